"""Language of words and documents by a linear-chain conditional random field.

Every word gets a score per language from hashed character n-grams, its prefix and suffix, the
word itself and the lexicons learned with it; learned transitions link neighbouring words, and
forward-backward gives each word's probabilities. A document's language is the one with the
largest sum over its words, so code-switched text is labelled word by word first.

Defined results: a null text or one without a letter is ``und`` with score 0, as is everything
where no row can be learned from. Repeated rows get equal answers; other columns are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfkin.llm.arrow import flat, give_back, slices
from shelfkin.shipping import ship

UNKNOWN = "und"
RESULT = "struct<lang_pred: string, score: double, n_words: long, n_switches: long>"
BUCKETS = 1 << 16
_SLICE = 2 << 20
_TABLES: dict[str, np.ndarray] = {}


@dataclass
class Crf:
    """``weights`` (bucket x language) of hashed features, ``lexicon`` (bucket x language) of
    known words, ``known`` (language x language) its weights, ``steps`` the transitions."""

    languages: list[str]
    weights: np.ndarray
    lexicon: np.ndarray
    known: np.ndarray
    steps: np.ndarray


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Which code points are letters, and every code point's small letter."""
    if not _TABLES:
        every = [chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x110000)]
        small = [s.lower() for s in every]
        _TABLES["letter"] = np.array([s.isalpha() for s in every])
        _TABLES["small"] = np.array([ord(t if len(t) == 1 else s) for s, t in zip(every, small, strict=True)], np.uint32)
    return _TABLES["letter"], _TABLES["small"]


@dataclass
class Words:
    """Words of some texts: ``row`` of each, and the buckets of their features."""

    row: np.ndarray
    first: np.ndarray  # place of each word's first letter among all letters
    grams: list[np.ndarray]  # one bucket per letter
    own: list[np.ndarray]  # one bucket per word
    whole: np.ndarray  # bucket of the word in the lexicon


# Odd multipliers, one per place of a feature.
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def _bucket(tag: int, *parts: np.ndarray) -> np.ndarray:
    h = parts[0] * _ODD[0]
    for odd, part in zip(_ODD[1:], parts[1:], strict=False):
        h += part * odd
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D + 2 * tag)
    return h >> np.uint32(16)


def words_of(column: pa.Array) -> Words:
    """Words are runs of letters; features look at small letters."""
    letter, small = _letters()
    data, at = flat(column)
    point = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[at]
    inside = letter[point]
    border = np.zeros(len(point) + 1, bool)
    border[at] = True
    starts = inside & (np.concatenate(([True], ~inside[:-1])) | border[:-1]) if len(point) else inside
    ends = inside & (np.concatenate((~inside[1:], [True])) | border[1:]) if len(point) else inside
    start_at = np.flatnonzero(starts)
    row = np.searchsorted(at, start_at, "right") - 1
    x = small[point[inside]]
    starts, ends = starts[inside], ends[inside]
    first = np.flatnonzero(starts)
    last = np.flatnonzero(ends)
    none = np.uint32(0)
    left = np.where(starts, none, np.concatenate(([none], x[:-1])) if len(x) else x)
    right = np.where(ends, none, np.concatenate((x[1:], [none])) if len(x) else x)
    with np.errstate(over="ignore"):
        grams = [_bucket(2, left, x), _bucket(3, left, x, right)]
        length = last - first + 1

        def letter_at(place: np.ndarray, there: np.ndarray) -> np.ndarray:
            return np.where(there, x[np.clip(place, 0, max(len(x) - 1, 0))], none) if len(x) else x

        head = [letter_at(first + k, length > k) for k in range(3)]
        tail = [letter_at(last - k, length > k) for k in range(4)]
        within = np.arange(len(x), dtype=np.uint32) - np.repeat(first.astype(np.uint32), length)
        spread = x * _ODD[0] + within * _ODD[1]
        spread ^= spread >> np.uint32(13)
        spread *= _ODD[2]
        spread ^= spread >> np.uint32(16)
        sums = np.add.reduceat(spread, first, dtype=np.uint32) if len(first) else x
        whole = _bucket(9, sums)
        own = [_bucket(4, *head), _bucket(5, *tail[:3]), _bucket(6, *tail), _bucket(7, sums)]
    return Words(row, first, grams, own, whole)


def emissions(words: Words, model: Crf) -> np.ndarray:
    """The score of every word for every language."""
    if not len(words.first):
        return np.zeros((0, len(model.languages)), np.float32)
    letters = model.weights[words.grams[0]]
    letters += model.weights[words.grams[1]]
    score = np.add.reduceat(letters, words.first, axis=0)
    for bucket in words.own:
        score += model.weights[bucket]
    return score + model.lexicon[words.whole] @ model.known


def forward_backward(score: np.ndarray, first: np.ndarray, length: np.ndarray, steps: np.ndarray,
                     pairs: np.ndarray | None = None) -> np.ndarray:
    """Probability of every word's language. Sequences are ``length`` words from ``first`` on;
    all of them move one word at a time, the longest first. ``pairs`` collects the expected
    number of each transition."""
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    active = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), "left")
    local = np.exp(score - score.max(axis=1, keepdims=True)) if len(score) else score
    move = np.exp(steps).astype(local.dtype)
    ahead = np.empty_like(local)
    for t, n in enumerate(active):
        at = first[:n] + t
        now = local[at] if t == 0 else local[at] * (ahead[at - 1] @ move)
        ahead[at] = now / now.sum(axis=1, keepdims=True)
    out = np.empty_like(local)
    back = np.ones((len(first), local.shape[1]), local.dtype)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = first[:n] + t
        both = ahead[at] * back[:n]
        out[at] = both / both.sum(axis=1, keepdims=True)
        pull = local[at] * back[:n]
        pull /= pull.sum(axis=1, keepdims=True)
        if t:
            if pairs is not None:
                joint = ahead[at - 1][:, :, None] * move[None] * pull[:, None, :]
                pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            back[:n] = pull @ move.T
    return out


def train(texts: list[str], labels: list[str], epochs: int = 5, sequence: int = 48, seed: int = 7) -> Crf:
    """Fit by Adam on the log-likelihood. Training sequences are spliced from runs of different
    texts, so that transitions between languages are learned too."""
    languages = sorted(set(labels))
    n = len(languages)
    model = Crf(languages, np.zeros((BUCKETS, n), np.float32), np.zeros((BUCKETS, n), np.float32),
                np.zeros((n, n), np.float32), np.zeros((n, n), np.float32))
    words = words_of(pa.array(texts, pa.string()))
    if n < 2 or not len(words.first):
        return model
    label = np.array([languages.index(x) for x in labels])[words.row]
    seen = np.zeros((BUCKETS, n))
    np.add.at(seen, (words.whole, label), 1)
    model.lexicon[:] = seen >= 3
    rng = np.random.default_rng(seed)
    runs, place = [], 0
    while place < len(label):
        stop = min(len(label), place + int(rng.integers(4, 97)), int(np.searchsorted(words.row, words.row[place], "right")))
        runs.append(np.arange(place, stop))
        place = stop
    order = np.concatenate([runs[i] for i in rng.permutation(len(runs))])
    size = np.diff(np.append(words.first, len(words.grams[0])))
    slots = [model.weights, model.known, model.steps]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in slots]
    cut = [order[i : i + sequence] for i in range(0, len(order), sequence)]
    batches = [cut[i : i + 24] for i in range(0, len(cut), 24)]
    step = 0
    for _ in range(epochs):
        for b in rng.permutation(len(batches)):
            chosen = np.concatenate(batches[b])
            length = np.array([len(c) for c in batches[b]])
            ends = np.cumsum(size[chosen])
            letters = np.repeat(words.first[chosen] - (ends - size[chosen]), size[chosen]) + np.arange(ends[-1])
            part = Words(words.row[chosen], ends - size[chosen], [g[letters] for g in words.grams],
                         [o[chosen] for o in words.own], words.whole[chosen])
            first = np.cumsum(length) - length
            expected = np.zeros((n, n))
            chance = forward_backward(emissions(part, model), first, length, model.steps, expected)
            miss = chance.astype(np.float64)
            miss[np.arange(len(chosen)), label[chosen]] -= 1
            held = np.ones(len(chosen), bool)
            held[first] = False
            follow = np.flatnonzero(held)
            np.add.at(expected, (label[chosen][follow - 1], label[chosen][follow]), -1)
            weights = np.zeros((BUCKETS, n))
            by_letter = np.repeat(miss, size[chosen], axis=0)
            for k in range(n):
                for bucket, of in [*((g, by_letter) for g in part.grams), *((o, miss) for o in part.own)]:
                    weights[:, k] += np.bincount(bucket, of[:, k], BUCKETS)
            gradients = [weights, model.lexicon[part.whole].T @ miss, expected]
            step += 1
            for w, g, (m, v) in zip(slots, gradients, moments, strict=True):
                g = (g / len(chosen) + 1e-4 * w / len(chosen)).astype(np.float32)
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return model


def _answers(column: pa.Array, model: Crf) -> pd.DataFrame:
    count, n = len(column), len(model.languages)
    best, score = np.full(count, -1), np.zeros(count)
    n_words, switches = np.zeros(count, np.int64), np.zeros(count, np.int64)
    _, at = flat(column)
    order = np.argsort(np.diff(at), kind="stable")  # like lengths move together
    column = column.take(pa.array(order))
    for a, b in slices(column, _SLICE) if n else []:
        parts, rows, base = [], [], a
        for c, d in slices(column.slice(a, b - a), 1 << 18):
            words = words_of(column.slice(a + c, d - c))
            parts.append(emissions(words, model))
            rows.append(words.row + base + c)
        row, part = np.concatenate(rows), np.concatenate(parts)
        if not len(row):
            continue
        has, first, length = np.unique(row, return_index=True, return_counts=True)
        chance = forward_backward(part, first, length, model.steps)
        total = np.add.reduceat(chance, first, axis=0, dtype=np.float64)
        win = total.argmax(axis=1)
        named = chance.argmax(axis=1)
        turn = np.concatenate(([0], named[1:] != named[:-1])).astype(np.int64)
        turn[first] = 0
        to = order[has]
        best[to], score[to] = win, np.clip(total[np.arange(len(win)), win] / length, 0, 1)
        n_words[to], switches[to] = length, np.add.reduceat(turn, first)
    names = np.array([*model.languages, UNKNOWN], dtype=object)
    return pd.DataFrame({"lang_pred": names[best], "score": score, "n_words": n_words, "n_switches": switches})


def label(model: Crf, text: Column, tidy: bool = False) -> Column:
    """The struct ``RESULT`` for every text. Its words are labelled inside the task, ``tidy`` after
    giving back the memory that the worker holds from other stages."""

    @F.arrow_udf(RESULT)
    def answer(column: pa.Array) -> pa.Array:
        if tidy:
            give_back()
        found = _answers(column, model)
        kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64()]
        return pa.StructArray.from_arrays([pa.array(found[c], k) for c, k in zip(found, kinds, strict=True)], names=list(found))

    return answer.asNondeterministic()(text)


def training_sample(docs: DataFrame, texts_per_language: int = 120, most_chars: int = 20_000) -> DataFrame:
    """``(text, lang)`` to learn from: of rows whose ``crc32(doc_id) % 5`` is not 0, up to
    ``texts_per_language`` whole texts of at most ``most_chars`` code points, by hash order."""
    fit = docs.select("doc_id", "text", "lang").filter(
        "lang is not null and crc32(cast(doc_id as string)) % 5 != 0 and length(text) between 1 and " + str(most_chars)
    )
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    return fit.withColumn("nth", nth).filter(F.col("nth") <= texts_per_language).select("text", "lang")


def fit(docs: DataFrame, texts_per_language: int = 120, most_chars: int = 20_000) -> Crf:
    """The model of a bounded sample (see ``training_sample``), trained on the driver."""
    rows = training_sample(docs, texts_per_language, most_chars).collect()
    rows.sort(key=lambda r: (r.lang, r.text))
    return train([r.text for r in rows], [r.lang for r in rows])


def identify(docs: DataFrame, model: Crf, into: str = "language", tidy: bool = False) -> DataFrame:
    """``docs`` with a column ``into`` of kind ``RESULT``; no shuffle."""
    ship(docs.sparkSession)
    return docs.withColumn(into, label(model, F.col("text"), tidy))


def accepted(docs: DataFrame, model: Crf, least: float = 0.35) -> DataFrame:
    """The rows of ``docs`` whose words agree on a language: ``und`` and those with a score
    below ``least`` go."""
    into = "__language"
    named = identify(docs, model, into, tidy=True)
    keep = (F.col(f"{into}.lang_pred") != UNKNOWN) & (F.col(f"{into}.score") >= least)
    return named.filter(keep).select(*[F.col(f"`{c}`") for c in docs.columns])
