"""Toxicity of texts, by a classifier whose scores do not hang on which group a text names.

A word's score is the sum of the weights of its hashed features (the word, its first and last
letters). Neighbouring sentences form passages of about ``PASSAGE_WORDS`` words, whose score sums
over their distinct words, and a text's score is a smooth maximum over its passages, so a toxic
passage in a long text is not averaged away and stray or repeated words do not add up. The weights are fitted to document
labels by logistic loss with a counterfactual penalty: in every labelled sentence that names a
group, the term is swapped for others of its kind, and the squared change of the sentence's score
is added to the loss; in sentences without one a term is put in, and the change that brings is
penalised likewise. Terms that merely stand near insults therefore get no weight.

The model is fitted on the driver from a bounded sample (``training_sample``). Scoring is one
narrow pass over the texts.

Defined results: a null or empty text, or one without a word, gets the score of a text whose
sentences say nothing; of label rows that disagree about one id the larger label counts, and of
rows of one id the smallest text is learned from; without a row to learn from every score is 0.5
or less. Repeated rows get equal answers; other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfkin.llm.arrow import ALNUM, RangeHashes, flat, lower, slices, words
from shelfkin.shipping import ship

BUCKETS = 1 << 18
HEADS, TAILS = (2, 3, 4, 5), (3, 4)
SENTENCE_WORDS, PASSAGE_WORDS = 64, 96
SHARPNESS = 2.0
PER_CLASS, MOST_CHARS = (3000, 1500), 20_000
_SLICE, _SAMPLE_SLICE = 2 << 20, 1 << 20
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?\n"]] = True

# Terms that name groups, by kind. Words of one kind are swapped for one another.
TERMS = {
    "gender": "women men woman man girls boys female male transgender frauen männer femmes hommes mujeres hombres",
    "religion": "christian christians muslim muslims jewish jews hindu hindus buddhist buddhists sikh catholic protestant atheist"
    " christen muslime juden chrétiens musulmans juifs cristianos musulmanes judíos",
    "origin": "african asian european american latino arab indian chinese mexican german french spanish polish turkish russian"
    " immigrants refugees foreigners migrants ausländer flüchtlinge étrangers réfugiés extranjeros refugiados",
    "skin": "black white brown schwarze weiße noirs blancs negros blancos",
    "orientation": "gay lesbian bisexual straight heterosexual homosexual queer schwule lesben homosexuelle homosexuels lesbiennes homosexuales",
    "ability": "deaf blind disabled autistic paralyzed wheelchair behinderte blinde handicapés sourds discapacitados ciegos",
    "age": "old young elderly teenagers seniors senioren jugendliche vieux jeunes ancianos jóvenes",
}


@dataclass
class Model:
    """``weights`` of hashed features (the first one is 0 and stands for none) and the bias."""

    weights: np.ndarray
    bias: float


def word_features(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: RangeHashes) -> np.ndarray:
    """Buckets of every word's features, ``(words, features)``. Heads and tails are counted in
    code points; a word without letters beyond one has no such feature (bucket 0)."""
    letters = np.flatnonzero((data & 0xC0) != 0x80)
    before = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    first, last = before[start], before[end]
    letters = np.append(letters, len(data))
    size = last - first
    out = np.zeros((len(start), 1 + len(HEADS) + len(TAILS)), np.int32)

    def buckets(a: np.ndarray, b: np.ndarray, tag: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (hashes(a, b) + np.uint64(tag)) * np.uint64(0x9E3779B97F4A7C15)
        return (1 + (h >> np.uint64(40)) % np.uint64(BUCKETS - 1)).astype(np.int32)

    out[:, 0] = buckets(start, end, 1)
    for column, k in enumerate(HEADS, 1):
        to = letters[np.minimum(first + k, last)]
        out[:, column] = np.where(size > k, buckets(start, np.where(size > k, to, end), 1 + k), 0)
    for column, k in enumerate(TAILS, 1 + len(HEADS)):
        start_at = letters[np.maximum(last - k, first)]
        out[:, column] = np.where(size > k, buckets(np.where(size > k, start_at, start), end, 100 + k), 0)
    return out


def sentences(data: np.ndarray, start: np.ndarray, row: np.ndarray) -> np.ndarray:
    """First word of every sentence. Sentences end at a full stop, a question or exclamation mark, a
    line's or the text's end; runs of more than ``SENTENCE_WORDS`` words are cut into pieces."""
    if not len(start):
        return np.zeros(0, np.int64)
    ends = np.concatenate(([0], np.cumsum(_END[data], dtype=np.int64)))[start]
    new = np.concatenate(([True], (ends[1:] != ends[:-1]) | (row[1:] != row[:-1])))
    first = np.flatnonzero(new)
    place = np.arange(len(start)) - np.repeat(first, np.diff(np.append(first, len(start))))
    return np.flatnonzero(place % SENTENCE_WORDS == 0)


def passages(sentence: np.ndarray, row: np.ndarray) -> np.ndarray:
    """First word of every passage: of the sentences (given by their first words) the first one to
    start in each stretch of ``PASSAGE_WORDS`` words of a text; ``row`` is that of every word."""
    if not len(sentence):
        return sentence
    of = row[sentence]
    stretch = (sentence - np.searchsorted(row, of)) // PASSAGE_WORDS
    return sentence[np.concatenate(([True], (of[1:] != of[:-1]) | (stretch[1:] != stretch[:-1])))]


def pooled(score: np.ndarray, row: np.ndarray, rows: int, empty: float) -> np.ndarray:
    """The smooth maximum of every row's passage scores; ``row`` ascends."""
    out = np.full(rows, empty)
    if len(score):
        has, first, count = np.unique(row, return_index=True, return_counts=True)
        top = np.maximum.reduceat(score, first)
        rest = np.add.reduceat(np.exp(SHARPNESS * (score - np.repeat(top, count))), first)
        out[has] = top + np.log(rest) / SHARPNESS
    return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


# ---------------------------------------------------------------- fitting


@dataclass
class Sample:
    """Texts as numbered distinct words: ``word`` of every token (once per passage), the ``first``
    token and the text (``row``) of every passage, ``features`` of every distinct word, and the
    counterfactuals: the word numbers ``old`` (-1: none) and ``new`` and how many ``times``."""

    word: np.ndarray
    first: np.ndarray
    row: np.ndarray
    features: np.ndarray
    old: np.ndarray
    new: np.ndarray
    times: np.ndarray


def _sample(texts: list[str]) -> Sample:
    """The texts, a slice at a time, and the group terms, so that all of these have numbers."""
    kinds = [kind.split() for kind in TERMS.values()]
    terms = [t for kind in kinds for t in kind]
    column = pa.array([*texts, *terms], pa.string())
    parts, known, features, base = [], np.zeros(0, np.uint64), [], 0
    for a, b in slices(column, _SAMPLE_SLICE):
        data, at = flat(column.slice(a, b - a))
        data = lower(data)
        start, end, row = words(data, at, ALNUM)
        hashes = RangeHashes(data)
        each = hashes(start, end)
        own, place = np.unique(each, return_index=True)
        new = ~np.isin(own, known)
        known = np.concatenate((known, own[new]))
        features.append(word_features(data, start[place[new]], end[place[new]], hashes))
        sentence = sentences(data, start, row)
        opening = passages(sentence, row)
        parts.append((each, sentence + base, opening + base, row[opening] + a))
        base += len(each)
    hashed, sentence, first, row = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(known)
    word = order[np.searchsorted(known, hashed, sorter=order)]
    features = np.concatenate(features)
    # Every term is a text of one word, so the last words are the terms.
    tokens = len(word) - len(terms)
    number = dict(zip(terms, word[tokens:].tolist(), strict=True))
    word, sentence, row = word[:tokens], sentence[sentence < tokens], row[first < tokens]
    first = first[first < tokens]
    counterfactual = swaps(word, sentence, [[number[t] for t in kind] for kind in kinds])
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(word))))
    once = np.unique(of * len(features) + word)
    return Sample(once % len(features), np.searchsorted(once, np.arange(len(first)) * len(features)), row, features, *counterfactual)


def swaps(word: np.ndarray, sentence: np.ndarray, kinds: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(old, new, times)``: the counterfactual sentences of a text of numbered words.

    Every group term of a sentence is swapped for all others of its kind. A sentence without one
    gets a term, in turn, and is compared with itself without it (``old`` is -1).
    """
    kind_of = {a: numbers for numbers in kinds for a in numbers}
    every = [a for numbers in kinds for a in numbers]
    held = np.isin(word, every)
    times: Counter[tuple[int, int]] = Counter()
    for a, n in zip(*(x.tolist() for x in np.unique(word[held], return_counts=True)), strict=True):
        times.update({(a, b): n for b in kind_of[a] if a != b})
    named = np.add.reduceat(held.astype(np.int64), sentence) if len(sentence) else np.zeros(0)
    times.update((-1, every[i % len(every)]) for i in range(int((named == 0).sum())))
    old, new = (np.array([k[i] for k in times], np.int64) for i in (0, 1))
    return old, new, np.array(list(times.values()), np.float64)


def train(texts: list[str], labels: list[int], steps: int = 150, rate: float = 0.1, sparse: float = 2e-3,
          ridge: float = 1e-4, fairness: float = 1.0) -> Model:
    """Fit by Adam on all texts at once, both labels of equal weight: a score of 0.5 is where they
    would be equally likely if they were equally frequent.

    A first run chooses features: ``sparse`` weighs the sum of absolute weights, so a feature of
    few texts never leaves zero. A second one fits the chosen ones with the squares weighed by
    ``ridge``. ``fairness`` weighs the counterfactual penalty in both.
    """
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), -3.0)
    toxic = y.mean()
    sample = _sample(texts)
    each = np.where(y > 0, 0.5 / toxic, 0.5 / (1 - toxic)) / len(y)
    start = np.zeros(BUCKETS + 1)
    start[-1] = -3.0
    w = _adam(sample, y, each, start, steps, rate, fairness, sparse=sparse)
    w = _adam(sample, y, each, w, steps, rate, fairness, ridge=ridge)
    return Model(w[:-1].astype(np.float32), float(w[-1]))


def _adam(sample: Sample, y: np.ndarray, each: np.ndarray, w: np.ndarray, steps: int, rate: float, fairness: float,
          sparse: float = 0.0, ridge: float = 0.0) -> np.ndarray:
    """Weights and, last, the bias. With ``ridge`` a weight of zero stays there."""
    old, new = sample.old, sample.new
    times = 2 * fairness * sample.times / max(sample.times.sum(), 1)
    there = old >= 0
    sizes = np.diff(np.append(sample.first, len(sample.word)))
    held = np.ones(len(w), bool) if sparse else w != 0
    held[0], held[-1] = False, True
    shrink = np.full(len(w), sparse)
    shrink[-1] = 0.0
    m, v = np.zeros(len(w)), np.zeros(len(w))
    for step in range(1, steps + 1):
        of_word = w[sample.features].sum(axis=1)
        score = np.add.reduceat(of_word[sample.word], sample.first) if len(sample.first) else np.zeros(0)
        total = pooled(score, sample.row, len(y), 0.0)
        miss = each * (_sigmoid(total + w[-1]) - y)
        pull = np.exp(SHARPNESS * (score - total[sample.row])) * miss[sample.row]
        by_word = np.bincount(sample.word, np.repeat(pull, sizes), len(of_word))
        change = times * (of_word[new] - np.where(there, of_word[old], 0.0))
        by_word += np.bincount(new, change, len(of_word)) - np.bincount(old[there], change[there], len(of_word))
        g = np.bincount(sample.features.ravel(), np.repeat(by_word, sample.features.shape[1]), len(w)) + ridge * w
        g[-1] = miss.sum()
        g[~held] = 0.0
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        pace = rate / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w = w - pace * m / (1 - 0.9**step)
        w = np.sign(w) * np.maximum(np.abs(w) - pace * shrink, 0.0)
    return w


def training_sample(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = PER_CLASS,
                    most_chars: int = MOST_CHARS) -> DataFrame:
    """``(text, toxic)`` to learn from, of rows whose ``crc32(doc_id) % 5`` is not 0.

    Of each label, up to ``per_class`` ids are taken by hash order: first by a threshold from the
    label's count, so that no task sorts more than about that many. Their whole texts are taken
    unless longer than ``most_chars`` code points.
    """
    known = (
        labels.filter("toxic in (0, 1) and doc_id is not null and crc32(cast(doc_id as string)) % 5 != 0")
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    count = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    cells = 1 << 30
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(cells))
    chosen = None
    for label, want in enumerate(per_class):
        most = min(cells, int(cells * 1.25 * want / max(count.get(label, 0), 1)) + 1)
        part = known.filter((F.col("toxic") == label) & (cell < most)).orderBy(cell, "doc_id").limit(want)
        chosen = part if chosen is None else chosen.unionByName(part)
    size = F.length("text")
    texts = docs.select("doc_id", "text").filter((size > 0) & (size <= most_chars))
    held = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return held.select("text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = PER_CLASS, most_chars: int = MOST_CHARS,
        fairness: float = 1.0) -> Model:
    """The model of a bounded sample (see ``training_sample``), trained on the driver."""
    sample = training_sample(docs, labels, per_class, most_chars)
    rows = sorted((r.text, int(r.toxic)) for r in sample.withColumn("text", F.lower("text")).collect())
    return train([t for t, _ in rows], [y for _, y in rows], fairness=fairness)


# ---------------------------------------------------------------- scoring


def scores(column: pa.Array, model: Model) -> np.ndarray:
    """The score of every (small-letter) text, from 0 to 1."""
    out = np.empty(len(column))
    for a, b in slices(column, _SLICE):
        data, at = flat(column.slice(a, b - a))
        data = lower(data)
        start, end, row = words(data, at, ALNUM)
        first = passages(sentences(data, start, row), row)
        hashes = RangeHashes(data)
        of_word = model.weights[word_features(data, start, end, hashes)].sum(axis=1, dtype=np.float64)
        says = np.flatnonzero(of_word)  # few words have a score; those count once per passage
        passage = np.searchsorted(first, says, "right") - 1
        own = hashes(start[says], end[says])
        order = np.lexsort((own, passage))
        same = np.zeros(len(says), bool)
        same[1:] = (np.diff(passage[order]) == 0) & (own[order[1:]] == own[order[:-1]])
        order = order[~same]
        score = np.bincount(passage[order], of_word[says[order]], len(first))
        out[a:b] = pooled(score, row[first], b - a, 0.0)
    return _sigmoid(out + model.bias)


def score(model: Model, text: Column) -> Column:
    """The score of every text; small letters are the engine's, as in training."""

    @F.arrow_udf("double")
    def judge(column: pa.Array) -> pa.Array:
        return pa.array(scores(column, model))

    return judge.asNondeterministic()(F.lower(text))


def scored(docs: DataFrame, model: Model, into: str = "toxicity") -> DataFrame:
    """``docs`` with the score of every text in a column ``into``; no shuffle."""
    ship(docs.sparkSession)
    return docs.withColumn(into, score(model, F.col("text")))


def clean(docs: DataFrame, model: Model, most: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``most``."""
    into = "__toxicity"
    return scored(docs, model, into).filter(F.col(into) < most).select(*[F.col(f"`{c}`") for c in docs.columns])
