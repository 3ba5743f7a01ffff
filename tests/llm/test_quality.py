import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from shelfkin.llm import quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(windows)
    inside = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(5)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), len(lines))


def plain_estimate(x):
    """The same estimate with sorted distances instead of binned ones."""
    x = np.array(x)
    centre = np.array([np.sort(np.round(c * 200))[math.ceil(len(c) / 2) - 1] / 200 for c in x.T])
    inverse = np.diag(1 / (4 * np.square(quality.FLOORS)))
    for _ in range(quality.STEPS):
        d = np.einsum("ni,ij,nj->n", x - centre, inverse, x - centre)
        bins = np.floor(np.log(np.maximum(d, 0) + 1e-6) * 50)
        edge = np.sort(bins)[math.ceil(len(x) * quality.SUBSET) - 1]
        near = x[bins <= edge]
        centre = near.mean(axis=0)
        cov = near.T @ near / len(near) - np.outer(centre, centre)
        inverse = np.linalg.inv(cov * quality._consistency() + np.diag(np.square(quality.FLOORS)))
    return np.einsum("ni,ij,nj->n", x - centre, inverse, x - centre)


def vector(c):
    n, chars, symbols, dup, again, lines = c
    return [(math.log(chars / n) - math.log(5)) * n / (n + 50), math.sqrt(symbols / chars), math.sqrt(dup / lines), math.sqrt(again / n)]


def corpus(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 120))]
        if i % 9 == 0:
            words = [w + "%%##" for w in words]
        text = "".join(w + rng.choice([" ", " ", " ", "\n", "\t", "\x0b ", "\x1c "]) for w in words)
        if i % 4 == 0 and words:
            text += "\n" + "\n".join([" ".join(words[:6])] * rng.randint(1, 3))
        rows.append((i, text, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b", None, f"rare{i}"]), 1.0))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, distance double"


def test_statistics_equal_plain():
    texts = [r[1] for r in corpus(1)] + ["", None, "a b c d e a b c d e a b c d e", "x " * 500, "\n\n \n", "a\na\r\na\n a\na", "<|>#*$%&🙂"]
    got = quality.statistics(pa.array(texts, pa.string()))
    assert list(zip(*[v.tolist() for v in got.values()], strict=True)) == [plain(t) for t in texts]


def test_chi_square():
    assert abs(quality.chi2_quantile(0.95, 2) - 9.4877) < 1e-3 and abs(quality.chi2_quantile(0.95, 3) - 12.5916) < 1e-3


def test_estimates_equal_plain(spark):
    rows = corpus(2, 900)
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    groups, small = {}, {}
    for i, text, lang, source, _ in rows:
        c = plain(text)
        failed = c[0] < 10 or 100 * c[4] > 20 * c[0]
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words, got[i].base_failed) == (*c[:5], failed)
        if not failed:
            groups.setdefault((lang, source), []).append((i, vector(c)))
    for key in [k for k, v in groups.items() if len(v) < quality.LEAST_GROUP]:
        small.setdefault(key[0], []).extend(groups.pop(key))
    rest = [x for lang in list(small) if len(small[lang]) < quality.LEAST_GROUP for x in small.pop(lang)]
    want = {}
    for members in [*groups.values(), *small.values(), *([rest] if rest else [])]:
        want |= dict(zip([i for i, _ in members], plain_estimate([v for _, v in members]), strict=True))
    cutoff = quality.chi2_quantile(quality.KEEP, 2)
    assert {i for i, r in got.items() if not r.base_failed} == set(want)
    for i, d in want.items():
        assert abs(got[i].distance - d) < 1e-4 * max(1, d) and got[i].kept == (d <= cutoff)
    assert sum(not r.kept for r in got.values()) > 50


def test_odd_rows(spark):
    rows = [(1, None, None, None, 0.0), (2, "", "en", "a", 0.0), (None, "one two three four five six seven eight nine ten eleven", None, "a", 0.0)]
    rows += [(4, "alpha beta gamma delta " * 40_000, "en", "a", 0.0)] * 2
    got = quality.judged(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 5 and by[1].n_words == by[2].n_words == 0 and not by[1].kept and by[None].kept and by[4].base_failed
    assert quality.judged(spark.createDataFrame([], SCHEMA)).count() == 0


def test_labels(spark, data_dir):
    got = queries.op2_quality(spark, data_dir).join(spark.read.parquet(f"{data_dir}/labels.parquet"), "doc_id").filter("not base_failed").collect()
    assert np.mean([r.kept for r in got if r.quality == 1]) > 0.99 and np.mean([r.kept for r in got if r.quality == 0]) < 0.2
