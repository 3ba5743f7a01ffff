"""The same figures in plain Python, for small inputs."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np

from shelfkin.functions.text import ENGLISH_STOP_WORDS


def clean(text):
    if text is None:
        return ""
    text = re.sub(r"[^\w\s]", " ", re.sub(r"<[^>]+>", "", text))
    return " ".join(text.split()).lower()


def terms(text, stop=tuple(ENGLISH_STOP_WORDS)):
    kept = [w for w in clean(text).split(" ") if len(w) >= 2 and w not in stop]
    return kept + [f"{a} {b}" for a, b in zip(kept, kept[1:])]


def fit(texts, max_features=5000, min_df=2):
    cf, df = Counter(), Counter()
    for t in texts:
        found = terms(t)
        cf.update(found)
        df.update(set(found))
    kept = sorted((t for t in cf if df[t] >= min_df), key=lambda t: (-cf[t], t))[:max_features]
    return {t: math.log((1 + len(texts)) / (1 + df[t])) + 1 for t in sorted(kept)}


def vector(text, idf):
    counts = Counter(t for t in terms(text) if t in idf)
    raw = {t: n * idf[t] for t, n in counts.items()}
    norm = math.sqrt(sum(x * x for x in raw.values()))
    return {t: x / norm for t, x in raw.items()}


def cosine(a, b):
    return sum(w * b.get(t, 0.0) for t, w in a.items())


def top(ids, vectors, k, pad=False):
    out = {}
    for i in ids:
        scored = [(round(cosine(vectors[i], vectors[j]), 6), j) for j in ids if j != i]
        scored = sorted(scored, key=lambda s: (-s[0], s[1]))
        out[i] = [(j, s) for s, j in scored if s > 0 or pad][:k]
    return out


def dense(vectors, ids, idf):
    place = {t: p for p, t in enumerate(idf)}
    m = np.zeros((len(ids), len(idf)))
    for row, i in enumerate(ids):
        for t, w in vectors[i].items():
            m[row, place[t]] = w
    return m
