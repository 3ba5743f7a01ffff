"""Byte-pair encoding and decoding with forced boundaries.

A pair of neighbouring bytes that no vocabulary token holds can never be merged across, so a
word is cut there and its fragments are merged on their own; the ids of the fragments follow
each other. A task keeps the fragments and words it has met.

Defined results: a null or empty text has no ids and decodes to an empty text. The strings of
added tokens are single ids wherever they stand. Repeated rows are kept; of the columns only
``doc_id`` is.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfkin.llm.arrow import slices
from shelfkin.shipping import ship

_NEVER = 1 << 40
_SHIFT = 20
#: Words and fragments a worker remembers before it starts afresh.
REMEMBERED = 250_000


#: Code points below this one are split by a plain pattern, texts with others by a full one.
LATIN = 0x250


def _class(*kinds: str) -> str:
    """The Latin code points of some general categories, for a character class."""
    return "".join(re.escape(chr(c)) for c in range(LATIN) if unicodedata.category(chr(c)).startswith(kinds))


def split_patterns(pattern: str) -> tuple[re.Pattern, regex.Pattern]:
    """The vocabulary's pre-splitting pattern for Latin texts and for all."""
    latin = pattern
    for name, members in ((r"\p{L}", _class("L")), (r"\p{N}", _class("N")), (r"\s", r"\t-\r\x85" + _class("Z"))):
        latin = latin.replace(name, members)
    return re.compile(latin), regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))


_BEYOND = re.compile(f"[^\\x00-{chr(LATIN - 1)}]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: visible
    Latin-1 letters stand for themselves, the other bytes take the letters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class Vocabulary:
    """Tables of one tokenizer file (a ``tokenizers`` JSON with a byte-level BPE model)."""

    def __init__(self, source: bytes):
        spec = json.loads(source)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocab.values(), *self.added.values()]))
        for text, at in [*vocab.items(), *self.added.items()]:
            self.tokens[at] = text
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[left] << _SHIFT | vocab[right]] = rank
            self.merged.append(vocab[left + right])
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + self.suffix] for c in letters]
        self.joined = self._joined(vocab, {c: b for b, c in enumerate(letters)})
        self.forced = bytes(~self.joined.reshape(-1))
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.latin, self.any = split_patterns(pattern)
        every = sorted(self.added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, every)) + ")") if every else None
        self.words: dict[str, bytes] = {}
        self.fragments: dict[tuple[bytes, bool], list[int]] = {}

    def _joined(self, vocab: dict[str, int], byte_of: dict[str, int]) -> np.ndarray:
        """Which pairs of bytes stand next to each other inside some token."""
        joined = np.zeros((256, 256), bool)
        for text in vocab:
            body = [byte_of[c] for c in text.removesuffix(self.suffix)]
            joined[body[:-1], body[1:]] = True
        return joined

    def cuts(self, word: bytes) -> list[bytes]:
        """The fragments between forced boundaries."""
        forced = self.forced
        borders = [i for i, (a, b) in enumerate(zip(word, word[1:], strict=False), 1) if forced[a << 8 | b]]
        if not borders:
            return [word]
        edges = [0, *borders, len(word)]
        return [word[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    def _fragment(self, piece: bytes, last: bool) -> list[int]:
        ids = [self.inner[b] for b in piece]
        if last:
            ids[-1] = self.final[piece[-1]]
        return self._merge_long(ids) if len(ids) > 256 else self._merge(ids)

    def _merge(self, ids: list[int]) -> list[int]:
        """The best-ranked pair first, the leftmost of equals, until none is left."""
        get, merged = self.ranks.get, self.merged
        ranks = [get(a << _SHIFT | b, _NEVER) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) != _NEVER:
            i = ranks.index(best)
            ids[i] = made = merged[best]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get(ids[i - 1] << _SHIFT | made, _NEVER)
            if i < len(ranks):
                ranks[i] = get(made << _SHIFT | ids[i + 1], _NEVER)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same order of merges by a heap over a linked list."""
        n, get = len(ids), self.ranks.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i) for i in range(n - 1) if (r := get(ids[i] << _SHIFT | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or get(ids[i] << _SHIFT | ids[j]) != rank:
                continue
            ids[i], ids[j] = self.merged[rank], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := get(ids[a] << _SHIFT | ids[b])) is not None:
                    heapq.heappush(heap, (r, a))
        return [x for x in ids if x >= 0]

    def word(self, text: str) -> bytes:
        """The ids of one word as 32-bit integers."""
        pieces = self.cuts(text.encode("utf-8", "surrogatepass"))
        if len(pieces) == 1:
            return array("i", self._fragment(pieces[0], True)).tobytes()
        ids: list[int] = []
        for k, piece in enumerate(pieces):
            key = piece, k == len(pieces) - 1
            known = self.fragments.get(key)
            if known is None:
                known = self._fragment(*key)
                if len(piece) <= 64:
                    if len(self.fragments) >= REMEMBERED:
                        self.fragments.clear()
                    self.fragments[key] = known
            ids += known
        return array("i", ids).tobytes()

    def _plain(self, text: str, out: list[bytes]) -> None:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each letter on its own
        text = text.lower()
        split = self.any if _BEYOND.search(text) else self.latin
        known = self.words
        for w in split.findall(text):
            got = known.get(w)
            if got is None:
                got = self.word(w)
                if len(known) >= REMEMBERED:
                    known.clear()
                if len(w) <= 64:
                    known[w] = got
            out.append(got)

    def encode(self, text: str | None) -> bytes:
        out: list[bytes] = []
        if text and self.special and any(s in text for s in self.added):
            for part in self.special.split(text):
                if part in self.added:
                    out.append(array("i", [self.added[part]]).tobytes())
                else:
                    self._plain(part, out)
        elif text:
            self._plain(text, out)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        return " ".join([self.tokens[i] for i in ids.tolist()])


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(source: bytes) -> Vocabulary:
    """The tables of a file's content, built once per process."""
    key = hashlib.sha256(source).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(source)
    return _LOADED[key]


def read_source(path: str) -> bytes:
    """The tokenizer file, read on the driver and sent with the job (a few megabytes)."""
    with open(path, "rb") as f:
        return f.read()


def _encode(column: pa.Array, table: Vocabulary) -> pa.Array:
    parts = [table.encode(t.as_py()) for t in column]
    ends = np.cumsum([0, *map(len, parts)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def _decode(column: pa.Array, table: Vocabulary) -> pa.Array:
    values, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return pa.array([table.decode(values[a:b]) for a, b in zip(ends, ends[1:], strict=False)], pa.string())


def encoded(spark: SparkSession, text: Column, source: bytes) -> Column:
    """``array<int>`` of token ids."""
    ship(spark)
    return F.arrow_udf(lambda column: _encode(column, vocabulary(source)), "array<int>").asNondeterministic()(text)


def decoded(spark: SparkSession, ids: Column, source: bytes) -> Column:
    """The text of token ids: their strings, joined by one space."""
    ship(spark)
    return F.arrow_udf(lambda column: _decode(column, vocabulary(source)), "string").asNondeterministic()(ids)


def round_trip(docs: DataFrame, source: bytes) -> DataFrame:
    """``(doc_id, ids, decoded)`` of every row: encoded, then decoded from the ids, in one worker
    and a few megabytes of text at a time."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary(source)
        for batch in batches:
            for a, b in slices(batch.column("text")):
                ids = _encode(batch.column("text").slice(a, b - a), table)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), ids, _decode(ids, table)], names=["doc_id", "ids", "decoded"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def digests(docs: DataFrame, source: bytes, keep_ids: bool = False) -> DataFrame:
    """``doc_id``, the number of tokens, SHA-256 of the ids and of the decoded text (and the
    ids)."""
    return round_trip(docs, source).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *([F.col("ids")] if keep_ids else []),
    )
