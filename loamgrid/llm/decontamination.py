"""Finds benchmark passages in documents: a set join of item windows, by their rarest shingle.

A window is a run of consecutive words of an item, and counts as contained only
if all its words occur in a row; so the necessary prefix of a window, with its
shingles ordered by rarity, is its one rarest shingle. Documents are scanned for
those shingles only; the place of a match fixes where the window would begin,
the document's own bounds are checked against the window's length, and every
word is compared before anything counts.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.llm import wordhash as wh
from loamgrid.llm.common import slices, stored

_U = np.uint64


@dataclass(frozen=True)
class Windows:
    """words: window length; shingle: words of a shingle; block_bytes: text of items that one pass over the documents
    may hold, which makes an index of some eight times that in each task."""

    words: int = 10
    shingle: int = 3
    block_bytes: int = 8 << 20


@dataclass
class _Index:
    stream: np.ndarray  # hashes of the items' words, one item behind the other
    start: np.ndarray  # distinct window -> its first word in the stream
    length: np.ndarray  # its words
    names_from: np.ndarray  # window -> range in names
    names: np.ndarray  # numbers of items
    items: list[str]
    sizes: list[int]  # words that shingles have: shorter ones only for very short items
    keys: np.ndarray  # sorted rarest shingles
    key_from: np.ndarray  # key -> range in key_window and key_place
    key_window: np.ndarray
    key_place: np.ndarray


class _Known:
    """Looks hashes up in a sorted array, behind a small bit table that turns most away."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = 16
        while (1 << bits) < 32 * len(keys) and bits < 26:
            bits += 1
        self.shift = _U(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[(keys >> self.shift).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in h, numbers of their keys)."""
        at = np.flatnonzero(self.table[(h >> self.shift).astype(np.int64)])
        no = np.searchsorted(self.keys, h[at])
        no[no == len(self.keys)] = 0
        ok = self.keys[no] == h[at] if len(self.keys) else np.zeros(0, bool)
        return at[ok], no[ok]


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


@dataclass
class _Items:
    """Distinct windows of a block of items, before their rarest shingles are known."""

    stream: np.ndarray
    start: np.ndarray
    length: np.ndarray
    names_from: np.ndarray
    names: np.ndarray
    items: list[str]
    sizes: list[int]

    def shingles(self, place: int) -> tuple[np.ndarray, np.ndarray]:
        """(windows that have a shingle at this place, its hash)."""
        out, whole = [], []
        for k in self.sizes:
            at = np.flatnonzero((np.minimum(self.length, self.sizes[-1]) == k) & (self.length >= place + k))
            out.append(at)
            whole.append(wh.runs(self.stream, k)[self.start[at] + place])
        return np.concatenate(out), np.concatenate(whole)


def _windows(ids: list[str | None], texts: list[str | None], how: Windows) -> _Items:
    """The distinct windows of items, by whole arrays; equal ones are told by two hashes of all their words."""
    parts, counts = [], []
    for part in slices(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.large_string())}), "text"):
        h, first, _, _ = wh.words(part.column("text"), wh.ALNUM)
        parts.append(h)
        counts.append(np.diff(first))
    stream = np.concatenate([*parts, np.zeros(0, _U)])
    n = np.concatenate([*counts, np.zeros(0, np.int64)])
    size = np.minimum(n, how.words)
    many = np.where(n > 0, n - size + 1, 0)
    item = np.repeat(np.arange(len(n)), many)
    start = np.repeat(np.cumsum(n) - n, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    length = size[item]
    one, two = length.astype(_U), wh.mix(length.astype(_U) + _U(1))
    for i in range(how.words):
        # Words beyond a short window count as nothing.
        w = np.where(i < length, stream[np.minimum(start + i, max(0, len(stream) - 1))], _U(0)) if len(stream) else np.zeros(0, _U)
        one, two = wh.mix(one * wh._STEP + w), wh.mix(two ^ w) * wh._STEP + _U(i)
    items = sorted({i for i in ids if i is not None})
    number = {x: k for k, x in enumerate(items)}
    owner = np.array([number.get(i, -1) for i in ids], np.int64)[item] if len(item) else np.zeros(0, np.int64)
    order = np.lexsort((owner, two, one))
    one, two, owner = one[order], two[order], owner[order]
    fresh = np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1]))) if len(order) else np.zeros(0, bool)
    window = np.cumsum(fresh) - 1
    named = (owner >= 0) & (fresh | np.concatenate(([True], owner[1:] != owner[:-1])) if len(order) else fresh)
    lead = order[fresh]
    names_from = np.concatenate(([0], np.cumsum(np.bincount(window[named], minlength=len(lead)))))
    sizes = np.unique(np.minimum(length, how.shingle)).tolist()
    return _Items(stream, start[lead].astype(np.int32), length[lead].astype(np.int32), names_from.astype(np.int32), owner[named].astype(np.int32), items, sizes)


def _rarest(of: _Items, shingles: np.ndarray, counts: np.ndarray) -> _Index:
    """The index, with each window's rarest shingle by its count over all documents; ties go to the smaller hash, then the earlier place."""
    order = np.empty(len(counts), np.int64)
    order[np.lexsort((shingles, counts))] = np.arange(len(counts))
    best = np.full(len(of.start), len(counts), np.int64)
    place = np.zeros(len(of.start), np.int8)
    for p in range(int(of.length.max(initial=0))):
        at, whole = of.shingles(p)
        by = np.argsort(whole)
        rank = np.empty(len(at), np.int64)
        rank[by] = order[np.searchsorted(shingles, whole[by])]
        less = rank < best[at]
        best[at[less]], place[at[less]] = rank[less], p
    key = shingles[np.argsort(order)[best]] if len(counts) else np.zeros(0, _U)
    by = np.argsort(key, kind="stable")
    keys, at = np.unique(key[by], return_index=True)
    return _Index(of.stream, of.start, of.length, of.names_from, of.names, of.items, of.sizes, keys, np.append(at, len(by)).astype(np.int32), by.astype(np.int32), place[by])


def _counts(docs: DataFrame, shingles: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Occurrences over all documents of the ``shingles`` (sorted) that items have."""
    sent = docs.sparkSession.sparkContext.broadcast((shingles, sizes))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sizes = sent.value
        known, total = _Known(keys), np.zeros(len(keys), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                h, first, _, _ = wh.words(part.column("text"), wh.ALNUM)
                end = np.repeat(first[1:], np.diff(first))
                for k in sizes:
                    at, no = known.find(wh.runs(h, k))
                    total += np.bincount(no[at + k <= end[at]], minlength=len(keys))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["no", "n"])

    total = np.zeros(len(shingles), np.int64)
    for r in docs.select("text").mapInArrow(count, "no long, n long").groupBy("no").agg(F.sum("n").alias("n")).toLocalIterator():
        total[r["no"]] = r["n"]
    return total


def _ranges(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, value) over all ranges."""
    n = end - begin
    of = np.repeat(np.arange(len(n)), n)
    return of, np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _matches(index: _Index, known: _Known, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, window) of every occurrence of a window inside one row."""
    row_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    starts, windows = [], []
    for k in index.sizes:
        at, no = known.find(wh.runs(h, k))
        # Parts with about as many windows to try, which bounds the memory that common shingles take.
        tries = np.cumsum(index.key_from[no + 1] - index.key_from[no].astype(np.int64))
        cuts = [*np.unique(np.searchsorted(tries, np.arange(0, int(tries[-1]) if len(tries) else 0, 1 << 18))).tolist(), len(at)]
        for lo, hi in itertools.pairwise(cuts):
            q, key = at[lo:hi], no[lo:hi]
            of, e = _ranges(index.key_from[key], index.key_from[key + 1])
            w = index.key_window[e]
            s = q[of] - index.key_place[e]
            row = row_of[q[of]]
            ok = (np.minimum(index.length[w], k) == k) & (s >= first[row]) & (s + index.length[w] <= first[row + 1])
            s, w = s[ok], w[ok]
            for i in range(int(index.length.max(initial=0))):
                n = index.length[w]
                ok = (i >= n) | (h[np.minimum(s + i, len(h) - 1)] == index.stream[np.minimum(index.start[w] + i, len(index.stream) - 1)])
                s, w = s[ok], w[ok]
            starts.append(s)
            windows.append(w)
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(windows)


def _pass(docs: DataFrame, index: _Index, how: Windows) -> DataFrame:
    """Adds one block of items to what earlier passes found: runs of hit words and item names."""
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        known = _Known(index.keys)
        for batch in batches:
            for part in slices(batch, "text"):
                h, first, _, _ = wh.words(part.column("text"), wh.ALNUM)
                start, window = _matches(index, known, h, first)
                row = np.searchsorted(first, start, side="right") - 1
                of, at = _ranges(index.names_from[window], index.names_from[window + 1])
                named = np.unique(np.stack((row[of], index.names[at])), axis=1) if len(of) else np.zeros((2, 0), np.int64)
                items = [set(x or ()) for x in part.column("items").to_pylist()]
                for r, i in named.T:
                    items[r].add(index.items[i])
                edge = np.zeros(len(h) + 1, np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + index.length[window], -1)
                hit = np.cumsum(edge[:-1]) > 0
                for r, spans in enumerate(part.column("spans").to_pylist()):
                    for s, e in zip((spans or [])[::2], (spans or [])[1::2], strict=True):
                        hit[first[r] + s : first[r] + e] = True
                runs = []
                for r in sorted({*row.tolist(), *(i for i, x in enumerate(part.column("spans").to_pylist()) if x)}):
                    own = np.concatenate(([0], hit[first[r] : first[r + 1]].astype(np.int8), [0]))
                    runs.append((r, np.flatnonzero(np.diff(own)).tolist()))
                spans = [None] * part.num_rows
                for r, x in runs:
                    spans[r] = x
                put = {"items": pa.array([sorted(x) for x in items], pa.list_(pa.string())), "spans": pa.array(spans, pa.list_(pa.int64())), "n_words": pa.array(np.diff(first))}
                yield pa.RecordBatch.from_arrays([put.get(n, part.column(i)) for i, n in enumerate(part.schema.names)], names=part.schema.names)

    return docs.mapInArrow(scan, docs.schema)


def hits(docs: DataFrame, benchmark: DataFrame, how: Windows = Windows()) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans) for each row of ``docs`` (doc_id, text).

    ``spans`` holds the hit runs as word numbers: from, to, from, to, ... Null
    and empty texts have no words; items without words have no windows, and a
    null item_id marks words but names no item. Repeated rows are judged each on
    its own; other columns are left aside. Items are held in blocks of bounded
    size, one pass over the documents each; without items nothing is hit.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = _scanned(docs, benchmark, how)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "items", "spans")


def clean(docs: DataFrame, benchmark: DataFrame, how: Windows = Windows()) -> DataFrame:
    """The rows of ``docs`` (text, ...), all columns kept, that hold no window of any item; see hits() for nulls and repeats."""
    names = [f"__{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index("text")]
    renamed = docs.toDF(*names).withColumnRenamed(text, "text")  # no clash with the columns that scanning adds
    kept = _scanned(renamed, benchmark, how).where("n_hit = 0")
    return kept.select(*["text" if n == text else n for n in names]).toDF(*docs.columns)


def _scanned(docs: DataFrame, benchmark: DataFrame, how: Windows) -> DataFrame:
    """``docs`` (text, ...) with n_words, items, spans and n_hit."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // how.block_bytes))
    # Windows of no item count the words.
    none = np.zeros(0, np.int32)
    nothing = _Index(np.zeros(0, _U), none, none, np.zeros(1, np.int32), none, [], [], np.zeros(0, _U), np.zeros(1, np.int32), none, none)
    out = docs.select("*", F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("array<string>").alias("items"), F.lit(None).cast("array<long>").alias("spans"))
    passes = 0
    for b in range(blocks):
        held = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toPandas()
        of = _windows(held["item_id"].tolist(), held["text"].tolist(), how)
        if not len(of.start):
            continue
        passes += 1
        shingles = _distinct(np.concatenate([_distinct(of.shingles(p)[1]) for p in range(int(of.length.max()))]))
        out = _pass(out, _rarest(of, shingles, _counts(docs, shingles, of.sizes)), how)
        if blocks > 1:
            out = stored(out)  # so that a task holds one index at a time, and a lost one costs one pass
    if not passes:
        out = _pass(out, nothing, how)
    pair = F.sequence(F.lit(0), F.floor(F.size("spans") / 2).cast("int") - 1)
    n_hit = F.when(F.size("spans") > 0, F.aggregate(pair, F.lit(0).cast("long"), lambda n, i: n + F.element_at("spans", 2 * i + 2) - F.element_at("spans", 2 * i + 1))).otherwise(F.lit(0).cast("long"))
    return out.withColumn("n_hit", n_hit)
