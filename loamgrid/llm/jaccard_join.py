"""Similarity join on word-shingle sets under a Jaccard threshold.

1. A fixed-size table of hashed shingle counts over all documents gives one
   global rare-first order (count, then hash). Any fixed order keeps prefix
   filtering exact, so hash clashes in the table cost time only.
2. Each document yields its size, a 128-bit hash of its set and its prefix: the
   rarest shingles, of which any partner must share one. Documents with equal
   sets are one node from here on.
3. Nodes meet on prefix shingles, which travel once, packed by ranges of their
   hashes; those that one node alone has go no further. First the few nodes of a
   rare shingle are all paired, and those of a crowded one with one of them
   picked at random; length and positional bounds thin the pairs; a suffix bound
   and the exact intersection decide each pair once. Then only nodes of one shingle that were not paired under it and
   are still in different components are paired, so a group of n near copies
   costs about n pairs and not n * n, and yet no two documents that are linked
   can end up apart.
4. Connected components give each document the smallest linked doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.llm import wordhash as wh
from loamgrid.llm.common import met_by, slices, small, stored
from loamgrid.llm.graph import components

_U = np.uint64
#: For each of 256 cells of the hash space, whether a set has an odd number of shingles there.
_PARITY = ("p0", "p1", "p2", "p3")


@dataclass(frozen=True)
class Jaccard:
    """words: shingle length; percent: similarity threshold; table_bits: log2 of the count table's size;
    picks: different random partners for each shingle in the first pass; rounds: further such passes at most,
    among nodes still apart; sent_ids: up to so many doc_ids of pairs are
    broadcast, so that only their texts leave the scan; beyond, ids and texts meet in a shuffle."""

    words: int = 5
    percent: int = 80
    table_bits: int = 20
    picks: int = 8
    rounds: int = 1
    sent_ids: int = 2_000_000


def _sets(part: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    h, first, _, _ = wh.words(part.column("text"))
    return wh.distinct(*wh.shingles(h, first, k))


def shingle_counts(docs: DataFrame, how: Jaccard) -> np.ndarray:
    """Counts of hashed shingles over all documents, in a table of 2**table_bits cells.

    Tasks send their tables in small blocks, which are added up in two steps, so
    neither a task nor the driver holds more than the table and a few hundred blocks.
    """
    size, block = 1 << how.table_bits, 1 << min(12, how.table_bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen = np.zeros(size, np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                value, _ = _sets(part, how.words)
                seen += np.bincount((value >> _U(64 - how.table_bits)).astype(np.int64), minlength=size)
        salt = TaskContext.get().partitionId() % 64
        blocks = seen.reshape(-1, block)
        some = np.flatnonzero(blocks.any(axis=1))
        for i in some:
            yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int32()), "salt": pa.array([salt], pa.int32()), "counts": pa.array([blocks[i].tobytes()], pa.binary())})

    def add(pdf):
        total = np.zeros(block, np.int64)
        for b in pdf["counts"]:
            total += np.frombuffer(b, np.int64)
        return pdf.head(1).assign(counts=[total.tobytes()])

    schema = "block int, salt int, counts binary"
    parts = docs.select("text").mapInArrow(count, schema)
    once = parts.groupBy("block", "salt").applyInPandas(add, schema)
    table = np.zeros(size, np.int64)
    for row in once.groupBy("block").applyInPandas(add, schema).toLocalIterator():
        table[row["block"] * block : (row["block"] + 1) * block] = np.frombuffer(row["counts"], np.int64)
    return np.minimum(table, 2**32 - 1).astype(np.uint32)


def signatures(docs: DataFrame, how: Jaccard) -> DataFrame:
    """(doc_id, n, h1, h2, p0 to p3, tokens): set size, hash of the set, parities, and the prefix, rarest first."""
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, how))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        for batch in batches:
            for part in slices(batch, "text"):
                rows = part.num_rows
                value, row = _sets(part, how.words)
                n = np.bincount(row, minlength=rows).astype(np.int64)
                h1, h2 = np.zeros(rows, _U), np.zeros(rows, _U)
                np.add.at(h1, row, wh.mix(value))
                np.add.at(h2, row, wh.mix(value ^ _U(0x5851F42D4C957F2D)))
                parity = np.zeros((rows, 4), _U)
                np.bitwise_xor.at(parity, (row, ((value >> _U(6)) & _U(3)).astype(np.int64)), _U(1) << (value & _U(63)))
                order = np.lexsort((value, table[(value >> _U(64 - how.table_bits)).astype(np.int64)], row))
                value = value[order]
                take = np.where(n > 0, n - (how.percent * n + 99) // 100 + 1, 0)
                begin = np.cumsum(n) - n
                at = np.repeat(begin, take) + np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(take))), pa.int32()), pa.array(value[at].view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), *(pa.array(parity[:, i].copy().view(np.int64)) for i in range(4)), tokens], names=["doc_id", "n", "h1", "h2", *_PARITY, "tokens"])

    return docs.select("doc_id", "text").mapInArrow(sign, f"doc_id long, n long, h1 long, h2 long, {' long, '.join(_PARITY)} long, tokens array<long>")


def _bounds(percent: int) -> str:
    """SQL: sides x and y may still reach the threshold, given one shared token with ``before`` and ``after``
    shingles around it that others have too, or may have. Cells with different parity differ in a shingle at least."""
    differ = " + ".join(f"bit_count(x.{p} ^ y.{p})" for p in _PARITY)
    need = f"ceil({percent} * (x.n + y.n) / {100 + percent}D - 1e-9)"
    return f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) AND least(x.before, y.before) + 1 + least(x.after, y.after) >= {need} AND {differ} <= x.n + y.n - 2 * {need}"


def _first(percent: int) -> str:
    """SQL, besides _bounds: the token is the first that x and y share, as far as ``earlier`` tells, so nothing before it counts."""
    need = f"ceil({percent} * (x.n + y.n) / {100 + percent}D - 1e-9)"
    return f"(greatest(x.before, y.before) > {_EARLIER} OR 1 + least(x.after, y.after) >= {need}) AND NOT arrays_overlap(x.earlier, y.earlier)"


#: Tokens before a shared one that are compared, at most; a pair that meets beyond them may be emitted more than once.
_EARLIER = 64


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` (token, node, n, pos, ...) with the numbers of shingles ``before`` and ``after`` that could be shared.

    Rows hold the prefix shingles by which a node can meet another. A shingle
    that both sides of a pair have, and that comes before one that they share in
    their prefixes, is in both prefixes itself; so of those before only rows
    count. Those after may be beyond the other side's prefix and count all.
    """
    out = rows.withColumn("before", F.row_number().over(Window.partitionBy("node").orderBy("pos")) - 1)
    return out.withColumn("after", F.col("n") - 1 - F.col("pos"))


#: A prefix shingle on its way, and how many of them a range of hashes gets, about.
_PLACE, _RANGE = np.dtype([("token", "<u8"), ("node", "<i8"), ("pos", "<u4")]), 1 << 18
#: Rows of a token that all meet each other at once; of more, all meet one.
_ALL = 8


def _pack(places: np.ndarray) -> bytes:
    """Bytes of ``places``, the first of each, then the second and so on: those of ids and places, mostly alike, then compress."""
    return places.view(np.uint8).reshape(len(places), _PLACE.itemsize).T.tobytes()


def _unpack(packs: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.ascontiguousarray(np.frombuffer(x.as_buffer(), np.uint8).reshape(_PLACE.itemsize, -1).T).view(_PLACE).ravel() for x in packs])


def _shared(single: DataFrame, how: Jaccard, ranges: int, freeing: list[DataFrame]) -> DataFrame:
    """(token, node, rank, few, again, n, pos, p0 to p3, before, after): prefix shingles of ``single`` that two nodes or more have.

    Rows of a token have ranks from 0 in a random order. Each meets those before
    it, or in a crowd the first only (these are ``few``); then all but the first
    meet ``again``.
    Only place and node travel with each shingle; what else a node has joins those that are left.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            many = np.diff(lists.offsets.to_numpy())
            places = np.empty(int(many.sum()), _PLACE)
            places["token"] = lists.flatten().to_numpy().view(_U)
            places["node"] = np.repeat(batch.column("node").to_numpy(), many)
            places["pos"] = np.arange(len(places)) - np.repeat(np.cumsum(many) - many, many)
            part = ((places["token"] >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            places, part = places[order], part[order]
            begin = np.flatnonzero(np.diff(part, prepend=-1))
            packs = [_pack(x) for x in np.split(places, begin[1:])] if len(places) else []
            yield pa.RecordBatch.from_arrays([pa.array(part[begin]), pa.array(packs, pa.binary())], names=["part", "places"])

    def meet(group: pa.Table) -> pa.Table:
        places = _unpack(group.column("places"))
        by = wh.mix(places["node"].view(_U) ^ wh.mix(places["token"] % _U(how.picks)))
        places = places[np.lexsort((by, places["token"]))]
        begin = np.flatnonzero(np.concatenate(([True], places["token"][1:] != places["token"][:-1])))
        sizes = np.diff(begin, append=len(places))
        many, rank = np.repeat(sizes, sizes), np.arange(len(places)) - np.repeat(begin, sizes)
        places, many, rank = places[many > 1], many[many > 1], rank[many > 1]
        # Of those that all meet, the last stands before none.
        few = np.where(many > _ALL, rank == 0, rank < many - 1)
        columns = {"token": places["token"].copy().view(np.int64), "node": places["node"], "pos": places["pos"].astype(np.int32), "rank": rank.astype(np.int32), "few": few, "again": (rank > 0) & (many > _ALL)}
        return pa.table(columns)

    packed = single.select("node", "tokens").mapInArrow(pack, "part int, places binary")
    rows = packed.groupBy("part").applyInArrow(meet, "token long, node long, pos int, rank int, few boolean, again boolean")
    return stored(_placed(rows.join(single.drop("tokens"), "node")), freeing)


def verified(docs: DataFrame, pairs: DataFrame, how: Jaccard) -> DataFrame:
    """The pairs (a, b) of doc_ids, each given once, whose shingle sets reach the threshold; a stored table."""
    pivots = (np.arange(1, 16, dtype=np.uint64) << _U(60)).astype(_U)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                value, row = _sets(part, how.words)
                raw = value.tobytes()
                end = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=part.num_rows)))) * 8
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([raw[s:e] for s, e in zip(end[:-1], end[1:], strict=True)], pa.binary())], names=["doc_id", "items"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                if len(x) > len(y):
                    x, y = y, x
                need = -(-how.percent * (len(x) + len(y)) // (100 + how.percent))
                apart = np.abs(np.diff(np.searchsorted(x, pivots), prepend=0, append=len(x)) - np.diff(np.searchsorted(y, pivots), prepend=0, append=len(y))).sum()
                if len(x) == 0 or apart > len(x) + len(y) - 2 * need:
                    keep.append(False)
                    continue
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                keep.append(int((y[at] == x).sum()) >= need)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ids = stored(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct())
    sets = stored(docs.select("doc_id", "text").join(small(ids, how.sent_ids), "doc_id", "left_semi").mapInArrow(load, "doc_id long, items binary"))
    if sets.count() > ids.count():  # some doc_id has several rows
        sets = stored(sets.distinct(), [sets])
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y")), "b")
    return stored(both.select("a", "b", "x", "y").mapInArrow(decide, "a long, b long"), [ids, sets])


def _apart(met: DataFrame, found: DataFrame | None, how: Jaccard) -> DataFrame:
    """Rows of ``met`` that meet again and whose shingle has nodes of several components, placed anew, with the component
    and ``earlier`` shingles.

    Where all nodes of a shingle are in one component already, no pair across
    components can meet or overlap. Without ``found`` each node is on its own.
    A pair that met under any shingle, as all did or one of it was first, is decided:
    the bounds hold for linked pairs under each shingle that they share. Of all
    other pairs both rows of each shared shingle are here, so counts of rows
    before are still no less than what such a pair may share.
    """
    left = met.where("again").select("token", "node", "n", "pos", *_PARITY)
    if found is None:
        left = left.withColumn("component", F.col("node"))
    else:
        left = left.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
        several = left.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
        left = met_by(left, several, "token", "left_semi")
    past = Window.partitionBy("node").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    # Only the first tokens are gathered, so a set of any size costs its rows and not their square.
    earlier = F.collect_list(F.when(F.col("before") < _EARLIER, F.col("token"))).over(past)
    return stored(_placed(left).withColumn("earlier", earlier))


def _paired(rows: DataFrame, few: DataFrame, condition: str) -> DataFrame:
    """x of ``rows`` beside y of ``few``, some for each token, under the same token; see met_by() for the complement."""
    y = few.withColumn("apart", F.bitwise_not("token")).drop("token")
    return rows.alias("x").join(y.alias("y"), F.expr(f"~x.token = y.apart AND {condition}"))


def _crowded(left: DataFrame, rows: int) -> bool:
    """Whether pairs across components would far outnumber the ``rows`` in which nodes met, so that merging components first pays."""
    k = left.groupBy("token", "component").agg(F.count(F.lit(1)).cast("double").alias("k")).groupBy("token").agg(F.sum("k").alias("s"), F.sum(F.col("k") * F.col("k")).alias("q"))
    r = k.agg(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2).alias("pairs")).first()
    return (r["pairs"] or 0) > 4 * rows


def _partners(left: DataFrame, how: Jaccard, again: int) -> DataFrame:
    """Distinct pairs (a, b) of each row's node with a random node of another component, under the same shingle."""
    pick = F.struct(F.xxhash64("node", F.pmod("token", F.lit(how.picks)), F.lit(again + 1)).alias("by"), *(F.col(c) for c in ("node", "n", "before", "after", *_PARITY)))
    best = left.groupBy("token", "component").agg(F.min(pick).alias("best"))
    two = best.withColumn("k", F.row_number().over(Window.partitionBy("token").orderBy("best.by", "component"))).where("k <= 2")
    met = _paired(left, two.select("token", "component", "best.*"), f"x.component <> y.component AND {_bounds(how.percent)}")
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


@dataclass(frozen=True)
class Joined:
    """members: (doc_id, n, node), one row for each document; links: (a, b) between nodes."""

    members: DataFrame
    links: DataFrame


def join(docs: DataFrame, how: Jaccard = Jaccard(), every_link: bool = False) -> Joined:
    """Links between documents of ``docs`` (doc_id, text) whose shingle sets are similar enough.

    ``every_link`` gives all links between different sets; without it, enough of
    them to connect all that are connected. Documents with equal sets share a
    node, the smallest doc_id. Null, empty and blank texts have empty sets and
    no links; rows with a null doc_id take no part in linking. Rows that share a
    doc_id are one document with several sets. Other columns are left aside.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = stored(signatures(docs, how))
    # Stored, so that joins with it have shuffles of their own on both sides, which Spark can split where copies crowd.
    nodes = stored(sig.where("n > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2").agg(F.min("doc_id").alias("node")))
    members = sig.select("doc_id", "n", "h1", "h2").join(nodes, ["h1", "h2"], "left")
    members = stored(members.withColumn("node", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("node")).otherwise(F.col("doc_id"))), [nodes])

    # Copies are the fewer rows by far in most corpora: their keys travel, and the prefixes stay where they are.
    row = F.xxhash64("doc_id", "h1", "h2")
    copies = members.where("n > 0 AND doc_id <> node").select(row.alias("row"))
    single = sig.where("n > 0 AND doc_id IS NOT NULL").withColumn("row", row).join(small(copies, how.sent_ids), "row", "left_anti")
    places = members.where("n > 0").agg(F.expr(f"sum(n - ({how.percent} * n + 99) div 100 + 1)")).first()[0] or 0
    ranges = max(places // _RANGE + 1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = _shared(single.select(F.col("doc_id").alias("node"), "n", *_PARITY, "tokens"), how, ranges, [sig])
    place = met.select("token", "node", "n", "before", "after", *_PARITY, "rank", "few")
    near = _paired(place.where("rank > 0").drop("few"), place.where("few").drop("few"), f"x.rank > y.rank AND x.node <> y.node AND {_bounds(how.percent)}")
    tried = stored(near.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct())
    links = verified(docs, tried, how)

    if not every_link:
        for again in range(how.rounds):
            left = _apart(met, components(links), how)
            if not _crowded(left, met.count()):
                break
            more = verified(docs, stored(_partners(left, how, again).join(tried, ["a", "b"], "left_anti")), how)
            if more.isEmpty():
                break
            links = stored(links.unionByName(more))
        else:
            left = _apart(met, components(links), how)
    else:
        left = _apart(met, None, how)
    rest = left.alias("x").join(left.alias("y"), F.expr(f"x.token = y.token AND x.component < y.component AND {_bounds(how.percent)} AND {_first(how.percent)}"))
    rest = stored(rest.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"))
    return Joined(members.select("doc_id", "n", "node"), links.unionByName(verified(docs, rest, how)))


def near_duplicates(docs: DataFrame, how: Jaccard = Jaccard()) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``; see join() for nulls, blanks and repeats.

    component_id is the smallest doc_id that links reach, the document's own
    included; it is null for a null doc_id. An empty table gives no rows.
    """
    found = join(docs, how)
    of = components(found.links)
    return found.members.join(of, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))
