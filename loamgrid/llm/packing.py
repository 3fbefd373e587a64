"""Cost-balanced packing of token runs into fixed-length training sequences.

A sequence's cost is linear plus quadratic in the pieces it holds (attention
stays inside a piece). Pieces are taken in descending length; each goes to the
cheapest sequence with room. Packing happens inside the scan's own tasks, so no
text or token moves between executors.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from loamgrid.llm.common import slices

#: Texts with this string, which has an id of its own, go through the slower tokenizer.
_SPECIAL = "<|endoftext|>"


def byte_bpe(path: str | None = None) -> Callable[[list[str]], list[list[int]]]:
    """Encoder for the public 50k byte-level BPE at ``path`` (a ``tokenizers`` file), as it is and without added tokens.

    The name of the special token has that token's id wherever a text spells it out. The same vocabulary's rank file beside it, where there is one, is read by a
    faster library that yields the same ids; tests hold the two against each other.
    """
    import base64
    import functools
    import os

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = path or public_tokenizers.path("byte_bpe_50k.json")

    @functools.cache
    def plain() -> Tokenizer:
        return Tokenizer.from_file(path)

    ranks = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks):
        return lambda texts: [e.ids for e in plain().encode_batch(texts, add_special_tokens=False)]
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(texts: list[str]) -> list[list[int]]:
        return [plain().encode(t, add_special_tokens=False).ids if _SPECIAL in t else fast.encode_ordinary(t) for t in texts]

    return encode


@dataclass(frozen=True)
class Packing:
    """length: tokens a sequence holds; linear, quadratic: cost of a piece of n tokens is linear*n + quadratic*n*n;
    pool: cut-off pieces that are packed together, which bounds a task's memory; end_id closes each document."""

    length: int = 1024
    linear: float = 1.0
    quadratic: float = 1.0 / 1024
    pool: int = 4096
    end_id: int = 0


def assign(sizes: np.ndarray, how: Packing = Packing()) -> list[tuple[int, int, int, int, int]]:
    """Packs pieces, longest first, each into the cheapest sequence that has room.

    There are as many sequences as the tokens need. A piece that fits nowhere
    fills the roomiest sequence, and its rest is packed in turn. Ties go to the
    earlier piece and the earlier sequence. Returns (piece, first token within
    the piece, tokens, sequence, offset), and never loses a token.
    """
    import heapq

    total = int(sizes.sum())
    room = np.full(-(-total // how.length), how.length, np.int64)
    cost = np.zeros(len(room))
    queue = [(-int(n), i, 0) for i, n in enumerate(sizes) if n > 0]
    heapq.heapify(queue)
    out = []
    while queue:
        n, i, start = heapq.heappop(queue)
        n = -n
        fits = room >= n
        j = int(np.argmin(np.where(fits, cost, np.inf))) if fits.any() else int(np.argmax(room))
        put = min(n, int(room[j]))
        out.append((i, start, put, j, how.length - int(room[j])))
        room[j] -= put
        cost[j] += how.linear * put + how.quadratic * put * put
        if put < n:
            heapq.heappush(queue, (put - n, i, start + put))
    return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"
_ARROW = pa.schema([(n, pa.float64() if n == "cost" else pa.int64()) for n in (x.split()[0] for x in SCHEMA.split(", "))])
_WITH_IDS = pa.schema([*_ARROW, pa.field("token_ids", pa.list_(pa.int32()))])


def pack(docs: DataFrame, encoder: Callable[[], Callable] = byte_bpe, how: Packing = Packing(), with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document of ``docs`` (doc_id, text; other columns are left aside).

    Null and empty texts are documents of the end token alone. A null doc_id is
    kept as null; repeated rows and repeated doc_ids are packed as documents of
    their own. An empty table gives no rows. A text of any length is cut into
    full sequences as it is read. sequence_id is unique: the task's partition in
    the upper bits, a counter in the lower 40; a task that runs again gives the
    same rows. ``with_ids`` adds the tokens themselves.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        base, used = TaskContext.get().partitionId() << 40, 0
        pool: list[tuple] = []

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*[(d, s, len(x), zlib.crc32(x.astype("<u4").tobytes()), n, q, o, how.linear * len(x) + how.quadratic * len(x) ** 2) for d, s, x, n, q, o in rows], strict=True))
            arrays = [pa.array(c, t) for c, t in zip(columns, _ARROW.types, strict=True)]
            if with_ids:
                arrays.append(pa.array([x.astype(np.int32) for *_, x, _, _, _ in rows], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, schema=_WITH_IDS if with_ids else _ARROW)

        def flush() -> pa.RecordBatch:
            nonlocal used
            rows = [(pool[i][0], pool[i][1] + a, pool[i][2][a : a + n], pool[i][3], base + used + j, o) for i, a, n, j, o in assign(np.array([len(p[2]) for p in pool]), how)]
            used += max(r[4] for r in rows) - base - used + 1
            pool.clear()
            return emit(rows)

        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                full = []
                texts = [t or "" for t in part.column("text").to_pylist()]
                for doc, got in zip(part.column("doc_id").to_pylist(), encode(texts), strict=True):
                    ids = np.array([*got, how.end_id], np.uint32)
                    whole = len(ids) // how.length * how.length
                    for s in range(0, whole, how.length):
                        full.append((doc, s, ids[s : s + how.length], len(ids), base + used, 0))
                        used += 1
                    if whole < len(ids):
                        pool.append((doc, whole, ids[whole:].copy(), len(ids)))
                    if len(pool) >= how.pool:
                        yield flush()
                if full:
                    yield emit(full)
        if pool:
            yield flush()

    schema = SCHEMA + (", token_ids array<int>" if with_ids else "")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, schema)
