"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

A word's probability is that of its class in context, times that of its group
among the class's groups in the same context, times that of the word in its
group. Class and group come from softmaxes over hashed n-gram and skip features
(the word before, the one before that, both together, and, for the class, the
third back); the group's features are hashed with the class. Frequent words are
groups of their own, so context reaches the word itself; others share a group by
their last two bytes and follow exact counts there. Words never seen in training
share the mass that words seen once had, so probabilities add up to one over the
known words and one unknown.

Counts are exact over all training documents. The softmaxes are trained by
gradient updates in every task over all of its documents, in rounds after which
each feature's changes are averaged over the tasks that met it. The tables of
features grow with the words and tokens counted, up to a stated bound. Texts are
scored in sparse numpy batches; rare words meet their counts in a join, frequent
ones in a table of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.llm import wordhash as wh
from loamgrid.llm.common import slices, stored

_U = np.uint64
#: The token that closes each document, and what stands before its first word.
END = int(np.int64(0x454E44))
_BEFORE = 0


@dataclass(frozen=True)
class MaxEnt:
    """wide: classes, and groups in each; own: classes whose groups are one frequent word each, the other classes' groups go by
    a word's last two bytes; context: numbers that a context word can have, the first half for frequent words; pairs: hashed
    pairs of words; within: hashed features of groups, all three at least, as sized() makes them grow up to most_context,
    most_pairs and most_within; table: frequent words, at most, whose counts are sent along; rounds: of training, each over its
    own part of the documents; rate: of AdaGrad; batch: tokens."""

    wide: int = 16
    own: int = 7
    context: int = 4096
    pairs: int = 4096
    within: int = 1 << 15
    most_context: int = 1 << 15
    most_pairs: int = 1 << 18
    most_within: int = 1 << 18
    table: int = 1 << 18
    rounds: int = 3
    rate: float = 0.4
    batch: int = 16_384
    block: int = 1024

    @property
    def alone(self) -> int:
        """Frequent words that are groups of their own."""
        return self.own * self.wide

    def sized(self, words: int, tokens: int) -> MaxEnt:
        """This model for ``words`` different words in ``tokens``: four context numbers to the root of the words, a pair and a
        group's feature to the root of the tokens, in powers of two; the weights sent stay below 50 MB."""
        grown = lambda least, want, most: max(least, min(most, 1 << max(int(want) - 1, 0).bit_length()))
        return replace(
            self, context=grown(self.context, 4 * words**0.5, self.most_context), pairs=grown(self.pairs, tokens**0.5, self.most_pairs), within=grown(self.within, tokens**0.5, self.most_within)
        )

    @property
    def base(self) -> int:
        """Feature rows of classes: bias, three context places and pairs. Those of groups follow: a bias for each class, then hashes."""
        return 1 + 3 * self.context + self.pairs

    @property
    def rows(self) -> int:
        """All feature rows, filled up to whole blocks."""
        return -(-(self.base + self.wide + self.within) // self.block) * self.block

    def group(self, ending):
        """The group, counted over all classes, of a word that is not alone in one; for numbers, arrays and columns."""
        return (self.own + ending % 256 % (self.wide - self.own)) * self.wide + (ending - ending % 256) / 256 % self.wide


@dataclass
class Counts:
    total: int  # N
    words: int  # V
    once: int
    frequent: np.ndarray  # hashes of the most frequent words, sorted
    counts: np.ndarray
    rank: np.ndarray  # 0 is the most frequent
    mass: np.ndarray  # of each group: its words' counts, 0.1 more each

    @property
    def unknown(self) -> float:
        return (self.once + 0.1) / (self.total + self.once + 0.2)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, ending, first): each row's words and then its end; first[i] is where row i begins."""
    h, first, _, ends = wh.words(texts)
    raw, _ = wh.buffers(texts)
    last = wh._LOWER[raw[ends - 1]].astype(np.int64)
    ending = np.where(ends > 1, wh._LOWER[raw[np.maximum(ends - 2, 0)]], 0).astype(np.int64) * 256 + last if len(ends) else last
    rows = len(first) - 1
    at = np.arange(len(h)) + np.repeat(np.arange(rows), np.diff(first))
    out, end = np.full(len(h) + rows, END, np.int64), np.zeros(len(h) + rows, np.int64)
    out[at], end[at] = h.view(np.int64), ending
    return out, end, first + np.arange(rows + 1)


def count(docs: DataFrame, how: MaxEnt) -> tuple[DataFrame, Counts]:
    """Exact counts (h, n, ending) of all tokens of ``docs``, and what of them the model sends along."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def merged() -> np.ndarray:
            h, n, e = np.concatenate(held, axis=1)
            order = np.argsort(h, kind="stable")
            h, n, e = h[order], n[order], e[order]
            start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            return np.stack((h[start], np.add.reduceat(n, start), e[start]))

        def tell() -> pa.RecordBatch:
            h, n, e = merged()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n), pa.array(e)], names=["h", "n", "ending"])

        for batch in batches:
            for part in slices(batch, "text"):
                h, e, _ = _tokens(part.column("text"))
                uniq, at, n = np.unique(h, return_index=True, return_counts=True)
                held.append(np.stack((uniq, n, e[at])))
                if sum(x.shape[1] for x in held) > 2_000_000:
                    held[:] = [merged()]
                    if held[0].shape[1] > 1_000_000:
                        yield tell()
        if held:
            yield tell()

    vocabulary = stored(docs.select("text").mapInArrow(tally, "h long, n long, ending long").groupBy("h").agg(F.sum("n").alias("n"), F.min("ending").alias("ending")))
    sums = vocabulary.groupBy(how.group(F.col("ending")).cast("int").alias("group")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"), F.sum((F.col("n") == 1).cast("long")).alias("once")).collect()
    top = _frequent(vocabulary, how).sort_values(["n", "h"], ascending=[False, True], ignore_index=True)
    mass = np.zeros(how.wide * how.wide)
    for r in sums:
        mass[r["group"]] = r["n"] + 0.1 * r["words"]
    for i, (n, e) in enumerate(zip(top["n"][: how.alone], top["ending"][: how.alone], strict=True)):
        mass[i] = n + 0.1
        mass[int(how.group(e))] -= n + 0.1
    mass[mass < 0.5] = 0  # no word, but for rounding
    h = top["h"].to_numpy(np.int64)
    order = np.argsort(h)
    known = Counts(sum(r["n"] for r in sums), sum(r["words"] for r in sums), sum(r["once"] for r in sums), h[order], top["n"].to_numpy(np.int64)[order], order.astype(np.int64), mass)
    return vocabulary, known


def _frequent(vocabulary: DataFrame, how: MaxEnt):
    """The most frequent words, as many whole steps of frequency as the table holds: no more than that reaches the driver."""
    step = F.floor(F.log(F.col("n").cast("double")) * 64)
    sizes = vocabulary.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("step")).collect()
    held, least = 0, None
    for r in sizes:
        held += r["words"]
        if held > how.table:
            break
        least = r["step"]
    return vocabulary.where(F.lit(least is not None) & (step >= F.lit(least or 0))).toArrow().to_pandas()


class Features:
    """Turns tokens into feature rows, classes and groups."""

    def __init__(self, known: Counts, how: MaxEnt, table: bool):
        from loamgrid.llm.decontamination import _Known

        self.how, self.known = how, known
        use = np.ones(len(known.frequent), bool) if table else known.rank < how.context // 2
        # Unsigned order for the lookup.
        h, self.at = known.frequent[use].view(_U), np.flatnonzero(use)
        order = np.argsort(h)
        self.at = self.at[order]
        self.find = _Known(h[order])

    def __call__(self, h: np.ndarray, ending: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(feature rows of the class (token, 5), those of its groups (token, 4), group over all classes, number in the frequent table or -1)."""
        how = self.how
        place, no = self.find.find(h.view(_U))
        listed = np.full(len(h), -1, np.int64)
        listed[place] = self.at[no]
        rank = np.where(listed >= 0, self.known.rank[listed], 1 << 40) if len(self.known.rank) else np.full(len(h), 1 << 40)
        half = how.context // 2
        word = np.where(rank < half - 1, rank + 1, half + ending % half)
        group = np.where(rank < how.alone, rank, how.group(ending).astype(np.int64))
        back = []
        start = np.repeat(first[:-1], np.diff(first))
        spot = np.arange(len(h))
        for k in (1, 2, 3):
            b = np.full(len(h), _BEFORE, np.int64)
            b[k:] = word[:-k] if len(word) > k else word[:0]
            b[spot - start < k] = _BEFORE
            back.append(b)
        pair = (back[0] * 0x9E3779B1 + back[1] * 0x85EBCA77) >> 7
        rows = np.stack((np.zeros(len(h), np.int64), 1 + back[0], 1 + how.context + back[1], 1 + 2 * how.context + back[2], 1 + 3 * how.context + pair % how.pairs), axis=1)
        cls = group // how.wide
        mixed = ((rows[:, [1, 2, 4]] << 8 | cls[:, None]) * 0x9E3779B1) >> 12
        within = np.concatenate((how.base + cls[:, None], how.base + how.wide + mixed % how.within), axis=1)
        return rows, within, group, listed


def _scores(w: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Each token's weights, added up and brought below zero; (class or place, token), as numpy is quick along rows."""
    x = w.take(rows[:, 0], axis=0)
    for k in range(1, rows.shape[1]):
        x += w.take(rows[:, k], axis=0)
    x = np.ascontiguousarray(x.T)
    x -= x.max(axis=0)
    return x


def _log_chosen(w: np.ndarray, rows: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    x = _scores(w, rows)
    own = x[chosen, np.arange(len(chosen))]
    return own.astype(np.float64) - np.log(np.exp(x, out=x).sum(axis=0))


def log_group(w: np.ndarray, rows: np.ndarray, within: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The natural logarithm of each token's group's probability in its context."""
    return _log_chosen(w, rows, group // w.shape[1]) + _log_chosen(w, within, group % w.shape[1])


def _descend(w: np.ndarray, seen: np.ndarray, rows: np.ndarray, chosen: np.ndarray, rate: float) -> None:
    """One AdaGrad step on a batch, in place: a feature's gradient is what its tokens were given less what they had."""
    g = _scores(w, rows)
    np.exp(g, out=g)
    g /= g.sum(axis=0)
    g[chosen, np.arange(len(chosen))] -= 1
    g = g.astype(np.float64)
    slot = np.zeros(len(w), np.int64)
    for k in range(rows.shape[1]):
        slot[:] = 0
        slot[rows[:, k]] = 1
        touched = np.flatnonzero(slot)
        slot[touched] = np.arange(len(touched))
        at = slot.take(rows[:, k])
        total = np.stack([np.bincount(at, weights=c, minlength=len(touched)) for c in g], axis=1).astype(np.float32)
        past = seen.take(touched, axis=0) + total * total
        seen[touched] = past
        w[touched] = w.take(touched, axis=0) - rate * total / np.sqrt(past + 1.0)


def start(known: Counts, how: MaxEnt) -> np.ndarray:
    """Untrained weights: the biases give each class and group its share of the counts, and nothing to one without words."""
    w = np.zeros((how.rows, how.wide), np.float32)
    mass = known.mass.reshape(how.wide, how.wide)
    w[0] = np.log(mass.sum(axis=1) + 1e-9)
    w[how.base : how.base + how.wide] = np.log(mass + 1e-9)
    return w


def train(docs: DataFrame, known: Counts, how: MaxEnt) -> np.ndarray:
    """Weights (feature row, class or place in it) after ``rounds`` passes, which together take in each document of ``docs`` once."""
    sc = docs.sparkSession.sparkContext
    w = start(known, how)
    fixed = sc.broadcast(known)
    blocks = how.rows // how.block

    for turn in range(how.rounds if known.total else 0):
        sent = sc.broadcast(w)

        def learn(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            make, before = Features(fixed.value, how, False), sent.value
            mine, seen, tokens = before.copy(), np.zeros_like(before), 0
            for batch in batches:
                for part in slices(batch, "text"):
                    h, ending, first = _tokens(part.column("text"))
                    rows, within, group, _ = make(h, ending, first)
                    for s in range(0, len(h), how.batch):
                        e = s + how.batch
                        _descend(mine, seen, rows[s:e], group[s:e] // how.wide, how.rate)
                        _descend(mine, seen, within[s:e], group[s:e] % how.wide, how.rate)
                    tokens += len(h)
            if tokens:
                weight = np.where((seen > 0).any(axis=1), np.float32(tokens / 1e6), np.float32(0))
                change = ((mine - before) * weight[:, None]).reshape(blocks, -1)
                weight = weight.reshape(blocks, -1)
                salt = TaskContext.get().partitionId() % 64
                for i in range(blocks):
                    yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int32()), "salt": pa.array([salt], pa.int32()), "weight": pa.array([weight[i].tobytes()], pa.binary()), "change": pa.array([change[i].tobytes()], pa.binary())})

        def add(pdf):
            total = lambda parts: [sum(np.frombuffer(b, np.float32).astype(np.float64) for b in parts).astype(np.float32).tobytes()]
            return pdf.head(1).assign(weight=total(pdf["weight"]), change=total(pdf["change"]))

        schema = "block int, salt int, weight binary, change binary"
        part = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(how.rounds)) == turn).select("text")
        w = w.copy()
        for r in part.mapInArrow(learn, schema).groupBy("block", "salt").applyInPandas(add, schema).groupBy("block").applyInPandas(add, schema).toLocalIterator():
            weight = np.frombuffer(r["weight"], np.float32)[:, None]
            w[r["block"] * how.block : (r["block"] + 1) * how.block] += np.frombuffer(r["change"], np.float32).reshape(how.block, -1) / np.where(weight > 0, weight, 1)
    return w


def score(docs: DataFrame, vocabulary: DataFrame, known: Counts, w: np.ndarray, how: MaxEnt) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs`` (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast((known, w))
    bottom = known.total + 0.1 * (known.words + 1)
    seen_mass = np.log10(1 - known.unknown)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w = sent.value
        make = Features(known, how, True)
        log_mass = np.log10(np.maximum(known.mass, 0.1))
        row_no = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, "text"):
                h, ending, first = _tokens(part.column("text"))
                feature, within, group, listed = make(h, ending, first)
                lp = np.empty(len(h))
                for s in range(0, len(h), how.batch):
                    e = min(s + how.batch, len(h))
                    lp[s:e] = log_group(w, feature[s:e], within[s:e], group[s:e])
                lp = lp / np.log(10) + seen_mass - log_mass[group]
                rows = part.num_rows
                row = np.repeat(np.arange(rows), np.diff(first))
                own = listed >= 0
                n = np.log10(known.counts[listed[own]] + 0.1) if own.any() else np.zeros(0)
                per = lambda x, keep: np.bincount(row[keep], weights=x, minlength=rows)  # noqa: B023, E731
                tokens, hits = np.diff(first), np.bincount(row[own], minlength=rows)
                columns = {"row": np.arange(rows) + row_no, "h": wh.mix((np.arange(rows) + row_no).astype(_U)).view(np.int64), "whole": np.ones(rows, bool), "tokens": tokens, "known": hits, "base": per(n, own) - hits * np.log10(bottom), "score": per(n + lp[own], own)}
                ids = part.column("doc_id")
                # Rare words: one entry for each document and word, to meet the word's count.
                r, x, y = row[~own], h[~own], lp[~own]
                order = np.lexsort((x, r))
                r, x, y = r[order], x[order], y[order]
                if len(r):
                    at = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (r[1:] != r[:-1]))))
                    rare = {"row": r[at] + row_no, "h": x[at], "whole": np.zeros(len(at), bool), "tokens": np.diff(np.append(at, len(r))), "known": np.zeros(len(at), np.int64), "base": np.zeros(len(at)), "score": np.add.reduceat(y, at)}
                    columns = {k: np.concatenate((columns[k], rare[k])) for k in columns}
                    ids = pa.concat_arrays([ids, ids.take(pa.array(r[at]))])
                row_no += rows
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(v) for v in columns.values())], names=["doc_id", *columns])

    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = text.mapInArrow(scan, "doc_id long, row long, h long, whole boolean, tokens long, known long, base double, score double")
    met = found.join(vocabulary.select(F.col("h").alias("h"), F.col("n").alias("n")), "h", "left")
    n = F.col("n")
    base = F.when(F.col("whole"), F.col("base")).otherwise(F.col("tokens") * F.log10((F.coalesce(n, F.lit(0)) + 0.1) / F.lit(bottom)))
    model = F.when(F.col("whole"), F.col("score")).when(n.isNull(), F.col("tokens") * F.lit(float(np.log10(known.unknown)))).otherwise(F.col("score") + F.col("tokens") * F.log10(n + 0.1))
    each = met.select("row", "doc_id", F.when(F.col("whole"), F.col("tokens")).otherwise(0).alias("n_tokens"), F.when(F.col("whole"), F.col("known")).when(n.isNotNull(), F.col("tokens")).otherwise(0).alias("n_known"), base.alias("base_score"), model.alias("score"))
    total = each.groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return total.select("doc_id", "n_tokens", "n_known", F.lit(known.total).cast("long").alias("train_tokens"), "base_score", "score")


def fit_and_score(docs: DataFrame, training: DataFrame, how: MaxEnt = MaxEnt()) -> DataFrame:
    """Scores each row of ``docs`` (doc_id, text) by a model of ``training`` (doc_id, text); see score() for the columns.

    Null and empty texts consist of the end alone. Without training documents
    every token is unknown. Words are told apart by 64-bit hashes. Repeated rows
    are scored each; other columns are left aside. base_score is the unigram
    score, score the model's log10 probability of the text.
    """
    training = training.select("doc_id", "text")
    vocabulary, known = count(training, how)
    how = how.sized(known.words, known.total)
    return score(docs, vocabulary, known, train(training, known, how), how)
