"""Toxicity scores from a weighted lexicon matched by one Aho-Corasick pass.

Texts are folded first: lower case, look-alike letters and digit substitutions
become plain letters, everything else a space. Lexicon entries are whole words
or word beginnings, found and weighted on labelled rows, together with a short
fixed list. Hits inside exception phrases do not count. The sum of weights, plain
and normalised by length, goes through a logistic curve fitted on the same rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.common import slices, stored

#: Look-alike letters, then digits and signs that stand for letters.
_LOOK_ALIKES = dict(zip("авекмнорстухіјѕԁɡαβεηικνορτυχаеорсух", "abekmhopctyxijsdgabeniknoptuxaeopcyx", strict=True))
_STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
#: Full-width Latin letters follow the plain ones at a fixed distance.
_WIDE = {chr(0xFF41 + i): chr(97 + i) for i in range(26)}
_FOLD = str.maketrans(_LOOK_ALIKES | _STANDS_FOR | _WIDE)
_GAP = re.compile(r"[\W_]+")
#: Words that count without any labelled rows, and phrases in which they are harmless; more of both are learned.
SEED = ("idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting", "imbecile", "dumbass")
EXCEPTIONS = ("pond scum", "soap scum", "sore loser rule")


@dataclass(frozen=True)
class Lexicon:
    """The bounded labelled sample that is fitted (``toxic`` and ``clean`` rows, chosen by a hash of doc_id) and what
    an entry must bring: ``least`` toxic texts, a share of ``precision`` of toxic ones among its texts, and a
    log-likelihood gain of ``gain``; at most ``entries`` are kept. Of beginnings that tell equally much the longest wins.
    A phrase of a hit's word and the word beside it becomes an exception if ``least`` clean texts have it and a text
    with it is less likely toxic than any text."""

    toxic: int = 4_000
    clean: int = 12_000
    least: int = 4
    precision: float = 0.5
    gain: float = 16.0
    entries: int = 4_000
    shortest: int = 3
    longest: int = 7
    seed_weight: float = 3.0
    exceptions: tuple[str, ...] = EXCEPTIONS
    seed: tuple[str, ...] = SEED


@dataclass
class Model:
    weights: dict[str, float]  # " word " or " begin"
    exceptions: list[str]
    mean: list[float] = field(default_factory=lambda: [0.0, 0.0])
    scale: list[float] = field(default_factory=lambda: [1.0, 1.0])
    curve: list[float] = field(default_factory=lambda: [-3.0, 1.0, 1.0])


def fold(text: str | None) -> str:
    """The words of a text, folded, each between single spaces; null is empty."""
    return f" {_GAP.sub(' ', (text or '').lower().translate(_FOLD)).strip()} "


def patterns(folded: str, how: Lexicon) -> set[str]:
    """Entries that a text could support: its words, and beginnings of words."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in range(how.shortest, min(len(w), how.longest + 1)))
    return out


def mine(rows: DataFrame, how: Lexicon) -> dict[str, float]:
    """Weighted entries from ``rows`` (text, toxic); equal texts count once."""
    rows = rows.groupBy(F.xxhash64("text").alias("key")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        texts = [0, 0]

        def tell() -> pa.RecordBatch:
            keys = list(seen[0].keys() | seen[1].keys())
            out = pa.RecordBatch.from_pydict({"entry": pa.array(keys, pa.string()), "clean": pa.array([seen[0][k] for k in keys], pa.int64()), "toxic": pa.array([seen[1][k] for k in keys], pa.int64())})
            seen[0].clear()
            seen[1].clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                texts[toxic] += 1
                seen[toxic].update(patterns(fold(text), how))
                if len(seen[0]) + len(seen[1]) > 500_000:
                    yield tell()
        yield tell()
        yield pa.RecordBatch.from_pydict({"entry": pa.array([""]), "clean": pa.array([texts[0]], pa.int64()), "toxic": pa.array([texts[1]], pa.int64())})

    counted = stored(rows.mapInArrow(count, "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(f"entry = '' OR toxic >= {how.least}"))
    total = counted.where("entry = ''").first()
    weights = {f" {w} ": how.seed_weight for w in how.seed}
    if total is None or not total["toxic"] or not total["clean"]:
        return weights
    bad, good = float(total["toxic"]), float(total["clean"])
    base = bad / (bad + good)
    n = F.col("toxic") + F.col("clean")
    gain = F.col("toxic") * F.log(F.col("toxic") / n / base) + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / n / (1 - base))).otherwise(0.0)
    strong = counted.where((F.col("entry") != "") & (F.col("toxic") / n > how.precision)).withColumn("gain", gain).where(F.col("gain") >= how.gain)
    taken: set[str] = set()
    for r in strong.orderBy(F.desc("gain"), F.col("entry").endswith(" "), F.desc(F.length("entry")), "entry").limit(how.entries).toLocalIterator():
        e = r["entry"]
        over = {e[:k] for k in range(how.shortest + 1, len(e))} & taken
        if not over and not any(t.startswith(e) for t in taken):
            taken.add(e)
            weights[e] = math.log((r["toxic"] + 0.5) / (bad + 1)) - math.log((r["clean"] + 0.5) / (good + 1))
    for e in list(weights):
        if e not in taken and ({e[:k] for k in range(how.shortest + 1, len(e))} & taken):
            del weights[e]  # a learned beginning already counts this word
    return weights


def _outside(hits: list[tuple], spared: list[tuple]) -> list[tuple]:
    """The hits (begin, end, weight) that lie inside no spared stretch, by one sweep over both in order of their beginnings."""
    out, k, reach = [], 0, -1
    spared.sort(key=lambda x: x[0])
    for h in sorted(hits, key=lambda x: x[0]):
        while k < len(spared) and spared[k][0] <= h[0]:
            reach = max(reach, spared[k][1])
            k += 1
        if h[1] > reach:
            out.append(h)
    return out


def spare(rows: DataFrame, weights: dict[str, float], how: Lexicon) -> list[str]:
    """Exception phrases from ``rows`` (text, toxic): two words, one of them hit, that speak against toxicity; equal texts count once."""
    rows = rows.groupBy(F.xxhash64("text").alias("key")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
    sent = rows.sparkSession.sparkContext.broadcast(weights)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(Model(sent.value, []))
        for batch in batches:
            out: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                for phrase in match.phrases(text):
                    out.setdefault(phrase, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_pydict({"phrase": pa.array(out, pa.string()), "clean": pa.array([x[0] for x in out.values()], pa.int64()), "toxic": pa.array([x[1] for x in out.values()], pa.int64())})

    share = rows.agg(F.avg("toxic").alias("share")).first()["share"] or 0.0
    counted = rows.mapInArrow(count, "phrase string, clean long, toxic long").groupBy("phrase").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    kind = counted.where((F.col("clean") >= how.least) & ((F.col("toxic") + 0.5) / (F.col("toxic") + F.col("clean") + 1) < share))
    return [r["phrase"] for r in kind.orderBy(F.desc("clean"), "phrase").limit(how.entries).toLocalIterator()]


class Matcher:
    def __init__(self, model: Model):
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        for e, w in model.weights.items():
            self.machine.add_word(e, (len(e), w))
        for e in model.exceptions:
            self.machine.add_word(f" {e} ", (len(e) + 2, None))
        self.machine.make_automaton()

    def phrases(self, text: str | None) -> set[str]:
        """Each hit's word with the word before it and with the one after it."""
        folded = fold(text)
        out = set()
        for begin in {end - n + 1 for end, (n, w) in self.machine.iter(folded) if w is not None}:
            stop = folded.find(" ", begin + 1)
            before, after = folded.rfind(" ", 0, begin), folded.find(" ", stop + 1)
            if before >= 0:
                out.add(folded[before + 1 : stop])
            if after >= 0:
                out.add(folded[begin + 1 : after])
        return out

    def features(self, text: str | None) -> tuple[float, float, int]:
        """(log of 1 + weights, the same for weights by 100 words, hits) of a whole text."""
        folded = fold(text)
        hits, spared = [], []
        for end, (n, w) in self.machine.iter(folded):
            (spared if w is None else hits).append((end - n + 1, end, w))
        if spared:
            hits = _outside(hits, spared)
        total = sum(w for _, _, w in hits)
        words = max(1, folded.count(" ") - 1)
        return math.log1p(total), math.log1p(100 * total / words), len(hits)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Newton's method for a ridge-penalised logistic regression; the first column is the constant."""
    beta = np.zeros(x.shape[1])
    held = np.diag([1e-6, *[ridge] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + held, x.T @ (y - p) - held @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def sample(docs: DataFrame, labels: DataFrame, how: Lexicon) -> DataFrame:
    """(text, toxic) of the bounded labelled sample; several labels of one document count as toxic if any is."""
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    size = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    rank = F.xxhash64("doc_id") / 2.0**64 + 0.5
    few = marks.where(((F.col("toxic") == 1) & (rank <= how.toxic / max(1, size.get(1, 0)))) | ((F.col("toxic") == 0) & (rank <= how.clean / max(1, size.get(0, 0)))))
    return stored(docs.join(F.broadcast(few.limit(2 * (how.toxic + how.clean))), "doc_id").select("text", "toxic"))


def fit(docs: DataFrame, labels: DataFrame, how: Lexicon = Lexicon()) -> Model:
    """Model from the labelled rows of ``docs`` (doc_id, text) in ``labels`` (doc_id, toxic); the fixed list alone without any."""
    rows = sample(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), how)
    weights = mine(rows, how)
    model = Model(weights, sorted({*how.exceptions, *spare(rows, weights, how)}))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(sent.value)
        for batch in batches:
            got = [match.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"a": pa.array([g[0] for g in got], pa.float64()), "b": pa.array([g[1] for g in got], pa.float64()), "toxic": batch.column("toxic")})

    pdf = rows.mapInArrow(measure, "a double, b double, toxic int").toPandas()
    if pdf["toxic"].nunique() > 1:
        x = pdf[["a", "b"]].to_numpy()
        model.mean, model.scale = x.mean(axis=0).tolist(), np.maximum(x.std(axis=0), 1e-6).tolist()
        z = (x - model.mean) / model.scale
        model.curve = _logistic(np.column_stack((np.ones(len(z)), z)), pdf["toxic"].to_numpy(float)).tolist()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, hits) for each row of ``docs`` (doc_id, text): a probability from 0 to 1 and the hits that count.

    Null and empty texts have no hits and get the score of such texts. Whole
    texts are read; repeated rows score alike and other columns are left aside.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        match = Matcher(model)
        c, a, b = model.curve
        for batch in batches:
            for part in slices(batch, "text"):
                got = [match.features(t) for t in part.column("text").to_pylist()]
                z = [c + a * (x - model.mean[0]) / model.scale[0] + b * (y - model.mean[1]) / model.scale[1] for x, y, _ in got]
                p = 1 / (1 + np.exp(-np.clip(np.array(z, float), -30, 30)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p), pa.array([n for _, _, n in got], pa.int64())], names=["doc_id", "score", "hits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, hits long")
