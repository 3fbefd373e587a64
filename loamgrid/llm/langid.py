"""Language identification by cross-parsing: how few phrases of a language's sample spell a text.

Each language's labelled text becomes a suffix automaton. A text is parsed
greedily into the longest phrases that occur in the sample; the language that
needs the fewest phrases for each letter wins. Texts are parsed in pieces, many
at a time, so one numpy step moves thousands of parses on; the parse of each
piece is then joined to the one before, as if the text had been read in one go.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loamgrid.llm.common import slices, small, stored


@dataclass(frozen=True)
class Samples:
    """The bounded sample that is fitted: ``passages`` different passages of each language, those first by a hash of
    the passage, of up to ``passage`` characters each, from anywhere in the whole labelled texts. Every labelled
    language and every letter of a sample is kept. Prediction reads whole texts, in pieces of ``piece`` letters that are
    parsed side by side; ``trace`` steps of each are kept, to tell where the parse that runs on from the piece before
    meets the piece's own."""

    passages: int = 64
    passage: int = 400
    piece: int = 512
    trace: int = 48


_GAP = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """Lower case, with every run of other characters than letters as one space; null is empty."""
    return _GAP.sub(" ", (text or "").lower()).strip()


def automaton(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Suffix automaton of ``codes`` (all above 0) as overlaid rows: (owner, next, start).

    A state is the place in the table where its row begins. Its move by symbol c
    is ``next[state + c]`` if ``owner[state + c]`` is the state, and none otherwise.
    So a state takes as many places as it has moves, whatever the alphabet.
    """
    step, link, length = [{}], [-1], [0]
    last = 0
    for c in codes.tolist():
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p != -1:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    # The widest rows are placed first, each at the first of random places where it meets no other.
    width = int(codes.max(initial=0)) + 1
    room = 2 * sum(map(len, step)) + len(step) + 64
    rng = np.random.Generator(np.random.PCG64(1))
    tries = iter(())
    owner, to = [-1] * (room + width), [0] * (room + width)
    place = [0] * len(step)
    taken: set[int] = set()
    for s in sorted(range(len(step)), key=lambda s: (-len(step[s]), s)):
        while True:
            at = next(tries, None)
            if at is None:
                tries = iter(rng.integers(0, room, 1 << 16).tolist())
            elif at not in taken and all(owner[at + c] < 0 for c in step[s]):
                break
        taken.add(at)
        place[s] = at
        for c in step[s]:
            owner[at + c] = at
    for moves, at in zip(step, place, strict=True):
        for c, t in moves.items():
            to[at + c] = place[t]
    return np.array(owner, np.int32), np.array(to, np.int32), place[0]


@dataclass
class Model:
    languages: list[str]
    alphabet: np.ndarray  # code point -> symbol; symbol 0 occurs in no sample
    automata: list[tuple[np.ndarray, np.ndarray, int]]  # of each language, see automaton()

    def stacked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All automata one behind the other, (owner, next), and each language's start state."""
        width = int(self.alphabet.max()) + 1
        owners, nexts, starts, base = [], [], [], 0
        for owner, to, start in self.automata:
            # Each is padded, so that any symbol of the common alphabet falls inside.
            owners += [np.where(owner < 0, -1, owner + np.int32(base)).astype(np.int32), np.full(width, -1, np.int32)]
            nexts += [to + np.int32(base), np.zeros(width, np.int32)]
            starts.append(base + start)
            base += len(owner) + width
        return np.concatenate(owners), np.concatenate(nexts), np.array(starts, np.int64)


def fit(labelled: DataFrame, how: Samples = Samples()) -> Model:
    """Model from ``labelled`` (text, lang); rows with a null in either are left aside.

    Only a bounded sample reaches the driver; see Samples. Ties in the choice go
    by the passage itself, so the model does not depend on the order of rows.
    """
    parts = F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{how.passage}}}+"), F.lit(0))
    rows = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", F.explode(parts).alias("text"))
    rows = rows.where(F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("text").alias("by"))
    known = stored(rows.groupBy("lang").agg(F.approx_count_distinct("by").alias("passages")))
    # A passage's hash is even over all different passages, so this share of those holds a few times what is wanted.
    share = known.select("lang", F.least(F.lit(1.0), 4.0 * how.passages / F.col("passages")).alias("share"))
    near = rows.join(small(share), "lang").where(F.col("by") / 2.0**64 + 0.5 <= F.col("share")).select("lang", "by", "text").distinct()
    picked: dict[str, list[tuple[int, str]]] = {}
    for r in near.toLocalIterator():
        found = picked.setdefault(r["lang"], [])
        found.append((r["by"], r["text"]))
        if len(found) > 2 * how.passages:
            found.sort()
            del found[how.passages :]
    samples = {}
    for lang, found in picked.items():
        text = " ".join(filter(None, (letters(t) for _, t in sorted(found)[: how.passages])))
        if text:
            samples[lang] = f" {text} "
    chosen = np.unique(np.array([ord(c) for c in set().union(*samples.values())], np.int64))
    alphabet = np.zeros(0x110000, np.min_scalar_type(len(chosen)))
    alphabet[chosen] = np.arange(1, len(chosen) + 1)
    automata = [automaton(alphabet[np.frombuffer(text.encode("utf-32-le"), np.uint32)].astype(np.int64)) for _, text in sorted(samples.items())]
    return Model(sorted(samples), alphabet, automata)


def _walk(owner: np.ndarray, to: np.ndarray, first: np.ndarray, base: np.ndarray, codes: np.ndarray, starts: np.ndarray, size: np.ndarray, trace: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parses pieces, longest first, from the start state: (phrases closed, state at the end) of each language and
    piece, and both after each of the first ``trace`` steps."""
    state = np.repeat(base, len(starts), axis=1)
    count = np.zeros(state.shape, np.int32)
    marks = np.zeros((trace, 2, *state.shape), np.int32)
    alive = len(starts)
    for t in range(int(size[0]) if len(size) else 0):
        while alive and size[alive - 1] <= t:
            alive -= 1
        c = codes[starts[:alive] + t]
        now = state[:, :alive]
        at = now + c[None, :]
        broken = owner.take(at) != now
        count[:, :alive] += broken
        state[:, :alive] = np.where(broken, first.take(c, axis=1), to.take(at))
        if t < trace:
            marks[t, 0], marks[t, 1] = state, count
    return count, state, marks


def _rewalk(owner: np.ndarray, to: np.ndarray, first: np.ndarray, codes: np.ndarray, starts: np.ndarray, size: np.ndarray, lang: np.ndarray, piece: np.ndarray, state: np.ndarray, own: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(phrases closed, state at the end) of (language, piece) pairs that begin in ``state``; where such a parse meets
    the piece's own one, in the same state at the same letter, the two go on alike."""
    total, last, marks = own
    out_count, out_state = np.zeros(len(lang), np.int32), state.copy()
    live, count, t = np.arange(len(lang)), np.zeros(len(lang), np.int32), 0
    while len(live):
        c = codes[starts[piece] + t]
        at = state + c
        broken = owner.take(at) != state
        count = count + broken
        state = np.where(broken, first[lang, c], to.take(at))
        t += 1
        ended = size[piece] <= t
        out_count[live[ended]], out_state[live[ended]] = count[ended], state[ended]
        if t <= len(marks):
            met = ~ended & (marks[t - 1, 0, lang, piece] == state)
            out_count[live[met]] = count[met] + total[lang[met], piece[met]] - marks[t - 1, 1, lang[met], piece[met]]
            out_state[live[met]] = last[lang[met], piece[met]]
            ended |= met
        if ended.any():
            live, lang, piece, state, count = live[~ended], lang[~ended], piece[~ended], state[~ended], count[~ended]
    return out_count, out_state


def phrases(owner: np.ndarray, to: np.ndarray, base: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, trace: int = 48) -> np.ndarray:
    """Phrases that each text needs, for each language: (language, text). Pieces codes[start:end] are in order, none
    is empty, and ``row`` numbers the text of each; a text is parsed as a whole, however it is cut."""
    base = base.astype(np.int32)[:, None]
    codes = codes.astype(np.int32)
    # Where each symbol leads from the start; the start itself where there is no such move.
    every = base + np.arange(int(codes.max(initial=0)) + 1, dtype=np.int32)[None, :]
    first = np.where(owner.take(every) == base, to.take(every), base)
    size = ends - starts
    joined = np.concatenate(([False], row[1:] == row[:-1]))
    count, state = np.zeros((len(base), len(starts)), np.int32), np.zeros((len(base), len(starts)), np.int32)
    own = {}
    for kind in (False, True):
        at = np.flatnonzero(joined == kind)
        at = at[np.argsort(-size[at], kind="stable")]
        got = _walk(owner, to, first, base, codes, starts[at], size[at], trace if kind else 0)
        count[:, at], state[:, at] = got[0], got[1]
        own[kind] = at, got
    at, got = own[True]
    used = np.repeat(base, len(at), axis=1)
    while len(at):
        wanted = state[:, at - 1]
        lang, k = np.nonzero(wanted != used)
        if not len(lang):
            break
        used[lang, k] = wanted[lang, k]
        count[lang, at[k]], state[lang, at[k]] = _rewalk(owner, to, first, codes, starts[at], size[at], lang, k, wanted[lang, k], got)
    texts = int(row[-1]) + 1 if len(row) else 0
    total = np.stack([np.bincount(row, weights=c, minlength=texts) for c in count]) if len(row) else np.zeros((len(base), 0))
    return total.astype(np.int64) + (np.bincount(row, minlength=texts) > 0)


def annotate(docs: DataFrame, model: Model, how: Samples = Samples()) -> DataFrame:
    """``docs`` (text, ...), all columns kept, with ``lang_pred`` and ``score`` added, or replaced where they exist; see predict()."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    most = max(1 << 16, (8 << 20) // max(4, len(model.languages)))

    def judge(model: Model, stacked: tuple | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        texts = [letters(t) for t in texts]
        n = np.array([len(t) for t in texts], np.int64)
        langs, scores = ["und"] * len(texts), np.zeros(len(texts))
        if n.sum() and model.languages:
            codes = model.alphabet[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)].astype(np.int64)
            pieces = -(-n // how.piece)
            row = np.repeat(np.arange(len(n)), pieces)
            begin = np.repeat(np.cumsum(n) - n, pieces)
            starts = begin + how.piece * (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
            ends = np.minimum(starts + how.piece, begin + n[row])
            got = phrases(*stacked, codes, starts, ends, row, how.trace)
            total = np.zeros((len(got), len(n)), np.int64)
            total[:, : got.shape[1]] = got
            best = total.argmin(axis=0)
            least = total.min(axis=0)
            others = (total.sum(axis=0) - least) / max(1, len(model.languages) - 1)
            for i in np.flatnonzero(n):
                langs[i] = model.languages[best[i]]
                scores[i] = 1.0 if len(model.languages) == 1 else 1 - least[i] / others[i]
        return langs, scores

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        stacked = model.stacked() if model.languages else None
        for batch in batches:
            for part in slices(batch, "text", most):
                langs, scores = judge(model, stacked, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs), pa.array(scores)], names=[*part.schema.names, "lang_pred", "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def predict(docs: DataFrame, model: Model, how: Samples = Samples()) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of ``docs`` (doc_id, text).

    ``und`` and 0 if the text is null or has no letter, or if nothing was
    learned. Score: 1 - the winner's phrases / the mean phrases of the others
    (1 with a single language). Ties go to the first language by name. Whole
    texts are read, of any length; repeated rows are judged alike and other
    columns are left aside.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return annotate(docs, model, how).drop("text")
