"""The corpus operators against brute force, exact round trips and held-out rows, and on awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loamgrid.llm import ann, decontamination, graph, jaccard_join, langid, maxent_lm, packing, queries, secrets, sharding, surrogates, toxicity, wordhash
from loamgrid.llm.common import remainder

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, **more):
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, and clashing extra columns."""
    long = " ".join(f"word{i % 977}" for i in range(40_000))
    rows = [
        (1, "plain words of a short text here", "en", "a", 5), (1, "plain words of a short text here", "en", "a", 5), (1, "another text with the same id as others", "fr", "a", 5),
        (2, None, None, None, None), (3, "", "en", "b", 0), (4, " \t\n ", "en", "b", 3), (None, "plain words of a short text here", "en", None, 5), (None, None, None, None, None),
        (5, long, "en", "c", len(long)), (6, "12345 !!! ???", "de", "c", 13), (7, "x", "de", "c", 1), (8, "<|endoftext|> as plain words", "de", "c", 1),
    ]
    d = spark.createDataFrame(rows, DOCS)
    return d.select("*", F.lit(1).alias("n"), F.lit("k").alias("node"), F.lit(2).alias("row"), F.lit("s").alias("score"), F.lit(0).alias("spans"), F.lit(0).alias("items"), F.lit(0).alias("kinds"))


@pytest.fixture(scope="module")
def nothing(awkward):
    return awkward.where("false")


def words(text):
    return (text or "").encode().lower().split()


# word hashing


def test_word_hashes_agree_with_plain_splitting():
    rng = random.Random(3)
    texts = ["", None, "A b  c", "ÉÀ x", *("".join(rng.choices("aB 1é-\n\tÿ語.", k=rng.randrange(60))) for _ in range(200)), "y" * 70_000 + " z"]
    for of, split in ((wordhash.SPACED, lambda t: t.split()), (wordhash.ALNUM, lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", t))):
        h, first, _, _ = wordhash.words(pa.array(texts, pa.string()), of)
        seen = {}
        for i, t in enumerate(texts):
            want = split((t or "").encode().lower())
            got = h[first[i] : first[i + 1]].tolist()
            assert len(got) == len(want)
            for w, x in zip(want, got, strict=True):
                assert seen.setdefault(w, x) == x
        assert len(set(seen.values())) == len(seen)


# op1


def test_packing_round_trip(spark, awkward):
    encode = packing.byte_bpe()
    how = packing.Packing(length=64, pool=50)
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), awkward):
        got = packing.pack(docs, how=how, with_ids=True).collect()
        rows = [(r["doc_id"], [*encode([r["text"] or ""])[0], 0]) for r in docs.select("doc_id", "text").collect()]
        assert sum(r["length"] for r in got) == sum(len(x) for _, x in rows)
        for r in got:
            assert r["ids_crc32"] == zlib.crc32(np.array(r["token_ids"], "<u4").tobytes())
            assert any(d == r["doc_id"] and len(x) == r["doc_tokens"] and x[r["start"] : r["start"] + r["length"]] == r["token_ids"] for d, x in rows)
        by = defaultdict(list)
        for r in got:
            by[r["sequence_id"]].append((r["offset"], r["length"]))
        for parts in by.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= 64
        assert sum(64 - sum(n for _, n in p) for p in by.values()) < 0.05 * sum(r["length"] for r in got) + 64 * 8


def test_tokenizers_agree():
    import public_tokenizers
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    texts = ["", "<|endoftext|>", "hello <|endoftext|> world", "don't  stop\n\n", *("".join(rng.choices("ab 1é'!\n\t語🙂ــx", k=50)) for _ in range(100))]
    assert packing.byte_bpe()(texts) == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_assignment_balances_cost():
    sizes = np.array(random.Random(2).choices(range(1, 1024), k=500))
    how = packing.Packing()
    cost, used = Counter(), Counter()
    for i, _, n, j, _ in packing.assign(sizes, how):
        cost[j] += how.linear * n + how.quadratic * n * n
        used[j] += n
    assert sum(used.values()) == sizes.sum() and max(used.values()) <= 1024
    assert len(used) == math.ceil(sizes.sum() / 1024)


# op2


def brute_components(texts):
    sets = {}
    for i, t in texts:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    links = set()
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                links.add((a, b))
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}, links


def families(seed, n=160):
    """Near copies at all distances around the threshold, passages in common, exact copies and very short texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    bases = [[word() for _ in range(rng.choice((7, 30, 60, 140)))] for _ in range(6)]
    shared = [word() for _ in range(40)]
    out = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 4))):
            k = rng.randrange(len(w))
            rng.choice((lambda: w.__setitem__(k, word()), lambda: w.insert(k, word()), lambda: w.pop(k)))() if len(w) > 1 else None
        if rng.random() < 0.2:
            w += shared
        out.append((i, " ".join(w) if rng.random() > 0.1 else rng.choice(("", "a", "a b", "A B", "a b c d", "a b c d e"))))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_join_against_brute_force(spark, seed):
    texts = families(seed)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want, links = brute_components(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(docs).collect()}
    assert got == want
    few = jaccard_join.Jaccard(table_bits=4, picks=1, sent_ids=0)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(docs, few).collect()} == want
    joined = jaccard_join.join(docs, every_link=True)
    node = {r["doc_id"]: r["node"] for r in joined.members.collect()}
    assert {(r["a"], r["b"]) for r in joined.links.collect()} == {tuple(sorted((node[a], node[b]))) for a, b in links if node[a] != node[b]}


def test_join_on_awkward_rows(spark, awkward, nothing):
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"] or -1) for r in jaccard_join.near_duplicates(awkward).collect())
    assert len(got) == awkward.count()
    assert [g for g in got if g[0] == 1] == [(1, 3, 1), (1, 3, 1), (1, 4, 1)]
    assert all(c == -1 for d, _, c in got if d == -1) and (2, 0, 2) in got and (3, 0, 3) in got and (4, 0, 4) in got
    assert jaccard_join.near_duplicates(nothing).count() == 0


def shuffled(spark):
    """Bytes that all stages so far have written for shuffles."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_prefixes_travel_once(spark):
    rng = random.Random(4)
    texts = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(400))) for i in range(3000)]
    texts += [(3000 + i, t + " more") for i, t in texts[:60]]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    how = jaccard_join.Jaccard(table_bits=12)
    places = len(texts) * (396 - 317 + 1)
    before = shuffled(spark)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_duplicates(docs, how).collect()}
    assert got == {i: i - 3000 if i >= 3000 else i for i, _ in texts}
    # A place takes some 12 bytes on its way; everything else is small here.
    assert shuffled(spark) - before < 18 * places


@pytest.mark.parametrize("seed", [5, 6])
def test_crowds_keep_every_link(spark, seed):
    """Few words, so that most shingles are in many documents and random picks decide few of the pairs."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(9)}" for _ in range(45)]
    texts = []
    for i in range(140):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(9)}"
        texts.append((7 * i - 300, " ".join(w)))
    want, links = brute_components(texts)
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    how = jaccard_join.Jaccard(table_bits=4, picks=1)
    joined = jaccard_join.join(docs, how, every_link=True)
    node = {r["doc_id"]: r["node"] for r in joined.members.collect()}
    assert {(r["a"], r["b"]) for r in joined.links.collect()} == {tuple(sorted((node[a], node[b]))) for a, b in links if node[a] != node[b]}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(docs, how).collect()} == want


def test_components_of_a_long_chain(spark):
    chain = spark.range(60).selectExpr("id AS a", "id + 1 AS b")
    got = {r["node"]: r["component"] for r in graph.components(chain.unionByName(spark.createDataFrame([(100, 101), (101, 100), (7, 7)], "a long, b long"))).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert graph.components(chain.where("false")).count() == 0


def test_small_graphs_take_few_jobs(spark):
    rng = np.random.default_rng(7)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(5000 - i, 5001 - i) for i in range(40)]
    links = spark.createDataFrame([*pairs, *pairs[:5], (None, 3), (3, None), (9, 9)], "a long, b long")
    spark.sparkContext.setJobGroup("few", "few")
    got = sorted(map(tuple, graph.components(links).collect()))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few")) <= 4
    assert got == sorted(map(tuple, graph.components(links, few=0).collect())) == sorted(map(tuple, graph.components(links, few=20).collect()))


# op3


def test_shards(spark, awkward, nothing):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), awkward):
        got = sharding.shard(docs).collect()
        want = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
        assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in got) == want
        counts = Counter(r["shard"] for r in got)
        sizes = [counts.get(s, 0) for s in range(24)]
        assert max(sizes) - min(sizes) <= 1
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append((r["slot"], r["curve"]))
        order = [c for s in sorted(slots) for _, c in sorted(slots[s])]
        assert order == sorted(order)
        assert all(sorted(x for x, _ in v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard(nothing).count() == 0


@pytest.mark.parametrize("dims", [2, 3, 4])
def test_curve_visits_neighbours(spark, dims):
    bits = 2
    rows = [tuple((i >> (bits * k)) & 3 for k in range(dims)) for i in range(1 << (bits * dims))]
    d = spark.createDataFrame(rows, ", ".join(f"c{k} int" for k in range(dims)))
    got = sorted((r["h"], r[:dims]) for r in d.select("*", sharding.curve_index([F.col(f"c{k}") for k in range(dims)], bits).alias("h")).collect())
    assert [h for h, _ in got] == list(range(len(rows)))
    assert all(sum(abs(x - y) for x, y in zip(a, b, strict=True)) == 1 for (_, a), (_, b) in zip(got, got[1:], strict=False))


# op4


def test_language_model(spark, awkward, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op4_hashed_maxent_lm(spark, SF).collect()
    tokens = {r["doc_id"]: [*words(r["text"]), "end"] for r in docs.collect()}
    seen = Counter(w for i, t in tokens.items() if zlib.crc32(str(i).encode()) % 10 for w in t)
    n, v = sum(seen.values()), len(seen)
    for r in got:
        t = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(w in seen for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((seen[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), abs=1e-6)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert maxent_lm.fit_and_score(awkward, awkward).count() == awkward.count()
    assert maxent_lm.fit_and_score(nothing, nothing).count() == 0
    alone = maxent_lm.fit_and_score(frame(spark, ["a b"]), nothing.select("doc_id", "text")).first()
    assert (alone["n_known"], alone["train_tokens"]) == (0, 0)


def test_language_model_grows_with_its_counts():
    how = maxent_lm.MaxEnt()
    sizes = [how.sized(10 ** (k // 2 + 1), 10**k) for k in range(14)]
    assert how.sized(0, 0) == how
    assert all(a.rows <= b.rows for a, b in zip(sizes, sizes[1:])) and sizes[4].rows < sizes[9].rows < sizes[11].rows
    assert all(4 * s.rows * s.wide < 50_000_000 for s in sizes)


def test_probabilities_add_up(spark):
    """After one context, the known words and the unknown one share all of the mass."""
    rng = random.Random(4)
    docs = frame(spark, [" ".join(rng.choices("abcdefghij", k=30)) for _ in range(50)])
    vocabulary, known = maxent_lm.count(docs, maxent_lm.MaxEnt())
    how = maxent_lm.MaxEnt()
    w = maxent_lm.train(docs, known, how)
    ask = frame(spark, [f"a b {x}" for x in [*"abcdefghij", "unseen"]] + ["a b"])
    got = {r["doc_id"]: r["score"] for r in maxent_lm.score(ask, vocabulary, known, w, how).collect()}
    feature = maxent_lm.Features(known, how, True)
    total = 0.0
    for x in [*"abcdefghij", "unseen"]:
        h, e, first = maxent_lm._tokens(pa.array([f"a b {x}"]))
        rows, within, group, listed = feature(h, e, first)
        lp = maxent_lm.log_group(w, rows, within, group)[2]
        total += known.unknown if listed[2] < 0 else math.exp(lp) * (1 - known.unknown) * (known.counts[listed[2]] + 0.1) / known.mass[group[2]]
    h, e, first = maxent_lm._tokens(pa.array(["a b"]))
    rows, within, group, listed = feature(h, e, first)
    total += math.exp(maxent_lm.log_group(w, rows, within, group)[2]) * (1 - known.unknown) * (known.counts[listed[2]] + 0.1) / known.mass[group[2]]
    # Classes and groups without words keep next to nothing of the softmaxes.
    assert 0.999 < total <= 1.0001 and all(s < 0 for s in got.values())


def test_context_reaches_the_word_in_its_class(spark):
    """On held-out rows whose words are all known, groups chosen in context beat groups that follow their class's counts."""
    rng = random.Random(5)
    follows = {f"w{i}": [f"w{rng.randrange(100)}" for _ in range(3)] for i in range(100)}

    def text():
        out = ["w0"]
        while len(out) < 60:
            out.append(rng.choice(follows[out[-1]]))
        return " ".join(out)

    docs, how = frame(spark, [text() for _ in range(600)]), maxent_lm.MaxEnt()
    train, held = docs.where("doc_id % 10 <> 0").select("doc_id", "text"), docs.where("doc_id % 10 = 0")
    vocabulary, known = maxent_lm.count(train, how)
    w = maxent_lm.train(train, known, how)
    classes_only = w.copy()
    classes_only[how.base :] = maxent_lm.start(known, how)[how.base :]
    of = lambda w: maxent_lm.score(held, vocabulary, known, w, how).agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens"), F.sum("n_known")).first()
    full, less = of(w), of(classes_only)
    assert full[2] == full[3] and full[0] > less[0] + 0.1 * full[2] and less[0] > less[1]


# op5


def test_surrogates(spark, awkward, nothing):
    texts = ["write to Ann.Lee@Example.com or ann.lee@example.com, +1 (523) 555-1055 or 523-555-1055.", "card 4785380592391139, 4785 3805 9239 1139; at 152.143.123.131 and 152.143.123.132", "Mrs Anna Smith met Mr John Smith and Mrs Anna Smith", "Г-жа Анна Иванова, 123-45-6789", "no data in 2024, version 1.2.3"]
    d = frame(spark, texts)
    got = [r["text"] for r in surrogates.replace(d, surrogates.Surrogates("k1")).orderBy("doc_id").collect()]
    mails = re.findall(r"\S+@[\w.]+\w", got[0])
    assert len(set(mails)) == 1 and "example.com" not in got[0].lower()
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4} or \d{3}-\d{3}-\d{4}\.", got[0]) and "555-1055" not in got[0]
    card, spaced = re.search(r"card (\d{16}), ([\d ]{19})", got[1]).groups()
    assert card == spaced.replace(" ", "") != "4785380592391139"
    assert len(set(re.findall(r"\d+\.\d+\.\d+\.\d+", got[1]))) == 2
    names = re.findall(r"(Mrs?) (\w+) ([\w-]+)", got[2])
    assert names[0] == names[2] != names[1] and names[0][1] in surrogates._GIVEN[("latin", "f")] and names[1][1] in surrogates._GIVEN[("latin", "m")]
    assert re.fullmatch(r"Г-жа \w+ [\w-]+, \d{3}-\d{2}-\d{4}", got[3]) and "Анна Иванова" not in got[3]
    assert got[4] == texts[4]
    assert [r["text"] for r in surrogates.replace(d, surrogates.Surrogates("k2")).orderBy("doc_id").collect()] != got
    out = surrogates.replace(awkward)
    assert out.count() == awkward.count() and out.columns.count("kinds") == 1
    assert surrogates.replace(nothing).count() == 0


def test_surrogates_stay_distinct(spark):
    n = 4000
    d = spark.range(n).select(F.col("id").alias("doc_id"), F.format_string("Mr Aa%s Bb%s", F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.translate(F.col("id").cast("string"), "0123456789", "klmnopqrst")).alias("text"))
    assert surrogates.replace(d).select("text").distinct().count() == n
    digits = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    assert digits.select(surrogates._permuted(F.col("d"), surrogates.Surrogates(), "x").alias("d")).distinct().count() == 1000


def test_surrogates_stay_distinct_under_all_titles(spark):
    letters = lambda c, to: F.translate((c + 1000).cast("string"), "0123456789", to)
    people = spark.range(600).select("id", F.concat(F.lit("Aa"), letters(F.col("id"), "abcdefghij"), F.lit(" Bb"), letters(F.col("id"), "klmnopqrst")).alias("name"))
    titles = F.element_at(F.array(*[F.array(*map(F.lit, t)) for t in (("Mr",), ("Sir",), ("Mr", "Mrs"), ("Mrs",))]), (F.col("id") % 4 + 1).cast("int"))
    said = people.select(F.col("id").alias("doc_id"), F.explode(titles).alias("title"), "name")
    got = surrogates.replace(said.select("doc_id", F.concat_ws(" ", "title", "name").alias("text"))).collect()
    holders = defaultdict(set)
    for r in got:
        holders[r["text"].split(" ", 1)[1].lower()].add(r["doc_id"])
    assert len(got) == 750 and all(len(ids) == 1 for ids in holders.values())


def luhn(digits):
    total = sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def iban(text):
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def test_surrogates_of_planted_entities(spark):
    """One surrogate for each entity over titles and mentions, distinct ones for distinct entities, formats and check digits kept."""
    texts = [
        "Mr Robin Lee wrote. Dr Robin Lee's friend saw ROBIN LEE and Robin; Lee left. Prof ROBIN LEE too.",
        "Dr Robin Lee met Mrs Ann Lee, robin.lee+x1@mail.corp.org, ann@corp.org. Bo@corp.org!",
        "4111 1111 1111 1111 and 4111111111111112, DE89370400440532013000, GB29NWBK60161331926819, GB28NWBK60161331926819",
        "Robin Lee alone",
    ]
    got = [r["text"] for r in surrogates.replace(frame(spark, texts), surrogates.Surrogates("k3")).orderBy("doc_id").collect()]
    given, family = re.match(r"Mr (\w+) (\w+) wrote", got[0]).groups()
    full = f"{given} {family}"
    assert got[0] == f"Mr {full} wrote. Dr {full}'s friend saw {full.upper()} and {given}; {family} left. Prof {full.upper()} too."
    assert given in surrogates._GIVEN[("latin", "m")] and full not in ("Robin Lee", "Ann Lee")
    assert got[1].startswith(f"Dr {full} met Mrs ") and re.search(r"met Mrs (\w+) (\w+),", got[1]).groups() != (given, family)
    one, two, three = re.findall(r"[\w.+]+@[\w.]+\w", got[1])
    assert re.fullmatch(r"[a-z]{5}\.[a-z]{3}\+[a-z]\d@[a-z]{4}\.[a-z]{4}\.example", one) and re.fullmatch(r"[a-z]{3}@[a-z]{4}\.example", two)
    assert two.split("@")[1] == three.split("@")[1] and len(three.split("@")[0]) == 2
    good, bad, de, gb, wrong = re.fullmatch(r"([\d ]{19}) and (\d{16}), (DE\d{20}), (GB\d\d[A-Z]{4}\d{14}), (GB\d\d[A-Z]{4}\d{14})", got[2]).groups()
    assert luhn(good.replace(" ", "")) and not luhn(bad) and good.replace(" ", "")[:-1] == bad[:-1] and good != texts[2][:19]
    assert iban(de) and iban(gb) and not iban(wrong) and gb[4:] == wrong[4:] and "NWBK" not in got[2] and iban("GB29NWBK60161331926819")
    assert got[3] == texts[3]


def test_query_leaves_no_entity(spark):
    """Every entity of the given documents, found again by plain patterns, is gone; other text is untouched."""
    flat = lambda p: re.compile(p.replace(r"\p{Lu}", "[A-ZÀ-ÞЀ-Я]").replace(r"[\p{L}'-]", "[A-Za-zÀ-ÿЀ-я'-]").replace(r"\p{L}", "[A-Za-zÀ-ÿЀ-я]"))
    every = re.compile("|".join(f"(?:{flat(p).pattern})" for p in surrogates.PATTERNS.values()))
    before = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    after = {r["doc_id"]: r for r in queries.op5_pii_surrogates(spark, SF).collect()}
    assert set(before) == set(after)
    own, new = defaultdict(set), defaultdict(set)
    for i, text in before.items():
        found = [m.group(0) for m in every.finditer(text or "")]
        assert after[i]["n_entities"] == len(found)
        if not found:
            assert after[i]["text"] == text
        put = [m.group(0) for m in every.finditer(after[i]["text"] or "")]
        for a, b in zip(found, put, strict=False):
            if len(found) == len(put) and "@" in a:
                assert a.lower() != b
                own[a.lower()].add(b)
                new[b].add(a.lower())
    assert all(len(x) == 1 for x in own.values()) and all(len(x) == 1 for x in new.values())


# op6


def test_secrets(spark, awkward, nothing):
    h = hashlib.sha256(b"1").hexdigest()
    texts = [f'so token = "{h[:40]}" and on', f"commit {h[:40]} fixed it", "see user19@mail5.example.com now", "export AWS_KEY=AKIA" + "Q7ZK3MX9P2LD8RTB", "plain text without any", None, f"-----BEGIN PRIVATE KEY-----\n{h}\n-----END PRIVATE KEY-----"]
    scan = secrets.Scanner(spark)
    found = {r["doc_id"]: (r["n_candidates"], r["n_secrets"]) for r in scan.findings(frame(spark, texts)).collect()}
    assert found[0] == (1, 1) and found[1] == (1, 0) and found[2][1] == 0 and found[3] == (1, 1) and found[4] == (0, 0) and found[5] == (0, 0)
    clean = {r["doc_id"]: r["text"] for r in scan.redact(frame(spark, texts)).collect()}
    assert clean[0] == 'so token = "[SECRET]" and on' and clean[1] == texts[1] and clean[4] == texts[4] and clean[5] is None
    place = scan.findings(frame(spark, texts)).where("doc_id = 0").first()["findings"][0]
    assert texts[0][place["place"] : place["place"] + place["length"]] == h[:40]
    assert scan.findings(awkward).count() == awkward.count() and scan.redact(awkward).columns == awkward.columns
    assert scan.findings(nothing).count() == 0
    # Findings that the forest was not fitted on.
    other = secrets.labelled_examples(spark, secrets.Forest(seed=99, examples=2000))
    values = F.transform(F.array(F.struct("before", "token", "after")), lambda x: secrets.features(x["before"], x["token"], x["after"]))
    judged = other.select(F.transform(values, scan.score)[0].alias("s"), "label").toPandas()
    assert ((judged["s"] >= 0.5) == (judged["label"] > 0)).mean() > 0.95


def test_secrets_planted_in_documents(spark):
    """Recall and precision on findings in real texts, in forms that the forest's examples don't all have."""
    rng = random.Random(8)
    of = lambda n, a="abcdefghijkLMNOPQRSTUVWXYZ0123456789": "".join(rng.choices(a, k=n))
    digest = lambda: of(32, "0123456789abcdef")
    secret = {'curl -H "Authorization: Bearer {}" https://api.example.com': lambda: of(32), '{{"user": "ann", "token": "{}"}}': lambda: of(32), "AWS_SECRET_ACCESS_KEY={}": lambda: of(40), "pushed with {} by mistake": lambda: "ghp_" + of(36), "postgres://app:{}@db.example.com/main": lambda: of(24)}
    open_ = {"cache key = {}": digest, "fixed in commit {}": digest, "public key fingerprint: {}": digest, "https://cdn.example.com/assets/main.{}.js": digest, "primary key = {}": lambda: f"user_{rng.randrange(2000, 2030)}_index", "token count = {}": lambda: str(rng.randrange(10**5, 10**9))}
    forms, rows = [*secret, *open_], []
    for i, r in enumerate(spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").select("text").toLocalIterator()):
        form, words_ = forms[i % len(forms)], (r[0] or "").split(" ")
        value, at = (secret.get(form) or open_[form])(), rng.randrange(len(words_) + 1)
        rows.append((i, " ".join([*words_[:at], form.format(value), *words_[at:]]), value, form in secret))
    docs = spark.createDataFrame(rows, "doc_id long, text string, value string, secret boolean")
    gone = [(r["secret"], r["value"] not in r["text"]) for r in secrets.Scanner(spark).redact(docs).collect()]
    hit, false, all_ = gone.count((True, True)), gone.count((False, True)), sum(s for s, _ in gone)
    assert hit > 0.95 * all_ and hit > 0.95 * (hit + false)


def test_short_secrets_and_blocks(spark):
    h = hashlib.sha256(b"2").hexdigest()
    values = {'password = "{}"': "hunter2secret", "password: {}, and": "Tr0ub4dor&3xyz", 'api_key = "{}"': "qwhzkXvbnmtrpLkjhgfdsazx", '"pwd": "{}"': "x7!kq2"}
    blocks = [f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,{h[:32].upper()}\n\n{h}\n-----END RSA PRIVATE KEY-----", f"-----BEGIN PGP PRIVATE KEY BLOCK-----\nVersion: 2\n\n{h}\n=ab12\n-----END PGP PRIVATE KEY BLOCK-----"]
    texts = [f"so {k.format(v)} on" for k, v in values.items()] + [f"see {b} here" for b in blocks]
    plain = ["the key is important to all", "he said 'nothing' of it", 'class="response" id="handler"', "token: required, and so on"]
    got = [r["text"] for r in secrets.Scanner(spark).redact(frame(spark, texts + plain)).orderBy("doc_id").collect()]
    assert got == [f"so {k.format('[SECRET]')} on" for k in values] + ["see [SECRET] here"] * 2 + plain
    at = secrets.Scanner(spark).findings(frame(spark, texts)).orderBy("doc_id").collect()
    assert [t[f["place"] : f["place"] + f["length"]] for t, r in zip(texts, at, strict=True) for f in r["findings"]] == [*values.values(), *blocks]


# op7


def test_search_against_brute_force(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate((rng.standard_normal((400, 16)), np.tile(rng.standard_normal((1, 16)), (60, 1)))).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0] * 15 + [None]), (1004, [1.0] * 7), (1005, [float("inf")] * 16), (None, [1.0] * 16)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    how = ann.OneBit(rows=64, cells=4, query_bytes=1024)
    for r in ann.search(d, d.where("vec_id % 20 = 0"), how).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    right = total = 0
    x = v.astype(np.float64)
    for q in range(0, 460, 20):
        dist = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(len(x)), dist)) if i != q][:10]
        right += len({i for i, _ in got[q]} & set(order))
        total += 10
        assert all(s == pytest.approx(dist[i], abs=1e-9) for i, s in got[q])
    assert right / total >= 0.95 and 1001 not in got and 1002 not in got
    assert got.get(1004, []) == [] and ann.search(d.where("false"), d.where("false")).count() == 0


def test_search_among_repeated_ids(spark):
    rng = np.random.default_rng(3)
    v = rng.standard_normal((60, 8))
    rows = [(i, x.tolist()) for i, x in enumerate(v) for _ in range(2)] + [(7, (v[0] + 0.001 * k).tolist()) for k in range(1, 30)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    got = ann.search(d, d.where("vec_id = 0"), ann.OneBit(bound=50.0)).orderBy("rank").collect()
    x = np.array([x for _, x in rows], np.float32).astype(np.float64)
    least = {}
    for (i, _), dist in zip(rows, np.sqrt(((x - x[0]) ** 2).sum(axis=1)), strict=True):
        least[i] = min(dist, least.get(i, np.inf))
    want = sorted((s, i) for i, s in least.items() if i)[:10]
    assert [r["vec_id"] for r in got] == [i for _, i in want] and [r["score"] for r in got] == pytest.approx([s for s, _ in want])


def test_search_on_the_given_vectors(spark):
    """Recall against brute force, and how few vectors are compared exactly."""
    d = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = d.select("vec_id", "embedding").toPandas()
    ids, x = rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_numpy()).astype(float)
    asked = d.where("vec_id % 20 = 0")
    got = defaultdict(set)
    for r in ann.search(d, asked).collect():
        got[r["query_id"]].add(r["vec_id"])
    right = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        far = np.where(np.arange(len(ids)) == q, np.inf, np.sqrt(((x - x[q]) ** 2).sum(axis=1)))
        right += len(got[ids[q]] & set(ids[np.lexsort((ids, far))[:10]]))
        total += 10
    assert right / total >= 0.98
    assert ann.compared(d, asked).agg(F.sum("compared")).first()[0] < 0.2 * len(ids) * len(got)


def test_bounds_hold(spark):
    rng = np.random.default_rng(5)
    x, q = rng.standard_normal((300, 24)), rng.standard_normal((20, 24))
    how = ann.OneBit()
    turn = ann.rotation(24, ann.code_bits(24, how), how.seed)
    assert np.allclose(np.linalg.norm(x @ turn, axis=1), np.linalg.norm(x, axis=1))
    low = ann.lower_bounds(*ann.encode(x, turn), q @ turn, how)
    true = ((x[None] - q[:, None]) ** 2).sum(axis=2)
    assert (low <= true).mean() > 0.99 and np.corrcoef(low.ravel(), true.ravel())[0, 1] > 0.8


# op8


def test_toxicity(spark, awkward, nothing):
    rng = random.Random(6)
    filler = lambda: " ".join(rng.choices([f"w{i}" for i in range(200)], k=60))
    texts, marks = [], []
    for i in range(400):
        bad = i % 5 == 0
        t = filler().split()
        if bad:
            for _ in range(3):
                t.insert(rng.randrange(len(t)), rng.choice(("idiot", f"grok{rng.choice('abcdef')}ul")))
        texts.append(" ".join(t))
        marks.append((i, int(bad)))
    docs = frame(spark, texts)
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    ask = frame(spark, [filler() + " IDI0T groks", filler(), "", None, "the pond scum here", "an іdiоt, grokzul and grokaul"])
    got = {r["doc_id"]: (r["score"], r["hits"]) for r in toxicity.score(ask, model).collect()}
    assert got[0][0] >= 0.3 > got[1][0] and got[2][1] == got[3][1] == got[4][1] == 0 and got[5][0] >= 0.3 and got[5][1] >= 3
    # A harmless neighbour, learned from clean texts.
    kind = [f"{filler()} merry grokaul {filler()}" for _ in range(9)]
    more = docs.unionByName(spark.createDataFrame([(1000 + i, t, "en", "s", 0) for i, t in enumerate(kind)], DOCS))
    learned = toxicity.fit(more, labels.unionByName(spark.createDataFrame([(1000 + i, 0) for i in range(len(kind))], "doc_id long, toxic int")))
    assert "merry grokaul" in learned.exceptions
    hits = {r["doc_id"]: r["hits"] for r in toxicity.score(frame(spark, ["a merry grokaul", "a vile grokaul"]), learned).collect()}
    assert hits == {0: 0, 1: 1}
    assert toxicity.score(awkward, model).count() == awkward.count() and toxicity.score(nothing, model).count() == 0
    assert 0 <= toxicity.score(docs, toxicity.fit(nothing, labels.where("false"))).first()["score"] <= 1


def test_spared_hits_against_every_pair():
    rng = random.Random(11)
    for _ in range(200):
        spans = [(s, s + rng.randrange(1, 9), 1.0) for s in (rng.randrange(40) for _ in range(rng.randrange(30)))]
        hits, spared = spans[::2], spans[1::2]
        want = sorted(h for h in hits if not any(s <= h[0] and h[1] <= e for s, e, _ in spared))
        assert sorted(toxicity._outside(hits, spared)) == want


def test_toxicity_against_plain_search(spark):
    """Hits and score of the query, from its model, by looking for every entry at every place."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    fold = remainder(F.col("doc_id"), 4)
    model = toxicity.fit(docs.where(fold != 2), labels.where(fold != 2))
    got = {r["doc_id"]: r for r in queries.op8_weighted_lexicon_toxicity(spark, SF).collect()}
    c, a, b = model.curve
    for r in docs.collect():
        text = toxicity.fold(r["text"])
        places = lambda e: [i for i in range(len(text)) if text.startswith(e, i)]  # noqa: B023, E731
        spared = [(i, i + len(e) + 1) for e in model.exceptions for i in places(f" {e} ")]
        weights = [w for e, w in model.weights.items() if e in text for i in places(e) if not any(s <= i and i + len(e) - 1 <= t for s, t in spared)]
        x, y = math.log1p(sum(weights)), math.log1p(100 * sum(weights) / max(1, text.count(" ") - 1))
        z = c + a * (x - model.mean[0]) / model.scale[0] + b * (y - model.mean[1]) / model.scale[1]
        want = 1 / (1 + math.exp(-max(-30, min(30, z))))
        assert got[r["doc_id"]]["hits"] == len(weights) and got[r["doc_id"]]["score"] == pytest.approx(want, abs=1e-9)


# op9


def longest_phrases(sample, text):
    n, at = 0, 0
    while at < len(text):
        k = 1
        while at + k <= len(text) and text[at : at + k] in sample:
            k += 1
        at += max(1, k - 1)
        n += 1
    return n


def test_parses_are_the_longest(spark):
    docs = frame(spark, ["abracadabra banana bandana", "cabbage abacus"])
    model = langid.fit(docs)
    sample_text = {r["text"] for r in docs.collect()}
    model_sample = [f" {' '.join(langid.letters(t) for t in order)} " for order in (sorted(sample_text), sorted(sample_text, reverse=True))]
    rng = random.Random(8)
    for _ in range(40):
        t = langid.letters("".join(rng.choices("abcdngre u", k=30)))
        codes = model.alphabet[np.frombuffer(t.encode("utf-32-le"), np.uint32)].astype(np.int64)
        got = langid.phrases(*model.stacked(), codes, np.array([0]), np.array([len(codes)]), np.array([0]))[0, 0]
        assert got in {longest_phrases(s, t) + d for s in model_sample for d in (0, 1)}


@pytest.mark.parametrize("trace", [0, 3, 48])
def test_cut_texts_parse_as_whole_ones(spark, trace):
    rng = random.Random(5)
    docs = spark.createDataFrame([(lang, " ".join("".join(rng.choices(signs, k=rng.randrange(1, 6))) for _ in range(150))) for lang, signs in (("a", "abcab"), ("b", "bcdb"), ("c", "ade"))], "lang string, text string")
    model = langid.fit(docs)
    texts = [langid.letters("".join(rng.choices("abcde ", k=k))) or "a" for k in (1, 3, 8, 200, 900, 40)]
    codes = model.alphabet[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)].astype(np.int64)
    ends = np.cumsum([len(t) for t in texts])
    want = langid.phrases(*model.stacked(), codes, ends - [len(t) for t in texts], ends, np.arange(len(texts)))
    for piece in (1, 2, 7, 64):
        cuts = [(s, min(s + piece, e), i) for i, (e, t) in enumerate(zip(ends, texts, strict=True)) for s in range(e - len(t), e, piece)]
        starts, stops, row = (np.array(x) for x in zip(*cuts, strict=True))
        assert (langid.phrases(*model.stacked(), codes, starts, stops, row, trace) == want).all()


def test_sample_is_drawn_from_whole_texts(spark):
    """The letters that tell a language stand far behind in its only text."""
    docs = spark.createDataFrame([("x" * 3000 + "".join(chr(0x561 + i % 30) for i in range(3000)), "hy")], "text string, lang string")
    assert (langid.fit(docs).alphabet > 0).sum() >= 31


def test_language(spark, awkward, nothing):
    got = queries.op9_cross_parsing_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").where("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() > 0.97 and got["score"].between(0, 1).all()
    model = langid.fit(awkward)
    out = langid.predict(awkward, model).collect()
    assert len(out) == awkward.count() and sum(r["lang_pred"] == "und" for r in out) == 5
    assert {r["lang_pred"] for r in langid.predict(awkward, langid.fit(nothing)).collect()} == {"und"}
    assert langid.predict(nothing, model).count() == 0 and langid.annotate(awkward, model).count() == awkward.count()


def test_language_of_copies_is_learned(spark):
    copies = spark.range(200_000).select(F.lit("the same notice in every copy").alias("text"), F.lit("en").alias("lang"))
    others = spark.createDataFrame([("ein ganz anderer Satz steht hier", "de"), ("noch ein Satz", "de")], "text string, lang string")
    assert langid.fit(copies.unionByName(others)).languages == ["de", "en"]


def test_many_letters_and_languages(spark):
    rng = random.Random(12)
    rows = []
    for k in range(70):
        # Each language has its own 40 ideographs; as the last by name, its words decide and not a tie.
        signs = [chr(0x4E00 + 40 * k + i) for i in range(40)]
        rows += [("".join(rng.choices(signs, k=60)), f"l{k:02}") for _ in range(3 + (k < 64))]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert len(model.languages) == 70 and (model.alphabet > 0).sum() == len(set().union(*(t for t, _ in rows))) + 1
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    assert langid.annotate(docs, model).where("lang <> lang_pred").count() == 0


# op10


def brute_hits(texts, items):
    split = lambda t: re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())
    out = []
    for t in texts:
        w, hit, named = split(t), set(), set()
        for name, body in items:
            x = split(body)
            k = min(10, len(x))
            for i in range(len(x) - k + 1) if k else ():
                for s in range(len(w) - k + 1):
                    if w[s : s + k] == x[i : i + k]:
                        hit.update(range(s, s + k))
                        named.update([str(name)] if name is not None else [])
        out.append((len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_decontamination_against_brute_force(spark, block):
    rng = random.Random(9)
    word = lambda: f"W{rng.randrange(12)}"
    items = [(i, " ".join(word() for _ in range(rng.choice((1, 2, 5, 10, 13, 25))))) for i in range(12)] + [(None, "u1 u2 u3"), (50, None), (51, ""), (3, "w1, w2")]
    texts = [None, "", "w1"]
    for _ in range(60):
        t = [word() for _ in range(rng.randrange(40))]
        if rng.random() < 0.6:
            t[len(t) // 2 : len(t) // 2] = (rng.choice(items)[1] or "").split()
        texts.append(", ".join(t))
    got = decontamination.hits(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string"), decontamination.Windows(block_bytes=block)).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in got] == brute_hits(texts, items)
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in got)


def test_decontamination_on_awkward_rows(spark, awkward, nothing):
    items = spark.createDataFrame([(1, "short text here")], "item_id long, text string")
    assert sum(r["contaminated"] for r in decontamination.hits(awkward, items).collect()) == 3
    assert decontamination.clean(awkward, items).count() == awkward.count() - 3
    assert decontamination.clean(awkward, items).columns == awkward.columns
    assert decontamination.hits(awkward, items.where("false")).where("contaminated").count() == 0
    assert decontamination.hits(nothing, items).count() == 0


# registered queries


def test_queries_and_oracles(spark):
    import duckdb

    c = duckdb.connect()
    for name in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in queries.ORACLES.items():
        want, got = c.sql(sql).df(), queries.QUERIES[name](spark, SF).toPandas()
        columns = sorted(want.columns)
        key = lambda d: sorted(d[columns].astype(str).itertuples(index=False, name=None))  # noqa: B023, E731
        assert columns == sorted(got.columns) and key(want) == key(got)
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES] == [*range(1, 11)] or {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES} == set(range(1, 11))


def test_folds(spark):
    d = spark.range(50).select(remainder(F.col("id"), 10).alias("r"), "id")
    assert all(r["r"] == zlib.crc32(str(r["id"]).encode()) % 10 for r in d.collect())
