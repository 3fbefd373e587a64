"""Secret scanning with a random forest that removes false findings; built-in functions only.

A pattern finds candidates: key blocks, whatever is assigned to a secret word or
quoted without a space (6 characters and more), and runs of 16 and more token
characters that mix letters and digits. Each candidate is described by its length, the changes
between kinds of characters, the part of it that dictionary words cover, its
path-like marks and the words beside it. A forest fitted on labelled findings
decides; its trees are compiled into one column expression, so scanning and
redaction happen where the text is read and nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm.common import aside, stored

#: A private-key block, with header lines or without.
_BLOCK = r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----[^-]++(?:-{1,4}+[^-]++){0,200}+-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
#: A secret word and its assignment; what follows is the value.
_ASSIGNED = r"(?i:passw|passphrase|pwd|secret|token|credential|key|auth|bearer)[A-Za-z0-9_-]{0,24}+[\"'`]?[ \t]{0,4}+(?:=>|:=|=|:|is(?=[ \t]))[ \t]{0,4}+(?i:(?:bearer|basic)[ \t]{1,4}+)?"
#: A value of 6 and more characters: quoted, or to the next space; another assignment after & is no part of it.
_VALUE = r"(?:\"[^\"\r\n]{6,}+(?=\")|'[^'\r\n]{6,}+(?=')|`[^`\r\n]{6,}+(?=`)|(?=[^\s\"'`<>]{6})[^\s\"'`<>&]++(?:&(?![A-Za-z0-9_]{1,40}=)[^\s\"'`<>&]*+){0,40}+)"
#: Key blocks, assigned values with what stands before them, quoted values, and 16 and more token characters with a letter and a digit among them.
CANDIDATE = (
    rf"{_BLOCK}|{_ASSIGNED}{_VALUE}"
    rf"|(?<=[\"'`])(?![^\s\"'`]{{0,200}}?(?:://|{_ASSIGNED}))[^\s\"'`]{{6,}}+(?=[\"'`])"
    rf"|(?<![A-Za-z0-9_+/.~-])(?=[A-Za-z_+/.~-]*+[0-9])(?=[0-9_+/.~-]*+[A-Za-z])(?![A-Za-z0-9_.-]{{0,60}}?{_ASSIGNED}{_VALUE})[A-Za-z0-9_+/.~-]{{16,}}+={{0,2}}"
)
#: Words whose presence beside a candidate speaks for or against a secret.
_FOR = "key|token|secret|passw|pwd|auth|bearer|credential|api|private|session"
_AGAINST = "commit|sha|hash|checksum|digest|md5|uuid|guid|version|revision|example|sample|placeholder|file|path|image|build|etag|blob|url|href|http|host|mail|www|public|fingerprint|(cache|primary|foreign|partition)[ _-]?key"
#: issuers' prefixes.
_ISSUED = r"^(AKIA|ASIA|gh[pousr]_|sk_live_|sk_test_|rk_live_|xox[abprs]-|AIza|eyJ|glpat-|SG\.|npm_|-----BEGIN)"
#: Short words that human-made identifiers are built from.
_WORDS = "the|and|for|with|from|this|that|your|here|user|name|file|path|page|site|test|example|sample|placeholder|change|default|config|setting|server|client|service|package|version|release|image|index|article|story|blog|post|news|data|base|table|column|value|value|number|count|size|type|list|item|get|set|response|request|handler|http|https|html|json|yaml|mail|host|local|cloud|admin|main|master|branch|build|debug|lib|usr|bin|var|tmp|home|src|python|java|script|module|api|key|token|secret|password|abc|xxx|one|two|three|com|org|net|www|slug|long|last|first|date|time|year|month|week"

FEATURES = ("length", "digits", "uppers", "signs", "changes", "consonants", "covered", "path", "distinct", "near_for", "near_against", "assigned", "quoted", "in_url", "hex", "issued")


@dataclass(frozen=True)
class Forest:
    """trees, depth: of the forest; examples: generated findings it is fitted on by default; threshold: least share of trees."""

    trees: int = 24
    depth: int = 6
    examples: int = 6_000
    seed: int = 11
    threshold: float = 0.5
    before: int = 40
    after: int = 12


def features(before: Column, token: Column, after: Column) -> Column:
    """Struct of the numbers that describe a candidate and its surroundings."""
    n = F.length(token).cast("double")
    left = lambda pattern: F.length(F.regexp_replace(token, pattern, "")).cast("double")
    near = F.lower(before)
    yes = lambda c: c.cast("double")
    return F.struct(
        F.least(n, F.lit(400.0)).alias("length"),
        (1 - left("[0-9]") / n).alias("digits"),
        (1 - left("[A-Z]") / n).alias("uppers"),
        (left("[A-Za-z0-9]") / n).alias("signs"),
        ((n - left(r"(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]|(?<=[^A-Za-z0-9])[A-Za-z0-9]")) / n).alias("changes"),
        (1 - left("(?i)[bcdfghjklmnpqrstvwxz]{3,}+") / n).alias("consonants"),
        (1 - left(f"(?i)({_WORDS})") / n).alias("covered"),
        (n - left("[/.]")).alias("path"),
        (F.size(F.array_distinct(F.split(F.substring(token, 1, 200), ""))) / F.least(n, F.lit(200.0))).alias("distinct"),
        yes(near.rlike(f"({_FOR})[^\\n]{{0,14}}$")).alias("near_for"),
        yes(near.rlike(f"({_AGAINST})[^\\n]{{0,14}}$")).alias("near_against"),
        yes(near.rlike(r"(=|:|=>|\bis)\s*[\"'`]?$")).alias("assigned"),
        yes(near.rlike(r"[\"'`]$") & after.rlike(r"^[\"'`]")).alias("quoted"),
        yes(near.rlike(r"([/@\\]|://[^\s]*)$")).alias("in_url"),
        yes(token.rlike("^[0-9a-f-]+$")).alias("hex"),
        yes(token.rlike(_ISSUED)).alias("issued"),
    )


def labelled_examples(spark: SparkSession, how: Forest = Forest()) -> DataFrame:
    """(before, token, after, label): generated findings, the same for the same seed; half are secrets.

    Their values come from hashes of row numbers, in the forms that issuers use;
    the others are commits, checksums, identifiers, host names, paths, slugs, and
    hashes that a public, cache or database key or a fingerprint is said to be.
    A third of both are short: passwords and plain letters, or words, quoted
    phrases and placeholders. A tenth of the secrets are key blocks.
    """

    def make(id: Column, digest: Column, b64: Column) -> Column:
        h = lambda salt, n: F.pmod(F.xxhash64(id, F.lit(salt + how.seed)), F.lit(n)).cast("int")
        choose = lambda salt, *xs: F.element_at(F.array(*[F.lit(x) if isinstance(x, str) else x for x in xs]), h(salt, len(xs)) + 1)
        piece = lambda a, n: F.substring(digest, a, n)
        word = lambda salt: choose(salt, "user", "article", "release", "module", "image", "handler", "default", "service", "config", "page", "index", "response")
        random = choose(1, piece(1, 40), piece(1, 32), piece(1, 64), F.substring(b64, 1, 43), F.concat(F.lit("AKIA"), F.upper(F.substring(b64, 3, 16))), F.concat(F.lit("ghp_"), F.substring(b64, 1, 36)), F.concat(F.lit("sk_live_"), F.substring(b64, 1, 24)), F.concat(F.lit("eyJ"), F.substring(b64, 1, 60), F.lit("."), F.substring(b64, 5, 43)), F.concat(F.substring(b64, 1, 9), choose(2, "_", "-", "~"), F.substring(b64, 20, 9)))
        subject = choose(3, "token", "api_key", "secret", "password", "auth_token", "access_key", "client_secret", "PRIVATE_TOKEN", "bearer", "credentials")
        said = F.concat(choose(4, "", "some words of a text. ", "export ", "  ", "thus the "), subject, choose(5, " = ", "=", ": ", ":", " is "))
        quote = choose(6, "\"", "'", "", "\"")
        other = choose(7, piece(1, 40), piece(1, 64), F.concat_ws("-", piece(1, 8), piece(9, 4), piece(13, 4), piece(17, 4), piece(21, 12)), F.concat(word(8), F.lit("-"), word(9), F.lit("-"), word(10), F.lit("-20"), F.lpad(h(11, 30).cast("string"), 2, "0")), F.concat(F.lit("/usr/lib/"), word(12), F.lit("3."), h(13, 15).cast("string"), F.lit("/"), word(14), F.lit("/"), word(15), F.lit(".py")), F.concat(F.lit("mail"), h(16, 90).cast("string"), F.lit("."), word(17), F.lit(".example.com")), F.concat(F.lit("your_"), choose(18, "token", "api_key", "secret"), F.lit("_here_"), h(19, 99).cast("string")), F.concat(F.lit("get"), F.initcap(word(20)), F.lit("Code"), h(21, 900).cast("string"), F.initcap(word(22))), F.concat(F.repeat(F.lit("x"), h(23, 9) + 14), F.lit("1")))
        benign = choose(24, "commit ", "sha256:", "checksum: ", "see ", "uuid=", "request id ", "https://example.org/", "user@", "version ", "file ", "image: registry/", "in the text of ", "etag: \"", "md5 = ", "blob ", "digest ")
        benign = F.when(h(7, 9) == 6, F.concat(subject, F.lit(" = \""))).when(h(7, 9) < 2, choose(25, "commit ", "sha256:", "checksum: ", "blob ", "etag: \"", "md5 = ", "digest ", "revision ", "hash = ", "build ", "cache key = ", "cache_key=", "public key: ", "public_key = \"", "primary key = ", "foreign key: ", "partition key = \"", "key fingerprint: ")).otherwise(benign)
        short = h(30, 3) == 0
        plain = lambda a, n: F.translate(F.substring(b64, a, n), "0123456789", "qzxwvkjhgf")
        password = choose(31, F.substring(b64, 5, 8), F.substring(b64, 9, 13), F.concat(word(32), h(33, 99).cast("string"), word(34)), F.concat(F.substring(b64, 7, 6), choose(35, "&", "!", "$", "#", "@", "%", "*"), F.substring(b64, 30, 5)), F.concat(plain(3, 4), h(36, 9999).cast("string")), plain(11, 24), F.lower(plain(20, 24)), F.concat(F.lower(plain(2, 5)), h(37, 9).cast("string"), word(38)))
        phrase = choose(41, "important", "required", "stored", "missing", "always", "needed", "written", "another", "something", "nothing", "undefined", "string", "optional", "invalid", "expired", "rotated", "Optional", "Required")
        blank = choose(42, "${SECRET}", "<your-token>", "********", "[SECRET]", "process.env.TOKEN", "changeme", "your_password", "config.api_key", "os.environ", "xxxxxxxx", "{{ password }}", "not-set", "self.token")
        said_word = F.concat(subject, choose(43, " is ", ": ", " = ", "=", ": \""))
        prose = choose(44, "he called it \"", "the word '", "name = \"", "class=\"", "a text of `", "type: \"", "said \"", "id='")
        named = choose(45, phrase, word(46), F.concat(word(47), F.lit("-"), word(48)), F.concat(word(49), h(50, 99).cast("string")), F.concat(word(51), F.lit("."), word(52)), F.concat(F.lower(plain(4, 5)), F.lit("ing")), F.initcap(word(53)))
        spoken = h(54, 3) > 0
        quoted = F.when(prose.endswith("'"), F.lit("' and")).when(prose.endswith("`"), F.lit("` and")).otherwise(F.lit("\" and"))
        little = F.when(spoken, choose(55, phrase, blank, F.concat_ws(" ", phrase, word(56), phrase, F.lit("and so on")))).otherwise(named)
        benign = F.when(short, F.when(spoken, said_word).otherwise(prose)).otherwise(benign)
        other = F.when(short, little).otherwise(other)
        rest = F.when(short & spoken, F.when(said_word.endswith("\""), F.lit("\" and")).otherwise(F.lit(" and so on"))).when(short, quoted).otherwise(F.lit(" and so on"))
        random = F.when(short, password).otherwise(random)
        kind = choose(61, " PRIVATE KEY", " RSA PRIVATE KEY", " PGP PRIVATE KEY BLOCK", " OPENSSH PRIVATE KEY")
        header = choose(62, "\n", "\n", "\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0F\n\n", "\nVersion: 2\n\n")
        block = F.concat(F.lit("-----BEGIN"), kind, F.lit("-----"), header, choose(63, piece(1, 64), F.concat(piece(1, 64), F.lit("\n"), piece(65, 64)), F.repeat(F.concat(F.substring(b64, 1, 64), F.lit("\n")), h(64, 30) + 1)), F.lit("\n-----END"), kind, F.lit("-----"))
        whole = h(60, 10) == 0
        said = F.when(whole, choose(65, "", "see ", "some words of a text.\n", "key: ", "in the file\n")).otherwise(said)
        quote = F.when(whole, F.lit("")).otherwise(quote)
        random = F.when(whole, block).otherwise(random)
        is_secret = id % 2 == 0
        return F.struct(F.when(is_secret, F.concat(said, quote)).otherwise(benign).alias("before"), F.when(is_secret, random).otherwise(other).alias("token"), F.when(is_secret, F.concat(quote, F.lit(" and"))).otherwise(rest).alias("after"), is_secret.cast("double").alias("label"))

    # Inside a lambda the long expression is interpreted; as generated code it would exceed what Java allows a method.
    # What is used many times is a column of a stored table, so that it is not copied into the expression each time.
    digest = F.sha2(F.concat_ws("-", F.lit(str(how.seed)), F.col("id").cast("string")), 512)
    base = stored(spark.range(0, how.examples, 1, 4).select("id", digest.alias("digest"), F.regexp_replace(F.base64(F.unhex(digest)), "[+/=\\s]", "").alias("b64")))
    return stored(base.select(F.transform(F.array(F.struct("id", "digest", "b64")), lambda r: make(r["id"], r["digest"], r["b64"]))[0].alias("row")).select("row.*"))


class _Trees:
    """Fitted trees as flat lists, and their verdict as an expression that walks them.

    The lists travel as short texts that the optimizer turns into constants, so
    the plan stays small whatever the size of the forest.
    """

    def __init__(self, roots: list, depth: int):
        self.feature: list[int] = []
        self.bound: list[float] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.verdict: list[float] = []
        self.depth = depth
        self.roots = [self._add(r) for r in roots]

    def _add(self, node) -> int:
        """Takes a node and those below it; a leaf points at itself."""
        at = len(self.feature)
        leaf = node.numDescendants() == 0
        self.feature.append(0 if leaf else node.split().featureIndex())
        self.bound.append(0.0 if leaf else node.split().threshold())
        self.verdict.append(node.prediction() if leaf else 0.0)
        self.left.append(at)
        self.right.append(at)
        if not leaf:
            self.left[at], self.right[at] = self._add(node.leftChild()), self._add(node.rightChild())
        return at

    def share(self, values: Column) -> Column:
        """Share of trees that end in 1, for an array of feature values."""
        const = lambda xs, kind: F.split(F.lit(",".join(map(repr, xs))), ",").cast(f"array<{kind}>")
        feature, bound = const(self.feature, "int"), const(self.bound, "double")
        left, right = const(self.left, "int"), const(self.right, "int")
        step = lambda at, _: F.when(F.get(values, F.get(feature, at)) <= F.get(bound, at), F.get(left, at)).otherwise(F.get(right, at))
        levels = F.sequence(F.lit(1), F.lit(self.depth))
        ends = F.transform(const(self.roots, "int"), lambda root: F.get(const(self.verdict, "double"), F.aggregate(levels, root, step)))
        return F.aggregate(ends, F.lit(0.0), lambda n, x: n + x) / len(self.roots)


_FITTED: dict[Forest, _Trees] = {}


class Scanner:
    """A fitted forest that scans texts; ``labelled`` (before, token, after, label) takes the place of the generated findings."""

    def __init__(self, spark: SparkSession, labelled: DataFrame | None = None, how: Forest = Forest()):
        self.how = how
        if labelled is not None:
            self._trees = self._fit(labelled, how)
            return
        # The generated findings depend on the settings alone, so a session fits them once.
        if how not in _FITTED:
            _FITTED[how] = self._fit(labelled_examples(spark, how), how)
        self._trees = _FITTED[how]

    @staticmethod
    def _fit(rows: DataFrame, how: Forest) -> _Trees:
        described = rows.select(F.transform(F.array(F.struct("before", "token", "after")), lambda x: features(x["before"], x["token"], x["after"]))[0].alias("f"), F.col("label").cast("double").alias("label")).select("f.*", "label").na.drop()
        # The fit reads its rows several times.
        described = stored(described)
        frame = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(described)
        fitted = RandomForestClassifier(numTrees=how.trees, maxDepth=how.depth, seed=how.seed, featureSubsetStrategy="sqrt").fit(frame)
        return _Trees([t._call_java("rootNode") for t in fitted.trees], how.depth)

    def score(self, values: Column) -> Column:
        """Share of trees that take a candidate for a secret."""
        return self._trees.share(F.array(*[values[f] for f in FEATURES]))

    def _judged(self, docs: DataFrame) -> DataFrame:
        """``docs`` with arrays of the text between candidates, of the candidates, and of their scores."""
        clean = F.coalesce(F.col("text").cast("string"), F.lit(""))
        out = docs.withColumn("__tokens", F.regexp_extract_all(clean, F.lit(CANDIDATE), F.lit(0)))
        out = out.withColumn("__between", F.when(F.size("__tokens") > 0, F.split(clean, CANDIDATE, -1)).otherwise(F.array(clean)))
        # Arrays are zipped first: named inside a lambda, they would be computed again for each element.
        n = F.size("__tokens")
        out = out.withColumn("__zipped", F.arrays_zip(F.slice("__between", F.lit(1), n).alias("b"), F.col("__tokens").alias("t"), F.slice("__between", F.lit(2), n).alias("a")))
        # An assigned value is found with what stands before it; that, and a sentence's signs after an unquoted one, are no part of the token.
        head = lambda t: F.regexp_extract(t, rf"^{_ASSIGNED}[\"'`]?", 0)
        tail = lambda t: F.regexp_extract(t, rf"^{_ASSIGNED}[^\"'`\s][^\s]*?([.,;:)\]}}]+)$", 1)
        cut = F.transform("__zipped", lambda x: F.struct(x["b"].alias("b"), x["t"].alias("t"), x["a"].alias("a"), F.when(x["t"].rlike(rf"^{_ASSIGNED}[\"'`]?[^\r\n]{{6}}"), head(x["t"])).otherwise(F.lit("")).alias("h"), tail(x["t"]).alias("e")))
        out = out.withColumn("__cut", cut)
        named = F.transform("__cut", lambda x: F.struct(F.concat(x["b"], x["h"]).alias("b"), F.substring(x["t"], F.length(x["h"]) + 1, F.length(x["t"]) - F.length(x["h"]) - F.length(x["e"])).alias("t"), x["e"].alias("e"), F.concat(x["e"], x["a"]).alias("a")))
        out = out.withColumn("__named", named)
        described = F.transform("__named", lambda x: F.struct(x["b"].alias("between"), x["t"].alias("token"), x["e"].alias("tail"), features(F.right(x["b"], F.lit(self.how.before)), x["t"], F.left(x["a"], F.lit(self.how.after))).alias("f")))
        return out.withColumn("__parts", F.transform(described, lambda x: F.struct(x["between"].alias("between"), x["token"].alias("token"), x["tail"].alias("tail"), F.round(self.score(x["f"]), 6).alias("score"))))

    def findings(self, docs: DataFrame) -> DataFrame:
        """(doc_id, n_candidates, n_secrets, findings) for each row of ``docs`` (doc_id, text).

        A finding has its place (characters before it), its length, its score
        and a fingerprint; the secret itself is not repeated. Null and empty
        texts have none, repeated rows have the same, other columns are left
        aside, and a text of any length is read to its end.
        """
        out = self._judged(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<place:int,length:int,score:double,fingerprint:string>>").alias("found"))

        def step(at: Column, x: Column) -> Column:
            place = at["at"] + F.length(x["between"])
            one = F.struct(place.alias("place"), F.length(x["token"]).alias("length"), x["score"].alias("score"), F.substring(F.sha2(x["token"], 256), 1, 16).alias("fingerprint"))
            return F.struct((place + F.length(x["token"]) + F.length(x["tail"])).alias("at"), F.when(x["score"] >= self.how.threshold, F.concat(at["found"], F.array(one))).otherwise(at["found"]).alias("found"))

        found = F.aggregate("__parts", begin, step)["found"]
        return out.select("doc_id", F.size("__tokens").cast("long").alias("n_candidates"), found.alias("findings")).select("doc_id", "n_candidates", F.size("findings").cast("long").alias("n_secrets"), "findings")

    def redact(self, docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
        """``docs``, all columns kept, with each secret in ``text`` replaced by ``mask``; other text is untouched, null stays null."""
        rows, back = aside(docs, "text")
        out = self._judged(rows)
        hit = F.exists("__parts", lambda x: x["score"] >= self.how.threshold)
        parts = F.transform("__parts", lambda x: F.concat(x["between"], F.when(x["score"] >= self.how.threshold, F.lit(mask)).otherwise(x["token"]), x["tail"]))
        text = F.when(hit, F.concat(F.array_join(parts, ""), F.element_at("__between", -1))).otherwise(F.col("text"))
        return back(out.withColumn("text", text))
