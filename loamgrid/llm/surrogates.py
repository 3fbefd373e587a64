"""Replaces personal data by keyed surrogates of the same type and format; built-in functions only.

Entities are found by pattern. Digits are replaced by a keyed permutation of all
numbers of that length, so two numbers never share a surrogate and the layout
stays; card numbers and IBANs that check out still do, and those that do not
still do not. Mail addresses keep their lengths, signs and number of labels, and
a shared domain stays shared. Names keep gender, script, case and number of
words. What is drawn can clash, so the distinct names and addresses of the whole
table are checked and those that clash are drawn again.

One entity gets one surrogate wherever and however it is written: a name's
gender is what its titles tell in the whole table, and in a text where a name
stands after a title, its mentions without one, by both words or by either, are
replaced too. A name that no title introduces in the same text is not found.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.llm.common import aside, met_by, stored

#: Forms of address by gender, in the order of the name lists below.
_TITLES = {"m": "Mr|Herr|Monsieur|Señor|Sir|Г-н", "f": "Mrs|Ms|Miss|Frau|Madame|Señora|Lady|Г-жа", "n": "Dr|Prof|Mx"}
#: Given names and family names by script and gender.
_GIVEN = {
    ("latin", "m"): "James Robert Michael David Thomas Daniel Paul Andrew Peter Simon Martin Oliver Lucas Felix Hugo Bruno".split(),
    ("latin", "f"): "Mary Anna Laura Julia Sarah Emma Clara Alice Helen Nora Diana Sofia Irene Lucia Marta Carla".split(),
    ("latin", "n"): "Alex Robin Kim Sam Jamie Charlie Taylor Morgan Jordan Casey Riley Avery Quinn Rowan Sasha Noel".split(),
    ("cyrillic", "m"): "Иван Пётр Павел Олег Игорь Антон Сергей Юрий".split(),
    ("cyrillic", "f"): "Анна Ольга Мария Елена Ирина Нина Вера Дарья".split(),
    ("cyrillic", "n"): "Саша Женя Валя Шура Слава Никита Мика Ника".split(),
}
#: Syllables of family names by script, each a beginning and an end; three make a name, of some 16 million.
_SYLLABLES = {
    "latin": ("b c d f g h k l m n p r s t v w".split(), "a al an ar e el en er i in o ol on or u ur".split()),
    "cyrillic": ("б в г д ж з к л м н п р с т ф х".split(), "а ал ан ар е ел ен ер и ин о ол он ор у ур".split()),
}
_WORD = r"\p{Lu}[\p{L}'-]+(?<!'s)(?<!['-])"
_NAME = rf"{_WORD}(?: {_WORD})?"
#: What counts as an entity; the first that matches at a place wins.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.){1,126}[A-Za-z]{2,24}(?![A-Za-z])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{3}[.-])[0-9]{3,4}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}[ -]){3}[0-9]{1,7}(?![0-9A-Za-z])|(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{4}){2,7}[A-Z0-9]{0,4}(?![0-9A-Za-z])",
    "name": rf"(?<!\p{{L}})(?:{'|'.join(_TITLES.values())})\.? {_NAME}",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_DRAWN = ("email", "name")


@dataclass(frozen=True)
class Surrogates:
    """key: secret that the surrogates depend on; redraws: times that clashing values are drawn again before a suffix settles them."""

    key: str = "set-a-secret-key"
    redraws: int = 3


def kind(entity: Column) -> Column:
    out = F.lit("name")
    for k in ("iban", "card", "phone", "ssn", "ip", "email"):
        out = F.when(entity.rlike(f"^(?:{PATTERNS[k]})$"), F.lit(k)).otherwise(out)
    return out


def canonical(entity: Column) -> Column:
    """What makes two spellings one entity: letters in lower case, numbers without their layout, names without title."""
    k = kind(entity)
    bare = F.regexp_replace(F.lower(entity), "[^0-9a-z]", "")
    name = F.lower(F.regexp_replace(entity, rf"^(?:{'|'.join(_TITLES.values())})\.? ", ""))
    return F.when(k == "email", F.lower(entity)).when(k == "name", name).when(k == "ip", entity).otherwise(bare)


def _hex(how: Surrogates, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(how.key), *parts), 256)


def _pick(values: list[str], h: Column, at: int) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.conv(F.substring(h, at, 7), 16, 10).cast("long") % len(values) + 1).cast("int"))


def _permuted(digits: Column, how: Surrogates, what: str) -> Column:
    """A keyed permutation of the decimal strings of each length: six Feistel rounds over the two halves."""
    left = F.substring(digits, F.lit(1), F.floor(F.length(digits) / 2).cast("int"))
    right = F.substring(digits, (F.floor(F.length(digits) / 2) + 1).cast("int"), F.length(digits))
    start = F.struct(left.alias("a"), right.alias("b"))

    def turn(at: Column, i: Column) -> Column:
        # The half b goes first; a is shifted by a keyed function of b, modulo the numbers of a's length.
        h = F.conv(F.substring(_hex(how, F.lit(what), i.cast("string"), F.length(at["a"]).cast("string"), at["b"]), 1, 15), 16, 10).cast("decimal(38,0)")
        size = F.rpad(F.lit("1"), F.length(at["a"]) + 1, "0").cast("decimal(38,0)")
        moved = (at["a"].cast("decimal(38,0)") + h) % size
        return F.struct(at["b"].alias("a"), F.lpad(moved.cast("decimal(38,0)").cast("string"), F.length(at["a"]), "0").alias("b"))

    out = F.aggregate(F.array(*[F.lit(i) for i in range(6)]), start, turn)
    return F.when(F.length(digits) < 2, digits).otherwise(F.concat(out["a"], out["b"]))


def _laid_out(entity: Column, digits: Column, skip: int = 0) -> Column:
    """``entity`` with its digits, after the first ``skip``, replaced by ``digits`` in turn; all else stays."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("used"))

    def put(at: Column, c: Column) -> Column:
        fresh = c.rlike("[0-9]") & (at["used"] >= skip)
        return F.struct(F.concat(at["text"], F.when(fresh, F.substring(digits, at["used"] - skip + 1, F.lit(1))).otherwise(c)).alias("text"), (at["used"] + c.rlike("[0-9]").cast("int")).alias("used"))

    return F.aggregate(F.split(entity, ""), start, put)["text"]


def gender(entity: Column) -> Column:
    """The gender that a name's title tells: m, f or n."""
    out = F.lit("n")
    for g in ("m", "f"):
        out = F.when(entity.rlike(rf"^(?:{_TITLES[g]})\.? "), F.lit(g)).otherwise(out)
    return out


def _bare(entity: Column) -> Column:
    """A name without its title."""
    return F.regexp_replace(entity, rf"^(?:{'|'.join(_TITLES.values())})\.? ", "")


def _scrambled(text: Column, h: Column) -> Column:
    """``text`` in lower case with each letter and digit drawn anew, by the hash ``h`` and its place; other signs stay."""
    at = lambda i, n: F.pmod(F.xxhash64(h, i), F.lit(n)).cast("int")
    put = lambda c, i: F.when(c.rlike("[a-z]"), F.char(at(i, 26) + 97)).when(c.rlike("[0-9]"), F.char(at(i, 10) + 48)).otherwise(c)
    return F.array_join(F.transform(F.split(F.lower(text), ""), put), "")


def drawn(k: Column, canon: Column, told: Column, attempt: Column, how: Surrogates) -> Column:
    """Surrogate of an address, or of a name without title, at a given draw; after the last a keyed suffix makes it certain."""
    h = _hex(how, k, canon, attempt.cast("string"))
    settled = attempt > how.redraws
    host = F.regexp_extract(canon, "@(.*)", 1)
    local = F.concat(_scrambled(F.regexp_extract(canon, "^([^@]*)@", 1), h), F.when(settled, F.concat(F.lit("-"), F.substring(h, 22, 16))).otherwise(F.lit("")))
    email = F.concat(local, F.lit("@"), _scrambled(F.regexp_replace(host, r"\.[^.]*$", ""), _hex(how, F.lit("host"), host)), F.lit(".example"))
    words = F.size(F.split(canon, " "))
    name = F.lit(None).cast("string")
    for (script, g), given in _GIVEN.items():
        fits = (told == g) & (canon.rlike(r"\p{IsCyrillic}") == F.lit(script == "cyrillic"))
        begin, end = _SYLLABLES[script]
        family = F.initcap(F.concat(*[_pick(part, h, 8 + 14 * i + 7 * j) for i in range(3) for j, part in enumerate((begin, end))]))
        name = F.when(fits, F.when(words > 1, F.concat(_pick(given, h, 1), F.lit(" "), family)).otherwise(family)).otherwise(name)
    name = F.concat(name, F.when(settled, F.translate(F.substring(h, 49, 16), "0123456789", "ghijklmnop")).otherwise(F.lit("")))
    return F.when(k == "email", email).otherwise(name)


def _luhn(payload: Column) -> Column:
    """The check digit that belongs to the digits before it."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(2).alias("by"))

    def step(at: Column, c: Column) -> Column:
        x = c.cast("int") * at["by"]
        return F.struct((at["sum"] + F.when(x > 9, x - 9).otherwise(x)).alias("sum"), (3 - at["by"]).alias("by"))

    return F.pmod(-F.aggregate(F.split(F.reverse(payload), ""), start, step)["sum"], F.lit(10))


def _card(digits: Column, how: Surrogates) -> Column:
    """All digits but the last permuted; the last is as far from the one that would check out as it was."""
    n = F.length(digits)
    old = F.substring(digits, F.lit(1), n - 1)
    new = _permuted(old, how, "number")
    last = F.pmod(_luhn(new) + F.substring(digits, n, F.lit(1)).cast("int") - _luhn(old), F.lit(10))
    return F.concat(new, last.cast("string"))


def _iban_check(country: Column, account: Column) -> Column:
    """The two check digits that belong to an account, as a number."""
    step = lambda at, c: F.when(c.rlike("[0-9]"), at * 10 + F.ascii(c) - 48).otherwise(at * 100 + F.ascii(c) - 55) % 97
    return 98 - F.aggregate(F.split(F.concat(account, country, F.lit("00")), ""), F.lit(0), step)


def _iban(entity: Column, how: Surrogates) -> Column:
    """Country kept, digits of the account permuted, its letters shifted by a keyed step for each place, check digits made anew."""
    country, old = F.substring(entity, 1, 2), F.substring(entity, F.lit(5), F.length(entity))
    shift = lambda c, i: F.when(c.rlike("[A-Z]"), F.char(F.pmod(F.ascii(c) - 65 + F.pmod(F.xxhash64(F.lit(how.key), i), F.lit(26)), F.lit(26)).cast("int") + 65)).otherwise(c)
    digits = F.regexp_replace(old, "[^0-9]", "")
    new = _laid_out(F.array_join(F.transform(F.split(old, ""), shift), ""), _permuted(digits, how, "iban"))
    check = F.pmod(_iban_check(country, new) + F.substring(entity, 3, 2).cast("int") - _iban_check(country, old), F.lit(100))
    return F.concat(country, F.lpad(check.cast("string"), 2, "0"), new)


def surrogate(entity: Column, puts: Column, how: Surrogates) -> Column:
    """The replacement of one entity as it is written; ``puts`` has those of names, and of addresses that were drawn again."""
    k, canon = kind(entity), canonical(entity)
    digits = F.regexp_replace(entity, "[^0-9]", "")
    put, bare = F.element_at(puts, canon), _bare(entity)
    name = F.concat(F.substring(entity, F.lit(1), F.length(entity) - F.length(bare)), _cased(bare, put))
    return (
        F.when(k == "name", name)
        .when(k == "email", F.coalesce(put, drawn(k, canon, F.lit("n"), F.lit(0), how)))
        .when(k == "ip", _address(entity, how))
        .when(k == "phone", F.when(entity.startswith("+"), _laid_out(entity, _permuted(F.substring(digits, F.lit(2), F.length(digits)), how, "phone"), 1)).otherwise(_laid_out(entity, _permuted(digits, how, "phone"))))
        .when(k == "iban", _iban(entity, how))
        .when(k == "card", _laid_out(entity, _card(digits, how)))
        .otherwise(_laid_out(entity, _permuted(digits, how, "number")))
    )


def _cased(written: Column, put: Column) -> Column:
    """``put`` in capitals where the name is written so."""
    return F.when((written == F.upper(written)) & (F.length(written) > 1), F.upper(put)).otherwise(put)


def _address(entity: Column, how: Surrogates) -> Column:
    """A keyed permutation of the IPv4 addresses: six Feistel rounds over the two 16-bit halves."""
    part = lambda i: F.element_at(F.split(entity, "\\."), i).cast("int")
    start = F.struct((part(1) * 256 + part(2)).alias("a"), (part(3) * 256 + part(4)).alias("b"))

    def turn(at: Column, i: Column) -> Column:
        h = F.conv(F.substring(_hex(how, F.lit("ip"), i.cast("string"), at["b"].cast("string")), 1, 4), 16, 10).cast("int")
        return F.struct(at["b"].alias("a"), ((at["a"] + h) % 65536).alias("b"))

    out = F.aggregate(F.array(*[F.lit(i) for i in range(6)]), start, turn)
    return F.concat_ws(".", F.shiftright(out["a"], 8), out["a"] % 256, F.shiftright(out["b"], 8), out["b"] % 256)


def _settled(docs: DataFrame, how: Surrogates) -> DataFrame | None:
    """(canon, put, first) of all names, and of addresses whose first draw clashes, over the whole table; None if there are none.

    A name's gender is the one that its titles tell, and neither if they tell
    both. Surrogates are compared in canonical form, names without title.
    """
    found = docs.select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"(?:{PATTERNS['email']})|(?:{PATTERNS['name']})"), F.lit(0))).alias("entity"))
    told = gender(F.col("entity"))
    each = found.groupBy(kind(F.col("entity")).alias("kind"), canonical(F.col("entity")).alias("canon")).agg(F.max(told == "m").alias("m"), F.max(told == "f").alias("f"))
    each = stored(each.select("kind", "canon", F.when(F.col("m") & ~F.col("f"), "m").when(F.col("f") & ~F.col("m"), "f").otherwise("n").alias("told")))
    again, out = each, None
    for attempt in range(how.redraws + 2):
        now = again.withColumn("put", drawn(F.col("kind"), F.col("canon"), F.col("told"), F.lit(attempt), how)).withColumn("value", F.lower("put"))
        now = stored(now.withColumn("attempt", F.lit(attempt)))
        if now.isEmpty():
            break
        if attempt > how.redraws:
            kept, again = now, each.where("false")
        else:
            first = now.groupBy("value").agg(F.min("canon").alias("canon"))
            if out is not None:
                first = first.join(out.select("value"), "value", "left_anti")
            # A value that is somebody's own is no surrogate.
            first = first.join(each.select(F.col("canon").alias("value")), "value", "left_anti")
            kept = stored(now.join(first, ["value", "canon"], "left_semi"))
            again = stored(now.join(first, ["value", "canon"], "left_anti").select("kind", "canon", "told"))
        out = kept if out is None else out.unionByName(kept)
    if out is None:
        return None
    needed = out.where("kind = 'name' OR attempt > 0").select("canon", "put", (F.col("kind") == "name").alias("is_name"))
    needed = stored(needed)
    return None if needed.isEmpty() else needed


def _mentions(found: Column, puts: Column, how: Surrogates) -> Column:
    """(pattern, mark, put) for each way in which the names of a text are mentioned without title, the longest first."""

    def ways(e: Column) -> Column:
        bare, put = _bare(e), F.element_at(puts, canonical(e))
        whole = F.struct((-F.length(bare)).alias("order"), bare.alias("said"), _cased(bare, put).alias("put"))
        part = lambda i: F.struct((-F.length(F.element_at(F.split(bare, " "), i))).alias("order"), F.element_at(F.split(bare, " "), i).alias("said"), _cased(bare, F.element_at(F.split(put, " "), i)).alias("put"))
        return F.when(F.contains(bare, F.lit(" ")), F.array(whole, part(1), part(-1))).otherwise(F.array(whole))

    every = F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(found, lambda e: kind(e) == "name"), ways))))
    mark = lambda i: F.concat(F.lit("\ue000"), F.substring(_hex(how, F.lit("mark")), 1, 8), i.cast("string"), F.lit("\ue001"))
    return F.transform(every, lambda x, i: F.struct(F.concat(F.lit(r"(?<![\p{L}'-])"), x["said"], F.lit(r"(?![\p{L}-])")).alias("pattern"), mark(i).alias("mark"), x["put"].alias("put")))


def _unnamed(text: Column, ways: Column) -> Column:
    """``text`` with all mentions replaced: by marks first, so that no surrogate is taken for a mention."""
    marked = F.aggregate(ways, text, lambda t, x: F.regexp_replace(t, x["pattern"], x["mark"]))
    return F.aggregate(ways, marked, lambda t, x: F.replace(t, x["mark"], x["put"]))


def replace(docs: DataFrame, how: Surrogates = Surrogates()) -> DataFrame:
    """``docs``, all columns kept, with every entity in ``text`` replaced, and ``n_entities`` and ``kinds`` (sorted, one for each) added.

    Null texts stay null and have no entities. Repeated rows are replaced alike.
    Texts of any length are read to their end. The rest of a text is untouched.
    Mentions of a name without its title are replaced but not counted. Existing
    columns named like the two new ones are replaced.
    """
    docs = docs.drop("n_entities", "kinds")
    rows, back = aside(docs, "text")
    clean = F.coalesce(F.col("text"), F.lit(""))
    settled = _settled(docs, how)
    out = rows.withColumn("found", F.regexp_extract_all(clean, F.lit(ENTITY), F.lit(0)))

    def finish(out: DataFrame, named: bool) -> DataFrame:
        puts = F.col("puts")
        out = out.withColumn("ways", _mentions(F.col("found"), puts, how) if named else F.lit(None))
        seg = (lambda t: _unnamed(t, F.col("ways"))) if named else lambda t: t
        out = out.withColumn("between", F.when(F.size("found") > 0, F.split(clean, ENTITY, -1)))
        pairs = F.arrays_zip(F.slice("between", F.lit(1), F.size("found")).alias("b"), F.col("found").alias("t"))
        parts = F.transform(pairs, lambda x: F.concat(seg(x["b"]), surrogate(x["t"], puts, how)))
        text = F.when(F.size("found") > 0, F.concat(F.array_join(parts, ""), seg(F.element_at("between", -1)))).otherwise(F.col("text"))
        kinds = F.array_sort(F.transform("found", kind))
        return back(out.withColumn("n_entities", F.size("found").cast("long")).withColumn("kinds", kinds).withColumn("text", text), "n_entities", "kinds")

    if settled is None:
        return finish(out.withColumn("puts", F.lit(None).cast("map<string,string>")), False)
    # Only texts with a name, or with an address if any was drawn again, need the join; they meet their few values by a hash of the text.
    wanted = ("name",) if settled.where("NOT is_name").isEmpty() else _DRAWN
    needs = F.exists("found", lambda e: kind(e).isin(*wanted))
    some = out.where(needs).withColumn("key", F.xxhash64("text"))
    asked = some.select("key", F.explode(F.array_distinct(F.transform("found", canonical))).alias("canon")).distinct()
    puts = asked.join(settled, "canon").groupBy("key").agg(F.map_from_entries(F.collect_set(F.struct("canon", "put"))).alias("puts"))
    plain = finish(out.where(~needs).withColumn("puts", F.lit(None).cast("map<string,string>")), False)
    return plain.unionByName(finish(met_by(some, puts, "key", "left"), True))
