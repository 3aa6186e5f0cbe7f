"""PII: keyed, type-consistent surrogates for detected entities.

DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import Scratch, fresh_name, ranked_within, table

#: Kinds in order of precedence, and what matches them (Java patterns).
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_TITLES_M = r"Mr|Herr|Monsieur|Señor|Г-н|Господин"
_TITLES_F = r"Mrs|Ms|Miss|Frau|Madame|Señora|Señorita|Г-жа|Госпожа"
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "awskey": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]{8})(?<=\b(?i:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z0-9+/_-]{8,}=*",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![0-9A-Za-z.-])[0-9]{4}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9A-Za-z-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{3}[.-])[0-9]{3,4}[ .-][0-9]{4}(?![0-9])",
    "name": rf"\b(?:{_TITLES_M}|{_TITLES_F})\.? \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+)?",
}
#: The one backreference needs its group's number in the whole alternation, which begins
#: with no group of its own.
PATTERN = "|".join(KINDS.values())


def may_have(text: Column) -> Column:
    """Whether some kind's pattern occurs. What every match of a kind holds is looked for
    first, as most texts have none of it and a fixed string is found much faster."""
    of = lambda *kinds: text.rlike("|".join(KINDS[k] for k in kinds))
    numbers = ("iban", "card", "ssn", "ip", "phone")
    found = (
        (F.contains(text, F.lit("@")) & of("email"))
        | ((F.contains(text, F.lit("AKIA")) | F.contains(text, F.lit("ASIA"))) & of("awskey"))
        | ((F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & of("secret"))
        | (text.rlike("[0-9][0-9.]") & of(*numbers))
        | of("name")
    )
    return F.coalesce(found, F.lit(False))

#: Given names for surrogates by gender and script.
GIVEN = {
    "mL": ("Adam", "Bruno", "Carlo", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Noah", "Oscar", "Paul", "Robin", "Simon", "Tomas", "Victor"),
    "fL": ("Alma", "Bianca", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irene", "Julia", "Karla", "Laura", "Marta", "Nora", "Olga", "Paula", "Rosa", "Sofia", "Tessa", "Vera"),
    "mC": ("Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Игорь", "Кирилл", "Леонид", "Максим", "Никита", "Олег", "Павел", "Роман", "Степан"),
    "fC": ("Анна", "Белла", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Ксения", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса"),
}
_SYLLABLES = {
    "L": ("ba", "cor", "da", "fel", "gan", "hol", "jen", "kir", "lan", "mor", "nel", "pas", "rin", "sal", "tor", "ven"),
    "C": ("ба", "ве", "го", "да", "жа", "зи", "ко", "ла", "ми", "но", "по", "ре", "са", "ту", "фе", "ши"),
}


#: Endings of made given names.
ENDINGS = {"mL": "o", "fL": "ia", "mC": "й", "fC": "я"}


def kind_of(surface: Column) -> Column:
    """The kind of a surface. A secret has lost the label that stood before it, so it is
    what nothing else fits."""
    out = F.lit("secret")
    for kind, pattern in reversed(list(KINDS.items())):
        if kind not in ("secret", "name"):
            out = F.when(surface.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    titled = surface.rlike(rf"^(?:{_TITLES_M}|{_TITLES_F})\.? ")
    return F.when(titled, "name").otherwise(out)


def _digits(surface: Column) -> Column:
    return F.regexp_replace(surface, "[^0-9]", "")


def parts_of(kind: Column, surface: Column) -> Column:
    """(at, type, norm) of what a surface refers to. Spellings of one thing have one norm:
    digits of numbers, lower case of addresses and names. A name has parts, so that a
    surname keeps its surrogate whether a given name stands before it or not."""
    gender = F.when(surface.rlike(rf"^(?:{_TITLES_F})\.? "), "f").otherwise("m")
    script = F.when(surface.rlike(r"\p{IsCyrillic}"), "C").otherwise("L")
    words = F.split(F.regexp_replace(surface, r"^\S+ ", ""), " ")
    part = lambda at, type_, norm: F.struct(F.lit(at).alias("at"), type_.alias("type"), norm.alias("norm"))
    # Slavic surnames agree with gender; others don't.
    family = F.concat(F.lit("family"), F.when(script == "C", gender).otherwise(F.lit("")), script)
    given = part(0, F.concat(F.lit("given"), gender, script), F.lower(F.element_at(words, 1)))
    surname = part(1, family, F.lower(F.element_at(words, -1)))
    name = F.when(F.size(words) > 1, F.array(given, surname)).otherwise(F.array(surname))
    norm = F.when(kind.isin("card", "ssn", "phone"), _digits(surface)).when(kind.isin("email"), F.lower(surface)).when(kind == "iban", F.replace(surface, F.lit(" "), F.lit(""))).otherwise(surface)
    return F.when(kind == "name", name).otherwise(F.array(part(0, kind, norm)))


def _syllables(script: str, number: Column, least: int) -> Column:
    """A number's hexadecimal digits as syllables, ``least`` at least: one to one."""
    table_ = F.create_map(*[F.lit(x) for n, syllable in enumerate(_SYLLABLES[script]) for x in (f"{n:X}", syllable)])
    digits = F.hex(number)
    digits = F.lpad(digits, F.greatest(F.length(digits), F.lit(least)).cast("int"), F.lit("0"))
    return F.array_join(F.transform(F.split(digits, ""), lambda d: F.coalesce(F.try_element_at(table_, d), F.lit(""))), "")


def _shaped(type_: Column, norm: Column, draw) -> Column:
    """The norm with its free places drawn anew: digits for digits, letters for letters of
    the same case, hexadecimal for hexadecimal."""
    hexed = norm.rlike("^[0-9a-f]+$")
    digit = lambda i: F.substring(F.lit("0123456789"), draw(i) % 10 + 1, F.lit(1))
    lower = lambda i: F.when(hexed, F.substring(F.lit("abcdef"), draw(i) % 6 + 1, F.lit(1))).otherwise(F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), draw(i) % 26 + 1, F.lit(1)))
    upper = lambda i: F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), draw(i) % 26 + 1, F.lit(1))
    change = lambda c, i: F.when(c.rlike("[0-9]"), digit(i)).when(c.rlike("[a-z]"), lower(i)).when(c.rlike("[A-Z]"), upper(i)).otherwise(c)
    shaped = F.array_join(F.transform(F.split(norm, ""), change), "")
    held = F.when(type_ == "awskey", 4).when(type_ == "card", 1).when(type_ == "iban", 2).when((type_ == "phone") & (F.length(norm) > 10), F.length(norm) - 10).otherwise(0)
    from_right = F.when(type_ == "email", F.length(F.substring_index(norm, ".", -1)) + 1).otherwise(0)
    size = F.length(norm)
    return F.concat(F.substring(norm, F.lit(1), held), F.substring(shaped, held + 1, F.greatest(size - held - from_right, F.lit(0))), F.substring(norm, size - from_right + 1, from_right))


def surrogate(type_: Column, norm: Column, attempt: int, place: Column, key: str) -> Column:
    """The keyed replacement of a norm, of its type and shape: digits for digits, letters
    for letters of the same case, what doesn't tell a person (country code, network digit,
    key prefix, top domain) as it is.

    Names are drawn from a list, then from syllables. From the third attempt on names,
    and from the fourth on addresses, which may be too short for all to differ, spell the
    number ``place`` in syllables, of which there are more the larger it is; names of
    different numbers differ."""
    seed = F.concat_ws("|", F.lit(key), type_, norm, F.lit(str(attempt)))
    stream = F.concat(F.sha2(seed, 512), F.sha2(F.concat(seed, F.lit("+")), 512))
    # Three hexadecimal digits per place: 85 places, then over again.
    draw = lambda i: F.conv(F.substring(stream, (i % 85) * 3 + 1, F.lit(3)), 16, 10).cast("int")
    number = lambda k: draw(F.lit(k))
    fixed = _shaped(type_, norm, draw)
    # A card whose check digit is right gets one that is right, too.
    body = F.substring(fixed, F.lit(1), F.length(norm) - 1)
    with_check = F.when(luhn_sum(norm) % 10 == 0, F.concat(body, ((10 - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))).otherwise(fixed)
    octets = F.concat_ws(".", *[(number(k) % 254 + 1).cast("string") for k in range(4)])
    pick = lambda items, n: F.element_at(F.array(*map(F.lit, items)), n % len(items) + 1)
    out = F.when(type_ == "ip", octets).when(type_ == "card", with_check).otherwise(fixed)
    if attempt >= 3:
        spelt = F.concat(_syllables("L", place, 4), F.lit("@"), pick(_SYLLABLES["L"], number(5)), pick(_SYLLABLES["L"], number(6)), F.lit("."), F.substring_index(norm, ".", -1))
        out = F.when(type_ == "email", spelt).otherwise(out)
    for g, names in GIVEN.items():
        drawn = F.concat(*[pick(_SYLLABLES[g[1]], number(k)) for k in (6, 7, 8)])
        made = pick(names, number(4)) if attempt == 0 else F.initcap(F.concat(drawn if attempt == 1 else _syllables(g[1], place, 4), F.lit(ENDINGS[g])))
        out = F.when(type_ == f"given{g}", made).otherwise(out)
    for family, end in (("L", ""), ("mC", "ин"), ("fC", "ина")):
        drawn = F.concat(*[pick(_SYLLABLES[family[-1]], number(k)) for k in range(6, 9 + attempt)])
        made = drawn if attempt < 2 else _syllables(family[-1], place, 5)
        out = F.when(type_ == f"family{family}", F.initcap(F.concat(made, F.lit(end)))).otherwise(out)
    return out


def luhn_sum(number: Column) -> Column:
    digits = F.filter(F.split(F.reverse(number), ""), lambda c: c != "")
    value = lambda c, i: F.when(i % 2 == 0, c.try_cast("int")).otherwise(c.try_cast("int") * 2 - F.when(c.try_cast("int") > 4, 9).otherwise(0))
    return F.coalesce(F.aggregate(F.transform(digits, value), F.lit(0), lambda a, b: a + b), F.lit(-1))


def surrogates(entities: DataFrame, key: str, scratch: Scratch, attempts: int = 40) -> DataFrame:
    """(type, norm, fake) for distinct (type, norm), with one fake for each within a type.

    Fakes are checked against each other and against all real norms; of those that meet,
    the least norm keeps the fake, the others draw again. Draws of the first attempts
    depend on the norm alone, so an entity mostly keeps its surrogate whatever else the
    corpus holds; later ones number what is left (``surrogate``) in an order fixed by
    the key, so names never run out. Numbers of a fixed format can: where ``attempts``
    leave some without, that is an error, never a fake of another form. Only (type, norm)
    rows meet; a fake that many draw is found by partial minima."""
    real = scratch.put(entities)
    known = real.select(F.col("type").alias("real_type"), F.lower("norm").alias("real_norm")).distinct()
    todo = real.withColumn("place", F.lit(0).cast("long"))
    fixed: list[DataFrame] = []
    given = 0
    for attempt in range(attempts):
        drawn = scratch.put(todo.select("type", "norm", surrogate(F.col("type"), F.col("norm"), attempt, F.col("place"), key).alias("fake")))
        first = drawn.groupBy("type", "fake").agg(F.min("norm").alias("norm"))
        free = first.join(known, (F.col("type") == F.col("real_type")) & (F.lower("fake") == F.col("real_norm")), "left_anti")
        if fixed:
            used = scratch.all(*fixed).select(F.col("type").alias("used_type"), F.col("fake").alias("used_fake"))
            free = free.join(used, (F.col("type") == F.col("used_type")) & (F.col("fake") == F.col("used_fake")), "left_anti")
        fixed.append(scratch.put(free.select("type", "norm", "fake")))
        rest = drawn.select("type", "norm").join(fixed[-1].select("type", "norm"), ["type", "norm"], "left_anti")
        if attempt == 0:
            todo = scratch.put(rest.withColumn("place", F.lit(0).cast("long")))
        else:
            order = F.sha2(F.concat_ws("|", F.lit(key), "norm"), 256)
            ranked = ranked_within(rest.withColumn("keyed", order), ["type"], ["keyed", "norm"], "place", salts=16)
            todo = scratch.put(ranked.select("type", "norm", (F.col("place") + F.lit(given)).alias("place")))
        left = todo.count()
        if not left:
            return scratch.all(*fixed)
        # The next attempt's numbers begin beyond this one's.
        given += left
    raise ValueError(f"{left} entities found no surrogate of their format in {attempts} attempts")


def render(kind: Column, surface: Column, fakes: Column) -> Column:
    """The surrogate in the surface's own format: its punctuation, case and title."""
    one = F.element_at(fakes, 1)
    start = F.struct(F.lit(0).alias("k"), F.lit("").alias("s"))

    def fill(acc, c):
        slot = c.rlike("[0-9A-Z]")
        k = acc["k"] + F.when(slot, 1).otherwise(0)
        return F.struct(k.alias("k"), F.concat(acc["s"], F.when(slot, F.substring(one, k, F.lit(1))).otherwise(c)).alias("s"))

    numbered = F.aggregate(F.split(surface, ""), start, fill)["s"]
    cased = F.array_join(F.zip_with(F.split(surface, ""), F.split(one, ""), lambda a, b: F.when(a.rlike("[A-Z]"), F.upper(b)).otherwise(b)), "")
    name = F.concat_ws(" ", F.regexp_extract(surface, r"^(\S+) ", 1), F.array_join(fakes, " "))
    return F.when(kind.isin("card", "ssn", "phone", "iban"), numbered).when(kind == "email", F.when(F.length(surface) == F.length(one), cased).otherwise(one)).when(kind == "name", name).otherwise(one)


def replace_pii(docs: DataFrame, text: str = "text", key: str = "statloom", n_entities: str | None = "n_entities") -> DataFrame:
    """``docs`` with every detected entity of ``text`` replaced by its surrogate, and the
    number of replacements as ``n_entities`` (no column if None).

    The same entity has the same surrogate in all documents, different ones have
    different ones. Null texts stay null, empty ones empty. Matches are found once, beside
    the text, which is then written; only texts with entities are joined, by a row number
    given then, so rows need no key and may repeat. An entity that a third of all
    documents hold is one row of the entity table; its joins are of a kind that Spark
    splits where they are skewed. No rows, no result."""
    scratch = Scratch(docs.sparkSession, "pii")
    cols = docs.columns
    names = {c: f"c{k}" for k, c in enumerate(cols)}
    body = names[text]
    plain = docs.select(*[F.col(c).alias(n) for c, n in names.items()])
    matched = F.when(may_have(F.col(body)), F.regexp_extract_all(body, F.lit(PATTERN), 0))
    all_ = scratch.put(plain.withColumn("matches", matched).withColumn("rid", F.monotonically_increasing_id()))
    hits = all_.where("matches is not null")
    found = hits.select("rid", F.explode(F.array_distinct("matches")).alias("surface"))
    typed = found.withColumn("kind", kind_of(F.col("surface")))
    parts = scratch.put(typed.select("rid", "surface", "kind", F.explode(parts_of(F.col("kind"), F.col("surface"))).alias("p")).select("rid", "surface", "kind", "p.at", "p.type", "p.norm"))
    fakes = surrogates(parts.select("type", "norm").distinct(), key, scratch)
    joined = parts.join(fakes, ["type", "norm"])
    per = joined.groupBy("rid", "surface", "kind").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "fake"))), lambda p: p["fake"]).alias("fakes"))
    maps = per.select("rid", "surface", render(F.col("kind"), F.col("surface"), F.col("fakes")).alias("new")).groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("surface", "new"))).alias("map"))
    new = F.transform("matches", lambda m: F.coalesce(F.try_element_at(F.col("map"), m), m))
    gaps = F.split(F.col(body), PATTERN, -1)
    merged = F.array_join(F.zip_with(gaps, F.array_append(new, ""), lambda g, s: F.concat(F.coalesce(g, F.lit("")), F.coalesce(s, F.lit("")))), "")
    changed = hits.join(maps, "rid").select(*[merged.alias(n) if n == body else F.col(n) for n in names.values()], F.size("matches").cast("long").alias("found"))
    both = all_.where("matches is null").select(*names.values(), F.lit(0).cast("long").alias("found")).unionByName(changed)
    out = [F.col(n).alias(c) for c, n in names.items() if c != n_entities]
    return both.select(*out, *([F.col("found").alias(n_entities)] if n_entities else []))


def op10_query(spark, sf_dir):
    """Whole texts with surrogates, and how many replacements; see ``replace_pii``."""
    return replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
