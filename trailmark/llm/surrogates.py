"""Keyed surrogates for personal data and secrets, with built-in column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import Staging, fresh

# Forms of address and common given names by gender, in Latin, Cyrillic and Greek script.
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mademoiselle", "Mlle", "Señora", "Sra", "Señorita", "Госпожа", "Κυρία"]
MALE_TITLES = ["Mr", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Господин", "Κύριος", "Κύριε"]
FEMALE_NAMES = [
    "Anna", "Camille", "Carmen", "Emma", "Ingrid", "Julia", "Laura", "Lucía", "Maria", "Marie", "Sarah", "Sofia",
    "Анна", "Елена", "Мария", "Ольга", "Ελένη", "Μαρία",
]
MALE_NAMES = [
    "Carlos", "Hans", "James", "Jean", "John", "José", "Klaus", "Michael", "Paul", "Peter", "Pierre", "Thomas",
    "Александр", "Дмитрий", "Иван", "Сергей", "Γιώργος", "Νίκος",
]

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_SECRET_NAME = r"(?i:token|secret|api[_-]?key|access[_-]?key|password|passwd|pwd)"
_SECRET_VALUE = r"[A-Za-z0-9_+/=.\-]*[A-Za-z0-9_+/=\-]"
# Account numbers by total length; their bodies hold letters in many countries.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV",
    22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG",
    25: "AO|CV|GW|LY|MZ|PT|ST", 26: "DZ|IR|IS|TR", 27: "BI|CF|CG|CM|DJ|FR|GA|GQ|GR|IT|KM|MC|MG|MR|SM|TD",
    28: "AL|AZ|BF|BJ|BY|CI|CY|DO|GT|HN|HU|LB|MA|ML|NE|NI|PL|SN|SV|TG", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE",
    31: "MT|SC", 32: "LC", 33: "RU",
}
_IBAN_LISTED = "|".join(
    rf"(?:{countries})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{size // 4 - 1}}}" + (rf" ?[A-Z0-9]{{{size % 4}}}" if size % 4 else "")
    for size, countries in IBAN_LENGTHS.items()
)
# Letters come in two groups at most before the first digit of a body; capitals after a number go on without one.
_IBAN_LISTED = rf"(?=[A-Z]{{2}}[0-9]{{2}}[A-Z ]{{0,11}}[0-9])(?:{_IBAN_LISTED})"
_CAPITALISED = r"\p{Lu}[\p{L}'\-]+"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)*\.[A-Za-z]{2,}",
    "assigned": rf"(?<![\p{{L}}\p{{N}}]){_SECRET_NAME}\s?[=:]\s?[\x22']?(?=[^\s\x22']*[0-9])(?=[^\s\x22']{{6}}){_SECRET_VALUE}",
    "secret": r"(?<![\p{L}\p{N}])(?:AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})(?![A-Za-z0-9])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": (
        r"(?:\+1[ .\-]?\(?[0-9]{3}\)?[ .\-]?[0-9]{3}[ .\-]?[0-9]{4}|\+(?!1)[0-9]{2,3}[ .\-]?\(?[0-9]{1,4}\)?(?:[ .\-]?[0-9]{2,4}){2,4}"
        r"|(?<![0-9])\(?[0-9]{3}\)?[ .\-][0-9]{3}[ .\-][0-9]{4})(?![0-9]|\.[0-9])"
    ),
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){3}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5})(?![0-9])",
    "iban": rf"(?<![\p{{L}}\p{{N}}])(?:{_IBAN_LISTED}|[A-Z]{{2}}[0-9]{{2}}(?: ?[0-9]{{4}}){{3,7}}(?: ?[0-9]{{1,3}})?)(?![\p{{L}}\p{{N}}])",
    "addressed": rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(FEMALE_TITLES + MALE_TITLES)})\.? {_CAPITALISED}(?: {_CAPITALISED})?",
    "named": rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(FEMALE_NAMES + MALE_NAMES)}) {_CAPITALISED}",
}
ANY = "|".join(PATTERNS.values())
# The patterns that match without a digit or an at sign; whatever has none of these is settled by this cheaper test.
_BARE = "|".join(PATTERNS[name] for name in ("secret", "addressed", "named"))
QUICK = rf"[0-9@]|{_BARE}"


def _is(kind: str, column: Column) -> Column:
    return column.rlike(f"^(?:{PATTERNS[kind]})$")


def _piece(kind: str | Column | None, raw: Column) -> Column:
    kind = kind if isinstance(kind, Column) else F.lit(kind).cast("string")
    return F.struct(kind.alias("kind"), raw.alias("raw"))


def _pieces(mention: Column) -> Column:
    """A mention as parts that get a surrogate (with a kind) and parts that stay (without)."""
    prefix = F.regexp_extract(mention, rf"^({_SECRET_NAME}\s?[=:]\s?[\x22']?)", 1)
    title = F.regexp_extract(mention, rf"^((?:{'|'.join(FEMALE_TITLES + MALE_TITLES)})\.? )", 1)
    women = "|".join(FEMALE_TITLES)
    gender = F.when(title.rlike(rf"^(?:{women})\.? "), "female").otherwise("male")
    after = F.split(F.substring(mention, F.length(title) + 1, F.length(mention)), " ")
    listed = F.split(mention, " ")
    listed_gender = F.when(listed[0].isin(FEMALE_NAMES), "female").otherwise("male")
    space = _piece(None, F.lit(" "))
    kind = F.lit(None).cast("string")
    for name in ("iban", "card", "phone", "ssn", "ip", "secret", "email"):
        kind = F.when(_is(name, mention), name).otherwise(kind)
    return (
        F.when(_is("assigned", mention), F.array(_piece(None, prefix), _piece("secret", F.substring(mention, F.length(prefix) + 1, F.length(mention)))))
        .when(kind.isNotNull(), F.array(_piece(kind, mention)))
        .when(title == "", F.array(_piece(listed_gender, listed[0]), space, _piece("family", listed[1])))
        .when(F.size(after) == 2, F.array(_piece(None, title), _piece(gender, after[0]), space, _piece("family", after[1])))
        .otherwise(F.array(_piece(None, title), _piece("family", after[0])))
    )


def _canonical(kind: Column, raw: Column) -> Column:
    """What mentions of one entity have in common: digits of numbers, lower case of names and of one-case secrets."""
    digits = F.regexp_replace(raw, "[^0-9]", "")
    phone = F.when((F.length(digits) == 11) & digits.startswith("1"), F.substring(digits, 2, 10)).otherwise(digits)
    return (
        F.when(kind == "phone", phone)
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.regexp_replace(raw, " ", ""))
        .when((kind == "secret") & (raw != F.upper(raw)) & (raw != F.lower(raw)), raw)
        .otherwise(F.lower(raw))
    )


_SCRIPT = "case when canonical rlike '\\\\p{IsCyrillic}' then 'cyrillic' when canonical rlike '\\\\p{IsGreek}' then 'greek' else 'latin' end"


def _number(i: str, base: int | str) -> str:
    """SQL: the i-th keyed number below base."""
    return f"pmod(conv(substring(stream, 4 * ({i}) + 1, 4), 16, 10), {base})"


def _symbol(alphabet: str, i: str) -> str:
    return f"substring('{alphabet}', cast({_number(i, len(alphabet))} as int) + 1, 1)"


_LOWER, _DIGITS, _HEX = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"


def _like(template: str, first: str = "0") -> str:
    """SQL: the template with every letter and digit replaced by a keyed one of its class, the rest kept."""
    c = f"substring({template}, i + 1, 1)"
    at = f"i + {first}"
    return (
        f"array_join(transform(sequence(0, length({template}) - 1), i -> case when {c} rlike '[0-9]' then {_symbol(_DIGITS, at)} "
        f"when {c} rlike '\\\\p{{Lu}}' then upper({_symbol(_LOWER, at)}) when {c} rlike '\\\\p{{L}}' then {_symbol(_LOWER, at)} else {c} end), '')"
    )


def _syllables(onsets: str, vowels: str, count: str, first: str) -> str:
    return (
        f"array_join(transform(sequence(0, {count} - 1), i -> concat({_symbol(onsets, f'2 * i + {first}')}, {_symbol(vowels, f'2 * i + 1 + {first}')})), '')"
    )


def _name(ending: dict[str, str]) -> str:
    """SQL: a stem in the script of the original (longer with more attempts) and an ending."""
    count = "(2 + cast(attempt / 4 as int))"
    return (
        f"case {_SCRIPT} when 'cyrillic' then concat({_syllables('бвгдзклмнпрст', 'аеиоу', count, '0')}, '{ending['cyrillic']}') "
        f"when 'greek' then concat({_syllables('βγδζκλμνπρστφ', 'αειου', count, '0')}, '{ending['greek']}') "
        f"else concat({_syllables('bcdfghjklmnprstvw', 'aeiou', count, '0')}, '{ending['latin']}') end"
    )


def _with_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """Entities (kind, canonical, attempt) with the surrogate of that attempt, in lower case."""
    block = "sha2(concat_ws(char(1), '%s', kind, canonical, cast(attempt as string), cast(b as string)), 256)" % key.replace("\\", "\\\\").replace("'", "\\'")
    streamed = entities.withColumn(
        "stream", F.expr(f"array_join(transform(sequence(0, (length(canonical) + attempt) div 8 + 2), b -> {block}), '')")
    )
    # After 16 attempts in too small a space, values grow; fixed formats are wide enough for that to be rare.
    more = f"array_join(transform(sequence(0, attempt div 16), i -> if(i = 0, '', {_symbol(_DIGITS, 'length(canonical) + i')})), '')"
    body = "substring(canonical, 2, length(canonical) - 2)"
    check = "substring(canonical, -1, 1)"
    domain = "sha2(concat_ws(char(1), '%s', 'domain', split_part(canonical, '@', 2)), 256)" % key.replace("\\", "\\\\").replace("'", "\\'")
    label = f"array_join(transform(sequence(0, 7), i -> substring('{_LOWER}', cast(pmod(conv(substring({domain}, 4 * i + 1, 4), 16, 10), 26) as int) + 1, 1)), '')"
    top = "if(canonical rlike '[.](com|net|org)$', regexp_extract(canonical, '[.](com|net|org)$', 1), 'org')"
    start = "coalesce(nullif(regexp_extract(canonical, '^(akia|ghp_|sk-)', 1), ''), '')"
    rest = f"substring(canonical, length({start}) + 1, length(canonical))"
    hexadecimal = f"array_join(transform(sequence(0, length(canonical) - 1), i -> {_symbol(_HEX, 'i')}), '')"
    octets = ", '.', ".join([f"cast(240 + cast({_number('0', 16)} as int) as string)", *(f"cast(cast({_number(str(i), 256)} as int) as string)" for i in (1, 2, 3))])
    cases = {
        "email": f"concat({_like('split_part(canonical, \'@\', 1)')}, {more}, '@', {label}, '.example.', {top})",
        "phone": f"concat(cast(2 + cast({_number('0', 8)} as int) as string), {_like('substring(canonical, 2, length(canonical))', '1')}, {more})",
        "ssn": f"concat('9', {_like('substring(canonical, 2, length(canonical))', '1')}, {more})",
        "card": f"concat(substring(canonical, 1, 1), {_like(body, '1')}, {more})",
        "iban": f"concat(substring(canonical, 1, 4), {_like('substring(canonical, 5, length(canonical))', '4')}, {more})",
        "ip": f"concat({octets}, if(attempt < 16, '', concat(':', {more})))",
        "secret": f"concat(if(canonical rlike '^[0-9a-f]+$', {hexadecimal}, concat({start}, {_like(rest)})), {more})",
        "female": _name({"latin": "na", "cyrillic": "на", "greek": "να"}),
        "male": _name({"latin": "no", "cyrillic": "н", "greek": "νος"}),
        "family": _name({"latin": "rel", "cyrillic": "ренко", "greek": "ρης"}),
    }
    made = "case kind " + " ".join(f"when '{k}' then {v}" for k, v in cases.items()) + " end"
    out = streamed.withColumn("surrogate", F.expr(made))
    # A card's check digit: right if the original's was right, else off by as much.
    due = lambda text: (
        f"pmod(10 - pmod(aggregate(transform(sequence(1, length({text})), i -> cast(substring({text}, length({text}) - i + 1, 1) as int) * if(i % 2 = 1, 2, 1)), "
        "0, (s, d) -> s + if(d > 9, d - 9, d)), 10), 10)"
    )
    original = "substring(canonical, 1, length(canonical) - 1)"
    digit = f"cast(pmod({due('surrogate')} + cast({check} as int) - {due(original)}, 10) as string)"
    return out.withColumn("surrogate", F.expr(f"case when kind = 'card' then concat(surrogate, {digit}) else surrogate end")).drop("stream")


def assign(entities: DataFrame, key: str, staging: Staging) -> DataFrame:
    """A surrogate for every distinct (kind, canonical): no two alike, and none that is itself an original.

    Surrogates are keyed hashes written in the original's format, so equal entities agree in any run with the
    same key. Where two of a kind fall together, all but the least original try again, as does one that equals
    an original of the corpus; rounds end when none is left to move.
    """
    spaces = F.when(F.col("kind").isin("female", "male", "family"), "name").otherwise(F.col("kind"))
    current = staging.keep(_with_surrogates(entities.withColumn("attempt", F.lit(0)), key), "surrogates-0")
    step = 0
    while True:
        spaced = current.withColumn("space", spaces)
        first = Window.partitionBy("space", "surrogate").orderBy("kind", "canonical")
        twice = spaced.withColumn("place", F.row_number().over(first)).where("place > 1").select("kind", "canonical")
        originals = spaced.select("space", F.col("canonical").alias("surrogate")).distinct()
        taken = spaced.join(originals, ["space", "surrogate"], "left_semi").select("kind", "canonical")
        moving = staging.keep(twice.union(taken).distinct(), f"moving-{step}")
        if not moving.limit(1).count():
            staging.drop(f"moving-{step}")
            return current
        rest = current.join(moving, ["kind", "canonical"], "left_anti")
        moved = current.join(moving, ["kind", "canonical"], "left_semi").select("kind", "canonical", (F.col("attempt") + 1).alias("attempt"))
        step += 1
        current = staging.keep(rest.unionByName(_with_surrogates(moved, key)), f"surrogates-{step}")
        staging.drop(f"surrogates-{step - 1}", f"moving-{step - 1}")


def _render(kind: Column, raw: Column, surrogate: Column) -> Column:
    """The surrogate in the mention's own writing: its punctuation, country code and case."""
    digits_before = F.transform(
        F.sequence(F.lit(1), F.length(raw)),
        lambda i: F.struct(
            F.substring(raw, i, 1).alias("c"), F.length(F.regexp_replace(F.substring(raw, F.lit(1), i), "[^0-9]", "")).alias("n")
        ),
    )
    total = F.length(F.regexp_replace(raw, "[^0-9]", ""))
    code = F.when((kind == "phone") & (total == 11) & F.regexp_replace(raw, "[^0-9]", "").startswith("1"), 1).otherwise(0)
    dressed = F.array_join(
        F.transform(digits_before, lambda x: F.when(x["c"].rlike("[0-9]") & (x["n"] > code), F.substring(surrogate, x["n"] - code, F.lit(1))).otherwise(x["c"])),
        "",
    )
    dressed = F.concat(dressed, F.substring(surrogate, total - code + 1, F.length(surrogate)))
    spaced = F.when(raw.contains(" "), F.trim(F.regexp_replace(surrogate, "(.{4})", "$1 "))).otherwise(surrogate)
    upper = (raw == F.upper(raw)) & (raw != F.lower(raw))
    return (
        F.when(kind.isNull(), raw)
        .when(kind.isin("phone", "card", "ssn"), dressed)
        .when(kind == "iban", spaced)
        .when(kind.isin("female", "male", "family"), F.when(upper & (F.length(raw) > 1), F.upper(surrogate)).otherwise(F.initcap(surrogate)))
        .when(upper, F.upper(surrogate))
        .otherwise(surrogate)
    )


def pseudonymise(docs: DataFrame, key: str, *, text_col: str = "text", count_col: str = "n_entities") -> DataFrame:
    """All columns of ``docs`` with personal data and secrets in ``text_col`` replaced, and how many were.

    Found are e-mail addresses, phone numbers, IPv4 addresses, social security, card and account numbers, access
    keys, values assigned to names such as password or token, and personal names after a form of address or a
    listed given name. A surrogate has the kind, length class, punctuation, case, script and gender of what it
    stands for: numbers keep their separators, a right card check digit stays right, e-mail domains lie under
    ``example``, addresses in 240.0.0.0/4. Name parts are replaced part by part, so "Mr Smith" and "John Smith"
    agree. One entity has one surrogate in all documents, two entities never share one (see ``assign``).

    Texts without a match are passed on from the scan. The others, each with a number, are written once; their
    mentions meet the table of distinct entities in a join (a frequent entity is a skewed join that the engine
    splits), and only then come back together, one document at a time. Null and empty texts stay as they are,
    repeated rows get equal results. A column named ``count_col`` is replaced, all others stay.
    """
    staging = Staging(docs.sparkSession)
    kept = docs.drop(count_col)
    found_in, row, parts, new = fresh(kept, "_mentions", "_row", "_parts", "_new")
    text, mentions = F.col(text_col), F.col(found_in)
    scanned = kept.withColumn(found_in, F.when(text.rlike(QUICK), F.regexp_extract_all(text, F.lit(ANY), 0)))
    clean = scanned.where(mentions.isNull() | (F.size(mentions) == 0)).withColumn(count_col, F.lit(0).cast("long"))
    found = scanned.where(F.size(mentions) > 0).withColumn(row, F.monotonically_increasing_id())
    found = staging.keep(found, "found")
    pieces = (
        found.select(F.col(row).alias("row"), F.posexplode(found_in).alias("at", "mention"))
        .select("row", "at", F.posexplode(_pieces(F.col("mention"))).alias("part", "piece"))
        .select("row", "at", "part", "piece.kind", "piece.raw")
        .withColumn("canonical", F.when(F.col("kind").isNotNull(), _canonical(F.col("kind"), F.col("raw"))))
    )
    pieces = staging.keep(pieces, "pieces")
    entities = pieces.where("kind is not null").select("kind", "canonical").distinct()
    table = assign(entities, key, staging).select("kind", "canonical", "surrogate")
    written = (
        pieces.join(table, ["kind", "canonical"], "left")
        .select("row", "at", "part", _render(F.col("kind"), F.col("raw"), F.col("surrogate")).alias("new"))
        .groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "part", "new"))).alias(new))
        .withColumnRenamed("row", row)
    )
    rebuilt = F.array_join(
        F.transform(
            F.col(parts),
            lambda part, i: F.concat(part, F.array_join(F.transform(F.filter(new, lambda x: x["at"] == i), lambda x: x["new"]), "")),
        ),
        "",
    )
    changed = (
        found.join(written, row)
        .withColumn(parts, F.split(text, ANY, -1))
        .withColumn(count_col, F.size(mentions).cast("long"))
        .withColumn(text_col, rebuilt)
    )
    return clean.select(*kept.columns, count_col).unionByName(changed.select(*kept.columns, count_col))
