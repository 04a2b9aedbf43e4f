"""Licence scans by canonical digests of entire texts, paragraphs, runs of paragraphs and lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm.licence_texts import LICENCES, OPENINGS, SPELLINGS, TITLES

# Whole lines that name a holder or reserve rights say nothing about which licence it is.
HOLDER = r"(^|\n)[^\p{L}\p{N}\n©(]*(?:copyright[^\p{L}\n]*(?:\(c\)|©|[0-9]{4})|\(c\) ?[^\n]{0,40}[0-9]{4}|©|all rights reserved)"
COPYRIGHT = rf"{HOLDER}[^\n]*"
# Where the licence goes on in the holder's line, only what is before it goes. Full stops alone don't tell: "Acme Inc. and others".
BEFORE = rf"{HOLDER}[^\n]*?[.,;:)] +({'|'.join(OPENINGS)})"
# The name over a licence, if it is the first line with a word.
TITLE = rf"^([ \n]*)(?:the )?(?:{'|'.join(TITLES)})(?: licen[sc]e)?(?: (?:{'|'.join(TITLES)}))? *(\n)"
MARKS = r"[^\p{L}\p{N}\n]+"
PARAGRAPH = r"\n[ \n]*\n"
SPACES = r"[ \n]+"


def spelling_pattern(left: str) -> str:
    """A spelling as a word by itself; its marks are blanks by then."""
    return rf"(^|[ \n]){left.replace('-', ' ')}($|[ \n])"


def canonical(frame: DataFrame, text_col: str, column: str) -> DataFrame:
    """Adds the canonical text: lower case, no copyright lines, blanks for marks, one spelling. Line breaks stay.

    The plain form is a column of its own, so that it is made once though spellings are only looked at where
    a variant occurs.
    """
    licence = F.regexp_replace(F.lower(F.col(text_col)), BEFORE, "$1$2")
    plain = F.regexp_replace(F.regexp_replace(licence, COPYRIGHT, "$1"), MARKS, " ")
    frame = frame.withColumn(column, plain)
    # Doubled blanks keep neighbouring words from sharing one, so that each is replaced.
    spaced = F.regexp_replace(column, " ", "  ")
    for left, right in SPELLINGS:
        spaced = F.regexp_replace(spaced, spelling_pattern(left), rf"$1{right.replace('-', ' ')}$2")
    any_left = "|".join(dict.fromkeys(left.replace("-", " ") for left, _ in SPELLINGS))
    variant = F.col(column).rlike(rf"(?<![^ \n])(?:{any_left})(?![^ \n])")
    return frame.withColumn(column, F.when(variant, F.regexp_replace(spaced, " +", " ")).otherwise(F.col(column)))


def _line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def _untitled(text: Column) -> Column:
    return _line(F.regexp_replace(text, TITLE, "$1$2"))


def known_digests(licences: DataFrame, *, id_col: str = "licence_id", text_col: str = "text") -> DataFrame:
    """(licence_id, digest) of the canonical form of each known text; texts without a word are left out."""
    known = canonical(licences.select(F.col(id_col).alias("licence_id"), F.col(text_col).alias("_text")), "_text", "_plain")
    whole = _untitled(F.col("_plain"))
    return known.where(whole != "").select("licence_id", F.sha2(whole, 256).alias("digest")).distinct()


def scan(
    docs: DataFrame, licences: DataFrame, *, runs: Sequence[int] = (2, 3, 4, 5), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Where an entire text, paragraph, run of paragraphs or line of a document is a known licence text.

    Every unit's canonical form is hashed and joined with the digests of the known texts, so a unit matches as
    a whole or not at all. Units are the document (position 0) without the licence's title over it, its paragraphs
    if there are several, as many neighbouring paragraphs as ``runs`` lists (``paragraphs``, at the first one's
    position; paragraphs without a word, such as copyright notices, don't count), and its lines if there are
    several, numbered from 0. A text of n paragraphs has at most n runs of each length.

    Columns: ``id_col``, ``unit``, ``position``, ``licence_id``, ``digest``. Null and empty texts, and units of
    marks only, match nothing. Licences with equal canonical texts give a row each; repeated documents give
    their rows each. The known table's size decides how the engine joins; without a broadcast only digests
    are shuffled. Other columns are not read.
    """
    plain = canonical(docs.select(id_col, F.col(text_col).alias("_text")), "_text", "_plain").where("_text is not null").drop("_text")
    plain = plain.select(F.col(id_col).alias("id"), "_plain", F.split("_plain", PARAGRAPH).alias("paragraphs"))
    worded = F.transform("paragraphs", lambda x, i: F.struct(i.alias("position"), _line(x).alias("text")))
    plain = plain.withColumn("worded", F.filter(worded, lambda x: x["text"] != ""))
    lines = F.split("_plain", "\n")
    none = F.array().cast("array<struct<unit:string,position:int,digest:string>>")

    def unit(name: str, position: Column, text: Column) -> Column:
        return F.struct(F.lit(name).alias("unit"), position.alias("position"), F.sha2(text, 256).alias("digest"))

    def run(length: int) -> Column:
        starts = F.sequence(F.lit(1), F.size("worded") - (length - 1))
        texts = F.transform(starts, lambda s: F.slice("worded", s, length))
        found = F.transform(texts, lambda x: unit("paragraphs", x[0]["position"], F.concat_ws(" ", x["text"])))
        return F.when(F.size("worded") >= length, found).otherwise(none)

    every = F.concat(
        F.array(unit("document", F.lit(0), _untitled(F.col("_plain")))),
        F.when(F.size("paragraphs") > 1, F.transform("worded", lambda x: unit("paragraph", x["position"], x["text"]))).otherwise(none),
        *(run(length) for length in runs),
        F.when(F.size(lines) > 1, F.transform(lines, lambda x, i: unit("line", i, _line(x)))).otherwise(none),
    )
    found = plain.select("id", F.explode(every).alias("u")).where(F.col("u.digest") != F.sha2(F.lit(""), 256))
    found = found.select("id", "u.unit", "u.position", "u.digest").join(known_digests(licences), "digest")
    return found.select(F.col("id").alias(id_col), "unit", "position", "licence_id", "digest")


def public_licences(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LICENCES, "licence_id string, text string")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle(runs: Sequence[int] = (2, 3, 4, 5)) -> str:
    """The scan as DuckDB SQL."""

    def plain(column: str) -> str:
        out = f"regexp_replace(lower({column}), {_quoted(BEFORE)}, '\\1\\2', 'g')"
        out = f"regexp_replace(regexp_replace({out}, {_quoted(COPYRIGHT)}, '\\1', 'g'), {_quoted(MARKS)}, ' ', 'g')"
        out = f"regexp_replace({out}, ' ', '  ', 'g')"
        for left, right in SPELLINGS:
            out = f"regexp_replace({out}, {_quoted(spelling_pattern(left))}, '\\1{right.replace('-', ' ')}\\2', 'g')"
        return f"regexp_replace({out}, ' +', ' ', 'g')"

    def line(column: str) -> str:
        return f"trim(regexp_replace({column}, '[ \\n]+', ' ', 'g'))"

    untitled = f"regexp_replace(plain, {_quoted(TITLE)}, '\\1\\2')"
    values = ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in LICENCES)
    run_units = "".join(
        f"""
  UNION ALL SELECT doc_id, 'paragraphs', position, joined FROM (
    SELECT doc_id, position, string_agg(body, ' ') OVER w AS joined, count(*) OVER w AS n FROM worded
    WINDOW w AS (PARTITION BY row ORDER BY position ROWS BETWEEN CURRENT ROW AND {length - 1} FOLLOWING)
  ) WHERE n = {length}"""
        for length in runs
    )
    return f"""
WITH forms AS (
  SELECT row_number() OVER () AS row, doc_id, {plain('text')} AS plain FROM documents WHERE text IS NOT NULL
), known AS (
  SELECT DISTINCT licence_id, sha256({line(untitled)}) AS digest
  FROM (SELECT licence_id, {plain('body')} AS plain FROM (VALUES {values}) AS v(licence_id, body))
), parts AS (
  SELECT row, doc_id, plain, regexp_split_to_array(plain, '\\n[ \\n]*\\n') AS p, string_split(plain, chr(10)) AS l FROM forms
), worded AS (
  SELECT row, doc_id, several, i - 1 AS position, {line('p[i]')} AS body
  FROM (SELECT row, doc_id, p, len(p) > 1 AS several, unnest(range(1, len(p) + 1)) AS i FROM parts)
  WHERE {line('p[i]')} <> ''
), units AS (
  SELECT doc_id, 'document' AS unit, 0 AS position, {line(untitled)} AS body FROM parts
  UNION ALL SELECT doc_id, 'paragraph', position, body FROM worded WHERE several{run_units}
  UNION ALL SELECT doc_id, 'line', i - 1, {line('l[i]')}
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM parts WHERE len(l) > 1)
)
SELECT doc_id, unit, CAST(position AS INTEGER) AS position, licence_id, digest
FROM units JOIN known ON digest = sha256(body) WHERE body <> ''
"""
