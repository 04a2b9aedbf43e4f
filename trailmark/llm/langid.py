"""Language identification by words first, backing off to shorter character n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    """Log frequencies per language: a row per known word or n-gram, a column per language.

    ``words`` and ``grams`` map to rows; ``floor`` is the row of what is wholly unknown.
    """

    languages: tuple[str, ...]
    words: dict[str, int]
    grams: dict[str, int]
    table: np.ndarray
    longest: int


def fit(
    labelled: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    rows_per_language: int = 4000,
    max_words: int = 200_000,
    max_grams: int = 200_000,
    longest: int = 5,
) -> LanguageModel:
    """Learn word and n-gram frequencies from labelled rows.

    The fit reads a sample of about ``rows_per_language`` rows of each language, chosen by a hash of the text
    (all rows where a language has fewer), in whole texts. It keeps the ``max_words`` most frequent words and
    ``max_grams`` n-grams, split evenly over the languages, so the model that the driver gathers and sends out
    is bounded by these parameters whatever the input. Rows without text or label are not used.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        "text is not null and lang is not null"
    )
    spread = F.pmod(F.xxhash64("text"), F.lit(1 << 20))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = tuple(sorted(sizes))
    if not languages:
        return LanguageModel((), {}, {}, np.zeros((1, 0), np.float32), longest)
    limit = F.create_map(
        *(F.lit(x) for k, n in sizes.items() for x in (k, math.ceil(rows_per_language / n * (1 << 20))))
    )
    counted = rows.where(spread < limit[F.col("lang")]).mapInArrow(_count_words, "lang string, word string, n long")
    counted = counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = _most_frequent(counted, "word", max_words // len(languages)).persist()
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    pieces = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.lit(longest)),
            lambda n: F.transform(
                F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))),
                lambda i: F.substring(padded, i, n),
            ),
        )
    )
    counted = words.select("lang", F.explode(pieces).alias("gram"), "n").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams = _most_frequent(counted, "gram", max_grams // len(languages))

    known_words, first = _log_frequencies(words, "word", languages, lambda item: 0)
    known_grams, second = _log_frequencies(grams, "gram", languages, len)
    words.unpersist()
    known_grams = {k: i + len(first) for k, i in known_grams.items()}
    table = np.concatenate([first, second, np.zeros((1, len(languages)), np.float32)])
    return LanguageModel(languages, known_words, known_grams, table, longest)


def _log_frequencies(frame: DataFrame, column: str, languages: tuple[str, ...], group) -> tuple[dict[str, int], np.ndarray]:
    """Rows by item in order, and smoothed log shares per language among the items of one group."""
    found = frame.select("lang", column, "n").toArrow()  # bounded by the parameters
    items = found.column(column).to_pylist()
    index = {item: i for i, item in enumerate(sorted(set(items)))}
    counts = np.full((len(index), len(languages)), 0.5)
    at = {lang: i for i, lang in enumerate(languages)}
    np.add.at(counts, ([index[x] for x in items], [at[x] for x in found.column("lang").to_pylist()]), found.column("n").to_numpy())
    groups = np.fromiter((group(item) for item in index), np.int64, len(index))
    for g in np.unique(groups):
        mine = groups == g
        # Half a count for each item of the vocabulary, in every group.
        extra = 0.5 * (len(index) - int(mine.sum()))
        counts[mine] /= counts[mine].sum(0) + extra
    return index, np.log(counts).astype(np.float32)


def _most_frequent(counted: DataFrame, item: str, n: int) -> DataFrame:
    """The n most frequent items of each language; ties by the item. The rank limit applies before the shuffle."""
    order = Window.partitionBy("lang").orderBy(F.desc("n"), item)
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).drop("rank")


def _count_words(batches):
    for batch in batches:
        found: Counter = Counter()
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            for word, n in Counter(WORD.findall(text.lower())).items():
                found[lang, word] += n
        keys = list(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(found.values()), pa.int64())],
            names=["lang", "word", "n"],
        )


def _backoff(word: str, model: LanguageModel) -> list[int]:
    """Rows for an unknown word: its known n-grams of the greatest length at which it has any.

    The blanks around a word say nothing by themselves, so a word of unknown letters is wholly unknown.
    """
    padded = f" {word} "
    get = model.grams.get
    for n in range(min(model.longest, len(padded)), 0, -1):
        within = padded if n > 1 else word
        found = [i for i in map(get, (within[k : k + n] for k in range(len(within) - n + 1))) if i is not None]
        if found:
            return found
    return [len(model.table) - 1]


def judge(text: str | None, model: LanguageModel) -> tuple[str, float]:
    """Language and confidence of one whole text.

    The confidence is the posterior after as many words as the text has, but 30 at most, of the text's
    average word: long texts don't all read 1.0 by their length alone.
    """
    counts = Counter(WORD.findall(text.lower())) if text else {}
    # A word may be of signs such as a superscript digit; the search for a letter ends at the first.
    if not model.languages or not any(c.isalpha() for word in counts for c in word):
        return UNKNOWN, 0.0
    rows, weights = [], []
    get = model.words.get
    for word, n in counts.items():
        row = get(word)
        if row is not None:
            rows.append(row)
            weights.append(n)
        else:
            found = _backoff(word, model)
            rows += found
            weights += [n / len(found)] * len(found)
    total = counts.total()
    mean = np.asarray(weights, np.float32) @ model.table[rows] / total
    scaled = np.exp((mean - mean.max()).astype(float) * min(total, 30))
    best = int(scaled.argmax())
    return model.languages[best], float(scaled[best] / scaled.sum())


def predict(docs: DataFrame, model: LanguageModel, *, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score`` (0 to 1), from the text alone.

    Null texts and texts without a letter are ``und`` with score 0; so is everything if the model has no
    language. Ties go to the first language in order. Whole texts are read, of any length, in one narrow pass.
    Columns already named ``lang_pred`` or ``score`` are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "score")
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        known = shared.value
        for batch in batches:
            found = [judge(x, known) for x in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                names=[*batch.schema.names, "lang_pred", "score"],
            )

    return kept.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """True for the third of the rows that the fit must not see: crc32 of the id as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1
