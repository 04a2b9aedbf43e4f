"""Contiguous shards of near equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import Staging

CUT_COLUMNS = ("_key", "_hash")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows with their place in the order: the id, then the text's hash, so that one id never pins a range."""
    text = F.col(text_col)
    return docs.select(
        F.col(id_col).alias("_key"),
        F.xxhash64(text).alias("_hash"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )


def balanced_shards(
    docs: DataFrame, shards: int, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Shard and slot of every row: cuts of the global byte prefix sum at equal targets.

    Rows are ordered by (id, text hash) in ranges written to the shared folder. Each range adds up to one
    total; only those totals, one row per range, are summed over, and every row adds its running sum within
    its range. A row belongs to the shard in which the middle of its bytes falls, so a shard's bytes differ
    from the target by less than its two border rows.

    Columns: ``id_col``, ``size`` (UTF-8 bytes plus 1), ``text_crc32``, ``shard``, ``slot`` (gapless from 0 in
    the shard). Null ids come first, a null text has size 1. Equal rows are interchangeable: each has its own
    slot. Ranges are cut by (id, text hash, salt), so neither an id nor a repeated row of any number fills one.
    An empty table gives no rows. Other columns are not read.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    staging = Staging(docs.sparkSession)
    rows = (
        _keyed(docs, id_col, text_col)
        .withColumn("_salt", F.rand(seed=9))
        .repartitionByRange("_key", "_hash", "_salt")
        .withColumn("_range", F.spark_partition_id())
        .drop("_salt")
    )
    rows = staging.keep(rows, "ranges")
    # One row per range: few enough for one window, whatever the rows.
    totals = rows.groupBy("_range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "_range",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("_total"),
    )
    starts = {r["_range"]: r for r in starts.collect()}  # bounded by the number of ranges
    if not starts:
        return rows.select(
            F.col("_key").alias(id_col), "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")
        )
    spark = docs.sparkSession
    table = spark.createDataFrame(
        [(k, int(r["_bytes_before"]), int(r["_rows_before"])) for k, r in starts.items()],
        "_range int, _bytes_before long, _rows_before long",
    )
    total = int(next(iter(starts.values()))["_total"])
    inside = Window.partitionBy("_range").orderBy("_key", "_hash", "size", "text_crc32")
    placed = rows.join(F.broadcast(table), "_range").select(
        F.col("_key").alias(id_col),
        "size",
        "text_crc32",
        (F.col("_bytes_before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))).alias("_end"),
        (F.col("_rows_before") + F.row_number().over(inside) - 1).alias("_row"),
    )
    # Twice the middle stays whole: floor((2 * end - size) * shards / (2 * total)).
    middle = F.expr(f"cast(cast(2 * _end - size as decimal(20, 0)) * {shards} div {2 * total} as int)")
    placed = staging.keep(placed.withColumn("shard", F.least(middle, F.lit(shards - 1))).drop("_end"), "placed")
    staging.drop("ranges")
    firsts = placed.groupBy("shard").agg(F.min("_row").alias("_first"))  # one row per shard
    return placed.join(F.broadcast(firsts), "shard").select(
        id_col, "size", "text_crc32", "shard", (F.col("_row") - F.col("_first")).alias("slot")
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str, *, id_col: str = "doc_id") -> None:
    """Whole documents as files, a folder per shard, in shard order.

    A shard is a contiguous range of ids, so the borders (one id per shard) place every document without a
    join; rows that share a border id go to the first of its shards.
    """
    last = placed.groupBy("shard").agg(F.max(id_col).alias("last")).orderBy("shard").collect()
    shard = F.lit(last[-1]["shard"] if last else 0)
    for row in reversed(last[:-1]):
        if row["last"] is not None:
            shard = F.when(F.col(id_col).isNull() | (F.col(id_col) <= F.lit(row["last"])), row["shard"]).otherwise(shard)
    docs.withColumn("shard", shard).repartition(max(1, len(last)), "shard").sortWithinPartitions("shard", id_col).write.mode(
        "overwrite"
    ).option("partitionOverwriteMode", "static").partitionBy("shard").parquet(path)
