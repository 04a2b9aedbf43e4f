"""Reading and writing the jobs' tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from trailmark.functions.clock import AsOf, day_bucket
from trailmark.operators.traffic import export_rows, retention_cutoff
from trailmark.session import staged
from trailmark.sources.schemas import (
    ACCESS_EVENTS,
    DAILY_HITS,
    LOG_COLUMNS,
    MARKDOWN_STORE,
    REQUEST_LOG,
    STORED_LOG,
    STORED_MARKDOWN,
)


# A stream takes in this much per micro-batch unless told otherwise, which bounds what one hot
# post can bring into a stateful task.
STREAM_LIMIT = 4 << 30


def read_access_events(
    spark: SparkSession, path: str, fmt: str = "parquet", *, stream: bool = False, **options: str
) -> DataFrame:
    """Raw requests with the fixed schema, as a batch or as a stream."""
    if stream and not {"maxFilesPerTrigger", "maxBytesPerTrigger"} & set(options):
        options["maxBytesPerTrigger"] = str(STREAM_LIMIT)
    reader = spark.readStream if stream else spark.read
    return reader.format(fmt).options(**options).schema(ACCESS_EVENTS).load(path)


def replace_partitions(rows: DataFrame, schema: StructType, path: str, *columns: str) -> None:
    """Replace the partitions ``rows`` fall into, leaving all others.

    Rows usually derive from the table itself, so they are staged first. The rebalance hint lets
    AQE split large partitions and pack small ones instead of one file per task and partition.
    """
    spark = rows.sparkSession
    with staged(spark) as aside:
        rows.select(schema.fieldNames()).write.parquet(aside)
        final = spark.read.schema(schema).parquet(aside).hint("rebalance", *columns)
        writer = final.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*columns).parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The request log with its ``dt`` partition column."""
    return spark.read.schema(STORED_LOG).parquet(path).select(*LOG_COLUMNS, "dt")


def _dated(rows: DataFrame, stream: str, batch_id: int) -> DataFrame:
    dated = rows.withColumn("dt", day_bucket(F.col("created_at")))
    return dated.withColumns({"stream": F.lit(stream), "batch": F.lit(batch_id).cast("long")})


def append_log(rows: DataFrame, path: str, rebalance: bool = True) -> None:
    """Append log rows into day partitions.

    Days are gathered first, and a busy one is split again by the size target, so input in no time
    order gives few files. For input in time order, ``rebalance=False`` saves the shuffle.
    """
    dated = _dated(rows, "load", -1)
    dated = dated.hint("rebalance", "dt") if rebalance else dated
    dated.write.mode("append").partitionBy("dt", "stream", "batch").parquet(path)


def write_log_batch(rows: DataFrame, batch_id: int, path: str, stream: str) -> None:
    """Write one micro-batch; doing it again replaces the same files, so replays add nothing.

    ``stream`` names the query whose batches are counted, so that two streams, or one that begins
    anew with another checkpoint, write beside each other.
    """
    dated = _dated(rows, stream, batch_id)
    writer = dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("dt", "stream", "batch").parquet(path)


def _file_system(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    return hadoop, where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def prune_log(spark: SparkSession, path: str, as_of: AsOf = None, days: int = 30) -> None:
    """Delete rows older than the retention window.

    Days before the cutoff go as whole directories, and so do the batches of the cutoff's day of
    which no row is kept. The other batches of that day are rewritten by way of a staged copy, since
    a table cannot be overwritten while it is being read.
    """
    cutoff = retention_cutoff(as_of, days)
    last_day = str(spark.range(1).select(F.to_date(cutoff)).first()[0])
    stored = spark.read.schema(STORED_LOG).parquet(path)
    kept = stored.filter((F.col("dt") == last_day) & (F.col("created_at") >= cutoff))
    # At most the batches of one day.
    alive = {f"stream={row[0]}/batch={row[1]}" for row in kept.select("stream", "batch").distinct().collect()}
    if alive:
        replace_partitions(kept, STORED_LOG, path, "dt", "stream", "batch")
    hadoop, where, fs = _file_system(spark, path)

    def folders(path):
        return [entry.getPath() for entry in fs.listStatus(path) if entry.isDirectory()]

    for entry in folders(where):
        day = entry.getName().removeprefix("dt=")
        if not day[:1].isdigit() or day > last_day:
            continue
        if day < last_day or not alive:
            fs.delete(entry, True)
            continue
        for batch in [b for stream in folders(entry) for b in folders(stream)]:
            if f"{batch.getParent().getName()}/{batch.getName()}" not in alive:
                fs.delete(batch, True)


def purge_log(spark: SparkSession, path: str) -> None:
    """Empty the log but keep it readable with its schema."""
    hadoop, where, fs = _file_system(spark, path)
    fs.delete(where, True)
    spark.createDataFrame([], REQUEST_LOG).write.parquet(path)


def export_csv(log: DataFrame, path: str, as_of: AsOf = None, days: int = 30) -> None:
    """Write the export as CSV parts with header, each part sorted and the parts in order."""
    rows = export_rows(log, as_of, days)
    stamped = rows.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))
    exact = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"', "emptyValue": ""}
    stamped.write.options(header=True, **exact).csv(path)


def write_text_documents(documents: DataFrame, path: str) -> None:
    """Write ``site, document`` rows as one text file per site."""
    # The text writer ends each row with a newline, which stands for the document's own last one.
    body = F.regexp_replace("document", r"\n\z", "")
    writer = documents.select("site", body.alias("value")).write.mode("overwrite")
    # Whatever the session says: the document of a site that is gone goes too.
    writer.option("partitionOverwriteMode", "static").partitionBy("site").text(path)


def read_text_documents(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.col("site").cast("string"), F.col("value").alias("document"))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MARKDOWN_STORE).parquet(path).select(MARKDOWN_STORE.fieldNames())


def write_store(spark: SparkSession, rows: DataFrame, path: str, buckets: int = 512) -> None:
    """Merge new rows into the Markdown table, rewriting only the buckets they fall into.

    Posts are spread over bucket directories by hash. New rows are written aside first, as they
    may be costly to compute; the merged buckets are staged too and then replace the old ones.
    A table keeps the number of buckets it was created with.
    """
    prefix = f"of{buckets}_"
    bucket = F.concat(F.lit(prefix), F.pmod(F.xxhash64("post_id"), F.lit(buckets)).cast("string"))
    with staged(spark) as aside:
        rows.select(*MARKDOWN_STORE.fieldNames(), bucket.alias("bucket")).write.parquet(aside)
        merged = incoming = spark.read.schema(STORED_MARKDOWN).parquet(aside)
        hadoop, where, fs = _file_system(spark, path)
        if fs.exists(where):
            names = [entry.getPath().getName() for entry in fs.listStatus(where)]
            if any(n.startswith("bucket=") and not n.startswith(f"bucket={prefix}") for n in names):
                raise ValueError(f"{path} was created with another number of buckets than {buckets}")
            # At most ``buckets`` names, and with them the scan skips all other buckets.
            touched = [row[0] for row in incoming.select("bucket").distinct().collect()]
            old = spark.read.schema(STORED_MARKDOWN).parquet(path).filter(F.col("bucket").isin(touched))
            kept = old.join(incoming.select("post_id"), "post_id", "left_anti")
            merged = kept.select(incoming.columns).unionByName(incoming)
        replace_partitions(merged, STORED_MARKDOWN, path, "bucket")


def read_daily_hits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DAILY_HITS).parquet(path).select("dt", "bot_name", "hits")


def merge_daily_hits(changed: DataFrame, path: str) -> None:
    """Put changed day counts in place of the old ones; doing it again changes nothing.

    Rows are one per bot and open day, so both sides are small however large the log is.
    """
    spark = changed.sparkSession
    hadoop, where, fs = _file_system(spark, path)
    merged = changed.select(DAILY_HITS.fieldNames())
    if fs.exists(where):
        days = [row[0] for row in changed.select("dt").distinct().collect()]
        old = read_daily_hits(spark, path).filter(F.col("dt").isin(days))
        merged = old.join(changed, ["dt", "bot_name"], "left_anti").select(merged.columns).unionByName(merged)
    replace_partitions(merged, DAILY_HITS, path, "dt")
