"""Hit or miss labels of a stream that do not depend on how its rows fall into triggers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trailmark.operators.cachehits import missed_seconds
from trailmark.session import delete

ROWS = "post_id long, at long, id long, asked boolean"
LIVE = "post_id long, at long"
MARKS = "requests long, saves long, horizon long"
_END = 2**62


class _State:
    """The tables left by the micro-batches before ``number``: held rows, live entries, marks of both sources."""

    def __init__(self, spark: SparkSession, checkpoint: str, number: int):
        self.spark, self.root, self.number = spark, f"{checkpoint.rstrip('/')}-labels", number

    def path(self, name: str = "", ahead: int = 0) -> str:
        return f"{self.root}/{self.number + ahead}/{name}"

    def exists(self) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path("marks/_SUCCESS"))
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def read(self, name: str, schema: str) -> DataFrame:
        if not self.exists():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.path(name))

    def write(self, rows: DataFrame, name: str, schema: str) -> DataFrame:
        path = self.path(name, ahead=1)
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(schema).parquet(path)


def _release(state: _State, batch: DataFrame | None, labels: str, ttl: int, lateness: int) -> None:
    """One micro-batch. Doing it again from the same state writes the same labels and the same next state."""
    spark = state.spark
    marks = state.read("marks", MARKS).first()
    rows = state.read("rows", ROWS)
    if marks is not None and marks.horizon is not None:
        rows = rows.filter(F.col("at") >= marks.horizon)
    if batch is not None:
        rows = rows.unionByName(batch.select("post_id", "at", "id", "asked"))
    rows = state.write(rows, "rows", ROWS)
    seen = rows.agg(F.max(F.when(F.col("asked"), F.col("at"))), F.max(F.when(~F.col("asked"), F.col("at")))).first()
    known = [max((x for x in pair if x is not None), default=None) for pair in zip(seen, marks or (None, None))]
    # What both sources have passed is complete, but for rows that come later than allowed.
    horizon = _END if batch is None else None if None in known else min(known) - lateness
    live = state.read("live", LIVE)
    if horizon is not None:
        if marks is not None and marks.horizon is not None and batch is not None:
            horizon = max(horizon, marks.horizon)
        open_rows = rows.filter(F.col("at") < horizon)
        none = F.lit(None).cast("long")
        save = F.when(~F.col("asked"), F.col("at")).alias("save")
        events = open_rows.select("post_id", "at", F.when(F.col("asked"), F.col("id")).alias("id"), save)
        # A live entry is its post's last miss, which comes first again and so gives the same expiry.
        carried = live.select("post_id", "at", F.lit(-_END).alias("id"), none.alias("save"))
        missed = state.write(missed_seconds(events.unionByName(carried), ttl), "missed", "post_id long, t long, id long")
        fresh = missed.join(live.withColumnRenamed("at", "t"), ["post_id", "t"], "left_anti")
        fresh = fresh.select("id").distinct().withColumn("_missed", F.lit(True))
        answered = open_rows.filter("asked").select("post_id", "id").join(fresh, "id", "left")
        answered = answered.select("post_id", "id", F.when(F.col("_missed"), 0).otherwise(1).alias("cache_hit"))
        answered.write.mode("overwrite").parquet(f"{labels}/batch={state.number}")
        dropped = open_rows.filter(~F.col("asked")).groupBy("post_id").agg(F.max("at").alias("dropped"))
        live = missed.groupBy("post_id").agg(F.max("t").alias("at")).join(dropped, "post_id", "left")
        live = live.filter("dropped IS NULL OR at >= dropped")
        if ttl:
            live = live.filter(F.col("at") + ttl >= horizon)
    state.write(live.select("post_id", "at"), "live", LIVE)
    state.write(spark.createDataFrame([(*known, horizon)], MARKS).coalesce(1), "marks", MARKS)
    if state.number:
        delete(spark, state.path(ahead=-1))


def stream_hit_labels(events: DataFrame, labels: str, checkpoint: str, ttl: int, *, lateness: int = 0) -> StreamingQuery:
    """Write ``post_id, id, cache_hit`` for a stream of request and save events (``hit_state.request_and_save_events``).

    Each micro-batch releases the seconds that both sources have passed by more than ``lateness`` seconds and holds
    newer rows back, so labels are those of the batch job over all rows, however files and triggers cut the sources.
    Released rows go through the batch job's joins over distinct (post, second) pairs; no post's rows are gathered in one
    task. Between micro-batches stay the held rows and one row per live entry, as tables beside the checkpoint
    (``<checkpoint>-labels``). A replayed micro-batch replaces its own labels.

    A source without rows holds everything back; ``finish_hit_labels`` releases the rest when both have ended. Rows that
    come later than ``lateness`` are labelled by the entries known then.
    """

    def write(batch: DataFrame, number: int) -> None:
        _release(_State(batch.sparkSession, checkpoint, number), batch, labels, ttl, lateness)

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finish_hit_labels(spark: SparkSession, labels: str, checkpoint: str, ttl: int) -> None:
    """Release what the stream still holds back; for sources that have ended."""
    state = _State(spark, checkpoint, 0)
    where = spark._jvm.org.apache.hadoop.fs.Path(state.root)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return
    state.number = max(int(entry.getPath().getName()) for entry in files.listStatus(where))
    _release(state, None, labels, ttl, 0)


def read_hit_labels(spark: SparkSession, labels: str) -> DataFrame:
    return spark.read.schema("post_id long, id long, cache_hit int").parquet(labels)
