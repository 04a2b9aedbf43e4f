"""Hit or miss of each served request, without walking a post's requests in one task.

The first request of a post builds its Markdown and misses; later ones hit until the time to
live has passed since that build or a save drops the entry. Hits do not extend it. An entry is
live through its expiry second, and a save in the same second as a request comes first.

Whether a request misses depends on the miss before it. Yet only seconds matter, not requests:
rows are first reduced to distinct seconds per post, partially on the map side. Time is cut
into cells one entry life long, and "nearest save before" and "first request after expiry" are
found inside (post, cell) groups, with a carry over the few cells of a post. Such a group holds
at most one row per second of a cell, whatever the traffic. Following the links from the first
second after each save, doubling the step every round, reaches all misses in a number of joins
logarithmic in the number of cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions.clock import epoch_second
from trailmark.session import delete, shared_folder


class _Steps:
    """Tables in the shared folder that cut lineage; each goes once the next stands."""

    def __init__(self, df: DataFrame):
        self.spark, self.paths = df.sparkSession, []

    def written(self, df: DataFrame) -> DataFrame:
        path = shared_folder(self.spark)
        df.write.parquet(path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_before_last(self) -> None:
        while len(self.paths) > 1:
            delete(self.spark, self.paths.pop(0))


def _nearest(df: DataFrame, value: str, ahead: bool) -> DataFrame:
    """Add ``near``: the closest non-null ``value`` at or before each ``at`` of a post, or at or
    after it when looking ahead. Values grow with ``at``, so a running extreme is the closest."""
    best, order = (F.min, F.desc) if ahead else (F.max, F.asc)
    inside = Window.partitionBy("post_id", "cell").orderBy(order("at"))
    passed = Window.partitionBy("post_id").orderBy(order("cell")).rowsBetween(Window.unboundedPreceding, -1)
    edges = df.groupBy("post_id", "cell").agg(best(value).alias("edge"))
    carried = edges.select("post_id", "cell", best("edge").over(passed).alias("carried"))
    return (
        df.withColumn("_inside", best(value).over(inside))
        .join(carried, ["post_id", "cell"])
        .withColumn("near", F.coalesce("_inside", "carried"))
        .drop("_inside", "carried")
    )


def _instants(events: DataFrame, life: int, steps: _Steps) -> DataFrame:
    """Distinct request seconds ``t`` with their first request and the last save before them."""
    seconds = (
        events.groupBy("post_id", "at")
        .agg(F.min("id").alias("id"), F.max("save").alias("save"))
        .withColumn("cell", F.floor(F.col("at") / life))
    )
    # Both passes below start from this reduction, not from the raw requests.
    placed = _nearest(steps.written(seconds), "save", ahead=False).filter("id IS NOT NULL")
    return placed.select(
        "post_id", "cell", F.col("at").alias("t"), "id", F.coalesce("near", F.lit(-(2**62))).alias("segment")
    )


def _links(instants: DataFrame, life: int) -> DataFrame:
    """``post_id, t, next``: the miss that follows a miss at ``t`` unless a save comes between."""
    nothing = F.lit(None).cast("long")
    here = instants.select(
        "post_id", "cell", F.col("t").alias("at"), "segment",
        F.struct("t", "segment").alias("landing"), nothing.alias("source"),
    )
    goals = instants.select(
        "post_id", (F.col("cell") + 1).alias("cell"), (F.col("t") + life).alias("at"), "segment",
        F.lit(None).cast(here.schema["landing"].dataType).alias("landing"), F.col("t").alias("source"),
    )
    found = _nearest(here.unionByName(goals), "landing", ahead=True)
    same = found.filter("source IS NOT NULL AND near.segment = segment")
    return same.select("post_id", F.col("source").alias("t"), F.col("near.t").alias("next"))


def missed_seconds(events: DataFrame, ttl: int) -> DataFrame:
    """``post_id, t, id``: seconds whose first request (``id``) misses.

    ``events`` has a request's ``id`` or a save's second ``save`` at each ``post_id, at``. The result reads two
    tables in the shared folder, as after a checkpoint; all earlier ones are gone.
    """
    # Without a time to live only saves end an entry, and the cells are merely days.
    life = int(ttl) + 1 if ttl else 86_400
    first_tables, later_tables = _Steps(events), _Steps(events)
    instants = first_tables.written(_instants(events, life, first_tables))
    first_tables.drop_before_last()
    first = instants.groupBy("post_id", "segment").agg(F.min("t").alias("t")).select("post_id", "t")
    first = first.withColumn("reached", F.lit(True))
    keys = ["post_id", "t"]
    if not ttl:
        return instants.join(first.select(keys), keys, "left_semi").select("post_id", "t", "id")
    links = _links(instants, life)
    steps = instants.select(keys).join(links, keys, "left").join(first, keys, "left")
    steps = later_tables.written(steps.fillna(False, subset=["reached"]))
    # Each round every reached miss reaches the one a step ahead, and steps become twice as long.
    while not steps.filter("reached AND next IS NOT NULL").isEmpty():
        after = steps.select("post_id", F.col("t").alias("next"), F.col("next").alias("then"))
        longer = steps.join(after, ["post_id", "next"], "left").select(*keys, F.col("then").alias("next"), "reached")
        onward = steps.filter("reached AND next IS NOT NULL").select(
            "post_id", F.col("next").alias("t"), F.lit(None).cast("long").alias("next"), "reached"
        )
        merged = longer.unionByName(onward).groupBy(keys)
        steps = later_tables.written(merged.agg(F.max("next").alias("next"), F.bool_or("reached").alias("reached")))
        later_tables.drop_before_last()
    return instants.join(steps.filter("reached").select(keys), keys, "left_semi").select("post_id", "t", "id")


def misses(requests: DataFrame, saves: DataFrame, ttl: int) -> DataFrame:
    """Ids of the requests that miss."""
    none = F.lit(None).cast("long")
    asked = requests.select("post_id", epoch_second(F.col("created_at")).alias("at"), "id", none.alias("save"))
    saved = epoch_second(F.col("saved_at"))
    kept = saves.select("post_id", saved.alias("at"), none.alias("id"), saved.alias("save"))
    return missed_seconds(asked.unionByName(kept), ttl).select("id")


def cache_hit_labels(requests: DataFrame, saves: DataFrame, ttl: int) -> DataFrame:
    """``requests`` with ``cache_hit`` 0 or 1; joined by request id, so no post is a hot key."""
    # An id on several rows marks each of them once.
    missed = misses(requests, saves, ttl).distinct().withColumn("_missed", F.lit(True))
    hit = F.when(F.col("_missed"), 0).otherwise(1)
    return requests.join(missed, "id", "left").withColumn("cache_hit", hit).drop("_missed")
