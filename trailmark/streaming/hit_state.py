"""Hit or miss labels on a stream, with one expiry time kept per post."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trailmark.functions.clock import epoch_second

# Ship the processor with the query so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_OUT = "post_id long, id long, cache_hit int"


class HitProcessor(StatefulProcessor):
    """State is the second through which the post's Markdown is live; a save clears it."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.live_through = handle.getValueState("live_through", "until long")

    def handleInputRows(self, key, rows, timerValues):
        parts = [(p["at"].to_numpy(), p["id"].fillna(0).to_numpy(np.int64), p["asked"].to_numpy(bool)) for p in rows]
        at, ids, asked = (np.concatenate(x) for x in zip(*parts))
        # Saves come first within their second.
        order = np.lexsort((ids, asked, at))
        at, ids, asked = at[order], ids[order], asked[order]
        kept = self.live_through.get()
        until = kept[0] if kept is not None else -(2**62)
        hit = np.ones(len(at), dtype=np.int32)
        position = 0
        saves = np.flatnonzero(~asked)
        for stop in [*saves, len(at)]:
            # Jump from miss to miss: everything up to the expiry second is a hit.
            position = max(position, int(np.searchsorted(at[:stop], until, side="right")))
            while position < stop:
                hit[position] = 0
                until = int(at[position]) + self.ttl if self.ttl else 2**62
                position = int(np.searchsorted(at[:stop], until, side="right"))
            if stop < len(at):
                until, position = -(2**62), stop + 1
        self.live_through.update((until,))
        yield pd.DataFrame({"post_id": key[0], "id": ids[asked], "cache_hit": hit[asked]})

    def close(self) -> None:
        pass


def request_and_save_events(requests: DataFrame, saves: DataFrame) -> DataFrame:
    at, none = epoch_second(F.col("created_at")).alias("at"), F.lit(None).cast("long").alias("id")
    asked = requests.select("post_id", at, "id", F.lit(True).alias("asked"))
    kept = saves.select("post_id", epoch_second(F.col("saved_at")).alias("at"), none, F.lit(False).alias("asked"))
    return asked.unionByName(kept)


def stream_cache_hit(events: DataFrame, ttl: int) -> DataFrame:
    """``post_id, id, cache_hit`` of a stream of request and save events.

    Needs the RocksDB state store. A task holds three numbers per row of one post and
    micro-batch, so the source's per-trigger limit bounds what a hot post brings in.
    """
    return events.groupBy("post_id").transformWithStateInPandas(
        statefulProcessor=HitProcessor(ttl),
        outputStructType=_OUT,
        outputMode="Append",
        timeMode="None",
    )
