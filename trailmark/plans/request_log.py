"""The request log as a site keeps it: only servable posts, with true hits and sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.config import Settings
from trailmark.operators.cachehits import cache_hit_labels
from trailmark.operators.requests import detect_kept, log_rows, with_markdown_bytes
from trailmark.session import shared_folder

# What is left to be known of a request once it is detected.
_SEEN = "id post_id created_at uri user_agent remote_addr payload_bytes cache_hit is_md bot_token served".split()


def request_log(
    events: DataFrame,
    servable: DataFrame,
    saves: DataFrame,
    documents: DataFrame,
    settings: Settings = Settings(enable_logging=True),
    *,
    salt: str,
    **hooks,
) -> DataFrame:
    """Log rows of raw requests.

    A request to be served counts if it hits one of ``servable(id)``; its hit flag follows from the
    requests and ``saves`` before it and its size is that of ``documents(post_id, markdown)``. Bot-like
    requests on no list are logged as unknown, whatever they hit. Only ids and sizes of posts travel.

    Detection is the costly part: it runs once, for the rows to be logged, into a table in the shared folder, which stays
    behind the result. A request on several rows is labelled on each of them; a served one without an id is left out.
    """
    seen = detect_kept(events, settings, **hooks).select(_SEEN)
    if not settings.enable_logging:
        return log_rows(seen, salt)
    path = shared_folder(events.sparkSession)
    seen.write.parquet(path)
    seen = events.sparkSession.read.schema(seen.schema).parquet(path)
    ids = servable.select(F.col("id").alias("post_id"))
    served = seen.filter("served AND post_id > 0 AND id IS NOT NULL").join(ids, "post_id", "left_semi")
    labelled = cache_hit_labels(served, saves, settings.cache_ttl)
    sized = with_markdown_bytes(labelled, documents)
    return log_rows(sized.select(_SEEN).unionByName(seen.filter(~F.col("served"))), salt)
