"""Fixed schemas of the tables the jobs read and write."""

from pyspark.sql import types as T


def _schema(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns])


_LONG, _INT, _STR, _TS = T.LongType(), T.IntegerType(), T.StringType(), T.TimestampNTZType()

ACCESS_EVENTS = _schema(
    ("id", _LONG),
    ("created_at", _TS),
    ("post_id", _LONG),
    ("uri", _STR),
    ("query_string", _STR),
    ("user_agent", _STR),
    ("remote_addr", _STR),
    ("payload_bytes", _LONG),
    ("cache_hit", _INT),
)

# Empty text and 0 mean "none" in this table; it holds no nulls.
REQUEST_LOG = _schema(
    ("id", _LONG),
    ("post_id", _LONG),
    ("url", _STR),
    ("user_agent", _STR),
    ("bot_name", _STR),
    ("ip_hash", _STR),
    ("bytes_served", _LONG),
    ("cache_hit", _INT),
    ("created_at", _TS),
)
LOG_COLUMNS = REQUEST_LOG.fieldNames()
# On storage: one directory per day, in it one per stream and micro-batch (load and -1 for batch appends).
STORED_LOG = _schema(
    *[(f.name, f.dataType) for f in REQUEST_LOG], ("dt", T.DateType()), ("stream", _STR), ("batch", _LONG)
)

EXPORT_COLUMNS = [
    "created_at", "post_id", "url", "user_agent", "bot_name", "bytes_served", "cache_hit",
]

POSTS = _schema(
    ("id", _LONG),
    ("post_title", _STR),
    ("permalink", _STR),
    ("post_content", _STR),
    ("post_excerpt", _STR),
    ("post_status", _STR),
    ("post_password", _STR),
    ("post_type", _STR),
    ("post_author", _LONG),
    ("post_date", _TS),
    ("post_modified", _TS),
)

MARKDOWN_STORE = _schema(
    ("post_id", _LONG), ("markdown", _STR), ("built_at", _TS), ("expires_at", _TS)
)
STORED_MARKDOWN = _schema(*[(f.name, f.dataType) for f in MARKDOWN_STORE], ("bucket", _STR))

DAILY_HITS = _schema(("bot_name", _STR), ("hits", _LONG), ("dt", T.DateType()))
