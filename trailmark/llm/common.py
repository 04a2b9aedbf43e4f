"""What several operators share: tables that cut lineage, and the public tokenizer."""

from __future__ import annotations

import base64
import functools
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.session import shared_folder


# What a written table's job runs with. The Arrow bounds keep batches of whole documents or sets, which lie in the JVM and in
# Python at once, small in every session; by default a batch is 10,000 rows of any size.
WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def bound_batches(spark: SparkSession) -> None:
    """Sets the Arrow bounds of ``WRITING`` for the session: for rows that are computed when a caller writes them."""
    for key, value in WRITING.items():
        if ".arrow." in key:
            spark.conf.set(key, value)


class Staging:
    """Parquet tables under ``spark.checkpoint.dir``, which every executor reaches.

    ``keep`` writes a table and reads it back, so that a lost executor costs one read and not the whole
    history. ``drop`` removes tables that nothing reads any more; the table behind a returned result stays,
    as checkpoint files do, until the folder's owner clears it.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = shared_folder(spark)
        self._written: dict[int, str] = {}

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        """Write and read back. The shuffle files behind it serve nothing more and go with the execution."""
        before = {key: self.spark.conf.get(key, None) for key in WRITING}
        for key, value in WRITING.items():
            self.spark.conf.set(key, value)
        try:
            frame.write.mode("overwrite").parquet(self.path(name))
        finally:
            for key, value in before.items():
                if value is None:
                    self.spark.conf.unset(key)
                else:
                    self.spark.conf.set(key, value)
        return self.read(name, frame.schema)

    def read(self, name: str, schema=None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return reader.parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until no column of ``frame`` is called so."""
    taken = {c.lower() for c in frame.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def may_match(rows: DataFrame, columns: list, keys: DataFrame, mark: str, words: int = 1 << 18) -> DataFrame:
    """``rows`` with a boolean ``mark``: False only where no row of ``keys`` has the values of ``columns``.

    The hashes of ``keys`` (its columns, in the same order) set bits in ``words`` numbers of 64 bits; that table is
    broadcast and no larger whatever the input. Joins behind it then move few rows where few match; where all bits are
    set they move all, and the result is the same. Nulls count as values.
    """
    def spots(*columns):
        spot = F.pmod(F.xxhash64(*columns), F.lit(words * 64))
        return F.floor(spot / 64).cast("long"), (spot % 64).cast("int")

    word, bit, mask = fresh(rows, "_word", "_bit", "_mask")
    a, b = spots(*keys.columns)
    masks = keys.select(a.alias(word), b.alias(bit)).groupBy(word).agg(F.expr(f"bit_or(shiftleft(1L, `{bit}`))").alias(mask))
    a, b = spots(*columns)
    placed = rows.withColumn(word, a).withColumn(bit, b).join(F.broadcast(masks), word, "left")
    return placed.withColumn(mark, F.coalesce(F.bit_get(mask, F.col(bit)) == 1, F.lit(False))).drop(word, bit, mask)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# The public split pattern of the 50k byte-level vocabulary with possessive runs: the same pieces, less
# backtracking. Checked against the tokenizer file in tests/llm.
SPLIT = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
)
# Texts beyond these characters, or with a special token spelt out, take the tokenizer file itself.
_UNUSUAL = re.compile("[^\x00-ɏ‐-‧]|<\\|")


@functools.lru_cache(maxsize=4)
def byte_bpe(json_path: str, ranks_path: str | None = None, special: bool = True):
    """``text -> ids`` of a byte-level BPE tokenizer file, without special tokens added.

    ``ranks_path`` names the same vocabulary as ranks; plain texts then use the faster encoder, which gives
    the same ids. Without it every text goes through the tokenizer file. With ``special=False`` the strings of
    special tokens are plain text.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path)
    slow.encode_special_tokens = not special

    def by_file(text: str) -> list[int]:
        return slow.encode(text, add_special_tokens=False).ids

    if ranks_path is None:
        return by_file
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        return by_file(text) if _UNUSUAL.search(text) else fast.encode_ordinary(text)

    return encode


def vocabulary() -> dict[str, str]:
    """The default tokenizer's files; operators take the paths as parameters."""
    import public_tokenizers

    return {
        "json_path": public_tokenizers.path("byte_bpe_50k.json"),
        "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"),
    }


def pieces() -> dict[str, str]:
    """The default second tokenizer's file."""
    import public_tokenizers

    return {"model_path": public_tokenizers.path("piece_bpe_32k.model")}
