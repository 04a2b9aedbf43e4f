"""Packing by power-of-two decomposition: every sequence is one piece of one document."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.common import byte_bpe


def piece_lengths(total: int, longest: int) -> list[int]:
    """As many pieces of ``longest`` as fit, then the binary digits of the rest, large to small."""
    full, rest = divmod(total, longest)
    return [longest] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(
    docs: DataFrame,
    *,
    json_path: str,
    ranks_path: str | None = None,
    longest: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_tokens: bool = True,
) -> DataFrame:
    """One row per piece: its document, place, tokens, length bucket and sequence.

    A document's ids (and ``end_id`` after them) are cut into pieces whose lengths are powers of two, at most
    ``longest``. A piece is a sequence by itself, so nothing is padded, no sequence crosses documents, and a
    trainer takes batches of equal length from one ``bucket`` (the length's exponent). It is one narrow pass
    over the scan; no row is shuffled and a hot document is only its own pieces.

    Columns: ``id_col``, ``start``, ``length``, ``ids_crc32`` (little-endian unsigned 32-bit ids),
    ``doc_tokens``, ``bucket``, ``tokens`` (if asked), ``sequence_id``, ``offset`` (always 0). A null or empty
    text is the end id alone. Repeated rows are packed as often as they occur; a null id stays null. Other
    columns of ``docs`` are not read. ``sequence_id`` is unique within one result and not gapless.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    key = docs.schema[id_col].dataType
    fields = [
        T.StructField("id", key), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()),
    ]
    if with_tokens:
        fields.append(T.StructField("tokens", T.ArrayType(T.IntegerType())))

    def cut(batches):
        encode = byte_bpe(json_path, ranks_path)
        for batch in batches:
            at, starts, lengths, sums, totals, tokens = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                start = 0
                for n in piece_lengths(len(ids), longest):
                    piece = ids[start : start + n]
                    at.append(i)
                    starts.append(start)
                    lengths.append(n)
                    sums.append(zlib.crc32(piece.tobytes()))
                    totals.append(len(ids))
                    if with_tokens:
                        tokens.append(piece.astype("i4"))
                    start += n
            columns = [
                batch.column("id").take(pa.array(at, pa.int64())),
                *(pa.array(x, pa.int64()) for x in (starts, lengths, sums, totals)),
            ]
            if with_tokens:
                columns.append(pa.array(tokens, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    pieces = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        cut, T.StructType(fields)
    )
    return pieces.select(
        F.col("id").alias(id_col),
        *(f.name for f in fields[1:]),
        F.log2("length").cast("int").alias("bucket"),
        F.monotonically_increasing_id().alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """The sequences as files, a folder per length, without a shuffle: a task adds to each folder."""
    pieces.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(path)
