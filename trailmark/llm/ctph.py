"""Context-triggered piecewise hashing: signatures of pieces, compared by edit distance."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import Staging, partitions
from trailmark.llm.words import _BASE, _INVERSE, CHUNK, U, _letters, mix, powers

WINDOW = 7  # bytes that the rolling hash sees
SMALLEST = 4  # block sizes are SMALLEST times a power of two
PIECES = 64  # characters of a signature at most
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
SHARED = 5  # pieces in a row that like texts share


def _rolling(data: np.ndarray) -> np.ndarray:
    """For each byte a hash of the ``WINDOW`` bytes that end there (fewer at the start)."""
    values = _letters(11)[data]
    out = values.copy()
    for i in range(1, WINDOW):
        out[i:] += values[:-i] << U(5 * i) if len(values) > i else U(0)
    return out ^ (out >> U(29))


def _chunks(data: np.ndarray):
    """(offset, rolling hashes, running sums) chunk by chunk, so that long texts need little memory."""
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK]
        before = min(at, WINDOW - 1)
        sums = np.cumsum(_letters(13)[part] * powers(_BASE, len(part)))
        yield at, _rolling(data[at - before : at + len(part)])[before:], sums


def _pieces(data: np.ndarray, chunks, block: int) -> str:
    """One character per piece; a piece ends where the rolling hash has its low bits set, or with the text."""
    ends, hashes = 0, []
    carried = 0  # hash of the unfinished piece's bytes in earlier chunks, and how many they are
    length = 0
    for at, rolling, sums in chunks:
        cut = np.flatnonzero((rolling & U(block - 1)) == U(block - 1)) + 1
        padded = np.concatenate([np.zeros(1, U), sums])
        borders = np.concatenate([[0], cut, [len(sums)]])
        part = (padded[borders[1:]] - padded[borders[:-1]]) * powers(_INVERSE, len(sums) + 1)[borders[:-1]]
        if length:
            part[0] = U((carried + int(part[0]) * pow(_BASE, length, 1 << 64)) % (1 << 64))
        hashes.append(part[:-1])
        ends += len(cut)
        if len(cut):
            carried, length = int(part[-1]), int(borders[-1] - borders[-2])
        else:
            carried, length = int(part[0]), length + len(sums)
    if length:
        hashes.append(np.array([carried], U))
    found = mix(np.concatenate(hashes)) if hashes else np.zeros(0, U)
    return ALPHABET[(found >> U(40)) & U(63)].tobytes().decode()


def _paired(pieces: str) -> str:
    """One character for each two neighbouring pieces; a last one alone stays as it is."""
    codes = np.frombuffer(pieces.encode(), np.uint8).astype(U)
    even = len(codes) // 2 * 2
    joined = ALPHABET[(mix(codes[:even:2] << U(8) | codes[1:even:2]) >> U(40)) & U(63)]
    return joined.tobytes().decode() + pieces[even:]


def fingerprint(data: bytes) -> str:
    """``block:signature:signature at twice the block``; equal bytes have equal fingerprints.

    The block size starts where pieces of that size would be 64. It halves while there are fewer than 32 (and not
    more than 64 at the half) and doubles while there are more than 64, so that a signature speaks for the whole
    text. Where one block size has more than 64 pieces and the next fewer than 16, as in long texts of one repeated
    line, whose triggers all go at once, neighbouring pieces are joined in pairs instead.
    """
    raw = np.frombuffer(data, np.uint8)
    block = SMALLEST
    while block * PIECES < len(raw):
        block *= 2
    chunks = list(_chunks(raw)) if len(raw) <= CHUNK else None

    def cut(size: int) -> str:
        return _pieces(raw, chunks or _chunks(raw), size)

    def joined(size: int, pieces: str) -> str:
        while len(pieces) > PIECES:
            size, pieces = 2 * size, _paired(pieces)
        return f"{size}:{pieces}:{_paired(pieces)}"

    pieces = cut(block)
    while len(pieces) < PIECES // 2 and block > SMALLEST:
        more = cut(block // 2)
        if len(more) > PIECES:
            if len(pieces) < PIECES // 4:
                return joined(block // 2, more)
            break
        block, pieces = block // 2, more
    double = cut(2 * block)
    while len(pieces) > PIECES:
        if len(double) < PIECES // 4:
            return joined(block, pieces)
        block, pieces, double = 2 * block, double, cut(4 * block)
    return f"{block}:{pieces}:{double}"


def _alike(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; 0 unless some pieces in a row agree."""
    run = F.least(F.lit(SHARED), F.length(a), F.length(b))
    shared = F.exists(
        F.sequence(F.lit(1), F.greatest(F.length(a) - run + 1, F.lit(1))), lambda i: F.contains(b, F.substring(a, i, run))
    )
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).when(~shared | (run == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / longest)


def likeness(a: Column, b: Column) -> Column:
    """Likeness (0 to 1) of two fingerprints: signatures are compared where their block sizes agree."""
    x, y = F.split(a, ":"), F.split(b, ":")
    p, q = x[0].cast("long"), y[0].cast("long")
    return (
        F.when(a == b, 1.0)
        .when(p == q, F.greatest(_alike(x[1], y[1]), _alike(x[2], y[2])))
        .when(p == 2 * q, _alike(x[1], y[2]))
        .when(2 * p == q, _alike(x[2], y[1]))
        .when(a.isNotNull() & b.isNotNull(), 0.0)
    )


def fingerprints(docs: DataFrame, *, text_col: str = "text", column: str = "fingerprint") -> DataFrame:
    """All columns of ``docs`` and the fingerprint of each whole text (null and empty: that of no bytes)."""
    kept = docs.drop(column)

    def run(batches):
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            made = pa.array([fingerprint((x or "").encode()) for x in texts], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, column])

    return kept.mapInArrow(run, kept.withColumn(column, F.lit("")).schema)


def edit(text: str, following: str) -> str:
    """The last quarter of the characters replaced by the first as many of the following text."""
    quarter = len(text) // 4
    return text[: len(text) - quarter] + following[:quarter]


def edited_neighbours(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next document, with their likeness.

    Rows are dealt into ranges of (id, text hash) and walked in that order; the last follows on to the first.
    Each range hands over its first and last document only, which then meet their neighbours in other ranges;
    no other text moves twice. Null ids come first, null texts count as empty, repeated rows follow one
    another; a lone row is its own neighbour. Other columns are not read.

    Columns: ``id_col``, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``next_fingerprint``,
    ``near_edited``, ``near_next``.
    """
    staging = Staging(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    ranged = (
        rows.withColumn("h", F.xxhash64("text"))
        .repartitionByRange(partitions(docs.sparkSession), "id", "h")
        .sortWithinPartitions("id", "h", "text")
        .select("id", "text")
    )
    shape = f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string, role string, part int, text string"

    def compared(text: str, own: str, following: str, next_fingerprint: str) -> tuple:
        changed = edit(text, following).encode()
        return len(text), hashlib.sha256(changed).hexdigest(), own, fingerprint(changed), next_fingerprint

    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint", "role", "part", "text"]
    types = [pa.int64(), *[pa.string()] * 5, pa.int32(), pa.string()]

    def batch_of(ids: list, out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [[] for _ in types]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *(pa.array(c, t) for c, t in zip(columns, types))], names=names)

    def walk(batches):
        part = TaskContext.get().partitionId()
        held = None  # the row before, whose neighbour comes next
        for batch in batches:
            ids, out = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                own = fingerprint(text.encode())
                one = batch.column("id").slice(i, 1)
                if held is None:
                    ids.append(one)
                    out.append((len(text), None, own, None, None, "first", part, text))
                else:
                    ids.append(held[0])
                    out.append((*compared(held[1], held[2], text, own), "row", part, None))
                held = (one, text, own)
            if out:
                yield batch_of(ids, out)
        if held is not None:
            yield batch_of([held[0]], [(len(held[1]), None, held[2], None, None, "last", part, held[1])])

    walked = staging.keep(ranged.mapInArrow(walk, shape), "walked")
    # Two rows a range: the last of each with the first of the next that has rows.
    order = Window.orderBy("part")
    firsts = walked.where("role = 'first'").select("part", F.col("text").alias("following"), F.col("fingerprint").alias("of_following"))
    firsts = firsts.withColumn("place", F.row_number().over(order))
    lasts = walked.where("role = 'last'").select("id", "part", "text", "fingerprint").withColumn("place", F.row_number().over(order))
    count = F.count(F.lit(1)).over(Window.partitionBy())
    lasts = lasts.withColumn("place", F.col("place") % count + 1)
    met = lasts.join(firsts.drop("part"), "place").select("id", "text", "fingerprint", "following", "of_following")

    def finish(batches):
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("text", "fingerprint", "following", "of_following")]
            out = [(*compared(*x), "row", 0, None) for x in zip(*cols)]
            if out:
                yield batch_of([batch.column("id")], out)

    whole = walked.where("role = 'row'").unionByName(met.mapInArrow(finish, shape))
    return whole.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
