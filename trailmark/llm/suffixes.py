"""Bytes covered by long strings that also start elsewhere, by anchored windows in place of longest-previous-factor arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import Staging
from trailmark.llm.words import _BASE, _INVERSE, U, _letters, mix, powers, utf8, words

PART = 1 << 18  # window starts handled at once within one text


def _prefix_sums(raw: np.ndarray, seed: int) -> np.ndarray:
    """Sums over bytes, or over word hashes as they are."""
    out = np.zeros(len(raw) + 1, U)
    np.cumsum((_letters(seed)[raw] if raw.dtype == np.uint8 else raw) * powers(_BASE, len(raw)), out=out[1:])
    return out


def _sequences(column: pa.Array, unit: str) -> Iterator[np.ndarray]:
    """Each row's bytes, or its words' hashes."""
    if unit == "words":
        yield from (hashes for _, hashes, _, _ in words(column, "space"))
        return
    data, at = utf8(column)
    for i in range(len(column)):
        yield data[at[i] : at[i + 1]]


def _hashes(sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, the same for equal strings wherever they stand."""
    return mix((sums[stop] - sums[start]) * powers(_INVERSE, len(sums))[start])


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of every run of ``width``, by block-wise running minima from both sides."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(U).max, U)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


@lru_cache(maxsize=2)
def _places(n: int) -> np.ndarray:
    return (np.arange(n, 0, -1) - 1).astype(U)


def anchors(raw: np.ndarray, length: int, gram: int):
    """Runs of window starts that share an anchor: (first start, last start, anchor) arrays.

    The anchor of a window of ``length`` bytes is its gram with the least hash, the last one on a tie, so equal
    windows have equal anchors at equal offsets, and windows with different anchors cannot be equal.
    """
    first, last, anchor = [], [], []
    windows = len(raw) - length + 1
    for at in range(0, windows, PART):
        part = raw[at : min(at + PART, windows) + length - 1]
        sums = _prefix_sums(part, 17)
        n = len(part) - gram + 1
        starts = np.arange(n)
        code = _hashes(sums, starts, starts + gram)
        # 40 bits of the hash order the grams, 24 bits of the place decide ties and name the gram.
        code = (code & ~U((1 << 24) - 1)) | _places(1 << 19)[-n:]
        least = _sliding_least(code, length - gram + 1)
        found = n - 1 - (least & U((1 << 24) - 1)).astype(np.int64)
        change = np.flatnonzero(np.diff(found, prepend=-1))
        first.append(change + at)
        last.append(np.append(change[1:], len(found)) - 1 + at)
        anchor.append(found[change] + at)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (first, last, anchor))


def window_hashes(raw: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the windows that begin at ``starts`` (ascending), part by part."""
    out = np.empty(len(starts), U)
    done = 0
    while done < len(starts):
        base = int(starts[done])
        upto = int(np.searchsorted(starts, base + PART))
        mine = starts[done:upto] - base
        sums = _prefix_sums(raw[base : base + int(mine[-1]) + length], 17)
        out[done:upto] = _hashes(sums, mine, mine + length)
        done = upto
    return out


def _contexts(raw: np.ndarray, first, last, anchor, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Per run the hash of its anchor gram, and one of all its windows together with their offsets from it."""
    keys, contexts = np.empty(len(first), U), np.empty(len(first), U)
    done = 0
    while done < len(first):
        base = int(first[done])
        upto = max(done + 1, int(np.searchsorted(first, base + PART)))
        a, b, c = (x[done:upto] - base for x in (first, last, anchor))
        sums = _prefix_sums(raw[base : base + int(b[-1]) + length], 17)
        keys[done:upto] = _hashes(sums, c, c + gram)
        contexts[done:upto] = mix(_hashes(sums, a, b + length) + mix((c - a).astype(U) * U(1 << 32) + (b - a).astype(U)))
        done = upto
    return keys, contexts


def merged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as disjoint ones that don't touch."""
    if not len(starts):
        return starts, stops
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(stops[order])
    fresh = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
    return starts[fresh], reach[np.append(fresh[1:], len(starts)) - 1]


def _lists(values: list[np.ndarray], kind) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def _arrays(column) -> list[np.ndarray]:
    return [np.asarray(x.values, np.int64) if x.is_valid else np.zeros(0, np.int64) for x in column]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("h", F.xxhash64("text"))


def repeated_spans(
    docs: DataFrame,
    staging: Staging,
    *,
    length: int = 400,
    keep: str = "first",
    unit: str = "bytes",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row of ``docs`` the maximal runs of bytes that lie in a string of ``length`` bytes found elsewhere.

    With ``unit="words"`` texts are rows of words instead (runs of anything but 0x20 and 0x09-0x0D, A-Z lower-cased),
    and all lengths and offsets count words; ``sha256`` is null then.

    Texts are UTF-8 bytes, null is empty; matches lie within one document each, which may be the same one, and
    may overlap. A byte counts if a window (a suffix cut after ``length`` bytes) over it has a longest previous
    factor of at least ``length`` (``keep="first"``: the first occurrence stays), or a longest previous or next
    one (``keep="none"``: every occurrence goes). In suffix order such windows are runs of equal neighbours, and
    the previous and next smaller positions of a member are in its run, so what has to be known of a run is its
    size and its least position, by (id, row, byte).

    No suffix order and no such array is built: windows are grouped by anchors instead. Each window's anchor is
    its gram (5/8 of the length) of least hash; equal windows have equal anchors at equal offsets.

    1. Neighbouring windows with one anchor form a run of about a hundred; one row each.
    2. A run whose anchor gram occurs once in the corpus has no repeated window. Grams are counted before the
       shuffle, so a passage in a third of all documents is a few rows from each task.
    3. Runs that agree in all their windows are repeated as a whole; again only counts and the least are kept.
    4. What is left are the borders of passages: runs whose gram recurs in other surroundings. Their windows,
       and those of one run of each whole group with that gram, are compared one by one by (gram, window)
       hashes of 64 bits each, in the same way: counted, then joined back, where the engine splits hot ones.

    Columns: ``row`` (unique), ``id``, ``h``, ``n_bytes``, ``sha256`` (of the whole text), ``starts`` and ``stops`` (arrays
    of byte offsets), ``removed``. Equal rows are occurrences like others. Extra columns are not read.
    """
    if keep not in ("first", "none") or unit not in ("bytes", "words"):
        raise ValueError("keep must be first or none, unit bytes or words")
    gram = max(1, length * 5 // 8)

    def walk(batches):
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            found, sizes = [[] for _ in range(4)], []
            for raw in _sequences(batch.column("text"), unit):
                sizes.append(len(raw))
                first, last, anchor = anchors(raw, length, gram)
                for into, values in zip(found, (*_contexts(raw, first, last, anchor, length, gram), first, last)):
                    into.append(values.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + batch.num_rows)), batch.column("id"), batch.column("h"), batch.column("sha256"),
                    pa.array(sizes, pa.int64()), *(_lists(x, pa.int64()) for x in found),
                ],
                names=["row", "id", "h", "sha256", "n_bytes", "keys", "contexts", "first", "last"],
            )
            row += batch.num_rows

    rows = _rows(docs, id_col, text_col).withColumn("sha256", F.sha2("text", 256) if unit == "bytes" else F.lit(None).cast("string"))
    kind = rows.schema["id"].dataType.simpleString()
    shape = f"row long, id {kind}, h long, sha256 string, n_bytes long, keys array<long>, contexts array<long>, first array<long>, last array<long>"
    runs = staging.keep(rows.mapInArrow(walk, shape), "runs")

    counted = runs.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    each = runs.select("row", "id", F.posexplode(F.arrays_zip("keys", "contexts")).alias("place", "z")).select("row", "id", "place", F.col("z.keys").alias("key"), F.col("z.contexts").alias("context"))
    shared = staging.keep(each.join(counted, "key", "left_semi"), "shared")
    alike = shared.groupBy("key", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "row", "place")).alias("least"))
    alike = staging.keep(alike, "alike")
    keys = alike.groupBy("key").agg(F.count(F.lit(1)).alias("contexts"), F.min("n").alias("fewest"))
    mixed = keys.where("contexts > 1 and fewest = 1" if keep == "none" else "contexts > 1").select("key")
    whole = shared.join(alike.where("n > 1").select("key", "context", "least"), ["key", "context"])
    if keep == "first":
        whole = whole.where("row <> least.row or place <> least.place")
    whole = whole.groupBy("row").agg(F.collect_list("place").alias("whole"))  # the runs of one document
    whole = staging.keep(whole, "whole")
    # The least of each group stands for it; a single run is its own least.
    asked = alike.join(mixed, "key", "left_semi").select("least.row", "least.place").groupBy("row").agg(F.collect_list("place").alias("asked"))
    asked = runs.join(asked, "row").select("row", F.col("id").alias("its"), F.col("h").alias("its_h"), "asked", "keys", "first", "last")

    def cut(batches):
        for batch in batches:
            columns = [_arrays(batch.column(c)) for c in ("asked", "keys", "first", "last")]
            numbers, out = batch.column("row").to_numpy(), [[] for _ in range(4)]
            for i, (raw, places, gram_keys, first, last) in enumerate(zip(_sequences(batch.column("text"), unit), *columns)):
                places = np.sort(places)
                sizes = last[places] - first[places] + 1
                starts = np.repeat(first[places] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                hashes = window_hashes(raw, starts, length)
                for into, values in zip(out, (np.full(len(starts), numbers[i]), np.repeat(gram_keys[places], sizes), hashes.view(np.int64), starts)):
                    into.append(values)
            flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]
            for a in range(0, len(flat[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 100_000]) for x in flat], names=["row", "key", "window", "start"])

    texts = _rows(docs, id_col, text_col)
    found = texts.join(asked, texts["id"].eqNullSafe(asked["its"]) & (texts["h"] == asked["its_h"])).dropDuplicates(["row"])
    windows = found.select("row", "text", "asked", "keys", "first", "last").mapInArrow(cut, "row long, key long, window long, start long")
    windows = staging.keep(windows, "windows")
    if keep == "first":
        windows = windows.join(runs.select("row", "id"), "row")
        least = F.min(F.struct("id", "row", "start")).alias("least")
    else:
        least = F.lit(None).alias("least")
    twice = windows.groupBy("key", "window").agg(F.count(F.lit(1)).alias("n"), least).where("n > 1")
    single = windows.join(twice, ["key", "window"])
    if keep == "first":
        single = single.where("row <> least.row or start <> least.start")
    single = staging.keep(single.groupBy("row").agg(F.collect_list("start").alias("single")), "single")

    def union(batches):
        for batch in batches:
            columns = [_arrays(batch.column(c)) for c in ("first", "last", "whole", "single")]
            out = [[], [], []]
            for first, last, places, starts in zip(*columns):
                a, b = merged(np.concatenate([first[places], starts]), np.concatenate([last[places], starts]) + length)
                for into, values in zip(out, (a, b)):
                    into.append(values)
                out[2].append(int((b - a).sum()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("row", "id", "h", "n_bytes", "sha256")), _lists(out[0], pa.int64()), _lists(out[1], pa.int64()), pa.array(out[2], pa.int64())],
                names=["row", "id", "h", "n_bytes", "sha256", "starts", "stops", "removed"],
            )

    every = runs.select("row", "id", "h", "n_bytes", "sha256", "first", "last").join(whole, "row", "left").join(single, "row", "left")
    shape = f"row long, id {kind}, h long, n_bytes long, sha256 string, starts array<long>, stops array<long>, removed long"
    spans = staging.keep(every.mapInArrow(union, shape), "spans")
    staging.drop("runs", "shared", "alike", "whole", "windows", "single")
    return spans


def remove_repeats(
    docs: DataFrame, *, length: int = 400, keep: str = "first", passage: int | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row what is left of its text without the spans of ``repeated_spans``, as bytes.

    Columns: ``id_col``, ``n_bytes``, ``n_removed``, ``n_spans``, ``starts``, ``stops``, ``kept_sha256`` and ``kept`` (binary; null
    where nothing was removed, so that untouched texts need not move). Only partly removed texts are joined.

    With ``passage``, ``n_passage_words`` counts the words that lie in a run of so many words found elsewhere too. Such
    passages may be shorter than ``length`` bytes; they are reported and not removed.
    """
    passages = None
    if passage:
        found = repeated_spans(docs, Staging(docs.sparkSession), length=passage, keep="none", unit="words", id_col=id_col, text_col=text_col)
        # Equal rows have equal passages.
        passages = found.where("removed > 0").select(F.col("id").alias("of"), F.col("h").alias("of_h"), F.col("removed").alias("n_passage_words")).dropDuplicates(["of", "of_h"])
    spans = repeated_spans(docs, Staging(docs.sparkSession), length=length, keep=keep, id_col=id_col, text_col=text_col)
    partly = spans.where("removed > 0 and removed < n_bytes").select("row", F.col("id").alias("its"), F.col("h").alias("its_h"), "starts", "stops")
    texts = _rows(docs, id_col, text_col)
    # With keep="first" a repeated row can be cut in part and meet its equals here; one of them serves.
    found = texts.join(partly, texts["id"].eqNullSafe(partly["its"]) & (texts["h"] == partly["its_h"])).select("row", "text", "starts", "stops").dropDuplicates(["row"])

    def take(batches):
        for batch in batches:
            data, at = utf8(batch.column("text"))
            kept = []
            for i, (starts, stops) in enumerate(zip(_arrays(batch.column("starts")), _arrays(batch.column("stops")))):
                raw = data[at[i] : at[i + 1]]
                borders = [0, *np.column_stack([starts, stops]).ravel().tolist(), len(raw)]
                kept.append(b"".join(raw[a:b].tobytes() for a, b in zip(borders[::2], borders[1::2])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(kept, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())],
                names=["row", "kept", "kept_sha256"],
            )

    left = found.mapInArrow(take, "row long, kept binary, kept_sha256 string")
    all_gone = (F.col("removed") > 0) & (F.col("removed") == F.col("n_bytes"))
    out = spans.join(left, "row", "left")
    more = []
    if passages is not None:
        out = out.join(passages, out["id"].eqNullSafe(passages["of"]) & (out["h"] == passages["of_h"]), "left")
        more.append(F.coalesce("n_passage_words", F.lit(0).cast("long")).alias("n_passage_words"))
    return out.select(
        F.col("id").alias(id_col), "n_bytes", F.col("removed").alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), "starts", "stops",
        F.when(F.col("removed") == 0, F.col("sha256")).when(all_gone, F.sha2(F.lit(""), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(all_gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept"), *more,
    )
