"""Benchmark decontamination: n-gram seeds, an exact bound on the words in common, then Smith-Waterman alignment."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.common import Staging
from trailmark.llm.words import U, grams, words

MATCH, MISMATCH, GAP = 2, -1, -1
# Letters written without blanks between words: each is a word by itself.
SINGLE = [
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF),
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF),
]


@dataclass(frozen=True)
class Items:
    """A block of test items as word hashes, and the seeds that lead to them.

    ``seeds`` is sorted; seed i belongs to (item, word position) pairs ``owners[first[i]:first[i + 1]]``.
    ``bags`` has each item's distinct words, sorted, and how often it holds each. ``short`` has the items of
    fewer words than a seed: by their number of words the sorted hashes of them all, and each hash's items.
    """

    ids: list
    words: list[np.ndarray]
    seeds: np.ndarray
    first: np.ndarray
    owners: np.ndarray
    bags: list[tuple[np.ndarray, np.ndarray]]
    short: dict[int, tuple[np.ndarray, list[list[int]]]]


def _item_words(texts: list[str | None]) -> list[np.ndarray]:
    return [hashes for _, hashes, _, _ in _words(pa.array(texts, pa.string()))]


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point what it is written as (lower case, or a blank where it ends a word), and if it is a word by itself."""
    folded, single = np.arange(sys.maxunicode + 1, dtype=np.uint32), np.zeros(sys.maxunicode + 1, bool)
    for a, b in SINGLE:
        single[a : b + 1] = True
    for i in range(128, sys.maxunicode + 1):
        kind = unicodedata.category(chr(i))
        if kind[0] in "PSZ" or kind == "Cc" or i in (0x200B, 0xFEFF):
            folded[i], single[i] = 0x20, False
        elif kind[0] == "L" and len(small := chr(i).lower()) == 1:
            folded[i] = ord(small)
    folded[ord("ς")] = ord("σ")
    return folded, single


def _rewritten(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The code points that a text's words are taken from, and of which character of the text each one comes."""
    folded, single = _characters()
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    alone = single[codes]
    # A blank before and after each character that is a word by itself.
    sizes = np.where(alone, 3, 1)
    comes_of = np.repeat(np.arange(len(codes)), sizes)
    out = folded[codes][comes_of]
    at = (np.cumsum(sizes) - sizes)[alone]
    out[at], out[at + 2] = 0x20, 0x20
    return out, comes_of


def _byte_borders(codes: np.ndarray) -> np.ndarray:
    """Where each code point starts in UTF-8 (one more at the end)."""
    return np.concatenate([[0], np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000).astype(np.int64))])


def _places(text: str, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions in the rewritten text as those in the text itself."""
    out, comes_of = _rewritten(text)
    new, old = _byte_borders(out), _byte_borders(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    return old[comes_of[np.searchsorted(new, first)]], old[comes_of[np.searchsorted(new, last) - 1] + 1]


def _words(column: pa.Array, rows: int = 256) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``words`` by Unicode; positions are those of the rewritten text, see ``_places``."""
    for low in range(0, len(column), rows):
        texts = column.slice(low, rows).to_pylist()
        texts = [t if t is None or t.isascii() else _rewritten(t)[0].tobytes().decode("utf-32-le") for t in texts]
        for row, *found in words(pa.array(texts, pa.large_string()), "punctuation", latin=True):
            yield low + row, *found


def _lookup(sorted_values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``wanted`` that occur in ``sorted_values``, and where."""
    if not len(sorted_values) or not len(wanted):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.searchsorted(sorted_values, wanted)
    at[at == len(sorted_values)] = 0
    hit = np.flatnonzero(sorted_values[at] == wanted)
    return hit, at[hit]


def _seeds(ids: list, texts: list, n: int) -> Items:
    """Every n-gram of every item is a seed, so any run of ``n`` unchanged words leads to its item.

    Items shorter than ``n`` words have no seeds; they are looked up as a whole.
    """
    item_words = _item_words(texts)
    per_item = [grams(x, n) for x in item_words]
    values = np.concatenate([np.zeros(0, U), *per_item])
    owners = np.array([(item, k) for item, mine in enumerate(per_item) for k in range(len(mine))], np.int64).reshape(-1, 2)
    order = np.argsort(values, kind="stable")
    seeds, first = np.unique(values[order], return_index=True)
    by_hash: dict[int, dict[int, list[int]]] = {}
    for item, mine in enumerate(item_words):
        if 0 < len(mine) < n:
            by_hash.setdefault(len(mine), {}).setdefault(int(grams(mine, len(mine))[0]), []).append(item)
    short = {size: (np.array(sorted(known), U), [known[x] for x in sorted(known)]) for size, known in by_hash.items()}
    bags = [np.unique(x, return_counts=True) for x in item_words]
    return Items(ids, item_words, seeds, np.append(first, len(values)), owners[order], bags, short)


def _whole(hashes: np.ndarray, items: Items) -> Iterator[tuple[int, int, int]]:
    """(item, first word, past-the-end word) of each exact copy of an item that is too short for seeds."""
    for size, (known, owners) in items.short.items():
        found, at = _lookup(known, grams(hashes, size))
        for position, k in zip(found.tolist(), at.tolist()):
            for item in owners[k]:
                yield item, position, position + size


def align(item: np.ndarray, passages: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """Best local alignment of one item with each passage: score, first and past-the-end word of the passage.

    Smith-Waterman with linear gaps, by anti-diagonals over all passages at once. Where several cells tie,
    the first in the passage counts.
    """
    count, m = len(passages), len(item)
    width = max(map(len, passages))
    text = np.zeros((count, width), U)
    valid = np.zeros((count, width), bool)
    for i, p in enumerate(passages):
        text[i, : len(p)], valid[i, : len(p)] = p, True
    # Diagonal d holds cells (i, d - i); index i + 1 in the arrays, so index 0 is the empty border.
    score = [np.zeros((count, m + 1), np.int32) for _ in range(2)]
    begin = [np.zeros((count, m + 1), np.int64) for _ in range(2)]
    best, best_end, best_begin = np.zeros(count, np.int32), np.zeros(count, np.int64), np.zeros(count, np.int64)
    for d in range(m + width - 1):
        low, high = max(0, d - width + 1), min(m, d + 1)
        i = np.arange(low, high)
        j = d - i
        now, start = np.zeros((count, m + 1), np.int32), np.zeros((count, m + 1), np.int64)
        same = (text[:, j] == item[i]) & valid[:, j]
        diagonal = score[0][:, i] + np.where(same, MATCH, MISMATCH)
        came = np.where(score[0][:, i] > 0, begin[0][:, i], j)
        up, left = score[1][:, i] + GAP, score[1][:, i + 1] + GAP
        for other, its in ((up, begin[1][:, i]), (left, begin[1][:, i + 1])):
            better = other > diagonal
            diagonal, came = np.where(better, other, diagonal), np.where(better, its, came)
        now[:, i + 1], start[:, i + 1] = np.maximum(diagonal, 0), came
        top = now[:, i + 1].argmax(1)
        value = now[np.arange(count), i[top] + 1]
        better = value > best
        best[better] = value[better]
        best_end[better] = j[top][better] + 1
        best_begin[better] = start[np.arange(count), i[top] + 1][better]
        score, begin = [score[1], now], [begin[1], start]
    return [(int(a), int(b), int(c)) for a, b, c in zip(best, best_begin, best_end)]


def _common(bag: tuple[np.ndarray, np.ndarray], passage: np.ndarray) -> int:
    """How many words an item and a passage have in common, each as often as both hold it."""
    at = _lookup(bag[0], passage)[1]
    return int(np.minimum(np.bincount(at, minlength=len(bag[0])), bag[1]).sum())


def _regions(found: np.ndarray, at: np.ndarray, items: Items, hashes: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int]]:
    """(item, first word, past-the-end word) around the seed hits of one document, overlapping ones joined.

    Hits of common n-grams go by a bound: a passage of score ``threshold`` has at least that share of the item's
    words in common with it. Gaps that put some of them past the slack have cost the score as much, so every hit
    in such a passage stays.
    """
    length = len(hashes)
    spans: dict[int, set[tuple[int, int]]] = {}
    for position, seed in zip(found.tolist(), at.tolist()):
        for item, k in items.owners[items.first[seed] : items.first[seed + 1]].tolist():
            size = len(items.words[item])
            slack = max(size // 2 + 4, int(size * (1 - threshold)) + 1)
            spans.setdefault(item, set()).add((max(0, position - k - slack), min(length, position - k + size + slack)))
    for item, windows in spans.items():
        least = threshold * len(items.words[item])
        mine = sorted(x for x in windows if _common(items.bags[item], hashes[slice(*x)]) >= least)
        if not mine:
            continue
        low, high = mine[0]
        for a, b in mine[1:]:
            if a < high - len(items.words[item]) // 2:
                high = max(high, b)
            else:
                yield item, low, high
                low, high = a, b
        yield item, low, high


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    n: int = 3,
    threshold: float = 0.5,
    block: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Passages of documents that copy test items, also edited ones.

    All n-grams of the items are the seeds. Each document looks its n-grams up among the seeds, and where the
    words around a hit have enough in common with the item for the threshold, they are aligned with it. ``score``
    is the alignment's score over that of a perfect copy (2 a word); matches of ``threshold`` and above are returned, one row for each passage, with the passage's
    bytes ``start`` to ``stop`` in the UTF-8 text. Where one joined region holds several copies of one item,
    each further copy is found after the better one is taken out.

    Words are runs of letters, marks and digits by Unicode, in lower case; characters of scripts without blanks
    between words (Chinese, Japanese, Thai, Lao, Khmer, Burmese) are words one by one. The test items go to the tasks in blocks of ``block`` items, so what is broadcast is bounded
    for a benchmark of any size, and every document meets every block. Document order plays no part; nothing
    is shuffled. A copy without a run of ``n`` unchanged words anywhere is not found, whatever its score.

    Null or empty texts match nothing; items of fewer than ``n`` words are found as exact copies only (score 1,
    so a benchmark with an item of one word names every document with that word); equal items
    each give their rows; repeated documents each give theirs. Columns beside the named ones are not read.
    """
    wanted = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).where("text is not null")
    out = None
    for ids, texts in _blocks(wanted, block):
        found = _match(docs, _seeds(ids, texts, n), n, threshold, id_col, text_col, benchmark.schema[item_col].dataType, item_col)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = _match(docs, _seeds([], [], n), n, threshold, id_col, text_col, benchmark.schema[item_col].dataType, item_col)
    return out


def _blocks(items: DataFrame, block: int) -> Iterator[tuple[list, list]]:
    """The items in blocks of bounded size, streamed to the driver partition by partition."""
    ids, texts = [], []
    for row in items.toLocalIterator():
        ids.append(row["item"])
        texts.append(row["text"])
        if len(ids) == block:
            yield ids, texts
            ids, texts = [], []
    if ids:
        yield ids, texts


def _match(docs, items: Items, n, threshold, id_col, text_col, item_type, item_col) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField(item_col, item_type),
        T.StructField("score", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()),
    ])
    id_type = None

    def run(batches):
        known = shared.value
        for batch in batches:
            rows, which, scores, starts, stops = [], [], [], [], []
            waiting: dict[int, list[tuple]] = {}
            for row, hashes, first, last in _words(batch.column("text")):
                found, at = _lookup(known.seeds, grams(hashes, n))
                whole = list(_whole(hashes, known))
                if not len(found) and not whole:
                    continue
                text = batch.column("text")[row].as_py()
                if not text.isascii():
                    first, last = _places(text, first, last)
                for item, a, b in whole:
                    rows.append(row)
                    which.append(known.ids[item])
                    scores.append(1.0)
                    starts.append(int(first[a]))
                    stops.append(int(last[b - 1]))
                for item, low, high in _regions(found, at, known, hashes, threshold):
                    waiting.setdefault(item, []).append((row, hashes[low:high], first[low:high], last[low:high]))
            while waiting:
                again: dict[int, list[tuple]] = {}
                for item, cases in waiting.items():
                    full = MATCH * len(known.words[item])
                    for part in _alike(cases):
                        for case, (score, a, b) in zip(part, align(known.words[item], [c[1] for c in part])):
                            if score < threshold * full or b <= a:
                                continue
                            row, w, first, last = case
                            rows.append(row)
                            which.append(known.ids[item])
                            scores.append(score / full)
                            starts.append(int(first[a]))
                            stops.append(int(last[b - 1]))
                            for x, y in ((0, a), (b, len(w))):
                                if MATCH * (y - x) >= threshold * full:
                                    again.setdefault(item, []).append((row, w[x:y], first[x:y], last[x:y]))
                waiting = again
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(rows, pa.int64())), pa.array(which, id_type) if which else pa.array([], pa.null()),
                    pa.array(scores, pa.float64()), pa.array(starts, pa.int64()), pa.array(stops, pa.int64()),
                ], names=schema.names,
            ) if rows else _nothing(batch, schema)

    def _nothing(batch, schema):
        from pyspark.sql.pandas.types import to_arrow_schema

        return pa.RecordBatch.from_pylist([], schema=to_arrow_schema(schema))

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _alike(cases: list[tuple], cells: int = 1 << 16) -> Iterator[list[tuple]]:
    """Cases of like length together, so that the alignment's arrays stay small and have little padding."""
    cases = sorted(cases, key=lambda c: len(c[1]))
    part: list[tuple] = []
    for case in cases:
        if part and ((len(part) + 1) * len(case[1]) > cells or len(case[1]) > 2 * len(part[0][1]) + 16):
            yield part
            part = []
        part.append(case)
    if part:
        yield part


def clean(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """Documents without a contaminated passage, all their columns. Null ids are kept: they name no document.

    The ids that go are written first, so that their size decides whether the documents have to be shuffled.
    """
    bad = contamination(docs, benchmark, id_col=id_col, **options).select(id_col).distinct()
    bad = Staging(docs.sparkSession).keep(bad, "contaminated")
    return docs.join(bad, id_col, "left_anti").select(docs.columns)
