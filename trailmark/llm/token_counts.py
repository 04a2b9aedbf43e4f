"""Token counts of sections by the character offsets of whole-document encodings."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import byte_bpe

SPANS = "array<struct<section:int,start:long,stop:long>>"
RULES = ("start", "end", "majority")


@functools.lru_cache(maxsize=2)
def _token_bytes(json_path: str) -> np.ndarray:
    """Bytes of each id: a byte-level vocabulary writes every byte as one character, special tokens as text."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(json_path)
    sizes = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
    for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
        sizes[i] = len(token)
    for i, token in tokenizer.get_added_tokens_decoder().items():
        sizes[i] = len(token.content.encode())
    return sizes


def token_spans(text: str, encode, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end character of every token of the whole text.

    A token that holds part of a character's bytes covers that character, so neighbours may overlap there.
    """
    ends = np.cumsum(sizes[encode(text)])
    starts = np.concatenate([np.zeros(1, np.int64), ends[:-1]]) if len(ends) else ends
    if len(ends) and ends[-1] == len(text):  # one byte a character
        return starts, ends
    raw = np.frombuffer(text.encode(), np.uint8)
    character = np.cumsum((raw & 0xC0) != 0x80) - 1
    return character[starts], character[ends - 1] + 1


def line_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Lines with their line breaks, so that they tile the text; an empty text is one empty line."""
    if not text:
        return np.zeros(1, np.int64), np.zeros(1, np.int64)
    stops = np.cumsum([len(x) + 1 for x in text.split("\n")])
    stops[-1] -= 1
    if len(stops) > 1 and stops[-1] == stops[-2]:
        stops = stops[:-1]
    return np.concatenate([[0], stops[:-1]]), stops


def allot(first: np.ndarray, last: np.ndarray, start: np.ndarray, stop: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of every token (-1: none), and whether the token reaches over a border of that section.

    Sections are disjoint and in order. ``start`` gives a token to the section of its first character, ``end``
    to that of its last, ``majority`` to the one that holds most of its characters, the earlier on a tie.
    """

    def holding(position):
        at = np.searchsorted(start, position, "right") - 1
        return np.where((at >= 0) & (position < stop[np.maximum(at, 0)]), at, -1) if len(start) else np.full(len(position), -1)

    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    if rule == "start":
        owner = holding(first)
    elif rule == "end":
        owner = holding(last - 1)
    else:
        owner = holding(first)
        low = np.searchsorted(stop, first, "right")
        high = np.searchsorted(start, last, "left")
        for t in np.flatnonzero((high - low > 1) | ((owner < 0) & (high > low))):
            s = np.arange(low[t], high[t])
            covered = np.minimum(last[t], stop[s]) - np.maximum(first[t], start[s])
            owner[t] = s[covered.argmax()]
    safe = np.maximum(owner, 0)
    crossing = (owner >= 0) & ((first < start[safe]) | (last > stop[safe])) if len(start) else np.zeros(len(first), bool)
    return owner, crossing


def section_tokens(
    docs: DataFrame,
    *,
    json_path: str,
    ranks_path: str | None = None,
    rule: str = "majority",
    spans_col: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per section with its tokens, counted on the encoding of the whole document.

    Sections are the document's lines with their line breaks, or the spans of ``spans_col`` (see ``SPANS``):
    disjoint, in order, in characters from 0. A token that crosses a border is given to one section by
    ``rule`` (see ``allot``), so the counts of tiling sections add up to the document's. Tokens outside all
    spans are counted in a row with section -1, if there are any. ``crossing`` counts the tokens given to the
    section that reach over one of its borders.

    Columns: ``id_col``, ``section``, ``start``, ``stop``, ``tokens``, ``crossing``. A null or empty text is one
    empty line without tokens; null spans are no spans. Repeated rows give rows each. It is one narrow pass:
    no text moves, and only the two or three named columns are read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    columns = [F.col(id_col).alias("id"), F.col(text_col).alias("text")]
    if spans_col:
        columns.append(F.col(spans_col).cast(SPANS).alias("spans"))
    rows = docs.select(*columns)

    def run(batches):
        encode, sizes = byte_bpe(json_path, ranks_path), _token_bytes(json_path)
        for batch in batches:
            at, parts = [], [[] for _ in range(5)]
            given = batch.column("spans").to_pylist() if spans_col else None
            for i, text in enumerate(batch.column("text").to_pylist()):
                text = text or ""
                if given is None:
                    start, stop = line_spans(text)
                    names = np.arange(len(start))
                else:
                    mine = given[i] or []
                    names = np.array([x["section"] for x in mine], np.int64)
                    start, stop = (np.array([x[k] for x in mine], np.int64) for k in ("start", "stop"))
                owner, crossing = allot(*token_spans(text, encode, sizes), start, stop, rule)
                outside = int((owner < 0).sum())
                counts = np.bincount(owner[owner >= 0], minlength=len(start))
                over = np.bincount(owner[crossing], minlength=len(start))
                if outside:
                    names, start, stop = np.append(names, -1), np.append(start, 0), np.append(stop, len(text))
                    counts, over = np.append(counts, outside), np.append(over, 0)
                at.append(np.full(len(names), i))
                for part, values in zip(parts, (names, start, stop, counts, over)):
                    part.append(values)
            owners = np.concatenate(at) if at else np.zeros(0, np.int64)
            arrays = [np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(owners, pa.int64())), pa.array(arrays[0], pa.int32()), *(pa.array(x, pa.int64()) for x in arrays[1:])],
                names=["id", "section", "start", "stop", "tokens", "crossing"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, section int, start long, stop long, tokens long, crossing long")
    return out.withColumnRenamed("id", id_col)
