"""Alignment of two tokenizers: which of their tokens share bytes, and which lie in one group between common borders."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.common import Staging, byte_bpe

BITS = 20  # of a token id in a packed pair
KNOWN = 400_000  # segments whose alignment a task remembers
SLICE = 1 << 20  # characters looked at together
BLOCK = 1 << 20  # bytes or links of one matrix product


# -- sparse matrices of ones in compressed rows: (row pointers, columns) --


def incidence(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens by bytes: consecutive tokens of these lengths, each with a one at its bytes."""
    pointers = np.concatenate([[0], np.cumsum(lengths)])
    return pointers, np.arange(pointers[-1])


def transpose(pointers: np.ndarray, columns: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    rows = np.repeat(np.arange(len(pointers) - 1), np.diff(pointers))
    counts = np.bincount(columns, minlength=width)
    return np.concatenate([[0], np.cumsum(counts)]), rows[np.argsort(columns, kind="stable")]


def row_products(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gustavson's product of two matrices: (row, column, value) of its entries in row order.

    Row i of the product is the sum of those rows of ``b`` that the columns of row i of ``a`` name. ``width`` is the
    number of columns of ``b``.
    """
    taken = np.diff(b[0])[a[1]]
    rows = np.repeat(np.repeat(np.arange(len(a[0]) - 1), np.diff(a[0])), taken)
    at = np.repeat(b[0][:-1][a[1]] - (np.cumsum(taken) - taken), taken) + np.arange(taken.sum())
    entries = rows * width + b[1][at]
    if len(entries) and (np.diff(entries) < 0).any():
        entries.sort()
    first = np.flatnonzero(np.diff(entries, prepend=-1))
    values = np.diff(np.append(first, len(entries)))
    return entries[first] // max(width, 1), entries[first] % max(width, 1), values


# -- the two tokenizers --


def _byte_level() -> dict[str, int]:
    """The public byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Pair:
    """Both tokenizers with the bytes of their entries.

    ``cuts`` tells whether texts can be cut before a blank that follows a letter or sign: no token of either
    tokenizer has a blank behind anything else, so tokens end there whatever the text. It is read off the files.
    """

    def __init__(self, json_path: str, model_path: str, ranks_path: str | None = None):
        import sentencepiece

        self.a = byte_bpe(json_path, ranks_path, special=False)
        self.b = sentencepiece.SentencePieceProcessor(model_file=model_path)
        with open(json_path, encoding="utf-8") as file:
            spec = json.load(file)
        alphabet = _byte_level()
        self.a_bytes = [b""] * (max(spec["model"]["vocab"].values()) + 1)
        for entry, i in spec["model"]["vocab"].items():
            self.a_bytes[i] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
        pieces = [self.b.IdToPiece(i) for i in range(self.b.GetPieceSize())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.IsByte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        split = spec.get("pre_tokenizer") or {}
        self.cuts = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not any(re.search("[^▁]▁", p) for p in pieces)
        self.blank = self.b.PieceToId("▁")

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Both tokenizers' ids of each text with a blank before it."""
        return [self.a(" " + text) for text in texts], [ids or [self.blank] for ids in self.b.encode(texts, num_threads=1)]

    def segments(self, text: str) -> list[str]:
        """The parts of blank + ``text`` between cuts, each without its first blank."""
        if not self.cuts:
            return [text]
        if text[:1] == " " or "  " in text or _BEFORE_BLANK.search(text):
            return [part[1:] for part in _CUT.split(" " + text)]
        return text.split(" ")


_BEFORE_BLANK = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")


class _Index(dict):
    """Numbers for segments in order of first sight."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        self.fresh.append(key)
        return number


class Aligner:
    """Alignments of segments, worked out once each and remembered up to ``KNOWN`` segments."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.lengths = [np.array([len(x) for x in table], np.int64) for table in (pair.a_bytes, pair.b_bytes)]
        sizes = [len(x) for x in self.lengths]
        self.signs = [f"{i}{mark}" for n, marks in zip(sizes, (",|", ",;\n")) for mark in marks for i in range(n)]
        self.base = np.cumsum([0, sizes[0], sizes[0], sizes[1], sizes[1]])
        self.reset()

    def reset(self) -> None:
        self.index = _Index()
        self.text: list[str] = []  # the groups
        self.good = np.zeros(0, bool)
        self.counts = np.zeros((0, 5), np.int64)  # a, b, groups, links, shared
        self.ends = np.zeros(1, np.int64)
        self.links = np.zeros(0, np.int64)

    def numbers(self, text: str) -> np.ndarray:
        parts = self.pair.segments(text)
        return np.fromiter(map(self.index.__getitem__, parts), np.int64, len(parts))

    def encode(self, keys: list[str]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        """Both tokenizers' ids; none, and False, where they don't give back the text."""
        a, b = self.pair.encode(keys)
        good = np.ones(len(keys), bool)
        given = lambda ids, table: b"".join([table[t] for t in ids])
        whole = "".join([" " + k for k in keys]).encode()
        if not all(given(chain.from_iterable(ids), table) == whole for ids, table in ((a, self.pair.a_bytes), (b, self.pair.b_bytes))):
            for i, key in enumerate(keys):
                want = (" " + key).encode()
                good[i] = given(a[i], self.pair.a_bytes) == want == given(b[i], self.pair.b_bytes)
                if not good[i]:
                    a[i], b[i] = [], []
        return a, b, good

    def learn(self) -> None:
        """Align the segments met since the last call: one block-diagonal product for all of them, cut into bounded blocks."""
        keys, self.index.fresh = self.index.fresh, []
        at = 0
        while at < len(keys):
            upto, size = at, 0
            while upto < len(keys) and (upto == at or size + len(keys[upto]) < BLOCK):
                size += len(keys[upto])
                upto += 1
            self._learn(keys[at:upto])
            at = upto

    def _learn(self, keys: list[str]) -> None:
        a, b, good = self.encode(keys)
        n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (a, b))
        ids_a, ids_b = (np.fromiter(chain.from_iterable(side), np.int64, n.sum()) for side, n in ((a, n_a), (b, n_b)))
        owner_a, owner_b = np.repeat(np.arange(len(keys)), n_a), np.repeat(np.arange(len(keys)), n_b)
        lengths = self.lengths[0][ids_a], self.lengths[1][ids_b]
        borders, group_a, group_b = groups(*lengths)
        rows, columns = overlap(lengths, borders, group_a, group_b)
        links = owner_a[rows]
        per_group = np.bincount(group_a, minlength=len(borders)), np.bincount(group_b, minlength=len(borders))
        own = owner_a[np.flatnonzero(np.diff(group_a, prepend=-1))]
        count = lambda x, w=None: np.bincount(x, w, minlength=len(keys)).astype(np.int64)
        self.good = np.append(self.good, good)
        self.counts = np.concatenate([self.counts, np.column_stack([n_a, n_b, count(own), count(links), count(own, per_group[0] * per_group[1])])])
        self.ends = np.append(self.ends, self.ends[-1] + np.cumsum(count(links)))
        self.links = np.append(self.links, ids_a[rows] << BITS | ids_b[columns])
        # One string for all groups: a group's A tokens, then its B tokens; a line per segment.
        last_a = np.append(np.diff(group_a) > 0, True)[: len(ids_a)]
        last_b = np.append(np.diff(group_b) > 0, True)[: len(ids_b)]
        last_of_key = np.append(np.diff(owner_b) > 0, True)[: len(ids_b)]
        order = np.empty(len(ids_a) + len(ids_b), np.int64)
        before_b = np.concatenate([[0], np.cumsum(per_group[1])])[:-1]
        order[np.arange(len(ids_a)) + before_b[group_a]] = self.base[last_a.astype(int)] + ids_a
        order[np.arange(len(ids_b)) + np.cumsum(per_group[0])[group_b]] = self.base[2 + last_b + last_of_key] + ids_b
        lines = iter("".join([self.signs[i] for i in order.tolist()]).split("\n"))
        self.text += [next(lines) if n else "" for n in n_b]


def groups(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From the byte lengths of both token rows: the offsets where tokens of both end, and each token's group."""
    ends_a, ends_b = np.cumsum(a), np.cumsum(b)
    both = np.intersect1d(ends_a, ends_b, assume_unique=True)
    return both, np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)


def overlap(lengths, borders, group_a, group_b) -> tuple[np.ndarray, np.ndarray]:
    """The A and B tokens that share bytes, as rows and columns of A x B transposed over bytes.

    Tokens of different groups share none, so the product is made in blocks of whole groups, about ``BLOCK`` bytes each.
    """
    rows, columns = [], []
    at = 0
    while at < len(borders):
        start = borders[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(borders, start + BLOCK, "right")))
        a0, a1 = np.searchsorted(group_a, [at, upto])
        b0, b1 = np.searchsorted(group_b, [at, upto])
        size = int(borders[upto - 1] - start)
        r, c, _ = row_products(incidence(lengths[0][a0:a1]), transpose(*incidence(lengths[1][b0:b1]), size), b1 - b0)
        rows.append(r + a0)
        columns.append(c + b0)
        at = upto
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(rows), join(columns)


def shared(group_a, group_b, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """The A and B tokens of the groups ``first`` to ``last - 1``, paired within each: group incidences multiplied."""
    a0, a1 = np.searchsorted(group_a, [first, last])
    b0, b1 = np.searchsorted(group_b, [first, last])
    mine = np.arange(a1 - a0 + 1), group_a[a0:a1] - first
    theirs = transpose(np.arange(b1 - b0 + 1), group_b[b0:b1] - first, last - first)
    r, c, _ = row_products(mine, theirs, b1 - b0)
    return r + a0, c + b0


# -- Spark --


def _counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with how often they occur."""
    if weights is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    counts = np.diff(np.append(first, len(keys))) if weights is None else np.add.reduceat(weights, first) if len(first) else weights
    return keys[first], counts


def _histogram(known: Aligner, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed id pairs linked in the given segments, and their numbers of links; a bounded part at a time."""
    found = []
    sizes = known.ends[segments + 1] - known.ends[segments]
    part = (np.cumsum(sizes) - sizes) // BLOCK
    for piece in np.split(np.arange(len(segments)), np.flatnonzero(np.diff(part)) + 1):
        own, n = segments[piece], sizes[piece]
        at = np.repeat(known.ends[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        found.append(_counted(known.links[at]))
    if len(found) == 1:
        return found[0]
    return _counted(*(np.concatenate(x) for x in zip(*found)))


def alignments(
    docs: DataFrame, *, json_path: str, model_path: str, ranks_path: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row its numbers of tokens, groups and links, and its links as distinct id pairs.

    Tokenizer A (``json_path``, byte-level; ``ranks_path`` is the same vocabulary for a faster encoder) gets a blank and the
    whole text, B (``model_path``, pieces) the text. Strings of special tokens are plain text. A's entries are
    bytes by the byte-level alphabet, B's are UTF-8 with U+2581 as blank and ``<0xHH>`` as that byte. Texts that are
    null or empty, and those whose tokens don't give back the blank and the text, have no tokens.

    Offsets where tokens of both end cut them into groups. The links are the entries of A x B transposed over
    bytes, both token-by-byte incidence matrices in compressed rows; ``n_shared`` counts the entries of the same
    product over groups (``token_links`` lists either).

    Tokens never reach over a blank that follows something else. Texts are cut there, and each distinct segment is
    encoded and multiplied once while a task remembers it; a test compares with whole texts. Where a vocabulary
    doesn't allow that, the whole text is one segment.

    Columns: ``row`` (unique), ``id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_shared``, ``groups_sha256`` (of ``a1,a2|b1;a3|b2``:
    decimal ids; '' without tokens), ``links`` (array of ``a``, ``b``, ``n``). One narrow pass; repeated rows each give
    a row, a null id stays null, other columns are not read.
    """
    pairs = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])

    def slices(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, size = 0, 0
            lengths = batch.column("size").to_pylist()
            for i, n in enumerate(lengths):
                if i > start and size + n > SLICE:
                    yield batch.slice(start, i - start)
                    start, size = i, 0
                size += n
            if start < batch.num_rows:
                yield batch.slice(start)

    def run(batches):
        known = Aligner(Pair(json_path, model_path, ranks_path))
        row = TaskContext.get().partitionId() << 33
        for batch in slices(batches):
            if len(known.index) > KNOWN:
                known.reset()
            texts = batch.column("text")
            segments = [known.numbers(t.as_py()) if t.is_valid and len(t.as_py()) else np.zeros(0, np.int64) for t in texts]
            known.learn()
            totals, hashes, keys, counts, ends = np.zeros((len(texts), 5), np.int64), [], [], [], [0]
            for i, own in enumerate(segments):
                if not len(own) or not known.good[own].all():
                    hashes.append("")
                    ends.append(ends[-1])
                    continue
                totals[i] = known.counts[own].sum(0)
                sha = hashlib.sha256()
                for at in range(0, len(own), 100_000):
                    sha.update((";" * (at > 0) + ";".join([known.text[s] for s in own[at : at + 100_000].tolist()])).encode())
                hashes.append(sha.hexdigest())
                k, n = _histogram(known, own)
                keys.append(k)
                counts.append(n)
                ends.append(ends[-1] + len(k))
            k, n = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, counts))
            fields = [pa.array((k >> BITS).astype("i4")), pa.array((k & ((1 << BITS) - 1)).astype("i4")), pa.array(n.astype("i8"))]
            links = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(pairs)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(texts))), batch.column("id"), *(pa.array(x) for x in totals.T.copy()), pa.array(hashes, pa.string()), links],
                names=["row", "id", "n_a", "n_b", "n_groups", "n_links", "n_shared", "groups_sha256", "links"],
            )
            row += len(texts)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.length(text_col), F.lit(0)).alias("size"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        run,
        f"row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, n_shared long, groups_sha256 string, links array<struct<a:int,b:int,n:bigint>>",
    )


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, count, best): links of each id pair in all rows, and whether no pair of that B id has more; added up before the shuffle."""
    counts = aligned.select(F.inline("links")).groupBy("a", "b").agg(F.sum("n").alias("count"))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def scored(docs: DataFrame, *, common: int = 200_000, id_col: str = "doc_id", **options) -> DataFrame:
    """``alignments`` of each row with two sums over its links, by how often their id pairs are linked in the corpus.

    ``n_best`` counts links whose pair is the most frequent one of its B id, ties included; ``count_sum`` adds up the
    pairs' counts. The ``common`` most frequent pairs are broadcast, which bounds that table whatever the corpus; rows'
    other pairs meet the whole table in a shuffled join. Both are exact. Columns: ``id_col``, the counts and ``groups_sha256``.
    """
    staging = Staging(docs.sparkSession)
    aligned = staging.keep(alignments(docs, id_col=id_col, **options), "aligned")
    counts = staging.keep(pair_counts(aligned), "counts")
    top = counts.orderBy(F.desc("count"), "a", "b").limit(common)
    met = aligned.select("row", F.inline("links")).join(F.broadcast(top), ["a", "b"], "left")
    sums = [F.sum(F.when(F.col("best"), F.col("n"))).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum")]
    found = met.groupBy("row").agg(*sums)
    if counts.count() > common:
        others = met.where(F.col("count").isNull()).select("row", "a", "b", "n").join(counts, ["a", "b"])
        found = found.unionByName(others.groupBy("row").agg(*sums)).groupBy("row").agg(*(F.sum(c).alias(c) for c in ("n_best", "count_sum")))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    names = ("n_a", "n_b", "n_groups", "n_links")
    return aligned.drop("links").join(found, "row", "left").select(
        F.col("id").alias(id_col), *names, zero("n_best"), zero("count_sum"), "groups_sha256", "n_shared"
    )


def token_links(
    docs: DataFrame, *, json_path: str, model_path: str, ranks_path: str | None = None, over: str = "bytes", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per link: the numbers and ids of an A and a B token that share bytes, or (``over="groups"``) a group.

    Columns: ``id_col``, ``a_at``, ``b_at`` (from 0), ``a``, ``b``, ``a_start``, ``b_start`` (bytes, the added blank is byte 0). Texts
    without tokens by ``alignments`` give no rows. Products are made over blocks of groups, so work memory is one
    text's tokens and one block's links.
    """
    if over not in ("bytes", "groups"):
        raise ValueError("over must be bytes or groups")
    names = ("a_at", "b_at", "a", "b", "a_start", "b_start")

    def run(batches):
        known = Aligner(Pair(json_path, model_path, ranks_path))
        for batch in batches:
            for i, text in enumerate(batch.column("text")):
                text = text.as_py()
                if not text:
                    continue
                (a,), (b,), good = known.encode([text])
                if not good[0]:
                    continue
                ids = np.array(a, np.int64), np.array(b, np.int64)
                lengths = known.lengths[0][ids[0]], known.lengths[1][ids[1]]
                borders, group_a, group_b = groups(*lengths)
                starts = [np.cumsum(x) - x for x in lengths]
                pairs = np.cumsum(np.bincount(group_a) * np.bincount(group_b))
                at = 0
                while at < len(borders):
                    upto = max(at + 1, int(np.searchsorted(pairs, (pairs[at - 1] if at else 0) + BLOCK, "right")))
                    if over == "groups":
                        r, c = shared(group_a, group_b, at, upto)
                    else:
                        inside = [slice(*np.searchsorted(g, [at, upto])) for g in (group_a, group_b)]
                        r, c = overlap([x[s] for x, s in zip(lengths, inside)], borders[at:upto] - (borders[at - 1] if at else 0), *(g[s] - at for g, s in zip((group_a, group_b), inside)))
                        r, c = r + inside[0].start, c + inside[1].start
                    for x in range(0, len(r), 100_000):
                        y, z = r[x : x + 100_000], c[x : x + 100_000]
                        columns = (y, z, ids[0][y], ids[1][z], starts[0][y], starts[1][z])
                        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array([i] * len(y), pa.int64())), *(pa.array(v) for v in columns)], names=["id", *names])
                    at = upto

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shape = T.StructType([T.StructField("id", rows.schema["id"].dataType), *(T.StructField(n, T.LongType()) for n in names)])
    return rows.mapInArrow(run, shape).select(F.col("id").alias(id_col), *names)
