"""Near-duplicate groups by HyperMinHash sketches, banding and exact confirmation."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmark.llm.common import Staging, fresh, may_match, partitions
from trailmark.llm.graph import components
from trailmark.llm.words import U, grams, mix, words

REGISTERS = 256  # a power of two, chosen by the top bits of a shingle's hash
MANTISSA = 10  # bits kept behind the leading one
BAND = 6  # registers a band; 42 bands
BLOCK = 512
# Expected share of equal registers of unrelated sets, from the paper's constant for HyperMinHash.
COLLISIONS = 0.169919487159739 * 2.0 ** (1 - MANTISSA)
KEYS = ["rep", "sized", "bi", "bj"]  # of a block pair


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """The set of ``width``-word shingle hashes, sorted; a shorter text is one shingle."""
    if not len(hashes):
        return hashes
    return np.unique(grams(hashes, min(width, len(hashes)))) if len(hashes) >= width else grams(hashes, len(hashes))


def sketch(values: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """Registers of a sorted set: leading zeros plus one above the mantissa bits of the bucket's least hash; 0 is empty."""
    top_bits = registers.bit_length() - 1
    bucket = (values >> U(64 - top_bits)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    rest = (values[first] << U(top_bits)) | U(registers - 1)
    top = rest
    zeros = np.zeros(len(rest), np.int64)
    for bits in (32, 16, 8, 4, 2, 1):
        empty = top < (U(1) << U(64 - bits))
        zeros[empty] += bits
        top = np.where(empty, top << U(bits), top)
    mantissa = (top << U(1)) >> U(64 - MANTISSA)
    out = np.zeros(registers, np.uint16)
    out[bucket[first]] = ((zeros + 1) << MANTISSA) | mantissa.astype(np.int64)
    return out


@lru_cache(maxsize=2)
def _orders(registers: int) -> np.ndarray:
    """For each place (column) a fixed order of all registers (rows): sort keys that end in the register's number."""
    keys = (mix(np.arange(registers * registers, dtype=U)) >> U(32)).astype(np.uint32).reshape(registers, registers)
    return keys // registers * registers + np.arange(registers, dtype=np.uint32)[:, None]


def borrowed(registers: np.ndarray) -> np.ndarray:
    """Registers with their places; an empty one takes the filled one that comes first in its own order.

    Two sketches then agree in each place with the share of filled registers they agree in, also where a small set
    fills few of them.
    """
    source, empty = np.arange(len(registers)), registers == 0
    if empty.any() and not empty.all():
        first = _orders(len(registers))[np.flatnonzero(registers)].min(0)
        source[empty] = first[empty] % len(registers)
    return source.astype(U) << U(16) | registers[source].astype(U)


def bands(registers: np.ndarray, band: int = BAND, borrow: bool = False) -> np.ndarray:
    """One hash per band that has a register set, or of borrowed registers per band."""
    count = len(registers) // band
    if borrow:
        registers = borrowed(registers)
    table = registers[: count * band].reshape(count, band).astype(U)
    key = np.arange(count, dtype=U) + U(1)
    for i in range(band):
        key = mix(key + table[:, i] * U(0x9E3779B97F4A7C15))
    return key[table.any(1)]


def similarity_bound(equal: np.ndarray, union: np.ndarray) -> np.ndarray:
    """Upper end (five standard deviations at 0.8) of the collision-corrected Jaccard estimate."""
    union = np.maximum(union, 1)
    return (equal / union - COLLISIONS) / (1 - COLLISIONS) + 5 * np.sqrt(0.16 / union)


def _similar(common, a, b, percent: int):
    return 100 * common >= percent * (a + b - common)


def _signed(docs: DataFrame, id_col: str, text_col: str, width: int, registers: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            k1, k2, sizes, sketches = [], [], [], []
            for _, hashes, _, _ in words(batch.column("text"), "space"):
                values = shingles(hashes, width)
                a, b = identity(values)
                k1.append(a)
                k2.append(b)
                sizes.append(len(values))
                sketches.append(sketch(values, registers).tobytes() if len(values) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("text_hash"), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())],
                names=["id", "text_hash", "k1", "k2", "n", "sketch"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, text_hash long, k1 long, k2 long, n long, sketch binary")


def identity(values: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set: two sums of differently mixed hashes, as signed longs."""
    with np.errstate(over="ignore"):
        a = mix(values).sum(dtype=U)
        b = mix(values ^ U(0xD6E8FEB86659FD93)).sum(dtype=U)
    return int(a.view(np.int64)), int(b.view(np.int64))


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(cls, values) of the wanted classes from one of their documents; a repeated id's other texts are passed over."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = may_match(rows, ["id"], wanted.select("first"), "asked").where("asked").join(wanted, F.col("id").eqNullSafe(F.col("first")))

    def run(batches):
        for batch in batches:
            keep, sets = [], []
            expected = list(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist()))
            for i, hashes, _, _ in words(batch.column("text"), "space"):
                values = shingles(hashes, width)
                if len(values) and identity(values) == expected[i]:
                    keep.append(i)
                    sets.append(values.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("cls").take(pa.array(keep, pa.int64())), pa.array(sets, pa.binary())], names=["cls", "values"])

    return rows.select("cls", "text", "k1", "k2").mapInArrow(run, "cls long, values binary").dropDuplicates(["cls"])


def _runs(batches, keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal keys from sorted batches; a run may go on in the next batch."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != current:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            current = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _binaries(column) -> list[memoryview | bytes]:
    return column.to_pylist()


def _estimated(batches, percent: int, registers: int):
    """Of each block pair, the rows that may be similar to a row of another component, by their sketches."""
    out, waiting = [], 0
    for table in _runs(batches, KEYS):
        block, comp, n, home = (table.column(c).to_numpy() for c in ("block", "comp", "n", "home"))
        bi, bj = table.column("bi")[0].as_py(), table.column("bj")[0].as_py()
        left, right = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
        if not len(left) or not len(right):
            continue
        regs = np.frombuffer(b"".join(_binaries(table.column("sketch"))), np.uint16).reshape(-1, registers)
        r, filled = regs[right], (regs[right] > 0).astype(np.float32)
        possible = np.zeros(table.num_rows, bool)
        for at in range(0, len(left), 16):
            rows = left[at : at + 16]
            a = regs[rows]
            small, large = np.minimum(n[rows][:, None], n[right]), np.maximum(n[rows][:, None], n[right])
            open_ = (comp[rows][:, None] != comp[right]) & (home[rows][:, None] | home[right]) & (100 * small >= percent * large)
            if not open_.any():
                continue
            equal = ((a[:, None, :] == r) & (a[:, None, :] > 0)).sum(2)
            mine = (a > 0).astype(np.float32)
            union = mine.sum(1)[:, None] + filled.sum(1) - mine @ filled.T
            open_ &= similarity_bound(equal, union) * 100 >= percent
            possible[rows] |= open_.any(1)
            possible[right] |= open_.any(0)
        if possible.any():
            out.append(table.drop_columns(["sketch"]).filter(pa.array(possible)))
            waiting += out[-1].num_rows
        if waiting > 5000:
            yield from pa.concat_tables(out).combine_chunks().to_batches()
            out, waiting = [], 0
    if out:
        yield from pa.concat_tables(out).combine_chunks().to_batches()


def _confirmed(batches, percent: int, tokens: int = 1 << 20):
    """Links between components of each block pair, by the full sets, as pairs of components.

    The right side is looked at in parts of about ``tokens`` shingles, which bounds the work memory.
    """
    for table in _runs(batches, KEYS):
        block, comp, n, home = (table.column(c).to_numpy() for c in ("block", "comp", "n", "home"))
        bi, bj = table.column("bi")[0].as_py(), table.column("bj")[0].as_py()
        left, right = np.flatnonzero(block == bi), np.flatnonzero(block == bj)
        values = [np.frombuffer(x.as_buffer(), U) for x in table.column("values").chunk(0)]
        found: set[tuple[int, int]] = set()
        a, b = [], []
        part = (np.cumsum(n[right]) - n[right]) // tokens
        for chunk in np.unique(part):
            those = right[part == chunk]
            universe, index = np.unique(np.concatenate([values[j] for j in those]), return_inverse=True)
            starts = np.cumsum(n[those]) - n[those]
            mark = np.zeros(len(universe), bool)
            for i in left:
                open_ = (comp[those] != comp[i]) & (home[i] | home[those])
                if not open_.any():
                    continue
                at = np.minimum(np.searchsorted(universe, values[i]), len(universe) - 1)
                at = at[universe[at] == values[i]]
                mark[at] = True
                common = np.add.reduceat(mark[index], starts, dtype=np.int64)
                mark[at] = False
                for j in those[open_ & _similar(common, n[i], n[those], percent)]:
                    pair = (int(comp[i]), int(comp[j]))
                    if pair not in found:
                        found.add(pair)
                        a.append(pair[0])
                        b.append(pair[1])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def near_duplicates(
    docs: DataFrame,
    *,
    width: int = 5,
    percent: int = 80,
    registers: int = REGISTERS,
    band: int = BAND,
    borrow: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Each document's set size and the smallest id it is linked to, directly or through others.

    Words are runs of anything but 0x20 and 0x09-0x0D, with A-Z lower-cased; a document's set holds its
    distinct ``width``-word shingles (64-bit hashes), or its whole word sequence if it has fewer words. Two
    documents are linked if 100 * common >= ``percent`` * union.

    1. Equal sets become one class, before anything is compared.
    2. Each class has a HyperMinHash sketch: ``registers`` of leading zeros and 10 mantissa bits. Bands of
       ``band`` registers bring classes together. With 256 and 6, a pair at a similarity of 0.8 shares none of
       42 bands three times in a million, one at 0.85 twice in 10^9. With ``borrow``, empty registers borrow filled ones
       for banding (not for the estimate), so that short texts with one line in common don't meet in bands that are
       empty otherwise; with 512 and 7 a pair at 0.8 shares none of 73 bands about twice in a million.
    3. Each band's bucket is led by its class that meets most others over all bands. All members are compared with
       their leader only, which is linear: first by the collision-corrected estimate, then by full sets. Components
       follow from these links.
    4. Members that share a leader, are of like size and still in different components are compared with
       one another in blocks of about 512 classes, without rows for pairs: sketches rule out, full sets
       confirm. Blocks inside the largest component of a group are left out, as nothing can change there.

    No bucket is capped. Work in step 4 grows with a group's members outside its main component times its
    members. The estimate's margin is five standard deviations, so it costs a true link once in millions.

    Columns: ``id_col``, ``n_shingles``, ``component_id``, ``kept`` (the id is the component's), ``text_hash``. Documents
    without words have no shingles and stay alone. Repeated rows share a class and each give a row. A null id
    never names a component unless all ids of it are null; such rows are kept. Other columns are not read.
    """
    staging = Staging(docs.sparkSession)
    parts = partitions(docs.sparkSession)
    signed = staging.keep(_signed(docs, id_col, text_col, width, registers), "signed")
    classes = (
        signed.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("id").alias("first"), F.max("sketch").alias("sketch"))
        .withColumn("cls", F.monotonically_increasing_id())
    )
    classes = staging.keep(classes, "classes")

    def banded(batches):
        for batch in batches:
            found = [bands(np.frombuffer(x, np.uint16), band, borrow) for x in _binaries(batch.column("sketch"))]
            owner = np.repeat(batch.column("cls").to_numpy(), [len(x) for x in found])
            keys = np.concatenate(found) if found else np.zeros(0, U)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(owner, pa.int64())], names=["band", "cls"])

    rows = classes.select("cls", "sketch").mapInArrow(banded, "band long, cls long")
    rows = staging.keep(rows, "bands")
    buckets = staging.keep(rows.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    rows = may_match(rows, ["band"], buckets.select("band"), "shared").where("shared").select("band", "cls")
    # A leader is the class that meets most others over all its bands: near copies of one text then have one leader in
    # nearly all buckets, not one for each of the least classes.
    # Set sizes join where the rows meet by class anyway, and go along from there.
    met = F.sum("size").over(Window.partitionBy("cls"))
    shared = rows.join(buckets, "band").select("band", "cls", met.alias("met")).join(classes.select("cls", "n"), "cls")
    shared = staging.keep(shared, "shared")
    leaders = shared.groupBy("band").agg(F.max(F.struct("met", "cls", "n")).alias("top"))
    leaders = leaders.select("band", F.col("top.cls").alias("rep"), F.col("top.n").alias("rep_n"))
    members = shared.join(leaders, "band").where("cls <> rep").select("rep", "cls", "rep_n", "n").distinct()
    members = staging.keep(members, "members")
    staging.drop("bands", "buckets", "shared")

    # Step 3: every member against its bucket's leader.
    pairs = members.where(F.lit(100) * F.least("n", "rep_n") >= F.lit(percent) * F.greatest("n", "rep_n"))
    sketches = classes.select("cls", "sketch")
    pairs = pairs.join(sketches.toDF("rep", "rep_sketch"), "rep").join(sketches, "cls")

    def likely(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(_binaries(batch.column(c))), np.uint16).reshape(-1, registers) for c in ("rep_sketch", "sketch"))
            equal, union = ((x == y) & (x > 0)).sum(1), ((x > 0) | (y > 0)).sum(1)
            yield batch.filter(pa.array(similarity_bound(equal, union) * 100 >= percent)).select(["rep", "cls", "rep_n", "n"])

    pairs = staging.keep(pairs.select("rep", "cls", "rep_n", "n", "rep_sketch", "sketch").mapInArrow(likely, "rep long, cls long, rep_n long, n long"), "pairs")
    names = classes.select("cls", "first", "k1", "k2")
    wanted = pairs.select("cls").union(pairs.select("rep")).distinct()
    wanted = staging.keep(names.join(wanted, "cls"), "wanted")
    sets = staging.keep(_sets(docs, wanted, id_col, text_col, width), "sets")

    def linked(batches):
        for batch in batches:
            hit = [
                _similar(len(np.intersect1d(np.frombuffer(x, U), np.frombuffer(y, U), assume_unique=True)), p, q, percent)
                for x, y, p, q in zip(*(batch.column(c).to_pylist() for c in ("rep_values", "values", "rep_n", "n")))
            ]
            yield batch.filter(pa.array(hit, pa.bool_())).select(["rep", "cls"])

    both = pairs.join(sets.toDF("rep", "rep_values"), "rep").join(sets, "cls")
    links = staging.keep(both.mapInArrow(linked, "rep long, cls long").toDF("a", "b"), "links")
    comps, stars = components(links, staging, "star")

    # Step 4: members of one group in different components. Sizes a link allows lie in one class of sizes or in
    # neighbouring ones; each member is at home in its class and a guest in the next.
    step = math.log(100 / percent) * 1.0001
    sized = F.floor(F.log("n") / step).cast("int")
    known = (
        members.join(comps.toDF("cls", "component"), "cls", "left")
        .select("rep", "cls", "n", F.coalesce("component", "cls").alias("comp"), F.explode(F.array(sized, sized + 1)).alias("sized"))
        .withColumn("home", F.col("sized") == sized)
    )
    counted = known.groupBy("rep", "sized", "comp").agg(F.count(F.lit(1)).alias("members"), F.count_if("home").alias("homes"))
    groups = counted.groupBy("rep", "sized").agg(
        F.max(F.struct("members", "comp")).alias("major"), F.sum("members").alias("all"), F.count(F.lit(1)).alias("comps"), F.sum("homes").alias("homes")
    ).where("comps > 1 and homes > 0")
    groups = groups.select(
        "rep", "sized", F.col("major.comp").alias("major"),
        F.ceil((F.col("all") - F.col("major.members")) / BLOCK).cast("int").alias("minors"),
        F.ceil(F.col("major.members") / BLOCK).cast("int").alias("majors"),
    )
    placed = known.join(groups, ["rep", "sized"]).withColumn("is_minor", F.col("comp") != F.col("major"))
    spot = F.xxhash64("cls")
    placed = placed.withColumn("block", F.when(F.col("is_minor"), F.pmod(spot, "minors")).otherwise(F.col("minors") + F.pmod(spot, "majors")).cast("int"))
    # A minor block meets every block, a major block the minor ones.
    last = F.when(F.col("is_minor"), F.col("minors") + F.col("majors")).otherwise(F.col("minors")) - 1
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), last))).select(
        *("rep", "sized"), F.least("block", "other").cast("int").alias("bi"), F.greatest("block", "other").cast("int").alias("bj"),
        *("cls", "comp", "block", "n", "home"),
    )
    shape = "rep long, sized int, bi int, bj int, cls long, comp long, block int, n long, home boolean"
    possible = (
        placed.join(sketches, "cls").select(*KEYS, "cls", "comp", "block", "n", "home", "sketch")
        .repartition(parts, *KEYS).sortWithinPartitions(*KEYS)
        .mapInArrow(lambda b: _estimated(b, percent, registers), shape)
    )
    possible = staging.keep(possible, "possible")
    more = possible.select("cls").distinct().join(sets, "cls", "left_anti")
    more = staging.keep(names.join(more, "cls"), "wanted")
    more = staging.keep(_sets(docs, more, id_col, text_col, width), "more-sets")
    confirmed = (
        possible.join(sets.union(more), "cls").repartition(parts, *KEYS).sortWithinPartitions(*KEYS)
        .mapInArrow(lambda b: _confirmed(b, percent), "a long, b long")
    )
    # The components found so far stand for their links.
    links = staging.keep(comps.toDF("a", "b").union(confirmed), "all-links")
    comps, _ = components(links, staging, "all")
    comps = comps.toDF("cls", "component")
    staging.drop("members", "wanted", "pairs", "sets", "more-sets", "possible", "links", "all-links", stars)

    whole = classes.select("cls", "first", "k1", "k2", "n").join(comps, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = whole.groupBy("component").agg(F.min("first").alias("component_id"))
    named = whole.join(least, "component").select("k1", "k2", "n", "component_id")
    out = signed.select("id", "text_hash", "k1", "k2", "n").join(named, ["k1", "k2", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"), "text_hash",
    )


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each group, all its columns: the one with the smallest id.

    A document is its id and text; where one that stays is repeated, one of its rows does. Only the keys of
    what goes (and of what is repeated) are written, and only texts that may be among them are joined.
    """
    staging = Staging(docs.sparkSession)
    its, hashed, kept, rows, asked = fresh(docs, "_id", "_hash", "_kept", "_rows", "_asked")
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    found = found.groupBy(F.col(id_col).alias(its), F.col("text_hash").alias(hashed), F.col("kept").alias(kept)).agg(F.count(F.lit(1)).alias(rows))
    listed = staging.keep(found.where(~F.col(kept) | (F.col(rows) > 1)), "listed")
    marked = may_match(docs, [F.col(id_col)], listed.select(its), asked)
    once = marked.where(~F.col(asked)).drop(asked)
    marked = marked.where(asked).drop(asked).withColumn(hashed, F.xxhash64(text_col))
    same = marked[id_col].eqNullSafe(F.col(its)) & (marked[hashed] == F.col(f"{hashed}_of"))
    listed = listed.withColumnRenamed(hashed, f"{hashed}_of")
    alone = marked.join(listed, same, "left_anti").drop(hashed)
    again = marked.join(listed.where(kept), same, "left_semi").dropDuplicates([id_col, hashed]).drop(hashed)
    return once.unionByName(alone).unionByName(again)
