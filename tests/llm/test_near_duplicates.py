import random
import re

import numpy as np
import pytest
from tests.llm.helpers import WORDS, awkward, prose, shown

from trailmark.llm import hyperminhash as H
from trailmark.llm.words import U


def shingle_set(text, width):
    lowered = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(rows, width, percent):
    sets = [shingle_set(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        r = find(i)
        if key is not None and (r not in least or key < least[r]):
            least[r] = key
    return sorted(
        ((key, len(sets[i]), least.get(find(i)) if sets[i] else key) for i, (key, _) in enumerate(rows)), key=str
    )


def found(frame):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in shown(frame)), key=str)


@pytest.mark.parametrize("width", [2, 5])
def test_awkward_documents(spark, width):
    docs = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in shown(docs)]
    got = H.near_duplicates(docs, width=width)
    assert found(got) == brute(rows, width, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in shown(got))


def edited(rng, words, share):
    return [rng.choice(WORDS) + str(rng.randrange(10**6)) if rng.random() < share else w for w in words]


@pytest.mark.parametrize("seed, sketch", [(0, {}), (1, {"registers": 512, "band": 7, "borrow": True}), (2, {"borrow": True})])
def test_groups_around_the_threshold(spark, seed, sketch, monkeypatch):
    monkeypatch.setattr(H, "BLOCK", 16)  # several blocks a group
    rng = random.Random(seed)
    rows = []
    for g in range(4):
        base = prose(seed * 10 + g, 200).split()
        for share in (0.0, 0.01, 0.03, 0.05, 0.08):
            rows += [(" ".join(edited(rng, base, share))) for _ in range(12)]
    rows += [prose(500 + i, 150) for i in range(60)]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(H.near_duplicates(docs, width=2, **sketch)) == brute(rows, 2, 80)


def test_short_texts_with_borrowed_registers(spark):
    """Texts of a few words, many with one line in common: all links at the threshold, and hardly any other bucket."""
    rng = random.Random(6)
    line = prose(77, 12)
    rows = []
    for i in range(150):
        words = prose(1000 + i, rng.randrange(8, 45)).split() + (line.split() if i % 2 else [])
        rows.append(" ".join(words))
        if i % 3 == 0:
            rows.append(" ".join(edited(rng, words, 0.04)))
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(H.near_duplicates(docs, width=2, registers=512, band=7, borrow=True)) == brute(rows, 2, 80)


def test_near_copies_have_few_leaders(spark, monkeypatch):
    """Copies of one text with random edits meet in many buckets; nearly all of those have the same leader."""
    rng = random.Random(8)
    base = prose(91, 200).split()
    rows = list(enumerate(" ".join(edited(rng, base, rng.choice((0.01, 0.02, 0.03)))) for _ in range(300)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made, keep = {}, H.Staging.keep

    def counted(self, frame, name):
        table = keep(self, frame, name)
        if name in ("members", "possible"):
            made[name] = table.count()
        return table

    monkeypatch.setattr(H.Staging, "keep", counted)
    assert found(H.near_duplicates(docs, width=5, registers=512, band=7, borrow=True)) == brute(rows, 5, 80)
    assert made["members"] < 8 * len(rows) and made["possible"] < 8 * len(rows), made


def test_borrowed_registers_agree_as_the_sets_do():
    rng = np.random.default_rng(2)
    values = lambda n: rng.permutation(rng.integers(0, 1 << 63, n, dtype=np.int64).astype(U) * U(2))
    for common, rest in ((8, 1), (40, 5), (400, 50), (12, 60)):
        equal = []
        for _ in range(300):
            both = values(common)
            x, y = (H.borrowed(H.sketch(np.sort(np.concatenate([both, values(rest)])), 512)) for _ in range(2))
            equal.append((x == y).mean())
        assert abs(np.mean(equal) - common / (common + 2 * rest)) < 0.03
    lone = [H.bands(H.sketch(np.sort(np.concatenate([both[:3], values(20)])), 512), 7, True) for _ in range(60)]
    assert len(np.unique(np.concatenate(lone))) > 0.99 * sum(map(len, lone))
    assert not H.borrowed(np.zeros(64, np.uint16)).view(np.uint16).reshape(-1, 4)[:, 0].any()


def test_estimate_stays_near_the_truth():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.8, 0.95):
        common = rng.integers(0, 1 << 63, 2000, dtype=np.int64).astype(U) * U(2)
        rest = int(1000 * (1 - share) / share)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, rest, dtype=np.int64).astype(U) * U(2)])) for _ in range(2))
        x, y = H.sketch(a), H.sketch(b)
        equal, union = ((x == y) & (x > 0)).sum(), ((x > 0) | (y > 0)).sum()
        bound = H.similarity_bound(np.array([equal]), np.array([union]))[0]
        true = len(common) / (len(common) + 2 * rest)
        assert true <= bound <= true + 0.27


def test_deduplicate_keeps_one_of_each_group(spark):
    docs = awkward(spark)
    rows = [(r["doc_id"], r["text"]) for r in shown(docs)]
    kept = shown(H.deduplicate(docs, width=5))
    expected = {x[0] for x in brute(rows, 5, 80) if x[0] == x[2]}
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(map(str, expected))
    assert set(kept[0]) == set(docs.columns)


def test_empty_table(spark):
    empty = awkward(spark).limit(0)
    assert shown(H.near_duplicates(empty)) == [] and shown(H.deduplicate(empty)) == []


@pytest.fixture
def wide(spark):
    """A session with many shuffle partitions that AQE doesn't join up again."""
    new = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in new}
    for key, value in new.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.set(key, value)


def tasks(spark, group):
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return sum(x.numCompletedTasks for s in stages if (x := tracker.getStageInfo(s)))


def test_components_take_two_shuffles_a_round(wide):
    rng = random.Random(9)
    links = [(0, i) for i in range(1, 200)] + [(i, 5) for i in range(200, 260)] + [(i, i + 1) for i in range(1000, 1040)]
    links += [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(150)] + [(3000, 3000)]
    links = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in links + links[:50]]
    rng.shuffle(links)
    parent = {x: x for a, b in links if a != b for x in (a, b)}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            low, high = sorted((find(a), find(b)))
            parent[high] = low
    staging, made = H.Staging(wide), []
    keep = staging.keep
    staging.keep = lambda frame, name: (made.append(name), keep(frame, name))[1]
    wide.sparkContext.setJobGroup("components", "")
    found = H.components(wide.createDataFrame(links, "a long, b long").coalesce(4), staging, "test")
    wide.sparkContext.setJobGroup("", "")
    found = found[0] if isinstance(found, tuple) else found
    assert sorted(map(tuple, found.collect())) == sorted((x, find(x)) for x in parent)
    assert tasks(wide, "components") < 170 * len(made)


def test_near_duplicates_on_many_partitions(wide):
    """What a shuffle costs by its partitions alone is paid few times."""
    rng = random.Random(10)
    base = prose(92, 150).split()
    rows = list(enumerate([" ".join(edited(rng, base, rng.choice((0.0, 0.02, 0.06)))) for _ in range(80)] + [prose(600 + i, 80) for i in range(40)]))
    docs = wide.createDataFrame(rows, "doc_id long, text string").coalesce(4)
    wide.sparkContext.setJobGroup("near", "")
    got = found(H.near_duplicates(docs, width=2))
    wide.sparkContext.setJobGroup("", "")
    assert got == brute(rows, 2, 80)
    assert tasks(wide, "near") < 2000
