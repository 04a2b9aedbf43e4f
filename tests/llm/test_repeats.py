import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from tests.llm.helpers import awkward, prose, shown

from trailmark.llm import suffixes


def brute(rows, length, keep):
    """(id, n_bytes, n_removed, n_spans, sha256 of the rest) by looking at every window."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = defaultdict(list)
    for n, (i, b) in enumerate(texts):
        for s in range(len(b) - length + 1):
            seen[b[s : s + length]].append((n, s))
    out = []
    for n, (i, b) in enumerate(texts):
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            places = seen[b[s : s + length]]
            first = min(places, key=lambda p: (-1 if texts[p[0]][0] is None else texts[p[0]][0], p))
            if len(places) > 1 and (keep == "none" or first != (n, s)):
                gone[s : s + length] = True
        rest = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def found(frame):
    return sorted(
        ((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in shown(frame)), key=str
    )


@pytest.mark.parametrize("length", [10, 40, 400])
@pytest.mark.parametrize("keep", ["none", "first"])
def test_awkward_documents(spark, length, keep):
    docs = awkward(spark).coalesce(1)
    rows = [(r["doc_id"], r["text"]) for r in shown(docs)]
    assert found(suffixes.remove_repeats(docs, length=length, keep=keep)) == brute(rows, length, keep)


@pytest.mark.parametrize("seed", range(3))
def test_overlapping_passages(spark, seed):
    rng = random.Random(seed)
    passages = [prose(100 + k, rng.randrange(5, 40)) for k in range(6)]
    rows = []
    for i in range(40):
        parts = [rng.choice(passages)[rng.randrange(20) :] if rng.random() < 0.6 else prose(1000 * seed + 50 * i + k, 12) for k in range(5)]
        rows.append((i, "|".join(parts) + "ab" * rng.randrange(60)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    for keep in ("none", "first"):
        assert found(suffixes.remove_repeats(docs, length=50, keep=keep)) == brute(rows, 50, keep)


def test_parts_of_long_texts_agree_with_one_pass(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PART", 64)
    raw = np.frombuffer((prose(9, 300) + prose(9, 300)).encode(), np.uint8)
    first, last, anchor = suffixes.anchors(raw, 50, 31)
    assert first[0] == 0 and last[-1] == len(raw) - 50 and (first[1:] == last[:-1] + 1).all()
    starts = np.arange(0, len(raw) - 50, 3)
    parted = suffixes.window_hashes(raw, starts, 50)
    monkeypatch.setattr(suffixes, "PART", 1 << 18)
    assert (parted == suffixes.window_hashes(raw, starts, 50)).all()


def test_kept_text_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "x" * 5 + "abcdefghij" + "y"), (2, "abcdefghij" + "z" * 3)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in shown(suffixes.remove_repeats(docs, length=10, keep="none"))}
    assert bytes(rows[1]["kept"]) == b"xxxxxy" and bytes(rows[2]["kept"]) == b"zzz" and rows[1]["starts"] == [5]
    assert shown(suffixes.remove_repeats(docs.limit(0), length=10)) == []


def passage_words(rows, length):
    """Words in runs of ``length`` words found elsewhere too, by looking at every run."""
    texts = [(i, [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]) for i, t in rows]
    seen = defaultdict(int)
    for _, w in texts:
        for s in range(len(w) - length + 1):
            seen[tuple(w[s : s + length])] += 1
    out = []
    for i, w in texts:
        inside = np.zeros(len(w), bool)
        for s in range(len(w) - length + 1):
            if seen[tuple(w[s : s + length])] > 1:
                inside[s : s + length] = True
        out.append((i, int(inside.sum())))
    return sorted(out, key=str)


def test_passages_shorter_than_the_removed_length(spark):
    docs = awkward(spark)
    passage = prose(55, 14)
    more = [(100 + i, prose(200 + i, 30) + (" " + passage.upper() if i % 2 else "\n" + passage) + "\t" + prose(300 + i, 9), "en", "s", 1) for i in range(6)]
    docs = docs.unionByName(awkward(spark, more + [(200, prose(400, 60), "en", "s", 1)]))
    rows = [(r["doc_id"], r["text"]) for r in shown(docs)]
    got = shown(suffixes.remove_repeats(docs, length=400, keep="none", passage=12))
    want = passage_words(rows, 12)
    assert sorted(((r["doc_id"], r["n_passage_words"]) for r in got), key=str) == want
    assert {i for i, n in want if n and i is not None and i >= 100} == set(range(100, 106))
    assert sorted(found(suffixes.remove_repeats(docs, length=400, keep="none")), key=str) == found(suffixes.remove_repeats(docs, length=400, keep="none", passage=12))
