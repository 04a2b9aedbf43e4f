"""Tokenizer alignment against whole texts encoded at once and links found byte by byte."""

import collections
import hashlib
import json
from bisect import bisect_left

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.helpers import awkward, prose, shown
from trailmark.llm import align
from trailmark.llm.common import pieces, vocabulary
from trailmark.llm.queries import op13_alignment

PATHS = {**vocabulary(), **pieces()}
A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=PATHS["model_path"])


def alphabet():
    """The byte-level alphabet by its published rule, written once more."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = iter(range(256, 512))
    return {chr(b) if b in shown else chr(next(hidden)): b for b in range(256)}


with open(PATHS["json_path"], encoding="utf-8") as file:
    VOCAB = {i: entry for entry, i in json.load(file)["model"]["vocab"].items()}
SIGNS = alphabet()


def token_bytes(text):
    """[(id, bytes)] of both tokenizers over the whole text, or None where they don't give it back."""
    if not text:
        return None
    a = [(i, bytes(SIGNS[c] for c in VOCAB[i])) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(B.IdToPiece(i)[3:5], 16)]) if B.IsByte(i) else B.IdToPiece(i).replace("▁", " ").encode()) for i in B.encode(text)]
    whole = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else None


def spans(tokens):
    at = 0
    for _, x in tokens:
        yield at, at + len(x)
        at += len(x)


def plain(text):
    """(a ids, b ids, groups text, links, shared links), byte by byte."""
    found = token_bytes(text)
    if found is None:
        return [], [], "", [], []
    a, b = found
    spans_a, spans_b = list(spans(a)), list(spans(b))
    ends = sorted({e for _, e in spans_a} & {e for _, e in spans_b})
    inside = [[[] for _ in ends] for _ in range(2)]
    for side, ranges in zip(inside, (spans_a, spans_b)):
        for i, (_, stop) in enumerate(ranges):
            side[bisect_left(ends, stop)].append(i)
    text = ";".join(",".join(str(a[i][0]) for i in x) + "|" + ",".join(str(b[j][0]) for j in y) for x, y in zip(*inside))
    owners = [[i for i, (p, q) in enumerate(ranges) for _ in range(p, q)] for ranges in (spans_a, spans_b)]
    links = sorted(set(zip(*owners)))
    together = [(i, j) for x, y in zip(*inside) for i in x for j in y]
    return [i for i, _ in a], [i for i, _ in b], text, links, together


def expected(texts):
    """{key: (n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_shared)} over a corpus."""
    found = {k: plain(t) for k, t in texts.items()}
    counts = collections.Counter((a[i], b[j]) for a, b, _, links, _ in found.values() for i, j in links)
    most = collections.Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = {}
    for k, (a, b, text, links, together) in found.items():
        pairs = [(a[i], b[j]) for i, j in links]
        out[k] = (
            len(a), len(b), text.count(";") + 1 if a else 0, len(links), sum(counts[p] == most[p[1]] for p in pairs), sum(counts[p] for p in pairs),
            hashlib.sha256(text.encode()).hexdigest() if a else "", len(together),
        )
    return out


def rows_of(frame):
    return [tuple(r) for r in frame.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_shared").collect()]


PARTS = ["the ", " the", " ", "  ", "\n", "\n\n ", "\t", "word", "wor", "Ünï", "日本語", "😀", "▁", "\x00", "\x1c", "\x85", " ", "　", "<s>", "</s>", "<unk>", "<0x0A>", "<|endoftext|>", "'s", "123", " 4", "...", " !", "é", "​", "a" * 20, "́"]


@pytest.fixture(scope="module")
def pair():
    return align.Pair(**PATHS)


def test_cuts_are_read_off_the_files(pair):
    assert pair.cuts


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.lists(st.sampled_from(PARTS), max_size=14).map("".join), st.text(max_size=30)))
def test_segments_encode_as_the_whole_text(text):
    pair = align.Pair(**PATHS) if not hasattr(test_segments_encode_as_the_whole_text, "pair") else test_segments_encode_as_the_whole_text.pair
    test_segments_encode_as_the_whole_text.pair = pair
    if not text:
        return
    assert "".join(" " + s for s in pair.segments(text)) == " " + text
    found = token_bytes(text)
    a, b, good = align.Aligner(pair).encode(pair.segments(text))
    assert good.all() == (found is not None)
    if found:
        assert [sum(a, []), sum(b, [])] == [[i for i, _ in side] for side in found]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=4, unique=True), max_size=5), st.lists(st.lists(st.integers(0, 6), max_size=4, unique=True), min_size=6, max_size=6))
def test_row_products(a, b):
    csr = lambda rows: (np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(int), np.array([x for r in rows for x in r], int))
    dense = lambda rows, n: np.array([[x in r for x in range(n)] for r in rows], int).reshape(len(rows), n)
    rows, columns, values = align.row_products(csr(a), csr(b), 7)
    want = dense(a, 6) @ dense(b, 7)
    assert list(zip(rows, columns, values)) == [(i, j, want[i, j]) for i in range(len(a)) for j in range(7) if want[i, j]]
    turned = align.transpose(*csr(a), 6)
    assert (dense([turned[1][turned[0][i] : turned[0][i + 1]].tolist() for i in range(6)], len(a)) == dense(a, 6).T).all()


def test_awkward_rows(spark, monkeypatch):
    docs = awkward(spark)
    rows = shown(docs.select("doc_id", "text"))
    want = expected({i: r["text"] for i, r in enumerate(rows)})
    every = sorted(((r["doc_id"], *want[i]) for i, r in enumerate(rows)), key=repr)
    for common in (200_000, 7):
        assert sorted(rows_of(align.scored(docs, **PATHS, common=common)), key=repr) == every
    assert rows_of(align.scored(docs.where("1 = 0"), **PATHS)) == []


def test_bounded_blocks_give_the_same(pair, monkeypatch):
    texts = [prose(9, 300), "x" * 500 + " " + "日" * 200, "the " * 400]
    known = align.Aligner(pair)
    own = [known.numbers(t) for t in texts]
    known.learn()
    monkeypatch.setattr(align, "BLOCK", 64)
    small = align.Aligner(pair)
    assert all((small.numbers(t) == s).all() for t, s in zip(texts, own))
    small.learn()
    assert small.text == known.text and (small.counts == known.counts).all()
    assert all(np.array_equal(np.sort(small.links[a:b]), np.sort(known.links[a:b])) for a, b in zip(known.ends, known.ends[1:]))
    for s in own:
        found = align._histogram(small, s)
        monkeypatch.undo()
        assert all(np.array_equal(x, y) for x, y in zip(found, align._histogram(known, s)))
        monkeypatch.setattr(align, "BLOCK", 64)


def test_token_links(spark):
    texts = [prose(3, 30), None, "", "日本語 tokenisation's\n\nend ", "a▁b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for over, which in (("bytes", 3), ("groups", 4)):
        got = sorted((r["doc_id"], r["a_at"], r["b_at"], r["a"], r["b"]) for r in shown(align.token_links(docs, **PATHS, over=over)))
        want = []
        for k, t in enumerate(texts):
            found = plain(t)
            want += [(k, i, j, found[0][i], found[1][j]) for i, j in found[which]]
        assert got == want
    with pytest.raises(ValueError):
        align.token_links(docs, **PATHS, over="words")


def test_query(spark):
    """Counts over the whole table; links by spans for every document."""
    sf_dir = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in shown(spark.read.parquet(f"{sf_dir}/documents.parquet"))}
    short = {k: t for k, t in texts.items() if len(t or "") < 3000}
    got = {r[0]: r[1:] for r in rows_of(op13_alignment(spark, sf_dir))}
    assert set(got) == set(texts)
    for k, t in short.items():
        a, b, text, links, together = plain(t)
        assert got[k][:2] == (len(a), len(b)) and got[k][3] == len(links) and got[k][7] == len(together)
        assert got[k][6] == (hashlib.sha256(text.encode()).hexdigest() if a else "")
    docs = spark.createDataFrame(list(short.items()), "doc_id long, text string")
    want = expected(short)
    assert {r[0]: r[1:] for r in rows_of(align.scored(docs, **PATHS))} == want
