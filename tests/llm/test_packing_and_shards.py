import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tests.llm.helpers import awkward, shown
from tokenizers import Tokenizer

from trailmark.llm import packing, shards
from trailmark.llm.common import byte_bpe, vocabulary


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(vocabulary()["json_path"])


def test_fast_encoder_equals_the_tokenizer_file(plain):
    encode = byte_bpe(**vocabulary())
    rng = random.Random(3)
    usual = [chr(c) for c in range(1, 0x250)] + list("  \n\t'sdmtllvere0123") * 8 + list("‐–—‘’“”•…")
    texts = ["".join(rng.choice(usual) for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    texts += ["it's  we'll\n\n x  ", "  ", "\n \n", "a<|endoftext|>b", "日本語 テスト", "😀😀", "̀é", "１２ 三"]
    for text in texts:
        assert encode(text) == plain.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("longest", [1, 8, 2048])
def test_pieces_round_trip(spark, plain, longest):
    docs = awkward(spark)
    rows = shown(packing.pack(docs, **vocabulary(), longest=longest))
    given = defaultdict(list)
    for r in shown(docs):
        given[r["doc_id"]].append([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 1])
    pieces = defaultdict(list)
    for r in rows:
        assert r["length"] == 1 << r["bucket"] == len(r["tokens"]) <= longest and r["offset"] == 0
        assert r["ids_crc32"] == zlib.crc32(np.array(r["tokens"], "<u4").tobytes())
        pieces[r["doc_id"]].append(r)
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    assert set(pieces) == set(given)
    for key, mine in pieces.items():
        expected = sorted(sum(given[key], []))
        assert sorted(t for r in mine for t in r["tokens"]) == expected
        if len(given[key]) == 1:
            mine.sort(key=lambda r: r["start"])
            assert [t for r in mine for t in r["tokens"]] == given[key][0]
            assert all(a["start"] + a["length"] == b["start"] for a, b in zip(mine, mine[1:]))


def test_piece_lengths():
    assert packing.piece_lengths(5000, 2048) == [2048, 2048, 512, 256, 128, 8]
    with pytest.raises(ValueError):
        packing.pack(None, json_path="", longest=3)


def test_buckets_are_files_by_length(spark, tmp_path):
    pieces = packing.pack(awkward(spark), **vocabulary(), longest=8)
    packing.write_buckets(pieces, str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.count() == pieces.count() and {r["bucket"] for r in shown(back)} <= {0, 1, 2, 3}


def expected_shards(rows, n):
    size = lambda r: len((r["text"] or "").encode()) + 1
    total, end, out = sum(map(size, rows)), 0, []
    for r in rows:
        end += size(r)
        out.append((r["doc_id"], size(r), min(n - 1, (2 * end - size(r)) * n // (2 * total))))
    return out


@pytest.mark.parametrize("n", [1, 3, 8])
def test_shards_equal_running_sums(spark, n):
    docs = awkward(spark).where("doc_id is null or doc_id <> 0").union(awkward(spark).where("doc_id = 0").limit(1))
    rows = sorted(shown(docs), key=lambda r: -1 if r["doc_id"] is None else r["doc_id"])
    got = shown(shards.balanced_shards(docs, n))
    assert len(got) == len(rows)
    named = [x for x in expected_shards(rows, n) if x[0] is not None]
    # The two null ids may stand in either order; all later rows have the same sums.
    assert sorted((r["doc_id"], r["size"], r["shard"]) for r in got if r["doc_id"] is not None) == sorted(named)
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r["shard"]].append(r)
    for mine in by_shard.values():
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
    crc = {(r["doc_id"], r["text_crc32"]) for r in got}
    assert crc == {(r["doc_id"], zlib.crc32((r["text"] or "").encode())) for r in rows}


def test_one_id_on_all_rows_is_spread(spark):
    docs = spark.range(4000).selectExpr("cast(7 as long) doc_id", "cast(id % 50 as string) text")
    got = shown(shards.balanced_shards(docs, 8))
    sizes = defaultdict(int)
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 6


def test_shards_of_nothing_and_files(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert shown(shards.balanced_shards(empty, 8)) == []
    docs = spark.range(100).selectExpr("id doc_id", "repeat('x', cast(id as int)) text")
    placed = shards.balanced_shards(docs, 4)
    shards.write_shards(docs, placed, str(tmp_path / "s"))
    back = {r["doc_id"]: r["shard"] for r in shown(spark.read.parquet(str(tmp_path / "s")))}
    assert back == {r["doc_id"]: r["shard"] for r in shown(placed)}
