import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from engram.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("size", [4096, 64])
def test_pieces_hold_all_ids_once(docs, by_id, size):
    tokenizer = packing.coder(PATH).tokenizer
    got = packing.pack_documents(docs, PATH, size).toPandas()
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in by_id.items()}
    for i, own in got.drop_duplicates(["doc_id", "start"]).groupby("doc_id"):
        own = own.sort_values("start")
        assert (own.doc_tokens == len(ids[i])).all() and own.length.sum() == len(ids[i])
        assert own.start.tolist() == [0, *own.length.cumsum()[:-1]]
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[i][r.start : r.start + r.length].tobytes())
    assert set(got.doc_id) == set(by_id)
    repeated = got[got.doc_id == 16]
    assert len(repeated) == 3 * repeated.start.nunique()
    packs = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (packs.length.cumsum() - got.sort_values(["sequence_id", "offset"]).length == got.sort_values(["sequence_id", "offset"]).offset).all()
    assert packs.length.sum().max() <= size and set(got.sequence_id) == set(range(got.sequence_id.max() + 1))


def test_no_rows(none):
    assert packing.pack_documents(none, PATH).count() == 0


def test_hot_length_spreads_and_ranks_are_whole(spark):
    pieces = spark.range(3000).selectExpr("id doc_id", "0L start", "IF(id % 3 = 0, 100L, 40L) length")
    got = packing.pack(pieces, 256).toPandas()
    packs = got.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert len(got) == 3000 and packs.length.sum().max() <= 256
    assert (packs.offset.max() < 256).all() and got.groupby(["sequence_id", "offset"]).size().max() == 1
    assert got.length.sum() / (256 * len(packs)) > 0.85


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=12))
def test_patterns_equal_placing_one_by_one(histogram):
    runs, packs = packing.shortest_pack_first(histogram, 50)
    fill = [0] * packs
    for length in sorted(histogram, reverse=True):
        assert sum(n for n, _, _ in runs[length]) == histogram[length]
        for n, first, offset in runs[length]:
            for k in range(first, first + n):
                assert fill[k] == offset
                fill[k] += length
    slow: list[int] = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            k = min(range(len(slow)), key=slow.__getitem__, default=None)
            if k is None or slow[k] + length > 50:
                slow.append(length)
            else:
                slow[k] += length
    assert sorted(fill) == sorted(slow) and max(fill, default=0) <= 50


def test_odd_texts_tokenize_as_whole():
    k = packing.coder(PATH)
    for x in ["İstanbul ǅ Σίσυφος ΣΑΣ don't it's 'S a<|endoftext|>b", "x\x1cy nb\xa0em é é ﬁ क़ \U0001f600 a.b,c!d 12ab3", "", " \n ", "a" * 5000, "K Å ß ẞ ŉ"]:
        assert np.frombuffer(k(x.encode()), "<u4").tolist() == k.tokenizer.encode(x, add_special_tokens=False).ids


def test_release_deletes_own_tables(spark, none):
    from engram.llm import common

    table = common.materialize(none.select("doc_id"), "to-go")
    path = common._TABLES.pop()
    kept, common._TABLES[:] = common._TABLES[:], [path]
    common.release(spark)
    common._TABLES[:] = kept
    assert table.schema == none.select("doc_id").schema
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)
