import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from engram.llm import mixing
from engram.llm.common import materialize
from engram.llm.oracle import ORACLES
from engram.llm.queries import QUERIES, TOKENIZER

from .conftest import words
from .test_dedup import brute_groups, brute_lines
from .test_quality import brute_scores


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(name, spark, sf_dir, duck, same):
    same(QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLES[name]).df())


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = total - sum(capped.values())
        free = [s for s in order if s not in capped]
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free} if free else {}
        over = {s: most * sizes[s] for s in free if share[s] > most * sizes[s]}
        if not over:
            return capped | share
        capped |= over


def test_mixing_targets_and_steps(docs, by_id, none, without_ids):
    got = mixing.mix_sources(docs).toPandas()
    again = mixing.mix_sources(docs.repartition(3)).toPandas()
    key = ["doc_id", "copies"]
    assert got.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))
    rows = docs.select("doc_id", "source").toPandas()
    sizes = {}
    for i, s in rows.itertuples(index=False):
        sizes[s] = sizes.get(s, 0) + len(words(by_id[i]))
    want = brute_targets(sizes)
    got = got.merge(rows.drop_duplicates(), on="doc_id")
    assert len(got) == len(rows)
    for s, own in got.groupby("source", dropna=False):
        s = None if s != s or s is None else s
        assert own.target.iloc[0] == pytest.approx(want[s]) and own.source_size.iloc[0] == sizes[s]
        rate = want[s] / max(sizes[s], 1)
        assert abs(own.copies.sum() - rate * len(own)) < 1.001
        assert own.copies.between(int(rate), -(-rate // 1)).all()
    assert (got["size"] == got.doc_id.map(lambda i: len(words(by_id[i])))).all()
    assert (got.taken <= 3 * got["size"]).all()
    assert mixing.mix_sources(none).count() == 0 and mixing.mix_sources(without_ids).count() == 4


@pytest.mark.parametrize("sizes", [[5, 5, 5], [1, 100, 1, 1000], [0, 0], [0, 7], [3, 1, 4, 1, 5, 9, 2, 6], [10**12, 1, 1]])
def test_targets_equal_resharing(spark, sizes):
    own = {f"s{i}" if i else None: n for i, n in enumerate(sizes)}
    df = spark.createDataFrame(list(own.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df, (1, 2, 3)).collect()}
    assert got == pytest.approx(brute_targets(own))


def test_mix_comes_near_target(spark):
    sizes = [1 + (i * 7919) % 400 for i in range(6000)]
    rows = [(i, "w " * n, "a" if i % 3 else f"b{i % 4}") for i, n in enumerate(sizes)]
    found = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in found.groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect():
        assert abs(r.taken - r.target) < 0.02 * r.target


def test_mixed_documents_repeat_rows(docs):
    copies = {(r.doc_id): r.c for r in mixing.mix_sources(docs).groupBy("doc_id").agg(F.sum("copies").alias("c")).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {i: c for i, c in copies.items() if c}


def test_many_sources_in_ranges(spark):
    own = {f"s{i:04d}": (i * 7919) % 1000 for i in range(3000)}
    df = spark.createDataFrame(list(own.items()), "source string, source_size long").repartition(7)
    got = {r.source: r.target for r in mixing.targets(df, (1, 2, 3)).collect()}
    assert got == pytest.approx(brute_targets(own))


def brute_mix(rows, salts=64, seed=0):
    """Copies of each of (doc_id, text, source), row by row: the order, one offset for a source, one copy for each
    integer crossed."""
    digest = lambda x: int(hashlib.md5(f"{seed} {x}".encode()).hexdigest()[:8], 16)
    sizes, order = {}, []
    for i, t, s in rows:
        size = len(words(t))
        sizes[s] = sizes.get(s, 0) + size
        bits = f"{size:b}"
        grade, salt = len(bits) * 16 + int(bits[:4], 2), digest(i) % salts
        order.append((s is None, s or "", 9999 - grade if salt % 2 else grade, salt, -size if salt % 2 else size, i, s))
    wanted, copies, rank = brute_targets(sizes), [], {}
    for *_, i, s in sorted(order):
        rank[s] = r = rank.get(s, 0) + 1
        rate = wanted[s] / sizes[s] if sizes[s] else 0.0
        start = digest(f"offset {'null source' if s is None else s}") / 2**32
        copies.append((i, min(math.floor(start + r * rate) - math.floor(start + (r - 1) * rate), math.ceil(rate))))
    return copies


def brute_tokens(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_pipeline_stages(spark, docs, by_id, labels, tmp_path):
    """Each stage against a brute-force version on what the stage before it kept."""
    from tokenizers import Tokenizer

    sf_dir = str(tmp_path)
    docs.selectExpr("doc_id", "text", "lang", "source", "n_chars", "77 n_lines", "'kept' `a.b`").write.parquet(f"{sf_dir}/documents.parquet")
    labels.write.parquet(f"{sf_dir}/labels.parquet")
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = table.columns, {}
    tokenizer = Tokenizer.from_file(TOKENIZER)
    for name, stage in corpus_pipeline.STAGES:
        before, table = table, materialize(stage(spark, table, sf_dir), "stage")
        kept[name] = table.toPandas()
        rows = before.collect()
        texts = {r.doc_id: r.text for r in rows}
        if name != "packing":
            assert table.columns == columns
            assert set(kept[name].n_lines) == {77} and set(kept[name]["a.b"]) == {"kept"}
        if name == "quality classifier":
            scores = brute_scores([tuple(r) for r in before.select("doc_id", "text", "source", "lang").collect()], labels.collect())
            assert min(abs(s[-1] - 0.5) for s in scores) > 1e-3
            assert sorted(kept[name].doc_id) == sorted(s[0] for s in scores if s[-1] >= 0.5)
        elif name == "line dedup":
            assert dict(zip(kept[name].doc_id, kept[name].text, strict=True)) == {i: t for i, (_, _, t) in brute_lines(texts).items()}
            assert (kept[name].n_chars == kept[name].text.map(len)).all() and len(kept[name]) == len(rows)
        elif name == "n-gram Jaccard join":
            assert set(kept[name].doc_id) == {i for i, (_, c) in brute_groups(texts).items() if i == c}
        elif name == "mixing sources to target weights":
            want = Counter()
            for i, n in brute_mix([(r.doc_id, r.text, r.source) for r in rows]):
                want[i] += n
            assert Counter(kept[name].doc_id) == +want
        else:
            pieces = kept[name]
            want = Counter()
            for r in rows:
                ids = brute_tokens(tokenizer, r.text)
                for at in range(0, len(ids), 4096):
                    part = np.array(ids[at : at + 4096], "<u4")
                    want[r.doc_id, at, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
            assert Counter(zip(pieces.doc_id, pieces.start, pieces.length, pieces.ids_crc32, pieces.doc_tokens, strict=True)) == want
            for _, own in pieces.sort_values("offset").groupby("sequence_id"):
                assert list(own.offset) == [0, *own.length.cumsum().iloc[:-1]] and own.length.sum() <= 4096
    assert corpus_pipeline.run(spark, sf_dir).count() == len(kept["packing"])
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline_without_rows(spark, none, labels, tmp_path):
    none.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
