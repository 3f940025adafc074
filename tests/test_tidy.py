"""Writes to a store leave no shuffle files behind, and a load moves only what it must."""

import re
import time

from pyspark.sql import functions as F

from engram.sources.store import CLEANUP, Store


def shuffled(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {found.apply(i).name() for i in range(found.size()) if found.apply(i).isShuffle()}


def rows(spark, n):
    return spark.range(n).select(
        F.concat(F.lit("words of row "), F.col("id").cast("string")).alias("content"), F.lit("s").alias("source"), F.lit(0.5).cast("float").alias("importance"), F.array(F.lit("t")).alias("tags"), F.col("id").alias("created_at")
    )


def test_writes_leave_no_shuffle_files(spark, tmp_path):
    old, before = spark.conf.get(CLEANUP), shuffled(spark)
    store = Store(spark, f"file://{tmp_path}/s")
    v, _, n = store.append(store.current, "main", rows(spark, 300))
    v, gone = store.rewrite(v, "main", F.col("id") <= 7, None)
    for _ in range(50):  # files are deleted soon after a query, not by it
        if not (left := shuffled(spark) - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(CLEANUP) == old
    assert (n, gone) == (300, 7) and [r.id for r in store.read(v).select("id").orderBy("id").collect()] == list(range(8, 301))
    assert store.index(v).tf.where("id <= 7").count() == 0 and store.index(v).tf.select("id").distinct().count() == 293


def test_a_load_moves_texts_for_terms_but_no_terms(spark, tmp_path, monkeypatch):
    moves, save = {}, Store._save

    def counted(self, df, *rest):
        plan = df._jdf.queryExecution().executedPlan().toString()
        moves.setdefault(tuple(df.columns), len(re.findall(r"Exchange hashpartitioning\((?!range)", plan)))
        return save(self, df, *rest)

    monkeypatch.setattr(Store, "_save", counted)
    store = Store(spark, f"file://{tmp_path}/s")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store.append(store.current, "main", rows(spark, 50))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    terms = next(n for c, n in moves.items() if "tf" in c)
    assert terms == 1
