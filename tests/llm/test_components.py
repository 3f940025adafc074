import builtins

from engram.llm import common


def test_components_close_whatever_the_rounds(spark, monkeypatch):
    monkeypatch.setattr(common, "range", lambda *a: builtins.range(min(a[0], 1)) if len(a) == 1 else builtins.range(*a), raising=False)
    common.prepare(spark)
    chain = spark.createDataFrame([(i, i + 1) for i in builtins.range(40)], "a long, b long")
    found = {r.node: r.component for r in common.components(chain).collect()}
    assert found == dict.fromkeys(builtins.range(1, 41), 0) | ({0: 0} if 0 in found else {})
