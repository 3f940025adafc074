import itertools
import math
import random

from pyspark.sql import functions as F

from engram.config import from_toml
from engram.functions import segment, text
from engram.session import Engine

#: Own words for the tests.
WORDS = {"所有权": 50, "所有": 200, "权": 20, "借用": 60, "检查": 90, "编译期": 10, "编译": 80, "保证": 100, "内存": 90, "安全": 120, "内存安全": 5, "索引": 40, "结构": 70}


def test_cuts_are_the_best_of_all():
    rng = random.Random(2)
    letters = "甲乙丙丁"
    words = {"".join(p): rng.randint(1, 50) for n in (1, 2, 3) for p in itertools.product(letters, repeat=n) if rng.random() < 0.4}
    total = sum(words.values())
    weight = lambda w: math.log(words[w] / total) if w in words else -math.log(total) - 1 if len(w) == 1 else -math.inf
    cut = segment.segmenter(words)
    for _ in range(60):
        run = "".join(rng.choice(letters) for _ in range(rng.randint(1, 8)))
        ways = []
        for marks in itertools.product((0, 1), repeat=len(run) - 1):
            ends = [i + 1 for i, m in enumerate(marks) if m] + [len(run)]
            ways.append([run[a:b] for a, b in zip([0, *ends], ends)])
        got = cut(run)
        assert "".join(got) == run
        assert math.isclose(sum(map(weight, got)), max(sum(map(weight, w)) for w in ways))


def test_tokens_by_dictionary(spark):
    how = text.Extraction(dictionary=WORDS)
    rows = spark.createDataFrame([("Rust 的所有权与借用检查在编译期保证 99.5% 内存安全",), ("Plain WORDS stay here",), (None,), ("",)], "a string")
    found = [r[0] for r in rows.select(text.tokens(F.col("a"), how)).collect()]
    assert found == [["rust", "所有权", "借用", "检查", "编译期", "保证", "99.5%", "内存", "安全"], ["plain", "words", "stay"], None, []]


def test_keywords_of_a_store_with_a_dictionary(spark, tmp_path):
    lines = [f"{w} {n} n" for w, n in WORDS.items()]
    (tmp_path / "words.txt").write_text("# own words\n" + "\n".join(lines) + "\n", encoding="utf-8")
    config = from_toml(f"[tokenizer]\ndictionary_file = '{tmp_path}/words.txt'\n")
    assert config.extraction.dictionary == WORDS
    s = Engine(spark, f"file://{tmp_path}/store", config).session()
    s.sql("INSERT INTO memories (content) VALUES ('Rust 的所有权与借用检查在编译期保证内存安全')")
    s.sql("INSERT INTO memories (content) VALUES ('MySQL 使用 B+ 树作为索引结构')")
    ids = lambda q: [r.id for r in s.sql(q).rows.collect()]
    assert ids("SELECT id FROM memories WHERE keyword = '所有权'") == [1]
    assert ids("SEARCH '索引 结构'") == [2] and ids("SEARCH '借用检查'") == [1]
