import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, id string, n_lines long, `row` string, grp long, length long, keep_id long"


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def corpus():
    """Texts with copies, near copies at all distances, shared passages and lines, and odd cases."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(800)] + ["Naïve", "straße", "ÀÉ", "中文字"]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, line = " ".join(some(30)), "A common line that many share"
    texts = [" ".join(some(rng.randint(1, 120))) for _ in range(60)]
    base = some(60)
    for _ in range(70):  # near copies, from one changed word to many
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    texts += [f"{' '.join(some(25))}\n{passage}\n{line}" for _ in range(20)]
    texts += [f"  {line.upper()}\t\n{' '.join(some(8))}\n{line}" for _ in range(10)]
    texts += [texts[3]] * 25 + [texts[4].replace(" ", "\n \t")] * 2 + [passage] * 3
    texts += ["", " \n\t ", None, "one", "ONE", "a b c d", "x " * 60, "y z " * 40, "p q r s t " * 30, "same line here now\n" * 12, " ".join(some(6000)), "\x1c odd\x85spaces\xa0here " * 8]
    return texts


def edge_rows(texts):
    langs, sources = ["en", "de", None], ["s1", "s2", "s3", None, ""]
    rows = [(i * 3 + 1, t, langs[i % 3], sources[0 if i % 3 else i % 5], None if t is None else len(t), i, f"x{i}", 7, "r", -i, None, 1) for i, t in enumerate(texts)]
    return [*rows, rows[5], rows[5]]  # rows that repeat


@pytest.fixture(scope="session")
def texts():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(edge_rows(texts), SCHEMA).repartition(5, "id").cache()


@pytest.fixture(scope="session")
def by_id(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def labels(spark, by_id):
    rows = [(i, 0 if i % 5 == 0 else 1, 1 if "w7 " in (t or "") else 0) for i, t in by_id.items()]
    return spark.createDataFrame([*rows, (None, 1, 0), (10**9, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def without_ids(spark):
    """Rows whose id, or everything, is null, among others."""
    rows = [(None, "one two three four five six\nA line with a length", None, None), (None, None, None, None), (4, "one two three four five six\nA line with a length", "en", "s"), (4, "other text of the same id", "en", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
