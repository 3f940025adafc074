import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from engram.llm import common, exact_dedup, jaccard, line_dedup, substring_dedup

from .conftest import lower, words


def brute_groups(texts, percent=75, k=5):
    sets = {}
    for i, t in texts.items():
        w = words(lower(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    both = Counter((a, b) for h in holders.values() for a in h for b in h if a < b)
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("setting", [{}, {"MEMBERS": 300, "ASK": 200, "FREQUENT": 3, "FLUSH": 500}, {"FREQUENT": 2, "HOT_LEVELS": 1, "SALTS": 3, "bits_for": lambda total: 22}])
def test_jaccard_equals_brute_force(docs, by_id, setting, monkeypatch):
    for name, value in setting.items():
        monkeypatch.setattr(common if name == "bits_for" else jaccard, name, value)
    got = jaccard.similar_groups(docs).collect()
    want = brute_groups(by_id)
    assert len(got) == len(by_id) + 2
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len({c for _, c in want.values()}) < len(want) - 50  # there are groups


def test_jaccard_near_the_threshold(spark):
    rng = random.Random(1)
    texts, k = {}, 0
    for _ in range(25):
        base = [f"t{rng.randrange(10**6)}" for _ in range(rng.randint(8, 70))]
        for _ in range(6):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = f"t{rng.randrange(10**6)}"
            texts[k], k = " ".join(w), k + 1
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(df).collect()} == brute_groups(texts)


def family(core, own, n, seed):
    """n texts of the same core words, each with further words of its own."""
    rng = random.Random(seed)
    shared = [f"c{rng.randrange(10**6)}" for _ in range(core)]
    return [" ".join(shared + [f"o{rng.randrange(10**9)}" for _ in range(own)]) for _ in range(n)]


@pytest.mark.parametrize(("core", "own"), [(80, 20), (80, 15), (80, 13), (80, 11)])
def test_families_around_the_threshold(spark, core, own, monkeypatch):
    sent = []
    real = jaccard.verify
    monkeypatch.setattr(jaccard, "verify", lambda texts, members, queries, *rest: sent.append(queries.count()) or real(texts, members, queries, *rest))
    texts = dict(enumerate(family(core, own, 120, 4)))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_groups(df).collect()} == brute_groups(texts)
    assert sum(sent) <= 4 * len(texts)  # no pairs of all


def test_jaccard_of_rows_that_share_an_id(spark):
    w = [f"t{i}" for i in range(60)]
    a, b, c = " ".join(w[:20]), " ".join(w[20:40]), " ".join(w[40:])
    rows = [(1, a), (5, a), (5, b), (9, b), (9, c + " one"), (11, c), (12, "alone here"), (12, "")]
    got = sorted(tuple(r) for r in jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 16, 1), (5, 16, 1), (5, 16, 1), (9, 16, 1), (9, 17, 1), (11, 16, 1), (12, 0, 12), (12, 1, 12)]


def test_jaccard_without_ids_or_rows(without_ids, none, docs, by_id):
    got = [tuple(r) for r in jaccard.similar_groups(without_ids).collect()]
    assert len(got) == 4 and got.count((None, 0, None)) == 2
    assert jaccard.similar_groups(none).count() == 0
    kept = jaccard.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    want = {i for i, (_, c) in brute_groups(by_id).items() if i == c}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == want


def test_exact_equals_brute_force(docs, by_id, none, without_ids):
    plain = lambda t: "".join(words(t))
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    best, count = {}, Counter()
    for i, t in rows:
        key = plain(t)
        count[key] += 1
        best[key] = min(best.get(key, (1, 0)), (-len(t), i))
    want = sorted((i, best[plain(t)][1], count[plain(t)], i == best[plain(t)][1], hashlib.sha256(plain(t).encode()).hexdigest()) for i, t in rows)
    assert sorted(map(tuple, exact_dedup.exact_groups(docs).collect())) == want
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.exact_groups(without_ids).count() == 4
    assert exact_dedup.drop_exact_copies(docs).columns == docs.columns


def test_chunks_whose_digests_clash_are_told_apart(spark):
    rng = random.Random(8)
    some = lambda: " ".join("".join(rng.choice("abcdgkm") for _ in range(6)) + "d." for _ in range(120))
    a, b, c = some(), some(), some()
    rows = list(enumerate([a, b, c, a + b, b + a, a + b, " " + c, a + b + c, "", None, "x"]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plain = ["".join(words(t)) for _, t in rows]
    want = [(i, min(j for j, y in enumerate(plain) if y == x and len(rows[j][1] or "") == max(len(rows[k][1] or "") for k, z in enumerate(plain) if z == x)), plain.count(x)) for i, x in enumerate(plain)]
    for weak in ({}, {"digest": lambda x: F.lit(b"0")}, {"digest": lambda x: F.lit(b"0"), "proof": lambda x: F.pmod(F.xxhash64(x), F.lit(2))}):
        assert sorted((r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_groups(df, **weak).collect()) == want


@pytest.mark.parametrize("letters", ["abcdefghiklmnorstuz", "абвгдежзик", "的一是不了人我在有他", "0123456789abcdef(){}="])
def test_cuts_follow_content_in_any_script(spark, letters):
    rng = random.Random(9)
    text = "".join("".join(rng.choice(letters) for _ in range(rng.randint(5, 30))) + rng.choice([",", ".", "; "]) for _ in range(900))
    df = spark.createDataFrame([(1, text), (2, "x" + text), (3, text[3333:])], "doc_id long, text string")
    a, b, c = ({bytes(x.digest) for x in r.chunks} for r in exact_dedup.chunked(df).orderBy("doc_id").collect())
    assert len(a) > 10 and len(a & b) >= len(a) - 3 and len(a - c) < len(a) // 3  # a part is gone, the other cuts are the same


def test_chunks_join_to_the_text(spark):
    rng = random.Random(3)
    some = lambda: "".join(rng.choice("abcdefghiklmnorstuz") for _ in range(rng.randint(2, 9)))
    text = " ".join(some() + rng.choice(["", "", "", "", ",", ".", ".\n"]) for _ in range(6000))
    df = spark.createDataFrame([(1, text), (2, text[200:])], "doc_id long, text string")
    a, b = (r.chunks for r in exact_dedup.chunked(df).orderBy("doc_id").collect())
    assert sum(c.size for c in a) == len("".join(words(text)))
    assert {bytes(c.digest) for c in a} & {bytes(c.digest) for c in b}  # an edit moves few cuts


def brute_lines(texts, least=10):
    held = defaultdict(set)
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    for i, t in texts.items():
        for x in (t or "").split("\n"):
            if len(key(x)) >= least:
                held[key(x)].add(i)
    out = {}
    for i, t in texts.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or len(held[key(x)]) < 2 or min(held[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_lines_equal_brute_force(docs, by_id, none, without_ids):
    found = line_dedup.dedup_lines(docs)
    assert sorted(found.columns) == sorted({*docs.columns, "n_lines", "n_dropped"})
    got = found.select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert len(got) == len(by_id) + 2
    assert {r[0]: tuple(r)[1:] for r in got} == brute_lines(by_id)
    assert line_dedup.dedup_lines(none).count() == 0
    odd = line_dedup.dedup_lines(without_ids).select("doc_id", "text").collect()
    assert sorted(t for i, t in odd if i is None) == ["", ""]
    three = line_dedup.dedup_lines(docs, least_docs=1000)
    assert three.where("n_dropped > 0").count() == 0


def brute_spans(texts, window=20):
    seen, out = set(), {}
    for i in sorted(texts):
        w = words(texts[i])
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            run = tuple(w[j : j + window])
            if run in seen:
                gone[j : j + window] = [True] * window
            seen.add(run)
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("setting", [{}, {"FLUSH": 300, "HOT": 64}, {"FLUSH": 300, "bits_for": lambda total: 22}, {"FLUSH": 2000, "HOT": 5}])
def test_spans_equal_brute_force(docs, by_id, setting, monkeypatch):
    for name, value in setting.items():
        monkeypatch.setattr(common if name == "bits_for" else substring_dedup, name, value)
    once = docs.dropDuplicates(["doc_id"])
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring_dedup.remove_repeats(once).collect()}
    assert got == brute_spans(by_id)


def spans_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring_dedup.remove_repeats(df).collect()}


def test_spans_that_branch_and_cycle(spark):
    rng = random.Random(11)
    some = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    a, b, c, d = some(30), some(45), some(25), some(33)
    ring = some(27)
    texts = [a + b, a + c, d + b, b[5:] + c[:21], a[3:] + b[:30], ring * 4, ring[9:] + ring * 2, some(10) + ring, b + b + a, ["z"] * 70, ["z"] * 41 + a, c[2:], c[:20], c[1:20], (a + b + c + d) * 2]
    texts += [some(rng.randrange(5)) + a[rng.randrange(9) : 30 - rng.randrange(9)] + some(rng.randrange(5)) + rng.choice([b, c, d]) for _ in range(60)]
    texts = [" ".join(t) for t in texts]
    assert spans_of(spark, texts) == brute_spans(dict(enumerate(texts)))


def test_spans_over_small_alphabets(spark):
    rng = random.Random(12)
    texts = [" ".join(rng.choice("ab" if i % 2 else "abcde") for _ in range(rng.randrange(20, 300))) for i in range(80)]
    assert spans_of(spark, texts) == brute_spans(dict(enumerate(texts)))


def test_spans_without_ids_or_rows(spark, none, without_ids, docs, by_id):
    assert substring_dedup.remove_repeats(none).count() == 0
    assert substring_dedup.remove_repeats(without_ids).count() == 4
    assert substring_dedup.remove_repeats(docs).count() == len(by_id) + 2
    w = [f"u{i}" for i in range(60)]
    rows = [(None, " ".join(w[:30])), (7, " ".join(w)), (7, " ".join(w)), (7, "\t" + " ".join(w[:40])), (None, " ".join(w)), (3, " ".join(w[50:])), (3, " ".join(w[50:]))]
    got = sorted((r.doc_id or 99, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    # the two rows 7 that are alike: one stays; the third is before or after them by its hash
    assert got[:2] == [(3, 10, 0)] * 2 and got[5:] == [(99, 30, 30), (99, 60, 60)]
    assert got[2:5] in ([(7, 40, 40), (7, 60, 0), (7, 60, 60)], [(7, 40, 0), (7, 60, 40), (7, 60, 60)])
