import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.llm import quality_classifier, quality_rules, toxicity

from .conftest import words


def brute_measures(text):
    text = text or ""
    w = words(text)
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice = {r for r, n in Counter(runs).items() if n > 1}
    covered = {i + k for i, r in enumerate(runs) if r in twice for k in range(5)}
    seen, dup = set(), 0
    for x in text.split("\n"):
        if words(x):
            dup += x in seen
            seen.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_rules_equal_brute_force(docs, by_id, none, without_ids):
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert set(got) == set(by_id)
    for i, t in by_id.items():
        r, want = got[i], brute_measures(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.kept and r.base_failed)
    assert quality_rules.judge(none).count() == 0 and quality_rules.judge(without_ids).count() == 4


def test_policies_and_ablation(docs):
    book = quality_rules.ledger(docs).cache()
    failed = [r.failed for r in book.collect()]
    want = quality_rules.mask(quality_rules.POLICIES["v3"])
    for r in quality_rules.ablation(book).collect():
        bit = quality_rules.mask([r.rule])
        assert r.n_failed == sum(f & bit > 0 for f in failed)
        assert r.n_only == sum(f & want == bit for f in failed)
        assert r.n_kept_without == sum(f & want & ~bit == 0 for f in failed)
    assert book.where(quality_rules.passes("v1")).count() == sum(f & 3 == 0 for f in failed)


def test_site_posteriors_equal_formula(spark):
    rng = np.random.default_rng(2)
    rows = [(f"h{h}", f"p{q}", float(p)) for h in range(4) for q in range(3) for p in rng.beta(2 + h, 2, 1 + 20 * (h == 0) + q)]
    got = {(r.host, r.path): (r.global_mean, r.host_posterior, r.path_posterior) for r in quality_classifier.site_posteriors(spark.createDataFrame(rows, "host string, path string, p double")).collect()}
    p = np.array([r[2] for r in rows])
    g, within = p.mean(), p.var()
    strength = lambda m, v: min(1e4, max(1.0, m * (1 - m) / max(v, 1e-9) - 1))
    hosts = {h: np.array([r[2] for r in rows if r[0] == h]) for h in {r[0] for r in rows}}
    v = max(sum(len(x) * (x.mean() - g) ** 2 for x in hosts.values()) / len(p) - len(hosts) * within / len(p), 1e-6)
    k = strength(g, v)
    post = {h: (x.sum() + k * g) / (len(x) + k) for h, x in hosts.items()}
    paths = {(h, q): np.array([r[2] for r in rows if r[:2] == (h, q)]) for h, q in got}
    v = max(sum(len(x) * (x.mean() - post[h]) ** 2 for (h, _), x in paths.items()) / len(p) - len(paths) * within / len(p), 1e-6)
    k = strength(g, v)
    for (h, q), x in paths.items():
        assert got[h, q] == pytest.approx((g, post[h], (x.sum() + k * post[h]) / (len(x) + k)), rel=1e-6)


def brute_posteriors(rows):
    """{(host, path): (global mean, host's, path's)} of (host, path, p), one site after the other."""
    p = np.array([r[2] for r in rows])
    g, within = p.mean(), max(p.var(), 1e-9)

    def shrunk(groups, centre):
        v = max(sum(len(x) * (np.mean(x) - centre[k]) ** 2 for k, x in groups.items()) / len(p) - len(groups) * within / len(p), 1e-6)
        k0 = min(1e4, max(1.0, g * (1 - g) / max(v, 1e-9) - 1))
        return {k: (np.sum(x) + k0 * centre[k]) / (len(x) + k0) for k, x in groups.items()}

    hosts, paths = {}, {}
    for h, q, x in rows:
        hosts.setdefault(h, []).append(x)
        paths.setdefault((h, q), []).append(x)
    of_host = shrunk(hosts, dict.fromkeys(hosts, g))
    of_path = shrunk(paths, {k: of_host[k[0]] for k in paths})
    return {k: (g, of_host[k[0]], x) for k, x in of_path.items()}


def brute_scores(rows, labels):
    """(doc_id, evidence, host's, path's, score) of (doc_id, text, source, lang): features of each text, one by one, a
    fit by half Newton steps until it stands still, and posteriors site by site."""
    own = {}
    for r in labels:
        if r.doc_id is not None and r.quality in (0, 1):
            own[r.doc_id] = min(own.get(r.doc_id, 1), r.quality)
    x = [np.array(quality_classifier.features((t or "").encode())) for _, t, _, _ in rows]
    train = [i for i, r in enumerate(rows) if r[0] in own]
    data, y = np.array([x[i] for i in train]), np.array([own[rows[i][0]] for i in train])
    mean, spread = data.mean(0), data.std(0) + 1e-6
    z = lambda v: np.append(np.clip((v - mean) / spread, -10, 10), 1.0)
    zs, w, ridge = np.array([z(v) for v in data]), np.zeros(len(mean) + 1), np.append(np.ones(len(mean)), 1e-3)
    for _ in range(200):
        q = 1 / (1 + np.exp(-zs @ w))
        w += 0.5 * np.linalg.solve((zs * (q * (1 - q))[:, None]).T @ zs + np.diag(ridge), zs.T @ (y - q) - ridge * w)
    logit = [float(np.clip(z(v) @ w, -12, 12)) for v in x]
    p = [1 / (1 + math.exp(-v)) for v in logit]
    post = brute_posteriors([(s or "", q or "", p[i]) for i, (_, _, s, q) in enumerate(rows)])
    odds = lambda v: math.log(min(1 - 1e-6, max(1e-6, v)) / (1 - min(1 - 1e-6, max(1e-6, v))))
    out = []
    for i, (doc, _, s, q) in enumerate(rows):
        g, host, path = post[s or "", q or ""]
        out.append((doc, p[i], host, path, 1 / (1 + math.exp(-(logit[i] + odds(path) - odds(g))))))
    return out


def test_classifier_equals_brute_force(docs, labels):
    want = brute_scores([tuple(r) for r in docs.select("doc_id", "text", "source", "lang").collect()], labels.collect())
    got = sorted((r.doc_id, r.evidence, r.host_posterior, r.path_posterior, r.score, r.kept) for r in quality_classifier.classify(docs, labels).collect())
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:5] == pytest.approx(b, abs=2e-4) and a[5] == (a[4] >= 0.5)


def test_sites_of_urls(spark):
    urls = ["https://www.Example.org/news/2024/a.html?x=1", "http://a.b/c", "http://a.b", "no address", None]
    host, path = quality_classifier.url_site(F.col("url"))
    got = spark.createDataFrame([(u,) for u in urls], "url string").select(host, path).collect()
    assert [tuple(r) for r in got] == [("example.org", "news"), ("a.b", ""), ("a.b", ""), ("", ""), ("", "")]


def test_classifier_on_pages(spark, sf_dir):
    """Web pages: hosts and first folders of their addresses are the sites."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("page_id doc_id", "url", "html text")
    labels = pages.selectExpr("doc_id", "CAST(doc_id % 2 AS INT) quality")
    host, path = quality_classifier.url_site(F.col("url"))
    got = quality_classifier.classify(pages, labels, host=host, path=path)
    assert got.count() == pages.count() and got.where("host_posterior BETWEEN 0 AND 1 AND path_posterior BETWEEN 0 AND 1").count() == pages.count()


def test_classifier_on_held_out_rows(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_classifier.classify(docs, labels.where("doc_id % 3 <> 0")).toPandas().merge(labels.where("doc_id % 3 = 0").toPandas(), on="doc_id")
    assert (got.kept == (got.quality == 1)).mean() > 0.95
    assert got[(got.quality == 1)].kept.mean() > 0.97


def test_classifier_edges(docs, labels, none, without_ids, spark):
    got = quality_classifier.classify(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all() and got.notna().all().all()
    assert quality_classifier.classify(none, labels).count() == 0
    assert quality_classifier.classify(docs, labels.where("false")).where("kept").count() == docs.count()
    assert quality_classifier.classify(without_ids, labels).count() == 4
    kept = quality_classifier.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == int(got.kept.sum())


def test_toxicity_on_held_out_rows(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels)
    rows = got.where("held_out").toPandas().merge(labels.toPandas(), on="doc_id")
    bad, good = rows[rows.toxic == 1].score.to_numpy(), rows[rows.toxic == 0].score.to_numpy()
    assert np.mean(bad[:, None] > good[None, :]) > 0.9
    said = rows[rows.predicted == 1]
    assert (said.toxic == 1).mean() > 0.9 and len(said[said.toxic == 1]) / len(bad) > 0.7


def test_toxicity_edges(docs, labels, none, without_ids):
    a, b = (toxicity.toxicity(docs, labels).toPandas().sort_values(["doc_id", "score"]).reset_index(drop=True) for _ in range(2))
    assert a.equals(b) and len(a) == docs.count() and a.score.between(0, 1).all() and ((a.score >= 0.7) == (a.predicted == 1)).all()
    assert toxicity.toxicity(none, labels).count() == 0
    assert toxicity.toxicity(docs, labels.where("false")).count() == docs.count()
    assert toxicity.toxicity(without_ids, labels).count() == 4


def test_forward_pass_equals_a_naive_convolution():
    """Scores of a fitted model against loops over places, taps and filters."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{rng.integers(60)}" for _ in range(rng.integers(0, 30))).encode() for _ in range(400)]
    labels = np.array([float(b"w7" in t.split() or b"w8 w9" in t) for t in texts])
    m = toxicity.fit(texts, labels, toxicity.Settings(least_texts=3, epochs=2))
    reader = toxicity.Rows(m.row_of, m.settings.hash_bits)
    for text in [*texts[:40], b"", b"unknown words", b"w7"]:
        ids = reader.of(text.split())
        pooled = []
        for w, taps in m.taps.items():
            n = max(ids.shape[1], w)
            for f in range(m.settings.filters):
                best = -math.inf
                for at in range(n - w + 1):
                    total = 0.0
                    for j in range(w):
                        for k in (0, 1):  # the word and its beginning
                            row = ids[k, at + j] if at + j < ids.shape[1] else 0
                            total += float(taps[j][row, f])
                    best = max(best, total)
                pooled.append(max(best + float(m.bias[w][f]), 0.0))
        want = 1 / (1 + math.exp(-sum(a * float(b) for a, b in zip(pooled, m.dense, strict=True)) - m.shift))
        assert m.raw(ids) == pytest.approx(want, abs=1e-5)
    found = np.array([m.raw(reader.of(t.split())) for t in texts])
    assert found[labels == 1].mean() > found[labels == 0].mean() + 0.2


def test_training_is_bounded_in_rows_and_bytes(spark):
    docs = spark.createDataFrame([(i, f"t{i} " * (10 + i)) for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    rows = lambda **bound: [r.text for r in toxicity.training_rows(docs, labels, toxicity.Settings(**bound)).collect()]
    assert len(rows()) == 50 and len(rows(max_rows=7)) == 7
    some = rows(max_bytes=2000)
    assert sum(map(len, some)) <= 2000 < sum(map(len, some)) + max(len(f"t{i} " * (10 + i)) for i in range(50))
    assert set(some) < set(rows()) and rows(max_bytes=1) == []


def test_cut_and_calibration():
    assert toxicity._cut(np.array([0.9, 0.8, 0.2, 0.1]), np.array([1, 1, 0, 0])) == pytest.approx(0.5)
    m = toxicity.Model(toxicity.Settings(), np.zeros(1, np.int32), cuts={"other": 0.4})
    assert m.calibrated(0.4, "en") == pytest.approx(0.7) and m.calibrated(0, "en") == 0 and m.calibrated(1, "en") == pytest.approx(1)
    assert not math.isnan(m.calibrated(0.39, "xx"))
