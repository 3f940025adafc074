"""Document quality by hierarchical empirical Bayes: the text's own evidence, shrunk with its host's and path's."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary, every, materialize, prepare, word_hashes
from .quality_rules import MEASURES, measure

FEATURES = ("length", "symbols", "upper", "bangs", "repeats", "dup_lines", "word_length", "adjacent", "variety")


@dataclass
class Settings:
    max_rows: int = 20_000  # labelled documents that the document classifier is fitted on
    penalty: float = 1.0
    cap: float = 12.0  # most log odds that a text's own evidence counts
    site_weight: float = 1.0
    threshold: float = 0.5


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # the last is the constant
    cap: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -10, 10)
        return np.clip(z @ self.weights[:-1] + self.weights[-1], -self.cap, self.cap)


def features(text: bytes) -> tuple[float, ...]:
    m = dict(zip(MEASURES, measure(text), strict=True))
    n = max(m["n_words"], 1)
    words = text.split()
    same = variety = 0.0
    if len(words) > 1:
        h = word_hashes(words)
        same = float((h[1:] == h[:-1]).mean())
        variety = len(set(words)) / n**0.9
    share = lambda a, b, most: min(m[a] / max(b, 1), most)
    return (
        np.log1p(m["n_words"]),
        np.log1p(10 * share("n_symbols", n, 5)),
        share("n_upper", m["n_upper"] + m["n_lower"], 1),
        np.log1p(10 * share("n_bangs", n, 5)),
        share("n_repeat_words", n, 1),
        share("n_dup_lines", m["n_lines"], 1),
        share("word_chars", n, 40),
        same,
        variety,
    )


def fit(x: np.ndarray, y: np.ndarray, settings: Settings) -> Model:
    """Logistic regression by Newton's method with a ridge penalty; one label alone gives its constant."""
    x = x.reshape(-1, len(FEATURES))
    mean, spread = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    z = np.c_[np.clip((x - mean) / spread, -10, 10), np.ones(len(x))]
    w = np.zeros(len(FEATURES) + 1)
    ridge = np.eye(len(w)) * settings.penalty
    ridge[-1, -1] = 1e-3
    for _ in range(30 if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (y - p) - ridge @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return Model(mean, spread, w, settings.cap)


def evidence(rows: DataFrame, model: Model) -> DataFrame:
    """rows with logit, the classifier's log odds that the whole of text is good. Null counts as empty.

    Only texts go through Python; other columns stay where they are.
    """
    shared = prepare(rows.sparkSession).sparkContext.broadcast(model)  # a few dozen numbers

    @F.arrow_udf("double")
    def logit(texts: pa.Array) -> pa.Array:
        raw = [x or b"" for x in texts.cast(pa.binary()).to_pylist()]
        x = np.array([features(t) for t in raw]).reshape(-1, len(FEATURES))
        return pa.array(np.round(shared.value.logit(x), 9))

    return rows.withColumn("logit", logit("text"))


def fit_table(docs: DataFrame, labels: DataFrame, settings: Settings, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on at most max_rows labelled documents, chosen by a hash of their id; only their features are collected."""
    prepare(docs.sparkSession)
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label IN (0, 1)")
    some = own.groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(settings.max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([list(map(float, features(t))) for t in binary(b, "text")], pa.list_(pa.float64()))], ["label", "x"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(some), "id").select("text", "label")  # max_rows rows of two numbers
    found = rows.mapInArrow(run, "label int, x array<double>").toArrow()
    x, y = np.array(found["x"].to_pylist(), float).reshape(-1, len(FEATURES)), np.array(found["label"].to_pylist(), float)
    order = np.lexsort((y, *x.T))
    return fit(x[order], y[order], settings)


def _strength(mean: float, between: float) -> float:
    """Prior strength of a beta with this mean and variance between sites, in documents."""
    return min(10_000.0, max(1.0, mean * (1 - mean) / max(between, 1e-9) - 1))


def site_posteriors(scored: DataFrame) -> DataFrame:
    """(host, path, global_mean, host_posterior, path_posterior) from (host, path, p): one row for each path.

    A host's posterior mean is its documents' mean drawn to the global mean, a path's is its documents' mean drawn
    to its host's posterior. The strength of each prior is estimated by moments: the variance of the means between
    sites, less what sampling alone gives. Sums are grouped by path first, so that a hot host adds one row a task.
    The global sums, two rows of a few numbers, come to the driver and go back as literals.
    """
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"))
    paths = materialize(paths, "paths")
    hosts = paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("n", "s", "q")))
    total = hosts.agg(*(F.sum(c).alias(c) for c in ("n", "s", "q"))).first()
    n = total.n or 1
    mean = (total.s or 0.0) / n
    within = max((total.q or 0.0) / n - mean * mean, 1e-9)

    def between(sites: DataFrame, centre: Column) -> float:
        found = sites.agg(F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - centre, 2)).alias("v"), F.count("*").alias("c")).first()
        return max((found.v or 0.0) / n - found.c * within / n, 1e-6)

    k = _strength(mean, between(hosts, F.lit(mean)))
    hosts = hosts.select("host", ((F.col("s") + k * mean) / (F.col("n") + k)).alias("host_posterior"))
    paths = paths.join(hosts, "host")
    k = _strength(mean, between(paths, F.col("host_posterior")))
    return paths.select("host", "path", F.lit(mean).alias("global_mean"), "host_posterior", ((F.col("s") + k * F.col("host_posterior")) / (F.col("n") + k)).alias("path_posterior"))


def url_site(url: Column) -> tuple[Column, Column]:
    """The host of a web address, in lower case without "www.", and the first folder of its path ("" for none)."""
    host = F.regexp_replace(F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit(""))), r"^www\.", "")
    return host, F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), r"^/([^/]+)/", 1)


def _site(host: Column, path: Column) -> list[Column]:
    return [F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path")]


def _log_odds(p: Column) -> Column:
    p = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), p))
    return F.log(p / (1 - p))


def classify(
    docs: DataFrame, labels: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None, carry: bool = False
) -> DataFrame:
    """doc_id, evidence, host_posterior, path_posterior, score and kept for each document (and row, if carry).

    score is the probability that the document is good: its own log odds plus those of its path's posterior over
    the global mean. host and path default to the columns source and lang; url_site gives those of web pages. Null
    hosts or paths are sites of their own, null texts count as empty, repeated rows get a row each. Without labels
    all evidence is 0.5 and all documents are kept; no rows give no rows. carry adds a column row, a struct of all
    columns of docs whatever their names. A long text is read whole by one task.

    Each text is read once: its evidence is stored with its site (and its row, if carry). Nothing is shuffled as
    long as the table of sites is small enough for Spark's own broadcast limit; beyond it, the join is by site, and
    adaptive execution splits hot sites.
    """
    s = settings or Settings()
    model = fit_table(docs, labels, s, id_col, text_col)
    site = _site(F.col("source") if host is None else host, F.col("lang") if path is None else path)
    base = docs.select(F.col(id_col).alias("doc_id"), *site, F.col(text_col).cast("string").alias("text"), *([F.struct(*every(docs)).alias("row")] if carry else []))
    p = 1 / (1 + F.exp(-F.col("logit")))
    own = materialize(evidence(base, model).drop("text").withColumn("p", F.round(p, 9)), "evidence")
    sites = materialize(site_posteriors(own), "sites")
    scored = own.join(sites, ["host", "path"])
    logit = F.col("logit") + s.site_weight * (_log_odds(F.col("path_posterior")) - _log_odds(F.col("global_mean")))
    score = F.round(1 / (1 + F.exp(-logit)), 6)
    out = scored.select("doc_id", F.round("p", 6).alias("evidence"), F.round("host_posterior", 6).alias("host_posterior"), F.round("path_posterior", 6).alias("path_posterior"), score.alias("score"), *(["row"] if carry else []))
    return out.withColumn("kept", F.col("score") >= s.threshold)


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns."""
    kept = classify(docs, labels, carry=True, **options).where("kept")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
