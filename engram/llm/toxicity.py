"""A convolutional text classifier: hashed word embeddings, several filter widths, max pooling, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary, materialize, prepare

_EDGES = "\"'`.,;:!?()[]{}<>*#$%&|~_-=+/\\"
#: Frequent words by which a text's language is told, to calibrate by. Fixed lists.
LANGUAGE_WORDS: dict[str, tuple[str, ...]] = {
    "en": ("the", "and", "of", "to", "in", "is", "that", "it", "for", "with", "was", "this"),
    "de": ("der", "die", "und", "das", "nicht", "mit", "den", "von", "ist", "zu", "dem", "auf"),
    "fr": ("le", "les", "des", "et", "une", "du", "est", "que", "dans", "pour", "qui", "la"),
    "es": ("el", "los", "las", "que", "con", "por", "una", "para", "del", "se", "y", "de"),
}
LANGUAGES = (*LANGUAGE_WORDS, "other")


@dataclass
class Settings:
    """Bounds and sizes of the model. max_rows and max_bytes bound the labelled texts that it is fitted on.

    Texts are taken whole, in the order of a hash of their id, until one goes over max_bytes.
    """

    max_rows: int = 12_000
    max_bytes: int = 96 << 20
    least_texts: int = 3  # training texts in which a word has to be to have an embedding
    hash_bits: int = 20
    max_vocabulary: int = 30_000
    dims: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    filters: int = 6
    epochs: int = 6
    rate: float = 0.02
    seed: int = 7
    threshold: float = 0.7


class Rows(dict):
    """Word -> rows of its own embedding and of its beginning's, packed into one number.

    What training did not meet has row 0, whose embedding is zero.
    """

    def __init__(self, row_of: np.ndarray, bits: int):
        super().__init__()
        self.row_of, self.bits = row_of, bits

    def __missing__(self, word: bytes) -> int:
        own, start = buckets(word, self.bits)
        rows = int(self.row_of[own]) | int(self.row_of[start]) << 32
        if len(self) < 150_000 and len(word) <= 64:
            self[word] = rows
        return rows

    def of(self, words: list[bytes]) -> np.ndarray:
        """Two rows for each word."""
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words)).view(np.int32).reshape(-1, 2).T


def buckets(word: bytes, bits: int) -> tuple[int, int]:
    """The hashed places of a word, in lower case and without marks at its ends, and of its first 4 characters."""
    plain = word.decode("utf-8", "replace").lower().strip(_EDGES) or word.decode("utf-8", "replace")
    return tuple(xxhash.xxh3_64_intdigest(x.encode("utf-8", "replace")) >> (64 - bits) for x in (plain, "^" + plain[:4]))


@dataclass
class Model:
    settings: Settings
    row_of: np.ndarray  # bucket -> row
    taps: dict[int, list[np.ndarray]] = field(default_factory=dict)  # width -> row projections for each tap
    bias: dict[int, np.ndarray] = field(default_factory=dict)
    dense: np.ndarray | None = None
    shift: float = 0.0
    cuts: dict[str, float] = field(default_factory=dict)  # language -> probability that becomes the threshold

    def pooled(self, ids: np.ndarray) -> np.ndarray:
        out = []
        for w, taps in self.taps.items():
            own = _padded(ids, w)
            n = own.shape[1] - w + 1
            total = sum(taps[j][own[k, j : j + n]] for j in range(w) for k in (0, 1))
            out.append(np.maximum(total.max(0) + self.bias[w], 0))
        return np.concatenate(out)

    def raw(self, ids: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.pooled(ids) @ self.dense + self.shift, -30, 30))))

    def calibrated(self, p: float, language: str) -> float:
        """Monotone in p; the language's cut becomes the threshold of all."""
        c, t = self.cuts.get(language, self.cuts["other"]), self.settings.threshold
        return t * p / c if p < c else t + (1 - t) * (p - c) / max(1 - c, 1e-9)


def _padded(ids: np.ndarray, width: int) -> np.ndarray:
    return ids if ids.shape[1] >= width else np.concatenate((ids, np.zeros((2, width - ids.shape[1]), ids.dtype)), 1)


def language(words: list[bytes]) -> str:
    """The language whose frequent words make up most of a text; told from the text alone."""
    counts = dict.fromkeys(LANGUAGE_WORDS, 0)
    for w in words:
        for name in _BY_WORD.get(w, ()):
            counts[name] += 1
    best = max(counts, key=counts.get)
    return best if counts[best] else "other"


_BY_WORD: dict[bytes, tuple[str, ...]] = {}
for _name, _list in LANGUAGE_WORDS.items():
    for _w in _list:
        _BY_WORD[_w.encode()] = (*_BY_WORD.get(_w.encode(), ()), _name)


@dataclass
class Example:
    """A labelled text as the model reads it: its hash, its hashed words (2 x n) and its language."""

    key: int
    label: float
    told: str
    places: np.ndarray


def encoder(bits: int):
    """A function from a text to its hash, hashed words and language."""
    known: dict[bytes, tuple[int, int]] = {}

    def encode(text: bytes) -> tuple[int, np.ndarray, str]:
        words = text.split()
        if len(known) > 300_000:
            known.clear()
        found = [known[w] if w in known else known.setdefault(w, buckets(w, bits)) for w in words]
        return xxhash.xxh3_64_intdigest(text), np.array(found, np.int32).reshape(-1, 2).T, language(words)

    return encode


def fit(texts: list[bytes], labels: np.ndarray, settings: Settings | None = None) -> Model:
    """Train on labelled texts."""
    s = settings or Settings()
    encode = encoder(s.hash_bits)
    rows = []
    for text, label in zip(texts, labels, strict=True):
        key, places, told = encode(text)
        rows.append(Example(key, float(label), told, places))
    return train_model(rows, s)


def train_model(rows: list[Example], s: Settings) -> Model:
    """Train on examples. Rows that differ only in order give the same model."""
    rows = sorted(rows, key=lambda r: (r.key, r.label))
    y = np.array([r.label for r in rows])
    rng = np.random.default_rng(s.seed)
    places, told, texts = [r.places for r in rows], [r.told for r in rows], rows
    told = np.array(told)
    #: The last quarter is not trained on: cuts are chosen there.
    calibrating = np.arange(len(texts)) >= len(texts) - len(texts) // 4
    train = np.flatnonzero(~calibrating)

    # vocabulary: buckets in some texts at least, the strongest evidence first
    size = 1 << s.hash_bits
    seen, bad = np.zeros(size), np.zeros(size)
    for i in train:
        u = np.unique(places[i])
        seen[u] += 1
        bad[u] += y[i]
    n1, n0 = max(y[train].sum(), 1), max((1 - y[train]).sum(), 1)
    odds = np.log((bad + 0.5) / (n1 + 1)) - np.log((seen - bad + 0.5) / (n0 + 1))
    z = np.abs(odds) * np.sqrt(np.minimum(bad + 0.5, seen - bad + 0.5)) + np.abs(odds)
    chosen = np.flatnonzero(seen >= s.least_texts)
    chosen = np.sort(chosen[np.argsort(-z[chosen], kind="stable")[: s.max_vocabulary]])
    row_of = np.zeros(size, np.int32)
    row_of[chosen] = np.arange(1, len(chosen) + 1)
    ids = [row_of[p] for p in places]

    # start: the first dimension holds each word's evidence, filters look for it
    shrink = seen[chosen] / (seen[chosen] + 4)
    emb = rng.normal(0, 0.05, (len(chosen) + 1, s.dims))
    emb[1:, 0] = np.clip(odds[chosen] * shrink, -2, 4)
    emb[0] = 0
    kernels = {w: rng.normal(0, 0.1, (w, s.dims, s.filters)) for w in s.widths}
    for w in s.widths:
        kernels[w][:, 0, :] += 1.0 / w
    bias = {w: np.full(s.filters, -0.2) for w in s.widths}
    dense, shift = np.full(len(s.widths) * s.filters, 0.5) + rng.normal(0, 0.05, len(s.widths) * s.filters), -3.0

    params = {"emb": emb, "dense": dense, "shift": np.array([shift])} | {f"k{w}": kernels[w] for w in s.widths} | {f"b{w}": bias[w] for w in s.widths}
    m, v, step = {k: np.zeros_like(x) for k, x in params.items()}, {k: np.zeros_like(x) for k, x in params.items()}, 0
    weight, place = np.where(y > 0, np.sqrt(n0 / n1), 1.0), np.zeros(len(emb), np.int32)
    for _ in range(s.epochs if 0 < y[train].sum() < len(train) else 0):
        shuffled = rng.permutation(train)
        for at in range(0, len(shuffled), 64):
            grads = {k: np.zeros_like(x) for k, x in params.items() if k != "emb"}
            touched: list[tuple[np.ndarray, np.ndarray]] = []
            batch = shuffled[at : at + 64]
            used = np.unique(np.concatenate([ids[i].ravel() for i in batch] + [np.zeros(1, np.int32)]))  # row 0 first
            place[used] = np.arange(len(used))
            small = params["emb"][used]
            taps = {w: [small @ params[f"k{w}"][j] for j in range(w)] for w in s.widths}
            for i in batch:
                own, states = place[ids[i]], []
                for w in s.widths:
                    x = _padded(own, w)
                    n = x.shape[1] - w + 1
                    total = sum(taps[w][j][x[k, j : j + n]] for j in range(w) for k in (0, 1))
                    best = total.argmax(0)
                    states.append((x, best, total[best, np.arange(s.filters)] + params[f"b{w}"]))
                pooled = np.concatenate([np.maximum(z_, 0) for _, _, z_ in states])
                p = 1 / (1 + np.exp(-np.clip(pooled @ params["dense"] + params["shift"][0], -30, 30)))
                d = weight[i] * (p - y[i]) / 64
                grads["dense"] += d * pooled
                grads["shift"] += d
                back = d * params["dense"] * (pooled > 0)
                for k, (w, (x, best, _)) in enumerate(zip(s.widths, states, strict=True)):
                    g = back[k * s.filters : (k + 1) * s.filters]
                    grads[f"b{w}"] += g
                    for j in range(w):
                        for rows in x[:, best + j]:
                            grads[f"k{w}"][j] += small[rows].T * g
                            touched.append((used[rows], g[:, None] * params[f"k{w}"][j].T))
            step += 1
            for k, g in grads.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                params[k] -= s.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
            if touched:  # embeddings move by plain steps, only where a filter looked
                rows, g = np.concatenate([r for r, _ in touched]), np.concatenate([g for _, g in touched])
                np.subtract.at(params["emb"], rows, 2.0 * g)
                params["emb"][0] = 0
    model = Model(s, row_of, {}, {w: params[f"b{w}"].astype(np.float32) for w in s.widths}, params["dense"].astype(np.float32), float(params["shift"][0]))
    model.taps = {w: [(params["emb"] @ params[f"k{w}"][j]).astype(np.float32) for j in range(w)] for w in s.widths}

    # calibrate: for each language told from the text, the cut with the best F1, drawn to that of all texts
    p = np.array([model.raw(ids[i]) for i in np.flatnonzero(calibrating)])
    y, told = y[calibrating], told[calibrating]
    whole = _cut(p, y)
    model.cuts = {"other": whole}
    for name in LANGUAGES[:-1]:
        mine = told == name
        good = y[mine].sum()
        own = _cut(p[mine], y[mine]) if good >= 10 else whole
        share = good / (good + 20)
        model.cuts[name] = float(share * own + (1 - share) * whole)
    return model


def _cut(p: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap at the best F1; 0.5 without both labels."""
    if not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(1, len(y) + 1) + y.sum())
    ends = np.flatnonzero(np.concatenate((p[order][1:] != p[order][:-1], [True])))
    k = ends[np.argmax(f1[ends])]
    low = p[order][k + 1] if k + 1 < len(p) else 0.0
    return float(np.clip((p[order][k] + low) / 2, 0.02, 0.98))


def training_rows(docs: DataFrame, labels: DataFrame, settings: Settings, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(text, label): the labelled texts that max_rows and max_bytes allow, chosen by a hash of their id."""
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where("label IN (0, 1)")
    some = own.groupBy("id").agg(F.max("label").alias("label")).withColumn("order", F.xxhash64("id")).orderBy("order", "id").limit(settings.max_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(some), "id")  # max_rows rows of three numbers
    rows = materialize(rows.withColumn("rid", F.monotonically_increasing_id()), "labelled")
    before = W.orderBy("order", "rid").rowsBetween(W.unboundedPreceding, -1)  # over the sample's numbers only
    sizes = rows.select("order", "rid", F.coalesce(F.octet_length("text"), F.lit(0)).alias("bytes"))
    within = sizes.withColumn("before", F.coalesce(F.sum("bytes").over(before), F.lit(0))).where(F.col("before") + F.col("bytes") <= settings.max_bytes)
    return rows.join(F.broadcast(within.select("rid")), "rid").select("text", "label")  # a part of the sample


def fit_table(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on a bounded sample of labelled rows; without labels, a model that scores near 0.

    Hashed words come to the driver, no texts: 8 bytes for a word.
    """
    s = settings or Settings()
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(s.hash_bits)
        for b in batches:
            rows = [encode(t) for t in binary(b, "text")]
            keys = np.array([r[0] for r in rows], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), b.column(1), pa.array([r[2] for r in rows], pa.string()), pa.array([np.ascontiguousarray(r[1]).tobytes() for r in rows], pa.binary())], ["key", "label", "told", "places"])

    found = training_rows(docs, labels, s, id_col, text_col, label_col).mapInArrow(run, "key long, label int, told string, places binary").toArrow()
    rows = [Example(k, float(y), t, np.frombuffer(p, np.int32).reshape(2, -1)) for k, y, t, p in zip(*(c.to_pylist() for c in found.columns), strict=True)]
    return train_model(rows, s)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): every whole text, by a model of fixed size. Null and empty texts have a score, too.

    Nothing is shuffled. Repeated rows get a row each; other columns, whatever their names, are not read.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # hash_bits and max_vocabulary bound it: about 20 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        rows = Rows(own.row_of, own.settings.hash_bits)
        for b in batches:
            out = []
            for text in binary(b, "text"):
                words = text.split()
                out.append(own.calibrated(own.raw(rows.of(words)), language(words)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 3."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3))


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every document; labels come from rows outside the held-out fold only.

    Null and empty texts are scored as texts without words, repeated rows get a row each, a row without an id is not
    held out, no rows give no rows, other columns are not read. A document with several labels is toxic if one says
    so; labels other than 0 and 1 are left out. A long text is read whole by one task.
    """
    s = settings or Settings()
    model = fit_table(docs, labels.where(fold(id_col) != 1), s, id_col, text_col)
    out = score(docs, model, id_col, text_col)
    return out.select("doc_id", F.coalesce(fold("doc_id") == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= s.threshold).cast("int").alias("predicted"))
