"""Quality rules as a ledger: every rule is evaluated once, policies and ablations are bit arithmetic on it."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary, prepare, window_hashes, word_hashes

_SPACE = b" \t\n\x0b\x0c\r"
_SYMBOLS = b"#*$%&|<>"
_CONTINUES = bytes(range(0x80, 0xC0))
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = b"abcdefghijklmnopqrstuvwxyz"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_bangs")


def _count(text: bytes, chars: bytes) -> int:
    return len(text) - len(text.translate(None, chars))


def repeat_words(words: list[bytes], k: int = 5) -> int:
    """Words inside windows of k words that occur twice or more, the first included."""
    n = len(words) - k + 1
    if n < 2:
        return 0
    h = window_hashes(word_hashes(words), k)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n + 1, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + k, np.int32)
    at = np.flatnonzero(twice)
    edge[at] += 1
    edge[at + k] -= 1
    return int((np.cumsum(edge) > 0).sum())


def measure(text: bytes) -> tuple[int, ...]:
    r"""The measurements of one text; words are [^\x20\x09-\x0D]+, chars are code points."""
    words = text.split()
    lines = text.split(b"\n")
    dup = 0
    if len(lines) > 1:
        seen: set[bytes] = set()
        for x in lines:
            if x.strip():
                if x in seen:
                    dup += 1
                else:
                    seen.add(x)
    chars = len(text) - _count(text, _SPACE) - (0 if text.isascii() else _count(text, _CONTINUES))
    return len(words), chars, _count(text, _SYMBOLS), dup, repeat_words(words), len(lines), _count(text, _UPPER), _count(text, _LOWER), text.count(b"!")


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, *MEASURES) of every whole text; null counts as empty. Nothing is shuffled."""
    prepare(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([measure(t) for t in binary(b, "text")], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(rows[:, k]) for k in range(len(MEASURES)))], ["doc_id", *MEASURES])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


@dataclass(frozen=True)
class Rule:
    """A text fails the rule if the SQL condition over the measurements holds."""

    name: str
    fails: str


#: Bit k of the ledger is rule k. Rules are only ever appended, so that old ledgers stay readable.
RULES: tuple[Rule, ...] = (
    Rule("too_few_words", "n_words < 10"),
    Rule("repeats_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", "10 * n_dup_lines > 3 * n_lines AND n_dup_lines >= 3"),
    Rule("shouts", "10 * n_upper > 3 * (n_upper + n_lower)"),
    Rule("bangs", "10 * n_bangs > 2 * n_words"),
    Rule("short_words", "10 * word_chars < 15 * n_words"),
    Rule("long_words", "word_chars > 30 * n_words"),
)
BASE = ("too_few_words", "repeats_windows")

#: Versioned policies: the rules that a kept text must pass.
POLICIES: Mapping[str, Sequence[str]] = {
    "v1": BASE,
    "v2": (*BASE, "symbols", "shouts", "bangs", "short_words", "long_words"),
    "v3": tuple(r.name for r in RULES),
}


def mask(names: Sequence[str], rules: Sequence[Rule] = RULES) -> int:
    places = {r.name: i for i, r in enumerate(rules)}
    return sum(1 << places[n] for n in names)


def ledger(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: doc_id, the measurements and failed, a bitmask of the rules that it fails.

    Null and empty texts have no words and fail too_few_words; repeated rows get a row each; no rows give no rows;
    other columns, whatever their names, are ignored. A long text is measured whole by one task.
    """
    bits = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(rules)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measures(docs, id_col, text_col).withColumn("failed", failed)


def passes(policy: str, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablation(book: DataFrame, policy: str = "v3") -> DataFrame:
    """For each rule of a policy: n_failed, n_only (texts that no other rule of it rejects) and n_kept_without."""
    want = mask(POLICIES[policy])
    own = F.col("failed").bitwiseAND(F.lit(want))
    counts = book.groupBy(own.alias("m")).count()  # at most 2 ** rules rows, summed before the shuffle
    each = [F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("long").alias("bit")) for i, r in enumerate(RULES) if r.name in POLICIES[policy]]
    rows = counts.withColumn("r", F.explode(F.array(*each))).select("m", "count", "r.rule", "r.bit")
    hit = F.col("m").bitwiseAND(F.col("bit")) != 0
    add = lambda c: F.coalesce(F.sum(F.when(c, F.col("count"))), F.lit(0))
    return rows.groupBy("rule").agg(add(hit).alias("n_failed"), add(F.col("m") == F.col("bit")).alias("n_only"), add(F.col("m").bitwiseAND(F.bitwise_not("bit")) == 0).alias("n_kept_without"))


def judge(docs: DataFrame, policy: str = "v3", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger with base_failed (the two base rules) and kept (base passed and policy passed)."""
    book = ledger(docs, RULES, id_col, text_col)
    base = F.col("failed").bitwiseAND(F.lit(mask(BASE))) != 0
    return book.withColumn("base_failed", base).withColumn("kept", ~base & passes(policy))
