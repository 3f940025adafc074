"""Transcripts to chat turns: a hidden Markov model over speaker markers and line features, read by Viterbi."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialize, prepare

ROLES = ("system", "user", "assistant", "tool")
#: States: the first line of a turn of each role, then its further lines.
STATES = len(ROLES) * 2
#: Fragments (rows) of a conversation in one block; longer conversations are read in blocks.
BLOCK = 1024

#: Names that speakers go by. Fixed list.
SPEAKERS = {
    "system": 0, "instruction": 0, "instructions": 0,
    "user": 1, "human": 1, "customer": 1, "prompter": 1, "question": 1, "q": 1,
    "assistant": 2, "ai": 2, "bot": 2, "model": 2, "agent": 2, "answer": 2, "a": 2, "gpt": 2,
    "tool": 3, "function": 3, "observation": 3,
}
_NAMES = "|".join(sorted(SPEAKERS, key=len, reverse=True))
#: A marker with its text on the same line, and one on a line of its own.
_INLINE = re.compile(rf"(?:\*\*)?({_NAMES})(?:\*\*)?:(?:\*\*)? ?|\[({_NAMES})\] ?", re.IGNORECASE)
_ALONE = re.compile(rf"(?:<\|({_NAMES})\|>|#{{2,4}} ?({_NAMES}):?)[ \t]*$", re.IGNORECASE)
_LIST = re.compile(r"\s*(?:[-*+] |\d+[.)] |```|    )")
CLASSES = ("blank", "question", "list", "long", "plain")


def marker(line: str) -> tuple[int, str | None] | None:
    """Role and the rest of the line, None for a marker that has the line to itself; None without a marker."""
    if found := _ALONE.match(line):
        return SPEAKERS[(found[1] or found[2]).lower()], None
    if found := _INLINE.match(line):
        return SPEAKERS[(found[1] or found[2]).lower()], line[found.end() :]
    return None


def line_class(line: str) -> int:
    plain = line.strip()
    if not plain:
        return 0
    if plain.endswith("?"):
        return 1
    if _LIST.match(line):
        return 2
    return 3 if len(plain) > 240 else 4


@dataclass(frozen=True)
class Line:
    """A line of a transcript, as the model sees it."""

    fragment: int
    text: str
    rest: str | None  # what follows a marker on its line
    role: int | None  # that the marker names
    kind: int  # the class of the whole line
    rest_kind: int  # the class of the rest; -1 if the marker has the line to itself
    fresh: bool  # it begins a fragment


@dataclass
class Parameters:
    """Probabilities. follows: of the next turn's role by role; classes: of each line class by role.

    The defaults are a start; fit() learns first, follows and classes from turns of known role, and learn() all of
    them from transcripts without any roles.
    """

    marked: float = 0.9  # a turn's first line has a marker
    stray: float = 0.002  # a further line looks like a marker
    wrong: float = 0.02  # a marker names another role
    goes_on: float = 0.7  # a line is followed by one of the same turn
    breaks: float = 0.9  # a fragment begins a turn
    first: tuple[float, ...] = (0.3, 0.59, 0.1, 0.01)
    follows: tuple[tuple[float, ...], ...] = ((0.02, 0.9, 0.07, 0.01), (0.01, 0.04, 0.9, 0.05), (0.01, 0.87, 0.02, 0.1), (0.01, 0.05, 0.9, 0.04))
    classes: tuple[tuple[float, ...], ...] = ((0.1, 0.02, 0.2, 0.2, 0.48), (0.1, 0.3, 0.05, 0.1, 0.45), (0.15, 0.1, 0.2, 0.2, 0.35), (0.1, 0.02, 0.3, 0.2, 0.38))
    tables: dict = field(default_factory=dict, repr=False)

    def __post_init__(self):
        n = len(ROLES)
        classes = np.array(self.classes)
        emit = {}
        for role in (None, *range(n)):
            for kind in range(len(CLASSES)):
                for rest in range(-1, len(CLASSES)) if role is not None else (kind,):
                    p = np.empty(STATES)
                    for s in range(STATES):
                        own = s % n
                        if s >= n:
                            p[s] = (1 - self.stray if role is None else self.stray) * classes[own, kind]
                        elif role is None:
                            p[s] = (1 - self.marked) * classes[own, kind]
                        else:
                            named = 1 - self.wrong if role == own else self.wrong / (n - 1)
                            p[s] = self.marked * named * (classes[own, rest] if rest >= 0 else 1.0)
                    emit[role, kind, rest] = np.log(p)
        moves = {}
        for fresh in (False, True):  # whether the line begins a fragment
            on = 1 - self.breaks if fresh else self.goes_on
            step = np.full((STATES, STATES), -60.0)
            for s in range(STATES):
                own = s % n
                step[s, n + own] = np.log(on)
                for r in range(n):
                    step[s, r] = np.log((1 - on) * self.follows[own][r])
            moves[fresh] = step
        start = np.full(STATES, -60.0)
        start[:n] = np.log(self.first)
        self.tables = {"emit": emit, "moves": moves, "start": start}


def _shares(counts: np.ndarray, prior: np.ndarray, weight: float = 5.0) -> tuple:
    """Shares of counts along the last axis, with a few counts of the prior shares; none is zero."""
    x = np.asarray(counts, float) + weight * np.asarray(prior, float)
    x = np.maximum(x / x.sum(-1, keepdims=True), 1e-5)
    x = x / x.sum(-1, keepdims=True)
    return tuple(map(tuple, x)) if x.ndim > 1 else tuple(x)


def fit(turns: DataFrame, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text", base: Parameters | None = None) -> Parameters:
    """Parameters with first roles, next roles and line classes counted over all turns of known role.

    Rows of other roles, or without an id, order number or role, are left out. The counts that are collected have a
    fixed size. A next turn is found by an equi-join on (id, number): no conversation meets in one task.
    """
    p = base or Parameters()
    prepare(turns.sparkSession)
    rows = turns.select(F.col(id_col).alias("c"), F.col(order_col).cast("long").alias("t"), F.col(role_col).cast("string").alias("r"), F.col(text_col).cast("string").alias("x")).where(F.col("r").isin(*ROLES))

    @F.arrow_udf("array<int>")
    def kinds(texts: pa.Array) -> pa.Array:
        return pa.array([[line_class(x) for x in (t or "").split("\n")] for t in texts.to_pylist()], pa.list_(pa.int32()))

    keys = rows.select("c", "t", "r").where("c IS NOT NULL AND t IS NOT NULL").distinct()
    after = keys.join(keys.selectExpr("c", "t - 1 t", "r nxt"), ["c", "t"]).groupBy("r", "nxt").count()
    first = keys.groupBy("c").agg(F.min(F.struct("t", "r")).alias("f")).groupBy("f.r").count()
    classes = np.zeros((len(ROLES), len(CLASSES)))
    follows, begins = np.zeros((len(ROLES),) * 2), np.zeros(len(ROLES))
    for r, k, n in rows.select("r", F.explode(kinds("x")).alias("k")).groupBy("r", "k").count().collect():
        classes[ROLES.index(r), k] = n
    for r, nxt, n in after.collect():
        follows[ROLES.index(r), ROLES.index(nxt)] = n
    for r, n in first.collect():
        begins[ROLES.index(r)] = n
    return Parameters(p.marked, p.stray, p.wrong, p.goes_on, p.breaks, _shares(begins, p.first), _shares(follows, p.follows), _shares(classes, p.classes))


def learn(fragments: DataFrame, base: Parameters | None = None, rounds: int = 3, id_col: str = "conv_id", order_col: str = "turn", text_col: str = "text") -> Parameters:
    """Parameters learned from transcripts without roles, by rounds of Viterbi and recounting.

    All rows count, in the blocks and the order in which chat_turns reads them. The model sees lines as codes of two
    bytes, which are written once; equal sequences of them are read once in a round. Only counts are collected.
    """
    p = base or Parameters()
    prepare(fragments.sparkSession)
    rows = _blocks(fragments.select(F.col(id_col).alias("conv_id"), F.col(order_col).cast("long").alias("turn"), F.col(text_col).cast("string").alias("text")))
    kind = rows.schema["conv_id"]
    own = to_arrow_type(kind.dataType)
    keys = [kind, T.StructField("b", T.LongType()), T.StructField("sub", T.LongType())]

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, 3):
            codes = np.array([_code(x) for x in _lines([r[5] or "" for r in run])], "<u2").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([run[0][0]], own), *(pa.array([run[0][k]], pa.int64()) for k in (1, 2)), pa.array([codes], pa.binary())], ["conv_id", "b", "sub", "codes"])

    schema = T.StructType([*keys, T.StructField("codes", T.BinaryType())])
    blocks = materialize(rows.repartition("conv_id", "b", "sub").sortWithinPartitions("conv_id", "b", "sub", "turn", "tie", "text").mapInArrow(seen, schema), "line-codes")
    spans = blocks.groupBy("conv_id").agg(F.min(F.struct("b", "sub")).alias("low"), F.count("*").alias("n")).where("n > 1").selectExpr("conv_id c", "low")
    spans = materialize(spans, "long-conversations")
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    whole = materialize(blocks.join(spans, same, "left_anti").groupBy("codes").agg(F.count("*").alias("times")), "sequences")
    tasks = min(8192, max(1, whole.count() >> 10))  # a scan would pack so small a table into few tasks
    whole = whole.selectExpr("codes", "-1 entry", "-1 leaves", "times").repartition(tasks)
    many = None
    if spans.limit(1).count():
        many = materialize(blocks.join(spans, same).select("conv_id", "b", "sub", "codes", (F.struct("b", "sub") == F.col("low")).alias("begins")), "long-codes")
    for _ in range(rounds):
        now = p

        def sums(batches: Iterator[pa.RecordBatch], now: Parameters = now) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for conv, at, sub, codes, begins in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    m = transfer(_decoded(codes), now, begins)
                    yield pa.RecordBatch.from_arrays([pa.array([conv], own), pa.array([at], pa.int64()), pa.array([sub], pa.int64()), pa.array([m.ravel().tolist()], pa.list_(pa.float64()))], ["conv_id", "b", "sub", "m"])

        def count(batches: Iterator[pa.RecordBatch], now: Parameters = now) -> Iterator[pa.RecordBatch]:
            total = _Counts()
            for b in batches:
                for codes, entry, leaves, times in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    lines = _decoded(codes)
                    total.add(lines, viterbi(lines, now, entry, leaves).tolist(), entry, times)
            yield pa.RecordBatch.from_arrays([pa.array([total.flat().tolist()], pa.list_(pa.float64()))], ["n"])

        read = whole
        if many is not None:
            bounds = _bounds(many.mapInArrow(sums, T.StructType([*keys, T.StructField("m", T.ArrayType(T.DoubleType()))])), kind)
            near = F.col("conv_id").eqNullSafe(F.col("c1")) & (F.col("b") == F.col("b1")) & (F.col("sub") == F.col("s1"))
            read = whole.unionByName(many.join(bounds, near).select("codes", "entry", "leaves", F.lit(1).cast("long").alias("times")))
        found = [r[0] for r in read.mapInArrow(count, "n array<double>").collect()]  # some dozen numbers for each task
        p = _Counts(np.sum(found, 0) if found else None).parameters(p)
    return p


class _Counts:
    """What Viterbi paths say of each parameter."""

    def __init__(self, flat: np.ndarray | None = None):
        n = len(ROLES)
        flat = np.zeros(10 + n + n * n + n * len(CLASSES)) if flat is None else flat
        self.pairs = flat[:10].reshape(5, 2)  # marked, stray, wrong, goes on, breaks: yes and all
        self.first, self.follows, self.classes = flat[10 : 10 + n], flat[10 + n : 10 + n + n * n].reshape(n, n), flat[10 + n + n * n :].reshape(n, -1)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.pairs, self.first, self.follows, self.classes)])

    def add(self, lines: list[Line], states: list[int], entry: int = -1, times: int = 1) -> None:
        """entry is the state before the first line (-1: a beginning); lines that occur several times count as often."""
        n, last = len(ROLES), None if entry < 0 else entry
        for line, s in zip(lines, states, strict=True):
            begins, own = s < n, s % n
            if begins:
                self.pairs[0] += (times * (line.role is not None), times)
                if line.role is not None:
                    self.pairs[2] += (times * (line.role != own), times)
            else:
                self.pairs[1] += (times * (line.role is not None), times)
            kind = line.rest_kind if begins and line.role is not None else line.kind
            if kind >= 0:
                self.classes[own, kind] += times
            if last is None:
                self.first[own] += times
            else:
                self.pairs[4 if line.fresh else 3] += (times * (begins == line.fresh), times)
                if begins:
                    self.follows[last % n, own] += times
            last = s

    def parameters(self, prior: Parameters) -> Parameters:
        old = (prior.marked, prior.stray, prior.wrong, prior.goes_on, prior.breaks)
        rates = [float(np.clip((yes + 5 * p) / (n + 5), 1e-4, 1 - 1e-4)) for (yes, n), p in zip(self.pairs, old, strict=True)]
        return Parameters(*rates, _shares(self.first, prior.first), _shares(self.follows, prior.follows), _shares(self.classes, prior.classes))


def _lines(texts: list[str]) -> list[Line]:
    out = []
    for i, text in enumerate(texts):
        for j, line in enumerate(text.split("\n")):
            role, rest = marker(line) or (None, line)
            out.append(Line(i, line, rest, role, line_class(line), -1 if rest is None else line_class(rest), j == 0))
    return out


def _code(line: Line) -> int:
    """All that the model sees of a line, as a number below 300."""
    return ((0 if line.role is None else line.role + 1) * len(CLASSES) + line.kind) * 12 + (line.rest_kind + 1) * 2 + line.fresh


def _decoded(codes: bytes) -> list[Line]:
    return list(map(_SEEN.__getitem__, np.frombuffer(codes, "<u2").tolist()))


#: The line of each code, without text.
_SEEN = [Line(0, "", None, None if x // 60 == 0 else x // 60 - 1, x // 12 % 5, x % 12 // 2 - 1, bool(x % 2)) for x in range(300)]


def _emissions(lines: list[Line], p: Parameters) -> np.ndarray:
    return np.array([p.tables["emit"][x.role, x.kind, x.rest_kind] for x in lines])


def viterbi(lines: list[Line], p: Parameters, entry: int = -1, leaves: int = -1) -> np.ndarray:
    """The best states; entry is the state before the first line (-1: a beginning), leaves the last one (-1: any)."""
    if not lines:
        return np.empty(0, int)
    emit, moves = _emissions(lines, p), p.tables["moves"]
    score = emit[0] + (p.tables["start"] if entry < 0 else moves[lines[0].fresh][entry])
    back = np.zeros((len(lines), STATES), np.int8)
    for t in range(1, len(lines)):
        step = score[:, None] + moves[lines[t].fresh]
        back[t] = step.argmax(0)
        score = step[back[t], np.arange(STATES)] + emit[t]
    path = np.empty(len(lines), int)
    path[-1] = score.argmax() if leaves < 0 else leaves
    for t in range(len(lines) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def transfer(lines: list[Line], p: Parameters, begins: bool) -> np.ndarray:
    """Best score of a block from each state before it to each state at its end (max-plus product)."""
    emit, moves = _emissions(lines, p), p.tables["moves"]
    total = np.tile(p.tables["start"], (STATES, 1)) + emit[0] if begins else moves[lines[0].fresh] + emit[0]
    for t in range(1, len(lines)):
        total = (total[:, :, None] + moves[lines[t].fresh][None]).max(1) + emit[t]
    return total


def turns_of(lines: list[Line], states: list[int]) -> list[tuple[int, int, int, str]]:
    """(fragment, part, role, text): markers go where a turn begins and nowhere else."""
    out: list[tuple[int, int, int, list[str]]] = []
    for line, s in zip(lines, states, strict=True):
        begins = s < len(ROLES)
        text = line.rest if begins and line.role is not None else line.text
        if begins or not out or out[-1][0] != line.fragment:
            part = out[-1][1] + 1 if out and out[-1][0] == line.fragment else 0
            out.append((line.fragment, part, s % len(ROLES), []))
        if text is not None:
            out[-1][3].append(text)
    return [(f, part, role, "\n".join(text)) for f, part, role, text in out]


def render(role: str, text: str) -> str:
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of equal first columns, from sorted batches."""
    last, run = None, []
    for b in batches:
        for row in zip(*(b.column(k).to_pylist() for k in range(b.num_columns)), strict=True):
            if row[:keys] != last and run:
                yield run
                run = []
            last = row[:keys]
            run.append(row)
    if run:
        yield run


def _blocks(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, text) with (b, sub), which name a row's block, and tie, its order beside equal numbers.

    A block has the rows of BLOCK consecutive order numbers. Where more rows than that share a number (or have
    none), that number, and all others of its block, become blocks of their own, cut by a hash of the text.
    """
    rows = rows.withColumn("tie", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("wide", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 54))).cast("long"))
    crowded = materialize(rows.groupBy("conv_id", "wide", "turn").agg(F.count("*").alias("c")).where(F.col("c") > BLOCK), "crowded")
    if crowded.limit(1).count() == 0:
        return rows.select("conv_id", F.col("wide").alias("b"), F.lit(0).cast("long").alias("sub"), "turn", "tie", "text")
    a = crowded.groupBy("conv_id", "wide").agg(F.lit(1).alias("split")).selectExpr("conv_id c1", "wide w1", "split")
    t = crowded.selectExpr("conv_id c2", "turn t2", "c")
    rows = rows.join(a, F.col("conv_id").eqNullSafe(F.col("c1")) & (F.col("wide") == F.col("w1")), "left")
    rows = rows.join(t, F.col("conv_id").eqNullSafe(F.col("c2")) & F.col("turn").eqNullSafe(F.col("t2")), "left")
    number = F.coalesce(F.col("turn") - F.col("wide") * BLOCK, F.lit(0))  # the place in the wide block
    sub = F.when(F.col("split").isNull(), F.lit(0)).otherwise(number * F.lit(1 << 40) + F.coalesce(F.floor((F.shiftright("tie", 32) + (1 << 31)) * (F.ceil(F.col("c") / BLOCK) / F.lit(float(1 << 32)))), F.lit(0)))
    return rows.select("conv_id", F.col("wide").alias("b"), sub.cast("long").alias("sub"), "turn", "tie", "text")


def _bounds(tables: DataFrame, kind: T.StructField) -> DataFrame:
    """(c1, b1, s1, entry, leaves): the best states before and at the end of each block of long conversations.

    tables (conv_id, b, sub, m) has each block's transfer().
    """
    own = to_arrow_type(kind.dataType)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one row for a block; of each, its name and the best state before each state are kept
        names: list[tuple] = []
        back: list[np.ndarray] = []
        score = None

        def ends() -> pa.RecordBatch:
            path = [int(score.argmax())]
            for b in reversed(back[1:]):
                path.append(int(b[path[-1]]))
            path = path[::-1]
            cols = list(zip(*names, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], own), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array([-1, *path[:-1]], pa.int32()), pa.array(path, pa.int32())], ["conv_id", "b", "sub", "entry", "leaves"])

        for batch in batches:
            for conv, b, sub, flat in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                m = np.array(flat).reshape(STATES, STATES)
                if names and names[-1][0] != conv:
                    yield ends()
                    names, back, score = [], [], None
                step = m if score is None else score[:, None] + m
                back.append(step.argmax(0).astype(np.int8))
                score = step.max(0)
                names.append((conv, b, sub))
        if names:
            yield ends()

    keys = [kind, T.StructField("b", T.LongType()), T.StructField("sub", T.LongType())]
    schema = T.StructType([*keys, T.StructField("entry", T.IntegerType()), T.StructField("leaves", T.IntegerType())])
    found = materialize(tables.repartition("conv_id").sortWithinPartitions("conv_id", "b", "sub").mapInArrow(chain, schema), "bounds")
    return found.selectExpr("conv_id c1", "b b1", "sub s1", "entry", "leaves")


def chat_turns(fragments: DataFrame, parameters: Parameters | None = None, id_col: str = "conv_id", order_col: str = "turn", text_col: str = "text") -> DataFrame:
    """Turns of raw transcripts: conv_id, turn, part, role, text, rendered; one row for each turn of a fragment.

    A fragment is a row of a transcript with one line or many, and one turn or several, in the order of order_col (a
    number; null first), then of a hash of the text. Roles of lines are hidden; markers ("User:", "[assistant]",
    "<|system|>", "### Human:") and the lines' looks are seen. Viterbi gives each line a role and tells where turns
    begin: a marker there is not text, any other line stays as it is, byte for byte, also one that looks like a
    marker. Other names than those of SPEAKERS are text of the turn that they stand in. A turn that goes on in the
    next fragment has a row in each. part counts the turns of a fragment from 0. Null texts are empty lines, a null
    conv_id is a conversation of its own, repeated rows follow one another, no rows give no rows, other columns are
    not read. A long text is held whole in one task.

    Conversations are read in blocks of 1024 order numbers, or of about as many rows where numbers are equal or null,
    so that a conversation with a third of all rows spreads over tasks: for those that have several blocks, each
    block gives its best scores from state to state (64 numbers), these are chained along the conversation (a few
    bytes are kept for each block), and blocks are then read between known states.
    """
    prepare(fragments.sparkSession)
    p = parameters or Parameters()
    rows = fragments.select(F.col(id_col).alias("conv_id"), F.col(order_col).cast("long").alias("turn"), F.col(text_col).cast("string").alias("text"))
    rows = _blocks(rows)
    kind = rows.schema["conv_id"]
    own = to_arrow_type(kind.dataType)
    low, high = (f(F.struct("b", "sub")) for f in (F.min, F.max))
    spans = materialize(rows.groupBy("conv_id").agg(low.alias("low"), high.alias("high")).where("low <> high"), "long-conversations")
    if spans.limit(1).count():
        firsts = spans.select(F.col("conv_id").alias("c"), "low")
        many = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "b", "sub", "turn", "tie", "text", (F.struct("b", "sub") == F.col("low")).alias("begins"))

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for run in _runs(batches, 3):
                m = transfer(_lines([r[5] or "" for r in run]), p, run[0][6])
                yield pa.RecordBatch.from_arrays([pa.array([run[0][0]], own), *(pa.array([run[0][k]], pa.int64()) for k in (1, 2)), pa.array([m.ravel().tolist()], pa.list_(pa.float64()))], ["conv_id", "b", "sub", "m"])

        a = T.StructType([kind, T.StructField("b", T.LongType()), T.StructField("sub", T.LongType()), T.StructField("m", T.ArrayType(T.DoubleType()))])
        bounds = _bounds(many.repartition("conv_id", "b", "sub").sortWithinPartitions("conv_id", "b", "sub", "turn", "tie", "text").mapInArrow(sums, a), kind)
        near = F.col("conv_id").eqNullSafe(F.col("c1")) & (F.col("b") == F.col("b1")) & (F.col("sub") == F.col("s1"))
        rows = rows.join(bounds, near, "left").select("conv_id", "b", "sub", "turn", "tie", "text", F.coalesce("entry", F.lit(-1)).alias("entry"), F.coalesce("leaves", F.lit(-1)).alias("leaves"))
    else:
        rows = rows.withColumn("entry", F.lit(-1)).withColumn("leaves", F.lit(-1))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for run in _runs(batches, 3):
            lines = _lines([r[5] or "" for r in run])
            states = viterbi(lines, p, run[0][6], run[0][7]).tolist()
            held += [(run[i][0], run[i][3], part, ROLES[role], text) for i, part, role, text in turns_of(lines, states)]
            if len(held) >= 2000:
                yield batch(held)
                held = []
        if held:
            yield batch(held)

    def batch(held: list[tuple]) -> pa.RecordBatch:
        arrays = [pa.array([h[0] for h in held], own), pa.array([h[1] for h in held], pa.int64()), pa.array([h[2] for h in held], pa.int32()), pa.array([h[3] for h in held]), pa.array([h[4] for h in held]), pa.array([render(h[3], h[4]) for h in held])]
        return pa.RecordBatch.from_arrays(arrays, ["conv_id", "turn", "part", "role", "text", "rendered"])

    schema = T.StructType([kind, T.StructField("turn", T.LongType()), T.StructField("part", T.IntegerType()), *(T.StructField(c, T.StringType()) for c in ("role", "text", "rendered"))])
    return rows.repartition("conv_id", "b", "sub").sortWithinPartitions("conv_id", "b", "sub", "turn", "tie", "text").mapInArrow(read, schema)


def as_transcripts(turns: DataFrame, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text", bare: int = 3) -> DataFrame:
    """Raw fragments (conv_id, turn, text) of turns of known role, marked in one of four ways by conversation.

    Every turn whose number has the remainder 1 by `bare` goes without a marker (bare = 0: none does).
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    title = F.initcap(role)
    way = F.pmod(F.xxhash64(F.col(id_col)), F.lit(4))
    marked = F.when(way == 0, F.concat(title, F.lit(": "), text)).when(way == 1, F.concat(F.lit("<|"), role, F.lit("|>\n"), text)).when(way == 2, F.concat(F.lit("["), F.upper(role), F.lit("] "), text)).otherwise(F.concat(F.lit("### "), title, F.lit(":\n"), text))
    plain = role == ""
    if bare:
        plain = plain | F.coalesce(F.pmod(F.col(order_col).cast("long"), F.lit(bare)) == 1, F.lit(False))
    return turns.select(F.col(id_col).alias("conv_id"), F.col(order_col).alias("turn"), F.when(plain, text).otherwise(marked).alias("text"))
