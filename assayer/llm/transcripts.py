"""Chat formatting: roles of raw transcripts by a hidden Markov model, rendered as canonical turns.

A transcript is lines; each line has a state, a role with a flag of whether a turn begins there. A line is
seen through categorical features: what its speaker's word is like (a role's word, one that differs from it
in a letter, another word, none), its marker's shape, whether the transcript begins, its length, its first
and last character. Emissions and
transitions are counted on a bounded sample of conversations whose roles are known, written in several
marker styles, with markers left out and misspelt. Viterbi finds the states of a transcript, and lines of a
turn are joined and rendered between role tokens.

A transcript may be cut into parts; its states are those of the whole. Of each part a matrix tells how
probable its best path is between any state before it and any state at its end. Matrices of neighbouring
parts multiply (in the algebra of maximum and sum), ``WIDTH`` at a time and level by level, until one is
left; the best states at the borders are then handed down, and each part is decoded between its own. So no
task ever has more of a conversation than a part, or ``WIDTH`` matrices.

Conversations become transcripts in parts of 64 turn numbers. Where more than ``CROWD`` rows have a turn
number of a conversation in common, the rows of each turn number are dealt to parts by a hash, equal rows by
their number.

Edge cases: null texts are empty turns; null roles, and roles outside the three, have no marker and get the
role that the model finds; a row of null conv_id is a transcript of its own; null turns come first; rows that
repeat a turn follow one another by role and text; texts of any length are read whole; of equally probable
states the first is taken (of ``STATES``); an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm._common import Store, in_arrow, partitions, prepare, table

ROLES = ("system", "user", "assistant")
#: Speaker words of each role; the first of each is used by the first styles, and so on.
SPEAKERS = {"system": ("system", "instructions", "context"), "user": ("user", "human", "question"), "assistant": ("assistant", "model", "answer")}
#: Marker styles: what stands before and after the speaker's word, its case.
STYLES = (("", ": ", "title"), ("### ", ":\n", "title"), ("[", "] ", "lower"), ("<", "> ", "lower"), ("**", ":** ", "title"), ("", "> ", "upper"))
#: Of so many turns one has no marker, and one a misspelt word.
BARE, MISSPELT = 9, 11
#: Conversations that the model is fitted on: those with the smallest hashes of their ids; and turns of each that it is fitted on.
TRAINING, FITTED = 1500, 64
#: Turn numbers of a part; rows that may share one of a conversation; children of a node of matrices.
SEGMENT, CROWD, WIDTH = 64, 64, 64
#: Ids of cut transcripts up to which they are broadcast; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
TURN, END = "<|{}|>\n", "<|end|>\n"
RESULT = "conv_id long, segment long, part long, n_turns long, continued boolean, roles array<string>, texts array<string>, chat string"

_ROLE_OF = {w: r for r, words in SPEAKERS.items() for w in words}
_MARKER = re.compile(r"\s*(#{1,6}\s*|\*\*|[\[<(])?\s*([A-Za-z]{1,15})\s*((?:[\])>]|:\*\*|:|>)+)(?:\s|$)")
#: What a speaker's word is like: a role's word, nearly one, another word, none.
KINDS = (*ROLES, *(f"near {r}" for r in ROLES), "other", "none")
#: Sizes of the features: kind, shape of the marker, transcript begins, length, first and last character.
SIZES = (len(KINDS), 7, 2, 5, 4, 4)
STATES = [(role, begins) for role in ROLES for begins in (True, False)]
#: Stands for the state before a transcript, beside those of STATES.
START = len(STATES)


def near(word: str, other: str) -> bool:
    """Whether two words differ by one letter changed, left out, put in, or by two neighbours swapped."""
    if abs(len(word) - len(other)) > 1 or word == other:
        return False
    i = 0
    while i < min(len(word), len(other)) and word[i] == other[i]:
        i += 1
    a, b = word[i:], other[i:]
    return a[1:] == b[1:] or a[1:] == b or a == b[1:] or len(a) > 1 and len(b) > 1 and a[0] == b[1] and a[1] == b[0] and a[2:] == b[2:]


_KIND: dict[str, int] = {}


def kind_of(word: str) -> int:
    """Of a speaker's word the index in KINDS."""
    if word not in _KIND:
        if len(_KIND) > 50_000:
            _KIND.clear()
        close = next((KINDS.index(f"near {r}") for w, r in _ROLE_OF.items() if near(word, w)), 6)
        _KIND[word] = KINDS.index(_ROLE_OF[word]) if word in _ROLE_OF else close
    return _KIND[word]


def features(line: str, first: bool) -> tuple[int, ...]:
    """What a line is seen through."""
    m = _MARKER.match(line)
    word = m[2].lower() if m else ""
    kind = kind_of(word) if m else 7
    shape = 0 if not m else 1 + ("", "#", "*", "[", "<", "(").index((m[1] or "").strip()[:1])
    bare = (line[m.end() :] if m else line).strip()
    start = 0 if not bare else 1 if bare[0].isupper() else 2 if bare[0].isalnum() else 3
    end = 0 if not bare else 1 if bare[-1] in ".!" else 2 if bare[-1] == "?" else 3
    return kind, shape, int(first), int(np.searchsorted((1, 40, 120, 400), len(bare), "right")), start, end


def strip_marker(line: str) -> str:
    m = _MARKER.match(line)
    return line[m.end() :] if m else line


class Model:
    """Smoothed log-probabilities of transitions (the last row: starts) and emissions."""

    def __init__(self, smoothing: float = 0.5):
        n = len(STATES)
        self.move = np.full((n + 1, n), smoothing)
        self.emit = [np.full((n, k), smoothing) for k in SIZES]
        for i, (role, begins) in enumerate(STATES):
            if begins:  # a marker of a role begins a turn of it, most of the time
                self.emit[0][i, ROLES.index(role)] += 20
                self.emit[0][i, 3 + ROLES.index(role)] += 4
            else:
                self.emit[0][i, 7] += 20
                self.move[START, i] = 1e-9
            for j, (other, fresh) in enumerate(STATES):
                if not fresh and other != role:
                    self.move[i, j] = 1e-9  # a turn goes on in its own role

    def learn(self, lines: list[str], states: list[int]) -> None:
        before = START
        for t, (line, s) in enumerate(zip(lines, states, strict=True)):
            for table_, f in zip(self.emit, features(line, not t), strict=True):
                table_[s, f] += 1
            self.move[before, s] += 1
            before = s

    def freeze(self) -> Model:
        self.move = np.log(self.move / self.move.sum(1, keepdims=True))
        self.emit = [np.log(e / e.sum(1, keepdims=True)) for e in self.emit]
        return self

    def emitted(self, lines: list[str], first: bool) -> np.ndarray:
        """Log-probabilities of the lines in each state. ``first``: the transcript begins with them."""
        seen = np.array([features(x, first and not t) for t, x in enumerate(lines)])
        return sum(e[:, seen[:, k]] for k, e in enumerate(self.emit)).T

    def matrix(self, lines: list[str], first: bool) -> np.ndarray:
        """Of a part: log-probability of its best path from each state before it (or START) to each state at its end."""
        out = None
        for e in self.emitted(lines, first):
            out = self.move + e if out is None else product(out, self.move + e)
        return out

    def viterbi(self, lines: list[str], first: bool = True, before: int = START, last: int | None = None) -> list[int]:
        """The most probable states of lines, given the state before them and the one at their end."""
        if not lines:
            return []
        emitted = self.emitted(lines, first)
        best = self.move[before] + emitted[0]
        back = np.zeros((len(lines), len(STATES)), np.int8)
        for t in range(1, len(lines)):
            ways = best[:, None] + self.move[:START]
            back[t] = ways.argmax(0)
            best = ways.max(0) + emitted[t]
        path = [int(best.argmax()) if last is None else last]
        for t in range(len(lines) - 1, 0, -1):
            path.append(int(back[t, path[-1]]))
        return path[::-1]

    def parse(self, transcript: str | None, first: bool = True, before: int = START, last: int | None = None) -> tuple[list[tuple[str, str]], bool]:
        """Turns (role, text) of a transcript or of a part of one, and whether the first goes on from the part before."""
        if not transcript:
            return [], False
        lines = transcript.split("\n")
        states = self.viterbi(lines, first, before, last)
        turns: list[tuple[str, list[str]]] = []
        for line, s in zip(lines, states, strict=True):
            role, begins = STATES[s]
            if begins:
                rest = strip_marker(line)
                turns.append((role, [rest] if rest or rest == line else []))
            elif turns:
                turns[-1][1].append(line)
            else:
                turns.append((role, [line]))
        return [(role, "\n".join(text)) for role, text in turns], not first and not STATES[states[0]][1]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Best paths through two parts, one after the other."""
    return (a[:, :, None] + b[None, :START]).max(1)


def best_between(parts: list[np.ndarray], before: int, last: int | None) -> list[tuple[int, int]]:
    """The states before and at the end of each of the parts on the best path, given those before and at the end of all."""
    best, backs = None, []
    for m in parts:
        ways = m[before][None] if best is None else best[:, None] + m[:START]
        backs.append(ways.argmax(0))
        best = ways.max(0)
    ends = [int(best.argmax()) if last is None else last]
    for back in reversed(backs[1:]):
        ends.append(int(back[ends[-1]]))
    ends.reverse()
    return list(zip([before, *ends[:-1]], ends, strict=True))


def marker(role: str | None, style: int) -> str:
    if role not in SPEAKERS:
        return ""
    before, after, case = STYLES[style % len(STYLES)]
    return before + getattr(SPEAKERS[role][style % len(SPEAKERS[role])], case)() + after


def misspelt(marker: str) -> str:
    """A marker whose speaker's word lacks its second letter."""
    at = next((i for i, c in enumerate(marker) if c.isalpha()), 0)
    return marker[: at + 1] + marker[at + 2 :]


def written(turns: list[tuple[str, str]], style: int) -> tuple[str, list[int]]:
    """A transcript of turns in a style, with some markers left out or misspelt, and the states of its lines."""
    lines: list[str] = []
    states: list[int] = []
    for k, (role, text) in enumerate(turns):
        given = marker(role, style)
        given = "" if (k + style) % BARE == BARE - 1 else misspelt(given) if (k + style) % MISSPELT == MISSPELT - 1 else given
        own = (given + text).split("\n")
        lines += own
        states += [STATES.index((role, not j)) for j in range(len(own))]
    return "\n".join(lines), states


def rendered(turns: list[tuple[str, str]]) -> str:
    """The canonical form; role tokens inside a text are broken by a zero-width space."""
    return "".join(TURN.format(role) + text.replace("<|", "<\u200b|") + "\n" + END for role, text in turns)


def fit(conversations: DataFrame, styles: tuple[int, ...] = tuple(range(len(STYLES)))) -> Model:
    """Counts the first turns of the sample's conversations in every style."""
    known = conversations.where(F.col("role").isin(*ROLES) & F.col("conv_id").isNotNull())
    ids = known.select("conv_id").distinct().orderBy(F.xxhash64("conv_id"), "conv_id").limit(TRAINING)
    rows = known.join(F.broadcast(ids), "conv_id").where(F.col("turn") < FITTED).groupBy("conv_id", "turn").agg(F.min(F.struct("role", F.coalesce("text", F.lit("")).alias("text"))).alias("r")).select("conv_id", "turn", "r.role", "r.text").orderBy("conv_id", "turn").collect()
    model = Model()
    turns: list[tuple[str, str]] = []
    for i, r in enumerate(rows):
        turns.append((r["role"], r["text"]))
        if i + 1 == len(rows) or rows[i + 1]["conv_id"] != r["conv_id"]:
            for style in styles:
                text, states = written(turns, style)
                model.learn(text.split("\n"), states)
            turns = []
    return model.freeze()


# -- transcripts from rows --------------------------------------------------------------------------


def _marker_column(style: Column) -> Column:
    out = F.lit("")
    for k in range(len(STYLES)):
        for role in ROLES:
            out = F.when((style == k) & (F.col("role") == role), F.lit(marker(role, k))).otherwise(out)
    dice = F.pmod(F.xxhash64("conv_id", "turn", F.lit(7)), F.lit(BARE * MISSPELT))
    at = F.regexp_instr(out, F.lit("[A-Za-z]"))
    wrong = F.concat(F.substring(out, F.lit(1), at), F.substring(out, at + 2, F.length(out)))
    return F.when(dice % BARE == 0, "").when(dice % MISSPELT == 0, wrong).otherwise(out)


def as_transcripts(conversations: DataFrame) -> DataFrame:
    """(conv_id, segment, part, transcript): turns in order, each with a speaker marker in a style that the conversation's hash
    picks; some markers are left out and some misspelt. ``segment`` and ``part`` order the parts of a conversation."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(STYLES)))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    line = F.concat(_marker_column(style), "text").alias("line")
    alone = rows.where("conv_id IS NULL").select("conv_id", F.coalesce("turn", F.lit(0)).alias("segment"), F.lit(0).cast("long").alias("part"), F.concat(_marker_column(F.lit(0)), "text").alias("transcript"))
    known = rows.where("conv_id IS NOT NULL")
    crowded = known.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).groupBy("conv_id").agg(F.max("n").alias("most"))
    ordinary = known
    parts = None
    if not crowded.isEmpty():
        ordinary = known.join(crowded, "conv_id", "left_anti")
        # equal rows get numbers, so that each lands in the same part whenever it is computed
        each = known.join(crowded, "conv_id").groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"), F.max("most").alias("most"))
        each = each.select("conv_id", "turn", "role", "text", "most", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("i"))
        own = F.pmod(F.xxhash64("role", "text", "i"), F.ceil(F.col("most") / CROWD))
        least = F.lit(-(2**62))
        parts = each.select("conv_id", F.coalesce("turn", least).alias("segment"), own.alias("part"), F.struct("turn", "role", line).alias("t"))
    rest = ordinary.select("conv_id", F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit(-(2**62))).alias("segment"), F.lit(0).cast("long").alias("part"), F.struct("turn", "role", line).alias("t"))
    rest = rest if parts is None else rest.unionByName(parts)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["line"]), "\n")
    return rest.groupBy("conv_id", "segment", "part").agg(joined.alias("transcript")).unionByName(alone)


# -- decoding ---------------------------------------------------------------------------------------

_NODE = "conv_id long, a long, b long"


def _matrices(model: Model):
    """Rows (conv_id, a, b, transcript, first): the part's matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.matrix((x or "").split("\n"), f).tobytes() for x, f in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(found, pa.binary())], names=["conv_id", "a", "b", "matrix"])

    return run


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Runs of rows (conv_id, over a, over b, ...) of one node; there are at most WIDTH."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and row[:3] != held[0][:3]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _square(x: bytes) -> np.ndarray:
    return np.frombuffer(x).reshape(START + 1, START)


def _up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, over a, over b, a, b, matrix): a node's product."""
    for rows in _families(batches):
        out = _square(rows[0][5])
        for row in rows[1:]:
            out = product(out, _square(row[5]))
        yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in rows[0][:3]), pa.array([out.tobytes()], pa.binary())], names=["conv_id", "a", "b", "matrix"])


def _down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, over a, over b, a, b, matrix, before, last): states before and at the end of a node's children, given its own."""
    for rows in _families(batches):
        states = best_between([_square(r[5]) for r in rows], rows[0][6], rows[0][7])
        columns = [pa.array([r[k] for r in rows], pa.int64()) for k in (0, 3, 4)] + [pa.array(x, pa.int32()) for x in zip(*states, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "a", "b", "before", "last"])


def with_border_states(parts: DataFrame, model: Model, store: Store) -> DataFrame:
    """The parts (conv_id, segment, part, transcript; a written table) of cut transcripts with ``first``, ``before`` and ``last``:
    whether the transcript begins there, and the states at the borders on the best path of the whole."""
    n = partitions(parts.sparkSession)
    nulls = F.lit(-(2**62))
    base = parts.groupBy("conv_id").agg(F.min(F.when(F.col("segment") != nulls, F.col("segment"))).alias("base"), F.min(F.struct("segment", "part")).alias("f"))
    rows = parts.join(base, "conv_id").select("conv_id", "segment", "part", "transcript", F.when(F.col("segment") == nulls, F.lit(0).cast("long")).otherwise(F.col("segment") - F.col("base") + 1).alias("a"), F.col("part").alias("b"), (F.struct("segment", "part") == F.col("f")).alias("first"))
    rows = store.keep(rows)
    most = rows.agg(F.max("a").alias("a"), F.max("b").alias("b")).first()
    now = store.keep(in_arrow(rows.select("conv_id", "a", "b", "transcript", "first"), _matrices(model), f"{_NODE}, matrix binary"))
    families, order = ["conv_id", "over_a", "over_b"], ["conv_id", "over_a", "over_b", "a", "b"]

    def levels() -> Iterator[tuple[Column, Column]]:
        """What a node's children have in common: a part number over WIDTH, then a segment over WIDTH."""
        size = most["b"] or 0
        while size:
            size //= WIDTH
            yield F.col("a"), F.floor(F.col("b") / WIDTH)
        size = most["a"] or 0
        while size:
            size //= WIDTH
            yield F.floor(F.col("a") / WIDTH), F.lit(0).cast("long")

    up: list[DataFrame] = []
    for over_a, over_b in levels():
        children = store.keep(now.select("conv_id", over_a.alias("over_a"), over_b.alias("over_b"), "a", "b", "matrix"))
        up.append(children)
        now = store.keep(in_arrow(children.repartition(n, *families).sortWithinPartitions(*order), _up, f"{_NODE}, matrix binary"))
    states = now.select("conv_id", "a", "b", F.lit(START).alias("before"), F.lit(None).cast("int").alias("last"))
    for children in reversed(up):
        given = children.join(states.select("conv_id", F.col("a").alias("over_a"), F.col("b").alias("over_b"), "before", "last"), families)
        given = given.select(*order, "matrix", "before", "last").repartition(n, *families).sortWithinPartitions(*order)
        states = store.keep(in_arrow(given, _down, f"{_NODE}, before int, last int"))
    return rows.join(states, ["conv_id", "a", "b"]).select("conv_id", "segment", "part", "transcript", "first", "before", "last")


def _parse(model: Model):
    """Rows (conv_id, segment, part, transcript, first, before, last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parsed = [model.parse(*row) for row in zip(*(b.column(k).to_pylist() for k in range(3, 7)), strict=True)]
            found, goes_on = [p[0] for p in parsed], [p[1] for p in parsed]
            columns = [
                b.column(0),
                b.column(1),
                b.column(2),
                pa.array([len(f) for f in found], pa.int64()),
                pa.array(goes_on, pa.bool_()),
                pa.array([[r for r, _ in f] for f in found], pa.list_(pa.string())),
                pa.array([[t for _, t in f] for f in found], pa.list_(pa.string())),
                pa.array(list(map(rendered, found)), pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in RESULT.split(", ")])

    return run


def format_chats(transcripts: DataFrame, model: Model) -> DataFrame:
    """One row per transcript or part of one (conv_id, segment, part, transcript): its turns, their roles and the canonical chat.
    ``continued``: the part's first turn is the end of the one before."""
    spark = transcripts.sparkSession
    prepare(spark)
    names = ["conv_id", "segment", "part", "transcript"]
    cut = transcripts.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1").select("conv_id")
    whole = transcripts.select(*names)
    alone = [F.lit(True).alias("first"), F.lit(START).alias("before"), F.lit(None).cast("int").alias("last")]
    many = cut.count()
    if not many:
        return in_arrow(whole.select(*names, *alone), _parse(model), RESULT)
    store = Store(spark)
    ids = F.broadcast(cut) if many <= BROADCAST_IDS else cut
    parts = with_border_states(store.keep(whole.join(ids, "conv_id", "left_semi").select(*names)), model, store)
    whole = whole.join(ids, "conv_id", "left_anti").select(*names, *alone)
    return in_arrow(whole.unionByName(parts), _parse(model), RESULT)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and canonical chats of every conversation, written as transcripts first."""
    conversations = table(spark, sf_dir, "conversations")
    return format_chats(as_transcripts(conversations), fit(conversations))
