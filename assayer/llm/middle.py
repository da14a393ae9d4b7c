"""Fill-in-middle transformation by a parallel scan of a finite automaton.

The automaton reads UTF-8 bytes. Its state tells whether a line begins here and how much of a marker has been
read; it counts a line where the line's first byte is read. A text is cut into chunks, and each chunk gives its
transition function (entry state -> exit state) with a count of lines for each entry state, whatever comes before
it. Functions compose associatively: a prefix scan over the chunks of a text resolves their entry states, running
sums of the counts then name the chunk that holds a wanted cut, and only that chunk is read again to find its byte.

Texts of at most ``GIANT`` bytes are scanned in the task that holds them, many at once. Longer ones are written once,
their slices dealt out to all tasks, and a slice sends back its function and counts only (about 100 bytes);
a text's slices meet in one group: at most 65,536 of them, as a text has less than 2 GB. Two more chunk reads in the
task that holds the text then give the cuts.

Edge cases: a null text is an empty one, and an empty one is ``plain``; a null doc_id has no seed, so its row is
``plain``; a text that holds a marker is ``plain``; repeated rows give the same row each; an empty table gives an empty
result; a text without a line end is one line; other columns are ignored, whatever their names. With n lines there
are n + 1 places for each of the two cuts, equal ones included, so that any of the three parts may be empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.functions.text import let
from assayer.llm._common import Store, in_arrow, partitions, prepare, table

#: What stands before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
SEED = 7
#: Of 100 documents so many are transformed, and so many of those in the order suffix, prefix, middle.
MIDDLE_PERCENT, SPM_PERCENT = 100, 50

#: Bytes of a chunk in a task, of a slice of a long text, of a text that is scanned in slices, and of texts scanned at once.
CHUNK, SLICE, GIANT, BLOCK = 1 << 12, 1 << 15, 1 << 16, 1 << 18

PARTS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_PARTS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


@dataclass(frozen=True)
class Automaton:
    """Classes of bytes, ``step[state, class]`` and ``emit[state, class]``: what reading a byte adds to the count. State 0 is the first."""

    classes: np.ndarray
    step: np.ndarray
    emit: np.ndarray
    accepts: np.ndarray

    @property
    def still(self) -> np.ndarray:
        """Classes of which a second byte in a row changes neither state nor count, so that runs of them shrink to one."""
        twice = range(self.step.shape[1])
        again = np.stack([self.step[self.step[:, c], c] for c in twice], 1)
        more = np.stack([self.emit[self.step[:, c], c] for c in twice], 1)
        return (again == self.step).all(0) & (more == 0).all(0)

    def symbols(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Classes of the bytes of each chunk with runs shrunk, where each stands, and the chunks' new bounds."""
        c = self.classes[data]
        keep = np.ones(len(c), bool)
        keep[1:] = (c[1:] != c[:-1]) | ~self.still[c[1:]]
        keep[bounds[:-1][bounds[:-1] < len(c)]] = True
        at = np.flatnonzero(keep)
        return c[at], at, np.searchsorted(at, bounds)

    def functions(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each chunk data[bounds[i]:bounds[i + 1]] the exit state and the count for each entry state: [chunk, state].

        Neighbours are composed in pairs, level by level, all chunks at once."""
        symbols, _, b = self.symbols(data, bounds)
        states = self.step.shape[0]
        maps = np.concatenate([self.step.T[symbols], np.arange(states, dtype=np.uint8)[None]])
        counts = np.concatenate([self.emit.T[symbols].astype(np.int64), np.zeros((1, states), np.int64)])
        while (np.diff(b) > 1).any():
            new = np.concatenate([[0], np.cumsum((np.diff(b) + 1) // 2)])
            owner = np.repeat(np.arange(len(b) - 1), np.diff(new))
            left = b[owner] + 2 * (np.arange(new[-1]) - new[owner])
            right = np.where(left + 1 < b[owner + 1], left + 1, len(maps) - 1)
            first, last = maps[left], maps[-1:]
            counts = np.concatenate([counts[left] + np.take_along_axis(counts[right], first.astype(np.int64), 1), counts[-1:]])
            maps = np.concatenate([np.take_along_axis(maps[right], first.astype(np.int64), 1), last])
            b = new
        own = np.where(np.diff(b) == 1, b[:-1], len(maps) - 1)  # an empty chunk changes nothing
        return maps[own], counts[own]

    @staticmethod
    def entries(maps: np.ndarray, first: np.ndarray, start: np.ndarray | int = 0) -> np.ndarray:
        """Entry state of each function in a row of them: ``start`` where ``first``, else the exit state of the one before.

        A scan by doubling: a first function is made constant, so nothing before it shows through."""
        m = maps.astype(np.int64)
        at = np.flatnonzero(first)
        begin = np.broadcast_to(np.asarray(start), at.shape)
        m[at] = m[at, begin][:, None]
        longest = int(np.diff(np.append(at, len(m))).max(initial=1))
        d = 1
        while d < longest:
            m[d:] = np.take_along_axis(m[d:], m[:-d].copy(), 1)
            d *= 2
        out = np.empty(len(m), np.int64)
        out[1:] = m[:-1, 0]
        out[at] = begin
        return out

    def select(self, data: np.ndarray, bounds: np.ndarray, entry: np.ndarray, which: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Positions in ``data`` at which the k-th (from 0) count of chunk ``which`` falls; chunks are entered in states ``entry``."""
        symbols, at, b = self.symbols(data, bounds)
        first = np.zeros(len(symbols), bool)
        first[b[:-1]] = True
        state = self.entries(self.step.T[symbols], first, entry)
        total = np.cumsum(self.emit[state, symbols], dtype=np.int64)
        return at[np.searchsorted(total, np.concatenate([[0], total])[b[which]] + k + 1)]


@lru_cache(maxsize=8)
def line_automaton(markers: Sequence[str] = MARKERS) -> Automaton:
    """Counts lines (``[^\\n]*\\n|[^\\n]+``) where they begin; accepts once any of the markers has been read."""
    marks = [m.encode() for m in markers]
    if not all(marks) or any(b"\n" in m for m in marks):
        raise ValueError("markers are not empty and hold no line end")
    known = sorted({m[:i] for m in marks for i in range(len(m))})
    found = len(known)
    letters = sorted({x for m in marks for x in m} | {10})
    classes = np.full(256, len(letters), np.uint8)
    classes[letters] = np.arange(len(letters))

    def read(seen: int, byte: bytes) -> int:
        text = b"" if seen == found else known[seen] + byte
        if seen == found or any(text.endswith(m) for m in marks):
            return found
        return next(known.index(text[i:]) for i in range(len(text) + 1) if text[i:] in known)

    n = found + 1
    step = np.zeros((2 * n, len(letters) + 1), np.uint8)
    emit = np.zeros_like(step)
    for inside in (0, 1):
        for seen in range(n):
            for c in range(len(letters) + 1):
                byte = bytes([letters[c]]) if c < len(letters) else b"\0"
                step[inside * n + seen, c] = (byte != b"\n") * n + read(seen, byte)
                emit[inside * n + seen, c] = not inside
    return Automaton(classes, step, emit, np.arange(2 * n) % n == found)


def draws(doc_id: int, seed: int = SEED) -> list[int]:
    """The first four 8-digit groups of the digest of ``seed:doc_id``."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def chosen(doc_id: int | None, n: int, marked: bool, seed: int, middle_percent: int, spm_percent: int) -> tuple[str, int, int]:
    """Form and the two cuts, in lines."""
    if doc_id is None or not n or marked:
        return "plain", 0, 0
    h1, h2, h3, h4 = draws(doc_id, seed)
    if h3 % 100 >= middle_percent:
        return "plain", 0, 0
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return ("spm" if h4 % 100 < spm_percent else "psm"), a, b


def assembled(text: bytes, form: str, a: int, b: int, markers: Sequence[str]) -> bytes:
    """The output for cuts at the bytes a and b."""
    if form == "plain":
        return text
    p, s, m = (x.encode() for x in markers)
    if form == "psm":
        return b"".join((p, text[:a], s, text[b:], m, text[a:b]))
    return b"".join((s, text[b:], p, text[:a], m, text[a:b]))


def n_chars(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column and where each begins (one entry more than texts); null as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)), at - at[0]


def cut_bytes(auto: Automaton, data: np.ndarray, at: np.ndarray, choose) -> Iterator[tuple[int, str, int, int]]:
    """(n, form, a, b) of each text data[at[i]:at[i + 1]], a and b in its bytes; ``choose(i, n, marked)`` gives form and cuts in lines."""
    parts = np.maximum(-(-np.diff(at) // CHUNK), 1)
    texts = np.concatenate([[0], np.cumsum(parts)])  # chunks of text i: texts[i] .. texts[i + 1]
    owner = np.repeat(np.arange(len(parts)), parts)
    bounds = np.append(at[owner] + CHUNK * (np.arange(texts[-1]) - texts[owner]), at[-1])
    maps, counts = auto.functions(data, bounds)
    first = np.zeros(len(owner), bool)
    first[texts[:-1]] = True
    entry = auto.entries(maps, first)
    rows = np.arange(len(owner))
    total = np.cumsum(counts[rows, entry])
    last = texts[1:] - 1
    before = np.concatenate([[0], total])[texts[:-1]]
    n = total[last] - before
    marked = auto.accepts[maps[last, entry[last]]]
    picks = [choose(i, int(n[i]), bool(marked[i])) for i in range(len(n))]
    # only cuts inside a text are searched: the first line begins at 0, one after the last at the end
    wanted = [(i, side, cut) for i, (_, *cuts) in enumerate(picks) for side, cut in enumerate(cuts) if 0 < cut < n[i]]
    cuts = np.zeros((len(n), 2), np.int64)
    for i, (_, a, b) in enumerate(picks):
        cuts[i] = [at[i + 1] - at[i] if x and x == n[i] else 0 for x in (a, b)]
    if wanted:
        i, side, cut = np.array(wanted).T
        chunk = np.searchsorted(total, before[i] + cut, "right")
        k = before[i] + cut - np.concatenate([[0], total])[chunk]
        used, which = np.unique(chunk, return_inverse=True)
        own = np.concatenate([[0], np.cumsum(bounds[used + 1] - bounds[used])])
        picked = np.concatenate([data[x:y] for x, y in zip(bounds[used], bounds[used + 1], strict=True)])
        cuts[i, side] = auto.select(picked, own, entry[used], which, k) - own[which] + bounds[chunk] - at[i]
    for j, (form, _, _) in enumerate(picks):
        yield int(n[j]), form, int(cuts[j, 0]), int(cuts[j, 1])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _PARTS]
    arrays = [pa.array(c, pa.large_binary() if f.name == "output" else f.type) for c, f in zip(columns, _PARTS, strict=True)]
    arrays[-1] = arrays[-1].cast(pa.large_string()).cast(pa.string())
    return pa.RecordBatch.from_arrays(arrays, schema=_PARTS)


def _row(doc_id: int | None, data: np.ndarray, n: int, form: str, a: int, b: int, markers: Sequence[str]) -> tuple:
    plain = form == "plain"
    return doc_id, n, form, None if plain else n_chars(data[:a]), None if plain else n_chars(data[a:b]), assembled(data.tobytes(), form, a, b, markers)


def _short(markers: Sequence[str], *draw: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = line_automaton(markers)
        for batch in batches:
            ids, (data, at) = batch.column(0).to_pylist(), flat(batch.column(1))
            begin = 0
            while begin < len(ids):  # as many texts as fit into a block
                end = max(begin + 1, int(np.searchsorted(at, at[begin] + BLOCK, "right")) - 1)
                own, part = at[begin : end + 1] - at[begin], data[at[begin] : at[end]]
                found = cut_bytes(auto, part, own, lambda i, n, marked, begin=begin: chosen(ids[begin + i], n, marked, *draw))
                yield _rows([_row(ids[begin + i], part[own[i] : own[i + 1]], *x, markers) for i, x in enumerate(found)])
                begin = end

    return run


# -- long texts ---------------------------------------------------------------------------------------


def slice_bounds(data: np.ndarray, size: int) -> np.ndarray:
    """Where slices of about ``size`` bytes begin, and the end."""
    return np.append(np.arange(0, max(len(data), 1), size), len(data))


def _slices(size: int):
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("no", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = flat(batch.column(2))
            for i, (key, doc_id) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                own = data[at[i] : at[i + 1]]
                b = slice_bounds(own, size)
                for lo in range(0, len(b) - 1, 64):
                    hi = min(lo + 64, len(b) - 1)
                    yield pa.RecordBatch.from_arrays([pa.array([key] * (hi - lo), pa.int64()), pa.array([doc_id] * (hi - lo), pa.int64()), pa.array(range(lo, hi), pa.int64()), pa.array([own[b[j] : b[j + 1]].tobytes() for j in range(lo, hi)], pa.binary())], schema=schema)

    return run


def _functions(markers: Sequence[str]):
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("no", pa.int64()), ("exits", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = line_automaton(markers)
        for batch in batches:
            pieces = batch.column(3).to_pylist()
            step = max(1, BLOCK // max(map(len, pieces), default=1))
            for lo in range(0, len(pieces), step):
                some = pieces[lo : lo + step]
                maps, counts = auto.functions(np.frombuffer(b"".join(some), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in some])]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, step).columns[:3], pa.array([x.tobytes() for x in maps], pa.binary()), pa.array([x.tobytes() for x in counts], pa.binary())], schema=schema)

    return run


_PLACES = "key long, n long, form string, a_no long, a_entry long, a_k long, b_no long, b_entry long, b_k long"


def _resolve(markers: Sequence[str], *draw: int):
    """Composes the functions of a text's slices and names, for each cut, its slice, that slice's entry state and the line in it."""

    def run(rows: pa.Table) -> pa.Table:
        auto = line_automaton(markers)
        states = auto.step.shape[0]
        rows = rows.sort_by("no")
        maps = np.frombuffer(b"".join(rows["exits"].to_pylist()), np.uint8).reshape(-1, states)
        counts = np.frombuffer(b"".join(rows["counts"].to_pylist()), np.int64).reshape(-1, states)
        entry = auto.entries(maps, np.arange(len(maps)) == 0)
        total = np.cumsum(counts[np.arange(len(maps)), entry])
        n = int(total[-1])
        form, *cuts = chosen(rows["doc_id"][0].as_py(), n, bool(auto.accepts[maps[-1, entry[-1]]]), *draw)
        out = {"key": rows["key"][0].as_py(), "n": n, "form": form}
        for name, cut in zip("ab", cuts, strict=True):
            no = int(np.searchsorted(total, cut, "right"))
            inside = no < len(maps)
            out |= {f"{name}_no": no, f"{name}_entry": int(entry[no]) if inside else 0, f"{name}_k": cut - (int(total[no - 1]) if no else 0) if inside else 0}
        return pa.Table.from_pylist([out], pa.schema([(x, pa.string() if x == "form" else pa.int64()) for x in out]))

    return run


def _finish(markers: Sequence[str], size: int):
    """Reads the slices that hold the cuts again and puts the parts in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = line_automaton(markers)
        for batch in batches:
            data, at = flat(batch.column(1))
            ids, rest = batch.column(0).to_pylist(), batch.select(batch.schema.names[2:]).to_pylist()
            for i, (doc_id, x) in enumerate(zip(ids, rest, strict=True)):
                own = data[at[i] : at[i + 1]]
                bounds = slice_bounds(own, size)
                cuts = [0, 0]
                for side, name in enumerate("ab" if x["form"] != "plain" else ""):
                    no = x[f"{name}_no"]
                    if no + 1 >= len(bounds):
                        cuts[side] = len(own)
                        continue
                    part = own[bounds[no] : bounds[no + 1]]
                    cuts[side] = int(bounds[no]) + int(auto.select(part, np.array([0, len(part)]), x[f"{name}_entry"], np.zeros(1, int), np.array([x[f"{name}_k"]]))[0])
                yield _rows([_row(doc_id, own, x["n"], x["form"], *cuts, markers)])

    return run


def fill_in_middle(docs: DataFrame, seed: int = SEED, middle_percent: int = MIDDLE_PERCENT, spm_percent: int = SPM_PERCENT, markers: Sequence[str] = MARKERS, giant: int = GIANT, slice_bytes: int = SLICE) -> DataFrame:
    """doc_id, n (lines), form (plain, psm, spm), prefix_chars, middle_chars (null if plain) and the output text of every document."""
    spark = docs.sparkSession
    prepare(spark)
    markers, draw = tuple(markers), (seed, middle_percent, spm_percent)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    short = in_arrow(docs.where(size <= giant), _short(markers, *draw), PARTS)
    # keys are made once, in the written table
    large = Store(spark).keep(docs.where(size > giant).select(F.monotonically_increasing_id().alias("key"), "doc_id", "text"))
    slices = in_arrow(large, _slices(slice_bytes), "key long, doc_id long, no long, data binary").repartition(partitions(spark), "key", "no")
    functions = in_arrow(slices, _functions(markers), "key long, doc_id long, no long, exits binary, counts binary")
    places = functions.groupBy("key").applyInArrow(_resolve(markers, *draw), _PLACES)
    long = in_arrow(large.join(places, "key").drop("key"), _finish(markers, slice_bytes), PARTS)
    return short.unionByName(long)


def restored(form: Column, output: Column, markers: Sequence[str] = MARKERS) -> Column:
    """The text of an output: its parts in their first order."""
    p, s, m = markers
    left = lambda c, mark: F.substring_index(c, mark, 1)
    right = lambda c, mark: F.substring_index(c, mark, -1)
    psm = let(right(output, p), lambda x: F.concat(left(x, s), right(x, m), left(right(x, s), m)))
    spm = let(right(output, s), lambda x: F.concat(left(right(x, p), m), right(x, m), left(x, p)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the output and of the text restored from it, for every document."""
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return fill_in_middle(table(spark, sf_dir, "documents")).select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("form"), F.col("output"))).alias("restored_sha256"))
