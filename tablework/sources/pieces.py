"""Records whose ends only a running state tells, read from splittable files
(H3 quoted line breaks in CSV, H6 JSON arrays).

A file is read in pieces - CSV by line break, JSON by ``}`` - with Spark's
split-parallel text source.  Whether a piece ends a record depends on all the
file before it: is the text inside quotes, and how deep is it nested?  Each
piece is summarised as a small function of that state (a built-in
expression), and functions compose:

1. One scan composes the functions of every split to one row.
2. Those rows - one for each split - are put in order file by file, which
   gives the state at every split's start.
3. A second scan walks each split from its known state and joins its pieces
   to records.  What is left at the two edges of a split - at most two
   fragments - meets the neighbours' fragments in a grouping by record.

So a file of any size is read by as many tasks as it has splits.

A piece has two outcomes, for a start outside and inside of quotes: the mode
after it (``t``: 0 same, 1 the other one, 2 outside, 3 inside) and the change
of depth (``d0``, ``d1``).  A record ends where the mode is outside and the
depth is ``base``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PATH = "_path"
_RECORD = "_path string, _start long, _at long, _whole boolean, _opens boolean, _closes boolean, _first boolean, value binary"


def text_pieces(spark: SparkSession, paths: list[str], sep: str | None = None) -> DataFrame:
    """(_path, _start: where the piece's split begins, value) of text files."""
    r = spark.read.format("text")
    if sep:
        r = r.option("lineSep", sep)
    return r.load(paths).select(
        F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias(PATH),
        F.col("_metadata.file_block_start").alias("_start"), "value")


# ------------------------------------------------------------ what a piece does
def csv_outcome(value: Column, sep: str) -> list[Column]:
    """t, d0, d1 of a CSV line.  A quote opens a field only at its beginning;
    inside, two quotes stand for one; what follows a closing quote belongs to
    the field until the next separator, as Spark's parser has it."""
    parts = F.split(value, '"', -1)
    before = F.slice(parts, 1, F.size(parts) - 1)  # the text before each quote

    def after(start: int) -> Column:  # 0 in a plain field, 1 inside quotes, 2 behind a quote inside, 3 at the line's start
        state = F.aggregate(before, F.lit(start), lambda st, s: F.when(st == 1, 2).when(
            s.endswith(sep) | ((st >= 2) & (s == "")), 1).otherwise(0))
        return state == 1

    outside, inside = after(3), after(1)
    t = F.when(~value.contains('"'), 0).when(outside & inside, 3).when(~outside & ~inside, 2).when(outside, 1).otherwise(0)
    return [t.cast("int").alias("t"), F.lit(0).alias("d0"), F.lit(0).alias("d1")]


def json_outcome(value: Column) -> list[Column]:
    """t, d0, d1 of a JSON piece and the ``}`` behind it."""
    plain = F.when(value.contains("\\"), F.regexp_replace(value, r"(?s)\\.", "")).otherwise(value)
    parts = F.split(plain, '"', -1)
    odd = F.size(parts) % 2 == 0  # an odd number of quotes

    def change(first: int) -> Column:
        seen = F.array_join(F.filter(parts, lambda _, i: i % 2 == first), "")
        opened = F.length(seen) - F.length(F.translate(seen, "{[", ""))
        closed = F.length(seen) - F.length(F.translate(seen, "}]", ""))
        ends_outside = ~odd if first == 0 else odd
        return opened - closed - ends_outside.cast("int")

    return [odd.cast("int").alias("t"), change(0).alias("d0"), change(1).alias("d1")]


# ---------------------------------------------------------------- walking splits
def _modes(t: np.ndarray, mode: int) -> np.ndarray:
    """The mode after each piece (0 outside, 1 inside)."""
    flips = np.cumsum(t == 1)
    at = np.maximum.accumulate(np.where(t >= 2, np.arange(len(t)), -1))  # the last piece that fixes the mode
    fixed = at >= 0
    return np.where(fixed, (t[at] - 2) ^ ((flips - flips[at]) & 1), mode ^ (flips & 1))


def _walk(t, d0, d1, mode: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(mode, depth) after each piece from a state before the first one."""
    after = _modes(t, mode)
    before = np.r_[mode, after[:-1]]
    return after, depth + np.cumsum(np.where(before == 1, d1, d0))


def _split_runs(batch: pa.RecordBatch) -> Iterator[tuple[str, int, int, int]]:
    """(path, start of split, first row, end row) of a batch's runs."""
    start, path = batch.column("_start").to_numpy(), batch.column(PATH)
    if not len(start):
        return
    same = pc.equal(path.slice(1), path.slice(0, len(path) - 1)).to_numpy(zero_copy_only=False) if len(path) > 1 else np.empty(0, bool)
    cut = np.flatnonzero(~(same & (start[1:] == start[:-1]))) + 1
    for i, j in zip([0, *cut], [*cut, len(start)]):
        yield path[int(i)].as_py(), int(start[i]), int(i), int(j)


def _columns(batch: pa.RecordBatch, i: int, j: int) -> list[np.ndarray]:
    return [batch.column(c).to_numpy()[i:j].astype(np.int64) for c in ("t", "d0", "d1")]


def _summaries(batches) -> Iterator[pa.RecordBatch]:
    """One row a split: the state at its end for a start outside and inside."""
    key, ends = None, [(0, 0), (1, 0)]

    def row():
        return pa.RecordBatch.from_pylist([{PATH: key[0], "_start": key[1], "m0": ends[0][0], "c0": ends[0][1], "m1": ends[1][0], "c1": ends[1][1]}],
                                          schema=pa.schema([(PATH, pa.string()), ("_start", pa.int64()), ("m0", pa.int32()), ("c0", pa.int64()),
                                                            ("m1", pa.int32()), ("c1", pa.int64())]))

    for b in batches:
        for path, start, i, j in _split_runs(b):
            if key is not None and key != (path, start):
                yield row()
                ends = [(0, 0), (1, 0)]
            key = (path, start)
            t, d0, d1 = _columns(b, i, j)
            ends = [tuple(int(x[-1]) for x in _walk(t, d0, d1, m, c)) for m, c in ends]
    if key is not None:
        yield row()


def split_starts(pieces: DataFrame) -> DataFrame:
    """(_path, _start, mode, depth): the state at the start of every split.
    The functions of a file's splits are folded in the order of the file; a
    row here stands for a split of the data, so the largest group has as many
    rows as the largest file has splits."""
    rows = pieces.select(PATH, "_start", "t", "d0", "d1").mapInArrow(
        _summaries, f"{PATH} string, _start long, m0 int, c0 long, m1 int, c1 long")
    state = "struct<mode:int,depth:long>"
    folded = rows.groupBy(PATH).agg(F.sort_array(F.collect_list(F.struct("_start", "m0", "c0", "m1", "c1"))).alias("s")).select(
        PATH, "s", F.expr(f"""aggregate(slice(s, 1, size(s) - 1), array(cast(named_struct('mode', 0, 'depth', 0L) as {state})),
            (a, x) -> array_append(a, cast(named_struct('mode', if(element_at(a, -1).mode = 1, x.m1, x.m0),
                'depth', element_at(a, -1).depth + if(element_at(a, -1).mode = 1, x.c1, x.c0)) as {state})))""").alias("a"))
    return folded.select(PATH, F.explode(F.arrays_zip("s", "a")).alias("x")).select(
        PATH, "x.s._start", "x.a.mode", "x.a.depth")


class Starts:
    """The state at each split's start, 17 bytes a split."""

    def __init__(self, table: pa.Table):
        key = table.column("key").to_numpy()
        order = np.argsort(key)
        self.key, self.mode, self.depth = key[order], table.column("mode").to_numpy()[order].astype(np.int8), table.column("depth").to_numpy()[order]

    def __call__(self, key: int, path: str, start: int) -> tuple[int, int]:
        at = int(np.searchsorted(self.key, key))
        if at == len(self.key) or self.key[at] != key:
            raise RuntimeError(f"{path} was cut at {start}, which the first scan did not do: the files or the cluster's size changed; read them again")
        return int(self.mode[at]), int(self.depth[at])


def _joined(values, bounds: np.ndarray, sep: bytes) -> pa.Array:
    """Runs of pieces between ``bounds`` as one value each."""
    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), values)
    return pc.binary_join(lists, pa.scalar(sep, pa.binary()))


def _records(batches, starts: Starts, sep: bytes, base: int) -> Iterator[pa.RecordBatch]:
    """Whole records of a split, and the fragments at its edges."""
    key, held, at, mode, depth, closed, fresh = None, [], 0, 0, 0, False, False

    def out(values, whole, opens, closes, first):
        n = len(values)
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]] * n, pa.string()), pa.array(np.full(n, key[1])), pa.array(np.arange(at, at + n)),
             *(pa.array(np.full(n, x)) for x in (whole, opens, closes)), pa.array(first), values],
            names=[PATH, "_start", "_at", "_whole", "_opens", "_closes", "_first", "value"])

    def edge(closes):
        """The pieces held: a fragment (or a whole record if it started here)."""
        return out(pa.array([sep.join(held)], pa.binary()), closed and closes, closed, closes, np.array([fresh]))

    for b in batches:
        for path, start, i, j in _split_runs(b):
            if key != (path, start):
                if held:
                    yield edge(False)
                key, held, at = (path, start), [], 0
                mode, depth = starts(b.column("_key")[i].as_py(), path, start)
                # at a file's start, or right behind a record
                closed, fresh = start == 0 or (mode == 0 and depth == base), start == 0
            values = b.column("value").slice(i, j - i)
            after, level = _walk(*_columns(b, i, j), mode, depth)
            mode, depth = int(after[-1]), int(level[-1])
            ends = np.flatnonzero((after == 0) & (level == base)) + 1
            if not len(ends):
                held.append(sep.join(values.to_pylist()))
                continue
            if held or not closed:
                held.append(sep.join(values.slice(0, int(ends[0])).to_pylist()))
                yield edge(True)
                at, held, closed, fresh = at + 1, [], True, fresh and not closed
                first_end = int(ends[0])
            else:
                first_end = 0
            bounds = np.r_[first_end, ends[ends > first_end]]
            if len(bounds) > 1:
                got = _joined(values, bounds, sep)
                first = np.zeros(len(got), bool)
                if fresh:  # the file's first record that is not blank
                    there = np.flatnonzero(pc.greater(pc.binary_length(got), 0).to_numpy(zero_copy_only=False))
                    if len(there):
                        first[there[0]], fresh = True, False
                yield out(got, True, True, True, first)
                at += len(got)
            if bounds[-1] < len(values):
                held.append(sep.join(values.slice(int(bounds[-1])).to_pylist()))
    if held:
        yield edge(False)


def records(pieces: DataFrame, sep: bytes, base: int) -> DataFrame:
    """pieces(_path, _start, value, t, d0, d1) -> (_path, value binary, _first:
    the file's first record that is not blank, _closes: false for what
    follows a file's last complete record)."""
    spark = pieces.sparkSession
    key = F.xxhash64(PATH, "_start").alias("key")
    # 17 bytes a split: a millionth of the data and less
    starts = spark.sparkContext.broadcast(Starts(split_starts(pieces).select(key, "mode", "depth").toArrow()))
    walked = pieces.select(PATH, "_start", F.col("value").cast("binary").alias("value"), "t", "d0", "d1", key.alias("_key")) \
        .mapInArrow(lambda it: _records(it, starts.value, sep, base), _RECORD)
    whole = walked.where("_whole").select(PATH, "value", "_first", "_closes")
    order = Window.partitionBy(PATH).orderBy("_start", "_at")
    # at most two fragments a split; a record begins at each that opens one
    edges = walked.where("not _whole").withColumn("_record", F.sum(F.col("_opens").cast("int")).over(order))
    rest = edges.groupBy(PATH, "_record").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_start", "_at", "value"))), lambda x: x["value"]).alias("parts"),
        F.max("_first").alias("_first"), F.max("_closes").alias("_closes"))
    glue = F.lit(bytearray(sep))
    text = F.aggregate(F.slice("parts", 2, F.size("parts")), F.element_at("parts", 1), lambda a, x: F.concat(a, glue, x))
    return whole.unionByName(rest.select(PATH, text.alias("value"), "_first", "_closes"))


# ------------------------------------------------------------------ the two kinds
def quoted_records(spark: SparkSession, paths: list[str], sep: str, encoding: str) -> DataFrame:
    """CSV records (_path, _first, value string), blank ones left out; line
    breaks inside quotes become ``\\n``.  Text with an open quote at the end
    of its file is that file's last record."""
    raw = text_pieces(spark, paths)
    got = records(raw.select(PATH, "_start", "value", *csv_outcome(F.col("value"), sep)), b"\n", 0)
    text = F.decode("value", encoding) if encoding.upper() != "UTF-8" else F.col("value").cast("string")
    return got.select(PATH, "_first", text.alias("value")).where("value != ''")


def json_elements(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Elements of files that are one JSON array of objects: (_path, value
    string, _tail).  ``_tail`` marks what follows a file's last element - ``]``
    if the file is whole."""
    raw = text_pieces(spark, paths, "}")
    got = records(raw.select(PATH, "_start", "value", *json_outcome(F.col("value"))), b"}", 1)
    body = F.regexp_replace(F.col("value").cast("string"), r"^[\s,]*", "")
    body = F.when(F.col("_first"), F.regexp_replace(body, r"^\[\s*", "")).otherwise(body)
    return got.select(PATH, F.when(F.col("_closes"), F.concat(body, F.lit("}"))).otherwise(body).alias("value"), (~F.col("_closes")).alias("_tail"))
