"""Records that don't end with a line, read by many tasks: JSON arrays of one line, quoted tables with line feeds in fields.

A file is read as text up to each separator (a comma, a line feed), in splits. A
separator ends a record only where it is neither in a string nor nested, and what
comes before it decides that. So each split is first reduced to what it does to
the state at its start: how the quotes in it turn, by how much it nests, and how
many of its separators lie at each depth, for a start outside and inside a
string. These maps, one row per split, are composed in order; then every split
knows its state and its first record's number, and cuts its text. Only the first
and last records of splits are put together in a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from toolweave.sources.shared import materialize

MAPS = "file string, split bigint, start string, odd boolean, change array<bigint>, depth array<array<bigint>>, count array<array<bigint>>"
RECORDS = "file string, record bigint, split bigint, edge boolean, last boolean, value string"


def _nesting(text: Column, opening: str, closing: str) -> Column:
    """Opening less closing characters."""
    return (F.length(F.translate(text, closing, "")) - F.length(F.translate(text, opening, ""))).cast("int")


def json_pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, split, value, quotes, outside, inside): the text up to each comma, its quotes, and how it nests if it starts outside or inside a string."""
    read = spark.read.text(path, lineSep=",").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")
    parts = F.split(F.regexp_replace("value", r"\\.", ""), '"', -1)
    every = lambda first: F.array_join(F.filter(parts, lambda _, i: i % 2 == first), "")
    return read.select("file", "split", "value", (F.size(parts) - 1).alias("quotes"), _nesting(every(0), "[{", "]}").alias("outside"), _nesting(every(1), "[{", "]}").alias("inside"))


def quoted_pieces(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """As ``json_pieces``, of lines with quotes; a doubled quote turns twice."""
    read = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")
    return read.select("file", "split", "value", (F.length("value") - F.length(F.translate("value", '"', ""))).cast("int").alias("quotes"), F.lit(0).alias("outside"), F.lit(0).alias("inside"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Slices of a batch by (file, split), which follow each other in a task."""
    file, split = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    first = 0
    for k in range(1, batch.num_rows + 1):
        if k == batch.num_rows or file[k] != file[first] or split[k] != split[first]:
            yield (file[first], split[first]), batch.slice(first, k - first)
            first = k


def _states(part: pa.RecordBatch, columns: int, inside: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(in a string, depth) behind each piece, from the state before the first."""
    quotes, out, in_ = (part.column(columns + k).to_numpy().astype(np.int64) for k in range(3))
    turned = inside + np.cumsum(quotes)
    before = (turned - quotes) % 2
    return turned % 2, depth + np.cumsum(np.where(before, in_, out))


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each split does to the state at its start."""

    def out(key: tuple[str, int], start: str, states: list) -> pa.RecordBatch:
        depths = [sorted(s[2]) for s in states]
        row = {"file": key[0], "split": key[1], "start": start, "odd": bool(states[0][0]), "change": [s[1] for s in states], "depth": depths, "count": [[s[2][d] for d in ds] for s, ds in zip(states, depths, strict=True)]}
        kinds = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int64()), *[pa.list_(pa.list_(pa.int64()))] * 2]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds, strict=True)], list(row))

    key, start, states = None, "", []
    for batch in batches:
        for now, part in _runs(batch):
            if now != key:
                if key is not None:
                    yield out(key, start, states)
                key, start, states = now, part.column(2)[0].as_py(), [[0, 0, Counter()], [1, 0, Counter()]]
            for s in states:
                inside, depth = _states(part, 3, s[0], s[1])
                values, counts = np.unique(depth[inside == 0], return_counts=True)
                s[2].update(dict(zip(values.tolist(), counts.tolist(), strict=True)))
                s[0], s[1] = int(inside[-1]), int(depth[-1])
    if key is not None:
        yield out(key, start, states)


def composed(maps: list, arrays: bool) -> dict[tuple[str, int], tuple[int, int, int, int, bool]]:
    """Per (file, split) of the maps: in a string or not, depth, record, the depth at which records end, whether it is the file's last split."""
    out: dict[tuple[str, int], tuple[int, int, int, int, bool]] = {}
    file, inside, depth, record, level = None, 0, 0, 0, 0
    order = sorted(maps, key=lambda r: (r["file"], r["split"]))
    for k, r in enumerate(order):
        if r["file"] != file:
            file, inside, depth, record = r["file"], 0, 0, 0
            level = int(arrays and r["start"] == "[")
        last = k + 1 == len(order) or order[k + 1]["file"] != file
        out[r["file"], r["split"]] = (inside, depth, record, level, last)
        record += dict(zip(r["depth"][inside], r["count"][inside], strict=True)).get(level - depth, 0)
        inside, depth = (inside + r["odd"]) % 2, depth + r["change"][inside]
    return out


def cut_records(pieces: DataFrame, separator: str, arrays: bool) -> DataFrame:
    """(file, record, last, value): the records of ``pieces`` with their number in the file; ``last`` marks what comes after the last separator.

    With ``arrays`` files that are a JSON array are cut between its elements; the
    brackets around them stay. A file that is none is one record.
    """
    maps = pieces.select("file", "split", F.regexp_extract("value", r"^[\s\x{FEFF}]*(.)", 1).alias("value"), "quotes", "outside", "inside")
    starts = composed(materialize(maps.mapInArrow(_reduce, MAPS), "splits").collect(), arrays)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, record, first, state = None, [], 0, 0, (0, 0, 0, 0, False)

        def rows(found: list[tuple[int, bool, str]]) -> pa.RecordBatch:
            n = len(found)
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * n), pa.array([f[0] for f in found], pa.int64()), pa.array([key[1]] * n, pa.int64()), pa.array([f[0] == first or f[1] for f in found], pa.bool_()), pa.array([f[1] and state[4] for f in found], pa.bool_()), pa.array([f[2] for f in found], pa.string())], ["file", "record", "split", "edge", "last", "value"])

        for batch in batches:
            for now, part in _runs(batch):
                if now != key:
                    if held:
                        yield rows([(record, True, separator.join(held))])
                    key, state, held = now, starts[now], []
                    inside, depth, record, level, _ = state
                    first = record
                insides, depths = _states(part, 3, inside, depth)
                ends = np.flatnonzero((insides == 0) & (depths == level))
                values, at, found = part.column(2).to_pylist(), 0, []
                for e in ends.tolist():
                    found.append((record, False, separator.join([*held, *values[at : e + 1]])))
                    held, at, record = [], e + 1, record + 1
                held += values[at:]
                inside, depth = int(insides[-1]), int(depths[-1])
                if found:
                    yield rows(found)
        if held:
            yield rows([(record, True, separator.join(held))])

    found = materialize(pieces.mapInArrow(cut, RECORDS), "records")
    whole = found.filter("not edge").select("file", "record", "last", "value")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("split", "value"))), lambda p: p["value"]), separator)
    # a record is put together from one piece a split
    return whole.unionAll(found.filter("edge").groupBy("file", "record").agg(F.max("last").alias("last"), joined.alias("value")))
