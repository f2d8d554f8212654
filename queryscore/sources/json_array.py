"""Large JSON arrays in any layout, read by as many tasks as their files have splits.

A file is cut behind every closing brace, wherever it stands: Spark's text source does that with
the brace as its separator, so splits are read apart. A brace is never escaped in JSON, so a piece
begins inside or outside a string, nothing else. One scan finds for each split whether it changes
between the two, and how much deeper it ends if it begins inside, or outside. A prefix over these
few rows gives the state in which every split really begins. A second scan cuts the elements where
the depth is that of the array. Only elements that reach over the end of a split are put together
from their parts; no other text leaves its task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# An escape, a string up to its quote or, left open, to the end, or a change of depth. Outside strings JSON
# has no escapes; where they are skipped too, a piece turns inside and outside round whichever it begins in.
_TOKEN = re.compile(r'\\.|"[^"\\]*(?:\\.[^"\\]*)*("?)|[{\[\]]', re.DOTALL)
_REST_OF_STRING = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*("?)', re.DOTALL)
_BEFORE = re.compile(r"[\s,\[]*")


def after(piece: str, inside: bool, depth: int) -> tuple[bool, int]:
    """The state behind ``piece`` and the brace that follows it, from the state before."""
    at = 0
    if inside:
        rest = _REST_OF_STRING.match(piece)
        inside, at = not rest.group(1), rest.end()
    if not inside:
        for token in _TOKEN.finditer(piece, at):
            first = piece[token.start()]
            if first == '"':
                inside = not token.group(1)
            elif first != "\\":
                depth += -1 if first == "]" else 1
    return inside, depth if inside else depth - 1


def _by_split(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple]:
    """Rows as tuples, and None behind each batch."""
    for batch in batches:
        yield from zip(*[batch.column(n).to_pylist() for n in names])
        yield None


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split and run: the state behind it if it begins outside a string, and if inside."""
    schema = pa.schema([
        ("file", pa.string()), ("split", pa.int64()), ("turns", pa.int32()), ("outside", pa.int64()), ("inside", pa.int64())])
    now, states, out = None, [], []

    def done() -> None:
        if now is not None:
            out.append({"file": now[0], "split": now[1], "turns": int(states[0][0]), "outside": states[0][1], "inside": states[1][1]})

    for row in _by_split(batches, ("file", "split", "value")):
        if row is None:
            continue
        if row[:2] != now:
            done()
            now, states = row[:2], [(False, 0), (True, 0)]
        states = [after(row[2], *s) for s in states]
    done()
    yield pa.RecordBatch.from_pylist(out, schema=schema)


_PARTS = pa.schema([("file", pa.string()), ("split", pa.int64()), ("line", pa.int64()), ("kind", pa.string()), ("value", pa.string())])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements, and parts of those that reach over the ends of a split: its tail, middle or head."""
    now, state, held, line, carried = None, (False, 0), [], 0, False
    out: list[dict] = []

    def emit(kind: str, text: str) -> None:
        nonlocal line
        begins = kind in ("whole", "head")
        out.append({"file": now[0], "split": now[1], "line": line if begins else -1, "kind": kind, "value": text})
        line += begins

    def close() -> None:
        """The end of a split: what is held goes on in the next one."""
        if now is not None and held and state[1] > 0:
            emit("middle" if carried else "head", "".join(held))

    for row in _by_split(batches, ("file", "split", "value", "starts_inside", "starts_depth")):
        if row is None:
            yield pa.RecordBatch.from_pylist(out, schema=_PARTS)
            out = []
            continue
        if row[:2] != now:
            close()
            now, state, held, line = row[:2], (row[3], row[4]), [], 0
            carried = state[1] > 1 or state[0]
        piece = row[2]
        if not held and not carried:
            piece = piece[_BEFORE.match(piece).end():]
        state = after(row[2], *state)
        held.append(piece + "}")
        if state == (False, 1):
            emit("tail" if carried else "whole", "".join(held))
            held, carried = [], False
        elif state == (False, 0):
            raise ValueError(f"{now[0]} is no JSON array of objects")
    close()
    yield pa.RecordBatch.from_pylist(out, schema=_PARTS)


def elements(spark: SparkSession, path: str) -> DataFrame:
    """(pos, value) of the objects in all arrays below ``path``; pos is (file, split, line).

    A file that is no complete array of objects is an error, found when it is read.
    """
    pieces = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value"
    )
    found = pieces.mapInArrow(_summaries, "file string, split long, turns int, outside long, inside long")
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    all_of = Window.partitionBy("file")
    inside = F.coalesce(F.bit_xor("turns").over(before), F.lit(0)) == 1
    states = found.withColumn("starts_inside", inside).withColumn("by", F.when(F.col("starts_inside"), F.col("inside")).otherwise(F.col("outside")))
    # behind the last element stands the bracket and then, not really, a brace
    whole = (F.sum("by").over(all_of) == -1) & (F.bit_xor("turns").over(all_of) == 0)
    states = states.select(
        F.col("file").alias("_file"), F.col("split").alias("_split"),
        F.when(whole, F.col("starts_inside")).otherwise(F.raise_error(F.concat("file", F.lit(" is no complete JSON array"))).cast("boolean")).alias("starts_inside"),
        F.coalesce(F.sum("by").over(before), F.lit(0)).alias("starts_depth"),
    )
    # one row per split
    known = pieces.join(F.broadcast(states), (F.col("file") == F.col("_file")) & (F.col("split") == F.col("_split")))
    parts = known.select("file", "split", "value", "starts_inside", "starts_depth").mapInArrow(
        _cut, "file string, split long, line long, kind string, value string")
    place = F.struct("file", "split", "line").alias("pos")
    alone = parts.where("kind = 'whole'").select(place, "value")
    # parts follow each other: each belongs to the last head at or before its split
    order = Window.partitionBy("file").orderBy("split", F.col("line") >= 0).rowsBetween(Window.unboundedPreceding, 0)
    across = parts.where("kind <> 'whole'").withColumn("head", F.max(F.when(F.col("kind") == "head", F.struct("split", "line"))).over(order))
    joined = across.groupBy("file", "head").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("split", "value"))), lambda x: x["value"]), "").alias("value"))
    return alone.unionByName(joined.select(F.struct("file", F.col("head.split").alias("split"), F.col("head.line").alias("line")).alias("pos"), "value"))
