"""Quoted CSV read in parallel: one file is cut into ranges, and every task finds where its records begin.

Whether a range begins inside a quoted field depends on the number of quotes before
it. A first pass counts, per range, quotes and record starts for both cases; sums
over the ranges of a file settle the case and the number of records before each
range. The second pass puts lines together to records, which is also where a record
gets its position. Only the pieces of records that cross a range are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import PySparkValueError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# The table of ranges goes to all tasks, 32 bytes each.
MOST_RANGES = 4_000_000
_QUOTE = b'"'
_FOUND = "file bigint, path string, block bigint, quotes bigint, even bigint, odd bigint"
_PIECES = "file bigint, owner bigint, block bigint, at bigint, whole boolean, header boolean, record binary"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines as bytes, in order, with the file and the start of the range they come from."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line"))


def _blank(line: bytes) -> bool:
    return line in (b"", b"\r")


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range its quotes and the records that start in it, should it begin outside (even) or inside (odd) a quoted field."""
    done: list[tuple] = []
    now: list | None = None
    for batch in batches:
        for file, path, block, line in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), batch.column(3)):
            if now is None or (now[0], now[2]) != (file, block):
                if now is not None:
                    done.append(tuple(now))
                now = [file, path.as_py(), block, 0, 0, 0]
            value = line.as_py()
            if not _blank(value):
                now[4 + now[3] % 2] += 1
            now[3] += value.count(_QUOTE)
    if now is not None:
        done.append(tuple(now))
    yield pa.RecordBatch.from_pylist(
        [dict(zip(("file", "path", "block", "quotes", "even", "odd"), r)) for r in done],
        schema=pa.schema([("file", pa.int64()), ("path", pa.string()), ("block", pa.int64()), ("quotes", pa.int64()),
                          ("even", pa.int64()), ("odd", pa.int64())]))


class _Ranges:
    """For every range whether it begins inside a field, the range that owns such a field's record, the records before
    it, and the position that the header of its file has among them."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: (r["path"], r["block"]))
        self.places: dict[tuple[int, int], tuple[bool, int, int, int]] = {}
        self.balanced = True
        before, header, path, quotes, owner = 0, 0, None, 0, 0
        for r in rows:
            if r["path"] != path:
                self.balanced &= quotes % 2 == 0
                # The header of a file is no record.
                path, quotes, owner, before = r["path"], 0, r["block"], before - 1
                header = before
            starts = r["odd"] if quotes % 2 else r["even"]
            self.places[r["file"], r["block"]] = (quotes % 2 == 1, owner, before, header)
            if starts:
                owner = r["block"]
            quotes, before = quotes + r["quotes"], before + starts
        self.balanced &= quotes % 2 == 0


def read_records(spark: SparkSession, path: str) -> DataFrame | None:
    """at (position over all files in the order of their paths, headers left out) and record (bytes) of CSV files.

    Records are parted by line feeds outside of quoted fields; a carriage return
    at their end is taken off, blank lines are none. Quotes must come in pairs, as
    they do where fields with quotes are quoted; None if a file has an odd number.
    """
    lines = _lines(spark, path)
    measured = lines.mapInArrow(_measured, _FOUND).limit(MOST_RANGES + 1).collect()
    if len(measured) > MOST_RANGES:
        raise PySparkValueError(f"more than {MOST_RANGES} ranges: raise spark.sql.files.maxPartitionBytes")
    ranges = _Ranges(measured)
    if not ranges.balanced:
        return None
    known = spark.sparkContext.broadcast(ranges.places)

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = known.value
        out: list[tuple] = []
        place, held, parity, owner, at, header = None, [], 0, 0, 0, 0

        def put(whole: bool) -> None:
            record = b"\n".join(held)
            if not (whole and at == header):
                out.append((place[0], owner, place[1], at, whole, owner == place[1] and at == header, record.removesuffix(b"\r") if whole else record))
            held.clear()

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                              names=["file", "owner", "block", "at", "whole", "header", "record"])

        for part in batches:
            for file, block, line in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                if (file, block) != place:
                    if held:
                        put(False)
                    place = (file, block)
                    inside, owner, at, header = ranges[place]
                    parity, begun, number = int(inside), not inside, at
                value = line.as_py()
                if not held and begun:
                    if _blank(value):
                        continue
                    owner, at, number = block, number, number + 1
                held.append(value)
                parity += value.count(_QUOTE)
                if parity % 2 == 0:
                    put(begun)
                    begun = True
            yield batch()
            out.clear()
        if held:
            put(False)
        yield batch()

    pieces = lines.select("file", "block", "line").mapInArrow(assembled, _PIECES)
    whole = pieces.where("whole").select("at", "record")
    # One record at most begins in a range and ends in a later one; its pieces bear the range it begins in.
    crossing = pieces.where(~F.col("whole")).groupBy("file", "owner").agg(
        F.sort_array(F.collect_list(F.struct("block", "at", "header", "record"))).alias("pieces"))
    joined = F.aggregate(F.slice("pieces", F.lit(2), F.size("pieces")), F.col("pieces")[0]["record"],
                         lambda a, p: F.concat(a, F.lit(b"\n"), p["record"]))
    trimmed = F.when(F.substring(joined, -1, 1) == F.lit(b"\r"), F.substring(joined, F.lit(1), F.length(joined) - 1)).otherwise(joined)
    rest = crossing.where(~F.col("pieces")[0]["header"]).select(F.col("pieces")[0]["at"].alias("at"), trimmed.alias("record"))
    return whole.unionByName(rest)


def fields(record: Column, names: list[str]) -> list[Column]:
    """The fields of a record, each UTF-8 or else Latin-1; nulls where they are empty or missing."""
    # Latin-1 loses no byte on the way through the parser.
    text = F.decode(record, "ISO-8859-1")
    parsed = F.from_csv(text, F.lit(", ".join(f"c{i} string" for i in range(len(names)))),
                        {"quote": '"', "escape": '"', "multiLine": "true"})
    return [decoded(parsed[f"c{i}"]).alias(name) for i, name in enumerate(names)]


def decoded(value: Column) -> Column:
    """Text read as Latin-1, which loses no byte: as UTF-8 where its bytes are, else as it is."""
    return F.coalesce(F.try_validate_utf8(F.encode(value, "ISO-8859-1").cast("string")), value)
