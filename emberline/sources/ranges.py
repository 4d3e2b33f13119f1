"""Large plain log files, read by byte ranges: many tasks share a file.

Spark's text source cuts a file into ranges and starts each at a line; whose line it is that a cut goes through is settled there. What it doesn't give is a line's number and
place in the file. So each range is read twice: once to count its lines and bytes, a row a range, from which running totals within the file follow; and once for
the lines, numbered within their range, to which the totals of the ranges before are added. No line is shuffled or collected.

The rows are those of ``files.read_logs`` for such files: line feeds end lines, with or without a carriage return before; a last line may have no end; a
byte-order mark belongs to the first line; lines of more than ``MAX_LINE_BYTES`` are cut and go on in the next row. Files that are packed, or whose lines end with lone carriage
returns, go through ``files.read_logs``. A file must not change between the two readings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.session import Scratch, small
from emberline.sources.files import MAX_LINE_BYTES

_MARK = b"\xef\xbb\xbf"


def _measured(value: pa.Array, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each line: bytes in the file without a final line feed, whether a carriage return ends it, and rows that it makes."""
    length = pc.binary_length(value).to_numpy(zero_copy_only=False).astype(np.int64)
    returned = pc.equal(pc.binary_slice(value, -1), b"\r").to_numpy(zero_copy_only=False)
    return length, returned, np.maximum(1, -(-(length - returned) // most))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """A batch in runs of lines of one range."""
    start = batch.column("start").to_numpy()
    path = batch.column("path")
    new = np.flatnonzero((start[1:] != start[:-1]) | pc.not_equal(path.slice(1), path.slice(0, max(0, len(path) - 1))).to_numpy(zero_copy_only=False)) + 1
    for lo, hi in zip([0, *new.tolist()], [*new.tolist(), batch.num_rows], strict=True):
        part = batch.slice(lo, hi - lo)
        yield (path[lo].as_py(), int(start[lo])), part


def _counted(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for (path, start), part in _runs(batch) if batch.num_rows else ():
                length, _, n = _measured(part.column("value"), most)
                rows.append((path, start, part.column("size")[0].as_py(), int(n.sum()), int(length.sum()) + len(length)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["path", "start", "size", "n", "bytes"])

    return run


def _numbered(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lines with their number and offset within the range; a range's lines come in order, not always in one batch."""
        own, number, offset = None, 0, 0
        for batch in batches:
            for key, part in _runs(batch) if batch.num_rows else ():
                if key != own:
                    own, number, offset = key, 0, 0
                value = part.column("value")
                length, returned, n = _measured(value, most)
                content = pc.if_else(pa.array(returned), pc.binary_slice(value, 0, -1), value)
                at = offset + np.cumsum(length + 1) - (length + 1)
                within = np.zeros(len(n), dtype=np.int64)
                last = np.ones(len(n), dtype=bool)
                if (n > 1).any():
                    line = np.repeat(np.arange(len(n)), n)
                    within = np.arange(len(line)) - np.repeat(np.cumsum(n) - n, n)
                    last = within == n[line] - 1
                    whole = content.take(pa.array(line))
                    content = pa.array([w.as_py()[k * most : (k + 1) * most] if cut > 1 else w.as_py() for w, k, cut in zip(whole, within.tolist(), n[line].tolist(), strict=True)], pa.binary())
                    at, returned = at[line] + within * most, returned[line]
                count = len(within)
                ends = np.where(last, np.where(returned, "crlf", "lf"), "none")
                columns = [pa.array([key[0]] * count), pa.array(np.full(count, key[1])), pa.array(number + np.arange(count)), pa.array(at), content, pa.array(ends.tolist()), pa.array(~last), pa.array(within > 0)]
                number, offset = number + count, offset + int((length + 1).sum())
                yield pa.RecordBatch.from_arrays(columns, ["path", "start", "k", "at", "bytes", "terminator", "truncated", "continuation"])

    return run


def read_large_logs(spark: SparkSession, path: str, most: int = MAX_LINE_BYTES) -> DataFrame:
    """A row a line of every file: path, line_no, offset, bytes, terminator, truncated, continuation."""
    name = F.regexp_replace("_metadata.file_path", "^file:///", "file:/").alias("path")
    read = spark.read.option("lineSep", "\n").text(path)
    lines = read.select(name, F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"), F.col("value").cast("binary").alias("value"))
    counted = lines.mapInArrow(_counted(most), "path string, start long, size long, n long, bytes long").groupBy("path", "start", "size").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    counted = Scratch(spark, "ranges").write(counted, "ranges")
    in_file = Window.partitionBy("path")
    before = in_file.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("bytes").over(in_file)
    # The text source leaves a byte-order mark out, and each line counts a line feed, also a last one that has none.
    placed = counted.select(
        "path", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.sum("n").over(in_file).alias("n_file"), F.when(total + 2 <= F.col("size"), 3).otherwise(0).alias("mark"), F.pmod(total - F.col("size"), F.lit(3)).alias("over"),
    )
    numbered = lines.mapInArrow(_numbered(most), "path string, start long, k long, at long, bytes binary, terminator string, truncated boolean, continuation boolean")
    line_no = F.col("n_before") + F.col("k")
    open_ = (line_no == F.col("n_file") - 1) & (F.col("over") == 1)
    content = F.when(open_ & (F.col("terminator") == "crlf"), F.concat("bytes", F.lit(b"\r"))).otherwise(F.col("bytes"))
    first = (line_no == 0) & (F.col("mark") == 3)
    return numbered.join(small(placed), ["path", "start"]).select(
        "path", line_no.alias("line_no"),
        F.when(first, 0).otherwise(F.col("bytes_before") + F.col("at") + F.col("mark")).cast("long").alias("offset"),
        F.when(first, F.concat(F.lit(_MARK), content)).otherwise(content).alias("bytes"),
        F.when(open_, "none").otherwise(F.col("terminator")).alias("terminator"), "truncated", "continuation",
    )
