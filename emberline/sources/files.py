"""Raw console logs in and out: whole files with their codecs, exports, metrics.

Files are recognised by content, not by name: gzip by its first two bytes, an export by its first line, a
lab runner's log by its line form, a persistent-store dump by its header lines. A file is one unit of work; its
bytes are decoded in the task that reads it, and come out as lines.
"""

from __future__ import annotations

import gzip
import io
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXPORT_MAGIC = b"EMBERLINE-EXPORT-1 "
#: A line's content, at most; longer ones are cut and go on in the next row.
MAX_LINE_BYTES = 1 << 20
#: Bytes in which a line feed has to show before lone carriage returns count as line ends.
PROBE_BYTES = 4096
_LINES = "path string, line_no long, offset long, bytes binary, terminator string, truncated boolean, continuation boolean"


def split_lines(data: bytes, most: int = MAX_LINE_BYTES) -> Iterator[tuple[int, bytes, str, bool, bool]]:
    """(offset, content, terminator, truncated, continuation); lf, crlf, cr or none. Lone carriage returns end lines only if no line feed shows early."""
    lone = b"\n" not in data[:PROBE_BYTES] and b"\r" in data and (len(data) > PROBE_BYTES or b"\n" not in data)
    mark = b"\r" if lone else b"\n"
    at, size = 0, len(data)
    while at < size:
        end = data.find(mark, at)
        stop = size if end < 0 else end
        content, name = data[at:stop], "none" if end < 0 else "cr" if lone else "lf"
        if name == "lf" and content.endswith(b"\r"):
            content, name = content[:-1], "crlf"
        for lo in range(0, max(1, len(content)), most):
            last = lo + most >= len(content)
            yield at + lo, content[lo : lo + most], name if last else "none", not last, lo > 0
        at = stop + 1


def _unwrapped(data: bytes) -> bytes:
    """The log inside a file: ungzipped, without an export's header line."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    if data.startswith(EXPORT_MAGIC):
        data = data.split(b"\n", 1)[1] if b"\n" in data else b""
    return data


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """A row a line of every file: path, line_no, offset, bytes, terminator, truncated, continuation."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = list(split_lines(_unwrapped(data.as_py())))
                for lo in range(0, len(rows), 10_000):
                    part = rows[lo : lo + 10_000]
                    offsets, contents, marks, cut, more = zip(*part, strict=True)
                    columns = [pa.array([name] * len(part)), pa.array(range(lo, lo + len(part)), pa.int64()), pa.array(offsets, pa.int64()), pa.array(contents, pa.binary()), pa.array(marks), pa.array(cut), pa.array(more)]
                    yield pa.RecordBatch.from_arrays(columns, ["path", "line_no", "offset", "bytes", "terminator", "truncated", "continuation"])

    return files.mapInArrow(lines, _LINES)


def file_facts(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of the stored bytes, bytes, duplicate_of (the first path with the same bytes, else null)."""
    files = spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))
    first = files.groupBy("sha256").agg(F.min("path").alias("first"))
    return files.join(first, "sha256").select("path", "sha256", "bytes", F.when(F.col("first") != F.col("path"), F.col("first")).alias("duplicate_of"))


def lab_runner_message(text: Column) -> Column:
    """Level and message of a line like ``- {"dt": ..., "lvl": "target", "msg": "..."}``; null for others."""
    body = F.regexp_extract(text, r"^- (\{.*\})\s*$", 1)
    parsed = F.from_json(F.when(body != "", body), "dt string, lvl string, msg string")
    return F.when(parsed["msg"].isNotNull(), F.struct(parsed["lvl"].alias("level"), parsed["msg"].alias("message")))


def is_store_header(text: Column) -> Column:
    """A header line of a persistent-store dump, which isn't part of the log."""
    return text.rlike(r"^(Panic|Oops)#[0-9]+ Part[0-9]+|^=+$")


def without_store_headers(lines: DataFrame, text: str = "text") -> DataFrame:
    """Lines from the first of each path that isn't a header on."""
    first = lines.where(~is_store_header(F.col(text))).groupBy("path").agg(F.min("line_no").alias("_from"))
    return lines.join(first, "path").where("line_no >= _from").drop("_from")


def export_session(lines: DataFrame, path: str, header: dict) -> None:
    """One session as an archive that ``read_logs`` reads: a gzipped header line, then the bytes with their terminators.

    Lines are range-sorted, each range is a gzip member of its own, and members are written as files that, joined by name, are one archive.
    """
    ends = F.create_map(*[F.lit(x) for pair in (("lf", "\n"), ("crlf", "\r\n"), ("cr", "\r"), ("none", "")) for x in pair])
    ordered = lines.select("line_no", F.concat(F.col("bytes"), F.element_at(ends, F.col("terminator")).cast("binary")).alias("whole"))
    ordered = ordered.repartitionByRange("line_no").sortWithinPartitions("line_no")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, first = io.BytesIO(), None
        with gzip.GzipFile(fileobj=out, mode="wb", mtime=0) as member:
            for batch in batches:
                for number, whole in zip(batch.column("line_no").to_pylist(), batch.column("whole").to_pylist(), strict=True):
                    if first is None:
                        first = number
                        if number == 0:
                            member.write(EXPORT_MAGIC + json.dumps(header, sort_keys=True).encode() + b"\n")
                    member.write(whole)
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first]), pa.array([out.getvalue()], pa.binary())], ["first_line", "member"])

    ordered.mapInArrow(members, "first_line long, member binary").write.parquet(path)


def import_session(spark: SparkSession, path: str) -> bytes:
    """The archive that ``export_session`` wrote, as bytes of one session (for handing on as a file)."""
    return b"".join(bytes(r["member"]) for r in spark.read.parquet(path).orderBy("first_line").collect())


def metrics_text(stats: DataFrame) -> DataFrame:
    """Lines of the Prometheus text format from device, lines, templates, fragmentation: value."""
    names = ("lines", "templates", "fragmentation")
    parts = [F.struct(F.lit(f"emberline_{n}").alias("name"), F.col(n).cast("double").alias("value")) for n in names]
    rows = stats.select("device", F.explode(F.array(*parts)).alias("m"))
    return rows.select(F.format_string('%s{device="%s"} %s', F.col("m.name"), F.col("device").cast("string"), F.col("m.value").cast("string")).alias("value"))
