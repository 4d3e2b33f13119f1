"""Token ids in length-delimited binary record files, with a separate offset index.

A record is

    length   8 bytes   of the payload, little-endian
    check    4 bytes   masked CRC-32 of the length bytes
    payload            doc_id (8 bytes, signed), id width (1 byte: 2 or 4; 128 more
                       if the doc_id is null), ids
    check    4 bytes   masked CRC-32 of the payload
    end      1 byte    0x0A

The mask turns a CRC right by 15 bits and adds 0xA282EAD8, so that the checks
of nested records don't cancel. Files hold records in ascending doc_id order, and
files are numbered in that order. The index is Parquet: file, byte offset and
length of each record, so that a reader can fetch records in any order.

Defined results: a null text is the end id alone; a null doc_id comes first
and is read back as null; repeated doc_ids are kept, ordered by text; an empty
table writes no records. A document of any length is one record; other columns
are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.llm import tokens
from emberline.llm.textkit import slices, tidy
from emberline.session import BATCH_ROWS, Scratch, batch_rows

#: Text bytes that go to one record file.
FILE_BYTES = 16 << 20
#: Bytes of a worker's cache: a byte-level tokenizer has units with and without a space before them.
CACHE_BYTES = 100 << 20


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    """One record without its end byte, which the file writer puts after every record."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    payload = struct.pack("<qB", doc_id or 0, width + 128 * (doc_id is None)) + ids.astype(f"<u{width}").tobytes()
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked_crc(length)) + payload + struct.pack("<I", masked_crc(payload))


def records(data: bytes) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """(offset, length, doc_id, ids) of each record of a file; raises if a check fails."""
    at = 0
    while at < len(data):
        (length,), (check,) = struct.unpack_from("<Q", data, at), struct.unpack_from("<I", data, at + 8)
        payload = data[at + 12 : at + 12 + length]
        if masked_crc(data[at : at + 8]) != check or struct.unpack_from("<I", data, at + 12 + length)[0] != masked_crc(payload):
            raise ValueError(f"damaged record at byte {at}")
        doc_id, width = struct.unpack_from("<qB", payload)
        yield at, length + 17, doc_id if width < 128 else None, np.frombuffer(payload, dtype=f"<u{width % 128}", offset=9)
        at += length + 17


def write_records(docs: DataFrame, folder: str, vocabulary: str, end_id: int, file_bytes: int = FILE_BYTES) -> None:
    """Writes folder/data (record files) and folder/index (Parquet)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-total // file_bytes))
    ordered = docs.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = tokens.encoder(vocabulary, CACHE_BYTES), np.uint32(end_id)
        for batch in batches:
            for part in slices(batch, size=tokens.TEXT_BYTES):
                flat, bounds = encoder.encode_column(part.column("text"))
                spans = zip(part.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
                framed = [frame(d, np.append(flat[lo:hi], end)) for d, lo, hi in spans]
                yield pa.RecordBatch.from_arrays([pa.array(framed, pa.binary())], ["record"])

    framed = ordered.mapInArrow(tidy(encode, tokens.forget), "record binary")
    with batch_rows(spark, BATCH_ROWS):
        framed.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{folder}/data")
    read_records(spark, folder, with_ids=False).write.parquet(f"{folder}/index")


def read_records(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """A row a record: file (its number), offset, length, doc_id, before (ids of the file's earlier records), n_tokens, ids_crc32 and the ids."""
    number = F.regexp_extract("path", r"part-([0-9]+)[^/]*$", 1).cast("long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/data").select(number.alias("file"), "content")
    schema = "file long, offset long, length long, doc_id long, before long, n_tokens long, ids_crc32 long"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column("file"), batch.column("content"), strict=True):
                rows, kept, before = [], [], 0
                for offset, length, doc_id, ids in records(data.as_py()):
                    wide = ids.astype("<u4")
                    rows.append((number.as_py(), offset, length, doc_id, before, len(ids), zlib.crc32(wide.tobytes())))
                    before += len(ids)
                    if with_ids:
                        kept.append(wide)
                columns = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 7)]
                names = ["file", "offset", "length", "doc_id", "before", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([w.tolist() for w in kept], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return files.mapInArrow(tidy(parse), schema + (", ids array<long>" if with_ids else ""))


def document_offsets(index: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32. Only one row a file goes through the window."""
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    firsts = totals.select("file", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("first"))
    return index.join(firsts, "file").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def encode_to_records(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Writes the files to the job's shared folder and reads them back."""
    scratch = Scratch(docs.sparkSession, "records")
    write_records(docs, scratch.path("set"), vocabulary, end_id)
    index = docs.sparkSession.read.parquet(scratch.path("set/index"))
    return document_offsets(index)
