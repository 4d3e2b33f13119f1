"""Removing lines that many documents hold.

Texts are split at newlines and the lines exploded with their positions. A line's key is the line without white space
(0x20, 0x09-0x0D) at its ends, A-Z lower-cased; keys of at least ``least`` code points are hashed (128 bits). Of each hash the distinct
documents are counted, and the largest doc_id kept: that document keeps its lines with this key, all of them, and of the others they are
dropped if at least ``documents`` documents hold the key. The positions to drop come back to their rows, whose other lines are joined again.

Hashes, ids and positions are shuffled, and texts once, to meet the positions of their row. One line may stand in any share of the documents: hashes are first
grouped with the id, so a hot one goes evenly to all tasks, and is then counted with map-side sums; where the common hashes are too many to be
broadcast, lines meet them in a join whose large keys Spark can split.

Defined results: a null or empty text is one empty line; a text of any length is read whole; lines that repeat in a document
count once for the document and are all dropped or all stay; rows that share a doc_id are one document (so a repeated row
adds nothing to a count), and each gets a row; a null doc_id is no document: it adds to no count and keeps no common line;
an empty table gives no rows; other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.session import Scratch, small

#: Code points of a key that is looked at, and documents that make it common.
LEAST, DOCUMENTS = 20, 3
_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(_SPACE))
    # Where all is ASCII, lower() does the same and is faster.
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _keyed(docs: DataFrame, least: int) -> DataFrame:
    """doc_id, rid, place and the two halves of the hash of every line whose key is long enough."""
    lines = docs.select("doc_id", "rid", F.posexplode(_lines(F.col("text"))).alias("place", "line"))
    keyed = lines.select("doc_id", "rid", "place", line_key(F.col("line")).alias("key")).where(F.length("key") >= least)
    return keyed.select("doc_id", "rid", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def common_lines(docs: DataFrame, least: int = LEAST, documents: int = DOCUMENTS) -> DataFrame:
    """h1, h2 (a key's hash) and keeper (the largest doc_id) of the keys that so many documents hold; docs has doc_id, rid and text."""
    held = _keyed(docs, least).where("doc_id is not null").select("h1", "h2", "doc_id").distinct()
    counted = held.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
    return counted.where(F.col("n") >= documents).select("h1", "h2", "keeper")


def dedup_lines(docs: DataFrame, least: int = LEAST, documents: int = DOCUMENTS) -> DataFrame:
    """A row for each document: row (its other columns), text, n_lines, n_dropped and kept, what is left of the text."""
    scratch = Scratch(docs.sparkSession, "lines")
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    # Rows with one id and text lose the same lines.
    rows = docs.select("doc_id", F.xxhash64("text").alias("rid"), others.alias("row"), "text")
    common = scratch.write(common_lines(rows, least, documents), "common")
    met = _keyed(rows, least).join(small(common), ["h1", "h2"]).where("not doc_id <=> keeper")
    dropped = scratch.write(met.groupBy(F.col("doc_id").alias("id"), F.col("rid").alias("of")).agg(F.collect_set("place").alias("dropped")), "dropped")
    own = F.col("rid") == F.col("of")
    placed = rows.join(dropped, own & F.col("doc_id").eqNullSafe(F.col("id")), "left").withColumn("lines", _lines(F.col("text")))
    n, gone = F.size("lines"), F.coalesce(F.size("dropped"), F.lit(0))
    left = F.array_except(F.sequence(F.lit(0), n - 1), "dropped")
    kept = F.when(gone == 0, F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(left, lambda k: F.get("lines", k)), "\n"))
    return placed.select("row", "text", n.cast("long").alias("n_lines"), gone.cast("long").alias("n_dropped"), kept.alias("kept"))
