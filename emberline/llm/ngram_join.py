"""Documents whose word-shingle sets have a Jaccard similarity of 0.75 or more, by adaptive multi-match prefixes.

Order all shingles in one way. If the first n - ceil(0.75 n) + m shingles of each
of two sets share fewer than m, the sets can't be similar enough. A longer prefix (a larger m)
costs more rows and asks for more matches, so it is lengthened only where the
estimated cost of candidates says so:

1. Every document gives its prefix for m = 0.1 n in hash order. The number of its prefix
   shingles that any other document's prefix holds estimates its candidates. Most documents
   fall short of m (for the shorter of two partners 0.075 n) and are done.
2. The prefixes of the rest are lengthened to whole sets, where 0.75 n matches are
   asked for. Shingles are counted there, and sets that fall short are done.
3. What is left is ordered by count, rarest first. A pair has to meet within the first
   quarter of its sets, at places that leave room for the overlap that it needs.

Every pair that can be similar meets in step 3. Links are verified with the sets
themselves. As only components are asked for, each document is first compared with the
leaders of the shingles that it holds; then pairs across components are compared, all
of them. So a group of copies costs pairs in proportion to its size, and no link
between components is lost.

A set is the distinct shingles of ``size`` words, lower-cased from A to Z; with fewer
words the whole sequence is the one shingle. Shingles are known by 64-bit hashes.

Defined results: a document without words or text has an empty set and no link; documents
with equal texts that hold words are one component; a null doc_id has the size of its set, no links and a null
component; repeated rows get a row each, and rows that share a doc_id but not the text
are one document with both sets (n_shingles is the larger); other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.components import components
from emberline.llm.copies import copy_groups, settled
from emberline.llm.textkit import Words, mix64, slices, text_bytes, tidy
from emberline.session import Scratch, small

SIZE = 5
#: Similarity as a fraction.
NUMERATOR, DENOMINATOR = 3, 4
#: Text bytes whose equal shingles a worker settles on its own.
BATCH_BYTES = 8 << 20
#: Matches asked of the first prefixes, as a fraction of the set.
FIRST = 0.1


def _sets(part: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of each row: its number and its sorted shingle hashes."""
    words = Words(*text_bytes(part.column("text")), lower=True)
    shingles = words.windows(size, 11)
    for k, (lo, hi) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
        if hi - lo >= size:
            yield k, np.unique(shingles[lo : hi - size + 1])
        elif hi > lo:
            with np.errstate(over="ignore"):
                whole = mix64(np.cumsum(mix64(words.hashes[lo:hi], 21) * np.arange(1, 2 * (hi - lo), 2, dtype=np.uint64))[-1:], hi - lo)
            yield k, whole


def _required(n: np.ndarray | int):
    """The least overlap of a set of n with any similar set."""
    return -(-NUMERATOR * n // DENOMINATOR)


def _first_prefixes(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """shingle, weight and doc_id (null: a witness) of every prefix; and one row with n a document, under a key of its own."""
        for batch in batches:
            for large in slices(batch, size=BATCH_BYTES):
                keys, docs, own_ids, own_sizes = [], [], [], []
                for part in slices(large):
                    ids = part.column("doc_id").to_numpy()
                    for k, own in _sets(part, size):
                        n = len(own)
                        m = min(max(1, int(np.ceil(FIRST * n))), _required(n))
                        keys.append(own[: n - _required(n) + m])
                        docs.append(np.full(len(keys[-1]), ids[k]))
                        own_ids.append(ids[k])
                        own_sizes.append(n)
                if not keys:
                    continue
                key, doc = np.concatenate(keys), np.concatenate(docs)
                keys_, weights, owned = settled(key, mix64(key ^ mix64(doc.view(np.uint64), 9), 1))
                witnesses, n_docs = np.zeros(len(keys_) - len(doc), dtype=np.int64), len(own_ids)
                own = np.array(own_ids, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([keys_, mix64(own.view(np.uint64), 77)]).view(np.int64)),
                        pa.array(np.concatenate([weights, np.ones(n_docs, dtype=np.int32)])),
                        pa.array(np.concatenate([doc, witnesses, own]), mask=np.concatenate([~owned, np.zeros(n_docs, dtype=bool)])),
                        pa.array(np.concatenate([np.zeros(len(keys_), dtype=np.int32), np.array(own_sizes, dtype=np.int32)])),
                    ],
                    ["shingle", "weight", "doc_id", "n"],
                )

    return run


def _whole_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids = part.column("doc_id").to_numpy()
                found = list(_sets(part, size))
                if found:
                    keys = np.concatenate([own for _, own in found])
                    docs = np.repeat(ids[[k for k, _ in found]], [len(own) for _, own in found])
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(docs)], ["shingle", "doc_id"])

    return run


def _set_sizes(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                n = np.zeros(part.num_rows, dtype=np.int64)
                for k, own in _sets(part, size):
                    n[k] = len(own)
                yield pa.RecordBatch.from_arrays([pa.array(n)], ["n_shingles"])

    return run


def _required_column(n: Column) -> Column:
    return F.ceil(n * NUMERATOR / DENOMINATOR)


def _similar(left: Column, right: Column, n_left: Column, n_right: Column) -> Column:
    shared = F.size(F.array_intersect(left, right))
    return shared * DENOMINATOR >= (n_left + n_right - shared) * NUMERATOR


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar. What is shared lies among the repeated shingles, which ``sets`` holds."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("set_b"))
    met = pairs.join(left, "a").join(right, "b")
    return met.where(_similar(F.col("set_a"), F.col("set_b"), F.col("n_a"), F.col("n_b"))).select("a", "b")


def shingle_components(docs: DataFrame, size: int = SIZE, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    scratch = scratch or Scratch(docs.sparkSession, "ngrams")
    docs = docs.select("doc_id", "text")
    copies = scratch.write(copy_groups(docs.where(F.col("text").rlike(r"[^ \t\n\x0B\f\r]")), scratch).where("doc_id != leader").distinct(), "copies")
    texts = docs.where("doc_id is not null").join(small(copies.select("doc_id")), "doc_id", "left_anti")

    # 1. Prefixes in hash order.
    prefixes = texts.mapInArrow(tidy(_first_prefixes(size)), "shingle long, weight int, doc_id long, n int")
    holders = F.expr("sum(weight) over (partition by shingle)")
    counted = prefixes.withColumn("holders", holders).where("doc_id is not null").groupBy("doc_id").agg(
        F.max("n").cast("long").alias("n"), F.count_if((F.col("n") == 0) & (F.col("holders") > 1)).alias("matches")
    )
    counted = scratch.write(counted, "counted")
    asked = F.greatest(F.lit(1), F.least(F.ceil(F.col("n") * FIRST), F.ceil(F.col("n") * (FIRST * NUMERATOR / DENOMINATOR))))
    rest = scratch.write(counted.where(F.col("matches") >= asked).select("doc_id", "n"), "rest")

    # 2. Whole sets of what is left, with the number of sets that hold each shingle.
    whole = texts.join(small(rest.select("doc_id")), "doc_id", "left_semi").mapInArrow(tidy(_whole_sets(size)), "shingle long, doc_id long")
    holders = whole.groupBy("shingle").agg(F.count(F.lit(1)).cast("int").alias("holders")).where("holders > 1")
    repeated = whole.join(scratch.write(holders, "holders"), "shingle")
    lists = repeated.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("holders", "shingle"))).alias("listed"))
    sets = lists.join(rest, "doc_id").where(F.size("listed") >= _required_column(F.col("n")))
    sets = scratch.write(sets.select("doc_id", "n", F.col("listed.shingle").alias("shingles")), "sets")

    # 3. Places in the order by holders; shingles that one set holds come first and meet nothing.
    ahead = F.col("n") - F.size("shingles")
    places = F.expr(f"slice(shingles, 1, cast(greatest(0, n - {_ceil_sql('n')} + 1 - (n - size(shingles))) as int))")
    placed = sets.select("doc_id", "n", ahead.alias("ahead"), F.posexplode(places).alias("k", "shingle"))
    placed = scratch.write(placed.select("doc_id", "n", (F.col("ahead") + F.col("k")).alias("place"), "shingle"), "places")

    ids = sets.select("doc_id")
    labels = ids.withColumn("component", F.col("doc_id"))
    links = None
    for turn in range(2):
        # Leaders: the smallest document, then one by a hash, of those that hold a shingle and are in another component.
        order = F.col("doc_id") if turn == 0 else F.xxhash64("doc_id")
        own = placed.join(labels, "doc_id")
        leader = own.groupBy("shingle").agg(
            F.min_by(F.struct(F.col("doc_id").alias("leader"), F.col("component").alias("of"), F.col("n").alias("n_of"), F.col("place").alias("place_of")), order).alias("first")
        )
        pairs = own.join(leader, "shingle").where("component != first.of")
        room = F.least(F.col("n") - F.col("place"), F.col("first.n_of") - F.col("first.place_of"))
        pairs = pairs.where(_room_enough(room, F.col("n"), F.col("first.n_of")))
        pairs = pairs.select(F.col("doc_id").alias("a"), F.col("first.leader").alias("b")).distinct()
        found = scratch.write(_verified(pairs, sets), f"links{turn}")
        links = found if links is None else links.unionByName(found)
        labels = components(ids, links, scratch, f"turn{turn}")

    # All pairs across components that can be similar. The smaller set has to meet within its first seventh.
    own = placed.join(labels, "doc_id")
    left = own.where((F.col("n") - F.col("place")) * 7 >= F.col("n") * 6).select(
        "shingle", F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("place").alias("place_a"), F.col("component").alias("component_a")
    )
    right = own.select("shingle", F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("place").alias("place_b"), F.col("component").alias("component_b"))
    room = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    across = left.join(
        right,
        (left["shingle"] == right["shingle"])
        & (F.col("component_a") != F.col("component_b"))
        & (F.col("n_a") <= F.col("n_b"))
        & (F.col("n_a") * DENOMINATOR >= F.col("n_b") * NUMERATOR)
        & _room_enough(room, F.col("n_a"), F.col("n_b")),
    )
    found = scratch.write(_verified(across.select("a", "b").distinct(), sets), "links")
    labels = components(ids, links.unionByName(found), scratch, "all")
    scratch.clear("copies", "counted", *(t for t in scratch.tables if t.startswith("all-")))

    # Copies take their leader's set and component.
    leaders = docs.where("doc_id is not null").select("doc_id").join(copies.select("doc_id", "leader"), "doc_id", "left")
    named = leaders.select("doc_id", F.coalesce("leader", "doc_id").alias("leader"))
    known = counted.select(F.col("doc_id").alias("leader"), F.col("n").alias("n_shingles")).join(
        labels.select(F.col("doc_id").alias("leader"), "component"), "leader", "left"
    )
    found = named.join(known, "leader", "left").select(
        "doc_id", F.coalesce("n_shingles", F.lit(0).cast("long")).alias("n_shingles"), F.coalesce("component", "leader").alias("component_id")
    )
    unnamed = docs.where("doc_id is null").select("text").mapInArrow(tidy(_set_sizes(size)), "n_shingles long")
    none = F.lit(None).cast(docs.schema["doc_id"].dataType)
    return found.unionByName(unnamed.select(none.alias("doc_id"), "n_shingles", none.alias("component_id")))


def _ceil_sql(n: str) -> str:
    return f"cast(ceil({n} * {NUMERATOR} / {DENOMINATOR}) as long)"


def _room_enough(room: Column, n_a: Column, n_b: Column) -> Column:
    """Sets of these sizes need an overlap of s / (1 + s) of both together, and can't have more than the room after their first match."""
    return room * (NUMERATOR + DENOMINATOR) >= (n_a + n_b) * NUMERATOR


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without those whose component has a smaller doc_id; of rows with one doc_id the first by text stays, null doc_ids stay."""
    scratch = Scratch(docs.sparkSession, "distinct")
    names = docs.columns
    found = shingle_components(docs, scratch=scratch).where("component_id != doc_id").select("doc_id").distinct()
    dropped = scratch.write(found, "dropped")
    scratch.clear("dropped")
    rest = docs.join(small(dropped), "doc_id", "left_anti").select(*names)
    repeated = scratch.write(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return rest
    first = Window.partitionBy("doc_id").orderBy("text", *[F.col(f"`{c}`").cast("string") for c in names if c not in ("doc_id", "text")])
    again = rest.join(small(repeated), "doc_id", "left_semi").select("*", F.row_number().over(first).alias("_first")).where("_first = 1").select(*names)
    return rest.join(small(repeated), "doc_id", "left_anti").select(*names).unionByName(again)
