"""Packing documents' tokens into sequences of bounded length by bulk-synchronous best fit.

Documents become pieces of at most ``capacity`` tokens. Pieces over half of it
open a sequence each, as no two of them fit together. Then rounds run until
no piece is left:

1. The largest pieces open as many new sequences as are needed at least: of any
   size, for what the pieces over it lack in gaps over it.
2. Pieces and the sequences' gaps are range-sorted together by size, largest first.
3. Each range is swept: a piece goes into the smallest gap of its range that is
   large enough, which stays in use as long as it has room.
4. What is left of each range is matched across ranges by rank: pieces of a
   lower range take the last unmatched gap above them, as many as surely fit.
   Only counts, one row a range, are needed on the driver for that. After some rounds
   a gap takes pieces of several ranges, as long as they surely fit: else small
   ranges place few pieces a round, and rounds go on and on.
5. Gaps are updated.

Defined results: a null text is empty, so it is one piece with the end id alone; a
null doc_id is kept as null; repeated rows are packed each; ties go by the
order in which pieces were stored; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm import tokens
from emberline.llm.textkit import release, slices, tidy
from emberline.session import Scratch, release_heap

CAPACITY = 4096
#: Pieces and gaps that one range holds.
RANGE_ROWS = 50_000
#: Matches across ranges that are broadcast (some five megabytes); more of them are shuffled.
SMALL_MATCHES = 100_000
#: Rounds in which a gap takes pieces of one range only: what room they leave for sure is less than what the next round knows, and packs looser.
PATIENT = 4
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and its ids if wanted."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = tokens.encoder(vocabulary), np.uint32(end_id).tobytes()
        for batch in batches:
            for part in slices(batch, size=tokens.TEXT_BYTES):
                rows = []
                flat, bounds = encoder.encode_column(part.column("text"))
                for doc_id, first, last in zip(part.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    ids = flat[first:last].tobytes() + end
                    for k, lo in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[lo : lo + 4 * capacity]
                        rows.append((doc_id, k, lo // 4, len(own) // 4, zlib.crc32(own), own))
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays(arrays[: 5 + with_ids], names[: 5 + with_ids])

    return docs.select("doc_id", "text").mapInArrow(tidy(cut, tokens.forget), PIECES + (", ids binary" if with_ids else ""))


class _Rooms:
    """Gaps by their room; finds the smallest room that is large enough."""

    def __init__(self, capacity: int):
        self.by_room: list[list] = [[] for _ in range(capacity + 1)]
        self.filled = 0  # bit r: there is a gap with room r

    def add(self, room: int, gap) -> None:
        self.by_room[room].append(gap)
        self.filled |= 1 << room

    def take(self, size: int):
        above = self.filled >> size
        if not above:
            return None
        room = size + (above & -above).bit_length() - 1
        own = self.by_room[room]
        gap = own.pop()
        if not own:
            self.filled &= ~(1 << room)
        return room, gap


#: what: "placed" (id in sequence at offset), "item" or "gap" (left over, rank within its range), or "rest" (a gap
#: that has become too small for some pieces of later ranges and waits for the next round)
_SWEPT = "what string, range int, rank int, id long, size long, sequence long, offset long"


def _sweep(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TaskContext.get().partitionId()
        rooms, out, items, size = _Rooms(capacity), [], 0, 1
        for batch in batches:
            for is_gap, size, id_ in zip(*(batch.column(c).to_pylist() for c in ("is_gap", "size", "id")), strict=True):
                if is_gap:
                    rooms.add(size, id_)
                elif (found := rooms.take(size)) is not None:
                    room, gap = found
                    out.append(("placed", own, 0, id_, size, gap, capacity - room))
                    if room > size:
                        rooms.add(room - size, gap)
                else:
                    out.append(("item", own, items, id_, size, None, None))
                    items += 1
        left = [(room, gap) for room in range(capacity, 0, -1) for gap in rooms.by_room[room]]
        out += [("gap" if room >= size else "rest", own, k, gap, room, gap, None) for k, (room, gap) in enumerate(left)]
        kinds = (pa.string(), pa.int32(), pa.int32(), *[pa.int64()] * 4)
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds]
        yield pa.RecordBatch.from_arrays(columns, ["what", "range", "rank", "id", "size", "sequence", "offset"])

    return run


def _across(ranges: list[tuple[int, int, int, int, int]], again: bool = False) -> list[tuple[int, int, int, int, int, int]]:
    """Matches of what ranges have left over, from (range, pieces, largest piece, gaps, smallest gap), largest first.

    Pieces take the smallest gaps of earlier ranges, from the last one up, and each gap as many as
    surely fit; a range's left pieces all come before its left gaps, or they would have been matched.
    ``again``: what room a gap then has for sure is free for later ranges.
    Gives (range, first and last piece rank, pieces a gap, gap range, gap rank of the first).
    """
    free: list[tuple[int, int, int, int]] = []  # smallest room, range (negative: the last one first), rank of the last gap, gaps
    out = []
    for range_, pieces, largest, gaps, smallest in ranges:
        at = 0
        while at < pieces and (k := bisect_left(free, (largest,))) < len(free):
            room, minus, last, n_gaps = free.pop(k)
            each = room // largest
            n = min(pieces - at, n_gaps * each)
            out.append((range_, at, at + n - 1, each, -minus, last))
            at += n
            full, more = divmod(n, each)
            if again:
                for count, left in ((full, room - each * largest), (int(more > 0), room - more * largest)):
                    if count and left:
                        insort(free, (left, minus, last, count))
                    last -= count
            else:
                last -= full + (more > 0)
            if unused := n_gaps - full - (more > 0):
                insort(free, (room, minus, last, unused))
        if gaps:
            insort(free, (smallest, -range_, gaps - 1, gaps))
    return out


def _opening(state: DataFrame, capacity: int) -> Column | None:
    """Which pieces open sequences now; None if no piece is left.

    Sizes are counted (at most ``capacity`` different ones of either kind). Of the pieces
    with the size at which enough are found, an id quantile parts those that open.
    """
    counts = {(r["is_gap"], r["size"]): r["count"] for r in state.groupBy("is_gap", "size").count().collect()}
    pieces = sorted(((size, n) for (is_gap, size), n in counts.items() if not is_gap), reverse=True)
    if not pieces:
        return None
    # Pieces over a size fit into gaps over it only; what these gaps lack, new sequences have to hold.
    lack, needed = 0, 0
    for size in sorted({size for _, size in counts}, reverse=True):
        lack += size * (counts.get((False, size), 0) - counts.get((True, size), 0))
        needed = max(needed, -(-lack // capacity))
    if needed <= 0:
        return F.lit(False)
    for size, n in pieces:
        if needed <= n:
            break
        needed -= n
    own = F.col("size") == size
    if needed < n:
        last = state.where(~F.col("is_gap") & own).agg(F.percentile_approx("id", needed / n, 10_000)).first()[0]
        own &= F.col("id") <= last
    return ~F.col("is_gap") & ((F.col("size") > size) | own)


def best_fit(pieces: DataFrame, capacity: int = CAPACITY, range_rows: int = RANGE_ROWS) -> DataFrame:
    """id, sequence, offset for stored pieces (id, size); a sequence's number is the id of the piece that opened it."""
    spark = pieces.sparkSession
    scratch = Scratch(spark, "packing")
    state = pieces.select("id", "size", F.lit(False).alias("is_gap"))
    opens: Column | None = F.col("size") > capacity // 2
    placed = []
    turn = 0
    while opens is not None:
        placed.append(state.where(opens).select("id", F.col("id").alias("sequence"), F.lit(0).cast("long").alias("offset")))
        size = F.when(opens, capacity - F.col("size")).otherwise(F.col("size")).cast("long")
        state = state.select("id", size.alias("size"), (F.col("is_gap") | opens).alias("is_gap")).where("size > 0")
        if turn == 0:  # what the large pieces leave is known only now
            more = _opening(state, capacity)
            if more is None:
                break
            placed.append(state.where(more).select("id", F.col("id").alias("sequence"), F.lit(0).cast("long").alias("offset")))
            size = F.when(more, capacity - F.col("size")).otherwise(F.col("size")).cast("long")
            state = state.select("id", size.alias("size"), (F.col("is_gap") | more).alias("is_gap")).where("size > 0")
        ranges = max(1, -(-state.count() // range_rows))
        order = [F.col("size").desc(), F.col("is_gap").desc(), F.col("id").asc()]
        dealt = state.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
        swept = scratch.write(dealt.mapInArrow(_sweep(capacity), _SWEPT), f"swept{turn}")
        item, gap = F.col("what") == "item", F.col("what") == "gap"
        left = swept.where(item | gap).groupBy("range").agg(
            F.count_if(item), F.max(F.when(item, F.col("size"))), F.count_if(gap), F.min(F.when(gap, F.col("size")))
        )
        segments = _across(sorted(tuple(r) for r in left.collect()), again=turn >= PATIENT)
        by_range: dict[int, list[tuple]] = {}
        for range_, *own in segments:
            by_range.setdefault(range_, []).append(tuple(own))
        shifts = spark.createDataFrame(
            list(by_range.items()), "range int, found array<struct<lo:int,hi:int,each:int,gap_range:int,gap_rank:int>>"
        )
        rest = swept.where(item).join(F.broadcast(shifts) if len(segments) <= SMALL_MATCHES else shifts, "range", "left")
        match = F.get(F.filter("found", lambda s: F.col("rank").between(s["lo"], s["hi"])), F.lit(0))
        aimed = rest.select("id", "size", "rank", match.alias("to"))
        aimed = aimed.select("id", "size", F.col("to.gap_range").alias("range"), (F.col("to.gap_rank") - F.expr("(rank - to.lo) div to.each")).cast("int").alias("rank"))
        homeless = aimed.where("range is null").select("id", "size", F.lit(False).alias("is_gap"))
        aimed = aimed.where("range is not null")
        # A gap takes at most ``capacity`` pieces; they stand side by side in it.
        before = "coalesce(sum(size) over (partition by range, rank order by id rows between unbounded preceding and 1 preceding), 0)"
        free = swept.where(gap).select("range", "rank", "sequence", F.col("size").alias("room"))
        met = scratch.write(aimed.withColumn("before", F.expr(before)).join(free, ["range", "rank"]).select("id", "size", "sequence", "room", "before"), f"met{turn}")
        placed.append(swept.where("what = 'placed'").select("id", "sequence", "offset"))
        placed.append(met.select("id", "sequence", (capacity - F.col("room") + F.col("before")).alias("offset")))
        used = met.groupBy("sequence").agg(F.sum("size").alias("used"))
        gaps = swept.where("what in ('gap', 'rest')").select("sequence", "size").join(used, "sequence", "left")
        gaps = gaps.select(F.col("sequence").alias("id"), (F.col("size") - F.coalesce("used", F.lit(0))).alias("size"), F.lit(True).alias("is_gap"))
        state = scratch.write(homeless.unionByName(gaps).where("size > 0"), f"state{turn}")
        opens = _opening(state, capacity)
        turn += 1
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence_id and offset."""
    scratch = Scratch(docs.sparkSession, "pieces")
    release_heap(docs.sparkSession)  # tokenizers and their caches are outside of it
    release()
    pieces = token_pieces(docs, vocabulary, end_id, capacity, with_ids).withColumn("id", F.monotonically_increasing_id())
    pieces = scratch.write(pieces, "pieces")
    places = best_fit(pieces.select("id", F.col("length").alias("size")), capacity)
    own = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    return pieces.join(places, "id").select(*own, F.col("sequence").alias("sequence_id"), "offset")
