"""Hard negatives by blocked dense products: rows of another label that are nearly as near to an anchor as its positives.

Vectors are of whole numbers (``quantised``), and a score is an inner product. Anchors are dealt into blocks of bounded size. For
each block the candidates are read twice, as they lie, without a shuffle, and the block goes with the tasks:

1. Every task multiplies its candidates, in slices, with the block's matrix (float64, exact as long as norms' products are below 2^53;
   beyond it, integers of any size) and keeps the best ``positives`` of each anchor's own label. What tasks have kept is merged by a ranked window.
2. With the positives known, each has a window of scores. Tasks multiply again and keep the best ``negatives`` of another label within
   the window of each positive; these are merged in the same way.

A task keeps, and the merge gets, at most as many rows an anchor and task as are asked for, whatever the candidates: ties, hot labels and copies
cost nothing. The work is anchors times candidates, which is asked for; it is shared evenly as candidates are not dealt out by a key.

Defined results: a null id or label, a null vector, one with null or non-finite components, or one of another length than most takes no part
(of several lengths that are equally frequent, the shortest takes part), nor does one whose whole numbers have a norm of 2**62 or more, as its score with
itself has no 64-bit value; zero vectors do; rows that share an id are no candidates of each other, and
are anchors of their own; rows that repeat an anchor are one anchor; candidates with equal ids and scores are one; a score beyond 64 bits is given
as the nearest 64-bit number (it is compared whole); an anchor without positives and a positive without negatives have no rows;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.textkit import tidy
from emberline.session import Scratch

#: Anchors of a block (expected; 512 KB a thousand at 64 dimensions), candidates and anchors that are multiplied at a time.
BLOCK, CANDIDATES, ANCHORS = 8192, 2048, 512
#: Float64 holds all whole numbers below it.
EXACT = 2.0**53
#: Norm from which on a vector takes no part.
LARGEST = 2.0**62


def quantised(vectors: DataFrame, id_column: str, vector_column: str, label_column: str, scale: float = 256.0) -> DataFrame:
    """id, label and vector (floor of scale times each component) of the rows that take part."""
    v = F.col("vector")
    rows = vectors.select(F.col(id_column).alias("id"), F.col(label_column).cast("long").alias("label"), F.col(vector_column).cast("array<double>").alias("vector"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & finite)
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    rows = rows.where(F.size("vector") == (sizes["size"] if sizes else 0))
    scaled = F.transform(v, lambda x: x * scale)
    whole = F.transform(scaled, lambda x: F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x))  # beyond it all are whole
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    return rows.select("id", "label", whole.alias("vector")).where(square < LARGEST**2)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _norm(x: np.ndarray) -> float:
    return float(np.sqrt((x * x).sum(axis=1).max(initial=0.0)))


def products(a: np.ndarray, x: np.ndarray, times: int) -> np.ndarray:
    """Inner products of all rows, exactly, also so many times; integers of any size if they might pass what float64 holds."""
    if _norm(a) * _norm(x) * times < EXACT / 2:  # then no partial sum passes it either, with room for the norms' rounding
        return a @ x.T
    whole = lambda m: np.array([[int(c) for c in row] for row in m.tolist()], dtype=object).reshape(m.shape)
    return whole(a) @ whole(x).T


def leading(score: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The best k distinct pairs of score (negated) and id, by score, then smaller id."""
    if score.dtype == object:
        return sorted({(-int(s), i) for s, i in zip(score.tolist(), ids.tolist(), strict=True)})[:k]
    most = 16 * k
    while True:
        s, own = score, ids
        if len(s) > most:  # of many, all that are as good as some
            good = s >= np.partition(s, len(s) - most)[-most]
            s, own = s[good], own[good]
        order = np.lexsort((own, -s))
        s, own = s[order], own[order]
        fresh = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (own[1:] != own[:-1])]) if len(s) else np.empty(0, np.int64)
        if len(fresh) >= k or len(score) <= most:
            return [(-int(x), i) for x, i in zip(s[fresh[:k]].tolist(), own[fresh[:k]].tolist(), strict=True)]
        most *= 16  # repeated rows took the places


class Best:
    """The best k candidates (by score, then smaller id) of each of some rows, of those seen so far."""

    def __init__(self, rows: int, k: int):
        self.k = k
        self.held: list[list[tuple[int, int]]] = [[] for _ in range(rows)]
        #: A score below which nothing can enter.
        self.least = np.full(rows, -np.inf)

    def add(self, at: np.ndarray, score: np.ndarray, allowed: np.ndarray, ids: np.ndarray) -> None:
        """Candidates of the rows ``at``: scores and which of them count (rows x candidates)."""
        good = allowed & (score >= self.least[at, None])
        for r in np.flatnonzero(good.any(axis=1)).tolist():
            row = int(at[r])
            own = sorted({*self.held[row], *leading(score[r, good[r]], ids[good[r]], self.k)})[: self.k]
            self.held[row] = own
            if len(own) == self.k:
                self.least[row] = np.nextafter(float(-own[-1][0]), -np.inf)


def _mined(block: pa.Table, slots: list[list[tuple[int, int, int]]] | None, k: int, bounds: tuple[int, int, int]) -> Callable:
    """A task: key, slot, id and score of the best candidates that it has seen.

    Without slots, of the anchors' own labels (slot 0). With them (row in the block, slot, positive score), of other labels within the slot's window.
    """
    a, label, anchor_id = _matrix(block.column("vector").combine_chunks()), block.column("label").to_numpy(), block.column("id").to_numpy()
    keys = block.column("key").to_pylist()
    wanted = [(r, 0, 0) for r in range(len(keys))] if slots is None else slots
    of = np.array([r for r, _, _ in wanted], dtype=np.int64)
    scores = [s for _, _, s in wanted]
    whole, low, high = bounds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(wanted), k)
        reach = np.array(scores, dtype=object if any(abs(s) * max(bounds) >= EXACT for s in scores) else np.float64)
        for batch in batches:
            for lo in range(0, batch.num_rows, CANDIDATES):
                part = batch.slice(lo, CANDIDATES)
                x, ids, own = _matrix(part.column("vector")), part.column("id").to_numpy(), part.column("label").to_numpy()
                for first in range(0, len(keys), ANCHORS):
                    score = products(a[first : first + ANCHORS], x, max(bounds))
                    begin, end = np.searchsorted(of, [first, first + ANCHORS])
                    for start in range(begin, end, ANCHORS):
                        at = np.arange(start, min(end, start + ANCHORS))
                        own_score, rows = score[of[at] - first], of[at]
                        allowed = anchor_id[rows, None] != ids
                        if slots is None:
                            allowed &= label[rows, None] == own
                        else:
                            allowed &= label[rows, None] != own
                            allowed &= ((whole * own_score >= low * reach[at, None]) & (whole * own_score <= high * reach[at, None])).astype(bool)
                        best.add(at, own_score, allowed, ids)
        out = [(keys[of[j]], wanted[j][1], i, -s) for j, own in enumerate(best.held) for s, i in own]
        columns = [pa.array([o[c] for o in out], kind) for c, kind in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.decimal128(38, 0)))]
        yield pa.RecordBatch.from_arrays(columns, ["key", "slot", "other", "score"])

    return run


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The best k of what tasks have found: key, slot, rank, other, score."""
    order = Window.partitionBy("key", "slot").orderBy(F.desc("score"), "other")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(anchors: DataFrame, candidates: DataFrame, positives: int = 5, negatives: int = 3, window: tuple[int, int, int] = (100, 50, 95), block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for ``quantised`` rows.

    ``window`` (whole, low, high): a negative's score times whole is between the positive's score times low and times high.
    """
    spark = candidates.sparkSession
    scratch = Scratch(spark, "negatives")
    rows = scratch.write(candidates, "candidates")
    keyed = anchors.select(F.xxhash64("id", "label", "vector").alias("key"), "id", "label", "vector").dropDuplicates(["key"])
    keyed = scratch.write(keyed, "anchors")
    blocks = -(-keyed.count() // block)
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    schema = "key long, slot int, other long, score decimal(38, 0)"
    out: DataFrame | None = None
    for b in range(blocks):
        own = keyed.where(F.pmod("key", F.lit(blocks)) == b).orderBy("key").toArrow()
        if not own.num_rows:
            continue
        near = scratch.write(_merged(rows.mapInArrow(tidy(_mined(own, None, positives, window)), schema), positives), f"positives{b}")
        at = {key: r for r, key in enumerate(own.column("key").to_pylist())}
        slots = sorted((at[r["key"]], r["rank"], int(r["score"])) for r in near.select("key", "rank", "score").toArrow().to_pylist())
        hard = _merged(rows.mapInArrow(tidy(_mined(own, slots, negatives, window)), schema), negatives)
        hard = scratch.write(hard, f"negatives{b}")
        positive = near.select("key", F.col("rank").alias("slot"), F.col("other").alias("positive_id"), _long("score").alias("positive_score"))
        pairs = hard.join(positive, ["key", "slot"]).join(keyed.select("key", F.col("id").alias("anchor_id")), "key")
        pairs = pairs.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), "positive_score", _long("score").alias("negative_score"))
        out = pairs if out is None else out.unionByName(pairs)
    return spark.createDataFrame([], result) if out is None else out


def _long(score: str) -> Column:
    bound = lambda x: F.lit(str(x)).cast("decimal(38, 0)")
    return F.least(F.greatest(F.col(score), bound(-(2**63))), bound(2**63 - 1)).cast("long")
