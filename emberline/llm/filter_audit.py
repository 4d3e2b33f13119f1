"""How the filters of a corpus interact: what each removes in every order, alone, and on average.

Each document fails or passes each filter. For all subsets T of the filters the documents that fail all of T are counted,
as sums of products of flags: N(T), 32 numbers a part of the corpus, and 32 more for each kind of labelled documents. All answers follow from them
without reading a document again:

* survivors of the filters S: the sum of (-1)^|T| N(T) over the subsets T of S (inclusion and exclusion);
* removed by a step: the survivors before it less those after it; redundant: N of the filter less what it removed;
* failing f only: the Moebius inversion at {f}, the sum of (-1)^(|T|-1) N(T) over all T that hold f;
* the sum over all orders of what f removes: the game "documents removed by S" has the Harsanyi dividends
  (-1)^(|T|+1) N(T), and f's Shapley value is the sum of its dividends, each shared by |T|; times the number of orders it is whole.

The filters of the corpus (``corpus_flags``): A under 200 words, B under half of the words distinct, C over 3 % capitals A-Z, D any of #$%&*|,
E the text of a smaller doc_id again. Flags are made with column functions; equal texts meet as hashes (128 bits), with the
smallest id of each found with map-side minima.

Defined results: a null text is empty, a null part is the empty string; an empty text fails A, and E if a smaller id is empty too; texts are
read whole; rows that repeat an id count each, and none is a copy of another row with its id; a null doc_id has no labels, is
no smaller id and fails no E; labels of unknown documents are ignored, and of several labels of a document one that says 1 is enough; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.session import Scratch, small

_WORD_ENDS = r"[\x20\x09-\x0D]+"


def text_flags(text: Column) -> dict[str, Column]:
    """Whether a text (not null) fails the filters A to D."""
    words = F.array_remove(F.split(text, _WORD_ENDS, -1), "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def corpus_flags(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, part and a boolean for each of A to E, a row for each of docs (doc_id, text, lang)."""
    whole = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    flags = text_flags(F.col("text"))
    known = whole.select("doc_id", "part", F.unhex(F.md5("text")).alias("key"), *[x.alias(f) for f, x in flags.items()])
    known = scratch.write(known, "flags")
    firsts = known.where("doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    firsts = scratch.write(firsts.where("first < last").select("key", "first"), "firsts")
    met = known.join(small(firsts), "key", "left")
    return met.select("doc_id", "part", *flags, F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias("E"))


def joint_failures(flags: DataFrame, filters: str, weights: dict[str, Column]) -> DataFrame:
    """part, and for each weight an array: at place m the sum over the documents that fail all filters whose bit is in m."""
    flag = {f: F.col(f).cast("long") for f in filters}

    def product(weight: Column, mask: int) -> Column:
        out = weight.cast("long")
        for k, f in enumerate(filters):
            if mask >> k & 1:
                out = out * flag[f]
        return out

    n = 1 << len(filters)
    sums = [F.sum(product(w, m)).alias(f"{name}_{m}") for name, w in weights.items() for m in range(n)]
    summed = flags.groupBy("part").agg(*sums)
    return summed.select("part", *[F.array(*[F.col(f"{name}_{m}") for m in range(n)]).alias(name) for name in weights])


def _signed(counts: Column, subsets: list[int], sign: int = 1) -> Column:
    """The sum of counts over subsets, of which those of an odd size are taken away (sign 1)."""
    out = F.lit(0).cast("long")
    for m in subsets:
        out = out + F.get(counts, F.lit(m)) * (sign * (-1) ** m.bit_count())
    return out


def survivors(counts: Column, filters: int) -> Column:
    """Of each set of filters (as bits), how many documents fail none of them."""
    return F.array(*[_signed(counts, [t for t in range(1 << filters) if t & ~s == 0]) for s in range(1 << filters)])


def audit(counts: DataFrame, filters: str, lost: dict[str, str]) -> DataFrame:
    """All orders of the filters and their steps, from ``joint_failures`` with the weight ``every`` and those that ``lost`` names (column: weight)."""
    n = len(filters)
    every, full = F.col("every"), range(1 << n)
    orders = 1
    for k in range(2, n + 1):
        orders *= k
    dividends = [[(-1) ** (t.bit_count() + 1) * orders // t.bit_count() if t >> k & 1 else 0 for t in full] for k in range(n)]
    shared = lambda k: sum((F.get(every, F.lit(t)) * d for t, d in enumerate(dividends[k]) if d), F.lit(0).cast("long"))
    known = counts.select(
        "part",
        survivors(every, n).alias("left"),
        *[survivors(F.col(w), n).alias(f"left_{c}") for c, w in lost.items()],
        F.array(*[F.get(every, F.lit(1 << k)) for k in range(n)]).alias("fails"),
        F.array(*[_signed(every, [t for t in full if t >> k & 1], -1) for k in range(n)]).alias("alone"),
        F.array(*[shared(k) for k in range(n)]).alias("shared"),
    )
    names = ",".join("".join(p) for p in permutations(filters))
    ordered = known.withColumn("filter_order", F.explode(F.split(F.lit(names), ",")))
    steps = ordered.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    bit = lambda letter: F.instr(F.lit(filters), letter) - 1
    at = lambda k: bit(F.substring(F.col("filter_order"), k, F.lit(1)))
    after = F.aggregate(F.sequence(F.lit(1), F.col("step")), F.lit(0), lambda m, k: m + F.pow(F.lit(2), at(k)).cast("int"))
    masks = steps.withColumn("own", at(F.col("step"))).withColumn("after", after).withColumn("before", F.col("after") - F.pow(F.lit(2), F.col("own")).cast("int"))
    removed = lambda left: F.get(left, F.col("before")) - F.get(left, F.col("after"))
    return masks.select(
        "part", "filter_order", "step",
        F.get("left", "after").alias("kept"),
        removed("left").alias("removed"),
        (F.get("fails", "own") - removed("left")).alias("redundant"),
        F.get("alone", "own").alias("unique_fails"),
        *[removed(f"left_{c}").alias(c) for c in lost],
        F.get("shared", "own").alias("shapley"),
    )


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley for docs (doc_id, text, lang) and labels (doc_id, quality, toxic)."""
    scratch = Scratch(docs.sparkSession, "audit")
    flags = corpus_flags(docs, scratch)
    one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    known = scratch.write(known.where("good or toxic"), "labels")
    marked = flags.join(small(known), "doc_id", "left")
    weight = lambda c: F.coalesce(F.col(c), F.lit(False))
    counts = joint_failures(marked, "ABCDE", {"every": F.lit(1), "good": weight("good"), "toxic": weight("toxic")})
    return audit(scratch.write(counts, "counts"), "ABCDE", {"good_lost": "good", "toxic_lost": "toxic"})
