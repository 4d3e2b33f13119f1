"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text's subwords are its runs of 1 to 3 characters, lower-cased, with everything
but letters as one space; a space may begin or end a run, to mark a word's edge, but not stand inside. Each is hashed to a
row of an embedding table. The rows' average goes through a linear softmax. Both are trained in
numpy by stochastic gradient descent on a bounded sample of labelled texts (``MAX_SAMPLE``,
chosen by a hash of doc_id, evenly over languages); whole texts are read. A part of the sample sets the softmax's temperature
and the score below which a language is rejected.

As the softmax is linear, the product of table and weights scores each subword, so
a prediction sums one row a subword. A text without letters has no subwords.

Defined results: a null text or one without letters is ``und`` with score 0; texts of any length are read
whole; ties go to the language that sorts first; repeated rows get a row each; other columns are kept
where the caller keeps them; an empty table gives no rows, and without labelled texts every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.textkit import mix64, on_release, ragged, slices, tidy

if TYPE_CHECKING:  # workers don't need it
    import pandas as pd

#: Labelled texts that the model is fitted on, at most.
MAX_SAMPLE = 3000
BUCKETS, DIMENSIONS, LONGEST = 1 << 15, 16, 3
EPOCHS, RATE, BATCH = 12, 4.0, 32
#: Characters whose subwords are hashed at a time; longer texts are cut for it.
PIECE = 1 << 18
#: Share of wrong languages that is accepted among texts that aren't rejected.
ACCEPTED_ERROR = 0.005
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


on_release(_letters.cache_clear)


def _pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, list[str], np.ndarray]]:
    """Lower-cased texts in lists of at most about ``PIECE`` characters: text numbers, pieces, and characters that are a piece's own.

    What a piece has beyond these only ends the runs that start in it.
    """
    rows: list[int] = []
    pieces: list[str] = []
    own: list[int] = []
    held = 0
    for k, text in enumerate(texts):
        lowered = text.lower()
        for lo in range(0, len(lowered), PIECE):
            if held >= PIECE:
                yield np.array(rows), pieces, np.array(own)
                rows, pieces, own, held = [], [], [], 0
            piece = lowered[lo : lo + PIECE + LONGEST - 1]
            rows.append(k)
            pieces.append(piece)
            own.append(min(PIECE, len(lowered) - lo))
            held += len(piece)
    if rows:
        yield np.array(rows), pieces, np.array(own)


def subwords(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bucket) of every subword, in parts of bounded size."""
    for row_of, pieces, own in _pieces(texts):
        lengths = np.array([len(t) + 1 for t in pieces], dtype=np.int64)
        codes = np.frombuffer((" ".join(pieces) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = _letters()[codes]
        codes = np.where(letter, codes, 32).astype(np.uint64)
        row = np.repeat(np.arange(len(pieces)), lengths)
        mine = ragged(lengths) < np.repeat(own, lengths)
        rows, buckets = [], []
        key = np.zeros(len(codes), dtype=np.uint64)
        for n in range(1, LONGEST + 1):
            m = len(codes) - n + 1
            if m <= 0:
                break
            with np.errstate(over="ignore"):
                key = key[:m] * np.uint64(0x100000001B3) + codes[n - 1 :]
            good = mine[:m] & (letter[:m] if n == 1 else (letter[:m] | letter[n - 1 :]))
            for inner in range(1, n - 1):
                good &= letter[inner : inner + m]
            good &= row[:m] == row[n - 1 :]
            at = np.flatnonzero(good)
            rows.append(row_of[row[at]])
            buckets.append((mix64(key[at], n) % np.uint64(BUCKETS)).astype(np.int64))
        yield np.concatenate(rows), np.concatenate(buckets)


@dataclass
class Model:
    languages: list[str]
    #: Score of each bucket for each language, and each language's own.
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    #: Score below which a language is rejected.
    least: float = 0.0

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        count, total = np.zeros(len(texts)), np.zeros((len(texts), len(self.languages)))
        for row, bucket in subwords(texts):
            count += np.bincount(row, minlength=len(texts))
            for k in range(len(self.languages)):
                total[:, k] += np.bincount(row, weights=self.table[bucket, k], minlength=len(texts))
        return total / np.maximum(1, count)[:, None] + self.bias, count > 0

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is accepted."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=bool)
        logits, has = self.logits(texts)
        p = softmax(logits / self.temperature)
        best = p.argmax(axis=1)
        score = np.where(has, p.max(axis=1), 0.0)
        return [self.languages[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)], score, has & (score >= self.least)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """label, part and the text's bucket counts, at most BUCKETS of them."""
    for batch in batches:
        for part in slices(batch):
            cells = [np.unique(row * BUCKETS + bucket, return_counts=True) for row, bucket in subwords(part.column("text").to_pylist())]
            found, at = np.unique(np.concatenate([np.empty(0, np.int64), *(c for c, _ in cells)]), return_inverse=True)
            n = np.bincount(at, weights=np.concatenate([np.empty(0), *(c for _, c in cells)]), minlength=len(found))
            bounds = np.searchsorted(found, np.arange(part.num_rows + 1) * BUCKETS)
            ids = [(found[lo:hi] % BUCKETS).astype(np.int32).tobytes() for lo, hi in zip(bounds, bounds[1:], strict=False)]
            counts = [n[lo:hi].astype(np.float32).tobytes() for lo, hi in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [part.column("label"), part.column("part"), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], ["label", "part", "ids", "counts"]
            )


def fit(labelled: DataFrame, most: int = MAX_SAMPLE) -> Model:
    """From doc_id, text and label (all not null)."""
    key = F.xxhash64("doc_id", F.lit(41))
    share = labelled.groupBy("label").agg(F.approx_count_distinct("doc_id", 0.02).alias("count"))
    n_labels = max(1, share.count())
    chance = F.least(F.lit(1.0), F.lit(most / n_labels * 1.2) / F.col("count"))
    even = labelled.select("doc_id", "label").join(F.broadcast(share), "label").where(F.pmod(key, F.lit(1 << 20)) < chance * (1 << 20))
    drawn = F.broadcast(even.distinct().orderBy(key, "doc_id", "label").limit(most).select("doc_id", "label"))
    part = F.pmod(F.xxhash64("doc_id", F.lit(42)), F.lit(5)).cast("int").alias("part")
    # Of rows that share an id one counts, so the sample is as large as it says whatever repeats.
    one = labelled.join(drawn, ["doc_id", "label"]).groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"].alias("text"))
    sample = one.select("label", "text", part)
    rows = sample.mapInArrow(tidy(_counts), "label string, part int, ids binary, counts binary").toArrow().to_pandas()
    return train(rows)


def train(rows: pd.DataFrame) -> Model:
    languages = sorted(rows["label"].unique())
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    rows = rows.sort_values(["label", "part", "ids", "counts"]).reset_index(drop=True)  # the same order whatever the partitions
    target = rows["label"].map({x: k for k, x in enumerate(languages)}).to_numpy()
    ids = [np.frombuffer(x, dtype=np.int32) for x in rows["ids"]]
    values = [c / max(1.0, c.sum()) for c in (np.frombuffer(x, dtype=np.float32) for x in rows["counts"])]
    rng = np.random.default_rng(7)
    embeddings = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    weights = rng.normal(0, 0.1, (DIMENSIONS, len(languages)))
    bias = np.zeros(len(languages))
    own = rows["part"].to_numpy()
    fitted, held = np.flatnonzero(own > 0), np.flatnonzero(own == 0)
    if not len(fitted):
        fitted = np.arange(len(rows))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(fitted)
        for lo in range(0, len(fitted), BATCH):
            batch = order[lo : lo + BATCH]
            at, value = np.concatenate([ids[i] for i in batch]), np.concatenate([values[i] for i in batch])[:, None]
            sizes = np.array([len(ids[i]) for i in batch])
            row = np.repeat(np.arange(len(batch)), sizes)
            hidden = np.zeros((len(batch), DIMENSIONS))
            np.add.at(hidden, row, value * embeddings[at])
            gradient = softmax(hidden @ weights + bias)
            gradient[np.arange(len(batch)), target[batch]] -= 1
            back = gradient @ weights.T
            weights -= rate * hidden.T @ gradient / len(batch)
            bias -= rate * 0.1 * gradient.mean(axis=0)
            np.subtract.at(embeddings, at, rate * value * back[row])
    model = Model(languages, embeddings @ weights, bias)
    if len(held):
        logits = np.stack([(values[i][:, None] * model.table[ids[i]]).sum(axis=0) for i in held]) + bias
        grid = np.geomspace(0.02, 5, 80)
        truth = target[held]
        losses = [-np.log(np.maximum(1e-12, softmax(logits / t)[np.arange(len(held)), truth])).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(losses))])
        p = softmax(logits / model.temperature)
        wrong = np.sort(p.max(axis=1)[p.argmax(axis=1) != truth])[::-1]
        allowed = int(ACCEPTED_ERROR * len(held))
        model.least = float(wrong[allowed]) if len(wrong) > allowed else 0.0
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs with lang_pred, score and accepted; docs has a text and columns of other names."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                language, score, accepted = model.predict([t or "" for t in part.column("text").to_pylist()])
                own = [part.column(c) for c in kept]
                yield pa.RecordBatch.from_arrays([*own, pa.array(language), pa.array(score), pa.array(accepted)], [*kept, "lang_pred", "score", "accepted"])

    kept = [c for c in docs.columns if c != "text"]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.mapInArrow(tidy(predict), f"{kinds}, lang_pred string, score double, accepted boolean")


def held_out(doc_id: Column) -> Column:
    """Documents that take no part in learning."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def identify_documents(docs: DataFrame, most: int = MAX_SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted of every document; learns from those that aren't held out."""
    known = docs.where("doc_id is not null and text is not null and lang is not null")
    labelled = known.where(~held_out(F.col("doc_id"))).select("doc_id", "text", F.col("lang").alias("label"))
    model = fit(labelled, most)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(rows, model)
