"""Toxicity by classifier chains over linear models.

Categories are predicted one after another: ``low_quality``, ``toxic``, ``severe``. Each is a
logistic regression over term features, to which the probabilities of
the earlier categories are added. For training those come from models that did not see the document
(out-of-fold), so that a later model learns how far earlier ones can be trusted.

The first two have labels. ``severe`` has none: its target is made, toxic documents with at least as many different marked
terms as most toxic ones, where the terms that count as marked are those of the toxic model that did not see the document. It grades
what is toxic and never decides which documents are: that is the second link alone.

Terms are the distinct lower-cased words of a document, and the first five letters of longer ones with a star. A term is a feature
if at least ``LEAST_HOLDERS`` documents of the sample hold it and it tells a category apart (at most ``MAX_TERMS`` terms
a category by deviance, counted in Spark over the sample; this bounds the model and drops no document);
five measures of the text's form come with them. The models are fitted on a bounded sample of
labelled documents (``MAX_SAMPLE``, half of them toxic if there are as many), chosen by a hash of doc_id.
The threshold for ``toxic`` is set on out-of-fold probabilities.

Defined results: a null or empty text has no terms and is not toxic; texts of any length are
read whole; labels of unknown documents and null labels are ignored, and a document with several labels takes the largest; without both
kinds of labels nothing is toxic; repeated rows get a row each; a null doc_id is judged like others; other
columns are kept where the caller keeps them; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.textkit import release, slices, tidy
from emberline.session import Scratch

if TYPE_CHECKING:  # workers don't need it
    import pandas as pd

#: Labelled documents that the models are fitted on, and terms of a category, at most.
MAX_SAMPLE, MAX_TERMS = 8000, 600
#: Documents of the sample that have to hold a term.
LEAST_HOLDERS = 4
FOLDS, STEM = 5, 5
CATEGORIES = ("low_quality", "toxic", "severe")
_WORD = re.compile(r"[^\W\d_]+")


def terms(text: str) -> set[str]:
    words = set(_WORD.findall(text.lower()))
    return words | {w[:STEM] + "*" for w in words if len(w) > STEM}


def form(text: str) -> list[float]:
    """Measures of a text's form, each about 0 to 1."""
    n = max(1, len(text))
    words = text.split()
    different = len(set(words)) / max(1, len(words))
    marks = text.count("!") + text.count("|") + text.count("?")
    upper = sum(map(str.isupper, text)) / n
    return [min(1.0, np.log1p(len(words)) / 10), different, min(1.0, 10 * marks / n), upper, min(1.0, text.count("\n") * 20 / n)]


@dataclass
class Chain:
    """Weights of each category's model over terms, form and earlier probabilities."""

    terms: dict[str, int] = field(default_factory=dict)
    weights: list[np.ndarray] = field(default_factory=list)
    threshold: float = 2.0

    def score(self, texts: list[str]) -> np.ndarray:
        """A probability for each text and category."""
        out = np.zeros((len(texts), len(CATEGORIES)))
        if not self.weights:
            return out
        known = self.terms.keys()
        for row, text in enumerate(texts):
            at = [self.terms[t] for t in terms(text) & known]
            dense = [1.0, *form(text)]
            for k, w in enumerate(self.weights):
                z = w[at].sum() + float(np.dot(w[len(self.terms) : len(self.terms) + len(dense)], dense)) + float(np.dot(w[len(self.terms) + len(dense) :], out[row, :k]))
                out[row, k] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def _logistic(row: np.ndarray, col: np.ndarray, dense: np.ndarray, target: np.ndarray, use: np.ndarray, n_terms: int, steps: int = 120) -> np.ndarray:
    """L2-regularised logistic regression by Adam on the documents in ``use``; classes weigh the same."""
    keep = use[row]
    row, col = row[keep], col[keep]
    w = np.zeros(n_terms + dense.shape[1])
    first, second = np.zeros_like(w), np.zeros_like(w)
    share = target[use].mean()
    weight = np.where(target > 0, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)) * use / max(1, use.sum())
    for step in range(1, steps + 1):
        z = np.bincount(row, weights=w[col], minlength=len(target)) + dense @ w[n_terms:]
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight
        gradient = np.concatenate([np.bincount(col, weights=error[row], minlength=n_terms), dense.T @ error]) + 1e-5 * w
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        w -= 0.15 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return w


def train(rows: pd.DataFrame, chosen: list[str]) -> Chain:
    """rows: fold, low_quality, toxic, terms (those chosen, numbers), form."""
    n, index = len(rows), {t: k for k, t in enumerate(chosen)}
    targets = {c: rows[c].to_numpy().astype(float) for c in ("low_quality", "toxic")}
    sizes = rows["terms"].map(len).to_numpy()
    row = np.repeat(np.arange(n), sizes)
    col = np.concatenate([np.asarray(t, dtype=np.int64) for t in rows["terms"]]) if n else np.empty(0, np.int64)
    dense = np.column_stack([np.ones(n), np.array(rows["form"].tolist())])
    fold = rows["fold"].to_numpy()
    chain = Chain(index)
    oof = np.zeros((n, len(CATEGORIES)))
    marked = np.zeros(n)  # terms of each document that speak for toxicity in the model that didn't see it
    for k, category in enumerate(CATEGORIES):
        if category == "severe":
            toxic = targets["toxic"] > 0
            targets[category] = (toxic & (marked >= max(1.0, np.median(marked[toxic])))).astype(float)
        target, features = targets[category], np.column_stack([dense, oof[:, :k]])
        for f in range(FOLDS):
            use = fold != f
            w = _logistic(row, col, features, target, use.astype(float) > 0, len(index))
            z = np.bincount(row, weights=w[: len(index)][col], minlength=n) + features @ w[len(index) :]
            oof[~use, k] = (1 / (1 + np.exp(-np.clip(z, -30, 30))))[~use]
            if category == "toxic":
                marked[~use] = np.bincount(row, weights=(w[: len(index)] > 1.0)[col].astype(float), minlength=n)[~use]
        chain.weights.append(_logistic(row, col, features, target, np.ones(n, dtype=bool), len(index)))
    chain.threshold = _threshold(oof[:, 1], targets["toxic"] > 0)
    return chain


def _threshold(p: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the thresholds with the fewest errors, a kept toxic document counting as much as a lost clean one."""
    grid = np.linspace(0.05, 0.95, 91)
    errors = np.array([(toxic & (p < t)).sum() + (~toxic & (p >= t)).sum() for t in grid])
    best = np.flatnonzero(errors == errors.min())
    return float(grid[best[len(best) // 2]])


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_SAMPLE) -> Chain:
    """From docs (doc_id, text) and labels (doc_id, quality, toxic)."""
    flags = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(
        F.max("toxic").alias("toxic"), F.max(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("low_quality")
    )
    key = F.xxhash64("doc_id", F.lit(43))
    totals = {r["toxic"]: r["count"] for r in flags.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return Chain()
    chance = F.least(F.lit(1.0), F.when(F.col("toxic") == 1, most / 2 / totals.get(1, 1)).otherwise(most / 2 / totals.get(0, 1)))
    drawn = flags.where(F.pmod(key, F.lit(1 << 20)) < chance * (1 << 20)).orderBy(key, "doc_id").limit(most)
    sample = docs.where("doc_id is not null and text is not null").select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    # Of rows that share an id one counts, so the sample is as large as it says whatever repeats.
    sample = sample.groupBy("doc_id", "toxic", "low_quality").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"].alias("text"))
    sample = sample.select("text", "toxic", "low_quality", F.pmod(F.xxhash64("doc_id", F.lit(44)), F.lit(FOLDS)).cast("int").alias("fold"))
    sample = Scratch(docs.sparkSession, "toxicity").write(sample, "sample")

    def list_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [list(terms(t)) for t in part.column("text").to_pylist()]
                size = [len(f) for f in found]
                rows = pa.array(np.repeat(np.arange(len(found)), size))
                columns = [pa.array([t for f in found for t in f], pa.string()), part.column("toxic").take(rows), part.column("low_quality").take(rows)]
                yield pa.RecordBatch.from_arrays(columns, ["term", "toxic", "low_quality"])

    n, n_toxic, n_low = sample.agg(F.count(F.lit(1)), F.sum("toxic"), F.sum("low_quality")).first()
    if not n_toxic or n_toxic == n:
        return Chain()
    counted = sample.mapInArrow(tidy(list_terms), "term string, toxic int, low_quality int").groupBy("term").agg(
        F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic"), F.sum("low_quality").alias("low_quality")
    ).where(F.col("n") >= LEAST_HOLDERS)
    chosen: set[str] = set()
    for category, total in (("toxic", n_toxic), ("low_quality", n_low)):
        # How much the term's holders tell: counts times the log of counts over expected counts (half the deviance).
        yes, no = F.col(category).cast("double"), (F.col("n") - F.col(category)).cast("double")
        part = lambda seen, share: F.when(seen > 0, seen * F.log(seen / (F.col("n") * F.lit(float(share))))).otherwise(0.0)
        sure = part(yes, max(total, 0.5) / n) + part(no, max(n - total, 0.5) / n)
        chosen |= {r["term"] for r in counted.orderBy(sure.desc(), "term").limit(MAX_TERMS).collect()}
    ordered = sorted(chosen)
    index = {t: k for k, t in enumerate(ordered)}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = [sorted(index[t] for t in terms(x) & index.keys()) for x in texts]
            own = [batch.column(c) for c in ("fold", "toxic", "low_quality")]
            columns = [*own, pa.array(found, pa.list_(pa.int32())), pa.array([form(x) for x in texts], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["fold", "toxic", "low_quality", "terms", "form"])

    kept = ["fold", "toxic", "low_quality", "text"]
    schema = "fold int, toxic int, low_quality int, terms array<int>, form array<double>"
    rows = sample.select(*kept).mapInArrow(tidy(features), schema).toArrow().to_pandas()
    if rows["toxic"].nunique() < 2:  # labels without documents
        return Chain()
    # The same order whatever the partitions.
    order = sorted(range(len(rows)), key=lambda k: (tuple(rows["terms"][k]), tuple(rows["form"][k]), *rows.loc[k, ["fold", "toxic", "low_quality"]]))
    chain = train(rows.iloc[order].reset_index(drop=True), ordered)
    del rows
    release()  # the driver goes on to other work
    return chain


def score_documents(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows of docs with p_low_quality, p_toxic, p_severe and toxic; docs has a text and columns of other names."""
    names = [f"p_{c}" for c in CATEGORIES]
    kept = list(docs.columns)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                p = chain.score([t or "" for t in part.column("text").to_pylist()])
                own = [part.column(c) for c in kept]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(c) for c in p.T.copy()), pa.array(p[:, 1] >= chain.threshold)], [*kept, *names, "toxic"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.mapInArrow(tidy(score), f"{kinds}, " + ", ".join(f"{n} double" for n in names) + ", toxic boolean")


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't judged toxic, with their columns."""
    chain = fit(docs, labels)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"), "text")
    judged = score_documents(row, chain).where(~F.col("toxic"))
    return judged.select(*[(F.col("text") if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])
