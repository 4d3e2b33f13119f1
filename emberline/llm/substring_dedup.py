"""Removing words in windows that occur elsewhere, found by difference-cover anchors.

Positions 0, 1, 4, 14 and 16 modulo 21 are a difference cover: for any two
positions i and j there is a step s below 21 with i + s and j + s both in it.
So two equal windows of 35 words share an anchor of 15 words at the same place in
both, and only anchors (5 of 21 positions) go through the first shuffle. Then each
window with a repeated anchor is hashed whole (95 bits) and counted, which
extends the anchors to full matches. Windows that are found once come back to their
documents; the other candidates are removed.

A worker counts equal hashes of its batch first. Those that it sees more than once
are settled there: one row without a document stands for them in the shuffle, and their
own rows go by a key of their own. So a passage that a third of all documents hold
is at most one row a batch, or goes evenly to all tasks.

Rows are known by a 64-bit hash of doc_id and text. Defined results: a null or
empty text has no words and keeps none; a null doc_id is a value like others;
repeated rows are copies of each other; rows that share a doc_id but not the text are
judged apart; other columns are kept as they are, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.copies import copy_groups, settled
from emberline.llm.textkit import Words, mix64, ragged, slices, text_bytes, tidy
from emberline.session import Scratch, small

WINDOW = 35
PERIOD = 21
COVER = (0, 1, 4, 14, 16)
ANCHOR = WINDOW - PERIOD + 1
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
#: Text bytes whose equal hashes a worker settles on its own.
BATCH_BYTES = 8 << 20


def _places(words: Words, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word that starts ``size`` words of one document: index, row and position."""
    position = ragged(counts)
    row = np.repeat(np.arange(len(counts)), counts)
    full = np.flatnonzero(np.repeat(counts, counts) - position >= size)
    return full, row[full], position[full]


def _rows(key: np.ndarray, more: np.ndarray, rid: np.ndarray, position: np.ndarray) -> pa.RecordBatch:
    """One batch for the shuffle by key; ``more`` are further bits that must be equal too."""
    whole = mix64(key ^ mix64(more, 13), 14)
    keys, weights, owned = settled(whole, mix64(mix64(rid.view(np.uint64), 9) ^ position.astype(np.uint64), 1))
    extra = len(keys) - len(key)
    none = np.zeros(extra, dtype=np.int64)
    if extra:
        first = np.unique(whole, return_index=True)
        at = first[1][np.searchsorted(first[0], keys[len(key) :])]
    unsettled = weights[: len(key)] == 1
    columns = [
        pa.array(np.concatenate([np.where(unsettled, key, keys[: len(key)]), key[at] if extra else none.view(np.uint64)]).view(np.int64)),
        pa.array((np.concatenate([np.where(unsettled, more, 0), more[at] if extra else none.view(np.uint64)]) & np.uint64(0x7FFFFFFF)).astype(np.int32)),
        pa.array(weights),
        pa.array(np.concatenate([rid, none]), mask=~owned),
        pa.array(np.concatenate([position, none]).astype(np.int32)),
    ]
    return pa.RecordBatch.from_arrays(columns, ["key", "more", "weight", "rid", "position"])


_ROWS = "key long, more int, weight int, rid long, position int"


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for large in slices(batch, size=BATCH_BYTES):
            keys, rids, positions = [], [], []
            for part in slices(large):
                words = Words(*text_bytes(part.column("text")))
                counts = words.counts()
                at, row, position = _places(words, counts, ANCHOR)
                own = _IN_COVER[position % PERIOD] & (counts[row] >= WINDOW)
                keys.append(words.windows(ANCHOR, 5)[at[own]])
                rids.append(part.column("rid").to_numpy()[row[own]])
                positions.append(position[own])
            key = np.concatenate(keys)
            yield _rows(key, np.zeros(len(key), dtype=np.uint64), np.concatenate(rids), np.concatenate(positions))


def _listed(words: Words, lists: pa.Array) -> np.ndarray:
    """The indices of the words at the listed positions of each document."""
    lengths = np.diff(lists.offsets.to_numpy())
    return words.first[np.repeat(np.arange(len(lists)), lengths)] + lists.flatten().to_numpy()


def _candidates(words: Words, anchors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window with a repeated anchor in its first PERIOD positions: index, row, position."""
    hit = np.zeros(len(words.hashes) + PERIOD + 1, dtype=np.int32)
    hit[_listed(words, anchors)] = 1
    total = np.concatenate([[0], np.cumsum(hit)])
    at, row, position = _places(words, words.counts(), WINDOW)
    near = total[at + PERIOD] > total[at]
    return at[near], row[near], position[near]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for large in slices(batch, size=BATCH_BYTES):
            found: list[list[np.ndarray]] = [[], [], [], []]
            for part in slices(large):
                words = Words(*text_bytes(part.column("text")))
                at, row, position = _candidates(words, part.column("anchors"))
                if len(at):
                    both = words.windows(WINDOW, 7)[at], words.windows(WINDOW, 8)[at] >> np.uint64(33)
                    for kept, x in zip(found, (*both, part.column("rid").to_numpy()[row], position), strict=True):
                        kept.append(x)
            if found[0]:
                yield _rows(*(np.concatenate(x) for x in found))


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with anchors: n_words, n_removed and the kept words joined by one space."""
    for batch in batches:
        for part in slices(batch):
            words = Words(*text_bytes(part.column("text")))
            counts = words.counts()
            at, _, _ = _candidates(words, part.column("anchors"))
            repeated = at[~np.isin(at, _listed(words, part.column("single")))]
            step = np.zeros(len(words.hashes) + WINDOW + 1, dtype=np.int64)
            step[repeated] += 1
            step[repeated + WINDOW] -= 1
            gone = np.cumsum(step)[: len(words.hashes)] > 0
            total = np.concatenate([[0], np.cumsum(gone)])
            removed = total[words.first[1:]] - total[words.first[:-1]]
            out = []
            for k in range(part.num_rows):
                stay = np.flatnonzero(~gone[words.first[k] : words.first[k + 1]]) + words.first[k]
                spans = zip(words.starts[stay].tolist(), words.ends[stay].tolist(), strict=True)
                data = words.raw[words.starts[stay[0]] : words.ends[stay[-1]]].tobytes() if len(stay) else b""
                base = int(words.starts[stay[0]]) if len(stay) else 0
                out.append(b" ".join([data[s - base : e - base] for s, e in spans]))
            yield _result(part, counts, removed, out)


def _unjudged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without anchors of their own: copies of others go whole if they hold a window, the rest stay."""
    for batch in batches:
        for part in slices(batch):
            data, bounds = text_bytes(part.column("text"))
            raw, ends = data.tobytes(), bounds.tolist()
            counts, removed, out = [], [], []
            for lo, hi, copied in zip(ends, ends[1:], part.column("copied").to_pylist(), strict=False):
                words = raw[lo:hi].split()
                gone = copied and len(words) >= WINDOW
                counts.append(len(words))
                removed.append(len(words) if gone else 0)
                out.append(b"" if gone else b" ".join(words))
            yield _result(part, np.array(counts, dtype=np.int64), np.array(removed, dtype=np.int64), out)


def _result(part: pa.RecordBatch, counts: np.ndarray, removed: np.ndarray, kept: list[bytes]) -> pa.RecordBatch:
    text = pa.array(kept, pa.binary()).cast(pa.string())
    own = part.column("text")
    return pa.RecordBatch.from_arrays(
        [part.column("row"), own, pa.array(counts.astype(np.int64)), pa.array(removed.astype(np.int64)), text],
        ["row", "text", "n_words", "n_removed", "kept"],
    )


def judge(docs: DataFrame) -> DataFrame:
    """A row for each document: row (its other columns), text, n_words, n_removed, kept."""
    scratch = Scratch(docs.sparkSession, "substring")
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    docs = docs.select(F.xxhash64("doc_id", "text").alias("rid"), others.alias("row"), "text")
    texts = docs.select("rid", "text")
    copies = scratch.write(copy_groups(texts, scratch, "rid"), "copies")
    unique = texts.join(small(copies.where("rid != leader").select("rid").distinct()), "rid", "left_anti")

    repeated = unique.mapInArrow(tidy(_anchors), _ROWS).withColumn("total", F.expr("sum(weight) over (partition by key)"))
    repeated = repeated.where("total > 1 and rid is not null")
    anchors = scratch.write(repeated.groupBy("rid").agg(F.collect_list("position").alias("anchors")), "anchors")
    known = scratch.write(anchors.select("rid").join(small(copies.select("rid").distinct()), "rid", "left_anti"), "known")

    listed = unique.join(small(anchors.select("rid")), "rid", "left_semi").join(anchors, "rid")
    windows = listed.mapInArrow(tidy(_windows), _ROWS).withColumn("total", F.expr("sum(weight) over (partition by key, more)"))
    windows = windows.where("total = 1")
    single = scratch.write(windows.groupBy("rid").agg(F.collect_list("position").alias("single")), "single")

    own = docs.schema["row"].dataType.simpleString()
    result = f"row {own}, text string, n_words long, n_removed long, kept string"
    lists = anchors.join(single, "rid", "left").select("rid", "anchors", F.coalesce("single", F.array().cast("array<int>")).alias("single"))
    found = docs.join(small(known), "rid", "left_semi").join(lists, "rid").mapInArrow(tidy(_judged), result)
    copied = copies.select("rid").distinct().withColumn("copied", F.lit(True))
    rest = docs.join(small(known), "rid", "left_anti").join(small(copied), "rid", "left").withColumn("copied", F.col("copied").isNotNull())
    return found.unionByName(rest.mapInArrow(tidy(_unjudged), result))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated windows taken out; n_chars follows the text, a text that changes has its words joined by one space."""
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept")).otherwise(F.col("text"))
    columns = []
    for c in docs.columns:
        own = F.col("row").getField(c) if c != "text" else text
        if c == "n_chars":
            own = F.when(changed, F.length("kept").cast(docs.schema[c].dataType)).otherwise(own)
        columns.append(own.alias(c))
    return judge(docs).select(*columns)
