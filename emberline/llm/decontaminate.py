"""Documents that hold benchmark items, also reworded, by latent semantic retrieval.

1. Texts are cut into blocks of ``BLOCK`` words; two neighbouring blocks are a passage. In how many blocks a
   word (hashed to ``FEATURES`` features) stands is counted over all documents and gives the weights (TF-IDF).
   Every feature weighs something, also one that stands in every block.
2. A distributed randomised singular value decomposition of all passages of all documents, in two readings of them (the first one counts
   for step 1 too), gives the corpus's leading directions; copies count as often as they stand. A set of the benchmark's passages, which together count as much as the corpus,
   is added to them, and the leading ``RANK`` directions of both are its latent space. The benchmark is taken in sets
   of at most ``SET`` passages, a space each, so that a large one is not squeezed into one space.
3. Every passage of every document is projected, and its cosine with the items' passages in the latent space makes candidates.
4. Runs of ``SHORTEST`` words that a document shares with an item are looked up by hash too, so what is there word
   for word is a candidate however common its words are. So are items of fewer words, as a whole.
5. Around each candidate the longest common subsequence of words with the item is measured, and that of
   the item's answer, its last sentence. An item is held if most of it is there in order, or much of it with
   most of its answer, or some of it, in other words by the cosine, with its whole answer.

Words are maximal runs of ASCII letters, digits and non-ASCII bytes, lower-cased from A to Z.

Recall by cosines alone, measured on the 200 items of the test data at scale 0.1, each put into a document with three tenths of its words
taken out and two tenths replaced: 0.97 or more.

Defined results: null or empty texts hold nothing; items without words are held by nothing; items shorter than
``SHORTEST`` words can't be told from chance and are found only word for word, in one run (their cosine is null); an item that a document
holds more than once gives one row; repeated rows, of documents or of the benchmark, give a row each; a null doc_id or item_id is kept, and
ids may have any type; texts of any length are read whole; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.textkit import Words, ragged, release, slices, text_bytes, tidy
from emberline.session import BATCH_ROWS, Scratch, batch_rows, release_driver, small

BLOCK = 24
FEATURES = 1 << 15
#: Dimensions of a latent space, benchmark passages that share one, and spaces that are searched in one pass.
RANK, SET, SPACES = 128, 256, 4
#: Extra dimensions of the randomised decomposition, and features whose sums travel as one row.
MORE, ROWS = 8, 1024
#: Items that the driver takes at a time (expected), and bytes of their texts.
ITEMS, ITEM_BYTES = 4096, 16 << 20
#: Least cosine of a candidate; parts of an item's words that have to be there in order: without its answer, with most of it, with the whole of it.
#: (Passages without the item stay below 0.35 of its words.)
COSINE, MOST, MUCH, SOME = 0.55, 0.5, 0.4, 0.25
#: Parts of an answer that are most of it and the whole of it, words that a whole one has at least, and the cosine that either asks for.
ANSWER, WHOLE, ANSWER_WORDS, CLOSE = 0.7, 0.9, 5, 0.65
SHORTEST = 8
#: Blocks that are projected at a time; words from which a feature's rows are summed at once, and features, or rows of one, that are taken at a time.
CHUNK, LAYERS, TAKEN = 512, 32, 2048

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[:128] = [not chr(c).isalnum() for c in range(128)]
_RUN = 31
_SENTENCE = re.compile(r"[.!?\n]+")


def _words(part_text: pa.Array) -> Words:
    return Words(*text_bytes(part_text), lower=True, separators=_SEPARATOR)


def _hashes(text: str) -> np.ndarray:
    return _words(pa.array([text])).hashes


def _blocks(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The first word of each block, blocks in order of documents, and each document's first block (and the end)."""
    counts = words.counts()
    per = -(-counts // BLOCK)
    first = np.concatenate([[0], np.cumsum(per)])
    start = np.repeat(words.first[:-1], per) + (np.arange(first[-1]) - np.repeat(first[:-1], per)) * BLOCK
    return start, first


def _features(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(FEATURES)).astype(np.int32)


def _follows(first: np.ndarray, blocks: int) -> np.ndarray:
    """Whether the next block is of the same document."""
    out = np.ones(blocks, dtype=bool)
    out[first[1:][np.diff(first) > 0] - 1] = False
    return out


@dataclass
class Corpus:
    """Weights of the features, and the leading directions of all passages' vectors, each as long as its singular value."""

    docs: DataFrame
    weights: np.ndarray
    #: Features x directions: of passages as rows of a matrix A, ``leading @ leading.T`` is close to A.T @ A.
    leading: np.ndarray
    #: Passages of all documents.
    size: int

    @property
    def sample(self) -> DataFrame:
        """The passages themselves (features, int32), each text once; all of them, and not drawn from."""

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for feature, start, follows in _read(batches):
                ends = np.r_[start[1:], len(feature)]
                stop = np.where(follows, np.r_[ends[1:], 0], ends)
                passages = [feature[lo:hi].tobytes() for lo, hi in zip(start, stop, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(passages, pa.binary())], ["passage"])

        return self.docs.select("text").mapInArrow(tidy(read), "passage binary").distinct()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of slices of texts: features of the words, first words of blocks, and whether the next block is of the same document."""
    for batch in batches:
        for part in slices(batch):
            words = _words(part.column("text"))
            start, first = _blocks(words)
            if len(start):
                yield _features(words.hashes), start, _follows(first, len(start))


def _runs_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ones of sorted keys, and how often each comes."""
    if not len(keys):
        return keys, keys
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.diff(np.r_[first, len(keys)])


def read_corpus(docs: DataFrame, scratch: Scratch) -> Corpus:
    """Counts the blocks that hold each feature, and decomposes the passages."""
    directions, n, blocks = _passage_sums(docs, None)
    release_driver(docs.sparkSession)  # the sums that the first reading has shuffled take as much disk as the second one's
    # Log 2 at least: copies may put an item's words into any share of the blocks.
    weights = np.log1p((blocks + 1) / (n + 1)).astype(np.float32)
    directions *= weights[:, None]
    return Corpus(docs, weights, leading_directions(docs, weights, directions), blocks)


@dataclass
class Item:
    key: int
    words: np.ndarray
    answer: np.ndarray
    #: Hashes of its runs of ``SHORTEST`` words, or of the whole if it is shorter.
    runs: np.ndarray
    #: Places of the words, and of the answer's.
    at: dict[int, int]
    answer_at: dict[int, int]


@dataclass
class Space:
    """A set of items' passages in their latent space."""

    #: Weighted latent coordinates of each feature.
    basis: np.ndarray
    #: Latent directions of the passages, and their items.
    passages: np.ndarray
    owner: np.ndarray


@dataclass
class Group:
    """Items that are searched in one pass."""

    items: list[Item]
    spaces: list[Space]
    #: Of each size of runs: their hashes, sorted, and their items.
    runs: dict[int, tuple[np.ndarray, np.ndarray]]

    def __post_init__(self) -> None:
        own = [item.words for item in self.items]
        #: Words of each item, all different ones, and of items and their words (item number x words + word) how often it has them.
        self.sizes = np.array([len(w) for w in own])
        self.known, word = np.unique(np.concatenate(own), return_inverse=True)
        self.pairs, self.times = np.unique(np.repeat(np.arange(len(own)), self.sizes) * len(self.known) + word, return_counts=True)


def _item(key: int, text: str) -> Item | None:
    sentences = [s for s in _SENTENCE.split(text) if s.strip()]
    words = _words(pa.array([text]))
    answer = _hashes(sentences[-1]) if len(sentences) > 1 else np.empty(0, dtype=np.uint64)
    if not len(words.hashes):
        return None
    return Item(key, words.hashes, answer, words.windows(min(len(words.hashes), SHORTEST), _RUN), places(words.hashes), places(answer))


def _passages(words: np.ndarray) -> list[np.ndarray]:
    """An item whole if it fits in a passage and a half, or else in passages; none of one that is only looked up."""
    if len(words) < SHORTEST:
        return []
    if len(words) <= 3 * BLOCK:
        return [words]
    return [words[lo : lo + 2 * BLOCK] for lo in range(0, len(words) - BLOCK, BLOCK)]


def _keys(feature: np.ndarray, block: np.ndarray, blocks: int) -> np.ndarray:
    """A number for each word's block and feature, in 32 bits if they suffice: these are sorted in half the time."""
    kind = np.uint32 if blocks * FEATURES <= 1 << 32 else np.int64
    return block.astype(kind) * kind(FEATURES) + feature.astype(kind)


def _squared_norms(feature: np.ndarray, block: np.ndarray, follows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of the TF-IDF vectors of the passages that start at each block, from the words' features and blocks."""
    keys = _keys(feature, block, len(follows))
    second = np.r_[False, follows[:-1]][block]  # words of the second block of a passage too
    keys = np.concatenate([keys, keys[second] - keys.dtype.type(FEATURES)])
    keys.sort()
    keys, n = _runs_of(keys)
    return np.bincount(keys // FEATURES, (n * weights[keys % FEATURES].astype(np.float64)) ** 2, minlength=len(follows))


def _with_next(rows: np.ndarray, follows: np.ndarray) -> np.ndarray:
    """Each block's row and that of the next block of its document."""
    out = np.empty_like(rows)
    np.add(rows[:-1], rows[1:], out=out[:-1])
    out[~follows] = rows[~follows]
    return out


def _with_last(rows: np.ndarray, follows: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Each block's row and that of the block before it in its document."""
    np.add(rows[1:], rows[:-1], out=out[1:])
    begins = np.r_[True, ~follows[:-1]]
    out[begins] = rows[begins]
    return out


def _add_rows(total: np.ndarray, feature: np.ndarray, row: np.ndarray, rows: np.ndarray) -> None:
    """total[feature[k]] += rows[row[k]] for every k."""
    order = np.argsort(feature.astype(np.uint16), kind="stable")
    known, n = _runs_of(feature[order])
    first = np.cumsum(n) - n
    often = np.argsort(-n, kind="stable")
    known, n, first, own = known[often], n[often], first[often], row[order]
    many = int(np.searchsorted(-n, -LAYERS, "left"))
    added, spare = np.empty((2, TAKEN, rows.shape[1]), dtype=np.float32)
    for j in range(many):
        for lo in range(first[j], first[j] + n[j], TAKEN):
            at = own[lo : min(lo + TAKEN, first[j] + n[j])]
            total[known[j]] += np.take(rows, at, axis=0, out=spare[: len(at)], mode="clip").sum(axis=0)
    for lo in range(many, len(n), TAKEN):  # sums of some features stay in the processor's cache until they are whole
        at, times = first[lo : lo + TAKEN], n[lo : lo + TAKEN]
        np.take(rows, own[at], axis=0, out=added[: len(at)], mode="clip")
        for k in range(1, int(times[0])):
            m = int(np.searchsorted(-times, -k, "left"))
            added[:m] += np.take(rows, own[at[:m] + k], axis=0, out=spare[:m], mode="clip")
        total[known[lo : lo + TAKEN]] += added[: len(at)]


def _drawn() -> np.ndarray:
    """The random directions that the decomposition begins with, the same ones each time."""
    return np.random.default_rng(11).standard_normal((FEATURES, RANK + MORE), dtype=np.float32)


def _passage_sums(docs: DataFrame, weights: np.ndarray | None, directions: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """The sum over all passages of their features' counts times the product of their vector and the directions, by its squared length.

    Before weights are known, all of them are one, a passage's words stand for its squared length, and the blocks that hold each feature are counted too, and all blocks.
    Without directions (and weights), tasks draw the first ones themselves: to send them costs their size in disk on each executor.
    Tasks sum their passages' parts, Spark adds those of the tasks, and the driver gets the sums (features x directions, whatever the corpus).
    """
    width = RANK + MORE if directions is None else directions.shape[1]
    sent = directions if weights is None else weights[:, None] * directions
    schema = "first int, sums binary, counts binary, blocks long"

    def rows(total: np.ndarray, counts: np.ndarray, blocks: int, at: Iterator[int]) -> Iterator[pa.RecordBatch]:
        for k, lo in enumerate(at):
            own = slice(k * ROWS, (k + 1) * ROWS)
            columns = [pa.array([lo], pa.int32()), *(pa.array([x[own].tobytes()], pa.binary()) for x in (total, counts)), pa.array([blocks], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["first", "sums", "counts", "blocks"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, counts, blocks = np.zeros((FEATURES, width), dtype=np.float32), np.zeros(FEATURES, dtype=np.int64), 0
        weighted = _drawn() if sent is None else sent
        for feature, start, follows in _read(batches):
            length = np.diff(np.r_[start, len(feature)])
            block = np.repeat(np.arange(len(start)), length)
            if weights is None:
                keys = _keys(feature, block, len(start))
                keys.sort()
                counts += np.bincount(_runs_of(keys)[0] % FEATURES, minlength=FEATURES)
                blocks += len(start)
                squared = (length + np.where(follows, np.r_[length[1:], 0], 0)).astype(np.float32)
            else:
                squared = _squared_norms(feature, block, follows, weights).astype(np.float32)
            y = project(weighted, feature, start)
            passage = _with_next(y, follows)
            passage /= np.maximum(1e-30, squared)[:, None]
            # A block's words are in its own passage and in that of the block before it.
            _add_rows(total, feature, block, _with_last(passage, follows, out=y))
        yield from rows(total, counts, blocks, range(0, FEATURES, ROWS))

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, counts, blocks = np.zeros(ROWS * width), np.zeros(ROWS, dtype=np.int64), 0
        for batch in batches:
            for sums, n, b in zip(batch.column("sums"), batch.column("counts"), batch.column("blocks").to_pylist(), strict=True):
                total += np.frombuffer(sums.as_buffer(), dtype=np.float32)
                counts += np.frombuffer(n.as_buffer(), dtype=np.int64)
                blocks += b
        yield from rows(total.astype(np.float32).reshape(ROWS, width), counts, blocks, [key[0].as_py()])

    spark = docs.sparkSession
    with batch_rows(spark, BATCH_ROWS):
        parts = docs.select("text").coalesce(spark.sparkContext.defaultParallelism).mapInArrow(tidy(multiply), schema)
        added = parts.groupBy("first").applyInArrow(add, schema).toArrow()
    out, counts, blocks = np.zeros((FEATURES, width), dtype=np.float32), np.zeros(FEATURES, dtype=np.int64), 0
    for batch in added.to_batches():
        for first, sums, n, blocks in zip(batch.column("first").to_pylist(), batch.column("sums"), batch.column("counts"), batch.column("blocks").to_pylist(), strict=True):
            out[first : first + ROWS] = np.frombuffer(sums.as_buffer(), dtype=np.float32).reshape(ROWS, width)
            counts[first : first + ROWS] = np.frombuffer(n.as_buffer(), dtype=np.int64)
    return out, counts, blocks


def times_passages(docs: DataFrame, weights: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """A.T @ A @ directions, where A's rows are the TF-IDF vectors of unit length of all passages."""
    return weights[:, None] * _passage_sums(docs, weights, directions)[0]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a.T @ b in double precision, some rows at a time."""
    return sum(a[lo : lo + ROWS].T.astype(np.float64) @ b[lo : lo + ROWS].astype(np.float64) for lo in range(0, len(a), ROWS))


def _roots(symmetric: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues over that part of the largest, largest first, and their vectors."""
    values, turned = np.linalg.eigh((symmetric + symmetric.T) / 2)
    keep = np.argsort(values)[::-1][: int((values > max(1e-30, least * values.max(initial=0.0))).sum())]
    return values[keep], turned[:, keep]


def leading_directions(docs: DataFrame, weights: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Randomised decomposition of all passages, from directions that a product with their counts has turned to their leading ones.

    The product with the weighted passages also says how directions are stretched (Nystroem's method), so no further reading is needed.
    """
    for _ in range(2):  # the second time for what single precision leaves
        values, turned = _roots(_products(directions, directions), 1e-10)
        directions = directions @ (turned / np.sqrt(values)).astype(np.float32)
    if not directions.shape[1]:
        return directions
    stretched = times_passages(docs, weights, directions)
    values, turned = _roots(_products(directions, stretched), 1e-5)
    return stretched @ (turned / np.sqrt(values)).astype(np.float32)


def build_space(spark: SparkSession, cut: list[tuple[int, np.ndarray]], corpus: Corpus, passages: int, rank: int = RANK) -> Space:
    """The space of some passages (numbers of their items, and features) and the corpus, of that many passages."""
    used = np.unique(np.concatenate([p for _, p in cut]))
    own = np.array([np.bincount(np.searchsorted(used, p), minlength=len(used)) for _, p in cut]) * corpus.weights[used]
    own *= max(1.0, float(np.sqrt(passages / len(cut)))) / np.linalg.norm(own, axis=1, keepdims=True)
    # The singular values and left vectors of both, one under the other, by the products of their rows.
    corner = corpus.leading[used].T.astype(np.float64) @ own.T
    values, turned = _roots(np.block([[_products(corpus.leading, corpus.leading), corner], [corner.T, own @ own.T]]), 1e-9)
    turned = turned[:, :rank] / np.sqrt(values[:rank])
    basis = corpus.leading @ turned[: corpus.leading.shape[1]].astype(np.float32)
    basis[used] += (own.T @ turned[corpus.leading.shape[1] :]).astype(np.float32)
    basis *= corpus.weights[:, None]
    latent = np.array([basis[p].sum(axis=0) for _, p in cut])
    return Space(basis, latent / np.maximum(1e-12, np.linalg.norm(latent, axis=1, keepdims=True)), np.array([k for k, _ in cut]))


def _runs(items: list[Item]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    runs = {}
    for size in {min(len(item.words), SHORTEST) for item in items}:
        own = [(item.runs, k) for k, item in enumerate(items) if min(len(item.words), SHORTEST) == size]
        keys, owner = np.concatenate([r for r, _ in own]), np.repeat([k for _, k in own], [len(r) for r, _ in own])
        order = np.argsort(keys, kind="stable")
        runs[size] = keys[order], owner[order]
    return runs


def _groups(spark: SparkSession, items: Iterator[Item], corpus: Corpus) -> Iterator[Group]:
    """Items in groups of at most ``SPACES`` spaces of ``SET`` passages; one of more is a group of its own."""
    def built(held: list[Item]) -> Group:
        cut = [(k, _features(p)) for k, item in enumerate(held) for p in _passages(item.words)]
        return Group(held, [build_space(spark, cut[lo : lo + SET], corpus, corpus.size) for lo in range(0, len(cut), SET)], _runs(held))

    held: list[Item] = []
    n = 0
    for item in items:
        own = len(_passages(item.words))
        if held and (n + own > SPACES * SET or len(held) >= ITEMS):
            yield built(held)
            held, n = [], 0
        held.append(item)
        n += own
    if held:
        yield built(held)


def places(a: np.ndarray) -> dict[int, int]:
    """Of each word, where it stands, a bit for each of a's words."""
    at: dict[int, int] = {}
    for k, x in enumerate(a.tolist()):
        at[x] = at.get(x, 0) | 1 << k
    return at


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    at = places(a)
    return _longest(len(a), [m for m in map(at.get, b.tolist()) if m])


def _longest(n: int, met: list[int]) -> int:
    """The same from the places, among n words, of the other text's words that have any."""
    row = full = (1 << n) - 1
    for m in met:
        u = row & m
        row = ((row + u) | (row - u)) & full
    return n - row.bit_count()


def project(basis: np.ndarray, feature: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of the words' rows of a basis over blocks."""
    out = np.empty((len(start), basis.shape[1]), dtype=np.float32)
    length = np.diff(np.r_[start, len(feature)])
    whole, short = np.flatnonzero(length == BLOCK), np.flatnonzero(length < BLOCK)
    spare = np.empty((CHUNK, basis.shape[1]), dtype=np.float32)
    for lo in range(0, len(whole), CHUNK):  # a word of each block at a time
        own = whole[lo : lo + CHUNK]
        total = basis[feature[start[own]]]
        for k in range(1, BLOCK):
            total += np.take(basis, feature[start[own] + k], axis=0, out=spare[: len(own)], mode="clip")
        out[own] = total
    for b in short.tolist():
        out[b] = basis[feature[start[b] : start[b] + length[b]]].sum(axis=0)
    return out


def _near(space: Space, feature: np.ndarray, start: np.ndarray, follows: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """(block, passage, cosine) of the passages that start at a block and are near one of the space."""
    latent = _with_next(project(space.basis, feature, start), follows)
    latent /= np.maximum(1e-12, np.linalg.norm(latent, axis=1, keepdims=True))
    for lo in range(0, len(latent), 4096):
        cosine = (latent[lo : lo + 4096] @ space.passages.T).ravel()
        at = np.flatnonzero(cosine >= COSINE)
        k, p = np.divmod(at, len(space.passages))
        yield from zip((lo + k).tolist(), p.tolist(), cosine[at].tolist(), strict=True)


def _shared_runs(group: Group, words: Words) -> Iterator[tuple[int, int, int]]:
    """(row, item number, word) of the runs that rows share with items."""
    for size, (keys, owner) in group.runs.items():
        windows = words.windows(size, _RUN)
        mask = np.uint64((1 << 20) - 1)
        some = np.zeros(1 << 20, dtype=bool)
        some[(keys & mask).astype(np.int64)] = True
        at = np.flatnonzero(some[(windows & mask).astype(np.int64)])
        row = np.searchsorted(words.first, at, "right") - 1
        inside = at + size <= words.first[row + 1]
        at, row = at[inside], row[inside]
        begin, end = np.searchsorted(keys, windows[at]), np.searchsorted(keys, windows[at], "right")
        hit = np.repeat(np.arange(len(at)), end - begin)
        number = owner[np.repeat(begin, end - begin) + ragged(end - begin)]
        # One run of each block of a row is enough, and of items that are looked up whole one of each row.
        part = at[hit] // BLOCK if size == SHORTEST else np.zeros(len(hit), dtype=np.int64)
        _, first = np.unique(np.column_stack([row[hit], number, part]), axis=0, return_index=True)
        for k in first.tolist():
            yield int(row[hit[k]]), int(number[k]), int(at[hit[k]])


def _words_of_items(group: Group, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Which of the words some item has, and their numbers among the items' words."""
    mask = np.uint64((1 << 20) - 1)
    some = np.zeros(1 << 20, dtype=bool)
    some[(group.known & mask).astype(np.int64)] = True
    at = np.flatnonzero(some[(words.hashes & mask).astype(np.int64)])
    number = np.minimum(np.searchsorted(group.known, words.hashes[at]), len(group.known) - 1)
    same = group.known[number] == words.hashes[at]
    return at[same], number[same]


def _around(group: Group, hits: tuple[np.ndarray, np.ndarray], words: Words, row: np.ndarray, number: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the words that some item has are around candidates: their first ones and ends."""
    size = group.sizes[number]
    return np.searchsorted(hits[0], np.maximum(words.first[row], at - size)), np.searchsorted(hits[0], np.minimum(words.first[row + 1], at + 2 * BLOCK + size))


def _able(group: Group, hits: tuple[np.ndarray, np.ndarray], number: np.ndarray, lo: np.ndarray, hi: np.ndarray, cosine: np.ndarray) -> np.ndarray:
    """Whether enough of the item's words, in any order, are around a candidate; always true of long items, whose candidates depend on earlier ones."""
    size = group.sizes[number]
    out = size > 3 * BLOCK
    least = np.where(cosine >= CLOSE, SOME, MOST) * size
    short = np.flatnonzero(~out)
    for k in range(0, len(short), 4 * CHUNK):
        own = short[k : k + 4 * CHUNK]
        n = hi[own] - lo[own]
        keys = np.repeat(np.arange(len(own)) * len(group.known), n) + hits[1][np.repeat(lo[own], n) + ragged(n)]
        keys.sort()
        keys = _runs_of(keys)[0]
        candidate, word = keys // len(group.known), keys % len(group.known)
        pair = number[own][candidate] * len(group.known) + word
        found = np.minimum(np.searchsorted(group.pairs, pair), len(group.pairs) - 1)
        times = np.where(group.pairs[found] == pair, group.times[found], 0)
        out[own] = np.bincount(candidate, times, minlength=len(own)) >= least[own]
    return out


def _run_cosine(group: Group, number: int, feature: np.ndarray) -> float | None:
    """The best latent cosine of a passage with an item's passages."""
    found = [float((space.passages[space.owner == number] @ (x := space.basis[feature].sum(axis=0)) / max(1e-12, np.linalg.norm(x))).max()) for space in group.spaces if (space.owner == number).any()]
    return max(found, default=None)


def _found_in(part: pa.RecordBatch, group: Group) -> list[tuple[int, int, float | None, float, float]]:
    """(row, key, cosine, part of the item and of its answer that is there) of what the rows hold."""
    words = _words(part.column("text"))
    start, first = _blocks(words)
    if not len(start):
        return []
    feature = _features(words.hashes)
    seen: dict[tuple[int, int], tuple[float, float, float]] = {}
    judged: dict[tuple[int, int], int] = {}

    def judge(row: int, number: int, at: int, cosine: float | None, lo: int, hi: int) -> None:
        item = group.items[number]
        # What was looked at for a passage of a long item close by holds this one too.
        if len(item.words) > 3 * BLOCK and at - judged.get((row, number), -len(item.words)) < len(item.words) // 4:
            return
        judged[row, number] = at
        # The words around it, without those that no item has: they add nothing to it, nor to its answer, whose words are its own.
        region = known[lo:hi].tolist()
        met = [m for m in map(item.at.get, region) if m]
        # No more of the item can be there in order than is there at all; without a near cosine that has to be most of it.
        least = (SOME if (cosine or 0.0) >= CLOSE else MOST) * len(item.words)
        if reduce(or_, met, 0).bit_count() < least:
            return
        held = _longest(len(item.words), met) / len(item.words)
        if held < SOME:
            return
        answered = _longest(len(item.answer), [m for m in map(item.answer_at.get, region) if m]) / len(item.answer) if len(item.answer) else 0.0
        if len(item.words) < SHORTEST:
            sure = held == 1.0
        elif len(item.words) - len(item.answer) < SHORTEST:
            sure = held >= MOST
        else:
            whole = answered >= WHOLE and len(item.answer) >= ANSWER_WORDS
            sure = held >= MOST or ((cosine or 0.0) >= CLOSE and (whole or (held >= MUCH and answered >= ANSWER)))
        if sure and held > seen.get((row, number), (0.0,))[0]:
            seen[row, number] = (held, cosine, answered)

    follows = _follows(first, len(start))
    hits = _words_of_items(group, words)
    known = words.hashes[hits[0]]
    for space in group.spaces:
        if not (near := list(_near(space, feature, start, follows))):
            continue
        block, p, cosine = (np.array(x) for x in zip(*near, strict=True))
        row, number = np.searchsorted(first, block, "right") - 1, space.owner[p]
        lo, hi = _around(group, hits, words, row, number, start[block])
        able = _able(group, hits, number, lo, hi, cosine)
        for candidate in zip(*(x[able].tolist() for x in (row, number, start[block], cosine, lo, hi)), strict=True):
            judge(*candidate)
    judged.clear()
    for row, number, at in _shared_runs(group, words):
        if seen.get((row, number), (0.0,))[0] < 1.0:
            end = min(at + 2 * BLOCK, int(words.first[row + 1]))
            judge(row, number, at, _run_cosine(group, number, feature[at:end]), *_around(group, hits, words, row, number, at))
    return [(row, group.items[number].key, cosine, held, answered) for (row, number), (held, cosine, answered) in seen.items()]


def find_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine (latent), held (part of the item's words), answered: every item that a document holds."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    kinds = [t.schema[c].dataType.simpleString() for t, c in ((docs, "doc_id"), (benchmark, "item_id"))]
    key = F.xxhash64("text")
    named = benchmark.where("text is not null").select("item_id", key.alias("key"), "text")
    texts = scratch.write(named.groupBy("key").agg(F.min("text").alias("text")), "items")
    n, bytes_ = texts.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    if not n:
        return spark.createDataFrame([], f"doc_id {kinds[0]}, item_id {kinds[1]}, cosine double, held double, answered double")
    corpus = read_corpus(docs, scratch)
    parts = max(-(-n // ITEMS), -(-bytes_ // ITEM_BYTES))

    def items() -> Iterator[Item]:
        for k in range(parts):
            for row in texts.where(F.pmod(F.hash("key"), F.lit(parts)) == k).orderBy("key").collect():
                if (item := _item(row["key"], row["text"])) is not None:
                    yield item

    found = None
    for group in _groups(spark, items(), corpus):

        def search(batches: Iterator[pa.RecordBatch], group: Group = group) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    if own := _found_in(part, group):
                        row, *rest = zip(*own, strict=True)
                        columns = [pa.array(c, t) for c, t in zip(rest, (pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)]
                        yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(row)), *columns], ["doc_id", "key", "cosine", "held", "answered"])

        part = docs.select("doc_id", "text").mapInArrow(tidy(search), f"doc_id {kinds[0]}, key long, cosine double, held double, answered double")
        found = part if found is None else found.unionByName(part)
        release()  # of the decomposition only the space is left
    if found is None:
        return spark.createDataFrame([], f"doc_id {kinds[0]}, item_id {kinds[1]}, cosine double, held double, answered double")
    return found.join(small(scratch.write(named.select("item_id", "key"), "names")), "key").select("doc_id", "item_id", "cosine", "held", "answered")


def without_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item of the benchmark, with their columns."""
    held = Scratch(docs.sparkSession, "items").write(find_items(docs, benchmark).select("doc_id").where("doc_id is not null").distinct(), "held")
    return docs.join(small(held), "doc_id", "left_anti").select(*docs.columns)
