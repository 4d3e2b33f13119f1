"""What op8's readings do with the rows of words, by hand and in bounded memory."""

import tracemalloc

import numpy as np
import pytest

from emberline.llm import decontaminate


def _words(n: int, blocks: int, features: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return (features * rng.random(n) ** 3).astype(np.int32), np.sort(rng.integers(0, blocks, n))


@pytest.mark.parametrize(("n", "features"), [(1, 1), (50_000, 9), (50_000, decontaminate.FEATURES)])
def test_rows_are_added_as_by_hand(n, features):
    feature, block = _words(n, 2_000, features)
    rows = np.random.default_rng(6).integers(-50, 50, (2_000, 5)).astype(np.float32)  # sums of these are exact
    wanted = np.zeros((decontaminate.FEATURES, 5), dtype=np.float32)
    np.add.at(wanted, feature, rows[block])
    found = np.zeros_like(wanted)
    decontaminate._add_rows(found, feature, block, rows)
    assert (found == wanted).all()


def test_the_rows_of_a_common_word_are_not_taken_all_at_once():
    feature, block = _words(100_000, 5_000, 3)
    rows = np.ones((5_000, decontaminate.RANK), dtype=np.float32)
    total = np.zeros((decontaminate.FEATURES, decontaminate.RANK), dtype=np.float32)
    tracemalloc.start()
    decontaminate._add_rows(total, feature, block, rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 << 20 < rows[0].nbytes * np.bincount(feature).max()


@pytest.mark.parametrize("before", [0, 1 << 17])
def test_norms_of_few_and_of_many_blocks(before):
    """With that many blocks before them, of a word each, numbers of blocks and features need more than 32 bits."""
    feature, block = _words(600, 30, 40)
    feature, block = np.r_[np.zeros(before, dtype=np.int32), feature], np.r_[np.arange(before), block + before]
    weights = np.random.default_rng(7).uniform(0.7, 9, decontaminate.FEATURES).astype(np.float32)
    follows = np.r_[np.zeros(before, dtype=bool), np.arange(30) % 4 != 3]
    follows[-1] = False
    found = decontaminate._squared_norms(feature, block, follows, weights)
    assert np.allclose(found[:before], float(weights[0]) ** 2)
    for k in range(before, before + 30):
        own = feature[(block == k) | ((block == k + 1) & follows[k])]
        at, times = np.unique(own, return_counts=True)
        assert np.isclose(found[k], ((times * weights[at].astype(np.float64)) ** 2).sum())


def test_neighbours_of_one_document_are_joined():
    rows = np.arange(12, dtype=np.float32).reshape(6, 2)
    follows = np.array([True, True, False, False, True, False])
    joined = decontaminate._with_next(rows, follows)
    assert joined[:, 0].tolist() == [2, 6, 4, 6, 18, 10]
    assert decontaminate._with_last(joined, follows, out=np.empty_like(rows))[:, 0].tolist() == [2, 8, 10, 6, 18, 28]


def test_only_words_of_items_are_looked_up_around_a_candidate():
    class Asked(dict):
        n = 0

        def get(self, *a):
            self.n += 1
            return super().get(*a)

    import pyarrow as pa

    text = " ".join(f"item{k}" for k in range(20))
    item = decontaminate._item(7, text)
    item.at = Asked(item.at)
    group = decontaminate.Group([item], [], decontaminate._runs([item]))
    space = np.ones((decontaminate.FEATURES, 1), dtype=np.float32)
    group.spaces.append(decontaminate.Space(space, np.ones((1, 1), dtype=np.float32), np.array([0])))
    around = " ".join(f"other{k}" for k in range(30))
    batch = pa.RecordBatch.from_arrays([pa.array([f"{around} {text} {around}"])], ["text"])
    (row, key, _, held, _), = decontaminate._found_in(batch, group)
    assert (row, key, held) == (0, 7, 1.0)
    known = 20
    assert item.at.n % known == 0 and 0 < item.at.n <= 4 * known
