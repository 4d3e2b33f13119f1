"""How many rounds op10 takes when ranges are small."""

import random

from emberline.llm import packing
from tests.llm.test_tokens import assert_valid


def test_small_ranges_take_few_rounds(spark, monkeypatch):
    sizes = [1 + (k * 37) % 60 for k in range(120)]
    rounds, own = [], packing._across
    monkeypatch.setattr(packing, "_across", lambda *a, **b: (rounds.append(len(a[0])), own(*a, **b))[1])
    out = packing.best_fit(spark.createDataFrame(list(enumerate(sizes)), "id long, size long"), 400, 1).collect()
    assert sorted(r["id"] for r in out) == list(range(len(sizes)))
    assert assert_valid([(r["sequence"], r["offset"], sizes[r["id"]]) for r in out], 400) == -(-sum(sizes) // 400)
    assert len(rounds) <= 7


def test_pieces_of_further_ranges_fit_for_sure():
    rng = random.Random(1)
    more = 0
    for _ in range(300):
        size, left = 1000, []
        for k in range(rng.randint(1, 40)):
            largest = max(1, size - rng.randint(0, 60))
            size = max(1, largest - rng.randint(0, 60))
            left.append((k, rng.randint(0, 6), largest, rng.randint(0, 3), size))
        matched = {}
        for again in (False, True):
            used, seen = {}, set()
            for k, lo, hi, each, gap_range, gap_rank in packing._across(left, again):
                assert gap_range < k and hi < left[k][1]
                for rank in range(lo, hi + 1):
                    gap = gap_range, gap_rank - (rank - lo) // each
                    assert (k, rank) not in seen and 0 <= gap[1] < left[gap_range][3]
                    seen.add((k, rank))
                    used[gap] = used.get(gap, 0) + left[k][2]
            assert all(n <= left[k][4] for (k, _), n in used.items())
            matched[again] = len(seen)
        more += matched[True] - matched[False]
    assert more > 0
