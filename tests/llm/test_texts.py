"""Operators on texts against brute force: op3, op6, op8, and the pipeline's stages on them."""

import hashlib
import random
import re
from collections import Counter

import pytest

from emberline.llm import decontaminate, ngram_join, substring_dedup

SCHEMA = "doc_id long, text string, lang string, row string, kept int"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{k}é" if k % 7 == 0 else f"w{k}" for k in range(400)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared = make(60)
    base = make(120)
    texts = [make(rng.randint(1, 150)) for _ in range(40)]
    texts += [make(20) + shared[k : k + 35 + k] + make(15) for k in range(6)]  # matches of 35 and more words at other offsets
    texts += [make(30) + shared[:34] + make(30) for _ in range(2)]  # one word short
    for k in range(8):  # near copies
        copy = list(base)
        for _ in range(k):
            copy[rng.randrange(len(copy))] = "edit"
        texts.append(copy)
    texts += [texts[0], texts[0], base, make(36) * 2, ["x"], ["X"], ["x", "y"], ["x", "y"]]
    out = [(k, " ".join(t).replace("w1 ", "w1\n\t").replace("w2 ", "w2  "), "en", "r", k) for k, t in enumerate(texts)]
    n = len(out)
    return [*out, (n, None, None, None, None), (n + 1, "", "en", None, 1), (n + 2, " \n ", "en", None, 1), (n + 3, "W5 w6 W7 w8 w9 w10", "en", "", 2), (n + 4, "w5 w6 w7 w8 w9 w10", "en", "", 2)]


def removed_by_hand(rows):
    words = {d: SPLIT.findall(t or "") for d, t, *_ in rows}
    n = Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    out = {}
    for d, w in words.items():
        gone = set()
        for k in range(len(w) - 34):
            if n[tuple(w[k : k + 35])] > 1:
                gone.update(range(k, k + 35))
        out[d] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def components_by_hand(rows):
    sets = {}
    for d, t, *_ in rows:
        w = SPLIT.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_cover_meets_every_difference():
    period, cover = substring_dedup.PERIOD, substring_dedup.COVER
    assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize("parts", [1, 5])
def test_substring_dedup(spark, parts):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.judge(docs).select("row.doc_id", "n_words", "n_removed", "kept").collect()}
    assert got == removed_by_hand(rows)


def test_substring_dedup_keeps_columns_and_untouched_texts(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    out = substring_dedup.remove_repeats(docs)
    assert out.columns == docs.columns
    by_hand, before = removed_by_hand(rows), {r[0]: r for r in rows}
    for r in out.collect():
        n = by_hand[r["doc_id"]]
        assert r["text"] == (n[2] if n[1] else before[r["doc_id"]][1])
        assert (r["lang"], r["row"], r["kept"]) == before[r["doc_id"]][2:]


def test_substring_dedup_of_repeated_rows_null_ids_and_nothing(spark):
    text = " ".join(f"a{k}" for k in range(40))
    docs = spark.createDataFrame([(1, text), (1, text), (None, text + " z"), (2, "short"), (2, "short")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in substring_dedup.judge(docs).select("row.doc_id", "n_words", "n_removed").collect())
    assert got == [("1", 40, 40), ("1", 40, 40), ("2", 1, 0), ("2", 1, 0), ("None", 41, 40)]
    assert substring_dedup.judge(docs.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 4])
def test_ngram_join(spark, parts):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.shingle_components(docs).collect()}
    assert got == components_by_hand(rows)


def test_ngram_join_of_many_near_copies_and_chains(spark):
    rng = random.Random(5)
    base = [f"b{k}" for k in range(100)]
    rows = []
    for k in range(120):  # a chain: each differs from the last by a word, far ones aren't similar
        base = list(base)
        base[rng.randrange(100)] = f"n{k}"
        rows.append((1000 - k, " ".join(base), "en", "", 0))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.shingle_components(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == components_by_hand(rows)


def test_ngram_join_of_repeated_rows_null_ids_and_nothing(spark):
    docs = spark.createDataFrame([(3, "a b c"), (3, "a b c"), (None, "a b c"), (5, "A B C"), (6, None)], "doc_id long, text string")
    got = sorted(map(str, map(tuple, ngram_join.shingle_components(docs).collect())))
    assert got == sorted(map(str, [(3, 1, 3), (3, 1, 3), (None, 1, None), (5, 1, 3), (6, 0, 6)]))
    assert ngram_join.shingle_components(docs.limit(0)).count() == 0
    kept = sorted(str(r["doc_id"]) for r in ngram_join.one_of_each(docs).collect())
    assert kept == ["3", "6", "None"]


def test_ngram_join_of_equal_texts_without_words(spark):
    docs = spark.createDataFrame([(1, ""), (2, ""), (3, " \n\x0b"), (4, " \n\x0b"), (5, "a"), (6, "a"), (7, "\xa0"), (8, "\xa0")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.shingle_components(docs).collect()}
    assert got == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (0, 4), 5: (1, 5), 6: (1, 5), 7: (1, 7), 8: (1, 7)}
    assert {r["doc_id"] for r in ngram_join.one_of_each(docs).collect()} == {1, 2, 3, 4, 5, 7}


def test_decontamination(spark):
    rng = random.Random(9)
    vocabulary = [f"word{k}" for k in range(3000)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, " ".join(make(12)) + ". " + " ".join(make(8)).capitalize() + ".") for k in range(12)] + [(50, None), (51, ""), (52, "Tiny one."), (53, " ".join(make(150)))]
    docs, planted = [], set()
    for k in range(80):
        words = make(rng.randint(5, 300))
        if k % 4 == 0:
            item = k // 4 % 12
            own = items[item][1].split()
            for _ in range(k % 3 * 2):
                own[rng.randrange(len(own))] = "else"
            at = rng.randrange(len(words))
            words[at:at] = own
            planted.add((k, item))
        docs.append((k, " ".join(words)))
    docs += [(90, None), (91, ""), (92, "x " * 20000 + items[3][1].upper() + " y" * 100), (93, "pre " + items[15][1] + " post"), (93, "pre " + items[15][1] + " post")]
    planted |= {(92, 3), (93, 53)}
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = [(r["doc_id"], r["item_id"]) for r in decontaminate.find_items(frame, benchmark).collect()]
    assert set(found) == planted and found.count((93, 53)) == 2
    kept = {r["doc_id"] for r in decontaminate.without_items(frame, benchmark).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in planted}
    assert decontaminate.find_items(frame, benchmark.limit(0)).count() == 0
    assert decontaminate.find_items(frame.limit(0), benchmark).count() == 0


def test_decontamination_of_small_tables_and_items_in_many_copies(spark):
    rng = random.Random(4)
    make = lambda n: [f"word{rng.randrange(3000)}" for _ in range(n)]
    items = [(k, " ".join(make(20))) for k in range(3)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = lambda docs: {(r["doc_id"], r["item_id"]) for r in decontaminate.find_items(spark.createDataFrame(docs, "doc_id long, text string"), benchmark).collect()}
    around = lambda item: " ".join([*make(10), item, *make(10)])
    assert found([(1, around(items[0][1])), (2, items[1][1]), (3, " ".join(make(30)))]) == {(1, 0), (2, 1)}
    copy = around(items[2][1])
    docs = [(k, copy if k % 3 == 0 else " ".join(make(100))) for k in range(300)] + [(1000, around(items[2][1]))]
    assert found(docs) == {(k, 2) for k in range(0, 300, 3)} | {(1000, 2)}


def test_decontamination_of_long_and_short_items(spark):
    rng = random.Random(6)
    make = lambda n: [f"word{rng.randrange(3000)}" for _ in range(n)]
    items = [(k, " ".join(make(300))) for k in range(60)] + [(100 + n, " ".join(f"short{n}x{k}" for k in range(n))) for n in range(1, 8)]
    docs = [(k, " ".join([*make(100), *t.split(), *make(100)])) for k, t in items] + [(-1, "short2x0 between short2x1"), (-2, " ".join(make(500)))]
    found = decontaminate.find_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"]) for r in found.collect()) == [(k, k) for k, _ in items]


def test_common_subsequence():
    import numpy as np

    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.common_subsequence(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)) == table[-1][-1]


def test_hashes_of_kept_words(spark):
    """The query's digest is that of the kept words."""
    rows = corpus()
    from pyspark.sql import functions as F

    got = substring_dedup.judge(spark.createDataFrame(rows, SCHEMA)).select("row.doc_id", F.sha2("kept", 256).alias("h")).collect()
    by_hand = removed_by_hand(rows)
    assert all(r["h"] == hashlib.sha256(by_hand[r["doc_id"]][2].encode()).hexdigest() for r in got)
