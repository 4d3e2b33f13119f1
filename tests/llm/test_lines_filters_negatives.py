"""op11, op12 and op13 against plain versions of themselves, and their edge cases."""

import math
import random
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.llm import filter_audit, hard_negatives, line_dedup

SPACE = " \t\n\x0b\x0c\r"
UPPER = {chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)}

# op11


def plain_lines(rows, least=20, documents=3):
    key = lambda line: "".join(UPPER.get(c, c) for c in line.strip(SPACE))
    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if doc_id is not None:
                holders[key(line)].add(doc_id)
    common = {k: max(ids) for k, ids in holders.items() if len(k) >= least and len(ids) >= documents}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if key(x) not in common or common[key(x)] == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(left), "\n".join(left)))
    return sorted(out, key=str)


def lines_of(spark, rows, **more):
    docs = spark.createDataFrame([(t, i, "x", 1) for i, t in rows], "text string, doc_id long, lines string, rid int")
    out = line_dedup.dedup_lines(docs, **more).select("row.doc_id", "n_lines", "n_dropped", "kept", "row.lines").collect()
    assert all(r["lines"] == "x" for r in out)
    return sorted((tuple(r)[:4] for r in out), key=str)


HOT = "A line that very many documents hold."


@pytest.mark.parametrize("broadcast", [True, False])
def test_lines_against_plain_version(spark, monkeypatch, broadcast):
    if not broadcast:  # as when the tables are large
        monkeypatch.setattr(line_dedup, "small", lambda df, limit=0: df)
    rng = random.Random(4)
    pool = [HOT, "\t" + HOT.upper() + " \r", "Žluťoučký kůň úpěl ďábelské ódy", "ŽLUŤOUČKÝ kůň úpěl ďábelské ódy", "short", "", "x" * 19, "y" * 20, "Y" * 20, "é" * 20, "\x0b" + "z" * 25, "z" * 25 + "\x0c", " " + "z" * 25, "once only, in one document {}"]
    rows = [(k % 50 if k % 9 else None, "\n".join(rng.choice(pool).replace("{}", str(k)) for _ in range(rng.randrange(0, 12)))) for k in range(120)]
    rows += [(1000 + k, HOT if k % 3 else "own " + HOT) for k in range(300)] + [(7, None), (8, ""), (8, ""), (9, "\n\n"), (-5, HOT + "\n" + HOT), (2000, "w\n" * 30_000 + HOT)]
    assert lines_of(spark, rows) == plain_lines(rows)


def test_the_largest_id_keeps_all_its_lines_and_two_documents_keep_theirs(spark):
    rows = [(1, HOT), (2, HOT + "\n" + HOT), (2, HOT + "\n" + HOT)]
    assert all(d == 0 for _, _, d, _ in lines_of(spark, rows))
    rows.append((0, " " + HOT.lower()))
    assert lines_of(spark, rows) == plain_lines(rows) == [(0, 1, 1, ""), (1, 1, 1, ""), (2, 2, 0, HOT + "\n" + HOT), (2, 2, 0, HOT + "\n" + HOT)]


def test_lines_of_no_documents(spark):
    assert lines_of(spark, []) == []


# op12

ORDERS = ["".join(p) for p in permutations("ABCDE")]


def fails(rows, k):
    doc_id, text, _ = rows[k]
    text = text or ""
    words = [w for w in "".join(" " if c in SPACE else c for c in text).split(" ") if w]
    return {
        "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text), "D": any(c in "#$%&*|" for c in text),
        "E": doc_id is not None and any(i is not None and i < doc_id and (t or "") == text for i, t, _ in rows),
    }


def plain_audit(rows, labels):
    good, toxic = ({i for i, *marks in labels if marks[k] == 1} for k in (0, 1))
    out = {}
    failing = [fails(rows, k) for k in range(len(rows))]
    for part in {lang or "" for *_, lang in rows}:
        own = [k for k, (*_, lang) in enumerate(rows) if (lang or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in ORDERS:
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [k for k in left if failing[k][f]]
                left = [k for k in left if not failing[k][f]]
                shapley[f] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), sum(failing[k][f] for k in own) - len(gone), sum(failing[k][f] and sum(failing[k].values()) == 1 for k in own),
                    sum(rows[k][0] in good for k in gone if rows[k][0] is not None), sum(rows[k][0] in toxic for k in gone if rows[k][0] is not None),
                ]
        for order in ORDERS:
            for step, f in enumerate(order, 1):
                out[part, order, step].append(shapley[f])
    return out


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, "part") for r in rows], "doc_id long, text string, lang string, A int, part string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = filter_audit.audit_documents(docs, marks).collect()
    assert len({tuple(r)[:3] for r in out}) == len(out)
    return {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in out}


@pytest.mark.parametrize("broadcast", [True, False])
def test_audit_against_every_order_applied(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(filter_audit, "small", lambda df, limit=0: df)
    rng = random.Random(6)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(90):
        n, pool = rng.choice([3, 199, 200, 260]), words[: rng.choice([20, 400])]
        text = rng.choice([" ", "\n", "\t \x0b"]).join(rng.choice(pool) for _ in range(n)) + rng.choice(["", "#", "| &", "É" * 9])
        rows.append((k, text.upper() if k % 5 == 0 else text, rng.choice(["en", None, "", "de"])))
    rows += [(100 + k, rows[k % 4][1], rng.choice(["en", "fr"])) for k in range(60)]  # copies across parts
    rows += [(200, None, "en"), (201, "", "en"), (201, "", "en"), (None, None, "de"), (None, rows[0][1], "en"), (202, "ABC " * 40_000, "it")]
    labels = [(k, k % 3 == 0 and 1 or 0, 1 if k % 7 == 0 else None) for k in range(0, 160, 2)] + [(0, 0, 0), (4, None, 1), (None, 1, 1), (9999, 1, 1)]
    wanted = plain_audit(rows, labels)
    assert audited(spark, rows, labels) == wanted
    assert any(v[-1] for v in wanted.values())


def test_audit_of_nothing_and_without_labels(spark):
    assert audited(spark, [], []) == {}
    rows = [(1, "few words", "en")]
    assert audited(spark, rows, []) == plain_audit(rows, [])


def test_shapley_values_share_out_what_all_filters_remove(spark):
    flags = spark.createDataFrame([(k >> 1 & 1 > 0, k >> 2 & 1 > 0, k % 5 == 0, "p") for k in range(97)], "X boolean, Y boolean, Z boolean, part string")
    counts = filter_audit.joint_failures(flags, "XYZ", {"every": F.lit(1)})
    rows = filter_audit.audit(counts, "XYZ", {}).collect()
    whole = {r["filter_order"][r["step"] - 1]: r["shapley"] for r in rows}
    last = {r["filter_order"]: r["kept"] for r in rows if r["step"] == 3}
    assert len(rows) == 18 and set(last.values()) == {97 - sum(whole.values()) // math.factorial(3)}


# op13


def plain_negatives(rows, positives=5, negatives=3):
    usable = sorted({(i, lab, tuple(math.floor(256 * x) for x in v)) for i, lab, v in rows if i is not None and lab is not None and v and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v)})
    usable = [r for r in usable if sum(x * x for x in r[2]) < 2**124]
    out = []
    for i, lab, v in usable:
        if i % 50:
            continue
        score = lambda w, v=v: sum(a * b for a, b in zip(v, w, strict=True))
        pos = sorted({(-score(w), j) for j, other, w in usable if other == lab and j != i})[:positives]
        for minus, j in pos:
            neg = sorted({(-score(w), n) for n, other, w in usable if other != lab and n != i and -50 * minus <= 100 * score(w) <= -95 * minus})[:negatives]
            clip = lambda s: max(-(2**63), min(2**63 - 1, s))
            out += [(i, j, rank, n, clip(-minus), clip(-s)) for rank, (s, n) in enumerate(neg, 1)]
    return sorted(out)


def mined(spark, rows, **more):
    frame = spark.createDataFrame([(i, lab, v, 1.0) for i, lab, v in rows], "vec_id long, label int, embedding array<double>, score double").repartition(5)
    usable = hard_negatives.quantised(frame, "vec_id", "embedding", "label")
    return sorted(tuple(r) for r in hard_negatives.mine(usable.where("id % 50 = 0"), usable, **more).collect())


def some_vectors(n=700, copies=200):
    rng = np.random.default_rng(8)
    rows = [(k, int(rng.integers(0, 3)), rng.normal(size=4).round(2).tolist()) for k in range(n)]
    rows += [(2000 + k, k % 3, [0.5, 0.5, 0.5, 0.5]) for k in range(copies)] + [(3000, 1, [0.6, 0.5, 0.5, 0.4])]  # one vector, very often
    rows += [(100, 1, [0.4, 0.1, 0.3, 0.2]), rows[50], rows[50], rows[7]] + [rows[51]] * 300  # ids and rows that repeat
    rows += [(150, None, [1.0] * 4), (None, 1, [1.0] * 4), (200, 1, None), (250, 1, [None, 1.0, 1.0, 1.0]), (300, 2, [float("nan")] * 4), (350, 2, [float("inf"), 0.0, 0.0, 0.0]), (400, 0, [1.0]), (450, 0, []), (550, 1, [0.0] * 4)]
    return rows


@pytest.mark.parametrize("block", [8192, 4])
def test_negatives_against_plain_version(spark, block):
    rows = some_vectors()
    wanted = plain_negatives(rows)
    assert len(wanted) > 100 and mined(spark, rows, block=block) == wanted


def test_scores_beyond_what_float64_holds(spark):
    rng = np.random.default_rng(9)
    rows = [(k, k % 2, (rng.normal(size=4) * 10.0 ** rng.integers(0, 10)).tolist()) for k in range(160)]
    rows += [(500, 0, [3.1e14, 1.0, 0.0, 0.0]), (501, 0, [3.1e14, 2.0, 0.0, 0.0]), (502, 1, [1.9e14, 3.0, 0.0, 0.0]), (503, 1, [1.9e14, 3.0000001e3, 0.0, 0.0]), (504, 1, [1e17, 0.0, 0.0, 0.0])]
    wanted = plain_negatives(rows)
    assert any(abs(r[4]) > 2**53 for r in wanted) and mined(spark, rows) == wanted


def test_negatives_of_few_and_none(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(50, 1, [1.0] * 4)]) == []
    assert mined(spark, [(50, 1, [1.0] * 4), (1, 1, [1.0] * 4)]) == []
    rows = [(50, 1, [1.0] * 4), (1, 1, [1.0] * 4), (2, 0, [0.9] * 4), (3, 0, [0.4] * 4)]
    assert mined(spark, rows) == plain_negatives(rows) == [(50, 1, 1, 2, 262144, 235520)]


def test_leading_with_repeated_pairs():
    ids = np.array([4] * 3000 + [3, 9, 1, 7], dtype=np.int64)
    score = np.array([10.0] * 3000 + [10.0, 9.0, 9.0, 8.0])
    wanted = [(-10, 3), (-10, 4), (-9, 1)]
    assert hard_negatives.leading(score, ids, 3) == wanted == hard_negatives.leading(score.astype(int).astype(object), ids, 3)
