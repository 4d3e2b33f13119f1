"""As-of joins in two levels, loops, outcomes, images and paging on small tables worked out by hand."""

import hashlib
import hmac
import random

from pyspark.sql import functions as F

from emberline.functions import text
from emberline.operators import compare, epochs, reports, templates
from emberline.operators.asof import as_of


def test_as_of_against_brute_force(spark):
    rng = random.Random(3)
    marks = [(rng.choice("ab"), rng.randrange(-50, 200), k, f"m{k}" if k % 5 else None) for k in range(60)]
    points = [(rng.choice("abc"), rng.randrange(-60, 260), k) for k in range(200)] + [(None, 5, 200)]
    found = as_of(spark.createDataFrame(marks, "k string, p long, tie int, value string"), spark.createDataFrame(points, "k string, p long, id int"), ["k"], "p", 16, "got")
    want = {}
    for k, p, own in points:
        before = [m for m in marks if m[0] == k and k is not None and m[1] <= p and m[3] is not None]
        want[own] = max(before, key=lambda m: m[1:3])[3] if before else None
    assert {r["id"]: r["got"] for r in found.collect()} == want


def test_as_of_without_marks(spark):
    marks, points = spark.createDataFrame([], "k string, p long, tie int, value string"), spark.createDataFrame([("a", 1)], "k string, p long")
    assert [tuple(r) for r in as_of(marks, points, ["k"], "p", 10, "got").collect()] == [("a", 1, None)]
    assert as_of(marks, points.limit(0), ["k"], "p", 10, "got").count() == 0


def _epochs(spark, prints, errors=()):
    rows = [("d", k, k * 100, k * 100 + 50, (k + 1) * 100 if k + 1 < len(prints) else None, 2, int(k in errors), 9, p) for k, p in enumerate(prints)]
    return spark.createDataFrame(rows, "device string, seq int, opened_at long, last_at long, closed_at long, records int, errors int, bytes int, fingerprint string")


def test_loop_kinds(spark):
    def kind(prints, errors=(), watchdog=(), userspace=()):
        marks = spark.createDataFrame([("d", k, k in watchdog, k in userspace) for k in range(len(prints))], "device string, seq int, watchdog boolean, userspace boolean")
        return epochs.loop_class(_epochs(spark, prints, errors), marks=marks).first()["kind"]

    assert kind("ab") == "none" and kind("aabb") == "none" and kind("abcd") == "unstable"
    assert kind("aaaa", errors={1, 2}, watchdog={1, 2}) == "watchdog"
    assert kind("aaaa", errors={1, 2}) == "crash"
    assert kind("bcaaa") == "flapping"
    assert kind("aaaa") == "stage_capped" and kind("aaaa", userspace={2}) == "stable"


def test_runs(spark):
    found = epochs.with_runs(_epochs(spark, "aabba")).orderBy("seq").collect()
    assert [(r["run"], r["stable_since"]) for r in found] == [(2, 0), (2, 0), (2, 2), (2, 2), (1, 4)]


def test_default_start(spark):
    log = spark.createDataFrame([("a", 999), ("b", 999), ("c", 999)], "device string, event_id long")
    opened = spark.createDataFrame([("a", 0, 5), ("a", 1, 950), ("b", 0, 3)], "device string, seq int, opened_offset long")
    found = {r["device"]: (r["start"], r["why"]) for r in epochs.default_start(log, opened, 10, 100).collect()}
    assert found == {"a": (940, "epoch"), "b": (900, "tail"), "c": (1000, "head")}


def test_epochs_of_image(spark):
    images = spark.createDataFrame([(1, "one", "ABCdef", "h1"), (2, "abc", None, "h2"), (3, "three", "0abc", "h3")], "image_id int, name string, git_sha string, image_hash string")
    ran = spark.createDataFrame([("d", k, k) for k in range(5)], "device string, seq int, image_id int")
    of = lambda ref: sorted(r["seq"] for r in compare.epochs_of_image(ran, images, ref).collect())
    assert of("abc") == [1, 2] and of("h3") == [3] and of("zz") == []


def test_pages(spark):
    rows = spark.range(5).withColumnRenamed("id", "n")
    of = lambda limit, offset: [tuple(r) for r in templates.page(rows, ["n"], limit, offset).collect()]
    assert of(2, 2) == [(2, True, 4), (3, True, 4)]
    assert of(2, 3) == [(3, False, None), (4, False, None)] and of(2, 5) == []


def test_bisection_by_tables_and_by_hand(spark):
    rng = random.Random(5)
    cases = {k: {i: rng.choice(["good", "bad", "skip"]) for i in range(8) if rng.random() < 0.7} for k in range(60)}
    rows = [(k, i, v) for k, case in cases.items() for i, v in case.items()]
    asked = spark.createDataFrame([(k, 8) for k in cases], "case_id int, n int")
    found = reports.bisect_steps(asked, spark.createDataFrame(rows, "case_id int, index int, verdict string")).collect()
    assert {r["case_id"]: (r["step"], r["candidate"]) for r in found} == {k: reports.bisect_next(list(case.items()), 8) for k, case in cases.items()}


def test_same_reports(spark):
    rows = [("a", "Board HANGS 12!"), ("b", "board hangs"), ("c", ""), ("d", None), ("e", "other")]
    found = {r["id"]: (r["first_id"], r["copies"]) for r in reports.same_reports(spark.createDataFrame(rows, "id string, text string")).collect()}
    assert found == {"a": ("a", 2), "b": ("a", 2), "c": ("c", 1), "d": ("d", 1), "e": ("e", 1)}


def test_signatures(spark):
    bodies = ["", "x" * 200, '{"watch":"errors"}', "é"]
    found = spark.createDataFrame([(b,) for b in bodies], "body string").select("body", text.hmac_sha256(F.col("body"), b"secret").alias("s")).collect()
    for row in found:
        assert row["s"] == hmac.new(b"secret", row["body"].encode(), hashlib.sha256).hexdigest()
