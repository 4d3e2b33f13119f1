"""The stored index: what patterns require, the same lines as a scan, also after an append, and how much is read."""

import random
import re

import pytest
from pyspark.sql import functions as F

from emberline.operators.index import BUCKETS, Index, Piece, bucket, required

PATTERNS = [
    r"error: device [0-9]+", r"err(or)? on", r"(usb|pci) .* (reset|timeout)", r"fail(ed|ure)", r"^panic", r"x+y", r"[a-z]+", r"(?i)Kernel PANIC", r"dev[0-9]: link (up|down)", r"a.c", r"over-?current", r"é?clair",
    r"caf.?é bar", r"(reset)+ done", r"(?:no|such) device$", r"timeout(?= after)", r"0x[0-9a-f]{4}", r"\berror\b", r"link up|link down|panic", r"(a|)b", r"\Qerror: device\E",
]


def texts():
    rng = random.Random(2)
    words = "error errors terror device devices usb pci reset resets timeout timeouts after fail failed failure panic kernel Kernel PANIC link up down dev0: dev1: error: xxy xy abc a-c over-current overcurrent éclair eclair café bar no such done 0x12ab 0xzz b".split()
    return [rng.choice([" ", " ", ", "]).join(rng.choice(words) for _ in range(rng.randint(0, 7))) for _ in range(900)]


def frame(spark, found, session=0):
    return spark.createDataFrame([(f"d{k % 3}", session + k // 40, k, t) for k, t in enumerate(found)], "device string, session_id long, line_no long, text string")


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    made = Index(spark, str(tmp_path_factory.mktemp("index")))
    found = texts()
    made.append(frame(spark, found[:500]), "0")
    made.append(frame(spark, found[500:], 1000), "1")
    made.append(frame(spark, found[500:], 1000), "1")  # a batch that comes again
    return made


def test_what_is_required():
    assert required("error: device [0-9]+") == [[[Piece("error", True, False), Piece("device", False, False)]]]
    assert required("(usb|pci) x") == [[[Piece("usb", True, True)], [Piece("pci", True, True)]], [[Piece("x", False, True)]]]
    assert required("a?") == required("[ab]+") == required("(a|)b?") == required("(") == []
    assert required("(ab c)+") == [[[Piece("ab", True, False), Piece("c", False, True)]]]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_as_a_scan(spark, index, pattern):
    found = texts()
    wanted = frame(spark, found[:500]).unionByName(frame(spark, found[500:], 1000)).where(F.col("text").rlike(pattern))
    assert sorted(map(tuple, index.regex(pattern).collect())) == sorted(map(tuple, wanted.collect()))


def test_what_is_required_is_in_every_match():
    for pattern in PATTERNS[:-1]:
        for text in texts():
            if re.search(pattern, text):
                tokens = [w for w in re.split(r"[\W_]+", text.lower()) if w]
                for group in required(pattern):
                    assert any(all(any(p.text == t if p.whole else t.endswith(p.text) if not p.open_right else t.startswith(p.text) if not p.open_left else p.text in t for t in tokens) for p in alternative) for alternative in group)


def test_phrases(spark, index):
    found = texts()
    for phrase in ("device reset", "error", "kernel panic", "Terror Device"):
        assert index.phrase(phrase).count() == sum(phrase.lower() in t.lower() for t in found)
    side_by_side = sum(bool(re.search(r"(?<![0-9a-z])link[^0-9a-z]+up(?![0-9a-z])", t.lower())) for t in found)
    assert index.words("link up").count() == side_by_side > 0


def test_only_the_postings_that_are_needed_are_read(spark, index):
    plan = index.candidates([[[Piece("timeout")]]])._jdf.queryExecution().executedPlan().toString()
    assert f"(bucket#" in plan and f"= {bucket('timeout')})" in plan and "EqualTo(token,timeout)" in plan and "PartitionFilters: [isnotnull(bucket" in plan
    read = {f for f in index.candidates([[[Piece("timeout")]]]).inputFiles()}
    assert len(read) >= 1
    files = index.table("postings").where(F.col("bucket") == bucket("timeout")).select(F.input_file_name()).distinct().count()
    assert files < index.table("postings").select(F.input_file_name()).distinct().count() / 8 and BUCKETS == 64


def test_two_batches_as_one(spark, index):
    before = sorted(map(tuple, index.regex("link (up|down)").collect()))
    other = Index(spark, index.folder + "-whole")
    other.append(index.table("lines").select("device", "session_id", "line_no", "text"), "0")
    assert sorted(map(tuple, other.regex("link (up|down)").collect())) == before


def test_nothing(spark, index):
    other = Index(spark, index.folder + "-empty")
    other.append(frame(spark, ["", "!?"]), "0")
    assert other.regex("error").count() == 0 and other.regex(".").count() == 1


def test_words_are_sent_once(spark):
    from pyspark.sql import functions as F

    from emberline.operators.index import postings_of

    kept = spark.createDataFrame([("d", 1, 0, "The cat, the dog", 3), ("d", 1, 1, "cat", 3), ("d", 2, 0, None, 5)], "device string, session_id long, line_no long, text string, part int")
    postings = postings_of(kept)
    assert postings._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("Exchange") == 1
    found = postings.select("token", "session_id", "line_no", F.concat_ws(",", F.col("places").cast("array<string>"))).collect()
    assert sorted(map(tuple, found)) == [("cat", 1, 0, "1"), ("cat", 1, 1, "0"), ("dog", 1, 0, "3"), ("the", 1, 0, "0,2")]
