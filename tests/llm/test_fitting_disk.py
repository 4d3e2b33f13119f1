"""What the decomposition of op8 leaves on the local disks of executors."""

import time
from pathlib import Path

import numpy as np
from pyspark import cloudpickle

from emberline.llm import decontaminate
from emberline.session import Scratch

DOCS = [(k, " ".join(f"w{(k * 37 + j * j) % 3001}" for j in range(120))) for k in range(200)]


def _shuffled(spark) -> int:
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return sum(p.stat().st_size for d in folders for p in Path(d).rglob("shuffle_*.data"))


def test_the_first_reading_sends_no_directions(spark, monkeypatch):
    sent = []
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    own = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *a, **b: (sent.append(len(cloudpickle.dumps(f))), own(self, f, *a, **b))[1])
    drawn, counts, blocks = decontaminate._passage_sums(docs, None)
    given = decontaminate._passage_sums(docs, None, decontaminate._drawn())
    assert np.allclose(drawn, given[0], rtol=1e-5, atol=1e-5)
    assert (counts == given[1]).all() and blocks == given[2]
    assert sent[0] < 1 << 20 < sent[1]


def test_what_the_first_reading_shuffles_goes_before_the_second(spark, monkeypatch):
    at_second, before = [], _shuffled(spark)

    def second(docs, weights, directions):
        for _ in range(40):
            at_second[:] = [_shuffled(spark)]
            if at_second[0] <= before + (4 << 20):
                break
            time.sleep(0.25)
        return directions

    monkeypatch.setattr(decontaminate, "leading_directions", second)
    decontaminate.read_corpus(spark.createDataFrame(DOCS, "doc_id long, text string"), Scratch(spark, "test"))
    assert at_second[0] <= before + (4 << 20)
