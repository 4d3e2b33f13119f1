"""Exact copies of texts, and repeated keys, settled before rows are shuffled."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.session import Scratch, small


def copy_groups(docs: DataFrame, scratch: Scratch, id_column: str = "doc_id") -> DataFrame:
    """The id and the leader (the smallest id with the same text) of rows whose text other rows share.

    Texts are told apart by their MD5; null texts and ids have no copies here. Groups are
    counted with map-side sums and stored, so rows join them by broadcast, or by a join whose large
    keys Spark can split: one text may have any share of the rows.
    """
    keyed = docs.where(f"{id_column} is not null and text is not null").select(id_column, F.unhex(F.md5("text")).alias("key"))
    groups = keyed.groupBy("key").agg(F.min(id_column).alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    groups = scratch.write(groups.select("key", "leader"), "copy-groups")
    return keyed.join(small(groups), "key").select(id_column, "leader")


def settled(key: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys to shuffle by, their weights and which rows are owned.

    A key that a batch holds once keeps its row, with weight 1. Of one that it holds more
    often, one unowned row of weight 2 stands for all, and the rows themselves go by ``salt`` with weight 2, as
    they are known to be repeated. Unowned rows come last.
    """
    order = np.argsort(key, kind="stable")
    new = np.r_[True, key[order][1:] != key[order][:-1]] if len(key) else np.empty(0, dtype=bool)
    runs = np.diff(np.r_[np.flatnonzero(new), len(key)])
    repeated = np.empty(len(key), dtype=bool)
    repeated[order] = np.repeat(runs > 1, runs)
    witnesses = key[order][new][runs > 1]
    keys = np.concatenate([np.where(repeated, salt, key), witnesses])
    weights = np.concatenate([np.where(repeated, 2, 1), np.full(len(witnesses), 2)]).astype(np.int32)
    owned = np.concatenate([np.ones(len(key), dtype=bool), np.zeros(len(witnesses), dtype=bool)])
    return keys, weights, owned
