"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import Scratch


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, root) for every node u of ``edges`` (a, b: long) but the roots; root is the component's least node.

    Each round writes its edges to the shared folder, so lineage stays short and
    a lost executor costs a re-read. A star's centre may have any number of
    neighbours: minima are pre-aggregated and joined back, never gathered.
    Self-links and null ends are ignored; an empty table gives no rows.
    """
    store = Scratch(edges.sparkSession, "components")
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = store.table(e, "0")
    seen = None
    for k in range(1, rounds + 1):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are written, as adaptive execution splits a hot centre only where a join reads both sides from shuffles of its own
        least = store.table(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), f"least{k}")
        large = store.table(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), f"large{k}")
        least = store.table(large.groupBy("u").agg(F.min("v").alias("m")), f"small{k}")
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = store.table(small, str(k))
        sign = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        for name in (str(k - 1), f"least{k}", f"large{k}", f"small{k}"):
            store.drop(name)
        if sign == seen:
            return now.select("u", F.col("v").alias("root"))
        seen = sign
    raise RuntimeError(f"components did not settle in {rounds} rounds")
