"""Connected components by alternating large-star and small-star rounds, with joins and minima only."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Staged

ROUNDS = 60


def _nearest(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of each u, itself included."""
    return edges.groupBy("u").agg(F.min("v").alias("__m")).select(F.col("u").alias("__u"), F.least("u", "__m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_nearest(both), F.col("u") == F.col("__u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    low = _nearest(down)
    moved = down.join(low, F.col("u") == F.col("__u")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
    return moved.select("e.*").where("u <> v").distinct()


def components(edges: DataFrame) -> Staged:
    """edges(u, v) -> staged (u, v): every vertex that isn't its component's smallest, with that smallest vertex."""
    now, mark = Staged(edges.where("u <> v").distinct(), "edges"), None
    for _ in range(ROUNDS):
        new = Staged(_small_star(_large_star(now.df)), "edges")
        now.drop()
        now = new
        found = now.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == mark:
            return now
        mark = found
    raise RuntimeError("components did not settle")
