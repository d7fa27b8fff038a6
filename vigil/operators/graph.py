"""Connected components by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.snapshots import written


def components(edges: DataFrame) -> DataFrame:
    """(id, root): for each id of the edges (a, b) the smallest id that it reaches.

    A round takes the smallest root next to each id, then that root's own root, so the rounds are about the logarithm of the
    longest path; each is stored, so that plans stay short and a lost executor costs no earlier round. Joins are by sorted
    partitions: a side that is small on disk would pass through the driver to be broadcast, in every round.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    roots = both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).withColumnRenamed("a", "id")
    roots = written(roots, "roots")
    while True:
        beside = both.join(roots.withColumnRenamed("id", "b").hint("merge"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("beside"))
        stepped = roots.join(beside.hint("merge"), "id").select("id", F.col("root").alias("was"), F.least("root", "beside").alias("at"))
        above = roots.select(F.col("id").alias("at"), F.col("root").alias("above"))
        after = written(stepped.join(above.hint("merge"), "at").select("id", "was", F.least("at", "above").alias("root")), "roots")
        roots = after.select("id", "root")
        if after.where("was <> root").isEmpty():
            return roots
