"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyscope.llm.common import kept


def components(links: DataFrame) -> DataFrame:
    """`node` and `comp`, the smallest node it is connected with, for each node of the links `a` - `b`.

    Each round every node takes the smallest of itself and its neighbours for its parent, parents are followed to their
    parents, and the links are carried over to what is left; the number of nodes left at least halves. All tables are
    written to the shared folder, so a lost executor costs no earlier round, and nothing is gathered on the driver.
    """
    links = kept(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    labels = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("comp"))
    while not links.isEmpty():
        ends = links.select(F.explode(F.expr("array(struct(a AS v, b AS p), struct(b AS v, b AS p))")).alias("x"))
        parents = kept(ends.groupBy("x.v").agg(F.min("x.p").alias("p")))
        for _ in range(2):
            above = parents.select(F.col("v").alias("v_"), F.col("p").alias("p_"))
            parents = kept(parents.join(above, F.col("p") == F.col("v_"), "left").select("v", F.coalesce("p_", "p").alias("p")))
        labels = kept(labels.join(parents, labels["comp"] == parents["v"], "left").select("node", F.coalesce("p", "comp").alias("comp")))
        for end in ("a", "b"):
            links = links.join(parents.withColumnsRenamed({"v": "v_", "p": "p_"}), F.col(end) == F.col("v_"), "left").withColumn(end, F.coalesce("p_", end)).select("a", "b")
        links = kept(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    return labels
