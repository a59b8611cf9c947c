"""Connected components by smallest label."""

from pyspark.sql import DataFrame, functions as F

from floodframe.llm.common import bounded, cut_lineage


def components(links: DataFrame) -> DataFrame:
    """``v`` and ``label``, the smallest vertex it reaches, for every vertex of ``links(a, b)``.

    A vertex takes the least label among its own and its neighbours', then its label's label, until every link joins equal labels.
    Stars are done after one round, chains after about the logarithm of their length. Labels are broadcast only while few.
    """
    spark = links.sparkSession
    edges = cut_lineage(spark, links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut_lineage(spark, edges.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("v"), F.least("a", "least").alias("label")))
    while True:
        held = bounded(labels)
        named = edges.join(held.toDF("a", "label_a"), "a").join(held.toDF("b", "label_b"), "b")
        open_edges = named.where("label_a != label_b")
        if open_edges.isEmpty():
            return labels
        # a label's own vertex hooks onto the least label beside it, which moves whole trees at once
        hooks = open_edges.groupBy(F.col("label_a").alias("v")).agg(F.min("label_b").alias("to"))
        hooked = labels.join(bounded(cut_lineage(spark, hooks)), "v", "left").select("v", F.least("label", F.coalesce("to", "label")).alias("label"))
        hooked = cut_lineage(spark, hooked)
        parent = bounded(hooked).toDF("label", "up")
        labels = cut_lineage(spark, hooked.join(parent, "label").select("v", F.col("up").alias("label")))
