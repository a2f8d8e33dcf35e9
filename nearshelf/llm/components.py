"""Connected components of a link table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearshelf.llm.tables import written


def components(links: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) of every id in links (a, b).

    Every id takes the smallest label around it, then that label's own label, until
    nothing changes: a number of rounds that grows with the logarithm of the longest
    chain. Labels are written after each round. Links to oneself, repeated links and
    null ends do no harm; an empty table gives an empty one.
    """
    links = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")), "labels")
    while True:
        heard = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("heard"))
        told = labels.join(heard, labels.id == heard.a).select("id", F.col("component").alias("was"), F.least("component", "heard").alias("component"))
        up = labels.select(F.col("id").alias("component"), F.col("component").alias("up"))
        new = written(told.join(up, "component", "left").select("id", "was", F.least("component", "up").alias("component")), "labels")
        labels = new.select("id", "component")
        if new.where("was <> component").isEmpty():
            return labels
