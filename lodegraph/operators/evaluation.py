"""How good recommendations are: pairs held out for each user, and what a ranking finds of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def split(pairs: DataFrame, user: str, item: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """The distinct pairs with held: of each user's so large a share, rounded, by a hash of the pair; nothing of a user with one."""
    draw = F.md5(F.concat(F.lit(f"{seed}|"), F.col(user).cast("string"), F.lit("|"), F.col(item).cast("string")))
    own = W.partitionBy(user)
    named = pairs.select(user, item).distinct().withColumn("_n", F.count("*").over(own)).withColumn("_at", F.row_number().over(own.orderBy(draw, item)))
    return named.select(user, item, ((F.col("_n") > 1) & (F.col("_at") <= F.round(F.col("_n") * share))).alias("held"))


def quality(recommended: DataFrame, held: DataFrame, user: str, item: str, k: int = 10, rank: str = "rank") -> DataFrame:
    """One row: users with something held out, and the means over them of precision, recall, hit_rate and ndcg at k.

    recommended: (user, item, rank from 1); held: (user, item). Precision is of what is recommended,
    which may be less than k; a user to whom nothing is recommended scores 0 throughout.
    """
    first = recommended.where(F.col(rank) <= k).select(user, item, F.col(rank).alias("_rank"))
    wanted = held.select(user, item).distinct()
    given = first.groupBy(user).agg(F.countDistinct(item).alias("_given"))
    found = first.join(wanted, [user, item]).groupBy(user).agg(F.countDistinct(item).alias("_hits"), F.sum(1 / F.log2(F.col("_rank") + 1)).alias("_gain"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("_wanted"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1)))
    rows = wanted.groupBy(user).agg(F.count("*").alias("_wanted")).join(given, user, "left").join(found, user, "left").na.fill(0, ["_given", "_hits"]).na.fill(0.0, ["_gain"])
    measures = {
        "precision": F.when(F.col("_given") > 0, F.col("_hits") / F.col("_given")).otherwise(0.0),
        "recall": F.col("_hits") / F.col("_wanted"),
        "hit_rate": (F.col("_hits") > 0).cast("double"),
        "ndcg": F.col("_gain") / ideal,
    }
    return rows.agg(F.count("*").alias("users"), *(F.avg(m).alias(n) for n, m in measures.items()))
