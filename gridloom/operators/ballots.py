"""Ranked ballots and plurality counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def borda(ballots: DataFrame) -> DataFrame:
    """(option, points, firsts): options - rank points a ballot. ballots: (evaluator, option, rank from 1)."""
    n = ballots.agg(F.countDistinct("option").alias("n"))
    b = ballots.crossJoin(F.broadcast(n))  # one row
    return b.groupBy("option").agg(F.sum(F.col("n") - F.col("rank")).cast("long").alias("points"), F.count_if(F.col("rank") == 1).cast("long").alias("firsts"))


def pairwise(ballots: DataFrame) -> DataFrame:
    """(a, b, wins): ballots that rank a before b. A ballot ranks few options, so pairs are made within a ballot's list."""
    lists = ballots.groupBy("evaluator").agg(F.array_sort(F.collect_list(F.struct("rank", "option"))).alias("xs"))
    one = lists.select("xs", F.posexplode("xs").alias("i", "x"))
    two = one.select(F.col("x.option").alias("a"), F.col("x.rank").alias("ra"), F.explode("xs").alias("y"))
    return two.where("y.rank > ra").groupBy("a", F.col("y.option").alias("b")).agg(F.count(F.lit(1)).alias("wins"))


def condorcet(ballots: DataFrame) -> DataFrame:
    """(option) that beats every other on more than half of the ballots that rank both; none if there is no such."""
    w = pairwise(ballots)
    back = w.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("wins").alias("losses"))
    beat = w.join(back, ["a", "b"], "left").where(F.col("wins") > F.coalesce("losses", F.lit(0))).groupBy(F.col("a").alias("option")).agg(F.count(F.lit(1)).alias("k"))
    n = ballots.agg((F.countDistinct("option") - 1).alias("k"))
    return beat.join(F.broadcast(n), "k").select("option")


def mean_scores(scores: DataFrame) -> DataFrame:
    """(option, criterion, mean). scores: (evaluator, option, criterion, score)."""
    return scores.groupBy("option", "criterion").agg(F.avg("score").alias("mean"))


def plurality(votes: DataFrame) -> DataFrame:
    """(winner, districts): districts won; a tied district has the winner null. votes: (district, party, votes)."""
    d = votes.groupBy("district", "party").agg(F.sum("votes").alias("v"))
    top = d.groupBy("district").agg(F.max("v").alias("m"))
    best = d.join(top, "district").where("v = m").groupBy("district").agg(F.count(F.lit(1)).alias("n"), F.min("party").alias("party"))
    return best.groupBy(F.when(F.col("n") == 1, F.col("party")).alias("winner")).agg(F.count(F.lit(1)).alias("districts"))
