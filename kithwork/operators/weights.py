"""Replies between persons and the reciprocal weight of a friendship."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reply_pairs(reply: DataFrame, creator: DataFrame) -> DataFrame:
    """(comment_id, p1, p2): who replied to whom; replies to oneself are left out."""
    author = creator.selectExpr("comment_id", "person_id AS p1")
    answered = creator.selectExpr("comment_id AS replied_id", "person_id AS p2")
    return reply.join(author, "comment_id").join(answered, "replied_id").filter("p1 <> p2").select("comment_id", "p1", "p2")


def between_friends(pairs: DataFrame, knows: DataFrame) -> DataFrame:
    """Replies whose two persons know each other."""
    friends = knows.selectExpr("src AS p1", "dst AS p2")
    return pairs.join(friends, ["p1", "p2"], "left_semi")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(p1, p2, n): replies by ordered pair; summed before the shuffle."""
    return pairs.groupBy("p1", "p2").agg(F.count(F.lit(1)).alias("n"))


def knows_weight(knows: DataFrame, counts: DataFrame) -> DataFrame:
    """(src, dst, weight): the smaller number of replies of the two directions, 0 if either is missing."""
    there = counts.selectExpr("p1 AS src", "p2 AS dst", "n AS forward")
    back = counts.selectExpr("p2 AS src", "p1 AS dst", "n AS backward")
    joined = knows.join(there, ["src", "dst"], "left").join(back, ["src", "dst"], "left")
    return joined.select("src", "dst", F.least(F.coalesce("forward", F.lit(0)), F.coalesce("backward", F.lit(0))).cast("long").alias("weight"))


def weighted(knows: DataFrame, reply: DataFrame, creator: DataFrame) -> DataFrame:
    """Friendships with weights, from replies between friends only."""
    return knows_weight(knows, pair_counts(between_friends(reply_pairs(reply, creator), knows)))


def above(edges: DataFrame, x: int) -> DataFrame:
    """Edges of a weight strictly above ``x``; all of them if ``x`` is negative."""
    return edges if x < 0 else edges.filter(F.col("weight") > x)
