"""Persons by date, tag, place and forum."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kithwork.sources.tables import Network

#: Levels that a place hierarchy may have; deeper ones are refused.
MAX_LEVELS = 32


def born_since(person: DataFrame, day: str) -> DataFrame:
    """Persons born on or after ``day``."""
    return person.filter(F.col("birthday") >= F.lit(day).cast("date"))


def with_tag(interest: DataFrame, tag: DataFrame, name: str) -> DataFrame:
    """(person_id) of those interested in the tag called ``name``."""
    return interest.join(tag.filter(F.col("name") == name), "tag_id", "left_semi").select("person_id").distinct()


def encode_birthday(person: DataFrame) -> DataFrame:
    """(person_id, code): a date as the number yyyymmdd."""
    return person.select("person_id", F.date_format("birthday", "yyyyMMdd").cast("long").alias("code"))


def by_birthday(person: DataFrame) -> DataFrame:
    """(person_id, birthday, position): youngest first, then by id. Positions come from per-day counts, so no task sorts all."""
    days = person.groupBy("birthday").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(F.col("birthday").desc()).rowsBetween(Window.unboundedPreceding, -1)
    starts = days.select("birthday", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # one row a day
    inside = F.row_number().over(Window.partitionBy("birthday").orderBy("person_id"))
    return person.withColumn("inside", inside).join(starts, "birthday").select("person_id", "birthday", (F.col("start") + F.col("inside")).cast("long").alias("position"))


def dense_relabel(ids: DataFrame, column: str, width: int = 1 << 16) -> DataFrame:
    """(column, new_id): distinct ids numbered from 0 in order, by ranges of ids."""
    part = ids.select(column).distinct().withColumn("part", F.floor(F.col(column) / width))
    counts = part.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(column)) - 1
    return part.withColumn("inside", inside).join(starts, "part").select(column, (F.col("start") + F.col("inside")).cast("long").alias("new_id"))


def tag_counts(interest: DataFrame) -> DataFrame:
    """(person_id, n_tags)."""
    return interest.groupBy("person_id").agg(F.count(F.lit(1)).alias("n_tags"))


def place_by_name(place: DataFrame, name: str) -> DataFrame:
    """(place_id, name) of all places called ``name``."""
    return place.filter(F.col("name") == name)


def place_closure(place: DataFrame, part_of: DataFrame) -> DataFrame:
    """(ancestor, place_id): every place with itself and all places inside it, cycles and repeats allowed.

    A hierarchy has few levels, so the loop is short; the only thing read back is whether a level found something new.
    """
    closure = place.select(F.col("place_id").alias("ancestor"), "place_id").distinct()
    step, down = closure, part_of.select(F.col("parent").alias("place_id"), F.col("child"))
    for _ in range(MAX_LEVELS):
        step = step.join(down, "place_id").select("ancestor", F.col("child").alias("place_id")).distinct()
        step = step.join(closure, ["ancestor", "place_id"], "left_anti")
        if not step.limit(1).count():
            return closure
        closure = closure.unionByName(step)
    raise ValueError(f"places are nested in more than {MAX_LEVELS} levels")


def person_places(net: Network) -> DataFrame:
    """(person_id, place_id): where persons live, study or work; each once."""
    return net.located_in.select("person_id", "place_id").unionByName(org_places(net)).distinct()


def org_places(net: Network) -> DataFrame:
    """(person_id, place_id) by way of an organisation."""
    return net.study_work.join(net.org_place, "org_id").select("person_id", "place_id")


def in_place(net: Network, names: DataFrame) -> DataFrame:
    """(name, person_id) for the distinct ``names`` (name): persons of any place so called or of a place inside it."""
    wanted = net.place.join(names.select("name").distinct(), "name").select("name", F.col("place_id").alias("ancestor"))
    inside = place_closure(net.place, net.place_part_of).join(wanted, "ancestor").select("name", "place_id").distinct()
    return person_places(net).join(inside, "place_id").select("name", "person_id").distinct()


def forum_tags_named(net: Network, names: DataFrame) -> DataFrame:
    """(forum_id, name) for forums with a tag of ``names`` (name)."""
    tags = net.tag.join(names.select("name").distinct(), "name").select("tag_id", "name")
    return net.forum_tag.join(tags, "tag_id").select("forum_id", "name").distinct()


def members_of_tagged_forums(net: Network, names: DataFrame) -> DataFrame:
    """Rows of forum_member whose forum has a tag of ``names``: the filter reaches the member scan as a semi join."""
    return net.forum_member.join(forum_tags_named(net, names).select("forum_id").distinct(), "forum_id", "left_semi")


def tag_members(net: Network, names: DataFrame) -> DataFrame:
    """(name, person_id): members of any forum with the tag."""
    return net.forum_member.join(forum_tags_named(net, names), "forum_id").select("name", "person_id").distinct()


def tag_sets(interest: DataFrame) -> DataFrame:
    """(person_id, tags): a person's tags as an array."""
    return interest.groupBy("person_id").agg(F.collect_set("tag_id").alias("tags"))


def kth_largest(rows: DataFrame, column: str, k: int) -> DataFrame:
    """(value): the k-th largest value of ``column``; no row if there are fewer. Only k rows a task are kept."""
    top = rows.select(F.col(column).alias("value")).orderBy(F.col("value").desc()).limit(k)
    return top.agg(F.min("value").alias("value"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k).select("value")
