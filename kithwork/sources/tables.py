"""The thirteen tables of a social network, as one object of lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Network:
    """All ids are BIGINT. ``knows`` has both directions, no loops and no repeats."""

    person: DataFrame  # person_id, birthday DATE
    knows: DataFrame  # src, dst
    comment_creator: DataFrame  # comment_id, person_id
    reply: DataFrame  # comment_id, replied_id
    tag: DataFrame  # tag_id, name
    interest: DataFrame  # person_id, tag_id
    forum_tag: DataFrame  # forum_id, tag_id
    forum_member: DataFrame  # forum_id, person_id
    place: DataFrame  # place_id, name (not unique)
    place_part_of: DataFrame  # child, parent
    located_in: DataFrame  # person_id, place_id
    org_place: DataFrame  # org_id, place_id
    study_work: DataFrame  # person_id, org_id


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of ``edges`` (src, dst), each once, without loops and nulls."""
    there = edges.select("src", "dst").filter("src <> dst")
    return there.unionByName(there.selectExpr("dst AS src", "src AS dst")).distinct()
