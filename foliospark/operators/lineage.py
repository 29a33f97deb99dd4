"""Lineage: which entity came from which, events about them, and which template matched what."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def relations(pairs: DataFrame) -> DataFrame:
    """parent, child and the first seq of each relation; an entity is not its own parent. pairs: parent, child, seq."""
    return pairs.where("parent <> child").groupBy("parent", "child").agg(F.min("seq").alias("seq"))


def parents(pairs: DataFrame) -> DataFrame:
    """The one parent of each child: the first that was recorded."""
    return relations(pairs).groupBy("child").agg(F.min_by("parent", F.struct("seq", "parent")).alias("parent"))


def children(pairs: DataFrame, entity) -> DataFrame:
    return relations(pairs).where(F.col("parent") == entity).orderBy("seq").select("child", "seq")


def with_children(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """Events of each entity and of its direct children. events: entity, seq, message."""
    own = events.select(F.col("entity").alias("root"), "entity", "seq", "message")
    below = relations(pairs).select(F.col("parent").alias("root"), F.col("child").alias("entity")).join(events, "entity").select("root", "entity", "seq", "message")
    return own.unionByName(below)


def tree(pairs: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """root, entity, level and path of everything below each root, by a recursive query. roots: root.

    Relations are followed until no new rows appear, or down to depth if it is given; a path ends where it would come
    to one of its own entities again. Takes Spark's own bounds on levels and rows of recursive queries off the session."""
    spark = pairs.sparkSession
    for what in ("Level", "Row"):
        spark.conf.set(f"spark.sql.cteRecursion{what}Limit", "-1")
    return spark.sql(f"""
        WITH RECURSIVE below(root, entity, level, path, seen) AS (
          SELECT root, root, 0, cast(root AS string), array(root) FROM {{roots}}
          UNION ALL
          SELECT b.root, r.child, b.level + 1, concat(b.path, '/', r.child), array_append(b.seen, r.child) FROM below b JOIN {{relations}} r ON r.parent = b.entity
          WHERE NOT array_contains(b.seen, r.child){"" if depth is None else f" AND b.level < {depth}"})
        SELECT root, entity, level, path FROM below""", relations=relations(pairs), roots=roots)


def latest_matches(matches: DataFrame) -> DataFrame:
    """The last match recorded for each content. matches: template, content, score, seq."""
    return matches.groupBy("content").agg(F.max_by("template", "seq").alias("template"), F.max_by("score", "seq").alias("score"))


def match_groups(matches: DataFrame) -> DataFrame:
    """Each template's contents, the best-scored first, and their number."""
    last = latest_matches(matches)
    return last.groupBy("template").agg(F.count(F.lit(1)).alias("matches"), F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("k"), "content"))), lambda x: x.content).alias("contents"))


def structures(events: DataFrame, key: str = "structure") -> DataFrame:
    """The value that messages give for a key."""
    return events.select("entity", F.regexp_extract("message", rf"{key}=(\w+)", 1).alias(key)).where(F.col(key) != "")


def field_names(events: DataFrame) -> DataFrame:
    """All names of name=value pairs in messages."""
    return events.select(F.explode(F.regexp_extract_all("message", F.lit(r"(\w+)="), F.lit(1))).alias("name")).distinct()
