"""Exact duplicates by 128-bit content hash, with a byte comparison inside groups.

Rows are grouped by the hash alone, so only 16 bytes and an id are shuffled to
find groups. Each group of two or more rows then gets one text to compare with,
and every member is compared with it byte by byte. Members that differ (hash
collisions) form groups of their own by their whole text.

Defined results: a null text counts as empty; rows with a null id are members
but are only kept where no member has an id; rows that repeat an id with the
same text are one document and share the answer; an empty table gives an empty
result. Other columns are not read, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import fresh, settled, shipped


def content_hash(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                keep: str = "min", hasher=content_hash) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    ``keep`` is "min" or "max": which id of a group stays. ``hasher`` makes the
    grouping hash; the answer does not depend on it.
    """
    best = {"min": F.min, "max": F.max}[keep]
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
    rows = rows.withColumn("_hash", hasher(F.col("_text")))
    several = settled(
        rows.groupBy("_hash").agg(F.count("*").alias("_n"), best("_id").alias("_keep"))
        .where("_n > 1").select("_hash", "_keep"), "dedup-groups")
    # While the list of hashes is short, texts of single rows are never shuffled.
    several = shipped(several)
    members = rows.join(several, "_hash")
    # One text for each group: that of the row that stays, whichever copy of it.
    models = settled(
        members.where(F.col("_id").eqNullSafe(F.col("_keep")))
        .groupBy("_hash").agg(F.min("_text").alias("_model")), "dedup-models")
    sha = F.sha2(F.col("_text"), 256).alias("text_sha256")
    marked = settled(members.join(models, "_hash").select(
        "_id", "_hash", F.when(F.col("_model") == F.col("_text"), F.lit(""))
        .otherwise(F.concat(F.lit("="), F.col("_text"))).alias("_other"), sha), "dedup-marked")
    groups = settled(
        marked.groupBy("_hash", "_other")
        .agg(F.count("*").alias("group_size"), best("_id").alias("keep_id")), "dedup-sizes")
    copies = marked.join(groups, ["_hash", "_other"]).select(
        F.col("_id").alias(id_col), "keep_id", "group_size",
        F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    singles = rows.join(several, "_hash", "left_anti").select(
        F.col("_id").alias(id_col), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), sha)
    return copies.unionByName(singles)


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  keep: str = "min") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group of
    equal texts, the one whose id ``keep`` names. Of rows that repeat an id with the
    same text, and of rows without id where no member has one, any one stays."""
    found = settled(exact_dedup(docs, id_col, text_col, keep).where("group_size > 1"), "dedup-found")
    own_id, own_sha = fresh("_own_id", docs.columns), fresh("_own_sha", docs.columns)
    sha = F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256)
    marked = docs.withColumn(own_sha, sha)

    def listed(rows: DataFrame) -> DataFrame:
        return shipped(settled(rows.select(F.col(f"`{id_col}`").alias(own_id), F.col("text_sha256").alias("_sha"))
                               .distinct(), "dedup-list"))

    def same(rows: DataFrame):
        return marked[f"`{id_col}`"].eqNullSafe(rows[own_id]) & (marked[own_sha] == rows["_sha"])

    every, stay = listed(found), listed(found.where("kept"))
    singles = marked.join(every, same(every), "left_anti")
    kept = marked.join(stay, same(stay), "left_semi").dropDuplicates([id_col, own_sha])
    return singles.unionByName(kept).drop(own_sha)
