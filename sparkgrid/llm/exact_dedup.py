"""Exact deduplication by most-significant-digit radix splitting on the bytes of the texts.

Documents are split into groups by a first digit (the byte length and the
leading bytes). Groups of one are done. The others are split again by the next
bytes, each digit four times as wide as the one before, until a group has one
member or its text is used up: what is then together is equal byte for byte,
and no digest is compared. Digits pass a shuffle only as group keys, combined
on the map side, so a group that holds a third of all rows arrives as one row
per task. Whole texts move only with documents that still have a rival.

Defined cases: NULL text counts as empty; empty texts are equal; NULL ids rank
below all others; of rows that repeat an id and a text exactly one stays; an
empty table gives an empty result; input columns with the name of a result
column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkgrid.llm.common import ascii_lower, packed, text_or_empty, unpacked
from sparkgrid.session import join_small, stage

FIRST_DIGIT = 32
GROWTH = 4


def first_digit(text: Column) -> Column:
    """Leading bytes as one character each, letters A-Z lowered; no need to lower the whole text."""
    head = F.substring(F.encode(text, "UTF-8"), 1, FIRST_DIGIT)
    return ascii_lower(F.decode(head, "ISO-8859-1"))


def exact_dedup(df: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """All rows of ``df`` with keep_id, group_size, kept and text_sha256.

    Texts are equal when identical after lowering A-Z. The row with the
    largest id of a group stays.
    """
    whole = text_or_empty(text)
    rows = df.select(packed(df), F.octet_length(whole).alias("size"), first_digit(whole).alias("digit"))
    shared = stage(rows.groupBy("size", "digit").count().where("count > 1").drop("count"), "digits")
    rivals = stage(
        join_small(rows, shared, ["size", "digit"], "left_semi").select(
            F.monotonically_increasing_id().alias("uid"), F.lit(0).cast("long").alias("group"), "size", "digit", "row"),
        "rivals")
    alone = join_small(rows, shared, ["size", "digit"], "left_anti")

    own_id = F.col(f"row.`{id_column}`")
    done = [alone.select("row", own_id.alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                         F.lit(True).alias("kept"))]
    longest = rivals.agg(F.max("size")).first()[0]
    active, start, width = rivals, 0, FIRST_DIGIT
    while longest is not None:
        normal = F.encode(ascii_lower(text_or_empty(f"row.`{text}`")), "UTF-8")
        keys = ["group", "size", "digit"]
        members = active.select("uid", "group", "size", "row", F.substring(normal, start + 1, width).alias("digit"))
        # Written, so that the join is a stage of its own in which a large group can be split.
        groups = stage(members.groupBy(*keys).agg(
            F.max(F.struct(own_id.alias("id"), "uid")).alias("keep"), F.count("*").alias("members")), "groups")
        split = stage(
            join_small(members, groups, keys).select(
                "uid", F.col("keep.uid").alias("group"), F.col("keep.id").alias("keep_id"), "members", "size", "row"),
            "split")
        start, width = start + width, width * GROWTH
        ended = (F.col("members") == 1) | (F.col("size") <= start)
        done.append(split.where(ended).select(
            "row", "keep_id", F.col("members").alias("group_size"), (F.col("uid") == F.col("group")).alias("kept")))
        active = split.where(~ended)
        longest = active.agg(F.max("size")).first()[0]

    result = done[0]
    for part in done[1:]:
        result = result.union(part)
    normal = ascii_lower(text_or_empty(f"row.`{text}`"))
    return unpacked(result, keep_id=F.col("keep_id"), group_size=F.col("group_size"), kept=F.col("kept"),
                    text_sha256=F.sha2(F.encode(normal, "UTF-8"), 256))


def kept_documents(df: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The rows that stay, with the columns of ``df`` only."""
    inner = df.select(packed(df, "document"), text, id_column)
    return exact_dedup(inner, text, id_column).where("kept").select("document.*")
