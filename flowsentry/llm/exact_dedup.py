"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Texts are equal when they agree after deleting white space. Equal texts are first combined inside each
task, then in salted digest groups, then the salts' winners are combined over the whole table. Each of the
three combines groups by the content itself beside its digest, so a digest that two contents share never
joins them. A hot group therefore reaches the second stage as one row per task and the third as one row per
salt. Of equal texts the one with the most code points stays, then the smallest id.

Defined results: a null text counts as empty, and empty texts are equal to each other. A null id ranks
after every other id. Rows that repeat both id and length of the one that stays are repeats of one document:
one of them is kept, the others are not. An empty table gives an empty result; other columns are ignored
by `equal_text_groups` and passed through by `drop_equal_texts`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.llm.common import SPACES, whole_texts, written

#: Salted groups for one digest; the rows of the last combine are at most this many for a content.
SALTS = 16


def normalised(text: Column) -> Column:
    return F.translate(text, SPACES, "")


def _big(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(38,0)")


def _rank(n_points: Column, doc_id: Column) -> Column:
    """Length and id as one number whose maximum is the row that stays: longest, then smallest id, null last."""
    id_part = F.coalesce(_big(2**63) - doc_id.cast("decimal(38,0)"), _big(0))
    return (n_points.cast("decimal(38,0)") * _big(2**65) + id_part).cast("decimal(38,0)")


def _id_of(rank: Column) -> Column:
    id_part = rank % _big(2**65)
    return F.when(id_part != 0, (_big(2**63) - id_part).cast("long"))


def _fingerprinted(texts: DataFrame) -> DataFrame:
    return (texts.select("doc_id", normalised(F.col("text")).alias("content"),
                         F.length("text").alias("n_points"))
            .select("doc_id", "content", "n_points",
                    F.unhex(F.sha2(F.col("content").cast("binary"), 256)).alias("digest")))


def combine(texts: DataFrame) -> DataFrame:
    """One row per distinct content: digest, content, best rank, number of rows."""
    found = _fingerprinted(texts)
    # the scan partition is the salt: inside a task all equal rows meet in the partial aggregate
    salted = (found.withColumn("salt", F.spark_partition_id() % SALTS)
              .groupBy("digest", "salt", "content")
              .agg(F.max(_rank(F.col("n_points"), F.col("doc_id"))).alias("best"), F.count("*").alias("n")))
    return (salted.groupBy("digest", "content")
            .agg(F.max("best").alias("best"), F.sum("n").alias("n")))


def equal_text_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of `df`.

    Rows find their group by digest. Digests that stand for several contents (none is known for SHA-256) are
    noticed when the groups are written, and their rows are then matched by content.
    """
    texts = whole_texts(df, id_col, text_col)
    contents = combine(texts)
    # both groupings below share the exchange by digest
    groups = written(contents.groupBy("digest").agg(
        F.count("*").alias("contents"), F.max("best").alias("best"), F.max("n").alias("n")), "equal-texts")
    once = Window.partitionBy("digest", "doc_id").orderBy(F.desc("n_points"))
    found = _fingerprinted(texts)
    rows = found.select("doc_id", "digest", "n_points").withColumn("repeat", F.row_number().over(once))
    joined = rows.join(groups.filter("contents = 1").select("digest", "best", "n"), "digest")
    if not groups.filter("contents > 1").isEmpty():
        shared = contents.join(groups.filter("contents > 1").select("digest"), "digest", "left_semi")
        exact = (found.join(shared, ["digest", "content"])
                 .withColumn("repeat", F.row_number().over(
                     Window.partitionBy("digest", "content", "doc_id").orderBy(F.desc("n_points")))))
        joined = joined.unionByName(exact.select(*joined.columns))
    keep = _id_of(F.col("best"))
    return joined.select(
        "doc_id", keep.alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep) & (F.col("repeat") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_equal_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` that stay, with all their columns; of rows that repeat id and text, one."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
                     F.unhex(F.sha2(normalised(text).cast("binary"), 256)).alias("digest"),
                     F.length(text).alias("n_points"), F.col(f"`{id_col}`").cast("long").alias("doc_id"))
    stay = (equal_text_groups(df, id_col, text_col).filter("kept")
            .select(F.col("doc_id").alias("stay_id"), F.unhex("text_sha256").alias("stay_digest")))
    found = rows.join(stay, (F.col("digest") == F.col("stay_digest"))
                      & F.col("doc_id").eqNullSafe(F.col("stay_id")), "left_semi")
    once = Window.partitionBy("digest", "doc_id").orderBy(F.desc("n_points"))
    return found.withColumn("repeat", F.row_number().over(once)).filter("repeat = 1").select("row.*")
