"""Exact duplicates by a 128-bit hash of the normalised text, with bytes compared inside groups.

Texts are equal when they are identical after every run of white space became one space. Rows are
grouped by the MD5 of that form, which moves 16 bytes per row. Only texts whose hash occurs more than
once are looked at again: they are counted per (hash, text), so bytes decide, and a task sends each
text it holds once, however many copies there are. A hash that stands for several texts is a
collision; its rows are grouped by the hash and SHA-256 together, and if even that does not tell two
different texts apart the job fails instead of dropping one of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queryscore.llm.scratch import kept
from queryscore.operators.skew import left_join_skewed

#: Bits of the filter that travels to every task: 8 MB, whatever the input.
FILTER_BITS = 1 << 26
_BUCKET_BITS = 1 << 15


def normalised(text: Column) -> Column:
    """Every run of white space as one space; null as an empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def hash128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _places(digest: Column) -> tuple[Column, Column]:
    """(bucket, bit in it) of a digest; Spark numbers buckets and bits from 1."""
    place = F.pmod(F.xxhash64(digest), F.lit(FILTER_BITS)) + 1
    return F.bitmap_bucket_number(place), F.bitmap_bit_position(place)


def marked(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` plus ``_maybe``: whether their ``_digest`` may be in ``known``; true wherever it is.

    ``known`` is reduced to a bit map of ``FILTER_BITS`` bits, so what is broadcast has a fixed size
    and no row is shuffled.
    """
    bucket, bit = _places(F.col("_digest"))
    maps = known.groupBy(bucket.alias("_bucket")).agg(F.bitmap_construct_agg(bit).alias("_map"))
    byte = F.conv(F.hex(F.substring("_map", F.shiftright("_bit", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    maybe = F.coalesce(F.getbit(byte, F.pmod("_bit", F.lit(8)).cast("int")) == 1, F.lit(False))
    spread = rows.withColumns({"_bucket": bucket, "_bit": bit}).join(F.broadcast(maps), "_bucket", "left")
    return spread.select(*rows.columns, maybe.alias("_maybe"))


def _collided(texts: DataFrame, repeated: DataFrame) -> DataFrame:
    """(_digest) of repeated hashes that stand for more than one text."""
    variants = marked(texts, repeated).where("_maybe").groupBy("_digest", "_text").agg(F.count(F.lit(1)).alias("_n"))
    told = variants.groupBy("_digest").agg(F.count(F.lit(1)).alias("_texts"), F.count_distinct(F.sha2("_text", 256)).alias("_shas"))
    found = kept(told.where("_texts > 1"), "collided")
    if not found.where("_shas < _texts").isEmpty():
        raise ValueError("different texts agree in both hashes")
    return found.select("_digest")


def _first(size: str) -> list[Column]:
    """The row of a group that stays: of the smallest id, of equal ids the first one read."""
    return [F.min(F.struct(F.col("_id").isNull().alias("late"), "_id", "_place")).alias("_head"), F.count(F.lit(1)).alias(size)]


def classes(docs: DataFrame, carry: list[str] | None = None, digest: Callable[[Column], Column] = hash128) -> DataFrame:
    """The columns ``carry`` (default: all) of every row plus keep_id, group_size, kept, text_sha256.

    keep_id is the smallest doc_id of the rows with an equal text, nulls being the largest; exactly
    one row of a group is kept, also where rows repeat. A null text is empty, and equal to an empty
    one, but not to a blank one. Columns of the names added give way. An empty table gives one.
    """
    carry = docs.columns if carry is None else carry
    added = ("keep_id", "group_size", "kept", "text_sha256")
    carry = [c for c in carry if c not in added]
    doc = F.struct(F.lit(0).alias("_"), *[docs[c] for c in carry])
    texts = docs.select(doc.alias("_doc"), docs["doc_id"].alias("_id"), normalised(docs["text"]).alias("_text"))
    texts = texts.withColumn("_digest", digest(F.col("_text")))
    rows = kept(
        texts.select("_doc", "_id", "_digest", F.unhex(F.sha2("_text", 256)).alias("_sha"), F.monotonically_increasing_id().alias("_place")),
        "digests",
    )
    repeated = kept(rows.groupBy("_digest").agg(*_first("_n")).where("_n > 1"), "repeated")
    collided = _collided(texts.select("_digest", "_text"), repeated)
    groups = repeated
    if not collided.isEmpty():
        rows = left_join_skewed(rows, collided.withColumn("_split", F.lit(True)), ["_digest"])
        rows = rows.withColumn("_digest", F.when(F.col("_split"), F.concat("_digest", "_sha")).otherwise(F.col("_digest"))).drop("_split")
        groups = rows.groupBy("_digest").agg(*_first("_n")).where("_n > 1")
    joined = left_join_skewed(rows, groups, ["_digest"], "_n")
    head = F.col("_head")
    return joined.select(
        *[F.col("_doc")[c].alias(c) for c in carry],
        F.when(head.isNull(), F.col("_id")).otherwise(head["_id"]).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("bigint").alias("group_size"),
        (head.isNull() | (head["_place"] == F.col("_place"))).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, digest: Callable[[Column], Column] = hash128) -> DataFrame:
    """``docs`` with one row of every group of equal texts, as ``classes`` keeps it.

    Rows whose hash occurs once go through untouched. The others are grouped by their text itself,
    and a task sends one row of each text.
    """
    packed = docs.select(F.struct(*docs.columns).alias("_doc"), docs["doc_id"].alias("_id"), normalised(docs["text"]).alias("_text"))
    packed = packed.withColumn("_digest", digest(F.col("_text")))
    seen = packed.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n"))
    told = marked(packed, kept(seen.where("_n > 1").select("_digest"), "repeated"))
    order = F.struct(F.col("_id").isNull(), "_id", F.xxhash64("_doc"))
    first = told.where("_maybe").groupBy("_text").agg(F.min_by("_doc", order).alias("_doc"))
    rows = told.where("NOT _maybe").select("_doc").unionByName(first.select("_doc"))
    return rows.select(*[F.col("_doc")[c].alias(c) for c in docs.columns])
