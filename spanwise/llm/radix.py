"""Exact copies by distributed MSD radix partitioning: equality is settled on the bytes themselves, without a digest.

All texts begin in one group. A round splits every open group by the next bytes of its texts (the digit); a text that ends
inside the digit is apart from those that go on. Groups of one text leave, groups whose texts have ended are groups of
copies, all others go to the next round. Digits get longer round by round, so long texts take few rounds. Groups are
counted by a hash aggregation that combines within each task first, so a group with a third of all rows meets as one row per
task; a row finds its group again by a join in which large groups can be split. After the first round only the texts that
share its digit are read on, and each of their bytes once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.llm.common import broadcast_checked, stored
from spanwise.session import scratch_path

#: Bytes of the first digit, how much longer each next one is, and the longest.
FIRST, TIMES, WIDEST = 64, 64, 1 << 20
#: Numbers of rows to read on that are broadcast at most; beyond, every text moves once, to meet the rows that are read on.
ROWS = 1_000_000


def digits(longest: int) -> list[tuple[int, int]]:
    """Start and width of the digits that cover a text of ``longest`` bytes; one at least."""
    out, start, width = [], 0, FIRST
    while not out or start < longest:
        out.append((start, width))
        start, width = start + width, min(width * TIMES, WIDEST)
    return out


def _groups(rows: DataFrame) -> DataFrame:
    """The groups of two rows or more that a digit makes, with their size, first row and largest key."""
    found = rows.groupBy("group", "digit", "ended").agg(
        F.count(F.lit(1)).alias("n"), F.min("row").alias("into"), F.max("id").alias("last"))
    return stored(found.where("n > 1"), "radix-groups")


def _split(docs: DataFrame, key: str, text: str, own: list[Column]) -> tuple[DataFrame, DataFrame]:
    """All rows, numbered and stored, and ``(row, group_size, last, stays)`` of those that have copies."""
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit("")).cast("binary")
    base = stored(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), whole.alias("whole"),
        F.substring(whole, 1, FIRST).alias("digit"), F.octet_length(whole).alias("size"), *([F.struct(*own).alias("own")] if own else [])), "radix-rows")
    longest = base.agg(F.max("size")).first()[0] or 0
    places = digits(longest)
    now = base.select("row", "id", "digit", F.lit(0).cast("long").alias("group"), (F.col("size") <= FIRST).alias("ended"))
    settled = base.select("row", "id", F.lit(None).cast("long").alias("group_size"), F.col("id").alias("last"), F.col("row").alias("into")).limit(0)
    for level in range(len(places)):
        groups = _groups(now)
        if groups.isEmpty():
            break
        met = stored(now.join(groups, ["group", "digit", "ended"]).select("row", "id", "ended", "n", "into", "last"), "radix-met")
        settled = settled.unionByName(met.where("ended").select("row", "id", F.col("n").alias("group_size"), "last", "into"))
        going = met.where("NOT ended").select("row", "id", F.col("into").alias("group"))
        if level + 1 == len(places) or going.isEmpty():
            break
        if not level:  # the texts that are read on, cut into digits once; the first of them know their group already
            pieces = scratch_path(spark, "radix-pieces")
            cut = F.explode(F.filter(F.array(*(
                F.struct(F.lit(i).alias("level"), F.lit(s).alias("start"), F.lit(w).alias("width"))
                for i, (s, w) in enumerate(places) if i)), lambda p: p["start"] < F.col("size")))
            base.select("row", "whole", "size").join(broadcast_checked(going, ROWS), "row").select("*", cut.alias("p")).select(
                "row", "id", "group", "p.level", F.expr("substring(whole, p.start + 1, p.width)").alias("digit"),
                F.expr("size <= p.start + p.width").alias("ended")).write.partitionBy("level").parquet(pieces)
        now = spark.read.schema(going.select("row", "id", "group", F.lit(b"").alias("digit"), F.lit(True).alias("ended")).schema).parquet(
            f"{pieces}/level={level + 1}")
        if level:
            now = stored(now.drop("id", "group").join(broadcast_checked(going, ROWS), "row"), "radix-now")
    stay = settled.where(F.col("id").eqNullSafe(F.col("last"))).groupBy("into").agg(F.min("row").alias("row"))
    return base, settled.drop("id", "into").join(stay.select("row", F.lit(True).alias("stays")), "row", "left")


def exact_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", own: list[Column] | None = None) -> DataFrame:
    """``(key, keep_id, group_size, kept)`` of every row of ``docs``, then the Columns ``own``, computed on its rows.

    Rows belong together when their texts are equal byte for byte; a null text is empty. Of a group the row with the largest
    key stays (null is the smallest; of rows equal in key and text one stays), ``keep_id`` is its key. Other columns are read
    for ``own`` only; an empty table gives an empty result.
    """
    own = own or []
    base, copies = _split(docs, key, text, own)
    rows = base.select("row", "id", *(["own"] if own else [])).join(copies, "row", "left")
    single = F.col("group_size").isNull()
    return rows.select(
        F.col("id").alias(key), F.when(single, F.col("id")).otherwise(F.col("last")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), (single | F.col("stays").isNotNull()).alias("kept"),
        *(["own.*"] if own else []))


def without_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    base, copies = _split(docs, key, text, [F.col(c) for c in docs.columns])
    return base.join(copies.where("stays IS NULL").select("row"), "row", "left_anti").select("own.*")
