"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame operations only.

Every document gets an exponential key divided by its quality weight; in order of the key, a source's documents are a
weighted sample without replacement of any length. A source first gives its complete epochs, then the documents with the
smallest keys up to the words that are left. No source is sorted as a whole: words are summed by key bucket, the prefix
sums over buckets name the one bucket in which a source's budget ends, and only that bucket is sorted by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwise.llm.common import broadcast_checked, fresh, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Marks that rarely stand in running text; their share lowers a document's quality weight.
NOISE = "0123456789#$%&*!|<>{}[]=+@^~_"
#: Documents of one source that share a key bucket, on average, at most.
BUCKET_ROWS = 512


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def quality_weight(text: Column) -> Column:
    """0.05 to 1: rises with the share of characters that are not in ``NOISE``; 1 for a null or empty text."""
    share = F.length(F.translate(text, NOISE, "")) / F.length(text)
    return F.coalesce(F.when(F.length(text) > 0, 0.05 + 0.95 * share), F.lit(1.0))


def sampling_key(seed: str, key: Column, size: Column, weight: Column) -> Column:
    """Exponential variate over ``weight``; the uniform variate is a hash of the seed, the key and the size."""
    name = F.concat_ws(":", F.lit(seed), F.coalesce(key.cast("string"), F.lit("")), size.cast("string"))
    number = F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("long")
    return -F.ln((number + 0.5) / F.lit(float(1 << 52))) / weight


def targets(totals: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """Target words of each source in ``totals(source, source_size)``: weights in source order, repeated, nulls last.

    A target above ``most`` times its source's size stops there and the excess goes to the other sources by weight. In
    order of size over weight, sources are capped up to the first one whose fair share lies below its cap.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy("ratio", "position")
    before, everything = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    given = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.col("position") % len(weights) + 1).cast("int"))
    return (
        totals.withColumn("position", F.row_number().over(order) - 1).withColumn("weight", given)
        .withColumn("limit", most * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("weight"))
        .withColumn("level", (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
                    / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
        .withColumn("place", F.row_number().over(fill))
        .withColumn("open", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("place", "level"))).over(everything))
        .select("source", "source_size", F.least("limit", F.coalesce(F.col("open.level"), F.lit(0.0)) * F.col("weight")).alias("target"))
    )


def mix(
    docs: DataFrame, weights: list[int] = [5, 2, 1], share: float = 1.5, most: float = 2.0, seed: str = "mix",  # noqa: B006
    key: str = "doc_id", text: str = "text", source: str = "source", quality: Column | None = None, carry: bool = False,
) -> DataFrame:
    """``(key, source, size, source_size, target, taken)`` per row; with ``carry`` all columns of ``docs`` and ``taken``.

    ``taken`` is the number of words that the mix takes of the row, repeats counted: complete epochs of its source, and
    the row once more where the weighted sample takes it; of the row at the end of the budget, the leading words that
    still fit. So each source gives the whole part of its target. A null text has no words; null sources form one source,
    the last; rows with equal keys are ordered by ``key`` (nulls last) and size, and rows equal in all of these are
    interchangeable. An empty table gives an empty result. ``carry`` needs no column named like a helper: helpers are kept
    in one struct column with a name that ``docs`` does not have. Reruns agree, as keys are hashes of ``seed`` and ``key``.
    """
    helper, plans, place, extra = fresh(docs, "_mix", "_plan", "_bucket", "_extra")
    of = lambda name: F.col(f"{plans}.{name}")
    own = F.struct(
        F.col(key).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
        (quality if quality is not None else quality_weight(F.col(text))).alias("weight"),
    )
    kept = [*docs.columns] if carry else []
    rows = docs.select(*kept, own.alias(helper))
    at = lambda name: F.col(f"{helper}.{name}")
    rows = rows.withColumn(helper, F.struct(
        at("id").alias("id"), at("source").alias("source"), at("size").alias("size"),
        sampling_key(seed, at("id"), at("size"), at("weight")).alias("key")))
    rows = stored(rows, "mix-rows")
    slim = rows.select(f"{helper}.*")
    totals = stored(slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "mix-sources")
    buckets = max(1, (totals.agg(F.sum("n")).first()[0] or 0) // BUCKET_ROWS)
    bucket = lambda k: F.floor((1 - F.exp(-k)) * buckets)
    aimed = targets(totals.select("source", "source_size"), weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    aimed = aimed.withColumn("epochs", epochs).withColumn(
        "rest", F.floor("target").cast("long") - F.col("epochs") * F.col("source_size"))
    summed = slim.groupBy("source", bucket(F.col("key")).alias("edge")).agg(F.sum("size").alias("words"))
    running = Window.partitionBy("source").orderBy("edge").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = summed.withColumn("before", F.sum("words").over(running) - F.col("words")).withColumnRenamed("source", "of")
    edges = aimed.join(summed, F.col("source").eqNullSafe(F.col("of")) & (F.col("before") < F.col("rest"))
                       & (F.col("rest") <= F.col("before") + F.col("words")), "left")
    plan = broadcast_checked(stored(edges.select(F.struct(
        F.col("source").alias("of"), "source_size", "target", "epochs", (F.col("rest") - F.col("before")).alias("room"),
        "edge").alias(plans)), "mix-plan"))
    met = rows.join(plan, at("source").eqNullSafe(of("of"))).withColumn(place, bucket(at("key")))
    mine = Window.partitionBy(of("of")).orderBy(at("key"), at("id").asc_nulls_last(), at("size"))
    prefix = F.sum(at("size")).over(mine.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - at("size")
    last = met.where(F.col(place) == of("edge")).withColumn(
        extra, F.greatest(F.lit(0).cast("long"), F.least(at("size"), of("room") - prefix)))
    rest = met.where(of("edge").isNull() | (F.col(place) != of("edge"))).withColumn(
        extra, F.when(F.col(place) < of("edge"), at("size")).otherwise(0).cast("long"))
    taken = (of("epochs") * at("size") + F.col(extra)).alias("taken")
    out = last.unionByName(rest)
    if carry:
        return out.select(*kept, F.struct(at("size").alias("size"), taken).alias(helper))
    return out.select(at("id").alias(key), at("source").alias("source"), at("size").alias("size"),
                      of("source_size").alias("source_size"), of("target").alias("target"), taken)


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves, whole: each row as often as ``taken`` holds its size, rounded (half a text counts)."""
    mixed = mix(docs, carry=True, **options)
    at = mixed.columns[-1]
    times = F.when(F.col(f"{at}.size") > 0, F.floor(F.col(f"{at}.taken") / F.col(f"{at}.size") + 0.5)).otherwise(0).cast("int")
    return mixed.where(times > 0).select(*docs.columns, F.explode(F.sequence(F.lit(1), times)).alias(at)).select(*docs.columns)
