"""Shards along a Hilbert curve over document metadata, with DataFrame operations only.

Language, source and size are quantised and woven into one Hilbert index; documents are ordered by it and the order is cut
into runs of near equal bytes. Documents that lie close in all three stay together, so the minima and maxima of a shard's
files are narrow in every dimension and a reader can skip most files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwise.llm.common import broadcast_checked, stored

DIMENSIONS = 3
#: Rows of one range of the order, which one task numbers.
RANGE_ROWS = 1_000_000
#: A cut inside a group of equal texts moves to the group's nearer end if that changes a shard by this share at most.
SLACK = 0.05


def _rotations(n: int = DIMENSIONS) -> tuple[list[int], list[int]]:
    """Entry corner and direction of each sub-cube in Gray-code order."""
    gray = lambda i: i ^ i >> 1
    ones = lambda i: (~i & i + 1).bit_length() - 1
    entry = [0 if w == 0 else gray(2 * ((w - 1) // 2)) for w in range(1 << n)]
    turn = [0 if w == 0 else ones(w if w % 2 else w - 1) % n for w in range(1 << n)]
    return entry, turn


def hilbert_index(dims: list[Column], bits: int) -> Column:
    """Position on the Hilbert curve of a point whose coordinates have ``bits`` bits each."""
    n = len(dims)
    entry, turn = (F.array(*(F.lit(v) for v in values)) for values in _rotations(n))
    full = (1 << n) - 1

    def rotated(value: Column, by: Column, left: bool) -> Column:
        there, back = (F.shiftleft, F.shiftright) if left else (F.shiftright, F.shiftleft)
        turns = [there(value, k).bitwiseOR(back(value, n - k)).bitwiseAND(F.lit(full)) for k in range(n)]
        return F.element_at(F.array(*turns), (by % n + 1).cast("int"))

    def step(state: Column, corner: Column) -> Column:
        by = state["d"] + 1
        turned = rotated(corner.bitwiseXOR(state["e"]), by, left=False)
        place = reduce(lambda w, k: w.bitwiseXOR(F.shiftright(turned, k)), range(1, n), turned)
        item = (place + 1).cast("int")
        return F.struct(
            (state["h"] * (1 << n) + place).alias("h"),
            state["e"].bitwiseXOR(rotated(F.element_at(entry, item), by, left=True)).alias("e"),
            ((state["d"] + F.element_at(turn, item) + 1) % n).cast("int").alias("d"),
        )

    corners = [
        reduce(lambda a, b: a.bitwiseOR(b), (
            F.shiftleft(F.shiftright(d.cast("int"), bit).bitwiseAND(F.lit(1)), i) for i, d in enumerate(dims)))
        for bit in range(bits - 1, -1, -1)
    ]
    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).alias("e"), F.lit(0).alias("d"))
    return F.aggregate(F.array(*corners), start, step, lambda state: state["h"])


def _levels(rows: DataFrame, name: str, bits: int) -> DataFrame:
    """Each distinct value of a column with its rank scaled to ``bits`` bits; null is the last."""
    values = rows.select(F.col(name).alias(f"{name}_of")).distinct()
    rank = F.row_number().over(Window.orderBy(F.col(f"{name}_of").asc_nulls_last())) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy())
    return broadcast_checked(stored(values.select(f"{name}_of", F.when(n <= 1 << bits, rank).otherwise(
        F.floor(rank * (1 << bits) / n)).cast("int").alias(f"{name}_level")), f"shard-{name}"))


def hilbert_shards(
    docs: DataFrame, shards: int = 40, bits: int = 5, key: str = "doc_id", text: str = "text", lang: str = "lang",
    source: str = "source", carry: bool = False,
) -> DataFrame:
    """``(key, size, text_crc32, hilbert, shard, slot)`` per row; with ``carry`` the columns of ``docs``, then shard and slot
    (in place of columns of these names).

    ``size`` is the text's UTF-8 bytes plus 16. Shards are runs of the curve with near equal bytes (a row belongs to the
    shard that holds its middle byte); ``slot`` numbers a shard's rows from 0 without gaps. Copies of a text take the
    place of the smallest language and source among them, and so lie side by side; a cut moves to the end of such a group
    where a shard's bytes hardly change. A null text counts as no bytes; null languages and sources rank last; equal rows
    get neighbouring slots in any order; an empty table gives an empty result. Places are computed on a few numbers per
    row; ``carry`` joins them to the rows once, by key and text, where rows equal in both share out their places.
    """
    slim = stored(docs.select(
        F.col(key).alias("id"), (F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("crc"), F.xxhash64(text).alias("same"),
        F.col(lang).alias("lang"), F.col(source).alias("source")), "shard-rows")
    levels = {name: _levels(slim, name, bits) for name in ("lang", "source")}
    level = slim.groupBy("same", "size").agg(F.min("lang").alias("lang"), F.min("source").alias("source"))
    for name, ranks in levels.items():
        level = level.join(ranks, F.col(name).eqNullSafe(F.col(f"{name}_of")))
    classes = F.least(F.lit((1 << bits) - 1), F.floor(1.5 * F.log2(F.col("size") / 16)).cast("int"))
    placed = level.select("same", "size", hilbert_index([F.col("lang_level"), F.col("source_level"), classes], bits).alias("h"))
    met = slim.select("id", "size", "crc", "same").join(placed, ["same", "size"])
    order = [F.col("h"), F.col("same"), F.col("id").asc_nulls_last()]
    counted = slim.agg(F.count(F.lit(1)), F.sum("size")).first()
    total = counted[1] or 1
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-counted[0] // RANGE_ROWS))
    ranged = stored(met.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "shard-ranged")
    sums = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = broadcast_checked(stored(sums.select("part", *(
        F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"first_{c}") for c in ("n", "bytes"))), "shard-starts"))
    mine = Window.partitionBy("part").orderBy(*order)
    ranked = stored(ranged.join(starts, "part").select(
        "id", "size", "crc", "same", "h", (F.col("first_n") + F.row_number().over(mine) - 1).alias("rank"),
        (F.col("first_bytes") + F.sum("size").over(mine.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("before")), "shard-ranked")
    cuts = _cuts(ranked, total, shards)
    middle = F.col("before") + F.col("size") / 2
    number = reduce(lambda a, b: a + b, ((middle >= c).cast("int") for c in cuts), F.lit(0))
    out = ranked.withColumn("shard", number)
    firsts = F.broadcast(out.groupBy("shard").agg(F.min("rank").alias("first")))  # one row per shard
    out = out.join(firsts, "shard").withColumn("slot", F.col("rank") - F.col("first"))
    if not carry:
        return out.select(F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), F.col("h").alias("hilbert"), "shard", "slot")
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    places = out.groupBy(name(F.col("id")).alias("of"), F.col("same").alias("of_same")).agg(F.sort_array(F.collect_list(F.struct("shard", "slot"))).alias("places"))
    places = places.select(F.struct("of", "of_same", "places").alias("_place"))
    place = "_place"
    while place in docs.columns:
        place += "_"
    places = places.withColumnRenamed("_place", place)
    rows = docs.join(places, (name(docs[key]) == F.col(f"{place}.of")) & (F.xxhash64(docs[text]) == F.col(f"{place}.of_same")))
    again = Window.partitionBy(f"{place}.of", f"{place}.of_same").orderBy(f"{place}.of")
    kept = [docs[c] for c in docs.columns]
    own = F.get(F.col(f"{place}.places"), F.row_number().over(again) - 1)
    rows = rows.select(*kept, own.alias(place))
    return rows.select(*[F.col(c) for c in docs.columns if c not in ("shard", "slot")], F.col(f"{place}.shard").alias("shard"), F.col(f"{place}.slot").alias("slot"))


def _cuts(ranked: DataFrame, total: int, shards: int) -> list[float]:
    """Positions of the cuts in bytes: even ones, moved out of groups of equal texts where that is cheap. One per shard."""
    cell = lambda c: F.floor(c * shards / total)
    hit = ranked.where(cell(F.col("before")) != cell(F.col("before") + F.col("size"))).select("h", "same").distinct()
    groups = ranked.join(F.broadcast(hit), ["h", "same"]).groupBy("h", "same").agg(  # at most one group per cut
        F.min("before").alias("start"), F.max(F.col("before") + F.col("size")).alias("end")).collect()
    cuts = []
    for k in range(1, shards):
        cut = k * total / shards
        ends = [e for g in groups if g.start < cut < g.end for e in (g.start, g.end) if abs(e - cut) <= SLACK * total / shards]
        cuts.append(min(ends, key=lambda e: abs(e - cut)) if ends else cut)
    return cuts


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """The documents as Parquet below ``path``, a folder per shard, rows in curve order."""
    placed = hilbert_shards(docs, carry=True, **options)
    placed.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
