"""Per-person features of coded records, relative to each person's own dates.

Three steps, each a plain DataFrame operation:

1. *tag*   – keep the records that belong to a code list (or rule) and name the list they belong to;
2. *fold*  – reduce to one row per person, day and tag before anything is shuffled by person, so a
             person with a third of all records still becomes at most (days x tags) rows;
3. *resolve* – join the folded days to the index dates once and compute every feature in one
             aggregation on the person. Days of several record tables can be pooled for this step.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from spanwise.functions.dates import within
from spanwise.session import BROADCAST_ROW_LIMIT, broadcast_if_small, dealt, is_small
from spanwise.sources.snapshots import snapshot

PERSON = "patient_id"
#: Distinct values of a text column that are numbered as a local table at most.
SHORT_LIST = 10_000
#: Codes that a scan is told as constants at most.
FEW_CODES = 1000


@dataclass(frozen=True)
class Feature:
    """One output column.

    ``how`` is one of ``first_date last_date flag count first_value last_value last_category
    latest_day_mean latest_day``. Bounds are Columns over the index frame; both are inclusive.
    """

    name: str
    tag: str
    how: str
    lower: Column | None = None
    upper: Column | None = None


def category_labels(codelists: DataFrame, features: Sequence[Feature]) -> DataFrame | None:
    """``(category, position)`` of the lists whose category a feature returns, in sorted order.

    Records carry the 1-based position instead of the text, which keeps every aggregation buffer a number.
    """
    names = sorted({f.tag for f in features if f.how == "last_category"})
    if not names:
        return None
    listed = codelists.where(F.col("codelist").isin(*names) & F.col("category").isNotNull()).select("category").distinct()
    return listed.select("category", F.row_number().over(Window.orderBy("category")).alias("position"))


def tag_by_codelist(
    events: DataFrame, codelists: DataFrame, names: Sequence[str], prefix: str = "", labels: DataFrame | None = None
) -> DataFrame:
    """Inner join to the named lists on coding system and code.

    The tag is the list name behind ``prefix``, which keeps the tags of several record tables apart; ``category`` is the
    position of the list's category in ``labels``.
    """
    listed = codelists.where(F.col("codelist").isin(*names))
    listed = listed.withColumn("position", F.lit(None).cast("int")) if labels is None else listed.join(labels, "category", "left")
    wanted = listed.select("system", "code", F.concat(F.lit(prefix), F.col("codelist")).alias("tag"), F.col("position").alias("category"))
    # one row per list and code, so that a code listed twice does not count a record twice
    once = wanted.groupBy("system", "code", "tag").agg(F.min("category").alias("category"))
    if not is_small(wanted):
        return events.join(once, ["system", "code"])
    codes = [row.code for row in wanted.select("code").distinct().limit(FEW_CODES + 1).collect() if row.code is not None]
    if len(codes) <= FEW_CODES:  # a filter by constants goes below the joins that the records come from
        events = events.where(F.col("code").isin(codes))
    return events.join(F.broadcast(once), ["system", "code"])


def fold_rules(events: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One row per person, day and rule, with the number of records for which the rule holds.

    All rules are counted in one pass; the split into tags happens after the days are folded. Serves dates, flags and
    counts; features that return a value need a code list tag. A record for which no rule holds counts nowhere.
    """
    events = events.where(reduce(Column.__or__, rules.values()))
    counted = events.groupBy(PERSON, "event_date").agg(*[F.count_if(rule).alias(name) for name, rule in rules.items()])
    return counted.unpivot([PERSON, "event_date"], list(rules), "tag", "n").where(F.col("n") > 0)


def fold_days(tagged: DataFrame, features: Sequence[Feature]) -> DataFrame:
    """One row per person, day and tag; within a day the record id orders the records.

    All buffers are numbers or dates, so the map-side partial aggregation is a hash aggregate.
    """
    hows = {f.how for f in features}
    aggs = [F.count(F.lit(1)).alias("n")]
    if "last_category" in hows:
        aggs.append(F.max_by("category", "event_id").alias("last_category"))
    if "last_value" in hows:
        aggs.append(F.max_by("value", "event_id").alias("last_value"))
    if "first_value" in hows:
        aggs.append(F.min_by("value", "event_id").alias("first_value"))
    if hows & {"latest_day_mean", "latest_day"}:
        aggs.append(F.sum("value").alias("value_sum"))
        aggs.append(F.count("value").alias("value_n"))
    return tagged.groupBy(PERSON, "event_date", "tag").agg(*aggs)


def _bounds(features: Sequence[Feature]) -> dict[int, tuple[str, Column]]:
    """Window bounds by Column object, each with a column name; a bound shared by features appears once."""
    named: dict[int, tuple[str, Column]] = {}
    for bound in (b for f in features for b in (f.lower, f.upper) if b is not None):
        named.setdefault(id(bound), (f"_bound_{len(named)}", bound))
    return named


def _aggregate(f: Feature, bounds: Mapping[int, tuple[str, Column]]) -> Column:
    tag = f.tag.replace("'", "\\'")
    match = f"tag = '{tag}'"
    if f.lower is not None:
        match += f" AND event_date >= {bounds[id(f.lower)][0]}"
    if f.upper is not None:
        match += f" AND event_date <= {bounds[id(f.upper)][0]}"
    day = f"CASE WHEN {match} THEN event_date END"
    measured = f"CASE WHEN {match} AND value_n > 0 THEN event_date END"
    by_how = {
        "first_date": f"min({day})",
        "last_date": f"max({day})",
        "flag": f"bool_or({match})",
        "count": f"sum(CASE WHEN {match} THEN n END)",
        # one row per day and tag, so the day alone orders these
        "first_value": f"min_by(first_value, {day})",
        "last_value": f"max_by(last_value, {day})",
        "latest_day_mean": f"max_by(try_divide(value_sum, cast(value_n as double)), {measured})",
        "latest_day": f"max({measured})",
        "last_category": f"max_by(last_category, {day})",
    }
    if f.how not in by_how:
        raise ValueError(f"unknown feature kind {f.how}")
    return F.expr(by_how[f.how]).alias(f.name)


def _with_labels(found: DataFrame, features: Sequence[Feature], labels: DataFrame | None) -> DataFrame:
    """Category positions replaced by their texts."""
    named = [f.name for f in features if f.how == "last_category"]
    if not named or labels is None:
        return found.withColumns({name: F.lit(None).cast("string") for name in named})
    small = is_small(labels)
    for name in named:
        text = labels.select(F.col("position").alias("_position"), F.col("category").alias("_category"))
        found = found.join(F.broadcast(text) if small else text, F.col(name) == F.col("_position"), "left").withColumn(
            name, F.col("_category")).drop("_position", "_category")
    return found


def pool(*days: DataFrame) -> DataFrame:
    """Folded days of several record tables in one frame, so that one join and one aggregation serve them all."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), days)


def found(index: DataFrame, days: DataFrame, features: Sequence[Feature], labels: DataFrame | None = None, tasks: int | None = None) -> DataFrame:
    """Features of the people of ``index`` that have at least one folded day.

    Window bounds are computed once per person, before the join. All features share one hash aggregation, so the record
    tables are read once. Many days are dealt to ``tasks`` tasks; the people of a task are held for the join, its days are not sorted.
    """
    bounds = _bounds(features)
    slim = index.select(PERSON, *[bound.alias(name) for name, bound in bounds.values()])
    own = days.where(F.col("tag").isin(*sorted({f.tag for f in features})))
    if tasks is not None:
        slim, own = slim.hint("shuffle_hash"), dealt(own, tasks, PERSON)
    return _with_labels(slim.join(own, PERSON).groupBy(PERSON).agg(*[_aggregate(f, bounds) for f in features]), features, labels)


@dataclass(frozen=True)
class Reach:
    """What the windows of an index frame can reach: days as constants, and the people if they are few."""

    days: list[tuple[date | None, date | None]]
    people: DataFrame | None

    def on(self, group: int = 0) -> Column:
        """Whether some window of the features of ``group`` may hold the day of a record: plain comparisons with constants."""
        lower, upper = self.days[group]
        sides = [] if lower is None else [F.col("event_date") >= F.lit(lower)]
        sides += [] if upper is None else [F.col("event_date") <= F.lit(upper)]
        return reduce(Column.__and__, sides, F.lit(True))

    def cut(self, events: DataFrame, group: int = 0, wanted: Column | None = None) -> DataFrame:
        """The records that some window of the features of ``group`` may hold, or those that are ``wanted``.

        The scan applies the comparisons; a semi join leaves out other people's records before anything is folded.
        """
        events = events.where(self.on(group) if wanted is None else wanted)
        return events if self.people is None else events.join(F.broadcast(self.people), PERSON, "left_semi")


def reach(index: DataFrame, *groups: Sequence[Feature]) -> Reach:
    """One short job over the index: the number of people and the widest window of each group of features.

    A feature without a bound leaves its side open; nobody with a known bound leaves no day to read. People are handed
    on only when they are counted as few, and their keys are numbers.
    """
    sides = [(side, [getattr(f, side) for f in features]) for features in groups for side in ("lower", "upper")]
    known = [(side, bounds) if bounds and all(b is not None for b in bounds) else None for side, bounds in sides]
    widest = {"lower": lambda b: F.min(b), "upper": lambda b: F.max(b)}
    one = {"lower": F.least, "upper": F.greatest}
    aggs = [widest[k[0]](k[1][0] if len(k[1]) == 1 else one[k[0]](*k[1])) if k else F.lit(None) for k in known]
    row = index.agg(F.count(F.lit(1)).alias("people"), *[a.alias(f"b{i}") for i, a in enumerate(aggs)]).first()
    none = {"lower": date(9999, 12, 31), "upper": date(1000, 1, 1)}  # before and after all records
    found = [None if k is None else row[f"b{i}"] or none[k[0]] for i, k in enumerate(known)]
    few = row["people"] <= BROADCAST_ROW_LIMIT and isinstance(index.schema[PERSON].dataType, NumericType)
    return Reach(list(zip(found[::2], found[1::2])), index.select(PERSON) if few else None)


def with_defaults(df: DataFrame, features: Sequence[Feature]) -> DataFrame:
    """Flags of people without records are false, counts 0."""
    defaults = {"flag": F.lit(False), "count": F.lit(0).cast("bigint")}
    return df.withColumns({f.name: F.coalesce(F.col(f.name), defaults[f.how]) for f in features if f.how in defaults})


def resolve(index: DataFrame, days: DataFrame, features: Sequence[Feature], labels: DataFrame | None = None) -> DataFrame:
    """Every person of ``index`` with all features."""
    joined = index.select(PERSON).join(found(index, days, features, labels), PERSON, "left")
    return with_defaults(joined, features).select(PERSON, *[f.name for f in features])


def coded_features(index: DataFrame, events: DataFrame, codelists: DataFrame, features: Sequence[Feature]) -> DataFrame:
    """Features of coded records: ``tag`` names the code list."""
    labels = category_labels(codelists, features)
    events = reach(index, features).cut(events)
    tagged = tag_by_codelist(events, codelists, sorted({f.tag for f in features}), labels=labels)
    return resolve(index, fold_days(tagged, features), features, labels)


def rule_features(
    index: DataFrame, events: DataFrame, rules: Mapping[str, Column], features: Sequence[Feature]
) -> DataFrame:
    """Features of records picked by predicates: ``tag`` names the rule."""
    used = {f.tag for f in features}
    events = reach(index, features).cut(events)
    return resolve(index, fold_rules(events, {name: rule for name, rule in rules.items() if name in used}), features)


def matching(events: DataFrame, codelists: DataFrame, name: str) -> DataFrame:
    """Records whose code is on the list (semi join)."""
    codes = codelists.where(F.col("codelist") == name).select("system", "code")
    return events.join(broadcast_if_small(codes), ["system", "code"], "left_semi")


def unmatched(events: DataFrame, codelists: DataFrame, name: str) -> DataFrame:
    """Records whose code is on no such list (anti join)."""
    codes = codelists.where(F.col("codelist") == name).select("system", "code")
    return events.join(broadcast_if_small(codes), ["system", "code"], "left_anti")


def first_dose(vaccinations: DataFrame, start: Column, end: Column, match: Column | None = None) -> DataFrame:
    """First matching record of each person in ``[start, end]``."""
    doses = vaccinations.where(within(F.col("event_date"), start, end))
    if match is not None:
        doses = doses.where(match)
    return doses.groupBy(PERSON).agg(F.min("event_date").alias("dose_1"))


def next_dose(vaccinations: DataFrame, previous: DataFrame, gap_days: int, end: Column, match: Column | None = None) -> DataFrame:
    """First matching record at least ``gap_days`` after the previous result, which is kept beside it."""
    doses = vaccinations if match is None else vaccinations.where(match)
    days = doses.groupBy(PERSON, "event_date").agg(F.count(F.lit(1)).alias("n"))
    later = (
        previous.select(PERSON, "dose_1")
        .join(days, PERSON)
        .where(within(F.col("event_date"), F.date_add("dose_1", gap_days), end))
        .groupBy(PERSON)
        .agg(F.min("event_date").alias("dose_2"))
    )
    return previous.join(later, PERSON, "left")


def dose_answers(
    vaccinations: DataFrame, codelists: DataFrame, name: str, start: Column, end: Column, gap_days: int, flag: str,
    tasks: int | None = None,
) -> DataFrame:
    """``first_dose``, ``next_dose`` and whether any record carries ``flag``, from one pass over the records.

    Doses are records on the list ``name``; the flag counts on every record. People without a first dose are left out.
    Many records are dealt to ``tasks`` tasks.
    """
    codes = codelists.where(F.col("codelist") == name).select("system", "code").distinct().withColumn("given", F.lit(True))
    marked = vaccinations.join(broadcast_if_small(codes), ["system", "code"], "left")
    days = dealt(marked, tasks, PERSON, "event_date").groupBy(PERSON, "event_date").agg(F.bool_or("given").alias("given"), F.bool_or(flag).alias(flag))
    on = F.col("event_date")
    first = F.min(F.when(F.col("given") & within(on, start, end), on)).over(Window.partitionBy(PERSON))  # at most one row per day
    later = F.when(F.col("given") & within(on, F.date_add("dose_1", gap_days), end), on)
    return dealt(days, tasks, PERSON).withColumn("dose_1", first).where(F.col("dose_1").isNotNull()).groupBy(PERSON).agg(
        F.min("dose_1").alias("dose_1"), F.min(later).alias("dose_2"), F.coalesce(F.bool_or(flag), F.lit(False)).alias(flag))


def record_flag(records: DataFrame, flag: Column, name: str) -> DataFrame:
    """People with at least one record that carries the flag."""
    return records.groupBy(PERSON).agg(F.coalesce(F.bool_or(flag), F.lit(False)).alias(name))


def positions(records: DataFrame, column: str) -> DataFrame | None:
    """``(value, position)`` of the distinct values of a text column, numbered in their order; None for a column of numbers.

    Aggregations over positions keep numbers in their buffers and run as hash aggregates. A short list becomes a local
    table; a longer one is sorted by ranges and stored, so that its numbers stay the same.
    """
    if not isinstance(records.schema[column].dataType, StringType):
        return None
    values = records.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    head = values.limit(SHORT_LIST + 1).toArrow().column("value").to_pylist()
    if len(head) > SHORT_LIST:
        return snapshot(values.orderBy("value").withColumn("position", F.monotonically_increasing_id()), "positions")
    rows = [(value, i) for i, value in enumerate(sorted(head, key=str.encode))]  # as Spark orders text
    return F.broadcast(records.sparkSession.createDataFrame(rows, "value string, position long"))


def to_positions(df: DataFrame, column: str, listed: DataFrame | None) -> DataFrame:
    """``column`` replaced by its position; unknown stays unknown."""
    if listed is None:
        return df
    numbered = listed.select(F.col("value").alias("_value"), F.col("position").alias("_position"))
    return df.join(numbered, F.col(column) == F.col("_value"), "left").withColumn(column, F.col("_position")).drop("_value", "_position")


def from_positions(df: DataFrame, column: str, listed: DataFrame | None) -> DataFrame:
    """The text for each position in ``column``."""
    if listed is None:
        return df
    named = listed.select(F.col("value").alias("_value"), F.col("position").alias("_position"))
    return df.join(named, F.col(column) == F.col("_position"), "left").withColumn(column, F.col("_value")).drop("_value", "_position")


def most_frequent_code(records: DataFrame, code: str, name: str, tasks: int | None = None) -> DataFrame:
    """Most frequent code of each person; the larger code wins a tie. Many records are dealt to ``tasks`` tasks."""
    listed = positions(records, code)
    coded = dealt(records.where(F.col(code).isNotNull()), tasks, PERSON, code)
    counts = coded.groupBy(PERSON, code).agg(F.count(F.lit(1)).alias("n"))
    # one exchange by person serves both: the largest code of each count, then the code of the largest count
    people = to_positions(counts, code, listed)
    people = people.repartition(PERSON) if tasks is None else people.repartition(tasks, PERSON)
    largest = people.groupBy(PERSON, "n").agg(F.max(code).alias(code))
    return from_positions(largest.groupBy(PERSON).agg(F.max_by(code, "n").alias(name)), name, listed)


def join_all(base: DataFrame, *parts: DataFrame) -> DataFrame:
    """Left join of one-row-per-person parts on the person key."""
    return reduce(lambda left, right: left.join(right, PERSON, "left"), parts, base)
