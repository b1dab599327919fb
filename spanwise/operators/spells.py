"""Records that are valid over a period: registrations and addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.functions.dates import within
from spanwise.operators.features import PERSON, from_positions, positions, to_positions
from spanwise.session import dealt


def covers(on: Column, start: str = "start_date", end: str = "end_date") -> Column:
    """Half-open validity ``start <= on < end``; an open end never closes."""
    return (F.col(start) <= on) & (F.col(end).isNull() | (F.col(end) > on))


def registered_as_of(index: DataFrame, spells: DataFrame, on: Column) -> DataFrame:
    """People of ``index`` with a spell covering their date.

    Spells are first folded to the longest one per start day, which answers the question as well and
    keeps a person with very many spells small.
    """
    longest = spells.groupBy(PERSON, "start_date").agg(
        F.max("end_date").alias("end_date"), F.bool_or(F.col("end_date").isNull()).alias("open")
    ).select(PERSON, "start_date", F.when(~F.col("open"), F.col("end_date")).alias("end_date"))
    held = index.select(PERSON, on.alias("as_of")).join(longest, PERSON).where(covers(F.col("as_of")))
    return index.join(held.select(PERSON).distinct(), PERSON, "left_semi")


def attribute_as_of(index: DataFrame, spells: DataFrame, on: Column, attribute: str, name: str, tasks: int | None = None) -> DataFrame:
    """Attribute of the covering spell, for people who have one; the latest start wins, then the larger spell id.

    Texts travel as positions in a list of them, and spell ids are numbers, so every step is a hash aggregate. Many spells
    are dealt to ``tasks`` tasks.
    """
    listed = positions(spells, attribute)
    numbered = to_positions(spells.select(PERSON, "spell_id", "start_date", "end_date", attribute), attribute, listed)
    last = [F.max_by(attribute, "spell_id").alias(attribute), F.max("spell_id").alias("spell_id")]
    slim = dealt(dealt(numbered, tasks, PERSON, "start_date").groupBy(PERSON, "start_date", "end_date").agg(*last), tasks, PERSON)
    held = index.select(PERSON, on.alias("as_of")).join(slim, PERSON).where(covers(F.col("as_of")))
    # the join has dealt the rows by person, which serves both: the last spell of each start, then the latest start
    started = held.groupBy(PERSON, "start_date").agg(*last)
    return from_positions(started.groupBy(PERSON).agg(F.max_by(attribute, "start_date").alias(name)), name, listed)


def deregistration_date(index: DataFrame, spells: DataFrame, lower: Column, upper: Column, name: str) -> DataFrame:
    """Last end date of people who have no open spell left, if it lies in the window."""
    ends = spells.groupBy(PERSON).agg(
        F.max("end_date").alias("left_on"), F.bool_or(F.col("end_date").isNull()).alias("still_open")
    )
    left = F.when(~F.col("still_open") & within(F.col("left_on"), lower, upper), F.col("left_on"))
    return index.join(ends, PERSON).select(PERSON, left.alias(name))


def registration_answers(
    index: DataFrame, spells: DataFrame, registered_on: Column, on: Column, attribute: str, left_from: Column, left_to: Column, left: str,
    tasks: int | None = None,
) -> DataFrame:
    """``registered_as_of``, ``attribute_as_of`` and ``deregistration_date`` from one pass over the spells.

    People registered on ``registered_on``, with all columns of ``index``, the attribute of the spell that covers ``on``
    (NULL without one) and the date they left (column ``left``). Many spells are dealt to ``tasks`` tasks.
    """
    listed = positions(spells, attribute)
    numbered = to_positions(spells.select(PERSON, "spell_id", "start_date", "end_date", attribute), attribute, listed)
    last = [F.max_by(attribute, "spell_id").alias(attribute), F.max("spell_id").alias("spell_id")]
    slim = dealt(dealt(numbered, tasks, PERSON, "start_date").groupBy(PERSON, "start_date", "end_date").agg(*last), tasks, PERSON)
    # a spell without dates still says whether its person has left
    asked = index.select(PERSON, registered_on.alias("held_on"), on.alias("as_of"), left_from.alias("left_from"), left_to.alias("left_to"))
    met = asked.join(slim, PERSON).select(
        "*", covers(F.col("held_on")).alias("held"), F.when(covers(F.col("as_of")), F.col("start_date")).alias("covering"))
    # the join has dealt the rows by person: spells that cover the date are settled start by start, then the person as a whole
    known = ["held_on", "left_from", "left_to"]
    started = met.groupBy(PERSON, "covering").agg(
        F.max_by(attribute, "spell_id").alias(attribute), F.bool_or("held").alias("held"), F.max("end_date").alias("left_on"),
        F.bool_or(F.col("end_date").isNull()).alias("still_open"), *[F.first(c).alias(c) for c in known])
    answers = started.groupBy(PERSON).agg(
        F.max_by(attribute, "covering").alias(attribute), F.bool_or("held").alias("held"), F.max("left_on").alias("left_on"),
        F.bool_or("still_open").alias("still_open"), *[F.first(c).alias(c) for c in known])
    gone = F.when(~F.col("still_open") & within(F.col("left_on"), F.col("left_from"), F.col("left_to")), F.col("left_on"))
    found = answers.where("held").select(PERSON, attribute, gone.alias(left))
    return index.join(from_positions(found, attribute, listed), PERSON)
