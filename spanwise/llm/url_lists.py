"""URL filters by temporal list join: dated list entries become validity intervals, captures are judged as of their fetch time.

An entry adds or removes a host, a domain with all its subdomains, or a path prefix at a time. Per listed name the entries
in order of time give intervals in which it is listed. A capture is looked up by the few names that its URL answers to,
and keeps those whose interval holds its fetch time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanwise.llm.common import broadcast_checked, stored

#: Kinds of entries, from the most special to the most general: the first listed one gives the reason.
KINDS = ("prefix", "host", "domain")
ENDLESS = "9999-12-31 00:00:00"


def url_host(url: Column) -> Column:
    """Lower-cased host without user and port; NULL where there is no host."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.when(F.length(host) > 0, F.regexp_replace(host, r"\.+$", ""))


def url_path(url: Column) -> Column:
    """Path without query and fragment, ``/`` if empty."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)", 1)
    return F.when(F.length(path) > 0, path).otherwise(F.lit("/"))


def url_names(url: Column) -> Column:
    """``array<struct<kind, name>>``: everything a URL may be listed as, one per label of the host and step of the path."""
    host, steps = url_host(url), F.filter(F.split(url_path(url), "/"), lambda s: s != "")
    labels = F.split(host, r"\.")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.struct(
        F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), n), "/")).alias("name")))
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.struct(
        F.lit("domain").alias("kind"), F.array_join(F.slice(labels, n, F.size(labels)), ".").alias("name")))
    return F.when(host.isNotNull(), F.array_distinct(F.concat(prefixes, F.array(F.struct(F.lit("host").alias("kind"), host.alias("name"))), domains)))


def list_name(kind: Column, value: Column) -> Column:
    """The name of an entry's value as ``url_names`` writes it."""
    plain = F.trim(value)
    host = F.lower(F.regexp_extract(plain, r"^([^/?#:]*)", 1))
    steps = F.filter(F.split(F.regexp_extract(plain, r"^[^/?#]*(/[^?#]*)", 1), "/"), lambda s: s != "")
    return F.when(kind == "prefix", F.concat(host, F.lit("/"), F.array_join(steps, "/"))).otherwise(F.regexp_replace(host, r"\.+$", ""))


def validity(entries: DataFrame) -> DataFrame:
    """``(list, kind, name, valid_from, valid_to)`` of ``entries(list, kind, value, at, action)``; the end is not included.

    Entries with a null time, value or action, or of another kind, show nothing. Of several at one time a removal wins.
    Repeated additions or removals change nothing. Changes are folded to one per name and time before they are put in
    order, so that a name with very many repeated entries is as short as its distinct times.
    """
    usable = entries.where(F.col("at").isNotNull() & F.col("action").isin("add", "remove") & F.col("kind").isin(*KINDS)
                           & (F.length(F.trim("value")) > 0))
    folded = usable.groupBy("list", "kind", list_name(F.col("kind"), F.col("value")).alias("name"), F.col("at").alias("valid_from")).agg(
        F.min(F.when(F.col("action") == "remove", 0).otherwise(1)).alias("listed"))
    order = Window.partitionBy("list", "kind", "name").orderBy("valid_from")
    changes = folded.withColumn("before", F.lag("listed", 1, 0).over(order)).where(F.col("listed") != F.col("before"))
    ends = changes.withColumn("valid_to", F.coalesce(F.lead("valid_from").over(order), F.lit(ENDLESS).cast(entries.schema["at"].dataType)))
    return ends.where("listed = 1").select("list", "kind", "name", "valid_from", "valid_to")


def judge(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", fetched: str = "fetched") -> DataFrame:
    """``(key, url, fetched, allowed, hits, list, kind, name)`` per capture; list, kind and name of the most special entry.

    A capture is allowed if no entry on any list was active when it was fetched. ``hits`` counts the active ones. A null or
    unusable URL or a null time is on no list, so the capture is allowed. Repeated captures are judged once and returned
    as often as they stand. Ties go to the smaller kind in ``KINDS`` order, longer name, then name and list. An empty
    table of captures gives no rows, one of entries allows all. Only the columns named are read.
    """
    rows = captures.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(fetched).alias("_at"))
    spans = stored(validity(entries), "url-lists").withColumnRenamed("kind", "of_kind").withColumnRenamed("name", "of_name")
    distinct = rows.where(F.col("_url").isNotNull() & F.col("_at").isNotNull()).select("_url", "_at").distinct()
    looked_up = distinct.select("_url", "_at", F.explode(url_names(F.col("_url"))).alias("n")).select("_url", "_at", "n.kind", "n.name")
    met = looked_up.join(broadcast_checked(spans), (F.col("kind") == F.col("of_kind")) & (F.col("name") == F.col("of_name"))
                         & (F.col("valid_from") <= F.col("_at")) & (F.col("_at") < F.col("valid_to")))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    found = met.groupBy(F.col("_url").alias("on_url"), F.col("_at").alias("on_at")).agg(
        F.count(F.lit(1)).alias("hits"),
        F.min(F.struct(rank.alias("rank"), (-F.length("name")).alias("length"), "name", "list", "kind")).alias("best"))
    return rows.join(found, (F.col("_url") == F.col("on_url")) & (F.col("_at") == F.col("on_at")), "left").select(
        F.col("_key").alias(key), F.col("_url").alias(url), F.col("_at").alias(fetched), F.col("hits").isNull().alias("allowed"),
        F.coalesce("hits", F.lit(0)).alias("hits"), F.col("best.list").alias("list"), F.col("best.kind").alias("kind"), F.col("best.name").alias("name"))


def captures_of(pages: DataFrame) -> DataFrame:
    """``pages`` as captures: fetched on one of 360 days and minutes of 2024 that follow from the page's id."""
    minute = F.pmod(F.col("page_id") * 7919, F.lit(360 * 1440))
    return pages.select("page_id", "url", F.timestamp_add("MINUTE", minute, F.lit("2024-01-01").cast("timestamp_ntz")).alias("fetched"))


def entries_of(pages: DataFrame) -> DataFrame:
    """Dated list entries that follow from ``pages``: of every seventh page its host, domain or first path step, added or removed."""
    rows = pages.where(F.col("page_id") % 7 == 0).withColumn("turn", (F.col("page_id") / 7).cast("long"))
    host, steps = url_host(F.col("url")), F.filter(F.split(url_path(F.col("url")), "/"), lambda s: s != "")
    labels = F.split(host, r"\.")
    kind = F.element_at(F.array(F.lit("prefix"), F.lit("prefix"), F.lit("host"), F.lit("domain")), (F.pmod("turn", F.lit(4)) + 1).cast("int"))
    value = F.when(F.col("kind") == "host", host).when(F.col("kind") == "domain", F.array_join(F.slice(labels, -3, 3), ".")).otherwise(
        F.concat(host, F.lit("/"), F.array_join(F.slice(steps, 1, 2), "/")))
    day = F.pmod(F.col("turn") * 37, F.lit(360))
    return rows.where(host.isNotNull() & (F.size(labels) >= 3)).withColumn("kind", kind).select(
        F.when(F.pmod("turn", F.lit(3)) == 0, "spam").otherwise("adult").alias("list"), "kind", value.alias("value"),
        F.timestamp_add("DAY", day, F.lit("2024-01-01").cast("timestamp_ntz")).alias("at"),
        F.when(F.pmod("turn", F.lit(5)) < 2, "remove").otherwise("add").alias("action"))
