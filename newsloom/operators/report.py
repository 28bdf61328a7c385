"""Feeds and reports: one feed for each URL, first volumes, collection counters, run statistics, silent countries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dedupe_feeds(feeds: DataFrame) -> DataFrame:
    """Of each URL the feed of the greatest weight (ties: the first), at the place of the URL's first feed."""
    columns = [c for c in feeds.columns if c != "ord"]
    best = F.struct((-F.col("weight")).alias("w"), F.col("ord").alias("o"))
    return feeds.groupBy("url").agg(F.min_by(F.struct(*(c for c in columns if c != "url")), best).alias("f"), F.min("ord").alias("ord")).select("url", "f.*", "ord").select(*columns, "ord")


def first_by(rows: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """The first row of each key; a key of many rows is reduced before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(key, "r.*").select(*rows.columns)


def collection_report(items: DataFrame, feed: str, link: str, date: str, start: Column, end: Column) -> DataFrame:
    """Per feed: total (with a link), kept, out_of_window, undated."""
    linked = F.coalesce(F.col(link), F.lit("")) != ""
    late = F.col(date).isNotNull() & ~F.col(date).between(start, end + F.make_dt_interval(days=F.lit(1)))
    n = F.count_if
    return items.groupBy(feed).agg(n(linked).alias("total"), n(linked & ~late).alias("kept"), n(linked & late).alias("out_of_window"), n(linked & F.col(date).isNull()).alias("undated"))


def run_stats(report: DataFrame) -> DataFrame:
    """One row: sources asked, answered, failed, and articles kept. Needs status and kept."""
    failed = F.col("status") == "echec"
    return report.agg(F.count("*").alias("sources"), F.count_if(~failed).alias("answered"), F.count_if(failed).alias("failed"), F.sum(F.coalesce("kept", F.lit(0))).cast("long").alias("collected"))


def silent(wanted: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Wanted groups without any result; none where there is no result at all."""
    some = seen.select(F.lit(1).alias("some_")).limit(1)
    return wanted.join(seen.select(key).distinct(), key, "left_anti").join(F.broadcast(some), how="cross").drop("some_")


def needed_relevance(rows: DataFrame, least: float = 3.0) -> DataFrame:
    """Articles of media, of book catalogues or of typed sources stay; others need the score."""
    exempt = F.col("origin").isin("media", "google-books") | (F.coalesce("forced_type", F.lit("")) != "")
    return rows.where(exempt | (F.col("relevance") >= least))


def dashboard(feeds: DataFrame) -> DataFrame:
    """Feeds of each country in French order of its name, world feeds by rubric, with their numbers."""
    place = F.coalesce("country_name", F.col("forced_type"), F.lit("monde"))
    return feeds.groupBy(place.alias("place")).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("name")).alias("names")).orderBy(F.collate("place", "fr"))


def ordered_distinct(rows: DataFrame, column: str, order: str = "ord") -> DataFrame:
    """Distinct values in order of first appearance."""
    return rows.where(F.col(column).isNotNull()).groupBy(column).agg(F.min(order).alias(order)).orderBy(order, column)
