"""Scores of stories, places in sections, the front page and routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PER_COUNTRY, FRONT_PAGE, FRONT_ROUNDS = 6, 8, 3
RUBRICS = {"livre": 25, "podcast": 10, "evenement": 12}


def round_half_up(x: Column, digits: int = 2) -> Column:
    scale = float(10**digits)
    return F.floor(x * scale + 0.5).cast("double") / scale


def cluster_score(relevance: Column, weight: Column, size: Column, age_days: Column, span_days: Column, has_image: Column, has_summary: Column, is_media: Column) -> Column:
    """Undated stories count as three days old, a window as one day at least; a weight of zero or null counts as one."""
    w = F.when(F.coalesce(weight, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(weight)
    fresh = F.greatest(F.lit(0.0), 1 - F.coalesce(age_days, F.lit(3.0)) / F.greatest(F.lit(1.0), span_days))
    bonus = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0.0))
    return 1.2 * F.least(F.coalesce(relevance, F.lit(0.0)), F.lit(12.0)) + 1.5 * w + 1.6 * F.least(size - 1, F.lit(4)) + 2.0 * fresh + bonus(has_image, 0.3) + bonus(has_summary, 0.4) + bonus(is_media, 0.6)


def top_per(rows: DataFrame, group: str, k: int, score: str = "score", order: str = "ord") -> DataFrame:
    """The k best of each group with their ``rank``; Spark limits each partition before it shuffles."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(order)))).where(F.col("rank") <= k)


def section_order(rows: DataFrame, group: str = "country", name: str = "name", score: str = "score") -> DataFrame:
    """(group, name, top, n, section_rank): sections by their best score, then by French collation of the name.

    There is one row for each country, which one task numbers.
    """
    tops = rows.groupBy(group, name).agg(F.max(score).alias("top"), F.count("*").alias("n"))
    return tops.withColumn("section_rank", F.row_number().over(Window.orderBy(F.col("top").desc(), F.collate(F.col(name), "fr"), F.col(group))))


def front_page(ranked: DataFrame, limit: int = FRONT_PAGE) -> DataFrame:
    """The sections' first, then second, then third stories, in order of sections; needs rank and section_rank."""
    return ranked.where(F.col("rank") <= FRONT_ROUNDS).orderBy("rank", "section_rank").limit(limit)


def route(rows: DataFrame, forced: str = "forced_type", kind: str = "type", country: str = "country") -> DataFrame:
    """Each story once for every section it belongs to. A type forced by the source decides alone; a story with a country
    goes to its country, and to the books as well if it is about one; others go by type, and news without a country is not published."""
    own = F.when(F.col(forced).isin("livre", "podcast", "evenement", "actualite"), F.array(F.col(forced)))
    local = F.when(F.col(country).isNotNull(), F.when(F.col(kind) == "livre", F.array(F.lit("pays"), F.lit("livre"))).otherwise(F.array(F.lit("pays"))))
    other = F.array(F.when(F.col(kind).isin(*RUBRICS), F.col(kind)).otherwise("actualite"))
    return rows.withColumn("section", F.explode(F.coalesce(own, local, other)))


def rubric(routed: DataFrame, name: str) -> DataFrame:
    return routed.where(F.col("section") == name).orderBy(F.col("score").desc(), "ord").limit(RUBRICS[name])


def rubrics(routed: DataFrame) -> DataFrame:
    """The best of all of those sections, as ``rubric`` gives them one by one, from one pass over the stories."""
    most = F.coalesce(*(F.when(F.col("section") == name, n) for name, n in RUBRICS.items()))
    return top_per(routed.where(F.col("section").isin(*RUBRICS)), "section", max(RUBRICS.values())).where(F.col("rank") <= most).drop("rank")


def published_entry(stories: DataFrame) -> DataFrame:
    """Score to two places, the first six other publishers, their number, an ISO date and its precision."""
    others = F.slice(F.col("publishers"), 2, 1_000_000)
    return stories.withColumns({"score": round_half_up(F.coalesce("score", F.lit(0.0))), "reprises": F.slice(others, 1, 6), "n_reprises": F.size(others).cast("long"), "date_iso": F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "date_precision": F.when(F.col("date").isNotNull(), "jour")})
