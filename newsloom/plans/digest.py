"""The whole digest: articles in, published sections out, each step an ordinary DataFrame step."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions.lexicon import Analyzer
from ..operators import dedupe, rank, report
from ..operators.translate import Identity, Provider, translated_articles
from ..runtime import Progress, checkpoint
from ..sources.tables import CacheTables


@dataclass(frozen=True)
class Options:
    now: dt.datetime
    window: D.Window
    least_relevance: float = 3.0
    per_country: int = rank.PER_COUNTRY
    front_page: int = rank.FRONT_PAGE
    rubrics: dict[str, int] = field(default_factory=lambda: dict(rank.RUBRICS))


def scored(articles: DataFrame, analyzer: Analyzer, options: Options) -> DataFrame:
    """In the window, with link, relevance, motifs, type and tags."""
    inside = articles.where((F.coalesce("link", F.lit("")) != "") & D.within(F.col("date"), F.lit(options.window.start), F.lit(options.window.end)))
    return analyzer.annotated(inside)


def annotated(articles: DataFrame, analyzer: Analyzer, options: Options) -> DataFrame:
    """As ``scored``; irrelevant ones are gone."""
    return report.needed_relevance(scored(articles, analyzer, options), options.least_relevance)


def stories(rows: DataFrame, analyzer: Analyzer, options: Options) -> DataFrame:
    """Clusters with representative, publishers, size and score."""
    best = dedupe.representatives(dedupe.clusters(rows, analyzer.generic))
    span = (options.window.end - options.window.start).total_seconds() / 86400
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    score = rank.cluster_score(F.col("relevance"), F.col("weight"), F.col("size"), D.days_between(F.lit(options.now), F.col("date")), F.lit(max(1.0, span)), has("image"), has("summary"), F.col("origin") == "media")
    return checkpoint(best.withColumn("score", score).withColumn("order_", F.struct("cluster_country", "cluster")))


def digest(articles: DataFrame, countries: DataFrame, feeds_report: DataFrame, analyzer: Analyzer, options: Options, translator: Provider | None = None, cache: CacheTables | None = None, progress: Progress | None = None) -> dict:
    """The published digest as a dict of bounded lists. ``countries``: code, name, region of those wanted.

    With a cache, texts that it holds under ``translations`` are not asked for, and new answers become its next version.
    """
    progress = progress or Progress(articles.sparkSession, None)
    with progress.stage("analyse"):
        inside = checkpoint(scored(articles, analyzer, options))
        kept = report.needed_relevance(inside, options.least_relevance)
        rejected = inside.count() - kept.count()
    with progress.stage("dedoublonnage"):
        found = stories(kept, analyzer, options)
    routed = rank.route(found)
    local = routed.where(F.col("section") == "pays").join(F.broadcast(countries.select(F.col("code").alias("country"), "name", "region")), "country")
    sections = rank.section_order(local)
    top = rank.top_per(local, "country", options.per_country, order="order_").join(sections.select("country", "section_rank"), "country")
    parts = top.select("*").withColumn("place", F.lit("pays"))
    for name, limit in options.rubrics.items():
        part = routed.where(F.col("section") == name).orderBy(F.col("score").desc(), "order_").limit(limit)
        parts = parts.unionByName(part.withColumn("place", F.lit(name)), allowMissingColumns=True)
    by = translator or Identity()
    with progress.stage("traduction"):
        entries, new = translated_articles(rank.published_entry(checkpoint(parts)), by, cache.read("translations") if cache else None)
        if cache and new is not None:
            cache.put("translations", new.withColumn("fetched_at", F.lit(None).cast("timestamp")))
        published = entries.orderBy("place", "section_rank", "rank", F.col("score").desc(), "order_")
    fields = ("title", "title_original", "summary", "summary_original", "translated", "link", "publisher", "author", "date_iso", "date_precision", "language", "image", "audio", "tags", "type", "country", "score", "reprises", "n_reprises", "name", "region", "rank", "section_rank", "place")
    rows = [r.asDict(recursive=True) for r in published.select(*fields).collect()]  # at most per_country for each country, and the rubrics' limits
    lands: dict[str, dict] = {}
    for r in (r for r in rows if r["place"] == "pays"):
        lands.setdefault(r["country"], {"code": r["country"], "name": r["name"], "region": r["region"], "articles": []})["articles"].append(r)
    front = sorted((r for r in rows if r["place"] == "pays" and r["rank"] <= rank.FRONT_ROUNDS), key=lambda r: (r["rank"], r["section_rank"]))[: options.front_page]
    quiet = report.silent(countries.select(F.col("code").alias("country"), "name"), found.where(F.col("country").isNotNull()), "country").orderBy(F.collate("name", "fr"))
    stats = report.run_stats(feeds_report).first().asDict()
    meta = {"edition": D.edition_slug(options.window.start), "range": D.format_range(options.window.start, options.window.end), "generated": options.now.isoformat(), "stories": found.count(), "countries": len(lands), "rejected": rejected, "translator": by.name, **stats}
    return {"meta": meta, "front_page": front, "countries": list(lands.values()), "livres": [r for r in rows if r["place"] == "livre"], "podcasts": [r for r in rows if r["place"] == "podcast"], "evenements": [r for r in rows if r["place"] == "evenement"], "silent": [r["name"] for r in quiet.collect()], "report": [r.asDict() for r in feeds_report.collect()]}
