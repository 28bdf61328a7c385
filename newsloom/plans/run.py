"""A whole run: configuration, plan, landing over a cache, articles and volumes, digest, translation over a cache."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators.translate import Identity, Provider
from ..runtime import Progress, checkpoint
from ..sources import books, feeds, landing, plan
from ..sources.config import Config
from ..sources.tables import CacheTables, key_of
from .digest import Options, digest

KEPT_DAYS = 7  # of landed feeds in the cache


@dataclass(frozen=True)
class Scope:
    """What is asked: profiles, country codes (none: all active), and which kinds of sources."""

    profiles: tuple[str, ...] = ("actualite", "antisemitisme")
    codes: tuple[str, ...] = ()
    search: bool = True
    media: bool = True
    catalogue: bool = True
    parallel: int = landing.PARALLEL
    retries: int = landing.RETRIES
    fetch: landing.Fetch = field(default=landing.http_get)
    landed: DataFrame | None = None  # url, status, body, error of feeds that were asked before: then nobody is


def feeds_of(config: Config, scope: Scope, days: float) -> DataFrame:
    """The plan: feeds of the countries and of the world, one for each URL."""
    codes = list(scope.codes) or None
    parts = []
    if scope.search or scope.media:
        parts.append(plan.country_feeds(config.countries, config.vocabulary, list(scope.profiles), days, codes, scope.search, scope.media))
    parts.append(plan.world_feeds(config.world, config.book_editions if scope.search else None, config.vocabulary, days))
    return plan.feed_plan(*parts)


def _landed(urls: DataFrame, scope: Scope, cache: CacheTables | None, namespace: str) -> DataFrame:
    """Rows of distinct URLs with their state, asked with the cache's validators; new answers become the cache's next version."""
    if scope.landed is not None:
        known = scope.landed.select("url", "status", "body", "error")
        got = urls.select("url").distinct().join(known, "url", "left")
        return landing.status_of(got.withColumn("error", F.when(F.col("status").isNull() & F.col("body").isNull(), F.coalesce("error", F.lit("not landed"))).otherwise(F.col("error"))))
    old = cache.read(namespace) if cache else None
    got = landing.status_of(landing.land(urls, old, scope.fetch, scope.parallel, scope.retries))
    if cache:
        good = got.where(F.col("error").isNull() & F.col("body").isNotNull())
        cache.put(namespace, good.select(key_of(F.col("url")).alias("key"), "url", "etag", "last_modified", "body", "fetched_at"))
    return got


def collected(config: Config, scope: Scope, window: D.Window, days: float, cache: CacheTables | None = None) -> tuple[DataFrame, DataFrame]:
    """Articles of all feeds, and a report: name, url, origin, status, state, error, total, kept, out_of_window, undated."""
    listed = feeds_of(config, scope, days).withColumnsRenamed({"ord": "feed_ord", "name": "feed_name", "language": "feed_language"})
    got = _landed(listed.select("url"), scope, cache, "http")
    parsed = checkpoint(feeds.parse_feeds(listed.join(got.select("url", "body", "state", F.col("error").alias("refused")), "url")))
    articles = feeds.articles(parsed.where("refused IS NULL"))
    late = F.col("date").isNotNull() & ~F.col("date").between(F.lit(window.start), F.lit(window.end) + F.make_dt_interval(days=F.lit(1)))
    linked = F.coalesce(F.col("link"), F.lit("")) != ""
    n = F.count_if
    counts = articles.groupBy(F.col("ord.feed_ord").alias("of_")).agg(n(linked).alias("total"), n(linked & ~late).alias("kept"), n(linked & late).alias("out_of_window"), n(linked & F.col("date").isNull()).alias("undated"))
    error = F.coalesce("refused", "error")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    report = parsed.join(counts, F.col("feed_ord") == F.col("of_"), "left").select(F.col("feed_name").alias("name"), "url", "origin", F.when(error.isNotNull(), "echec").otherwise(F.col("state")).alias("state"), F.when(error.isNotNull(), "echec").otherwise("ok").alias("status"), error.alias("error"), *(zero(c) for c in ("total", "kept", "out_of_window", "undated")))
    return articles, report


def catalogue(config: Config, scope: Scope, window: D.Window) -> tuple[DataFrame, DataFrame]:
    """Volumes as articles, and a report row for each call; calls go one by one, as the service asks."""
    url = F.concat(F.lit(f"{books.ENDPOINT}?q="), F.url_encode("query"), F.lit("&orderBy=newest&printType=books&maxResults="), F.least("most", F.lit(books.MOST)).cast("string"), F.coalesce(F.concat(F.lit("&langRestrict="), F.col("language")), F.lit("")))
    calls = checkpoint(config.book_calls.withColumn("url", url))
    one_by_one = Scope(parallel=1, retries=3, fetch=scope.fetch)
    answers = calls.join(_landed(calls.select("url"), one_by_one, None, "").select("url", "body", "error"), "url")
    found = checkpoint(books.volumes(answers, F.lit(window.start), F.lit(window.end)))
    report = books.call_report(answers, found)
    return found, report.select("name", "url", "origin", F.when(F.col("status") == "ok", "ok").otherwise("echec").alias("state"), "status", "error", "total", "kept", F.lit(0).cast("long").alias("out_of_window"), F.lit(0).cast("long").alias("undated"))


def revue(spark: SparkSession, config: Config, scope: Scope, options: Options, translator: Provider | None = None, cache: CacheTables | None = None, hook: Callable[[str, int, int], None] | None = None) -> dict:
    """The digest of a run, with its report; ``hook`` hears of each stage's tasks.

    A feed that fails is a line of the report. Landed feeds older than ``KEPT_DAYS`` leave the cache first; answers of the translator
    enter it under their key for the next run.
    """
    progress = Progress(spark, hook)
    days = max(1.0, -(-(options.window.end - options.window.start).total_seconds() // 86400))
    if cache and cache.read("http") is not None:
        cache.prune("http", options.now - dt.timedelta(days=KEPT_DAYS))
    with progress.stage("collecte"):
        articles, report = collected(config, scope, options.window, days, cache)
        articles, report = checkpoint(articles), checkpoint(report)
    if scope.catalogue:
        with progress.stage("livres"):
            volumes, calls = catalogue(config, scope, options.window)
            lead = articles.schema["ord"].dataType.simpleString()
            none = F.lit(None)
            # volumes come after all items, in the order of their calls
            last = F.named_struct(F.lit("feed_ord"), F.named_struct(*(x for k, v in zip("abcd", (9, F.col("ord.ord.query_ord"), F.col("ord.ord.language_ord"), 0), strict=True) for x in (F.lit(k), v if not isinstance(v, int) else F.lit(v)))), F.lit("item_ord"), F.col("ord.place"))
            as_articles = volumes.withColumn("ord", last.cast(lead)).withColumn("audio", none.cast(articles.schema["audio"].dataType))
            articles = checkpoint(articles.unionByName(as_articles.drop("isbn", "pages", "query"), allowMissingColumns=True))
            report = checkpoint(report.unionByName(calls))
    wanted = plan.wanted_countries(config.countries, list(scope.codes) or None).select("code", "name", "region")
    return digest(articles, wanted, report, config.analyzer(), options, translator or Identity(), cache, progress)
