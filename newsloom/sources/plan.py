"""Feed plan from configuration tables: search feeds for countries and profiles, listed media, world feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.report import dedupe_feeds

FEED = "https://news.google.com/rss/search"
PAGE = "https://news.google.com/search"
# label, first and second group of terms
PROFILES = {"actualite": ("actualité communautaire", "core", None), "antisemitisme": ("antisémitisme et mémoire", "hostile", None), "culture": ("culture et vie intellectuelle", "core", "culture"), "livres": ("parutions", "core", "books")}
_COLUMNS = ("feed_id", "name", "url", "language", "origin", "profile", "forced_type", "weight", "country", "country_name", "region")


def load(spark, folder: str, name: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(f"{folder}/{name}.json")


def build_query(a: Column, b: Column | None, days: float | None) -> Column:
    """(x OR "y z") (u OR v) when:Nd; an empty second group and no days leave their parts out."""
    group = lambda g: F.concat(F.lit("("), F.array_join(F.transform(g, lambda t: F.when(t.rlike(r"\s"), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(t)), " OR "), F.lit(")"))
    second = F.lit("") if b is None else F.when(F.size(F.coalesce(b, F.array().cast("array<string>"))) > 0, F.concat(F.lit(" "), group(b))).otherwise("")
    return F.concat(group(a), second, F.lit(f" when:{max(1, -int(-days // 1))}d" if days else ""))


def search_url(query: Column, hl: Column, gl: Column, ceid: Column, base: str = FEED) -> Column:
    return F.concat(F.lit(f"{base}?q="), F.url_encode(query), F.lit("&hl="), F.url_encode(hl), F.lit("&gl="), F.url_encode(gl), F.lit("&ceid="), F.url_encode(ceid))


def wanted_countries(countries: DataFrame, codes: list[str] | None = None) -> DataFrame:
    """Those asked for by code, active or not; without a list, the active ones."""
    if codes:
        return countries.where(F.col("code").isin([c.strip().upper() for c in codes]))
    return countries.where(F.coalesce("active", F.lit(True)))


def country_feeds(countries: DataFrame, vocabulary: DataFrame, profiles: list[str], days: float | None, codes: list[str] | None = None, search: bool = True, media: bool = True) -> DataFrame:
    """Feeds of the wanted countries. ``countries``: ord, code, name, region, weight, active, editions (language, hl, gl, ceid), media
    (id, name, url, language, weight, type, active). ``vocabulary``: language, core, hostile, culture, books.

    An unknown profile is an error at once, an unknown language of an edition one when the plan is read.
    """
    if unknown := [p for p in profiles if p not in PROFILES]:
        raise ValueError(f"unknown profile: {', '.join(unknown)}; known: {', '.join(PROFILES)}")
    rows = wanted_countries(countries, codes)
    parts: list[DataFrame] = []
    if search:
        each = rows.select("*", F.posexplode("editions").alias("edition_ord", "e")).join(F.broadcast(vocabulary), F.col("e.language") == vocabulary["language"], "left")
        for k, p in enumerate(profiles):
            label, a, b = PROFILES[p]
            known = F.when(F.col(a).isNull(), F.raise_error(F.concat(F.lit("no vocabulary for language "), F.col("e.language"))).cast("array<string>")).otherwise(F.col(a))
            query = build_query(known, F.col(b) if b else None, days)
            parts.append(each.where(F.size(F.coalesce(F.col(a), F.array(F.lit("?")))) > 0).select(F.struct(F.col("ord").alias("a"), F.lit(0).alias("b"), F.col("edition_ord").alias("c"), F.lit(k).alias("d")).alias("ord"), F.concat_ws("-", F.lit("gn"), F.lower("code"), F.col("e.language"), F.lit(p)).alias("feed_id"), F.concat(F.lit("Google News "), F.col("name"), F.lit(f" — {label}")).alias("name"), search_url(query, F.col("e.hl"), F.col("e.gl"), F.col("e.ceid")).alias("url"), F.col("e.language").alias("language"), F.lit("google-news").alias("origin"), F.lit(p).alias("profile"), F.lit("livre" if p == "livres" else None).cast("string").alias("forced_type"), F.coalesce("weight", F.lit(1.5)).alias("weight"), F.col("code").alias("country"), F.col("name").alias("country_name"), "region"))
    if media:
        m = rows.select("*", F.posexplode("media").alias("media_ord", "m")).where(F.coalesce("m.active", F.lit(True)))
        parts.append(m.select(F.struct(F.col("ord").alias("a"), F.lit(1).alias("b"), F.col("media_ord").alias("c"), F.lit(0).alias("d")).alias("ord"), F.col("m.id").alias("feed_id"), F.col("m.name").alias("name"), F.col("m.url").alias("url"), F.col("m.language").alias("language"), F.lit("media").alias("origin"), F.lit(None).cast("string").alias("profile"), F.col("m.type").alias("forced_type"), F.coalesce("m.weight", F.col("weight"), F.lit(1.5)).alias("weight"), F.col("code").alias("country"), F.col("name").alias("country_name"), "region"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def world_feeds(sources: DataFrame, book_editions: DataFrame | None, vocabulary: DataFrame, days: float | None) -> DataFrame:
    """Active world sources (ord, id, name, url, language, weight, type, active), and searches for books in known languages; unknown ones are passed over."""
    none = lambda *names: {n: F.lit(None).cast("string") for n in names}
    place = lambda b: F.struct(F.col("ord").alias("a"), F.lit(b).alias("b"), F.lit(0).alias("c"), F.lit(0).alias("d")).alias("ord")
    out = sources.where(F.coalesce("active", F.lit(True))).select(place(2), F.col("id").alias("feed_id"), "name", "url", "language", F.lit("monde").alias("origin"), F.col("type").alias("forced_type"), F.coalesce("weight", F.lit(1.5)).alias("weight")).withColumns(none("profile", "country", "country_name", "region"))
    if book_editions is None:
        return out
    e = book_editions.join(F.broadcast(vocabulary), "language")
    books = e.select(place(3), F.concat(F.lit("gn-livres-"), F.col("language")).alias("feed_id"), F.concat(F.lit("Google News parutions "), F.col("language")).alias("name"), search_url(build_query(F.col("core"), F.col("books"), days), F.col("hl"), F.col("gl"), F.col("ceid")).alias("url"), "language", F.lit("google-news").alias("origin"), F.lit("livre").alias("forced_type"), F.lit(1.5).alias("weight"), F.lit("livres").alias("profile")).withColumns(none("country", "country_name", "region"))
    return out.unionByName(books)


def feed_plan(*feeds: DataFrame) -> DataFrame:
    """All feeds, one for each URL."""
    out = feeds[0].select("ord", *_COLUMNS)
    for f in feeds[1:]:
        out = out.unionByName(f.select("ord", *_COLUMNS))
    return dedupe_feeds(out)
