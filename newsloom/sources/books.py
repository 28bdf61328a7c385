"""Book catalogues: request plan, and volumes from raw JSON answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.dates import published_date, volume_in_window
from ..operators.report import first_by

ENDPOINT = "https://www.googleapis.com/books/v1/volumes"
MOST = 40
VOLUMES = "items array<struct<id:string, volumeInfo:struct<title:string, subtitle:string, authors:array<string>, publisher:string, publishedDate:string, description:string, categories:array<string>, language:string, canonicalVolumeLink:string, infoLink:string, imageLinks:struct<thumbnail:string, smallThumbnail:string>, industryIdentifiers:array<struct<type:string, identifier:string>>, pageCount:int>>>"


def requests(queries: DataFrame, languages: DataFrame, most: int = MOST) -> DataFrame:
    """Every query in every language: query, language, url; both tables are short lists of the configuration."""
    url = F.concat(F.lit(f"{ENDPOINT}?q="), F.url_encode("query"), F.lit(f"&orderBy=newest&printType=books&maxResults={min(MOST, most)}"), F.coalesce(F.concat(F.lit("&langRestrict="), F.col("language")), F.lit("")))
    return queries.crossJoin(F.broadcast(languages)).select("query", "language", url.alias("url"))


def volumes(answers: DataFrame, start: Column, end: Column, body: str = "body") -> DataFrame:
    """Articles from answers with ord, query, language and a JSON body: with a link, in the window, the first of each volume.

    Unreadable answers give no rows.
    """
    some = lambda c: F.nullif(c, F.lit(""))
    rows = answers.withColumn("j_", F.from_json(F.col(body), VOLUMES)).select("ord", "query", F.col("language").alias("asked"), F.posexplode("j_.items").alias("place", "v"))
    i = F.col("v.volumeInfo")
    isbn = F.get(F.filter(i["industryIdentifiers"], lambda x: x["type"].isin("ISBN_13", "ISBN_10")), 0)["identifier"]
    when = published_date(i["publishedDate"])
    image = F.coalesce(some(i["imageLinks"]["thumbnail"]), some(i["imageLinks"]["smallThumbnail"]))
    link = F.coalesce(some(i["canonicalVolumeLink"]), some(i["infoLink"]))
    out = rows.select(
        F.struct("ord", "place").alias("ord"), F.concat(F.lit("google-books::"), F.col("v.id")).alias("id"), F.coalesce(some(F.concat_ws(" — ", some(i["title"]), some(i["subtitle"]))), F.lit("(sans titre)")).alias("title"), link.alias("link"), link.alias("canonical"), F.col("v.id").alias("guid"), when["date"].alias("date"), when["precision"].alias("date_precision"),
        T.excerpt(i["description"], 400).alias("summary"), some(F.array_join(i["authors"], ", ")).alias("author"), F.regexp_replace(image, "^http:", "https:").alias("image"), F.coalesce(i["categories"], F.array().cast("array<string>")).alias("categories"), F.coalesce(some(i["language"]), F.col("asked")).alias("language"), i["publisher"].alias("publisher"), isbn.alias("isbn"), i["pageCount"].alias("pages"), F.lit(None).cast("string").alias("country"),
        F.lit("google-books").alias("feed_id"), F.lit("Google Books").alias("feed_name"), F.lit("google-books").alias("origin"), F.lit(1.5).alias("weight"), F.lit("livre").alias("forced_type"), F.lit("livres").alias("profile"), "query",
    )
    kept = out.where((F.coalesce("link", F.lit("")) != "") & volume_in_window(F.col("date"), F.col("date_precision"), start, end))
    return first_by(kept, "guid")


def call_report(answers: DataFrame, found: DataFrame) -> DataFrame:
    """One row for each call of ``answers`` (ord, query, language, body, error): id, name, url, origin, status, error, total, kept.

    ``total`` counts the volumes of the answer, ``kept`` those of ``found`` (by ``volumes``) that this call was the first to bring. A
    call that failed or whose answer cannot be read keeps its row, with nothing in it.
    """
    blank = F.trim(F.coalesce("body", F.lit(""))) == ""
    read = F.from_json("body", "struct<items:array<struct<id:string>>, odd_:string>", {"columnNameOfCorruptRecord": "odd_"})
    calls = answers.withColumn("j_", read).withColumn("error", F.coalesce("error", F.when(~blank & (F.col("j_").isNull() | F.col("j_.odd_").isNotNull()), "unreadable JSON")))
    first = found.groupBy(F.col("ord.ord").alias("of_")).agg(F.count("*").alias("new_"))
    in_words = F.concat(F.lit("Google Books — "), F.col("query"), F.coalesce(F.concat(F.lit(" ("), F.col("language"), F.lit(")")), F.lit("")))
    ok = F.col("error").isNull()
    total = F.when(ok, F.size(F.coalesce("j_.items", F.array().cast("array<struct<id:string>>")))).otherwise(0)
    return calls.join(first, F.col("ord") == F.col("of_"), "left").select(
        "ord", F.concat_ws(":", F.lit("google-books"), "query", F.coalesce("language", F.lit("toutes"))).alias("id"), in_words.alias("name"), F.lit(ENDPOINT).alias("url"), F.lit("google-books").alias("origin"),
        F.when(ok, "ok").otherwise("echec").alias("status"), "error", total.cast("long").alias("total"), F.when(ok, F.coalesce("new_", F.lit(0))).otherwise(0).cast("long").alias("kept"),
    )
