"""Translation of published texts: cache probe, batches by language, failures that leave the original."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import checkpoint
from .batches import batches

TARGET = "fr"


class Provider(Protocol):
    """Gives as many texts as it gets; ``batch`` is the most it takes at once."""

    name: str
    batch: int

    def translate(self, texts: list[str], source: str) -> list[str | None]: ...


@dataclass(frozen=True)
class Identity:
    """Leaves texts as they are; the default."""

    name: str = "none"
    batch: int = 1000

    def translate(self, texts: list[str], source: str) -> list[str | None]:
        return list(texts)


@dataclass(frozen=True)
class Marking:
    """Deterministic stand-in for a service: marks each text with its language."""

    name: str = "fake"
    batch: int = 25

    def translate(self, texts: list[str], source: str) -> list[str | None]:
        return [f"[{source}>{TARGET}] {t}" for t in texts]


@dataclass(frozen=True)
class Called:
    """A service behind a callable, as for language-model, DeepL or LibreTranslate interfaces: (texts, source) -> answer.

    An answer is a list or a text that holds a JSON array.
    """

    name: str
    call: object
    batch: int = 25

    def translate(self, texts: list[str], source: str) -> list[str | None]:
        answer = self.call(texts, source)
        return read_array(answer, texts) if isinstance(answer, str) else list(answer)


def provider(name: str | None, **services: Provider) -> Provider:
    known: dict[str, Provider] = {"none": Identity(), "aucun": Identity(), "fake": Marking(), **services}
    key = (name or "none").strip().lower()
    if key not in known:
        raise ValueError(f"unknown translator {name!r}; known: {', '.join(sorted(known))}")
    return known[key]


def read_array(answer: str, originals: list[str]) -> list[str]:
    """The JSON array in an answer, fenced, bracketed or bare; blank items and arrays of another length give the originals."""
    tries = [m[1] for m in re.finditer(r"(?is)```(?:json)?\s*(.*?)```", answer)][:1]
    if 0 <= (a := answer.find("[")) < (b := answer.rfind("]")):
        tries.append(answer[a : b + 1])
    for text in [*tries, answer]:
        try:
            found = json.loads(text)
        except ValueError:
            continue
        if isinstance(found, list) and len(found) == len(originals):
            return [x if isinstance(x, str) and x.strip() else o for x, o in zip(found, originals, strict=True)]
    return list(originals)


def primary(language: Column) -> Column:
    return F.lower(F.split(language, "-")[0])


def needs_translation(language: Column) -> Column:
    return F.coalesce((language != "") & (primary(language) != TARGET), F.lit(False))


def cache_key(name: str, language: Column, text: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", F.lit(name), primary(language), text)), 1, 24)


PARALLEL = 3  # batches under way
_DONE = "language string, text string, translated string, state string, key string"


def translate_texts(texts: DataFrame, by: Provider, cache: DataFrame | None = None, parallel: int = PARALLEL) -> tuple[DataFrame, DataFrame]:
    """(language, text, translated, state) of the distinct texts to translate, and new cache rows (key, value).

    state: cache, translated, or the error's message, with the original as translation. Misses go out in batches of the
    provider's size, languages apart, all batches of a language but its last being full; so many are under way at once, and a
    failing batch fails alone. Texts of many rows are translated once, and the answers are written down at once, so that a
    service is asked once however often the results are read.
    """
    wanted = texts.where(needs_translation(F.col("language")) & (F.trim("text") != "")).select(primary(F.col("language")).alias("language"), "text").distinct()
    wanted = wanted.withColumn("key", cache_key(by.name, F.col("language"), F.col("text")))
    known = wanted.sparkSession.createDataFrame([], "key string, value string") if cache is None else cache.select("key", "value")
    probed = wanted.join(known.dropDuplicates(["key"]), "key", "left")
    hit = probed.where(F.col("value").isNotNull()).select("language", "text", F.col("value").alias("translated"), F.lit("cache").alias("state"), "key")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for language, rows in zip(frame["language"], frame["rows"], strict=True):
                originals = [r["text"] for r in rows]
                try:
                    out = [o if x is None else x for x, o in zip(by.translate(list(originals), str(language)), originals, strict=True)]
                    state = "translated"
                except Exception as e:  # a batch's failure is a result, not the job's end
                    out, state = originals, f"error: {e}"
                yield pd.DataFrame({"language": language, "text": originals, "translated": out, "state": state, "key": [r["key"] for r in rows]})

    misses = batches(probed.where(F.col("value").isNull()).select("language", "text", "key"), "language", ["text"], by.batch)
    # a partition asks for one batch at a time, so as many are under way as there are partitions
    done = checkpoint(misses.repartition(parallel).mapInPandas(run, _DONE))
    return hit.unionByName(done).drop("key"), done.where(F.col("state") == "translated").select("key", F.col("translated").alias("value"))


def translate_articles(articles: DataFrame, by: Provider, cache: DataFrame | None = None, parallel: int = PARALLEL) -> DataFrame:
    """As ``translated_articles``, for those who keep no cache."""
    return translated_articles(articles, by, cache, parallel)[0]


def translated_articles(articles: DataFrame, by: Provider, cache: DataFrame | None = None, parallel: int = PARALLEL) -> tuple[DataFrame, DataFrame | None]:
    """Adds title_original and summary_original, replaces title and summary, and tells by ``translated`` whether any changed.

    The second frame holds new cache rows (key, value), for ``CacheTables.put`` or the next run; none where nothing is asked.
    """
    rows = articles.withColumns({"title_original": F.col("title"), "summary_original": F.col("summary")})
    if by.name == "none":
        return rows.withColumn("translated", F.lit(False)), None
    texts = rows.select("language", F.col("title").alias("text")).unionByName(rows.select("language", F.col("summary").alias("text")))
    found, new = translate_texts(texts, by, cache, parallel)
    found = found.select(F.col("language").alias("l_"), F.col("text").alias("t_"), F.col("translated").alias("new_"))
    for c in ("title", "summary"):
        mine = found
        rows = rows.join(mine, (primary(F.col("language")) == F.col("l_")) & (F.col(c) == F.col("t_")), "left").withColumn(c, F.coalesce(F.nullif("new_", F.lit("")), F.col(c))).drop("l_", "t_", "new_")
    changed = ~(F.col("title").eqNullSafe(F.col("title_original")) & F.col("summary").eqNullSafe(F.col("summary_original")))
    return rows.withColumn("translated", changed), new
