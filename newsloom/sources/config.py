"""The three configuration files as tables: countries, world sources and catalogue queries, vocabularies by language."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexicon import Analyzer, Vocabulary

# The fields of the files, as their users write them.
_EDITION = "struct<langue:string,hl:string,gl:string,ceid:string>"
_SOURCE = "struct<id:string,nom:string,url:string,langue:string,poids:double,type:string,actif:boolean,note:string>"
COUNTRIES = f"struct<pays:array<struct<code:string,nom:string,region:string,poids:double,actif:boolean,editions:array<{_EDITION}>,medias:array<{_SOURCE}>>>>"
WORLD = f"struct<livres:array<{_SOURCE}>,podcasts:array<{_SOURCE}>,evenements:array<{_SOURCE}>,requetesLivres:array<{_EDITION}>,googleBooks:struct<actif:boolean,requetes:array<string>,langues:array<string>,maxParRequete:int>>"
VOCABULARY = "struct<langues:map<string,struct<nom:string,noyau:array<string>,antisemitisme:array<string>,culture:array<string>,livres:array<string>,racines:struct<noyau:array<string>,antisemitisme:array<string>>>>>"
RUBRICS = {"livres": "livre", "podcasts": "podcast", "evenements": "evenement"}


class Config(NamedTuple):
    countries: DataFrame  # ord, code, name, region, weight, active, editions, media
    world: DataFrame  # ord, id, name, url, language, weight, type, active
    book_editions: DataFrame  # ord, language, hl, gl, ceid
    book_calls: DataFrame  # query, language (null: any), most; none where the catalogue is switched off
    vocabulary: DataFrame  # language, core, hostile, culture, books, core_roots, hostile_roots

    def analyzer(self) -> Analyzer:
        """Of all vocabularies: some thousand terms at most, as each stands for a person's choice."""
        names = ("core", "hostile", "culture", "books", "core_roots", "hostile_roots")
        return Analyzer({r["language"]: Vocabulary(**{n: list(r[n] or []) for n in names}) for r in self.vocabulary.collect()})


def _file(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """The one value of a file; an unreadable file is an error when the table is read."""
    read = F.from_json("value", f"struct<j:{schema}>", {"mode": "FAILFAST"})
    return spark.read.text(f"{folder}/{name}.json", wholetext=True).select(F.concat(F.lit('{"j":'), "value", F.lit("}")).alias("value")).select(read["j"].alias("j"))


_FIELDS = {"id": "id", "name": "nom", "url": "url", "language": "langue", "weight": "poids", "type": "type", "active": "actif"}


def load(spark: SparkSession, folder: str) -> Config:
    """Reads ``europe.json``, ``monde.json`` and ``langues.json`` of a folder."""
    edition = lambda e: F.struct(e["langue"].alias("language"), *(e[k].alias(k) for k in ("hl", "gl", "ceid")))
    source = lambda s: F.struct(*(s[old].alias(new) for new, old in _FIELDS.items()))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    lands = _file(spark, folder, "europe", COUNTRIES).select(F.posexplode("j.pays").alias("ord", "p"))
    countries = lands.select("ord", "p.code", F.col("p.nom").alias("name"), "p.region", F.col("p.poids").alias("weight"), F.col("p.actif").alias("active"), F.transform(F.coalesce("p.editions", none(_EDITION)), edition).alias("editions"), F.transform(F.coalesce("p.medias", none(_SOURCE)), source).alias("media"))
    monde = _file(spark, folder, "monde", WORLD)

    def typed(group: str, kind: str) -> Column:
        return F.transform(F.coalesce(f"j.{group}", none(_SOURCE)), lambda s: s.withField("type", F.coalesce(s["type"], F.lit(kind))))

    each = [typed(group, kind) for group, kind in RUBRICS.items()]
    world = monde.select(F.posexplode(F.concat(*each)).alias("ord", "s")).select("ord", *(F.col(f"s.{old}").alias(new) for new, old in _FIELDS.items()))
    editions = monde.select(F.posexplode(F.coalesce("j.requetesLivres", none(_EDITION))).alias("ord", "e")).select("ord", F.col("e.langue").alias("language"), "e.hl", "e.gl", "e.ceid")
    asked = monde.select("j.googleBooks.*").where(F.coalesce("actif", F.lit(True)) & F.col("requetes").isNotNull())
    calls = asked.select(F.posexplode("requetes").alias("query_ord", "query"), "langues", F.coalesce("maxParRequete", F.lit(40)).alias("most"))
    calls = calls.select("query_ord", "query", F.posexplode(F.coalesce("langues", F.array(F.lit(None).cast("string")))).alias("language_ord", "language"), "most")
    words = _file(spark, folder, "langues", VOCABULARY).select(F.explode("j.langues").alias("language", "v"))
    vocabulary = words.select("language", F.col("v.noyau").alias("core"), F.col("v.antisemitisme").alias("hostile"), "v.culture", F.col("v.livres").alias("books"), F.col("v.racines.noyau").alias("core_roots"), F.col("v.racines.antisemitisme").alias("hostile_roots"))
    return Config(countries, world, editions, calls.select(F.struct("query_ord", "language_ord").alias("ord"), "query", "language", "most"), vocabulary)
