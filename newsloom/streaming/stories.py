"""Stories over a stream: each batch of articles meets the founders so far, and the table of groups goes on from version to version.

An article joins the group of its link, a new group the earliest founder of its block whose title shares its subject, or it becomes
one; as in a batch, members attract nobody. If articles arrive in the order of ``ord`` and all have links, or none has, the result
is that of one run over all of them. Only founders are kept for comparison; with ``keep_days`` those leave that are older than
that by the latest date seen, while undated ones, which no watermark can reach, stay apart from that rule and never leave.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedupe
from ..runtime import checkpoint
from ..sources.tables import CacheTables, key_of

_NAMESPACE = "groups"


class Stories:
    """State and results under a shared folder. Needs ord, canonical, title, country and date of each article."""

    def __init__(self, spark: SparkSession, path: str, generic: list[str] | tuple[str, ...] = (), keep_days: float | None = None):
        self.spark, self.path, self.generic, self.keep_days = spark, path.rstrip("/"), list(generic), keep_days
        self.tables = CacheTables(spark, f"{self.path}/state")

    def write(self, stream: DataFrame):
        """A stream writer, to be started; a batch that is told twice, as after a failure, counts once."""
        return stream.writeStream.foreachBatch(self.take).option("checkpointLocation", f"{self.path}/checkpoint")

    def assigned(self) -> DataFrame:
        """ord, group_ord, cluster (the founding group), cluster_country, batch of all articles so far."""
        return self.spark.read.parquet(f"{self.path}/assigned")

    def take(self, rows: DataFrame, batch: int) -> None:
        """One batch: its results are written first, under its number; then the state of groups names it."""
        known = self.tables.read(_NAMESPACE)
        if known is not None and (known.agg(F.max("batch")).first()[0] or -1) >= batch:
            return
        new = checkpoint(rows.select("ord", "canonical", "title", F.coalesce("country", F.lit(dedupe.WORLD)).alias("block"), "date"))
        if known is None:
            old_links = new.limit(0).select("canonical", F.lit(None).cast("long").alias("group_ord"), F.lit(None).cast("long").alias("cluster"), F.col("block").alias("cluster_country"))
            met = new.limit(0).select("ord", "canonical")
            fresh = new
        else:
            old_links = known.where(F.coalesce("canonical", F.lit("")) != "").select("canonical", "group_ord", "cluster", "cluster_country")
            met = new.join(old_links, "canonical").select("ord", "group_ord", "cluster", "cluster_country")
            fresh = new.join(old_links.select("canonical"), "canonical", "left_anti")
        grouped = checkpoint(dedupe.link_groups(fresh))
        lead = grouped.where(F.col("ord") == F.col("group_ord.ord"))
        prints = checkpoint(dedupe.fingerprints(lead).select("group_ord", "canonical", "block", "date", "stems", "n_words", "grams"))
        compared = prints.select("group_ord", "block", "stems", "n_words", "grams")
        if known is not None:
            founders = known.where(F.col("group_ord") == F.col("cluster"))
            if self.keep_days is not None:
                latest = known.select("date").unionByName(prints.select("date")).agg(F.max("date")).first()[0]
                founders = founders.where(F.col("date").isNull() | (F.datediff(F.lit(latest), "date") <= self.keep_days)) if latest else founders
            # only founders of blocks that the batch has articles of
            founders = founders.join(prints.select("block").distinct(), "block", "left_semi")
            compared = compared.unionByName(founders.select("group_ord", "block", "stems", "n_words", "grams"))
        compared = checkpoint(compared)
        found = dedupe.founders_of_titles(compared, self.generic)
        blocks = compared.select(F.col("group_ord").alias("cluster"), F.col("block").alias("cluster_country"))
        joined = prints.join(found.select(F.col("node").alias("group_ord"), F.col("founder").alias("cluster")), "group_ord").join(blocks, "cluster")
        groups = checkpoint(joined.withColumn("batch", F.lit(batch)))
        told = grouped.join(groups.select("group_ord", "cluster", "cluster_country"), "group_ord").select("ord", "group_ord", "cluster", "cluster_country")
        if known is not None:
            told = told.unionByName(met)
        told.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{self.path}/assigned/part={batch}")
        kept = groups.withColumn("is_founder", F.col("group_ord") == F.col("cluster"))
        # what members look like is never asked again
        slim = kept.withColumns({c: F.when(F.col("is_founder"), F.col(c)) for c in ("stems", "grams")}).drop("is_founder")
        mark = self.spark.createDataFrame([(batch,)], "batch int")
        end = mark.join(slim.limit(0).drop("batch"), F.lit(True), "left").withColumn("key", F.lit("latest"))
        rows_ = slim.withColumn("key", key_of(F.to_json(F.struct("group_ord")))).unionByName(end)
        self.tables.put(_NAMESPACE, rows_.withColumn("fetched_at", F.lit(None).cast("timestamp")))
        self.tables.vacuum(_NAMESPACE)
