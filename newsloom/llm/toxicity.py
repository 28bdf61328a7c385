"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other; each later logistic regression sees, beside the words, the probabilities of
all categories before it. While training, those come from models that have not seen the row (out of fold); a model over
all rows then serves for scoring. Features are the words of a text and their four- and five-letter beginnings, by
presence; each category's features are the terms of highest chi-square in the training sample.

Only the fit is bounded: it takes about ``SAMPLE_ROWS`` labelled rows, picked by a hash of their id. All rows are scored, by the
JVM, over their whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SAMPLE_ROWS, FOLDS = 20_000, 3
TERMS, LEAST_ROWS = 3000, 3  # of each category; rows that a term must occur in
THRESHOLD = 0.5
FIT_PARTITIONS = 4
_ROWS_IN_HASH = 1_000_000


def terms(text: Column) -> Column:
    """Distinct words (runs of letters, lower-cased) and the beginnings of longer ones, marked by what JVM and SQL alike call letters."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}]+"), lambda w: F.length(w) > 1))
    begin = lambda n: F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("-")))
    return F.array_distinct(F.concat(words, begin(4), begin(5)))


@dataclass
class Chain:
    """A fitted chain: the vocabulary, and one model for each category in order. Without models nothing is toxic."""

    categories: list[str]
    vocabulary: list[str]
    models: list[LogisticRegressionModel | float]

    def scored(self, df: DataFrame) -> DataFrame:
        """Adds p_<category>; needs ``terms_``."""
        df = _vectors(df, self.vocabulary)
        for k, (category, model) in enumerate(zip(self.categories, self.models, strict=True)):
            df = _with_probability(df, model, self.categories[:k], category)
        return df.drop("words_", "terms_")


def _vectors(df: DataFrame, vocabulary: list[str]) -> DataFrame:
    return CountVectorizerModel.from_vocabulary(vocabulary or ["-"], "terms_", "words_").setBinary(True).setMinTF(0).transform(df)


def _assembled(df: DataFrame, before: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=["words_", *(f"p_{c}" for c in before)], outputCol="features_").transform(df)


def _with_probability(df: DataFrame, model: LogisticRegressionModel | float, before: list[str], category: str) -> DataFrame:
    if isinstance(model, float):
        return df.withColumn(f"p_{category}", F.lit(model))
    out = model.setFeaturesCol("features_").setRawPredictionCol("raw_").setProbabilityCol("probability_").setPredictionCol("").transform(_assembled(df, before))
    return out.withColumn(f"p_{category}", F.get(vector_to_array("probability_"), 1)).drop("features_", "raw_", "probability_")


def _model(df: DataFrame, before: list[str], category: str) -> LogisticRegressionModel | float:
    """A logistic regression; the share of ones where there are not both kinds of rows."""
    n, ones = df.agg(F.count("*"), F.sum(f"y_{category}")).first()
    if not n or not 0 < (ones or 0) < n:
        return float(ones or 0) / n if n else 0.0
    fit = LogisticRegression(featuresCol="features_", labelCol=f"y_{category}", regParam=2e-4, elasticNetParam=0.5, maxIter=60, tol=1e-5, standardization=False)
    return fit.fit(_assembled(df, before))


def _vocabulary(sample: DataFrame, categories: list[str], limit: int) -> list[str]:
    """The terms of highest chi-square with each category; a bounded list whatever the corpus."""
    n, *ones = sample.agg(F.count("*"), *(F.sum(f"y_{c}") for c in categories)).first()
    seen = sample.select(F.explode("terms_").alias("term"), *(f"y_{c}" for c in categories)).groupBy("term").agg(F.count("*").alias("df"), *(F.sum(f"y_{c}").alias(c) for c in categories)).where(F.col("df") >= LEAST_ROWS)
    seen = C.checkpoint(seen)
    out: set[str] = set()
    for c, total in zip(categories, ones, strict=True):
        if not 0 < (total or 0) < n:
            continue
        a, df = F.col(c).cast("double"), F.col("df").cast("double")
        chi = F.pow(a * n - df * float(total), 2) / (df * (float(n) - df) * float(total) * (float(n) - float(total)))
        out |= {r["term"] for r in seen.where(df < n).orderBy(chi.desc(), "term").limit(limit).select("term").collect()}
    return sorted(out)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample_rows: int = SAMPLE_ROWS, folds: int = FOLDS, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id") -> Chain:
    """Fit a chain. ``categories`` gives, in the chain's order, a 0/1 condition on the label table for each.

    Labels that are null, or whose id is, are ignored, as are labels without a document; several label rows of one id count by their
    largest. About ``sample_rows`` labelled ids are used, all of them where there are no more.
    """
    names = list(categories)
    y = labels.where(F.col(label_id_col).isNotNull()).select(F.col(label_id_col).cast("long").alias("label_id"), *(c.cast("double").alias(f"y_{k}") for k, c in categories.items())).dropna()
    y = y.groupBy("label_id").agg(*(F.max(f"y_{k}").alias(f"y_{k}") for k in names))
    total = y.count()
    share = min(1.0, sample_rows / max(total, 1))
    y = y.where(F.pmod(F.xxhash64("label_id", F.lit(7)), F.lit(_ROWS_IN_HASH)) < int(share * _ROWS_IN_HASH) + (share >= 1))
    source = C.id_text(docs, id_col, text_col)
    sample = source.join(y, source["doc_id"] == y["label_id"]).select(F.col("label_id"), terms(F.col("text")).alias("terms_"), *(f"y_{k}" for k in names))
    sample = C.checkpoint(sample.withColumn("fold", F.pmod(F.xxhash64("label_id", F.lit(11)), F.lit(folds))))
    vocabulary = _vocabulary(sample, names, TERMS)
    rows = C.checkpoint(_vectors(sample, vocabulary).drop("terms_").coalesce(FIT_PARTITIONS))
    models: list[LogisticRegressionModel | float] = []
    for k, category in enumerate(names):
        models.append(_model(rows, names[:k], category))
        if k + 1 < len(names):
            parts = None
            for fold in range(folds):
                unseen = _model(rows.where(F.col("fold") != fold), names[:k], category)
                part = _with_probability(rows.where(F.col("fold") == fold), unseen, names[:k], category)
                parts = part if parts is None else parts.unionByName(part)
            rows = C.checkpoint(parts.coalesce(FIT_PARTITIONS))
    return Chain(names, vocabulary, models)


def judged(docs: DataFrame, chain: Chain, category: str, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The same rows and columns with p_<category> of the whole chain and ``is_<category>``, which replace columns of those names.

    Null and empty texts hold no words and are scored as such; repeated rows are scored alike; other columns may have any names.
    """
    out = chain.scored(docs.select(F.struct("*").alias("row"), terms(F.coalesce(F.col(text_col), F.lit(""))).alias("terms_")))
    added = [*(f"p_{c}" for c in chain.categories), f"is_{category}"]
    return out.withColumn(f"is_{category}", F.col(f"p_{category}") >= threshold).select(*(F.col(f"row.`{c}`") for c in docs.columns if c not in added), *added)


def label_categories() -> dict[str, Column]:
    """The chain over the table ``labels``: text of low quality, then toxic text."""
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def toxicity(spark: SparkSession, docs: DataFrame, labelled: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with p_low_quality, p_toxic and is_toxic, by a chain fitted on the texts of ``labelled``."""
    return judged(docs, train(labelled, labels, label_categories()), "toxic")


def op7_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read_table(spark, sf_dir, "documents")
    out = toxicity(spark, docs, docs, C.read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", "p_low_quality", "p_toxic", F.col("is_toxic").alias("toxic"))
