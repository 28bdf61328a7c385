"""Landing of raw texts: bounded parallel requests with retries and conditional headers, and the cache tables around them."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import checkpoint
from . import http

TIMEOUT, BACKOFF, RETRIES = http.GET
PARALLEL = http.PARALLEL
ROWS = 64  # answers that a task holds at once
Fetch = Callable[[str, dict[str, str], float], tuple[int, str | None, dict[str, str]]]


def http_get(url: str, headers: dict[str, str], timeout: float) -> tuple[int, str | None, dict[str, str]]:
    return http.send(url, "GET", headers, None, timeout)[:3]


def ask(url: str, headers: dict[str, str], fetch: Fetch = http_get, retries: int = RETRIES, timeout: float = TIMEOUT, sleep: Callable[[float], None] = time.sleep) -> dict:
    """One landed row; waits 0.5 s, 1 s, ... between tries; other refusals are final, and 304 is no error."""
    return http.answer({"url": url, "headers": headers, "retries": retries, "timeout": timeout}, lambda u, method, sent, payload, t: (*fetch(u, sent, t), u), sleep)


_ASKED = ("url", "method", "payload", "accept", "etag", "last_modified", "timeout", "wait", "retries")


_TYPES = {"string": pa.string(), "int": pa.int32(), "timestamp": pa.timestamp("us", tz="UTC")}
_ANSWER = pa.schema([(n, _TYPES[t]) for n, t in (f.split() for f in http.FIELDS.split(", "))])


def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of requests, handed on ``ROWS`` at a time, so that a task never holds the answers of a whole batch."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            rows = [http.answer({k: v for k, v in r.items() if v is not None and v == v}) for r in batch.slice(i, ROWS).to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, _ANSWER)


def fetched(requests: DataFrame, parallel: int = PARALLEL) -> DataFrame:
    """A row for each distinct request of a table: url, and any of method, payload, accept, etag, last_modified, timeout, wait, retries.

    So many partitions ask at once, one thing at a time each; a failing request is a row with an error. Rows are written down, so
    that reading them twice does not ask twice.
    """
    asked = requests.select(*(c for c in _ASKED if c in requests.columns)).distinct()
    return checkpoint(asked.repartition(parallel, F.rand(random.randrange(1 << 30))).mapInArrow(answers, http.FIELDS))


_LANDED = "url string, status int, body string, etag string, last_modified string, error string, fetched_at timestamp"


def land(urls: DataFrame, cache: DataFrame | None = None, fetch: Fetch = http_get, parallel: int = PARALLEL, retries: int = RETRIES) -> DataFrame:
    """Raw rows for distinct URLs, so many at once; validators come from the cache, and a 304 brings its body back.

    A failing request is a row with an error. Rows are written down, so that reading them twice does not ask twice.
    """
    known = urls.select("url").distinct()
    if cache is None:
        known = known.withColumns({"etag_": F.lit(None).cast("string"), "last_modified_": F.lit(None).cast("string"), "body_": F.lit(None).cast("string")})
    else:
        known = known.join(cache.select("url", F.col("etag").alias("etag_"), F.col("last_modified").alias("last_modified_"), F.col("body").alias("body_")), "url", "left")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (frame.iloc[i : i + ROWS] for frame in frames for i in range(0, len(frame), ROWS)):
            rows = []
            for r in part.itertuples(index=False):
                headers = {k: v for k, v in (("If-None-Match", r.etag_), ("If-Modified-Since", r.last_modified_)) if isinstance(v, str) and v}
                row = ask(r.url, headers, fetch, retries)
                if row["status"] == 304:
                    row |= {"body": r.body_ if isinstance(r.body_, str) else None, "etag": row["etag"] or r.etag_, "last_modified": row["last_modified"] or r.last_modified_}
                rows.append(row)
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _LANDED.split(", ")]).astype({"status": "Int32"})

    return checkpoint(known.repartition(parallel, F.rand(random.randrange(1 << 30))).mapInPandas(run, _LANDED))


def status_of(landed: DataFrame) -> DataFrame:
    return landed.withColumn("state", F.when(F.col("error").isNotNull(), "echec").when(F.col("status") == 304, "inchange").otherwise("ok"))


def pruned(cache: DataFrame, before) -> DataFrame:
    """Entries fetched since; those without a time never expire."""
    return cache.where(F.col("fetched_at").isNull() | (F.col("fetched_at") >= F.lit(before)))


def refreshed(cache: DataFrame, landed: DataFrame) -> DataFrame:
    """The cache with newly landed bodies; write it to a new version, as it reads the old one."""
    new = landed.where(F.col("error").isNull() & F.col("body").isNotNull()).select("url", "etag", "last_modified", "body", "fetched_at")
    return cache.join(new.select("url"), "url", "left_anti").select(*new.columns).unionByName(new)


def chunked(rows: DataFrame, order: str, size: int, by: str) -> DataFrame:
    """Adds ``chunk``: batches of a size within each ``by``."""
    from ..operators.batches import numbered

    return numbered(rows, by, [order]).withColumn("chunk", F.floor(F.col("nth") / size)).drop("nth")
