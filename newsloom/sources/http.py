"""HTTP as a Spark source: GET and POST requests in partitions, each with its own waits, and a row for every answer or failure.

``spark.read.format("newsloom_http")`` reads a short list of requests, as a configuration gives it; ``landing.fetched`` does the
same for a table of requests of any size. Either way one partition asks one thing at a time, so that as many requests are under
way as there are partitions. Reading asks the network anew: write the rows down before use, as ``landed`` does.
"""

from __future__ import annotations

import datetime as dt
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..runtime import checkpoint

# Answers that are worth another try.
RETRY = {408, 425, 429, 500, 502, 503, 504, 522, 524}
FEEDS = "application/rss+xml, application/atom+xml, application/xml;q=0.9, text/xml;q=0.9, */*;q=0.5"
JSON = "application/json"
AGENT = "newsloom/1.0"
# method: timeout and first wait in seconds, retries; waits double
GET, POST = (20.0, 0.5, 2), (60.0, 0.8, 2)
PARALLEL = 8
FIELDS = "url string, method string, status int, body string, etag string, last_modified string, content_type string, final_url string, attempts int, error string, fetched_at timestamp"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]
# (url, method, headers, payload, timeout) -> status, body, headers, address after redirects
Send = Callable[[str, str, dict[str, str], bytes | None, float], tuple[int, str | None, dict[str, str], str]]


def send(url: str, method: str, headers: dict[str, str], payload: bytes | None, timeout: float) -> tuple[int, str | None, dict[str, str], str]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, payload, headers, method=method), timeout=timeout) as r:
            text = r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
            return r.status or 200, text, dict(r.headers), r.url
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode("utf-8", "replace") if e.fp else None, dict(e.headers), e.url


def answer(request: dict, via: Send = send, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The row of one request: url, and method, payload, accept, headers, etag, last_modified, timeout, wait, retries where they differ.

    Failures that may pass are tried again after waits; other refusals are final; 304 is no error. With the accept header of
    JSON an answer that is none is an error, an empty one a null. A failed POST tells what the service said.
    """
    method = (request.get("method") or "GET").upper()
    timeout, wait, retries = (request.get(k) if request.get(k) is not None else d for k, d in zip(("timeout", "wait", "retries"), POST if method == "POST" else GET, strict=True))
    accept = request.get("accept") or (JSON if method == "POST" else FEEDS)
    headers = {"User-Agent": AGENT, "Accept": accept, "Accept-Language": "fr,en;q=0.8,*;q=0.5"}
    for name, value in (("Content-Type", JSON if method == "POST" else None), ("If-None-Match", request.get("etag")), ("If-Modified-Since", request.get("last_modified")), *(request.get("headers") or {}).items()):
        if value:
            headers[name] = value
    payload = (request.get("payload") or "null").encode() if method == "POST" else None
    row = dict.fromkeys(NAMES) | {"url": request["url"], "method": method}
    for attempt in range(retries + 1):
        if attempt:
            sleep(wait * 2 ** (attempt - 1))
        row |= {"attempts": attempt + 1, "status": None, "body": None, "error": None, "fetched_at": dt.datetime.now(dt.UTC)}
        try:
            status, body, got, final = via(request["url"], method, headers, payload, timeout)
        except Exception as e:  # of the connection: a row, and another try
            row["error"] = f"{type(e).__name__}: {e}"
            continue
        lower = {k.lower(): v for k, v in got.items()}
        row |= {"status": status, "etag": lower.get("etag"), "last_modified": lower.get("last-modified"), "content_type": lower.get("content-type"), "final_url": final}
        if status == 304 or 200 <= status < 300:
            row["body"] = None if status == 304 else body
            if accept == JSON and status != 304:
                row |= _as_json(body)
            break
        row["error"] = f"HTTP {status}" + (f" {body[:300]}" if method == "POST" and body else "")
        if status not in RETRY:
            break
    return row


def _as_json(body: str | None) -> dict:
    try:
        json.loads(body or "null")
        return {"body": body or None}
    except ValueError as e:
        return {"body": None, "error": f"unreadable JSON: {e}"}


class _Share(InputPartition):
    def __init__(self, requests: list[dict]):
        super().__init__(None)
        self.requests = requests


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.requests, self.parallel = json.loads(options["requests"]), int(options.get("parallel", PARALLEL))

    def partitions(self) -> list[InputPartition]:
        return [_Share(self.requests[k :: self.parallel]) for k in range(min(self.parallel, len(self.requests)))] or [_Share([])]

    def read(self, partition: _Share) -> Iterator[tuple]:
        for request in partition.requests:
            row = answer(request)
            yield tuple(row[n] for n in NAMES)


class HttpSource(DataSource):
    """Options: requests (a JSON list of objects, or of plain addresses), parallel."""

    @classmethod
    def name(cls) -> str:
        return "newsloom_http"

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def landed(spark: SparkSession, requests: list[str | dict], parallel: int = PARALLEL) -> DataFrame:
    """Answers to a short list of requests, asked once and written down."""
    spark.dataSource.register(HttpSource)
    asked = [{"url": r} if isinstance(r, str) else r for r in requests]
    return checkpoint(spark.read.format("newsloom_http").option("requests", json.dumps(asked)).option("parallel", str(parallel)).load())
