"""Requests against a local server, versions of cache tables, places and batches."""

import collections
import datetime as dt
import json
import random
import tempfile
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from newsloom.operators import batches, translate
from newsloom.sources import feeds, http, landing
from newsloom.sources.tables import CacheTables, Conflict, key_of

SEEN, LOCK = collections.Counter(), threading.Lock()
FLIGHT = {"now": 0, "most": 0}
FEED = "<rss><channel><title>J</title><item><title>Titre</title><link>https://x/1</link></item></channel></rss>"


class Handler(BaseHTTPRequestHandler):
    def _say(self, status, body="", **headers):
        self.send_response(status)
        for k, v in headers.items():
            self.send_header(k.replace("_", "-"), v)
        self.send_header("Content-Length", str(len(body.encode())))
        self.end_headers()
        self.wfile.write(body.encode())

    def do_GET(self):
        with LOCK:
            SEEN[self.path] += 1
            n = SEEN[self.path]
            FLIGHT["now"] += 1
            FLIGHT["most"] = max(FLIGHT["most"], FLIGHT["now"])
        if self.path.startswith("/slow"):
            time.sleep(0.15)
        with LOCK:
            FLIGHT["now"] -= 1
        if self.path == "/feed":
            self._say(304) if self.headers.get("If-None-Match") == "e1" else self._say(200, FEED, ETag="e1", Content_Type="text/xml; charset=utf-8", Last_Modified="m1")
        elif self.path == "/busy":
            self._say(503) if n < 3 else self._say(200, "at last")
        elif self.path == "/json":
            self._say(200, '{"a": 1}' if self.headers["Accept"] == "application/json" else "no")
        elif self.path == "/moved":
            self._say(302, Location="/feed")
        elif self.path in ("/broken", "/blank") or self.path.startswith("/slow"):
            self._say(200, "" if self.path == "/blank" else "{no json")
        else:
            self._say(404)

    def do_POST(self):
        with LOCK:
            SEEN[self.path] += 1
        body = self.rfile.read(int(self.headers["Content-Length"])).decode()
        self._say(200, json.dumps({"got": json.loads(body), "type": self.headers["Content-Type"], "key": self.headers.get("X-Key")})) if self.path == "/echo" else self._say(400, "because " + "x" * 400)

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_requests_as_a_source(spark, server):
    asked = [f"{server}/feed", {"url": f"{server}/busy", "wait": 0.01}, f"{server}/none", f"{server}/moved", {"url": f"{server}/json", "accept": http.JSON}, {"url": f"{server}/broken", "accept": http.JSON}, {"url": f"{server}/blank", "accept": http.JSON}, {"url": f"{server}/feed", "etag": "e1"}, {"url": "http://127.0.0.1:1/x", "wait": 0.0, "retries": 1}, {"url": f"{server}/echo", "method": "POST", "payload": '{"t": ["é"]}', "headers": {"X-Key": "k"}}, {"url": f"{server}/refuse", "method": "POST", "payload": "{}"}]
    df = http.landed(spark, asked, 3)
    rows = df.collect()
    before = sum(SEEN.values())
    assert df.count() == len(asked) and sum(SEEN.values()) == before  # written down: nothing is asked again
    by = {(r["url"].removeprefix(server), r["status"]): r for r in rows}
    ok = by["/feed", 200]
    assert (ok["body"], ok["etag"], ok["last_modified"], ok["content_type"], ok["attempts"], ok["error"]) == (FEED, "e1", "m1", "text/xml; charset=utf-8", 1, None)
    assert (by["/feed", 304]["body"], by["/feed", 304]["error"]) == (None, None)
    assert (by["/busy", 200]["body"], by["/busy", 200]["attempts"]) == ("at last", 3)
    assert (by["/none", 404]["error"], by["/none", 404]["attempts"], SEEN["/none"]) == ("HTTP 404", 1, 1)
    assert by["/moved", 200]["final_url"] == f"{server}/feed"
    assert by["/json", 200]["body"] == '{"a": 1}' and by["/broken", 200]["error"].startswith("unreadable JSON") and by["/blank", 200]["body"] is None and by["/blank", 200]["error"] is None
    lost = by["http://127.0.0.1:1/x", None]
    assert lost["attempts"] == 2 and "URLError" in lost["error"]
    assert json.loads(by["/echo", 200]["body"]) == {"got": {"t": ["é"]}, "type": "application/json", "key": "k"}
    assert by["/refuse", 400]["error"] == "HTTP 400 because " + "x" * 292
    assert http.landed(spark, []).count() == 0


def test_waits_double():
    waits = []
    row = http.answer({"url": "u", "method": "post", "payload": "{}"}, lambda *a: (503, "busy", {}, "u"), waits.append)
    assert (waits, row["attempts"], row["error"]) == ([0.8, 1.6], 3, "HTTP 503 busy")
    waits.clear()
    assert http.answer({"url": "u", "retries": 3}, lambda *a: (_ for _ in ()).throw(TimeoutError("late")), waits.append)["error"] == "TimeoutError: late" and waits == [0.5, 1.0, 2.0]


def test_table_of_requests(spark, server):
    FLIGHT["most"] = 0
    asked = spark.createDataFrame([(f"{server}/slow{k % 9}",) for k in range(18)], "url string")
    got = landing.fetched(asked, 2)
    assert got.count() == 9 and FLIGHT["most"] <= 2 and all(SEEN[f"/slow{k}"] == 1 for k in range(9))


def test_from_server_to_articles(spark, server, tmp_path):
    """A cold and a warm run over a cache: the second is told that nothing changed and has the same items."""
    store = CacheTables(spark, str(tmp_path / "cache"))
    urls = spark.createDataFrame([(f"{server}/feed",), (f"{server}/gone",)], "url string")
    for state in ("ok", "inchange"):
        old = store.read("feeds")
        got = landing.status_of(landing.land(urls, old, retries=0))
        assert {r["url"].removeprefix(server): r["state"] for r in got.collect()} == {"/feed": state, "/gone": "echec"}
        good = got.where("error is null").select(key_of(F.col("url")).alias("key"), "url", "etag", "last_modified", "body", "fetched_at")
        store.put("feeds", good)
        items = feeds.parse_feeds(got.where("error is null")).select(F.explode("items").alias("i")).select("i.title", "i.link").collect()
        assert [tuple(r) for r in items] == [("Titre", "https://x/1")]
    assert store.versions("feeds") == [1, 2] and store.read("feeds").count() == 1


def test_cache_tables(spark, tmp_path):
    store = CacheTables(spark, str(tmp_path / "c"))
    at = lambda day: dt.datetime(2026, 7, day)
    rows = lambda *r: spark.createDataFrame(list(r), "key string, value string, fetched_at timestamp")
    state = lambda df: {r["key"]: r["value"] for r in df.collect()}
    assert store.read("a") is None and store.versions("a") == [] and store.prune("a", at(2)) == 1 and store.read("a") is None
    assert store.put("a", rows(("x", "1", at(1)), ("y", "1", None), ("x", "0", at(1).replace(hour=0, microsecond=0) - dt.timedelta(1)), (None, "n", at(1)))) == 2
    reader = store.read("a")  # goes on reading its version
    assert store.put("a", rows(("x", "2", at(3)), ("z", "2", at(1)))) == 3
    assert store.prune("a", at(2)) == 4
    assert [state(store.read("a", v)) for v in (2, 3, 4)] == [{"x": "1", "y": "1"}, {"x": "2", "y": "1", "z": "2"}, {"x": "2", "y": "1"}] and state(reader) == {"x": "1", "y": "1"}
    assert store.clear("a") == 5 and store.read("a") is None and store.read("b") is None
    assert store.put("b", rows(("x", "b", None))) == 1 and store.vacuum("a", 2) == 2
    assert state(store.read("a", 4)) == {"x": "2", "y": "1"} and [store.entry("a", v)["operation"] for v in store.versions("a")] == ["prune", "put", "put", "prune", "clear"]
    off = CacheTables(spark, str(tmp_path / "off"), enabled=False)
    assert (off.put("a", rows(("x", "1", None))), off.read("a"), off.vacuum("a")) == (0, None, 0) and not (tmp_path / "off").exists()


def test_two_writers(spark, tmp_path):
    store, other = (CacheTables(spark, str(tmp_path / "c"), tries=2) for _ in range(2))
    row = lambda k: spark.createDataFrame([(k, None)], "key string, fetched_at timestamp")
    store.put("a", row("first"))
    raced = []

    def slow(old):
        if not raced:
            raced.append(other.put("a", row("second")))
        return old.unionByName(row("third"))

    assert store.change("a", slow, "put") == 3 and {r["key"] for r in store.read("a").collect()} == {"first", "second", "third"}

    def always(old):
        other.put("a", row("again"))
        return old

    with pytest.raises(Conflict):
        store.change("a", always, "put")
    assert store.versions("a") == [1, 2, 3, 4, 5]


def test_numbered(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.randint(0, 500), k) for k in range(1500)] + [("hot", k % 7, k) for k in range(3000)]
    df = spark.createDataFrame(rows, "g string, o int, k int").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = batches.numbered(df, "g", ["o", "k"]).collect()
        assert len({r["g"] for r in got}) == 4 and set(got[0].asDict()) == {"g", "o", "k", "nth"}
        for g in ("a", "b", None, "hot"):
            assert [(r["o"], r["k"]) for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["nth"])] == sorted((o, k) for h, o, k in rows if h == g)
            assert sorted(r["nth"] for r in got if r["g"] == g) == list(range(sum(h == g for h, _, _ in rows)))
        b = batches.batches(df, "g", ["o", "k"], 100).collect()
        assert sorted(len(r["rows"]) for r in b if r["g"] == "hot") == [100] * 30 and all(r["rows"] == sorted(r["rows"], key=lambda x: (x["o"], x["k"])) for r in b)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert batches.batches(df.limit(0), "g", ["o"], 5).count() == 0


class Slow:
    """Writes down when each batch begins and ends; refuses one text."""

    name, batch = "slow", 4

    def __init__(self, folder):
        self.folder = folder

    def translate(self, texts, source):
        began = time.time()
        time.sleep(0.1)
        with open(tempfile.mktemp(dir=self.folder), "w") as f:
            json.dump([began, time.time(), source, texts], f)
        if "t07" in texts:
            raise RuntimeError("refused")
        return [f"{source} {t}" for t in texts]


def test_batches_under_way(spark, tmp_path):
    rows = spark.createDataFrame([(lang, f"t{k:02}") for lang in ("de", "en") for k in range(18)] + [("fr", "non"), ("de", "t01")], "language string, text string").repartition(7)
    out, new = translate.translate_texts(rows, Slow(str(tmp_path)), parallel=2)
    calls = [json.loads(p.read_text()) for p in tmp_path.iterdir()]
    assert sorted((c[2], len(c[3])) for c in calls) == sorted([(lang, 4) for lang in ("de", "en") for _ in range(4)] + [("de", 2), ("en", 2)])
    assert all(sum(a[0] < t < a[1] for a in calls) <= 2 for t in (c[0] + 0.01 for c in calls))
    states = collections.Counter(r["state"] for r in out.collect())
    assert states == {"translated": 28, "error: refused": 8} and new.count() == 28
    again, more = translate.translate_texts(rows, Slow(str(tmp_path)), new, parallel=2)
    assert collections.Counter(r["state"] for r in again.collect()) == {"cache": 28, "error: refused": 8} and more.count() == 0


def test_translated_articles_give_their_answers(spark):
    rows = spark.createDataFrame([("de", "Titel", "Text"), ("fr", "Titre", "Texte")], "language string, title string, summary string")
    _, new = translate.translated_articles(rows, translate.Marking())
    assert {r["value"] for r in new.collect()} == {"[de>fr] Titel", "[de>fr] Text"}
    assert translate.translated_articles(rows, translate.Identity())[1] is None
