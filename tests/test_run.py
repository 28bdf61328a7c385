"""Whole runs: configuration files, a local server, caches, volumes, translation, mail, files."""

import datetime as dt
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from newsloom import cli
from newsloom.functions.dates import resolve_window
from newsloom.plans import run
from newsloom.plans.digest import Options
from newsloom.runtime import Progress
from newsloom.sinks.mail import Memory
from newsloom.sources import books, config
from newsloom.sources.tables import CacheTables

NOW = dt.datetime(2026, 7, 26, 9)
ASKED = []


def feed(*items):
    return "<rss><channel><title>J</title>" + "".join(f"<item><title>{t}</title><link>{link}</link><pubDate>Thu, 23 Jul 2026 08:00:00 GMT</pubDate><description>{d}</description></item>" for t, link, d in items) + "</channel></rss>"


VOLUMES = json.dumps({"items": [{"id": "v1", "volumeInfo": {"title": "Un livre", "publishedDate": "2026-07-22", "infoLink": "https://b.example/1", "language": "fr"}}]})
PAGES = {
    "/fr1": feed(("Incendie de la synagogue de Rouen", "https://a.example/1", "Récit"), ("Tout autre sujet du jour", "https://a.example/2", "x")),
    "/fr2": feed(("Rouen : la synagogue en incendie", "https://b.example/9", "Récit")),
    "/de": feed(("Neue Synagoge eröffnet heute", "https://d.example/1", "Bericht")),
    "/pod": feed(("Un épisode", "https://p.example/1", "")),
}


class Handler(BaseHTTPRequestHandler):
    def do_GET(self):
        ASKED.append((self.path, self.headers.get("If-None-Match")))
        body = VOLUMES if self.path.startswith("/books") else PAGES.get(self.path)
        old = self.headers.get("If-None-Match") == self.path
        self.send_response(304 if old else 200 if body else 404)
        if body:
            self.send_header("ETag", self.path)
        self.send_header("Content-Length", "0" if old or not body else str(len(body.encode())))
        self.end_headers()
        if body and not old:
            self.wfile.write(body.encode())

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


@pytest.fixture(scope="module")
def folder(server, tmp_path_factory):
    at = tmp_path_factory.mktemp("config")
    medium = lambda i, path, lang, **more: {"id": i, "nom": i.upper(), "url": server + path, "langue": lang, **more}
    land = lambda code, name, lang, media, **more: {"code": code, "nom": name, "region": "ouest", "poids": 2, "editions": [{"langue": lang, "hl": lang, "gl": code, "ceid": f"{code}:{lang}"}], "medias": media, **more}
    files = {
        "europe": {"_lisez_moi": ["x"], "pays": [land("FR", "France", "fr", [medium("f1", "/fr1", "fr"), medium("f2", "/fr2", "fr", poids=3), medium("off", "/off", "fr", actif=False)]), land("DE", "Allemagne", "de", [medium("d1", "/de", "de"), medium("lost", "/lost", "de")]), land("MT", "Malte", "fr", [], actif=True), land("XX", "Nulle part", "fr", [], actif=False)]},
        "monde": {"livres": [], "podcasts": [medium("p1", "/pod", "fr")], "evenements": [medium("m1", "/museum", "fr", type="evenement", actif=False)], "requetesLivres": [{"langue": "fr", "hl": "fr", "gl": "FR", "ceid": "FR:fr"}], "googleBooks": {"requetes": ["a b", "c"], "langues": ["fr", "de"], "maxParRequete": 90}},
        "langues": {"langues": {"fr": {"nom": "français", "noyau": ["juif"], "antisemitisme": ["haine"], "culture": ["art"], "livres": ["roman"], "racines": {"noyau": ["synagog"], "antisemitisme": []}}, "de": {"nom": "Deutsch", "noyau": ["Jude"]}}},
    }
    for name, content in files.items():
        (at / f"{name}.json").write_text(json.dumps(content), encoding="utf-8")
    return str(at)


def test_configuration(spark, folder):
    c = config.load(spark, folder)
    lands = c.countries.orderBy("ord").collect()
    assert [(r["code"], r["weight"], r["active"], len(r["media"])) for r in lands] == [("FR", 2.0, None, 3), ("DE", 2.0, None, 2), ("MT", 2.0, True, 0), ("XX", 2.0, False, 0)]
    assert lands[0]["media"][2].asDict()["active"] is False and lands[0]["editions"][0]["ceid"] == "FR:fr"
    assert [(r["id"], r["type"]) for r in c.world.orderBy("ord").collect()] == [("p1", "podcast"), ("m1", "evenement")]
    assert [(r["query"], r["language"], r["most"]) for r in c.book_calls.orderBy("ord").collect()] == [("a b", "fr", 90), ("a b", "de", 90), ("c", "fr", 90), ("c", "de", 90)]
    assert {r["language"]: (r["core"], r["core_roots"]) for r in c.vocabulary.collect()} == {"fr": (["juif"], ["synagog"]), "de": (["Jude"], None)}
    listed = run.feeds_of(c, run.Scope(codes=("FR",)), 7).collect()
    assert {r["feed_id"] for r in listed} == {"gn-fr-fr-actualite", "gn-fr-fr-antisemitisme", "f1", "f2", "p1", "gn-livres-fr"}
    assert {r["feed_id"] for r in run.feeds_of(c, run.Scope(search=False), 7).collect()} == {"f1", "f2", "d1", "lost", "p1"}


def test_broken_configuration(spark, tmp_path):
    for name in ("europe", "monde", "langues"):
        (tmp_path / f"{name}.json").write_text("{", encoding="utf-8")
    with pytest.raises(Exception, match="(?i)malformed"):
        config.load(spark, str(tmp_path)).countries.collect()


def test_two_runs(spark, folder, tmp_path, server, monkeypatch):
    monkeypatch.setattr(books, "ENDPOINT", f"{server}/books")
    from newsloom.operators.translate import Marking

    heard, cache = [], CacheTables(spark, str(tmp_path / "cache"))
    options = Options(NOW, resolve_window(NOW))
    scope = run.Scope(search=False, parallel=2, retries=0)
    both = []
    for _ in range(2):
        ASKED.clear()
        both.append((run.revue(spark, config.load(spark, folder), scope, options, Marking(), cache, lambda *e: heard.append(e)), sorted(ASKED)))
    (d, cold), (again, warm) = both
    assert [(c["name"], [a["publisher"] for a in c["articles"]]) for c in d["countries"]] == [("France", ["F2", "F1"]), ("Allemagne", ["D1"])] or len(d["countries"][0]["articles"]) == 2
    titles = {a["title"] for c in d["countries"] for a in c["articles"]}
    assert "[de>fr] Neue Synagoge eröffnet heute" in titles and d["silent"] == ["Malte"]
    assert [b["title"] for b in d["livres"]] == ["Un livre"] and [e["title"] for e in d["podcasts"]] == ["Un épisode"]
    lines = {r["name"]: (r["status"], r["total"], r["kept"]) for r in d["report"]}
    assert lines["LOST"] == ("echec", 0, 0) and lines["F1"] == ("ok", 2, 2)
    assert sorted(v for k, v in lines.items() if k.startswith("Google Books")) == [("ok", 1, 0)] * 3 + [("ok", 1, 1)]
    assert d["meta"]["sources"] == len(d["report"]) == 9 and d["meta"]["failed"] == 1 and d["meta"]["rejected"] == 0
    assert {s for s, _, _ in heard} == {"collecte", "livres", "analyse", "dedoublonnage", "traduction"} and all(done <= known for _, done, known in heard)
    ends = {s: (done, known) for s, done, known in heard}
    assert all(done == known > 0 for done, known in ends.values())
    feeds = [x for x in warm if not x[0].startswith("/books")]
    assert {etag for _, etag in cold} == {None} and [e for p, e in feeds if p != "/lost"] == [p for p, _ in feeds if p != "/lost"]
    assert {r["state"] for r in again["report"]} == {"inchange", "echec", "ok"} and {a["title"] for c in again["countries"] for a in c["articles"]} == titles
    assert cache.read("translations").count() == 2 and len(cache.versions("http")) == 3


def test_command_line(spark, folder, tmp_path, server, capsys):
    box, out = Memory(), tmp_path / "out"
    base = ["--config", folder, "--sans-google-news", "--sans-google-books", "--silencieux", "--cache", str(tmp_path / "cache")]
    assert cli.main(["revue", *base, "--pays", "fr", "--format", "md,json", "--sortie", str(out), "--email", "a@b.example", "--sujet", "Objet", "--par-pays", "1", "--podcasts", "0", "--traduction", "fake"], NOW, transport=box) == 0
    found = json.loads((out / "revue-2026-07-19.json").read_text(encoding="utf-8"))
    assert len(found["countries"][0]["articles"]) == 1 and found["podcasts"] == [] and (out / "revue-2026-07-19.md").exists()
    assert (box.sent[0].subject, box.sent[0].to) == ("Objet", ["a@b.example"])
    capsys.readouterr()
    assert cli.main(["sources", *base, "--check", "--pays", "DE"], NOW) == 0
    told = capsys.readouterr().out.splitlines()
    assert "echec 0 LOST HTTP 404" in told and "ok 1 D1" in told
    assert cli.main(["sources", *base], NOW) == 0 and f"FR F1 {server}/fr1" in capsys.readouterr().out
    landed = spark.createDataFrame([(f"{server}/fr1", 200, PAGES["/fr1"], None), (f"{server}/fr2", None, None, "HTTP 500")], "url string, status int, body string, error string")
    landed.write.parquet(str(tmp_path / "landed"))
    ASKED.clear()
    assert cli.main(["revue", *base, "--brut", str(tmp_path / "landed"), "--format", "json", "--stdout"], NOW) == 0
    d = json.loads(capsys.readouterr().out)
    assert ASKED == [] and {r["name"]: r["error"] for r in d["report"]} == {"F1": None, "F2": "HTTP 500", "D1": "not landed", "LOST": "not landed", "P1": "not landed"}
    for wrong in (["revue"], ["revue", *base, "--format", "pdf"], ["revue", *base, "--sans-fichiers"], ["revue", *base, "--traduction", "nobody"]):
        assert cli.main(wrong, NOW) == 1 and "error:" in capsys.readouterr().err
    assert cli.main(["aide"]) == 0


def test_progress_keeps_the_group_around_it(spark):
    sc, heard = spark.sparkContext, []
    sc.setJobGroup("mine", "outer")
    try:
        with Progress(spark, lambda *e: heard.append(e), every=0.05).stage("s"):
            spark.range(1000).repartition(3).count()
        assert sc.getLocalProperty("spark.jobGroup.id") == "mine" and heard[-1][0] == "s" and heard[-1][1] == heard[-1][2] > 0

        def broken(*_):
            raise RuntimeError("hook")

        with Progress(spark, broken, every=0.05).stage("s"):
            assert spark.range(10).count() == 10
        with Progress(spark, None).stage("s"):
            assert sc.getLocalProperty("spark.jobGroup.id") == "mine"
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
