"""Command line: ``revue`` builds a digest, ``sources`` shows or tests the plan, ``aide`` this text.

revue --config FOLDER [--brut TABLE]
  period     --jours N | --depuis D --jusqu-a D | --semaine | --semaine-du D
  scope      --pays FR,DE  --profils a,b  --sans-google-news  --sans-medias  --sans-google-books
  selection  --par-pays N  --a-la-une N  --livres N  --podcasts N  --evenements N  --pertinence-min N
  text       --traduction NAME
  output     --format html,md  --sortie FOLDER  --stdout  --sans-fichiers
  mail       --email ADDRESSES  --de ADDRESS  --sujet TEXT  --essai-a-vide
  technical  --concurrence N  --cache FOLDER  --sans-cache  --vider-cache  --silencieux
sources --config FOLDER [--html | --check] and the options of scope

A configuration folder holds europe.json, monde.json and langues.json. With --brut, feeds are read from a landed table and nothing is
asked; else they are asked, with validators of the cache. Translators other than ``fake`` and mail transports are the caller's to give.
"""

from __future__ import annotations

import argparse
import datetime as dt
import pathlib
import sys

from .functions.dates import resolve_window


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="newsloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", nargs="?", default="revue", choices=["revue", "build", "sources", "aide", "help"])
    for name, kind in (("jours", float), ("depuis", str), ("jusqu-a", str), ("semaine-du", str), ("pays", str), ("profils", str), ("brut", str), ("config", str), ("sortie", str), ("par-pays", int), ("a-la-une", int), ("livres", int), ("podcasts", int), ("evenements", int), ("traduction", str), ("email", str), ("de", str), ("sujet", str), ("concurrence", int), ("cache", str)):
        p.add_argument(f"--{name}", type=kind)
    p.add_argument("--pertinence-min", "--min", dest="min", type=float)
    p.add_argument("--format", default="html")
    for name in ("semaine", "html", "check", "sans-google-news", "sans-medias", "sans-google-books", "stdout", "sans-fichiers", "essai-a-vide", "sans-cache", "vider-cache", "silencieux"):
        p.add_argument(f"--{name}", action="store_true")
    return p


def _listed(text: str | None) -> tuple[str, ...]:
    return tuple(x.strip() for x in (text or "").split(",") if x.strip())


def main(argv: list[str] | None = None, now: dt.datetime | None = None, translators: dict | None = None, transport=None, fetch=None) -> int:
    """0, 1 on an error, 2 on an unknown command. ``translators``, ``transport`` and ``fetch`` are the caller's services."""
    a = parser().parse_args(argv)
    if a.command in ("aide", "help"):
        print(__doc__)
        return 0
    now = now or dt.datetime.now(dt.UTC).replace(tzinfo=None)
    log = (lambda *_: None) if a.silencieux else (lambda *x: print(*x, file=sys.stderr))
    try:
        from pyspark.sql import SparkSession

        from .operators.rank import RUBRICS
        from .operators.translate import provider
        from .plans import run
        from .plans.digest import Options
        from .runtime import ship, shared_dir
        from .sinks import mail, render
        from .sources import config, landing
        from .sources.tables import CacheTables

        if not a.config:
            raise ValueError("--config names the folder of europe.json, monde.json and langues.json")
        formats = _listed(a.format)
        if unknown := [f for f in formats if f not in render.FORMATS]:
            raise ValueError(f"unknown format: {', '.join(unknown)}; known: {', '.join(render.FORMATS)}")
        if a.sans_fichiers and not a.email and not a.stdout:
            raise ValueError("--sans-fichiers without --email: the digest would go nowhere")
        spark = SparkSession.builder.getOrCreate()
        ship(spark)
        settings = config.load(spark, a.config)
        window = resolve_window(now, a.depuis, a.jusqu_a, a.semaine, a.semaine_du, a.jours)
        days = max(1.0, -(-(window.end - window.start).total_seconds() // 86400))
        landed = spark.read.parquet(a.brut) if a.brut else None
        scope = run.Scope(_listed(a.profils) or ("actualite", "antisemitisme"), tuple(c.upper() for c in _listed(a.pays)), not a.sans_google_news, not a.sans_medias, not (a.sans_google_books or a.brut), a.concurrence or landing.PARALLEL, landing.RETRIES, fetch or landing.http_get, landed)
        if a.command == "sources":
            listed = run.feeds_of(settings, scope, days)
            if a.check:
                report = run.collected(settings, scope, window, days)[1].orderBy("status", "name")
                rows = [r.asDict() for r in report.collect()]
                print("\n".join(f"{r['status']} {r['total']} {r['name']} {r['error'] or ''}".rstrip() for r in rows))
                return 0
            rows = [r.asDict() for r in listed.orderBy("ord").collect()]
            print(render.sources_page(rows) if a.html else "\n".join(f"{r['country'] or '-'} {r['name']} {r['url']}" for r in rows))
            return 0
        cache = None if a.sans_cache or a.brut else CacheTables(spark, a.cache or f"{shared_dir(spark)}/newsloom-cache")
        if cache and a.vider_cache:
            for namespace in ("http", "translations"):
                cache.clear(namespace)
        rubrics = RUBRICS | {k: v for k, v in (("livre", a.livres), ("podcast", a.podcasts), ("evenement", a.evenements)) if v is not None}
        options = Options(now, window, a.min if a.min is not None else 3.0, a.par_pays or 6, a.a_la_une or 8, rubrics)
        found = run.revue(spark, settings, scope, options, provider(a.traduction, **(translators or {})), cache, lambda stage, done, of: log(f"{stage} {done}/{of}"))
        for name in formats:
            form = render.FORMATS[name]
            text = form.render(found)
            if a.stdout or (not a.sortie and not a.sans_fichiers):
                print(text)
            elif not a.sans_fichiers:
                target = pathlib.Path(a.sortie) / f"revue-{found['meta']['edition']}.{form.extension}"
                target.parent.mkdir(parents=True, exist_ok=True)
                target.write_text(text, encoding="utf-8")
        if a.email:
            if a.essai_a_vide:
                log(f"not sent: {a.email}: {a.sujet or render.subject(found)}")
            elif transport is None:
                raise ValueError("--email needs a transport from the caller")
            else:
                mail.deliver(found, a.email, transport, a.de or mail.parse_recipients(a.email)[0], subject=a.sujet)
        return 0
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
