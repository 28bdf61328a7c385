"""The digest as JSON, Markdown, HTML, e-mail HTML and text. A digest holds what is published (some hundred entries), so it is text on the driver."""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable
from dataclasses import dataclass

RUBRICS = (("livres", "Parutions"), ("podcasts", "Podcasts"), ("evenements", "Événements"))
TITLE = "Revue de presse"


def markdown_escape(text: str | None) -> str:
    return re.sub(r"([\\`*_\[\]<>])", r"\\\1", text or "")


def _sections(d: dict) -> list[tuple[str, list[dict]]]:
    out = [("À la une", d.get("front_page", []))] + [(c["name"], c["articles"]) for c in d.get("countries", [])]
    return [(t, a) for t, a in out + [(title, d.get(k, [])) for k, title in RUBRICS] if a]


def _counts(d: dict) -> str:
    m = d["meta"]
    return f"{m['countries']} pays, {m['stories']} sujets, {m['collected']} articles de {m['answered']} sources sur {m['sources']}"


def _origin(e: dict) -> str:
    more = e.get("n_reprises") or 0
    also = f" ; repris par {', '.join(e['reprises'])}{'…' if more > len(e['reprises']) else ''}" if more else ""
    return ", ".join(filter(None, (e.get("publisher"), (e.get("date_iso") or "")[:10]))) + also


def _failures(d: dict) -> list[dict]:
    return [r for r in d.get("report", []) if r.get("state") == "echec"]


def to_json(d: dict) -> str:
    return json.dumps(d, ensure_ascii=False, indent=2, default=str)


def to_markdown(d: dict) -> str:
    esc, lines = markdown_escape, [f"# {TITLE} — {d['meta']['range']}", "", _counts(d), ""]
    for title, entries in _sections(d):
        lines += [f"## {esc(title)}", ""]
        for e in entries:
            name = f"[{esc(e['title'])}]({e['link']})" if e.get("link") else esc(e["title"])
            lines += [f"- **{name}** — {esc(_origin(e))}"]
            lines += [f"  {esc(e['summary'])}"] if e.get("summary") else []
            lines += [f"  _{', '.join(map(esc, e['tags']))}_"] if e.get("tags") else []
        lines += [""]
    if d.get("silent"):
        lines += ["## Sans remontée", "", esc(", ".join(d["silent"])), ""]
    if failed := _failures(d):
        lines += ["## Sources en échec", "", *(f"- {esc(r['name'])} : {esc(r.get('error'))}" for r in failed), ""]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip() + "\n"


def _entry_html(e: dict, style: Callable[[str], str]) -> str:
    esc = lambda x: html.escape(str(x or ""))
    link = e.get("link") if re.match(r"https?://", e.get("link") or "") else None
    title = f'<a href="{esc(link)}"{style("link")}>{esc(e["title"])}</a>' if link else esc(e["title"])
    parts = [f"<h3{style('h3')}>{title}</h3>", f"<p{style('meta')}>{esc(_origin(e))}</p>"]
    if e.get("summary"):
        parts.append(f"<p{style('p')}>{esc(e['summary'])}</p>")
    if e.get("tags"):
        parts.append(f"<p{style('meta')}>{esc(', '.join(e['tags']))}</p>")
    if e.get("isbn"):
        parts.append(f"<p{style('meta')}>ISBN {esc(e['isbn'])}</p>")
    if (e.get("audio") or {}).get("url"):
        parts.append(f'<p{style("meta")}><a href="{esc(e["audio"]["url"])}">Écouter</a></p>')
    return "<article>" + "".join(parts) + "</article>"


def to_html(d: dict) -> str:
    """One page without scripts: contents with numbers, sections, and failing sources at the end."""
    esc, plain = html.escape, lambda _: ""
    sections = _sections(d)
    nav = "".join(f'<li><a href="#s{k}">{esc(t)}</a> ({len(a)})</li>' for k, (t, a) in enumerate(sections))
    body = "".join(f'<section id="s{k}"><h2>{esc(t)}</h2>{"".join(_entry_html(e, plain) for e in a)}</section>' for k, (t, a) in enumerate(sections))
    silent = f"<p>Sans remontée : {esc(', '.join(d['silent']))}</p>" if d.get("silent") else ""
    failed = "".join(f"<li>{esc(r['name'])} : {esc(str(r.get('error')))}</li>" for r in _failures(d))
    css = "body{font:16px/1.5 serif;max-width:44em;margin:auto;padding:1em}h3{margin:.8em 0 0}p{margin:.2em 0}"
    return f'<!doctype html><html lang="fr"><head><meta charset="utf-8"><title>{TITLE} — {esc(d["meta"]["range"])}</title><style>{css}</style></head><body><h1>{TITLE}</h1><p>{esc(d["meta"]["range"])}</p><p>{esc(_counts(d))}</p><nav><ul>{nav}</ul></nav>{body}<footer>{silent}{f"<ul>{failed}</ul>" if failed else ""}</footer></body></html>'


_STYLES = {"h3": "font-size:16px;margin:12px 0 0", "meta": "color:#666;font-size:13px;margin:2px 0", "p": "margin:4px 0", "link": "color:#1a4b8c"}


def to_email(d: dict) -> str:
    """Inline styles only; at most eight failing sources by name."""
    esc, style = html.escape, lambda k: f' style="{_STYLES[k]}"'
    body = "".join(f'<h2 style="font-size:19px;border-bottom:1px solid #ccc">{esc(t)}</h2>{"".join(_entry_html(e, style) for e in a)}' for t, a in _sections(d))
    names = [r["name"] for r in _failures(d)]
    failed = f'<p style="color:#666">Sources en échec : {esc(", ".join(names[:8]))}{"…" if len(names) > 8 else ""}</p>' if names else ""
    return f'<div style="font-family:Georgia,serif;max-width:640px;margin:auto"><h1 style="font-size:24px">{TITLE}</h1><p>{esc(d["meta"]["range"])} — {esc(_counts(d))}</p>{body}{failed}</div>'


def to_text(d: dict) -> str:
    lines = [f"{TITLE.upper()} — {d['meta']['range']}", _counts(d)]
    for title, entries in _sections(d):
        lines += ["", "=" * 64, title.upper(), "=" * 64]
        for e in entries:
            lines += ["", e["title"], _origin(e), *([e["summary"]] if e.get("summary") else []), *([e["link"]] if e.get("link") else [])]
    return "\n".join(lines) + "\n"


def subject(d: dict) -> str:
    return f"{TITLE} — {d['meta']['range']} · {d['meta']['countries']} pays, {d['meta']['stories']} sujets"


@dataclass(frozen=True)
class Format:
    extension: str
    render: Callable[[dict], str]


FORMATS = {"html": Format("html", to_html), "md": Format("md", to_markdown), "markdown": Format("md", to_markdown), "json": Format("json", to_json), "email": Format("email.html", to_email), "texte": Format("txt", to_text)}


def sources_page(feeds: list[dict]) -> str:
    """Every feed with its link, by country in name order, then the world's by rubric."""
    from itertools import groupby

    esc, place = html.escape, lambda f: (f.get("country_name") is None, f.get("country_name") or f.get("forced_type") or "monde")
    parts = []
    for (_, name), some in groupby(sorted(feeds, key=place), key=place):
        rows = list(some)
        items = "".join(f'<li><a href="{esc(f["url"])}">{esc(f["name"])}</a> ({esc(f.get("language") or "?")})</li>' for f in rows)
        parts.append(f"<section><h2>{esc(name)} ({len(rows)})</h2><ul>{items}</ul></section>")
    return f'<!doctype html><html lang="fr"><head><meta charset="utf-8"><title>Sources</title></head><body><h1>Sources ({len(feeds)})</h1>{"".join(parts)}</body></html>'
