"""Tolerant parsing of RSS 2.0, RSS 1.0 and Atom with native expressions: raw feed texts in, items and articles out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup as M
from ..functions import text as T
from ..functions.dates import parse_date
from ..functions.urls import canonical_url, hostname

_PREFIX = r"(?:[A-Za-z0-9_.-]+:)?"
# Elements of the three formats, those of texts and those of markup, and file names of pictures and sounds.
SHORT = ("title", "link", "guid", "id", "pubdate", "dc:date", "published", "issued", "updated", "date", "lastbuilddate", "dc:creator", "source", "language", "dc:language")
LONG = ("content:encoded", "content", "description", "summary", "subtitle")
REPEATED = ("author", "category", "enclosure", "thumbnail")
PICTURES, SOUNDS = r"(?i)\.(jpe?g|png|webp|gif|avif)(\?|$)", r"(?i)\.(mp3|m4a|ogg|aac|wav)(\?|$)"
_TAGS = M.tag_pattern([n.split(":")[-1] for n in (*SHORT, *LONG, *REPEATED)])
_HTTP = T.quoted(r"(?i)^https?://")


def _some(value: str) -> str:
    return f"nullif({value}, '')"


def _block(text: str, use: str) -> str:
    """``use`` of the fields of an entry, or of what stands ahead of the first one, in which ``b_`` stands for them."""
    said = f"transform({M.contents('s_', SHORT)}, v_ -> CASE WHEN v_ IS NOT NULL THEN {T.sql_collapsed(T.sql_decoded('v_'))} END)"
    links = M.attributes("s_", ["link", "enclosure", "media:content", "media:thumbnail"], ["href", "rel", "url", "type", "medium", "length"])
    fields = f"named_struct('short', {said}, 'long', {M.contents('s_', LONG)}, 'links', {links}, 'categories', {M.every('s_', 'category')}, 'authors', {M.every('s_', 'author')})"
    return T.let("s_", M.scanned(text, _TAGS), T.let("b_", fields, use))


def _text(*names: str) -> str:
    """The first of those elements, as text; null without one."""
    return f"coalesce({', '.join(f'get(b_.short, {SHORT.index(n.lower())})' for n in names)}, NULL)"


def _html(*names: str) -> str:
    return f"coalesce({', '.join(f'get(b_.long, {LONG.index(n)})' for n in names)}, NULL)"


def _tags(name: str, test: str) -> str:
    """Tags of a name that pass, in order; ``a_`` stands for one."""
    return f"filter(b_.links, a_ -> a_.name = '{name}' AND coalesce({test}, false))"


_ALTERNATE = f"a_.href <> '' AND lower(coalesce({_some('a_.rel')}, 'alternate')) = 'alternate'"
# a link tag that is the alternate, else a text link, else any other link tag, else a guid that is a URL
_LINK = f"""coalesce(get({_tags('link', _ALTERNATE)}, 0).href, CASE WHEN {_text('link')} RLIKE {_HTTP} THEN {_text('link')} END,
  get({_tags('link', "a_.href <> ''")}, 0).href, CASE WHEN {_text('guid', 'id')} RLIKE {_HTTP} THEN {_text('guid', 'id')} END)"""
_HEAD_LINK = f"coalesce(get({_tags('link', _ALTERNATE)}, 0).href, {_text('link')})"

_IS_IMAGE = f"a_.url <> '' AND (coalesce(a_.medium, '') = 'image' OR startswith(coalesce(a_.type, ''), 'image/') OR a_.url RLIKE {T.quoted(PICTURES)})"
_IN_HTML = T.quoted(r"(?i)<img[^>]+src\s*=\s*(?:\x22([^\x22]+)\x22|\x27([^\x27]+)\x27|([^\s>]+))")


def _image(shown: str) -> str:
    inside = "concat(" + ", ".join(f"regexp_extract({shown}, {_IN_HTML}, {k})" for k in (1, 2, 3)) + ")"
    enclosed = _tags("enclosure", "a_.url <> '' AND startswith(a_.type, 'image/')")
    return f"coalesce(get({_tags('media:content', _IS_IMAGE)}, 0).url, get({_tags('media:thumbnail', _IS_IMAGE)}, 0).url, get({enclosed}, 0).url, CASE WHEN {shown} RLIKE {_IN_HTML} THEN {T.sql_decoded(inside)} END)"


def _audio() -> str:
    """(url, type, length) of the first sound."""
    sound = "startswith(coalesce(a_.type, ''), 'audio/')"
    told = lambda length: f"a_ -> named_struct('url', a_.url, 'type', {_some('a_.type')}, 'length', {length})"
    enclosed, media = _tags("enclosure", f"a_.url <> '' AND ({sound} OR a_.url RLIKE {T.quoted(SOUNDS)})"), _tags("media:content", f"a_.url <> '' AND ({sound} OR coalesce(a_.medium, '') = 'audio')")
    return f"coalesce(get(transform({enclosed}, {told(_some('a_.length'))}), 0), get(transform({media}, {told('cast(NULL AS STRING)')}), 0))"


def _categories() -> str:
    """Distinct terms or texts of under 80 characters."""
    named = T.sql_collapsed(T.sql_decoded(f"coalesce({_some(M.attribute('e_.tag', 'term'))}, e_.body)"))
    return f"array_distinct(filter(transform(b_.categories, e_ -> {named}), v_ -> v_ <> '' AND length(v_) < 80))"


def _author() -> str:
    """Creator, else an author's name, else the name in parentheses, else a text that is no address."""
    within = T.quoted(rf"(?is)<{_PREFIX}name(?:\s[^>]*)?>(?:\s*<!\[CDATA\[)?(.*?)(?:\]\]>\s*)?</{_PREFIX}name\s*>")
    inner = T.sql_collapsed(T.sql_decoded(f"regexp_extract(e_.body, {within}, 1)"))
    plain = T.sql_collapsed(T.sql_decoded("regexp_replace(e_.body, '<[^>]*>', ' ')"))
    inside = f"regexp_extract(p_, {T.quoted(r'\(([^)]+)\)')}, 1)"
    other = T.let("p_", plain, f"CASE WHEN {inside} <> '' THEN {T.sql_collapsed(inside)} WHEN p_ <> '' AND NOT contains(p_, '@') THEN p_ END")
    one = T.let("n_", inner, f"CASE WHEN n_ <> '' THEN n_ ELSE {other} END")
    return f"coalesce({_some(_text('dc:creator'))}, get(filter(transform(b_.authors, e_ -> {one}), v_ -> v_ IS NOT NULL), 0))"


def _item() -> str:
    """One entry's fields; what its content lacks its summary gives, and the other way round."""
    content = f"coalesce({_html(*LONG)}, '')"
    summary = f"coalesce({_some(_html('description', 'summary', 'subtitle'))}, {content})"
    texts = f"named_struct('content', {content}, 'summary', {summary}, 'title', {_some(_text('title'))}, 'link', {_LINK})"
    html = T.let("d_", T.sql_text("t_.summary"), f"named_struct('summary', d_, 'content', CASE WHEN t_.content = t_.summary THEN d_ ELSE {T.sql_text('t_.content')} END)")
    fields = {
        "title": "t_.title", "link": "t_.link", "guid": f"coalesce({_some(_text('guid', 'id'))}, t_.link, t_.title)",
        "published_raw": _some(_text("pubDate", "dc:date", "published", "issued", "updated", "date")), "updated_raw": _some(_text("updated", "lastBuildDate")),
        "author": _author(), "summary_html": "t_.summary", "summary": "o_.summary", "content_html": "t_.content", "content": "o_.content",
        "categories": _categories(), "image": T.let("r_", f"coalesce({_some('t_.content')}, t_.summary)", _image("r_")), "audio": _audio(), "source": _some(_text("source")),
    }
    told = ", ".join(f"'{k}', {v}" for k, v in fields.items())
    return T.let("t_", texts, T.let("o_", html, f"named_struct({told})"))


def feed_format(body: Column) -> Column:
    atom = body.rlike(r"(?i)<feed[\s>]") & body.rlike(r"""(?i)xmlns\s*=\s*["']http://www\.w3\.org/2005/Atom""")
    return F.when(atom, "atom").when(body.rlike(r"(?i)<rdf:RDF[\s>]"), "rdf").when(body.rlike(r"(?i)<rss[\s>]"), "rss").otherwise("inconnu")


def parse_feeds(feeds: DataFrame, body: str = "body") -> DataFrame:
    """Adds format, feed_title, feed_link, feed_description, language, items (array of struct) and error to raw feeds.

    Text before the first entry is the feed's own. Entries with neither title nor link are left out. An empty text, and one of
    unknown format without entries, has an error and no items; nothing fails the job. Each entry is cut once at its tags, and all
    fields are picked from the events.
    """
    entry = lambda n: T.quoted(rf"(?is)<{_PREFIX}{n}(?:\s[^>]*)?>(.*?)</{_PREFIX}{n}\s*>")
    of = lambda use: F.expr(f"CASE WHEN format = 'atom' THEN {use(entry('entry'))} ELSE {use(entry('item'))} END")
    out = feeds.withColumn("text_", F.regexp_replace(F.coalesce(F.col(body), F.lit("")), "^﻿", "")).withColumn("format", feed_format(F.col("text_")))
    out = out.withColumns({"blocks_": of(lambda p: f"regexp_extract_all(text_, {p}, 1)"), "head_": of(lambda p: f"get(split(text_, {p}, 2), 0)")})
    items = F.expr(f"filter(transform(blocks_, block_ -> {_block('block_', _item())}), i_ -> i_.title <> '' OR i_.link <> '')")
    head = _block("head_", f"named_struct('feed_title', {_text('title')}, 'feed_link', {_HEAD_LINK}, 'feed_description', {T.sql_collapsed(T.sql_decoded(_html('description', 'subtitle')))}, 'language', {_text('language', 'dc:language')})")
    out = out.withColumns({"items": items, "of_feed_": F.expr(head)})
    error = F.when(T.collapse(F.col("text_")) == "", "empty feed").when((F.col("format") == "inconnu") & (F.size("items") == 0), "not a feed")
    named = {n: F.col(f"of_feed_.{n}") for n in ("feed_title", "feed_link", "feed_description", "language")}
    return out.withColumns({**named, "error": error}).drop("text_", "blocks_", "head_", "of_feed_")


def split_publisher(title: Column, source: Column) -> Column:
    """struct(title, publisher) of ``Title - Publisher``: the known source as suffix, else the last dash that leaves a title of
    over 20 characters and a suffix of under 60 with its dash."""
    exact = F.coalesce((source != "") & title.endswith(F.concat(F.lit(" - "), source)), F.lit(False))
    at = F.length(title) - F.locate(" - ", F.reverse(title)) - 2  # characters before the last dash
    found = F.contains(title, F.lit(" - ")) & (at > 20) & (F.length(title) - at < 60)
    head = F.when(exact, F.substring(title, F.lit(1), F.length(title) - F.length(source) - 3)).when(found, F.substring(title, F.lit(1), at)).otherwise(title)
    name = F.when(exact, source).when(found, F.trim(F.substring(title, at + 4, F.length(title)))).otherwise(F.when(source != "", source))
    return F.struct(F.when(exact | found, F.trim(head)).otherwise(head).alias("title"), name.alias("publisher"))


def articles(parsed: DataFrame) -> DataFrame:
    """Items as flat articles. Needs feed_id, feed_name, origin, feed_language, country, weight, forced_type, profile and feed_ord."""
    rows = parsed.select("feed_ord", "feed_id", "feed_name", "origin", "feed_language", "country", "weight", "forced_type", "profile", F.posexplode_outer("items").alias("item_ord", "i")).where("i IS NOT NULL")  # an inner one would parse twice, once to filter
    search = F.col("origin") == "google-news"
    parts = split_publisher(F.col("i.title"), F.col("i.source"))
    title = F.when(search, parts["title"]).otherwise(F.col("i.title"))
    own = F.when(search, parts["publisher"]).otherwise(F.col("feed_name"))
    key = F.coalesce(F.when(F.col("i.guid") != "", F.col("i.guid")), F.col("i.link"), title)
    body = F.coalesce(F.when(F.col("i.summary") != "", F.col("i.summary")), F.col("i.content"), F.lit(""))
    return rows.select(
        F.struct("feed_ord", "item_ord").alias("ord"), F.concat_ws("::", "feed_id", key).alias("id"), F.coalesce(F.nullif(T.collapse(title), F.lit("")), F.lit("(sans titre)")).alias("title"), F.col("i.link").alias("link"), canonical_url(F.col("i.link")).alias("canonical"), key.alias("guid"),
        F.coalesce(parse_date(F.col("i.published_raw")), parse_date(F.col("i.updated_raw"))).alias("date"), F.when(~search, T.excerpt(body, 400)).when(F.length("i.summary") > 160, T.excerpt(F.col("i.summary"), 400)).otherwise("").alias("summary"), F.col("i.author").alias("author"), F.col("i.image").alias("image"), F.col("i.audio").alias("audio"), F.col("i.categories").alias("categories"),
        F.col("feed_language").alias("language"), F.coalesce(F.nullif(own, F.lit("")), hostname(F.col("i.link")), F.col("feed_name")).alias("publisher"), "country", "feed_id", "feed_name", "origin", F.coalesce("weight", F.lit(1.5)).alias("weight"), "forced_type", "profile",
    )
