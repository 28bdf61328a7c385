"""The one-pass scanner over loose feeds: formats, orders of fallback, broken markup."""

import pytest
from pyspark.sql import functions as F

from newsloom.functions import markup as M
from newsloom.sources import feeds


def items(spark, *bodies):
    rows = feeds.parse_feeds(spark.createDataFrame(list(enumerate(bodies)), "k int, body string")).orderBy("k").collect()
    return rows


def rss(inner, head=""):
    return f"<rss><channel>{head}{inner}</channel></rss>"


@pytest.fixture(scope="module")
def read(spark):
    """All small entries of this module, parsed at once."""
    inners = [c[0] for c in FIELDS + SOUNDS]
    found = items(spark, *(rss(f"<item><title>t</title>{x}</item>") for x in inners))
    return {x: r["items"][0] for x, r in zip(inners, found, strict=True)}


def test_formats_and_heads(spark):
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><title>A &amp; B</title><subtitle>sub</subtitle><link rel="self" href="https://x/self"/><link href="https://x/"/><entry><title>e</title></entry><item><title>no</title></item></feed>'
    rdf = '<rdf:RDF xmlns:rdf="u"><channel><title>R</title><link>https://r/</link><dc:language>lt</dc:language></channel><item><title>i</title></item></rdf:RDF>'
    got = items(spark, atom, rdf, rss("<item><title>x</title></item>", "<title>H</title><description>d &lt;b&gt;</description><language>de</language>"), "﻿" + rss("<item><title>x</title></item>"), "<feed><entry><title>e</title></entry></feed>", "<x><item><title>loose</title></item></x>", "<x></x>", "  ", None)
    assert [(r["format"], len(r["items"]), r["error"]) for r in got] == [("atom", 1, None), ("rdf", 1, None), ("rss", 1, None), ("rss", 1, None), ("inconnu", 0, "not a feed"), ("inconnu", 1, None), ("inconnu", 0, "not a feed"), ("inconnu", 0, "empty feed"), ("inconnu", 0, "empty feed")]
    assert (got[0]["feed_title"], got[0]["feed_link"], got[0]["feed_description"]) == ("A & B", "https://x/", "sub")
    assert (got[1]["feed_link"], got[1]["language"], got[2]["feed_title"], got[2]["feed_description"], got[2]["language"]) == ("https://r/", "lt", "H", "d <b>", "de")


FIELDS = [
    ("<pubDate> </pubDate><dc:date>2026-01-02</dc:date><published>p</published>", "published_raw", "2026-01-02"),
    ("<published>p</published><issued>i</issued>", "published_raw", "p"),
    ("<date>d</date>", "published_raw", "d"),
    ("<updated>u</updated>", "published_raw", "u"),
    ("<lastBuildDate>l</lastBuildDate>", "updated_raw", "l"),
    ("<GUID isPermaLink='false'> g&amp;h </GUID>", "guid", "g&h"),
    ("<link>https://x/1</link>", "guid", "https://x/1"),
    ("", "guid", "t"),
    ("<guid>https://x/g</guid>", "link", "https://x/g"),
    ("<guid>no url</guid>", "link", None),
    ("<link>mailto:x</link>", "link", None),
    ("<atom:link rel='self' href='https://x/self'/><link>https://x/2</link>", "link", "https://x/self"),  # an element reaches from the first start tag to the next end tag
    ("<link rel='enclosure' href='https://x/e'/><link rel=alternate href=https://x/a/>", "link", "https://x/a"),
    ("<link>https://x/3</link><link href='https://x/4'/>", "link", "https://x/4"),
    ("<dc:creator><![CDATA[ Ann\n Other ]]></dc:creator><author>b@x (Bob)</author>", "author", "Ann Other"),
    ("<author>b@x.example (Bob  B)</author>", "author", "Bob B"),
    ("<author>b@x.example</author><author><name>Cid</name></author>", "author", "Cid"),
    ("<author>Dora</author>", "author", "Dora"),
    ("<author>d@x.example</author>", "author", None),
    ("<source url='u'>Paper</source>", "source", "Paper"),
    ("<description>&lt;p&gt;Le b&amp;acirc;timent&lt;/p&gt;</description>", "summary", "Le bâtiment"),
    ("<description/><summary>s</summary>", "summary_html", ""),
    ("<description> </description><summary>s</summary>", "summary_html", "s"),
    ("<content:encoded><![CDATA[<p>long</p>]]></content:encoded><description>short</description>", "content", "long"),
    ("<content:encoded><![CDATA[<p>long</p>]]></content:encoded>", "summary", "long"),
    ("<description>short</description>", "content", "short"),
    ("<description>a <title>in</title> b</description>", "summary_html", "a <title>in</title> b"),
    ("<category>A</category><category term='B &amp; C'>x</category><category>A</category><category><![CDATA[D]]></category><category term='E'/>", "categories", ["A", "B & C", "D"]),
    (f"<category>{'x' * 80}</category><category>{'y' * 79}</category>", "categories", ["y" * 79]),
    ("<media:content url='https://x/p.webp?w=1'/>", "image", "https://x/p.webp?w=1"),
    ("<media:content url='https://x/v.mp4' type='video/mp4'/><media:thumbnail url='https://x/t' medium='image'></media:thumbnail>", "image", "https://x/t"),
    ("<enclosure url='https://x/e.jpg'/><description>&lt;img&gt;</description>", "image", None),
    ("<enclosure url='https://x/e' type='image/png'/>", "image", "https://x/e"),
    ("<description><![CDATA[<img alt='' src='https://x/i?a=1&amp;b=2'>]]></description>", "image", "https://x/i?a=1&b=2"),
]
SOUNDS = [("<enclosure url='https://x/a.MP3'/>", ("https://x/a.MP3", None, None)), ("<enclosure url='https://x/a' type='audio/ogg' length='5'/>", ("https://x/a", "audio/ogg", "5")), ("<media:content url='https://x/m' medium='audio'/>", ("https://x/m", None, None)), ("<enclosure url='' type='audio/ogg'/>", None), ("<enclosure url='https://x/v.mp4'/>", None)]


@pytest.mark.parametrize("inner, field, want", FIELDS)
def test_fields(read, inner, field, want):
    assert read[inner][field] == want


@pytest.mark.parametrize("inner, want", SOUNDS)
def test_sounds(read, inner, want):
    got = read[inner]["audio"]
    assert (got and tuple(got)) == want


def test_broken_markup_costs_no_neighbour(spark):
    got = items(spark, rss("<item><title>open <b>bold</title><link>https://x/1</item><item><description>neither</description></item><item><title></title><link href='https://x/2'/></item><item><title>A &amp;amp; B &nbsp;C</title>"))[0]
    assert [(i["title"], i["link"]) for i in got["items"]] == [("open <b>bold", None), (None, "https://x/2")]


def test_events_are_linear_in_repeats(spark):
    many = rss("<item><title>t</title>" + "<category>c</category>" * 20_000 + "</item>")
    assert items(spark, many)[0]["items"][0]["categories"] == ["c"]


def test_scan(spark):
    found = spark.createDataFrame([("a<x:Link href='1'/>b<link >c</LINK >d<linked>",), (None,)], "t string").select(F.expr(M.scanned("t", M.tag_pattern(["link"]))).alias("s")).collect()
    s = found[0]["s"]
    assert (s["tags"], s["texts"]) == (["<x:Link href='1'/>", "<link >", "</LINK >"], ["a", "b", "c", "d<linked>"])
    assert list(zip(s["starts_local"], s["ends"], s["empty"], s["any"], strict=True)) == [("link", "", "x:link", "x:link"), ("link", "", "", "link"), ("", "link", "", "")]
    assert found[1]["s"]["tags"] == []
