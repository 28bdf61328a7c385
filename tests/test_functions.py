"""Expected values of the scalar functions."""

import datetime as dt
import random
import unicodedata

import pytest
import regex as re_
from pyspark.sql import functions as F

from newsloom.functions import dates as D
from newsloom.functions import lexicon as L
from newsloom.functions import text as T
from newsloom.functions import urls as U


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("raw, want", [("caf&eacute; &amp; th&#233;", "café & thé"), ("&#x1F600;", "😀"), ("&inconnu; &AMP;", "&inconnu; &"), ("&#55296; &#x110000;", "&#55296; &#x110000;"), ("&amp;lt;", "&lt;"), ("", ""), (None, "")])
def test_entities(spark, raw, want):
    assert value(spark, T.decode_entities(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize("raw, want", [("<p>Un</p><p>deux</p>", "Un deux"), ("&lt;p&gt;Bonjour &amp;eacute;&lt;/p&gt;", "Bonjour é"), ("a<script>x<b></script>b<!-- c -->d", "a b d"), ("in<b>side</b>", "inside"), ("  a ​b ", "a b")])
def test_html_to_text(spark, raw, want):
    assert value(spark, T.html_to_text(F.lit(raw))) == want


def test_excerpt(spark):
    assert value(spark, T.excerpt(F.lit("court"), 10)) == "court"
    assert value(spark, T.excerpt(F.lit("un deux trois quatre, cinq"), 22)) == "un deux trois quatre…"
    assert value(spark, T.excerpt(F.lit("a" * 30), 10)) == "a" * 10 + "…"


def test_titles(spark):
    assert value(spark, T.normalize_title(F.lit("L’Été à Łódź : « Żydzi »!"))) == "l ete a łodz zydzi"
    assert value(spark, T.significant_tokens(F.lit("Le procès de la ville et the city"))) == ["proces", "ville", "city"]
    assert value(spark, T.significant_stems(F.lit("attaquée attaques"))) == ["attaqu"]
    assert value(spark, T.trigrams(F.lit("ab"))) == [" ab", "ab "]
    assert value(spark, T.trigrams(F.lit(""))) == []
    assert value(spark, T.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 0.5
    assert value(spark, T.dice(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == pytest.approx(2 / 3)
    assert value(spark, T.slugify(F.lit("Été !! 2026"))) == "ete-2026"
    assert value(spark, T.slugify(F.lit("!!"))) == "sans-titre"
    assert value(spark, T.escape_markdown(F.lit("a*b_[c] (d)"))) == r"a\*b\_\[c\] (d)"


@pytest.mark.parametrize("url, want", [("http://www.Exemple.fr/a/?utm_source=x&b=2&a=1#h", "https://exemple.fr/a/?a=1&b=2"), ("https://exemple.fr/a/", "https://exemple.fr/a"), ("https://exemple.fr", "https://exemple.fr/"), ("https://e.fr/x?reference=1", "https://e.fr/x"), ("pas une url", "pas une url"), ("", None)])
def test_canonical_url(spark, url, want):
    assert value(spark, U.canonical_url(F.lit(url))) == want


@pytest.mark.parametrize("raw, want", [("Mon, 27 Jul 2026 08:30:00 +0200", "2026-07-27 06:30:00"), ("Mon, 27 Jul 2026 08:30:00 GMT", "2026-07-27 08:30:00"), ("2026-07-27T08:30:00Z", "2026-07-27 08:30:00"), ("2026-07-27 08:30:00", "2026-07-27 08:30:00"), ("Mon, 27 Jul 2026 08:30:00 +0200 (CEST)", "2026-07-27 06:30:00"), ("n'importe quoi", None), ("", None)])
def test_parse_date(spark, raw, want):
    assert value(spark, D.parse_date(F.lit(raw)).cast("string")) == want


def test_published_precision(spark):
    got = [value(spark, D.published_date(F.lit(x))["precision"]) for x in ("2026-07-27", "2026-07", "2026", "rien")]
    assert got == ["jour", "mois", "annee", None]


def test_windows():
    now = dt.datetime(2026, 7, 22, 15)
    w = D.resolve_window(now, week=True)
    assert (w.start, w.end.date()) == (dt.datetime(2026, 7, 19), dt.date(2026, 7, 25))
    assert D.format_range(w.start, w.end) == "du 19 au 25 juillet 2026"
    assert D.edition_slug(w.start) == "2026-07-19"
    assert D.resolve_window(now).start == now - dt.timedelta(days=7)
    with pytest.raises(ValueError, match="before it starts"):  # an unreadable end counts as 1970
        D.resolve_window(now, until="rien")
    with pytest.raises(ValueError, match="no date"):
        D.resolve_window(now, since="rien")


def test_hebrew_date():
    assert D.hebrew_date(dt.date(2024, 10, 3)) == (5785, 7, 1)
    assert D.hebrew_date(dt.date(2026, 7, 26)) == (5786, 5, 12)


def test_lexicon(spark):
    a = L.Analyzer({"pl": L.Vocabulary(core=["żydzi"], core_roots=["żyd"]), "en": L.Vocabulary(core=["rabbi"])})
    score = lambda t, lang: value(spark, a.relevance(F.lit(t), F.lit(""), F.lit(None).cast("array<string>"), F.lit(lang).cast("string"))["score"])
    assert score("Festiwal o Żydach w Krakowie", "pl") == 3
    assert score("Rabbit recipes", "en") == 0
    assert score("A rabbi speaks", "en-GB") == 3
    assert score("A rabbi speaks", None) == 3
    assert score("A rabbi in the synagogue", "xx") == 3
    kind = lambda t, forced=None, audio=False: value(spark, a.content_type(F.lit(t), F.lit(""), F.lit(forced).cast("string"), F.lit(audio)))
    assert [kind("Nouveau roman"), kind("Épisode 3"), kind("Grande exposition"), kind("Rien"), kind("x", "livre"), kind("x", None, True)] == ["livre", "podcast", "evenement", "actualite", "livre", "podcast"]
    assert value(spark, a.tags(F.lit("Israel and the rabbi"), F.lit(""), F.lit("en"))) == ["Israël", "vie juive"]


def test_dictionary_equals_expressions(spark):
    """The dictionary finds what one alternation for each group finds, phrases and roots of several words among them."""
    rng = random.Random(4)
    parts = ["vie", "juive", "tel", "aviv", "art", "l'art", "livre", "livres", "roman", "synagogue", "synagogal", "żydach", "rabbi", "rabbit", "anti", "juif", "juifs", "c++", "2026", "x1", "jews", "israel", "conférence", "lecture", "series", "éditions", "podcast", "juives7", "thing", "things", "über", "ß", "a", "-", "--", "tel-aviv"]
    vocabulary = {"fr": L.Vocabulary(core=["vie juive", "juif", "vie"], hostile=["anti-juif", "haine"], culture=["l'art", "c++"], core_roots=["juiv", "vie jui"], hostile_roots=["anti"]), "pl": L.Vocabulary(core=["żydzi"], core_roots=["żyd", "a"], books=["livre"])}
    a = L.Analyzer(vocabulary)
    texts = [T_ for _ in range(400) for T_ in [rng.choice([" ", "  ", ", "]).join(rng.choice(parts) for _ in range(rng.randint(0, 9)))]] + ["", "Juif-juif JUIFS", "vie  juive", "tel aviv tel", "vie juive vie"]
    rows = spark.createDataFrame([(t, lang) for t in texts for lang in ("fr", "pl-PL", "xx", None)], "t string, lang string")
    groups = ["hostile", "israel", "culture", "podcast", "event", "books"]
    text = T.fold(F.col("t"))
    got = rows.withColumn("s", a.scan(text)).select("t", "lang", *(a.hits(F.col("s"), g).alias(g) for g in groups), a.core_hits(F.col("s"), F.col("lang")).alias("core")).collect()
    plain = lambda group: re_.compile(a.dictionary.patterns[group].replace("(?iu)", "")) if a.dictionary.patterns[group] else None
    compiled = {g: plain(g) for g in a.dictionary.patterns}
    for r in got:
        folded = "".join(c for c in unicodedata.normalize("NFD", r["t"]) if not 0x300 <= ord(c) <= 0x36F).lower()
        core = {"fr": "core:fr", "pl-PL": "core:pl", "xx": "universal", None: "fallback"}[r["lang"]]
        for name, group in [*((g, g) for g in groups), ("core", core)]:
            want = list(dict.fromkeys(m.group(0) for m in compiled[group].finditer(folded))) if compiled[group] else []
            assert r[name] == want, (r["t"], name)


def test_dictionary_bounds(spark):
    assert value(spark, L.Analyzer({}).relevance(F.lit("Jews in a synagogue"), F.lit(None).cast("string"), F.lit(None).cast("array<string>"), F.lit("en")))["motifs"] == ["jews", "synagogue"]
    assert value(spark, L.Analyzer({}).content_type(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(False))) == "actualite"
    with pytest.raises(ValueError, match="at most 54 languages"):
        L.Analyzer({f"l{k}": L.Vocabulary() for k in range(55)})


@pytest.mark.parametrize("title, summary, want", [("Title", "a book", 1), ("a book", "", 2), ("Exposition", "", 2), ("Soirée théâtre", "", 0)])
def test_titles_count_double(spark, title, summary, want):
    a = L.Analyzer({"fr": L.Vocabulary(culture=["musée"])})
    kind = value(spark, a.content_type(F.lit(title), F.lit(summary), F.lit(None).cast("string"), F.lit(False)))
    assert kind == ("actualite" if want < 2 else "evenement" if title == "Exposition" else "livre")
    assert value(spark, a.content_type(F.lit("Au musée"), F.lit(""), F.lit(None).cast("string"), F.lit(False))) == "evenement"  # words of culture announce events


def test_international_hosts(spark):
    rng = random.Random(1)
    labels = ["bücher", "пример", "παράδειγμα", "faß", "日本語", "abc", "a-b", "😀", "中文测试", "a😀b日c", "é"] + ["".join(rng.choice("abcdéüñжλ日😀-") for _ in range(rng.randint(1, 12))) for _ in range(150)]
    got = spark.createDataFrame([(x,) for x in labels], "x string").select("x", F.expr(f"get(transform(array(x), y_ -> {U.sql_ascii_label('y_')}), 0)").alias("a"))
    assert {r["x"]: r["a"] for r in got.collect()} == {x: x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in labels}


@pytest.mark.parametrize("url, want, host", [
    ("https://WWW.Bücher.example/straße?ß=ü&a=1", "https://xn--bcher-kva.example/stra%C3%9Fe?a=1&%C3%9F=%C3%BC", "xn--bcher-kva.example"),
    ("http://пример.рф", "https://xn--e1afmkfd.xn--p1ai/", "xn--e1afmkfd.xn--p1ai"),
    ("https://παράδειγμα。gr/x/", "https://xn--hxajbheg2az3al.gr/x", "xn--hxajbheg2az3al.gr"),
    ("http://e.fr:80/a", "https://e.fr/a", "e.fr"),
    ("http://e.fr:8080/a", "https://e.fr:8080/a", "e.fr"),
    ("https://e.fr/x?q=a b&p=%zz&k&UTM_x=1", "https://e.fr/x?k=&p=%25zz&q=a+b", "e.fr"),
    ("https://e.fr/x?b=2&a=2&b=1&a=%C3%A9*-._~", "https://e.fr/x?a=2&a=%C3%A9*-._%7E&b=2&b=1", "e.fr"),
    ("mailto:a@b.example", "mailto:a@b.example", None),
])
def test_links_of_any_script(spark, url, want, host):
    assert (value(spark, U.canonical_url(F.lit(url))), value(spark, U.hostname(F.lit(url)))) == (want, host)
