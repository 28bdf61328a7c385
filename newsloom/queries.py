"""The digest's operators over the driver's tables, each with the SQL that it is held against.

Articles are documents: the title is the first twelve words, the feed ``source``, the country ``doc_id % 25`` (a nation), weights,
dates and origins follow from the id by arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates as D
from .functions import lexicon as L
from .functions import text as T
from .functions import urls as U
from .operators import dedupe, rank, report, translate
from .operators.batches import batches
from .runtime import new_path, spread
from .sources import books, feeds, landing, plan
from .sources.tables import CacheTables, key_of
from .streaming.stories import Stories

QUERIES: dict = {}
SQL: dict[str, str] = {}
WORD = r"[^ \n\t\r]+"
TITLE = r"^[ \n\t\r]*+(?:[^ \n\t\r]++[ \n\t\r]*+){0,12}+"
LEXICON = L.Vocabulary(core=["thing", "tion", "dans"], hostile=["was", "pour"], culture=["with", "und"], books=["that", "les"], core_roots=["thin", "schaft"], hostile_roots=["ent"])
ANALYZER = L.Analyzer({"en": LEXICON, "fr": L.Vocabulary(core=["dans"], core_roots=["men"])})
GENERIC = ["the", "thing"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _articles(spark: SparkSession, sf: str) -> DataFrame:
    d, i = spread(_table(spark, sf, "documents")), F.col("doc_id")
    # the words of the title are told apart in the part that they reach to, not in the whole text
    words = F.regexp_extract_all(F.regexp_extract(F.coalesce("text", F.lit("")), TITLE, 0), F.lit(WORD), F.lit(0))
    return d.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source", F.array_join(words, " ").alias("title"), (i % 25).alias("country"), (1 + i % 3).cast("double").alias("weight"), F.when(i % 7 != 0, F.timestamp_seconds(1704067200 + 3600 * (i % 700))).alias("date"), F.when(i % 4 == 0, "media").when(i % 4 == 1, "monde").otherwise("google-news").alias("origin"), (i * 37 % 101 / 10.0).cast("double").alias("score"))


# -- pieces of SQL --------------------------------------------------------------------------------------------------

_A = rf"""a AS (SELECT doc_id, coalesce(text, '') AS text, lang, source, array_to_string(list_slice(regexp_extract_all(coalesce(text, ''), '{WORD}'), 1, 12), ' ') AS title, doc_id % 25 AS country,
  CAST(1 + doc_id % 3 AS DOUBLE) AS weight, CASE WHEN doc_id % 7 <> 0 THEN make_timestamp(1000000 * (1704067200 + 3600 * (doc_id % 700))) END AS date,
  CASE doc_id % 4 WHEN 0 THEN 'media' WHEN 1 THEN 'monde' ELSE 'google-news' END AS origin, CAST((doc_id * 37) % 101 AS DOUBLE) / 10.0 AS score FROM documents)"""
_SPACES = r"[\s\x0b\x{a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+"


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SPACES}', ' ', 'g'))"


def _decode(x: str) -> str:
    for name in ("quot", "copy", "middot", "amp"):
        x = f"replace({x}, '&{name};', '{T.ENTITIES[name]}')"
    return x


def _strip(x: str) -> str:
    for p, to in ((r"(?is)<script\b.*?</script>", " "), (r"(?is)<style\b.*?</style>", " "), (r"(?s)<!--.*?-->", " "), (r"(?i)<br\s*/?>", " "), (r"(?i)</(?:p|div|li|h[1-6]|tr|blockquote)>", " "), (r"<[^>]*>", "")):
        x = f"regexp_replace({x}, '{p}', '{to}', 'g')"
    return x


def _normal(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower({x})), '[''’ʼ`]', ' ', 'g'), '[^\p{{L}}\p{{N}}\s]+', ' ', 'g'), '\s+', ' ', 'g'))"


_TOKENS = f"list_distinct(list_filter(string_split({{n}}, ' '), lambda w: length(w) > 1 AND NOT list_contains({_list(T.STOPWORDS)}, w)))"
_PRINTS = f"""n AS (SELECT doc_id, country, {_normal('title')} AS normal FROM a),
p AS (SELECT doc_id, country, {_TOKENS.format(n='normal')} AS toks, list_distinct(list_transform({_TOKENS.format(n='normal')}, lambda w: w[1:6])) AS stems,
  list_distinct(list_transform(range(1, length(normal) + 1), lambda i: (' ' || normal || ' ')[i:i+2])) AS grams FROM n)"""
_PAIRS = f"""pairs AS (SELECT x.country AS block, x.doc_id AS a, y.doc_id AS b FROM p x JOIN p y ON x.country = y.country AND x.doc_id < y.doc_id AND len(x.toks) >= 3 AND len(y.toks) >= 3,
  LATERAL (SELECT len(list_intersect(x.stems, y.stems)) AS k, len(list_filter(list_intersect(x.stems, y.stems), lambda s: NOT list_contains({_list(GENERIC)}, s))) AS telling, len(list_intersect(x.grams, y.grams)) AS g) s
  WHERE k / (len(x.stems) + len(y.stems) - k) >= 0.55 OR (k / (len(x.stems) + len(y.stems) - k) >= 0.34 AND 2 * g / (len(x.grams) + len(y.grams)) >= 0.68) OR (telling >= 2 AND k / least(len(x.stems), len(y.stems)) >= 0.5))"""
_CLUSTERS = f"""{_PAIRS}, seq AS (SELECT p.doc_id, p.country AS block, row_number() OVER (PARTITION BY p.country ORDER BY p.doc_id) AS pos, coalesce(nb.l, []) AS before
  FROM p LEFT JOIN (SELECT b, list(a) AS l FROM pairs GROUP BY b) nb ON nb.b = p.doc_id),
r AS (SELECT block, pos, doc_id, doc_id AS founder, [doc_id] AS heads FROM seq WHERE pos = 1 UNION ALL
  SELECT q.block, q.pos, q.doc_id, coalesce(list_min(list_intersect(q.before, r.heads)), q.doc_id), CASE WHEN len(list_intersect(q.before, r.heads)) > 0 THEN r.heads ELSE list_append(r.heads, q.doc_id) END
  FROM r JOIN seq q ON q.block = r.block AND q.pos = r.pos + 1),
c AS (SELECT doc_id, founder AS cluster FROM r)"""
_REP = "(CASE WHEN origin <> 'google-news' THEN 4.0 ELSE 0 END + CASE WHEN date IS NOT NULL THEN 2.0 ELSE 0 END + CASE WHEN text <> '' THEN 1.5 ELSE 0 END + weight)"
_MEMBERS = f"""m AS (SELECT c.cluster, a.*, row_number() OVER (PARTITION BY c.cluster ORDER BY {_REP} DESC, coalesce(epoch_us(date), 0) DESC, a.doc_id) AS place FROM c JOIN a USING (doc_id))"""
_SCORE = "1.2 * least(score, 12.0) + 1.5 * weight + 1.6 * least(size - 1, 4) + 2.0 * greatest(0.0, 1 - coalesce(abs(epoch_us(TIMESTAMP '2024-01-20 00:00:00') - epoch_us(date)) / 86400000000, 3.0) / 7.0) + 0.0 + CASE WHEN text <> '' THEN 0.4 ELSE 0.0 END + CASE WHEN origin = 'media' THEN 0.6 ELSE 0.0 END"


# -- pages ----------------------------------------------------------------------------------------------------------


@query(f"SELECT page_id, {_collapse(_decode(_strip(_decode('html'))))} AS text FROM pages")
def html_to_text(spark, sf):
    return spread(_table(spark, sf, "pages")).select("page_id", T.html_to_text(F.col("html")).alias("text"))


_URLS = rf"""u AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), '^www\.', '') AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path,
  list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(split_part(x, '=', 1), '(?i){U.TRACKING}'))) AS params FROM pages),
v AS (SELECT page_id, url, host, 'https://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS whole, path FROM u),
w AS (SELECT page_id, url, host, CASE WHEN path NOT IN ('', '/') AND ends_with(whole, '/') THEN left(whole, length(whole) - 1) ELSE whole END AS canonical FROM v)"""


@query(f"WITH {_URLS} SELECT page_id, canonical FROM w")
def canonical_urls(spark, sf):
    return _table(spark, sf, "pages").select("page_id", U.canonical_url(F.col("url")).alias("canonical"))


@query(f"WITH {_URLS} SELECT host, count(*) AS n FROM w GROUP BY host")
def host_counts(spark, sf):
    return _table(spark, sf, "pages").groupBy(U.hostname(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query(f"WITH {_URLS} SELECT canonical, count(*) AS n, min(page_id) AS first_page FROM w GROUP BY canonical")
def exact_link_groups(spark, sf):
    rows = _table(spark, sf, "pages").select(F.col("page_id").alias("ord"), U.canonical_url(F.col("url")).alias("canonical"))
    return dedupe.link_groups(rows).groupBy("canonical", "group_ord").agg(F.count("*").alias("n")).select("canonical", "n", F.col("group_ord.ord").alias("first_page"))


@query(f"WITH {_URLS} SELECT host AS url, 'p' || p AS name, o AS ord, CAST(1.0 + p % 5 AS DOUBLE) AS weight FROM (SELECT host, arg_min(page_id, (-(page_id % 5), page_id)) AS p, min(page_id) AS o FROM w GROUP BY host)")
def feed_dedupe(spark, sf):
    rows = _table(spark, sf, "pages").select(U.hostname(F.col("url")).alias("url"), F.concat(F.lit("p"), F.col("page_id")).alias("name"), F.col("page_id").alias("ord"), (1.0 + F.col("page_id") % 5).cast("double").alias("weight"))
    return report.dedupe_feeds(rows).select("url", "name", "ord", "weight")


@query(f"SELECT page_id, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) AS root, {_collapse('url')} AS plain FROM pages")
def site_roots(spark, sf):
    return _table(spark, sf, "pages").select("page_id", U.site_root(F.col("url")).alias("root"), T.collapse(F.col("url")).alias("plain"))


# -- titles ---------------------------------------------------------------------------------------------------------


@query(f"WITH {_A} SELECT doc_id, {_normal('title')} AS normal FROM a")
def normalized_titles(spark, sf):
    return _articles(spark, sf).select("doc_id", T.normalize_title(F.col("title")).alias("normal"))


@query(f"WITH {_A}, {_PRINTS} SELECT doc_id, array_to_string(list_sort(stems), ' ') AS stems, len(toks) AS n_words FROM p")
def significant_stems(spark, sf):
    out = dedupe.fingerprints(_articles(spark, sf))
    return out.select("doc_id", F.array_join(F.array_sort("stems"), " ").alias("stems"), F.col("n_words").cast("long").alias("n_words"))


@query(f"WITH {_A}, {_PRINTS} SELECT doc_id, array_to_string(list_sort(grams), '|') AS grams FROM p")
def title_trigrams(spark, sf):
    return _articles(spark, sf).select("doc_id", F.array_join(F.array_sort(T.trigrams(F.col("title"))), "|").alias("grams"))


@query(rf"""WITH {_A}, x AS (SELECT doc_id, {_collapse('text')} AS clean FROM a), y AS (SELECT *, left(clean, 100) AS cut, 100 - strpos(reverse(left(clean, 100)), ' ') AS cut_at FROM x)
SELECT doc_id, CASE WHEN length(clean) <= 100 THEN clean ELSE regexp_replace(CASE WHEN contains(cut, ' ') AND cut_at > 60 THEN left(cut, cut_at) ELSE cut END, '[\s,;:.!?…-]+$', '') || '…' END AS excerpt FROM y""")
def excerpts(spark, sf):
    return _articles(spark, sf).select("doc_id", T.excerpt(F.col("text"), 100).alias("excerpt"))


@query(f"WITH {_A} SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html, left(trim(regexp_replace(strip_accents(lower(title)), '[^a-z0-9]+', '-', 'g'), '-'), 60) AS slug_start FROM a")
def escaped_texts(spark, sf):
    a = _articles(spark, sf)
    slug = F.substring(F.regexp_replace(F.regexp_replace(T.fold(F.col("title")), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 60)
    return a.select("doc_id", T.escape_html(F.col("text")).alias("html"), slug.alias("slug_start"))


@query(f"""WITH {_A}, x AS (SELECT doc_id, title || ' - ' || source AS t, CASE WHEN doc_id % 2 = 0 THEN source END AS s FROM a), y AS (SELECT *, length(t) - strpos(reverse(t), ' - ') - 2 AS cut_at, s IS NOT NULL AS exact FROM x)
SELECT doc_id, CASE WHEN exact THEN trim(left(t, length(t) - length(s) - 3)) WHEN cut_at > 20 AND length(t) - cut_at < 60 THEN trim(left(t, cut_at)) ELSE t END AS title, CASE WHEN exact THEN s WHEN cut_at > 20 AND length(t) - cut_at < 60 THEN trim(substr(t, cut_at + 4)) END AS publisher FROM y""")
def title_publisher_split(spark, sf):
    a = _articles(spark, sf).select("doc_id", F.concat_ws(" - ", "title", "source").alias("t"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("s"))
    parts = feeds.split_publisher(F.col("t"), F.col("s"))
    return a.select("doc_id", parts["title"].alias("title"), parts["publisher"].alias("publisher"))


# -- dates ----------------------------------------------------------------------------------------------------------


@query("SELECT CAST(date_trunc('day', ts) AS DATE) - CAST(dayofweek(ts) AS INTEGER) AS week_start, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def sunday_weeks(spark, sf):
    e = _table(spark, sf, "events")
    return e.groupBy(D.week_start(F.col("ts")).alias("week_start"), "event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("SELECT event_type, count(*) AS n, count(*) FILTER (ts IS NULL) AS undated FROM (SELECT event_type, CASE WHEN event_id % 10 = 0 THEN NULL ELSE ts END AS ts FROM events) WHERE ts IS NULL OR (ts >= TIMESTAMP '2024-01-08' AND ts <= TIMESTAMP '2024-01-16') GROUP BY event_type")
def sliding_window(spark, sf):
    e = _table(spark, sf, "events").select("event_type", F.when(F.col("event_id") % 10 != 0, F.col("ts").cast("timestamp")).alias("ts"))
    kept = e.where(D.within(F.col("ts"), F.lit("2024-01-08").cast("timestamp"), F.lit("2024-01-15").cast("timestamp")))
    return kept.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("ts").isNull()).alias("undated"))


@query("""WITH x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, o_orderkey % 3 AS k FROM orders), y AS (SELECT o_orderkey, CASE k WHEN 0 THEN 'jour' WHEN 1 THEN 'mois' ELSE 'annee' END AS precision, CAST(CASE k WHEN 0 THEN d WHEN 1 THEN date_trunc('month', d) ELSE date_trunc('year', d) END AS DATE) AS d FROM x)
SELECT precision, count(*) AS n, count(*) FILTER (precision = 'jour' AND d >= DATE '1995-03-05' AND d <= DATE '1995-04-11' OR precision = 'mois' AND last_day(d) >= DATE '1995-03-05' AND d <= DATE '1995-04-11') AS inside FROM y GROUP BY precision""")
def book_precision_window(spark, sf):
    o = _table(spark, sf, "orders")
    shown = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy"))
    rows = o.select(D.published_date(shown).alias("p"))
    inside = D.volume_in_window(F.col("p.date"), F.col("p.precision"), F.lit("1995-03-05").cast("timestamp"), F.lit("1995-04-11").cast("timestamp"))
    return rows.groupBy(F.col("p.precision").alias("precision")).agg(F.count("*").alias("n"), F.count_if(inside).alias("inside"))


# -- relevance ------------------------------------------------------------------------------------------------------


def _sql_known(words, roots=()) -> str:
    """Whether the token ``t`` belongs to a group."""
    plain, starts = _list(sorted({L.folded(w) for w in words})), [L.folded(r) for r in roots]
    return " OR ".join([f"list_contains({plain}, t)"] + [rf"regexp_full_match(t, '{r}\p{{L}}{{0,6}}')" for r in starts])


def _sql_hits(tokens: str, words, roots=()) -> str:
    return f"len(list_distinct(list_filter({tokens}, lambda t: {_sql_known(words, roots)})))"


def _sql_found(tokens: str, words, roots=()) -> str:
    """The distinct tokens of a group in their order."""
    return f"list_filter({tokens}, lambda t, i: list_position({tokens}, t) = i AND ({_sql_known(words, roots)}))"


def _sql_core(tokens: str) -> str:
    en, fr = (_sql_hits(tokens, [*v.core, *L.WORDS], [*v.core_roots, *L.ROOTS]) for v in (LEXICON, L.Vocabulary(core=["dans"], core_roots=["men"])))
    none, other = _sql_hits(tokens, [*LEXICON.core, "dans"], [*LEXICON.core_roots, "men"]), _sql_hits(tokens, L.WORDS, L.ROOTS)
    return f"(CASE WHEN lang IS NULL THEN {none} WHEN lang = 'en' THEN {en} WHEN lang = 'fr' THEN {fr} ELSE {other} END)"


_TOK = r"t AS (SELECT *, regexp_extract_all(lower(strip_accents(title)), '[\p{L}\p{N}]+') AS h, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') AS b FROM a)"
_REL = f"""{_A}, {_TOK}, k AS (SELECT *, {_sql_core('h')} AS ch, {_sql_core('b')} AS cb, {_sql_hits('h', LEXICON.hostile, LEXICON.hostile_roots)} AS bh, {_sql_hits('b', LEXICON.hostile, LEXICON.hostile_roots)} AS bb, {_sql_hits('h', L.ISRAEL)} AS ih, {_sql_hits('b', L.ISRAEL)} AS ib FROM t),
s AS (SELECT *, 3.0 * ch + least(cb, 4) + 3.0 * bh + least(bb, 4) + 1.5 * ih + 0.5 * least(ib, 3) AS relevance FROM k)"""


def _relevant(spark, sf):
    a = _articles(spark, sf)
    r = ANALYZER.relevance(F.col("title"), F.col("text"), F.lit(None).cast("array<string>"), F.col("lang"))
    return a.withColumn("r", r).withColumns({"relevance": F.col("r.score"), "direct": F.col("r.direct")})


@query(f"WITH {_REL} SELECT doc_id, CAST(relevance AS DOUBLE) AS relevance, ch + bh > 0 AS direct FROM s")
def relevance_scores(spark, sf):
    return _relevant(spark, sf).select("doc_id", "relevance", "direct")


@query(f"WITH {_REL} SELECT source, count(*) AS n FROM s WHERE origin = 'media' OR relevance >= 3 GROUP BY source")
def relevance_filter(spark, sf):
    rows = _relevant(spark, sf).withColumn("forced_type", F.lit(None).cast("string"))
    return report.needed_relevance(rows).groupBy("source").agg(F.count("*").alias("n"))


_KINDS = f"""typed AS (SELECT doc_id, country, score, 2 * {_sql_hits('h', [*LEXICON.books, *L.BOOK])} + {_sql_hits('b', [*LEXICON.books, *L.BOOK])} AS book, 2 * {_sql_hits('h', [*LEXICON.culture, *L.EVENT])} + {_sql_hits('b', [*LEXICON.culture, *L.EVENT])} AS event, {_sql_hits('h', L.PODCAST)} AS cast_ FROM t),
y AS (SELECT doc_id, country, score, CASE WHEN doc_id % 11 = 0 THEN 'podcast' WHEN cast_ > 0 THEN 'podcast' WHEN book >= 2 AND book >= event THEN 'livre' WHEN event >= 2 THEN 'evenement' ELSE 'actualite' END AS type FROM typed)"""
_TYPES = f"{_A}, {_TOK}, {_KINDS}"


def _typed(spark, sf):
    a = _articles(spark, sf).withColumn("forced_type", F.when(F.col("doc_id") % 11 == 0, "podcast"))
    return a.withColumn("type", ANALYZER.content_type(F.col("title"), F.col("text"), F.col("forced_type"), F.lit(False)))


@query(f"WITH {_TYPES} SELECT doc_id, type FROM y")
def content_types(spark, sf):
    return _typed(spark, sf).select("doc_id", "type")


@query(f"""WITH {_A}, x AS (SELECT doc_id, lang, regexp_extract_all(lower(strip_accents(title || ' ' || text)), '[\\p{{L}}\\p{{N}}]+') AS b FROM a),
k AS (SELECT doc_id, {_sql_hits('b', LEXICON.hostile, LEXICON.hostile_roots)} > 0 AS bad, {_sql_hits('b', L.ISRAEL)} > 0 AS il, {_sql_hits('b', LEXICON.culture)} > 0 AS cu, {_sql_core('b')} > 0 AS co FROM x)
SELECT doc_id, array_to_string(list_slice(list_filter([CASE WHEN bad THEN 'antisémitisme' END, CASE WHEN il THEN 'Israël' END, CASE WHEN cu THEN 'culture' END, CASE WHEN co AND NOT bad THEN 'vie juive' END], lambda t: t IS NOT NULL), 1, 3), '|') AS tags FROM k""")
def tags(spark, sf):
    return _articles(spark, sf).select("doc_id", F.array_join(ANALYZER.tags(F.col("title"), F.col("text"), F.col("lang")), "|").alias("tags"))


_CORE_FOUND = f"CASE WHEN lang = 'en' THEN {_sql_found('h', [*LEXICON.core, *L.WORDS], [*LEXICON.core_roots, *L.ROOTS])} WHEN lang = 'fr' THEN {_sql_found('h', ['dans', *L.WORDS], ['men', *L.ROOTS])} ELSE {_sql_found('h', L.WORDS, L.ROOTS)} END"


@query(f"""WITH {_A}, {_TOK}, m AS (SELECT doc_id, list_concat({_CORE_FOUND}, {_sql_found('h', LEXICON.hostile, LEXICON.hostile_roots)}, {_sql_found('h', L.ISRAEL)}) AS w FROM t)
SELECT doc_id, array_to_string(list_slice(list_filter(w, lambda x, i: list_position(w, x) = i), 1, 6), '|') AS motifs FROM m""")
def relevance_motifs(spark, sf):
    return _relevant(spark, sf).select("doc_id", F.array_join("r.motifs", "|").alias("motifs"))


@query(f"WITH {_A}, {_PRINTS} SELECT s AS stem, count(*) AS n FROM (SELECT unnest(stems) AS s FROM p) WHERE s IN (SELECT strip_accents(lower(x))[1:6] FROM (SELECT unnest({_list([*LEXICON.core, *LEXICON.hostile, *LEXICON.culture, *LEXICON.books, *LEXICON.core_roots, *LEXICON.hostile_roots, 'dans', 'men'])}) AS x)) GROUP BY s")
def generic_stems(spark, sf):
    """How often titles hold the stems that the vocabulary calls generic, which alone make no two titles alike."""
    stems = dedupe.fingerprints(_articles(spark, sf)).select(F.explode("stems").alias("stem"))
    return stems.where(F.col("stem").isin(ANALYZER.generic)).groupBy("stem").agg(F.count("*").alias("n"))


@query(f"""WITH {_REL}, {_KINDS}
SELECT type, count(*) AS n, CAST(sum(relevance) AS DOUBLE) AS relevance FROM s JOIN y USING (doc_id) GROUP BY type""")
def annotated_articles(spark, sf):
    """Relevance, type and tags of articles from one scan of each text."""
    none = F.lit(None).cast("string")
    a = _articles(spark, sf).withColumns({"summary": F.col("text"), "language": F.col("lang"), "categories": F.array().cast("array<string>"), "audio": none, "forced_type": F.when(F.col("doc_id") % 11 == 0, "podcast")})
    return ANALYZER.annotated(a).groupBy("type").agg(F.count("*").alias("n"), F.sum("relevance").alias("relevance"))


# -- stories --------------------------------------------------------------------------------------------------------


def _prints(spark, sf):
    return dedupe.fingerprints(_articles(spark, sf)).withColumnRenamed("doc_id", "group_ord").withColumnRenamed("country", "block")


def _members(spark, sf):
    # of the text the title is read and whether there is one; the whole of it would be written down and shuffled with each story
    a = _articles(spark, sf).withColumns({"ord": F.col("doc_id"), "canonical": F.lit(None).cast("string"), "summary": F.substring("text", 1, 80), "image": F.lit(None).cast("string"), "publisher": F.col("source"), "country": F.col("country").cast("string"), "link": F.lit("x")}).drop("text")
    return dedupe.clusters(a, GENERIC)


@query(f"WITH {_A}, {_PRINTS}, {_PAIRS} SELECT block, a, b FROM pairs")
def similar_pairs(spark, sf):
    return dedupe.similar_pairs(_prints(spark, sf), GENERIC).select("block", "a", "b")


@query(f"WITH RECURSIVE {_A}, {_PRINTS}, {_CLUSTERS} SELECT doc_id, cluster FROM c")
def clusters(spark, sf):
    return _members(spark, sf).select("doc_id", F.col("cluster.ord").alias("cluster"))


@query(f"WITH RECURSIVE {_A}, {_PRINTS}, {_CLUSTERS}, {_MEMBERS} SELECT cluster, arg_min(doc_id, place) AS best, count(*) AS size FROM m GROUP BY cluster")
def representatives(spark, sf):
    return dedupe.representatives(_members(spark, sf)).select(F.col("cluster.ord").alias("cluster"), F.col("doc_id").alias("best"), "size")


@query(f"WITH RECURSIVE {_A}, {_PRINTS}, {_CLUSTERS}, {_MEMBERS}, q AS (SELECT cluster, source, min(place) AS place FROM m GROUP BY cluster, source) SELECT cluster, array_to_string(list(source ORDER BY place), '|') AS publishers FROM q GROUP BY cluster")
def cluster_publishers(spark, sf):
    return dedupe.representatives(_members(spark, sf)).select(F.col("cluster.ord").alias("cluster"), F.array_join("publishers", "|").alias("publishers"))


@query(f"WITH RECURSIVE {_A}, {_PRINTS}, {_CLUSTERS}, {_MEMBERS}, z AS (SELECT *, count(*) OVER (PARTITION BY cluster) AS size FROM m) SELECT cluster, floor(({_SCORE}) * 100 + 0.5) / 100 AS score FROM z WHERE place = 1")
def cluster_scores(spark, sf):
    best = dedupe.representatives(_members(spark, sf))
    age = D.days_between(F.lit("2024-01-20").cast("timestamp"), F.col("date"))
    score = rank.cluster_score(F.col("score"), F.col("weight"), F.col("size"), age, F.lit(7.0), F.lit(False), F.col("summary") != "", F.col("origin") == "media")
    return best.select(F.col("cluster.ord").alias("cluster"), rank.round_half_up(score).alias("score"))


# -- ranking --------------------------------------------------------------------------------------------------------

_TOP = "top AS (SELECT * FROM (SELECT doc_id, country, score, row_number() OVER (PARTITION BY country ORDER BY score DESC, doc_id) AS rank FROM a) WHERE rank <= 6)"
_SEC = "sec AS (SELECT *, row_number() OVER (ORDER BY top DESC, name, country) AS section_rank FROM (SELECT a.country, n.n_name AS name, max(a.score) AS top, count(*) AS n FROM a JOIN nation n ON a.country = n.n_nationkey GROUP BY ALL))"


def _local(spark, sf):
    names = _table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("country"), F.col("n_name").alias("name"))
    return _articles(spark, sf).join(F.broadcast(names), "country")  # a table of nations


@query(f"WITH {_A}, {_TOP} SELECT country, doc_id, CAST(rank AS INTEGER) AS rank, score FROM top")
def top_k_per_country(spark, sf):
    return rank.top_per(_articles(spark, sf), "country", 6, order="doc_id").select("country", "doc_id", "rank", "score")


@query(f"WITH {_A}, {_SEC} SELECT country, name, top, n, CAST(section_rank AS INTEGER) AS section_rank FROM sec")
def section_order(spark, sf):
    return rank.section_order(_local(spark, sf)).select("country", "name", "top", "n", "section_rank")


@query(f"WITH {_A}, {_TOP}, {_SEC} SELECT doc_id, CAST(rank AS INTEGER) AS rank, CAST(section_rank AS INTEGER) AS section_rank FROM top JOIN sec USING (country) WHERE rank <= 3 ORDER BY rank, section_rank LIMIT 8")
def front_page(spark, sf):
    local = _local(spark, sf)
    top = rank.top_per(local.select("country", "doc_id", "score"), "country", 6, order="doc_id")
    return rank.front_page(top.join(rank.section_order(local).select("country", "section_rank"), "country")).select("doc_id", "rank", "section_rank")


@query(f"""WITH {_TYPES}, z AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN ['podcast'] WHEN doc_id % 5 <> 0 THEN CASE WHEN type = 'livre' THEN ['pays', 'livre'] ELSE ['pays'] END ELSE [type] END AS s FROM y)
SELECT section, count(*) AS n, min(doc_id) AS first_doc FROM (SELECT doc_id, unnest(s) AS section FROM z) GROUP BY section""")
def section_routing(spark, sf):
    rows = _typed(spark, sf).withColumn("country", F.when(F.col("doc_id") % 5 != 0, F.col("country")))
    return rank.route(rows).groupBy("section").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query(f"WITH {_A} SELECT n_nationkey AS country, n_name AS name FROM nation WHERE n_nationkey NOT IN (SELECT country FROM a WHERE score >= 10.0)")
def silent_countries(spark, sf):
    wanted = _table(spark, sf, "nation").select(F.col("n_nationkey").alias("country"), F.col("n_name").alias("name"))
    return report.silent(wanted, _articles(spark, sf).where(F.col("score") >= 10.0).select(F.col("country").cast("int").alias("country")), "country").select("country", "name")


# -- reports, caches, plans ---------------------------------------------------------------------------------------

_REPORT = "SELECT source, count(*) FILTER (link) AS total, count(*) FILTER (link AND NOT late) AS kept, count(*) FILTER (link AND late) AS out_of_window, count(*) FILTER (link AND date IS NULL) AS undated FROM (SELECT source, doc_id % 9 <> 0 AS link, date, date IS NOT NULL AND NOT (date >= TIMESTAMP '2024-01-05' AND date <= TIMESTAMP '2024-01-13') AS late FROM a) GROUP BY source"


def _report(spark, sf):
    items = _articles(spark, sf).withColumn("link", F.when(F.col("doc_id") % 9 != 0, "x"))
    return report.collection_report(items, "source", "link", "date", F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-12").cast("timestamp"))


@query(f"WITH {_A} {_REPORT}")
def collection_report(spark, sf):
    return _report(spark, sf)


@query(f"WITH {_A}, z AS ({_REPORT}) SELECT count(*) AS sources, count(*) FILTER (kept >= 20) AS answered, count(*) FILTER (kept < 20) AS failed, CAST(sum(kept) AS BIGINT) AS collected FROM z")
def run_stats(spark, sf):
    return report.run_stats(_report(spark, sf).withColumn("status", F.when(F.col("kept") < 20, "echec").otherwise("ok")))


@query(f"WITH {_A} SELECT title, min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM a GROUP BY title")
def first_guid(spark, sf):
    return report.first_by(_articles(spark, sf).select("title", "doc_id", "source"), "title", "doc_id")


_TEXTS = "x AS (SELECT DISTINCT lower(split_part(lang, '-', 1)) AS language, title AS text FROM a WHERE lang <> '' AND lower(split_part(lang, '-', 1)) <> 'fr' AND trim(title) <> '')"


def _translated(spark, sf, cached: bool):
    rows = _articles(spark, sf).select(F.col("lang").alias("language"), F.col("title").alias("text"), "doc_id")
    cache = rows.where(F.col("doc_id") % 2 == 0).select(translate.cache_key("fake", F.col("language"), F.col("text")).alias("key"), F.concat(F.lit("! "), F.col("text")).alias("value")) if cached else None
    return translate.translate_texts(rows.select("language", "text"), translate.Marking(), cache)[0]


@query(f"WITH {_A}, {_TEXTS}, h AS (SELECT DISTINCT lang AS language, title AS text FROM a WHERE doc_id % 2 = 0) SELECT language, CASE WHEN h.text IS NOT NULL THEN 'cache' ELSE 'translated' END AS state, count(*) AS n FROM x LEFT JOIN h USING (language, text) GROUP BY ALL")
def cache_probe(spark, sf):
    return _translated(spark, sf, True).groupBy("language", "state").agg(F.count("*").alias("n"))


@query(f"WITH {_A}, {_TEXTS} SELECT language, text, '[' || language || '>fr] ' || text AS translated FROM x")
def translate_distinct(spark, sf):
    return _translated(spark, sf, False).select("language", "text", "translated")


@query("SELECT role, chunk, count(*) AS n, min(conv_id) AS first_conv FROM (SELECT role, conv_id, CAST(floor((row_number() OVER (PARTITION BY role ORDER BY conv_id, turn) - 1) / 25) AS BIGINT) AS chunk FROM conversations) GROUP BY ALL")
def translation_batches(spark, sf):
    c = _table(spark, sf, "conversations").withColumn("order_", F.struct("conv_id", "turn"))
    return landing.chunked(c, "order_", 25, "role").groupBy("role", "chunk").agg(F.count("*").alias("n"), F.min("conv_id").alias("first_conv"))


@query("SELECT n_nationkey AS country, 'https://news.google.com/rss/search?q=%28' || lower(n_name[1:1]) || '+OR+%22big+' || lower(n_name[1:1]) || '%22%29+%28x%29+when%3A7d&hl=fr&gl=FR&ceid=FR%3Afr' AS url FROM nation")
def search_queries(spark, sf):
    n = _table(spark, sf, "nation")
    first = F.lower(F.substring("n_name", 1, 1))
    q = plan.build_query(F.array(first, F.concat(F.lit("big "), first)), F.array(F.lit("x")), 6.5)
    return n.select(F.col("n_nationkey").alias("country"), plan.search_url(q, F.lit("fr"), F.lit("FR"), F.lit("FR:fr")).alias("url"))


@query("SELECT r_name AS query, language, 'https://www.googleapis.com/books/v1/volumes?q=' || replace(r_name, ' ', '+') || '&orderBy=newest&printType=books&maxResults=40&langRestrict=' || language AS url FROM region CROSS JOIN (SELECT unnest(['de', 'fr']) AS language)")
def request_cross_product(spark, sf):
    return books.requests(_table(spark, sf, "region").select(F.col("r_name").alias("query")), spark.createDataFrame([("de",), ("fr",)], "language string"))


@query(f"WITH {_A} SELECT country AS place, count(*) AS n, array_to_string(list_sort(list_distinct(list(source))), '|') AS names FROM a GROUP BY country")
def source_dashboard(spark, sf):
    f = _articles(spark, sf).select(F.col("country").cast("string").alias("country_name"), F.lit(None).cast("string").alias("forced_type"), F.col("source").alias("name"))
    return report.dashboard(f).select(F.col("place").cast("long").alias("place"), "n", F.array_join("names", "|").alias("names"))


def _shown_title(item):
    """An entry's title; the parser tells a blank one by null, SQL by an empty text."""
    return F.coalesce(item["title"], F.when(item.isNotNull(), ""))


@query(None)
def parsed_feed_items(spark, sf):
    """Each document rendered whole as a feed of one item and parsed again."""
    link = F.coalesce(F.concat(F.lit("https://x.example/"), F.col("doc_id").cast("string")), F.lit(""))
    d = _articles(spark, sf).select("source", "doc_id", F.format_string("<item><title>%s</title><link>%s</link><description>%s</description></item>", T.escape_html(F.col("title")), link, T.escape_html(F.col("text"))).alias("item"))
    raw = d.withColumn("body", F.concat(F.lit("<rss><channel><title>t</title>"), F.col("item"), F.lit("</channel></rss>")))
    parsed = feeds.parse_feeds(raw).select("doc_id", F.size("items").cast("long").alias("n"), F.get("items", 0).alias("i"))
    return parsed.select("doc_id", "n", _shown_title(F.col("i")).alias("title"), "i.link")


SQL["parsed_feed_items"] = f"WITH {_A} SELECT doc_id, 1::BIGINT AS n, {_collapse('title')} AS title, 'https://x.example/' || doc_id AS link FROM a"


# -- texts, dates and feeds in their variants ------------------------------------------------------------------------


@query(f"WITH {_A}, x AS (SELECT doc_id, regexp_replace(left(trim(regexp_replace(strip_accents(lower(title)), '[^a-z0-9]+', '-', 'g'), '-'), 60), '-+$', '') AS slug FROM a) SELECT doc_id, CASE WHEN slug = '' THEN 'sans-titre' ELSE slug END AS slug FROM x")
def slugs(spark, sf):
    return _articles(spark, sf).select("doc_id", T.slugify(F.col("title")).alias("slug"))


@query(rf"WITH {_A} SELECT doc_id, regexp_replace('[' || source || '](' || lang || ') *' || text || '*', '([\\`*_\[\]<>])', '\\\1', 'g') AS markdown FROM a")
def markdown_escapes(spark, sf):
    shown = F.concat(F.lit("["), F.col("source"), F.lit("]("), F.col("lang"), F.lit(") *"), F.col("text"), F.lit("*"))
    return _articles(spark, sf).select("doc_id", T.escape_markdown(shown).alias("markdown"))


@query("""WITH x AS (SELECT event_id, event_id % 6 AS k, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)
SELECT event_id, CASE k WHEN 0 THEN s - 7200 WHEN 1 THEN s WHEN 2 THEN s WHEN 3 THEN s - s % 86400 WHEN 4 THEN s + 18000 ELSE -1 END AS seconds FROM x""")
def parsed_dates(spark, sf):
    """Times written in six ways and read again: with an offset, in GMT, as ISO, as a day, with a remark, and unreadable."""
    forms = ("EEE, dd MMM yyyy HH:mm:ss '+0200'", "EEE, dd MMM yyyy HH:mm:ss 'GMT'", "yyyy-MM-dd'T'HH:mm:ss'Z'", "d MMM yyyy", "dd MMM yyyy HH:mm:ss '-0500 (EST)'")
    e, ts = _table(spark, sf, "events"), F.col("ts").cast("timestamp")
    shown = F.lit("n'importe quoi")
    for k, form in enumerate(forms):
        shown = F.when(F.col("event_id") % 6 == k, F.date_format(ts, form)).otherwise(shown)
    return e.select("event_id", F.coalesce(F.unix_seconds(D.parse_date(shown)), F.lit(-1)).alias("seconds"))


def _variants(spark, sf):
    """Documents as feeds of the three formats: texts in CDATA and escaped, links as attribute, text and guid."""
    a, i = _articles(spark, sf), F.col("doc_id").cast("string")
    title, text, source, lang = (T.escape_html(F.col(c)) for c in ("title", "text", "source", "lang"))
    c = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    atom = c('<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>t</title><entry><title type="html"><![CDATA[', title, ']]></title><link rel="self" href="https://x.example/self"/><link href="https://x.example/', i, '"/><author><name>', source, '</name></author><category term="', lang, '"></category><published>2024-01-02T03:04:05Z</published><summary>', text, '</summary><media:content url="https://x.example/', i, '" medium="image"/></entry></feed>')
    rdf = c('<rdf:RDF><channel><title>t</title></channel><item rdf:about="u"><title>', title, "</title><link>https://x.example/", i, "</link><dc:creator>", source, "</dc:creator><dc:date>2024-01-02</dc:date><description>", text, '</description><media:thumbnail url="https://x.example/', i, ".png?w=1\"/></item></rdf:RDF>")
    rss = c("<rss><channel><title>t</title><item><title>", title, "</title><guid>https://x.example/", i, "</guid><author>who@x.example (", source, ")</author><category><![CDATA[", lang, "]]></category><category>", lang, '</category><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate><enclosure url="https://x.example/', i, '.mp3" length="7" type="audio/mpeg"/><content:encoded><![CDATA[<p>', text, '</p><img src="https://x.example/', i, ".jpg\">]]></content:encoded></item></channel></rss>")
    kind = F.col("doc_id") % 3
    return a.withColumn("body", F.when(kind == 0, atom).when(kind == 1, rdf).otherwise(rss))


@query(f"""WITH {_A}, x AS (SELECT doc_id, doc_id % 3 AS k, 'https://x.example/' || doc_id AS link, title, text, source, lang FROM a)
SELECT doc_id, ['atom', 'rdf', 'rss'][k + 1] AS format, {_collapse('title')} AS title, link, {_collapse('source')} AS author, CASE k WHEN 0 THEN link WHEN 1 THEN link || '.png?w=1' ELSE link || '.jpg' END AS image,
  CASE WHEN k = 2 THEN link || '.mp3 audio/mpeg 7' END AS audio, CASE WHEN k = 1 THEN '' ELSE lang END AS categories, CASE k WHEN 1 THEN 1704153600 ELSE 1704164645 END::BIGINT AS published, {_collapse('text')} AS summary FROM x""")
def feed_variants(spark, sf):
    parsed = feeds.parse_feeds(_variants(spark, sf)).select("doc_id", "format", F.get("items", 0).alias("i"))
    audio = F.when(F.col("i.audio").isNotNull(), F.concat_ws(" ", "i.audio.url", "i.audio.type", "i.audio.length"))
    return parsed.select("doc_id", "format", _shown_title(F.col("i")).alias("title"), "i.link", "i.author", "i.image", audio.alias("audio"), F.array_join("i.categories", "|").alias("categories"), F.unix_seconds(D.parse_date(F.col("i.published_raw"))).alias("published"), "i.summary")


@query(f"""WITH {_A}, x AS (SELECT doc_id, {_collapse('title')} AS t, 'https://x.example/' || doc_id AS guid, {_collapse('text')} AS clean, left({_collapse('text')}, 400) AS cut, doc_id % 2 = 0 AS search FROM a),
y AS (SELECT *, length(cut) - strpos(reverse(cut), ' ') AS cut_at FROM x)
SELECT doc_id, 'f::' || guid AS id, CASE WHEN t = '' THEN '(sans titre)' ELSE t END AS title, guid AS canonical, CASE WHEN search THEN 'Paper' ELSE 'Feed' END AS publisher,
  CASE WHEN search AND length(clean) <= 160 THEN '' WHEN length(clean) <= 400 THEN clean ELSE regexp_replace(CASE WHEN contains(cut, ' ') AND cut_at > 240 THEN left(cut, cut_at) ELSE cut END, '[\\s,;:.!?…-]+$', '') || '…' END AS summary FROM y""")
def feed_articles(spark, sf):
    """Items of searches, which name their publisher in the title where there is one, and of other feeds, as articles."""
    a, search = _articles(spark, sf), F.col("doc_id") % 2 == 0
    title = F.when(search & (T.collapse(F.col("title")) != ""), F.concat(T.escape_html(F.col("title")), F.lit(" - Paper"))).otherwise(T.escape_html(F.col("title")))
    body = F.concat(F.lit("<rss><channel><item><title>"), title, F.lit("</title><link>https://x.example/"), F.col("doc_id").cast("string"), F.lit("</link><source>Paper</source><description>"), T.escape_html(F.col("text")), F.lit("</description></item></channel></rss>"))
    none = {c: F.lit(None).cast("string") for c in ("country", "forced_type", "profile", "feed_language")}
    raw = a.select(F.col("doc_id").alias("feed_ord"), F.lit("f").alias("feed_id"), F.lit("Feed").alias("feed_name"), F.when(search, "google-news").otherwise("media").alias("origin"), "weight", body.alias("body")).withColumns(none)
    return feeds.articles(feeds.parse_feeds(raw)).select(F.col("ord.feed_ord").alias("doc_id"), "id", "title", "canonical", "publisher", "summary")


@query(f"""WITH {_A}, x AS (SELECT a.*, 'v' || (doc_id // 2) AS guid, CASE doc_id % 3 WHEN 0 THEN '2024-01-09' WHEN 1 THEN '2024-01' ELSE '2024' END AS shown FROM a), y AS (SELECT * FROM x WHERE doc_id % 3 <> 2 AND doc_id % 5 <> 0)
SELECT guid, min(doc_id) AS doc_id, 'google-books::' || guid AS id, arg_min({_collapse('source')} || ' — ' || lang, doc_id) AS title, arg_min(CASE WHEN doc_id % 3 = 0 THEN 'jour' ELSE 'mois' END, doc_id) AS precision, arg_min('A, ' || source, doc_id) AS author, arg_min('https://i.example/' || doc_id, doc_id) AS image FROM y GROUP BY guid""")
def book_volumes(spark, sf):
    """Documents as catalogue answers of one volume each, two for most volumes; those without a link or outside the window go."""
    found = books.volumes(_book_answers(spark, sf), *_week())
    return found.select("guid", F.col("ord.ord").alias("doc_id"), "id", "title", F.col("date_precision").alias("precision"), "author", "image")


def _week():
    return F.lit("2024-01-07").cast("timestamp"), F.lit("2024-01-14").cast("timestamp")


def _book_answers(spark, sf):
    i = F.col("doc_id")
    info = F.struct(F.col("source").alias("title"), F.col("lang").alias("subtitle"), F.array(F.lit("A"), F.col("source")).alias("authors"), F.when(i % 3 == 0, "2024-01-09").when(i % 3 == 1, "2024-01").otherwise("2024").alias("publishedDate"), F.col("text").alias("description"), F.when(i % 5 != 0, F.concat(F.lit("https://b.example/"), i)).alias("infoLink"), F.struct(F.concat(F.lit("http://i.example/"), i).alias("thumbnail")).alias("imageLinks"))
    body = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("v"), F.floor(i / 2)).alias("id"), info.alias("volumeInfo"))).alias("items")))
    return _articles(spark, sf).select(i.alias("ord"), F.lit("q").alias("query"), F.lit("fr").alias("language"), body.alias("body"))


@query("""WITH x AS (SELECT doc_id, doc_id % 7 = 0 AS failed, doc_id % 7 = 1 AS odd, doc_id % 3 <> 2 AND doc_id % 5 <> 0 AS fits, doc_id // 2 AS guid FROM documents),
f AS (SELECT guid, min(doc_id) AS first FROM x WHERE fits AND NOT failed AND NOT odd GROUP BY guid)
SELECT doc_id, CASE WHEN failed OR odd THEN 'echec' ELSE 'ok' END AS status, CASE WHEN failed THEN 'HTTP 429' WHEN odd THEN 'unreadable JSON' END AS error, CASE WHEN failed OR odd THEN 0 ELSE 1 END::BIGINT AS total, CASE WHEN first = doc_id THEN 1 ELSE 0 END::BIGINT AS kept FROM x LEFT JOIN f ON f.guid = x.guid""")
def book_calls(spark, sf):
    """Calls with what each was the first to bring; one in seven was refused, one in seven had an answer cut short."""
    i = F.col("ord")
    answers = _book_answers(spark, sf).withColumns({"error": F.when(i % 7 == 0, "HTTP 429"), "body": F.when(i % 7 > 1, F.col("body")).when(i % 7 == 1, F.expr("left(body, length(body) - 1)"))})
    found = books.volumes(answers, *_week())
    return books.call_report(answers, found).select(i.alias("doc_id"), "status", "error", "total", "kept")


@query("""WITH x AS (SELECT page_id, page_id % 5 AS k FROM pages)
SELECT page_id, 'https://' || ['xn--bcher-kva', 'xn--e1afmkfd', 'xn--hxajbheg2az3al', 'xn--wgv71a119e', 'plain'][k + 1] || '.example/p' || page_id || '/?a=%C3%A9+%26&b=1' AS canonical, ['xn--bcher-kva', 'xn--e1afmkfd', 'xn--hxajbheg2az3al', 'xn--wgv71a119e', 'plain'][k + 1] || '.example' AS host FROM x""")
def international_links(spark, sf):
    """Pages at hosts in German, Russian, Greek, Japanese and plain letters, with parameters as a form would not write them."""
    names = F.array(*(F.lit(n) for n in ("Bücher", "пример", "παράδειγμα", "日本語", "PLAIN")))
    url = F.concat(F.lit("http://www."), F.get(names, F.col("page_id") % 5), F.lit(".Example:80/p"), F.col("page_id"), F.lit("/?b=1&utm_id=3&a=é %26#top"))
    return _table(spark, sf, "pages").select("page_id", U.canonical_url(url).alias("canonical"), U.hostname(url).alias("host"))


@query(f"""WITH {_TYPES}, z AS (SELECT *, CASE WHEN doc_id % 11 = 0 THEN 'podcast' ELSE type END AS section FROM y), r AS (SELECT doc_id, section, row_number() OVER (PARTITION BY section ORDER BY score DESC, doc_id) AS place FROM z WHERE section <> 'actualite')
SELECT section, doc_id FROM r WHERE place <= CASE section WHEN 'livre' THEN 25 WHEN 'podcast' THEN 10 ELSE 12 END""")
def rubric_limits(spark, sf):
    rows = rank.route(_typed(spark, sf).withColumns({"ord": F.col("doc_id"), "country": F.lit(None).cast("string")}))
    return rank.rubrics(rows).select("section", "doc_id")


@query(f"WITH RECURSIVE {_A}, {_PRINTS}, {_CLUSTERS}, {_MEMBERS}, q AS (SELECT cluster, source, min(place) AS place FROM m GROUP BY cluster, source), l AS (SELECT cluster, list(source ORDER BY place) AS s FROM q GROUP BY cluster) SELECT m.cluster, floor(m.score * 100 + 0.5) / 100 AS score, array_to_string(list_slice(s, 2, 7), '|') AS reprises, CAST(len(s) - 1 AS BIGINT) AS n_reprises, strftime(date, '%Y-%m-%dT%H:%M:%S.000Z') AS date_iso, CASE WHEN date IS NOT NULL THEN 'jour' END AS date_precision FROM m JOIN l USING (cluster) WHERE place = 1")
def published_entries(spark, sf):
    out = rank.published_entry(dedupe.representatives(_members(spark, sf)))
    return out.select(F.col("cluster.ord").alias("cluster"), "score", F.array_join("reprises", "|").alias("reprises"), "n_reprises", "date_iso", "date_precision")


@query(f"WITH {_A} SELECT source, min(doc_id) AS ord FROM a WHERE doc_id % 4 <> 0 GROUP BY source")
def distinct_errors(spark, sf):
    rows = _articles(spark, sf).select(F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("source"), F.col("doc_id").alias("ord"))
    return report.ordered_distinct(rows, "source")


@query("SELECT 'active' AS asked, n_nationkey AS code FROM nation WHERE n_nationkey % 3 <> 0 UNION ALL SELECT 'listed', n_nationkey FROM nation WHERE n_name IN ('FRANCE', 'CHINA')")
def wanted_countries(spark, sf):
    n = _table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("code"), F.when(F.col("n_nationkey") % 3 == 0, False).alias("active"))
    show = lambda kind, rows: rows.select(F.lit(kind).alias("asked"), F.col("key").alias("code"))
    return show("active", plan.wanted_countries(n)).unionByName(show("listed", plan.wanted_countries(n, [" france", "China "])))


@query("""WITH c AS (SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_nationkey % 3 <> 0),
g AS (SELECT 'gn-' || lower(name) || '-' || l || '-' || p AS feed_id, 'https://news.google.com/rss/search?q=%28' || CASE l WHEN 'en' THEN 'news' ELSE '%22une+info%22' END || '%29' || CASE p WHEN 'culture' THEN '+%28' || CASE l WHEN 'en' THEN 'art' ELSE 'livre' END || '%29' ELSE '' END || '+when%3A7d&hl=' || l || '&gl=' || k || '&ceid=' || k || '%3A' || l AS url, 1.5 + k % 2 AS weight, name AS country FROM c, (SELECT unnest(['en', 'fr']) AS l), (SELECT unnest(['actualite', 'culture']) AS p)),
m AS (SELECT 'm' || (k % 5) AS feed_id, 'https://m.example/' || (k % 5) AS url, 1.0 + k AS weight, name AS country, row_number() OVER (PARTITION BY k % 5 ORDER BY k DESC) AS place FROM c)
SELECT feed_id, url, CAST(weight AS DOUBLE) AS weight, country FROM g UNION ALL SELECT feed_id, url, CAST(weight AS DOUBLE), country FROM m WHERE place = 1""")
def country_feed_plan(spark, sf):
    """Searches of two editions and profiles for each active country, and a medium that several countries list: the weightiest stays."""
    k, name = F.col("n_nationkey"), F.col("n_name")
    edition = lambda l: F.struct(F.lit(l).alias("language"), F.lit(l).alias("hl"), k.cast("string").alias("gl"), F.concat(k.cast("string"), F.lit(f":{l}")).alias("ceid"))
    medium = F.struct(F.concat(F.lit("m"), k % 5).alias("id"), F.lit("M").alias("name"), F.concat(F.lit("https://m.example/"), k % 5).alias("url"), F.lit("en").alias("language"), (1.0 + k).cast("double").alias("weight"), F.lit(None).cast("string").alias("type"), F.lit(True).alias("active"))
    n = _table(spark, sf, "nation").select(k.alias("ord"), name.alias("code"), name.alias("name"), F.lit("r").alias("region"), (1.5 + k % 2).cast("double").alias("weight"), (k % 3 != 0).alias("active"), F.array(edition("en"), edition("fr")).alias("editions"), F.array(medium).alias("media"))
    words = spark.createDataFrame([("en", ["news"], ["hate"], ["art"], ["book"]), ("fr", ["une info"], ["haine"], ["livre"], ["roman"])], "language string, core array<string>, hostile array<string>, culture array<string>, books array<string>")
    return plan.feed_plan(plan.country_feeds(n, words, ["actualite", "culture"], 7)).select("feed_id", "url", "weight", "country")


@query(f"WITH {_A}, x AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'echec' WHEN doc_id % 5 = 1 THEN 'inchange' ELSE 'ok' END AS state FROM a) SELECT doc_id, state, CASE state WHEN 'echec' THEN 'old' ELSE 'new' END AS body FROM x WHERE doc_id % 5 <> 0 OR doc_id % 2 = 0")
def cache_refresh(spark, sf):
    """Landed answers over a cache that holds every other document: failures leave the old body."""
    d, i = _articles(spark, sf).withColumn("url", F.col("doc_id").cast("string")), F.col("doc_id")
    none, at = F.lit(None).cast("string"), F.lit("2024-01-01").cast("timestamp")
    cache = d.where(i % 2 == 0).select("url", none.alias("etag"), none.alias("last_modified"), F.lit("old").alias("body"), at.alias("fetched_at"))
    landed = landing.status_of(d.select("doc_id", "url", F.when(i % 5 == 1, 304).otherwise(200).alias("status"), F.when(i % 5 == 0, "timeout").alias("error"), none.alias("etag"), none.alias("last_modified"), F.lit("new").alias("body"), at.alias("fetched_at")))
    return landed.select("doc_id", "url", "state").join(landing.refreshed(cache, landed).select("url", "body"), "url").select("doc_id", "state", "body")


# -- requests, versions, batches, calls ---------------------------------------------------------------------------------


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'echec' ELSE 'ok' END AS state, CASE WHEN doc_id % 5 = 0 THEN 3 ELSE 1 END AS attempts, CASE WHEN doc_id % 5 > 0 THEN coalesce(text, '') END AS body FROM documents")
def landed_requests(spark, sf):
    """Every document as an address that holds its own text, asked for like any other; one in five of a scheme that nobody answers."""
    d, i = spread(_table(spark, sf, "documents")), F.col("doc_id")
    data = F.concat(F.lit("data:text/plain;charset=utf-8;base64,"), F.translate(F.base64(F.coalesce("text", F.lit("")).cast("binary")), "\r\n", ""))
    asked = d.select("doc_id", F.when(i % 5 == 0, F.concat(F.lit("nowhere://"), i)).otherwise(data).alias("url"), F.lit(0.0).alias("wait"))
    got = landing.status_of(landing.fetched(asked, spark.sparkContext.defaultParallelism))
    return asked.select("doc_id", "url").join(got, "url").select("doc_id", "state", "attempts", "body")


@query("""WITH g AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS day FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0),
v AS (SELECT 1 AS version, 'put' AS operation, doc_id, 1 AS day FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT 2, 'put', doc_id, day FROM g UNION ALL SELECT 3, 'prune', doc_id, day FROM g WHERE day = 2)
SELECT version, operation, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids, count(*) FILTER (day = 2) AS fresh FROM v GROUP BY ALL UNION ALL SELECT 4, 'clear', 0, 0, 0""")
def cache_generations(spark, sf):
    """Three generations of a cache, the second over half of the first, then what was fetched before the second day goes, then all."""
    i = F.col("doc_id")
    day = lambda n: F.lit(f"2024-01-0{n}").cast("timestamp")
    rows = _table(spark, sf, "documents").select(key_of(F.lit("doc"), i.cast("string")).alias("key"), i, "text")
    store = CacheTables(spark, new_path(spark, "cache"))
    store.put("texts", rows.where(i % 2 == 0).withColumn("fetched_at", day(1)))
    store.put("texts", rows.where(i % 3 == 0).withColumn("fetched_at", day(2)))
    store.prune("texts", day(2))
    store.clear("texts")
    found = []
    for v in store.versions("texts"):
        old = store.read("texts", v)
        told = rows.limit(0).withColumn("fetched_at", day(1)) if old is None else old
        found.append(told.agg(F.count("*").alias("n"), F.coalesce(F.sum("doc_id"), F.lit(0)).alias("ids"), F.count_if(F.col("fetched_at") == day(2)).alias("fresh")).select(F.lit(v).alias("version"), F.lit(store.entry("texts", v)["operation"]).alias("operation"), "n", "ids", "fresh"))
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query(f"""WITH {_A}, x AS (SELECT DISTINCT lang AS language, title AS text FROM a), n AS (SELECT *, row_number() OVER (PARTITION BY language ORDER BY text) - 1 AS nth FROM x)
SELECT language, CAST(nth // 25 AS BIGINT) AS batch, count(*) AS n, min(text) AS first_text, max(text) AS last_text FROM n GROUP BY ALL""")
def language_batches(spark, sf):
    """Batches of distinct titles for a translator, numbered over the whole table in each language."""
    titles = _articles(spark, sf).select(F.col("lang").alias("language"), F.col("title").alias("text")).distinct()
    b = batches(titles, "language", ["text"], 25)
    return b.select("language", "batch", F.size("rows").cast("long").alias("n"), F.get("rows", 0)["text"].alias("first_text"), F.element_at("rows", -1)["text"].alias("last_text"))


@query(f"WITH RECURSIVE {_A}, {_PRINTS}, {_CLUSTERS} SELECT doc_id, cluster FROM c")
def streamed_clusters(spark, sf):
    """Founder clusters of documents that arrive in three batches, in the order of their ids."""
    a = _articles(spark, sf).select(F.col("doc_id").alias("ord"), F.lit(None).cast("string").alias("canonical"), "title", F.col("country").cast("string").alias("country"), "date")
    stories = Stories(spark, new_path(spark, "stories"), GENERIC)
    ends = a.agg(F.percentile_approx("ord", [1 / 3, 2 / 3])).first()[0] or [0, 0]
    for k, part in enumerate((a.where(F.col("ord") <= ends[0]), a.where(F.col("ord").between(ends[0] + 1, ends[1])), a.where(F.col("ord") > ends[1]))):
        stories.take(part, k)
    return stories.assigned().select(F.col("ord").alias("doc_id"), F.col("cluster.ord").alias("cluster"))
