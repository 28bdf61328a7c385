"""Text: entities, tags, white space, titles, stems and similarities; native column expressions only."""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Named entities, besides letters with a mark, which are composed below.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "laquo": "«", "raquo": "»", "ldquo": "“", "rdquo": "”",
    "lsquo": "‘", "rsquo": "’", "hellip": "…", "mdash": "—", "ndash": "–", "sbquo": "‚", "bdquo": "„", "minus": "−", "oelig": "œ",
    "OElig": "Œ", "aelig": "æ", "AElig": "Æ", "szlig": "ß", "oslash": "ø", "Oslash": "Ø", "aring": "å", "Aring": "Å", "eth": "ð",
    "ETH": "Ð", "thorn": "þ", "THORN": "Þ", "deg": "°", "euro": "€", "pound": "£", "yen": "¥", "cent": "¢", "copy": "©", "reg": "®",
    "trade": "™", "middot": "·", "bull": "•", "dagger": "†", "sect": "§", "para": "¶", "permil": "‰", "times": "×", "divide": "÷",
    "micro": "µ", "iexcl": "¡", "iquest": "¿", "frac12": "½", "frac14": "¼", "frac34": "¾", "shy": "", "zwj": "", "zwnj": "",
    "lrm": "", "rlm": "",
}
# The marks that entity names end in, and the letters that can bear one.
MARKS = {"grave": "̀", "acute": "́", "circ": "̂", "tilde": "̃", "uml": "̈", "ring": "̊", "cedil": "̧"}
MARKED = "aeiouyncszAEIOUYNCSZ"
# Words without meaning for a title, French and English.
STOPWORDS = (
    "le la les un une des du de d l et ou a au aux en dans sur pour par avec sans sous que qui quoi dont ce cet cette ces son sa ses "
    "leur leurs il elle ils elles on nous vous est sont ete etre avoir plus moins apres avant contre entre vers chez tout tous toute "
    "toutes se ne pas y aussi mais donc car s n c j m t "
    "the of and to in for on with at by from as is are was were be been it its this that these those has have had will would can could "
    "says said after over new about into than then but not his her their they"
).split()
STEM = 6
SPACES = "[\\s\\u000b\\u00a0\\u1680\\u2000-\\u200b\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+"


@functools.cache
def entity_table() -> dict[str, str]:
    composed = {letter + name: c for letter in MARKED for name, mark in MARKS.items() if len(c := unicodedata.normalize("NFC", letter + mark)) == 1}
    return ENTITIES | composed


@functools.cache
def _accents() -> tuple[str, str]:
    """Letters whose decomposition is one letter and marks, and those letters; the marks themselves come last and go."""
    strip = lambda c: "".join(x for x in unicodedata.normalize("NFD", c) if not 0x300 <= ord(x) <= 0x36F)
    found = [(chr(i), s) for i in range(0xA0, 0x2200) if not 0x300 <= i <= 0x36F and len(s := strip(chr(i))) == 1 and s != chr(i)]
    return "".join(a for a, _ in found) + "".join(map(chr, range(0x300, 0x370))), "".join(b for _, b in found)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it: a plain column would be worked out at each place."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


# -- expressions as SQL text: the large ones, which take seconds to put together call by call -------------------------


def quoted(text: str) -> str:
    """A raw SQL string."""
    if "'" in text and '"' in text:
        return "concat(" + """, "'", """.join(f"r'{part}'" for part in text.split("'")) + ")"
    return f"r'{text}'" if "'" not in text else f'r"{text}"'


def let(name: str, value: str, body: str) -> str:
    """``body``, in which ``name`` stands for a value that is worked out once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def applied(column: Column, body: Callable[[str], str]) -> Column:
    """SQL text over a column of any kind."""
    return F.get(F.call_function("transform", F.array(column), F.expr(f"t_ -> {body('t_')}")), F.lit(0))


@functools.cache
def _decoded(text: str) -> str:
    pattern = quoted("&(?:#[xX][0-9A-Fa-f]{1,8}|#[0-9]{1,9}|[A-Za-z][A-Za-z0-9]*);")
    table = f"from_json({quoted(json.dumps(entity_table()).replace(chr(39), chr(92) + 'u0027'))}, 'map<string,string>')"
    name = "substring(m_, 2, length(m_) - 2)"

    def code_point(number: str) -> str:
        valid = "n_ BETWEEN 1 AND 1114111 AND n_ NOT BETWEEN 55296 AND 57343"
        return let("n_", number, f"CASE WHEN {valid} THEN decode(unhex(lpad(hex(n_), 8, '0')), 'UTF-32') ELSE m_ END")

    hexadecimal, decimal = (f"try_cast({x} AS BIGINT)" for x in ("conv(substring(m_, 4, length(m_) - 4), 16, 10)", "substring(m_, 3, length(m_) - 3)"))
    named = let("e_", name, f"coalesce(try_element_at({table}, e_), CASE WHEN e_ = upper(e_) THEN try_element_at({table}, lower(e_)) END, m_)")
    one = f"CASE WHEN startswith(lower(m_), '&#x') THEN {code_point(hexadecimal)} WHEN startswith(m_, '&#') THEN {code_point(decimal)} ELSE {named} END"
    joined = f"array_join(zip_with(split({text}, {pattern}, -1), transform(regexp_extract_all({text}, {pattern}, 0), m_ -> {one}), (p_, d_) -> concat(p_, coalesce(d_, ''))), '')"
    # texts whose only entities are those of escaped markup, which most are, need plain replacements; the ampersand comes last
    plain = text
    for entity in ("lt", "gt", "quot", "#39", "amp"):
        plain = f"replace({plain}, '&{entity};', {quoted(ENTITIES.get(entity, chr(39)))})"
    return f"CASE WHEN NOT contains({text}, '&') THEN {text} WHEN {text} RLIKE {quoted('&(?!(?:lt|gt|quot|#39|amp);)[#A-Za-z]')} THEN {joined} ELSE {plain} END"


def sql_decoded(text: str) -> str:
    return let("x_", f"coalesce({text}, '')", _decoded("x_"))


def sql_stripped(text: str) -> str:
    out = "h_"
    for pattern, to in ((r"(?is)<(script|style)\b.*?</\1>", " "), (r"(?s)<!--.*?-->", " "), (r"(?i)<br\s*/?>", " "), (r"(?i)</(?:p|div|li|h[1-6]|tr|blockquote)>", " "), (r"<[^>]*>", "")):
        out = f"regexp_replace({out}, {quoted(pattern)}, '{to}')"
    return let("h_", f"coalesce({text}, '')", f"CASE WHEN contains(h_, '<') THEN {out} ELSE h_ END")


def sql_collapsed(text: str) -> str:
    return f"trim(regexp_replace(coalesce({text}, ''), {quoted(SPACES)}, ' '))"


def sql_text(html: str) -> str:
    return sql_collapsed(sql_decoded(sql_stripped(sql_decoded(html))))


# -- text ----------------------------------------------------------------------------------------------------------


def decode_entities(text: Column) -> Column:
    """Named, decimal and hexadecimal entities in one pass; what is unknown or out of range stays. Null gives an empty text."""
    return applied(text, sql_decoded)


def strip_tags(html: Column) -> Column:
    """Scripts, styles, comments, breaks and ends of blocks become spaces; other tags vanish."""
    return applied(html, sql_stripped)


def collapse(text: Column) -> Column:
    """Runs of white space of any kind become one space; none at the ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "))


def html_to_text(html: Column) -> Column:
    """Decode, strip, decode again, collapse."""
    return applied(html, sql_text)


def excerpt(text: Column, most: int = 320) -> Column:
    """At most so many characters, cut at the last space if that lies in the last 40 per cent, with an ellipsis."""

    def cut_at_space(clean: Column) -> Column:
        cut = F.substring(clean, 1, most)
        at = F.length(cut) - F.locate(" ", F.reverse(cut))  # characters before the last space
        words = F.when(F.contains(cut, F.lit(" ")) & (at > most * 0.6), F.substring(cut, F.lit(1), at)).otherwise(cut)
        return F.when(F.length(clean) <= most, clean).otherwise(F.concat(F.regexp_replace(words, r"[\s,;:.!?…-]+$", ""), F.lit("…")))

    return bound(collapse(text), cut_at_space)


def deaccent(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), *_accents())


def fold(text: Column) -> Column:
    return F.lower(deaccent(text))


def normalize_title(title: Column) -> Column:
    """Lower-cased, without accents, of letters, digits and single spaces."""
    plain = F.regexp_replace(deaccent(F.lower(F.coalesce(title, F.lit("")))), "['’ʼ`]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^\p{L}\p{N}\s]+", " "), r"\s+", " "))


def tokens_of(normal: Column) -> Column:
    """Distinct words of a normal title that say something."""
    stop = F.split(F.lit(" ".join(STOPWORDS)), " ")
    return F.array_distinct(F.filter(F.split(normal, " "), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w)))


def stems_of(tokens: Column) -> Column:
    return F.array_distinct(F.transform(tokens, lambda w: F.substring(w, 1, STEM)))


def trigrams_of(normal: Column) -> Column:
    """Distinct runs of three characters of a normal title between two spaces."""
    none = F.array().cast("array<string>")
    runs = lambda p: F.when(F.length(p) >= 3, F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - 2, F.lit(1))), lambda i: F.substring(p, i, F.lit(3)))).otherwise(none)
    return F.array_distinct(bound(F.concat(F.lit(" "), normal, F.lit(" ")), runs))


def significant_tokens(title: Column) -> Column:
    return tokens_of(normalize_title(title))


def significant_stems(title: Column) -> Column:
    return stems_of(significant_tokens(title))


def trigrams(title: Column) -> Column:
    return trigrams_of(normalize_title(title))


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    both = shared(a, b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def dice(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(2 * shared(a, b) / (F.size(a) + F.size(b)))


def slugify(text: Column, most: int = 60) -> Column:
    slug = F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    slug = F.regexp_replace(F.substring(slug, 1, most), "-+$", "")
    return F.when(slug == "", F.lit("sans-titre")).otherwise(slug)


def escape_html(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"([\\`*_\[\]<>])", r"\\$1")
