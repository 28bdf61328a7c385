"""Lexical relevance, content type and tags, by a dictionary of all terms that is looked up once for each word of a text.

A term is a whole word, a root that up to six letters may follow, or a phrase. Each key of the dictionary holds a bit for every group of
terms that it belongs to, so that one pass over a text's distinct words answers for all groups and languages. The dictionary
is a hash table in one literal: an array of small maps, by checksum of the word. Roots are found by the prefixes of a word. Phrases
are keyed by their first word; where one may stand, the groups' expressions decide, which follow their order of preference.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import applied, fold, let, quoted

# Terms that hold in any language.
ISRAEL = ["israel", "israël", "israeli", "israelien", "israélien", "israelisch", "israeliano", "israelí", "izrael", "ізраїль", "израиль", "ισραήλ", "jerusalem", "jérusalem", "tel aviv", "knesset", "tsahal", "idf"]
PODCAST = ["podcast", "baladodiffusion", "épisode", "episode", "folge", "puntata", "episodio", "odcinek", "avsnitt", "hlaðvarp", "podkast", "подкаст"]
EVENT = ["exposition", "vernissage", "colloque", "conférence", "rencontre", "festival", "exhibition", "lecture series", "symposium", "ausstellung", "tagung", "vortrag", "mostra", "convegno", "exposición", "wystawa", "konferencja", "kiállítás", "utställning", "näyttely", "izložba", "έκθεση", "выставка", "виставка"]
BOOK = ["book", "books", "novel", "memoir", "livre", "roman", "essai", "parution", "buch", "sachbuch", "libro", "romanzo", "saggio", "novela", "książka", "powieść", "könyv", "kniha", "bok", "boek", "βιβλίο", "книга", "grāmata", "knyga", "raamat", "kirja", "kitap", "carte", "knjiga", "éditions", "editions", "verlag", "publisher", "wydawnictwo", "nakladatelství"]
ROOTS = ["jewish", "jewry", "judaism", "judaizm", "judaiz", "judais", "judentum", "synagog", "sinagog", "sunagoog", "zsinagog", "synagoog", "sinagóg", "yiddish", "jiddisch", "jidysz", "jidis", "jiddis", "sefard", "sephard", "ashkenaz", "aschkenas", "aszkenaz", "asjkenaz"]
WORDS = ["juif", "juifs", "juive", "juives", "jew", "jews", "juden", "joden", "ebrei", "ebreo", "ebraico", "zydzi", "zsido", "zsidok", "evrei", "evreu", "judio", "judios", "judeu", "judeus", "kosher", "koscher", "casher", "kacher"]
SUFFIX = 6


def folded(term: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", term or "") if not 0x300 <= ord(c) <= 0x36F).lower()


def pattern(terms: list[str], roots: list[str] = ()) -> str | None:
    """Whole words, and roots followed by at most six letters, longest first; null without terms."""
    longest = lambda xs: sorted(dict.fromkeys(filter(None, map(folded, xs))), key=len, reverse=True)
    parts = [rf"{re.escape(r)}\p{{L}}{{0,{SUFFIX}}}" for r in longest(roots)] + [re.escape(w) for w in longest(terms)]
    return rf"(?iu)(?<![\p{{L}}\p{{N}}])(?:{'|'.join(parts)})(?![\p{{L}}\p{{N}}])" if parts else None


@dataclass
class Vocabulary:
    """One language's terms; the groups of a vocabulary file."""

    core: list[str] = field(default_factory=list)
    hostile: list[str] = field(default_factory=list)
    culture: list[str] = field(default_factory=list)
    books: list[str] = field(default_factory=list)
    core_roots: list[str] = field(default_factory=list)
    hostile_roots: list[str] = field(default_factory=list)


GROUPS = ("fallback", "universal", "hostile", "israel", "culture", "podcast", "event", "books")
_ODD, _LANGUAGES = 62, 54  # the bit of words that begin a phrase; languages that the bits leave room for
_WORD = r"[\p{L}\p{N}]+"


class Table:
    """A hash table from words to bits, as SQL."""

    def __init__(self, bits: dict[str, int]):
        size = 1 << max(0, len(bits).bit_length() - 1)
        buckets: list[dict[str, int]] = [{} for _ in range(size)]
        for word, mask in sorted(bits.items()):
            buckets[zlib.crc32(word.encode()) % size][word] = mask
        self.size, self.sql = size, f"from_json({quoted(json.dumps(buckets).replace(chr(39), chr(92) + 'u0027'))}, 'array<map<string,bigint>>')"

    def at(self, word: str) -> str:
        """The bits of a word, 0 for an unknown one."""
        return f"coalesce(try_element_at(get({self.sql}, cast(crc32(cast({word} AS BINARY)) % {self.size} AS INT)), {word}), 0L)"


class Dictionary:
    """All terms of all groups; ``groups`` holds (words, roots) by name."""

    def __init__(self, groups: dict[str, tuple[list[str], list[str]]]):
        if len(groups) > _ODD:
            raise ValueError(f"at most {_LANGUAGES} languages, not {len(groups) - len(GROUPS)}")
        self.bit = {name: k for k, name in enumerate(groups)}
        self.patterns = {name: pattern(*terms) for name, terms in groups.items()}
        words: dict[str, int] = {}
        roots: dict[str, int] = {}
        self.phrases: list[str] = []
        for name, (plain, starts) in groups.items():
            for table, terms in ((words, plain), (roots, starts)):
                for term in filter(None, map(folded, terms)):
                    if [term] == re.findall(r"[^\W_]+", term):
                        table[term] = table.get(term, 0) | 1 << self.bit[name]
                    else:
                        # a phrase's first word, or the root of one
                        self.phrases.append(term)
                        first = re.findall(r"[^\W_]+", term)[:1]
                        of = words if table is words or [term] != [first] else roots
                        for w in first:
                            of[w] = of.get(w, 0) | 1 << _ODD
        self.phrases = sorted(set(self.phrases))
        self.everywhere = any(not re.findall(r"[^\W_]+", p) for p in self.phrases)  # terms without any letter have no first word
        self.stem = min([3, *map(len, roots)])
        self.words, self.roots = Table(words), Table(roots)
        self.stems = Table({r[: self.stem]: 1 for r in roots})

    def scanned(self, text: str) -> str:
        """SQL of (text, found, odd) for a folded text: its distinct known words with their bits, and whether a phrase may stand in it."""
        cut = "left(t1_, length(t1_) - k_)"
        ending = f"k_ = 0 OR right(t1_, k_) RLIKE {quoted(r'^\p{L}+$')}"
        by_root = f"aggregate(sequence(0, least({SUFFIX}, greatest(0, length(t1_) - 1))), 0L, (m_, k_) -> CASE WHEN {ending} THEN m_ | {self.roots.at(cut)} ELSE m_ END)"
        bits = f"{self.words.at('t1_')} | CASE WHEN {self.stems.at(f'left(t1_, {self.stem})')} <> 0 THEN {by_root} ELSE 0L END"
        found = f"filter(transform(array_distinct(regexp_extract_all(x1_, {quoted(_WORD)}, 0)), t1_ -> named_struct('word', t1_, 'bits', {bits})), f1_ -> f1_.bits <> 0)"
        phrases = f"exists(from_json({quoted(json.dumps(self.phrases).replace(chr(39), chr(92) + 'u0027'))}, 'array<string>'), p1_ -> contains(x1_, p1_))"
        first = "true" if self.everywhere else f"exists(f2_, f1_ -> (f1_.bits & shiftleft(1L, {_ODD})) <> 0)"
        odd = f"{first} AND {phrases}" if self.phrases else "false"
        return let("x1_", f"coalesce({text}, '')", let("f2_", found, f"named_struct('text', x1_, 'found', f2_, 'odd', {odd})"))

    def hits(self, scan: str, group: str) -> str:
        """SQL of the distinct matched strings of a group in their order."""
        if not self.patterns[group]:
            return "cast(array() AS array<string>)"
        return f"CASE WHEN {scan}.odd THEN array_distinct(regexp_extract_all({scan}.text, {quoted(self.patterns[group])}, 0)) ELSE {self._plain(scan, str(self.bit[group]))} END"

    @staticmethod
    def _plain(scan: str, bit: str) -> str:
        return f"transform(filter({scan}.found, f1_ -> (f1_.bits & shiftleft(1L, {bit})) <> 0), f1_ -> f1_.word)"

    def hits_of(self, scan: str, language: str, languages: list[str]) -> str:
        """As ``hits``, for the group of a language; without one all vocabularies, in an unknown one the universal terms."""
        table = lambda of: f"from_json({quoted(json.dumps(of).replace(chr(39), chr(92) + 'u0027'))}, 'map<string,string>')"
        pick = lambda of, none, other: f"CASE WHEN l1_ IS NULL THEN {none} ELSE coalesce(try_element_at({table(of)}, l1_), {other}) END"
        bit = pick({c: str(self.bit[f"core:{c}"]) for c in languages}, f"'{self.bit['fallback']}'", f"'{self.bit['universal']}'")
        text = lambda p: quoted(p or "(?!)")
        expression = pick({c: self.patterns[f"core:{c}"] for c in languages}, text(self.patterns["fallback"]), text(self.patterns["universal"]))
        odd = f"array_distinct(regexp_extract_all({scan}.text, {expression}, 0))"
        return let("l1_", f"lower(split({language}, '[-_]')[0])", f"CASE WHEN {scan}.odd THEN {odd} ELSE {let('b1_', f'cast({bit} AS INT)', self._plain(scan, 'b1_'))} END")


class Analyzer:
    """Columns of relevance, type and tags for articles in many languages.

    A known language uses its own core terms with the universal ones, an unknown one the universal ones alone, and no language
    at all the union of all vocabularies. The other groups are shared by all languages.
    """

    def __init__(self, languages: dict[str, Vocabulary]):
        every = list(languages.values())
        of = lambda name: [t for v in every for t in getattr(v, name)]
        shared = {"fallback": (of("core"), of("core_roots")), "universal": (WORDS, ROOTS), "hostile": (of("hostile"), of("hostile_roots")), "israel": (ISRAEL, []), "culture": (of("culture"), []), "podcast": (PODCAST, []), "event": ([*of("culture"), *EVENT], []), "books": ([*of("books"), *BOOK], [])}
        self.languages = list(languages)
        self.dictionary = Dictionary(shared | {f"core:{code}": ([*v.core, *WORDS], [*v.core_roots, *ROOTS]) for code, v in languages.items()})
        self.generic = sorted({folded(t)[:6] for n in ("core", "hostile", "culture", "books", "core_roots", "hostile_roots") for x in of(n) for t in re.split(r"\W+", x) if t})

    def scan(self, text: Column) -> Column:
        """A folded text's words in the dictionary: what the other methods work on, once for each text."""
        return applied(text, self.dictionary.scanned)

    def hits(self, scan: Column, group: str) -> Column:
        return applied(scan, lambda s: self.dictionary.hits(s, group))

    def core_hits(self, scan: Column, language: Column) -> Column:
        return applied(F.struct(scan.alias("s"), language.alias("l")), lambda x: self.dictionary.hits_of(f"{x}.s", f"{x}.l", self.languages))

    @staticmethod
    def _body(summary: Column, categories: Column) -> Column:
        return fold(F.concat_ws(" ", F.coalesce(summary, F.lit("")), F.array_join(F.coalesce(categories, F.array().cast("array<string>")), " ")))

    def relevance(self, title: Column, summary: Column, categories: Column, language: Column) -> Column:
        """struct(score, motifs, direct)."""
        return self._relevance(self.scan(fold(title)), self.scan(self._body(summary, categories)), language)

    def _relevance(self, head: Column, body: Column, language: Column) -> Column:
        d = self.dictionary

        def told(x: str) -> str:
            sets = {f"{g}_{side}": d.hits(f"{x}.{side}", group) for g, group in (("bad", "hostile"), ("il", "israel")) for side in ("head", "body")}
            sets |= {f"core_{side}": d.hits_of(f"{x}.{side}", f"{x}.language", self.languages) for side in ("head", "body")}
            n = lambda k: f"size(r1_.{k})"
            score = f"3.0D * {n('core_head')} + least({n('core_body')}, 4) + 3.0D * {n('bad_head')} + least({n('bad_body')}, 4) + 1.5D * {n('il_head')} + 0.5D * least({n('il_body')}, 3)"
            motifs = "slice(array_distinct(concat(r1_.core_head, r1_.bad_head, r1_.il_head)), 1, 6)"
            return let("r1_", "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in sets.items()) + ")", f"named_struct('score', {score}, 'motifs', {motifs}, 'direct', {n('core_head')} + {n('bad_head')} > 0)")

        return applied(F.struct(head.alias("head"), body.alias("body"), language.alias("language")), told)

    def content_type(self, title: Column, summary: Column, forced: Column, has_audio: Column) -> Column:
        return self._content_type(self.scan(fold(title)), self.scan(fold(summary)), forced, has_audio)

    def _content_type(self, head: Column, body: Column, forced: Column, has_audio: Column) -> Column:
        d = self.dictionary

        def told(x: str) -> str:
            worth = lambda group: f"2 * size({d.hits(f'{x}.head', group)}) + size({d.hits(f'{x}.body', group)})"
            kind = let("w1_", f"named_struct('book', {worth('books')}, 'event', {worth('event')})", "CASE WHEN w1_.book >= 2 AND w1_.book >= w1_.event THEN 'livre' WHEN w1_.event >= 2 THEN 'evenement' ELSE 'actualite' END")
            return f"CASE WHEN coalesce({x}.forced, '') <> '' THEN {x}.forced WHEN {x}.audio OR size({d.hits(f'{x}.head', 'podcast')}) > 0 THEN 'podcast' ELSE {kind} END"

        return applied(F.struct(head.alias("head"), body.alias("body"), forced.alias("forced"), has_audio.alias("audio")), told)

    def tags(self, title: Column, summary: Column, language: Column) -> Column:
        return self._tags(self.scan(F.concat_ws(" ", fold(title), fold(summary))), language)

    def _tags(self, both: Column, language: Column) -> Column:
        d = self.dictionary

        def told(x: str) -> str:
            has = lambda sql: f"size({sql}) > 0"
            group = lambda g: has(d.hits(f"{x}.both", g))
            core = has(d.hits_of(f"{x}.both", f"{x}.language", self.languages))
            return let("h1_", group("hostile"), f"slice(filter(array(CASE WHEN h1_ THEN 'antisémitisme' END, CASE WHEN {group('israel')} THEN 'Israël' END, CASE WHEN {group('culture')} THEN 'culture' END, CASE WHEN NOT h1_ AND {core} THEN 'vie juive' END), g1_ -> g1_ IS NOT NULL), 1, 3)")

        return applied(F.struct(both.alias("both"), language.alias("language")), told)

    def annotated(self, rows: DataFrame) -> DataFrame:
        """Adds relevance, motifs, direct, type and tags to articles with title, summary, categories, language, forced_type and audio.

        Each text is scanned once; where neither categories nor a phrase across two texts can tell, scans are put together.
        """
        none = "cast(array() AS array<string>)"
        scans = rows.withColumns({"head_": self.scan(fold(F.col("title"))), "body_": self.scan(fold(F.col("summary")))})
        joined = "named_struct('text', concat_ws(' ', head_.text, body_.text), 'found', array_distinct(concat(head_.found, body_.found)), 'odd', false)"
        both = F.when(F.lit(not self.dictionary.phrases), F.expr(joined)).otherwise(self.scan(F.concat_ws(" ", "head_.text", "body_.text")))
        more = F.when(F.expr(f"size(coalesce(categories, {none})) = 0"), F.col("body_")).otherwise(self.scan(self._body(F.col("summary"), F.col("categories"))))
        scans = scans.withColumns({"both_": both, "more_": more})
        found = scans.withColumns({"r_": self._relevance(F.col("head_"), F.col("more_"), F.col("language")), "type": self._content_type(F.col("head_"), F.col("body_"), F.col("forced_type"), F.col("audio").isNotNull()), "tags": self._tags(F.col("both_"), F.col("language"))})
        return found.withColumns({"relevance": F.col("r_.score"), "motifs": F.col("r_.motifs"), "direct": F.col("r_.direct")}).drop("head_", "body_", "both_", "more_", "r_")
