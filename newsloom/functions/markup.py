"""One pass over loose markup: a text is cut once at the tags of known elements, and elements are picked from those events.

Markup of feeds is often broken, so nothing is nested: an element reaches from its start tag to the next end tag of its name.
Names are compared in lower case, without prefix unless the asked name has one. All is SQL text over an event struct:
``tags`` in order, the ``texts`` around them (one more), and for each tag the name that it ``starts``, ``ends``, or is as an ``empty`` tag.
"""

from __future__ import annotations

import re

from .text import SPACES, let, quoted, sql_decoded

_NAME = "[A-Za-z0-9_.-]+"
VISIBLE = quoted("[^" + SPACES[1:-2] + "]")


def tag_pattern(names: list[str]) -> str:
    """Start, end and empty tags of elements of those local names, by any prefix."""
    return rf"(?i)</?(?:{_NAME}:)?(?:{'|'.join(re.escape(n) for n in sorted(set(names)))})(?:\s[^>]*)?/?>"


def _strings(names: list[str] | tuple[str, ...]) -> str:
    return f"array({', '.join(quoted(n) for n in names)})"


def scanned(text: str, pattern: str) -> str:
    """The event struct of a text."""
    p = quoted(pattern)
    starts = f"NOT startswith(g_, '</') AND g_ RLIKE {quoted(rf'^<(?:{_NAME}:)?{_NAME}[\s>]')}"
    ends = f"g_ RLIKE {quoted(r'^</[^\s>]+\s*>$')}"
    kinds = {"starts": starts, "ends": ends, "empty": "NOT startswith(g_, '</') AND endswith(g_, '/>')", "any": "NOT startswith(g_, '</')"}
    parts = [f"'{k}', CASE WHEN {on} THEN n_ ELSE '' END, '{k}_local', CASE WHEN {on} THEN substring_index(n_, ':', -1) ELSE '' END" for k, on in kinds.items()]
    name = f"lower(regexp_extract(g_, {quoted(rf'^</?((?:{_NAME}:)?{_NAME})')}, 1))"
    mark = let("n_", name, f"named_struct({', '.join(parts)})")
    arrays = ", ".join(f"'{k}{local}', z_.{k}{local}" for k in kinds for local in ("", "_local"))
    told = let("z_", f"transform(k_, g_ -> {mark})", f"named_struct('tags', k_, 'texts', split(y_, {p}, -1), {arrays})")
    return let("y_", f"coalesce({text}, '')", let("k_", f"regexp_extract_all(y_, {p}, 0)", told))


def _named(events: str, kind: str, name: str) -> str:
    return f"CASE WHEN contains({name}, ':') THEN {events}.{kind} ELSE {events}.{kind}_local END"


def unwrapped(value: str) -> str:
    cdata = quoted(r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$")
    return let("w_", value, f"CASE WHEN contains(w_, '<![CDATA[') THEN regexp_replace(w_, {cdata}, '$1') ELSE w_ END")


def body(events: str, i: str, name: str) -> str:
    """What follows the i-th tag (from 1) up to the next end tag of the name; null without one."""
    rest = f"slice({_named(events, 'ends', name)}, {i} + 1, greatest(size({events}.tags) - {i}, 0))"
    inside = f"array_join(zip_with(slice({events}.texts, {i} + 1, j_), concat(slice({events}.tags, {i} + 1, j_ - 1), array('')), (a_, b_) -> concat(a_, b_)), '')"
    place = f"CASE WHEN get({_named(events, 'ends', name)}, {i}) = {name} THEN 1 ELSE cast(array_position({rest}, {name}) AS INT) END"  # mostly the next tag
    return let("j_", place, unwrapped(f"CASE WHEN j_ = 1 THEN get({events}.texts, {i}) WHEN j_ > 1 THEN {inside} END"))


def contents(events: str, names: list[str] | tuple[str, ...]) -> str:
    """For each name the content of its first element; an empty text if that is blank or missing and an empty tag is there; else null."""
    first = f"cast(array_position({_named(events, 'starts', 'c_')}, c_) AS INT)"
    found = let("i_", first, f"CASE WHEN i_ > 0 THEN {body(events, 'i_', 'c_')} END")
    one = let("v_", found, f"CASE WHEN regexp_like(coalesce(v_, ''), {VISIBLE}) THEN v_ WHEN array_contains({_named(events, 'empty', 'c_')}, c_) THEN '' END")
    return f"transform({_strings(names)}, c_ -> {one})"


def every(events: str, name: str) -> str:
    """array of (tag, body) of each element of a name that has an end tag."""
    n = quoted(name)
    at = f"filter(transform({_named(events, 'starts', n)}, (s_, i_) -> CASE WHEN s_ = {n} THEN i_ + 1 END), i_ -> i_ IS NOT NULL)"
    return f"filter(transform({at}, i_ -> named_struct('tag', get({events}.tags, i_ - 1), 'body', {body(events, 'i_', n)})), e_ -> e_.body IS NOT NULL)"


def attributes(events: str, names: list[str], wanted: list[str]) -> str:
    """array of (name, and each wanted attribute) of the start and empty tags of those names, in order."""
    asked = f"zip_with({events}.any, {events}.any_local, (m_, l_) -> CASE WHEN array_contains({_strings(names)}, m_) THEN m_ ELSE l_ END)"
    values = ", ".join(f"'{a}', {attribute('g_', a)}" for a in wanted)
    told = f"CASE WHEN array_contains({_strings(names)}, n_) THEN named_struct('name', n_, {values}) END"
    return f"filter(zip_with({asked}, {events}.tags, (n_, g_) -> {told}), e_ -> e_ IS NOT NULL)"


def attribute(tag: str, name: str) -> str:
    """Value of an attribute in a tag, decoded; null without one."""
    value = rf"""(?i)\b{re.escape(name)}\s*=\s*("[^"]*"|\x27[^\x27]*\x27|[^\s"\x27>]+?(?=\s|/?>|["\x27]))"""
    bare = let("q_", f"regexp_extract({tag}, {quoted(value)}, 1)", f"CASE WHEN q_ = '' THEN NULL WHEN q_ RLIKE {quoted(r'^[\x22\x27]')} THEN substring(q_, 2, length(q_) - 2) ELSE q_ END")
    return let("u_", bare, f"CASE WHEN u_ IS NOT NULL THEN {sql_decoded('u_')} END")
