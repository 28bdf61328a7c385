"""Links: canonical form, host, origin. Absolute http(s) links are rewritten; anything else stays as it is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import applied, let, quoted

# Beginnings of tracking parameters.
TRACKING = r"^(?:utm_|fbclid|gclid|mc_[ce]id|igshid|ref|ref_src|s_cid|cmpid|at_medium|at_campaign|_ga|spm|xtor)"
_URL = r"(?i)^(https?)://([^/?#]+)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
# Fixed values of Punycode (RFC 3492): base, least and greatest threshold, skew, damping, first bias.
BASE, T_MIN, T_MAX, SKEW, DAMP, BIAS = 36, 1, 26, 38, 700, 72


def _digits(delta: str, bias: str) -> str:
    """A number in digits of growing weight, as letters and figures."""
    digit = lambda d: f"substring('abcdefghijklmnopqrstuvwxyz0123456789', cast({d} AS INT) + 1, 1)"
    threshold = f"least({T_MAX}L, greatest({T_MIN}L, k6_ * {BASE}L - z_.b))"
    step = let("t6_", threshold, f"CASE WHEN a6_.q < 0 THEN a6_ WHEN a6_.q < t6_ THEN named_struct('q', -1L, 's', concat(a6_.s, {digit('a6_.q')})) ELSE named_struct('q', (a6_.q - t6_) div ({BASE} - t6_), 's', concat(a6_.s, {digit(f't6_ + (a6_.q - t6_) % ({BASE} - t6_)')})) END")
    return let("z_", f"named_struct('q', {delta}, 'b', {bias})", f"aggregate(sequence(1, 14), named_struct('q', z_.q, 's', ''), (a6_, k6_) -> {step}).s")


def _adapted(delta: str, points: str, first: str) -> str:
    """The next bias."""
    most = (BASE - T_MIN) * T_MAX // 2
    start = let("h7_", f"CASE WHEN {first} THEN {delta} div {DAMP} ELSE {delta} div 2 END", f"h7_ + h7_ div {points}")
    shrunk = f"aggregate(sequence(1, 14), named_struct('d', {start}, 'k', 0L), (a7_, i7_) -> CASE WHEN a7_.d > {most} THEN named_struct('d', a7_.d div {BASE - T_MIN}, 'k', a7_.k + {BASE}) ELSE a7_ END)"
    return let("y7_", shrunk, f"y7_.k + ({BASE - T_MIN + 1} * y7_.d) div (y7_.d + {SKEW})")


def sql_ascii_label(label: str) -> str:
    """A label of a host name in ASCII: Punycode behind ``xn--`` where it has other letters."""
    state = "named_struct('n', {n}, 'delta', {delta}, 'bias', {bias}, 'h', {h}, 's', {s})"
    same = state.format(n="a5_.n", delta="a5_.delta", bias="a5_.bias", h="a5_.h", s="a5_.s")
    less = state.format(n="a5_.n", delta="a5_.delta + 1", bias="a5_.bias", h="a5_.h", s="a5_.s")
    met = state.format(n="a5_.n", delta="0L", bias=_adapted("a5_.delta", "(a5_.h + 1)", "a5_.h = size(basic_)"), h="a5_.h + 1", s=f"concat(a5_.s, {_digits('a5_.delta', 'a5_.bias')})")
    letters = f"aggregate(points_, {state.format(n='m4_', delta='a4_.delta + (m4_ - a4_.n) * (a4_.h + 1)', bias='a4_.bias', h='a4_.h', s='a4_.s')}, (a5_, c5_) -> CASE WHEN c5_ < m4_ THEN {less} WHEN c5_ = m4_ THEN {met} ELSE {same} END)"
    after = let("g4_", letters, state.format(n="m4_ + 1", delta="g4_.delta + 1", bias="g4_.bias", h="g4_.h", s="g4_.s"))
    start = state.format(n="128L", delta="0L", bias=f"{BIAS}L", h="cast(size(basic_) AS BIGINT)", s="''")
    plain = "array_join(basic_, '')"
    whole = f"concat('xn--', {plain}, CASE WHEN size(basic_) > 0 THEN '-' ELSE '' END, aggregate(array_sort(array_distinct(filter(points_, c_ -> c_ > 127))), {start}, (a4_, m4_) -> {after}).s)"
    points = let("points_", "transform(split(w4_, ''), c_ -> cast(ascii(c_) AS BIGINT))", let("basic_", "filter(split(w4_, ''), c_ -> ascii(c_) < 128)", whole))
    return let("w4_", label, f"CASE WHEN w4_ RLIKE {quoted(r'^[\x00-\x7F]*$')} THEN w4_ ELSE {points} END")


def sql_host(host: str) -> str:
    """Lower case, in ASCII, without www."""
    labels = f"transform(split(regexp_replace(lower({host}), '[\\u3002\\uff0e\\uff61]', '.'), '[.]'), l4_ -> {sql_ascii_label('l4_')})"
    return f"regexp_replace(array_join({labels}, '.'), {quoted(r'^www\.')}, '')"


def _decoded(part: str) -> str:
    """Of a form's field; a percent sign that begins no code is one."""
    return f"coalesce(try_url_decode(regexp_replace({part}, '%(?![0-9A-Fa-f][0-9A-Fa-f])', '%25')), {part})"


def _sql_canonical(url: str) -> str:
    piece = lambda k: f"regexp_extract({url}, {quoted(_URL)}, {k})"
    ports = f"CASE WHEN lower({piece(1)}) = 'http' THEN ':(80|443)$' ELSE ':443$' END"
    host = let("o_", f"regexp_replace({piece(2)}, {ports}, '')", f"concat({sql_host(f'regexp_replace(o_, {quoted(r':\d+$')}, {chr(39) * 2})')}, regexp_extract(o_, {quoted(r'(:\d+)$')}, 1))")
    # other letters, spaces and the marks that may not stand in a path, in UTF-8 by percent signs
    odd = quoted(r"[^\x21-\x7E]|[\x22<>`{}]")
    path = let("p_", f"CASE WHEN {piece(3)} = '' THEN '/' ELSE {piece(3)} END", f"CASE WHEN p_ RLIKE {odd} THEN array_join(transform(split(p_, ''), c_ -> CASE WHEN c_ RLIKE {odd} THEN replace(url_encode(c_), '+', '%20') ELSE c_ END), '') ELSE p_ END")
    fields = f"transform(filter(split({piece(4)}, '&'), f_ -> f_ <> ''), (f_, i_) -> named_struct('k', {_decoded('''split_part(f_, '=', 1)''')}, 'i', i_, 'v', {_decoded('''substring(f_, length(split_part(f_, '=', 1)) + 2)''')}))"
    kept = f"array_sort(filter({fields}, s_ -> NOT s_.k RLIKE {quoted('(?i)' + TRACKING)}))"
    query = f"array_join(transform({kept}, s_ -> concat(url_encode(s_.k), '=', url_encode(s_.v))), '&')"
    parts = f"named_struct('host', {host}, 'path', {path}, 'query', {query})"
    whole = let("u_", parts, let("v_", "concat('https://', u_.host, u_.path, CASE WHEN u_.query = '' THEN '' ELSE concat('?', u_.query) END)", "CASE WHEN u_.path <> '/' AND endswith(v_, '/') THEN left(v_, length(v_) - 1) ELSE v_ END"))
    return f"CASE WHEN coalesce({url}, '') = '' THEN NULL WHEN {url} RLIKE {quoted(_URL)} THEN {whole} ELSE {url} END"


def canonical_url(url: Column) -> Column:
    """https, host in lower case and ASCII without www., no fragment, no tracking parameters, the others sorted by name and encoded
    as a form does, no closing slash."""
    return applied(url, _sql_canonical)


def hostname(url: Column) -> Column:
    host = lambda u: f"CASE WHEN {u} RLIKE {quoted(_URL)} THEN {sql_host(f'regexp_replace(regexp_extract({u}, {quoted(_URL)}, 2), {quoted(chr(58) + chr(92) + "d+$")}, {chr(39) * 2})')} END"
    return applied(url, host)


def site_root(url: Column) -> Column:
    return F.when(url.rlike(_URL), F.lower(F.regexp_extract(url, r"(?i)^(https?://[^/?#]+)", 1)))
