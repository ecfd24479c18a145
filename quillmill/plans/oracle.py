"""Pieces of SQL that the oracles of the catalogue are made of, in DuckDB's dialect."""

from __future__ import annotations

import re

from ..functions.text import STOP_WORDS
from ..operators import claims, gate, profiles

WS = r"[\s\x{0B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(words: list[str]) -> str:
    return "[" + ", ".join(map(quoted, words)) + "]"


def count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {quoted(pattern)}))"


def length(text: str) -> str:
    return f"(length({text}) + {count(text, '[' + chr(92) + 'x{10000}-' + chr(92) + 'x{10FFFF}]')})"


def trim(text: str) -> str:
    return rf"regexp_replace({text}, '\A{WS}+|{WS}+\z', '', 'g')"


def tokens(text: str, n: int) -> str:
    grams = "CASE WHEN length(c) >= 2 THEN list_transform(range(1, length(c)), lambda i: substr(c, i, 2)) ELSE [] END" if n == 2 else "CASE WHEN length(c) >= 3 THEN list_transform(range(1, length(c) - 1), lambda i: substr(c, i, 3)) WHEN length(c) = 2 THEN [c] ELSE [] END"
    return (
        rf"list_filter(flatten(list_transform(regexp_extract_all(lower({text}), '[a-z0-9_\x{{4E00}}-\x{{9FFF}}]+'), lambda c: CASE WHEN regexp_matches(c, '[\x{{4E00}}-\x{{9FFF}}]') THEN {grams} "
        f"WHEN length(c) >= 2 THEN [c] ELSE [] END)), lambda t: NOT list_contains({listed(STOP_WORDS)}, t))"
    )


def gate_metrics(table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """Metrics of all rules for every row."""
    t = f"coalesce({text}, '')"
    phrases = " + ".join(f"(contains(lower({t}), {quoted(p)}))::INT" for p in gate.AD_PHRASES + gate.BAIT_PHRASES)
    patterns = " + ".join(count(t, p) for p in gate.AD_PATTERNS)
    links = " || ".join(f"regexp_extract_all({t}, {quoted(p)})" for p in gate.LINK_PATTERNS)
    return rf"""
m0 AS (SELECT {key}, {t} AS t, {length(t)} AS len, {phrases} + {patterns} AS quality_hits, {' + '.join(count(t, p) for p in gate.HTML_PATTERNS)} AS html_hits,
  {' + '.join(count(t, p) for p in gate.MOJIBAKE_PATTERNS)} AS mojibake_hits, {links} AS links, {count(t, WS + '*[|·•»›▸→]' + WS + '*')} AS separators,
  {tokens(t, 2)} AS toks, {count(t, '[^' + gate.CLEAN_RANGES + ']')} / greatest({length(t)}, 1) AS noise_ratio FROM {table}),
tk AS (SELECT {key}, sum(c) AS token_total, count(*) AS token_distinct, max(c) AS token_top FROM (SELECT {key}, k, count(*) AS c FROM (SELECT {key}, unnest(toks) AS k FROM m0) GROUP BY 1, 2) GROUP BY 1),
pa AS (SELECT {key}, list_filter(list_transform(regexp_split_to_array(t, '\n{WS}*\n'), lambda p: {trim('p')}), lambda p: p <> '') AS ps FROM m0),
pk AS (SELECT {key}, ps, len(ps) AS n FROM pa WHERE len(ps) > 0),
pi AS (SELECT {key}, unnest(CASE WHEN n <= 40 THEN range(1, n + 1) ELSE list_distinct([1, n] || list_transform(range(1, 39), lambda i: least(n - 1, floor(i * (n / 40.0))::BIGINT) + 1)) END) AS i, ps FROM pk),
pt AS (SELECT {key}, i, list_distinct({tokens('ps[i]', 2)}) AS s FROM pi),
pv AS (SELECT a.{key}, max(len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))) AS paragraph_similarity FROM pt a JOIN pt b ON a.{key} = b.{key} AND a.i < b.i WHERE len(a.s) >= 8 AND len(b.s) >= 8 GROUP BY 1),
m AS (SELECT m0.{key}, len, greatest(1.0, log10(len + 10)) AS f, quality_hits, html_hits, mojibake_hits, len(links) AS link_count, coalesce(list_sum(list_transform(links, lambda x: {length('x')})), 0) AS link_chars, separators, noise_ratio,
  coalesce(token_total, 0) AS token_total, coalesce(token_distinct, 0) AS token_distinct, coalesce(token_top, 0) AS token_top, coalesce(paragraph_similarity, 0) AS paragraph_similarity
  FROM m0 LEFT JOIN tk USING ({key}) LEFT JOIN pv USING ({key}))"""


def limits(profile: str | None = None) -> dict[str, str]:
    """Each threshold as SQL: a number, or a choice by the column that holds the profile."""
    if profile is None:
        return {k: repr(float(v)) for k, v in profiles.DEFAULTS.items()}
    return {k: f"(CASE {profile} WHEN 'dense' THEN {float(v[0])} WHEN 'sparse' THEN {float(v[2])} ELSE {float(v[1])} END)" for k, v in profiles.THRESHOLDS.items()}


def gate_statuses(at: dict[str, str]) -> dict[str, str]:
    def two(value: str, block: str, share_b: float, warn: str, share_w: float) -> str:
        return f"CASE WHEN {value} >= greatest({at[block]}, floor({at[block]} * f * {share_b})) THEN 'block' WHEN {value} >= greatest({at[warn]}, floor({at[warn]} * f * {share_w})) THEN 'warn' ELSE 'ok' END"

    thin = "1 / sqrt(log10(token_total + 10))"
    widen = "least(2.0, 1 + (f - 1) * 0.5)"
    return {
        "length": f"CASE WHEN len < {at['min_length']} THEN 'block' WHEN len < {at['warn_length']} THEN 'warn' WHEN len > {at['max_length']} THEN 'block' WHEN len > {at['warn_max_length']} THEN 'warn' ELSE 'ok' END",
        "quality": two("quality_hits", "quality_block", 0.6, "quality_warn", 0.5),
        "html": two("html_hits", "html_block", 0.7, "html_warn", 0.6),
        "mojibake": two("mojibake_hits", "mojibake_block", 0.7, "mojibake_warn", 0.6),
        "links": f"CASE WHEN len < 100 THEN 'ok' WHEN link_chars / len > {at['link_ratio']} AND link_count >= 5 AND link_count / (len / 100.0) > {at['link_block']} THEN 'block' WHEN separators >= 5 THEN 'warn' WHEN link_count >= 5 AND link_count / (len / 100.0) > greatest(0.3, {at['link_warn']} * least(1.5, 1 + (f - 1) * 0.3)) THEN 'warn' ELSE 'ok' END",
        "stuffing": f"CASE WHEN len < {at['stuffing_min_length']} OR token_distinct < 10 OR token_top < {at['stuffing_min_count']} OR token_top / (len / 100.0) < {at['stuffing_warn']} * {widen} THEN 'ok' WHEN token_top / (len / 100.0) >= {at['stuffing_block']} * {widen} THEN 'block' ELSE 'warn' END",
        "density": f"CASE WHEN token_total < 20 THEN 'ok' WHEN token_distinct / token_total < {at['min_density']} * greatest(0.3, {thin}) THEN 'block' WHEN token_distinct / token_total < {at['warn_density']} * greatest(0.5, {thin}) THEN 'warn' ELSE 'ok' END",
        "noise": f"CASE WHEN len < 50 THEN 'ok' WHEN noise_ratio > {at['max_noise']} THEN 'block' WHEN noise_ratio > {at['warn_noise']} THEN 'warn' ELSE 'ok' END",
        "paragraphs": f"CASE WHEN paragraph_similarity >= {at['paragraph_block']} THEN 'block' WHEN paragraph_similarity >= {at['paragraph_warn']} THEN 'warn' ELSE 'ok' END",
    }


def densities(table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """What the classification rests on. Neighbouring digits are told apart by doubling every other character, as RE2 knows no look-around."""
    clean = text
    for pattern, by in ((r"```[\s\S]*?```", " "), (r"`[^`]+`", " "), (r"<[^>]+>", " "), (r"https?://\S+", " "), (r"!\[([^\]]*)\]\([^)]+\)", r"\1 "), (r"\[([^\]]*)\]\([^)]+\)", r"\1 "), (r"&\w+;", " "), (r"(?:阅读|阅读数|点赞|在看|转发|收藏)\s*\d+", " "), (r"🎧\s*\d+人", " ")):
        clean = f"regexp_replace({clean}, {quoted(pattern)}, {quoted(by)}, 'g')"
    stop = listed([w for w in STOP_WORDS if w.isascii()])
    years = r"""list_filter(regexp_extract_all(regexp_replace(c, '(\D)', '\1\1', 'g'), '(?:^|\D)(\d{4}(?:(?:--|//|年年)\d{1,2}(?:(?:--|//|月月)\d{1,2})?)?)(?:\D|$)', 1), lambda y: substr(y, 1, 4)::INT BETWEEN 1900 AND 2100)"""
    points = " || ".join(f"regexp_extract_all(c, {quoted(p)})" for p in (r"(?:约|近|超|达)?\d+(?:\.\d+)?%", rf"(?i)\d+(?:\.\d+)?\s*(?:{profiles.UNITS})", r"\d+(?:\.\d+)?\s*(?:万亿|亿|千万|百万|万|千)\s*(?:元|美元|欧元|人|台|套|条|座|个|辆|次)?"))
    parts = rf"list_filter(list_transform(regexp_split_to_array(c, '\n{WS}*\n'), lambda p: {trim('p')}), lambda p: p <> '')"
    per = f"1000.0 / greatest({length('c')}, 1)"
    return rf"""
d0 AS (SELECT {key}, {text} AS t, {clean} AS c FROM {table}),
d1 AS (SELECT {key}, t, {count('t', '```[' + chr(92) + 's' + chr(92) + 'S]*?```')} AS code_blocks,
  (len(list_filter(regexp_extract_all(c, '\b[a-zA-Z]{{3,}}\b'), lambda w: NOT list_contains({stop}, lower(w)))) + {count('c', '[a-zA-Z]+/[a-zA-Z]+')} + {count('c', '[a-zA-Z]+-[a-zA-Z]+')}) * {per} AS term_density,
  len(list_distinct({points} || {years})) * {per} AS data_density,
  coalesce(list_sum(list_transform({parts}, lambda p: {length('p')})) / nullif(len({parts}), 0), 0) AS avg_paragraph,
  ({' + '.join(count('c', w) for w in profiles.NARRATIVE)}) * {per} AS narrative_density FROM d0),
prof AS (SELECT {key}, code_blocks, term_density, data_density, avg_paragraph, narrative_density, CASE WHEN t IS NULL OR {length('t')} < 100 THEN 'balanced' WHEN code_blocks >= 1 OR term_density >= 5 OR data_density >= 4 THEN 'dense'
  WHEN avg_paragraph > 300 AND narrative_density >= 2 THEN 'sparse' ELSE 'balanced' END AS profile FROM d1)"""


def vectors(table: str, key: str, text: str, group: str = "") -> str:
    """Long weighted vectors, their norms and ranks; ``group`` is a column or empty."""
    g, on = (f"{group}, ", f"USING ({group}, k)") if group else ("", "USING (k)")
    sizes = f"SELECT {g}count(*) AS n_docs, avg(length({text})) AS avg_len FROM {table} WHERE {text} IS NOT NULL" + (f" GROUP BY {group}" if group else "")
    join = f"JOIN sz USING ({group})" if group else "CROSS JOIN sz"
    return rf"""
sz AS ({sizes}),
tx AS (SELECT {g}{key}, length({text}) AS len, unnest({tokens(text, 3)}) AS k, generate_subscripts({tokens(text, 3)}, 1) - 1 AS pos FROM {table} WHERE {text} IS NOT NULL),
tc AS (SELECT {g}{key}, k, max(len) AS len, count(*) AS cnt, min(pos) AS pos FROM tx GROUP BY ALL),
df AS (SELECT {g}k, count(*) AS df FROM tc GROUP BY ALL),
idf AS (SELECT {g}k, df, ln((n_docs + 1) / (df + 1)) + 1 AS idf FROM df {join}),
v AS (SELECT {g}{key}, k, len, cnt, pos, df, cnt / (cnt + 1.5 * (0.25 + 0.75 * len / avg_len)) * idf AS w FROM tc JOIN idf {on} {join}),
vn AS (SELECT {g}{key}, count(*) AS n_tokens, sqrt(sum(w * w)) AS norm FROM v GROUP BY ALL),
vr AS (SELECT {g}{key}, k, row_number() OVER (PARTITION BY {g}{key} ORDER BY round(w, 12) DESC, pos) AS r FROM v)"""


def re2(pattern: str) -> str:
    """A pattern in RE2's notation, white space as everywhere here."""
    return re.sub(r"\\u([0-9a-f]{4})", r"\\x{\1}", pattern).replace(r"\s", WS)


def head(text: str, n: int) -> str:
    """The first n UTF-16 units, a character that would be cut left out."""
    return rf"replace(regexp_replace(substr({FILLED.format(text)}, 1, {n}), '[\x{{10000}}-\x{{10FFFF}}]\z', ''), chr(64976), '')"


def claims_sql(table: str, key: str, text: str) -> str:
    found = [f"list_transform(regexp_extract_all(s, {quoted(re2(p))}), lambda a: {{'anchor': a, 'type': '{kind}', 'once': a}})" for kind, patterns in (("numeric", claims.NUMERIC), ("entity", claims.ENTITY)) for p in patterns]
    first = "CASE " + " ".join(f"WHEN contains(s, {quoted(w)}) THEN {quoted(w)}" for w in claims.CAUSAL) + " END"
    cause = f"CASE WHEN {length('s')} >= 8 AND {first} IS NOT NULL THEN [{{'anchor': {first}, 'type': 'causal', 'once': 'causal:' || {head('s', 30)}}}] ELSE [] END"
    return rf"""
WITH s0 AS (SELECT {key}, unnest(l) AS s, generate_subscripts(l, 1) AS si FROM (SELECT {key}, list_transform(regexp_split_to_array({text}, '[。！？\n.!?]+'), lambda x: {trim('x')}) AS l FROM {table})),
s1 AS (SELECT {key}, s, si, {' || '.join(found)} || {cause} AS l FROM s0 WHERE {length('s')} >= 3),
s2 AS (SELECT {key}, s, si, unnest(l) AS c, generate_subscripts(l, 1) AS ci FROM s1),
s3 AS (SELECT {key}, s, si, ci, c, row_number() OVER (PARTITION BY {key}, c.once ORDER BY si, ci) AS n FROM s2),
s4 AS (SELECT {key}, CASE WHEN {length('s')} <= 80 THEN s ELSE {head('s', 80)} || '...' END AS claim, c.anchor AS anchor, c.type AS type, row_number() OVER (PARTITION BY {key} ORDER BY si, ci) - 1 AS pos FROM s3 WHERE n = 1)
SELECT {key}, pos, claim, anchor, type FROM s4 WHERE pos < {claims.LIMIT}"""


# ---- titles, tags and texts, with their own literals ---------------------------------------------------------------------------
HAN = r"\x{4E00}-\x{9FA5}"
_CONCEPTS = "保护|假设|矛盾|影响|效应|机制|策略|方法|思维|模式|偏见|误区|功能|限制|优势|劣势|特点|特征|原理|原则|标准|规范|问题|挑战|风险|机遇|变化|趋势|后果|意义|价值|Check|Effect|War|API|AI|ML|UX|UI|SDK"
_TERMS = "AI|ML|UX|UI|API|SDK|OS|CPU|GPU|RAM|IO|ID|OK|TV|PC|HR|PR|PM|QA|App|Web|Mac|iOS|Android|Check|Effect|War|Note|Data|Code|Node|Git|HTTP|JSON"
_PIECES = "的如|认为|发现|指出|显示|表明|通过|以及"
_WEAK = "(?:的|如|和|与|或|对|在|被|将|把|了|着|吗|呢|啊|吧|么|[a-zA-Z]{1,2})"
FILLED = r"regexp_replace({0}, '([\x{{10000}}-\x{{10FFFF}}])', '\1' || chr(64976), 'g')"


def good_title(t: str) -> str:
    tail = f"regexp_extract({t}, '[a-zA-Z]+$')"
    return (
        f"({length(t)} BETWEEN 4 AND 25 AND NOT (regexp_matches({t}, '[{HAN}]') AND {tail} <> '' AND length({tail}) <= 5 AND NOT regexp_matches({tail}, '(?:{_TERMS})$')) "
        f"AND NOT ({length(t)} > 12 AND regexp_matches({t}, '{_PIECES}')))"
    )


def cut_title(w: str, most: int = 18) -> str:
    head = f"substr({w}, 1, {most})"
    word = rf"regexp_extract({head}, '(?s)\A(.*(?:[{HAN}]|{WS}))[a-zA-Z]*\z', 1)"
    bare = trim(f"regexp_replace({head}, '[a-zA-Z]+$', '')")
    strong = rf"regexp_replace({trim(head)}, '{_WEAK}\z', '')"
    least = trim(f"regexp_replace(substr({w}, 1, 10), '[a-zA-Z]+$', '')")
    return (
        f"CASE WHEN {length(w)} <= {most} THEN {w} WHEN regexp_matches({head}, '[a-zA-Z]$') THEN CASE WHEN length({word}) > 4 THEN {trim(word)} ELSE coalesce(nullif({bare}, ''), substr({w}, 1, 12)) END "
        f"WHEN {length(strong)} >= 4 THEN {strong} ELSE {least} END"
    )


def clean_titles(source: str, raw: str, prefix: str) -> str:
    """CTEs that end in ``{prefix}c``: the source's columns with ``clean``."""
    number = rf"\A(?:[0-9]+[.、]{WS}*|[【(（]?[0-9]+[\]】)）]{WS}*|[①②③④⑤⑥⑦⑧⑨⑩]{WS}*)"
    edge = f"(?:[：:,，]|{WS})+"
    t1 = f"regexp_replace(regexp_replace(regexp_replace({trim(raw)}, {quoted(number)}, ''), {quoted(chr(92) + 'A#{1,3}' + WS + '*')}, ''), '\\A\\*\\*|\\*\\*\\z', '', 'g')"
    core = rf"\A([^\n]{{0,6}})?([^\n]+?(?:{_CONCEPTS}))([^\n]{{0,8}})?\z"
    term = rf"[A-Z][A-Za-z]*(?:{WS}+[A-Z][A-Za-z]*)*"
    within = lambda x, a, b: f"CASE WHEN {length(x)} BETWEEN {a} AND {b} THEN {x} END"
    both = trim(f"{trim('g1')} || g2")
    lead = rf"regexp_replace(substr(w, greatest(0, term_at - 6) + 1, least(term_at, 6)), '\A(?:的|{WS})+', '')"
    joined = trim(f"{lead} || term")
    return rf"""
{prefix}0 AS (SELECT *, {t1} AS t1 FROM {source}),
{prefix}1 AS (SELECT *, CASE WHEN regexp_matches(t1, '\A{edge}') THEN regexp_replace(t1, '\A{edge}', '') ELSE regexp_replace(t1, '{edge}\z', '') END AS t FROM {prefix}0),
{prefix}2 AS (SELECT *, {trim("regexp_extract(t, " + quoted(chr(92) + "A([^" + chr(92) + "n]+?)[：:–—]") + ", 1)")} AS topic FROM {prefix}1),
{prefix}3 AS (SELECT *, CASE WHEN {length('topic')} > 22 THEN topic ELSE t END AS w FROM {prefix}2),
{prefix}4 AS (SELECT *, regexp_extract(w, '\A([^，,]*)[，,]', 1) AS clause, regexp_extract(w, {quoted(core)}, 1) AS g1, {trim("regexp_extract(w, " + quoted(core) + ", 2)")} AS g2, regexp_extract_all(w, {quoted(term)}) AS ts FROM {prefix}3),
{prefix}5 AS (SELECT *, coalesce(list_filter(ts, lambda x: length(x) = list_max(list_transform(ts, lambda y: length(y))))[1], '') AS term FROM {prefix}4),
{prefix}6 AS (SELECT *, instr(w, term) - 1 AS term_at FROM {prefix}5),
{prefix}7 AS (SELECT *, coalesce({within('topic', 4, 22)}, CASE WHEN {length('clause')} BETWEEN 6 AND 22 THEN {trim('clause')} END, CASE WHEN g2 <> '' THEN coalesce({within(both, 4, 22)}, {within('g2', 4, 20)}) END,
  CASE WHEN term <> '' THEN coalesce({within('term', 4, 20)}, CASE WHEN term_at > 2 THEN {within(joined, 4, 20)} END) END, {cut_title('w')}) AS short FROM {prefix}6),
{prefix}c AS (SELECT *, CASE WHEN {raw} IS NULL THEN NULL WHEN {length('t')} < 2 THEN '' WHEN {length('t')} <= 20 THEN t WHEN {good_title(trim('short'))} THEN short ELSE '' END AS clean FROM {prefix}7)"""


def drawn_titles(source: str, content: str, prefix: str) -> str:
    """CTEs that end in ``{prefix}d``: key columns with ``drawn``."""
    start = "regexp_extract(line, '\\A[^。！？；]{1,30}[。！？；]?')"
    sentence = trim(rf"regexp_replace({start}, '(?:[。，！？；：]|{WS})+\z', '')")
    line = trim(f"regexp_extract(coalesce({content}, ''), '\\A([^\\n]*)', 1)")
    return rf"""
{prefix}l AS (SELECT *, {line} AS line FROM {source}), {clean_titles(prefix + 'l', 'line', prefix)},
{prefix}s AS (SELECT *, CASE WHEN {start} <> '' THEN {sentence} ELSE line END AS said FROM {prefix}c),
{prefix}d AS (SELECT *, CASE WHEN clean <> '' THEN clean WHEN {length(cut_title('said'))} >= 2 THEN {cut_title('said')} ELSE '' END AS drawn FROM {prefix}s)"""


def tag_candidates(title: str, content: str) -> str:
    c, t = f"coalesce({content}, '')", trim(f"coalesce({title}, '')")
    core = trim(f"regexp_replace({t}, '(?:的研究|的发现|的分析|的影响|的问题|的方法|的策略|的机制|的效果|的报告|的调查)$', '')")
    bold = rf"list_filter(list_transform(regexp_extract_all({c}, '\*\*(.+?)\*\*', 1), lambda w: {trim('w')}), lambda w: length(w) BETWEEN 2 AND 15)"
    bracket = rf"regexp_extract_all({c}, '[（(]([a-zA-Z{HAN}]{{2,15}})[）)]', 1)"
    said = f"""list_transform(regexp_extract_all({c}, '"[^"]{{2,10}}"|「[^」]{{2,10}}」|『[^』]{{2,10}}』|《[^》]{{2,10}}》'), lambda w: regexp_replace(w, '["「」『』《》]', '', 'g'))"""
    head = f"CASE WHEN {good_title(t)} AND {length(core)} BETWEEN 2 AND 20 THEN [{core}] ELSE [] END"
    subject = trim(f"regexp_extract(regexp_extract({c}, '\\A[^\\n。！？]*'), '^(.{{2,12}})(?:是|指|通过|利用|基于|采用|包括|涉及|表现为|被称为)', 1)")
    first = distinct_in_order(f"({bold} || {bracket} || {said} || {head})")
    return f"(CASE WHEN len({first}) < 2 THEN {distinct_in_order(f'({first} || CASE WHEN {subject} <> {quoted("")} THEN [{subject}] ELSE [] END)')} ELSE {first} END)[1:6]"


def distinct_in_order(values: str) -> str:
    return f"list_filter({values}, lambda x, i: list_position({values}, x) = i)"


def last_start(text: str, mark: str, size: int, end: str) -> str:
    """0-based place of the last occurrence of a mark that begins at ``end`` or before; -1 without one."""
    piece = f"substr({text}, 1, {end} + {size})"
    found = f"strpos(reverse({piece}), reverse({mark}))"
    return f"(CASE WHEN {found} = 0 THEN -1 ELSE length({piece}) - {found} - {size} + 1 END)"


def chunks(table: str, key: str, text: str, size: int, overlap: int) -> str:
    end = f"off + {size}"
    para = last_start("u", "chr(10) || chr(10)", 2, end)
    stop = f"greatest({last_start('u', quoted('。'), 1, end)}, {last_start('u', quoted('. '), 2, end)})"
    cut = f"CASE WHEN {end} >= n THEN n WHEN {para} > off + {size / 2} THEN {para} WHEN {stop} > off + {size / 2} THEN {stop} + 1 ELSE {end} END"
    return rf"""WITH RECURSIVE u0 AS (SELECT {key}, {FILLED.format(text)} AS u FROM {table} WHERE {text} <> ''), u1 AS (SELECT {key}, u, length(u) AS n, 0::BIGINT AS off, 0 AS pos FROM u0),
w AS (SELECT *, ({cut})::BIGINT AS cut FROM u1 UNION ALL SELECT *, ({cut})::BIGINT AS cut FROM (SELECT {key}, u, n, (CASE WHEN cut - {overlap} <= off THEN cut ELSE cut - {overlap} END)::BIGINT AS off, pos + 1 AS pos FROM w WHERE cut < n))
SELECT {key}, (row_number() OVER (PARTITION BY {key} ORDER BY pos) - 1)::INT AS pos, replace(piece, chr(64976), '') AS chunk FROM (SELECT {key}, pos, substr(u, off + 1, cut - off) AS piece FROM w) WHERE piece <> chr(64976)"""


def units(text: str) -> str:
    return rf"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) > 65535 THEN [55296 + ((unicode(c) - 65536) >> 10), 56320 + ((unicode(c) - 65536) & 1023)] ELSE [unicode(c)] END))"


def fnv64(text: str) -> str:
    return f"list_reduce(list_transform({units(text)}, lambda c: c::UHUGEINT), lambda h, x: (xor(h, x) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, 14695981039346656037::UHUGEINT)"


def fnv32(text: str) -> str:
    signed = "(CASE WHEN xor(h, x) >= 2147483648 THEN xor(h, x) - 4294967296 ELSE xor(h, x) END)::DOUBLE * 16777619.0"
    step = f"({signed} - floor({signed} / 4294967296.0) * 4294967296.0)::BIGINT"
    return f"CASE WHEN {text} = '' THEN '811c9dc5' ELSE format('{{:08x}}', list_reduce(list_transform({units(text)}, lambda c: c::BIGINT), lambda h, x: {step}, 2166136261::BIGINT)) END"


def context_sentence(text: str, at: str, size: str) -> str:
    before = rf"regexp_extract(substr({text}, 1, {at} - 1), '([^。！？\n.!?]*)\z', 1)"
    after = rf"regexp_extract(substr({text}, {at} + {size}), '\A([^。！？\n.!?]*[。！？\n.!?]?)', 1)"
    whole = trim(f"{before} || substr({text}, {at}, {size}) || {after}")
    return f"CASE WHEN length({whole}) > 200 THEN substr({whole}, 1, 200) || '...' ELSE {whole} END"


def located(source: str, text: str) -> str:
    """CTEs that end in ``lo``: rows with anchor and type against a text, with status, source_text and diff_note."""
    near = f"list_filter(regexp_extract_all({text}, '\\d+(?:\\.\\d+)?'), lambda x: x::DOUBLE = value OR (CASE WHEN value <> 0 THEN abs(x::DOUBLE - value) / abs(value) ELSE abs(x::DOUBLE) END) BETWEEN 1e-300 AND 0.05 - 1e-15)[1]"
    return rf"""
l0 AS (SELECT *, instr({text}, anchor) AS exact, try_cast(regexp_extract(anchor, '(\d+(?:\.\d+)?)', 1) AS DOUBLE) AS value FROM {source}),
l1 AS (SELECT *, CASE WHEN type = 'numeric' AND exact = 0 AND value IS NOT NULL THEN {near} END AS near, CASE WHEN type <> 'numeric' AND exact = 0 THEN substr(anchor, 1, greatest(2, ceil(length(anchor) * 0.6))::BIGINT) END AS part FROM l0),
l2 AS (SELECT *, CASE WHEN exact > 0 THEN anchor WHEN near IS NOT NULL THEN near WHEN instr({text}, part) > 0 THEN part END AS match FROM l1),
lo AS (SELECT *, CASE WHEN match IS NULL THEN NULL WHEN exact > 0 OR near IS NOT NULL THEN '已溯源' ELSE '需对比' END AS status,
  CASE WHEN match IS NOT NULL THEN {context_sentence(text, f'instr({text}, match)', 'length(match)')} END AS source_text,
  CASE WHEN near IS NOT NULL AND near::DOUBLE <> value THEN 'source: ' || near || ', note: ' || anchor WHEN match IS NOT NULL AND exact = 0 AND near IS NULL THEN 'found in part: ' || part END AS diff_note FROM l2)"""


def yaml(value: str) -> str:
    bare = rf"""regexp_matches({value}, '[:#\[\]{{}},&*?|<>=!%@`"''\\\n]|^\s|\s$|^-')"""
    return rf"""CASE WHEN {bare} THEN '"' || replace(replace(replace({value}, '\', '\\'), '"', '\"'), chr(10), '\n') || '"' ELSE {value} END"""


def edit_similarities(pairs: str, a: str, b: str) -> str:
    """CTEs that end in ``es``: the pairs with ``similarity`` by characters. DuckDB's distance counts bytes, so the characters of the two
    texts are numbered and stand as single bytes."""
    coded = lambda x: f"array_to_string(list_transform(string_split({x}, ''), lambda c: chr((33 + list_position(letters, c))::INT)), '')"
    return f"""
es0 AS MATERIALIZED (SELECT *, list_distinct(string_split({a} || {b}, '')) AS letters FROM {pairs}),
es1 AS MATERIALIZED (SELECT *, {coded(a)} AS coded_a, {coded(b)} AS coded_b FROM es0),
es AS (SELECT *, 1 - levenshtein(coded_a, coded_b) / greatest(length({a}), length({b})) AS similarity FROM es1)"""
