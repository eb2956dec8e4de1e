"""DuckDB SQL text for the oracle side, mirroring the column builders.

These helpers only build SQL strings for ``oracle_sql()``; the engine itself
never parses or runs them.
"""
from __future__ import annotations

from .. import fixed
from ..functions.text import SPACE_LISTED as SPACE


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def tokens(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '[{SPACE}]+'), lambda w: w <> '')"


def marks(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[.!?]'))"


def sentences(x: str) -> str:
    return f"string_split(regexp_replace({x}, '([.!?])[{SPACE}]+', '\\1' || chr(1), 'g'), chr(1))"


def length_score(x: str) -> str:
    return f"(least({marks(x)}, {fixed.MAX_SENTENCES}) / {float(fixed.MAX_SENTENCES)})"


def adherence(x: str, t: str) -> str:
    tt = f"list_distinct({tokens(t)})"
    return f"(len(list_intersect({tt}, {tokens(x)})) / greatest(len({tt}), 1))"


def reading(x: str) -> str:
    w = tokens(x)
    syl = f"list_sum(list_transform({w}, lambda u: greatest(1, len(regexp_extract_all(lower(u), '[aeiouy]+')))))"
    return (f"(CASE WHEN len({w}) = 0 THEN 0.0 ELSE {fixed.FLESCH_BASE} - {fixed.FLESCH_WPS} * "
            f"(len({w}) / greatest({marks(x)}, 1)) - {fixed.FLESCH_SPW} * ({syl} / len({w})) END)")


def penalty(x: str) -> str:
    s = f"lower({x})"
    parts = [f"floor((length({s}) - length(replace({s}, {lit(t)}, ''))) / {len(t)})"
             for t in fixed.FORBIDDEN_TERMS]
    return f"(({' + '.join(parts)}) / greatest(len({tokens(x)}), 1))"


def fitness(x: str, t: str, length_sign: int = 1) -> str:
    return (f"({float(length_sign)} * {length_score(x)} + {adherence(x, t)} + "
            f"{reading(x)} - {penalty(x)})")


def det_uniform(*parts: str) -> str:
    key = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"((('0x' || substr(md5({key}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"


def gumbel(*parts: str) -> str:
    return f"(-ln(-ln({det_uniform(*parts)})))"


def validate_bio(x: str) -> str:
    s = strip(x)
    return f"(CASE WHEN {s} IN ('B', 'I', 'O') THEN {s} ELSE 'O' END)"


def validate_section(x: str) -> str:
    s = strip(x)
    n = fixed.SECTION_NAMES
    c = (f"(CASE WHEN {s} = {lit(fixed.SECTION_STRENGTHS_DATA)} THEN {lit(n[0])} "
         f"WHEN {s} = {lit(fixed.SECTION_COMMENTS_PROMPT)} THEN {lit(n[2])} ELSE {s} END)")
    return f"(CASE WHEN {c} IN ({', '.join(lit(v) for v in n)}) THEN {c} ELSE {lit(fixed.SECTION_DEFAULT)} END)"


def sentence_features(s: str) -> str:
    return (f"{{'text': {s}, 'n_words': len({tokens(s)}), 'bang': suffix({s}, '!'), "
            f"'comma': contains({s}, ',')}}")


def rules_bio(prev: str, x: str) -> str:
    n = f"{x}.n_words"
    raw = (f"(CASE WHEN {n} < 3 THEN 'O' WHEN {prev} IN ('', 'O') THEN 'B ' WHEN {n} > 20 THEN 'B' "
           f"WHEN {prev} = 'I' AND {x}.bang THEN 'B' WHEN {x}.comma AND {n} < 5 THEN 'i' ELSE 'I' END)")
    return validate_bio(raw)


def rules_section(prev: str, x: str) -> str:
    n = f"{x}.n_words"
    raw = (f"(CASE WHEN {n} < 4 AND {prev} <> '' THEN {prev} "
           f"WHEN {x}.comma AND {n} > 15 THEN {lit(fixed.SECTION_COMMENTS_PROMPT)} "
           f"WHEN {x}.bang THEN {lit(fixed.SECTION_STRENGTHS_DATA)} "
           f"ELSE {lit(fixed.SECTION_DEFAULT)} END)")
    return validate_section(raw)


def fold(items: str, step) -> str:
    """list_reduce mirror of ``tagging.fold_tags``: list of {tag, seg}."""
    tag = step("acc.prev", "x")
    opener = f"({tag} = 'B' OR ({tag} = 'I' AND acc.prev IN ('', 'O')))"
    seg = f"(acc.seg + CAST({opener} AS INTEGER))"
    merge = (f"lambda acc, x: {{'prev': {tag}, 'seg': {seg}, "
             f"'out': list_append(acc.out, {{'tag': {tag}, 'seg': {seg}}})}}")
    init = "{'prev': '', 'seg': 0, 'out': []::STRUCT(tag VARCHAR, seg INTEGER)[]}"
    return f"(list_reduce({items}, {merge}, {init})).out"


def normalize_label(x: str) -> str:
    s = strip(x)
    s = f"regexp_replace({s}, '^[''\"`]+|[''\"`]+$', '', 'g')"
    s = f"regexp_replace({s}, '^[\\s\\W]*H\\d+\\.\\s*', '')"
    s = f"regexp_replace({s}, '[\\\\/]', '', 'g')"
    s = f"regexp_replace({s}, '[;,]+$', '')"
    return strip(s)


def distinct_ordered(lst: str) -> str:
    return f"list_filter({lst}, lambda v, i: list_position({lst}, v) = i)"


def parse_labels_ctes(src: str, key: str, col: str, seg: str | None = None) -> str:
    """CTE chain producing (key, issues) like ``text.parse_labels`` (+ P6)."""
    p1, p2 = fixed.PROTECTED_PHRASES
    raw = f"coalesce({col}, 'Other')"
    short = f"({seg} IS NULL OR length({strip(seg)}) < {fixed.SHORT_SEGMENT_CHARS})" if seg else "FALSE"
    return f"""
pl0 AS (SELECT {key}, {raw} AS raw, {short} AS short FROM {src}),
pl1 AS (SELECT {key}, short, list_concat(
          list_filter(list_transform(string_split_regex(replace(replace(raw, {lit(p1)}, ''), {lit(p2)}, ''), '[;,]'),
                                     lambda p: {strip('p')}), lambda p: p <> ''),
          list_filter([CASE WHEN contains(raw, {lit(p1)}) THEN {lit(p1)} END,
                       CASE WHEN contains(raw, {lit(p2)}) THEN {lit(p2)} END], lambda p: p IS NOT NULL)) AS pieces
        FROM pl0),
pl2 AS (SELECT {key}, short, list_transform({distinct_ordered('pieces')}, lambda p: {normalize_label('p')}) AS n FROM pl1),
pl3 AS (SELECT {key}, short, list_filter(n, lambda p: p <> '') AS n FROM pl2),
labeled AS (SELECT {key}, CASE WHEN short THEN []::VARCHAR[] ELSE
              list_filter({distinct_ordered('n')}, lambda p: p <> 'Other') END AS issues FROM pl3)"""
