"""The results of the operators that SQL can express, as DuckDB statements made from the same rule tables."""

from __future__ import annotations

from tidelog.llm import licenses, line_rules, secrets


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lines_sql(rules: line_rules.LineRules = line_rules.LineRules()) -> str:
    """op4."""
    has = lambda pattern, x="x": f"regexp_matches({x}, {quoted(pattern)})"
    count = lambda pattern: f"len(regexp_extract_all(x, {quoted(pattern)}))"
    short = has(rf"^\s*\S+(\s+\S+){{0,{rules.short_line_words - 1}}}\s*$")
    dense = f"{count(line_rules.LINE_SYMBOLS)} * 100 >= length(x) * {rules.symbol_percent} OR {count('[!?]')} * 100 >= length(x) * {rules.shout_percent}"
    fails = f"(({short} AND NOT {has(line_rules.ENDINGS)}) OR (length(x) >= 20 AND ({dense})) OR {has(line_rules.SEPARATED)} OR {has(line_rules.NAVIGATION)} OR {has(line_rules.BOILERPLATE)})"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rn, doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
g AS (SELECT rn, i, array_to_string(w[i:i + 4], ' ') AS g FROM w, unnest(range(1, len(w) - 3)) AS u(i)),
p AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, g) AS c FROM g) WHERE c > 1),
r AS (SELECT rn, sum(least(5, coalesce(i - b, 5))) AS n FROM (SELECT rn, i, lag(i) OVER (PARTITION BY rn ORDER BY i) AS b FROM p) GROUP BY rn),
k AS (SELECT *, list_filter(l, lambda x: NOT {fails}) AS k FROM w),
q AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines, len(l) - len(k) AS n_failed_lines,
  length(array_to_string(l, '')) AS whole, length(array_to_string(k, '')) AS part FROM k LEFT JOIN r USING (rn)),
f AS (SELECT *, n_words < {rules.min_words} OR n_repeat_words * 100 > n_words * {rules.max_repeat_percent} AS base_failed FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (whole - part) * 100 <= whole * {rules.max_loss_percent} AS kept, n_lines, n_failed_lines FROM f"""


def licenses_sql() -> str:
    """op7."""
    known = " ".join(f"WHEN {quoted(s)} THEN {quoted(k)}" for k, s in licenses.SENTENCES.items())
    hits = ", ".join(f"CASE WHEN regexp_matches(ids, {quoted(licenses.rule_pattern(ids))}) THEN {k + 1} END" for k, (_, _, ids) in enumerate(licenses.RULES))
    names = "[" + ", ".join(quoted(n) for n, _, _ in licenses.RULES) + "]"
    forms = "[" + ", ".join(quoted(f) for _, f, _ in licenses.RULES) + "]"
    return f"""
WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), {quoted(licenses.BREAK)}), lambda x: CASE trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')) {known} END), lambda x: x IS NOT NULL) AS s FROM documents),
i AS (SELECT doc_id, len(s) AS n_sentences, array_to_string(s, ',') AS ids FROM s),
h AS (SELECT *, list_filter([{hits}], lambda x: x IS NOT NULL) AS h FROM i)
SELECT doc_id, n_sentences, ids AS sentence_ids, {names}[h[1]] AS license, {forms}[h[1]] AS form,
  array_to_string(list_transform(list_filter(h, lambda x, j: NOT list_contains(list_transform(h[1:j - 1], lambda y: {names}[y]), {names}[x])), lambda x: {names}[x]), ',') AS licenses FROM h"""


def secrets_sql(rule: secrets.Ownership = secrets.Ownership()) -> str:
    """op1."""

    def kind(k: int) -> str:
        name, pattern, group, least = secrets.PATTERNS[k]
        p = quoted(pattern)
        lengths = lambda list_, upto: f"coalesce(list_sum(list_transform({list_}[1:{upto}], lambda y: length(y))), 0)"
        return f"""SELECT rn, {k} AS k, {lengths('gaps', 'i')} + {lengths('hits', 'i - 1')} AS s, {lengths('gaps', 'i')} + {lengths('hits', 'i')} AS e, vals[i] AS v
  FROM (SELECT rn, regexp_split_to_array(t, {p}) AS gaps, regexp_extract_all(t, {p}, 0) AS hits, regexp_extract_all(t, {p}, {group}) AS vals FROM d WHERE regexp_matches(t, {p})), unnest(range(1, len(hits) + 1)) AS u(i) WHERE length(vals[i]) >= {least}"""

    names = "[" + ", ".join(quoted(x) for x in secrets.KINDS) + "]"
    text = f"{names}[k + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT)"
    counts = ", ".join(f"coalesce(n_{x}, 0) AS n_{x}" for x in secrets.KINDS[:3])
    return f"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner, coalesce(source, '') || '/' || coalesce(lang, '') AS repository FROM documents),
b AS ({' UNION ALL '.join(kind(k) for k in range(3))}),
one AS (SELECT v FROM b JOIN d USING (rn) GROUP BY v HAVING count(DISTINCT owner) <= {rule.max_owners} AND count(DISTINCT (owner, repository)) <= {rule.max_repositories}),
o AS (SELECT DISTINCT rn, 3 AS k, e - length(v) AS s, e, v FROM b SEMI JOIN one USING (v)
  WHERE length(v) >= {rule.min_length} AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND NOT regexp_matches(v, {quoted(secrets.PLACEHOLDER)}) AND len(list_distinct(string_split(v, ''))) >= {rule.min_distinct_chars}),
base AS (SELECT rn, string_agg({text}, ',' ORDER BY s, k, e) AS x, {', '.join(f'count(*) FILTER (k = {k}) AS n_{secrets.KINDS[k]}' for k in range(3))} FROM b GROUP BY rn),
own AS (SELECT rn, count(*) AS n FROM o GROUP BY rn),
everything AS (SELECT rn, string_agg({text}, ',' ORDER BY s, k, e) AS x FROM (SELECT * FROM b UNION ALL SELECT * FROM o) GROUP BY rn)
SELECT doc_id, {counts}, sha256(coalesce(base.x, '')) AS base_sha256, coalesce(everything.x, '') AS spans, coalesce(own.n, 0) AS n_owned
FROM d LEFT JOIN base USING (rn) LEFT JOIN everything USING (rn) LEFT JOIN own USING (rn)"""
