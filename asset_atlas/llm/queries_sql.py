"""DuckDB twins of the corpus queries that SQL can express."""

from __future__ import annotations

from . import lines, mixing, pii, ranking, rules

BLANK_CHARS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def rules_sql() -> str:
    bad = {True: [], False: []}
    for part, table in ((True, rules.BASE), (False, rules.TABLE)):
        for r in table:
            sides = []
            if r.low is not None:
                sides.append(f"{r.measure} < {r.low}")
            if r.high is not None:
                sides.append(f"{r.measure} > {r.high}")
            bad[part].append((r.name, "(" + " OR ".join(sides) + ")"))
    every = bad[True] + bad[False]
    names = " , ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in every)
    return rf"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x FROM documents
), w AS (
  SELECT rid, doc_id, x, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM t
), p AS (
  SELECT rid, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM w
), g AS (
  SELECT rid, i, w AS w1, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM p
  WINDOW o AS (PARTITION BY rid ORDER BY i)
), c AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, w1, w2, w3) AS n FROM g WHERE w3 IS NOT NULL
), r AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM c, (VALUES (0), (1), (2)) AS s(k)
  WHERE n >= 2 GROUP BY rid
), m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    CAST(len(list_filter(ws, lambda v: lower(v) IN ({_quoted(rules.STOP_WORDS)}))) AS BIGINT) AS n_stop_words,
    CAST(len(list_filter(ws, lambda v: regexp_matches(v, '^[^a-z]*[A-Z][^a-z]*[A-Z][^a-z]*$'))) AS BIGINT) AS n_upper_words
  FROM w LEFT JOIN r USING (rid)
), q AS (
  SELECT *, word_chars / greatest(n_words, 1) AS mean_word_chars, n_symbols / greatest(n_words, 1) AS symbol_ratio,
    n_stop_words / greatest(n_words, 1) AS stop_ratio, n_upper_words / greatest(n_words, 1) AS upper_ratio,
    n_repeat_words / greatest(n_words, 1) AS repeat_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  {" OR ".join(c for _, c in bad[True])} AS base_failed,
  NOT ({" OR ".join(c for _, c in every)}) AS kept,
  n_lines, n_stop_words, n_upper_words,
  array_to_string(list_filter([{names}], lambda v: v IS NOT NULL), ',') AS broken
FROM q
"""


def _account(code: str, n: int) -> str:
    """An account of one country, of ``n`` characters in groups of four."""
    left = (n - 4) % 4
    return rf"{code}[0-9]{{2}}(?:\x20?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf"\x20?[A-Z0-9]{{{left}}}" if left else "")


def pii_sql() -> str:
    # the same languages as the Spark patterns, without the devices that keep those linear
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": "|".join(
            [_account(code, n) for n, codes in pii.IBAN_LENGTHS.items() for code in codes.split()]
            + [r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?"]
        ),
    }
    parts = " UNION ALL ".join(
        f"SELECT rid, {i} AS kind, unnest(range(len(m))) AS i, unnest(m) AS match, unnest(p[:len(m)]) AS gap "
        f"FROM (SELECT rid, regexp_extract_all(x, '{patterns[k.name]}') AS m, "
        f"string_split_regex(x, '{patterns[k.name]}') AS p FROM t)"
        for i, k in enumerate(pii.KINDS)
    )
    digits = "regexp_replace(match, '[^0-9]', '', 'g')"
    compact = "replace(match, ' ', '')"
    n_base = sum(k.base for k in pii.KINDS)
    prior = "CASE kind " + " ".join(f"WHEN {i} THEN {k.prior}" for i, k in enumerate(pii.KINDS)) + " END"
    near = "CASE kind " + " ".join(
        f"WHEN {i} THEN regexp_matches(lower(right(gap, {pii.CONTEXT})), '{k.near}')" for i, k in enumerate(pii.KINDS)
    ) + " END"
    names = _quoted(k.name for k in pii.KINDS)
    text = f"([{names}])[kind + 1] || ':' || s || ':' || e"
    counts = ", ".join(
        f"count(*) FILTER (kind = {i}) AS n_{k.name}" for i, k in enumerate(pii.KINDS)
    )
    order = [f"n_{k.name}" for k in pii.KINDS]
    return rf"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x FROM documents
), a AS ({parts}), b AS (
  SELECT rid, kind, match, gap,
    sum(length(gap) + length(match)) OVER (PARTITION BY rid, kind ORDER BY i) AS e FROM a
), c AS (
  SELECT *, e - length(match) AS s, {digits} AS dg, {compact} AS cp FROM b
), d AS (
  SELECT *, CASE kind
    WHEN 0 THEN true
    WHEN 1 THEN len(list_filter(string_split(match, '.'), lambda v: TRY_CAST(v AS HUGEINT) IS NULL OR TRY_CAST(v AS HUGEINT) > 255)) = 0
    WHEN 2 THEN length(dg) BETWEEN 14 AND 19 AND list_sum([
        CASE WHEN j % 2 = 0 THEN CAST(reverse(dg)[j + 1] AS INT)
             WHEN CAST(reverse(dg)[j + 1] AS INT) > 4 THEN CAST(reverse(dg)[j + 1] AS INT) * 2 - 9
             ELSE CAST(reverse(dg)[j + 1] AS INT) * 2 END FOR j IN range(length(dg))]) % 10 = 0
    WHEN 3 THEN length(dg) BETWEEN 10 AND 15
    WHEN 4 THEN length(cp) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, [
        CASE WHEN z BETWEEN '0' AND '9' THEN CAST(z AS INT) ELSE ascii(z) - 55 END
        FOR z IN string_split(cp[5:] || cp[:4], '')]), lambda acc, v: CASE WHEN v < 10 THEN (acc * 10 + v) % 97 ELSE (acc * 100 + v) % 97 END) = 1
    END AS ok, {prior} + CASE WHEN {near} THEN 1 - {prior} ELSE 0 END AS score
  FROM c
), f AS (
  SELECT rid, {counts},
    string_agg({text}, ',' ORDER BY s, kind) FILTER (kind < {n_base}) AS base,
    string_agg({text}, ',' ORDER BY s, kind) AS spans,
    string_agg(printf('%.2f', CAST(score AS DOUBLE)), ',' ORDER BY s, kind) AS scores
  FROM d WHERE ok GROUP BY rid
)
SELECT doc_id, {", ".join(f"coalesce({c}, 0) AS {c}" for c in order[:n_base])},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  {", ".join(f"coalesce({c}, 0) AS {c}" for c in order[n_base:])}, coalesce(scores, '') AS scores
FROM t LEFT JOIN f USING (rid)
"""


def lines_sql() -> str:
    key = f"translate(trim(line, {BLANK_CHARS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM t
), k AS (
  SELECT *, {key} AS key FROM l
), c AS (
  SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= {lines.MIN_CHARS}
  GROUP BY key HAVING count(DISTINCT rid) >= {lines.MIN_DOCS}
), m AS (
  SELECT rid, k.doc_id, i, line, top IS NOT NULL AND k.doc_id < top AS lost FROM k LEFT JOIN c USING (key)
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY rid
"""


def mixing_sql() -> str:
    topic = "CASE " + " ".join(
        f"WHEN regexp_matches(x, '{p}') THEN '{n}'" for n, p in mixing.TOPICS
    ) + " ELSE 'prose' END"
    steps = []
    at = "w0"
    for i in range(mixing.SWEEPS * len(mixing.MARGINS)):
        m = mixing.MARGINS[i % len(mixing.MARGINS)]
        steps.append(
            f"w{i + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, "
            f"w * t_{m}.target / sum(w) OVER (PARTITION BY {m}) AS w FROM {at} JOIN t_{m} USING ({m}))"
        )
        at = f"w{i + 1}"
    goals = ", ".join(
        f"t_{m} AS (SELECT {m}, pow(t, {mixing.TEMPERATURE}) / sum(pow(t, {mixing.TEMPERATURE})) OVER () AS target "
        f"FROM (SELECT {m}, CAST(sum(tokens) AS DOUBLE) AS t FROM cells GROUP BY {m}) WHERE t > 0)"
        for m in mixing.MARGINS
    )
    return rf"""
WITH d AS (
  SELECT doc_id, source AS source0, lang AS lang0, coalesce(source, '') AS source, coalesce(lang, '') AS lang, x,
    {topic} AS topic, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n_words
  FROM (SELECT *, coalesce(text, '') AS x FROM documents)
), cells AS MATERIALIZED (
  SELECT source, lang, topic, sum(n_words) AS tokens FROM d GROUP BY ALL
), {goals}, w0 AS (
  SELECT source, lang, topic, tokens, CAST(tokens AS DOUBLE) AS w FROM cells WHERE tokens > 0
), {", ".join(steps)}, r AS (
  SELECT source, lang, topic,
    round(w * (SELECT CAST(sum(tokens) AS DOUBLE) FROM cells) * {mixing.SHARE} / tokens, 9) AS rate FROM {at}
), z AS (
  SELECT d.*, coalesce(rate, 0.0) AS rate,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0 AS part
  FROM d LEFT JOIN r USING (source, lang, topic)
)
SELECT doc_id, source0 AS source, lang0 AS lang, topic, CAST(n_words AS BIGINT) AS n_words, round(rate, 6) AS rate,
  CAST(floor(rate) + CASE WHEN part < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM z
"""


def ranking_sql() -> str:
    terms = (
        r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
        r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    )
    return rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, {terms} AS t FROM documents WHERE text IS NOT NULL
), total AS (
  SELECT count(*) AS n, coalesce(sum(len(t)), 0)::BIGINT AS l FROM d WHERE len(t) > 0
), q AS MATERIALIZED (
  SELECT i, item_id, term, count(*) AS times
  FROM (SELECT row_number() OVER () AS i, item_id, unnest({terms}) AS term FROM benchmark WHERE text IS NOT NULL)
  GROUP BY ALL
), hit AS MATERIALIZED (
  SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM hit, total GROUP BY term
), m AS (
  SELECT r, doc_id, {ranking.FLAT} + ({ranking.BY_LENGTH} * len(t) * n) // l AS m FROM d, total WHERE len(t) > 0
), s AS (
  SELECT i, item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN w USING (term) JOIN hit USING (term) JOIN m USING (r) GROUP BY ALL
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM s WHERE score > 0)
WHERE rank <= {ranking.BEST}
"""


ORACLES = {
    "op2_pii": pii_sql(),
    "op3_mixing": mixing_sql(),
    "op5_rules": rules_sql(),
    "op6_lines": lines_sql(),
    "op11_ranking": ranking_sql(),
}
