"""The queries that SQL can say, in DuckDB SQL over the same tables."""

from __future__ import annotations

from claimlake.llm.quality import PRIOR_ROWS, RULES, SPREADS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"
BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
CONTROL = r"<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>"


def quality_sql() -> str:
    """Quality rules: counts, sketches, fences and verdicts."""
    as_sql = lambda e: e.replace(" div ", " // ")
    ratios = " UNION ALL ".join(f"SELECT doc_id, lang, source, '{n}' AS rule, CAST({as_sql(e)} AS BIGINT) AS v FROM c WHERE NOT base_failed" for n, (e, _, _) in RULES.items())
    limits = ", ".join(f"('{n}', {gap}, {str(two).lower()})" for n, (_, gap, two) in RULES.items())

    mean = lambda n, x, y: f"(({n}) * ({x}) + {PRIOR_ROWS} * ({y})) // (({n}) + {PRIOR_ROWS})"

    def fences(by: str) -> str:
        group = f"{by}, rule" if by else "rule"
        return f"""SELECT {group}, any_value(total) AS n, min(bucket) FILTER (WHERE upto * 4 >= total) AS q1, min(bucket) FILTER (WHERE upto * 4 >= total * 3) AS q3 FROM (
            SELECT {group}, bucket, sum(sum(1)) OVER (PARTITION BY {group}) AS total, sum(sum(1)) OVER (PARTITION BY {group} ORDER BY bucket) AS upto
            FROM b GROUP BY {group}, bucket) GROUP BY {group}"""

    return f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{WORD}') AS words FROM d),
win AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM
  (SELECT win.doc_id, i, unnest([0, 1, 2]) AS k FROM win JOIN (SELECT doc_id, g FROM win GROUP BY ALL HAVING count(*) > 1) USING (doc_id, g)) GROUP BY doc_id),
li AS (SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '{WORD}') GROUP BY doc_id),
c AS (SELECT doc_id, lang, source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(li.n, 0) AS n_lines, coalesce(li.dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    len(words) < 50 OR 100 * coalesce(rep.n, 0) > 50 * len(words) AS base_failed
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN li USING (doc_id)),
r AS ({ratios}),
b AS (SELECT *, v - v % (1::BIGINT << greatest(length(bin(v)) - 5, 0) * (v >= 64)::INT) AS bucket FROM r),
limits(rule, gap, two) AS (VALUES {limits}),
own AS ({fences("lang, source")}), by_lang AS ({fences("lang")}), whole AS ({fences("")}),
e AS (SELECT own.lang, own.source, rule, two, own.n, by_lang.n AS n_lang,
    own.q3 + greatest({SPREADS} * (own.q3 - own.q1), gap) AS high, own.q1 - greatest({SPREADS} * (own.q3 - own.q1), gap) AS low,
    by_lang.q3 + greatest({SPREADS} * (by_lang.q3 - by_lang.q1), gap) AS high_lang, by_lang.q1 - greatest({SPREADS} * (by_lang.q3 - by_lang.q1), gap) AS low_lang,
    whole.q3 + greatest({SPREADS} * (whole.q3 - whole.q1), gap) AS high_all, whole.q1 - greatest({SPREADS} * (whole.q3 - whole.q1), gap) AS low_all
  FROM own JOIN by_lang USING (lang, rule) JOIN whole USING (rule) JOIN limits USING (rule)),
f AS (SELECT lang, source, rule, two,
    greatest(high, {mean("n", "high", mean("n_lang", "high_lang", "high_all"))}) AS high, least(low, {mean("n", "low", mean("n_lang", "low_lang", "low_all"))}) AS low FROM e),
bad AS (SELECT doc_id, string_agg(rule, ',' ORDER BY {"CASE rule " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(RULES)) + " END"}) AS rules
  FROM r JOIN f USING (lang, source, rule)
  WHERE v > high OR (two AND v < low) GROUP BY doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND rules IS NULL AS kept, coalesce(rules, '') AS failed_rules
FROM c LEFT JOIN bad USING (doc_id)
"""


LINE_SQL = f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, {BLANK}), '{UPPER}', '{LOWER}') AS key FROM l),
g AS (SELECT key, max(doc_id) AS last, count(DISTINCT doc_id) AS n FROM k WHERE length(key) >= 20 GROUP BY key),
j AS (SELECT k.*, coalesce(g.n >= 3 AND k.doc_id <> g.last, false) AS gone FROM k LEFT JOIN g USING (key))
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""

TOKEN_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, lang, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) > 1 AS copy FROM documents
), t AS (
  SELECT source, lang, 'words-1' AS tokenizer, len(regexp_extract_all(regexp_replace(text, '[#*$%&|<>!]+', '', 'g'), '{WORD}')) AS n FROM d WHERE NOT copy
  UNION ALL
  SELECT source, lang, 'pieces-1', len(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+|[^\x20\x09-\x0D\p{{L}}\p{{N}}]')) FROM d WHERE NOT copy
)
SELECT source, lang, tokenizer, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM t GROUP BY ALL
"""


def url_sql(rules: list[tuple[str, str, str]]) -> str:
    values = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in rules)
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return f"""
WITH rules(r_host, r_path, action) AS (VALUES {values}),
p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{parts}', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '{parts}', 2), '') AS path FROM pages),
j AS (SELECT p.*, r.*, row_number() OVER (PARTITION BY page_id ORDER BY length(r_host) + length(r_path) DESC NULLS LAST, length(r_host) DESC) AS nth
  FROM p LEFT JOIN rules r ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, r_host || r_path AS rule, coalesce(action, 'allow') AS verdict FROM j WHERE nth = 1
"""


CHAT_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), u AS (SELECT *, length(text) + len(regexp_extract_all(text, '{CONTROL}')) + CASE WHEN role = 'assistant' THEN 10 ELSE 17 + length(role) END AS size FROM t)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(size) AS BIGINT) AS formatted_chars
FROM u GROUP BY conv_id
"""


PHRASE_SQL = rf"""
WITH pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM
  (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
places AS (SELECT lang, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(words) >= m),
f AS (SELECT lang, words[i:i + m - 1] AS p, m, count(*) AS f FROM places GROUP BY ALL),
total AS (SELECT lang, sum(len(words)) AS n FROM w GROUP BY lang),
c AS (SELECT * FROM f WHERE m >= 2 AND f >= 30),
cuts AS (SELECT lang, p, m, f, unnest(range(1, m)) AS k FROM c),
scored AS (SELECT cuts.lang, cuts.p, cuts.f AS a, k, l.f AS l, r.f AS r, CAST((2000000::HUGEINT * cuts.f) // (l.f::HUGEINT + r.f) AS BIGINT) AS score
  FROM cuts JOIN f AS l ON l.lang = cuts.lang AND l.p = cuts.p[1:k] JOIN f AS r ON r.lang = cuts.lang AND r.p = cuts.p[k + 1:cuts.m]),
worst AS (SELECT lang, p, a, min(struct_pack(score := score, k := k, l := l, r := r)) AS cut FROM scored GROUP BY lang, p, a),
inner_of AS (SELECT lang, p[i:i + s - 1] AS p, max(f) AS longest FROM
  (SELECT lang, p, m, f, s, unnest(range(1, m - s + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS s) WHERE s < m) GROUP BY ALL),
kept AS (SELECT worst.*, array_to_string(worst.p, ' ') AS phrase FROM worst LEFT JOIN inner_of USING (lang, p) WHERE longest IS NULL OR 100 * longest < 80 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY cut.score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(cut.l AS BIGINT) AS l, CAST(cut.r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, cut.score AS score
FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
