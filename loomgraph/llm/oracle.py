"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from loomgraph.llm.chat import SQL as CHAT
from loomgraph.llm.repetition import Rules

LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PLAIN = r"[^\x20\x09-\x0D]+"


def windows(words: str, k: str) -> str:
    """Windows of k words of a list, as text; none if it is shorter."""
    return f"list_transform(range(1, len({words}) - {k} + 2), lambda i: array_to_string({words}[i : i + {k} - 1], ' '))"


def contamination() -> str:
    words = lambda t: f"regexp_extract_all({LOW.format(f'coalesce({t}, {chr(39)}{chr(39)})')}, '{ALNUM}')"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words('text')} AS w FROM documents),
i AS (SELECT item_id, {words('text')} AS w FROM benchmark WHERE item_id IS NOT NULL),
k AS (SELECT item_id, w, least(10, len(w)) AS k FROM i WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, k, unnest({windows('w', 'k')}) AS s FROM k),
sizes AS (SELECT DISTINCT k FROM p),
dw AS (SELECT r, k, generate_subscripts(x, 1) AS pl, unnest(x) AS s FROM (SELECT r, k, {windows('w', 'k')} AS x FROM d, sizes)),
m AS (SELECT r, pl, dw.k AS k, item_id FROM dw JOIN p ON dw.k = p.k AND dw.s = p.s),
h AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(pl, pl + k)) AS pos FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM m) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)"""


def repetition() -> str:
    rules = Rules()
    sizes = sorted({*rules.grams, rules.base_gram})
    shares = ", ".join(f"coalesce(g{k}, 0) / greatest(word_chars, 1)::DOUBLE AS gram{k}_share" for k in sorted(rules.grams))
    leads = ", ".join(f"lead(w0, {i}) OVER o AS w{i}" for i in range(1, max(sizes)))
    over = " OR ".join(f"gram{k}_share > {x}::DOUBLE" for k, x in rules.grams.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{PLAIN}') AS w FROM documents),
x AS (SELECT r, generate_subscripts(w, 1) AS pl, length(unnest(w)) AS n FROM d),
y AS (SELECT r, generate_subscripts(w, 1) AS pl, unnest(w) AS w0 FROM d),
v AS (SELECT r, pl, w0, {leads} FROM y WINDOW o AS (PARTITION BY r ORDER BY pl)),
g AS ({" UNION ALL ".join(f"SELECT r, {k} AS k, pl, concat_ws(' ', {', '.join(f'w{i}' for i in range(k))}) AS s FROM v WHERE w{k - 1} IS NOT NULL" for k in sizes)}),
u AS (SELECT r, k, s FROM g GROUP BY ALL HAVING count(*) > 1),
t AS (SELECT r, k, pl FROM g JOIN u USING (r, k, s)),
c AS (SELECT DISTINCT r, k, unnest(range(pl, pl + k)) AS pl FROM t),
s AS (SELECT r, count(*) FILTER (k = {rules.base_gram}) AS n_repeat_words, {", ".join(f"sum(n) FILTER (k = {k}) AS g{k}" for k in sorted(rules.grams))} FROM c JOIN x USING (r, pl) GROUP BY r),
l0 AS (SELECT r, generate_subscripts(z, 1) AS pl, unnest(z) AS line FROM (SELECT r, string_split(text, chr(10)) AS z FROM d)),
l1 AS (SELECT r, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS n, row_number() OVER (PARTITION BY r, line ORDER BY pl) AS k FROM l0 WHERE regexp_matches(line, '{PLAIN}')),
l AS (SELECT r, count(*) AS n_dup_lines, sum(n) AS dup_chars FROM l1 WHERE k > 1 GROUP BY r),
a AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda y: length(y))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, dup_chars, {", ".join(f"g{k}" for k in sorted(rules.grams))} FROM d LEFT JOIN s USING (r) LEFT JOIN l USING (r)),
b AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.base_share} * n_words AS base_failed,
    coalesce(dup_chars, 0) / greatest(word_chars, 1)::DOUBLE AS dup_line_share, {shares} FROM a)
SELECT *, NOT (base_failed OR dup_line_share > {rules.lines}::DOUBLE OR {over}) AS kept FROM b"""


def jaccard() -> str:
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOW.format("coalesce(text, '')")}, '{PLAIN}') AS w FROM documents),
s AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) >= 5 THEN {windows('w', '5')} WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS common FROM s a JOIN s b USING (s) WHERE a.r <> b.r GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.r = p.a JOIN n y ON y.r = p.b WHERE 100 * common >= 90 * (x.n + y.n - common)),
c AS (SELECT a, b FROM e UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a),
m AS (SELECT a AS r, min(doc_id) AS least FROM c JOIN d ON d.r = c.b GROUP BY a),
k AS (SELECT r, md5(string_agg(s, chr(10) ORDER BY s)) AS k FROM s GROUP BY r),
q AS (SELECT k, min(doc_id) AS class_id FROM k JOIN d USING (r) GROUP BY k)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(l, 0) AS n_similar, least(doc_id, coalesce(least, doc_id)) AS component_id, coalesce(class_id, doc_id) AS class_id
FROM d LEFT JOIN n USING (r) LEFT JOIN (SELECT a AS r, count(*) AS l FROM e GROUP BY a) USING (r) LEFT JOIN m USING (r) LEFT JOIN k USING (r) LEFT JOIN q USING (k)"""


def all_sql() -> dict[str, str]:
    return {"op1_decontamination": contamination(), "op2_chat_formatting": CHAT, "op6_jaccard_join": jaccard(), "op10_quality_rules": repetition()}
