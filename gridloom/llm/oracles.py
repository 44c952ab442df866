"""The queries of this subpackage that SQL can say."""

from __future__ import annotations

#: Lower case of A-Z alone, and the words.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

#: Equal weights: a phase is a round robin by name over the sources that are left; it ends with the first that is used up.
OP2_SQL = """
WITH RECURSIVE d AS (
    SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), chr(0))), doc_id NULLS FIRST) - 1 AS r FROM documents
), s AS (
    SELECT source, row_number() OVER (ORDER BY source IS NOT NULL, source) AS name, (count(*) + 63) // 64 AS n FROM documents GROUP BY source
), state AS (
    SELECT 0 AS phase, source, name, CAST(0 AS BIGINT) AS used, CAST(n AS BIGINT) AS rest, CAST(0 AS BIGINT) AS start FROM s
    UNION ALL
    SELECT phase + 1, source, name, used + took, rest - took, start + span FROM (
        SELECT *, span // m + CASE WHEN pos < span % m THEN 1 ELSE 0 END AS took FROM (
            SELECT *, min((rest - 1) * m + pos) OVER () + 1 AS span FROM (
                SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY name) - 1 AS pos FROM state WHERE rest > 0
            )
        )
    )
), part AS (
    SELECT source, used, start, count(*) OVER (PARTITION BY phase) AS m, row_number() OVER (PARTITION BY phase ORDER BY name) - 1 AS pos,
        coalesce(lead(used) OVER (PARTITION BY source ORDER BY phase), used + rest) AS until
    FROM state WHERE rest > 0
)
SELECT d.doc_id, d.source, d.r // 64 AS block_, part.start + (d.r // 64 - part.used) * part.m + part.pos AS slot_, d.r % 64 AS place_
FROM d JOIN part ON d.source IS NOT DISTINCT FROM part.source AND d.r // 64 >= part.used AND d.r // 64 < part.until
"""

OP3_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), unit AS (
    SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u FROM v
), link AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.vec_id <> b.vec_id AND len(a.u) = len(b.u) AND list_inner_product(a.u, b.u) >= 0.95
), reach AS (
    SELECT a AS x, a AS y FROM link UNION SELECT r.x, l.b FROM reach r JOIN link l ON r.y = l.a
), n AS (SELECT a, count(*) AS k FROM link GROUP BY a), c AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT vec_id, coalesce(k, 0) AS n_links, coalesce(m, vec_id) AS component_id, coalesce(m, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.x = vec_id
"""

OP4_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
g AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS gram FROM w
), n AS (SELECT doc_id, count(*) AS k FROM g GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
near AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 90 * (x.k + y.k - i)),
link AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (SELECT a AS x, a AS y FROM link UNION SELECT r.x, l.b FROM reach r JOIN link l ON r.y = l.a),
c AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.k, 0) AS n_shingles, coalesce(c.m, d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.x = d.doc_id
"""

OP9_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
    SELECT *, 4 + length(replace(replace(role, '%', '%25'), chr(10), '%0A')) + 1
        + length(regexp_replace(text, '(\\*)(###|</turn>)', '\\\1\2', 'g')) + 9 AS size FROM turns
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(size) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

OP11_SQL = r"""
WITH rules(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
rest AS (SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages),
cut_ AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h, rest FROM rest),
u AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM cut_),
fit AS (
    SELECT DISTINCT u.host, u.path, r.host || r.path AS rule, r.verdict FROM (SELECT DISTINCT host, path FROM u) u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
), best AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM fit GROUP BY ALL)
SELECT page_id, u.host, u.path, best.rule, coalesce(best.verdict, 'allow') AS verdict FROM u LEFT JOIN best ON best.host = u.host AND best.path = u.path
"""

OP12_SQL = r"""
WITH doc AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
tok AS (SELECT k, lang, source, unnest(ts) AS term FROM doc),
per AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT k) AS docs FROM tok GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM per GROUP BY ALL HAVING sum(docs) >= 3),
grp AS (SELECT DISTINCT lang, source FROM doc),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
cnt AS (SELECT g.lang, g.source, t.term, coalesce(p.n, 0)::HUGEINT AS n FROM grp g JOIN kept t ON t.lang = g.lang LEFT JOIN per p ON p.lang = g.lang AND p.source = g.source AND p.term = t.term),
tot AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM cnt GROUP BY ALL),
p AS (SELECT c.lang, c.source, c.term, c.n, 1 + (1000000000::HUGEINT * (c.n + 1)) // (t.total + v.v) AS p FROM cnt c JOIN tot t ON t.lang = c.lang AND t.source = c.source JOIN v ON v.lang = c.lang),
q AS (SELECT t.lang, t.term, 1 + (1000000000::HUGEINT * (t.n + 1)) // (v.total::HUGEINT + v.v) AS q FROM kept t JOIN v ON v.lang = t.lang),
pair AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) x
        ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
), term AS (SELECT p.lang, p.source, p.term AS item, ((p.p - q.q) * (p.p - q.q)) // q.q AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q),
told AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM term),
ranked AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM told)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
"""

OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, list_transform(regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+'), lambda x: length(x)) AS sizes FROM d),
n AS (
    SELECT *, len(sizes) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(sizes) + 1) AS x, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(sizes) + 1) AS y,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 50 THEN 'plain'
            WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u
), o AS (SELECT *, CAST(coalesce(list_sum(sizes[1:least(x, y)]), 0) AS BIGINT) AS a, CAST(coalesce(list_sum(sizes[1:greatest(x, y)]), 0) AS BIGINT) AS b FROM n),
c AS (SELECT *, substr(text, 1, a) AS p, substr(text, a + 1, b - a) AS m, substr(text, b + 1) AS s FROM o)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM c
"""
