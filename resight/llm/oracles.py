"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

import math

from . import licenses

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all({}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"


def _low(c: str) -> str:
    return f"translate(coalesce({c}, ''), '{_UPPER}', '{_LOWER}')"


OP3 = f"""WITH b AS (SELECT item_id, {_WORDS.format(_low("text"))} AS w FROM benchmark), d AS (SELECT doc_id, {_WORDS.format(_low("text"))} AS w FROM documents),
 bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + 12], ' ') AS g FROM b, unnest(range(1, greatest(len(w) - 12, 1) + 1)) t(i) WHERE len(w) > 0),
 lens AS (SELECT DISTINCT n FROM bw),
 dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM d, lens, unnest(range(1, len(w) - n + 2)) t(i)),
 hits AS (SELECT DISTINCT doc_id, item_id, i, n FROM dw JOIN bw USING (n, g)),
 hw AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hits, unnest(range(n)) u(k) GROUP BY doc_id),
 it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)"""

_TEMPLATES = ", ".join(f"('{label}', [{', '.join(repr(w) for w in sorted(set(licenses.words_of(t))))}], {max(1, math.ceil(0.8 * len(set(licenses.words_of(t))) - 1e-9))})" for label, t in licenses.TEMPLATES)
_PHRASES = ", ".join(f"('{label}', [{', '.join(repr(w) for w in p.split())}])" for p, label in licenses.PHRASES.items())
OP5 = f"""WITH d AS (SELECT doc_id, {_low("text")} AS t FROM documents), w AS (SELECT doc_id, t, {_WORDS.format("t")} AS w FROM d),
 phrases(label, p) AS (VALUES {_PHRASES}), templates(label, own, need) AS (VALUES {_TEMPLATES}),
 places AS (SELECT doc_id, label, i - 1 AS i FROM w, phrases, unnest(range(1, len(w) - len(p) + 2)) u(i) WHERE w[i:i + len(p) - 1] = p),
 blocks AS (SELECT doc_id, unnest(string_split(regexp_replace(t, '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), chr(10))) AS b FROM d),
 words AS (SELECT doc_id, list_distinct({_WORDS.format("b")}) AS bw FROM blocks),
 met AS (SELECT doc_id, label, max(len(list_intersect(bw, own)) / len(own)) AS share FROM words, templates WHERE len(list_intersect(bw, own)) >= need GROUP BY doc_id, label),
 base AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id),
 labels AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM places UNION ALL SELECT doc_id, label FROM met) GROUP BY doc_id),
 shares AS (SELECT doc_id, max(share) AS share FROM met GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN labels USING (doc_id) LEFT JOIN shares USING (doc_id)"""

OP7 = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT h, max(page_id) AS first FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN n >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND page_id <> first THEN first END AS refers_to FROM p LEFT JOIN f USING (h)"""

OP9 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
 s AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 200)) AS g FROM d, unnest(range(n - 99)) t(i)),
 again AS (SELECT doc_id, i, true AS hit FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM s) WHERE r > 1),
 bytes AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS b FROM d, unnest(range(n)) t(i)),
 gone AS (SELECT doc_id, i, b, coalesce(bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), false) AS gone FROM bytes LEFT JOIN again USING (doc_id, i)),
 runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM gone),
 sums AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, coalesce(string_agg(b, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM runs GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN sums USING (doc_id)"""

OP11 = f"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_low("text")}, '[a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w FROM documents),
 t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
 kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 3), v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
 g AS (SELECT DISTINCT lang, source FROM d), c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term),
 shares AS (SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (sum(coalesce(n, 0)) OVER (PARTITION BY lang, source) + v)::HUGEINT AS p FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)),
 sums AS (SELECT lang, term, sum(n) AS n FROM shares GROUP BY lang, term), whole AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)::HUGEINT) // (sum(n) OVER (PARTITION BY lang) + v)::HUGEINT AS q FROM sums JOIN v USING (lang)),
 far AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
 terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200"""

ORACLES: dict[str, str] = {"op3_decontaminate": OP3, "op5_licenses": OP5, "op7_warc": OP7, "op9_remove_repeats": OP9, "op11_source_divergence": OP11}
