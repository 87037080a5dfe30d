"""SQL twins of the operators' queries, for DuckDB on the same tables.

None for SimHash (no XXH64), the entropy method, trained models and tokenizers; tests hold
those against plain versions.
"""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(text: str) -> str:
    return f"translate({text}, '{_UPPER}', '{_LOWER}')"


_WARC = """
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < owner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < owner THEN owner END AS refers_to
FROM (
    SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
           sha1(coalesce(html, '')) AS payload_digest,
           max(page_id) OVER (PARTITION BY coalesce(html, '')) AS owner
    FROM pages
)
"""

_TOPK = """
WITH usable AS (
    SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
    FROM usable AS q JOIN usable AS c ON q.row <> c.row
    WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id, score
FROM scored
WINDOW best AS (PARTITION BY row ORDER BY score DESC, vec_id)
QUALIFY rank <= 20
"""

_CHAT = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL
    SELECT -1, n, CASE n WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok'
    FROM range(2) AS r(n)
),
sized AS (
    SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|'))
              + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n'))
              + length('<|im_start|>') + 1 + length('<|im_end|>') + 1 AS chars
    FROM turns
),
chats AS (
    SELECT conv_id, count(*) AS n_turns, sum(chars) AS formatted_chars,
           string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
           coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
           string_agg(role, ',' ORDER BY turn, role, text) AS roles
    FROM sized GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars,
       regexp_full_match(roles, '(system,)?user,assistant(,user,assistant)*') AS valid
FROM chats
"""

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_DECONTAMINATION = f"""
WITH docs AS (
    SELECT doc_id, coalesce(regexp_extract_all({_lowered("text")}, '{_WORDS}'), []) AS words FROM documents
),
items AS (
    SELECT item_id, regexp_extract_all({_lowered("text")}, '{_WORDS}') AS words FROM benchmark
),
item_windows AS (
    SELECT DISTINCT item_id, least(len(words), 10) AS n,
           array_to_string(list_slice(words, i, i + least(len(words), 10) - 1), ' ') AS window_text
    FROM (SELECT *, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM items WHERE len(words) > 0)
),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
    SELECT doc_id, i, n, array_to_string(list_slice(words, i, i + n - 1), ' ') AS window_text
    FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i
          FROM docs, sizes WHERE len(words) >= n)
),
hits AS (
    SELECT doc_id, item_id, i, n FROM doc_windows JOIN item_windows USING (n, window_text)
),
hit_words AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY doc_id
),
hit_items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

_URLS = f"""
WITH parts AS (
    SELECT page_id, url, length(coalesce(html, '')) < 1000 AS thin,
           coalesce({_lowered("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host,
           coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
),
known AS (SELECT *, max(thin) OVER (PARTITION BY coalesce(url, '')) AS listed FROM parts),
ruled AS (
    SELECT *, CASE
        WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
        WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
        WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
        WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/'
    END AS rule
    FROM known
)
SELECT page_id, host, path, rule, listed,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN listed THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

_SUFFIXES = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (
    SELECT r, p, md5_number(substr(h, 2 * p + 1, 400)) AS s
    FROM (SELECT r, h, unnest(range(length(h) // 2 - 199)) AS p FROM docs WHERE length(h) >= 400)
),
again AS (SELECT r, p FROM starts WHERE s IN (SELECT s FROM starts GROUP BY s HAVING count(*) > 1)),
marked AS (
    SELECT r, p, coalesce(p - lag(p) OVER w > 200, true) AS fresh FROM again WINDOW w AS (PARTITION BY r ORDER BY p)
),
numbered AS (SELECT r, p, sum(CAST(fresh AS INT)) OVER (PARTITION BY r ORDER BY p) AS k FROM marked),
spans AS (SELECT r, k, min(p) AS a, max(p) + 200 AS b FROM numbered GROUP BY r, k),
edged AS (SELECT r, k, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY k) AS before FROM spans),
cut AS (
    SELECT r, sum(b - a) AS removed, count(*) AS n, max(b) AS tail,
           string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY k) AS kept
    FROM edged JOIN docs USING (r) GROUP BY r
)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
       coalesce(n, 0) AS n_spans, sha256(unhex(coalesce(kept || substr(h, 2 * tail + 1), h))) AS kept_sha256
FROM docs LEFT JOIN cut USING (r)
"""

_SPELLING = r"""
WITH crc_table AS (
    SELECT list(c ORDER BY i) AS t
    FROM (SELECT i, list_reduce(list_concat([i], range(8)),
                 lambda c, ignored: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
          FROM range(256) AS r(i))
),
runs AS (
    SELECT doc_id, run, count(*) AS times
    FROM (SELECT doc_id, unnest(regexp_extract_all({lowered}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents)
    WHERE length(run) >= 7 GROUP BY ALL
),
hashed AS (
    SELECT *, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(
                 string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
                 lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)]
                      ELSE [CAST(192 + (unicode(c) >> 6) AS BIGINT), CAST(128 + (unicode(c) & 63) AS BIGINT)] END))),
                 lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS h
    FROM runs, crc_table
),
words AS (
    SELECT word, CAST(sum(times) AS BIGINT) AS n
    FROM (SELECT times, CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS INTEGER))
                        || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word FROM hashed)
    WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2
),
gaps AS (
    SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest
    FROM (SELECT *, unnest(range(length(word))) AS i FROM words)
),
pairs AS (
    SELECT a.word, a.n, b.word AS other, b.n AS other_n
    FROM gaps AS a JOIN gaps AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    UNION SELECT g.word, g.n, w.word, w.n FROM gaps AS g JOIN words AS w ON g.rest = w.word
    UNION SELECT w.word, w.n, g.word, g.n FROM gaps AS g JOIN words AS w ON g.rest = w.word
),
best AS (
    SELECT word, count(*) AS n_near, arg_min(other, (-other_n, encode(other))) AS other, max(other_n) AS other_n
    FROM pairs GROUP BY word
),
formed AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near,
           CASE WHEN other_n >= 10 * w.n THEN other END AS form, CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
    FROM words AS w LEFT JOIN best USING (word)
),
steps AS (
    WITH RECURSIVE steps AS (
        SELECT word, word AS root, form FROM formed
        UNION ALL
        SELECT s.word, f.word, f.form FROM steps AS s JOIN formed AS f ON s.form = f.word
    )
    SELECT word, root FROM steps WHERE form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN steps USING (word)
""".format(lowered=_lowered("text"))

_NEGATIVES = """
WITH usable AS (
    SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT a.row, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
           CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
    FROM usable AS a JOIN usable AS c ON a.row <> c.row
    WHERE a.vec_id % 100 = 0
),
positives AS (
    SELECT row, anchor_id, vec_id AS positive_id, score AS positive_score,
           row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS place
    FROM scored WHERE same QUALIFY place <= 5
)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.row, place ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives AS p JOIN scored AS s USING (row, anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""

TWINS: dict[str, str] = {
    "op2_warc_archive": _WARC,
    "op3_nra_topk": _TOPK,
    "op7_chat_format": _CHAT,
    "op9_decontamination": _DECONTAMINATION,
    "op10_url_filter": _URLS,
    "op11_suffix_dedup": _SUFFIXES,
    "op12_spelling_variants": _SPELLING,
    "op13_hard_negatives": _NEGATIVES,
}
