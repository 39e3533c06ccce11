"""SQL for the queries of this subpackage that SQL can express, over the whole tables."""

from __future__ import annotations

REACH = "both_ AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link), reach AS (SELECT a AS id, a AS other FROM both_ UNION SELECT r.id, e.b FROM reach r JOIN both_ e ON e.a = r.other), least AS (SELECT id, min(other) AS component FROM reach GROUP BY id)"

USABLE = "embedding IS NOT NULL AND len(embedding) > 0 AND len([c for c in embedding if c IS NULL OR isnan(c) OR isinf(c)]) = 0 AND len([c for c in embedding if c <> 0]) > 0"

OP1 = (
    f"WITH RECURSIVE usable AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL AND {USABLE}), "
    "link AS (SELECT u.vec_id AS a, v.vec_id AS b FROM usable u JOIN usable v ON v.label = u.label AND u.vec_id < v.vec_id AND len(u.x) = len(v.x) WHERE list_inner_product(u.x, v.x) / (sqrt(list_inner_product(u.x, u.x)) * sqrt(list_inner_product(v.x, v.x))) >= 0.98), "
    f"{REACH}, degree AS (SELECT a AS id, count(*) AS n FROM both_ GROUP BY a) "
    "SELECT e.vec_id, coalesce(d.n, 0) AS n_links, coalesce(l.component, e.vec_id) AS component_id, e.vec_id = coalesce(l.component, e.vec_id) AS kept FROM embeddings e LEFT JOIN degree d ON d.id = e.vec_id LEFT JOIN least l ON l.id = e.vec_id"
)

#: A sum of 64 products in eight interleaved parts, which is the order in which arrays are summed.
PART = "list_reduce(p[{k}:64:8], lambda a, b: a + b)"
SUM = "((" + ") + (".join(f"({PART.format(k=k)} + {PART.format(k=k + 1)}) + ({PART.format(k=k + 2)} + {PART.format(k=k + 3)})" for k in (1, 5)) + "))"

OP5 = (
    f"WITH usable AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE {USABLE}), pair_ AS (SELECT q.vec_id AS query_id, v.vec_id, [q.x[i] * v.x[i] for i in range(1, 65)] AS p FROM usable q JOIN usable v ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id), scored AS (SELECT query_id, vec_id, {SUM} AS score FROM pair_), "
    "ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM scored) SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"
)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP6 = (
    rf"WITH RECURSIVE word AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents), "
    "shingle AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 2], ' ') for i in range(1, len(w) - 1)] END) AS s FROM word)), "
    "size_ AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id), common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingle x JOIN shingle y ON y.s = x.s AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id), "
    "link AS (SELECT a, b FROM common JOIN size_ m ON m.doc_id = a JOIN size_ n ON n.doc_id = b WHERE 100 * c >= 85 * (m.n + n.n - c)), "
    f"{REACH} SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(l.component, d.doc_id) AS component_id, d.doc_id = coalesce(l.component, d.doc_id) AS kept FROM documents d LEFT JOIN size_ s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.id = d.doc_id"
)

QUOTE = "[\"'']?"
ASSIGN = rf"(?i:password|passwd|secret|token|api_?key){QUOTE}\x20*[:=]\x20*{QUOTE}([A-Za-z0-9+/_.=-]+)"


def sql_hits(place: int, kind: str, pattern: str, group: int, least: int) -> str:
    return f"SELECT doc_id, {place} AS place, '{kind}' AS kind, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS hits, regexp_extract_all(t, '{pattern}', {group}) AS parts, {least} AS least FROM doc"


BASE_SPANS = (
    f"WITH doc AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), found AS ({sql_hits(0, 'assign', ASSIGN, 1, 8)} UNION ALL {sql_hits(1, 'access', 'AKIA[A-Z0-9]+', 0, 16)} UNION ALL {sql_hits(2, 'hex', '[0-9a-f]+', 0, 32)}), "
    "each AS (SELECT doc_id, place, kind, least, unnest(gaps[1:len(hits)]) AS gap, unnest(hits) AS hit, unnest(parts) AS part, generate_subscripts(hits, 1) AS i FROM found WHERE len(hits) > 0), "
    "placed AS (SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, place ORDER BY i) AS stop FROM each), span AS (SELECT doc_id, place, kind, CAST(stop - length(hit) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM placed WHERE length(part) >= least), "
    "listed AS (SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex FROM span GROUP BY doc_id) "
    "SELECT d.doc_id, coalesce(l.n_assign, 0) AS n_assign, coalesce(l.n_access, 0) AS n_access, coalesce(l.n_hex, 0) AS n_hex, sha256(coalesce(l.spans, '')) AS base_sha256 FROM doc d LEFT JOIN listed l ON l.doc_id = d.doc_id"
)
