"""SQL for embeddings and retrieval."""

from __future__ import annotations

from checks.corpus import corpus_sql, values
from checks.oracle_enrich import RATED, TOLD
from riskloom import dims


RAW = ("list_transform(range(1, 129), lambda i: (instr('0123456789abcdef', substr(hx, 2 * i - 1, 1)) * 16 - 16"
       " + instr('0123456789abcdef', substr(hx, 2 * i, 1)) - 1) / 255.0::DOUBLE)")


def hashed(source: str, keep: str, text: str) -> str:
    """A query giving keep columns and `vec`."""
    return f"""SELECT {keep}, list_transform(raw, lambda v: v / (sqrt(list_inner_product(raw, raw)) + 1e-12)) AS vec FROM (
      SELECT {keep}, {RAW} AS raw FROM (
        SELECT {keep}, h3 || sha256(unhex(h3)) AS hx FROM (SELECT {keep}, h2 || sha256(unhex(h2)) AS h3 FROM (
          SELECT {keep}, h1 || sha256(unhex(h1)) AS h2 FROM (SELECT {keep}, sha256({text}) AS h1 FROM {source})))))"""


PRINT = "array_to_string(list_transform({0}, lambda x: CAST(CAST(round(x * 1000000) AS BIGINT) AS VARCHAR)), ' ')"

QUERY_VECS = """q AS (SELECT label AS query, list(m ORDER BY i) AS qv FROM (
  SELECT label, i, avg(x) AS m FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label),
v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings)"""
COSINE = "list_inner_product(vec, qv) / (sqrt(list_inner_product(vec, vec)) * (sqrt(list_inner_product(qv, qv)) + 1e-12) + 1e-12)"
L2 = "list_inner_product(vec, vec) + list_inner_product(qv, qv) - 2 * list_inner_product(vec, qv)"


def ranked(score: str, order: str, k: int) -> str:
    return f"""WITH {QUERY_VECS}, scored AS (SELECT query, vec_id, label, round({score}, 9) AS score FROM q, v),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score {order}, vec_id) AS rank FROM scored) WHERE rank <= {k})"""


EVAL = ranked(COSINE, "DESC", 10) + """, evaluated AS (
  SELECT query AS label, CASE WHEN min(rank) FILTER (label = query) <= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit,
         coalesce(1.0::DOUBLE / min(rank) FILTER (label = query), 0.0::DOUBLE) AS reciprocal_rank FROM ranked GROUP BY query)"""

KB = "kb AS (SELECT * FROM " + values([(k, s) for k, s, _, _ in dims.KB], "key, summary") + "), kbv AS (" + hashed("kb", "key", "summary") + ")"
KB_COSINE = "list_inner_product(k.vec, t.vec) / (sqrt(list_inner_product(k.vec, k.vec)) * (sqrt(list_inner_product(t.vec, t.vec)) + 1e-12) + 1e-12)"


def kb_ranked(source: str, key: str) -> str:
    return f"""ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, id) AS rank FROM (
  SELECT t.{key}, k.key AS id, round({KB_COSINE}, 9) AS score FROM {source} t, kbv k)) WHERE rank <= 3)"""


ASK = "A scanner flagged the code below. Say what can go wrong, how to repair it, and where to read more."
ANSWER = "Reply in JSON: explanation and fix as texts, references as a list of URLs."

ORACLE = {
    "build_prompts": corpus_sql(TOLD.replace(", kb AS", ", kb_full AS", 1).replace("LEFT JOIN kb k", "LEFT JOIN kb_full k", 1) + f", {KB}, tv AS ({hashed('types', 'type', 'type')}), {kb_ranked('tv', 'type')}"
        f""", near AS (SELECT r.type, string_agg(kb.summary, chr(10) ORDER BY rank) AS texts FROM ranked r JOIN kb ON r.id = kb.key GROUP BY r.type)
        SELECT path, seq, '{ASK}' || chr(10) || 'finding: ' || t.type || ' at line ' || coalesce(CAST(line AS VARCHAR), 'unknown')
        || chr(10) || 'code: ' || snippet || chr(10) || 'scanner''s note: check' || chr(10) || 'background:' || chr(10)
        || concat_ws(chr(10), kb_summary, texts) || chr(10) || '{ANSWER}' AS prompt FROM told t JOIN near n ON t.type = n.type"""),
    "hash_embed": f"SELECT doc_id, {PRINT.format('vec')} AS vec FROM ({hashed('documents', 'doc_id', 'text')})",
    "knn_cosine": ranked(COSINE, "DESC", 3) + " SELECT query AS label, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM ranked",
    "knn_l2": ranked(L2, "ASC", 3) + " SELECT query AS label, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 6) AS score FROM ranked",
    "knn_many": f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vec FROM embeddings),
        q AS (SELECT vec_id AS query_id, vec AS qv FROM v WHERE vec_id % 20 = 0), scored AS (SELECT query_id, vec_id, round(greatest({L2}, 0), 9) AS score FROM q, v)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 6) AS score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM scored) WHERE rank <= 5""",
    "retrieval_eval": EVAL + " SELECT label, hit, round(reciprocal_rank, 9) AS reciprocal_rank FROM evaluated",
    "retrieval_means": EVAL + " SELECT round(avg(hit), 9) AS hit_at_k, round(avg(reciprocal_rank), 9) AS mrr, count(*) AS queries FROM evaluated",
    "kb_with_neighbours": corpus_sql(RATED + f", {KB}, types AS (SELECT DISTINCT type FROM rated), tv AS ({hashed('types', 'type', 'type')}), {kb_ranked('tv', 'type')}"
        """, best AS (SELECT type, string_agg(id, '; ' ORDER BY rank) AS neighbours, round(max(score), 6) AS best FROM ranked GROUP BY type)
        SELECT path, seq, r.type, neighbours, best FROM rated r JOIN best b ON r.type = b.type"""),
    "kb_search": f"WITH {KB}, dv AS ({hashed('documents', 'doc_id', 'text')}), {kb_ranked('dv', 'doc_id')}"
        " SELECT doc_id, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM ranked",
    "embed_batch": "SELECT doc_id, length(text) || ' ' || (length(text) - length(replace(text, ' ', ''))) || ' ' || (length(text) - length(replace(text, 'e', ''))) AS vec, 'service' AS origin FROM documents",
    "vectors_append": f"""WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS id, text FROM documents UNION ALL SELECT 'b' || item_id, text FROM benchmark)
        SELECT id, CAST(round(vec[1] * 1000000) AS BIGINT) AS first FROM ({hashed('t', 'id', 'text')})""",
    "vectors_roundtrip": f"SELECT vec_id AS id, CAST(label AS VARCHAR) AS text, {PRINT.format('list_transform(embedding, lambda e: CAST(e AS DOUBLE))')} AS vec FROM embeddings",
}
