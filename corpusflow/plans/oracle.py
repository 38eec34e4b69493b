"""ANSI/DuckDB SQL oracles for the registered queries (same column names).

Shared pieces are CTE fragments composed in Python; each oracle is one plain
SQL string over the pre-registered views. The chunker fragment is the same
greedy rule as ``operators.chunking`` written as a recursive CTE over word
offsets (one recursion step per output line).
"""

from __future__ import annotations

WIDTH = 500
DIM = 64
# a letter in the wrapper's sense (word character that is not a digit)
_L = r"[\pL\p{Nl}\p{No}_]"
# hyphen between letters; \x01 marks a break already inserted by an earlier pass
_HY = "(" + _L + _L + "|" + _L + r"-\x01?" + _L + ")-(" + _L + r"(?:-\x01?)?" + _L + ")"
_BLANK_FREE = r"[^\s\x{a0}\x{2000}-\x{200a}\x{3000}\x{2028}\x{2029}\x{85}\x{1680}\x{202f}\x{205f}]"


def chunk_ctes(source: str = "documents", key: str = "doc_id", text: str = "text", width: int = WIDTH,
               prefix: str = "") -> str:
    """CTEs ending in ``{prefix}chunks(key, chunk_index, chunk_total, chunk)``; needs WITH RECURSIVE."""
    hy = f"'{_HY}', '\\1-' || chr(1) || '\\2', 'g'"
    p = prefix
    return f"""
{p}norm AS (SELECT {key} AS k, regexp_replace({text}, '[\\t\\n\\x0B\\f\\r]', ' ', 'g') AS t FROM {source}),
{p}marked AS (
  SELECT k, t, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, {hy}), {hy}), {hy}),
                              ' ([^ ])', ' ' || chr(1) || '\\1', 'g') AS m
  FROM {p}norm),
{p}pieces AS (
  SELECT k, t, unnest(string_split(m, chr(1))) AS piece, generate_subscripts(string_split(m, chr(1)), 1) AS i
  FROM {p}marked),
{p}offs AS (
  SELECT k, t, i, (sum(length(piece)) OVER (PARTITION BY k ORDER BY i) - length(piece))::BIGINT AS s,
         length(rtrim(piece, ' '))::BIGINT AS wl
  FROM {p}pieces),
{p}arr AS (
  SELECT k, any_value(t) AS t, list(s ORDER BY i) AS S, list(s + wl ORDER BY i) AS E, count(*) AS n
  FROM {p}offs WHERE wl > 0 GROUP BY k),
{p}rec AS (
  SELECT k, 0 AS ln, 1 AS i, NULL::VARCHAR AS chunk, t, S, E, n FROM {p}arr
  UNION ALL
  SELECT k, ln + 1, j + 1, substr(t, st + 1, E[j] - st), t, S, E, n
  FROM (
    SELECT k, ln, t, S, E, n, i, greatest(jf, i) AS j,
           CASE WHEN jf >= i THEN b ELSE S[i] END AS st
    FROM (SELECT *, len(list_filter(E, lambda x: x <= b + {width})) AS jf
          FROM (SELECT *, CASE WHEN ln = 0 THEN 0 ELSE S[i] END AS b FROM {p}rec WHERE i <= n)))),
{p}kept AS (
  SELECT k, ln, chunk FROM {p}rec WHERE ln > 0 AND regexp_matches(chunk, '{_BLANK_FREE}')),
{p}chunks AS (
  SELECT k AS {key}, (row_number() OVER (PARTITION BY k ORDER BY ln) - 1)::INTEGER AS chunk_index,
         (count(*) OVER (PARTITION BY k))::INTEGER AS chunk_total, chunk
  FROM {p}kept)"""


def embed_ctes(source: str, keys: list[str], text: str, name: str, dim: int = DIM) -> str:
    """CTEs ending in ``{name}(keys..., vec DOUBLE[])``: the hashed bag-of-words vector."""
    kl = ", ".join(keys)
    on = " AND ".join(f"g.{k} = c.{k}" for k in keys)
    return f"""
{name}_w AS (SELECT {kl}, unnest(string_split_regex(lower({text}), '[^\\pL\\pN]+')) AS w FROM {source}),
{name}_b AS (SELECT {kl}, (('0x' || substr(md5(w), 1, 8))::BIGINT % {dim})::INTEGER AS bucket, count(*) AS n
             FROM {name}_w WHERE w <> '' GROUP BY ALL),
{name}_g AS (SELECT {kl}, b AS bucket FROM (SELECT DISTINCT {kl} FROM {source}), range({dim}) r(b)),
{name}_d AS (SELECT g.{keys[0]}{''.join(', g.' + k for k in keys[1:])},
                    list(coalesce(c.n, 0)::DOUBLE ORDER BY g.bucket) AS v
             FROM {name}_g g LEFT JOIN {name}_b c ON {on} AND g.bucket = c.bucket GROUP BY ALL),
{name} AS (SELECT {kl}, CASE WHEN nrm > 0 THEN list_transform(v, lambda x: x / nrm) ELSE v END AS vec
           FROM (SELECT *, sqrt(list_reduce(list_transform(v, lambda x: x * x), lambda a, b: a + b)) AS nrm
                 FROM {name}_d))"""


def sq_l2(a: str, b: str, dim: int = DIM) -> str:
    """Squared L2 summed in index order (bit-identical to the Spark expression)."""
    return (f"list_reduce(list_transform(range(1, {dim} + 1), "
            f"lambda i: ({a}[i]::DOUBLE - {b}[i]::DOUBLE) * ({a}[i]::DOUBLE - {b}[i]::DOUBLE)), lambda x, y: x + y)")


def long_form(name: str, keys: list[str]) -> str:
    kl = ", ".join(keys)
    return f"""SELECT {kl}, bucket, round(weight, 6) AS weight FROM (
  SELECT {kl}, (generate_subscripts(vec, 1) - 1)::INTEGER AS bucket, unnest(vec) AS weight FROM {name})
WHERE weight <> 0"""


DOC_CHUNKS = chunk_ctes() + """,
doc_chunks AS (SELECT doc_id, chunk_index, chunk_total, chunk, 'doc_' || doc_id || '.txt' AS filename,
                      'txt' AS file_type FROM chunks)"""

CHUNK_VECS = DOC_CHUNKS + "," + embed_ctes("doc_chunks", ["doc_id", "chunk_index"], "chunk", "cvec") + """,
coll AS (SELECT c.filename || '_' || c.chunk_index AS id, c.chunk AS document, v.vec
         FROM doc_chunks c JOIN cvec v USING (doc_id, chunk_index))"""


def _knn(queries: str, collection: str, k: str, qkey: str = "query_id", ckey: str = "id") -> str:
    """SELECT of ranked hits; ``queries(qkey, vec, k?)`` and ``collection(ckey, vec)``."""
    return f"""SELECT * FROM (
  SELECT q.{qkey} AS query_id, c.{ckey} AS {ckey}, {sq_l2('q.vec', 'c.vec')} AS distance, {k} AS k
  FROM {queries} q, {collection} c)
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, {ckey}) <= k"""


ORACLES: dict[str, str] = {}

ORACLES["chunk_documents"] = "WITH RECURSIVE " + chunk_ctes() + """
SELECT doc_id, chunk_index, chunk_total, chunk FROM chunks"""

ORACLES["chunk_stats"] = "WITH RECURSIVE " + chunk_ctes() + """
SELECT doc_id, count(*) AS n_chunks, arg_min(substr(chunk, 1, 100), chunk_index) AS preview,
       max(length(chunk))::INTEGER AS max_len, sum(length(chunk))::BIGINT AS total_len
FROM chunks GROUP BY doc_id"""

ORACLES["hash_embed_buckets"] = """
SELECT doc_id, (('0x' || substr(md5(w), 1, 8))::BIGINT % 64)::INTEGER AS bucket, count(*) AS n
FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\\pL\\pN]+')) AS w FROM documents)
WHERE w <> '' GROUP BY ALL"""

ORACLES["hash_embed_vectors"] = "WITH RECURSIVE " + CHUNK_VECS + "\n" + long_form("cvec", ["doc_id", "chunk_index"])

ORACLES["query_first_chunk_embed"] = "WITH RECURSIVE " + chunk_ctes("benchmark", "item_id", "text", prefix="q") + """,
first_chunk AS (SELECT b.item_id, c.chunk FROM benchmark b LEFT JOIN qchunks c ON c.item_id = b.item_id AND c.chunk_index = 0),
""" + embed_ctes("first_chunk", ["item_id"], "coalesce(chunk, '')", "qv")[1:] + "\n" + long_form("qv", ["item_id"])

ORACLES["index_rows"] = "WITH RECURSIVE " + DOC_CHUNKS + """
SELECT filename || '_' || chunk_index AS id, filename AS source, file_type, chunk_index, chunk_total,
       (chunk_index // 7)::VARCHAR AS batch, length(chunk)::INTEGER AS doc_len
FROM doc_chunks"""

ORACLES["index_batches"] = "WITH RECURSIVE " + DOC_CHUNKS + """
SELECT filename AS source, (chunk_index // 7)::VARCHAR AS batch, min(chunk_index) AS start,
       max(chunk_index) + 1 AS "end", count(*) AS n_rows, any_value(chunk_total) AS chunk_total
FROM doc_chunks GROUP BY ALL"""

_BENCH_VEC = embed_ctes("benchmark", ["item_id"], "text", "bq")

ORACLES["text_search"] = "WITH RECURSIVE " + CHUNK_VECS + "," + _BENCH_VEC + """,
hits AS (""" + _knn("(SELECT item_id AS query_id, vec FROM bq)", "coll", "10") + """)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY distance, id))::BIGINT AS rank, id,
       round(distance, 6) AS distance FROM hits"""

ORACLES["search_json"] = "WITH RECURSIVE " + CHUNK_VECS + "," + _BENCH_VEC + """,
hits AS (""" + _knn("(SELECT item_id AS query_id, vec FROM bq)", "coll", "10") + """)
SELECT h.query_id, to_json({'data': {'ids': list(h.id ORDER BY h.distance, h.id)}, 'query': any_value(b.text)})::VARCHAR AS body
FROM hits h JOIN benchmark b ON b.item_id = h.query_id GROUP BY h.query_id"""

_CHAT_HITS = "WITH RECURSIVE " + CHUNK_VECS + "," + chunk_ctes("benchmark", "item_id", "text", prefix="q") + """,
first_chunk AS (SELECT b.item_id, c.chunk FROM benchmark b LEFT JOIN qchunks c ON c.item_id = b.item_id AND c.chunk_index = 0),
""" + embed_ctes("first_chunk", ["item_id"], "coalesce(chunk, '')", "qv")[1:] + """,
hits AS (""" + _knn("(SELECT item_id AS query_id, vec FROM qv)", "coll", "5") + """),
ranked AS (SELECT h.query_id, h.id, h.distance, c.document,
                  row_number() OVER (PARTITION BY h.query_id ORDER BY h.distance, h.id) AS rank
           FROM hits h JOIN coll c USING (id))"""

ORACLES["chat_retrieval"] = _CHAT_HITS + """
SELECT query_id, count(*) AS n_hits, string_agg(document, chr(10) ORDER BY rank) AS context
FROM ranked GROUP BY query_id"""

_EMB = "(SELECT vec_id, embedding AS vec, label FROM embeddings)"

ORACLES["knn_batch"] = f"""
WITH hits AS ({_knn(f"(SELECT vec_id AS query_id, vec FROM {_EMB})", _EMB, "10", ckey="vec_id")})
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id))::BIGINT AS rank, vec_id,
       round(distance, 6) AS distance FROM hits"""

ORACLES["knn_single"] = f"""
WITH dims AS (SELECT i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY i),
mv AS (SELECT 0 AS query_id, list(m ORDER BY i) AS vec FROM dims),
hits AS ({_knn("mv", _EMB, "10", ckey="vec_id")})
SELECT (row_number() OVER (ORDER BY distance, vec_id))::BIGINT AS rank, vec_id, round(distance, 6) AS distance
FROM hits"""

_K_OF_LABEL = ("greatest(least(coalesce(CASE WHEN label % 3 = 0 THEN NULL ELSE label * 7 - 10 END, 5), 50), 10)")

ORACLES["knn_per_row_k"] = f"""
WITH q AS (SELECT vec_id AS query_id, vec, {_K_OF_LABEL} AS kq FROM {_EMB}),
hits AS ({_knn("q", _EMB, "q.kq", ckey="vec_id")})
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id))::BIGINT AS rank, vec_id,
       round(distance, 6) AS distance FROM hits"""

ORACLES["knn_nested"] = f"""
WITH hits AS ({_knn(f"(SELECT vec_id AS query_id, vec FROM {_EMB})", _EMB, "5", ckey="vec_id")})
SELECT query_id, string_agg(vec_id::VARCHAR, ',' ORDER BY distance, vec_id) AS ids, count(*)::INTEGER AS n,
       round(list_reduce(list(distance ORDER BY distance, vec_id), lambda a, b: a + b), 6) AS dist_sum
FROM hits GROUP BY query_id"""

# --- logs, conversations, prompts -------------------------------------------

ORACLES["recent_queries"] = """
SELECT event_id AS id, event_type AS query, epoch_us(ts) AS ts_us,
       json_extract_string(props, '$.k')::INTEGER AS num_results, value AS query_response_time
FROM events ORDER BY ts DESC, event_id DESC LIMIT 10"""

_MSG = "(SELECT conv_id AS conversation_id, turn, role, text AS content FROM conversations)"
_CONVS = f"""(SELECT conversation_id, NULL::VARCHAR AS title, 1704067200 + conversation_id * 60 AS created_at
  FROM {_MSG} WHERE turn = 0 AND role = 'user')"""

ORACLES["recent_conversations"] = f"""
SELECT * FROM {_CONVS} c ORDER BY created_at DESC, conversation_id DESC LIMIT 10"""

ORACLES["conversation_memory"] = f"""
SELECT conversation_id, count(*) AS n_messages,
       string_agg(role || ': ' || content, chr(10) ORDER BY turn) AS history
FROM (SELECT * FROM {_MSG} QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY turn DESC) <= 5)
GROUP BY conversation_id"""

ORACLES["orphan_messages"] = f"""
SELECT m.conversation_id, m.turn, m.role FROM {_MSG} m
WHERE NOT EXISTS (SELECT 1 FROM {_CONVS} c WHERE c.conversation_id = m.conversation_id)"""

ORACLES["conversation_join"] = f"""
SELECT c.conversation_id, c.created_at, count(*) AS n_messages
FROM {_MSG} m JOIN {_CONVS} c ON c.conversation_id = m.conversation_id GROUP BY ALL"""


def _prompt(query: str, context: str) -> str:
    return (f"'### System:' || chr(10) || '' || chr(10) || chr(10) || '### Context:' || chr(10) || coalesce({context}, '')"
            f" || chr(10) || chr(10) || '### User:' || chr(10) || {query} || chr(10) || chr(10) || '### Assistant:' || chr(10)")


def _chat_context_sql(requests: str, text: str, k: str) -> str:
    """CTEs (after CHUNK_VECS) ending in ``ctx(query_id, n_hits, context)`` for ``requests(query_id, text, ...)``."""
    return "," + chunk_ctes(requests, "query_id", text, prefix="r") + f""",
rfirst AS (SELECT q.query_id, c.chunk FROM {requests} q LEFT JOIN rchunks c ON c.query_id = q.query_id AND c.chunk_index = 0),
""" + embed_ctes("rfirst", ["query_id"], "coalesce(chunk, '')", "rv")[1:] + f""",
rq AS (SELECT rv.query_id, rv.vec, {k} AS kq FROM rv JOIN {requests} q USING (query_id)),
rhits AS ({_knn("rq", "coll", "q.kq")}),
ctx AS (SELECT h.query_id, count(*) AS n_hits,
               string_agg(c.document, chr(10) ORDER BY h.distance, h.id) AS context
        FROM rhits h JOIN coll c USING (id) GROUP BY h.query_id)"""


_BREQ = "(SELECT item_id AS query_id, text FROM benchmark)"

ORACLES["prompt_single"] = "WITH RECURSIVE " + CHUNK_VECS + _chat_context_sql(_BREQ, "text", "5") + f"""
SELECT b.query_id, {_prompt('b.text', 'ctx.context')} AS prompt
FROM {_BREQ} b LEFT JOIN ctx USING (query_id)"""

_UREQ = f"(SELECT conversation_id * 1000 + turn AS query_id, conversation_id, turn, content FROM {_MSG} WHERE role = 'user')"

ORACLES["prompt_conversation"] = "WITH RECURSIVE " + CHUNK_VECS + _chat_context_sql(_UREQ, "content", "5") + f""",
hist AS (SELECT r.conversation_id, r.turn,
                string_agg(m.role || ': ' || m.content, chr(10) ORDER BY m.turn) AS history
         FROM {_UREQ} r JOIN {_MSG} m ON m.conversation_id = r.conversation_id
              AND m.turn BETWEEN r.turn - 5 AND r.turn - 1
         GROUP BY ALL)
SELECT r.conversation_id, r.turn,
       '### Previous Conversation:' || chr(10) || coalesce(h.history, '') || chr(10) || chr(10) ||
       {_prompt('r.content', 'ctx.context')} AS prompt
FROM {_UREQ} r LEFT JOIN hist h USING (conversation_id, turn) LEFT JOIN ctx USING (query_id)"""

ORACLES["new_conversation_ids"] = f"""
WITH req AS (SELECT item_id, CASE WHEN item_id % 4 = 0 THEN NULL ELSE item_id END::BIGINT AS conversation_id
             FROM benchmark),
top AS (SELECT max(conversation_id) AS m FROM {_CONVS} c)
SELECT item_id, conversation_id, false AS is_new FROM req WHERE conversation_id IS NOT NULL
UNION ALL
SELECT item_id, (top.m + row_number() OVER (ORDER BY item_id))::BIGINT AS conversation_id, true AS is_new
FROM req, top WHERE req.conversation_id IS NULL"""

_TOKENS = ("list_filter(list_transform(string_split(content, ' '), lambda w, i: CASE WHEN i = 1 THEN w ELSE ' ' || w END),"
           " lambda t: t <> '')")

ORACLES["event_frames"] = f"""
SELECT conversation_id, turn, len(toks)::INTEGER AS n_events,
       'id: ' || conversation_id || chr(10) || chr(10) ||
       array_to_string(list_transform(toks, lambda t: 'data: ' || t || chr(10) || chr(10)), '') AS body
FROM (SELECT conversation_id, turn, {_TOKENS} AS toks FROM {_MSG} WHERE role = 'assistant')"""

ORACLES["event_parse"] = f"""
WITH f AS ({ORACLES['event_frames']}),
r AS (SELECT conversation_id, turn,
             array_to_string(list_transform(list_filter(string_split(body, chr(10) || chr(10)),
                                                        lambda e: starts_with(e, 'data: ')),
                                            lambda e: substr(e, 7)), '') AS rebuilt FROM f)
SELECT r.conversation_id, r.turn, length(r.rebuilt)::INTEGER AS rebuilt_len, r.rebuilt = m.content AS same
FROM r JOIN {_MSG} m USING (conversation_id, turn)"""

_NREQ = ("(SELECT item_id AS query_id, text, CASE WHEN item_id % 5 = 0 THEN 0 ELSE 5 END AS n_results "
         "FROM benchmark)")

ORACLES["no_hit_answer"] = "WITH RECURSIVE " + CHUNK_VECS + _chat_context_sql(_NREQ, "text", "q.n_results") + f"""
SELECT q.query_id, ctx.context IS NOT NULL AS has_hits,
       coalesce(ctx.context, 'No relevant documents found for your query.') AS context
FROM {_NREQ} q LEFT JOIN ctx USING (query_id)"""

ORACLES["query_log_rows"] = "WITH RECURSIVE " + CHUNK_VECS + "," + _BENCH_VEC + """,
hits AS (""" + _knn("(SELECT item_id AS query_id, vec FROM bq)", "coll", "10") + """),
got AS (SELECT query_id, count(*) AS returned FROM hits GROUP BY query_id)
SELECT (row_number() OVER (ORDER BY b.item_id))::BIGINT AS id, b.text AS query, 5 AS num_results,
       10 AS effective_k, coalesce(g.returned, 0)::INTEGER AS returned
FROM benchmark b LEFT JOIN got g ON g.query_id = b.item_id"""

# --- ingest -------------------------------------------------------------------

_EXTS = "['.txt', '.md', '.xml', '.csv', '.pdf', '.docx', '.doc', '.png', '.jpg', '.jpeg', '.avi', '.mp4', " \
        "'.mov', '.mpeg', '.TXT', '.tar.gz', '', '.', '.zip', '.Md']"
_NAMED = f"""(SELECT doc_id, text, CASE WHEN doc_id % 21 = 20 THEN '.doc_' || doc_id
                 ELSE 'doc_' || doc_id || {_EXTS}[(doc_id % 21) + 1] END AS filename FROM documents)"""
_EXT = "lower(regexp_extract(regexp_replace(filename, '^\\.+', ''), '(\\.[^.]*)$', 1))"
_SUFFIX = f"(CASE WHEN starts_with({_EXT}, '.') THEN {_EXT} ELSE '.' || {_EXT} END)"
_FORMATS = """(SELECT * FROM (VALUES ('txt','text'),('md','text'),('xml','text'),('csv','csv'),('pdf','pdf'),
  ('docx','docx'),('doc','docx'),('png','image'),('jpg','image'),('jpeg','image'),('avi','video'),('mp4','video'),
  ('mov','video'),('mpeg','video')) f(file_type, extractor))"""
_TYPED = f"(SELECT doc_id, filename, {_SUFFIX} AS suffix, substr({_SUFFIX}, 2) AS file_type FROM {_NAMED})"

ORACLES["file_type_derivation"] = f"SELECT doc_id, filename, suffix, file_type FROM {_TYPED}"

ORACLES["format_dispatch_counts"] = f"""
SELECT coalesce(f.extractor, 'unsupported') AS extractor, count(*) AS n
FROM {_TYPED} t LEFT JOIN {_FORMATS} f USING (file_type) GROUP BY 1"""

ORACLES["unsupported_rejects"] = f"""
SELECT t.doc_id, t.filename, t.file_type, 'unsupported' AS reason
FROM {_TYPED} t WHERE NOT EXISTS (SELECT 1 FROM {_FORMATS} f WHERE f.file_type = t.file_type)"""

ORACLES["text_newline_normalise"] = """
SELECT doc_id, length(dec)::INTEGER AS n_chars, dec = text AS same FROM (
  SELECT doc_id, text, regexp_replace(decode(encode(replace(text, chr(10),
         CASE WHEN doc_id % 2 = 0 THEN chr(13) || chr(10) ELSE chr(13) END))), chr(13) || chr(10) || '?', chr(10), 'g') AS dec
  FROM documents)"""

ORACLES["empty_blank_rejects"] = f"""
SELECT doc_id, CASE WHEN text IS NULL OR length(text) = 0 THEN 'empty'
                    WHEN NOT regexp_matches(text, '{_BLANK_FREE}') THEN 'blank' ELSE 'ok' END AS status
FROM (SELECT doc_id, text FROM documents
      UNION ALL SELECT * FROM (VALUES (-1, NULL), (-2, ''), (-3, ' ' || chr(10) || ' '), (-4, chr(160)), (-5, ' x'))
      e(doc_id, text))"""

ORACLES["paged_text_concat"] = """
SELECT conv_id, count(*) AS n_pages, string_agg(text, chr(10) ORDER BY turn) || chr(10) AS text
FROM conversations GROUP BY conv_id"""

ORACLES["count_match_check"] = "WITH RECURSIVE " + chunk_ctes() + """
SELECT doc_id, count(*) AS n_chunks, count(*) AS n_embeddings, true AS ok FROM chunks GROUP BY doc_id"""

ORACLES["dimension_check"] = """
SELECT count(*) AS n_vectors, min(len(embedding))::INTEGER AS min_dim, max(len(embedding))::INTEGER AS max_dim,
       min(len(embedding)) = 64 AND max(len(embedding)) = 64 AS matches FROM embeddings"""

ORACLES["insert_if_absent"] = """
WITH t AS (SELECT max(vec_id) AS top FROM embeddings)
SELECT vec_id, label FROM embeddings, t WHERE vec_id <= 2 * top // 3
UNION ALL
SELECT vec_id, label + 100 AS label FROM embeddings, t WHERE vec_id >= top // 3 AND vec_id > 2 * top // 3"""

# --- frames, OCR, sizes ----------------------------------------------------------

_EV_FRAMES = """(SELECT user_id AS video_id, event_id, value AS brightness,
       json_extract_string(props, '$.k')::BIGINT * 10 AS edge_count,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_no,
       count(*) OVER (PARTITION BY user_id) AS total
  FROM events)"""
_STRIDED = f"(SELECT * FROM {_EV_FRAMES} WHERE frame_no % greatest(1, total // 10) = 0)"

ORACLES["frame_stride"] = f"SELECT video_id, frame_no, event_id FROM {_STRIDED}"

ORACLES["frame_relevance"] = f"""
SELECT video_id, frame_no, event_id FROM {_STRIDED} WHERE brightness >= 30 AND edge_count >= 500"""

ORACLES["frame_cap"] = f"""
SELECT video_id, frame_no FROM {_STRIDED} WHERE brightness >= 30 AND edge_count >= 500
QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY frame_no) <= 10"""

ORACLES["histogram_bins"] = """
SELECT user_id AS video_id, floor(value)::INTEGER AS bin, count(*) AS n
FROM events WHERE value >= 0 AND value < 256 GROUP BY ALL"""


def _pearson(a: str, b: str) -> str:
    s = "lambda x, y: x + y"
    ma = f"(list_reduce({a}, {s})::DOUBLE / len({a}))"
    mb = f"(list_reduce({b}, {s})::DOUBLE / len({b}))"
    cov = (f"list_reduce(list_transform(range(1, len({a}) + 1), "
           f"lambda i: ({a}[i]::DOUBLE - {ma}) * ({b}[i]::DOUBLE - {mb})), {s})")
    va = f"list_reduce(list_transform({a}, lambda x: (x::DOUBLE - {ma}) * (x::DOUBLE - {ma})), {s})"
    vb = f"list_reduce(list_transform({b}, lambda x: (x::DOUBLE - {mb}) * (x::DOUBLE - {mb})), {s})"
    return f"(CASE WHEN sqrt({va} * {vb}) = 0 THEN 1.0 ELSE {cov} / sqrt({va} * {vb}) END)"


_HF = """(SELECT label AS video_id, vec_id, embedding::DOUBLE[] AS hist,
         row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS seq,
         count(*) OVER (PARTITION BY label) AS total FROM embeddings)"""

ORACLES["histogram_corr"] = f"""
SELECT video_id, vec_id, prev_vec_id, round({_pearson('hist', 'prev_hist')}, 6) AS corr FROM (
  SELECT video_id, vec_id, hist, lag(vec_id) OVER w AS prev_vec_id, lag(hist) OVER w AS prev_hist
  FROM {_HF} WINDOW w AS (PARTITION BY video_id ORDER BY seq))
WHERE prev_vec_id IS NOT NULL"""

ORACLES["sequence_dedup"] = f"""
WITH RECURSIVE s AS (
  SELECT video_id, vec_id, hist, row_number() OVER (PARTITION BY video_id ORDER BY seq) AS pos
  FROM {_HF} WHERE seq % greatest(1, total // 100) = 0),
walk AS (
  SELECT video_id, pos, vec_id, true AS kept, hist AS last FROM s WHERE pos = 1
  UNION ALL
  SELECT s.video_id, s.pos, s.vec_id, NOT ({_pearson('s.hist', 'w.last')} > 0.2) AS kept,
         CASE WHEN {_pearson('s.hist', 'w.last')} > 0.2 THEN w.last ELSE s.hist END AS last
  FROM walk w JOIN s ON s.video_id = w.video_id AND s.pos = w.pos + 1)
SELECT video_id, vec_id FROM walk WHERE kept
QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY pos) <= 100"""

ORACLES["video_text"] = f"""
WITH RECURSIVE s AS (
  SELECT video_id, vec_id, hist, seq, row_number() OVER (PARTITION BY video_id ORDER BY seq) AS pos
  FROM {_HF} WHERE seq % greatest(1, total // 100) = 0 AND abs(hist[1]) * 400 >= 30 AND abs(hist[2]) * 8000 >= 500),
walk AS (
  SELECT video_id, pos, vec_id, seq, true AS kept, hist AS last FROM s WHERE pos = 1
  UNION ALL
  SELECT s.video_id, s.pos, s.vec_id, s.seq, NOT ({_pearson('s.hist', 'w.last')} > 0.2) AS kept,
         CASE WHEN {_pearson('s.hist', 'w.last')} > 0.2 THEN w.last ELSE s.hist END AS last
  FROM walk w JOIN s ON s.video_id = w.video_id AND s.pos = w.pos + 1),
kept AS (SELECT video_id, vec_id, seq FROM walk WHERE kept QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY pos) <= 100),
toks AS (
  SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\n]')) AS tok,
         generate_subscripts(regexp_split_to_array(text, '[ \\n]'), 1) AS token_no FROM documents),
frames AS (
  SELECT k.video_id, k.seq, string_agg(trim(t.tok), ' ' ORDER BY t.token_no) AS frame_text
  FROM kept k JOIN toks t ON t.doc_id = k.vec_id
  WHERE ('0x' || substr(md5(t.tok), 1, 2))::INTEGER * 100.0::DOUBLE / 255.0::DOUBLE > 60 AND length(trim(t.tok)) > 1 GROUP BY ALL)
SELECT video_id, count(*) AS n_frames, string_agg(frame_text, chr(10) ORDER BY seq) AS text FROM frames GROUP BY video_id"""

ORACLES["ocr_token_text"] = """
WITH lines AS (
  SELECT doc_id AS video_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS frame_no FROM documents),
toks AS (
  SELECT video_id, frame_no, unnest(string_split(line, ' ')) AS tok,
         generate_subscripts(string_split(line, ' '), 1) AS token_no FROM lines),
good AS (
  SELECT video_id, frame_no, token_no, trim(tok) AS t FROM toks
  WHERE ('0x' || substr(md5(tok), 1, 2))::INTEGER * 100.0::DOUBLE / 255.0::DOUBLE > 60 AND length(trim(tok)) > 1),
frames AS (
  SELECT video_id, frame_no, string_agg(t, ' ' ORDER BY token_no) AS frame_text FROM good GROUP BY ALL)
SELECT video_id, count(*) AS n_frames, string_agg(frame_text, chr(10) ORDER BY frame_no) AS text
FROM frames GROUP BY video_id"""

ORACLES["image_resize_plan"] = """
WITH s AS (
  SELECT p_partkey AS image_id, (p_partkey * 37) % 1000 + 1 AS width, (p_size * 29 + p_partkey) % 900 + 1 AS height
  FROM part
  UNION ALL SELECT * FROM (VALUES (-1, 800, 600), (-2, 799, 600), (-3, 400, 900), (-4, 1980, 10), (-5, 1981, 10),
                                  (-6, 1, 1)) e(image_id, width, height)),
r AS (SELECT *, greatest(CASE WHEN width < 800 THEN 800.0::DOUBLE / width::DOUBLE ELSE 1.0::DOUBLE END,
                         CASE WHEN height < 600 THEN 600.0::DOUBLE / height::DOUBLE ELSE 1.0::DOUBLE END) AS scale,
             (width < 800 OR height < 600) AS small FROM s)
SELECT image_id, width, height,
       CASE WHEN small AND scale > 1 THEN floor(width::DOUBLE * scale) ELSE width END::BIGINT AS new_width,
       CASE WHEN small AND scale > 1 THEN floor(height::DOUBLE * scale) ELSE height END::BIGINT AS new_height,
       small AND scale > 1 AS resized
FROM r"""

ORACLES["frame_resize_plan"] = """
WITH s AS (
  SELECT l_orderkey * 10 + l_linenumber AS frame_id, (l_partkey * 13) % 4000 + 1 AS width,
         (l_suppkey * 7 + l_linenumber) % 3000 + 1 AS height FROM lineitem
  UNION ALL SELECT * FROM (VALUES (-1, 1980, 1980), (-2, 1981, 10), (-3, 10, 1981), (-4, 3961, 2))
  e(frame_id, width, height)),
r AS (SELECT *, (width > 1980 OR height > 1980) AS big,
             1980.0::DOUBLE / greatest(width, height)::DOUBLE AS scale FROM s)
SELECT frame_id, width, height,
       CASE WHEN big THEN round_even(width::DOUBLE * scale, 0) ELSE width END::BIGINT AS new_width,
       CASE WHEN big THEN round_even(height::DOUBLE * scale, 0) ELSE height END::BIGINT AS new_height,
       big AS resized
FROM r"""

ORACLES["video_stats"] = """
SELECT video_id, fps, frames, round(frames::DOUBLE / nullif(fps, 0)::DOUBLE, 6) AS duration, fps <> 0 AS ok
FROM (SELECT o_custkey AS video_id, count(*) AS frames, (o_custkey % 4) * 10 AS fps FROM orders GROUP BY 1)"""

# --- streams and extractors -----------------------------------------------------

ORACLES["stream_ingest"] = "WITH RECURSIVE " + DOC_CHUNKS + """
SELECT filename || '_' || chunk_index AS id, filename AS source, chunk_index, chunk_total,
       (chunk_index // 5000)::VARCHAR AS batch, length(chunk)::INTEGER AS doc_len
FROM doc_chunks"""

ORACLES["stream_search"] = ORACLES["text_search"]
ORACLES["collection_appends"] = ORACLES["text_search"]
ORACLES["text_search_va"] = ORACLES["text_search"]
ORACLES["knn_va"] = ORACLES["knn_batch"]

ORACLES["docx_extract"] = "SELECT doc_id, length(text)::INTEGER AS n_chars, true AS same FROM documents"

ORACLES["chunk_documents_native"] = ORACLES["chunk_documents"]

ORACLES["stream_query_log"] = f"SELECT *, true AS timed FROM ({ORACLES['query_log_rows']})"

ORACLES["batch_sink"] = ORACLES["index_rows"]

#: Every conversation's user messages with the stripped echo after each; history is the five messages before.
ORACLES["turn_stream"] = f"""
WITH r AS (SELECT conversation_id, turn, content, row_number() OVER (PARTITION BY conversation_id ORDER BY turn) AS k
           FROM {_MSG} WHERE role = 'user' AND trim(content) <> ''),
o AS (SELECT *, row_number() OVER (ORDER BY k, conversation_id, turn) AS no FROM r),
m AS (SELECT 2 * no - 1 AS id, conversation_id, 2 * k - 1 AS at, 'user' AS role, content FROM o
      UNION ALL SELECT 2 * no, conversation_id, 2 * k, 'assistant', regexp_replace(content, '^\\s+|\\s+$', '', 'g') FROM o),
h AS (SELECT u.id, string_agg(p.role || ': ' || p.content, chr(10) ORDER BY p.at) AS history
      FROM m u JOIN m p ON p.conversation_id = u.conversation_id AND p.at BETWEEN u.at - 5 AND u.at - 1
      WHERE u.role = 'user' GROUP BY u.id)
SELECT m.id, m.conversation_id, m.role, m.content,
       CASE WHEN m.role = 'user' THEN '### Previous Conversation:' || chr(10) || coalesce(h.history, '') || chr(10) || chr(10) ||
       {_prompt('m.content', 'NULL')} END AS prompt
FROM m LEFT JOIN h USING (id)"""

ORACLES["request_defaults"] = """
SELECT item_id, length(text)::INTEGER AS query_len,
       (CASE WHEN item_id % 3 = 2 THEN item_id % 60 ELSE 5 END)::INTEGER AS n_results
FROM benchmark"""

ORACLES["paged_file_extract"] = ORACLES["paged_text_concat"]
ORACLES["paged_source"] = ORACLES["paged_text_concat"]
