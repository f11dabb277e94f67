"""DuckDB twins of the Spark queries, written independently from the table definitions.

Views ``documents embeddings benchmark labels conversations ...`` are registered by the caller.
Shared CTEs are kept as named fragments; ``q(*names, body)`` assembles a WITH list in order.
Whitespace and word classes are the same literal patterns as in ``irforge.functions.text``.
"""

from __future__ import annotations

from irforge.functions import fixed

WS = r"[\x09-\x0d\x1c-\x1f\x85\p{Z}]"
NON_WS_RUN = r"[^\x09-\x0d\x1c-\x1f\x85\p{Z}]+"
WORD = r"[\p{L}\p{N}_]{2,}"


def py_split(x: str) -> str:
    return f"regexp_extract_all({x}, '{NON_WS_RUN}')"


def py_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+\\z', '', 'g')"


def words(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{WORD}')"


CTE = {
    "corpus": f"""corpus AS (
  SELECT CAST(doc_id AS VARCHAR) AS docid,
         CASE WHEN strpos(text, chr(10)) > 0 THEN split_part(text, chr(10), 1) ELSE '' END AS title,
         CASE WHEN strpos(text, chr(10)) > 0 THEN substr(text, strpos(text, chr(10)) + 1) ELSE text END AS body
  FROM documents)""",
    "docs": """docs AS (SELECT CAST(doc_id AS VARCHAR) AS docid, text AS doctext FROM documents)""",
    "queries": f"""queries AS (
  SELECT CAST(item_id AS VARCHAR) AS qid, text AS query FROM benchmark)""",
    "qrels": """qrels AS (
  SELECT DISTINCT CAST(b.item_id AS VARCHAR) AS qid, CAST(d.doc_id AS VARCHAR) AS docid, 1 AS rel
  FROM benchmark b JOIN documents d ON strpos(d.text, b.text) > 0)""",
    "bm25": f"""qterms AS (
  SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({words('query')}) AS term FROM queries) GROUP BY qid, term),
fld AS (SELECT docid, 'text' AS f, body AS x FROM corpus UNION ALL SELECT docid, 'title' AS f, title AS x FROM corpus),
ftoks AS (SELECT docid, f, {words('x')} AS t FROM fld),
fdl AS (SELECT docid, f, len(t) AS dl FROM ftoks WHERE len(t) > 0),
fstats AS (SELECT f, count(*) AS n, avg(dl) AS avgdl FROM fdl GROUP BY f),
fpost AS (SELECT docid, f, term, count(*) AS tf FROM (SELECT docid, f, unnest(t) AS term FROM ftoks) GROUP BY docid, f, term),
fdf AS (SELECT f, term, count(*) AS df FROM fpost GROUP BY f, term),
contrib AS (
  SELECT qt.qid, p.docid,
         qt.qtf * ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * p.tf
           / (p.tf + 0.9 * (1 - 0.4 + 0.4 * l.dl / s.avgdl)) AS s
  FROM qterms qt JOIN fpost p ON p.term = qt.term
  JOIN fdf d ON d.f = p.f AND d.term = p.term
  JOIN fdl l ON l.docid = p.docid AND l.f = p.f
  JOIN fstats s ON s.f = p.f),
bm25_scores AS (SELECT qid, docid, round(sum(s), 6) AS score FROM contrib GROUP BY qid, docid),
run AS (
  SELECT * FROM (
    SELECT qid, docid, score,
           row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid ASC) AS rank
    FROM bm25_scores) WHERE rank <= 100)""",
    "metrics": """rel AS (SELECT qid, docid, CAST(rel AS DOUBLE) AS rel FROM qrels WHERE rel > 0),
judged AS (SELECT qid, count(*) AS n_rel FROM rel GROUP BY qid),
ideal AS (
  SELECT qid, sum(rel / log2(ir + 1.0)) AS idcg FROM (
    SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, docid ASC) AS ir FROM rel)
  WHERE ir <= 10 GROUP BY qid),
er AS (
  SELECT r.qid, r.docid, r.erank, q.rel, CASE WHEN q.rel > 0 THEN 1 ELSE 0 END AS hit
  FROM (SELECT qid, docid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid DESC) AS erank FROM run) r
  LEFT JOIN rel q ON q.qid = r.qid AND q.docid = r.docid
  WHERE r.erank <= 100),
er2 AS (SELECT *, sum(hit) OVER (PARTITION BY qid ORDER BY erank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hits_so_far FROM er),
qagg AS (
  SELECT qid,
    sum(CASE WHEN erank <= 10 THEN coalesce(rel, 0.0) / log2(erank + 1.0) ELSE 0.0 END) AS dcg,
    sum(CASE WHEN erank <= 100 THEN hit ELSE 0 END) AS hits_r,
    sum(CASE WHEN erank <= 100 AND hit = 1 THEN hits_so_far / erank ELSE 0.0 END) AS ap_sum,
    min(CASE WHEN erank <= 10 AND hit = 1 THEN erank END) AS first_hit
  FROM er2 GROUP BY qid),
per_query AS (
  SELECT j.qid,
    coalesce(a.dcg / i.idcg, 0.0) AS ndcg_10,
    coalesce(a.hits_r / j.n_rel, 0.0) AS recall_100,
    coalesce(a.ap_sum / j.n_rel, 0.0) AS ap_100,
    coalesce(1.0 / a.first_hit, 0.0) AS rr_10
  FROM judged j JOIN ideal i ON i.qid = j.qid LEFT JOIN qagg a ON a.qid = j.qid)""",
}


def q(*names: str, body: str) -> str:
    return "WITH " + ",\n".join(CTE[n] for n in names) + "\n" + body


ORACLE: dict[str, str] = {}

ORACLE["bm25_topk"] = q("corpus", "queries", "bm25", body="SELECT qid, docid, score, CAST(rank AS BIGINT) AS rank FROM run")
ORACLE["containment_qrels"] = q("qrels", body="SELECT qid, docid, CAST(rel AS INTEGER) AS rel FROM qrels")
ORACLE["run_metrics"] = q("corpus", "queries", "bm25", "qrels", "metrics", body="""SELECT qid,
  round(ndcg_10, 6) AS ndcg_10, round(recall_100, 6) AS recall_100, round(ap_100, 6) AS ap_100, round(rr_10, 6) AS rr_10
FROM per_query""")
ORACLE["run_metrics_summary"] = q("corpus", "queries", "bm25", "qrels", "metrics", body="""SELECT count(*) AS n_queries,
  round(avg(ndcg_10), 6) AS ndcg_10, round(avg(recall_100), 6) AS recall_100,
  round(avg(ap_100), 6) AS map_100, round(avg(rr_10), 6) AS mrr_10
FROM per_query""")
ORACLE["run_depth_report"] = q("corpus", "queries", "bm25", body="""SELECT
  CAST(sum(CASE WHEN n >= 100 THEN 1 ELSE 0 END) AS BIGINT) AS n_full_depth,
  CAST(sum(CASE WHEN n < 100 THEN 1 ELSE 0 END) AS BIGINT) AS n_short,
  min(n) AS min_results, max(n) AS max_results
FROM (SELECT qid, count(*) AS n FROM run GROUP BY qid)""")
ORACLE["run_pool"] = q("corpus", "queries", "bm25", body="""SELECT count(DISTINCT docid) AS n_distinct_docs, count(*) AS n_occurrences FROM run""")


# --- text preparation ------------------------------------------------------------------------
def rstrip(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+\\z', '', 'g')"


def before(x: str, p: str) -> str:
    # string_split(...)[1], not split_part: nested split_part calls plan exponentially in DuckDB
    return f"string_split({x}, {p})[1]"


STOP = fixed.QUESTION_STOP_PHRASES


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def clean_q(x: str) -> str:
    e = rstrip(f"replace({x}, chr(10), '')")
    for p in STOP:
        e = before(e, lit(p))
    return py_strip(e)


def clean_out(x: str, prompt: str) -> str:
    e = py_strip(before(f"replace({x}, {prompt}, '')", lit(fixed.LLM_OUTPUT_CUTS[0])))
    for p in fixed.LLM_OUTPUT_CUTS[1:]:
        e = py_strip(before(e, "chr(10)" if p == "\n" else lit(p)))
    return e


CTE["dsdocs"] = """dsdocs AS (
  SELECT CAST(doc_id AS VARCHAR) AS docid, text AS doctext,
         CASE source WHEN 'src0' THEN 'signal1m' WHEN 'src1' THEN 'hotpotqa' WHEN 'src2' THEN 'quora'
                     WHEN 'src3' THEN 'climate-fever' ELSE source END AS dataset
  FROM documents)"""
CTE["questions"] = """questions AS (
  SELECT CAST(c.conv_id AS VARCHAR) AS docid, c.turn AS seq, c.text AS question, coalesce(d.text, '') AS doctext
  FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id WHERE c.role = 'user')"""
CTE["outputs"] = """outputs AS (
  SELECT CAST(a.conv_id AS VARCHAR) AS docid, a.turn, coalesce(u.text, '') AS prompt,
         coalesce(u.text, '') || chr(10) || a.text AS output
  FROM conversations a LEFT JOIN conversations u
    ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn AND u.role = 'user'
  WHERE a.role = 'assistant')"""

ORACLE["merge_title_text"] = q("corpus", body=f"""SELECT docid,
  CASE WHEN {py_strip('title')} <> '' THEN {py_strip(py_strip('title') + " || ' ' || " + py_strip('body'))}
       ELSE {py_strip('body')} END AS doctext FROM corpus""")
ORACLE["filter_len_sampling"] = q("dsdocs", body="""SELECT docid, dataset, CAST(length(doctext) AS BIGINT) AS n_chars FROM dsdocs
WHERE length(doctext) >= CASE dataset WHEN 'signal1m' THEN 3 WHEN 'hotpotqa' THEN 150 WHEN 'quora' THEN 15
                                      WHEN 'climate-fever' THEN 3 ELSE 300 END""")
ORACLE["filter_len_kselect"] = q("dsdocs", body="""SELECT docid, dataset, CAST(length(doctext) AS BIGINT) AS n_chars FROM dsdocs
WHERE NOT (dataset = 'signal1m' AND length(doctext) < 3) AND NOT (dataset = 'hotpotqa' AND length(doctext) < 150)
  AND length(doctext) >= 300""")
ORACLE["truncate_tokens"] = q("docs", body=f"""SELECT docid, t AS doctext, CAST(len({py_split('t')}) AS BIGINT) AS n_tokens
FROM (SELECT docid, array_to_string({py_split('doctext')}[1:512], ' ') AS t FROM docs)""")
ORACLE["text_prefix"] = q("docs", body="SELECT docid, substr(doctext, 1, 600) AS exemplar, substr(doctext, 1, 200) AS answer FROM docs")
ORACLE["clean_questions"] = q("questions", body=f"SELECT docid, seq, {clean_q('question')} AS question FROM questions")
ORACLE["kept_questions"] = q("questions", body=f"""SELECT docid, seq, question, CAST(length(doctext) AS BIGINT) AS doc_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY docid ORDER BY seq DESC) AS rn FROM (
    SELECT docid, seq, {clean_q('question')} AS question, doctext FROM questions)
  WHERE question <> '' AND NOT regexp_matches(question, '[^\\x00-\\x7F]'))
WHERE rn = 1""")
ORACLE["clean_llm_output"] = q("outputs", body=f"SELECT docid, turn, {clean_out('output', 'prompt')} AS question FROM outputs")
ORACLE["extract_question"] = q("outputs", body=f"""SELECT docid, turn, CASE WHEN ends_with(x, '?') THEN x ELSE x || '?' END AS question
FROM (SELECT docid, turn, {py_strip(before(py_strip("string_split(output, 'Query:')[-1]"), 'chr(10)'))} AS x FROM outputs)""")
_PAD_P, _PAD_Q = fixed.PAD_EXEMPLAR
_INSTR = fixed.FEWSHOT_INSTRUCTION.rstrip("\n")
_SHOTS = " || chr(10) || chr(10) || ".join(
    f"'Example {i}:' || chr(10) || 'Passage: ' || {lit(_PAD_P)} || chr(10) || 'Query: ' || {lit(_PAD_Q)}" for i in (1, 2, 3))
ORACLE["render_fewshot_prompt"] = q("docs", body=f"""SELECT docid,
  {lit(_INSTR)} || chr(10) || chr(10) || {_SHOTS} || chr(10) || chr(10) ||
  'Now generate a query for the following passage:' || chr(10) || 'Passage: ' || doctext || chr(10) || 'Query:' AS prompt
FROM docs""")
ORACLE["render_template_prompt"] = q("docs", body=f"""SELECT docid,
  {rstrip("'Example 1:' || chr(10) || 'Document: ' || array_to_string(" + py_split('doctext') + "[1:512], ' ') || chr(10) || 'Relevant Query: ' || chr(10)")} AS prompt
FROM docs""")
ORACLE["doc_text_join_fields"] = q("corpus", body="SELECT docid, title || '. ' || body AS multifield, title || ' ' || body AS lookup FROM corpus")


# --- vectors ---------------------------------------------------------------------------------
def l_norm(v: str) -> str:
    return f"sqrt(list_sum(list_transform({v}, lambda y: y * y)))"


def checksum(v: str) -> str:
    return f"list_sum(list_transform({v}, lambda x, i: x * i))"


CTE["unit"] = f"""emb AS (SELECT vec_id, CAST(vec_id AS VARCHAR) AS docid, CAST(embedding AS DOUBLE[]) AS raw, label AS cid FROM embeddings),
embn AS (SELECT *, greatest({l_norm('raw')}, 1e-12) AS nrm FROM emb),
unit AS (SELECT vec_id, docid, cid, raw, list_transform(raw, lambda x: x / nrm) AS vec FROM embn)"""
CTE["means"] = f"""ue AS (SELECT cid, i, x, rx FROM (SELECT cid, unnest(vec) AS x, unnest(raw) AS rx, generate_subscripts(vec, 1) AS i FROM unit)),
cm AS (SELECT cid, list(m ORDER BY i) AS center, list(rm ORDER BY i) AS rcenter
       FROM (SELECT cid, i, avg(x) AS m, avg(rx) AS rm FROM ue GROUP BY cid, i) GROUP BY cid),
ucm AS (SELECT cid, list_transform(center, lambda x: x / nrm) AS center, rcenter
        FROM (SELECT cid, center, rcenter, greatest({l_norm('center')}, 1e-12) AS nrm FROM cm))"""
CTE["qvec"] = f"""qraw AS (
  SELECT a.docid, list_transform(generate_series(1, len(a.raw)), lambda i: a.raw[i] + b.raw[i]) AS s
  FROM emb a JOIN emb b ON b.vec_id = (a.vec_id * 7 + 1) % (SELECT count(*) FROM emb)),
qv AS (SELECT docid, list_transform(s, lambda x: x / nrm) AS qvec FROM (SELECT docid, s, greatest({l_norm('s')}, 1e-12) AS nrm FROM qraw))"""

ORACLE["unit_normalize"] = q("unit", body=f"""SELECT docid, round({l_norm('raw')}, 6) AS raw_norm, round(vec[1], 6) AS u1,
  round({checksum('vec')}, 6) AS checksum FROM unit""")
ORACLE["neighbor_counts"] = q("unit", body="""SELECT a.docid, count(b.docid) AS n_neighbors
FROM unit a LEFT JOIN unit b ON a.docid <> b.docid AND list_dot_product(a.vec, b.vec) > 0.30 GROUP BY a.docid""")
ORACLE["cluster_sizes"] = q("unit", body="""SELECT CAST(r.range AS INTEGER) AS cid, CAST(coalesce(s.size, 0) AS BIGINT) AS size
FROM range(0, (SELECT max(cid) + 1 FROM unit)) r LEFT JOIN (SELECT cid, count(*) AS size FROM unit GROUP BY cid) s ON s.cid = r.range""")
ORACLE["cluster_means"] = q("unit", "means", body=f"""SELECT cid, round(center[1], 6) AS c1, round({checksum('center')}, 6) AS checksum FROM ucm""")
ORACLE["nearest_centroid"] = q("unit", "means", body="""SELECT docid, cid, dist FROM (
  SELECT u.docid, c.cid, round(list_distance(u.raw, c.rcenter), 6) AS dist,
         row_number() OVER (PARTITION BY u.docid ORDER BY round(list_distance(u.raw, c.rcenter), 6), c.cid) AS rn
  FROM unit u, ucm c) WHERE rn = 1""")
ORACLE["medoid_per_cluster"] = q("unit", "means", body="""SELECT cid, docid, dist FROM (
  SELECT c.cid, u.docid, round(list_distance(u.raw, c.rcenter), 6) AS dist,
         row_number() OVER (PARTITION BY c.cid ORDER BY round(list_distance(u.raw, c.rcenter), 6), u.docid) AS rn
  FROM unit u, ucm c) WHERE rn = 1""")
ORACLE["nearest_cluster"] = q("unit", "means", body="""SELECT cid, near_cid, sim FROM (
  SELECT a.cid, b.cid AS near_cid, round(list_dot_product(a.center, b.center), 6) AS sim,
         row_number() OVER (PARTITION BY a.cid ORDER BY round(list_dot_product(a.center, b.center), 6) DESC, b.cid) AS rn
  FROM ucm a JOIN ucm b ON a.cid <> b.cid) WHERE rn = 1""")
ORACLE["cosine_sse"] = q("unit", "means", body="""SELECT round(sum(pow(1.0 - list_cosine_similarity(u.raw, c.rcenter), 2)), 6) AS sse
FROM unit u JOIN ucm c ON c.cid = u.cid""")
ORACLE["dense_topk"] = q("unit", "qvec", body="""SELECT qid, docid, score, rank FROM (
  SELECT q.docid AS qid, u.docid, round(list_dot_product(q.qvec, u.vec), 6) AS score,
         CAST(row_number() OVER (PARTITION BY q.docid ORDER BY round(list_dot_product(q.qvec, u.vec), 6) DESC, u.docid) AS BIGINT) AS rank
  FROM qv q, unit u) WHERE rank <= 100""")
ORACLE["masked_mean_pool"] = q("unit", body=f""", tok AS (SELECT docid, vec_id, raw, unnest(range(0, 8)) AS pos FROM unit),
kept AS (SELECT docid, pos, raw FROM tok WHERE (vec_id + pos) % 5 <> 0),
cnt AS (SELECT docid, count(*) AS n_tokens FROM kept GROUP BY docid),
el AS (SELECT docid, j, avg(raw[pos * 8 + j]) AS m FROM kept, (SELECT unnest(range(1, 9)) AS j) GROUP BY docid, j),
pooled AS (SELECT docid, list(m ORDER BY j) AS pooled FROM el GROUP BY docid)
SELECT p.docid, c.n_tokens, round(pooled[1], 6) AS p1, round({checksum('pooled')}, 6) AS checksum
FROM pooled p JOIN cnt c ON c.docid = p.docid""")
ORACLE["silhouette_by_label"] = q("unit", body=""", pd AS (SELECT a.docid, a.cid AS lcid, b.cid AS rcid, avg(list_distance(a.vec, b.vec)) AS mean
  FROM unit a JOIN unit b ON a.docid <> b.docid GROUP BY a.docid, a.cid, b.cid),
sz AS (SELECT cid, count(*) AS size FROM unit GROUP BY cid),
ab AS (SELECT docid, lcid, max(CASE WHEN rcid = lcid THEN mean END) AS a, min(CASE WHEN rcid <> lcid THEN mean END) AS b FROM pd GROUP BY docid, lcid)
SELECT round(avg(CASE WHEN sz.size <= 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette
FROM ab JOIN sz ON sz.cid = ab.lcid""".replace("pd AS", "", 0))
ORACLE["knee_of_curve"] = q("unit", body=""", x AS (SELECT docid, raw, cid, k FROM unit, (SELECT unnest(range(1, 11)) AS k)),
xg AS (SELECT docid, raw, k, cid % k AS g FROM x),
el AS (SELECT k, g, i, avg(rx) AS m FROM (SELECT k, g, unnest(raw) AS rx, generate_subscripts(raw, 1) AS i FROM xg) GROUP BY k, g, i),
cen AS (SELECT k, g, list(m ORDER BY i) AS center FROM el GROUP BY k, g),
curve AS (SELECT xg.k, round(sum(pow(1.0 - list_cosine_similarity(xg.raw, cen.center), 2)), 9) AS sse
          FROM xg JOIN cen ON cen.k = xg.k AND cen.g = xg.g GROUP BY xg.k),
c0 AS (SELECT CAST(k AS DOUBLE) AS x, sse AS y, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM curve),
c1 AS (SELECT *, (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) AS xn,
              (y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) AS yn FROM c0),
c2 AS (SELECT *, (max(yn) OVER () - yn) - xn AS d FROM c1),
c3 AS (SELECT *, coalesce(lag(d) OVER (ORDER BY x), d) AS pd, coalesce(lead(d) OVER (ORDER BY x), d) AS nd,
              lead(d) OVER (ORDER BY x) AS d_next FROM c2),
c4 AS (SELECT *, d >= pd AND d >= nd AS is_max, d <= pd AND d <= nd AS is_min FROM c3),
c5 AS (SELECT *, max(CASE WHEN is_max THEN i END) OVER w AS last_max, max(CASE WHEN is_min THEN i END) OVER w AS last_min,
              last_value(CASE WHEN is_max THEN d - 0.01 / (n - 1) END IGNORE NULLS) OVER w AS thr_at_max,
              last_value(CASE WHEN is_max THEN x END IGNORE NULLS) OVER w AS x_at_max
       FROM c4 WINDOW w AS (ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT CAST(min_by(x_at_max, i) AS DOUBLE) AS knee FROM c5
WHERE last_max IS NOT NULL AND d_next IS NOT NULL
  AND d_next < CASE WHEN last_min >= last_max THEN 0.0 ELSE thr_at_max END""")


# --- features and experts --------------------------------------------------------------------
def tfidf_ctes(src: str) -> str:
    """CTE list computing ``tfidf(docid, term, tf, w)`` over the table ``src(docid, doctext)``."""
    return f"""tt AS (
  SELECT docid, list_concat(t, list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1])) AS terms
  FROM (SELECT docid, {words('doctext')} AS t FROM {src})),
tp AS (SELECT docid, term, count(*) AS tf FROM (SELECT docid, unnest(terms) AS term FROM tt) GROUP BY docid, term),
ts AS (SELECT term, sum(tf) AS cf, count(*) AS df FROM tp GROUP BY term),
vocab AS (SELECT * FROM ts ORDER BY cf DESC, term ASC LIMIT 120000),
idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM {src})) / (1.0 + df)) + 1.0 AS idf FROM vocab),
wr AS (SELECT tp.docid, tp.term, tp.tf, tp.tf * idf.idf AS raw FROM tp JOIN idf ON idf.term = tp.term),
tfidf AS (SELECT docid, term, tf, raw / sqrt(sum(raw * raw) OVER (PARTITION BY docid)) AS w FROM wr)"""


def density_ctes(src: str) -> str:
    return f"""dens AS (
  SELECT s.docid, coalesce(w.wsum, 0.0) / greatest(len({py_split('s.doctext')}), 1) AS density
  FROM {src} s LEFT JOIN (SELECT docid, sum(w) AS wsum FROM tfidf GROUP BY docid) w ON w.docid = s.docid),
ni_raw AS (
  SELECT docid, 1.0 - len(list_distinct({py_split('lower(doctext)')})) / greatest(len({py_split('lower(doctext)')}), 1) AS ni_raw
  FROM {src}),
nis AS (SELECT docid, (ni_raw - (SELECT min(ni_raw) FROM ni_raw)) / greatest(1e-8, (SELECT max(ni_raw) - min(ni_raw) FROM ni_raw)) AS ni
        FROM ni_raw)"""


CTE["de"] = """de AS (SELECT d.docid, d.doctext, u.vec, u.cid FROM docs d JOIN unit u ON u.docid = d.docid)"""
CTE["tfidf_docs"] = tfidf_ctes("docs")
CTE["tfidf_de"] = tfidf_ctes("de")
CTE["density_de"] = density_ctes("de")
CTE["feat"] = """nbc AS (SELECT a.docid, count(b.docid) AS nb FROM de a LEFT JOIN de b
        ON a.docid <> b.docid AND list_dot_product(a.vec, b.vec) > 0.30 GROUP BY a.docid),
dm AS (SELECT cid, list(m ORDER BY i) AS center FROM (
        SELECT cid, i, avg(x) AS m FROM (SELECT cid, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM de) GROUP BY cid, i)
       GROUP BY cid),
dist AS (SELECT de.docid, list_distance(de.vec, dm.center) AS dist FROM de JOIN dm ON dm.cid = de.cid),
sz AS (SELECT cid, count(*) AS cluster_size FROM de GROUP BY cid),
feat AS (SELECT de.docid, de.cid, coalesce(nbc.nb, 0) AS n_neighbors, dens.density, nis.ni, dist.dist, sz.cluster_size
         FROM de JOIN dens ON dens.docid = de.docid JOIN nis ON nis.docid = de.docid JOIN dist ON dist.docid = de.docid
         LEFT JOIN nbc ON nbc.docid = de.docid JOIN sz ON sz.cid = de.cid),
st AS (SELECT least(min(density), 0.0) AS tfidf_min, greatest(max(density), 1.0) AS tfidf_max, avg(ni) AS ni_mean,
              stddev_pop(ni) + 1e-8 AS ni_std, min(dist) AS dmin, max(dist) AS dmax, max(n_neighbors) AS max_neighbors FROM feat),
ex AS (SELECT f.docid, f.cid,
  f.n_neighbors / CAST(greatest(1, st.max_neighbors) AS DOUBLE) AS s1,
  1.0 / (1.0 + exp(-((f.density * greatest(1e-8, st.tfidf_max) - st.tfidf_min) / greatest(1e-8, st.tfidf_max)))) AS s2,
  CASE WHEN st.ni_std <= 1e-8 THEN 1.0 ELSE exp(-pow(f.ni - st.ni_mean, 2) / (2.0 * st.ni_std * st.ni_std)) END AS s3,
  CASE WHEN f.cluster_size = 1 THEN 0.85
       ELSE least(greatest((st.dmax - f.dist) / greatest(1e-8, st.dmax - st.dmin), 0.0), 1.0) END AS s4
  FROM feat f, st),
zs AS (SELECT docid, cid,
  (s1 - avg(s1) OVER w) / (stddev_pop(s1) OVER w + 1e-8) * 1.3 AS z1,
  (s2 - avg(s2) OVER w) / (stddev_pop(s2) OVER w + 1e-8) * 1.3 AS z2,
  (s3 - avg(s3) OVER w) / (stddev_pop(s3) OVER w + 1e-8) * 1.3 AS z3,
  (s4 - avg(s4) OVER w) / (stddev_pop(s4) OVER w + 1e-8) * 1.3 AS z4
  FROM ex WINDOW w AS (PARTITION BY cid)),
bl AS (SELECT docid, cid, 0.0 + z1 * 0.25 + z2 * 0.25 + z3 * 0.25 + z4 * 0.25 AS blended FROM zs)"""
CTE["quota"] = """szq AS (SELECT cid, count(*) AS size FROM de GROUP BY cid),
quota AS (SELECT cid, size, CAST(ceil(1000.0 * size / (SELECT sum(size) FROM szq)) AS BIGINT) AS quota FROM szq)"""
FEAT = ("docs", "unit", "de", "tfidf_de", "density_de", "feat")

ORACLE["docs_with_embeddings"] = q("docs", "unit", "de", body="SELECT docid, CAST(length(doctext) AS BIGINT) AS n_chars, cid FROM de")
ORACLE["tfidf_weights"] = q("docs", "tfidf_docs", body="SELECT docid, term, tf, round(w, 6) AS w FROM tfidf")
ORACLE["top_terms"] = q("docs", "tfidf_docs", body="""SELECT docid, term, term_rank FROM (
  SELECT docid, term, row_number() OVER (PARTITION BY docid ORDER BY w DESC, term ASC) AS term_rank FROM tfidf) WHERE term_rank <= 10""")
ORACLE["tfidf_density"] = q("docs", "unit", "de", "tfidf_de", "density_de", body="SELECT docid, round(density, 6) AS density FROM dens")
ORACLE["lexical_redundancy"] = q("docs", "unit", "de", "tfidf_de", "density_de", body="SELECT docid, round(ni, 6) AS ni FROM nis")
ORACLE["corpus_stats"] = q(*FEAT, body="""SELECT round(tfidf_min, 6) AS tfidf_min, round(tfidf_max, 6) AS tfidf_max,
  round(ni_mean, 6) AS ni_mean, round(ni_std, 6) AS ni_std, round(dmin, 6) AS dmin, round(dmax, 6) AS dmax,
  CAST(max_neighbors AS BIGINT) AS max_neighbors FROM st""")
ORACLE["expert_scores"] = q(*FEAT, body="""SELECT docid, cid, round(s1, 6) AS s1, round(s2, 6) AS s2, round(s3, 6) AS s3,
  round(s4, 6) AS s4 FROM ex""")
ORACLE["cluster_zscore"] = q(*FEAT, body="""SELECT docid, cid, round(z1, 6) AS z1, round(z2, 6) AS z2, round(z3, 6) AS z3,
  round(z4, 6) AS z4 FROM zs""")
ORACLE["blended_score"] = q(*FEAT, body="SELECT docid, cid, round(blended, 6) AS blended FROM bl")
ORACLE["cluster_best_doc"] = q(*FEAT, body="""SELECT cid, docid, round(blended, 6) AS blended FROM (
  SELECT cid, docid, blended, row_number() OVER (PARTITION BY cid ORDER BY round(blended, 9) DESC, docid) AS rn FROM bl) WHERE rn = 1""")
ORACLE["cluster_quota"] = q("docs", "unit", "de", "quota", body="SELECT cid, CAST(size AS BIGINT) AS size, quota FROM quota")
ORACLE["cluster_schedule"] = q("docs", "unit", "de", "quota", body="""SELECT step, cid, visit FROM (
  SELECT cid, j AS visit, CAST(row_number() OVER (ORDER BY CAST(j AS DOUBLE) / quota, cid) AS BIGINT) AS step
  FROM (SELECT cid, quota, unnest(range(0, quota)) AS j FROM quota WHERE quota > 0)) WHERE step <= 1000""")


# --- training and test sets ------------------------------------------------------------------
CTE["kq"] = f"""kq AS (SELECT docid AS qid, question AS qtext, doctext FROM (
  SELECT docid, question, doctext, row_number() OVER (PARTITION BY docid ORDER BY seq DESC) AS rn FROM (
    SELECT docid, seq, {clean_q('question')} AS question, doctext FROM questions)
  WHERE question <> '' AND NOT regexp_matches(question, '[^\\x00-\\x7F]')) WHERE rn = 1)"""
CTE["negs"] = """lk AS (SELECT docid, title || ' ' || body AS text FROM corpus),
drun AS (SELECT * FROM (
  SELECT kq.qid, u.docid, round(list_dot_product(qv.qvec, u.vec), 6) AS score,
         row_number() OVER (PARTITION BY kq.qid ORDER BY round(list_dot_product(qv.qvec, u.vec), 6) DESC, u.docid) AS rank
  FROM kq JOIN qv ON qv.docid = kq.qid, unit u) WHERE rank <= 100),
negs AS (SELECT qid, docid, CAST(neg_no AS BIGINT) AS neg_no, text FROM (
  SELECT r.qid, r.docid, lk.text, row_number() OVER (PARTITION BY r.qid ORDER BY r.pos) AS neg_no FROM (
    SELECT qid, docid, rank - 1 AS pos, count(*) OVER (PARTITION BY qid) AS len FROM drun) r
  LEFT JOIN lk ON lk.docid = r.docid
  WHERE r.pos >= CASE WHEN len - 8 >= 0 THEN len - 8 ELSE greatest(0, 2 * len - 8) END AND lk.text IS NOT NULL)
  WHERE neg_no <= 4),
rtrain AS (
  SELECT qid, CAST(0 AS BIGINT) AS neg_no, qtext AS query, doctext AS doc, CAST(1.0 AS DOUBLE) AS label
  FROM kq WHERE qid IN (SELECT qid FROM negs)
  UNION ALL
  SELECT n.qid, n.neg_no, kq.qtext, n.text, CAST(0.0 AS DOUBLE) FROM negs n JOIN kq ON kq.qid = n.qid)"""
CTE["testset"] = """tl AS (SELECT docid, title || '. ' || body AS text FROM corpus),
pool AS (SELECT DISTINCT docid FROM run),
looked AS (SELECT tl.docid, tl.text FROM pool JOIN tl ON tl.docid = pool.docid WHERE tl.text IS NOT NULL AND tl.text <> ''),
ts AS (SELECT r.qid, q.query,
         coalesce(list({'docid': r.docid, 'text': l.text} ORDER BY r.rank) FILTER (WHERE l.text IS NOT NULL), []) AS passages
       FROM run r LEFT JOIN looked l ON l.docid = r.docid JOIN queries q ON q.qid = r.qid GROUP BY r.qid, q.query),
flat AS (SELECT qid, query, p.docid AS docid, p.text AS text, pos FROM (
  SELECT qid, query, unnest(passages) AS p, generate_subscripts(passages, 1) AS pos FROM ts))"""
CTE["rerank"] = f"""ptf AS (SELECT qid, docid, term, count(*) AS tf FROM (SELECT qid, docid, unnest({words('text')}) AS term FROM flat) GROUP BY qid, docid, term),
pn AS (SELECT qid, docid, sqrt(sum(tf * tf)) AS dn FROM ptf GROUP BY qid, docid),
qtfs AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({words('query')}) AS term FROM (SELECT DISTINCT qid, query FROM flat)) GROUP BY qid, term),
qn AS (SELECT qid, sqrt(sum(qtf * qtf)) AS qn FROM qtfs GROUP BY qid),
dots AS (SELECT p.qid, p.docid, sum(p.tf * q.qtf) AS dot FROM ptf p JOIN qtfs q ON q.qid = p.qid AND q.term = p.term GROUP BY p.qid, p.docid),
cosd AS (SELECT f.qid, f.docid, coalesce(d.dot / (pn.dn * qn.qn), 0.0) AS cos FROM flat f
         LEFT JOIN dots d ON d.qid = f.qid AND d.docid = f.docid LEFT JOIN pn ON pn.qid = f.qid AND pn.docid = f.docid
         LEFT JOIN qn ON qn.qid = f.qid),
rs AS (SELECT qid, docid, a - (greatest(a, b) + ln(exp(a - greatest(a, b)) + exp(b - greatest(a, b)))) AS score
       FROM (SELECT qid, docid, 10.0 * cos AS a, -10.0 * cos AS b FROM cosd)),
rr AS (SELECT qid, docid, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid ASC) - 1 AS BIGINT) AS rank FROM rs)"""
TRAIN = ("docs", "unit", "qvec", "corpus", "questions", "kq", "negs")
TEST = ("corpus", "queries", "bm25", "testset")

ORACLE["tail_negatives"] = q(*TRAIN, body="SELECT qid, docid, neg_no FROM negs")
ORACLE["rerank_train"] = q(*TRAIN, body="SELECT qid, neg_no, query, doc, label FROM rtrain")
ORACLE["triples"] = q(*TRAIN, body="""SELECT n.qid, n.neg_no, kq.qtext AS query, kq.doctext AS positive, n.text AS negative
FROM negs n JOIN kq ON kq.qid = n.qid""")
ORACLE["reranker_inputs"] = q(*TRAIN, body="""SELECT qid, neg_no, 'Query: ' || query || ' Document: ' || doc || ' Relevant:' AS input,
  CASE WHEN label = 1.0 THEN 'true' ELSE 'false' END AS target FROM rtrain""")
ORACLE["rerank_testset"] = q(*TEST, body="""SELECT qid, query, CAST(len(passages) AS BIGINT) AS n_passages,
  array_to_string(list_transform(passages, lambda p: p.docid), ',') AS docids,
  CAST(coalesce(list_sum(list_transform(passages, lambda p: length(p.text))), 0) AS BIGINT) AS text_chars FROM ts""")
ORACLE["explode_testdata"] = q(*TEST, body="""SELECT qid, query, docid AS docno, CAST(pos AS BIGINT) AS pos,
  CAST(length(text) AS BIGINT) AS text_len FROM flat""")
ORACLE["rerank_scores"] = q(*TEST, "rerank", body="SELECT qid, docid, round(score, 6) AS score, rank FROM rr")
ORACLE["rerank_metrics"] = (q(*TEST, "rerank", "qrels", body="") + ",\n"
    + CTE["metrics"].replace("FROM run) r", "FROM (SELECT qid, docid, round(score, 9) AS score FROM rr)) r")
    + """\nSELECT qid, round(ndcg_10, 6) AS ndcg_10, round(recall_100, 6) AS recall_100, round(ap_100, 6) AS ap_100,
  round(rr_10, 6) AS rr_10 FROM per_query""")
ORACLE["predictions_map"] = q(*TEST, "rerank", body="""SELECT qid, n_scored, docid AS best_docid, score AS best_score FROM (
  SELECT qid, docid, round(score, 6) AS score, count(*) OVER (PARTITION BY qid) AS n_scored,
         row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, docid ASC) AS rn FROM rr) WHERE rn = 1""")


# --- sampling --------------------------------------------------------------------------------
CTE["kept"] = f"""kept AS (SELECT e.docid, e.raw, e.cid FROM emb e WHERE e.docid IN (
  SELECT docid FROM dsdocs WHERE length(doctext) >= CASE dataset WHEN 'signal1m' THEN 3 WHEN 'hotpotqa' THEN 150
    WHEN 'quora' THEN 15 WHEN 'climate-fever' THEN 3 ELSE 300 END)),
ksz AS (SELECT cid, count(*) AS size FROM kept GROUP BY cid),
kcm AS (SELECT cid, list(m ORDER BY i) AS center FROM (
  SELECT cid, i, avg(x) AS m FROM (SELECT cid, unnest(raw) AS x, generate_subscripts(raw, 1) AS i FROM kept) GROUP BY cid, i)
  GROUP BY cid),
kcos AS (SELECT k.docid, k.cid, list_dot_product(k.raw, c.center) / ({l_norm('k.raw')} * {l_norm('c.center')}) AS cos
         FROM kept k JOIN kcm c ON c.cid = k.cid)"""
SAMP = ("dsdocs", "unit", "kept")
ORACLE["sample_size_per_cluster"] = q(*SAMP, body=""", kss AS (
  SELECT cid, size, 1 + floor((1000 - (SELECT count(*) FROM ksz)) * size / (SELECT sum(size) FROM ksz)) AS ss FROM ksz),
kr AS (SELECT *, row_number() OVER (ORDER BY size DESC, cid DESC) AS r, (SELECT count(*) FROM ksz) AS k,
              1000 - (SELECT sum(ss) FROM kss) AS rem FROM kss)
SELECT cid, CAST(size AS BIGINT) AS size,
  CAST(least(greatest(ss + CASE WHEN 1000 <> k AND ((rem > 0 AND r <= rem) OR (rem < 0 AND r <= k + rem)) THEN 1 ELSE 0 END, 0), size) AS BIGINT)
    AS sample_size
FROM kr""")
ORACLE["cluster_softmax"] = q(*SAMP, body="""SELECT docid, cid, round(cos, 6) AS cos, round(e / sum(e) OVER (PARTITION BY cid), 6) AS p
FROM (SELECT docid, cid, cos, exp(cos - max(cos) OVER (PARTITION BY cid)) AS e FROM kcos)""")


# --- selection replay: steps, rewards, policy ------------------------------------------------
CTE["steps"] = """sched AS (SELECT step, cid, visit FROM (
  SELECT cid, j AS visit, CAST(row_number() OVER (ORDER BY CAST(j AS DOUBLE) / quota, cid) AS BIGINT) AS step
  FROM (SELECT cid, quota, unnest(range(0, quota)) AS j FROM quota WHERE quota > 0)) WHERE step <= 1000),
best AS (SELECT cid, docid FROM (
  SELECT cid, docid, row_number() OVER (PARTITION BY cid ORDER BY round(blended, 9) DESC, docid) AS rn FROM bl) WHERE rn = 1),
steps AS (SELECT s.step, s.cid, b.docid, qv.qvec, list_transform(u.vec[1:4], lambda x: abs(x)) AS r, u.vec[5:8] AS s
          FROM sched s JOIN best b ON b.cid = s.cid JOIN unit u ON u.docid = b.docid JOIN qv ON qv.docid = b.docid),
log AS (SELECT *, list_sum(r) / 4.0 AS score FROM steps)"""
REPLAY = FEAT + ("qvec", "quota", "steps")


def _policy_sql(mode: str) -> str:
    s = [f"x.s[{i}]" for i in range(1, 5)]
    r = [f"x.r[{i}]" for i in range(1, 5)]
    alpha = "(CASE WHEN CAST(x.step AS DOUBLE) / 1000 <= 0.3 THEN 0.8 ELSE 0.0 END)"
    smean, rmean = f"(({' + '.join(s)}) / 4.0)", f"(({' + '.join(r)}) / 4.0)"
    g = [f"((1.0 - {alpha}) * ({s[i]} - {smean}) + {alpha} * ({r[i]} - {rmean}))" for i in range(4)]
    if mode == "ema":
        adv = "(x.score - x.b)"
        newstate = "(1.0 - 0.05) * x.b + 0.05 * x.score AS b, x.c1, x.c2, x.c3, x.c4, x.c0"
        logged = "(1.0 - 0.05) * x.b + 0.05 * x.score"
    else:
        v = f"(x.c1 * {s[0]} + x.c2 * {s[1]} + x.c3 * {s[2]} + x.c4 * {s[3]} + x.c0)"
        adv = f"(x.score - {v})"
        newstate = "x.b, " + ", ".join(f"x.c{i + 1} + 0.02 * {adv} * {s[i]} AS c{i + 1}" for i in range(4)) + f", x.c0 + 0.02 * {adv} AS c0"
        logged = v
    inner = f"""SELECT x.step, {newstate}, {adv} AS adv, {logged} AS base,
        {', '.join(f'greatest(greatest(x.w{i + 1} + 0.3 * {adv} * {g[i]}, 0.0), 0.05) AS v{i + 1}' for i in range(4))}
      FROM (SELECT l.step, l.s, l.r, l.score, p.w1, p.w2, p.w3, p.w4, p.b, p.c1, p.c2, p.c3, p.c4, p.c0
            FROM pol p JOIN log l ON l.step = p.step + 1) x"""
    vs = "(v1 + v2 + v3 + v4)"
    l2 = f"SELECT *, {', '.join(f'CASE WHEN {vs} > 0 THEN v{i} / {vs} ELSE 0.25 END AS n{i}' for i in range(1, 5))} FROM ({inner})"
    l3 = f"SELECT *, {', '.join(f'0.9 * n{i} + 0.025 AS e{i}' for i in range(1, 5))} FROM ({l2})"
    es = "(e1 + e2 + e3 + e4)"
    l4 = (f"SELECT step, {', '.join(f'CASE WHEN {es} > 0 THEN e{i} / {es} ELSE 0.25 END AS w{i}' for i in range(1, 5))}, "
          f"b, c1, c2, c3, c4, c0, adv, base FROM ({l3})")
    return f"""pol(step, w1, w2, w3, w4, b, c1, c2, c3, c4, c0, adv, base) AS (
  SELECT CAST(0 AS BIGINT), 0.25::DOUBLE, 0.25::DOUBLE, 0.25::DOUBLE, 0.25::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE,
         0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE
  UNION ALL
  {l4})"""


def _recursive(*names: str, pol: str, body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(CTE[n] for n in names) + ",\n" + pol + "\n" + body


_POL_OUT = """SELECT step, round(w1, 6) AS w1, round(w2, 6) AS w2, round(w3, 6) AS w3, round(w4, 6) AS w4,
  round(adv, 6) AS advantage, round(base, 6) AS baseline FROM pol WHERE step > 0"""
ORACLE["replay_steps"] = q(*REPLAY, body="SELECT step, cid, docid, round(score, 6) AS score FROM log")
ORACLE["policy_replay_ema"] = _recursive(*REPLAY, pol=_policy_sql("ema"), body=_POL_OUT)
ORACLE["policy_replay_critic"] = _recursive(*REPLAY, pol=_policy_sql("critic"), body=_POL_OUT)
ORACLE["reward_curve"] = _recursive(*REPLAY, pol=_policy_sql("ema"), body="""SELECT CAST(floor((l.step - 1) / 10) AS BIGINT) AS bucket,
  count(*) AS n_steps, round(avg(l.r[1]), 6) AS mean_r1, round(avg(l.r[2]), 6) AS mean_r2, round(avg(l.r[3]), 6) AS mean_r3,
  round(avg(l.r[4]), 6) AS mean_r4, round(avg(l.score), 6) AS mean_score, round(avg(p.adv), 6) AS mean_advantage,
  round(avg(p.base), 6) AS mean_baseline
FROM log l JOIN pol p ON p.step = l.step GROUP BY 1""")
ORACLE["rank_reward"] = q(*REPLAY, body=""", own AS (SELECT s.step, s.docid, s.qvec, list_dot_product(s.qvec, u.vec) AS own FROM steps s JOIN unit u ON u.docid = s.docid),
cnt AS (SELECT o.step, count(c.docid) AS cnt FROM own o LEFT JOIN de c ON c.docid <> o.docid AND
          (round(list_dot_product(o.qvec, c.vec), 6) > round(o.own, 6) OR (round(list_dot_product(o.qvec, c.vec), 6) = round(o.own, 6) AND c.docid < o.docid)) GROUP BY o.step),
rk AS (SELECT o.step, o.docid, least(coalesce(cnt.cnt, 0) + 1, 101) AS rank FROM own o LEFT JOIN cnt ON cnt.step = o.step)
SELECT step, docid, CAST(rank AS BIGINT) AS rank, round(exp(-(rank - 1) / 18.0), 6) AS r1 FROM rk""")
ORACLE["discriminative_reward"] = q(*REPLAY, body=""", ncl AS (SELECT cid, near_cid FROM (
  SELECT a.cid, b.cid AS near_cid, row_number() OVER (PARTITION BY a.cid ORDER BY round(list_dot_product(a.c, b.c), 6) DESC,
         b.cid) AS rn
  FROM (SELECT cid, list_transform(center, lambda x: x / greatest(sqrt(list_sum(list_transform(center, lambda y: y * y))), 1e-12)) AS c FROM dm) a
  JOIN (SELECT cid, list_transform(center, lambda x: x / greatest(sqrt(list_sum(list_transform(center, lambda y: y * y))), 1e-12)) AS c FROM dm) b
    ON a.cid <> b.cid) WHERE rn = 1),
sx AS (SELECT s.step, s.docid, s.cid, coalesce(n.near_cid, s.cid) AS near_cid, s.qvec, list_dot_product(s.qvec, u.vec) AS cos_qp
       FROM steps s LEFT JOIN ncl n ON n.cid = s.cid JOIN unit u ON u.docid = s.docid),
same AS (SELECT sx.step, max(list_dot_product(sx.qvec, d.vec)) AS cos_same FROM sx JOIN de d ON d.cid = sx.cid AND d.docid <> sx.docid GROUP BY sx.step),
nearm AS (SELECT sx.step, max(list_dot_product(sx.qvec, d.vec)) AS cos_near FROM sx JOIN de d ON d.cid = sx.near_cid AND (d.docid <> sx.docid OR sx.near_cid = sx.cid) GROUP BY sx.step)
SELECT sx.step, sx.docid, round(cos_qp, 6) AS cos_qp, round(coalesce(cos_same, cos_qp), 6) AS cos_same,
  round(coalesce(cos_near, cos_qp), 6) AS cos_near,
  round(cos_qp * (1 - coalesce(cos_same, cos_qp)) * (1 - coalesce(cos_near, cos_qp)), 6) AS r2
FROM sx LEFT JOIN same ON same.step = sx.step LEFT JOIN nearm ON nearm.step = sx.step""")
ORACLE["answer_reward"] = q(*REPLAY, body=f""", av AS (SELECT a.docid, list_transform(generate_series(1, len(a.raw)), lambda i: a.raw[i] + b.raw[i]) AS s
  FROM emb a JOIN emb b ON b.vec_id = (a.vec_id * 11 + 3) % (SELECT count(*) FROM emb)),
avn AS (SELECT docid, list_transform(s, lambda x: x / nrm) AS avec FROM (SELECT docid, s, greatest({l_norm('s')}, 1e-12) AS nrm FROM av))
SELECT s.step, s.docid, round(list_dot_product(s.qvec, a.avec) * list_dot_product(u.vec, a.avec)
  * (1.0 - abs(list_dot_product(s.qvec, u.vec) - 0.7)), 6) AS r3
FROM steps s JOIN unit u ON u.docid = s.docid JOIN avn a ON a.docid = s.docid""")
ORACLE["coverage_reward"] = q(*REPLAY, body=""", touched AS (SELECT DISTINCT step, doc FROM (
  SELECT s.step, d.docid AS doc FROM steps s JOIN de d ON list_dot_product(s.qvec, d.vec) > 0.30
  UNION ALL SELECT step, docid AS doc FROM steps)),
t AS (SELECT tc.step, tc.doc, d.cid AS dcid, s.cid AS scid, s.docid AS sdoc
      FROM touched tc JOIN de d ON d.docid = tc.doc JOIN steps s ON s.step = tc.step),
fc AS (SELECT docid AS doc, min(step) AS chosen_at FROM steps GROUP BY docid),
ra AS (SELECT doc, min(step) AS removed_at FROM t WHERE doc = sdoc OR dcid = scid GROUP BY doc),
ps AS (SELECT t.step,
         sum(CASE WHEN fc.chosen_at IS NULL OR fc.chosen_at >= t.step THEN 1 ELSE 0 END) AS global_new,
         sum(CASE WHEN t.dcid = t.scid AND (ra.removed_at IS NULL OR ra.removed_at >= t.step) THEN 1 ELSE 0 END) AS add_c
       FROM t LEFT JOIN fc ON fc.doc = t.doc LEFT JOIN ra ON ra.doc = t.doc GROUP BY t.step),
cb AS (SELECT s.step, (SELECT count(*) FROM fc WHERE fc.chosen_at < s.step) AS n_covered FROM steps s),
rb AS (SELECT s.step, (SELECT count(*) FROM ra JOIN de d ON d.docid = ra.doc WHERE d.cid = s.cid AND ra.removed_at < s.step) AS n_removed
       FROM steps s),
csz AS (SELECT cid, count(*) AS csize FROM de GROUP BY cid),
nn AS (SELECT count(*) AS n FROM de)
SELECT s.step, s.docid, CAST(coalesce(ps.global_new, 0) AS BIGINT) AS global_new, CAST(coalesce(ps.add_c, 0) AS BIGINT) AS add_c,
  round((csz.csize / CAST(nn.n AS DOUBLE)) * coalesce(ps.add_c, 0) / greatest(csz.csize - rb.n_removed, 1)
        + (1.0 - csz.csize / CAST(nn.n AS DOUBLE)) * coalesce(ps.global_new, 0) / greatest(nn.n - cb.n_covered, 1), 6) AS r4
FROM steps s LEFT JOIN ps ON ps.step = s.step JOIN cb ON cb.step = s.step JOIN rb ON rb.step = s.step
JOIN csz ON csz.cid = s.cid, nn""")
ORACLE["dynamic_dup_threshold"] = q(*REPLAY, body=f""", cand AS (
  SELECT s.step, CAST(c.cand AS INTEGER) AS cand, (s.step - 1) * 5 + c.cand AS seq, s.docid,
         (CAST(s.docid AS BIGINT) * 7 + 1 + c.cand * 13) % (SELECT count(*) FROM emb) AS partner
  FROM steps s, (SELECT unnest(range(0, 5)) AS cand) c),
cv AS (SELECT c.step, c.cand, c.seq, list_transform(generate_series(1, len(a.raw)), lambda i: a.raw[i] + b.raw[i]) AS s
       FROM cand c JOIN emb a ON a.docid = c.docid JOIN emb b ON b.vec_id = c.partner),
cvn AS (SELECT step, cand, seq, list_transform(s, lambda x: x / nrm) AS qv FROM (SELECT *, greatest({l_norm('s')}, 1e-12) AS nrm FROM cv)),
bm AS (SELECT a.step, a.cand, a.seq, round(max(list_dot_product(a.qv, b.qv)), 9) AS value
       FROM cvn a JOIN cvn b ON b.cand = 0 AND b.step < a.step GROUP BY a.step, a.cand, a.seq),
th AS (SELECT *, count(value) OVER w AS n_prev, quantile_cont(value, 0.75) OVER w AS qt
       FROM bm WINDOW w AS (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT step, cand, round(value, 6) AS value, round(thr, 6) AS threshold, value >= thr AS is_dup FROM (
  SELECT *, CASE WHEN n_prev >= 5 THEN least(greatest(qt, 0.88), 0.95) ELSE 0.90 END AS thr FROM th)""")
ORACLE["best_candidate"] = q(*REPLAY, body=f""", cand AS (
  SELECT s.step, CAST(c.cand AS INTEGER) AS cand, (s.step - 1) * 5 + c.cand AS seq, s.docid,
         (CAST(s.docid AS BIGINT) * 7 + 1 + c.cand * 13) % (SELECT count(*) FROM emb) AS partner
  FROM steps s, (SELECT unnest(range(0, 5)) AS cand) c),
cv AS (SELECT c.step, c.cand, c.seq, list_transform(generate_series(1, len(a.raw)), lambda i: a.raw[i] + b.raw[i]) AS s
       FROM cand c JOIN emb a ON a.docid = c.docid JOIN emb b ON b.vec_id = c.partner),
cvn AS (SELECT step, cand, seq, list_transform(s, lambda x: x / nrm) AS qv FROM (SELECT *, greatest({l_norm('s')}, 1e-12) AS nrm FROM cv)),
bm AS (SELECT a.step, a.cand, a.seq, round(max(list_dot_product(a.qv, b.qv)), 9) AS value
       FROM cvn a JOIN cvn b ON b.cand = 0 AND b.step < a.step GROUP BY a.step, a.cand, a.seq),
th AS (SELECT *, count(value) OVER w AS n_prev, quantile_cont(value, 0.75) OVER w AS qt
       FROM bm WINDOW w AS (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
dup AS (SELECT step, cand, value >= (CASE WHEN n_prev >= 5 THEN least(greatest(qt, 0.88), 0.95) ELSE 0.90 END) AS is_dup FROM th),
sc AS (SELECT c.step, c.cand, c.cand = 4 AS reserve, coalesce(d.is_dup, false) AS is_dup,
         (round(abs(c.qv[1]), 9) + round(abs(c.qv[2]), 9) + round(abs(c.qv[3]), 9) + round(abs(c.qv[4]), 9)) / 4.0 AS score
       FROM cvn c LEFT JOIN dup d ON d.step = c.step AND d.cand = c.cand)
SELECT step, cand, reserve, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY step ORDER BY CASE WHEN reserve THEN 1 WHEN is_dup THEN 2 ELSE 0 END, score DESC, cand) AS rn FROM sc) WHERE rn = 1""")
ORACLE["run_stats"] = q(*REPLAY, body=""", kk AS (SELECT max(cid) + 1 AS k FROM de),
cs AS (SELECT r.range AS cid, coalesce(n, 0) AS n FROM range(0, (SELECT k FROM kk)) r
       LEFT JOIN (SELECT cid, count(*) AS n FROM de GROUP BY cid) c ON c.cid = r.range)
SELECT CAST((SELECT k FROM kk) AS INTEGER) AS K, CAST(sum(n) AS BIGINT) AS num_docs, CAST(1000 AS BIGINT) AS generated,
  CAST((SELECT count(*) FROM log) AS BIGINT) AS produced, string_agg(CAST(n AS VARCHAR), ',' ORDER BY cid) AS cluster_sizes FROM cs""")
ORACLE["stream_progress"] = _recursive(*REPLAY, pol=_policy_sql("ema"), body="""SELECT l.cid, count(*) AS n_steps,
  round(avg(l.score), 6) AS mean_score, round(avg(p.adv), 6) AS mean_advantage, max(l.step) AS last_step
FROM log l JOIN pol p ON p.step = l.step GROUP BY l.cid""")


# --- model-facing operators ------------------------------------------------------------------
CTE["tk"] = """tk AS (SELECT docid, list(term ORDER BY term_rank) AS keys FROM (
  SELECT docid, term, row_number() OVER (PARTITION BY docid ORDER BY w DESC, term ASC) AS term_rank FROM tfidf)
  WHERE term_rank <= 10 GROUP BY docid)"""
MODEL = ("docs", "unit", "de", "tfidf_de", "tk")
ORACLE["answer_snippet"] = q(*MODEL, body=f""", sn AS (SELECT de.docid, de.doctext, {py_split('de.doctext')} AS toks, coalesce(tk.keys, []) AS keys
  FROM de LEFT JOIN tk ON tk.docid = de.docid),
ws AS (SELECT docid, unnest(generate_series(0, len(toks) - 70, 35)) AS s FROM sn WHERE len(toks) > 70),
wsc AS (SELECT w.docid, w.s,
          len(list_filter(x.keys, lambda k: strpos(lower(array_to_string(x.toks[w.s + 1:w.s + 70], ' ')), k) > 0)) AS score
        FROM ws w JOIN sn x ON x.docid = w.docid),
best AS (SELECT docid, s FROM (SELECT docid, s, row_number() OVER (PARTITION BY docid ORDER BY score DESC, s ASC) AS rn FROM wsc)
         WHERE rn = 1)
SELECT x.docid, CAST(CASE WHEN len(x.toks) > 70 THEN b.s ELSE -1 END AS BIGINT) AS start,
  CASE WHEN len(x.toks) > 70 THEN array_to_string(x.toks[b.s + 1:b.s + 70], ' ') ELSE x.doctext END AS snippet
FROM sn x LEFT JOIN best b ON b.docid = x.docid""")
ORACLE["generate_candidates"] = q(*MODEL, body=""", c AS (SELECT docid, keys, CAST(unnest(range(0, 5)) AS INTEGER) AS cand FROM tk),
p AS (SELECT docid, cand, keys[cand * 2 + 1:cand * 2 + 2] AS pr FROM c)
SELECT docid, cand, CASE WHEN len(pr) >= 2 THEN 'How does ' || pr[1] || ' relate to ' || pr[2] || ' in this passage?'
                         WHEN len(pr) = 1 THEN 'What is ' || pr[1] || ' in this passage?'
                         ELSE 'How does the described effect occur and under what conditions?' END AS question FROM p""")
ORACLE["late_interaction"] = q("unit", "qvec", body=""", run AS (SELECT qid, docid FROM (
  SELECT q.docid AS qid, u.docid, row_number() OVER (PARTITION BY q.docid ORDER BY round(list_dot_product(q.qvec, u.vec), 6) DESC, u.docid) AS rk
  FROM qv q, unit u) WHERE rk <= 10),
qt AS (SELECT docid AS qid, p AS qpos, qvec[p * 8 + 1:p * 8 + 8] AS qv FROM qv, (SELECT unnest(range(0, 8)) AS p)),
dt AS (SELECT docid, p AS dpos, raw[p * 8 + 1:p * 8 + 8] AS dv FROM unit, (SELECT unnest(range(0, 8)) AS p) WHERE (vec_id + p) % 5 <> 0),
pq AS (SELECT r.qid, r.docid, qt.qpos, max(-list_sum(list_transform(generate_series(1, 8), lambda i: (qt.qv[i] - dt.dv[i]) * (qt.qv[i] - dt.dv[i])))) AS best
       FROM run r JOIN qt ON qt.qid = r.qid JOIN dt ON dt.docid = r.docid GROUP BY r.qid, r.docid, qt.qpos)
SELECT qid, docid, round(sum(best), 6) AS maxsim FROM pq GROUP BY qid, docid""")


# --- collection status, positional zip, K grid ------------------------------------------------
ORACLE["dataset_counts"] = q("dsdocs", "questions", "qrels", body="""SELECT d.dataset, count(*) AS n_docs,
  coalesce(max(qn.n), 0) AS n_questions, coalesce(max(jn.n), 0) AS n_judged_queries
FROM dsdocs d
LEFT JOIN (SELECT dd.dataset, count(*) AS n FROM questions q JOIN dsdocs dd ON dd.docid = q.docid GROUP BY dd.dataset) qn ON qn.dataset = d.dataset
LEFT JOIN (SELECT dd.dataset, count(DISTINCT r.qid) AS n FROM qrels r JOIN dsdocs dd ON dd.docid = r.docid GROUP BY dd.dataset) jn ON jn.dataset = d.dataset
GROUP BY d.dataset""")
ORACLE["completeness_check"] = q("dsdocs", body="SELECT dataset, count(*) AS n_docs, count(*) > 100 AS complete FROM dsdocs GROUP BY dataset")
ORACLE["artifact_coverage"] = q("dsdocs", body="""SELECT d.dataset, count(*) AS n_docs, count(e.vec_id) AS n_embedded,
  count(*) > 0 AS has_documents, count(e.vec_id) > 0 AS has_embeddings
FROM dsdocs d LEFT JOIN embeddings e ON CAST(e.vec_id AS VARCHAR) = d.docid GROUP BY d.dataset""")
ORACLE["zip_positional"] = """WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS docid, row_number() OVER (ORDER BY doc_id) - 1 AS seq
  FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings)),
e AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS seq FROM embeddings)
SELECT CAST(d.seq AS BIGINT) AS seq, d.docid, e.vec_id FROM d JOIN e ON e.seq = d.seq"""
ORACLE["candidate_k_grid"] = """WITH n AS (SELECT count(*) AS n FROM embeddings),
g AS (SELECT DISTINCT unnest([greatest(8, CAST(floor(sqrt(n)) AS BIGINT)), greatest(8, n // 80), greatest(8, n // 60),
                               greatest(8, n // 40), greatest(8, n // 20)]) AS k FROM n)
SELECT CAST(k AS INTEGER) AS k FROM g WHERE k < least((SELECT n FROM n), 5000)"""
ORACLE["question_dup_edges"] = q(*REPLAY, body=f""", cand AS (
  SELECT s.step, c.cand, (s.step - 1) * 5 + c.cand AS seq, s.docid,
         (CAST(s.docid AS BIGINT) * 7 + 1 + c.cand * 13) % (SELECT count(*) FROM emb) AS partner
  FROM steps s, (SELECT unnest(range(0, 5)) AS cand) c),
cv AS (SELECT c.step, c.cand, c.seq, list_transform(generate_series(1, len(a.raw)), lambda i: a.raw[i] + b.raw[i]) AS s
       FROM cand c JOIN emb a ON a.docid = c.docid JOIN emb b ON b.vec_id = c.partner),
cvn AS (SELECT CAST(step AS VARCHAR) || ':' || CAST(cand AS VARCHAR) AS k, seq, list_transform(s, lambda x: x / nrm) AS qv
        FROM (SELECT *, greatest({l_norm('s')}, 1e-12) AS nrm FROM cv))
SELECT a.k AS later, b.k AS earlier, round(list_dot_product(a.qv, b.qv), 6) AS cos
FROM cvn a JOIN cvn b ON b.seq < a.seq AND list_dot_product(a.qv, b.qv) >= 0.5""")
ORACLE["sorted_selected"] = q(*REPLAY, body="""SELECT docid, CAST(row_number() OVER (ORDER BY CAST(docid AS BIGINT)) AS BIGINT) AS ord
FROM (SELECT DISTINCT docid FROM log)""")
