"""Retrieval queries (G1-G14, C23, H3, H10, H11) over documents and the benchmark corpus.

Claims are the documents; the retrieval corpus is the benchmark passages chunked
with the sentence chunker (every benchmark passage is shorter than one chunk).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from claimlens.functions.text import TOKEN, english_stop_words
from claimlens.operators import chunking as CH
from claimlens.operators import neighbours as NB
from claimlens.operators import retrieval as RT
from claimlens.operators import risk as RK
from claimlens.plans.registry import register
from claimlens.plans.sqlparts import TXT
from claimlens.sources.claims import claims_txt
from claimlens.sources.tables import table
from claimlens.session import materialize

K = 5


def corpus_chunks(spark, sf):
    b = table(spark, sf, "benchmark").withColumn("title", F.concat(F.lit("Passage "), F.col("item_id").cast("string")))
    return CH.chunk_table(b, "item_id", "text", "sentence", keep=["title"])


def claim_texts(spark, sf):
    return claims_txt(spark, sf, ["claim_id", "esg_claim_text"])


def hits(spark, sf, k=K, chunks=None, claims=None):
    c = claims if claims is not None else claim_texts(spark, sf)
    return RT.search_topk(c, "claim_id", "esg_claim_text", chunks if chunks is not None else corpus_chunks(spark, sf), k)


def _stop_sql():
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in english_stop_words()) + "]"


def _terms_sql(rel, id_expr, text):
    stop = _stop_sql()
    return f"""(SELECT id, unnest(t || list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS term
   FROM (SELECT {id_expr} AS id,
                list_filter(regexp_extract_all(lower({text}), '{TOKEN}'), lambda x: NOT list_contains({stop}, x)) AS t
         FROM {rel}))"""


def _tfidf_ctes(prefix, rel, id_expr, text, max_features=5000, min_df=1, max_df=1.0):
    return f"""{prefix}_terms AS {_terms_sql(rel, id_expr, text)},
{prefix}_n AS (SELECT count(*)::DOUBLE AS n FROM {rel}),
{prefix}_tf AS (SELECT id, term, count(*) AS tf FROM {prefix}_terms GROUP BY id, term),
{prefix}_st AS (SELECT term, count(*) AS df, sum(tf) AS total FROM {prefix}_tf GROUP BY term),
{prefix}_vocab AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM {prefix}_st, {prefix}_n
                   WHERE df <= {max_df} * n AND df >= {min_df} ORDER BY total DESC, term LIMIT {max_features}),
{prefix}_w AS (SELECT id, term, tf * idf AS w FROM {prefix}_tf JOIN {prefix}_vocab USING (term)),
{prefix}_vec AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM {prefix}_w)"""


HITS_SQL_CTES = TXT.rstrip("\n") + ",\n" + _tfidf_ctes("c", "benchmark", "CAST(item_id AS VARCHAR) || ':0'", "text") + f""",
q_terms AS {_terms_sql('claims', 'claim_id', 'esg_claim_text')},
q_tf AS (SELECT id, term, count(*) AS tf FROM q_terms JOIN c_vocab USING (term) GROUP BY id, term),
q_w AS (SELECT id, term, tf * idf AS w FROM q_tf JOIN c_vocab USING (term)),
q_vec AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM q_w),
dots AS (SELECT q.id AS claim_id, c.id AS chunk_uid, sum(q.w * c.w) AS score FROM q_vec q JOIN c_vec c USING (term)
         GROUP BY q.id, c.id),
ranked AS (SELECT claim_id, chunk_uid, round(score, 6) AS score,
                  CAST(row_number() OVER (PARTITION BY claim_id ORDER BY round(score, 6) DESC, chunk_uid) AS INTEGER) AS rank
           FROM dots WHERE score > 0),
hits AS (SELECT * FROM ranked WHERE rank <= {K})
"""

register("tfidf_search_topk", HITS_SQL_CTES + "SELECT claim_id, chunk_uid, score, rank FROM hits")(hits)


def _search_pairs(spark, sf):
    """Work of the search: chunks scored for each claim, of those that share a term with it."""
    return RT.search_pairs(claim_texts(spark, sf), "claim_id", "esg_claim_text", corpus_chunks(spark, sf), K)


register("search_pairs")(_search_pairs)


# ---------------------------------------------------------------- C23 corpus term weights (baseline TF-IDF settings)
def _tfidf_terms(spark, sf):
    p = RT.TfidfParams(max_features=5000, ngram=(1, 2), min_df=2, max_df=0.95)
    d = table(spark, sf, "documents")
    _, vec = RT.corpus_vectors(d, p, "doc_id", "text")
    return RT.term_weights(vec, 20)


register("tfidf_terms", "WITH " + _tfidf_ctes("d", "documents", "doc_id", "text", 5000, 2, 0.95) + """
SELECT term, round(sum(w), 6) AS weight FROM d_vec GROUP BY term ORDER BY weight DESC, term LIMIT 20""")(_tfidf_terms)


# ---------------------------------------------------------------- G6 / G7 dense search against label centroids
def _dense(metric):
    def q(spark, sf):
        e = table(spark, sf, "embeddings")
        cents = RT.centroids(e, "label")
        return RT.dense_topk(e, "vec_id", cents, "label", "centroid", K, metric)
    return q


_CENT = """WITH ex AS (SELECT label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
dims AS (SELECT label, i, avg(v[i]) AS x FROM ex, range(1, 65) r(i) WHERE i <= len(v) GROUP BY label, i),
cent AS (SELECT label, list(x ORDER BY i) AS c FROM dims GROUP BY label)"""
register("dense_topk_ip", _CENT + f""",
s AS (SELECT c.label, e.vec_id, round(list_sum(list_transform(range(1, len(c.c) + 1), lambda i: c.c[i] * e.v[i])), 6) AS score
      FROM cent c, (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) e),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT label, vec_id, score, rank FROM r WHERE rank <= {K}""")(_dense("ip"))
register("dense_topk_l2", _CENT + f""",
s AS (SELECT c.label, e.vec_id,
             round(sqrt(list_sum(list_transform(range(1, len(c.c) + 1), lambda i: (c.c[i] - e.v[i]) * (c.c[i] - e.v[i])))), 6) AS score
      FROM cent c, (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) e),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY score ASC, vec_id) AS INTEGER) AS rank FROM s)
SELECT label, vec_id, score, rank FROM r WHERE rank <= {K}""")(_dense("l2"))


# ---------------------------------------------------------------- G6 with cells: approximate, and exact by bounds
PROBES = 0.7


def _cell_search(spark, sf, exact):
    """The K nearest rows of every row whose id is divisible by 20 (the stated queries), among all rows."""
    rows = NB.usable(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return NB.search(NB.index(rows), rows.where(F.col("id") % 20 == 0), K, PROBES, exact)


def _half_up(c):
    return F.floor(F.col(c) * 1e6 + 0.5) / 1e6


def _exact_search(spark, sf):
    return _cell_search(spark, sf, True).select("query_id", "rank", F.col("id").alias("vec_id"), _half_up("distance").alias("distance"))


def _approximate_search(spark, sf):
    return _cell_search(spark, sf, False).select("query_id", "rank", F.col("id").alias("vec_id"), _half_up("distance").alias("distance"))


def _approximate_recall(spark, sf):
    return NB.recall(_cell_search(spark, sf, False), _cell_search(spark, sf, True)).withColumn("probes", F.lit(PROBES))


register("cell_search_exact", """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
d AS (SELECT a.vec_id AS query_id, b.vec_id, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, floor(d * 1e6 + 0.5) / 1e6 AS distance FROM d
WINDOW w AS (PARTITION BY query_id ORDER BY d, vec_id) QUALIFY row_number() OVER w <= 5""")(_exact_search)
register("cell_search_approximate")(_approximate_search)
register("cell_search_recall")(_approximate_recall)


# ---------------------------------------------------------------- G9 context, G10 prompt
def _hits_and_context(spark, sf):
    """One search: the written hits (k rows a claim) and the context assembled from them."""
    ch = materialize(corpus_chunks(spark, sf))  # chunked once, used by the search and for the texts
    found = materialize(hits(spark, sf, chunks=ch))
    return found, RT.context(found, ch, "claim_id")


def _context(spark, sf):
    return _hits_and_context(spark, sf)[1]


_CTX_SQL = HITS_SQL_CTES.rstrip("\n") + """,
hj AS (SELECT h.*, b.text FROM hits h JOIN benchmark b ON h.chunk_uid = CAST(b.item_id AS VARCHAR) || ':0'),
ctx AS (SELECT claim_id,
          string_agg(printf('Document %d (Score: %s):\n%s', rank, score3, text), chr(10) || chr(10) ORDER BY rank) AS context,
          count(*) AS retrieved_documents, arg_min(score, rank) AS top_document_score
        FROM (SELECT *, CAST((CAST(round(score * 1000000) AS BIGINT) + 500) // 1000 // 1000 AS VARCHAR) || '.' ||
                        lpad(CAST((CAST(round(score * 1000000) AS BIGINT) + 500) // 1000 % 1000 AS VARCHAR), 3, '0') AS score3
              FROM hj) GROUP BY claim_id)
"""
register("context_assembly", _CTX_SQL + "SELECT claim_id, context, retrieved_documents, top_document_score FROM ctx")(_context)


def _prompt(spark, sf):
    c = claim_texts(spark, sf)
    ctx = _context(spark, sf)
    j = c.join(ctx, "claim_id")
    return j.select("claim_id", RT.prompt(F.col("context"), F.col("esg_claim_text")).alias("prompt"))


def _prompt_sql():
    t = RT.PROMPT_TEMPLATE.replace("{{", "\x00").replace("}}", "\x01")
    head, rest = t.split("{context}")
    mid, tail = rest.split("{claim}")
    lit = lambda s: "'" + s.replace("\x00", "{").replace("\x01", "}").replace("'", "''") + "'"
    return _CTX_SQL + f"""SELECT c.claim_id, {lit(head)} || x.context || {lit(mid)} || c.esg_claim_text || {lit(tail)} AS prompt
FROM claims c JOIN ctx x ON c.claim_id = x.claim_id"""


register("prompt_table", _prompt_sql())(_prompt)


# ---------------------------------------------------------------- G11 response parsing
def _parse(spark, sf):
    ev = table(spark, sf, "events").select("event_id", F.col("props").alias("raw"))
    p = RT.parse_response(F.col("raw"))
    return ev.select("event_id", p["kpi"].alias("kpi"), p["risk_score"].alias("risk_score"),
                     F.length(p["rationale"]).alias("rationale_chars"),
                     F.size(p["regulatory_issues"]).alias("n_issues"))


register("llm_json_parse", """
SELECT event_id,
  CASE WHEN json_valid(props) AND json_type(props) = 'OBJECT' THEN props->>'kpi' ELSE 'Unable to extract' END AS kpi,
  CASE WHEN json_valid(props) AND json_type(props) = 'OBJECT' THEN TRY_CAST(props->>'risk_score' AS DOUBLE) ELSE 0.5 END AS risk_score,
  CAST(CASE WHEN json_valid(props) AND json_type(props) = 'OBJECT' THEN length(props->>'rationale') ELSE length(props) END AS INTEGER) AS rationale_chars,
  CAST(CASE WHEN json_valid(props) AND json_type(props) = 'OBJECT' THEN json_array_length(props->'regulatory_issues') ELSE 0 END AS INTEGER) AS n_issues
FROM events""")(_parse)


def _parse_text(spark, sf):
    cv = table(spark, sf, "conversations").where(F.col("role") == "assistant")
    p = RT.parse_response(F.col("text"))
    return cv.select("conv_id", "turn", p["kpi"].alias("kpi"), p["risk_score"].alias("risk_score"),
                     F.length(p["rationale"]).alias("rationale_chars"), F.size(p["recommendations"]).alias("n_recs"))


register("llm_text_fallback", """
SELECT conv_id, turn,
  CASE WHEN NOT json_valid(text) THEN 'Unable to extract' WHEN json_type(text) = 'OBJECT' THEN text->>'kpi' ELSE 'Unable to extract' END AS kpi,
  CASE WHEN NOT json_valid(text) THEN 0.5 WHEN json_type(text) = 'OBJECT' THEN TRY_CAST(text->>'risk_score' AS DOUBLE) ELSE 0.5 END AS risk_score,
  CAST(CASE WHEN NOT json_valid(text) THEN length(text) WHEN json_type(text) = 'OBJECT' THEN length(text->>'rationale') ELSE length(text) END AS INTEGER) AS rationale_chars,
  CAST(CASE WHEN NOT json_valid(text) THEN 0 WHEN json_type(text) = 'OBJECT' THEN json_array_length(text->'recommendations') ELSE 0 END AS INTEGER) AS n_recs
FROM conversations WHERE role = 'assistant'""")(_parse_text)


# ---------------------------------------------------------------- G12-G14 + H9-H11: notebook claim analysis
def _rag_analysis(spark, sf, claims=None):
    c = claims if claims is not None else claim_texts(spark, sf)
    ch = materialize(corpus_chunks(spark, sf))  # chunked once, used by the search and for titles
    s = RK.with_lower(RT.hit_summary(c, hits(spark, sf, chunks=ch, claims=c), ch, "claim_id", title="title"), "esg_claim_text")
    t = F.col("esg_claim_text")
    kc = RK.keyword_counts(t, lt=F.col(RK.LOWER))
    issues = RK.keyword_issues(t, lt=F.col(RK.LOWER))
    s = s.withColumns({"_gw": kc["greenwashing_indicators"], "_n_issues": F.size(issues),
                       "_esg": kc["environmental"] + kc["social"] + kc["governance"]})
    risk = RK.weighted_risk(t, "n_hits", "mean_score", "_gw", "_n_issues")
    s = s.withColumn("risk_score", risk)
    return s.select("claim_id", F.round("risk_score", 6).alias("risk_score"),
                    F.round(1 - F.col("risk_score"), 6).alias("compliance_score"),
                    F.col("n_hits").cast("bigint").alias("n_hits"),
                    F.concat_ws("|", "relevant_standards").alias("relevant_standards"),
                    F.concat_ws("|", RK.notebook_recommendations(t, F.col("risk_score"), F.col("_esg")))
                    .alias("recommendations"))


def _rag_analysis_sql():
    from claimlens.functions import lexicons as L
    from claimlens.functions.text import DIGIT
    from claimlens.plans.q_risk import _ISSUES_SQL, _count
    lt = "lower(c.esg_claim_text)"
    fam = L.ESG_KEYWORDS
    gw = _count(lt, fam["greenwashing_indicators"])
    iss = f"len({_ISSUES_SQL.replace('lower(esg_claim_text)', lt).replace('(esg_claim_text,', '(c.esg_claim_text,')})"
    esg = f"({_count(lt, fam['environmental'])} + {_count(lt, fam['social'])} + {_count(lt, fam['governance'])})"
    R = L.NOTEBOOK_RECS
    return HITS_SQL_CTES.rstrip("\n") + f""",
hs AS (SELECT h.claim_id, count(*) AS n_hits, avg(h.score) AS mean_score,
              string_agg('Passage ' || split_part(h.chunk_uid, ':', 1), '|' ORDER BY h.rank) FILTER (WHERE h.rank <= 3) AS rel
       FROM hits h GROUP BY h.claim_id),
f AS (SELECT c.claim_id, c.esg_claim_text AS t, coalesce(hs.n_hits, 0) AS n_hits, hs.mean_score, coalesce(hs.rel, '') AS rel,
             {gw} AS gw, {iss} AS n_issues, {esg} AS esg, length(c.esg_claim_text) AS n,
             regexp_matches(c.esg_claim_text, '{DIGIT}') AS dig
      FROM claims c LEFT JOIN hs ON c.claim_id = hs.claim_id),
r AS (SELECT *, least(0.0::DOUBLE + (CASE WHEN n_hits > 0 THEN 1.0::DOUBLE - mean_score ELSE 0.8::DOUBLE END) * 0.3::DOUBLE
                    + least(gw * 0.2::DOUBLE, 1.0::DOUBLE) * 0.25::DOUBLE + least(n_issues * 0.15::DOUBLE, 1.0::DOUBLE) * 0.2::DOUBLE
                    + coalesce((CASE WHEN n < 50 THEN 0.3::DOUBLE WHEN n > 500 THEN 0.1::DOUBLE END) * 0.15::DOUBLE, 0.0::DOUBLE)
                    + coalesce((CASE WHEN NOT dig THEN 0.2::DOUBLE END)
                               * (CASE WHEN n < 50 OR n > 500 THEN 0.1::DOUBLE ELSE 0.15::DOUBLE END), 0.0::DOUBLE), 1.0::DOUBLE) AS risk
      FROM f)
SELECT claim_id, round(risk, 6) AS risk_score, round(1 - risk, 6) AS compliance_score, CAST(n_hits AS BIGINT) AS n_hits,
       rel AS relevant_standards,
       concat_ws('|', CASE WHEN risk > 0.7 THEN '{R['high_1']}|{R['high_2']}' WHEN risk > 0.5 THEN '{R['medium_1']}|{R['medium_2']}'
                          ELSE '{R['low']}' END,
                 CASE WHEN esg < 2 THEN '{R['terms']}' END, '{R['metrics']}') AS recommendations
FROM r"""


register("rag_analysis", _rag_analysis_sql())(_rag_analysis)


# ---------------------------------------------------------------- H3 retrieval risk (context text as the analysis text)
def _rag_risk(spark, sf):
    found, ctx = _hits_and_context(spark, sf)
    c = claim_texts(spark, sf)
    hs = found.groupBy("claim_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("m"))
    j = c.join(hs, "claim_id", "left").join(ctx.select("claim_id", "context"), "claim_id", "left")
    r = RK.rag_risk("esg_claim_text", "n", "m", "context")
    # half-up at 6 decimals by the same IEEE steps in both engines (values end in ...5 often here)
    return j.select("claim_id", (F.floor(r * 1e6 + 0.5) / 1e6).alias("rag_risk"))


def _rag_risk_sql():
    from claimlens.functions import lexicons as L
    from claimlens.plans.sqlparts import contains
    a = "lower(coalesce(x.context, ''))"
    neg = " + ".join(f"CAST({contains(a, w)} AS INTEGER)" for w in L.RAG_NEGATIVE)
    pos = " + ".join(f"CAST({contains(a, w)} AS INTEGER)" for w in L.RAG_POSITIVE)
    ab = " OR ".join(contains("lower(c.esg_claim_text)", w) for w in L.RAG_ABSOLUTE)
    return _CTX_SQL.rstrip("\n") + f""",
hs AS (SELECT claim_id, count(*) AS n, round(avg(score), 6) AS m FROM hits GROUP BY claim_id),
f AS (SELECT c.claim_id, c.esg_claim_text, CASE WHEN coalesce(hs.n, 0) > 0 THEN (1.0::DOUBLE - coalesce(hs.m, 0.5::DOUBLE)) * 0.3::DOUBLE
                                           ELSE 0.6::DOUBLE END AS src,
             ({neg}) AS neg, ({pos}) AS pos, ({ab}) AS ab
      FROM claims c LEFT JOIN hs ON c.claim_id = hs.claim_id LEFT JOIN ctx x ON c.claim_id = x.claim_id)
SELECT claim_id, floor(CASE WHEN esg_claim_text IS NULL THEN NULL ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE,
  ((0.0::DOUBLE + src) + CASE WHEN neg > pos THEN 0.3::DOUBLE WHEN pos > neg THEN -0.2::DOUBLE ELSE 0.0::DOUBLE END)
  + CASE WHEN ab THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END)) END * 1e6 + 0.5) / 1e6 AS rag_risk FROM f"""


register("rag_risk", _rag_risk_sql())(_rag_risk)


# ---------------------------------------------------------------- G1 / G2 chunkers over whole documents (rows-only)
def _chunks(method):
    def q(spark, sf):
        d = table(spark, sf, "documents")
        return CH.chunk_table(d, "doc_id", "text", method).select("doc_id", "chunk_id", "chunk_size", "chunk_uid")
    return q


register("chunk_recursive")(_chunks("recursive"))


# ---------------------------------------------------------------- J24 retrieval risk as a classifier on a 50-claim sample
def _retrieval_eval(spark, sf):
    from claimlens.operators import curves as CV
    c = claims_txt(spark, sf, ["claim_id", "greenwashing_flag"]).where(F.col("greenwashing_flag").isNotNull())
    sample = materialize(c.select("claim_id", F.col("greenwashing_flag").alias("label"))
                         .orderBy(F.md5(F.concat(F.col("claim_id").cast("string"), F.lit("-42"))), "claim_id").limit(50))
    # the sample is drawn first: only its 50 claims are searched for and scored
    drawn = materialize(claim_texts(spark, sf).join(F.broadcast(sample.select("claim_id")), "claim_id", "left_semi"))
    ra = _rag_analysis(spark, sf, drawn).select("claim_id", "risk_score")
    s = sample.join(ra, "claim_id").withColumn("pred", (F.col("risk_score") > 0.5).cast("int"))
    size = sample.agg(F.count("*").alias("n"))  # one row: fewer than 50 when fewer claims are labelled
    return CV.binary_metrics(s).crossJoin(F.broadcast(size))


def _retrieval_eval_sql():
    base = _rag_analysis_sql()
    head, tail = base.rsplit("\nSELECT claim_id, round(risk, 6) AS risk_score", 1)
    ra = "SELECT claim_id, round(risk, 6) AS risk_score" + tail
    return head + f""",
ra AS ({ra}),
smp AS (SELECT claim_id, greenwashing_flag AS label FROM claims WHERE greenwashing_flag IS NOT NULL
        ORDER BY md5(CAST(claim_id AS VARCHAR) || '-42'), claim_id LIMIT 50),
sp AS (SELECT s.label, CAST(ra.risk_score > 0.5 AS INTEGER) AS pred FROM smp s JOIN ra USING (claim_id)),
cf AS (SELECT count_if(label = 0 AND pred = 0) AS tn, count_if(label = 0 AND pred = 1) AS fp,
              count_if(label = 1 AND pred = 0) AS fn, count_if(label = 1 AND pred = 1) AS tp FROM sp)
SELECT round(coalesce((tp + tn) / nullif(CAST(tp + tn + fp + fn AS DOUBLE), 0), 0.0), 6) AS accuracy,
       round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0.0), 6) AS precision,
       round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0.0), 6) AS recall,
       round(coalesce(2.0 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0.0), 6) AS f1,
       CAST((SELECT count(*) FROM smp) AS BIGINT) AS n FROM cf"""


register("retrieval_eval", _retrieval_eval_sql())(_retrieval_eval)


def _sentence_chunks_sql(size: int = 1000, overlap: int = 200, back: int = 100) -> str:
    """The windowed sentence chunker as a recursive CTE (oracle for ``chunk_sentence``)."""
    from claimlens.functions.text import WS

    def end_expr(start):
        lo = f"greatest({start}, {start} + {size - back})"
        w = f"substr(d.text, {lo} + 2, {start} + {size} - {lo})"
        pos = [f"coalesce(nullif(strpos(reverse({w}), '{c}'), 0), 1000000000)" for c in ".!?"]
        r = f"least({', '.join(pos)})"
        return (f"CASE WHEN {start} + {size} >= d.n THEN {start} + {size} "
                f"WHEN {r} < 1000000000 THEN {lo} + 1 + (length({w}) - {r}) + 1 ELSE {start} + {size} END")

    return f"""WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents),
steps(doc_id, start, e) AS (
  SELECT d.doc_id, 0, {end_expr('0')} FROM d WHERE d.n > {size}
  UNION ALL
  SELECT d.doc_id, s.e - {overlap}, {end_expr(f's.e - {overlap}')}
  FROM steps s JOIN d ON s.doc_id = d.doc_id WHERE s.e - {overlap} < d.n),
pieces AS (SELECT s.doc_id, s.start,
                  regexp_replace(substr(d.text, s.start + 1, s.e - s.start), '^{WS}+|{WS}+$', '', 'g') AS piece
           FROM steps s JOIN d ON s.doc_id = d.doc_id),
kept AS (SELECT doc_id, piece, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS chunk_id
         FROM pieces WHERE piece <> ''
         UNION ALL SELECT doc_id, text, 0 FROM d WHERE n <= {size})
SELECT doc_id, CAST(chunk_id AS INTEGER) AS chunk_id, CAST(length(piece) AS INTEGER) AS chunk_size,
       CAST(doc_id AS VARCHAR) || ':' || CAST(chunk_id AS VARCHAR) AS chunk_uid
FROM kept"""


register("chunk_sentence", _sentence_chunks_sql())(_chunks("sentence"))
