"""Queries of the training-data operators (``opN_<name>``) and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.llm import chat, decontaminate, hard_negatives, language_id, language_model, near_duplicates, packing, privacy, quality, sharding, token_counts, toxicity, vector_codes
from claimlens.llm.common import fold
from claimlens.sources.tables import table

QUERIES = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return put


DECONTAMINATION_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bwin AS (SELECT item_id, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
         FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bwin),
dwin AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
         FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)),
hits AS (SELECT DISTINCT d.doc_id, d.k, d.i, b.item_id FROM dwin d JOIN bwin b ON d.k = b.k AND d.g = b.g),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hw ON dw.doc_id = hw.doc_id LEFT JOIN it ON dw.doc_id = it.doc_id
"""


@register("op3_decontaminate", DECONTAMINATION_SQL)
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    r = F.col("contamination")
    return found.select("doc_id", r.n_words.alias("n_words"), r.n_hit.alias("n_hit"), F.size(r["items"]).cast("bigint").alias("n_items"),
                        F.sha2(F.concat_ws(",", F.array_sort(r["items"])), 256).alias("items_sha256"),
                        decontaminate.is_contaminated(r.n_words, r.n_hit).alias("contaminated"))


NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN 's ' || array_to_string(w, ' ') ELSE 'g ' || array_to_string(w[i:i + 4], ' ') END AS g
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM dw WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS inter FROM sh x JOIN sh y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * inter >= 75 * (na.n + nb.n - inter)),
sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS src, doc_id AS dst FROM documents UNION SELECT r.src, s.b FROM reach r JOIN sym s ON r.dst = s.a),
comp AS (SELECT src, min(dst) AS c FROM reach GROUP BY src)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, comp.c AS component_id, d.doc_id = comp.c AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN comp ON comp.src = d.doc_id
"""


@register("op5_near_duplicates", NEAR_DUPLICATES_SQL)
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


@register("op1_shard")
def op1_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign_shards(table(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@register("op10_pack")
def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)
    return out.select("doc_id", "piece", "start", F.col("length").cast("bigint").alias("length"), "ids_crc32", "sequence_id", "offset")


@register("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


@register("op6_language_model")
def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5) == 1)


@register("op8_quality")
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register("op9_language_id")
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = fold(F.col("doc_id"), 4) == 2
    return language_id.identify(docs, docs.filter(~held), public_tokenizers.path("piece_bpe_32k.model"), carry=("doc_id", held.alias("held_out")))


CHAT_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS et, replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') AS er FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(et) + length(er) + 24) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@register("op2_chat", CHAT_SQL)
def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    same = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", same), (-1, 1, "assistant", same)], turns.schema)
    return chat.read_back(chat.render(chat.fold_events(chat.turns_as_events(turns.unionByName(extra)))))


@register("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = fold(F.col("doc_id"), 3) == 1
    model = toxicity.train(docs.filter(~held), labels.filter(~held))
    return toxicity.score(docs.select("doc_id", held.alias("held_out"), "text"), model).select("doc_id", "held_out", "score", "predicted")


HARD_NEGATIVES_SQL = r"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, c.vec_id, c.label, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
      FROM e a JOIN e c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.anchor_label
 AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 3
"""


@register("op11_hard_negatives", HARD_NEGATIVES_SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


def vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The rounds written out: an assignment ``a<t>`` and the codebooks ``c<t>`` after it."""
    w = f"len(v) // {parts}"
    ctes = [f"""e AS MATERIALIZED (SELECT vec_id, label, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)""",
            f"p AS MATERIALIZED (SELECT vec_id, q, v[q * ({w}) + 1:(q + 1) * ({w})] AS v FROM e, range({parts}) AS r(q))",
            f"""c0 AS MATERIALIZED (SELECT q, k, v FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM e) USING (vec_id)
      WHERE k < {entries})"""]
    for t in range(rounds + 1):
        ctes.append(f"""a{t} AS MATERIALIZED (SELECT vec_id, q, min(d * {entries} + k) AS dk, any_value(v) AS v
      FROM (SELECT p.vec_id, p.q, c.k, p.v, list_sum([(p.v[i] - c.v[i]) * (p.v[i] - c.v[i]) for i in range(1, len(p.v) + 1)]) AS d
            FROM p JOIN c{t} AS c ON c.q = p.q) GROUP BY vec_id, q)""")
        if t < rounds:
            ctes.append(f"""u{t} AS (SELECT q, dk % {entries} AS k, i, sum(x) AS s, count(*) AS n
      FROM (SELECT q, dk, unnest(v) AS x, unnest(range(len(v))) AS i FROM a{t}) GROUP BY ALL)""")
            ctes.append(f"""c{t + 1} AS MATERIALIZED (SELECT c.q, c.k, coalesce(m.v, c.v) AS v FROM c{t} AS c LEFT JOIN
      (SELECT q, k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM u{t} GROUP BY q, k) AS m ON m.q = c.q AND m.k = c.k)""")
    return "WITH " + ",\n".join(ctes) + f""",
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY q, k)) AS sha FROM c{rounds}),
r AS (SELECT vec_id, string_agg(printf('%02x', CAST(dk % {entries} AS INTEGER)), '' ORDER BY q) AS code, CAST(sum(dk // {entries}) AS BIGINT) AS error
      FROM a{rounds} GROUP BY vec_id)
SELECT r.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, sha AS codebooks_sha256
FROM r JOIN e ON e.vec_id = r.vec_id, h
"""


@register("op12_vector_codes", vector_codes_sql())
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return vector_codes.with_label_error(codes).select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


@register("op13_privacy")
def op13_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("privacy")
    out = privacy.sanitise(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *[r[f"n_{k}"].alias(f"n_{k}") for k in privacy.KINDS], F.sha2(r["base"], 256).alias("base_sha256"), r["spans"].alias("spans"))
