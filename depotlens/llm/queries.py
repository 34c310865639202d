"""The queries of this package over the tables of a data directory, and the SQL that some of them must equal."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from depotlens.llm import (backoff_lm, chat_format, host_rules, jaccard_join, knn_quality, pattern_packing, pfair_mix,
                           pivot_search, rans_files, rendezvous, rotated_kmeans, secret_scan, token_align)
from depotlens.llm.common import checkpointed, numbered, shared_folder, table

SHARDS = 40
ROW_BYTES = 16
CENTROIDS, ROUNDS, COMPONENTS = 40, 5, 64
CONTROL_CONVERSATION = -7
CONTROL_TEXT = r"\### Assistant: </turn> ok"


def op1_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = secret_scan.train(secret_scan.labelled_samples(docs))
    return secret_scan.digest(secret_scan.scan(docs, model))


def op2_host_rules(spark, sf_dir):
    figures = host_rules.word_figures(table(spark, sf_dir, "documents")).drop("text", "lang", "n_chars")
    failed = checkpointed(host_rules.failures(figures))
    verdicts = host_rules.host_verdicts(failed, "source")
    return host_rules.judged(failed, verdicts, "source").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_jaccard_join(spark, sf_dir):
    return jaccard_join.linked(table(spark, sf_dir, "documents"))


def op4_pivot_search(spark, sf_dir):
    return pivot_search.nearest(table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 100 == 0)


def op5_backoff_lm(spark, sf_dir):
    return backoff_lm.scores(table(spark, sf_dir, "documents"))


def op6_rendezvous(spark, sf_dir):
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    sharded = rendezvous.assigned(rows, "doc_id", [1.0] * SHARDS)
    return numbered(sharded, ["shard"], ["doc_id"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_knn_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = knn_quality.fit(docs, table(spark, sf_dir, "labels"))
    return knn_quality.scored(docs, model).select(
        "doc_id", F.coalesce(knn_quality.held_out(), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= knn_quality.THRESHOLD).cast("int").alias("predicted"))


def op8_chat_format(spark, sf_dir):
    control = spark.createDataFrame(
        [(CONTROL_CONVERSATION, i, role, CONTROL_TEXT) for i, role in enumerate(("user", "assistant"))],
        "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(control)
    return chat_format.read_back(chat_format.formatted(turns))


def op9_pattern_packing(spark, sf_dir):
    path = public_tokenizers.path(pattern_packing.TOKENIZER_FILE)
    return pattern_packing.packed(pattern_packing.pieces(table(spark, sf_dir, "documents"), path))


def op10_pfair_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.octet_length("text").alias("bytes"))
    return pfair_mix.mixed(docs.drop("bytes"), pfair_mix.target_weights(docs, size="bytes"))


def op11_rans_files(spark, sf_dir):
    folder = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    path = public_tokenizers.path(rans_files.TOKENIZER_FILE)
    return rans_files.read_checks(spark, rans_files.written(table(spark, sf_dir, "documents"), path, folder))


def op12_token_align(spark, sf_dir):
    return token_align.alignment(table(spark, sf_dir, "documents"), public_tokenizers.path(token_align.BYTE_FILE),
                                 public_tokenizers.path(token_align.PIECE_FILE))


def op13_rotated_kmeans(spark, sf_dir):
    return rotated_kmeans.clustered(table(spark, sf_dir, "embeddings"), CENTROIDS, ROUNDS, COMPONENTS)


def queries():
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_host_rules": op2_host_rules,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_pivot_search": op4_pivot_search,
        "op5_backoff_lm": op5_backoff_lm,
        "op6_rendezvous": op6_rendezvous,
        "op7_knn_quality": op7_knn_quality,
        "op8_chat_format": op8_chat_format,
        "op9_pattern_packing": op9_pattern_packing,
        "op10_pfair_mix": op10_pfair_mix,
        "op11_rans_files": op11_rans_files,
        "op12_token_align": op12_token_align,
        "op13_rotated_kmeans": op13_rotated_kmeans,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql():
    """SQL for the results that DuckDB can compute on whole tables."""
    return {"op2_host_rules": OP2_SQL, "op3_jaccard_join": OP3_SQL, "op4_pivot_search": OP4_SQL,
            "op5_backoff_lm": OP5_SQL, "op13_rotated_kmeans": op13_sql()}


def op13_sql():
    """One pair of common tables a round: the nearest centroid of every vector, and the centroids that follow."""
    rounds = "".join(f"""
), a{i} AS MATERIALIZED (
    SELECT vec_id, cluster, distance FROM (
        SELECT v.vec_id, c.cluster, CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))
                   AS BIGINT) AS distance
        FROM v CROSS JOIN c{i} c)
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY distance, cluster) = 1
), c{i + 1} AS MATERIALIZED (
    SELECT c.cluster, coalesce(m.x, c.x) AS x
    FROM c{i} c LEFT JOIN (
        SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY d) AS x
        FROM (SELECT cluster, d, sum(x[d]) AS s, count(*) AS n
              FROM a{i} JOIN v USING (vec_id), range(1, {COMPONENTS + 1}) r(d) GROUP BY cluster, d)
        GROUP BY cluster) m USING (cluster)""" for i in range(ROUNDS + 1))
    return f"""
WITH v AS MATERIALIZED (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings
    WHERE len(embedding) = {COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS cluster, x
    FROM v QUALIFY row_number() OVER (ORDER BY sha256('2:' || vec_id)) <= {CENTROIDS}{rounds}
)
SELECT vec_id, CAST(a.cluster AS INTEGER) AS cluster, distance,
       CAST(sum(distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN c{ROUNDS} c USING (cluster)
"""


OP4_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS query_id, b.vec_id,
           CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id
    WHERE a.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
"""

OP2_SQL = r"""
WITH d AS (
    SELECT row_number() OVER () AS row_id, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
    SELECT row_id, doc_id, source, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
           list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM d
), windows AS (
    SELECT row_id, i, words[i : i + 2] AS win
    FROM (SELECT row_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), often AS (
    SELECT row_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY row_id, win) > 1
), covered AS (
    SELECT row_id, count(DISTINCT p) AS n
    FROM (SELECT row_id, unnest([i, i + 1, i + 2]) AS p FROM often) GROUP BY row_id
), f AS (
    SELECT doc_id, source, len(words) AS n_words,
           CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
           length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
           length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper,
           len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
    FROM w LEFT JOIN covered USING (row_id)
), b AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f
), x AS (
    SELECT *, base_failed OR n_symbols * 10 > n_words OR n_dup_lines * 2 > n_lines
              OR n_repeat_words * 10 > n_words * 3 OR n_upper * 2 > word_chars AS failed
    FROM b
), h AS (
    SELECT source, count(*) AS n, sum(CAST(failed AS INTEGER)) AS bad FROM x GROUP BY source
), m AS (
    SELECT sum(bad) / sum(n) AS mean, var_samp(bad / n) AS spread, avg(1 / n) AS noise FROM h
), s AS (
    SELECT mean, least(greatest(coalesce(CASE WHEN spread - mean * (1 - mean) * noise > 0
        THEN mean * (1 - mean) / (spread - mean * (1 - mean) * noise) - 1 END, 1000.0), 0.5), 1000.0) AS strength
    FROM m
), v AS (
    SELECT source, (bad + mean * strength) / (n + strength) <= 0.5 AS host_ok FROM h, s
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT failed AND host_ok AS kept
FROM x JOIN v ON x.source IS NOT DISTINCT FROM v.source
"""

OP3_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
    FROM documents
), g AS (
    SELECT DISTINCT doc_id, words[i : i + 3] AS shingle
    FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 2))) AS i FROM w WHERE len(words) > 0)
), n AS (
    SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
    FROM g a JOIN g b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
    SELECT a, b FROM common JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION
    SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) m USING (doc_id)
"""

OP5_SQL = r"""
WITH w AS (
    SELECT doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
    FROM documents
), o AS (
    SELECT doc_id, i, words[i] AS w2, CASE WHEN i > 1 THEN words[i - 1] END AS w1
    FROM (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w)
), one AS (
    SELECT w2 AS word, count(*) AS c FROM o GROUP BY w2
), two AS (
    SELECT w1, w2, count(*) AS c12 FROM o WHERE w1 IS NOT NULL GROUP BY w1, w2
), t AS (
    SELECT sum(c) AS total FROM one
), s AS (
    SELECT o.doc_id, CASE WHEN c12 > 0 THEN ln(c12) - ln(a.c)
                     ELSE CASE WHEN o.w1 IS NULL THEN 0 ELSE ln(0.4) END + ln(b.c) - ln(total) END AS x
    FROM o CROSS JOIN t JOIN one b ON o.w2 = b.word LEFT JOIN one a ON o.w1 = a.word
    LEFT JOIN two ON o.w1 = two.w1 AND o.w2 = two.w2
)
SELECT d.doc_id, count(x) AS n_words, round(coalesce(sum(x), 0), 6) AS log_score,
       round(sum(x) / count(x), 9) AS mean_log_score
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id
"""
