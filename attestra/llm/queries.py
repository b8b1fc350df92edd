"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff_lm, exact_dedup, interactions, licenses, ngram_lm, packing, periodic, pii, quality, secrets, simhash, toxicity, unigram
from .common import documents, staged


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir))
    base = F.filter("spans", lambda x: x["base"])
    count = lambda k: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == k))).cast("long").alias(f"n_{pii.KINDS[k]}")
    return found.select("doc_id", *map(count, range(pii.N_BASE)), F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = licenses.documents_as_files(documents(spark, sf_dir))
    return licenses.scan(files, "doc_id").select(F.col("id").alias("doc_id"), "license", "score", "origin", "of", F.array_join("licenses", ",").alias("licenses"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return unigram.digested(unigram.decode(unigram.encode(documents(spark, sf_dir), path), path))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.counts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches, by the sign of the id's hash, meet one index; all rows are judged by what both brought."""
    index = exact_dedup.DigestIndex(spark, exact_dedup.new_table_name())
    rows = staged(exact_dedup.digests(documents(spark, sf_dir)), "digests")
    half = F.xxhash64("doc_id") < 0
    index.add(rows.where(half), "first")
    index.add(rows.where(~half), "second")
    out = staged(exact_dedup.members(rows, index.standing()), "exact-dedup")
    index.drop()
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = quality.judge(docs, quality.planned(docs))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc_id", *quality.MEASURES, failed.alias("base_failed"), "kept")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(documents(spark, sf_dir))
    base = F.filter("spans", lambda x: x["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{secrets.KINDS[k]}")
    return found.select("doc_id", *map(count, range(3)), F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.scores(documents(spark, sf_dir)).select("doc_id", "n_pairs", F.round("score", 6).alias("score"))


def op10_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.scores(documents(spark, sf_dir)).withColumn("score", F.round("score", 6))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of held-out documents (a third, by the id's CRC) are never read by ``learn``."""
    docs = documents(spark, sf_dir)
    held_out = lambda i: F.crc32(i.cast("string")) % 3 == 1
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    scored = toxicity.score(docs, toxicity.learn(docs, labels))
    return scored.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
        "n_words", F.size("hits").alias("n_hits"),
    )


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, by the id's CRC, get a periodic tail; then runs and collapsed texts of all."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    start = lambda n: g % n
    texts = documents(spark, sf_dir).select("doc_id", F.when(h % 10 == 0, periodic.repeated(F.col("text"), start, lambda n: 1 + F.floor((n - start(n)) / (3 + g % 8)))).otherwise(F.col("text")).alias("text"))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    found = periodic.collapsed(texts).withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(F.expr("1000 * best.length div -best.period")).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit(interactions.cells(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_license_scan": op3_license_scan,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_token_counts": op5_token_counts,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_secrets": op8_secrets,
    "op9_simhash": op9_simhash,
    "op10_lm_scores": op10_lm_scores,
    "op10_backoff_scores": op10_backoff_scores,
    "op11_toxicity": op11_toxicity,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_filter_interactions": op13_filter_interactions,
}

QUALITY_SQL = r"""
    WITH d AS (
        SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    l AS (
        SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
        FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
    g AS (
        SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n
        FROM (SELECT doc_id, unnest(generate_series(1, len(w) - 2)) AS i, unnest(w[:-3]) AS a, unnest(w[2:-2]) AS b, unnest(w[3:]) AS c FROM d WHERE len(w) > 2)),
    r AS (
        SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
        FROM g, (VALUES (0), (1), (2)) AS x(k) WHERE n > 1 GROUP BY doc_id),
    m AS (
        SELECT doc_id, len(w) AS n_words, length(text) - length(regexp_replace(text, '[^\x20\x09-\x0D]', '', 'g')) AS word_chars,
               length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
               coalesce(n_repeat_words, 0) AS n_repeat_words, length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclamations,
               length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS n_letters
        FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
    b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_exclamations > n_words OR 2 * n_upper > n_letters
                OR (10 * n_dup_lines > 3 * n_lines AND n_dup_lines >= 3)
                OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
    FROM b"""
BACKOFF_SQL = r"""
    WITH t AS (
        SELECT row_number() OVER () AS r, doc_id, list_concat(['<s>'], list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: 'w' || x), ['</s>']) AS w
        FROM documents),
    p AS (SELECT r, doc_id, unnest(w[2:]) AS a, unnest(w[:-2]) AS b, unnest(list_concat([NULL], w[:-3])) AS c FROM t),
    k AS (SELECT r, doc_id, a AS g1, b AS v2, b || ' ' || a AS g2, c || ' ' || b AS v3, c || ' ' || b || ' ' || a AS g3 FROM p),
    n AS (
        SELECT r, doc_id, g3,
               count(*) OVER (PARTITION BY g1) - count(*) OVER (PARTITION BY r, g1) AS n1, count(*) OVER () - count(*) OVER (PARTITION BY r) AS of1,
               count(*) OVER (PARTITION BY g2) - count(*) OVER (PARTITION BY r, g2) AS n2, count(*) OVER (PARTITION BY v2) - count(*) OVER (PARTITION BY r, v2) AS of2,
               count(*) OVER (PARTITION BY g3) - count(*) OVER (PARTITION BY r, g3) AS n3, count(*) OVER (PARTITION BY v3) - count(*) OVER (PARTITION BY r, v3) AS of3
        FROM k),
    s AS (
        SELECT r, doc_id, CASE WHEN g3 IS NOT NULL AND n3 > 0 THEN 0 WHEN n2 > 0 THEN CASE WHEN g3 IS NULL THEN 0 ELSE 1 END ELSE CASE WHEN g3 IS NULL THEN 1 ELSE 2 END END AS drops,
               CASE WHEN g3 IS NOT NULL AND n3 > 0 THEN ln(n3 / of3) WHEN n2 > 0 THEN ln(n2 / of2) WHEN n1 > 0 THEN ln(n1 / of1) ELSE ln(0.5 / greatest(of1, 1)) END AS s
        FROM n)
    SELECT any_value(doc_id) AS doc_id, count(*) AS n_words, round(sum(s + drops * ln(0.4)), 6) AS score, CAST(count_if(drops > 0) AS BIGINT) AS n_backed_off
    FROM s GROUP BY r"""
#: Restated from each document's failed filters: in an order, the first of them is where it is removed.
INTERACTIONS_SQL = r"""
    WITH d AS (
        SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    f AS (
        SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
               CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
               || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END
               || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
        FROM d LEFT JOIN l USING (doc_id)),
    c AS (SELECT part, fails, count(*) AS n, count_if(good) AS n_good, count_if(toxic) AS n_toxic FROM f GROUP BY part, fails),
    x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    o AS (
        SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a JOIN x b ON b.x <> a.x JOIN x c ON c.x NOT IN (a.x, b.x)
        JOIN x d ON d.x NOT IN (a.x, b.x, c.x) JOIN x e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
    s AS (
        SELECT part, filter_order, step, n, n_good, n_toxic, fails, filter_order[step] AS f,
               coalesce(list_min(list_transform(string_split(nullif(fails, ''), ''), lambda y: instr(filter_order, y))), 9) AS gone
        FROM c, o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
    r AS (
        SELECT part, filter_order, step, f, sum(CASE WHEN gone > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed,
               sum(CASE WHEN gone < step AND contains(fails, f) THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = f THEN n ELSE 0 END) AS unique_fails,
               sum(CASE WHEN gone = step THEN n_good ELSE 0 END) AS good_lost, sum(CASE WHEN gone = step THEN n_toxic ELSE 0 END) AS toxic_lost
        FROM s GROUP BY ALL)
    SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
           CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
           CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
    FROM r"""
SQL: dict[str, str] = {
    "op13_filter_interactions": INTERACTIONS_SQL,
    "op10_backoff_scores": BACKOFF_SQL,
    "op3_license_scan": licenses.oracle(),
    "op7_quality_rules": QUALITY_SQL,
    "op10_lm_scores": r"""
        WITH t AS (
            SELECT doc_id, list_concat(['<s>'], list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: 'w' || x), ['</s>']) AS w
            FROM documents),
        p AS (SELECT doc_id, unnest(w[:-2]) AS v, unnest(w[2:]) AS w FROM t),
        c AS (SELECT v, w, count(*) AS n FROM p GROUP BY v, w),
        s AS (SELECT v, w, ln(n) - ln(sum(n) OVER (PARTITION BY v)) AS s FROM c)
        SELECT doc_id, count(*) AS n_pairs, round(sum(s), 6) AS score
        FROM p JOIN s USING (v, w) GROUP BY doc_id""",
    "op6_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS chars,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents),
        g AS (
            SELECT text_sha256, count(*) AS group_size,
                   first(doc_id ORDER BY chars DESC, doc_id NULLS LAST) AS keep_id
            FROM d GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
        FROM d JOIN g USING (text_sha256)""",
}
