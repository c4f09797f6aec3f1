"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, divergence, filter_audit, idstore, jaccard, language_model, lattice, packing, quality, secrets, sharding, wrapper
from .common import Store


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = Store(spark, "op1")
    pieces = store.put(packing.token_pieces(_table(spark, sf_dir, "documents"), tokenizer_path()), "pieces")
    narrow = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.assign(narrow)


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated"
    )


def op3_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "<|im_end|><|im_start|>assistant ok"
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(
        spark.createDataFrame([(-1, 0, "user", own), (-1, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    )
    return chat.conversation_digests(chat.format_examples(turns))


def op4_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_lattice_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(_table(spark, sf_dir, "documents"), n=4, num=85)


def op8_empirical_bayes_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), keep=("doc_id",))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the base rules first; then all rules with that ledger, which scans the blobs by the added rules alone
    docs, base = _table(spark, sf_dir, "documents"), tuple(r for r in secrets.RULES if r.base)
    _, ledger = secrets.scan(docs, rules=base)
    found, _ = secrets.scan(docs, Store(spark, "op9").put(ledger, "ledger"))
    count = lambda kind: F.size(F.filter("findings", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *(count(r.kind) for r in base),
        F.sha2(secrets.span_list(F.col("findings"), base).cast("binary"), 256).alias("base_sha256"),
        secrets.span_list(F.col("findings")).alias("spans"),
    )


def op10_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Store(spark, "op10").path("store")
    idstore.write(_table(spark, sf_dir, "documents"), path, tokenizer_path())
    if idstore.verify_manifest(spark, path).limit(1).count():
        raise ValueError("the store's manifest doesn't hold")
    return idstore.digests(spark, path)


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


def op13_deleted_interpolation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.train_and_score(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_best_fit_packing, op2_benchmark_decontamination, op3_chat_prefix_targets, op4_label_propagation_shards,
        op5_wrapper_text, op6_lattice_near_duplicates, op7_ngram_jaccard_join, op8_empirical_bayes_quality, op9_secret_scans, op10_id_store,
        op11_filter_interaction_audit, op12_source_divergence_audit, op13_deleted_interpolation_scores,
    )}


#: The five filters' failures per document, then every order: removed where this filter is the first that fails.
_AUDIT_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), firsts AS (SELECT t, min(doc_id) AS first_id FROM words GROUP BY t
), judged AS (
  SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(doc_id > first_id, false) AS e,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = words.doc_id AND l.quality = 1) AS good,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = words.doc_id AND l.toxic = 1) AS toxic
  FROM words JOIN firsts USING (t)
), masks AS (
  SELECT part, a::INT * 1 + b::INT * 2 + c::INT * 4 + d::INT * 8 + e::INT * 16 AS m, count(*) AS n,
    count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM judged GROUP BY ALL
), letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(f, bit)
), orders AS (
  SELECT v.f || w.f || x.f || y.f || z.f AS filter_order, [v.bit, w.bit, x.bit, y.bit, z.bit] AS bits
  FROM letters v, letters w, letters x, letters y, letters z WHERE v.bit + w.bit + x.bit + y.bit + z.bit = 31
    AND (v.bit | w.bit | x.bit | y.bit | z.bit) = 31
), steps AS (
  SELECT filter_order, s::INT AS step, bits[s] AS bit, coalesce(list_sum(bits[1:s - 1]), 0)::INT AS before FROM orders, range(1, 6) r(s)
), figures AS (
  SELECT part, filter_order, step, bit,
    sum(n) FILTER (m & (before | bit) = 0) AS kept, sum(n) FILTER (m & before = 0 AND m & bit > 0) AS removed,
    sum(n) FILTER (m & before > 0 AND m & bit > 0) AS redundant, sum(n) FILTER (m = bit) AS unique_fails,
    sum(n_good) FILTER (m & before = 0 AND m & bit > 0) AS good_lost, sum(n_toxic) FILTER (m & before = 0 AND m & bit > 0) AS toxic_lost
  FROM masks, steps GROUP BY ALL
)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  (sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM figures
"""

_DIVERGENCE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS no, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), words AS (SELECT no, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT no) >= 3
), vocabulary AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang
), grps AS (SELECT DISTINCT lang, source FROM docs
), counts AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL
), own AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY ALL
), filled AS (
  SELECT lang, g.source, k.term, coalesce(c, 0) AS c,
    (1 + 1000000000::HUGEINT * (coalesce(c, 0) + 1) // (coalesce(n, 0) + v)::HUGEINT)::HUGEINT AS p
  FROM grps g JOIN kept k USING (lang) JOIN vocabulary USING (lang) LEFT JOIN counts USING (lang, source, term) LEFT JOIN own USING (lang, source)
), whole AS (
  SELECT lang, term, (1 + 1000000000::HUGEINT * (sum(c) + 1)::HUGEINT // (any_value(n) + any_value(v))::HUGEINT)::HUGEINT AS q
  FROM counts JOIN vocabulary USING (lang) JOIN (SELECT lang, sum(c) AS n FROM counts GROUP BY lang) USING (lang) GROUP BY lang, term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM filled a JOIN filled b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM grps g JOIN grps h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN pairs p ON p.lang = g.lang AND p.source = g.source AND p.item = h.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM filled JOIN whole USING (lang, term) WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
FROM every QUALIFY part = 'pair' OR rank <= 200
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_filter_interaction_audit": _AUDIT_SQL, "op12_source_divergence_audit": _DIVERGENCE_SQL}
