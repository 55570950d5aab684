"""The registered queries of the numbered operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from labelsieve.llm import align, audit, bpe, chat, embed, exact_dedup, jaccard, leaks, lm, mixing, quality, sharding, substring
from labelsieve.llm.common import id_crc32, table


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (id_crc32(F.col("doc_id")) % 4 == 2).alias("held_out"), quality.quality_score(trees, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_docs(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    # The old layout keeps equal texts in one of 8 shards; a large group of them makes that shard too large.
    files = sharding.reshard_files(docs, F.pmod(crc, F.lit(8)))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    rows = files.select("doc_id", size.alias("size"), crc.alias("text_crc32"), "shard", "shard_old", "shard_block")
    slotted = sharding.with_slots(rows, ["doc_id", "text_crc32", "size"])
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.embedding_groups(table(spark, sf_dir, "embeddings"))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score_texts(table(spark, sf_dir, "documents"))
    held_out = id_crc32(F.col("doc_id")) % 5 == 1
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    back = chat.read_chats(chat.proven(chat.format_chats(turns.unionByName(planted))))
    told = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return plan.select("doc_id", F.col("mix_size").alias("size"), "source_size", "target", (F.col("mix_copies") * F.col("mix_size")).alias("taken"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = leaks.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return told.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = align.aligned_docs(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return told.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(audit.mask_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_substring, op2_jaccard, op3_quality, op4_bpe, op5_sharding, op6_exact_dedup, op7_embeddings, op8_lm, op9_chat, op10_mixing, op11_decontamination, op12_alignment, op13_filter_audit]
    return {f.__name__: f for f in found}


#: Words as DuckDB counts them.
_SIZES = r"""
sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents)
"""

OP6_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""

OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), p AS (
  SELECT *, len(regexp_extract_all(role || text, '\\')) AS backslashes, len(regexp_extract_all(role || chr(10) || text, '</?s>|\[/?INST\]')) AS controls,
    regexp_matches(role, '(?s)\\.') OR regexp_matches(text, '(?s)\\.') OR regexp_matches(role || chr(10) || text, '</?s>|\[/?INST\]') AS conflict FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(text) + 23 + CASE WHEN conflict THEN backslashes + controls ELSE 0 END) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""

OP10_SQL = f"""
WITH {_SIZES}, s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, 3 * source_size AS cap, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
r AS (SELECT *, CAST(cap AS DOUBLE) / weight AS ratio FROM w),
l AS (SELECT *, CAST(sum(source_size) OVER () - (sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS UNBOUNDED PRECEDING) - cap) AS DOUBLE)
  / CAST(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM r),
t AS (SELECT source, source_size, CASE WHEN ratio > level THEN max(CASE WHEN ratio > level THEN level END) OVER () * weight ELSE CAST(cap AS DOUBLE) END AS target FROM l),
q AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
  CAST(('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8)) AS BIGINT) / 4294967296.0 AS u
  FROM sized JOIN t ON sized.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM q
"""


#: A-Z to a-z, and words.
_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP11_SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents), b AS (SELECT item_id, {_TERMS} AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[k:k + 9], ' ') AS phrase FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS k FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM i),
p AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS phrase FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, n WHERE len(w) >= n)),
h AS (SELECT doc_id, k, p.n, item_id FROM p JOIN i USING (phrase)),
c AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS place FROM (SELECT DISTINCT doc_id, k, n FROM h)) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""

OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents
), m AS (
  SELECT part, coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad, CASE WHEN len(words) < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > least THEN 16 ELSE 0 END AS mask
  FROM d LEFT JOIN labels USING (doc_id)
), c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (bad) AS t FROM m GROUP BY ALL
), f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS f(name, bit)
), o AS (
  SELECT concat(a.name, b.name, c.name, d.name, e.name) AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), s AS (SELECT filter_order, k AS step, bits[k] AS bit, CAST(coalesce(list_sum(bits[:k - 1]), 0) AS INTEGER) AS earlier FROM o, generate_series(1, 5) AS g(k)
), r AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, bit, sum(CASE WHEN mask & (bit | earlier) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & bit > 0 AND mask & earlier > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN g ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN t ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": OP6_SQL, "op9_chat": OP9_SQL, "op10_mixing": OP10_SQL, "op11_decontamination": OP11_SQL, "op13_filter_audit": OP13_SQL}
