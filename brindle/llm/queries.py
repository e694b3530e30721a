"""The queries opN_<name> of this subpackage, and their SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontamination, language_id, merkle, mixing, near_dedup, oracles, piece_codec, pieces, quality_rules, sharding, substring_dedup, token_counts, url_filter, vector_dedup
from .shared import cut


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def vocabulary(name: str = "piece_bpe_32k.model") -> pieces.Vocabulary:
    import public_tokenizers

    return pieces.load(public_tokenizers.path(name))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the vocabulary's pieces and scores as a unigram model."""
    return token_counts.count(_table(spark, sf_dir, "documents"), vocabulary())


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    remainder = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4, F.lit(0))
    model = language_id.train(docs.filter(remainder != 2))
    return language_id.predict(docs, model, extra={"held_out": remainder == 2})


#: Verdict, host and path of each.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    model = url_filter.train(url_filter.default_labels(spark))
    return url_filter.judge(pages, URL_RULES, model).select("page_id", "host", "path", "rule", "verdict", "score")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.digests(piece_codec.encode(_table(spark, sf_dir, "documents"), vocabulary()))


def op6_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), shards=24)


def op7_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken)


OP7_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         (CAST('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) + 0.5::DOUBLE)
         / 281474976710656::DOUBLE AS draw
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, 3 * source_size AS cap,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM s),
l AS (
  SELECT *, cap / weight AS lim, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS pos,
         (sum(source_size) OVER ()
          - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
                             ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (
  SELECT source, source_size,
         CASE WHEN level >= lim THEN cap::DOUBLE
              ELSE min(CASE WHEN level < lim THEN {'a': pos, 'b': level} END) OVER ()['b'] * weight END AS target
  FROM l),
r AS (SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0) AS whole FROM t),
q AS (SELECT *, target - whole * source_size AS rest FROM r),
c AS (SELECT source, length(bin(size)) AS bits, CAST(sum(size) AS BIGINT) AS words FROM d WHERE size > 0 GROUP BY ALL),
v AS (
  SELECT c.source, c.bits,
         (q.rest - coalesce(sum(words) OVER (PARTITION BY c.source ORDER BY bits DESC
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / sum(bits * words) OVER (PARTITION BY c.source ORDER BY bits DESC
                                   ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
  FROM c JOIN q ON c.source IS NOT DISTINCT FROM q.source WHERE q.rest > 0),
m AS (SELECT source, arg_max(level, bits) AS level FROM v WHERE level * bits < 1 GROUP BY source),
k AS (
  SELECT d.*, q.source_size, q.target, q.whole, q.rest, m.level * length(bin(d.size)) AS chance
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN m ON d.source IS NOT DISTINCT FROM m.source),
e AS (SELECT *, CASE WHEN chance >= 1 THEN 0 ELSE draw / (1 - draw) / (chance / (1 - chance)) END AS rank FROM k),
o AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
            - sum(size) OVER (PARTITION BY source, rank) AS before,
         sum(size) OVER (PARTITION BY source, rank) AS own
  FROM e)
SELECT doc_id, size, source_size, target,
       CAST((whole + CASE WHEN rest > 0 AND before + own / 2 <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM o
"""


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = quality_rules.measure(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return quality_rules.judge(cut(counts)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "posterior",
    )


def op9_vector_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(words, 256).alias("kept_sha256"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.contaminated(docs, _table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, (F.col("n_hit") > 0).alias("contaminated"))


def damaged(rows: DataFrame) -> DataFrame:
    """Turns of conversations, some of them dropped, emptied, cut short, repeated or given to the user."""
    space = F.lit(" ")
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")))
    rows = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key) % 20).alias("_kind"))
    rows = rows.filter("_kind <> 0").withColumn("role", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1))))
    return rows.drop("_kind", "_copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversations.repair(damaged(rows), rows)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document proven against the root, after some texts were tampered with."""
    docs = _table(spark, sf_dir, "documents")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    found = F.when(tampered, merkle.leaf([*values, merkle.lower_ascii(F.col("text"))]))
    leaves = docs.select("doc_id", "lang", merkle.leaf([*values, F.col("text")]).alias("digest"), found.alias("found"))
    listed = merkle.manifest(cut(leaves), "lang", [F.col("doc_id").asc_nulls_first()], ["doc_id", "found"])
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    root = merkle.folded(F.coalesce("found", "digest"), F.col("proof"))
    out = listed.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_near_dedup": op1_minhash_near_dedup,
        "op2_token_counts": op2_token_counts,
        "op3_language_id": op3_language_id,
        "op4_url_filter": op4_url_filter,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_kd_shards": op6_kd_shards,
        "op7_pareto_mix": op7_pareto_mix,
        "op8_quality_rules": op8_quality_rules,
        "op9_vector_near_dedup": op9_vector_near_dedup,
        "op10_substring_dedup": op10_substring_dedup,
        "op11_decontamination": op11_decontamination,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_pareto_mix": OP7_SQL, "op11_decontamination": oracles.DECONTAMINATION, "op13_merkle_manifest": oracles.merkle()}
