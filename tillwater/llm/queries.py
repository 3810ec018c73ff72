"""Registered queries of this subpackage, over whole tables, with their check SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwater.llm import (
    bpe, idstore, manifest_sql, merkle, minhash, neighbours, packing, pii, quality_model, quality_rules, sharding, substring,
    tries, urls,
)
from tillwater.llm.common import tidy
from tillwater.session import stored

SHARDS = 40
RULES = [
    urls.Rule("org/", True), urls.Rule("example.org/es/", False), urls.Rule("example.org/en/1", False),
    urls.Rule("com/fr/", True), urls.Rule("com/de/", False),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out() -> Column:
    """Whether a row's label is for tests only."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    tidy(spark)
    ranks = public.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode(_table(spark, sf_dir, "documents"), ranks, public.PATTERN)
    return bpe.decode(encoded, ranks).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    tidy(spark)
    return urls.judge(_table(spark, sf_dir, "pages"), RULES)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    packed = packing.pack(_table(spark, sf_dir, "documents"), public.path("word_bpe_49k.json"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(_table(spark, sf_dir, "documents"), sharding.Tree.regular(SHARDS))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality_model.fit(docs.select("doc_id", "text"), labels.filter(~held_out()))
    scored = quality_model.scored(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    tidy(spark)
    table = _table(spark, sf_dir, "embeddings")
    return neighbours.search(neighbours.build(table), table.filter("vec_id % 50 = 0"), 5)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.measures(_table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines_removed", "kept_share",
    )


def op8_id_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    tidy(spark)
    docs = _table(spark, sf_dir, "documents")
    store = idstore.write(docs, public.path("byte_bpe_50k.json"))
    found = store.read(store.find(docs.select("doc_id")))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    tidy(spark)
    return minhash.classes(_table(spark, sf_dir, "documents"), share=0)


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    tidy(spark)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.deduplicated(docs, digests=True).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    tidy(spark)
    found = pii.find(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in pii.BASE],
        F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
        pii.listed(pii.merged(F.col("base"), F.col("added"))).alias("spans"),
    )


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the rows, by a checksum of their id, have lost their line breaks since."""
    tidy(spark)
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    without = F.when(changed, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.manifest(_table(spark, sf_dir, "documents"), without)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation begins with up to 8 turns of the one whose id is the next multiple of 5 below."""
    tidy(spark)
    conv_id = F.col("conv_id")
    head = F.crc32(conv_id.cast("string").cast("binary")) % 9
    turns = tries.turns(_table(spark, sf_dir, "conversations"))
    return tries.prefixes(tries.rebuilt(stored(turns), conv_id - conv_id % 5, head, 8))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_bpe, op2_url_filter, op3_packing, op4_sharding, op5_quality_model, op6_neighbours, op7_quality_rules,
        op8_id_store, op9_near_duplicates, op10_repeats, op11_personal_data,
        op12_manifest, op13_prefix_trie, pipeline,
    )
}

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
), firsts AS (
  SELECT k, min(doc_id) AS first_doc FROM win GROUP BY k
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN firsts USING (k) WHERE doc_id > first_doc
), lists AS (
  SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS t
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p
  WHERE gone.p IS NULL GROUP BY words.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLES = {"op10_repeats": OP10_SQL, "op12_manifest": manifest_sql.MANIFEST, "op13_prefix_trie": manifest_sql.PREFIXES}
