"""Queries of this subpackage for the driver contract: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, harmonic, jaccard, mixing, packing, pii, quality, runs, secrets, substring, urls, vectors, whitening


def tokenizer_path(name: str) -> str:
    """Where the public vocabularies lie; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def span_digest(found: DataFrame, kinds: list[str], by_flag: bool = False) -> DataFrame:
    """doc_id, a count per base kind, the digest of the base spans and the text of all spans, from `found`.

    Base spans are those of the kinds given, or those flagged `base`.
    """
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("found", lambda s: s["base"] if by_flag else s["kind"].isin(kinds))
    of_kind = lambda k: F.filter(base, lambda s: s["kind"] == k)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))


def op1_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), packing.byte_bpe_tokenizer(tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar(spark, _table(spark, sf_dir, "documents"))


def op3_pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(_table(spark, sf_dir, "documents"))
    return span_digest(found, list(pii.KINDS), by_flag=True)


def op4_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near(spark, _table(spark, sf_dir, "embeddings"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark, _table(spark, sf_dir, "pages"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(spark, _table(spark, sf_dir, "documents")).drop("kept_text")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, _table(spark, sf_dir, "documents"))[0]


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(secrets.scan(_table(spark, sf_dir, "documents")), [r.kind for r in secrets.RULES if r.base])


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), ids=False)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.scan(_table(spark, sf_dir, "documents"), planted=True))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(spark, _table(spark, sf_dir, "embeddings"))


def op13_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = harmonic.pack(_table(spark, sf_dir, "documents"), harmonic.word_ids(tokenizer_path("word_bpe_49k.json")))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_packing, op2_jaccard_join, op3_pii_scan, op4_vector_join, op5_url_filter, op6_secret_scan, op7_quality_rules, op8_substring_dedup, op9_source_mixing, op10_bpe, op11_periodic_runs, op12_whitening, op13_harmonic_packing)}


OP8_SQL = """
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents),
places as (select doc_id, words, unnest(range(1, len(words) - 11)) as i from w where len(words) >= 13),
windows as (select doc_id, i, array_to_string(list_slice(words, i, i + 12), ' ') as body from places),
firsts as (select body, min(doc_id) as first_id from windows group by body having min(doc_id) < max(doc_id)),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as pos from windows join firsts using (body) where first_id < doc_id),
word_rows as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as pos from w),
left_over as (select doc_id, string_agg(word, ' ' order by pos) as body, count(*) as n from word_rows anti join gone using (doc_id, pos) group by doc_id)
select w.doc_id, len(words) as n_words, len(words) - coalesce(n, 0) as n_removed, sha256(coalesce(body, '')) as kept_sha256 from w left join left_over using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    """Only what SQL can express over whole tables in reasonable time; the rest is tested by brute force."""
    return {"op8_substring_dedup": OP8_SQL}
