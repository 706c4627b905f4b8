"""The corpus operators' registered queries, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.llm import decontam, langid, licenses, near_dups, oracles, packing, quality, secrets, token_files, urls, warc
from meridian.llm.tokens import public_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = dict(oracles.ORACLES)


def query(f):
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, ids_of = token_files.write_files(read(spark, sf_dir, "documents"), public_path("word_bpe_49k.json"), end_id=2)
    return token_files.read_files(manifest, ids_of).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"), end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secret_spans")
    base = tuple(k[0] for k in secrets.STRONG)
    count = [F.size(secrets.of_kinds(F.col("secret_spans"), (k,))).cast("long").alias(f"n_{k}") for k in base]
    sha = F.sha2(secrets.joined(F.col("secret_spans"), base), 256)
    return found.select("doc_id", *count, sha.alias("base_sha256"), secrets.joined(F.col("secret_spans")).alias("spans"))


#: The rules of the URL filter query: verdict, host, path.
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


@query
def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"), URL_RULES, urls.fit(spark)).select("page_id", "host", "path", "rule", "verdict", F.round("probability", 6).alias("probability"))


@query
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.recognise(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"), F.array_join("classes", ",").alias("classes"))


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judge(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.is_held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return langid.predict(docs, model).select("doc_id", langid.is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.index(warc.write_archives(read(spark, sf_dir, "pages")))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op4_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dups.groups(read(spark, sf_dir, "documents"), words=3, percent=85)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


@query
def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
