"""Registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm import audit, langid, layout, lcp, mixing, packing, periodic, pii, secret_scan, setsketch, srs, toxicity, warc
from wattline.llm.common import crc_mod, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op3_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query
def op6_setsketch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"), setsketch.Params(percent=85))


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.filter(crc_mod(F.col("doc_id"), 5) != 0))
    found = langid.identify(docs.select("doc_id", "text"), model)
    x = F.col("langid")
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), x["lang"].alias("lang_pred"), x["score"].alias("score"), x["rejected"].alias("rejected"))


@query
def op7_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.Params(special=True))


@query
def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), count="n_entities")


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.filter(crc_mod(F.col("doc_id"), 3) != 1))
    found = toxicity.detect(docs, model)
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"))


@query
def op10_lcp_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lcp.fingerprint_with_edits(table(spark, sf_dir, "documents"))


@query
def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


@query
def op5_srs_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return srs.nearest(rows, rows.filter("vec_id % 50 = 0"))


@query
def op4_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.extract(table(spark, sf_dir, "pages"))


@query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.collapse_runs(table(spark, sf_dir, "documents"), edit=periodic.repeated_tail))


@query
def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(table(spark, sf_dir, "documents")))
