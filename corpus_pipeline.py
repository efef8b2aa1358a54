"""Corpus pipeline: language identification, near-duplicates, personal data, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each
stage's result as Parquet in the shared folder and reads it back for the next.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattline.llm import langid, mixing, packing, pii, setsketch
from wattline.llm.common import crc_mod, fresh, scratch_path, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those that the model rejects go.

    The model learns from the labelled languages of the table itself."""
    labelled = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").filter(crc_mod(F.col("doc_id"), 5) != 0)
    return langid.keep_known(docs, langid.train(labelled))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (the one with the least id; without any id, the one
    with the least text key), and all without any.

    Rows that repeat doc_id and text are one document; of the rows without doc_id, all without words stay."""
    kid, ktk, tk, nr = (fresh(docs, x) for x in ("kept_id", "kept_text", "text_key", "nr"))
    found = setsketch.grouped(docs.select("doc_id", "text"), setsketch.Params())
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tk")
    heads = found.filter("root is not null").groupBy("root").agg(F.min(key).alias("x")).select("x.doc_id", "x.tk")
    bare = found.filter("root is null and doc_id is not null").select("doc_id", "tk").distinct()
    keep = heads.union(bare).distinct().select(F.col("doc_id").alias(kid), F.col("tk").alias(ktk))
    stay = F.col("doc_id").isNull() & ~F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    named = docs.filter(~stay).withColumn(tk, setsketch.text_key(F.col("text")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(kid)) & F.col(tk).eqNullSafe(F.col(ktk))
    once = Window.partitionBy("doc_id", tk).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    rows = named.join(keep, same, "left_semi").withColumn(nr, F.row_number().over(once)).filter(F.col(nr) == 1)
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns]).union(docs.filter(stay))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by surrogates; n_chars follows the text."""
    out = pii.replace_pii(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType))) if "n_chars" in docs.columns else out


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources mixed to their target weights, in the mix's order; a document taken twice stands twice."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences."""
    return packing.pack(docs, packing.Params(special=True))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("pack_sequences", pack_sequences),
]

#: Training and hashing by sketches have no SQL form; tests hold each stage against a plain version: a loop over
#: documents, all pairs, naive replacement, a queue served word by word, the tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
