"""Corpus preparation in five stages, each on all that its predecessor kept.

1. language_id drops documents that op3 calls ``und``: those without any letter. A script without labelled rows is no ground.
2. near_duplicates keeps one document, that with the smallest id, of each class of near copies (five words, Jaccard 0.8).
3. decontamination drops documents that hold a benchmark item.
4. secrets masks every secret span in the texts and counts characters anew.
5. packing cuts the documents into pieces and packs these into windows of 4096 tokens.

Stages 1 to 4 return the columns of ``documents`` and any others that came with them, whatever their names; the last
returns a row for each piece.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import decontaminate, jaccard_join, language_id, packing, secret_scan
from tallyspark.llm.common import discard, fresh, shared_path, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _columns(docs: DataFrame) -> list[str]:
    """The columns of documents, and any others that came with them."""
    return [*COLUMNS, *(c for c in docs.columns if c not in COLUMNS)]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model, fitted on labelled rows, gives a language; without labelled rows, those whose text has letters."""
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    return language_id.identified(docs.select(*_columns(docs)), model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, known by its id and text, so that texts that share an id stand for themselves. Of rows equal in
    both, the one whose columns have the least hash. Null ids are all kept."""
    own, same, h, row = fresh(docs, "id", "same", "text_hash", "row")
    classes = jaccard_join.near_duplicates(docs, k=5, similarity=(80, 100))
    firsts = classes.where((F.col("doc_id") == F.col("component_id")) & (F.col("text_hash") == F.col("component_hash")))
    first = firsts.select(F.col("doc_id").alias(own), F.col("text_hash").alias(same)).distinct()
    hashed = docs.where("doc_id is not null").withColumn(h, F.xxhash64(F.col("text").cast("string")))
    known = hashed.join(first.hint("merge"), (F.col("doc_id") == F.col(own)) & (F.col(h) == F.col(same)), "left_semi")
    columns = _columns(docs)
    one = known.groupBy("doc_id", h).agg(F.min_by(F.struct(*columns), F.xxhash64(*columns)).alias(row)).select(f"{row}.*")
    return one.unionByName(docs.where("doc_id is null").select(*columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without leaks; of texts that share an id those that leak go."""
    key, own = fresh(docs, "key", "own")
    keyed = docs.withColumn(key, F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h")))
    leaks = decontaminate.leaks(keyed, table(spark, sf_dir, "benchmark"), doc_id=key)
    leaking = stored(leaks.select(F.col("doc_id").alias(own)).distinct(), "leaking")
    same = keyed[key]["id"].eqNullSafe(F.col(own)["id"]) & (keyed[key]["h"] == F.col(own)["h"])
    return keyed.join(leaking, same, "left_anti").select(*_columns(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    own, blob, spans, new = fresh(docs, "id", "blob", "spans", "new")
    found = secret_scan.scan_versions(docs, shared_path(spark, "secret-ledger"), path="doc_id").where(F.size("spans") > 0)
    found = found.select(F.col("doc_id").alias(own), F.col("blob").alias(blob), F.col("spans").alias(spans)).dropDuplicates([own, blob])
    found = stored(found, "secrets")
    same = F.col("doc_id").eqNullSafe(F.col(own)) & (F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)) == F.col(blob))
    joined = docs.join(found, same, "left")
    clean = F.col(spans).isNull()
    masked = joined.withColumn(new, F.when(clean, F.col("text")).otherwise(secret_scan.redacted(F.col("text"), F.col(spans))))
    counted = masked.withColumn("n_chars", F.when(clean, F.col("n_chars")).otherwise(F.length(new).cast("bigint")))
    return counted.withColumn("text", F.col(new)).select(*_columns(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their ids, places and windows."""
    pieces = packing.tokenize_windows(docs, public_tokenizers.path("word_bpe_49k.json"), window=4096, end_id=2)
    return packing.pack_windows(pieces, window=4096)


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("packing", pack)]
#: Models, edit distances and packing aren't SQL; tests compare the pipeline with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if name != STAGES[0][0]:
            discard(before)  # a copy of the corpus that no later stage reads
    return STAGES[-1][1](spark, docs, sf_dir)
