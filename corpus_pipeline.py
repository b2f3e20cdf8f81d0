"""From raw documents to token ids, in five stages.

Each stage gets what its predecessor kept and returns the columns of documents, the last one the coded texts:

1. language ID: a document stays if its pooled language probability is MIN_SCORE at least; texts without a letter (null and empty ones
   among them) go. The network learns from the rows that have a label, on a bounded sample.
2. line dedup: lines that stand earlier in the corpus, whole or but for one word in eight (three at most), go; every document stays, and n_chars is counted anew.
3. SimHash near-dedup: of each component one document stays, the one with the smallest id (five words a shingle, as for all stages on
   shingles; two texts are linked if their sets of shingles have a Jaccard similarity of 0.8 at least).
4. benchmark decontamination: documents that contain a benchmark item, at a similarity of 0.8 or more, go.
5. BPE encoding and decoding: one row per document with its token ids, their number and the decoded text.

Repeated rows, null ids and clashing extra columns: as the operators' own modules state. Empty tables give empty results. SQL
can't express the first stage's network, so there is no SQL; the stages are tested one by one against plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trustloom.llm import bpe, decontaminate, language_id, line_dedup, scratch, simhash

MIN_SCORE = 0.4
SHINGLE = 5
SIMILARITY = 0.8


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = language_id.fit(docs, "text", "lang")
    said = language_id.predict(docs, net, "text", "_lang", "_score")
    return said.filter((F.col("_lang") != "und") & (F.col("_score") >= MIN_SCORE)).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(docs)
    counted = F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.withColumn("n_chars", counted).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs, shingle=SHINGLE, similarity=SIMILARITY)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out="_matches")
    return found.filter(F.size("_matches") == 0).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = bpe.encode_corpus(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", "ids", "decoded")


STAGES = [
    ("language_id", keep_language),
    ("line_dedup", drop_lines),
    ("simhash", keep_one_of_each),
    ("decontaminate", drop_leaks),
    ("bpe", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.stored(docs, name)
    return docs
