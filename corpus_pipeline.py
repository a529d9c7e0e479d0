"""The corpus pipeline: toxicity, near-duplicates, secrets, mixture and tokens, one stage after the other.

Each stage is a function of (spark, docs, sf_dir) that returns a DataFrame; its result is written as Parquet and
read again as the next stage's ``docs``. Stages work on whole tables with columns renamed, so that extra columns
of any name pass through. An empty table passes every stage as an empty table.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propval.llm import mixing, secret_scan, sentencepiece_viterbi, simhash, toxicity
from propval.llm.common import numbered, shared_path, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under 0.5; learned from ``labels``, held-out ids aside."""
    rows, name = numbered(docs)
    scorer = toxicity.fit_documents(rows, table(spark, sf_dir, "labels"), name["doc_id"], name["text"])
    if scorer.undecided:
        warnings.warn("toxicity: the labels teach nothing, so this stage keeps every document", stacklevel=2)
    scored = toxicity.score(rows, rows.columns, name["text"], scorer)
    return scored.filter("score < 0.5").drop("score").toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates: 4-word shingles, 4 differing bits at most."""
    rows, name = numbered(docs)
    return simhash.keep_one(rows, name["doc_id"], name["text"]).toDF(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret found in them replaced by a mark, n_chars brought up to date."""
    rows, name = numbered(docs)
    found = secret_scan.find_secrets(rows, name["text"], rows.columns)
    text = F.when(F.col(name["text"]).isNotNull(), secret_scan.redact(F.col(name["text"]), F.col("spans")))
    clean = found.select(*[text.alias(c) if c == name["text"] else F.col(c) for c in rows.columns], (F.size("spans") > 0).alias("changed"))
    if "n_chars" in name:
        kind = rows.schema[name["n_chars"]].dataType
        clean = clean.withColumn(name["n_chars"], F.when(F.col("changed"), F.length(name["text"]).cast(kind)).otherwise(F.col(name["n_chars"])))
    return clean.drop("changed").toDF(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mixture takes, a document taken twice as two rows."""
    rows, name = numbered(docs)
    mixed = mixing.mix_documents(rows, rows.columns, key=name["doc_id"], text=name["text"], source=name["source"])
    taken = mixed.filter("times > 0").withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return taken.select(*rows.columns).toDF(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces and ids of every document, by piece_bpe_32k.model, and whether decoding gives back its text."""
    import public_tokenizers
    found = sentencepiece_viterbi.encode(docs, ["doc_id"], "text", public_tokenizers.path("piece_bpe_32k.model"), check=True)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

ORACLE_SQL = None  # the trained models and hashes of the stages are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; doc_id, n_pieces and ids of those left. Warns where ids do not decode to their text."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    lost = docs.filter("not round_trip").count()
    if lost:
        warnings.warn(f"sentencepiece: the ids of {lost} documents do not decode to their texts", stacklevel=2)
    return docs.drop("round_trip")
