"""A training corpus from `documents`: language ID, near-dedup, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's result below the
shared folder and hands the next one the table reread. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilcast.llm.common import stage_table
from veilcast.llm.language import fit, fits, held_out, predict
from veilcast.llm.mixing import mix
from veilcast.llm.near_text import near_components
from veilcast.llm.postings import covered, decontaminate
from veilcast.llm.sharding import shuffle_into_shards
from veilcast.llm.tokens import with_token_counts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SURE = 0.5  # least posterior of the language
CONFIDENT = 0.99  # posterior from which another label is taken for wrong


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters (null and empty ones too), those whose language stays below SURE and those unlike the known
    texts of that language go. A null lang gets the predicted one, and so does a learned one that the model contradicts
    with CONFIDENT or more. Rows with a label that the model hasn't learned can't be judged: they stay, if they have letters.

    The model learns from all labelled documents outside the held-out third; what its languages' texts are like is
    measured on all labelled ones inside. Each text is scored once, into a table."""
    model = fit(docs.filter(~held_out("doc_id")), sample_docs=None)
    scored, _ = stage_table(predict(docs.select(*COLUMNS), model, details=True).filter("letters > 0"))
    like = fits(scored.filter(held_out("doc_id") & F.col("lang").isNotNull()))
    unlearned = F.coalesce(~F.col("lang").isin(model[0]), F.lit(False))
    kept = scored.filter(unlearned | ((F.col("lang_pred") != "und") & (F.col("score") >= SURE) & like))
    trusted = F.col("lang").isNotNull() & (unlearned | (F.col("score") < CONFIDENT))
    return kept.withColumn("lang", F.when(trusted, F.col("lang")).otherwise(F.col("lang_pred"))).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similarity 0.8 or more of their five-word shingles, the rows of the smallest id stay. Rows
    without an id or without words link with nothing and stay, and so do repeats of a row that stays."""
    found = near_components(docs)
    gone = found.filter("NOT kept AND id IS NOT NULL").select(F.col("id").alias("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or all words of a shorter item, go. Texts decide, so
    rows of null and of repeated ids are judged by their own."""
    texts = docs.withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64(F.lit(1), "text"))
    found = decontaminate(texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), extra=("k1", "k2"))
    hit = found.filter(covered() > 0).select("k1", "k2").distinct()
    return texts.join(hit, ["k1", "k2"], "left_anti").select(*COLUMNS)


def raked_sample(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with the raked probabilities of their source, language and topic, weighed by their tokens. Texts
    without any token weigh nothing and are drawn with their cell's probability. Null sources and languages are values of their own; an empty table gives an empty one."""
    counted, _ = stage_table(with_token_counts(docs.select(*COLUMNS), "text", "n_tokens"))
    return mix(counted, weight_col="n_tokens").filter("kept").select(*COLUMNS)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in shards of equal counts, uniformly permuted; nulls, ties and repeats are rows like others."""
    return shuffle_into_shards(docs.select(*COLUMNS))


STAGES = [
    ("language", known_language),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmarks),
    ("mixture", raked_sample),
    ("shards", shards),
]

#: The model of the first stage and the permutation of the last aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs, _ = stage_table(docs)
    return docs
