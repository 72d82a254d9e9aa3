"""Operator 2, substring dedup by sliding sentence spans.

Every run of RUN consecutive sentences (or, at the caller's choice, every shortest run of a number of
words) is hashed; a run whose hash also occurs at a smaller (id, sentence number) is a repeat, and
the sentences it covers go. First occurrences come from one
aggregation with map-side combining, so a passage that a third of all documents share reaches the
shuffle once for each task. Runs go back to the repeated hashes by a plain equi-join of which one side
is unique, which Spark can split where a hash is hot.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, require

RUN = 3
MARKS = r".!?。！？।۔\n"  # full stops, exclamation and question marks of Latin, Chinese and Japanese, Devanagari and Urdu texts
#: A sentence runs to the end of its closing marks or line, with the blanks after them.
SENTENCE = rf"[^{MARKS}]++[{MARKS}]*+[ \t\r\n\f]*+|[{MARKS}]++[ \t\r\n\f]*+"
BLANKS = " \t\r\n\f"
SINGLE = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"  # kana and Han characters, written without blanks
WORD = rf"[{SINGLE}]|[^{SINGLE} \t\r\n\f]+"


def run_ends(own: list[str], run: int, words: int | None) -> list[int]:
    """Where the run that starts at each sentence ends; the last sentences, which start no whole run, are left out."""
    if words is None:
        return list(range(run, len(own) + 1))
    count = re.compile(WORD).findall
    sums = list(accumulate((len(count(s)) for s in own), initial=0))
    ends = (bisect_left(sums, sums[k] + words, k + 1) for k in range(len(own)))
    return [e for e in ends if e <= len(own)]


def run_hashes(df: DataFrame, run: int = RUN, words: int | None = None) -> DataFrame:
    """(k1, k2, id, at, h1, h2): the 128-bit hash of each run of sentences of each row."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        find, digest = re.compile(SENTENCE).findall, xxhash.xxh3_128_digest
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                index, at, sums = [], [], []
                for k, text in enumerate(part.column(3).to_pylist()):
                    own = [s.strip(BLANKS) for s in find(text)] if text else []
                    ends = run_ends(own, run, words)
                    index += [k] * len(ends)
                    at += range(len(ends))
                    sums += [digest("\n".join(own[i:e])) for i, e in enumerate(ends)]
                halves = pa.py_buffer(b"".join(sums))
                both = pa.Array.from_buffers(pa.int64(), 2 * len(sums), [None, halves])
                even = pa.array(range(0, 2 * len(sums), 2), pa.int64())
                take = pa.array(index, pa.int64())
                yield pa.record_batch(
                    [part.column(0).take(take), part.column(1).take(take), part.column(2).take(take), pa.array(at, pa.int32()), both.take(even), both.take(pa.compute.add(even, 1))],
                    names=["k1", "k2", "id", "at", "h1", "h2"],
                )

    return df.select("k1", "k2", "id", "text").mapInArrow(hashes, "k1 long, k2 long, id long, at int, h1 long, h2 long")


def drop_repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, words: int | None = None) -> DataFrame:
    """df with text_col less its repeated sentences, and n_sentences and n_removed (long).

    Sentences compare without blanks at their ends. Null texts stay null and empty ones empty, with no sentences; a
    text of fewer than `run` sentences has no runs and stays as it is. A null id comes after all others.
    With `words`, a run is the shortest one from a sentence on that has that many words, whatever its number of sentences,
    so a long sentence is a run and three short ones are none; words end at blanks, and kana and Han characters are one each.
    Rows alike in id and text are one occurrence, so repeats of a whole row don't erase each other.
    An empty table gives an empty one; existing columns n_sentences and n_removed are replaced."""
    require(df, id_col, text_col)
    prepare(df.sparkSession)
    df = df.drop("n_sentences", "n_removed")
    ids, text = F.col(id_col).cast("long"), F.col(text_col)
    keys = df.select(F.xxhash64(ids, text).alias("k1"), F.xxhash64(text, ids, F.lit(1)).alias("k2"), F.coalesce(ids, F.lit((1 << 63) - 1)).alias("id"), text.alias("text"))
    runs = run_hashes(keys, run, words)
    first = runs.groupBy("h1", "h2").agg(F.min(F.struct("id", "at")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("h1", "h2", "first")
    repeats = runs.join(first, ["h1", "h2"]).filter((F.col("id") != F.col("first.id")) | (F.col("at") != F.col("first.at")))
    spans = repeats.groupBy("k1", "k2").agg(F.collect_set("at").alias("starts"))

    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        find = re.compile(SENTENCE).findall
        for texts, starts in batches:
            kept, n, gone = [], [], []
            for t, s in zip(texts.tolist(), starts.tolist()):
                own = find(t) if t else []
                ends = run_ends(own, run, words) if s is not None else []
                drop = {k for a in s for k in range(a, ends[a])} if s is not None else set()
                n.append(len(own))
                gone.append(len(drop))
                kept.append("".join(x for k, x in enumerate(own) if k not in drop) if drop else t)
            yield pd.DataFrame({"kept": kept, "n": n, "gone": gone})

    cutter = F.pandas_udf(cut, "kept string, n long, gone long")
    tagged = df.withColumn("__vc_k1", F.xxhash64(ids, text)).withColumn("__vc_k2", F.xxhash64(text, ids, F.lit(1)))
    joined = tagged.join(spans.select(F.col("k1").alias("__vc_k1"), F.col("k2").alias("__vc_k2"), F.col("starts").alias("__vc_starts")), ["__vc_k1", "__vc_k2"], "left")
    done = joined.withColumn("__vc_cut", cutter(F.col(text_col), F.col("__vc_starts")))
    return done.select(*[F.col("__vc_cut.kept").alias(c) if c == text_col else F.col(c) for c in df.columns], F.col("__vc_cut.n").alias("n_sentences"), F.col("__vc_cut.gone").alias("n_removed"))


def op2_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_sentences", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("changed"))


ORACLE_SQL = rf"""
WITH s AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^{MARKS}]+[{MARKS}]*[ \t\r\n\f]*|[{MARKS}]+[ \t\r\n\f]*') AS ss FROM documents
), r AS (
  SELECT doc_id, k, array_to_string([trim(x, e' \t\r\n\f') FOR x IN ss[k : k + {RUN - 1}]], e'\n') AS h
  FROM s, unnest(range(1, CAST(len(ss) - {RUN - 2} AS BIGINT))) AS t(k)
), f AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, k) AS rn FROM r),
g AS (SELECT DISTINCT doc_id, k + j AS k FROM f, unnest(range(0, {RUN})) AS t(j) WHERE rn > 1),
gs AS (SELECT doc_id, list(k) AS gone FROM g GROUP BY doc_id)
SELECT doc_id, CAST(len(ss) AS BIGINT) AS n_sentences, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string([ss[k] FOR k IN range(1, CAST(len(ss) + 1 AS BIGINT)) IF NOT list_contains(coalesce(gone, []), k)], '')) AS kept_sha256, coalesce(len(gone), 0) > 0 AS changed
FROM s LEFT JOIN gs USING (doc_id)
"""
