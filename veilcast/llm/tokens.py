"""Operator 3, token counts, and the unit encoder that operator 4 shares.

Byte-level BPE splits a text into pre-tokens before it merges, and no pre-token holds a non-space
character followed by white space. A text can therefore be cut before white space without changing its
tokens; what lies between two cuts is a unit. Units repeat, so a count is a sum of looked-up lengths:
first in a table of frequent units that is broadcast, then in a cache that each Python worker keeps for
its whole life. Only units that neither holds are encoded, by the tokenizers library itself. Units are
never shuffled: the frequent ones are found by mergeable sketches of fixed size, on the JVM.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, require, worker_state

VOCABULARY = "byte_bpe_50k.json"
FREQUENT = 20_000
TRACKED = 40_000
SKETCH_GROUPS = 16
CACHE_UNITS = 300_000
LONGEST_UNIT = 64  # characters; longer units are rare words or texts without spaces, and never kept
MAX_TOKENS = 512

#: White space on whose class the libraries could differ, or that needs care with the cuts.
ODD = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
UNIT = re.compile(r"\s*\S+|\s+")
#: What may not be in a unit that the rank-based encoder takes: line breaks, and characters beyond the
#: long-settled scripts, whose Unicode class libraries may know differently.
FAR = re.compile("[\r\n\u0590-\U0010ffff]")
#: What may not be in a whole text that the rank-based encoder takes: those characters but line breaks.
LATER = re.compile("[\u0590-\U0010ffff]")
LONGEST_RUN = 2 * LONGEST_UNIT  # bytes with or without white space in such a text; its merging is quadratic in them
BLANK = np.isin(np.arange(256), list(b" \t\n\r"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself if it is printable, else the next one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def ranked_twin(path: str):
    """An encoder over the same vocabulary as byte ranks, several times as fast on units not seen yet, or None.

    It is used only if the file proves it equal: the model is plain BPE on the bytes of the pattern's pre-tokens; every rank
    is the id of the same bytes in the file's vocabulary; and pair k of the merge list makes the token of id 256 + k, as
    then "lowest rank first" and "first pair of the list first" are the same rule."""
    import base64
    import json

    import public_tokenizers
    import tiktoken

    beside = path[: -len(".json")] + ".tiktoken"
    if not path.endswith(".json") or not os.path.exists(beside):
        return None
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, before = file["model"], file.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    # the library's own byte-level pre-tokenizer splits by this very pattern
    if not plain or file.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex"):
        return None
    vocab, letters = model["vocab"], byte_letters()
    pairs = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    if any(vocab[p] != 256 + k for k, p in enumerate(pairs)):
        return None
    with open(beside, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    added = {t["content"] for t in file.get("added_tokens", [])}
    if {"".join(letters[c] for c in raw): k for raw, k in ranks.items()} != {t: k for t, k in vocab.items() if t not in added}:
        return None
    return tiktoken.Encoding("twin", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def longest_run(text: str) -> int:
    """Bytes of the longest run with or without blanks in a text that isn't empty."""
    blank = BLANK[np.frombuffer(text.encode(), np.uint8)]
    return int(np.diff(np.flatnonzero(blank[1:] != blank[:-1]), prepend=-1, append=len(blank) - 1).max())


class UnitEncoder:
    """Encodes texts by units; `wrap` turns the ids of a unit into what is kept of them, and wrap_runs
    does so for many runs of one array, given their starts and ends.

    `known` maps units that follow a space (without that space) to kept values. Two generations of
    cache bound the memory: a full young one becomes the old one, and hits in the old one move up. Units of more than
    LONGEST_UNIT characters are encoded each time, so `cache_units` bounds bytes too. With `whole_texts`, texts that the rank-based
    encoder takes are encoded by it at once, without units: faster where ids are wanted and many units are rare."""

    def __init__(self, path: str, wrap, known: dict | None = None, cache_units: int = CACHE_UNITS, wrap_runs=None, whole_texts: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()  # whatever the file sets
        self.library.no_padding()
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.wrap, self.known, self.limit = wrap, known or {}, cache_units
        self.wrap_runs = wrap_runs or (lambda ids, a, b: map(int.__sub__, b, a))
        self.twin = ranked_twin(path)
        self.whole_texts = whole_texts and self.twin is not None
        self.newline = self.twin.encode("\n")[0] if self.twin else None
        self.young: dict = dict(self.known)
        self.old: dict = {}

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _learn(self, units: set[str]) -> None:
        """Encodes units that the caches lack, many in one call: joined by line feeds, whose token
        then parts them. A unit that holds a line feed is encoded by itself."""
        if len(self.young) + len(units) > self.limit:
            self.old, self.young = self.young, dict(self.known)
        far = FAR.search
        plain = [u for u in units if u.isascii() and "\n" not in u and "\r" not in u or not far(u)] if self.twin else []
        alone = list(units.difference(plain)) if self.twin else list(units)
        for at in range(0, len(plain), 4096):
            block = plain[at : at + 4096]
            ids = self.twin.encode_to_numpy("\n " + "\n ".join(block), disallowed_special=())
            cuts = np.flatnonzero(ids == self.newline)
            if len(cuts) != len(block):
                alone += block
                continue
            starts, ends = (cuts + 1).tolist(), [*cuts[1:].tolist(), len(ids)]
            self.young.update(zip(block, self.wrap_runs(ids, starts, ends)))
        if alone:
            for u, e in zip(alone, self.library.encode_batch_fast([" " + u for u in alone], add_special_tokens=False)):
                self.young[u] = self.wrap(np.array(e.ids, dtype=np.int64))

    def wholes(self, texts: list[str]) -> list:
        """The kept values of whole texts, encoded by the library in one call."""
        return [self.wrap(np.array(e.ids, dtype=np.int64)) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def batch(self, texts: list[str]) -> list[list]:
        """For each text the kept values of its units, in order."""
        plans, apart = [], []  # texts and units that the library encodes as they are, once for this batch

        def late(text: str) -> int:
            apart.append(text)
            return len(apart) - 1

        for text in texts:
            if not text:
                plans.append(None)
            elif any(s in text for s in self.specials) or ODD.search(text):
                plans.append(late(text))
            elif self.whole_texts and (text.isascii() or not LATER.search(text)) and longest_run(text) <= LONGEST_RUN:
                plans.append([self.wrap(self.twin.encode_to_numpy(text, disallowed_special=()))])
            else:
                odd: dict[int, int] = {}
                if "  " in text or " \n" in text or " \t" in text or " \r" in text or text[-1] == " ":
                    first, *units = UNIT.findall(text)
                    for k, u in enumerate(units):
                        if u[0] != " " or u[1:2].isspace() or len(u) == 1 or len(u) > LONGEST_UNIT:
                            odd[k], units[k] = late(u), " "
                        else:
                            units[k] = u[1:]
                else:
                    first, *units = text.split(" ")
                    if units and max(map(len, units)) > LONGEST_UNIT:
                        for k, u in enumerate(units):
                            if len(u) > LONGEST_UNIT:
                                odd[k], units[k] = late(" " + u), " "
                plans.append((late(first) if first else None, units, odd))
        young = self.young
        need = {u for u in set().union(*[p[1] for p in plans if type(p) is tuple]) if u not in young}
        if self.old and need:
            moved = {u: self.old[u] for u in need if u in self.old}
            self.young.update(moved)
            need.difference_update(moved)
        if need:
            spare = self.young
            self._learn(need)
            if self.young is not spare:  # a new generation began; this batch may need what the last one knew
                self.young.update({u: spare[u] for p in plans if type(p) is tuple for u in p[1] if u in spare})
        get, out, rest = self.young.__getitem__, [], self.wholes(apart)
        for plan in plans:
            if plan is None:
                out.append([])
            elif type(plan) is list:
                out.append(plan)
            elif type(plan) is int:
                out.append([rest[plan]])
            else:
                first, units, odd = plan
                values = list(map(get, units))
                for k, at in odd.items():
                    values[k] = rest[at]
                if first is not None:
                    values.insert(0, rest[first])
                out.append(values)
        return out


def frequent_units(df: DataFrame, text: str = "text", k: int = FREQUENT) -> list[str]:
    """The k most frequent units of all texts, approximately: each task sketches its own texts in fixed
    memory (approx_top_k), sketches are merged in SKETCH_GROUPS groups and then in one. k bounds what
    reaches the driver; which units are found never changes a count, only how fast it is made."""
    units = df.select(F.spark_partition_id().alias("p"), F.explode(F.split(text, " ")).alias("unit")).filter(F.octet_length("unit") <= 64)
    sketched = units.groupBy(F.pmod("p", F.lit(SKETCH_GROUPS)).alias("g")).agg(F.expr(f"approx_top_k_accumulate(unit, {TRACKED})").alias("s"))
    # grouped by a constant: an ungrouped merge would also be asked of partitions without any sketch, and fails there
    top = sketched.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_combine(s, {TRACKED})").alias("s")).select(F.expr(f"approx_top_k_estimate(s, {k})").alias("top")).first()
    return [] if top is None or top["top"] is None else [r["item"] for r in top["top"] if r["item"]]


def with_token_counts(df: DataFrame, text_col: str = "text", count_col: str = "n_tokens", path: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """df with count_col (long): tokens of each whole text as the tokenizers library counts them without
    added special tokens; strings of special tokens inside a text count as the library's default has it.

    Null and empty texts have 0 tokens; texts of any length are encoded whole; rows that repeat are counted each; an empty table
    gives an empty one; an existing count_col is replaced."""
    require(df, text_col)
    prepare(df.sparkSession)
    path = path or tokenizer_path(VOCABULARY)
    spark = df.sparkSession
    maker = UnitEncoder(path, len)
    table = {}
    if units := frequent_units(df, text_col, frequent):
        units = [u for u in units if len(u) <= LONGEST_UNIT]
        maker._learn(set(units))
        table = {u: maker.young.get(u, maker.old.get(u)) for u in units}
    shared = spark.sparkContext.broadcast(table)  # `frequent` short units at most
    key = ("count", path, uuid.uuid4().hex)
    kept = df.drop(count_col)
    at = kept.columns.index(text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_state(key, lambda: UnitEncoder(path, len, shared.value))
        for batch in batches:
            texts = batch.column(at).to_pylist()
            n = []
            for lo in range(0, len(texts), 256):
                n += [sum(values) for values in encoder.batch(texts[lo : lo + 256])]
            yield pa.record_batch([*batch.columns, pa.array(n, pa.int64())], names=[*batch.schema.names, count_col])

    return kept.mapInArrow(count, T.StructType([*kept.schema.fields, T.StructField(count_col, T.LongType())]))


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, frequent: int = FREQUENT) -> DataFrame:
    """(id_col, n_tokens long), as with_token_counts has it; repeated ids give repeated rows; other columns are ignored."""
    require(df, id_col, text_col)
    return with_token_counts(df.select(id_col, text_col), text_col, "n_tokens", path, frequent).select(id_col, "n_tokens")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    sized = docs.select(F.struct("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes")).alias("key"), "text")
    out = token_counts(sized, id_col="key")
    return out.select("key.doc_id", "key.n_bytes", "n_tokens", (F.col("n_tokens") > MAX_TOKENS).alias("over_limit"))
