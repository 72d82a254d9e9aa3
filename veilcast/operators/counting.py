"""Counters of groups from unit rows, by array operations on hash bits.

64 values for each call would be 64 expressions in a plan, and their code too long for the JVM to compile well. So each task
turns its rows' hashes into a matrix of bits and reduces it group by group: one row a group leaves the task, with a list
of 64 for each call. Those rows are exchanged by group, sorted, and reduced once more as they stream by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.worlds import WORLDS

HELD = 4096  # groups that a task holds at a time; more leave it in several parts
ROWS = 4096  # whose bits are spread out at a time
BITS = np.arange(WORLDS, dtype=np.uint64)
REDUCE = {"sum": np.add, "min": np.fmin, "max": np.maximum}
NOTHING = {"sum": 0.0, "min": np.inf, "max": -np.inf}


def _codes(columns: list[pa.Array], n: int) -> np.ndarray:
    """A number for each row, equal for rows with equal keys; nulls are equal."""
    code = np.zeros(n, np.int64)
    for c in columns:
        own = c.dictionary_encode("encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        _, code = np.unique(code * (int(own.max(initial=0)) + 1) + own, return_inverse=True)
    return code


def _key(values: tuple) -> tuple:
    return tuple("NaN" if x != x else x if not isinstance(x, (list, dict)) else repr(x) for x in values)


class Groups:
    """Running values of groups: updates, and for each call 64 counters and the worlds that any value is in."""

    def __init__(self, keys: list[str], funcs: list[str]):
        self.keys, self.funcs = keys, funcs
        self.clear()

    def clear(self) -> None:
        self.at, self.first = {}, []
        self.updates = np.zeros(0, np.int64)
        self.values = [np.zeros((0, WORLDS)) for _ in self.funcs]
        self.masks = [np.zeros(0, np.int64) for _ in self.funcs]

    def add(self, columns: list[pa.Array], updates: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Rows with their keys; parts: for each call their 64 counters and masks."""
        code = _codes(columns, len(updates))
        order = np.argsort(code, kind="stable")
        starts = np.flatnonzero(np.diff(code[order], prepend=-1))
        some = pa.array(order[starts])
        named = list(zip(*[c.take(some).to_pylist() for c in columns])) if columns else [()] * len(starts)
        place = np.array([self.at.setdefault(_key(k), len(self.at)) for k in named], np.int64)
        if (new := len(self.at) - len(self.updates)) > 0:
            seen = len(self.first)
            fresh = {int(p): k for p, k in zip(place, named) if p >= seen}
            self.first += [fresh[p] for p in range(seen, len(self.at))]
            self.updates = np.concatenate([self.updates, np.zeros(new, np.int64)])
            self.values = [np.concatenate([v, np.full((new, WORLDS), NOTHING[f])]) for f, v in zip(self.funcs, self.values)]
            self.masks = [np.concatenate([m, np.zeros(new, np.int64)]) for m in self.masks]
        self.updates[place] += np.add.reduceat(updates[order], starts)
        for k, (f, (counters, masks)) in enumerate(zip(self.funcs, parts)):
            self.values[k][place] = REDUCE[f](self.values[k][place], REDUCE[f].reduceat(counters[order], starts, axis=0))
            self.masks[k][place] |= np.bitwise_or.reduceat(masks[order], starts)

    def batch(self, kinds: list[pa.DataType], final: bool) -> pa.RecordBatch:
        """All groups as rows; a counter that no value reached is 0 in the end."""
        keys = [pa.array([x[k] for x in self.first], t) for k, t in enumerate(kinds)]
        cells = []
        for v, m in zip(self.values, self.masks):
            flat = np.where(np.isinf(v) & ((m.view(np.uint64)[:, None] >> BITS) & np.uint64(1) == 0), 0.0, v) if final else v
            cells += [pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * WORLDS), pa.array(flat.ravel())), pa.array(m)]
        return pa.record_batch([*keys, pa.array(self.updates), *cells], names=[*self.keys, "__updates", *[f"__{x}{k}" for k in range(len(self.funcs)) for x in "ab"]])


def _spread(h: np.ndarray, value: np.ndarray, there: np.ndarray, func: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of rows as 64 counters each, and the hashes of those that have a value."""
    own = np.where(there, h, 0)
    on = (own.view(np.uint64)[:, None] >> BITS) & np.uint64(1) == 1
    return np.where(on, value[:, None], NOTHING[func]), own


def _partial(batches: Iterator[pa.RecordBatch], keys: list[str], funcs: list[str]) -> Iterator[pa.RecordBatch]:
    groups, n_keys, kinds = Groups(keys, funcs), len(keys), None
    for whole in batches:
        kinds = [whole.schema.field(k).type for k in range(n_keys)]
        for lo in range(0, whole.num_rows, ROWS):
            batch = whole.slice(lo, ROWS)
            h, updates = (batch.column(n_keys + k).to_numpy(zero_copy_only=False) for k in (0, 1))
            parts = []
            for k, f in enumerate(funcs):
                c = batch.column(n_keys + 2 + k)
                parts.append(_spread(h, c.fill_null(0.0).to_numpy(zero_copy_only=False), c.is_valid().to_numpy(zero_copy_only=False), f))
            groups.add([batch.column(k) for k in range(n_keys)], updates, parts)
            if len(groups.at) >= HELD:
                yield groups.batch(kinds, False)
                groups.clear()
    if groups.at:
        yield groups.batch(kinds, False)


def _merge(batches: Iterator[pa.RecordBatch], keys: list[str], funcs: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key -> one row a group."""
    groups, n_keys, kinds = Groups(keys, funcs), len(keys), None
    for whole in batches:
        kinds = [whole.schema.field(k).type for k in range(n_keys)]
        for lo in range(0, whole.num_rows, ROWS):
            batch = whole.slice(lo, ROWS)
            if len(groups.at) >= HELD:  # all but the last group, which may go on, are whole
                last = _key(tuple(batch.column(k)[0].as_py() for k in range(n_keys)))
                if last not in groups.at:
                    yield groups.batch(kinds, True)
                    groups.clear()
            parts = []
            for k in range(len(funcs)):
                lists = batch.column(n_keys + 1 + 2 * k)
                parts.append((lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, WORLDS), batch.column(n_keys + 2 + 2 * k).to_numpy(zero_copy_only=False)))
            groups.add([batch.column(k) for k in range(n_keys)], batch.column(n_keys).to_numpy(zero_copy_only=False), parts)
    if groups.at:
        yield groups.batch(kinds, True)


def world_table(rows: DataFrame, keys: list[str], specs: list[tuple[str, str, str, Column]], updates: Column | None = None) -> DataFrame:
    """(keys, __updates, counters and mask of each spec): the values of rows (hash __h) in each world. A spec names its
    counters, its mask, its function (sum, min or max) and its value. Without keys there is one row, also of no rows."""
    funcs = [f for _, _, f, _ in specs]
    wide = rows.select(*keys, "__h", (F.lit(1) if updates is None else updates).cast("long").alias("__u"), *[v.cast("double").alias(f"__i{k}") for k, (_, _, _, v) in enumerate(specs)])
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in wide.schema.fields[: len(keys)]]
    cells = [f"__{x}{k} {t}" for k in range(len(specs)) for x, t in (("a", "array<double>"), ("b", "long"))]
    schema = ", ".join([*kinds, "__updates long", *cells])
    parts = wide.mapInArrow(lambda b: _partial(b, keys, funcs), schema)
    if keys:
        merged = parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda b: _merge(b, keys, funcs), schema)
    else:
        none = [x for f in funcs for x in ([NOTHING[f]] * WORLDS, 0)]
        zero = rows.sparkSession.createDataFrame([(0, *none)], schema)
        merged = parts.unionByName(zero).repartition(1).mapInArrow(lambda b: _merge(b, keys, funcs), schema)
    out = [c for k, (counters, mask, _, _) in enumerate(specs) for c in (F.col(f"__a{k}").alias(counters), F.col(f"__b{k}").alias(mask))]
    return merged.select(*keys, "__updates", *out)
