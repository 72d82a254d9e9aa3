"""Operator 9, suffix-array dedup by a common-prefix-aware distributed merge sort.

To tell which windows of LENGTH bytes also start earlier, not every suffix need be sorted. Each window has an
anchor, the leftmost position whose GRAM-byte hash is smallest in it; equal windows have equal anchors at
equal offsets. So the suffixes that are sorted are those at anchors, about one in 35 bytes, each with
the few bytes to its left that its windows reach back to.

1. Anchors that occur once can't matter. Tasks exchange sorted, delta-coded anchor hashes by range and get
   back a bit for each: repeated or not.
2. Each task sorts its repeated anchors' suffixes, finds the windows that repeat inside the run, and sends
   the rest: sorted runs, front-coded (common prefix with the last suffix, then the remainder), cut at
   sampled splitters. A passage that a third of all documents share leaves a task once.
3. Runs of a range are combined by a loser tree in which every contender knows its common prefix with the
   last winner; known prefixes are never compared again, and the merged common prefixes come for free.
4. For each offset of a window to its anchor, windows are equal if their suffixes stay together under
   common prefixes of at least the rest of the window and their left bytes agree. All but the
   earliest of equal windows are repeats.

Answers return to the task that owns a document by mail: tables in the shared folder, a folder for each
input partition. So texts are never shuffled. That needs a scan that deals out the same rows each time,
which is verified by counts, ids and ends, and fails else; a plan with an exchange is first written to the shared folder.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, prepare, require, stage_table

LENGTH = 100
CHUNK = 1 << 20
RUN_ANCHORS = 250_000
POSITION_BITS = 28  # beside the hash in a key; longer data is taken in overlapping pieces
PIECE = 1 << 27
HASH_BITS = 48
SAMPLES = 32
U = np.uint64
LAST = (1 << 63) - 1


def gram_of(length: int) -> int:
    """Bytes of an anchor's gram: the largest power of two up to a third of the window, 32 at most."""
    return min(32, 1 << max(0, (length // 3).bit_length() - 1))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each run of `gram` bytes, by doubling."""
    with np.errstate(over="ignore"):
        h, n = mix64(data.astype(U) + U(0x51ED270B)), 1
        while n < gram:
            h = h[:-n] * U(0x9E3779B97F4A7C15 + 2 * n) + (h[n:] ^ (h[n:] >> U(29)))
            n *= 2
    return mix64(h)


def anchors_of(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(position, first window, last window, gram hash) of the anchors of concatenated texts.

    Data of more than PIECE bytes is taken in pieces that overlap by less than a window, so each window is in one. Places keep their
    order in a piece, so equal windows have equal anchors there too; an anchor at a border comes twice, with windows of its own."""
    if len(data) > PIECE:
        found = []
        for lo in range(0, len(data), PIECE):
            hi = min(len(data), lo + PIECE + length - 1)
            own = np.unique(np.clip(ends - lo, 0, hi - lo))
            pos, start, stop, h = anchors_of_piece(data[lo:hi], own[own > 0], length)
            found.append((pos + lo, start + lo, stop + lo, h))
        return tuple(np.concatenate(c) for c in zip(*found))
    return anchors_of_piece(data, ends, length)


def anchors_of_piece(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    gram = gram_of(length)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none.astype(U)
    h = gram_hashes(data, gram)
    low = U((1 << POSITION_BITS) - 1)
    key, n, want = (h & ~low) | np.arange(len(h), dtype=U), 1, length - gram + 1
    while 2 * n <= want:
        key = np.minimum(key[:-n], key[n:])
        n *= 2
    if n < want:
        key = np.minimum(key[: len(key) - (want - n)], key[want - n :])
    stop = np.repeat(ends, np.diff(ends, prepend=0))
    at = np.flatnonzero(stop[: len(key)] - np.arange(len(key)) >= length)
    if not len(at):
        return none, none, none, none.astype(U)
    pos = (key[at] & low).astype(np.int64)
    fresh = np.flatnonzero(np.concatenate([[True], (pos[1:] != pos[:-1]) | (at[1:] != at[:-1] + 1)]))
    last = np.append(fresh[1:], len(at)) - 1
    return pos[fresh], at[fresh], at[last], h[pos[fresh]]


def chunks_of(batches: Iterator[pa.RecordBatch]):
    """(ids, data, ends, ordinal of the first) of whole texts, about CHUNK bytes at a time."""
    ids, raws, held, first = [], [], 0, 0
    for batch in batches:
        for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(LAST if i is None else i)
            raws.append(raw or b"")
            held += len(raws[-1])
            if held >= CHUNK:
                yield ids, np.frombuffer(b"".join(raws), np.uint8), np.cumsum([len(r) for r in raws]), first
                first += len(ids)
                ids, raws, held = [], [], 0
    if ids:
        yield ids, np.frombuffer(b"".join(raws), np.uint8), np.cumsum([len(r) for r in raws]), first


def mail(path: str, pid: int) -> list[dict]:
    """Rows sent to an input partition."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    where, root = fs.FileSystem.from_uri(path)
    rows = []
    for info in where.get_file_info(fs.FileSelector(f"{root}/pid={pid}", allow_not_found=True)):
        if info.path.endswith(".parquet"):
            with where.open_input_file(info.path) as f:
                rows += pq.ParquetFile(f).read().to_pylist()
    return rows


def send(df: DataFrame) -> str:
    """Writes rows with a `pid` column as mail; the folder's path."""
    return stage_table(df.repartition("pid"), "pid")[1]


def short(hashes: np.ndarray) -> np.ndarray:
    return hashes >> U(64 - HASH_BITS)


def pack_sorted(values: np.ndarray) -> bytes:
    """Delta coding of an ascending array: width, first value, then differences."""
    deltas = np.diff(values)
    kind = "<u4" if not len(deltas) or deltas.max() < 1 << 32 else "<u8"
    return struct.pack("<BQ", int(kind[2]), int(values[0])) + deltas.astype(kind).tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    width, first = struct.unpack_from("<BQ", blob)
    deltas = np.frombuffer(blob, f"<u{width}", offset=9).astype(U)
    return np.concatenate([[U(first)], U(first) + np.cumsum(deltas, dtype=U)])


def _ask(batches: Iterator[pa.RecordBatch], length: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """Rows (range, pid, values, multi, sample): the task's distinct anchor hashes by range."""
    pid, found, prefixes = TaskContext.get().partitionId(), [np.zeros(0, U)], []
    for _, data, ends, _ in chunks_of(batches):
        pos, _, _, h = anchors_of(data, ends, length)
        found.append(short(h))
        if len(pos):
            some = pos[np.argsort(h)[:SAMPLES]]
            padded = np.concatenate([data, np.zeros(8, np.uint8)])
            prefixes += [(int(a), padded[p : p + 8].tobytes()) for a, p in zip(np.sort(h)[:SAMPLES].tolist(), some)]
    values, counts = np.unique(np.concatenate(found), return_counts=True)
    cuts = np.searchsorted(values, (np.arange(1, ranges, dtype=np.float64) * (2.0**HASH_BITS / ranges)).astype(U)).tolist()
    rows = []
    for r, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(values)])):
        if hi > lo:
            rows.append((r, pid, pack_sorted(values[lo:hi]), np.packbits(counts[lo:hi] > 1).tobytes(), None))
    rows.append((-1, pid, None, None, b"".join(p for _, p in sorted(prefixes)[:SAMPLES])))
    for row in rows:
        yield pa.record_batch([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["range", "pid", "values", "multi", "sample"])


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole ranges, sorted by range -> (pid, range, n, bits): which hashes occur twice or more."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        parts = [unpack_sorted(v) for _, _, v, _ in rows]
        multi = [np.unpackbits(np.frombuffer(m, np.uint8), count=len(p)) for (_, _, _, m), p in zip(rows, parts)]
        flat = np.concatenate(parts)
        order = np.argsort(flat, kind="stable")
        same = flat[order][1:] == flat[order][:-1]
        twice = np.zeros(len(flat), bool)
        twice[order[1:]] = same
        twice[order[:-1]] |= same
        twice |= np.concatenate(multi).astype(bool)
        bits = np.split(twice, np.cumsum([len(p) for p in parts])[:-1])
        return pa.record_batch(
            [pa.array([r[1] for r in rows], pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([len(p) for p in parts], pa.int64()), pa.array([np.packbits(b).tobytes() for b in bits], pa.binary())],
            names=["pid", "range", "n", "bits"],
        )

    held: list[tuple] = []
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("range", "pid", "values", "multi")]):
            if held and held[0][0] != row[0]:
                yield settle(held)
                held = []
            held.append(row)
    if held:
        yield settle(held)


def earlier_windows(common: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """For suffixes in sorted order with their common prefixes to the one before, their left bytes (nearest
    first), offsets low..high of their windows and their rank in document order: a boolean for each
    suffix and offset, whether an equal window of a smaller rank is there."""
    out = np.zeros((len(common), left.shape[1] + 1), bool)
    cls = np.zeros(len(common), np.int64)
    for o in range(left.shape[1] + 1):
        if o:
            alive = np.flatnonzero(high >= o)
            if not len(alive):
                break
            _, now = np.unique(cls[alive] * 256 + left[alive, o - 1], return_inverse=True)
            cls[alive] = now
        at = np.flatnonzero((low <= o) & (high >= o))
        if len(at) < 2:
            continue
        together = np.cumsum(common < length - o)[at]
        key = together * (int(cls[at].max()) + 1) + cls[at]
        order = np.lexsort((rank[at], key))
        again = np.concatenate([[False], key[order][1:] == key[order][:-1]])
        out[at[order[again]], o] = True
    return out


def to_spans(repeats: np.ndarray, doc: np.ndarray, pos: np.ndarray, ids: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, from, to, id) of the byte ranges that repeated windows cover, a row for each run of offsets."""
    edge = np.diff(np.pad(repeats.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(edge == 1)
    _, stop = np.nonzero(edge == -1)
    return doc[row], pos[row] - (stop - 1), pos[row] - first + length, ids[row]


def pack_spans(doc: np.ndarray, start: np.ndarray, stop: np.ndarray, ids: np.ndarray) -> bytes:
    """Ranges merged by document, with its id, as four int64 arrays."""
    order = np.lexsort((start, doc))
    doc, start, stop, ids = doc[order], start[order], stop[order], ids[order]
    if len(doc):
        far = doc * (1 << 40)
        reach = np.maximum.accumulate(far + stop)
        fresh = np.concatenate([[True], far[1:] + start[1:] > reach[:-1]])
        at = np.flatnonzero(fresh)
        ends = np.append(at[1:], len(doc)) - 1
        doc, start, stop, ids = doc[at], start[at], reach[ends] - far[at], ids[at]
    return np.stack([doc, start, stop, ids]).astype(np.int64).tobytes()


def pack_run(right: np.ndarray, common: np.ndarray, left: np.ndarray, low: np.ndarray, high: np.ndarray, ids: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> bytes:
    """A front-coded run: for each suffix only what follows its common prefix with the one before."""
    length = right.shape[1]
    common = common.copy()
    common[0] = 0
    col = np.arange(length)
    rest = right[(col >= common[:, None]) & (col < (length - low)[:, None])]
    back = left[np.arange(left.shape[1]) < high[:, None]]
    head = struct.pack("<QQQ", len(common), len(rest), len(back))
    return b"".join([head, common.astype("<u2").tobytes(), low.astype("<u2").tobytes(), high.astype("<u2").tobytes(), ids.astype("<i8").tobytes(), doc.astype("<i4").tobytes(), pos.astype("<i8").tobytes(), rest.tobytes(), back.tobytes()])


def unpack_run(blob: bytes, length: int, reach: int) -> tuple:
    """(suffixes as bytes, common, left, low, high, ids, doc, pos) of a run."""
    n, n_rest, n_back = struct.unpack_from("<QQQ", blob)
    at, cols = 24, []
    for kind, size in (("<u2", 2), ("<u2", 2), ("<u2", 2), ("<i8", 8), ("<i4", 4), ("<i8", 8)):
        cols.append(np.frombuffer(blob, kind, n, at).astype(np.int64))
        at += n * size
    common, low, high, ids, doc, pos = cols
    rest, back = blob[at : at + n_rest], np.frombuffer(blob, np.uint8, n_back, at + n_rest)
    left = np.zeros((n, reach), np.uint8)
    left[np.arange(reach) < high[:, None]] = back
    texts, last, k = [], b"", 0
    for c, size in zip(common.tolist(), np.maximum(length - low - common, 0).tolist()):
        last = (last[:c] + rest[k : k + size]).ljust(length, b"\0")
        texts.append(last)
        k += size
    return texts, common, left, low, high, ids, doc, pos


def merge_runs(runs: list[tuple[list[bytes], list[int]]], length: int) -> tuple[list[int], list[int], list[int]]:
    """Merges sorted runs of (texts, common prefixes with the text before): the run and place of each text
    in order, and its common prefix with the text before it. A loser tree whose contenders carry the
    prefix they share with the last winner: a longer one wins unseen, and equal ones are compared from there on."""
    k = len(runs)
    if k == 1:
        n = len(runs[0][0])
        return [0] * n, list(range(n)), list(runs[0][1])
    size = 1 << (k - 1).bit_length()
    now: list[bytes | None] = [r[0][0] for r in runs] + [None] * (size - k)
    known, place = [0] * size, [0] * size

    def first_of(a: int, b: int) -> tuple[int, int]:
        x, y = now[a], now[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        p, q = known[a], known[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        differ = int.from_bytes(x[p:], "big") ^ int.from_bytes(y[p:], "big")
        if not differ:
            known[b] = length
            return a, b
        same = length - (differ.bit_length() + 7) // 8
        if x[same] < y[same]:
            known[b] = same
            return a, b
        known[a] = same
        return b, a

    losers, winners = [0] * size, [0] * size + list(range(size))
    for node in range(size - 1, 0, -1):
        winners[node], losers[node] = first_of(winners[2 * node], winners[2 * node + 1])
    best, out_run, out_at, out_common = winners[1], [], [], []
    while now[best] is not None:
        at = place[best]
        out_run.append(best)
        out_at.append(at)
        out_common.append(known[best])
        texts, commons = runs[best]
        at += 1
        if at < len(texts):
            place[best], now[best], known[best] = at, texts[at], commons[at]
        else:
            now[best] = None
        node = (size + best) >> 1
        while node:
            best, losers[node] = first_of(best, losers[node])
            node >>= 1
    return out_run, out_at, out_common


def _runs(batches: Iterator[pa.RecordBatch], length: int, ranges: int, asked: str, splitters: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (key, pid, run, spans): front-coded runs by splitter range, and the task's own repeats."""
    pid, reach = TaskContext.get().partitionId(), length - gram_of(length)
    letters = mail(asked, pid)
    bits = {r["range"]: np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"]).astype(bool) for r in letters}
    held: list[tuple] = []
    kept: list[tuple] = []

    def row(key: int, run: bytes | None, spans: bytes | None) -> pa.RecordBatch:
        return pa.record_batch([pa.array([key], pa.int32()), pa.array([pid], pa.int32()), pa.array([run], pa.binary()), pa.array([spans], pa.binary())], names=["key", "pid", "run", "spans"])

    def flush(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        right, left, low, high, ids, doc, pos = [np.concatenate(c) for c in zip(*parts)]
        order = _sorted_rows(right)
        right, left, low, high, ids, doc, pos = (c[order] for c in (right, left, low, high, ids, doc, pos))
        common = common_prefixes(right)
        rank = np.empty(len(order), np.int64)
        rank[np.lexsort((pos, doc, ids))] = np.arange(len(order))
        repeats = earlier_windows(common, left, low, high, rank, length)
        if repeats.any():
            yield row(-1, None, pack_spans(*to_spans(repeats, doc, pos, ids, length)))
        offsets = np.arange(repeats.shape[1])
        due = (offsets >= low[:, None]) & (offsets <= high[:, None]) & ~repeats
        some = np.flatnonzero(due.any(axis=1))
        if not len(some):
            return
        low, high = due[some].argmax(axis=1), repeats.shape[1] - 1 - due[some][:, ::-1].argmax(axis=1)
        right, left, ids, doc, pos = (c[some] for c in (right, left, ids, doc, pos))
        right = np.where(np.arange(length) < (length - low)[:, None], right, 0).astype(np.uint8)
        again = _sorted_rows(right)
        right, left, low, high, ids, doc, pos = (c[again] for c in (right, left, low, high, ids, doc, pos))
        common = common_prefixes(right)
        prefix = right[:, :8].copy().view(">u8").ravel()
        cuts = np.searchsorted(prefix.astype(U), splitters, side="left").tolist()
        for key, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(right)])):
            if hi > lo:
                yield row(key, pack_run(right[lo:hi], common[lo:hi], left[lo:hi], low[lo:hi], high[lo:hi], ids[lo:hi], doc[lo:hi], pos[lo:hi]), None)

    # a hash's place among the task's own is known only when all were seen; the texts of one input partition wait here
    for ids, data, ends, first in chunks_of(batches):
        pos, start, stop, h = anchors_of(data, ends, length)
        if len(pos):
            kept.append((ids, data, ends, first, pos, start, stop, short(h)))
    every = np.unique(np.concatenate([k[7] for k in kept])) if kept else np.zeros(0, U)
    if len(every) != sum(r["n"] for r in letters):
        raise RuntimeError(f"partition {pid} has other rows than before; its input changed")
    if not kept:
        return
    twice = np.concatenate([bits[r] for r in sorted(bits)])
    count = 0
    while kept:
        ids, data, ends, first, pos, start, stop, h = kept.pop(0)
        some = np.flatnonzero(twice[np.searchsorted(every, h)])
        if not len(some):
            continue
        pos, start, stop = pos[some], start[some], stop[some]
        low, high = pos - stop, pos - start
        which = np.searchsorted(ends, pos, side="right")
        begins = np.concatenate([[0], ends[:-1]])
        padded = np.concatenate([np.zeros(reach, np.uint8), data, np.zeros(length, np.uint8)])
        right = padded[reach + pos[:, None] + np.arange(length)]
        right[np.arange(length) >= (length - low)[:, None]] = 0
        left = padded[reach + pos[:, None] - 1 - np.arange(reach)]
        left[np.arange(reach) >= high[:, None]] = 0
        held.append((right, left, low, high, np.array(ids, np.int64)[which], first + which, pos - begins[which]))
        count += len(pos)
        if count >= RUN_ANCHORS:
            yield from flush(held)
            held, count = [], 0
    if held:
        yield from flush(held)


def _sorted_rows(right: np.ndarray) -> np.ndarray:
    """The order of rows of bytes."""
    texts = [r.tobytes() for r in right]
    return np.array(sorted(range(len(texts)), key=texts.__getitem__), np.int64)


def common_prefixes(right: np.ndarray) -> np.ndarray:
    """Common prefix of each row with the one before."""
    out = np.zeros(len(right), np.int64)
    for lo in range(1, len(right), 1 << 16):
        a, b = right[lo - 1 : lo - 1 + (1 << 16)], right[lo : lo + (1 << 16)]
        differ = a[: len(b)] != b
        out[lo : lo + len(b)] = np.where(differ.any(axis=1), differ.argmax(axis=1), right.shape[1])
    return out


def _combine(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key -> (pid, spans): each range's runs are merged and their repeats sent back."""
    reach = length - gram_of(length)

    def settle(rows: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        parts = [unpack_run(blob, length, reach) for _, blob in rows]
        run, at, common = merge_runs([(p[0], p[1].tolist()) for p in parts], length)
        base = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])[:-1]])
        order = base[np.array(run)] + np.array(at)
        left, low, high, ids, doc, pos = (np.concatenate([p[c] for p in parts])[order] for c in range(2, 8))
        owner = np.repeat([pid for pid, _ in rows], [len(p[0]) for p in parts])[order]
        rank = np.empty(len(order), np.int64)
        rank[np.lexsort((pos, doc, owner, ids))] = np.arange(len(order))
        repeats = earlier_windows(np.array(common), left, low, high, rank, length)
        hit = repeats.any(axis=1)
        for pid in np.unique(owner[hit]).tolist():
            own = np.flatnonzero(hit & (owner == pid))
            yield pa.record_batch([pa.array([pid], pa.int32()), pa.array([pack_spans(*to_spans(repeats[own], doc[own], pos[own], ids[own], length))], pa.binary())], names=["pid", "spans"])

    held: list[tuple[int, bytes]] = []
    last = None
    for batch in batches:
        for key, pid, run, spans in zip(*[batch.column(c).to_pylist() for c in ("key", "pid", "run", "spans")]):
            if key == -1:
                yield pa.record_batch([pa.array([pid], pa.int32()), pa.array([spans], pa.binary())], names=["pid", "spans"])
                continue
            if held and key != last:
                yield from settle(held)
                held = []
            last = key
            held.append((pid, run))
    if held:
        yield from settle(held)


def _cut(batches: Iterator[pa.RecordBatch], found: str) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) -> (id, n_bytes, n_removed, n_spans, kept)."""
    blobs = [np.frombuffer(r["spans"], np.int64).reshape(4, -1) for r in mail(found, TaskContext.get().partitionId())]
    doc, start, stop, owner = np.frombuffer(pack_spans(*np.concatenate(blobs, axis=1)), np.int64).reshape(4, -1) if blobs else np.zeros((4, 0), np.int64)
    ordinal = 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            raws = [r or b"" for r in part.column(1).to_pylist()]
            bounds = np.searchsorted(doc, np.arange(ordinal, ordinal + len(raws) + 1)).tolist()
            ordinal += len(raws)
            gone, kept = [], []
            for i, raw, a, b in zip(part.column(0).to_pylist(), raws, bounds[:-1], bounds[1:]):
                pieces, at, n = [], 0, 0
                if (owner[a:b] != (LAST if i is None else i)).any():
                    raise RuntimeError("an answer is for another document; the input changed")
                for x, y in zip(start[a:b].tolist(), stop[a:b].tolist()):
                    if y > len(raw):
                        raise RuntimeError("a range ends beyond its text; the input changed")
                    pieces.append(raw[at:x])
                    at, n = y, n + y - x
                gone.append(n)
                kept.append(b"".join([*pieces, raw[at:]]) if b > a else raw)
            spans = np.diff(bounds)
            yield pa.record_batch([part.column(0), pa.array([len(r) for r in raws], pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], names=["id", "n_bytes", "n_removed", "n_spans", "kept"])


def drop_repeated_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(id long, n_bytes, n_removed, n_spans long, kept binary): every byte goes that is covered by a string of
    `length` bytes which also starts earlier, in a document of smaller id or before in the same one.

    Strings are judged on the input, may overlap and never cross documents. Null texts count as empty;
    texts shorter than `length` stay. A null id comes after all others; rows that share an id are ordered by
    their place in the input. An empty table gives an empty one; other columns are ignored."""
    require(df, id_col, text_col)
    if length < 12:
        raise ValueError("windows of fewer than 12 bytes have no useful anchors")
    prepare(df.sparkSession)
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    if "Exchange" in docs._jdf.queryExecution().executedPlan().toString():
        docs, _ = stage_table(docs)
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    asked, _ = stage_table(docs.mapInArrow(lambda b: _ask(b, length, ranges), "range int, pid int, values binary, multi binary, sample binary"))
    prefixes = [bytes(r["sample"]) for r in asked.filter("range = -1 AND length(sample) > 0").select("sample").collect()]  # SAMPLES a task
    keys = np.sort(np.frombuffer(b"".join(prefixes), ">u8").astype(U))
    splitters = np.unique(keys[(np.arange(1, 2 * ranges) * len(keys)) // (2 * ranges)]) if len(keys) else np.zeros(0, U)
    by_range = asked.filter("range >= 0").select("range", "pid", "values", "multi").repartition("range").sortWithinPartitions("range", "pid")
    answers = send(by_range.mapInArrow(_answer, "pid int, range int, n long, bits binary"))
    runs = docs.mapInArrow(lambda b: _runs(b, length, ranges, answers, splitters), "key int, pid int, run binary, spans binary")
    dealt = runs.repartition(F.when(F.col("key") >= 0, F.col("key")).otherwise(-1 - F.col("pid"))).sortWithinPartitions("key", "pid")
    found = send(dealt.mapInArrow(lambda b: _combine(b, length), "pid int, spans binary"))
    return docs.mapInArrow(lambda b: _cut(b, found), "id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op9_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Windows as the hexadecimal digits of their bytes, each looked up among all.
ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, k, md5_number(substr(h, 2 * k + 1, {2 * LENGTH})) AS s FROM d, unnest(range(0, CAST(len(h) // 2 - {LENGTH - 1} AS BIGINT))) AS t(k)
), r AS (
  SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY s ORDER BY doc_id, k) AS rn FROM w) WHERE rn > 1
), g AS (
  SELECT doc_id, k, sum(fresh) OVER (PARTITION BY doc_id ORDER BY k) AS run
  FROM (SELECT doc_id, k, CASE WHEN k - lag(k) OVER (PARTITION BY doc_id ORDER BY k) <= {LENGTH} THEN 0 ELSE 1 END AS fresh FROM r)
), spans AS (SELECT doc_id, run, min(k) AS a, max(k) + {LENGTH} AS b FROM g GROUP BY doc_id, run),
cuts AS (
  SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before, max(b) OVER (PARTITION BY doc_id) AS last FROM spans
), kept AS (
  SELECT doc_id, sum(b - a) AS gone, count(*) AS n, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * any_value(last) + 1) AS k
  FROM cuts JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
