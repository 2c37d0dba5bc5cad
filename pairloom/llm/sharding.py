"""Sharding by histogram sort: splitters found by counting exact bytes below probe keys, then one exchange.

A document's key is (hash of its text, doc_id), so equal texts lie side by side and a group of copies larger than a shard
is cut between its documents. Each round counts bytes, rows and outermost keys between the probes over all partitions;
a splitter's next probes divide only the keys that are really there between its closest bounds, until the bytes below it
meet the tolerance or no document is left to move. Only counts by probe reach the driver, as many as there are probes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, materialize

#: Probes of a round, over all splitters that are still open.
PROBES = 4096
#: Rows that one range within a shard should hold at most, and the most ranges of a shard.
RANGE_ROWS, MOST_RANGES = 1_000_000, 256
_LOW = 1 << 63


def _pair(key: int) -> tuple[int, int]:
    return (key >> 64) - _LOW, (key & ((1 << 64) - 1)) - _LOW


def _key(h: int, d: int) -> int:
    return (h + _LOW << 64) + d + _LOW


def _below(h: np.ndarray, d: np.ndarray, probe_h: np.ndarray, probe_d: np.ndarray) -> np.ndarray:
    """For each key (h, d), how many of the sorted probes are not above it."""
    left, right = np.searchsorted(probe_h, h, "left"), np.searchsorted(probe_h, h, "right")
    out = right.copy()
    for at in np.unique(left[tied]) if (tied := left < right).any() else ():
        own = np.flatnonzero(tied & (left == at))
        out[own] = at + np.searchsorted(probe_d[at : right[own[0]]], d[own], "right")
    return out


def _columns(batch: pa.RecordBatch, *at: int) -> list[np.ndarray]:
    return [batch.column(k).to_numpy(zero_copy_only=False) for k in at]


def _histogram(slim: DataFrame, probes: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(place, bytes, rows, least key, largest key) for the keys from each probe to the next; place 0 is below all."""
    pairs = np.array([_pair(p) for p in probes], np.int64).reshape(-1, 2)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, d, size = _columns(batch, 0, 1, 2)
            order = np.lexsort((d, h))
            h, d, size = h[order], d[order], size[order]
            place = _below(h, d, pairs[:, 0], pairs[:, 1])
            if not len(place):
                continue
            heads = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
            tails = np.r_[heads[1:], len(place)]
            columns = (place[heads], np.add.reduceat(size, heads), tails - heads, h[heads], d[heads], h[tails - 1], d[tails - 1])
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["place", "bytes", "rows", "h0", "d0", "h1", "d1"])

    found = arrow_map(slim.select("h", "d", "size"), count, "place long, bytes long, rows long, h0 long, d0 long, h1 long, d1 long")
    found = found.groupBy("place").agg(F.sum("bytes"), F.sum("rows"), F.min(F.struct("h0", "d0")), F.max(F.struct("h1", "d1")))
    return sorted((r[0], r[1], r[2], _key(*r[3]), _key(*r[4])) for r in found.collect())  # no more rows than probes


def splitters(slim: DataFrame, count: int, tolerance: float, coarse: int = 1, probes: int = PROBES) -> tuple[list[int], int]:
    """count - 1 keys that cut slim (h, d, size) into parts of near equal bytes, and how many rounds that took.

    tolerance: the share of a part of coarse ranges by which every coarse-th splitter may be off; the others may be off
    by a quarter of a range.
    """
    first = _histogram(slim, [])
    if not first:
        return [0] * (count - 1), 0
    _, total, _, least, largest = first[0]
    targets = [total * i // count for i in range(1, count)]
    slack = [tolerance * total / count * coarse if i % coarse == 0 else total / count / 4 for i in range(1, count)]
    # bounds of each splitter: (key, bytes below it); below the least key there is nothing, below the end everything
    low, high = [(least, 0)] * len(targets), [(largest + 1, total)] * len(targets)
    done: dict[int, int] = {}
    rounds = 0
    while True:
        for i, t in enumerate(targets):
            if i not in done:
                (a, under), (b, over) = low[i], high[i]
                near = min((t - under, a), (over - t, b))
                if near[0] <= slack[i] or b - a <= 1:
                    done[i] = near[1]
        if len(done) == len(targets):
            return [done[i] for i in range(len(targets))], rounds
        rounds += 1
        spans = {(low[i][0], high[i][0]) for i in range(len(targets)) if i not in done}
        each = max(2, probes // len(spans))
        tried = sorted({a + (b - a) * k // (each + 1) for a, b in spans for k in range(1, each + 1)} | {x for s in spans for x in s})
        found = {place: (size, a, b) for place, size, _, a, b in _histogram(slim, tried)}
        under, known = found.get(0, (0, 0, 0))[0], []
        for place, probe in enumerate(tried, 1):
            known.append((probe, under))
            if place in found:  # the keys that are there are closer bounds than the probes
                size, a, b = found[place]
                known += [(a, under), (b + 1, under + size)]
                under += size
        sums = np.array([u for _, u in known])
        for i, t in enumerate(targets):
            if i not in done:
                at = int(np.searchsorted(sums, t, "right"))
                low[i], high[i] = max(low[i], known[at - 1]), min(high[i], known[at]) if at < len(known) else high[i]


def shard(documents: DataFrame, shards: int = 16, tolerance: float = 0.001, probes: int = PROBES) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row; the law is bytes: shards of near equal sums of size.

    size: UTF-8 bytes of the text (null: none) plus 1. Copies share a shard but where a group straddles a splitter. Rows
    equal in text and doc_id always share one. A null doc_id sorts first among its copies. Texts of any length count
    whole; a splitter cannot cut a document, so sums of size differ by up to the longest one near it. Extra columns are
    not read.
    """
    text = F.coalesce("text", F.lit(""))
    doc = F.col("doc_id").cast("long")
    slim = documents.select(doc.alias("doc_id"), F.xxhash64(text).alias("h"), F.coalesce(doc, F.lit(-_LOW)).alias("d"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    slim = materialize(slim, gathered=True)
    ranges = min(MOST_RANGES, max(8, -(-slim.count() // (shards * RANGE_ROWS))))
    cuts, _ = splitters(slim, shards * ranges, tolerance, ranges, probes)
    pairs = np.array([_pair(c) for c in cuts], np.int64).reshape(-1, 2)
    rows = np.zeros(shards * ranges, np.int64)
    for place, _, n, _, _ in _histogram(slim, cuts):
        rows[place] = n
    before = (np.cumsum(rows) - rows).reshape(shards, ranges)
    before = (before - before[:, :1]).ravel()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = _below(*_columns(batch, 1, 2), pairs[:, 0], pairs[:, 1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place.astype(np.int64)), pa.array(before[place])], names=[*batch.schema.names, "range", "before"])

    dealt = arrow_map(slim, deal, "doc_id long, h long, d long, size long, text_crc32 long, range long, before long")
    order = F.row_number().over(Window.partitionBy("range").orderBy("h", "d"))  # the one exchange
    return dealt.select("doc_id", "size", "text_crc32", F.floor(F.col("range") / ranges).cast("int").alias("shard"), (F.col("before") + order - 1).alias("slot"))
