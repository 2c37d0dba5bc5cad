"""SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints within two bits of each other agree on at least one of any three blocks of bits, so the distinct
fingerprints are dealt by block value. Inside a block value they are sorted by Gray rank, which puts fingerprints that
share bit patterns side by side; runs of them become nodes that hold the bits all members agree on (mask and pattern),
runs of nodes become upper nodes, and the self join walks pairs of nodes from the top, adding up the differences in the
bits both sides fix and pruning whole groups as soon as they exceed the limit. A block value with too many fingerprints
is dealt again by three blocks of its remaining bits, until the bits left bound its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, components, materialize, spare

#: Seed of the shingles' XXH64.
SEED = 42
#: Children of a node of the index.
FANOUT = 8
#: Distinct fingerprints that one block value may hold before it is dealt again.
MOST = 20_000
#: Pairs of nodes expanded at once.
PAIRS = 4_000
#: Blocks of fewer free bits than this are small enough by themselves.
LEAST_BITS = 14

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: bytes | None, words: int = 3) -> int:
    """The 64-bit SimHash of a UTF-8 text's shingles; 0 without words."""
    found = (text or b"").lower().split()
    if not found:
        return 0
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words)))) if len(found) >= words else [b" ".join(found)]
    hashes = np.fromiter(map(_hash, shingles), np.uint64).astype(">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(documents: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return arrow_map(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), run, "doc_id long, fp long")


def _split(mask: int) -> list[int]:
    """Three blocks of the bits set in mask."""
    bits = [i for i in range(64) if mask >> i & 1]
    size = -(-len(bits) // 3)
    return [sum(1 << i for i in bits[k : k + size]) for k in range(0, len(bits), size)]


def _signed(mask: int) -> int:
    return mask - (mask >> 63 << 64)


class Index:
    """The levels of nodes over fingerprints (rows of 64-bit words) sorted by bucket and Gray rank; level 0 are the fingerprints.

    With labels, pairs of one label are not sought, and nodes that have one label alone are not compared with each other.
    """

    def __init__(self, buckets: np.ndarray, values: np.ndarray, labels: np.ndarray | None = None):
        self.pattern, self.mask, self.first = [values], [np.full_like(values, ~np.uint64(0))], [None]
        self.labels = None if labels is None else [(labels, labels)]
        low, high, of = values, values, buckets
        while len(of) > 1 and (of[1:] == of[:-1]).any():
            begins = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            place = np.arange(len(of)) - np.repeat(begins, np.diff(np.r_[begins, len(of)]))
            heads = np.flatnonzero(place % FANOUT == 0)
            low, high, of = np.bitwise_and.reduceat(low, heads), np.bitwise_or.reduceat(high, heads), of[heads]
            mask = ~(low ^ high)
            self.pattern.append(low & mask)
            self.mask.append(mask)
            self.first.append(np.r_[heads, len(place)])
            if self.labels:
                least, most = self.labels[-1]
                self.labels.append((np.minimum.reduceat(least, heads), np.maximum.reduceat(most, heads)))

    def _apart(self, level: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Which pairs of nodes have more labels than one between them."""
        least, most = self.labels[level]
        return (least[x] != most[x]) | (least[x] != most[y]) | (least[y] != most[y])

    def near(self, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of pairs within the distance, each once, in blocks."""
        top = len(self.pattern) - 1
        every = np.arange(len(self.pattern[top]))
        waiting = [(top, every[k : k + PAIRS], every[k : k + PAIRS]) for k in range(0, len(every), PAIRS)]
        while waiting:
            level, x, y = waiting.pop()
            if level == 0:
                yield x[x < y], y[x < y]
                continue
            first, below = self.first[level], level - 1
            nx, ny = first[x + 1] - first[x], first[y + 1] - first[y]
            n = nx * ny
            own = np.repeat(np.arange(len(x)), n)
            k = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            cx, cy = first[x][own] + k // ny[own], first[y][own] + k % ny[own]
            half = cx <= cy if below else cx < cy
            if self.labels:
                half &= self._apart(below, cx, cy)
            cx, cy = cx[half], cy[half]
            differ = np.zeros(len(cx), np.int64)
            for word in range(self.pattern[below].shape[1]):
                pattern, mask = self.pattern[below][:, word], self.mask[below][:, word]
                differ += np.bitwise_count((pattern[cx] ^ pattern[cy]) & mask[cx] & mask[cy])
            keep = differ <= distance
            cx, cy = cx[keep], cy[keep]
            waiting += [(below, cx[k : k + PAIRS], cy[k : k + PAIRS]) for k in range(0, len(cx), PAIRS)]


def _forest(buckets: np.ndarray, values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """For each fingerprint that has a near one in its bucket, itself and the first of its group: links that span what is near."""
    label = np.arange(len(values))
    for x, y in Index(buckets, values[:, None]).near(distance):
        while (label[x] != label[y]).any():
            least = np.minimum(label[x], label[y])
            np.minimum.at(label, label[x], least)
            np.minimum.at(label, label[y], least)
            label = label[label]
    while (label != label[label]).any():
        label = label[label]
    moved = np.flatnonzero(label != np.arange(len(values)))
    return values[moved], values[label[moved]]


def _links(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(end: int) -> pa.RecordBatch:
            a, b = _forest(keys[:end], values[:end], distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            keys = np.r_[keys, batch.column(0).to_numpy(zero_copy_only=False)]
            values = np.r_[values, batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)]
            if len(keys) and keys[0] != keys[-1] and len(keys) >= 1 << 15:
                end = int(np.flatnonzero(keys != keys[-1])[-1]) + 1
                yield out(end)
                keys, values = keys[end:], values[end:]
        if len(keys):
            yield out(len(keys))

    return run


def near_links(distinct: DataFrame, distance: int = 2, most: int = MOST) -> DataFrame:
    """Links (a, b) that span all pairs of the distinct fingerprints fp within the distance (2 at most)."""
    if not 0 <= distance <= 2:
        raise ValueError("three blocks find pairs of up to two differing bits")
    gray = F.col("fp")
    for shift in (1, 2, 4, 8, 16, 32):
        gray = gray.bitwiseXOR(F.shiftrightunsigned(gray, shift))
    gray = gray.bitwiseXOR(F.lit(-(1 << 63)))

    def deal(rows: DataFrame, masks: list[int]) -> tuple[DataFrame, list[int]]:
        """rows: fp, key, path (the place in masks of the bits not yet used). Each row once for each block of those bits."""
        blocks = [(_split(m) + [0, 0, 0])[:3] for m in masks]
        cut = lambda j: F.element_at(F.array(*[F.lit(_signed(b[j])) for b in blocks]), F.col("path") + 1)
        parts = F.array(*[F.struct(F.xxhash64("key", F.col("path") * 3 + j, F.col("fp").bitwiseAND(cut(j))).alias("key"), (F.col("path") * 3 + j).alias("path")) for j in range(3)])
        return rows.select("fp", F.explode(parts).alias("p")).select("fp", "p.key", "p.path"), [m & ~b for m, bs in zip(masks, blocks) for b in bs]

    rows, masks = deal(distinct.select("fp", F.lit(0).cast("long").alias("key"), F.lit(0).alias("path")), [(1 << 64) - 1])
    done = []
    while True:
        large = materialize(rows.groupBy("key").count().where(F.col("count") > most).select("key"))
        last = large.isEmpty() or max(m.bit_count() for m in masks) <= LEAST_BITS
        done.append(rows if last else rows.join(large, "key", "left_anti"))
        if last:
            break
        rows, masks = deal(rows.join(large, "key", "left_semi"), masks)
        rows = materialize(rows.distinct())
    found = [arrow_map(r.withColumn("gray", gray).repartition("key").sortWithinPartitions("key", "gray").select("key", "fp"), _links(distance), "a long, b long") for r in done]
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links


def near_duplicates(documents: DataFrame, distance: int = 2, words: int = 3, most: int = MOST) -> DataFrame:
    """doc_id, fp (signed long) and component_id, the smallest doc_id reachable, for every row of documents (doc_id, text).

    A text without words, null texts among them, has fingerprint 0, which links like any other. Repeated rows get the
    same result each; a null doc_id takes part but names a component only where all its members are null. Texts of any
    length are read whole; extra columns are not read.
    """
    docs = materialize(fingerprints(documents, words), gathered=True)
    distinct = materialize(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = components(near_links(distinct, distance, most)).withColumnRenamed("node", "fp")
    linked = materialize(distinct.select("fp", "least").join(roots, "fp"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(least, "root").select("fp", "component_id")
    alone = distinct.where("n > 1").join(roots.select("fp"), "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    return docs.join(named.unionByName(alone), "fp", "left").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(documents: DataFrame, distance: int = 2, words: int = 3, most: int = MOST) -> DataFrame:
    """documents with one row of each component: that of the smallest doc_id.

    Rows equal in doc_id and text are one document, of which one row stays. Rows without a doc_id cannot be told apart
    by it: they stay, those of equal texts once. Extra columns stay, whatever their names.
    """
    return keep_least(documents, near_duplicates(documents, distance, words, most))


def keep_least(documents: DataFrame, near: DataFrame) -> DataFrame:
    """documents with one row of each component in near (doc_id, component_id of every row), as keep_first says."""
    near, own = materialize(near), spare("own", documents)
    same = lambda other: F.col("doc_id").cast("long").eqNullSafe(other[own])
    gone = near.where("doc_id <> component_id").select(F.col("doc_id").alias(own)).distinct()
    kept = documents.join(gone, same(gone), "left_anti")
    again = materialize(near.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(own)))
    if again.isEmpty():
        return kept
    return kept.join(again, same(again), "left_anti").unionByName(kept.join(again, same(again), "left_semi").dropDuplicates(["doc_id", "text"]))
