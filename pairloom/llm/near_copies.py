"""Near copies by SimHash at a wide radius: candidates from the Gray-order index, decided by exact Jaccard similarity.

Texts with a similarity of 0.8 differ in about 15 of 100 SimHash bits, far beyond the few bits that blocks of a short
fingerprint can vouch for. So fingerprints have 128 bits, distinct ones are dealt by several samples of their bits (as
many samples, of as many bits, as the number of texts and the wanted recall ask for), and in each bucket the index finds
those within LIMIT bits. Whether a candidate pair is a near copy its sets of shingles say, so nothing else is linked;
before texts are read again, a bitmap of each set bounds what two sets can share.

A group of many near copies meets in most buckets. Its members are compared with a few leaders first: the ones closest to
the bits that most of the bucket has, then ones drawn anew for each round, until a round links hardly any more. What is
linked by then is one component, and only pairs of different components are sought in full, so links grow with the group
and not with its square. Buckets over MOST rows are
dealt in parts; in the end only rows outside the largest component of such a bucket go to all of its parts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, components, materialize, spread_join
from .decontam import bitmap, likely
from .simhash import SEED, Index, keep_least

#: Words of a shingle.
WORDS = 5
#: Bits of a fingerprint, and the share of them that differs at a similarity of 0.8: acos(2 * 0.8 / 1.8) / pi.
BITS, DIFFER = 128, math.acos(1.6 / 1.8) / math.pi
#: Chance that such a pair meets in a bucket, and the most bits in which it is let differ (19.4 expected, deviation 4.1).
RECALL, LIMIT = 0.97, 33
#: Distinct sets a bucket has on average; rows of a bucket that are dealt in parts; one of so many sets is read to find such buckets.
BUCKET, MOST, SAMPLED = 1024, 20_000, 16
#: Leaders of a bucket; rounds of drawn ones end with one that links less than this share of the sets that have a possible partner.
LEADERS, LEAST_LINKED = 2, 0.02
#: Bytes of a set's bitmap.
BITMAP = 32
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))


def shingles(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct XXH64 hashes of a UTF-8 text's shingles; of a shorter text all words are one, none without words."""
    found = (text or b"").lower().split()
    if len(found) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)] if found else [], np.uint64)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in map(b" ".join, zip(*(found[i:] for i in range(words))))), np.uint64, len(found) - words + 1))


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _MIX[2]
    return values ^ (values >> np.uint64(29))


def fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """The 128-bit SimHash of a set of hashes as two words; the second one is over hashes mixed anew."""
    ones = np.zeros(128, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        both = np.stack([part, _mixed(part * _MIX[0])], 1).astype(">u8")
        ones += np.unpackbits(both.view(np.uint8).reshape(-1, 16), axis=1).sum(0, dtype=np.int64)
    packed = np.packbits(2 * ones > len(hashes)).tobytes()
    return int.from_bytes(packed[:8], "big"), int.from_bytes(packed[8:], "big")


def parity(hashes: np.ndarray) -> bytes:
    """A bit for each value of the lowest byte: whether an odd number of hashes has it. Sets differ in as many hashes as bits at least."""
    return np.packbits(np.bincount((hashes & np.uint64(255)).astype(np.int64), minlength=8 * BITMAP) & 1).tobytes()


def alike(both, n1, n2):
    """Whether sets of n1 and n2 with so many in common have a Jaccard similarity of 0.8 or more."""
    return 9 * both >= 4 * (n1 + n2)


def meeting(bits: int, number: int) -> float:
    """The chance that a pair at a similarity of 0.8 agrees in all bits of at least one of so many samples."""
    chance = 0.0
    for d in range(BITS - bits + 1):
        of = math.comb(BITS, d) * DIFFER**d * (1 - DIFFER) ** (BITS - d)
        chance += of * (1 - (1 - math.comb(BITS - d, bits) / math.comb(BITS, bits)) ** number)
    return chance


def tables(sets: int) -> list[np.ndarray]:
    """The samples of bits by which so many distinct sets are dealt, as masks of two words."""
    bits = min(64, max(6, math.ceil(math.log2(max(sets, 1) / BUCKET))))
    number = next(n for n in count(1) if meeting(bits, n) >= RECALL)
    return [np.packbits(np.isin(np.arange(BITS), np.random.default_rng(t).choice(BITS, bits, False))).view(">u8").astype(np.uint64) for t in range(number)]


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def _texts(documents: DataFrame) -> DataFrame:
    """doc_id, row (a key of doc_id and text) and text in bytes."""
    return documents.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("row"), F.col("text").cast("binary"))


def _identity(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes())


def _sets(documents: DataFrame) -> DataFrame:
    """doc_id, row, set (its identity), n, f0, f1 and odd (its bitmap) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(t) for t in batch.column(2).to_pylist()]
            prints = [*map(fingerprint, own)]
            columns = [_signed([*map(_identity, own)]), pa.array([*map(len, own)], pa.int32()), *(_signed([p[k] for p in prints]) for k in (0, 1)), pa.array([*map(parity, own)], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "row", "set", "n", "f0", "f1", "odd"])

    return arrow_map(_texts(documents), run, "doc_id long, row long, set long, n int, f0 long, f1 long, odd binary")


def _hashes(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """set and hashes, as bytes, of the sets whose rows are asked for; each once."""
    shared = documents.sparkSession.sparkContext.broadcast(bitmap(rows.select(F.col("row").alias("hash"))))  # bounded by its own size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pa.array(likely(shared.value, batch.column(1).to_numpy().view(np.uint64))))
            own = [shingles(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), _signed([*map(_identity, own)]), pa.array([x.tobytes() for x in own], pa.binary())], names=["row", "set", "hashes"])

    found = arrow_map(_texts(documents), run, "row long, set long, hashes binary")
    return found.join(rows.select("row"), "row", "left_semi").select("set", "hashes").dropDuplicates(["set"])


def _dealt(sets: DataFrame, masks: list[np.ndarray]) -> DataFrame:
    """key, set, n, f0, f1 for every set and table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f0, f1 = (batch.column(k).to_numpy().view(np.uint64) for k in (2, 3))
            for t, mask in enumerate(masks):
                key = _mixed((f0 & mask[0]) * _MIX[0] + (f1 & mask[1]) * _MIX[1] + np.uint64(t))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *batch.columns], names=["key", "set", "n", "f0", "f1"])

    return arrow_map(sets.where("n > 0").select("set", "n", "f0", "f1"), run, "key long, set long, n int, f0 long, f1 long")


class _Rows:
    """Rows (set, n, f0, f1) of whole buckets, ordered by bucket and Gray rank, and the pairs of them that can be near copies."""

    def __init__(self, rows: pa.Table):
        bucket = rows.column(0).to_numpy()
        ranks = []
        for name in ("f0", "f1"):
            rank = rows.column(name).to_numpy().view(np.uint64)
            for shift in (1, 2, 4, 8, 16, 32):
                rank = rank ^ (rank >> np.uint64(shift))
            ranks.append(rank ^ (np.uint64(0) - (ranks[0] & np.uint64(1))) if ranks else rank)
        self.order = np.lexsort((ranks[1], ranks[0], bucket))
        self.rows = rows
        self.bucket = bucket[self.order]
        self.set, n, f0, f1 = (rows.column(name).to_numpy()[self.order] for name in ("set", "n", "f0", "f1"))
        self.n = n.astype(np.int64)
        self.prints = np.stack([f0, f1], 1).view(np.uint64)
        self.odd = np.frombuffer(b"".join(rows.column("odd").to_pylist()), np.uint64).reshape(len(rows), -1)[self.order] if "odd" in rows.column_names else None
        self.root = rows.column("root").to_numpy()[self.order] if "root" in rows.column_names else self.set
        self.heads = np.flatnonzero(np.r_[True, self.bucket[1:] != self.bucket[:-1]])
        self.sizes = np.diff(np.r_[self.heads, len(self.bucket)])

    def hold(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Places of the pairs within the limits."""
        fit = np.flatnonzero((5 * np.minimum(self.n[i], self.n[j]) >= 4 * np.maximum(self.n[i], self.n[j])) & (self.root[i] != self.root[j]))
        fit = fit[np.bitwise_count(self.prints[i[fit]] ^ self.prints[j[fit]]).sum(1) <= LIMIT]
        if self.odd is None:
            return fit
        n1, n2 = self.n[i[fit]], self.n[j[fit]]
        differ = np.bitwise_count(self.odd[i[fit]] ^ self.odd[j[fit]]).sum(1, dtype=np.int64)
        return fit[alike((n1 + n2 - differ) // 2, n1, n2)]

    def led(self, drawn: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The rows of each bucket with its leaders: 0: those closest to most of the bucket, else a number by which to draw them."""
        if drawn:
            first = _mixed((self.set.view(np.uint64) ^ self.bucket.view(np.uint64)) * _MIX[1] + np.uint64(drawn))
        else:
            bits = np.unpackbits(self.prints.astype(">u8").view(np.uint8).reshape(-1, 16), axis=1)
            most = 2 * np.add.reduceat(bits, self.heads, axis=0, dtype=np.int32) > self.sizes[:, None]
            first = (bits != np.repeat(most, self.sizes, axis=0)).sum(1)
        best, head, at = np.lexsort((self.set, first, self.bucket)), np.repeat(self.heads, self.sizes), np.arange(len(self.set))
        for k in range(LEADERS):
            j = at[np.repeat(self.sizes, self.sizes) > k]
            i = best[head[j] + k]
            j, i = j[i != j], i[i != j]
            keep = self.hold(i, j)
            yield i[keep], j[keep]

    def near(self, labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of different labels."""
        for i, j in Index(self.bucket, self.prints, labels).near(LIMIT):
            keep = self.hold(i, j)
            yield i[keep], j[keep]


def _by_bucket(work: Callable[[pa.Table], Iterator[pa.RecordBatch]]):
    """Calls work on whole buckets, some at a time; the rows come sorted by the first column, the bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        for batch in batches:
            waiting.append(batch)
            held += len(batch)
            if held >= 1 << 15:
                rows = pa.Table.from_batches(waiting).combine_chunks()
                bucket = rows.column(0).to_numpy()
                end = int(np.searchsorted(bucket, bucket[-1]))
                if end:
                    yield from work(rows.slice(0, end))
                waiting, held = rows.slice(end).to_batches(), len(rows) - end
        if held:
            yield from work(pa.Table.from_batches(waiting).combine_chunks())

    return run


def _possible(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """The rows that can be near copies of another one in their bucket."""
    bucket = rows.column(0).to_numpy()
    same = bucket[1:] == bucket[:-1]
    rows = rows.filter(pa.array(np.r_[False, same] | np.r_[same, False]))
    if not len(rows):
        return
    of = _Rows(rows)
    keep = np.zeros(len(rows), bool)
    for i, j in of.led(0):
        keep[i] = keep[j] = True
    labels = np.where(keep, -1, np.arange(len(rows)))
    for i, j in of.near(labels):
        keep[i] = keep[j] = True
    yield from rows.take(pa.array(of.order[keep])).to_batches()


def _pairs(i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    both = np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)], 1), axis=0) if len(i) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])


def _leading(drawn: int) -> Callable[[pa.Table], Iterator[pa.RecordBatch]]:
    def work(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        of = _Rows(rows)
        for i, j in of.led(drawn):
            yield _pairs(of.set[i], of.set[j])

    return work


def _left(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """The pairs of each bucket in different components."""
    of = _Rows(rows)
    for i, j in of.near(of.root):
        if len(i):
            yield _pairs(of.set[i], of.set[j])


def _verified(pairs: DataFrame, hashes: DataFrame) -> DataFrame:
    """The pairs (a, b) that are near copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(*(batch.column(k).to_pylist() for k in (2, 3))):
                one, two = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
                keep.append(alike(len(np.intersect1d(one, two, assume_unique=True)), len(one), len(two)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sides = [hashes.select(F.col("set").alias(c), F.col("hashes").alias(f"h{c}")) for c in ("a", "b")]
    return arrow_map(pairs.distinct().join(sides[0], "a").join(sides[1], "b").select("a", "b", "ha", "hb"), run, "a long, b long")


_ROW = "bucket long, key long, set long, n int, f0 long, f1 long"


def _bucketed(rows: DataFrame, work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    rows = rows.select("bucket", *[c for c in rows.columns if c != "bucket"])
    return arrow_map(rows.repartition("bucket").sortWithinPartitions("bucket"), _by_bucket(work), schema)


def links(documents: DataFrame, sets: DataFrame, most: int = MOST) -> DataFrame:
    """Links (a, b) of sets that span all near copies found among sets (set, row of one document that has it, n, f0, f1, odd)."""
    masks = tables(sets.where("n > 0").count())
    some = sets.where(F.pmod(F.xxhash64("set", F.lit(SEED)), F.lit(SAMPLED)) == 0)
    large = _dealt(some, masks).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * SAMPLED > most)
    large = materialize(large.select("key", F.ceil(F.col("n") * SAMPLED / most).cast("int").alias("parts")))
    rows = _dealt(sets, masks).withColumn("bucket", F.col("key")).select("bucket", "key", "set", "n", "f0", "f1")
    if large.isEmpty():
        rows = materialize(_bucketed(rows, _possible, _ROW)).withColumn("parts", F.lit(1))
    else:  # what is dealt in parts is not thinned, as a row's partner may be in another part
        rows = spread_join(rows, large, ["key"], ["set"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        thin = _bucketed(rows.where("parts = 1").select("bucket", "key", "set", "n", "f0", "f1"), _possible, _ROW).withColumn("parts", F.lit(1))
        part = F.xxhash64("key", F.pmod(F.xxhash64("set", "key"), "parts"))
        names = ["bucket", "key", "set", "n", "f0", "f1", "parts"]
        rows = materialize(thin.select(names).unionByName(rows.where("parts > 1").withColumn("bucket", part).select(names)))
    odd = sets.join(rows.select("set").distinct(), "set", "left_semi").select("set", "row", "odd")
    odd = materialize(odd)
    rows = materialize(rows.join(odd.select("set", "odd"), "set"))
    hashes = materialize(_hashes(documents, odd.select("row").distinct()))

    def rooted() -> DataFrame:
        roots = components(found).withColumnRenamed("node", "set")
        return rows.join(roots, "set", "left").withColumn("root", F.coalesce("root", "set"))

    found = materialize(_verified(_bucketed(rows, _leading(0), "a long, b long"), hashes))
    least, drawn = LEAST_LINKED * odd.count(), count(1)
    while True:
        more = materialize(_verified(_bucketed(rooted(), _leading(next(drawn)), "a long, b long"), hashes))
        found = materialize(found.unionByName(more))
        if more.count() <= least:
            break
    last = rooted()
    if not large.isEmpty():
        last = materialize(last)
        mains = last.where("parts > 1").groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
        split = spread_join(last.where("parts > 1"), materialize(mains), ["key"], ["set"])
        everywhere = split.where("root <> main").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("bucket", F.xxhash64("key", F.col("part").cast("long"))).drop("part", "main")
        last = last.where("parts = 1").unionByName(split.where("root = main").drop("main")).unionByName(everywhere)
    return found.unionByName(materialize(_verified(_bucketed(last, _left, "a long, b long"), hashes)))


def near_copies(documents: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id and component_id, the smallest doc_id reachable over texts of similarity 0.8 or more, for every row of documents (doc_id, text).

    Equal sets of shingles are always linked, texts without words (null and empty ones among them) with each other. A
    null doc_id names a component only where all its members are null. Repeated rows get the same result each; texts of
    any length are read whole; extra columns are not read.
    """
    docs = materialize(_sets(documents), gathered=True)
    sets = docs.groupBy("set").agg(F.min("doc_id").alias("least"), F.min("row").alias("row"), F.first("n").alias("n"), F.first("f0").alias("f0"), F.first("f1").alias("f1"), F.first("odd").alias("odd"))
    sets = materialize(sets)
    roots = components(links(documents, sets, most)).withColumnRenamed("node", "set")
    named = materialize(sets.select("set", "least").join(roots, "set", "left").select("set", "least", F.coalesce("root", "set").alias("root")))
    best = named.groupBy("root").agg(F.min("least").alias("component_id"))
    component = named.join(best, "root").select("set", "component_id")
    return docs.join(component, "set", "left").select("doc_id", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_first(documents: DataFrame, most: int = MOST) -> DataFrame:
    """documents with one row of each component, as simhash.keep_first has it."""
    return keep_least(documents, near_copies(documents, most))
