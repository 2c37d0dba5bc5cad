"""Benchmark decontamination by spaced-seed hashing.

Fixed masks look at some positions of a short span of tokens and ignore the others, so a substituted token there does not
hide a copied passage. The hashes of all benchmark items under all masks are joined with those of the documents; around
each hit, the alignment it implies is extended both ways from every run of agreeing tokens, as far as the item goes, and
kept if enough agree. Items too short for a mask are sought word for word. A bitmap of bounded size tells the map side
which hashes can be in the benchmark at all, so that only tokens near likely hits are shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize, spare

#: Positions that count (1) and that are ignored (0).
MASKS = ("1110011", "11010101", "110010011")
#: Agreeing tokens that make a leak (or MIN_SHARE of a shorter item), and the share of agreeing tokens in it.
MIN_TOKENS, MIN_SHARE = 10, 0.75
#: Items of fewer tokens than the shortest mask must agree in all; those under LEAST_PASSAGE are no passage: they match documents without other tokens.
SHORT, LEAST_PASSAGE = min(map(len, MASKS)), 3
#: Least tokens of a block of a document; blocks are as long as the longest item, which is also the context on both sides.
BLOCK = 128
#: Bytes of item tokens up to which they are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Bits of the bitmap: so many a benchmark hash, within these bounds; and the bits that each hash sets.
BITS_EACH, LEAST_BITS, MOST_BITS, PLACES = 64, 1 << 16, 1 << 27, 4
#: Points an agreeing and a differing token count in an extension.
AGREE, DIFFER = 1, -3
#: ASCII bytes that end a token: all but letters and digits.
_ENDS = bytes(32 if k < 128 and not chr(k).isalnum() else k for k in range(256))
_ODD = (np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class _Hashes(dict):
    """Hash of a token, kept for the next time; starts anew when large."""

    def __missing__(self, token: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        value = self[token] = xxhash.xxh64_intdigest(token)
        return value


_KNOWN = _Hashes()
_OTHER = re.compile(r"[^\w]+|_+")


def tokens(text: bytes) -> np.ndarray:
    """Hashes of the lower-cased runs of letters and digits."""
    if not text.isascii():
        text = _OTHER.sub(" ", text.decode("utf-8", "replace").lower()).encode()
        words = text.split()
    else:
        words = text.lower().translate(_ENDS).split()
    return np.fromiter(map(_KNOWN.__getitem__, words), np.uint64, len(words))


def _hashed(found: np.ndarray, mask: str, salt: int) -> np.ndarray:
    places = max(0, len(found) - len(mask) + 1)
    out = np.full(places, salt, np.uint64)
    for k, at in enumerate(k for k, c in enumerate(mask) if c == "1"):
        out += found[at : at + places] * _ODD[k]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


def seeds(found: np.ndarray, masks: tuple[str, ...] = MASKS) -> Iterator[np.ndarray]:
    """For each mask, the hashes of all its places over the tokens."""
    for n, mask in enumerate(masks):
        yield _hashed(found, mask, n + 1)


def short_seeds(found: np.ndarray, lengths: Iterable[int]) -> Iterator[np.ndarray]:
    """The hashes of all runs of so many tokens; a length that is no passage only of tokens that are no more."""
    for n in lengths:
        if n >= LEAST_PASSAGE or n == len(found):
            yield _hashed(found, "1" * n, len(MASKS) + n)


def _items(benchmark: DataFrame) -> DataFrame:
    """item (a key), item_id, n and tokens of every distinct item with an id and a token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [tokens(t or b"") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([*map(len, own)], pa.int32()), pa.array([x.tobytes() for x in own], pa.binary())], names=["item_id", "n", "tokens"])

    texts = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("binary")).where("item_id IS NOT NULL")
    found = arrow_map(texts, run, "item_id long, n int, tokens binary").where("n > 0").distinct()
    return found.select(F.xxhash64("item_id", "tokens").alias("item"), "item_id", "n", "tokens")


def _seeds(items: DataFrame) -> DataFrame:
    """item, at and hash for each place and mask of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in enumerate(batch.column(1).to_pylist()):
                own = np.frombuffer(text, np.uint64)
                for found in seeds(own) if len(own) >= SHORT else short_seeds(own, [len(own)]):
                    item = batch.column(0).take(pa.array(np.full(len(found), row)))
                    yield pa.RecordBatch.from_arrays([item, pa.array(np.arange(len(found), dtype=np.int32)), pa.array(found.view(np.int64))], names=["item", "at", "hash"])

    return arrow_map(items.select("item", "tokens"), run, "item long, at int, hash long")


def _places(hashes: np.ndarray, bits: int, k: int) -> np.ndarray:
    """The k-th bit of each hash in a bitmap of so many bits, a power of two."""
    return (hashes * _ODD[k]) >> np.uint64(64 - bits.bit_length() + 1)


def bitmap(hashes: DataFrame) -> np.ndarray:
    """A Bloom filter of the hashes, as bytes; as many 64-bit words reach the driver as it has, MOST_BITS / 64 at most."""
    bits = LEAST_BITS
    wanted = BITS_EACH * hashes.count()
    while bits < min(wanted, MOST_BITS):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            place = np.unique(np.concatenate([_places(own, bits, k) for k in range(PLACES)]))
            yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (place & np.uint64(63))).view(np.int64))], names=["word", "bit"])

    words = arrow_map(hashes.select("hash"), run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(bits // 64, np.int64)
    for batch in words.toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out.view(np.uint8)


def likely(bitmap: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Places of the hashes that the Bloom filter may hold."""
    at = np.arange(len(found))
    for k in range(PLACES):
        place = _places(found[at], 8 * len(bitmap), k)
        at = at[(bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    return at


def _blocks(documents: DataFrame, known: np.ndarray, short: list[int], longest: int) -> DataFrame:
    """For each block of a document with likely hits: its tokens with context, where they begin, and the hits (hash, place)."""
    shared = documents.sparkSession.sparkContext.broadcast(known)  # MOST_BITS / 8 bytes at most
    size = max(BLOCK, longest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for batch in batches:
            rows, begins, texts, hits = [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                own = tokens(text or b"")
                place, value = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for found in chain(seeds(own), short_seeds(own, short)):
                    at = likely(bitmap, found)
                    place.append(at)
                    value.append(found[at])
                at, found = np.concatenate(place), np.concatenate(value)
                for block in np.unique(at // size).tolist():
                    mine = at // size == block
                    begin = max(0, block * size - longest)
                    rows.append(row)
                    begins.append(begin)
                    texts.append(own[begin : (block + 1) * size + longest].tobytes())
                    hits.append([{"hash": h, "at": a} for h, a in zip(found[mine].view(np.int64).tolist(), at[mine].tolist())])
            kind = pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(begins, pa.int64()), pa.array(texts, pa.binary()), pa.array(hits, kind)], names=["doc_id", "begin", "tokens", "hits"])

    return arrow_map(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), run, "doc_id long, begin long, tokens binary, hits array<struct<hash: long, at: long>>")


def extend(same: np.ndarray, first: int, last: int) -> tuple[int, int]:
    """The best-scoring span of an alignment that holds the seed first..last: start and end, end exclusive."""
    points = np.where(same, AGREE, DIFFER)
    right = np.cumsum(points[last + 1 :])
    left = np.cumsum(points[:first][::-1])
    end = last + 1 + (int(right.argmax()) + 1 if len(right) and right.max() > 0 else 0)
    start = first - (int(left.argmax()) + 1 if len(left) and left.max() > 0 else 0)
    return start, end


def spans(same: np.ndarray) -> set[tuple[int, int]]:
    """The best-scoring spans of an alignment that hold each of its runs of agreeing tokens, and so each of its hits."""
    steps = np.diff(np.r_[0, same.astype(np.int8), 0])
    return {extend(same, first, end - 1) for first, end in zip(np.flatnonzero(steps == 1).tolist(), np.flatnonzero(steps == -1).tolist())}


def best(same: np.ndarray, n: int) -> tuple[int, int, int] | None:
    """Of an alignment of an item of n tokens, the leak with the most agreeing tokens, then the shortest and first: agree, start, end."""
    found = []
    for start, end in spans(same):
        agree = int(same[start:end].sum())
        if agree >= (n if n < SHORT else min(MIN_TOKENS, MIN_SHARE * n)) and agree >= MIN_SHARE * (end - start):
            found.append((agree, start - end, -start))
    if not found:
        return None
    agree, length, start = max(found)
    return agree, -start, -start - length


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, out = [], []
        for row, (shift, text, item) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(2, 5)))):
            doc, own = np.frombuffer(text, np.uint64), np.frombuffer(item, np.uint64)
            low = max(0, -shift)  # of the item, where the document begins
            if found := best(own[low : low + len(doc)] == doc, len(own)):
                agree, start, end = found
                rows.append(row)
                out.append((agree, end - start, low + start, low + start + shift))
        columns = [*zip(*out)] or [[]] * 4
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "item_id", "agree", "length", "item_start", "doc_start"])


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, agree, length, item_start, doc_start: for each document and item that it holds a passage of, the longest one.

    agree: agreeing tokens of the aligned passage; length: all of its tokens; the starts count tokens. A leak has
    MIN_TOKENS agreeing tokens, or MIN_SHARE of a shorter item's, and MIN_SHARE of the passage's; an item under SHORT
    tokens must be there word for word. Of several passages the one with the most agreeing tokens is returned, then the
    shortest, then the first in the document, then in the item.

    Empty and null texts match nothing; texts and items of any length are compared whole. Repeated rows give one result;
    a null doc_id is reported as such, an item without an id is not used. Extra columns are not read.
    """
    items = materialize(_items(benchmark))
    hashes = materialize(_seeds(items).distinct())
    longest, size = items.agg(F.max("n"), F.sum(F.length("tokens"))).first()
    short = [r["n"] for r in items.where(F.col("n") < SHORT).select("n").distinct().collect()]
    blocks = materialize(_blocks(documents, bitmap(hashes), sorted(short), longest or 0).withColumn("block", F.xxhash64("doc_id", "begin", "tokens")), gathered=True)
    hits = blocks.select("block", F.explode("hits").alias("hit")).select("block", "hit.hash", F.col("hit.at").alias("place"))
    aligned = hits.join(hashes, "hash").select("block", "item", (F.col("place") - F.col("at")).alias("shift")).distinct()
    if (size or 0) <= BROADCAST_BYTES:
        items = F.broadcast(items)
    aligned = aligned.join(items.select("item", "n"), "item").join(blocks.drop("hits").dropDuplicates(["block"]), "block")
    at, first = F.col("shift") - F.col("begin"), F.greatest(F.lit(0), F.col("shift") - F.col("begin"))
    own = F.substr("tokens", (8 * first + 1).cast("int"), (8 * (at + F.col("n") - first)).cast("int"))
    both = aligned.select("doc_id", "item", "shift", own.alias("own")).join(items.select("item", "item_id", "tokens"), "item")
    found = arrow_map(both.select("doc_id", "item_id", "shift", "own", "tokens"), _verify, "doc_id long, item_id long, agree long, length long, item_start long, doc_start long")
    most = F.max(F.struct("agree", (-F.col("length")).alias("l"), (-F.col("doc_start")).alias("d"), (-F.col("item_start")).alias("i")))
    found = found.groupBy("doc_id", "item_id").agg(most.alias("b"))
    return found.select("doc_id", "item_id", F.col("b.agree").alias("agree"), (-F.col("b.l")).alias("length"), (-F.col("b.i")).alias("item_start"), (-F.col("b.d")).alias("doc_start"))


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """documents without those that hold a passage of the benchmark (leaks).

    Rows go by doc_id: those of a repeated or null one go if any of them has a leak. Extra columns stay, whatever their names.
    """
    bad = spare("bad", documents)
    gone = leaks(documents, benchmark).select(F.col("doc_id").alias(bad)).distinct()
    return documents.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(bad)), "left_anti")
