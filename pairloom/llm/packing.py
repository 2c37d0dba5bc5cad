"""Packing documents into training sequences by non-negative least squares over length patterns.

The histogram of piece lengths has no more bins than a sequence has tokens, however large the corpus. On it, patterns of
up to three lengths that fill a sequence exactly are enumerated, their repeat counts fitted to the histogram by
non-negative least squares and rounded down, and what is left is packed best-fit, longest first. The plan says for each
length which ranks go to which sequences; every piece finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, materialize
from .tokens import word_ids

#: Rounds of the least-squares fit; each moves the best patterns that share no length.
ROUNDS = 400
#: Lengths left over count by this power of their share of a sequence: short ones fill gaps later.
POWER = 2.0


def pieces(documents: DataFrame, tokenizer: str, most: int, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's ids and the closing id, cut only where longer than most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, end = word_ids(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                ids = store.ids(text or b"") + end
                for n, at in enumerate(range(0, len(ids), 4 * most)):
                    part = ids[at : at + 4 * most]
                    row.append(k)
                    piece.append(n)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return arrow_map(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fit(histogram: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows of three lengths, 0 for none) that fill a sequence exactly, and how often each is used.

    histogram: counts by length, from 0 to the sequence's size. Least squares by blocks of coordinates: each round takes
    the patterns whose exact line search lowers the squared rest most and which share no length.
    """
    most = len(histogram) - 1
    there = np.flatnonzero(histogram)
    there = there[there > 0]
    has = np.zeros(most + 1, bool)
    has[there] = True
    found = [np.array([[0, 0, most]])] if has[most] else []
    a = there[2 * there <= most]
    a = a[has[most - a]]
    found.append(np.stack([0 * a, a, most - a], 1))
    for first in there[3 * there <= most]:
        second = there[(there >= first) & (first + 2 * there <= most)]
        second = second[has[most - first - second]]
        found.append(np.stack([0 * second + first, second, most - first - second], 1))
    patterns = np.concatenate(found)
    if not len(patterns):
        return patterns, np.zeros(0, np.int64)
    one, two, three = (np.ascontiguousarray(x) for x in patterns.T)
    weight = (np.arange(most + 1) / most) ** POWER  # no weight for length 0
    norm = weight[one] + weight[two] + weight[three]
    for x, y in ((one, two), (two, three), (one, three)):
        norm += 2 * weight[x] * (x == y)
    rest = histogram * weight
    used = np.zeros(len(patterns))
    for _ in range(rounds):
        slope = rest[one] + rest[two] + rest[three]
        step = np.maximum(slope / norm, -used)
        gain = step * (2 * slope - step * norm)
        top = min(len(gain), 512)
        order = np.argpartition(-gain, top - 1)[:top]
        order = order[np.argsort(-gain[order], kind="stable")]
        least, taken = max(1e-3, 0.01 * gain[order[0]]), set()
        if gain[order[0]] < 1e-3:
            break
        for k in order:
            mine = {*patterns[k].tolist()} - {0}
            if gain[k] < least:
                break
            if taken & mine:
                continue
            taken |= mine
            used[k] += step[k]
            for length in patterns[k]:
                rest[length] -= step[k] * weight[length]
    return patterns, used


def plan(histogram: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, int]:
    """Slots (length, first rank, ranks, first sequence, offset, of one length in a sequence), and how many sequences there are."""
    most = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    groups: list[tuple[list[int], int]] = []
    patterns, used = fit(left, rounds)
    for k in np.argsort(-used, kind="stable"):
        if (n := int(used[k] + 1e-6)) < 1:
            break
        lengths = [x for x in patterns[k].tolist() if x]
        n = min([n, *(int(left[x]) // lengths.count(x) for x in lengths)])
        if n:
            groups.append((lengths, n))
            for x in lengths:
                left[x] -= n
    open_: dict[int, list[tuple[list[int], int]]] = {}
    spaces: list[int] = []

    def put(lengths: list[int], n: int) -> None:
        space = most - sum(lengths)
        if not space:
            groups.append((lengths, n))
            return
        if not open_.get(space):
            insort(spaces, space)
        open_.setdefault(space, []).append((lengths, n))

    for length in range(most, 0, -1):
        count = int(left[length])
        while count:
            at = bisect_left(spaces, length)
            if at == len(spaces):
                each = most // length
                if count >= each:
                    put([length] * each, count // each)
                if count % each:
                    put([length] * (count % each), 1)
                break
            space = spaces[at]
            lengths, n = open_[space].pop()
            if not open_[space]:
                del spaces[at]
            each = min(space // length, count)
            n, rest = (count // each, n - count // each) if count // each < n else (n, 0)
            if rest:
                put(lengths, rest)
            put([*lengths, *[length] * each], n)
            count -= n * each
    groups += [g for gs in open_.values() for g in gs]
    ranks, slots, sequences = np.zeros(most + 1, np.int64), [], 0
    for lengths, n in groups:
        offset = 0
        for length in sorted(set(lengths), reverse=True):
            each = lengths.count(length)
            slots.append((length, int(ranks[length]), n * each, sequences, offset, each))
            ranks[length] += n * each
            offset += each * length
        sequences += n
    return np.array(sorted(slots), np.int64).reshape(-1, 6), sequences


def pack(documents: DataFrame, tokenizer: str = "word_bpe_49k.json", most: int = 2048, end_id: int = 0, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece of every document.

    A null or empty text is the closing id alone. Repeated rows and doc_ids are packed each by itself, texts of any length
    whole; extra columns are not read. Pieces rank among those of their length by the partition they are read in and
    their place there; ranks are written with the partition before they are counted, so a lost executor changes nothing.
    """
    parts = materialize(pieces(documents, tokenizer, most, end_id), gathered=True).withColumn("pid", F.spark_partition_id())

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(most + 1, np.int64)
        for batch in batches:
            lengths = batch.column(3).to_numpy(zero_copy_only=False)
            order = np.argsort(lengths, kind="stable")
            own = lengths[order]
            heads = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
            counts = np.diff(np.r_[heads, len(own)])
            rank = np.empty(len(own), np.int64)
            rank[order] = np.arange(len(own)) - np.repeat(heads, counts) + seen[own]
            seen[own[heads]] += counts
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rank)], names=[*batch.schema.names, "rank"])

    numbered = materialize(arrow_map(parts, number, "doc_id long, piece int, start long, length long, ids_crc32 long, pid int, rank long"))
    counts = materialize(numbered.groupBy("pid", "length").count())
    histogram = np.zeros(most + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("count").alias("n")).collect():  # no more rows than a sequence has tokens
        histogram[row["length"]] = row["n"]
    slots, _ = plan(histogram, rounds)
    before = counts.select("pid", "length", (F.sum("count").over(Window.partitionBy("length").orderBy("pid")) - F.col("count")).alias("before"))
    ranked = numbered.join(before, ["pid", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    shared = documents.sparkSession.sparkContext.broadcast(slots)  # bounded by the patterns of one histogram

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        firsts = np.searchsorted(table[:, 0], np.arange(most + 2))
        key = table[:, 0] * (1 << 50) + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
            at = np.searchsorted(key, length * (1 << 50) + rank, side="right") - 1
            assert (at >= firsts[length]).all()
            _, first, _, sequence, offset, each = table[at].T
            n = rank - first
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence + n // each), pa.array(offset + n % each * length)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return arrow_map(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
