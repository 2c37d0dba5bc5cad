"""Line dedup by winnowing over line hashes.

A window is the shortest span of lines from a line on that has min_words words (blank lines do not count). The line with
the least hash in a window, the rightmost of equals, is its fingerprint: equal windows choose the same one, so runs that
share min_words words or more are sure to share a fingerprint. Only the positions of fingerprints are joined; those whose
hash occurs nowhere else are dropped. Around the others the windows are compared as a whole, by 128-bit hashes, with the
first place where the same lines occur, and a match is extended both ways: to the right by the windows from each of its
lines on, to the left and up to its last line by the shortest spans that end at a line. The union of what occurs earlier
are the maximal runs, and those lines are deleted. Earlier: smaller doc_id (null first), then by a hash of the text where
rows share a doc_id, then earlier in the text; places may overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, every, materialize, spare, spread_join

#: Words that a repeated run must have.
MIN_WORDS = 30
#: Bytes of a line's hash.
WIDE = 16


def line_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Of the lines that are not blank: their places, one more for the end of the text; the words up to each of them; their hashes."""
    lines = [line.strip() for line in text.split(b"\n")]
    at = [k for k, line in enumerate(lines) if line]
    words = np.cumsum([0, *(len(lines[k].split()) for k in at)])
    return np.array([*at, len(lines)], np.int32), words.astype(np.int64), b"".join([xxhash.xxh3_128_digest(lines[k]) for k in at])


def ends_of(words: np.ndarray, min_words: int) -> np.ndarray:
    """For each line the last line of the window from it on; as many as there are windows."""
    ends = np.searchsorted(words[1:], words[:-1] + min_words)
    return ends[ends < len(words) - 1]


def chosen(hashes: bytes, ends: np.ndarray) -> np.ndarray:
    """The fingerprint's line of each window: the rightmost of the least hashes."""
    own = np.frombuffer(hashes, "<u8")[::2]
    out = np.zeros(len(ends), np.int64)
    waiting: list[int] = []  # lines of growing hash, each the least of those after it so far
    head = to = 0
    for k, end in enumerate(ends.tolist()):
        while to <= end:
            while len(waiting) > head and own[waiting[-1]] >= own[to]:
                waiting.pop()
            waiting.append(to)
            to += 1
        while waiting[head] < k:
            head += 1
        out[k] = waiting[head]
    return out


def spans_up_to(words: np.ndarray, min_words: int) -> np.ndarray:
    """For each line the first line of the shortest span up to it with enough words; -1 where there is none."""
    return np.searchsorted(words, words[1:] - min_words, "right") - 1


def _version() -> Column:
    """Tells rows apart that share a doc_id but not the text."""
    return F.xxhash64("text").alias("version")


def _lines(documents: DataFrame, min_words: int) -> DataFrame:
    """doc_id, version, at, words, hashes of every row that has a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [line_hashes(t or b"") for t in batch.column(2).to_pylist()]
            rows = [k for k, (_, words, _) in enumerate(found) if words[-1] >= min_words]
            columns = [pa.array(c, pa.binary()) for c in ([found[k][0].tobytes() for k in rows], [found[k][1].tobytes() for k in rows], [found[k][2] for k in rows])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows, pa.int64())) for c in (0, 1)), *columns], names=["doc_id", "version", "at", "words", "hashes"])

    return arrow_map(documents.select(F.col("doc_id").cast("long"), _version(), F.col("text").cast("binary")), run, "doc_id long, version long, at binary, words binary, hashes binary")


def _positions(lines: DataFrame, min_words: int) -> DataFrame:
    """doc_id, version, line and fp of every position that a window chooses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, prints = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for row, (words, hashes) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                own = np.unique(chosen(hashes, ends_of(np.frombuffer(words, np.int64), min_words)))
                rows.append(np.full(len(own), row))
                places.append(own)
                prints.append(np.frombuffer(hashes, np.int64)[::2][own])
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(prints))], names=["doc_id", "version", "line", "fp"])

    return arrow_map(lines.select("doc_id", "version", "words", "hashes"), run, "doc_id long, version long, line int, fp long")


def windows_around(hits: list[int], at: np.ndarray, words: np.ndarray, hashes: bytes, min_words: int) -> Iterator[tuple[int, int, int, int]]:
    """(first line, last line and the blank ones after it, 128-bit hash as two) of the windows that chose a hit, and of the spans up to a line that begin with one."""
    ends = ends_of(words, min_words)
    near = np.isin(chosen(hashes, ends), hits)

    def row(k: int, end: int) -> tuple[int, int, int, int]:
        key = xxhash.xxh3_128_intdigest(hashes[WIDE * k : WIDE * (end + 1)])
        return int(at[k]), int(at[end + 1]) - 1, key >> 64, key & ((1 << 64) - 1)

    for k in np.flatnonzero(near).tolist():
        yield row(k, int(ends[k]))
    for end, k in enumerate(spans_up_to(words, min_words).tolist()):
        if 0 <= k < len(near) and near[k] and ends[k] != end:
            yield row(k, end)


def _windows(lines: DataFrame, hits: DataFrame, min_words: int) -> DataFrame:
    """doc_id, version, start, end, k0, k1 of the windows around hits (doc_id, version, hits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for k, (own, at, words, hashes) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(2, 6)))):
                more = [*windows_around(own, np.frombuffer(at, np.int32), np.frombuffer(words, np.int64), hashes, min_words)]
                rows += [k] * len(more)
                found += more
            start, end, k0, k1 = [*zip(*found)] or [[]] * 4
            index = pa.array(rows, pa.int64())
            keys = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in (k0, k1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), pa.array(start, pa.int32()), pa.array(end, pa.int32()), *keys], names=["doc_id", "version", "start", "end", "k0", "k1"])

    own = hits.select(F.col("doc_id").alias("d"), F.col("version").alias("v"), "hits")
    rows = lines.join(own, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")))
    return arrow_map(rows.select("doc_id", "version", "hits", "at", "words", "hashes"), run, "doc_id long, version long, start int, end int, k0 long, k1 long")


def repeated_runs(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, version, runs: for each document with lines to delete, its maximal runs of them (start and end, lines from 0, both inclusive)."""
    lines = materialize(_lines(documents, min_words), gathered=True)
    positions = materialize(_positions(lines, min_words), gathered=True)
    shared = positions.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
    hits = spread_join(positions, shared, ["fp"], ["doc_id", "version"], "left_semi").groupBy("doc_id", "version").agg(F.collect_set("line").alias("hits"))
    near = materialize(_windows(lines, hits, min_words))
    place = F.struct("doc_id", "version", "start")
    first = near.groupBy("k0", "k1").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = spread_join(near, first, ["k0", "k1"], ["doc_id", "version"]).where(place > F.col("first")).select("doc_id", "version", "start", "end")
    in_text = Window.partitionBy("doc_id", "version").orderBy("start", "end")
    reach = F.max("end").over(in_text.rowsBetween(Window.unboundedPreceding, -1))
    later = later.distinct().withColumn("opens", F.coalesce(F.col("start") > reach + 1, F.lit(True)).cast("int"))
    later = later.withColumn("run", F.sum("opens").over(in_text.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = later.groupBy("doc_id", "version", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy("doc_id", "version").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))


def dedup_lines(documents: DataFrame, min_words: int = MIN_WORDS, removed: str = "removed_runs") -> DataFrame:
    """documents with the later ones of repeated runs of lines deleted from text, and a column of the deleted runs (null for none).

    A run of min_words words or more that occurs earlier, in another text or in its own, is deleted as far as it is equal.
    Lines compare without the white space at their ends; blank lines after a deleted line go with it. Null and empty
    texts stay. Repeated rows (equal doc_id and text) are one document: all keep or lose the same lines; a text repeated
    under another doc_id loses all of them. A null doc_id comes first. Texts of any length are read whole. Extra columns
    stay as they are; removed names the new column, in place of one of that name.
    """
    d, v, r, own = (spare(n, documents) for n in ("run_doc", "run_version", "runs", "own_version"))
    runs = repeated_runs(documents, min_words)
    runs = runs.select(F.col("doc_id").alias(d), F.col("version").alias(v), F.col("runs").alias(r))
    rows = documents.select(*[c for c, name in zip(every(documents), documents.columns) if name.lower() != removed.lower()], _version().alias(own))
    joined = rows.join(runs, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.col(own) == F.col(v)), "left")
    kept = F.filter(F.split("text", "\n", -1), lambda _, k: ~F.exists(r, lambda x: (x["start"] <= k) & (k <= x["end"])))
    text = F.when(F.col(r).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn("text", text).withColumn(removed, F.col(r)).drop(d, v, own, r)
