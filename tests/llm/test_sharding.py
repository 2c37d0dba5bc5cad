import random
import zlib

import pytest

from pairloom.llm import sharding


def _check(rows, got, shards, largest):
    assert len(got) == len(rows)
    wanted = sorted((d is not None, d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert sorted((r.doc_id is not None, r.doc_id, r.size, r.text_crc32) for r in got) == wanted
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by.values())
    assert set(by) <= set(range(shards))
    mean = sum(r.size for r in got) / shards
    assert all(abs(sum(r.size for r in rs) - mean) <= largest + 0.002 * mean for rs in by.values())


@pytest.mark.parametrize("hot", [0, 400])
def test_shards(spark, hot):
    rng = random.Random(hot)
    rows = [(k, "é" * rng.randint(0, 60)) for k in range(600)] + [(1000 + k, "copy of a text that many share") for k in range(hot)]
    rows += [(-5, None), (-6, ""), (None, "a"), (-7, "y" * 500)]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, size int").repartition(6)
    for probes in (64, sharding.PROBES):
        _check(rows, sharding.shard(docs, probes=probes).collect(), 16, 501)


def test_copies_lie_together(spark):
    rows = [(k, f"text {k // 5}") for k in range(2000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    homes = {}
    for r in got:
        homes.setdefault(r.doc_id // 5, set()).add(r.shard)
    assert sum(len(h) > 1 for h in homes.values()) <= 15  # only those that a splitter cuts


def test_equal_rows_and_empty(spark):
    rows = [(1, "same")] * 40
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 40 and len({r.shard for r in got}) == 1 and sorted(r.slot for r in got) == list(range(40))
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_places_below_probes():
    import numpy as np

    rng = np.random.default_rng(1)
    probes = sorted({(int(a), int(b)) for a, b in rng.integers(-3, 4, (12, 2))})
    keys = rng.integers(-4, 5, (300, 2))
    ph, pd = (np.array(c) for c in zip(*probes))
    got = sharding._below(keys[:, 0], keys[:, 1], ph, pd)
    assert got.tolist() == [sum(p <= (int(h), int(d)) for p in probes) for h, d in keys]
    for k in [(-(1 << 63), -(1 << 63)), (0, 0), ((1 << 63) - 1, 5)]:
        assert sharding._pair(sharding._key(*k)) == k


def test_very_long_texts_and_odd_columns(spark):
    rows = [(k, "z" * 3_000_000 if k % 50 == 0 else f"t{k}") for k in range(200)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, h int, d int, range int")
    _check(rows, sharding.shard(docs).collect(), 16, 3_000_001)
