import random

import numpy as np
import pytest
import xxhash

from pairloom.llm import simhash
from pairloom.llm.common import components


def _fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _groups(values, distance):
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= distance
    label = np.arange(len(values))
    while True:
        new = np.where(near, label[None, :], len(values)).min(1)
        if (new == label).all():
            return label
        label = new


def test_fingerprints():
    rng = random.Random(1)
    for text in ["", " \t\n", "One", "A b", "Éa b C d", "x\x0by\x1cz \x85 w", *(" ".join(rng.choices("abcdefg", k=rng.randint(1, 30))) for _ in range(20))]:
        assert simhash.fingerprint(text.encode()) == _fingerprint(text)
    assert simhash.fingerprint(None) == 0


def test_spark_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    got = spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", seed=42)


@pytest.mark.parametrize("most", [20_000, 4])
def test_links_span_all_near_pairs(spark, most):
    rng = np.random.default_rng(7)
    values = []
    for base in rng.integers(0, 1 << 63, 40, dtype=np.uint64).tolist():
        for _ in range(12):
            x = base
            for bit in rng.integers(0, 64, rng.integers(0, 4)).tolist():
                x ^= 1 << bit
            values.append(x)
    values = np.unique(np.array(values, np.uint64))
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in components(simhash.near_links(frame, 2, most)).collect()}
    found, wanted = {}, {}
    for v, label in zip(values.view(np.int64).tolist(), _groups(values, 2)):
        found.setdefault(roots.get(v, v), set()).add(v)
        wanted.setdefault(int(label), set()).add(v)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, wanted.values()))


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(60)] + [(1000, 1000 + k) for k in range(1, 50)] + [(5, 5), (7, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[k] for k in range(61)}) == 1 and len({got[1000 + k] for k in range(50)}) == 1 and got[0] != got[1000]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    base = rng.choices(words, k=300)
    near = base[:]
    near[150] = "other"
    rows = [(4, " ".join(base)), (2, " ".join(base).upper()), (9, " ".join(near)), (1, " ".join(rng.choices(words, k=300))), (7, None), (6, ""), (8, " \n"), (4, " ".join(base)), (None, "alone here today")]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fp string, component_id int")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[4].component_id == by[2].component_id == 2
    assert by[7].component_id == by[6].component_id == by[8].component_id == 6 and by[7].fp == 0
    values = np.array([_fingerprint(t or "") for _, t in rows], np.uint64)
    if np.bitwise_count(values[0] ^ values[2]) <= 2:
        assert by[9].component_id == 2
    assert by[1].component_id == 1 and by[None].component_id is None
    assert simhash.near_duplicates(docs.where("false")).count() == 0


def test_one_row_of_each_group_stays(spark):
    rows = [(3, "a b c d"), (2, "A B C d"), (2, "A B C d"), (5, "x y z"), (5, "x y z"), (5, "quite another text of the same id"), (7, None), (6, ""), (None, "n o p"), (None, "n o p"), (None, None)]
    docs = spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, __x string")
    got = simhash.keep_first(docs)
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(2, "A B C d"), (5, "x y z"), (5, "quite another text of the same id"), (6, ""), (None, "n o p"), (None, None)], key=str)
    assert simhash.keep_first(docs.where("doc_id IN (3, 5) AND text <> 'x y z'")).count() == 2 and simhash.keep_first(docs.where("false")).count() == 0


def test_very_long_text_and_odd_columns(spark):
    long = " ".join(f"w{k % 9973}" for k in range(200_000))
    rows = [(5, long), (3, long.upper()), (4, "short text")]
    frame = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, own int, fp int, component_id string")
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(frame).collect()}
    assert got[3] == got[5] and got[3][1] == 3 and got[4][1] == 4
    words = long.split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]), 42) for k in range(len(words) - 2)]
    assert got[3][0] % (1 << 64) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    kept = simhash.keep_first(frame)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4]
