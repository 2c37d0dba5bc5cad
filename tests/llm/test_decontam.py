import random

import numpy as np

from pairloom.llm import decontam


def test_leaks(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(3000)]
    items = {k: rng.choices(words, k=rng.randint(14, 60)) for k in range(30)}
    docs, wanted = {}, set()
    for k in range(90):
        text = rng.choices(words, k=400)
        if k < 60:
            item = items[k % 30][:]
            if k >= 30:  # one token in nine is another
                for at in range(4, len(item), 9):
                    item[at] = "other"
            text[200:200] = item
            wanted.add((k, k % 30))
        docs[k] = " ".join(text)
    docs[90], docs[91], docs[92] = None, "", " ".join(x.upper() + "," for x in items[3]) + " É"
    wanted.add((92, 3))
    bench = [(k, " ".join(v)) for k, v in items.items()] + [(100, None), (101, ""), (102, "a too short item"), (None, " ".join(items[1]))]
    b = spark.createDataFrame([(*x, "x") for x in bench], "item_id long, text string, doc_id string")
    d = spark.createDataFrame([(*x, 1) for x in docs.items()], "doc_id long, text string, agree int")
    got = decontam.leaks(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in got} == wanted
    assert all(r.agree == r.length == len(items[r.item_id]) and r.doc_start == 200 for r in got if r.doc_id < 30)
    kept = {r.doc_id for r in decontam.decontaminate(d, b).collect()}
    assert kept == set(range(60, 92))
    assert decontam.leaks(d.where("false"), b).count() == 0 and decontam.leaks(d, b.where("false")).count() == 0
    assert decontam.leaks(d.union(d).where("doc_id < 3"), b).count() == 3


def test_masks_ignore_their_positions():
    rng = np.random.default_rng(1)
    for n, mask in enumerate(decontam.MASKS):
        a = rng.integers(0, 1 << 63, len(mask), dtype=np.uint64)
        for at, c in enumerate(mask):
            b = a.copy()
            b[at] += np.uint64(1)
            assert ([*decontam.seeds(a)][n] == [*decontam.seeds(b)][n]).all() == (c == "0")


def test_extension_is_the_best_span():
    rng = random.Random(3)
    for _ in range(200):
        same = np.array([rng.random() < 0.8 for _ in range(30)])
        at = rng.randrange(30)
        points = np.where(same, decontam.AGREE, decontam.DIFFER)
        start, end = decontam.extend(same, at, at)
        best = max(points[a:b].sum() for a in range(at + 1) for b in range(at + 1, 31))
        assert start <= at < end and points[start:end].sum() == best


def test_every_run_of_an_alignment_is_verified(spark):
    item = [f"w{k}" for k in range(27)]
    doc = [f"d{k}" for k in range(50)] + item[:7] + [f"o{k}" for k in range(6)] + item[13:] + [f"e{k}" for k in range(50)]
    d = spark.createDataFrame([(1, " ".join(doc))], "doc_id long, text string")
    b = spark.createDataFrame([(4, " ".join(item))], "item_id long, text string")
    assert [tuple(r) for r in decontam.leaks(d, b).collect()] == [(1, 4, 14, 14, 13, 63)]


def test_spans_hold_the_best_for_every_token():
    rng = random.Random(6)
    for _ in range(100):
        same = np.array([rng.random() < 0.7 for _ in range(40)])
        found = decontam.spans(same)
        assert {decontam.extend(same, k, k) for k in np.flatnonzero(same).tolist()} == found
    assert decontam.spans(np.zeros(3, bool)) == set() == decontam.spans(np.zeros(0, bool))


def _best(same, n):
    """The best leak of an alignment, by trying every span for every agreeing token."""
    points = np.where(same, decontam.AGREE, decontam.DIFFER)
    sums = np.r_[0, np.cumsum(points)]
    found = []
    for at in np.flatnonzero(same):
        spans = [(sums[e] - sums[s], -(e - s), s, e) for s in range(at + 1) for e in range(at + 1, len(same) + 1)]
        most = max(spans)[0]
        for score, _, s, e in spans:
            agree = int(same[s:e].sum())
            # of equally good spans the shortest one counts
            if score == most and -(e - s) == max(x[1] for x in spans if x[0] == most):
                if agree >= (n if n < decontam.SHORT else min(decontam.MIN_TOKENS, decontam.MIN_SHARE * n)) and agree >= decontam.MIN_SHARE * (e - s):
                    found.append((agree, -(e - s), -s))
    return max(found, default=None)


def _brute(docs, items):
    """All leaks, by trying every alignment that a mask or a short item vouches for."""
    out = {}
    for d, doc in docs.items():
        for i, item in items.items():
            n = len(item)
            for shift in range(1 - n, len(doc)):
                low, high = max(0, -shift), min(n, len(doc) - shift)
                same = np.array([item[k] == doc[k + shift] for k in range(low, high)])
                if n < decontam.SHORT:
                    seeded = len(same) == n and same.all() and (n >= decontam.LEAST_PASSAGE or n == len(doc))
                else:
                    seeded = any(all(same[p + k] for k, c in enumerate(m) if c == "1") for m in decontam.MASKS for p in range(len(same) - len(m) + 1))
                if seeded and (b := _best(same, n)):
                    key = (b[0], b[1], -(low - b[2] + shift), -(low - b[2]))
                    out[d, i] = max(out.get((d, i), key), key)
    return {(d, i, a, -n, -it, -at) for (d, i), (a, n, at, it) in out.items()}


def test_leaks_against_brute_force(spark):
    rng = random.Random(11)
    for size in (3, 12):
        words = [f"w{k}" for k in range(size)]
        items = {k: rng.choices(words, k=n) for k, n in enumerate([1, 2, 3, 5, 6, 7, 8, 9, 12, 20, 33])}
        docs = {k: rng.choices(words, k=rng.choice([0, 1, 2, 8, 30, 60])) for k in range(25)}
        for k in range(25, 32):
            copy = items[rng.choice([8, 9, 10])][:]
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = "z"
            docs[k] = rng.choices(words, k=rng.randint(0, 9)) + copy + rng.choices(words, k=rng.randint(0, 9))
        docs[40], docs[41] = items[0], items[1]
        d = spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()], "doc_id long, text string")
        b = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()], "item_id long, text string")
        assert {tuple(r) for r in decontam.leaks(d, b).collect()} == _brute(docs, items)


def test_long_passages_and_chance_seeds(spark):
    rng = random.Random(12)
    words = [f"w{k}" for k in range(5000)]
    long, item, short = rng.choices(words, k=3000), rng.choices(words, k=60), rng.choices(words, k=3)
    filler = lambda n: [f"x{rng.random()}" for _ in range(n)]
    docs = {
        1: filler(700) + long + filler(50),
        2: filler(10) + item[:8] + filler(30) + item[38:58] + filler(10),
        3: filler(20) + short + filler(20),
        4: filler(20) + short[:2] + filler(20),
        5: filler(30_000) + item,
    }
    d = spark.createDataFrame([(k, " ".join(v), "a", "b", "c") for k, v in docs.items()], "doc_id long, text string, bad string, bad_ string, `a.b` string")
    b = spark.createDataFrame([(k, " ".join(v)) for k, v in ((7, long), (8, item), (9, short))], "item_id long, text string")
    assert {(r.doc_id, r.item_id): (r.agree, r.length) for r in decontam.leaks(d, b).collect()} == {(1, 7): (3000, 3000), (2, 8): (20, 20), (3, 9): (3, 3), (5, 8): (60, 60)}
    left = decontam.decontaminate(d, b)
    assert left.columns == d.columns and [r.doc_id for r in left.collect()] == [4]
