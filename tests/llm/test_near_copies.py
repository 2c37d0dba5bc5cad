import random

import numpy as np

from pairloom.llm import near_copies, simhash


def _shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def _planted():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(2000)]
    docs = {}
    for base in range(25):
        text = rng.choices(words, k=rng.choice([4, 12, 60, 200, 300]))
        for copy in range(8):
            own = text[:]
            for _ in range(rng.randint(0, 5) if copy else 0):
                own[rng.randrange(len(own))] = rng.choice(words)
            docs[8 * base + copy] = " ".join(own)
    docs |= {900: None, 901: " ", 902: docs[8].upper()}
    return docs


def _components(docs):
    sets = {k: _shingles(t) for k, t in docs.items()}
    label = {k: k for k in docs}
    near = lambda a, b: a == b or (a | b and len(a & b) >= 0.8 * len(a | b) - 1e-9)
    links = [(x, y) for x in docs for y in docs if x < y and near(sets[x], sets[y])]
    moved = True
    while moved:
        moved = False
        for x, y in links:
            if label[x] != label[y]:
                label[x] = label[y] = min(label[x], label[y])
                moved = True
    return label


def test_planted_near_copies_against_brute_force(spark):
    docs = _planted()
    label = _components(docs)
    frame = spark.createDataFrame([*docs.items()], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(frame).collect()} == label
    kept = {r.doc_id for r in near_copies.keep_first(frame).collect()}
    assert kept == set(label.values())
    assert len(kept) < simhash.keep_first(frame).count()


def test_large_group_in_parts(spark):
    """A group that fills its buckets, dealt in parts: its members are near a few others each."""
    rng = random.Random(6)
    words = [f"w{k}" for k in range(3000)]
    base, docs = rng.choices(words, k=150), {}
    for k in range(240):
        own = (rng.choice([*docs.values()]) if k % 3 else base)[:]
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = rng.choice(words)
        docs[k] = own
    docs = {k: " ".join(t) for k, t in docs.items()} | {k: " ".join(rng.choices(words, k=90)) for k in range(240, 300)}
    frame = spark.createDataFrame([*docs.items()], "doc_id long, text string").repartition(3)
    label = _components(docs)
    for most in (40, 20_000):
        assert {r.doc_id: r.component_id for r in near_copies.near_copies(frame, most).collect()} == label


def test_recall_of_pairs_at_the_limit():
    """Pairs with a similarity of just 0.8 meet in a bucket and lie within the limit as often as promised."""
    rng = np.random.default_rng(7)
    for n in (45, 450):
        met = close = 0
        masks = near_copies.tables(200_000)
        for _ in range(400):
            own = rng.integers(0, 1 << 64, n * 10 // 9, dtype=np.uint64)
            one, two = own[:n], own[-n:]  # 8/9 of each shared: 0.8
            one, two = (np.array(near_copies.fingerprint(np.sort(x)), np.uint64) for x in (one, two))
            close += int(np.bitwise_count(one ^ two).sum()) <= near_copies.LIMIT
            met += any((((one ^ two) & m) == 0).all() for m in masks)
        assert close >= 0.99 * 400 and met >= 0.95 * 400


def test_one_row_of_each_group_stays(spark):
    rows = [(3, "a b c d"), (2, "A B C d"), (2, "A B C d"), (5, "x y z"), (5, "quite another text of the same id"), (7, None), (6, ""), (None, "n o p"), (None, "n o p")]
    got = near_copies.keep_first(spark.createDataFrame([(d, t, "s") for d, t in rows], "doc_id long, text string, __x string"))
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(2, "A B C d"), (5, "x y z"), (5, "quite another text of the same id"), (6, ""), (None, "n o p")], key=str)
    assert near_copies.near_copies(got.where("false")).count() == 0
