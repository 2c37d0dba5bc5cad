"""Cleanup and the final pass agree with item-by-item readings of their rules."""

import random
from collections import Counter

from pyspark.sql import functions as F

from pairloom.operators import evaluate, port, results, state

SCHEMA = "category string, ea1 string, name1 string, ea2 string, name2 string, description string, ratio double, nodes1 long, nodes2 long, id1 long, id2 long, seq long"


def _items(rng, n):
    out, seen = [], set()
    for seq in range(n):
        a, b = rng.randint(1, 6), rng.randint(1, 6)
        ratio = rng.choice([0.5, 0.6, 0.7, 0.8, 1.0])
        category = "best" if ratio == 1 else "partial"
        if (a, b, ratio) not in seen:
            seen.add((a, b, ratio))
            out.append((category, str(a), f"n{a}", str(b), rng.choice([f"m{b}", f"n{a}"]) if ratio < 1 and rng.random() < 0.1 else f"m{b}", f"d{seq}", ratio, 1, 1, a, b, seq))
    return out


def _ordered(items):
    return sorted(items, key=lambda x: (state.CATEGORIES.index(x[0]), -x[6], x[11]))


def _cleanup(items):
    names, best, out = set(), {}, []
    for x in _ordered(items):
        if (x[2], x[4]) in names:
            continue
        names.add((x[2], x[4]))
        own = 1.0 if x[2] == x[4] else x[6]
        above = best.get(x[1])
        best[x[1]] = max(own, above or 0.0)
        if above is None or above <= own:
            out.append(x)
    return out


def _final(items):
    unique = {}
    for x in _ordered(items):
        unique.setdefault((x[1], x[3]), x)
    top1, top2, k, kb = {}, {}, [], []
    for x in unique.values():
        top1[x[1]] = max(top1.get(x[1], 0), x[6])
        if x[6] >= top1[x[1]]:
            k.append(x)
            top2[x[3]] = max(top2.get(x[3], 0), x[6])
            if x[6] >= top2[x[3]]:
                kb.append(x)
    count = lambda rows, at: {v: sum(r[at] == v for r in rows) for v in {r[at] for r in rows}}
    ma = [x for x in k if count(k, 1)[x[1]] > 1]
    mb = [x for x in kb if count(kb, 3)[x[3]] > 1 and x not in ma]
    gone1, gone2 = {x[1] for x in ma}, {x[3] for x in mb}
    most1 = {}
    for x in unique.values():
        most1[x[1]] = max(most1.get(x[1], 0), x[6])
    most2 = {}
    for x in k:
        most2[x[3]] = max(most2.get(x[3], 0), x[6])
    kept = [x for x in items if x[1] not in gone1 and x[3] not in gone2 and x[6] >= most1[x[1]] and x[6] >= most2.get(x[3], 0)]
    return kept + [("multimatch", *x[1:]) for x in ma + mb]


def test_against_rules(spark):
    for seed in range(4):
        items = _items(random.Random(seed), 25)
        df = spark.createDataFrame(items, SCHEMA)
        assert sorted(map(tuple, state.cleanup(df).select(*state.MATCH).collect())) == sorted(_cleanup(items))
        assert sorted(map(tuple, state.final_pass(df).collect())) == sorted(_final(items))


def test_take_leaves_what_is_certain(spark):
    known = spark.createDataFrame([("best", "1", "n1", "1", "m1", "d", 1.0, 1, 1, 1, 1, 0), ("partial", "2", "sub_2", "2", "m2", "d", 0.6, 1, 1, 2, 2, 1)], SCHEMA)
    new = [("partial", "1", "n1", "3", "m3", "d", 0.9, 1, 1, 1, 3, 2), ("partial", "2", "sub_2", "4", "m4", "d", 0.5, 1, 1, 2, 4, 3), ("partial", "2", "sub_2", "5", "m5", "d", 0.7, 1, 1, 2, 5, 4), ("best", "6", "nullsub_1", "6", "m6", "d", 1.0, 1, 1, 6, 6, 5), ("best", "7", None, "7", "m7", "d", 1.0, 1, 1, 7, 7, 6)]
    got = state.take(spark.createDataFrame(new, SCHEMA), known)
    assert sorted((r.id1, r.id2) for r in got.collect()) == [(2, 5), (7, 7)]


def _taken(candidates, known):
    """Candidate by candidate, with an entry for each name."""
    one, two, out = {}, {}, []
    for x in sorted(known, key=lambda x: (state.CATEGORIES.index(x[0]), -x[6], x[11], x[9], x[10])):
        one[x[2]], two[x[4]] = (x[4], x[6]), (x[2], x[6])
    for x in sorted(candidates, key=lambda x: (x[11], x[9], x[10])):
        n1, n2, ratio = x[2], x[4], x[6]
        if n1.startswith("nullsub_") or n2.startswith("nullsub_") or 1.0 in (one.get(n1, (0, 0))[1], two.get(n2, (0, 0))[1]):
            continue
        if not n1.startswith("sub_") and not n2.startswith("sub_") and n1 in one:
            better = one[n1][0] == n1
        else:
            better = one.get(n1, (0, 0))[1] > ratio or two.get(n2, (0, 0))[1] > ratio
        if not better:
            out.append(x)
            one[n1], two[n2] = (n2, 1.0 if n1 == n2 else ratio), (n1, 1.0 if n1 == n2 else ratio)
    return out


def test_take_against_one_by_one(spark):
    for seed in range(5):
        rng = random.Random(seed)
        name = lambda k: rng.choice([f"sub_{k}", f"sub_{k}", f"f{k}", "nullsub_1"])
        names = [[name(k) for k in range(12)] for _ in range(2)]
        rows = []
        for seq in range(70):
            a, b = rng.randrange(12), rng.randrange(12)
            ratio = rng.choice([0.5, 0.6, 0.7, 0.8, 0.9, 1.0])
            rows.append(("best" if ratio == 1 else "partial", str(a), names[0][a], str(b), names[1][b], f"d{seq}", ratio, 1, 1, a, b, seq // 3))
        known = [x for x in rows[:12] if "nullsub_1" not in x][:6]
        got = state.take(spark.createDataFrame(rows[12:], SCHEMA), spark.createDataFrame(known, SCHEMA))
        assert sorted(map(tuple, got.collect())) == sorted(_taken(rows[12:], known))
    chain = [("partial", "1", "sub_1", "1", "sub_m1", "d", 0.9, 1, 1, 1, 1, 0), ("partial", "2", "sub_2", "1", "sub_m1", "d", 0.8, 1, 1, 2, 1, 1), ("partial", "2", "sub_2", "2", "sub_m2", "d", 0.7, 1, 1, 2, 2, 2)]
    assert [(r.id1, r.id2) for r in state.take(spark.createDataFrame(chain, SCHEMA), None).orderBy("seq").collect()] == [(1, 1), (2, 2)]


def test_take_settles_long_chains_in_few_tables(spark, monkeypatch):
    """A path of names where every decision hangs on the one before; equal candidates count one by one. By rounds, by pieces and by one piece."""
    rng, rows = random.Random(1), []
    for seq in range(400):
        a, b = rng.randrange(20), rng.randrange(20)
        rows.append(("partial", str(a), rng.choice([f"f{a}", f"sub_{a}"]), str(b), rng.choice([f"f{b}", f"sub_{b}"]), "d", rng.choice([0.4, 0.5, 0.6, 0.7, 0.8]), 1, 1, a, b, seq))
    rows += [("best", "50", "f50", "50", "f50", "d", 1.0, 1, 1, 50, 50, 1000)] * 3
    rows += [("partial", str(k), f"sub_c{(k + 1) // 2}", str(k), f"sub_d{k // 2}", "d", 0.9 - k / 1000, 1, 1, k, k, 2000 + k) for k in range(60)]
    wanted, df = sorted(_taken(rows, [])), spark.createDataFrame(rows, SCHEMA)
    written, kept = [], state.materialize
    monkeypatch.setattr(state, "materialize", lambda df, *a: written.append(1) or kept(df, *a))
    for step, shrinks, most in ((500_000, 0.75, 8), (150, 0.75, 40), (1, 2.0, 300)):
        monkeypatch.setattr(state, "STEP", step)
        monkeypatch.setattr(state, "SHRINKS", shrinks)
        written.clear()
        if step > 1:
            assert sorted(map(tuple, state.take(df, None).collect())) == wanted and len(written) < most
        else:
            some = [x for x in rows if x[11] < 60 or x[11] == 1000]  # rounds alone
            assert sorted(map(tuple, state.take(spark.createDataFrame(some, SCHEMA), None).collect())) == sorted(_taken(some, []))
    monkeypatch.undo()
    decided = state.decisions(df, None)
    assert sorted(map(tuple, decided.where("decision = 'accepted'").select(*state.MATCH).collect())) == wanted and decided.count() == len(rows)


def test_results_are_texts_and_read_back(spark):
    rows = [("partial", "4294967296", "a", "16", "b", "d", 0.12345678, 3, 4, 1, 1, 0), ("best", "255", "c", "16", "d", "d", 1.0, 3, 4, 2, 2, 1), ("multimatch", "255", "c", "16", "d", "d", 1.0, 3, 4, 2, 2, 2)]
    written = results.result_rows(spark.createDataFrame(rows, SCHEMA))
    got = {(r.type, r.line, r.address, r.address2, r.ratio) for r in written.collect()}
    assert got == {("partial", "00000", "100000000", "00000010", "0.1234568"), ("best", "00000", "000000ff", "00000010", "1.0000000")}
    assert {(r.ea1, r.ea2, r.ratio) for r in results.read_results(written).collect()} == {("4294967296", "16", 0.1234568), ("255", "16", 1.0)}


def test_bounds_leave_what_the_rules_need(spark):
    """Categories that ratios do not follow, names of several addresses, pairs that come again: the same as item by item."""
    for seed in range(6):
        rng = random.Random(100 + seed)
        items = []
        for seq in range(60):
            a, b = rng.randint(1, 4), rng.randint(1, 4)
            items.append((rng.choice(state.CATEGORIES), str(a), f"n{a % 3}" if seed % 2 else f"n{a}", str(b), rng.choice([f"m{b}", f"n{a}"]), f"d{seq}", rng.choice([0.5, 0.7, 0.8, 1.0]), 1, 1, a, b, seq))
        df = spark.createDataFrame(items, SCHEMA)
        assert sorted(map(tuple, state.cleanup(df).select(*state.MATCH).collect())) == sorted(_cleanup(items))
        assert sorted(map(tuple, state.final_pass(df).collect())) == sorted(_final(items))


def test_what_the_first_leaves_behind_goes_before_the_windows(spark):
    rows = [("best", "1", "n1", "0", "m0", "d", 1.0, 1, 1, 1, 0, 0)] + [("partial", "1", "n1", str(k), f"m{k}", "d", 0.6, 1, 1, 1, k, k) for k in range(1, 60)]
    df = spark.createDataFrame(rows, SCHEMA)
    for found in (state.cleanup(df), state.final_pass(df)):
        read = [p for p in found.inputFiles()]
        assert read and spark.read.parquet(*read).count() == 1 == found.count()


def test_only_what_may_be_applied_is_written(spark, monkeypatch):
    """Of 60 proposals of an address one can be applied; equal places count one by one, and joins are dealt over all tasks."""
    tables, kept = [], port.materialize
    monkeypatch.setattr(port, "materialize", lambda df, *a: tables.append(kept(df, *a)) or tables[-1])
    side = lambda letter: spark.createDataFrame([(str(k), f"{letter}{k}", f"{letter}{k}") for k in range(62)], "address string, name string, mangled_function string")
    target = side("sub_").withColumn("mangled_function", F.col("name"))
    rows = [("partial", str(k), "7", 0.9, "d", (k, k)) for k in range(60)] + [("partial", "61", "8", 0.8, "d", (3, 3)), ("partial", "60", "8", 0.8, "d", (3, 3)), ("unreliable", "5", "8", 0.4, "d", (0, 0))]
    proposals = spark.createDataFrame(rows, "category string, ea1 string, ea2 string, ratio double, description string, place struct<seq: long, id: long>")
    got = port.decide(proposals, side("f"), target)
    assert sorted((r.ea1, r.ea2) for r in got.where("action = 'applied'").collect()) == [("0", "7"), ("60", "8")]
    assert {r.action: r.n for r in port.action_counts(got).collect()} == {"applied": 2, "skipped_conflict": 60, "not_selected": 1}
    assert max(t.count() for t in tables) == 3


def _written(rows):
    """Result rows item by item."""
    lines, found = {}, {}
    for r in sorted(rows, key=lambda r: (results.WRITTEN.index(r[0]), -r[6], r[11], r[9], r[10])):
        line = lines[r[0]] = lines.get(r[0], -1) + 1
        found.setdefault((r[1], r[3]), (r[0], f"{line:05d}", f"{int(r[1]):08x}", r[2], f"{int(r[3]):08x}", r[4], f"{r[6]:.7f}", str(r[7]), str(r[8]), r[5]))
    return sorted(found.values())


def test_results_go_over_shuffles_as_numbers(spark, monkeypatch):
    """Functions of one address with two names, pairs that come again: the same as item by item; tables of all matches hold no texts."""
    tables, kept = [], results.materialize
    monkeypatch.setattr(results, "materialize", lambda df, *a, **b: tables.append(kept(df, *a, **b)) or tables[-1])
    for names in (1, 2):
        rng, rows = random.Random(names), []
        for seq in range(400):
            a, b = rng.randint(1, 8), rng.randint(1, 8)
            rows.append((rng.choice(results.WRITTEN), str(a), f"n{a}_{seq % names}", str(b), f"m{b}", f"d{seq % 3}", rng.choice([0.5, 0.7, 1 / 3, 1.0]), a, b, a, b, seq))
        tables.clear()
        assert sorted(map(tuple, results.result_rows(spark.createDataFrame(rows, SCHEMA)).collect())) == _written(rows)
        large = [t for t in tables if t.count() == len(rows)]
        assert large and not any(kind == "string" for t in large for _, kind in t.dtypes)


def test_results_are_compared_by_numbers(spark, monkeypatch):
    """Rows that come again, nulls: the same as item by item; no texts are dealt by the keys of both results."""
    dealt, kept = [], evaluate.apart
    monkeypatch.setattr(evaluate, "apart", lambda rows, *keys: dealt.append(rows) or kept(rows, *keys))
    rng = random.Random(5)
    sides = [[(rng.choice("ab"), rng.choice("de"), rng.choice(["1", "2", None]), rng.choice(["3", "4", None]), rng.choice(["0.5", "0.7"])) for _ in range(60)] for _ in range(2)]
    a, b = (spark.createDataFrame(s, "type string, description string, address string, address2 string, ratio string") for s in sides)
    x, y = (Counter(r[2:] for r in s) for s in sides)
    for numbers in (True, False):
        assert tuple(evaluate.same_rows(a, b, ["address", "address2", "ratio"], numbers).first()) == ((x - y).total(), (y - x).total())
    assert tuple(evaluate.same_rows(a, a.limit(0), ["address"], True).first()) == (60, 0) and tuple(evaluate.same_rows(a.limit(0), a.limit(0), ["address"]).first()) == (0, 0)
    least = [{}, {}]
    for s, found in zip(sides, least):
        for t, d, *key, ratio in s:
            found[tuple(key)] = min(found.get(tuple(key), ("z",)), (t, d, ratio))
    lone = lambda k: None in k
    wanted = Counter()
    for key in {*least[0], *least[1]}:
        p, q = (s.get(key) for s in least)
        for p_, q_ in [(p, None), (None, q)] if lone(key) else [(p, q)]:
            if p_ or q_:
                k = (p_ or q_)[:2]
                wanted.update({(*k, "both"): bool(p_ and q_), (*k, "same_ratio"): bool(p_ and q_ and p_[2] == q_[2]), (*k, "only_a"): not q_, (*k, "only_b"): not p_})
    got = evaluate.agreement(a, b).collect()
    assert {(r.type, r.description, c): r[c] for r in got for c in ("both", "same_ratio", "only_a", "only_b")} == wanted
    assert len(dealt) == 3 and not any(kind == "string" for rows in dealt for _, kind in rows.dtypes)
