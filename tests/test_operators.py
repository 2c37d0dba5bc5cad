"""Passes, ports, graphs, text differences, sources and a whole diff on small catalogs."""

import difflib
import itertools
import random
import re
import sqlite3

import pytest
from catalogs import catalog
from conftest import SMALL

from pairloom.functions import textdiff
from pairloom.functions.names import glob_matches
from pairloom.operators import evaluate, graph, port, results, stages
from pairloom.operators.candidates import candidates, united
from pairloom.plans import diff as plan
from pairloom.plans.registry import HEURISTICS, LONG_TEXTS, running
from pairloom.schema import FUNCTIONS, SIDE_TABLES, check_version, validate
from pairloom.sources import catalogs as stored
from pairloom.sources.adapters import pair
from pairloom.sources.catalogs import Catalog, Pair
from pairloom.sources.sqlite import read_sqlite


def test_registry():
    assert [h.number for h in HEURISTICS] == list(range(50))
    assert [h.number for h in running("best")] == list(range(11, -1, -1))
    assert [h.number for h in running("partial")] == [41, 40, 39, *range(35, 11, -1)]
    assert not {h.number for h in running("best", same_processor=False)} & {0, 1, 2, 3, 5, 6, 9}


def test_long_texts_are_never_shuffled(spark):
    found = pair(spark, SMALL)
    for h in HEURISTICS:
        plan = candidates(found, h)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        made = set(re.findall(r"AS (\w+#\d+)", plan))
        for node in re.split(r"\n\n+\(\d+\) ", plan):
            if node.startswith("Exchange"):
                texts = {c for c in re.findall(r"(?:\[|, )(\w+#\d+)", node.split("\n")[1]) if c.split("#")[0] in LONG_TEXTS}
                assert texts <= made, (h.name, texts - made)


def test_replaced_names():
    a, b = "x\ncall old_one\ny\nz", "x\ncall new_one\ny\nz"
    assert textdiff.replaced_names(a, b) == [("call", "call"), ("old_one", "new_one")]
    assert textdiff.replaced_names(a, a) == []
    assert textdiff.replaced_names("call old_one", "call new_one") == []  # nothing follows the change
    assert textdiff.identifiers("0x401000 a::b ns::name::x abc") == ["x401000", "ns::name::x"] or textdiff.identifiers("name::x") == ["name::x"]


def test_unified_is_the_standard_library(spark):
    a, b = "one\r\ntwo\x0bthree", "one\ntwo\nfour"
    assert textdiff.unified(a, b) == list(difflib.unified_diff(a.splitlines(), b.splitlines(), lineterm=""))


def test_interesting():
    assert textdiff.swapped_jump("cmp a\njl x\nret", "cmp a\njb x\nret")
    assert not textdiff.swapped_jump("cmp a\njl x\nret", "cmp a\njmp x\nret")
    assert textdiff.risky_change("a;\nb;", "a;\n  strcpy(x);\nb;")
    assert textdiff.risky_change("a;\nb;", "a;\n  if ( n > 4 )\nb;") and not textdiff.risky_change("a;\nb;", "a;\n  c;\nb;")


def test_interesting_pairs_against_the_matcher(spark, monkeypatch):
    """Every pair as the unified diff of its texts says; pairs without a common line are decided without a comparison."""
    rng, given = random.Random(11), []
    lines = ["jl x", "JB x", "jge y", "jae y", "bls z", "bl z", "b", "bs", "nop", "nop:", "jl x:", "", "mov", " strcpy(x);", "if ( n > 4 )", " if ( n > 0 )", " if ( n > 4 )", "xmem", "memx", "a;"]
    text = lambda own: rng.choice([None, "", *["\n".join(rng.choice(own) for _ in range(rng.randint(1, 6)))] * 6])
    one, two = ([{"name": f"f{k}", "assembly": text(lines), "pseudocode": text(lines)} for k in range(45)] for _ in (1, 2))
    cases = [(a, b) for a in one for b in two]
    matches = spark.createDataFrame([(a, b, r) for a in range(1, 46) for b in range(1, 46) for r in (0.5, 0.6)] + [(46, 1, 1.0)], "id1 long, id2 long, ratio double")
    got = {(r.id1, r.id2): r.interesting for r in stages.interesting_changes(Pair(catalog(spark, one), catalog(spark, two)), matches).collect()}
    wanted = [textdiff.swapped_jump(a["assembly"], b["assembly"]) or textdiff.risky_change(a["pseudocode"], b["pseudocode"]) for a, b in cases]
    assert len(got) == len(cases) and [got[k] for k in sorted(got)] == wanted and 100 < sum(wanted) < len(wanted) - 100
    for a, b in cases:
        marks = lambda t, of: ([hash(x) for x in t.split("\n")], [of(x) for x in t.split("\n")])
        if None not in (a["assembly"], b["assembly"]):
            assert textdiff.swapped_marks(*[marks(x["assembly"], textdiff.jump_marks) for x in (a, b)]) == textdiff.swapped_jump(a["assembly"], b["assembly"])
        if None not in (a["pseudocode"], b["pseudocode"]):
            assert textdiff.risky_marks(*[marks(x["pseudocode"], textdiff.risk_marks) for x in (a, b)]) == textdiff.risky_change(a["pseudocode"], b["pseudocode"])
    apart = [[{"name": f"f{k}", "assembly": f"jl x{k}\n{s} jb {k}\nbs{k} {s}", "pseudocode": f"{s} {k}"} for k in range(6)] for s in "mn"]
    monkeypatch.setattr(stages, "arrow_map", lambda df, run, schema, f=stages.arrow_map: (given.append(df.count()) if run is stages._interesting else None, f(df, run, schema))[1])
    rows = stages.interesting_changes(Pair(*[catalog(spark, s) for s in apart]), spark.createDataFrame([(a, b, 0.5) for a in range(1, 7) for b in range(1, 7)], "id1 long, id2 long, ratio double")).collect()
    assert given == [0] and len(rows) == 36


def test_graph_features_against_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(1, 7)
        blocks = list(range(n))
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, 10))]
        reach = {(a, b) for a, b in pairs} | {(a, a) for a in blocks}
        for k, i, j in itertools.product(blocks, repeat=3):
            if (i, k) in reach and (k, j) in reach:
                reach.add((i, j))
        strong = {frozenset(b for b in blocks if (a, b) in reach and (b, a) in reach) for a in blocks}
        got = graph.features(blocks, pairs)
        assert got["strong"] == len(strong)
        assert got["loops"] == sum(len(c) > 1 or (min(c), min(c)) in pairs for c in strong)
        assert got["edges"] == len(set(pairs))
        assert got["complexity"] == max(1, len(set(pairs)) - n + 2 * got["weak"])
    assert graph.prime_product({0: 3, 1: 1, 3: 2}) == 8 * 3 * 49
    assert graph.leaders([(0, None, False), (1, 4, True), (2, None, False), (4, 99, True)]) == [0, 2, 4]


def _reached(listing):
    """Blocks by brute force: all starts that a walk over single instructions finds, then cut at starts."""
    by = {at: (size, role, target) for at, size, role, target in listing}
    seen, starts, todo = set(), {min(by)}, [min(by)]
    while todo:
        at = todo.pop()
        if at in seen or at not in by:
            continue
        seen.add(at)
        size, role, target = by[at]
        if role in ("branch", "conditional") and target in by:
            starts.add(target)
            todo.append(target)
        if role == "conditional" and at + size in by:
            starts.add(at + size)
        if role not in graph.STOPS or role == "conditional":
            todo.append(at + size)
    out = {}
    for start in sorted(starts):
        at, n = start, 0
        while True:
            size, role, target = by[at]
            n, at = n + 1, at + size
            if role in graph.STOPS or at in starts or at not in by:
                break
        to = ([target] if role in ("branch", "conditional") else []) + ([at] if role == "conditional" or role not in graph.STOPS else [])
        out[start] = (n, at - start, [x for k, x in enumerate(to) if x in starts and x not in to[:k]])
    return out


def test_basic_blocks_against_brute_force(spark):
    rng = random.Random(9)
    rows, wanted = [], {}
    for func in range(80):
        at, listing = 0, []
        for _ in range(rng.randint(1, 15)):
            size = rng.randint(1, 3)
            listing.append((at, size, rng.choice(["normal", "normal", "call", "branch", "conditional", "return", "invalid"]), rng.choice([None, rng.randint(0, 30)])))
            at += size
        wanted[func] = _reached(listing)
        rows += [(func, *x) for x in listing]
    got = {}
    for r in graph.basic_blocks(spark.createDataFrame(rows, "func_id long, offset long, size long, role string, target long")).orderBy("func_id", "block").collect():
        got.setdefault(r.func_id, []).append(r)
    for func, blocks in got.items():
        starts = [b.start for b in blocks]
        assert {b.start: (b["count"], b["size"], [starts[k] for k in b.successors]) for b in blocks} == wanted[func]
        assert all(b.predecessors == [k for k, a in enumerate(blocks) if b.block in a.successors] for b in blocks)
    assert set(got) == set(wanted) and graph.partition([]) == []


def test_basic_blocks_take_one_function_at_a_time(spark):
    """Functions of a task are not gathered as rows of a batch, which would hold all their instructions at once."""
    rows = [(func, at, 1, ("normal", "conditional", "return")[at % 3], at * 7 % 50) for func in (1, None) for at in range(50)]
    found = graph.basic_blocks(spark.createDataFrame(rows[::-1], "func_id long, offset long, size long, role string, target long"))
    plan_ = found._jdf.queryExecution().toString()
    assert "collect_list" not in plan_ and "FlatMapGroupsInArrow" in plan_
    wanted = graph.partition([x[1:] for x in rows[:50]])
    for func in (1, None):
        got = found.where(found.func_id.eqNullSafe(func)).orderBy("block").collect()
        assert [{k: r[k] for k in wanted[0]} for r in got] == wanted


def test_traces_and_steps(spark, tmp_path):
    pair_ = Pair(catalog(spark, _functions(8)), catalog(spark, _functions(8, 8, "sub")))
    runs = [plan.Diff(pair_, plan.Settings(rounds=1, trace="step-00[|step-*"), f"{tmp_path}/{x}") for x in "ab"]
    outcomes = [r.run() for r in runs]
    traces = [spark.read.parquet(f"{tmp_path}/{x}/trace/step-00*") for x in "ab"]
    assert traces[0].count() and evaluate.compare_traces(*traces).count() == 0
    assert evaluate.compare_traces(traces[0], traces[1].where("decision = 'accepted'")).count() == traces[0].where("decision <> 'accepted'").count()
    again = plan.Diff(pair_, plan.Settings(rounds=1, trace="step-00[|step-*"), f"{tmp_path}/a").at(2)
    assert again.next_seq == 2 and again.matches.count() == spark.read.parquet(f"{tmp_path}/a/step-001").count()
    with pytest.raises(ValueError, match="not there"):
        again.at(99)
    results.write_json(outcomes[0].results(), f"{tmp_path}/json")
    schema = ", ".join(f"{c} {t}" for c, t in outcomes[0].results().dtypes)
    assert evaluate.same_rows(results.read_json(spark, f"{tmp_path}/json", schema), outcomes[0].results(), outcomes[0].results().columns).first() == (0, 0)
    assert glob_matches("before:cleanup", "x|before:*") and glob_matches("a.c", "a?c") and not glob_matches("abc", "a.c|ab") and not glob_matches("step-000", "")


def test_gaps_follow_consecutive_matches(spark):
    rng = random.Random(1)
    ends = sorted(rng.sample(range(10, 3000), 200))
    rows = [("best", str(e), str(e + 5)) for e in ends]
    got = {(r.a1, r.b1, r.a2, r.b2) for r in stages.gaps(spark.createDataFrame(rows, "category string, ea1 string, ea2 string")).collect()}
    assert got == {(str(a), str(b), str(a + 5), str(b + 5)) for a, b in itertools.pairwise(ends)}


def _functions(n, shift=0, names="fn"):
    out = []
    for k in range(n):
        lines = [f"op{k} r{j}" for j in range(12)] + ["ret"]
        out.append({"name": f"{names}_{k}", "address": str(4096 + 16 * k + shift), "nodes": 5, "edges": 6, "instructions": 13, "pseudocode_lines": 13, "clean_assembly": "\n".join(lines), "assembly": "\n".join(lines) + f" ; {names}", "bytes_hash": f"b{k}" if k % 3 else f"b{k}{names}", "function_hash": f"f{k}", "cyclomatic_complexity": 3})
    return out


def test_diff_and_update(spark):
    main = catalog(spark, _functions(12))
    other = catalog(spark, _functions(12, 8, "sub"))
    outcome, decisions, labelled = plan.update(Pair(main, other), settings=plan.Settings(rounds=2))
    assert outcome.mode == "normal"
    got = {(r.id1, r.id2) for r in outcome.matches.collect()}
    assert got == {(k, k) for k in range(1, 13)}
    assert {r.action for r in decisions.collect()} == {"applied"}
    assert sorted(r.name for r in labelled.collect()) == sorted(f"fn_{k}" for k in range(12))
    assert outcome.unmatched().count() == 0
    scores = evaluate.label_scores(evaluate.ground_truth(catalog(spark, _functions(12, 8)).functions, other.functions), labelled).first()
    assert (scores.correct, scores.wrong, scores.missed) == (12, 0, 0)


def test_diff_of_stripped_and_patched(spark):
    same = plan.diff(Pair(catalog(spark, _functions(6)), catalog(spark, _functions(6, 0, "sub"))), plan.Settings(rounds=1))
    assert same.mode == "stripped" and same.matches.count() == 6
    patched = _functions(12, 8)
    patched[11] |= {"name": "sub_new", "mangled_function": "sub_new"}
    main = _functions(12)
    main[11] |= {"name": "sub_old"}
    outcome = plan.diff(Pair(catalog(spark, main), catalog(spark, patched)), plan.Settings(rounds=1))
    assert outcome.mode == "patch"
    assert ("sub_old", "sub_new") in {(r.name1, r.name2) for r in outcome.matches.collect()}


def test_empty_catalogs(spark):
    assert plan.diff(Pair(catalog(spark, []), catalog(spark, _functions(2))), plan.Settings(rounds=1)).matches.count() == 0


def test_port_rules(spark):
    ref = [("1", "good", "good"), ("2", "sub_2", "sub_2"), ("3", "old", "old"), ("4", "twin", "_Z4twin"), ("5", "far", "far")]
    tgt = [("11", "sub_11", "sub_11"), ("12", "sub_12", "sub_12"), ("13", "old", "old"), ("14", "sub_14", "sub_14"), ("15", "twin", "twin"), ("16", "kept", "kept")]
    schema = "address string, name string, mangled_function string"
    p = [("best", "1", "11", 0.9, 1), ("best", "1", "11", 0.8, 2), ("best", "2", "12", 1.0, 3), ("best", "3", "13", 1.0, 4), ("partial", "4", "14", 0.9, 5), ("multimatch", "4", "12", 0.9, 6), ("best", "1", "16", 0.9, 7), ("best", "5", "12", 0.9, 8)]
    proposals = spark.createDataFrame([(c, a, b, r, "d", k) for c, a, b, r, k in p], "category string, ea1 string, ea2 string, ratio double, description string, place long")
    rows = port.decide(proposals, spark.createDataFrame(ref, schema), spark.createDataFrame(tgt, schema)).orderBy("place").collect()
    assert [r.action for r in rows] == ["applied", "skipped_conflict", "skipped_not_portable", "confirmed", "skipped_duplicate_name", "not_selected", "skipped_existing", "skipped_conflict"]
    origins = spark.createDataFrame([("1", "good", "0", "first", 2, 0.5)], "address string, name string, origin_address string, origin_name string, hops long, cumulative_ratio double")
    one = proposals.where("place = 1")
    got = port.decide(one, spark.createDataFrame(ref, schema), spark.createDataFrame(tgt, schema), origins).first()
    assert (got.action, got.hops, got.confidence, got.origin_name) == ("applied", 3, 0.45, "first")
    assert port.decide(one, spark.createDataFrame(ref, schema), spark.createDataFrame(tgt, schema), origins, port.Options(max_hops=2)).first().action == "skipped_hops"
    assert port.decide(one, spark.createDataFrame(ref, schema), spark.createDataFrame(tgt, schema), origins, port.Options(min_confidence=0.5)).first().action == "skipped_ratio"


def test_sqlite_and_parquet(spark, tmp_path):
    path = str(tmp_path / "a.sqlite")
    with sqlite3.connect(path) as c:
        c.execute(f"CREATE TABLE functions ({', '.join(f.name + {'bigint': ' INTEGER', 'double': ' REAL'}.get(f.dataType.simpleString(), ' TEXT') for f in FUNCTIONS)})")
        given = catalog(spark, _functions(5))
        for r in given.functions.collect():
            c.execute(f"INSERT INTO functions VALUES ({', '.join('?' * len(FUNCTIONS))})", tuple(r))
        c.execute("CREATE TABLE version (value TEXT)")
        c.execute("INSERT INTO version VALUES ('3.4')")
    read = read_sqlite(spark, path, 3)
    assert validate(read.functions) == []
    assert evaluate.same_rows(read.functions, given.functions, FUNCTIONS.names).first() == (0, 0)
    assert read.table("version").first()[0] == "3.4" and read.table("constants").count() == 0
    stored.write_catalog(read, str(tmp_path / "p"), 2)
    again = stored.read_catalog(spark, str(tmp_path / "p"))
    assert evaluate.same_rows(again.functions, given.functions, FUNCTIONS.names).first() == (0, 0)
    with sqlite3.connect(path) as c:
        c.execute("UPDATE functions SET name = 5 WHERE id = 1")
        c.execute("CREATE TABLE odd (id INTEGER, name)")
    twice = given.functions.union(given.functions)
    assert validate(twice) == ["5 addresses repeat"]
    assert "column name is missing" in validate(given.functions.drop("name"))
    with pytest.raises(Exception, match="is not bigint"):
        with sqlite3.connect(path) as c:
            c.execute("UPDATE functions SET nodes = 'many' WHERE id = 2")
        read_sqlite(spark, path).functions.collect()
    assert set(SIDE_TABLES) >= {"program", "constants"}


def test_same_name_leaves_null_subs_of_any_case(spark):
    names = [{"name": n} for n in ("nullsubX", "NULLSUB_2", "nullsub", "good", "sub_1")]
    got = {r.name1 for r in stages.same_name(Pair(catalog(spark, names), catalog(spark, names))).collect()}
    assert got == {"nullsub", "good"}


def test_callee_pairs_that_are_matched_are_not_proposed(spark):
    def side(name):
        return [{"name": f"caller_{name}", "nodes": 5, "assembly": f"a\ncall callee_{name}\nb"}, {"name": f"callee_{name}", "nodes": 5}]

    pair = Pair(catalog(spark, side("one")), catalog(spark, side("two")))
    matched = spark.createDataFrame([(1, 1, "caller_one", "caller_two")], "id1 long, id2 long, name1 string, name2 string")
    assert [(r.name1, r.name2) for r in stages.callee_matches(pair, matched, "assembly").collect()] == [("callee_one", "callee_two")]
    both = matched.union(spark.createDataFrame([(2, 2, "callee_one", "callee_two")], matched.schema))
    assert stages.callee_matches(pair, both, "assembly").count() == 0


def test_callees_of_short_texts_need_no_matcher(spark, monkeypatch):
    """Against the matcher on every pair of texts; pairs that differ in one of a few lines never reach it."""
    rng, compared = random.Random(5), []
    names = [f"callee_{k}" for k in range(12)] + ["nullsub_1", "twice", "twice"]

    def side(lines):
        text = lambda: "\n".join(rng.choice(lines).replace("?", rng.choice(names)) for _ in range(rng.randint(1, 5))) + rng.choice(["", "\n"])
        return [{"name": n, "nodes": rng.choice([2, 4, 9, 40]), "assembly": rng.choice([None, "", text(), text(), text()])} for n in names]

    def wanted(one, two, ids, matched):
        found = {p for a, b in ids for x, y in [(one[a - 1]["assembly"], two[b - 1]["assembly"])] if None not in (x, y) and x != y for p in textdiff.replaced_names(x, y)}
        nodes = [{f["name"]: f["nodes"] for f in s if not f["name"].startswith(("nullsub", "twice"))} for s in (one, two)]
        sized = lambda p: p[0] in nodes[0] and p[1] in nodes[1] and (low := min(n[x] for n, x in zip(nodes, p))) >= 3 and low * 4 >= max(n[x] for n, x in zip(nodes, p))
        return sorted(p for p in found - matched if sized(p))

    ids = list(itertools.product(range(1, 16), repeat=2))
    for lines in (["call ?", "push", "ret", "call ?, ?"], ["call ?"]):
        one, two = side(lines), side(lines)
        matches = spark.createDataFrame([(a, b, names[a - 1], names[b - 1]) for a, b in ids if (a + b) % 3], "id1 long, id2 long, name1 string, name2 string")
        matched = {(r.name1, r.name2) for r in matches.collect()}
        for few in (True, False):
            rows = stages.callee_matches(Pair(catalog(spark, one), catalog(spark, two)), matches, "assembly", few).collect()
            assert sorted((r.name1, r.name2) for r in rows) == wanted(one, two, [(r.id1, r.id2) for r in matches.collect()], matched)
    short = lambda n: [{"name": f"callee_{n}{k}", "nodes": 4, "assembly": f"push\ncall callee_{n}{k}\nret"} for k in range(4)]
    monkeypatch.setattr(stages, "_by_matcher", lambda *a: compared.append(a))
    every = spark.createDataFrame([(a, b, "", "") for a in range(1, 5) for b in range(1, 5)], "id1 long, id2 long, name1 string, name2 string")
    assert stages.callee_matches(Pair(catalog(spark, short("a")), catalog(spark, short("b"))), every, "assembly").count() == 16 and not compared


def test_arriving_catalogs(spark, tmp_path):
    from pairloom.streaming.arrivals import follow

    stored.write_catalog(catalog(spark, _functions(8)), f"{tmp_path}/v0")
    stored.write_catalog(catalog(spark, _functions(8, 8, "sub")), f"{tmp_path}/v1")
    spark.createDataFrame([(f"{tmp_path}/v1",)], "path string").write.parquet(f"{tmp_path}/arrivals")
    paths = spark.readStream.schema("path string").parquet(f"{tmp_path}/arrivals")
    follow(paths, f"{tmp_path}/v0", f"{tmp_path}/out", f"{tmp_path}/check", plan.Settings(rounds=1)).awaitTermination(240)
    got = {r.name for r in spark.read.parquet(f"{tmp_path}/out/0-0/functions").collect()}
    assert got == {f"fn_{k}" for k in range(8)}


def test_commands_and_resuming(spark, tmp_path, capsys):
    from pairloom.__main__ import run

    stored.write_catalog(catalog(spark, _functions(8)), f"{tmp_path}/v0")
    stored.write_catalog(catalog(spark, _functions(8, 8, "sub")), f"{tmp_path}/v1")
    assert run(spark, ["version"]) == 0 and capsys.readouterr().out == "0.1\n"
    given = ["diff", f"{tmp_path}/v0", f"{tmp_path}/v1", "--resume", f"{tmp_path}/steps"]
    assert run(spark, [*given, "-o", f"{tmp_path}/a"]) == 0
    assert run(spark, [*given, "-o", f"{tmp_path}/b"]) == 0  # every pass is read from the first run's
    a, b = (spark.read.parquet(f"{tmp_path}/{x}/results") for x in "ab")
    assert a.count() == 8 and evaluate.same_rows(a, b, a.columns).first() == (0, 0)
    assert run(spark, ["port", f"{tmp_path}/v0", f"{tmp_path}/v1", "--results", f"{tmp_path}/a/results", "-o", f"{tmp_path}/p"]) == 0
    assert {r.name for r in spark.read.parquet(f"{tmp_path}/p/labelled/functions").collect()} == {f"fn_{k}" for k in range(8)}
    assert run(spark, ["info", f"{tmp_path}/p/labelled"]) == 0


def test_names_over_three_versions(spark, tmp_path):
    """Names carried twice have two hops and multiplied confidences, and the lineage of both."""
    from pairloom.__main__ import run

    def version(n, shift, names):
        functions = _functions(8, shift, names)
        for f in functions:
            f["bytes_hash"] = f"{n}{f['bytes_hash']}"  # near, not equal
        stored.write_catalog(catalog(spark, functions), f"{tmp_path}/v{n}")

    version(0, 0, "fn")
    version(1, 8, "sub")
    version(2, 16, "sub")
    assert run(spark, ["update", f"{tmp_path}/v0", f"{tmp_path}/v1", "-o", f"{tmp_path}/a"]) == 0
    assert run(spark, ["update", f"{tmp_path}/a/labelled", f"{tmp_path}/v2", "-o", f"{tmp_path}/b"]) == 0
    first, second = (stored.read_catalog(spark, f"{tmp_path}/{x}/labelled") for x in "ab")
    one = {r.name: r for r in first.table("name_origin").collect()}
    two = {r.name: r for r in second.table("name_origin").collect()}
    assert two and set(two) <= set(one)
    ratio = {r.reference_name: r.ratio for r in second.table("port_log").where("action = 'applied'").collect()}
    for name, r in two.items():
        assert (r.hops, one[name].hops) == (2, 1) and r.origin_address == one[name].origin_address and r.first_labelled_at == one[name].first_labelled_at
        assert abs(r.cumulative_ratio - one[name].cumulative_ratio * ratio[name]) < 1e-12
    rows = second.table("provenance").orderBy("hop").collect()
    assert [r.hop for r in rows] == [1, 2] and rows[1].lineage.count(" -> ") == 2 and rows[1].applied == len(two)
    assert run(spark, ["update", f"{tmp_path}/v0", f"{tmp_path}/v1", "-o", f"{tmp_path}/a"]) == 2  # never over what is there
    assert run(spark, ["diff", f"{tmp_path}/v0"]) == 2 and run(spark, ["info", f"{tmp_path}/nowhere"]) == 6
    assert run(spark, ["port", f"{tmp_path}/v0", f"{tmp_path}/v2", "--results", f"{tmp_path}/a/results", "-o", f"{tmp_path}/c"]) == 4
    assert not (tmp_path / "c").exists() and not [*tmp_path.glob("c.unfinished*")]


def test_steps_of_other_catalogs_and_versions(spark, tmp_path):
    a, b = catalog(spark, _functions(6)), catalog(spark, _functions(6, 6))
    plan.diff(Pair(a, b), plan.Settings(rounds=1), f"{tmp_path}/steps")
    with pytest.raises(ValueError, match="other catalogs"):
        plan.diff(Pair(a, catalog(spark, _functions(5, 6))), plan.Settings(rounds=1), f"{tmp_path}/steps")
    with pytest.raises(ValueError, match="other catalogs"):
        plan.diff(Pair(a, b), plan.Settings(rounds=2), f"{tmp_path}/steps")
    versions = lambda *v: spark.createDataFrame([(x,) for x in v], "value string")
    assert check_version(versions("3.4")) == [] and "2.0" in check_version(versions("2.0"))[0]
    with pytest.raises(ValueError, match="no version"):
        check_version(versions())


def test_rounds_go_on_until_nothing_is_added(spark, monkeypatch):
    """A chain of callees 14 deep: each round of passes finds one more."""
    asked = []

    class Stepping(plan.Diff):
        def passes(self, found, bonus=False):
            self.matches = spark.createDataFrame([], "id1 long, id2 long, name1 string, name2 string, category string, ratio double")

        def heuristics(self, category):
            pass

        def total(self):
            asked.append(min(len(asked), 14))
            return asked[-1]

    for name in ("callee_matches", "related_constants", "related_units", "local_affinity", "seeds"):
        monkeypatch.setattr(plan.stages, name, lambda *_: None)
    monkeypatch.setattr(plan, "materialize", lambda df: df)
    monkeypatch.setattr(plan, "line_numbers", lambda s: s)
    monkeypatch.setattr(plan, "final_pass", lambda m: m)
    monkeypatch.setattr(plan, "unmatched", lambda *_: None)
    pair = Pair(catalog(spark, _functions(3)), catalog(spark, _functions(3)))
    Stepping(pair).run()
    assert asked == [*range(15), 14]
    asked.clear()
    Stepping(pair, plan.Settings(rounds=3)).run()
    assert asked == [0, 1, 2]


def test_pairs_are_not_made_distinct_twice(spark):
    """Where ids differ a join gives a pair once, so no pair is shuffled; where they do not, rows are still distinct."""
    own = pair(spark, SMALL)
    heuristics = [HEURISTICS[n] for n in (3, 25, 32, 27)]
    found = united(own, heuristics)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == found.distinct().count() > 0
    twice = Pair(Catalog(own.main.functions.unionByName(own.main.functions), own.main.tables), own.diff)
    assert sorted(map(tuple, united(twice, heuristics).collect())) == sorted(map(tuple, found.collect()))


def test_related_units_link_classes_before_functions_meet(spark):
    """Pairs of functions are not made distinct; overlapping ranges give a pair once."""
    units = [(1, "", 3, "", "", "4096", "4128"), (2, "", 3, "", "", "4112", "4144")]
    links = [(k, 1 + (k > 2), k) for k in range(1, 5)]
    own = lambda: catalog(spark, _functions(4), compilation_units=units, compilation_unit_functions=links)
    found = stages.related_units(Pair(own(), own()), spark.createDataFrame([(1, 1), (3, 3)], "id1 long, id2 long"))
    plan_ = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan_.index("Generate") < plan_.index("Aggregate")
    inside = [{1, 2, 3}, {2, 3, 4}]
    assert sorted((r.id1, r.id2) for r in found.collect()) == sorted({(a, b) for s in inside for a in s for b in s})


def test_functions_of_gaps_are_counted_by_places(spark):
    rng = random.Random(3)
    functions = [{"name": f"sub_{k}", "address": str(rng.randrange(3000))} for k in range(150)]
    ends = [(g, str(rng.randrange(3000)), rng.choice([str(rng.randrange(3000)), functions[g]["address"]])) for g in range(60)]
    few, places = stages._between(catalog(spark, functions), spark.createDataFrame(ends, "gap long, a1 string, b1 string"), 1, 20)
    at = {r.place: r.id1 for r in places.collect()}
    assert sorted(at) == list(range(1, 151))
    wanted = {g: sorted(k + 1 for k, f in enumerate(functions) if a < f["address"] < b) for g, a, b in ends}
    assert {r.gap: sorted(at[k] for k in range(r.first1, r.last1 + 1)) for r in few.collect()} == {g: x for g, x in wanted.items() if 0 < len(x) <= 20}
