import random

import numpy as np
from conftest import SMALL
from twin import same

from pairloom.llm import line_dedup
from pairloom.llm.queries import QUERIES, SQL

SPACES = " \t\n\x0b\x0c\r"


def test_edge_cases(spark):
    run = "\n".join(f"line {k} with some words in it" for k in range(8))
    rows = [(1, run), (2, f"before\n{run}\nafter"), (3, None), (4, ""), (1, run), (None, run), (5, "short\nshort")]
    docs = spark.createDataFrame([(d, t, "v", 3) for d, t in rows], "doc_id long, text string, version string, removed_runs int")
    got = [(r.doc_id, r.text, r.version) for r in line_dedup.dedup_lines(docs).collect()]
    assert sorted(got, key=str) == sorted([(None, run, "v"), (1, "", "v"), (1, "", "v"), (2, "before\nafter", "v"), (3, None, "v"), (4, "", "v"), (5, "short\nshort", "v")], key=str)
    assert line_dedup.dedup_lines(docs.where("false")).count() == 0


def test_query(spark):
    same(spark, QUERIES["op1_line_dedup"], SQL["op1_line_dedup"], SMALL)


def _runs(docs, least):
    """Deletes every line of a run that occurs earlier, by following each diagonal as far as lines are equal."""
    solid = [(d, [(k, x.strip(SPACES)) for k, x in enumerate(t.split("\n")) if x.strip(SPACES)]) for d, t in sorted(docs.items())]
    gone = {d: set() for d in docs}
    for n, (d, own) in enumerate(solid):
        for e, other in solid[: n + 1]:
            for i in range(len(own)):
                for j in range(i if e == d else len(other)):
                    if i and j and own[i - 1][1] == other[j - 1][1]:
                        continue
                    length = 0
                    while i + length < len(own) and j + length < len(other) and own[i + length][1] == other[j + length][1]:
                        length += 1
                    if sum(len(x.split()) for _, x in own[i : i + length]) >= least:
                        gone[d] |= {k for k, _ in own[i : i + length]}
    out = {}
    for d, t in docs.items():
        lines = t.split("\n")
        for k, x in enumerate(lines):
            if k - 1 in gone[d] and not x.strip(SPACES):
                gone[d].add(k)
        out[d] = "\n".join(x for k, x in enumerate(lines) if k not in gone[d])
    return out


def test_runs_go_as_far_as_they_are_equal(spark):
    passage = " ".join(f"a{k}" for k in range(45)) + "\n" + " ".join(f"b{k}" for k in range(10))
    docs = {1: passage + "\nfirst end", 2: f"other start\n{passage}\nsecond end"}
    got = line_dedup.dedup_lines(spark.createDataFrame([*docs.items()], "doc_id long, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == {1: docs[1], 2: "other start\nsecond end"}


def test_against_brute_force(spark):
    rng = random.Random(8)
    for seed in range(4):
        pool = [" ".join(rng.choices("abcd", k=rng.randint(1, 4))) for _ in range(8)] + ["", "  ", "long " * 9]
        docs = {k: "\n".join(rng.choices(pool, k=rng.randint(0, 14))) for k in range(25)}
        got = line_dedup.dedup_lines(spark.createDataFrame([*docs.items()], "doc_id long, text string"), 6)
        assert {r.doc_id: r.text for r in got.collect()} == _runs(docs, 6)


def test_equal_windows_choose_the_same_line():
    rng = random.Random(9)
    lines = [" ".join(rng.choices("abcdef", k=rng.randint(1, 5))).encode() for _ in range(300)]
    at, words, hashes = line_dedup.line_hashes(b"\n".join(lines))
    ends = line_dedup.ends_of(words, 12)
    least = np.frombuffer(hashes, "<u8")[::2]
    for k, (end, one) in enumerate(zip(ends.tolist(), line_dedup.chosen(hashes, ends).tolist())):
        assert one == max(range(k, end + 1), key=lambda x: (-int(least[x]), x))
    assert len(set(line_dedup.chosen(hashes, ends).tolist())) < 0.6 * len(ends)


def test_very_long_text_and_ties(spark):
    run = "\n".join(f"line {k} of a very long text with some more words" for k in range(20_000))
    rows = [(7, f"{run}\nseven"), (7, f"{run}\nanother seven"), (8, run), (9, "x y z\n" * 30)]
    got = line_dedup.dedup_lines(spark.createDataFrame([(d, t, 1, 2, 3) for d, t in rows], "doc_id long, text string, runs int, own_version int, run_doc int"))
    assert got.columns == ["doc_id", "text", "runs", "own_version", "run_doc", "removed_runs"]
    by = {(r.doc_id, r.text) for r in got.collect() if (r.runs, r.own_version, r.run_doc) == (1, 2, 3)}
    first, second = ({(7, rows[0][1]), (7, "another seven")}, {(7, "seven"), (7, rows[1][1])})
    assert by in (first | {(8, ""), (9, "x y z")}, second | {(8, ""), (9, "x y z")})
