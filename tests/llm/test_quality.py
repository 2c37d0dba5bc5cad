import random

from conftest import SMALL
from twin import same

from pairloom.llm import quality
from pairloom.llm.queries import QUERIES, SQL


def _brute(text):
    words = text.encode().split()
    words = [w.decode() for w in words]
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    places = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if x.encode().strip()]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(places), len(lines)


def test_measures():
    rng = random.Random(1)
    for text in ["", " \n\t", "é ü\x1c ñ", "a\x0bb\x85c\xa0d", "# 100% <b>", *("".join(rng.choices(["a ", "b ", "ü", "\n", " ", "#", "ab "], k=rng.randint(0, 80))) for _ in range(300))]:
        assert quality.measures(text.encode()) == _brute(text)


def test_query(spark):
    same(spark, QUERIES["op6_quality"], SQL["op6_quality"], SMALL)


def test_hosts(spark):
    good, bad = "one two three four five six seven eight nine ten eleven", "too short"
    rows = [(k, good if k % 10 else bad, f"host{k % 7}") for k in range(700)]
    rows += [(1000 + k, good if k % 10 == 0 else bad, "spam") for k in range(200)]
    rows += [(2000, bad, "tiny"), (2001, good, None), (2002, None, "host1"), (2003, "", "host1")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, kept int")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert len(got) == len(rows)
    assert not any(got[1000 + k].kept for k in range(200)) and got[1000].base_failed is False
    assert all(got[k].kept == bool(k % 10) for k in range(700))
    assert got[2001].kept and not got[2000].kept and got[2002].n_words == got[2003].n_words == 0
    assert 0 < got[2000].host_rate < 1  # one document says little about its host
    assert quality.judge(docs.where("false")).count() == 0
    assert quality.judge(docs.where("doc_id = 5")).first().kept


def test_verdicts_against_plain_formulas(spark):
    rng = random.Random(3)
    good, loud, long = "plain words in a row that say what they have to say", "buy # now % and * again for # less & more $ than ever", "incomprehensibilities " * 12
    rows = []
    for host in range(12):
        share = [rng.random() * 0.2 for _ in range(3)]
        if host == 4:
            share[1] = 0.95
        for _ in range(rng.choice([3, 40, 150])):
            text = next((t for t, p in zip(("short", loud, long), share) if rng.random() < p), good)
            rows.append((len(rows), text, f"h{host}"))
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    failing = quality.measured(frame).select("*", *[c.alias(r) for r, c in quality.failures().items()])
    got = {(r.source, r.rule): r for r in quality.host_verdicts(failing).collect()}
    condemned = set()
    for rule in quality.RULES:
        hosts = {}
        for _, text, source in rows:
            words, chars, symbols, dup, repeated, lines = _brute(text)
            fails = {"base": words < 10 or 100 * repeated > 20 * words, "word_length": not 3 * words <= chars <= 10 * words, "symbols": 100 * symbols > 10 * words > 0, "dup_lines": 100 * dup > 30 * lines}
            n, failed = hosts.get(source, (0, 0))
            hosts[source] = n + 1, failed + fails[rule]
        weights = [min(n, 50) for n, _ in hosts.values()]
        mean = lambda values: sum(w * x for w, x in zip(weights, values)) / sum(weights)  # noqa: E731, B023
        raw = mean([f / n for n, f in hosts.values()])
        m = min(max(raw, 1e-6), 1 - 1e-6)
        own = mean([(f / n - raw) ** 2 for n, f in hosts.values()]) - m * (1 - m) * mean([1 / n for n, _ in hosts.values()])
        weight = m * (1 - m) / own - 1 if own > 0 else 0
        weight = weight if weight > 0 else mean([n for n, _ in hosts.values()])
        for source, (n, failed) in hosts.items():
            rate = (failed + m * weight) / (n + weight)
            is_bad = rate - 2 * (rate * (1 - rate) / (n + weight + 1)) ** 0.5 > m + 2 * (m * (1 - m) / (weight + 1)) ** 0.5
            assert abs(got[source, rule].rate - rate) < 1e-9 and got[source, rule].condemned == is_bad and got[source, rule].failed == failed
            if is_bad:
                condemned.add(source)
    assert condemned == {"h4"}
    assert {r.source for r in quality.judge(frame).where("host_condemned").select("source").distinct().collect()} == condemned
    assert quality.judge(frame).where("NOT kept AND NOT base_failed").count() > 0


def test_very_long_text_and_odd_columns(spark):
    docs = spark.createDataFrame([(1, "word " * 300_000, "a", "x", "y"), (1, "word " * 300_000, "a", "x", "y")], "doc_id long, text string, source string, host string, base string")
    got = quality.judge(docs).collect()
    assert len(got) == 2 and all(r.n_words == r.n_repeat_words == 300_000 and r.base_failed and not r.kept for r in got)
