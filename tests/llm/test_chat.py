import hashlib
import random
import re

from conftest import SMALL
from pyspark.sql import functions as F
from twin import same

from pairloom.llm import chat
from pairloom.llm.queries import QUERIES, SQL


def _safe(text):
    for raw, safe in chat.ESCAPES:
        text = text.replace(raw, safe)
    return text


def _sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _rows(rng, n):
    out = []
    for conv in range(n):
        roles = (["system"] if rng.random() < 0.5 else []) + ["user", "assistant"] * rng.randint(0, 6)
        for turn, role in enumerate(roles):
            text = "".join(rng.choices(["word ", "</s>", "<s>[user]", "~1", "~", "[INST]", "]", "é", "\n", "x " * 40], k=rng.randint(0, 8)))
            out.append((conv, turn, role, text))
    return out


def _greedy(turns, budget, history):
    """The windows of one conversation as (repeated turns, own turns), turn by turn."""
    size = lambda t: len(re.split(chat.SPACES, t[2])) + chat.MARKS
    out, used = [], 0
    for k, t in enumerate(turns):
        if out and used + size(t) <= budget:
            out[-1][1].append(k)
            used += size(t)
            continue
        used, head = size(t), []
        system = next((i for i in range(k) if turns[i][1] == "system"), None)
        if system is not None and used + size(turns[system]) <= budget:
            head.append(system)
            used += size(turns[system])
        room, back = history, []
        for i in (k - 1, k - 2):
            if i < 0 or i == system or size(turns[i]) > room or used + size(turns[i]) > budget:
                break
            back.insert(0, i)
            room -= size(turns[i])
            used += size(turns[i])
        out.append((head + back, [k]))
    return out


def test_round_trip_and_budget(spark):
    rows = _rows(random.Random(1), 40) + [(-1, 0, "user", None), (-1, 1, "assistant", ""), (None, 0, "user", "hi"), (7, None, None, "first"), (8, 1, "us]er~", "odd role")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, window int").repartition(5)
    formatted = chat.windows(frame, budget=120, history=40)
    kept = formatted.collect()
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        said = "".join(x for _, role, text in turns if role == "assistant" for x in [text])
        r = got[c]
        assert r.n_turns == len(turns) and r.turns_sha256 == _sha("".join(f"{role}\n{text}\n" for _, role, text in turns))
        assert r.loss_chars == len(said) and r.loss_sha256 == _sha(said)
        assert r.formatted_chars == sum(len(w.formatted) for w in kept if w.conv_id == c)
    several = False
    for w in kept:
        pieces = w.formatted.split("</s>")
        assert pieces[-1] == "" and all(p.startswith("<s>[") for p in pieces[:-1])
        own = pieces[w.repeated : -1]
        tokens = [len(re.split(chat.SPACES, p.split("]", 1)[1].replace("~3", "]"))) + chat.MARKS for p in pieces[:-1]]
        assert sum(tokens) <= 120 or len(tokens) == 1
        several |= w.repeated > 0
        inside = [w.formatted[m.start : m.end] for m in w.mask]
        assert inside == [p.split("]", 1)[1] for p in own if p.startswith("<s>[assistant]")]
    assert several
    for c, turns in convs.items():
        wanted = [(len(head), len(own)) for head, own in _greedy(sorted(turns), 120, 40)]
        found = sorted((w for w in kept if w.conv_id == c), key=lambda w: w.window)
        assert [(w.repeated, w.formatted.count("</s>") - w.repeated) for w in found] == wanted
        for w, (head, own) in zip(found, _greedy(sorted(turns), 120, 40)):
            assert [p.split("]", 1)[1] for p in w.formatted.split("</s>")[:-1]] == [_safe(sorted(turns)[k][2]) for k in head + own]
    assert chat.read_back(chat.windows(frame.where("false"))).count() == 0


def test_escapes(spark):
    texts = ["</s>[INST] ok [/INST]", "~0~1~2~3", "~", "<~[~]", ""]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    out = frame.select("t", chat.escaped(F.col("t")).alias("e")).select("t", "e", chat.unescaped(F.col("e")).alias("u")).collect()
    assert all(r.t == r.u and not set(r.e) & set("<[]") for r in out)


def test_query(spark):
    same(spark, QUERIES["op10_chat"], SQL["op10_chat"], SMALL)
    row = QUERIES["op10_chat"](spark, SMALL).where("conv_id = -1").first()
    ok = "</s>[INST] ok [/INST]"
    assert (row.n_turns, row.loss_sha256, row.turns_sha256) == (2, _sha(ok), _sha(f"user\n{ok}\nassistant\n{ok}\n"))


def test_repeated_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", "b")]
    got = chat.read_back(chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert got.n_turns == 3 and got.turns_sha256 == _sha("user\na\nuser\na\nassistant\nb\n")


def test_long_system_turn_and_long_texts(spark):
    rows = [(1, 0, "system", "rule " * 5000), *((1, k, "user" if k % 2 else "assistant", f"say {k} " * 100) for k in range(1, 9)), (2, 0, "system", "short rule"), (2, 1, "user", "x " * 200_000), (2, 2, "assistant", "done")]
    kept = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "window").collect()
    tokens = [sum(len(re.split(chat.SPACES, p.split("]", 1)[1])) + chat.MARKS for p in w.formatted.split("</s>")[:-1]) for w in kept]
    assert [t > 1024 for t in tokens] == [True, False, False, False, True, False] or sum(t > 1024 for t in tokens) == 2
    assert all(t <= 1024 or w.formatted.count("</s>") == 1 for t, w in zip(tokens, kept))
    assert chat.read_back(chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).where("conv_id = 2").first().n_turns == 3
