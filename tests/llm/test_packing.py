import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pairloom.llm import packing
from pairloom.llm.tokens import WordIds

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def test_word_ids_are_the_tokenizers(tokenizer):
    rng = random.Random(1)
    store = WordIds(PATH, 50)
    marks = "aAbZ'sßéÉÀ́İıΣσς.,#-_…«» \n\t\x0b\x1c\x85\xa0 ​1²½٣中文ÅK|<>"
    for k in range(3000):
        text = "".join(rng.choices(marks, k=rng.randint(0, 25))) + ("<|endoftext|> I'LL don't" if k % 50 == 0 else "")
        assert np.frombuffer(store.ids(text.encode()), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_round_trip(spark, tokenizer):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choices(["alpha", "beta,", "Gamma", "x1"], k=rng.randint(0, 70)))) for k in range(150)]
    rows += [(500, None), (501, ""), (502, "word " * 500), (502, "word " * 500), (None, "none"), (503, "word " * 31)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, length int").repartition(5)
    got = packing.pack(docs, most=32).collect()
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append(r)
    for parts in sequences.values():
        parts.sort(key=lambda r: r.offset)
        at = 0
        for r in parts:
            assert r.offset == at
            at += r.length
        assert at <= 32
    ids = {}
    for d, t in rows:
        ids.setdefault(d, []).append(tokenizer.encode(t or "", add_special_tokens=False).ids + [0])
    for d, texts in ids.items():
        own = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == d)
        wanted = sorted((n, a, len(x[a : a + 32]), zlib.crc32(np.array(x[a : a + 32], "<u4").tobytes())) for x in texts for n, a in enumerate(range(0, len(x), 32)))
        assert own == wanted
    total = sum(r.length for r in got)
    assert len(sequences) <= 1.05 * -(-total // 32) + 1
    assert packing.pack(docs.where("false")).count() == 0


def test_plan_places_every_rank_once():
    rng = np.random.default_rng(3)
    for most in (1, 2, 7, 64, 256):
        histogram = rng.integers(0, 40, most + 1)
        histogram[0] = 0
        slots, sequences = packing.plan(histogram, 60)
        fill, seen = np.zeros(sequences, int), {}
        for length, first, n, sequence, offset, each in slots.tolist():
            for k in range(n):
                seen.setdefault(length, []).append(first + k)
                fill[sequence + k // each] += length
        assert all(sorted(seen.get(x, [])) == list(range(histogram[x])) for x in range(1, most + 1))
        assert (fill <= most).all() and (fill > 0).all()
        total = int((histogram * np.arange(most + 1)).sum())
        assert sequences <= 1.04 * -(-total // most) + 2  # best-fit alone has 1.035 here


def test_fit_is_the_least_squares():
    histogram = np.zeros(11, int)
    histogram[[2, 3, 5, 8, 10]] = [30, 20, 40, 10, 7]  # 2 + 8, 5 + 5, 2 + 3 + 5, 10
    patterns, used = packing.fit(histogram, 2000)
    rest = histogram.astype(float)
    for p, n in zip(patterns, used):
        assert n >= 0 and p.sum() == 10
        for x in p[p > 0]:
            rest[x] -= n
    slope = np.array([sum(rest[x] * (x / 10) ** packing.POWER for x in p if x) for p in patterns])
    assert (slope < 0.2).all() and (np.abs(slope * used) < 1).all()  # no use that is left helps, every use in hand is right


def test_long_text_is_cut_only_where_needed(spark):
    got = packing.pack(spark.createDataFrame([(1, "word " * 4000), (2, "word " * 2047)], "doc_id long, text string")).orderBy("doc_id", "piece").collect()
    assert [(r.doc_id, r.start, r.length) for r in got] == [(1, 0, 2048), (1, 2048, 1953), (2, 0, 2048)]
