import math

import numpy as np
from conftest import SMALL
from pyspark.sql import functions as F

from pairloom.llm import langid
from pairloom.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op4_language"](spark, "/root/testdata/sf0.01").join(truth, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and 150 < len(held) < 350
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.99
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_and_ids_do_not_enter(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.train(docs)
    a = langid.identify(docs, model).select("lang_pred").collect()
    b = langid.identify(docs.withColumn("lang", F.lit("zz")).withColumn("doc_id", F.lit(1)), model).select("lang_pred").collect()
    assert a == b


def test_edge_cases(spark):
    rows = [(1, "das ist ein satz und noch einer", "de"), (2, "this is a sentence and another one", "en"), (3, "und das ist noch ein satz", "de"), (4, "here is one more sentence this time", "en"), (5, "kein", None)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"]
    texts = [(1, None), (2, ""), (3, "123 !?"), (4, "das"), (5, "sentences"), (6, "Satzes"), (7, "x" * 5000), (None, "this is")]
    docs = spark.createDataFrame([(*x, "lang") for x in texts], "doc_id long, text string, lang_pred string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[4][0] == "de" and got[5][0] == "en" and got[6][0] == "de" and got[None][0] == "en" and got[7][0] in ("de", "en")
    assert {r.doc_id for r in langid.keep_identified(docs, model).collect()} == {4, 5, 6, 7, None}
    none = langid.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(docs.where("false"), model).count() == 0


def test_store_of_scores_starts_anew(monkeypatch):
    monkeypatch.setattr(langid, "KEPT", 4)
    model = langid.Model(["a", "b"], {"x": 0, "y": 1}, np.array([[-1, -2], [-3, -1]], np.float32), {}, np.array([[-9, -9]], np.float32))
    text = "x y " + " ".join(f"{c}q" for c in "abcdefgh")
    fresh = langid.Model(["a", "b"], model.known, model.known_logs, {}, model.gram_logs)
    assert model.predict(text) == fresh._one_by_one(langid.words(text)) and model.predict("x x") == fresh.predict("x x")


def test_words_are_letters():
    assert langid.words("½ ² ① 12 _") == [] and langid.words("a½b É ß x²") == ["a", "b", "é", "ß", "x"]
    assert langid.words("हिन्दी cafés") == ["हिन्दी", "cafés"]
    assert langid.words("Plain, words_here 3d") == ["plain", "words", "here", "d"]


def test_model_against_brute_force(spark):
    """Words, backoff and score as the module's text has them, read one by one."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.collect()
    model = langid.train(docs)
    names = sorted({r.lang for r in rows if r.lang})
    seen, grams = {}, [{} for _ in range(langid.LONGEST + 1)]
    for r in rows:
        for w in langid.words(r.text or "") if r.lang else ():
            seen.setdefault(w, dict.fromkeys(names, 0))[r.lang] += 1
    for w, by in seen.items():
        for n in range(1, langid.LONGEST + 1):
            for k in range(len(w) + 3 - n):
                own = grams[n].setdefault(f"^{w}$"[k : k + n], dict.fromkeys(names, 0))
                for lang, c in by.items():
                    own[lang] += c
    # an n-gram counts for a language if it has it twice, or is a single character
    grams = [{g: {x: c for x, c in by.items() if c > 1 or len(g) == 1} for g, by in t.items()} for t in grams]
    grams = [{g: by for g, by in t.items() if any(by.values())} for t in grams]
    known = {w: by for w, by in seen.items() if sum(by.values()) > 1}
    log = lambda by, t, lang: math.log((by.get(lang, 0) + 0.1) / (sum(x.get(lang, 0) for x in t.values()) + 0.1 * len(t)))

    def score(w):
        if w in known:
            return [log(known[w], known, x) for x in names]
        marked, out, given = f"^{w}$", [0.0] * len(names), 0
        for end in range(1, len(marked) + 1):
            for begin in range(max(0, end - langid.LONGEST), end + 1):
                g = marked[begin:end]
                if not g or g in grams[len(g)]:
                    given += langid.LONGEST - len(g)
                    out = [o + (log(grams[len(g)][g], grams[len(g)], x) if g else math.log(1e-6)) for o, x in zip(out, names)]
                    break
        return [(o + langid.PENALTY * given) / len(marked) for o in out]

    assert model.languages == names
    for w in [*list(known)[:60], "unseenword", "qqq", "überallx", "x", "déjàzz"]:
        assert np.allclose(model.score(w), score(w), atol=1e-4), w


def test_bounds_are_kept(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.train(docs, most_words=50, most_grams=80)
    assert len(model.known) <= 50 * len(model.languages) and len(model.grams) <= 80 * len(model.languages)
    few = langid.train(docs, cells=20 * 16)
    assert len(few.known) <= 20 * len(few.languages)
