"""Language identification by words first, backing off to ever shorter character n-grams.

A word seen in training scores its smoothed log frequency in each language. Another word scores the mean over its places
of the longest known character n-gram there (marks at its ends included), with a penalty for each character given up.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_column, arrow_map, materialize

#: Bounds of the fit: labelled documents a language, words and n-grams kept a language, languages.
DOCUMENTS, WORDS, GRAMS, LANGUAGES = 3000, 25_000, 40_000, 200
#: Numbers of a table of the model: with many languages, fewer words and n-grams of each are kept.
CELLS = 1 << 25
#: The longest n-grams, and what giving up a character costs (of the log frequency).
LONGEST, PENALTY = 5, math.log(0.4)
#: Words whose scores a worker keeps; beyond it the store starts anew.
KEPT = 100_000
#: What documents without a letter get.
NONE = "und"
_WORD = re.compile(r"[^\W\d_]+")
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words(text: str) -> list[str]:
    """The lower-cased runs of letters; combining marks go on a run, numerals of any kind do not."""
    text = text.lower()
    found = _WORD.findall(text)
    if text.isascii() or not found or (_MARKED.search(text) is None and "".join(found).isalpha()):
        return found
    return _LETTERS.findall(text)


#: What may hold combining marks: everything but Latin, Greek and Cyrillic letters, punctuation and the like.
_MARKED = re.compile("[\u0300-\u036f\u0483-\u1dff\u20d0-\u20ff\u2c00-\U0010ffff]")


@dataclass
class Model:
    """languages in order; for words and n-grams their rows of log frequencies by language."""

    languages: list[str]
    known: dict[str, int]
    known_logs: np.ndarray
    grams: dict[str, int]
    gram_logs: np.ndarray
    _row: dict[str, int] = field(default_factory=dict)
    _scores: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"_row": {}, "_scores": None}

    def score(self, word: str) -> np.ndarray:
        """Log frequency of a word by language."""
        if (row := self.known.get(word)) is not None:
            return self.known_logs[row]
        marked, grams, rows, given_up = f"^{word}$", self.grams, [], 0
        for end in range(1, len(marked) + 1):
            begin = end - LONGEST if end > LONGEST else 0
            while (row := grams.get(marked[begin:end])) is None and begin < end:
                begin += 1
            given_up += LONGEST - end + begin
            rows.append(-1 if row is None else row)  # the last row is that of characters never seen
        return (self.gram_logs[rows].sum(0) + PENALTY * given_up) / len(rows)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and how sure: its share when the scores, damped by the root of the word count, are made to sum to 1."""
        found = words(text or "")
        if not found or not self.languages:
            return NONE, 0.0
        if self._scores is None or len(self._row) + len(found) > KEPT:
            self._row.clear()
            self._scores = np.empty((KEPT, len(self.languages)), np.float32)
        total = np.zeros(len(self.languages))
        for k in range(0, len(found), KEPT // 2):
            part = found[k : k + KEPT // 2]
            for word in set(part).difference(self._row):
                if len(self._row) == KEPT:
                    return self._one_by_one(found)
                self._scores[len(self._row)] = self.score(word)
                self._row[word] = len(self._row)
            total += self._scores[np.fromiter(map(self._row.__getitem__, part), np.int64, len(part))].sum(0, dtype=np.float64)
        return self._best(total, len(found))

    def _one_by_one(self, found: list[str]) -> tuple[str, float]:
        """As predict, for texts of more distinct words than are kept."""
        return self._best(np.sum([n * self.score(w).astype(np.float32).astype(np.float64) for w, n in Counter(found).items()], axis=0), len(found))

    def _best(self, total: np.ndarray, n: int) -> tuple[str, float]:
        weight = np.exp((total - total.max()) / math.sqrt(n))
        best = int(total.argmax())
        return self.languages[best], float(weight[best] / weight.sum())


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[lang].update(words(text or ""))
        rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*zip(*rows)] or [[]] * 3, (pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[tuple[str, str], int] = defaultdict(int)
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            marked = f"^{word}$"
            for length in range(1, LONGEST + 1):
                for at in range(len(marked) - length + 1):
                    counts[lang, marked[at : at + length]] += n
        rows = [(*key, n) for key, n in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*zip(*rows)] or [[]] * 3, (pa.string(), pa.string(), pa.int64()))], names=["lang", "gram", "n"])


def _most(counts: DataFrame, key: str, most: int) -> DataFrame:
    """The most frequent keys of each language; equal ones by key."""
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), key))).where(F.col("rank") <= most).select("lang", key, "n")


def _table(counts: DataFrame, names: list[str]) -> tuple[list[str], np.ndarray]:
    """The keys in order and their counts by language; as many numbers as the keys kept times the languages."""
    found = counts.toArrow()
    keys, row = np.unique(np.array(found.column(1).to_pylist(), object), return_inverse=True) if len(found) else ([], [])
    out = np.zeros((len(keys), len(names)), np.float32)
    place = {n: k for k, n in enumerate(names)}
    out[row, [place[x] for x in found.column(0).to_pylist()]] = found.column(2).to_numpy()
    return [*keys], out


def train(labelled: DataFrame, documents: int = DOCUMENTS, most_words: int = WORDS, languages: int = LANGUAGES, most_grams: int = GRAMS, cells: int = CELLS) -> Model:
    """A model of the labelled rows (doc_id, text, lang).

    The bounds are parameters: of each of the most frequent languages, the documents whose hash of doc_id is below the
    cut that leaves about so many, in whole, and their most frequent words and n-grams, counted in Spark; only those and
    their counts reach the driver, two tables of so many cells at most. Without labelled rows the model knows no
    language. Null, empty and very long texts are read like others; equally frequent words go by spelling.
    """
    counts = labelled.where("lang IS NOT NULL").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    names, chosen = sorted(r["lang"] for r in counts), F.lit(False)
    if not names:
        return Model([], {}, np.zeros((0, 0), np.float32), {}, np.zeros((0, 0), np.float32))
    for r in counts:
        share = min(1.0, documents / r["count"])
        chosen |= (F.col("lang") == r["lang"]) & (F.xxhash64("doc_id") <= F.lit(max(-(1 << 63), min((1 << 63) - 1, int((share * 2 - 1) * (1 << 63))))))
    texts = labelled.where(chosen).select("lang", "text")
    most = cells // len(names) ** 2
    found = arrow_map(texts, _counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    ranked = materialize(_most(found, "word", min(most_words, most)))
    seen, known = _table(ranked, names)
    grams = arrow_map(ranked, _grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    pieces, counted = _table(_most(grams.where("n > 1 OR length(gram) = 1"), "gram", min(most_grams, most)), names)

    def logs(table: np.ndarray) -> np.ndarray:
        return np.log((table + 0.1) / (table.sum(0) + 0.1 * len(table))).astype(np.float32)

    common = known.sum(1) > 1
    length = np.array([len(g) for g in pieces])
    order = np.argsort(length, kind="stable")
    floor = np.full((1, len(names)), math.log(1e-6), np.float32)
    known_rows = {w: k for k, w in enumerate(w for w, c in zip(seen, common) if c)}
    return Model(names, known_rows, logs(known[common]), {pieces[k]: n for n, k in enumerate(order)}, np.concatenate([*(logs(counted[length == n]) for n in range(1, LONGEST + 1)), floor]))


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row; texts that are null, empty or without a letter get `und` and 0.

    Texts are read whole, however long. Of languages with equal scores the first by name is returned. Repeated rows get
    the same result each; extra columns are not read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # bounded by the words a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            found = [own.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return arrow_map(documents.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_identified(documents: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """documents whose language is known: those without a letter, or with a score under least, go.

    Null and empty texts go; repeated rows stay or go together; extra columns stay, whatever their names.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def sure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [shared.value.predict(t) for t in texts.to_pylist()]
            yield pa.array([lang != NONE and score >= least for lang, score in found], pa.bool_())

    return documents.where(arrow_column(documents.sparkSession, sure, "boolean")(F.col("text")))
