"""Secret scans: fixed patterns, and credential values that would be hard to guess.

A value in a credential's context is cut into words, dates, repeats, keyboard walks and brute-force spans so that the
guesses an attacker needs are least (dynamic programming over its characters); values that cost more than a bound are
secrets, placeholders and dictionary passwords are not.
"""

from __future__ import annotations

import json
import math
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map


def _either(word: str) -> str:
    """A pattern for an ASCII word in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Fixed patterns by kind, with the least length of what must be long enough.
_NAMES = "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")])
ASSIGN = re.compile(f"({_NAMES})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{16,}")  # a run is taken whole, so a shorter one never hides a longer one
KINDS = ("assign", "access", "hex", "guess")

#: Names before a value that may be a credential.
CONTEXTS = ("password", "passwd", "passphrase", "pwd", "pass", "secret", "token", "api_key", "apikey", "api-key", "access_key", "private_key", "client_secret", "credential", "credentials", "auth", "bearer", "authorization", "signature", "key")
CONTEXT = re.compile("(?<![A-Za-z0-9])(" + "|".join(_either(c) for c in sorted(CONTEXTS, key=len, reverse=True)) + r""")["']?\x20*(?:[:=]|\x20is\x20)\x20*(?:[Bb]earer\x20+)?["']?([^\x00-\x20\x7f-\xa0\u2028\u2029"'<>,;(){}]{6,})""")
#: Common parts of passwords and placeholders, the commonest first; they come before the words of the list.
COMMON = "password secret token example changeme admin test your key api user pass welcome login master root default dummy sample null none true false hello monkey dragon letmein iloveyou trustno passwd qwerty".split()
#: The ranked list of words: a public tokenizer's vocabulary, or the path of one. Its words of LEAST_WORD ASCII letters or more count, in the order of their ids.
WORD_LIST, LEAST_WORD = "word_bpe_49k.json", 3
#: Rows of keys; a walk goes along a row, either way.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
#: Along which way of a row a pair of keys goes.
_WAY = {(a, b): way for row in ROWS for x, y in zip(row, row[1:]) for a, b, way in ((x, y, 1), (y, x, -1))}
#: Letters that digits and marks stand for.
_LEET = str.maketrans("@4301$57", "aaeoisst")
_MONTH, _DAY, _YEAR = "(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])", r"(?:19|20)\d\d"
_DATES = [re.compile(d) for d in (f"{_YEAR}[-/._]?{_MONTH}[-/._]?{_DAY}", f"{_DAY}[-/._]?{_MONTH}[-/._]?{_YEAR}", _YEAR)]
#: Guesses (log10) that make a value a secret.
LEAST_COST = 10.0
_LOG2, _LOG50 = math.log10(2), math.log10(50)


#: Letters of other scripts than the Latin one that a guesser tries at a place.
OTHER_LETTERS = 100


@cache
def ranks(name: str = WORD_LIST) -> dict[str, int]:
    """The rank of each word: COMMON, then those of the list."""
    if not os.path.isabs(name):
        import public_tokenizers

        name = public_tokenizers.path(name)
    with open(name, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    found = dict.fromkeys(COMMON)
    for token in sorted(vocabulary, key=vocabulary.__getitem__):
        word = token.removesuffix("</w>")
        if word != token and len(word) >= LEAST_WORD and word.isascii() and word.isalpha():
            found[word] = None
    return {w: k + 1 for k, w in enumerate(found)}


@cache
def _longest(name: str) -> int:
    return max(map(len, ranks(name)))


def _alphabet(c: str) -> float:
    """log10 of the alphabet that a character is guessed from: digits, letters of its case, letters of other scripts, marks."""
    if c.isdigit():
        return 1.0
    if c.isascii() and c.isalpha():
        return math.log10(26)
    return math.log10(OTHER_LETTERS) if c.isalpha() else math.log10(33)


def repeats(value: str) -> list[tuple[int, int, int]]:
    """(start, end, size) of the maximal parts that repeat a block of so many characters twice or more, blocks that repeat themselves left out."""
    codes = np.frombuffer(value.encode("utf-32-le"), np.uint32)
    found: list[tuple[int, int, int]] = []
    within: dict[tuple[int, int], int] = {}
    for size in range(1, len(codes) // 2 + 1):
        same = codes[size:] == codes[:-size]
        if np.count_nonzero(same) < size:
            continue
        steps = np.diff(np.concatenate([[0], same.view(np.int8), [0]]))
        for start, end in zip(np.flatnonzero(steps == 1).tolist(), np.flatnonzero(steps == -1).tolist()):
            # the same part with a block of a divisor's size is the same repeat
            if end - start >= size and size % within.get((start, end + size), size + 1):
                within[start, end + size] = size
                found.append((start, end + size, size))
    return found


def guess_cost(value: str, words: str = WORD_LIST) -> float:
    """log10 of the guesses for the cheapest segmentation of a value, over all segmentations: no segment's cost depends on those before.

    A word costs its rank, its capitals and its replaced letters; a date its days; a repeat of a block of any size the
    block by brute force and the count; a walk its start, length and turns; another character the size of its alphabet.
    Repeats and walks may end anywhere within their longest extent. The work grows with the square of the length, in
    array operations.
    """
    n, lower = len(value), value.lower()
    if len(lower) != n:
        lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = lower.translate(_LEET)
    best = np.full(n + 1, np.inf)
    best[0] = 0.0
    alphabet = np.array([_alphabet(c) for c in value])
    brute = np.concatenate([[0.0], np.cumsum(alphabet)])
    logs = np.log10(np.arange(1, n + 2))
    rank, longest = ranks(words), _longest(words)
    starting: dict[int, list[tuple[int, int]]] = {}
    for start, end, size in repeats(value):
        for at in range(start, end - max(3, 2 * size) + 1):
            starting.setdefault(at, []).append((end, size))
    ways = np.array([_WAY.get(pair, 0) for pair in zip(lower, lower[1:])] + [0])
    walk_end = np.arange(1, n + 1)
    for at in range(n - 2, -1, -1):
        if ways[at]:
            walk_end[at] = walk_end[at + 1]
    turned = np.concatenate([[0], np.cumsum(ways[1:] != ways[:-1])])
    for at in range(n):
        cost = best[at]
        best[at + 1] = min(best[at + 1], cost + alphabet[at])
        for end in range(at + 2, min(n, at + longest) + 1):
            for form in (lower, plain):
                if found := rank.get(form[at:end]):
                    capitals = sum(c.isupper() for c in value[at:end])
                    changed = sum(a != b for a, b in zip(lower[at:end], plain[at:end])) if form is plain else 0
                    best[end] = min(best[end], cost + math.log10(found + 1) + (capitals + changed) * _LOG2)
        if value[at].isdigit():
            for date in _DATES:
                if m := date.match(value, at):
                    best[m.end()] = min(best[m.end()], cost + math.log10(36_500 if m.end() - at > 4 else 130))
        for end, size in starting.get(at, ()):
            low = at + max(3, 2 * size)
            counts = np.arange(low - at, end - at + 1) / size
            best[low : end + 1] = np.minimum(best[low : end + 1], cost + brute[at + size] - brute[at] + np.log10(counts + 1))
        if (end := int(walk_end[at])) >= at + 3:
            turns = turned[at + 1 : end - 1] - turned[at]
            own = cost + _LOG50 + logs[2 : end - at] + turns * _LOG2
            best[at + 3 : end + 1] = np.minimum(best[at + 3 : end + 1], own)
    return float(best[n])


def is_hard(value: str, least_cost: float, words: str) -> bool:
    """Whether a value costs so much; what brute force does more cheaply needs no segmentation."""
    return sum(map(_alphabet, value)) >= least_cost and guess_cost(value, words) >= least_cost


def spans(text: str, least_cost: float = LEAST_COST, words: str = WORD_LIST) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of every secret, in order."""
    found = []
    if _MAYBE.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
        found += [(m.start(2), 3, m.end(2)) for m in CONTEXT.finditer(text) if is_hard(m[2], least_cost, words)]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


#: What every context has, sought first.
_MAYBE = re.compile("[:=]|\x20is\x20")


def scan(documents: DataFrame, least_cost: float = LEAST_COST, words: str = WORD_LIST) -> DataFrame:
    """doc_id and secrets, an array of (start, kind, end) in code points, of every row, by start, then kind.

    Null and empty texts have none; texts and values of any length are read whole. A value that a fixed pattern has as
    well is in both spans. Repeated rows get the same result each; extra columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))
        for batch in batches:
            found = [[{"start": s, "kind": KINDS[k], "end": e} for s, k, e in spans(t or "", least_cost, words)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "secrets"])

    return arrow_map(documents.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, secrets array<struct<start: long, kind: string, end: long>>")
