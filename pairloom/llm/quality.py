"""Quality rules with host-level verdicts.

A document fails rules by itself, the base rule among them. Failures of each rule are counted by host (the source), each
host's rate is shrunk towards the other hosts' by a beta prior fitted to all rates, and the documents of a host go as
well if by one of the rules its rate is, even at the low end of what its documents leave open, above the high end of
what the prior has hosts do. So a verdict needs many documents or a rate far from the others, and what every host does
condemns none.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize

#: The base rule: fewer words fail, and so does a larger percentage of words in repeated windows.
MIN_WORDS, MOST_REPEATED = 10, 20
#: Words of a window.
WINDOW = 5
#: The other rules: mean word length outside these bounds, symbols and repeated lines above these percentages of words and lines.
WORD_LENGTH, MOST_SYMBOLS, MOST_DUP_LINES = (3, 10), 10, 30
RULES = ("base", "word_length", "symbols", "dup_lines")
#: Standard deviations, of a host's shrunk rate and of the prior, that a condemned host's rate is above the prior's mean.
DEVIATIONS = 2.0
#: Documents from which hosts count alike for the prior.
FULL = 50
_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
#: Bytes that go on a character of UTF-8.
_GO_ON = bytes(range(0x80, 0xC0))


def measures(text: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (with a word) of a UTF-8 text."""
    words = text.split()
    chars = len(text.translate(None, _SPACES + _GO_ON))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    grams = [*zip(*(words[k:] for k in range(WINDOW)))]
    repeated = 0
    if len(set(grams)) < len(grams):
        counts, end = Counter(grams), 0
        for at, gram in enumerate(grams):
            if counts[gram] > 1:
                repeated += at + WINDOW - max(at, end)
                end = at + WINDOW
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def measured(documents: DataFrame) -> DataFrame:
    """doc_id, source and the measures of every row; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measures(t or b"") for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, pa.int64()) for c in ([*zip(*found)] or [[]] * 6))], names=["doc_id", "source", *_NAMES])

    return arrow_map(documents.select(F.col("doc_id").cast("long"), "source", F.col("text").cast("binary")), run, "doc_id long, source string, " + ", ".join(f"{n} long" for n in _NAMES))


_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def failures() -> dict[str, Column]:
    """Whether a measured document fails each of RULES; a text without words fails the base rule alone."""
    n = F.col("n_words")
    low, high = WORD_LENGTH
    return {
        "base": (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * n),
        "word_length": (F.col("word_chars") < low * n) | (F.col("word_chars") > high * n),
        "symbols": (n > 0) & (100 * F.col("n_symbols") > MOST_SYMBOLS * n),
        "dup_lines": 100 * F.col("n_dup_lines") > MOST_DUP_LINES * F.col("n_lines"),
    }


def beta_priors(rates: DataFrame) -> DataFrame:
    """rule, mean and weight (a + b) of the beta prior of hosts (rule, n, failed) by the method of moments.

    A host counts by its documents, from FULL of them on like any other: neither hosts of a few documents nor one of very
    many decide. The variance of the rates less what the hosts' sizes alone would give is the prior's; where nothing is
    left, or there is one host, the prior is as heavy as the mean host.
    """
    rate, m, w = F.col("failed") / F.col("n"), F.col("mean"), F.least("n", F.lit(FULL))
    mean = lambda c: F.sum(w * c) / F.sum(w)
    found = rates.groupBy("rule").agg(mean(rate).alias("raw"), mean(rate * rate).alias("squares"), mean(1 / F.col("n")).alias("i"), mean(F.col("n")).alias("size"))
    found = found.withColumn("mean", F.least(F.greatest("raw", F.lit(1e-6)), F.lit(1 - 1e-6)))
    found = found.withColumn("own", F.col("squares") - F.col("raw") * F.col("raw") - m * (1 - m) * F.col("i"))
    weight = F.when(F.col("own") > 0, m * (1 - m) / F.col("own") - 1)
    return found.select("rule", "mean", F.when(weight > 0, weight).otherwise(F.col("size")).alias("weight"))


def host_verdicts(rows: DataFrame, deviations: float = DEVIATIONS) -> DataFrame:
    """source, rule, n, failed, rate (shrunk) and condemned for each host and rule of rows (source and a failure column by rule)."""
    counts = rows.groupBy("source").agg(F.count("*").alias("n"), *[F.sum(F.col(r).cast("long")).alias(r) for r in RULES])
    rates = materialize(counts.select("source", "n", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("failed")) for r in RULES])).alias("x")).select("source", "n", "x.rule", "x.failed"))
    joined = rates.join(F.broadcast(beta_priors(rates)), "rule")  # a row a rule
    all_, m = F.col("n") + F.col("weight"), F.col("mean")
    joined = joined.withColumn("rate", (F.col("failed") + m * F.col("weight")) / all_)
    low = F.col("rate") - deviations * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (all_ + 1))
    high = m + deviations * F.sqrt(m * (1 - m) / (F.col("weight") + 1))
    return joined.select("source", "rule", "n", "failed", "rate", (low > high).alias("condemned"))


def judge(documents: DataFrame, deviations: float = DEVIATIONS) -> DataFrame:
    """doc_id, source, the measures, base_failed, host_rate (of base failures, shrunk), host_condemned and kept of every row.

    Null and empty texts fail the base rule. Rows of a null source are a host of their own. Repeated rows count each;
    texts of any length are read whole; extra columns are not read. Hosts are counted before they are shuffled, so one
    host may hold most rows; the verdicts are joined back, and large hosts are split in that join.
    """
    rows = materialize(measured(documents).select("*", *[F.coalesce(c, F.lit(False)).alias(r) for r, c in failures().items()]), gathered=True)
    verdicts = host_verdicts(rows, deviations)
    hosts = verdicts.groupBy(F.col("source").alias("host")).agg(F.max(F.when(F.col("rule") == "base", F.col("rate"))).alias("host_rate"), F.bool_or("condemned").alias("host_condemned"))
    joined = rows.join(hosts, F.col("source").eqNullSafe(F.col("host")), "left").drop("host", *RULES[1:]).withColumnRenamed("base", "base_failed")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_condemned"))
