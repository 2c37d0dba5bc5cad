"""The corpus operators as queries: each takes (spark, sf_dir), works on a whole table and returns its full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, html_extract, langid, line_dedup, packing, quality, secret_scan, sharding, simhash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    found = sharding.shard(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ok = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{ok}'), (-1L, 1L, 'assistant', '{ok}') AS t(conv_id, turn, role, text)")
    return chat.read_back(chat.windows(rows.union(more)))


_TURN = "7 + length(replace(replace(replace(replace({0}, '~', '~0'), '<', '~1'), '[', '~2'), ']', '~3')) + length(replace(replace(replace(replace({1}, '~', '~0'), '<', '~1'), '[', '~2'), ']', '~3')) + 2"
SQL["op10_chat"] = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), a AS (
  SELECT *, len(string_split_regex(text, '[\x20\x09-\x0D]+')) + 4 AS tokens, {_TURN.format("role", "text")} AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place
  FROM rows
), b AS MATERIALIZED (
  SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY place) AS upto FROM a
), fold AS (
  WITH RECURSIVE step AS (
    SELECT conv_id, place, 1024::hugeint AS lim, CASE WHEN role = 'system' THEN tokens ELSE 0 END AS st, CASE WHEN role = 'system' THEN chars ELSE 0 END AS sc, CASE WHEN role = 'system' THEN 1 ELSE 0 END AS sp,
      tokens AS t1, chars AS c1, 0::bigint AS t2, 0::bigint AS c2, 0::bigint AS head FROM b WHERE place = 1
    UNION ALL
    SELECT conv_id, place, CASE WHEN upto > lim THEN upto - tokens + 1024 - s - CASE WHEN h1 THEN t1 ELSE 0 END - CASE WHEN h2 THEN t2 ELSE 0 END ELSE lim END,
      CASE WHEN role = 'system' AND st = 0 THEN tokens ELSE st END, CASE WHEN role = 'system' AND st = 0 THEN chars ELSE sc END, CASE WHEN role = 'system' AND st = 0 THEN place ELSE sp END,
      tokens, chars, t1, c1, CASE WHEN upto > lim THEN CASE WHEN s > 0 THEN sc ELSE 0 END + CASE WHEN h1 THEN c1 ELSE 0 END + CASE WHEN h2 THEN c2 ELSE 0 END ELSE 0 END
    FROM (
      SELECT *, h1 AND t2 > 0 AND place - 2 <> sp AND t1 + t2 <= 128 AND s + tokens + t1 + t2 <= 1024 AS h2 FROM (
        SELECT *, place - 1 <> sp AND t1 <= 128 AND s + tokens + t1 <= 1024 AS h1 FROM (
          SELECT b.*, lim, st, sc, sp, t1, c1, t2, c2, CASE WHEN st + tokens <= 1024 THEN st ELSE 0 END AS s FROM step JOIN b ON b.conv_id = step.conv_id AND b.place = step.place + 1)))
  ) SELECT conv_id, place, head FROM step
), d AS (SELECT b.*, head FROM b JOIN fold USING (conv_id, place))
SELECT conv_id, count(*)::bigint AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::bigint AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars + head)::bigint AS formatted_chars
FROM d GROUP BY conv_id
"""


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text without the later ones of repeated runs, removed (start:end of the deleted runs, lines from 0, end exclusive)."""
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    runs = F.transform("removed_runs", lambda r: F.concat_ws(":", r["start"], r["end"] + 1))
    return found.select("doc_id", "text", F.coalesce(F.array_join(runs, ","), F.lit("")).alias("removed"))


SQL["op1_line_dedup"] = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents
), words AS (
  SELECT *, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line, len(regexp_extract_all(raw, '[^\\x20\\x09-\\x0D]+')) AS n FROM lines
), own AS (
  SELECT doc_id, k, line, sum(n) OVER w - n AS low, sum(n) OVER w AS high FROM words WHERE n > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY k)
), ends AS (
  SELECT a.doc_id, a.k AS s, b.k AS e FROM own a JOIN own b ON a.doc_id = b.doc_id AND b.low < a.low + 30 AND b.high >= a.low + 30
  UNION SELECT a.doc_id, a.k, b.k FROM own a JOIN own b ON a.doc_id = b.doc_id AND a.low <= b.high - 30 AND a.high > b.high - 30
), windows AS (
  SELECT w.doc_id, s, e, string_agg(line, chr(10) ORDER BY k) AS content FROM ends w JOIN own o ON o.doc_id = w.doc_id AND o.k BETWEEN s AND e GROUP BY w.doc_id, s, e
), later AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, s) AS nth FROM windows) WHERE nth > 1
), gone AS (
  SELECT w.*, last_value(w.n > 0 AND l.doc_id IS NOT NULL) OVER (PARTITION BY w.doc_id, w.solid ORDER BY w.k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_gone,
    max(w.n > 0 AND l.doc_id IS NOT NULL) OVER (PARTITION BY w.doc_id, w.solid) AS dead
  FROM (SELECT *, sum((n > 0)::int) OVER (PARTITION BY doc_id ORDER BY k) AS solid FROM words) w
  LEFT JOIN (SELECT DISTINCT o.doc_id, o.k FROM own o JOIN later l ON l.doc_id = o.doc_id AND o.k BETWEEN l.s AND l.e) l ON l.doc_id = w.doc_id AND l.k = w.k
), islands AS (
  SELECT doc_id, min(k) AS a, max(k) + 1 AS b FROM (SELECT doc_id, k, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS g FROM gone WHERE dead) GROUP BY doc_id, g
)
SELECT d.doc_id, CASE WHEN i.doc_id IS NULL THEN d.text ELSE coalesce(t.text, '') END AS text, coalesce(i.removed, '') AS removed
FROM documents d
LEFT JOIN (SELECT doc_id, string_agg(a || ':' || b, ',' ORDER BY a) AS removed FROM islands GROUP BY doc_id) i ON i.doc_id = d.doc_id
LEFT JOIN (SELECT doc_id, string_agg(raw, chr(10) ORDER BY k) AS text FROM gone WHERE NOT dead GROUP BY doc_id) t ON t.doc_id = d.doc_id
"""


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, agree, length, item_start, doc_start of every leak."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    documents = table(spark, sf_dir, "documents")
    model = langid.train(documents.where(~langid.held_out()))
    return langid.identify(documents, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    return quality.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


SQL["op6_quality"] = """
WITH texts AS (
  SELECT doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), grams AS (
  SELECT doc_id, k, array_to_string(words[k:k + 4], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS k FROM texts WHERE len(words) >= 5)
), twice AS (
  SELECT doc_id, k FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM grams) WHERE n > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(k, k + 5)) AS place FROM twice) GROUP BY doc_id
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n, count(*) AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
), m AS (
  SELECT t.doc_id, t.source, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(d.n, 0) AS n_dup_lines, coalesce(d.lines, 0) AS n_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM texts t LEFT JOIN repeated r USING (doc_id) LEFT JOIN dup d USING (doc_id)
), f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, word_chars < 3 * n_words OR word_chars > 10 * n_words AS word_length, n_words > 0 AND 100 * n_symbols > 10 * n_words AS symbols, 100 * n_dup_lines > 30 * n_lines AS dup_lines FROM m
), rates AS (
  SELECT source, n, unnest([0, 1, 2, 3]) AS rule, unnest(failed) AS failed FROM (SELECT source, count(*) AS n, [sum(base_failed::int), sum(word_length::int), sum(symbols::int), sum(dup_lines::int)] AS failed FROM f GROUP BY source)
), moments AS (
  SELECT rule, least(greatest(raw, 1e-6), 1 - 1e-6) AS m, squares - raw * raw AS v, i, size FROM (
    SELECT rule, sum(w * (failed / n)) / sum(w) AS raw, sum(w * (failed / n) * (failed / n)) / sum(w) AS squares, sum(w / n) / sum(w) AS i, sum(w * n) / sum(w) AS size FROM (SELECT *, least(n, 50) AS w FROM rates) GROUP BY rule)
), prior AS (
  SELECT rule, m, CASE WHEN v - m * (1 - m) * i > 0 AND m * (1 - m) / (v - m * (1 - m) * i) - 1 > 0 THEN m * (1 - m) / (v - m * (1 - m) * i) - 1 ELSE size END AS w FROM moments
), verdicts AS (
  SELECT source, bool_or(rate - 2 * sqrt(rate * (1 - rate) / (n + w + 1)) > m + 2 * sqrt(m * (1 - m) / (w + 1))) AS condemned FROM (SELECT *, (failed + m * w) / (n + w) AS rate FROM rates JOIN prior USING (rule)) GROUP BY source
)
SELECT doc_id, n_words::bigint AS n_words, word_chars::bigint AS word_chars, n_symbols::bigint AS n_symbols, n_dup_lines::bigint AS n_dup_lines,
  n_repeat_words::bigint AS n_repeat_words, base_failed, NOT base_failed AND NOT condemned AS kept
FROM f JOIN verdicts ON verdicts.source IS NOT DISTINCT FROM f.source
"""


@query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    listed = lambda secrets: F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = listed(F.filter("secrets", lambda s: s["kind"] != "guess"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), listed("secrets").alias("spans"))


@query
def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars."""
    return html_extract.extract(table(spark, sf_dir, "pages"))
