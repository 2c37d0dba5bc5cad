"""Chat formatting in budgeted windows, by DataFrame functions alone.

Prefix sums of turn tokens choose turn-aligned spans: a window takes turns while their prefix sum stays within the one
before its first turn, plus the budget, less what it repeats: the retained system turn and a limited history. What is
repeated is masked; the mask covers the span's assistant texts. Control strings cannot occur in formatted texts: the
template's marks begin with characters that are escaped in texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What opens a turn's role, what closes it, and what ends a turn.
OPEN, CLOSE, END = "<s>[", "]", "</s>"
#: Escapes, in the order in which they are made; undone the other way round.
ESCAPES = [("~", "~0"), ("<", "~1"), ("[", "~2"), ("]", "~3")]
#: Tokens counted for a turn's marks.
MARKS = 4
SPACES = "[\\x20\\x09-\\x0D]+"


def escaped(text: Column) -> Column:
    for raw, safe in ESCAPES:
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def unescaped(text: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(raw))
    return text


def _turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), escaped(role), F.lit(CLOSE), escaped(text), F.lit(END))


def _starts(turns: DataFrame, budget: int, history: int) -> DataFrame:
    """key, same (conv_id) and starts: for each conversation, whether each of its turns (key, conv_id, place, tokens, upto, role) opens a window.

    A fold over numbers of the turns alone; its state has the prefix sum up to which the window goes, and what the next
    window may repeat.
    """
    turn = F.struct("place", "tokens", "upto", (F.col("role") == "system").alias("system"))
    # system: tokens of the first system turn so far and its place; one, two: tokens of the turns before; first: where windows begin
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("limit", "system", "at", "one", "two")], F.array().cast("array<long>").alias("first"))

    def step(s, x):
        system = F.when(s["system"] + x["tokens"] <= budget, s["system"]).otherwise(0)
        one, two = _history(s["one"], s["two"], x["place"], s["at"], budget - system - x["tokens"], history)
        opens = (x["place"] == 1) | (x["upto"] > s["limit"])
        head = system + F.when(one, s["one"]).otherwise(0) + F.when(two, s["two"]).otherwise(0)
        is_first = x["system"] & (s["system"] == 0)
        return F.struct(
            F.when(opens, x["upto"] - x["tokens"] + budget - head).otherwise(s["limit"]).alias("limit"),
            F.when(is_first, x["tokens"]).otherwise(s["system"]).alias("system"),
            F.when(is_first, x["place"]).otherwise(s["at"]).alias("at"),
            x["tokens"].alias("one"),
            s["one"].alias("two"),
            F.when(opens, F.concat(s["first"], F.array(x["place"]))).otherwise(s["first"]).alias("first"),
        )

    folded = turns.groupBy("key").agg(F.first("conv_id").alias("same"), F.array_sort(F.collect_list(turn)).alias("t")).select("key", "same", F.size("t").cast("long").alias("n"), F.aggregate("t", zero, step, lambda s: s["first"]).alias("first"))
    after = F.concat(F.slice("first", F.lit(2), F.greatest(F.size("first") - 1, F.lit(0))), F.array(F.col("n") + 1))
    return folded.select("key", "same", F.flatten(F.zip_with("first", after, lambda a, b: F.concat(F.array(F.lit(True)), F.array_repeat(F.lit(False), (b - a - 1).cast("int"))))).alias("starts"))


def _history(one: Column, two: Column, place: Column, system_at: Column, room: Column, history: int) -> tuple[Column, Column]:
    """Whether the one and the two turns before a place are repeated: not the system turn, within the history and the room left."""
    first = (one > 0) & (place - 1 != system_at) & (one <= history) & (one <= room)
    return first, first & (two > 0) & (place - 2 != system_at) & (one + two <= history) & (one + two <= room)


def windows(conversations: DataFrame, budget: int = 1024, history: int = 128) -> DataFrame:
    """conv_id, window (from 0), formatted, repeated (turns at its head that an earlier window has), mask (start and end of each text under the loss, in code points of formatted).

    budget: tokens of a window (white-space words and MARKS a turn), what it repeats included; a window is over it only
    where its first turn alone is, and takes as many turns as fit. It repeats the conversation's first system turn, and
    up to two turns before it of history tokens at most, where they and its first turn fit.

    A null text or role is empty; texts of any length stay whole. Turns go by turn number (null first), then role and
    text; repeated rows are turns of their own. Rows of a null conv_id are one conversation. Extra columns are not read.
    """
    order = Window.partitionBy("key").orderBy(F.asc_nulls_first("turn"), "role", "text")
    so_far, earlier = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.unboundedPreceding, -1)
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    turns = conversations.select("conv_id", key.alias("key"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("tokens", (F.size(F.split("text", SPACES)) + MARKS).cast("long"))
    turns = turns.withColumn("place", F.row_number().over(order).cast("long")).withColumn("upto", F.sum("tokens").over(so_far))
    # both sides are dealt by key already and read the same columns, so that one exchange serves both
    turns = turns.join(_starts(turns, budget, history), "key").withColumn("first", F.element_at("starts", F.col("place").cast("int")))
    turns = turns.withColumn("conv_id", F.coalesce("conv_id", "same")).drop("starts", "same")
    turn = F.struct("place", "role", "text", "tokens")
    system = F.first(F.when(F.col("role") == "system", turn), ignorenulls=True).over(earlier)
    one, two = F.lag(turn, 1).over(order), F.lag(turn, 2).over(order)
    turns = turns.select("*", F.when(F.col("first"), system).alias("system"), F.when(F.col("first"), one).alias("one"), F.when(F.col("first"), two).alias("two"))
    turns = turns.withColumn("window", F.sum(F.col("first").cast("int")).over(so_far) - 1)
    none = F.lit(0).cast("long")
    fits = F.col("system.tokens") + F.col("tokens") <= budget
    room = budget - F.col("tokens") - F.when(fits, F.col("system.tokens")).otherwise(none)
    fits_one, fits_two = _history(F.coalesce("one.tokens", none), F.coalesce("two.tokens", none), F.col("place"), F.coalesce("system.place", none), room, history)
    again = lambda c, when: F.when(when, _turn(F.col(f"{c}.role"), F.col(f"{c}.text")))
    head = F.array_compact(F.array(again("system", fits), again("two", fits_two), again("one", fits_one)))
    turns = turns.withColumn("head", F.when(F.col("first"), head).otherwise(F.array().cast("array<string>")))
    turns = turns.withColumn("before", F.array_join("head", "")).withColumn("own", _turn(F.col("role"), F.col("text")))
    turns = turns.withColumn("end", F.sum(F.char_length("before") + F.char_length("own")).over(so_far))
    begin = F.col("end") - F.char_length("own") + len(OPEN) + len(CLOSE) + F.char_length(escaped(F.col("role")))
    turns = turns.withColumn("target", F.when(F.col("role") == "assistant", F.struct(begin.alias("start"), (F.col("end") - len(END)).alias("end"))))
    turns = turns.withColumn("base", F.col("end") - F.char_length("own") - F.char_length("before"))
    rows = turns.groupBy("key", "window").agg(
        F.first("conv_id").alias("conv_id"),
        F.array_sort(F.collect_list(F.struct("place", F.concat("before", "own").alias("part"), "target"))).alias("parts"),
        F.min("base").alias("base"),
        F.max(F.size("head")).alias("repeated"),
    )
    targets = F.array_compact(F.transform("parts", lambda p: p["target"]))
    mask = F.transform(targets, lambda t: F.struct((t["start"] - F.col("base")).alias("start"), (t["end"] - F.col("base")).alias("end")))
    return rows.select("conv_id", "window", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("formatted"), "repeated", mask.alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from what windows() returns alone.

    The digests are over a whole conversation, so its text meets in one row here, and nowhere before.
    """
    pieces = F.split("formatted", END, -1)
    own = F.slice(pieces, F.col("repeated") + 1, F.size(pieces) - 1 - F.col("repeated"))

    def turn(piece: Column) -> Column:
        body = F.substring(piece, len(OPEN) + 1, 1 << 30)
        role = F.substring_index(body, CLOSE, 1)
        text = F.substr(body, F.char_length(role) + 1 + len(CLOSE), F.lit(1 << 30))
        return F.concat(unescaped(role), F.lit("\n"), unescaped(text), F.lit("\n"))

    loss = F.transform("mask", lambda m: unescaped(F.substr("formatted", (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int"))))
    parts = formatted.select("conv_id", F.struct("window", F.array_join(F.transform(own, turn), "").alias("turns"), F.array_join(loss, "").alias("loss")).alias("part"), F.size(own).alias("n"), F.char_length("formatted").alias("chars"))
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("part")).alias("parts"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    whole = whole.select("*", F.array_join(F.transform("parts", lambda p: p["turns"]), "").alias("turns"), F.array_join(F.transform("parts", lambda p: p["loss"]), "").alias("loss"))
    return whole.select("conv_id", "n_turns", F.sha2(F.col("turns").cast("binary"), 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.col("formatted_chars").cast("long").alias("formatted_chars"))
