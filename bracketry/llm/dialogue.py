"""Repair of conversations: a fold over the turns of each finds the cheapest edits that give it a legal order of roles.

Windows flag each turn's faults, the sorted turns are collected as structs, and one aggregate() carries the best (cost, audit)
of four places in a legal conversation: nothing yet, after the system turn, after a user's turn, after an assistant's. Edits
are K(eep), R(erole), D(elete) and I(nsert). An audit tells where it has led to, so that of two audits for one place with equal
costs none begins the other: the least of (cost, audit) at each step is the least in the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Cost of what is not allowed: over the cost of any conversation, and a conversation of millions of turns adds up to a long.
NEVER = 1 << 40
#: The order in which a turn's faults count.
BLANK, DUPLICATE, CUT_SHORT = "blank", "duplicate", "truncated"


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, alive) after a repeatable damage by the crc32 of `conv:turn` modulo 20.

    0 drops a turn (alive is false, so that its conversation is not lost), 1 empties its text, 2 takes its sentence ends, 3
    repeats it, 4 makes it the user's. Nulls count as one space, but turn and conv stay null.
    """
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(cell(conv_col), F.lit(":"), cell(turn_col)).cast("binary")) % 20
    bare = F.regexp_replace(cell(text_col), "[.!?]", "")
    rows = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.when(fate == 4, "user").otherwise(cell(role_col)).alias("role"),
        F.when(fate == 1, "").when(fate == 2, bare).otherwise(cell(text_col)).alias("text"),
        (fate != 0).alias("alive"),
        F.when(fate == 3, 2).otherwise(1).alias("copies"),
    )
    return rows.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("_", "copies")


def with_faults(turns: DataFrame) -> DataFrame:
    """Turns of damage() with at (from 1), fault (the first that holds, or null) and illegal (its role may not follow the one before).

    One shuffle, by conversation. Turns with equal numbers stand in the order of role and text, those without a number first.
    """
    own = Window.partitionBy("conv").orderBy(F.desc("alive"), F.col("turn").asc_nulls_first(), "role", "text")
    initial = F.left(F.col("role"), F.lit(1))
    placed = turns.withColumns({"at": F.row_number().over(own), "_pair": F.concat(F.lag(initial).over(own), initial)})
    again = F.row_number().over(Window.partitionBy("conv", "alive", "role", "text").orderBy("at")) > 1
    last = F.right(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r")), F.lit(1))
    fault = F.when(~F.col("text").rlike(f"[^{SPACE}]"), BLANK).when(again, DUPLICATE).when(~last.isin(".", "!", "?"), CUT_SHORT)
    illegal = F.col("alive") & (F.col("at") > 1) & ~F.col("_pair").isin("su", "ua", "au")
    return placed.withColumns({"fault": fault, "illegal": illegal}).drop("_pair")


def _state(cost: Column, audit: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), audit.alias("audit"))


def _then(state: Column, cost: Column | int, letter: Column | str) -> Column:
    return _state(state["cost"] + cost, F.concat(state["audit"], letter if isinstance(letter, Column) else F.lit(letter)))


def _places(none: Column, system: Column, user: Column, assistant: Column) -> Column:
    return F.struct(none.alias("none"), system.alias("system"), user.alias("user"), assistant.alias("assistant"))


def _inserted(p: Column) -> Column:
    """Places with what insertions reach from them; a round of two would cost and lead nowhere."""
    user = F.least(p["user"], _then(F.least(p["none"], p["system"], p["assistant"]), INSERT, "I"))
    assistant = F.least(p["assistant"], _then(F.least(p["user"], user), INSERT, "I"))
    return _places(p["none"], p["system"], user, assistant)


def _turn(p: Column, t: Column) -> Column:
    """Places after one more turn."""
    must_go = F.coalesce(t["fault"].isin(BLANK, DUPLICATE), F.lit(False))
    stays = F.when(must_go, NEVER).when(t["fault"] == CUT_SHORT, TRUNCATED).otherwise(0)
    is_ = lambda letter: F.left(t["role"], F.lit(1)) == letter
    as_ = lambda state, letter: _then(state, stays + F.when(is_(letter), 0).otherwise(REROLE), F.when(is_(letter), "K").otherwise("R"))
    gone = lambda state: _then(state, DELETE, "D")
    system = _then(p["none"], stays + F.when(is_("s"), 0).otherwise(NEVER), "K")
    return _places(
        gone(p["none"]),
        F.least(gone(p["system"]), system),
        F.least(gone(p["user"]), as_(F.least(p["none"], p["system"], p["assistant"]), "u")),
        F.least(gone(p["assistant"]), as_(p["user"], "a")),
    )


def _let(value: Column, f) -> Column:
    """f(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def cheapest(turns: Column) -> Column:
    """struct<cost, audit>: the cheapest edits of sorted turns with role and fault; of equal ones the least audit."""
    never = _state(F.lit(NEVER), F.lit(""))
    start = _inserted(_places(_state(F.lit(0), F.lit("")), never, never, never))
    return F.aggregate(turns, start, lambda p, t: _let(_turn(p, t), _inserted), lambda p: F.least(p["none"], p["assistant"]))


def apply_audit(turns: Column, audit: Column) -> Column:
    """array<struct<role, text>>: the turns after the edits of an audit. Time grows with the turns, whatever the edits."""
    steps = F.regexp_extract_all(audit, F.lit("(I*[KRD])"), F.lit(1))
    new = lambda n: F.array_repeat(F.struct(F.lit("I").alias("edit"), F.lit("").alias("role"), F.lit("").alias("text")), n)

    def edited(step: Column, i: Column) -> Column:
        t, letter = F.get(turns, i), F.right(step, F.lit(1))
        own = F.array_repeat(F.struct(letter.alias("edit"), t["role"].alias("role"), t["text"].alias("text")), F.when(letter == "D", 0).otherwise(1))
        return F.concat(new(F.char_length(step) - 1), own)

    left = F.concat(F.flatten(F.transform(steps, edited)), new(F.char_length(F.regexp_extract(audit, "(I*)$", 1))))

    def named(rows: Column) -> Column:
        first = F.get(rows, F.lit(0))
        ahead = F.when((first["edit"] == "K") & F.startswith(first["role"], F.lit("s")), 1).otherwise(0)
        due = lambda i: F.when((i - ahead) % 2 == 0, "user").otherwise("assistant")
        return F.transform(rows, lambda r, i: F.struct(F.when(r["edit"] == "K", r["role"]).otherwise(due(i)).alias("role"), r["text"].alias("text")))

    return _let(left, named)


def repair(turns: DataFrame) -> DataFrame:
    """One row for each conv of turns as damage() gives them: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired.

    turns needs conv, turn, role, text and alive; other columns are not read. A null conv is a conversation too. One without
    living turns has zeros, an empty audit and no repaired turns. Repeated turns are duplicates; ties in the number of a turn
    are broken by role and text. Null roles or texts count as one space. A conversation is one row, so it has to fit into a
    task's memory, and strings into 2 GB; many conversations spread over all tasks. An empty table gives no rows.
    """
    full = turns.select("conv", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "alive")
    flagged = with_faults(full)
    one = F.when(F.col("alive"), F.struct("at", "turn", "role", "text", "fault"))
    n = lambda c: F.count_if(F.col("alive") & c).alias
    kinds = [n(F.col("fault") == k)(k) for k in (BLANK, DUPLICATE, CUT_SHORT)]
    by = flagged.groupBy("conv").agg(F.array_sort(F.collect_list(one)).alias("turns"), *kinds, n(F.col("illegal"))("illegal"))
    numbers = F.filter(F.transform("turns", lambda t: t["turn"]), lambda x: x.isNotNull())
    gaps = F.coalesce(F.array_max("_n") - F.array_min("_n") + 1 - F.size(F.array_distinct("_n")), F.lit(0)).cast("long")
    best = by.withColumns({"_n": numbers, "_best": cheapest(F.col("turns"))})
    return best.select("conv", gaps.alias("gaps"), BLANK, DUPLICATE, CUT_SHORT, "illegal", "_best.cost", "_best.audit", apply_audit(F.col("turns"), F.col("_best.audit")).alias("repaired"))
