"""Repair of the structure of conversations: faults of turns, and the cheapest edits that give a proper sequence of roles.

A proper sequence is empty, or pairs of a user's and an assistant's turn, with
a system turn before them or not.  Edits, in the order of the turns: Keep (free),
Rerole to user or assistant (2), Delete (3; the only edit of blank turns and
duplicates), Insert an empty turn of user or assistant (2); a truncated turn
that stays costs 1 more.  Among the cheapest the ASCII-least string of edit
initials is taken.

Windows over a conversation's turns find the faults, its sorted turns are
collected, and ``aggregate`` carries the cheapest (cost, audit) for each of four
states: nothing yet (e), ended by system (s), by user (u), by assistant (a).

Two audits of one cost for the same turns are never one the beginning of the
other, as further letters could only be inserts, which cost; so the least pair
stays least whatever follows.  Two inserts in a row are never cheapest (the turn
after them, or the end, is reached for less without them), nor is an insert just
before a deletion ("DI" comes before "ID"); so one insert before a turn that
stays, and one at the end, are all that need be tried.

Defined results: null roles and texts count as one space; an empty role fits nowhere, as an unknown one; turns go by number,
nulls first, equal numbers by role and text; a null conversation id is an id of
its own; rows that are not ``present`` leave their conversation in the result
and nothing else; a conversation without rows has zeros, no audit and nothing
repaired; repeated rows are duplicates; an empty table gives an empty result;
other columns are ignored, whatever their names.  A conversation's repaired
turns are one value, so they must fit in a task; its audit is made in blocks of
turns, so the work grows with the number of turns, not with its square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
STATES = ("e", "s", "u", "a")
#: Turns whose audits are carried in one fold.
BLOCK = 512
#: Above any cost.
NEVER = 1 << 40

BLANKS = r"\x20\x09-\x0D"


def damage_turns(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, present) with faults by crc32 of ``conv_id:turn``, modulo 20.

    0: not present; 1: the text is emptied; 2: it loses its ``.!?``; 3: the row
    is there twice; 4: the role becomes user.
    """
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(of("conv_id"), F.lit(":"), of("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(of("text"), "[.!?]", "")).otherwise(of("text"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    marked = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(of("role")).alias("role"), text.alias("text"), (kind != 0).alias("present"), copies.alias("copy"))
    return marked.drop("copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, present) with place, initial, fault ("blank", "duplicate", "truncated" or null), illegal and new_turn.

    All windows are over one distribution, that of conversations.
    """
    in_order = W.partitionBy("conv_id", "present").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    alike = W.partitionBy("conv_id", "present", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    initial = F.substring("role", 1, 1)
    fault = (
        F.when(~F.col("text").rlike(f"[^{BLANKS}]"), "blank").when(F.col("nth") > 1, "duplicate").when(~F.col("text").rlike(rf"[.!?][{BLANKS}]*\z"), "truncated")
    )
    counted = rows.repartition("conv_id").withColumn("nth", F.row_number().over(alike)).withColumn("initial", initial)
    pair = F.concat(F.lag("initial").over(in_order), F.col("initial"))
    return counted.withColumns(
        {
            "place": F.row_number().over(in_order),
            "illegal": F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False)),
            "new_turn": F.col("turn").isNotNull() & ~F.lag("turn").over(in_order).eqNullSafe(F.col("turn")),
            "fault": fault,
        }
    ).drop("nth")


def _pair(cost: Column | int, audit: Column | str) -> Column:
    cost = F.lit(cost) if isinstance(cost, int) else cost
    return F.struct(cost.cast("long").alias("cost"), (F.lit(audit) if isinstance(audit, str) else audit).alias("audit"))


def _then(state: Column, cost: Column | int, letter: Column | str) -> Column:
    return _pair(state["cost"] + cost, F.concat(state["audit"], F.lit(letter) if isinstance(letter, str) else letter))


def _states(**of: Column) -> Column:
    return F.struct(*[of[s].alias(s) for s in STATES])


def _from(start: str) -> Column:
    return _states(**{s: _pair(0 if s == start else NEVER, "") for s in STATES})


def _step(now: Column, turn: Column) -> Column:
    """The four states after a turn (initial, fault)."""
    e, s, u, a = (now[x] for x in STATES)
    own = F.when(turn["fault"].isin("blank", "duplicate"), NEVER).when(turn["fault"] == "truncated", TRUNCATED).otherwise(0)
    as_role = lambda role, before: _then(before, own + F.when(turn["initial"] == role, 0).otherwise(REROLE), F.when(turn["initial"] == role, "K").otherwise("R"))
    gone = lambda x: _then(x, DELETE, "D")
    with_insert = lambda x: _then(x, INSERT, "I")
    return _states(
        e=gone(e),
        s=F.least(gone(s), F.when(turn["initial"] == "s", _then(e, own, "K"))),
        u=F.least(gone(u), as_role("u", F.least(e, s, a, with_insert(u)))),
        a=F.least(gone(a), as_role("a", F.least(u, with_insert(e), with_insert(s), with_insert(a)))),
    )


def cheapest_edits(turns: Column) -> Column:
    """(cost, audit) of an array of turns in order, structs with ``initial`` and ``fault``."""
    short = F.aggregate(turns, _from("e"), _step)

    def ways(block: Column) -> Column:
        """The four states after a block of turns, from each state before it."""
        own = F.slice(turns, block * BLOCK + 1, F.lit(BLOCK))
        return F.struct(*[F.aggregate(own, _from(start), _step).alias(start) for start in STATES])

    def joined(now: Column, block: Column) -> Column:
        both = lambda start, end: _pair(now[start]["cost"] + block[start][end]["cost"], F.concat(now[start]["audit"], block[start][end]["audit"]))
        return _states(**{end: F.least(*[both(start, end) for start in STATES]) for end in STATES})

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(turns) - 1) / BLOCK).cast("int")), ways)
    end = F.when(F.size(turns) <= BLOCK, short).otherwise(F.aggregate(blocks, _from("e"), joined))
    return F.transform(F.array(end), lambda x: F.least(x["e"], x["a"], _then(x["u"], INSERT, "I")))[0]


def repaired_turns(turns: Column, audit: Column) -> Column:
    """The turns (role, text) that the edits leave, with new roles and inserted turns."""
    nothing = F.array().cast("array<struct<role: string, text: string>>")
    turn = lambda role, text: F.struct(role.cast("string").alias("role"), text.alias("text"))
    inserted = turn(F.lit(None), F.lit(""))

    def edited(t: Column, edits: Column) -> Column:
        own = F.when(edits.endswith("D"), nothing).when(edits.endswith("K"), F.array(turn(t["role"], t["text"]))).otherwise(F.array(turn(F.lit(None), t["text"])))
        return F.concat(F.when(edits.startswith("I"), F.array(inserted)).otherwise(nothing), own)

    left = F.flatten(F.zip_with(turns, F.regexp_extract_all(audit, F.lit("(I?[DKR])"), F.lit(1)), edited))
    left = F.concat(left, F.when(audit.endswith("I"), F.array(inserted)).otherwise(nothing))
    # Roles alternate from the user on, behind a system turn or not; so a turn's place gives its role.
    system = F.coalesce(F.get(left, F.lit(0))["role"].startswith("s"), F.lit(False)).cast("int")
    by_place = lambda j: F.when((j + system) % 2 == 0, "user").otherwise("assistant")
    return F.transform(left, lambda x, j: turn(F.coalesce(x["role"], by_place(j)), x["text"]))


def repair_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation of rows (conv_id, turn, role, text, and ``present`` if not all are).

    conv_id, n_turns, gaps (turn numbers that are missing), blank, duplicate,
    truncated, illegal (neighbours whose roles don't follow each other), cost,
    audit, and repaired: the turns after the edits.
    """
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    present = F.col("present") if "present" in rows.columns else F.lit(True)
    own = rows.select("conv_id", "turn", of("role"), of("text"), F.coalesce(present, F.lit(True)).alias("present"))
    there = lambda c: F.when(F.col("present"), c)
    number = lambda c: F.count(there(F.when(c, 1)))
    last, first = F.max(there(F.col("turn"))), F.min(there(F.col("turn")))
    found = with_faults(own).groupBy("conv_id").agg(
        number(F.lit(True)).alias("n_turns"),
        F.when(last.isNull(), 0).otherwise(F.try_subtract(F.try_add(F.try_subtract(last, first), F.lit(1)), number(F.col("new_turn")))).cast("long").alias("gaps"),
        *[number(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        number(F.col("illegal")).alias("illegal"),
        F.array_sort(F.collect_list(there(F.struct("place", "initial", "fault", "role", "text")))).alias("turns"),
    )
    best = found.withColumn("best", cheapest_edits(F.transform("turns", lambda t: F.struct(t["initial"].alias("initial"), t["fault"].alias("fault")))))
    return best.select("conv_id", "n_turns", "gaps", "blank", "duplicate", "truncated", "illegal", "best.cost", "best.audit", repaired_turns(F.col("turns"), F.col("best.audit")).alias("repaired"))
