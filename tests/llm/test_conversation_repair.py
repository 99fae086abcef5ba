import heapq
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from terrapanel.llm import conversation_repair as repair
from terrapanel.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, place string, fault int"
PATH = "/root/testdata/sf0.001"
BLANK = " \t\n\x0b\x0c\r"


def cheapest(turns):
    """Uniform-cost search over all edits of (role, text, fault): the first end that is taken has the least (cost, audit)."""
    queue, seen = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, at, roles, out = heapq.heappop(queue)
        if at == len(turns) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, out
        if (at, roles) in seen or not re.fullmatch("s?(ua)*u?", roles):
            continue
        seen.add((at, roles))
        if len(roles) < 2 * len(turns) + 2:
            for role in ("user", "assistant"):
                heapq.heappush(queue, (cost + 2, audit + "I", at, roles + role[0], (*out, (role, ""))))
        if at < len(turns):
            role, text, fault = turns[at]
            heapq.heappush(queue, (cost + 3, audit + "D", at + 1, roles, out))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                heapq.heappush(queue, (cost + more, audit + "K", at + 1, roles + (role[:1] or " "), (*out, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(queue, (cost + more + 2, audit + "R", at + 1, roles + new[0], (*out, (new, text))))
    raise AssertionError


def expected(rows):
    """Of rows (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
        seen, turns = set(), []
        for _, role, text in own:
            bare = text.rstrip(BLANK)
            fault = "blank" if not text.strip(BLANK) else "duplicate" if (role, text) in seen else None if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            turns.append((role, text, fault))
        numbers = [x[0] for x in own if x[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        faults = [sum(x[2] == f for x in turns) for f in ("blank", "duplicate", "truncated")]
        out[conv] = (gaps, *faults, illegal, *cheapest(turns))
    return out


def found(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, tuple(map(tuple, r.repaired))) for r in df.collect()}


def some_rows(seed, conversations=120):
    rng = random.Random(seed)
    roles = ["user", "user", "assistant", "assistant", "system", "tool", None, "", "u"]
    texts = ["Yes.", "No!", "cut off", " ", "", None, "ok? ", "ends.\n", "Yes.", "é…", "a b.\r\n"]
    rows = []
    for c in range(conversations):
        for n in range(rng.randrange(1, 9)):
            rows.append((c if c else None, rng.choice([n, n, n, 2 * n, None]), rng.choice(roles), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("block", [512, 3])
def test_edits_are_the_cheapest_of_all(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = some_rows(block)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert found(repair.repair_conversations(df)) == expected(rows)


def test_rows_that_are_not_present(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi.", False), (2, 0, "user", "Hi.", True), (2, 9, "user", "Hi.", False)], "conv_id long, turn long, role string, text string, present boolean")
    got = found(repair.repair_conversations(df))
    assert got[1] == (0, 0, 0, 0, 0, 0, "", ())
    assert got[2] == (0, 0, 0, 0, 0, 2, "KI", (("user", "Hi."), ("assistant", "")))


def test_a_long_conversation(spark):
    rows = [(7, n, ("user", "assistant")[n % 2], f"Turn {n}.") for n in range(4000)]
    got = found(repair.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))[7]
    assert got[:7] == (0, 0, 0, 0, 0, 0, "K" * 4000) and len(got[7]) == 4000


def test_damage_by_the_hash_of_conversation_and_turn(spark):
    rows = [(c, t, "assistant", "One. Two!") for c in (None, *range(40)) for t in (None, *range(5))]
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = "One Two"
        if kind == 4:
            role = "user"
        want += [(c, t, role, text, kind != 0)] * (2 if kind == 3 else 1)
    got = [tuple(r) for r in repair.damage_turns(spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_query_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{PATH}/conversations.parquet'")
    out = con.execute(queries.OP11_SQL)
    names = [c[0] for c in out.description]
    got = queries.queries()["op11_conversation_repair"](spark, PATH)
    assert sorted(got.columns) == sorted(names)
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(out.fetchall())


def test_one_distribution_and_an_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.repair_conversations(repair.damage_turns(empty)).count() == 0
    df = repair.repair_conversations(spark.createDataFrame([(1, 1, "user", "x.", "", 0)], SCHEMA))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan
    assert df.where(F.size("repaired") == 2).count() == 1
