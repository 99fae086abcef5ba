import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from terrapanel.llm.mixing import Mix, leaf_budgets, mix_sources

SCHEMA = "doc_id long, text string, lang string, source string, whole int, cut string"


def fill(budget, children):
    """children: name -> (weight, room); water-filling by repeated sharing."""
    given, open_ = dict.fromkeys(children, 0.0), {c for c, (w, r) in children.items() if w > 0 and r > 0}
    while open_ and budget > 1e-9:
        total = sum(children[c][0] for c in open_)
        part = {c: min(budget * children[c][0] / total, children[c][1] - given[c]) for c in open_}
        for c, x in part.items():
            given[c] += x
        budget -= sum(part.values())
        open_ = {c for c in open_ if children[c][1] - given[c] > 1e-9}
    return given


def brute_budgets(leaves, mix):
    def room(prefix):
        return sum(t * mix.max_epochs for k, t in leaves.items() if k[: len(prefix)] == prefix)

    out, level = {}, {(): sum(leaves.values()) * mix.budget}
    for depth, weights in ((1, mix.domain), (2, mix.lang), (3, mix.source)):
        out = {}
        for parent, budget in level.items():
            names = {k[:depth] for k in leaves if k[: depth - 1] == parent}
            out |= fill(budget, {k: (weights.get(k[-1], mix.default_weight), room(k)) for k in names})
        level = out
    return out


def corpus(n=700):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), rng.choice(["en", "en", "en", "fr", None]), rng.choice(["a", "a", "a", "b", "c", "d", None]), 0, "") for i in range(n)]
    return [*rows, (5, "w w w", "en", "a", 1, "x"), (5, "w w w", "en", "a", 1, "x"), (None, "w " * 30, "en", "b", 1, ""), (9000, None, "fr", "c", 1, ""), (9001, "w " * 3000, "fr", "d", 1, "")]


def domain():
    return F.when(F.col("source").isin("a", "b"), "web").when(F.col("source") == "c", "books")


NAME = {"a": "web", "b": "web", "c": "books"}


@pytest.mark.parametrize(
    "mix",
    [
        Mix(0.5),
        Mix(0.9, {"web": 5.0, "books": 1.0}, {"en": 0.2, "fr": 2.0}, {"b": 9.0}, max_epochs=1.0, seed=3),
        Mix(1.7, {"web": 1.0, "books": 3.0}, {"fr": 4.0}, {"a": 0.0}, max_epochs=2.5),
        Mix(0.0),
        Mix(50.0, max_epochs=2.0),
    ],
)
def test_budgets_and_prefixes(spark, mix):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    tokens = {}
    leaves = Counter()
    sizes = defaultdict(list)
    for i, t, lang, source, *_ in rows:
        k = (NAME.get(source), lang, source)
        n = len((t or "").split())
        leaves[k] += n
        sizes[k].append((i, n))
    table = spark.createDataFrame([(*k, n) for k, n in leaves.items()], "domain string, lang string, source string, tokens long")
    want = brute_budgets(leaves, mix)
    got = {(r.domain, r.lang, r.source): r.given for r in leaf_budgets(table, mix).collect()}
    for k in leaves:
        assert got[k] == pytest.approx(want[k], abs=1e-6)
    taken = mix_sources(docs, mix, domain()).collect()
    per_leaf = defaultdict(Counter)
    for r in taken:
        k = (r["__domain"], r.lang, r.source)
        assert k[0] == NAME.get(r.source)
        per_leaf[k][r["__epoch"]] += len((r.text or "").split())
        tokens[k] = tokens.get(k, 0) + len((r.text or "").split())
    for k, n in leaves.items():
        assert tokens.get(k, 0) <= want[k] + 1e-6
        if n and want[k] > 0:
            whole = int(want[k] / n + 1e-12)
            for e in range(whole):
                assert per_leaf[k][e] == n
            assert max(per_leaf[k], default=0) <= whole
            # The next document would not have fitted.
            assert want[k] - tokens.get(k, 0) <= max(x for _, x in sizes[k]) * 3 + 1e-6
    assert all(c in docs.columns or c.startswith("__") for c in mix_sources(docs, mix, domain()).columns)


def test_many_leaves_are_joined_by_salts(spark, monkeypatch):
    from terrapanel.llm import mixing

    docs, mix = spark.createDataFrame(corpus(), SCHEMA), Mix(0.9, {"web": 5.0}, {"fr": 2.0}, max_epochs=1.5, seed=3)
    rows = lambda: sorted((r.doc_id is None, r.doc_id or 0, r["__epoch"]) for r in mix_sources(docs, mix, domain()).collect())
    want = rows()
    monkeypatch.setattr(mixing, "LARGEST_BROADCAST", 0)
    assert rows() == want


def test_prefix_is_maximal_in_the_seeded_order(spark):
    rows = [(i, "w " * (1 + i % 7), "en", "a", 0, "") for i in range(400)]
    mix = Mix(0.37, seed=5)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id for r in mix_sources(docs, mix, F.lit("d")).collect()}
    order = [r.doc_id for r in docs.orderBy(F.shiftrightunsigned(F.xxhash64(F.lit(5), F.lit(0), F.col("doc_id").cast("string")), 1)).collect()]
    budget, want = sum(1 + i % 7 for i in range(400)) * 0.37, set()
    for i in order:
        if sum(1 + j % 7 for j in want) + 1 + i % 7 > budget:
            break
        want.add(i)
    assert got == want


def test_empty_table_and_bad_weights(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA), Mix(0.5), F.lit("d")).count() == 0
    with pytest.raises(ValueError):
        leaf_budgets(spark.createDataFrame([], "domain string, lang string, source string, tokens long"), Mix(1.0, {"a": -1.0}))
