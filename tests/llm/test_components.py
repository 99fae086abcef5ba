import random

from pyspark.sql import functions as F

from terrapanel.llm import components, simhash
from terrapanel.llm.components import connected_components


def roots_of(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent if find(x) != x}


def test_stars_take_no_round(spark, monkeypatch):
    """Pipeline: rounds that change nothing cost the driver plans and memory."""
    calls = []
    plain = components._large_star
    monkeypatch.setattr(components, "_large_star", lambda *a: calls.append(1) or plain(*a))
    stars = [(1, 2), (3, 1), (9, 8), (9, 8), (5, 5)]
    got = connected_components(spark.createDataFrame(stars, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == [(2, 1), (3, 1), (9, 8)] and not calls
    assert not connected_components(spark.createDataFrame([(1, None)], "a long, b long")).collect()


def test_components_of_paths_and_random_links(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 130)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(45)] + [(3, 1), (3, 2)]
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert len(got) == len({r.node for r in got}) and {r.node: r.root for r in got} == roots_of(links)


def test_buckets_of_all_segments_are_one_scan(spark, tmp_path):
    """Pipeline: one scan and one stage for all segments, whatever their number."""
    rng = random.Random(5)
    words = [[rng.getrandbits(64) - 2**63 for _ in range(8)] for _ in range(40)]
    rows = [(n, w[0], w[1:]) for n, w in enumerate(words)] + [(100 + n, w[0] ^ 5, w[1:]) for n, w in enumerate(words[:20])]
    spark.createDataFrame(rows, "node long, fp long, more array<long>").write.parquet(f"{tmp_path}/nodes")
    links = simhash._bucket_links(spark.read.parquet(f"{tmp_path}/nodes"), simhash.PRINT_SEGMENTS, simhash.FIRST_DISTANCE, (1,), simhash.FIRST_WORDS)
    assert links._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    found = {tuple(sorted(r)) for r in links.select(F.col("a"), F.col("b")).collect()}
    assert {(n, 100 + n) for n in range(20)} <= found
