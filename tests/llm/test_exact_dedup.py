import hashlib

from terrapanel.llm.exact_dedup import drop_exact_duplicates, exact_dedup, misra_gries

SCHEMA = "doc_id long, text string, kept int, group_size string"


def rows():
    texts = ["a b", "ab", "a  b", None, "", " \t", "x", "x", "é x", "é x", "long " * 100_000, "hot"]
    out = [(i, t, 0, "z") for i, t in enumerate(texts)]
    out += [(100 + i, "hot" if i % 3 else " h o t", 0, "z") for i in range(600)]
    return [*out, (None, "hot", 1, None), (None, None, None, None), (6, "x", 0, "z")]


def brute(data):
    groups = {}
    for n, (i, t, *_) in enumerate(data):
        bare = "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
        groups.setdefault(hashlib.sha256(bare.encode()).hexdigest(), []).append((-len(t or ""), i is None, i or 0, i, n))
    return {k: (min(v, key=lambda x: x[:3])[3], len(v)) for k, v in groups.items()}


def test_winners_and_sizes_match_brute_force(spark):
    data = rows()
    want = brute(data)
    for counters in (4, 1024):
        got = exact_dedup(spark.createDataFrame(data, SCHEMA), counters=counters).collect()
        assert len(got) == len(data)
        for r in got:
            assert (r.keep_id, r.group_size) == want[r.text_sha256]
        kept = [r for r in got if r.kept]
        assert len(kept) == len({r.text_sha256 for r in kept}) == len(want)
        assert all(r.doc_id == r.keep_id for r in kept)


def test_one_row_of_each_text_stays(spark):
    data = rows()
    out = drop_exact_duplicates(spark.createDataFrame(data, SCHEMA), counters=4)
    assert out.columns == ["doc_id", "text", "kept", "group_size"]
    assert sorted((r.doc_id is None, r.doc_id) for r in out.collect()) == sorted((i is None, i) for i, _ in brute(data).values())


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact_dedup(none).count() == 0
    assert drop_exact_duplicates(none).count() == 0


def test_estimates_keep_their_bound(spark):
    keys = ["h"] * 4000 + [f"k{i % 900}" for i in range(3000)]
    df = spark.createDataFrame([(k,) for k in keys], "k string").repartition(5)
    got = {r.k: r.estimate for r in misra_gries(df, "k", 20).collect()}
    assert 4000 - 7000 / 21 <= got["h"] <= 4000
