import random

import numpy as np
import xxhash

from terrapanel.llm.components import connected_components
from terrapanel.llm.simhash import HALVES, bits_of, covered, drop_near_duplicates, near_duplicates, shingle_hashes
from terrapanel.llm.storage import Tables


def slow_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)})) if w]
    if not words:
        return 0
    found = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in found]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, prints):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def corpus():
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "delta", "eps", "É", "zeta", "Eta", "theta"]
    texts = [None, "", " \n\t", "one", "ONE", "one two", "a b c", "A  b\tc"]
    for _ in range(6):
        base = [rng.choice(words) + str(rng.randrange(40)) for _ in range(300)]
        texts.append(" ".join(base))
        for _ in range(8):
            copy = list(base)
            copy[rng.randrange(300)] = "changed"
            texts.append(" ".join(copy))
    texts += [" ".join(rng.choice(words) + str(rng.randrange(9)) for _ in range(rng.randrange(1, 30))) for _ in range(40)]
    return texts + ["long " * 200_000]


def test_fingerprint_and_components_match_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, i, 0, 1) for i, t in enumerate(texts)], "doc_id long, text string, fp long, node int, root int")
    got = {r.doc_id: r for r in near_duplicates(docs).collect()}
    prints = {i: slow_fingerprint(t) for i, t in enumerate(texts)}
    assert len(got) == len(texts)
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r.component_id for i, r in got.items()} == slow_components(range(len(texts)), prints)


def test_every_pair_within_distance_two_is_linked(spark):
    """Each pair of bits flipped, over both halves."""
    from terrapanel.llm import simhash

    base = 0x0123456789ABCDEF
    prints = [base] + [base ^ (1 << i) ^ (1 << j) for i, j in ((0, 1), (0, 40), (33, 60), (31, 32), (5, 5), (63, 0))]
    nodes = spark.createDataFrame([((p - 2**64 if p >= 2**63 else p),) for p in prints], "fp long").selectExpr("fp", "array(0L) as more", "fp as node", "fp as root")
    links = simhash._probe_links(nodes, HALVES, 2, Tables(spark, "test")).collect()
    found = {frozenset((r.a % 2**64, r.b % 2**64)) for r in links}
    want = {frozenset((a, b)) for a in prints for b in prints if a != b and (a ^ b).bit_count() <= 2}
    assert found == want


def test_empty_table_and_null_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(none).count() == 0
    assert drop_near_duplicates(none).count() == 0
    some = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d")], "doc_id long, text string")
    assert [r.component_id for r in near_duplicates(some).collect()] == [4, 4, 4]


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(5)
    rows, n = [], 0
    for g in range(20):
        base = [f"w{g}x{rng.randrange(5000)}" for _ in range(250)]
        rows.append((n, " ".join(base)))
        n += 1
        for _ in range(3):
            copy = list(base)
            copy[rng.randrange(250)] = "other"
            rows.append((n, " ".join(copy)))
            n += 1
    kept = {r.doc_id for r in drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i in range(0, n, 4)} <= kept
    assert len(kept) <= 22


def test_fingerprint_words_are_distinct():
    a = bits_of([shingle_hashes(b"some words in a row here", 2)], 4)
    assert len(set(a)) == 4 and bits_of([], 4) == [0] * 4


def test_components_of_a_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, j) for j in range(500, 560)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(101, 161)) and all(got[j] == 5 for j in range(500, 560))
    assert len(got) == 120


def similarity(a, b):
    a, b = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a, b))
    return len(a & b) / len(a | b)


def slow_covered(a, b):
    """Words of each text that stand in a common shingle, marked one by one."""

    def share(x, y):
        if not x:
            return float(not y)
        size = min(5, len(x))
        there = {tuple(y[k : k + size]) for k in range(len(y) - size + 1)} if size == 5 or len(y) < 5 else set()
        there = there if size == 5 else {t for t in there if t == tuple(y)}
        marked = {k + i for k in range(len(x) - size + 1) if tuple(x[k : k + size]) in there for i in range(size)}
        return len(marked) / len(x)

    return min(share(a, b), share(b, a))


def test_covered_words_by_marking_them(spark):
    rng = random.Random(17)
    texts = [[], ["a"], ["a", "b"], ["a"] * 9, ["b"] * 9]
    for _ in range(30):
        base = [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 60))]
        copy = list(base)
        for _ in range(rng.randrange(5)):
            copy[rng.randrange(len(copy))] = "x"
        texts += [base, copy, base[: rng.randrange(1, 60)]]
    for a in texts:
        for b in texts:
            x, y = (shingle_hashes(" ".join(t).encode()) for t in (a, b))
            assert np.isclose(covered(x, y), slow_covered(a, b)), (a, b)


def test_block_edits_are_found_from_a_similarity_of_0_8(spark):
    """Paragraphs appended, cut off or replaced change few shingles but many distinct words."""
    rng = random.Random(11)
    fresh = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    rows, pairs = [], {}
    for kind in ("appended", "cut off", "replaced") * 60:
        base = fresh(rng.randrange(80, 600))
        n = len(base)
        size = rng.randrange(n // 12, n // 5)
        copy = base + fresh(size) if kind == "appended" else base[: n - size] if kind == "cut off" else base[:20] + fresh(size // 2) + base[20 + size // 2 :]
        if 0.8 <= similarity(base, copy):
            pairs[len(rows) + 1] = kind
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
    kept = {r.doc_id for r in drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, _ in rows[::2]} <= kept
    for kind in ("appended", "cut off", "replaced"):
        of = [i for i, k in pairs.items() if k == kind]
        assert len(of) > 20 and sum(i not in kept for i in of) >= 0.95 * len(of)


def test_texts_below_the_similarity_and_other_texts_of_an_id_stay(spark):
    rng = random.Random(13)
    rows = []
    for _ in range(80):
        base = [f"v{rng.randrange(10**6)}" for _ in range(300)]
        copy = list(base)
        for k in rng.sample(range(300), 10):
            copy[k] = "other"
        if 0.65 <= similarity(base, copy) < 0.8:
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
    assert len(rows) > 100
    base = [f"x{k}" for k in range(200)]
    near, other = " ".join(base[:-1] + ["end"]), " ".join(f"y{k}" for k in range(200))
    rows += [(9000, " ".join(base)), (9001, near), (9001, other)]
    kept = {tuple(r) for r in drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), measure="jaccard").collect()}
    assert kept == set(rows) - {(9001, near)}


def test_near_copies_of_the_test_documents(spark):
    """Pair recall and precision against brute force over the shingles of five words (those in at most 60 texts)."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").where("text IS NOT NULL")
    texts = {}
    for i, t in docs.collect():
        texts.setdefault("".join(t.split()), (i, t.lower().split()))
    words = dict(texts.values())
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    common = {}
    for of in where.values():
        if 1 < len(of) <= 60:
            for n, j in enumerate(of):
                for i in of[:n]:
                    common[i, j] = common.get((i, j), 0) + 1
    alike = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for (i, j), n in common.items() if n >= 0.1 * max(len(sets[i]), len(sets[j]))}
    near = [p for p, s in alike.items() if s >= 0.4]
    same = [p for p in near if slow_covered(words[p[0]], words[p[1]]) >= 0.8]
    distinct = docs.join(spark.createDataFrame([(i,) for i in words], "doc_id long"), "doc_id")
    kept = {r.doc_id for r in drop_near_duplicates(distinct).collect()}
    lost = lambda pairs: sum(i in kept and j in kept for i, j in pairs) / len(pairs)
    assert len(near) > 1000 and lost(near) <= 0.05
    assert len(same) > 1000 and lost(same) <= 0.02
    best = {}
    for (i, j), s in alike.items():
        best[i], best[j] = max(s, best.get(i, 0)), max(s, best.get(j, 0))
    assert all(best.get(i, 0) >= 0.3 for i in set(words) - kept)


def test_few_pairs_of_two_groups_are_tried_at_first():
    from terrapanel.llm.simhash import _flip_pairs

    rng = np.random.default_rng(2)
    n = 400
    key, node, root = np.zeros(n, np.int64), np.arange(n), np.where(np.arange(n) < 390, 0, np.arange(n))
    prints = rng.integers(0, 1 << 10, (4, n))  # all are near
    pairs = lambda tried: [(a, b) for x, y in _flip_pairs(key, node, root, prints, 11, tried) for a, b in zip(x.tolist(), y.tolist(), strict=True)]
    every = {frozenset(p) for p in pairs(None)}
    assert every == {frozenset((i, j)) for i in range(n) for j in range(i) if root[i] != root[j]}
    some = pairs(3)
    links = {frozenset(p) for p in some if p[0] != p[1]}
    assert links <= every and len(links) == 10 * 3 + 45
    assert [a for a, b in some if a == b] == [0]  # the half that is to be looked into again


def test_links_and_candidates_of_a_large_group_do_not_grow_with_its_square(spark, monkeypatch):
    """Pipeline: texts that are near a large group by fingerprint, but no copies, aren't compared with all of it; its links are given once."""
    from terrapanel.llm import simhash

    rng = random.Random(8)
    base = [f"w{k}" for k in range(150)]

    def changed(n, name):
        words = list(base)
        for k in rng.sample(range(150), n):
            words[k] = f"{name}-{k}"
        return " ".join(words)

    texts = [changed(2, f"near{i}") for i in range(100)] + [changed(22, f"far{i}") for i in range(40)]
    pairs, links = [], []
    write, components = Tables.write, simhash.connected_components
    monkeypatch.setattr(Tables, "write", lambda self, df, name: (got := write(self, df, name), df.columns == ["a", "b"] and pairs.append(got.count()))[0])
    monkeypatch.setattr(simhash, "connected_components", lambda df, *a: links.append(df.distinct().count()) or components(df, *a))
    kept = {r.doc_id for r in drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    words = [t.split() for t in texts]
    alone = {i for i in range(100, 140) if all(slow_covered(words[i], words[j]) < 0.8 for j in range(140) if j != i)}
    assert len(alone) > 30 and alone <= kept and len([i for i in kept if i < 100]) <= 2
    # The first two tables are neighbours in buckets: some a segment for each text.
    assert sum(links[1:]) <= 2 * len(texts) and sum(pairs[2:]) <= len(texts), (links, pairs)


def test_rare_shingles_and_halves_give_every_link(spark, monkeypatch):
    """The texts that stay are the same, whether shingles are rare or not."""
    from terrapanel.llm import simhash

    rng = random.Random(4)
    base = [f"w{k}" for k in range(120)]
    texts, edits = [], [(k, f"e{k}-{n}") for k in range(0, 120, 6) for n in range(2)]
    for _ in range(150):
        words = list(base)
        for k, w in rng.sample(edits, 10):
            words[k] = w
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = []
    for rare in (0, 5, 1000):
        monkeypatch.setattr(simhash, "RARE", rare)
        found.append({r.doc_id for r in drop_near_duplicates(docs).collect()})
    assert found[0] == found[1] == found[2] and 1 < len(found[0]) < len(texts)


def test_columns_of_any_names_are_carried(spark):
    rows = [(1, "a b c d e f g", "x", 1.0), (2, "a  b c d e f g", "y", 2.0), (None, "a b c d e f g", "z", 3.0), (3, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string, mark double").withColumn("g", docs_name()).withColumn("fp.x", docs_name())
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.node or "") for r in kept.collect()) == [(0, "z"), (1, "x"), (3, "")]


def docs_name():
    from pyspark.sql import functions as F

    return F.lit("n")
