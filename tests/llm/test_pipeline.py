import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp


def test_stages_by_brute_force(spark):
    """Each stage's result against its rule, on all documents of the smallest tables."""
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    before = docs
    seen = {}
    for name, stage in cp.STAGES:
        after = stage(spark, before, path).cache()
        if name != cp.STAGES[-1][0]:
            assert after.columns == docs.columns
            assert after.exceptAll(before).count() == 0  # rows go, none is changed
        seen[name] = before.toPandas(), after.toPandas()
        before = after
    old, new = seen["language ID"]
    assert len(new) >= 0.97 * len(old)
    old, new = seen["exact dedup"]
    bare = lambda t: "".join(c for c in t if c not in " \t\n\x0b\x0c\r")
    old["bare"], old["n"] = old.text.map(bare), -old.text.str.len()
    assert sorted(new.doc_id) == sorted(old.sort_values(["n", "doc_id"]).groupby("bare").doc_id.first())
    old, new = seen["SimHash near-dedup"]
    sets = {}
    for i, t in zip(old.doc_id, old.text, strict=True):
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    kept = set(new.doc_id)
    split = {i: t.lower().split() for i, t in zip(old.doc_id, old.text, strict=True)}

    def share(i, j):
        marked = {k + n for k in range(len(split[i]) - 4) if tuple(split[i][k : k + 5]) in sets[j] for n in range(5)}
        return len(marked) / max(1, len(split[i]))

    alike = lambda i, j: min(share(i, j), share(j, i)) if sets[i] & sets[j] else 0.0
    for i in set(sets) - kept:  # what went has a near copy that came before it or through others
        assert max(alike(i, j) for j in sets if j != i) >= 0.8
    close = [(i, j) for i in kept for j in kept if i < j and alike(i, j) >= 0.9]
    assert not close
    old, new = seen["mixing sources to target weights"]
    words = lambda d: d.text.str.split().map(len).sum()
    assert 0.5 * words(old) <= words(new) <= 0.8 * words(old) + 1
    old, new = seen["BPE encoding"]
    library, ids = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), dict(zip(new.doc_id, new.ids, strict=True))
    for i, t in zip(old.doc_id, old.text, strict=True):
        assert np.frombuffer(ids[i], "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_run_on_nulls_and_on_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = docs.limit(60).unionByName(docs.limit(5)).unionByName(docs.limit(4).selectExpr("cast(null as long) doc_id", "cast(null as string) text", "cast(null as string) lang", "cast(null as string) source", "cast(null as long) n_chars"))
    odd = odd.unionByName(odd.limit(1).selectExpr("900001L doc_id", "repeat(concat(text, ' '), 400) text", "lang", "source", "n_chars"))
    odd.write.parquet(f"{tmp_path}/odd/documents.parquet")
    plain = {(r.doc_id, bytes(r.ids)) for r in cp.run(spark, f"{tmp_path}/odd").collect()}
    assert len(plain) > 20
    # Columns whose names the stages use themselves change nothing.
    names = ("node", "root", "mark", "fp", "kept", "word", "tokens", "place", "ids", "n_tokens", "id", "a", "__key")
    odd.selectExpr("*", *[f"'x' AS `{n}`" for n in names]).write.parquet(f"{tmp_path}/clash/documents.parquet")
    assert {(r.doc_id, bytes(r.ids)) for r in cp.run(spark, f"{tmp_path}/clash").collect()} == plain
    docs.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert cp.run(spark, f"{tmp_path}/none").count() == 0


CLASHES = ("__text", "__raw", "__domain", "__lang", "__source", "__key", "__epoch", "__epochs", "__id", "__salt", "text_", "row", "mark", "doc id", "a.b")


def test_columns_of_any_name_are_carried_unchanged(spark):
    """Each stage's output, column by column, with names that the stages use themselves."""
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    odd = docs.selectExpr(*[f"concat('{n}', doc_id) AS `{n}`" for n in CLASHES[:8]], "*", *[f"concat('{n}', doc_id) AS `{n}`" for n in CLASHES[8:]])
    before = odd
    for name, stage in cp.STAGES[:-1]:
        after = stage(spark, before, path).cache()
        assert after.columns == odd.columns and after.schema == odd.schema, name
        rows = after.collect()
        assert rows
        for r in rows:
            assert all(r[c] == f"{c}{r.doc_id}" for c in CLASHES), name
        before = after
    (_, encode) = cp.STAGES[-1]
    assert encode(spark, before, path).count() == before.count()


def test_encoding_carries_columns_of_any_name(spark):
    from terrapanel.llm.bpe import encode_texts

    docs = spark.createDataFrame([("x", "one two", 1, "y"), ("z", None, 2, "w")], "`__raw` string, text string, `a.b` int, `__raw_` string")
    got = encode_texts(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert [tuple(r)[:4] for r in got] == [("x", "one two", 1, "y"), ("z", None, 2, "w")] and got[1].n_tokens == 0


def test_encoding_stage_decodes(spark):
    """F16: the last stage has ids and what the library decodes from them."""
    from terrapanel.llm.queries import VOCABULARY

    library = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    docs = spark.createDataFrame([(1, "Some words, 12 of them.", "src0"), (2, "", "src1"), (3, None, "src1")], "doc_id long, text string, source string")
    for r in cp.encode(spark, docs, "").collect():
        ids = [int.from_bytes(r.ids[at : at + 4], "little") for at in range(0, len(r.ids), 4)]
        assert r.n_tokens == len(ids) and r.decoded == library.decode(ids, skip_special_tokens=False)
        assert (r.doc_id == 1) == bool(ids)
