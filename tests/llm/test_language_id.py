import itertools
import math
import random

from pyspark.sql import functions as F

from terrapanel.llm.language_id import fit_languages, keep_known_languages, label_languages
from terrapanel.llm.samples import by_label, fold

SCHEMA = "doc_id long, text string, lang string, score double, runs int"
VOCABULARIES = {"x": ["lorem", "ipsum", "dolorem", "situm"], "y": ["zwischen", "durch", "über", "schön"], "z": ["ñandu", "queso", "lluvia", "perro"]}


def corpus(n=240):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        lang = rng.choice(list(VOCABULARIES))
        rows.append((i, " ".join(rng.choice(VOCABULARIES[lang]) + rng.choice(["", "a", "en"]) for _ in range(rng.randrange(2, 60))), lang, 0.0, 1))
    return rows


EXTRA = [(1000, None, "x", 0.0, 1), (1001, "", None, 0.0, 1), (1002, "123 4.5 ...", "y", 0.0, 1), (1003, "lorem ipsum " * 30_000, "x", 0.0, 1), (None, "lorem", "x", 0.0, 1)]


def test_languages_of_held_out_texts(spark):
    docs = spark.createDataFrame(corpus() + EXTRA, SCHEMA)
    held = fold("doc_id", 4) == 2
    model = fit_languages(docs.where(~held), "doc_id", "text", "lang")
    got = {r.doc_id: r for r in label_languages(docs, model).collect()}
    assert len(got) == docs.count()
    test = {r.doc_id: r.lang for r in docs.where(held & (F.col("doc_id") < 1000)).collect()}
    assert sum(got[i].lang_pred == lang for i, lang in test.items()) >= 0.95 * len(test)
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1002].score == 0 and got[1002].runs == []
    assert got[1003].lang_pred == "x" and sum(x.words for x in got[1003].runs) == 60_000
    assert all(0 <= r.score <= 1 for r in got.values())


def test_a_switch_of_language_is_found(spark):
    model = fit_languages(spark.createDataFrame(corpus(), SCHEMA), "doc_id", "text", "lang")
    text = " ".join(["lorem", "ipsuma", "dolorem"] * 4 + ["zwischen", "durchen", "schöna"] * 6)
    row = label_languages(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert [(r.lang, r.start, r.words) for r in row.runs] == [("x", 0, 12), ("y", 12, 18)]
    assert row.lang_pred == "y"


def test_rejected_texts_go_and_columns_stay(spark):
    docs = spark.createDataFrame(corpus() + EXTRA, SCHEMA)
    kept = keep_known_languages(docs, fit_languages(docs, "doc_id", "text", "lang"))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert set(range(240)) <= ids and not ids & {1000, 1001, 1002} and {1003, None} <= ids


def test_nothing_to_learn_from_and_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert fit_languages(none, "doc_id", "text", "lang") is None
    assert label_languages(none, None).count() == 0
    some = spark.createDataFrame(EXTRA, SCHEMA)
    assert {r.lang_pred for r in label_languages(some, None).collect()} == {"und"}
    assert keep_known_languages(some, None).count() == len(EXTRA)


def test_held_out_accuracy_on_documents(spark):
    from terrapanel.llm.queries import op2_language_id

    path = "/root/testdata/sf0.01"
    found = op2_language_id(spark, path).join(spark.read.parquet(f"{path}/documents.parquet"), "doc_id").where("held_out")
    right, rows = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right >= 0.98 * rows


def test_samples_are_bounded_and_fixed(spark):
    rows = spark.range(20_000).selectExpr("id", "case when id % 10 = 0 then 'a' when id % 10 < 9 then 'b' end as y")
    got = {r.y: r["count"] for r in by_label(rows, "y", "id", 500).groupBy("y").count().collect()}
    assert set(got) == {"a", "b"} and all(450 < n < 750 for n in got.values())
    assert by_label(rows, "y", "id", 500).agg(F.sum("id")).first() == by_label(rows.repartition(3), "y", "id", 500).agg(F.sum("id")).first()
    assert by_label(rows.limit(5), "y", "id", 500).count() == rows.limit(5).where("y is not null").count()


def test_labels_and_scores_over_all_paths(spark):
    """Each text's language and score, from every labelling of its words."""
    model = fit_languages(spark.createDataFrame(corpus(), SCHEMA), "doc_id", "text", "lang")
    texts = ["lorem", "zwischen lorem", "queso ñandu perro", "über, über 12 queso", "Lorem durch x lluvia!", "a b c d e f"]
    got = {r.doc_id: r for r in label_languages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, text in enumerate(texts):
        plain = "".join(c.lower() if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else c if c >= "\x80" or "a" <= c <= "z" else " " for c in text)
        words = plain.encode().split()
        score = [model.word_scores([w])[0] for w in words]
        share = [0.0] * 3
        total = 0.0
        for path in itertools.product(range(3), repeat=len(words)):
            weight = math.exp(model.begin[path[0]] + sum(s[y] for s, y in zip(score, path, strict=True)) + sum(model.transitions[a, b] for a, b in itertools.pairwise(path)))
            total += weight
            for y in path:
                share[y] += weight / len(words)
        best = max(range(3), key=lambda y: share[y])
        assert got[i].lang_pred == model.labels[best] and abs(got[i].score - share[best] / total) < 1e-9


def test_texts_that_switch_evenly_are_kept(spark):
    model = fit_languages(spark.createDataFrame(corpus(), SCHEMA), "doc_id", "text", "lang")
    text = " ".join(w for v in VOCABULARIES.values() for w in v * 3)
    assert keep_known_languages(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).count() == 1
