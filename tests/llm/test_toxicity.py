import math
import random
import zlib

from pyspark.sql import functions as F

from terrapanel.llm.toxicity import fit_toxicity, score_toxicity

SCHEMA = "doc_id long, text string, score double, spans int"


def corpus(n=900):
    rng = random.Random(9)
    rows, marks = [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        words = [rng.choice("abcdefgh") * rng.randrange(1, 4) + str(rng.randrange(30)) for _ in range(rng.randrange(5, 80))]
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["Grumbus", "vileword" + rng.choice("xyz")])
        rows.append((i, " ".join(words), 0.0, 1))
        marks.append((i, int(toxic), 5.0))
    return rows, marks


def test_held_out_texts_and_offsets(spark):
    rows, marks = corpus()
    rows += [(9000, None, 0.0, 1), (9001, "", 0.0, 1), (9002, "a1 b2 " * 40_000, 0.0, 1), (None, "a1 Grumbus! vilewordx", 0.0, 1), (9003, "é 😂 Grumbus, grumbus b2", 0.0, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([*marks, (5, None, 0.0), (None, 1, 0.0), (5, marks[5][1], 0.0)], "doc_id long, toxic int, score double")
    model = fit_toxicity(docs, labels.where("doc_id % 5 <> 0"))
    got = {r.doc_id: r for r in score_toxicity(docs, model).collect()}
    assert len(got) == len(rows)
    held = [(i, y) for i, y, _ in marks if i % 5 == 0]
    assert sum((got[i].score >= 0.5) == bool(y) for i, y in held) >= 0.97 * len(held)
    assert got[9000].score == got[9001].score < 0.5 and got[9002].score < 0.5 and got[None].score > 0.5
    text = rows[-1][1]
    assert {text[s.start : s.end].lower() for s in got[9003].spans} == {"grumbus, grumbus"}
    assert all(0 <= r.score <= 1 for r in got.values())


def slow_word_score(model, word):
    """Weights of a word's features, hashed one by one."""
    space, m64 = model.crf.space, 2**64
    hashes = [zlib.crc32(word)]
    for k in range(1, 1 + max(*space.ngrams, *space.prefixes, *space.suffixes)):
        for i in range(len(word) - k + 1):
            h = 0
            for byte in word[i : i + k]:
                h = (h * 0x100000001B3 % m64) ^ (byte + 1)
            if k in space.prefixes and i == 0:
                hashes.append((h + 0x9E3779B97F4A7C15) % m64)
            if k in space.suffixes and i == len(word) - k:
                hashes.append((h + 2 * 0x9E3779B97F4A7C15) % m64)
            if k in space.ngrams:
                hashes.append(h)
    found = [((h ^ (h >> 31)) * 0xBF58476D1CE4E5B9 % m64) >> (64 - space.bits) for h in hashes]
    found += [(1 << space.bits) + n for n, lexicon in enumerate(space.lexicons) if word in lexicon]
    return [sum(float(model.crf.weights[f, y]) for f in found) for y in (0, 1)]


def slow_score(model, text):
    """Forward-backward in plain Python, word by word."""
    plain = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else c if c >= "\x80" or "a" <= c <= "z" else " " for c in text or "")
    words = [w.encode() for w in plain.split(" ") if w]
    t, begin = model.crf.transitions, model.crf.begin
    score = [slow_word_score(model, w) for w in words]
    forward, backward = [], [[1.0, 1.0]]
    for n, s in enumerate(score):
        into = [math.exp(begin[y]) if not n else sum(forward[-1][x] * math.exp(t[x, y]) for x in (0, 1)) for y in (0, 1)]
        now = [into[y] * math.exp(s[y]) for y in (0, 1)]
        forward.append([v / sum(now) for v in now])
    for s in reversed(score[1:]):
        now = [sum(math.exp(t[x, y]) * math.exp(s[y]) * backward[0][y] for y in (0, 1)) for x in (0, 1)]
        backward.insert(0, [v / sum(now) for v in now])
    marginal = [f[1] * b[1] / (f[0] * b[0] + f[1] * b[1]) for f, b in zip(forward, backward, strict=False)]
    total = sum(m for m in marginal if m >= 0.5)
    summary = [max(marginal), math.log1p(total), total / len(words)] if words else [0.0] * 3
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(summary, model.slope, strict=True)) + model.offset)))


def test_scores_by_plain_forward_backward(spark):
    rows, marks = corpus(200)
    rows += [(9000, None, 0.0, 1), (9001, "É grumbus 12 É", 0.0, 1), (9002, "a1 b2 vilewordx " * 300, 0.0, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = fit_toxicity(docs, spark.createDataFrame(marks, "doc_id long, toxic int, score double"))
    got = {r.doc_id: r.score for r in score_toxicity(docs, model).collect()}
    for i, text, *_ in [*rows[::7], *rows[-3:]]:
        assert abs(got[i] - slow_score(model, text)) < 1e-6, text


def test_scores_keep_the_labels_rate_when_the_sample_is_balanced(spark):
    """A smaller sample has as many toxic as clean texts; scores must not rise for that."""
    rows, marks = corpus(3000)
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame(marks, "doc_id long, toxic int, score double")
    rate = sum(y for _, y, _ in marks) / len(marks)
    for size in (3000, 150):
        found = score_toxicity(docs, fit_toxicity(docs, labels, texts_per_label=size), spans=False)
        mean, predicted = found.agg(F.avg("score"), F.avg((F.col("score") >= 0.5).cast("int"))).first()
        assert abs(mean - rate) < 0.04 and abs(predicted - rate) < 0.04, size


def test_an_id_with_both_labels_is_toxic(spark):
    from terrapanel.llm.samples import one_label

    marks = spark.createDataFrame([(1, 0), (1, 1), (2, None), (2, 0), (None, 0)], "id long, toxic int")
    assert {(r.id, r.toxic) for r in one_label(marks, "id", "toxic").collect()} == {(1, 1), (2, 0), (None, 0)}


def test_one_label_none_and_empty_tables(spark):
    rows, _ = corpus(20)
    docs = spark.createDataFrame(rows, SCHEMA)
    for marks, most in (([], 0.5), ([(1, 0), (2, 0)], 0.1)):
        model = fit_toxicity(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
        assert all(r.score <= most for r in score_toxicity(docs, model).collect())
    assert score_toxicity(spark.createDataFrame([], SCHEMA), model).count() == 0


def test_held_out_quality_on_documents(spark):
    from terrapanel.llm.queries import op10_toxicity

    path = "/root/testdata/sf0.1"
    found = op10_toxicity(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").where("held_out")
    counts = {(r.toxic, r.predicted): r["count"] for r in found.groupBy("toxic", "predicted").agg(F.count("*").alias("count")).collect()}
    assert counts[1, 1] >= 0.85 * (counts[1, 1] + counts.get((1, 0), 0))
    assert counts.get((0, 1), 0) <= 0.03 * (counts[0, 0] + counts.get((0, 1), 0))
