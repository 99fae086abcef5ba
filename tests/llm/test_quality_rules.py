import math
import random
from collections import Counter, defaultdict

import pytest

from terrapanel.llm import kneser_ney, queries, quality_rules
from terrapanel.llm.kneser_ney import DISCOUNTS, fit_characters
from terrapanel.llm.quality_rules import apply_quality_rules, measures

SCHEMA = "doc_id long, text string, lang string, language string, kept int"
PATH = "/root/testdata/sf0.001"
BLANKS = " \t\n\x0b\x0c\r"


def words_of(text):
    out, word = [], ""
    for c in text + " ":
        if c in BLANKS:
            out += [word] * bool(word)
            word = ""
        else:
            word += c
    return out


def plain_measures(text):
    words = words_of(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered |= {i, i + 1, i + 2}
    seen, again = set(), 0
    for line in text.split("\n"):
        if words_of(line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(covered)


def plain_model(rows, stored, order=4):
    """p(language, context, symbol) by the definition, from rows (lang, text)."""
    n, texts = Counter(), Counter()
    for lang, text in rows:
        s = "\n" * (order - 1) + " ".join(words_of(text))
        s = "".join(c if c < "\U00010000" else "�" for c in s)
        own = Counter((lang, s[i - k + 1 : i + 1]) for i in range(order - 1, len(s)) for k in range(1, order + 1))
        n.update(own)
        texts.update(own.keys())
    symbols = sum(c for (_, g), c in n.items() if len(g) == 1)
    a = Counter({g: c for g, c in n.items() if len(g[1]) == order})
    for lang, g in n:
        if len(g) > 1:
            a[lang, g[1:]] += 1
    counts = defaultdict(Counter)
    for (lang, g), c in a.items():
        counts[lang, len(g)][c] += 1

    def discount(lang, k, c):
        m, i = counts[lang, k], min(c, 3)
        if m[i] and m[i + 1] and m[1]:
            d = i - (i + 1) * m[1] / (m[1] + 2 * m[2]) * m[i + 1] / m[i]
            if 0 < d < i:
                return d
        return DISCOUNTS[i - 1]

    total, kept = Counter(), defaultdict(float)
    own = {}
    for (lang, g), c in a.items():
        total[lang, g[:-1], len(g)] += c
        if n[lang, g] * stored >= symbols and texts[lang, g] > 1:
            own[lang, g] = max(0.0, c - discount(lang, len(g), c))
            kept[lang, g[:-1], len(g)] += own[lang, g]

    def p(lang, g):
        if not g:
            return 1 / (sum(counts[lang, 1].values()) + 1)
        key = lang, g[:-1], len(g)
        if not total[key]:
            return p(lang, g[1:])
        return own.get((lang, g), 0.0) / total[key] + max(1 - kept[key] / total[key], 1e-12 if kept[key] else 0) * p(lang, g[1:])

    return p


def plain_log_perplexity(p, lang, text, order=4):
    s = "\n" * (order - 1) + " ".join(words_of(text))
    s = "".join(c if c < "\U00010000" else "�" for c in s)
    each = [math.log(p(lang, s[i - order + 1 : i + 1])) for i in range(order - 1, len(s))]
    return -sum(each) / len(each) if each else None


def corpus():
    rng = random.Random(4)
    syllables = {"en": ["the", "an", "re", "on", "ou"], "de": ["ung", "ver", "ß", "ein"], None: ["ra", "ño", "\U0001f600"]}
    rows = []
    for i in range(150):
        lang = rng.choice(list(syllables))
        words = ["".join(rng.choices(syllables[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(1, 90))]
        rows.append((i, rng.choice([" ", "  ", "\n", " \t"]).join(words), lang))
    return rows + [(200, None, "en"), (201, "", "de"), (202, " \n ", "en"), (None, "the an the an", "en"), (203, "q#x" * 3000, "en")]


def test_measures_by_definition():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choices(["a", "b", "a b c ", " ", "\n", "é", "#", "\t", " ", "a b c\n", "|>"], k=rng.randrange(0, 60)))
        assert measures(text.encode()) == plain_measures(text), text


@pytest.mark.parametrize(("stored", "counted"), [(1 << 19, 1 << 21), (40, 50)])
def test_perplexity_by_definition(spark, monkeypatch, stored, counted):
    monkeypatch.setattr(kneser_ney, "STORED", stored)
    monkeypatch.setattr(kneser_ney, "COUNTED", counted)
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    model = fit_characters(df)
    p = plain_model([(lang, text or "") for _, text, lang in rows], stored)
    found = model.log_perplexities([r[2] for r in rows], [(r[1] or "").encode() for r in rows])
    for (_, text, lang), got in zip(rows, found, strict=True):
        want = plain_log_perplexity(p, lang, text or "")
        assert math.isnan(got) if want is None else math.isclose(got, want, rel_tol=1e-5), (text, got, want)
    symbols = {c for _, t, x in rows if x == "en" for c in " ".join(words_of(t or ""))} | {"\x00"}  # and one that was never seen
    assert math.isclose(sum(p("en", "the" + c) for c in symbols), 1, rel_tol=1e-9)


def test_verdicts_follow_rules_and_bands(spark):
    rows = corpus()
    got = apply_quality_rules(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, text, _ in rows:
        r, want = by[i], plain_measures(text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        inside = r.log_perplexity is None or r.low is None or r.low <= r.log_perplexity <= r.high
        assert r.kept == (not r.base_failed and inside)


def test_junk_is_rejected_and_prose_stays(spark):
    rng = random.Random(8)
    prose = [(i, " ".join("".join(rng.choices(["the", "an", "re", "on", "ou"], k=2)) for _ in range(120)), "en") for i in range(200)]
    noise = [(1000 + i, " ".join("".join(rng.choices("qxzjkvw#0139", k=5)) for _ in range(120)), "en") for i in range(4)]
    got = apply_quality_rules(spark.createDataFrame([(*r, "", 0) for r in prose + noise], SCHEMA)).collect()
    assert {r.doc_id for r in got if not r.kept and not r.base_failed} == {i for i, *_ in noise}


def test_whole_table_and_an_empty_one(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.queries()["op13_quality_rules"](spark, PATH).collect()}
    assert len(got) == len(docs)
    for d in docs:
        assert tuple(got[d.doc_id][m] for m in quality_rules.MEASURES) == plain_measures(d.text)
    rejected = sum(not r.kept for r in got.values() if not r.base_failed)
    assert rejected < 0.05 * len(docs)
    assert apply_quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("held", [1 << 21, 40, 0])
def test_rare_n_grams_keep_their_own_probability(spark, monkeypatch, held):
    """however few n-grams tasks hold, each n-gram of two texts has the model's probability, not that of a lower order."""
    monkeypatch.setattr(kneser_ney, "STORED", 40)
    monkeypatch.setattr(kneser_ney, "HELD", held, raising=False)
    rows = corpus()
    rows += [rows[3], rows[3], (rows[4][0], *rows[5][1:])]  # repeated rows and ids
    got = apply_quality_rules(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)).collect()
    p = plain_model([(lang, text or "") for _, text, lang in rows], 1 << 60)
    want = [(-1 if i is None else i, plain_log_perplexity(p, lang, text or "")) for i, text, lang in rows]
    assert len(got) == len(want)
    order = lambda x: (x[0], x[1] is None, x[1])
    for (i, log), (j, own) in zip(sorted(((-1 if r.doc_id is None else r.doc_id, r.log_perplexity) for r in got), key=order), sorted(want, key=order), strict=True):
        assert i == j and (log is None if own is None else math.isclose(log, own, rel_tol=1e-6)), (i, log, own)
