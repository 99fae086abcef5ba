import math
import re

from terrapanel.llm.licenses import BASE, SLACK, TEMPLATES, WORDINGS, RareWordIndex, scan_licenses, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, spans string, n_words int"


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    found = []
    for t in BASE:
        k = t.text.split()
        found += [(i, t.label) for i in range(len(words)) if words[i : i + len(k)] == k]
    return len(words), sorted(found)


TEXTS = [
    None, "", "...", "MIT License", "the mit-license, mit  LICENSE. mit é license", "Released under the MIT License.",
    "This work is licensed under the GNU General Public License, version 3.", "general public general public license license",
    "Licensed under the Apache License, Version 2.0.", "apache LICENSE apache license", "Licensed under CC BY-NC 4.0.",
    "mit der license", "permission is hereby granted, free of charge, to whom", "éMIT license", "mit\x85license", "x " * 200_000 + "mit license",
    "mit license", "mit license", "İ mit license",
]


def test_base_places_match_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], SCHEMA)
    got = {r.doc_id: r for r in scan_licenses(docs).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        n, places = brute(t)
        assert got[i].n_words == n
        assert sorted((s.start, s.label) for s in got[i].spans if s.base) == places, t
        assert all(0 <= s.score <= 1 for s in got[i].spans)


def test_templates_of_the_method(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], SCHEMA)
    labels = {r.doc_id: {s.label for s in r.spans} for r in scan_licenses(docs).collect()}
    assert labels[5] == {"mit", "mit-reference"}
    assert labels[6] == {"gpl", "gpl-3.0"}
    assert labels[8] == {"apache", "apache-2.0"}
    assert labels[10] == {"cc-by-nc-4.0"}
    assert labels[12] == {"mit-text"}
    assert labels[11] == set()


def test_every_template_finds_its_own_text(spark):
    docs = spark.createDataFrame([(i, t.text, "x", 1) for i, t in enumerate(TEMPLATES)], SCHEMA)
    for r in scan_licenses(docs).collect():
        assert any(s.label == TEMPLATES[r.doc_id].label and s.score > 0.999 for s in r.spans)


def every_place(text):
    """(label, start) of all templates, by trying every word of the text."""
    words = words_of((text or "").encode())
    found = set()
    for t in TEMPLATES:
        whole, keys, at = words_of(t.text.encode()), [words_of(k.encode()) for k in t.keys], []
        for k in keys:
            at.append(next(i for i in range(at[-1] if at else 0, len(whole)) if whole[i : i + len(k)] == k))
        for s in range(len(words)):
            stands = lambda i, k: words[i : i + len(k)] == k
            others = ((s + a - at[0], k) for a, k in zip(at[1:], keys[1:], strict=True))
            if stands(s, keys[0]) and all(any(stands(i, k) for i in range(max(0, b - SLACK), b + SLACK + 1)) for b, k in others):
                found.add((t.label, s))
    return found


def licence_texts():
    import random

    rng = random.Random(23)
    wordings = [t.text.split() for t in TEMPLATES]
    out = [*TEXTS[:15], *TEXTS[16:]]
    for _ in range(150):
        words = []
        for _ in range(rng.randrange(1, 4)):
            own = list(rng.choice(wordings))
            for _ in range(rng.randrange(4)):  # words are changed, go, or come
                k = rng.randrange(len(own))
                own[k : k + rng.randrange(2)] = rng.choice(([], ["some"], ["license", "software"], ["x"] * rng.randrange(20)))
                own = own or ["x"]
            words += own[rng.randrange(3) :] + ["y"] * rng.randrange(3)
        out.append(" ".join(words))
    return out


def test_all_templates_by_brute_force(spark):
    texts = licence_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.spans for r in scan_licenses(docs).collect()}
    want = {i: every_place(t) for i, t in enumerate(texts)}
    assert {i: {(s.label, s.start) for s in spans} for i, spans in found.items()} == want
    # Scores: rarity counted over all texts, word by word.
    words = [words_of((t or "").encode()) for t in texts]
    idf = lambda w: math.log((2 + len(words)) / (1 + sum(w in own for own in words)))
    by_label = {t.label: t for t in TEMPLATES}
    for i, spans in found.items():
        for s in spans:
            whole = words_of(by_label[s.label].text.encode())
            key = words_of(by_label[s.label].keys[0].encode())
            begin = s.start - next(k for k in range(len(whole)) if whole[k : k + len(key)] == key)
            there = sum(idf(w) for k, w in enumerate(whole) if 0 <= begin + k < len(words[i]) and words[i][begin + k] == w)
            assert abs(s.score - there / sum(map(idf, whole))) < 1e-9
    assert {t.label for t in WORDINGS} <= {label for places in want.values() for label, _ in places}


def test_two_rare_words_must_agree_on_the_place():
    index = RareWordIndex(TEMPLATES, 100, {})
    compared = []
    index._stands = lambda words, n, start: compared.append(n)
    apart = "merchantability x sublicense y apache z license 2 0 version".encode()
    assert index.scan(words_of(apart)) == [] and not compared
    # Both words of "apache license" are there, but not as far apart as in the phrase: nothing is compared.
    assert index.scan(words_of(b"license apache x license")) == [] and not compared


def test_query_columns_match_brute_force(spark):
    from terrapanel.llm.queries import op1_license_scan

    path = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in op1_license_scan(spark, path).collect()}
    for r in spark.read.parquet(f"{path}/documents.parquet").collect():
        n, places = brute(r.text)
        x = got[r.doc_id]
        assert (x.n_words, x.n_base, x.base_labels) == (n, len(places), ",".join(sorted({p[1] for p in places})))
        assert (x.first_word, x.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert set(x.base_labels.split(",")) - {""} <= set(x.labels.split(","))


def test_empty_table(spark):
    assert scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0
