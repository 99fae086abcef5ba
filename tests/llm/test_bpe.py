import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from terrapanel.llm.bpe import PrefixBpe, decode_ids, encode_texts

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids int, decoded string"


def texts():
    rng = random.Random(1)
    letters = "aaabbn'stelré .1<|endoftext|>Σς́İ  \x1c世界😂ᲉꟋ"
    out = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    words = ["internationalization", "aaaaaaaaaaaaaaaaaaaaaaa", "thththththinghe", "réeuxment", "don't", "x" * 5000, "<|startoftext|>hi", "éa"]
    return [None, "", " \t\n", *words, *out, "ab " * 100_000, "hot", "hot"]


def test_ids_and_decoded_texts_match_the_library(spark):
    library, data = Tokenizer.from_file(PATH), texts()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(data)], SCHEMA)
    got = {r.doc_id: r for r in encode_texts(docs, PATH).collect()}
    assert len(got) == len(data)
    for i, t in enumerate(data):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i].ids, "<u4").tolist() == want, t
        assert got[i].n_tokens == len(want)
        assert got[i].decoded == library.decode(want, skip_special_tokens=False)


def test_decoding_from_packed_ids(spark):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts())], SCHEMA)
    encoded = encode_texts(docs, PATH)
    both = decode_ids(encoded.withColumnRenamed("decoded", "was"), PATH)
    assert both.where("decoded <> was").count() == 0
    none = spark.createDataFrame([(None,)], "ids binary")
    assert decode_ids(none, PATH).first().decoded == ""


def test_empty_table(spark):
    assert encode_texts(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_prefix_tokens_equal_merging_by_rank():
    bpe, rng = PrefixBpe(PATH), random.Random(2)

    def by_rank(word):
        raw = word.encode()
        text = [chr(b) for b in raw[:-1]] + [chr(raw[-1] + 256)]
        ids = [bpe.longest[bpe.edges[ord(t)]] for t in text]
        while True:
            ranked = [(bpe.pairs[p], n) for n, p in enumerate(zip(ids, ids[1:], strict=False)) if p in bpe.pairs]
            if not ranked:
                return ids
            rank, _ = min(ranked)
            pair = next(p for p, r in bpe.pairs.items() if r == rank)
            whole = next(w for w, (r, _, _) in bpe.parts.items() if r == rank)
            out, n = [], 0
            while n < len(ids):
                if tuple(ids[n : n + 2]) == pair:
                    out.append(whole)
                    n += 2
                else:
                    out.append(ids[n])
                    n += 1
            ids = out

    for _ in range(60):
        word = "".join(rng.choice(["th", "e", "a", "in", "o", "ing", "s"]) for _ in range(rng.randrange(1, 9)))
        assert bpe.encode_word(word.encode()) == by_rank(word)


def test_query_digests(spark):
    from terrapanel.llm.queries import op6_bpe

    library = Tokenizer.from_file(PATH)
    path = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in op6_bpe(spark, path).collect()}
    for r in spark.read.parquet(f"{path}/documents.parquet").collect():
        ids = library.encode(r.text, add_special_tokens=False).ids
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
