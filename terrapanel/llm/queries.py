"""The queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapanel.llm.bpe import encode_texts
from terrapanel.llm.conversation_repair import damage_turns, repair_conversations
from terrapanel.llm.exact_dedup import exact_dedup
from terrapanel.llm.language_id import fit_languages, label_languages
from terrapanel.llm.licenses import scan_licenses
from terrapanel.llm.media import store_texts
from terrapanel.llm.mixing import Mix, count_words, mix_sources
from terrapanel.llm.quality import fit_quality, score_quality
from terrapanel.llm.quality_rules import apply_quality_rules
from terrapanel.llm.samples import fold
from terrapanel.llm.simhash import near_duplicates
from terrapanel.llm.storage import bounded_batches
from terrapanel.llm.toxicity import fit_toxicity, score_toxicity
from terrapanel.llm.url_filter import filter_urls
from terrapanel.llm.whitening import fit_whitening, identity_error, whiten


def _read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(_read(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    names = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = fold("doc_id", 4) == 2
    model = fit_languages(docs.where(~held_out), "doc_id", "text", "lang")
    found = label_languages(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "runs")


URL_RULES = """
SELECT * FROM VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
                     ('block', 'example.net', '/de/8'), ('block', 'org', '/es/') AS rules(verdict, host, path)
"""


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_read(spark, sf_dir, "pages", "page_id", "url"), spark.sql(URL_RULES))


OP3_SQL = r"""
WITH r(verdict, rhost, rpath) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
         ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), p AS (
  SELECT row_number() OVER () AS n, page_id,
         translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), m AS (
  SELECT p.*, r.verdict, rhost || rpath AS rule,
         row_number() OVER (PARTITION BY n ORDER BY length(rhost || rpath) DESC NULLS LAST) AS place
  FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE place = 1
"""


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_read(spark, sf_dir, "documents", "doc_id", "text"))


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w = 1 AS kept,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d
  WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM g
"""


#: Which sources make up a domain; others are "other".
DOMAINS = {f"src{n}": ("web", "news", "books", "reference")[n // 5] for n in range(20)}
MIX = Mix(
    budget=0.6,
    domain={"web": 0.4, "news": 0.2, "books": 0.3, "reference": 0.1},
    lang={"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1},
    source={"src0": 2.0},
    max_epochs=2.0,
    seed=17,
)


def domain_of(source: F.Column) -> F.Column:
    names = F.create_map(*[F.lit(x) for pair in DOMAINS.items() for x in pair])
    return F.coalesce(names[F.coalesce(source, F.lit(""))], F.lit("other"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    taken = mix_sources(docs, MIX, domain_of(F.col("source")))
    return taken.select("doc_id", F.col("__domain").alias("domain"), "lang", "source", F.col("__epoch").alias("epoch"), count_words(F.col("text")).alias("n_tokens"))


#: Files come with the environment and are read where they are.
VOCABULARY = "word_bpe_49k.json"


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    encoded = encode_texts(docs, public_tokenizers.path(VOCABULARY))
    return encoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text", "source", "lang", "n_chars")
    held_out = fold("doc_id", 5) == 0
    labels = _read(spark, sf_dir, "labels", "doc_id", "quality").where(~held_out)
    found = score_quality(docs, fit_quality(docs, labels))
    return found.select("doc_id", held_out.alias("held_out"), "score", "text_score", "meta_score", (F.col("score") >= 0.5).alias("kept"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = store_texts(_read(spark, sf_dir, "documents", "doc_id", "text"), read_back=True, tensors=False)
    return stored.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        "height",
        "width",
        "rgb_sha256",
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents", "doc_id", "text"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents", "doc_id", "text")
    held_out = fold("doc_id", 5) == 0
    labels = _read(spark, sf_dir, "labels", "doc_id", "toxic").where(~held_out)
    model = fit_toxicity(docs, labels)
    found = score_toxicity(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = damage_turns(_read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    lines = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    return repair_conversations(turns).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256")
    )


OP11_SQL = r"""
WITH RECURSIVE bits AS (SELECT range(8) AS eight),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS label
  FROM conversations
), hashed AS (
  SELECT *, xor(list_reduce(
      list_transform(range(1, length(label) + 1), lambda i: CAST(ord(substr(label, CAST(i AS INT), 1)) AS BIGINT)),
      lambda c, b: list_reduce(eight, lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(c, b)),
      4294967295), 4294967295) % 20 AS kind
  FROM named, bits
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM hashed WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER w AS place, left(role, 1) AS initial,
         coalesce(lag(left(role, 1)) OVER w || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS illegal,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault
  FROM damaged
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) AS n,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (illegal) AS illegal
  FROM placed GROUP BY conv_id
), moves(before, after, letters, cost, initial) AS (
  SELECT p.s, t.s, p.letters || CASE WHEN k.keep THEN 'K' ELSE 'R' END, p.cost + CASE WHEN k.keep THEN 0 ELSE 2 END, CASE WHEN k.keep THEN t.s END
  FROM (VALUES ('e', 'u', '', 0), ('s', 'u', '', 0), ('a', 'u', '', 0), ('u', 'u', 'I', 2),
               ('u', 'a', '', 0), ('e', 'a', 'I', 2), ('s', 'a', 'I', 2), ('a', 'a', 'I', 2)) AS p(s, t, letters, cost)
  JOIN (VALUES ('u'), ('a')) AS t(s) ON t.s = p.t, (VALUES (true), (false)) AS k(keep)
  UNION ALL VALUES ('e', 's', 'K', 0, 's')
), fold AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS place, 'e' AS state, CAST(0 AS BIGINT) AS cost, '' AS audit FROM counted
  UNION ALL
  SELECT conv_id, place, state, cost, audit FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, state ORDER BY cost, audit) AS best FROM (
      SELECT f.conv_id, r.place, m.after AS state, f.cost + m.cost + CASE WHEN r.fault = 'truncated' THEN 1 ELSE 0 END AS cost, f.audit || m.letters AS audit
      FROM fold f JOIN placed r ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.place = f.place + 1
      JOIN moves m ON m.before = f.state AND (m.initial IS NULL OR m.initial = r.initial) AND r.fault NOT IN ('blank', 'duplicate')
      UNION ALL
      SELECT f.conv_id, r.place, f.state, f.cost + 3, f.audit || 'D'
      FROM fold f JOIN placed r ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.place = f.place + 1
    )
  ) WHERE best = 1
), ends AS (
  SELECT f.conv_id, cost + CASE state WHEN 'u' THEN 2 ELSE 0 END AS cost, audit || CASE state WHEN 'u' THEN 'I' ELSE '' END AS audit
  FROM fold f JOIN counted c ON c.conv_id IS NOT DISTINCT FROM f.conv_id AND f.place = c.n WHERE state <> 's'
), best AS (
  SELECT conv_id, cost, audit FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) AS nth FROM ends) WHERE nth = 1
), letters AS (
  SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS step FROM best
), edits AS (
  SELECT conv_id, step, substr(audit, CAST(step AS INT), 1) AS letter,
         length(replace(left(audit, CAST(step AS INT)), 'I', '')) AS place, length(replace(left(audit, CAST(step AS INT)), 'D', '')) AS nth
  FROM letters
), kept AS (
  SELECT e.*, r.role, r.text, max(CASE WHEN e.nth = 1 AND e.letter = 'K' AND r.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id) AS system
  FROM edits e LEFT JOIN placed r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.place = e.place AND e.letter <> 'I'
), lines AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (nth - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY step) AS repaired
  FROM kept WHERE letter <> 'D' GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    model = fit_whitening(vectors)
    error = identity_error(vectors, model) if model else None
    deviation = F.expr("try_cast(deviation AS bigint)").alias("deviation")
    return whiten(vectors, model).select("vec_id", "component", "n", deviation, "whitened", "explained", F.lit(error).cast("double").alias("identity_error"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_quality_rules(_read(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _bounded(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "op1_license_scan": op1_license_scan,
        "op2_language_id": op2_language_id,
        "op3_url_filter": op3_url_filter,
        "op4_exact_dedup": op4_exact_dedup,
        "op5_mixing": op5_mixing,
        "op6_bpe": op6_bpe,
        "op7_quality": op7_quality,
        "op8_media": op8_media,
        "op9_simhash": op9_simhash,
        "op10_toxicity": op10_toxicity,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_whitening": op12_whitening,
        "op13_quality_rules": op13_quality_rules,
        "pipeline": pipeline,
    }
    return {name: _bounded(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": OP3_SQL, "op4_exact_dedup": OP4_SQL, "op11_conversation_repair": OP11_SQL}
