"""Thin opN_ queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .block_dedup import exact_groups
from .common import shared_folder, table
from .divergence import divergence
from .fingerprint import fingerprints_with_edit
from .html_text import extract
from .langid import identify
from .mixing import mix
from .resampling import resample
from .sentencepieces import piece_digests
from .simhash import near_groups
from .substring_dedup import remove_repeats
from .token_files import read_ids, write_ids
from .toxicity import score_toxicity
from .weak_quality import score_quality


def tokenizer_file(name: str) -> str:
    return importlib.import_module("public_tokenizers").path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


#: Shares of all tokens that the mix should have.
TARGETS = {"en": 0.5, "de": 0.2, "fr": 0.15, "es": 0.15}


#: The domain classifier learns from at most so many annotated documents, those with the least hash of doc_id.
LABELLED = 20_000


def labelled_domains(docs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """(text, domain) of annotated documents, those that the labels table covers. Their ids are chosen first
    and are at most LABELLED, so they are broadcast and no text is shuffled."""
    marked = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct()
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    return docs.join(F.broadcast(chosen), "doc_id", "left_semi").select("text", F.col("lang").alias("domain"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = mix(docs, labelled_domains(docs, spark, sf_dir), TARGETS)
    shares = [F.element_at("membership", j + 1).alias(f"p_{d}") for j, d in enumerate(TARGETS)]
    return out.select("doc_id", "n_tokens", *shares, "rate", "missed")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).drop("n_blocks")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents")).drop("text")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex[:12]}"
    write_ids(table(spark, sf_dir, "documents"), path, tokenizer_file("word_bpe_49k.json"))
    return read_ids(spark, path)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_with_edit(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_language_id": op2_language_id,
    "op3_mixing": op3_mixing,
    "op4_html_text": op4_html_text,
    "op6_quality": op6_quality,
    "op5_substring_dedup": op5_substring_dedup,
    "op7_token_files": op7_token_files,
    "op10_sentencepiece": op10_sentencepiece,
    "op8_fingerprints": op8_fingerprints,
    "op9_exact_dedup": op9_exact_dedup,
    "op11_toxicity": op11_toxicity,
    "op12_source_divergence": op12_source_divergence,
    "op13_resampling": op13_resampling,
}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
HEX = "(strpos('0123456789ABCDEF', substr(h, i::INT, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(h, i::INT + 1, 1)) - 1"

SQL: dict[str, str] = {
    "op9_exact_dedup": r"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept,
               sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)""",
    "op5_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        w AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS i, words FROM d WHERE len(words) >= 20),
        x AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(words[i:i + 19], ' ') ORDER BY doc_id, i) AS place FROM w),
        gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM x, range(0, 20) AS r(k) WHERE place > 1),
        p AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM d)
        SELECT d.doc_id, len(any_value(words))::BIGINT AS n_words, count(gone.pos) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY p.pos) FILTER (gone.pos IS NULL), '')) AS kept_sha256
        FROM d LEFT JOIN p ON p.doc_id = d.doc_id LEFT JOIN gone ON gone.doc_id = p.doc_id AND gone.pos = p.pos GROUP BY d.doc_id""",
    "op12_source_divergence": rf"""
        WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS rid, regexp_extract_all({LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
        w AS (SELECT lang, source, rid, unnest(terms) AS term FROM d),
        c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT rid) AS docs FROM w GROUP BY ALL),
        k AS (SELECT lang, term, sum(n) AS lang_n FROM c GROUP BY ALL HAVING sum(docs) >= 30),
        v AS (SELECT lang, count(*) AS terms, sum(lang_n) AS lang_total FROM k GROUP BY 1),
        g AS (SELECT DISTINCT lang, source FROM d),
        kept AS (SELECT c.lang, c.source, c.term, c.n FROM c JOIN k ON c.lang = k.lang AND c.term = k.term),
        t AS (SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM g LEFT JOIN kept ON g.lang = kept.lang AND g.source = kept.source GROUP BY ALL),
        p AS (SELECT t.lang, t.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (total + 5 * terms) AS p, 1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * terms) AS q
              FROM t JOIN k ON t.lang = k.lang JOIN v ON v.lang = t.lang LEFT JOIN kept ON kept.lang = t.lang AND kept.source = t.source AND kept.term = k.term),
        far AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source
              UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
        r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM x)
        SELECT * FROM r WHERE part = 'pair' OR rank <= 50""",
    "op13_resampling": rf"""
        WITH crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS t FROM range(256) AS r(i)),
        d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
        b AS (SELECT regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
        dw AS (SELECT rid, unnest(words) AS word FROM d), bw AS (SELECT unnest(words) AS word FROM b),
        one AS (SELECT word, hex(word) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
        hashed AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda i: ({HEX})::BIGINT)), lambda c, y: xor(t[(xor(c, y) % 256)::INT + 1], c // 256)), 4294967295) % 10000 AS bucket FROM one, crc),
        s AS (SELECT bucket, count(*) AS s FROM dw JOIN hashed ON dw.word = hashed.word GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM bw JOIN hashed ON bw.word = hashed.word GROUP BY 1),
        g AS (SELECT s.bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t ON s.bucket = t.bucket),
        w AS (SELECT rid, sum(gain)::BIGINT AS weight FROM dw JOIN hashed ON dw.word = hashed.word JOIN g ON g.bucket = hashed.bucket GROUP BY 1),
        u AS (SELECT d.rid, doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight, upper(substr(sha256('2024:' || doc_id), 1, 8)) AS h FROM d LEFT JOIN w ON d.rid = w.rid),
        z AS (SELECT rid, doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((list_reduce(list_transform([1, 3, 5, 7], lambda i: ({HEX})::BIGINT), lambda a, y: a * 256 + y) + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM u),
        r AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM z WHERE n_features >= 20)
        SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM r) THEN rank END AS rank FROM z LEFT JOIN r ON z.rid = r.rid""",
}
