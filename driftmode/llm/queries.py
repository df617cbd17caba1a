"""The thin queries over the synthetic tables, one for each operator: ``QUERIES`` and ``ORACLE_SQL``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer file is."""
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated passage: its document, its words, and the document in which it stands first."""
    from .suffix_dedup import find_repeats

    found = find_repeats(table(spark, sf_dir, "documents"))
    spans = found.select(F.col("id").alias("doc_id"), F.explode("repeats").alias("s"), (F.size("removed") > 0).alias("loses_words"))
    return spans.select("doc_id", F.col("s.start").alias("start_word"), F.col("s.end").alias("end_word"), F.col("s.first_id").alias("first_doc_id"), "loses_words")


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text, and after two edits of it (a phrase in the middle replaced, another put at the front)."""
    from .token_counts import apply_edits, build_trees

    path = tokenizer_file("byte_bpe_50k.tiktoken")
    trees = build_trees(table(spark, sf_dir, "documents").select("doc_id", "text"), path).withColumn("n_before", F.col("n_tokens"))
    middle = "cast(coalesce(length(text), 0) div 2 as bigint)"
    edits = f"array(named_struct('start', 0L, 'end', 0L, 'text', 'Edited: '), named_struct('start', {middle}, 'end', {middle} + 12, 'text', ' it\\'s 2 new  words'))"
    done = apply_edits(trees.withColumn("edits", F.expr(edits)), path)
    return done.select("doc_id", F.col("n_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), "n_encoded")


@query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again, as digests."""
    from .bpe import encode_documents

    path = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    both = encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), path, decoded_col="decoded")
    return both.select("doc_id", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text, by a model of the labelled documents that are not held out."""
    from ._spark import written
    from .quality_model import add_features, held_out, score_features, train

    featured = written(add_features(table(spark, sf_dir, "documents").select("doc_id", "text")), "features")
    model = train(featured, table(spark, sf_dir, "labels"))
    return score_features(featured.withColumn("held_out", held_out("doc_id")), model)


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the verdict of the compression bands for every document."""
    from .quality_rules import score_rules

    return score_rules(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as archives, indexed, and read back through the index."""
    from .warc import build_index, read_archives, write_archives

    records = read_archives(build_index(write_archives(table(spark, sf_dir, "pages"))))
    return records.select("page_id", F.octet_length("payload").cast("bigint").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


ORACLE_SQL["op6_warc"] = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest FROM p),
    r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM d)
    SELECT page_id, payload_bytes, payload_digest,
        CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
    FROM r"""


@query
def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    from .near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


@query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document, against the whole benchmark."""
    from .decontaminate import find_contamination

    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL["op8_decontaminate"] = f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
    b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    i AS (SELECT item_id, w, least(13, len(w)) AS m FROM b WHERE len(w) > 0),
    bw AS (SELECT DISTINCT item_id, m, array_to_string(w[k:k + m - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS k FROM i)),
    dw AS (SELECT r, m, k, array_to_string(w[k:k + m - 1], ' ') AS win FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM i) WHERE len(w) >= m)),
    h AS (SELECT r, m, k, item_id FROM dw JOIN bw USING (m, win)),
    p AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT DISTINCT r, unnest(range(k, k + m)) AS pos FROM h) GROUP BY r),
    t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM h GROUP BY r)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
        coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN p USING (r) LEFT JOIN t USING (r)"""


@query
def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    from .html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, read back from plane files."""
    from .token_files import read_ids, write_ids

    manifest = write_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file("byte_bpe_50k.json"))
    return read_ids(manifest).select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
