"""Document pipeline: from the table ``documents`` to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it to the shared folder as
Parquet and hands it to the next stage. All stages but the last one return the columns of ``docs``. Documents with
null or empty texts fail the quality rules; an empty table stays empty through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmode.llm._spark import written
from driftmode.llm.bpe import encode_documents
from driftmode.llm.decontaminate import remove_contaminated
from driftmode.llm.near_dup import keep_one
from driftmode.llm.quality_rules import keep_good
from driftmode.llm.queries import table, tokenizer_file
from driftmode.llm.suffix_dedup import remove_repeats
from driftmode.session import prepare

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _ready(spark: SparkSession, docs: DataFrame) -> DataFrame:
    prepare(spark)
    return docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the compression bands go."""
    return keep_good(_ready(spark, docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class the document with the smallest id stays."""
    return keep_one(_ready(spark, docs))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay where they stand first; elsewhere their words go."""
    return remove_repeats(_ready(spark, docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words or more inside benchmark windows go."""
    return remove_contaminated(docs, table(prepare(spark), sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (binary, little-endian unsigned 32-bit) of every text; ``round_trip`` says that they decode to it."""
    path = tokenizer_file("byte_bpe_multi_50k.tiktoken")
    both = encode_documents(_ready(spark, docs), path, decoded_col="decoded")
    same = F.decode("decoded", "UTF-8") == F.coalesce("text", F.lit(""))
    return both.select("doc_id", "lang", "source", F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", encoding),
]

#: The stages need compression, sketches and token merges, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``; each stage's result is a Parquet table that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
