"""The corpus pipeline: five stages from documents to token ids, each written as Parquet and read again.

1. quality rules      lines that fail go, then documents that fail or lost too much
2. line dedup         lines that an earlier line equals, or is one edit from, go
3. simhash near-dedup one document of each group of near copies stays (five-word shingles, SIMILARITY of them shared)
4. mixing             documents are drawn, up to three times each, so that sources have their target shares
5. byte-level BPE     ids of each drawn document, and the text that they decode to
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm import bpe, lines, mixing, quality, simhash
from chunkloom.llm.common import Table

#: Shingles have five words. Near copies share SIMILARITY of these; fingerprints within RADIUS are candidates (each goes to RADIUS + 1
#: shards, and to (RADIUS + 1) ** 2 where shards are large), beside those of MinHash bands, which reach further at a cost that doesn't grow so; what
#: both leave is searched exactly.
SHINGLE, RADIUS, SIMILARITY = 5, 3, 0.8

#: SimHash classes and byte-level BPE can't be expressed in SQL; tests/llm/test_pipeline.py holds run() against a plain Python version.
ORACLE_SQL = None


def _counted(new: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it is now."""
    return new.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


# What holds for all stages: an empty table gives an empty table; other columns are kept whatever their names; a null or repeated
# doc_id is a row like others; equal rows are treated alike unless it says otherwise. What each operator says of nulls, long texts and ties holds.


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines that fail. Null, empty and blank texts don't pass. No ties; row by row."""
    return _counted(quality.clean(docs), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier one repeats. A null text stays null; null keys come last; ties by the text's hash."""
    return _counted(lines.drop_repeated_lines(docs), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that of the smallest doc_id (null last, ties by the text's hash, one of equal rows). All texts without words are one group."""
    return simhash.drop_near_duplicates(docs, shingle=SHINGLE, radius=RADIUS, similarity=SIMILARITY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as they are drawn, up to three times. A null source is the last one; texts without words may be drawn."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the decoded text, a row for each row. A null text has no ids and decodes to an empty one."""
    if ranks is None:
        import public_tokenizers

        ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.round_trip(docs, bpe.tokenizer_json(bpe.read_ranks(ranks)), pattern)
    return coded.select("doc_id", "n_tokens", "ids", F.col("decoded").cast("string").alias("text"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. Stages meet in tables in the shared folder, so a lost executor costs tasks, not stages.

    A stage's table goes when the next one is written, the last one when the application ends.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        made = Table(stage(spark, docs, sf_dir), "stage")
        if before:
            before.drop()
        docs, before = made.df, made
    return docs
