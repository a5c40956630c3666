"""From documents to token-ID files: quality rules, near-dedup, decontamination, mixing, output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanforge.llm import decontaminate, mixing, nearcopies, quality, tokenfile, tokens
from spanforge.llm._shared import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the model fitted on them and the labels go.

    Null and empty texts fail; rows without an id are judged by their text; repeated rows are each judged; a very long text is
    judged whole; an empty table gives an empty one, as in every stage.
    """
    return quality.filtered(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8), the document with the least id stays.

    SimHash chains prune the candidates, exact similarity decides. Rows without an id stay; of rows that repeat an id and a text
    one stays, rows of one id with different texts all do; null and blank texts are copies of each other.
    """
    return nearcopies.one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, all rows of them; null and blank texts hold none."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled to flattened marginals of source, language and topic.

    Nulls are a value of their own; documents without a word are not taken; rows of one id are taken or left together.
    """
    return mixing.mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-ID files of what is left; one row for each document, read back from them (the cases are op10's)."""
    import public_tokenizers

    return tokenfile.written_and_read(docs, str(public_tokenizers.path(tokens.TOKENIZER)))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("mixing", mix_sources),
    ("token_id_output", token_output),
]

#: No SQL: the stages fit a hashed model, make SimHashes and tokenize, which SQL can't express; tests/llm hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each on all that the one before kept, written and read in between."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
