"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the docs of the next.  All but the last
return the columns of documents.  A stage first deletes what the stages before it on the same sf_dir put aside,
unless its docs still read it, so that the disk holds one stage's tables at a time.

What a stage does with nulls, empty and very long texts, ties, repeated rows, empty tables and
columns with clashing names is that of its operator, stated there: quality rules drop null and empty texts (they
have fewer words than the base rule asks); the near-dedup stage keeps of each class the
row with the least doc_id, a null one last, and every row without words; decontamination and mixing pass
null texts and identifiers on; token output sorts null identifiers first.  An empty table stays empty in all of them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import decontam, mixing, near_dup, quality_rules, sstable
from marginalia.llm.common import drop_paths, drop_staged, fresh_path, staged_since, staged_so_far, table

#: What the stages so far put aside, by sf_dir; the first stage starts anew.
_ASIDE: dict[str, list[str]] = {}


def _clears(first: bool = False) -> Callable:
    """A stage that deletes what earlier ones put aside: their results are written by now."""

    def wrap(stage: Callable) -> Callable:
        @wraps(stage)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            aside = [] if first else _ASIDE.get(sf_dir, [])
            # A caller may pass docs on unwritten.
            read = {part for x in docs.inputFiles() for part in x.split("/")} if aside else set()
            kept = [x for x in aside if x.rsplit("/", 1)[1] in read]
            drop_paths(spark, [x for x in aside if x not in kept])
            before = staged_so_far()
            out = stage(spark, docs, sf_dir)
            _ASIDE[sf_dir] = kept + staged_since(before)
            return out

        return run_stage

    return wrap


@_clears(first=True)
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or an adaptive threshold go."""
    return quality_rules.keep_good(docs)


@_clears()
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    return near_dup.one_of_each(docs)


@_clears()
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


@_clears()
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents come as often as their rate says."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels"))


@_clears()
def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as sorted token shards; the rows are read back from the files."""
    return sstable.token_output(docs)


STAGES = [
    ("quality rules", keep_good),
    ("near-dedup", one_of_each),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("token output", token_shards),
]

#: The near-dedup and tokenizer stages can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES:
        path, before = fresh_path(spark, "stage"), staged_so_far()
        stage(spark, docs, sf_dir).write.parquet(path)
        # What the stage put aside and what it read are of no use once its result is written.
        drop_staged(spark, before)
        drop_paths(spark, last)
        docs, last = spark.read.parquet(path), [path]
    return docs
