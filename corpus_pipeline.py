"""The corpus pipeline: from documents to token files.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import decontam, mixing, ngram_join, token_files, toxicity
from quarry.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar scores below one half.

    Null and empty texts are scored as texts without matches and stay. Equal texts share a
    fate; repeated rows repeat; an empty table stays empty; without usable labels the fixed
    words decide. Extra columns are kept, whatever their names.
    """
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose shingles of five words link at a Jaccard of 0.8 or more.

    The smallest doc_id of a group stays; of several texts under that id the one of the
    smallest digest, of repeated rows one. Null and empty texts link with nothing: of those
    one stays for each doc_id. Rows of null doc_id stay. An empty table stays empty.
    """
    return ngram_join.one_per_group(docs, width=5, percent=80)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none and stay, items without words are held by none; repeated
    rows share a fate; without items or documents the table stays as it is.
    """
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by the rates that bring domain totals to their targets.

    Null and empty texts have no tokens and stay once; equal rows get equal numbers of
    copies; without labels there is one domain and nothing changes; an empty table stays empty.
    """
    return mixing.mixed(docs, table(spark, sf_dir, "labels"))


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token segments written, read back and listed by document: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts have the end id alone; repeated rows repeat; rows of one doc_id
    follow one another in any order, null ids come first; an empty table gives no rows.
    """
    return token_files.read_index(token_files.write_tokens(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", one_of_near_copies),
    ("decontamination", drop_benchmark_passages),
    ("mixing", mix_to_weights),
    ("tokens", write_token_files),
]

#: Learned scores, rates and token ids are beyond SQL; the tests hold the stages against brute force, toxicity against the words of the labelled texts and held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
