"""The corpus pipeline: quality rules, line and near deduplication, mixing, packing.

Each stage takes (spark, docs, sf_dir) and gives what the next one reads. All but the last give the columns of
documents, whatever further columns and names docs has; only columns named like an operator's results (__kept, __rule,
__p, ...) are refused. For every stage an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillmark.llm import queries
from rillmark.llm.common import staged, without_ids
from rillmark.llm.line_dedup import line_dedup
from rillmark.llm.near_dedup import near_duplicates
from rillmark.llm.packing import pack
from rillmark.llm.quality_rules import fit_rules, quality_verdicts


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base test or a learned rule go.

    Null, empty and very short texts fail the base; very long ones are counted whole. Repeated rows and null ids share
    their text's fate. Without labels no rule is learned, and the base alone decides.
    """
    rules = fit_rules(docs, queries.table(spark, sf_dir, "labels"))
    return quality_verdicts(docs, rules).filter("__kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go from its texts; n_chars follows the text.

    No document goes. A null text stays null, a text of nothing but boilerplate becomes empty; null sources are one
    source; null ids and repeated rows are documents like any other.
    """
    out = line_dedup(docs, ratio=queries.LINE_RATIO, min_pages=queries.LINE_PAGES)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the smallest id stays.

    Repeated rows of the id that stays all stay; rows with a null id always do, as no decision names them. Null, empty
    and wordless texts are like no other; texts under five words are compared as a whole.
    """
    copies = near_duplicates(docs, shingle_words=5, num=4, den=5).filter("NOT kept AND id IS NOT NULL").select("id").distinct()
    return without_ids(docs, "doc_id", staged(copies, "near-copies"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose token weights follow the targets by source, language and topic.

    Repeated rows of an id share their fate, null ids that of an empty id; null and empty texts weigh one token; null
    classes are one class.
    """
    return queries.mixed(docs).filter("__kept").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, with their ids, in windows of 2048.

    A null or empty text is its end mark alone; a very long one is cut into many windows; rows with a null or repeated
    id are documents of their own.
    """
    return pack(docs, queries.public_tokenizer, window=2048, end_id=1, with_ids=True).withColumnRenamed("id", "doc_id")


STAGES = [("quality rules", quality), ("line dedup", lines), ("near dedup", near), ("mixing", mixture), ("packing", packed)]
#: The rules are learned and the links found by hashing, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
