"""The registered ``opN_<name>`` queries and, where SQL can say them, their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_windows, read_back
from ..sources.files import scratch_path
from .common import read_table
from . import fp_tree
from .html_wrapper import extract_pages
from .langid import predict_documents
from .mixing import mix_report
from .nn_descent import near_duplicates
from .perm_index import nearest
from . import quality_rules
from .sentencepiece_nbest import encode_documents
from .simhash import simhash_components
from .url_templates import judge
from . import warc
from .whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op9_warc": warc.ORACLE, "op11_fp_tree": fp_tree.ORACLE, "op13_rule_ledger": quality_rules.oracle()}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts hold control strings, formatted and read back."""
    given = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).selectExpr("-7L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role").withColumn("text", F.lit(said))
    return read_back(format_windows(given.unionByName(extra)))


@_query
def op2_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract_pages(read_table(spark, sf_dir, "pages"))


@_query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents takes of each."""
    return mix_report(read_table(spark, sf_dir, "documents"))


@_query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents."""
    return simhash_components(read_table(spark, sf_dir, "documents"))


@_query
def op5_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return judge(read_table(spark, sf_dir, "pages"))


@_query
def op6_perm_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest vectors of every row whose id is divisible by 50, among all rows."""
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@_query
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best encodings of all documents, decoded again."""
    found = encode_documents(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_pieces", "score", "round_trip", "n_best")


@_query
def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents."""
    return predict_documents(read_table(spark, sf_dir, "documents"))


@_query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records to a content-addressed archive and read back."""
    path = scratch_path(spark, "warc")
    warc.write_archive(read_table(spark, sf_dir, "pages"), path)
    return warc.describe(warc.read_archive(spark, path))


@_query
def op10_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate links and components of all vectors."""
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


@_query
def op11_fp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that rank highest for every benchmark item."""
    return fp_tree.ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@_query
def op13_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failed rules and the current policy's verdict for all documents, read from the ledger."""
    path = scratch_path(spark, "ledger")
    quality_rules.write_ledger(read_table(spark, sf_dir, "documents"), path)
    return quality_rules.report(quality_rules.read_ledger(spark, path))


@_query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, whitened along the directions of largest variance."""
    return whiten(read_table(spark, sf_dir, "embeddings"))
