"""Three example queries over a collection: ``python -m lodestone.plans.demo <folder>``."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from ..operators.index import build_index
from ..operators.retrieval import search_tfidf
from ..sources.collection import read_collection
from .cli import session

# The example queries.
QUERIES = ["alkylated with radioactive iodoacetate", "psychodrama for disturbed children", "lipid metabolism in toxemia and normal pregnancy"]


def demo(spark: SparkSession, folder: str, k: int = 10) -> DataFrame:
    """(qid, rank, doc_id, score): the best documents of each example query by TF-IDF."""
    index = build_index(read_collection(spark, folder), id_col="doc_name")
    queries = spark.createDataFrame(list(enumerate(QUERIES, 1)), "qid long, query string")
    return search_tfidf(queries, index, k).orderBy("qid", "rank")


if __name__ == "__main__":
    demo(session(), sys.argv[1]).show(100, truncate=False)
