"""Command line: index, search, lsi, evaluate, compress.

    python -m lodestone.plans.cli index --data-dir collection --output-dir index
    python -m lodestone.plans.cli search --method bm25 --query "lipid metabolism"
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codecs import CODECS
from ..operators import compression, evaluation, lsi, retrieval
from ..operators.index import Index, build_index, numbered
from ..sources.collection import as_queries, read_collection, read_evaluation_queries, read_qrels, read_queries, with_document_numbers

#: Fixed value: documents up to which latent vectors are searched exactly.
FLAT_DOCS = 50_000
MODES, METHODS = ("bsbi", "spimi"), ("tfidf", "bm25", "wand", "lsi")


def session() -> SparkSession:
    """The session at hand, or one for this machine."""
    builder = SparkSession.builder.appName("lodestone").config("spark.sql.session.timeZone", "UTC")
    return builder.getOrCreate()


def _path(args: argparse.Namespace) -> str:
    """Each index name has a folder of its own."""
    return f"{args.output_dir.rstrip('/')}/{args.index_name}"


def build(spark: SparkSession, args: argparse.Namespace) -> Index:
    """Builds and stores the index of a collection; documents are keyed by their names."""
    docs = read_collection(spark, args.data_dir)
    index = build_index(docs, getattr(args, "mode", "bsbi"), "block", id_col="doc_name")
    index.save(_path(args))
    return Index.load(spark, _path(args))


def build_latent(spark: SparkSession, args: argparse.Namespace) -> None:
    latent = lsi.build_lsi(Index.load(spark, _path(args)), args.n_components, args.svd_algorithm)
    if latent.doc_vecs.count() > FLAT_DOCS:
        latent = latent.with_cells()
    latent.save(f"{_path(args)}/lsi")


def results_of(spark: SparkSession, args: argparse.Namespace, method: str, queries: DataFrame) -> DataFrame:
    """(qid, rank, doc_id, score) of all queries in one job."""
    index = Index.load(spark, _path(args))
    if method == "tfidf":
        return retrieval.search_tfidf(queries, index, args.k)
    if method == "bm25":
        return retrieval.search_bm25(queries, index, args.k, args.bm25_k1, args.bm25_b)
    if method == "wand":
        return retrieval.search_wand(queries, index, args.k, args.bm25_k1, args.bm25_b)
    return lsi.search_named(queries, index, lsi.LatentIndex.load(spark, f"{_path(args)}/lsi"), args.k, getattr(args, "n_probe", None))


def sizes(index: Index) -> DataFrame:
    """The compression report of an index keyed by names: documents are numbered in name order."""
    numbers = numbered(index.doc_stats, "doc_id", "number")
    return compression.report(index.postings.join(numbers, "doc_id").select("term", F.col("number").alias("doc_id"), "tf"))


def cmd_index(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    began = time.time()
    index = build(spark, args)
    out = index.summary().crossJoin(sizes(index).where(F.col("encoder") == args.compression).select("encoder", "total_bytes"))
    out.show(truncate=False)
    print(f"built in {time.time() - began:.1f} s")
    return out


def cmd_search(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    if not (args.query or args.query_file):
        raise SystemExit(1)
    parts = [as_queries(spark, args.query)] if args.query else []
    parts += [read_queries(spark, args.query_file)] if args.query_file else []
    queries = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    # lines without an id are told apart by their words
    queries = queries.withColumn("qid", F.when(F.col("qid") == "*", F.concat(F.lit("* "), F.col("query"))).otherwise(F.col("qid")))
    out = results_of(spark, args, args.method, queries).orderBy("qid", "rank")
    out.show(1000, truncate=False)
    return out


def cmd_lsi(spark: SparkSession, args: argparse.Namespace) -> None:
    began = time.time()
    build_latent(spark, args)
    print(f"built in {time.time() - began:.1f} s")


def cmd_evaluate(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Means of the metrics by method, and the best method of each if there are several."""
    methods = ["tfidf", "bm25", "lsi"] if args.method == "all" else [args.method]
    queries = read_evaluation_queries(spark, args.query_file)
    number = F.regexp_extract("qid", r"([0-9]+)$", 1).cast("int")
    queries = queries.where(number.isNull() | (number <= args.max_q_id))
    qrels = read_qrels(spark, args.qrel_file).where(F.col("docno") <= args.max_doc_id)
    if args.lsi_build:
        build_latent(spark, args)
    judged = {}
    for m in methods:
        found = with_document_numbers(results_of(spark, args, m, queries), "doc_id")
        judged[m] = found.select("qid", "rank", F.col("docno").alias("doc_id"))
    table = evaluation.compare(judged, qrels.withColumnRenamed("docno", "doc_id"), queries)
    table.show(truncate=False)
    if len(methods) > 1:
        evaluation.best_methods(table, methods).show(truncate=False)
    return table


def cmd_compress(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    out = sizes(Index.load(spark, _path(args)))
    out.show(truncate=False)
    return out


COMMANDS = {"index": cmd_index, "search": cmd_search, "lsi": cmd_lsi, "evaluate": cmd_evaluate, "compress": cmd_compress}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestone")
    verbs = top.add_subparsers(dest="verb", required=True)
    own = {}
    for name in COMMANDS:
        own[name] = p = verbs.add_parser(name)
        p.add_argument("--output-dir", default="index")
        p.add_argument("--index-name", default="main_index")
        p.add_argument("--compression", choices=sorted(CODECS), default="vbe")
    for name in ("index", "lsi", "evaluate"):
        own[name].add_argument("--data-dir", default="collection")
    own["index"].add_argument("--mode", choices=MODES, default="bsbi")
    own["index"].add_argument("--block-size", type=int, default=1_000_000, help="accepted for compatibility: the result does not depend on it")
    own["search"].add_argument("--method", choices=METHODS, default="bm25")
    own["search"].add_argument("--query")
    own["search"].add_argument("--query-file")
    own["search"].add_argument("-k", type=int, default=10)
    own["evaluate"].add_argument("--method", choices=("tfidf", "bm25", "lsi", "all"), default="all")
    own["evaluate"].add_argument("--qrel-file", default="qrels.txt")
    own["evaluate"].add_argument("--query-file", default="queries.txt")
    own["evaluate"].add_argument("-k", type=int, default=1000)
    own["evaluate"].add_argument("--max-q-id", type=int, default=30)
    own["evaluate"].add_argument("--max-doc-id", type=int, default=1033)
    own["evaluate"].add_argument("--lsi-build", action="store_true")
    for name in ("search", "evaluate"):
        own[name].add_argument("--bm25-k1", type=float, default=1.2)
        own[name].add_argument("--bm25-b", type=float, default=0.75)
    for name in ("lsi", "evaluate"):
        own[name].add_argument("--n-components", type=int, default=100)
        own[name].add_argument("--svd-algorithm", choices=("randomized", "arpack"), default="randomized")
        own[name].add_argument("--n-probe", type=int, default=10)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None):
    args = parser().parse_args(argv)
    return COMMANDS[args.verb](spark or session(), args)


if __name__ == "__main__":
    main(sys.argv[1:])
