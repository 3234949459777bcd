"""The registered queries of the retrieval engine and the DuckDB SQL that each is compared with.

``documents`` is the collection and ``benchmark`` the query set, both whole. A document is relevant to a query if it has every distinct
term of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scoring
from .functions.codecs import bit_length, gamma_string
from .functions.text import WHITE_SPACE, document_number, query_id, query_text, tokens
from .operators.blocks import counted
from .operators import compression, evaluation, lsi, retrieval, vector, vocabulary
from .operators.index import Index, block_postings, build_index, count_postings, gap_rows, merge_full_outer, merge_runs, postings_arrays, token_rows
from .shared import materialize, shared_path
from .sources import collection

PREFIX, TERM, ABSENT = "ent", "the", "no-such-term"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_BUILT: dict[tuple[str, str, str], object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _once(spark: SparkSession, sf_dir: str, what: str, make: Callable[[], object]):
    """Indexes are built once for a session and a folder, as they would be stored once."""
    key = (spark.sparkContext.applicationId, sf_dir, what)
    if key not in _BUILT:
        _BUILT[key] = make()
    return _BUILT[key]


def index_of(spark: SparkSession, sf_dir: str) -> Index:
    return _once(spark, sf_dir, "index", lambda: build_index(table(spark, sf_dir, "documents")))


def latent_of(spark: SparkSession, sf_dir: str) -> lsi.LatentIndex:
    return _once(spark, sf_dir, "latent", lambda: lsi.build_lsi(index_of(spark, sf_dir)))


def queries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def qrels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, doc_id, rel): documents that have every distinct term of a query."""
    return retrieval.containing(queries_of(spark, sf_dir), index_of(spark, sf_dir)).withColumn("rel", F.lit(1))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _split(text: str) -> str:
    return f"[x FOR x IN regexp_split_to_array({text}, '{WHITE_SPACE}') IF x <> '']"


_TOK = f"tok AS (SELECT doc_id, unnest({_split('text')}) AS term FROM documents)"
_POST = f"{_TOK}, post AS (SELECT term, doc_id, CAST(count(*) AS INTEGER) AS tf FROM tok GROUP BY ALL)"
_STATS = f"""{_POST}, ts AS (SELECT term, count(*) AS df, max(tf) AS max_tf FROM post GROUP BY term),
ds AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS dl FROM post GROUP BY doc_id),
st AS (SELECT count(*) AS n, coalesce(avg(dl), 1.0) AS avgdl FROM ds)"""
_QUERY = f"""{_STATS}, qt AS (SELECT item_id AS qid, unnest({_split('text')}) AS term FROM benchmark),
q AS (SELECT qid, term, count(*) AS qtf FROM qt GROUP BY ALL), qd AS (SELECT qid, term, 1 AS qtf FROM q)"""
_TFIDF = "ln(n / df) * (1 + ln(tf))"
_IDF = "ln((n - df + 0.5) / (df + 0.5) + 1)"


def _bm25(k1: float = 1.2, b: float = 0.75) -> str:
    return f"{_IDF} * tf * ({k1}::DOUBLE + 1) / (tf + {k1}::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * dl / avgdl))"


def _scored(weight: str, terms: str = "q") -> str:
    return f"SELECT qid, doc_id, sum(qtf * {weight}) AS score FROM {terms} JOIN ts USING (term) JOIN post USING (term) JOIN ds USING (doc_id), st GROUP BY ALL"


def _ranked(scored: str, k: int = 10) -> str:
    return f"SELECT * FROM (SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM ({scored})) WHERE rank <= {k}"


def _search(scored: str, k: int = 10) -> str:
    return f"WITH {_QUERY} SELECT qid, rank, doc_id, round(score, 6) AS score FROM ({_ranked(scored, k)})"


# Index relations


@query(f"WITH {_TOK} SELECT term, count(*) AS n FROM tok GROUP BY term")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of every token of the collection."""
    return token_rows(table(spark, sf_dir, "documents")).groupBy("term").agg(F.count("*").alias("n"))


@query(f"WITH {_POST} SELECT * FROM post")
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings."""
    return counted(table(spark, sf_dir, "documents"))


@query(f"WITH {_STATS} SELECT doc_id, dl FROM ds")
def doc_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).doc_stats


@query(f"WITH {_STATS} SELECT term, df FROM ts")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).term_stats.select("term", "df")


@query(f"WITH {_STATS} SELECT term, max_tf FROM ts")
def max_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).term_stats.select("term", "max_tf")


@query(f"WITH {_STATS} SELECT n, round(avgdl, 6) AS avgdl FROM st")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(index_of(spark, sf_dir).collection, "avgdl")


@query(f"WITH t AS (SELECT source AS block, doc_id, unnest({_split('text')}) AS term FROM documents) SELECT block, term, doc_id, CAST(count(*) AS INTEGER) AS tf FROM t GROUP BY ALL")
def block_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of a block-wise build, a block for each source."""
    return block_postings(table(spark, sf_dir, "documents"), "source")


@query(f"WITH {_POST} SELECT * FROM post")
def merged_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block-wise build: runs merged."""
    return build_index(table(spark, sf_dir, "documents"), "bsbi", "source", stored=False).postings


@query(f"""WITH {_TOK}, b AS (SELECT item_id AS doc_id, unnest({_split('text')}) AS term FROM benchmark), u AS (SELECT term, doc_id FROM tok UNION ALL SELECT term, doc_id FROM b)
SELECT term, doc_id, CAST(count(*) AS INTEGER) AS tf FROM u GROUP BY ALL""")
def merge_runs_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs, documents and benchmark items of overlapping ids, merged by a full outer join."""
    items = count_postings(token_rows(table(spark, sf_dir, "benchmark"), "item_id"))
    return merge_full_outer(index_of(spark, sf_dir).postings, items)


@query(f"""WITH {_TOK}, b AS (SELECT item_id AS doc_id, unnest({_split('text')}) AS term FROM benchmark), u AS (SELECT term, doc_id FROM tok UNION ALL SELECT term, doc_id FROM b)
SELECT term, doc_id, CAST(count(*) AS INTEGER) AS tf FROM u GROUP BY ALL""")
def merge_runs_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same two runs merged as a union of runs."""
    items = count_postings(token_rows(table(spark, sf_dir, "benchmark"), "item_id"))
    return merge_runs(index_of(spark, sf_dir).postings, items)


@query(f"WITH {_STATS} SELECT (SELECT count(*) FROM ts) AS vocabulary, (SELECT count(*) FROM ds) AS documents, (SELECT count(*) FROM post) AS postings, (SELECT CAST(sum(dl) AS BIGINT) FROM ds) AS tokens")
def index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).summary()


@query(f"WITH t AS (SELECT page_id AS doc_id, unnest({_split('html')}) AS term FROM pages) SELECT term, doc_id, CAST(count(*) AS INTEGER) AS tf FROM t GROUP BY ALL")
def pages_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another collection: the markup of pages."""
    return counted(table(spark, sf_dir, "pages"), "page_id", "html")


@query(f"WITH {_TOK} SELECT DISTINCT row_number() OVER (ORDER BY term) - 1 AS term_id, term FROM (SELECT DISTINCT term FROM tok)")
def vocab_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense ids of the terms, in string order."""
    return vocabulary.id_map(index_of(spark, sf_dir).term_stats, "term", "term_id")


@query(f"WITH {_TOK} SELECT DISTINCT term FROM tok")
def vocab_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).term_stats.select("term").orderBy("term")


@query(f"WITH {_TOK} SELECT DISTINCT term FROM tok WHERE starts_with(term, '{PREFIX}')")
def vocab_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.with_prefix(index_of(spark, sf_dir).term_stats, PREFIX)


@query(f"""WITH {_TOK}, p(prefix) AS (VALUES ('{PREFIX}'), ('{ABSENT}'), ('')) SELECT prefix, prefix = '' OR EXISTS (SELECT 1 FROM tok WHERE starts_with(term, prefix)) AS found FROM p""")
def vocab_prefix_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = index_of(spark, sf_dir).term_stats
    rows = [vocabulary.prefix_exists(terms, p) for p in (PREFIX, ABSENT, "")]
    return rows[0].union(rows[1]).union(rows[2])


@query(f"WITH {_POST} SELECT * FROM post WHERE term = '{TERM}'")
def postings_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).lookup(TERM)


@query(f"WITH {_POST} SELECT term, doc_id >> 16 AS block, list(doc_id ORDER BY doc_id) AS doc_ids, list(tf ORDER BY doc_id) AS tfs FROM post GROUP BY ALL")
def postings_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings_arrays(index_of(spark, sf_dir).postings)


# Term weights


@query(f"WITH {_STATS} SELECT term, round(ln(n / df), 6) AS idf FROM ts, st")
def idf_classic(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = index_of(spark, sf_dir)
    return rounded(i.term_stats.crossJoin(F.broadcast(i.collection)).select("term", scoring.idf_classic(F.col("n"), F.col("df")).alias("idf")), "idf")


@query(f"WITH {_STATS} SELECT term, round({_IDF}, 6) AS idf FROM ts, st")
def idf_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = index_of(spark, sf_dir)
    return rounded(i.term_stats.crossJoin(F.broadcast(i.collection)).select("term", scoring.idf_bm25(F.col("n"), F.col("df")).alias("idf")), "idf")


@query(f"WITH {_STATS} SELECT term, round({_IDF} * max_tf * (1.2::DOUBLE + 1) / (max_tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE)), 6) AS bound FROM ts, st")
def bm25_upper_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = index_of(spark, sf_dir)
    bound = scoring.bm25_bound(scoring.idf_bm25(F.col("n"), F.col("df")), F.col("max_tf"))
    return rounded(i.term_stats.crossJoin(F.broadcast(i.collection)).select("term", bound.alias("bound")), "bound")


@query(f"WITH {_POST} SELECT term, doc_id, round(1 + ln(tf), 6) AS w FROM post")
def sublinear_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).postings.select("term", "doc_id", F.round(scoring.sublinear_tf(F.col("tf")), 6).alias("w"))


@query(f"WITH {_STATS} SELECT term, doc_id, round((1 + ln(tf)) * ln(n / greatest(df, 1)), 6) AS w FROM post JOIN ts USING (term), st")
def tdm_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lsi.weights(index_of(spark, sf_dir)), "w")


@query(f"WITH {_STATS}, s AS (SELECT (SELECT count(*) FROM ds) AS documents, (SELECT count(*) FROM ts) AS terms, (SELECT count(*) FROM post) AS entries) SELECT *, round(entries / (documents * terms), 9) AS density FROM s")
def tdm_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsi.matrix_shape(index_of(spark, sf_dir)).withColumn("density", F.round("density", 9))


@query(f"WITH {_QUERY} SELECT qid, term, round((1 + ln(qtf)) * ln(n / greatest(df, 1)), 6) AS w FROM q JOIN ts USING (term), st")
def lsi_query_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lsi.query_weights(queries_of(spark, sf_dir), index_of(spark, sf_dir)), "w")


# Retrieval


@query(_search(_scored(_TFIDF)))
def search_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(retrieval.search_tfidf(queries_of(spark, sf_dir), index_of(spark, sf_dir)), "score")


@query(_search(_scored(_bm25())))
def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(retrieval.search_bm25(queries_of(spark, sf_dir), index_of(spark, sf_dir)), "score")


@query(_search(_scored(_bm25(2.0, 0.4)), 25))
def search_bm25_k1_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(retrieval.search_bm25(queries_of(spark, sf_dir), index_of(spark, sf_dir), 25, 2.0, 0.4), "score")


@query(_search(_scored(_bm25(), "qd")))
def search_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(retrieval.search_wand(queries_of(spark, sf_dir), index_of(spark, sf_dir)), "score")


@query(_search(_scored(_bm25(), "qd")))
def search_wand_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows by bounds: documents that cannot reach a query's k best are not scored."""
    return rounded(retrieval.search_wand(queries_of(spark, sf_dir), index_of(spark, sf_dir), prune=True), "score")


@query(_search(_scored(_bm25())))
def search_stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over an index that was saved, in ranges of terms, and opened again."""

    def stored() -> Index:
        path = shared_path(spark, "saved")
        index_of(spark, sf_dir).save(path)
        return Index.load(spark, path)

    return rounded(retrieval.search_bm25(queries_of(spark, sf_dir), _once(spark, sf_dir, "saved", stored)), "score")


_LINES = [("r1", f"{TERM} {TERM} of {TERM}"), ("r2", f"{TERM} of"), ("r3", "de de la"), ("u1", f"{ABSENT} {TERM}"), ("u2", ABSENT), ("u3", "")]
_GIVEN = ", ".join(f"('{a}', '{b}')" for a, b in _LINES)
_LINE_QUERY = _STATS + f", g(qid, query) AS (VALUES {_GIVEN}), gt AS (SELECT qid, unnest({_split('query')}) AS term FROM g), q AS (SELECT qid, term, count(*) AS qtf FROM gt GROUP BY ALL)"


def _given(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_LINES, "qid string, query string")


@query(f"WITH {_LINE_QUERY} SELECT qid, rank, doc_id, round(score, 6) AS score FROM ({_ranked(_scored(_bm25()))})")
def search_repeated_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repeated query term counts once for each occurrence; unknown terms and empty queries match nothing."""
    return rounded(retrieval.search_bm25(_given(spark), index_of(spark, sf_dir)), "score")


@query(f"WITH {_LINE_QUERY} SELECT qid, rank, doc_id, round(score, 6) AS score FROM ({_ranked(_scored(_TFIDF))})")
def search_unknown_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(retrieval.search_tfidf(_given(spark), index_of(spark, sf_dir)), "score")


@query()
def lsi_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latent search; no SQL has the decomposition, so it is tested against numpy."""
    return rounded(lsi.search_lsi(queries_of(spark, sf_dir), index_of(spark, sf_dir), latent_of(spark, sf_dir)), "score")


# Codecs

_GAPS = f"{_POST}, g AS (SELECT term, doc_id, tf, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term ORDER BY doc_id), 0) AS gap FROM post)"
_BITS = "length(bin(CAST({} AS BIGINT)))"


def _sizes(gap: str, tf: str) -> str:
    return f"WITH {_GAPS} SELECT term, CAST(ceil(sum({gap}) / 8) AS BIGINT) AS postings_bytes, CAST(ceil(sum({tf}) / 8) AS BIGINT) AS tf_bytes FROM g GROUP BY term"


_VB = f"8 * CAST(ceil({_BITS} / 7) AS BIGINT)"
_GAMMA = f"(2 * {_BITS} - 1)"


@query(f"WITH {_GAPS} SELECT * FROM g")
def gap_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gap_rows(index_of(spark, sf_dir).postings)


@query(f"WITH {_POST} SELECT term, doc_id FROM post")
def gap_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids back from stored lists of gaps, which hold no ids."""
    return compression.from_gaps(materialize(compression.gap_lists(index_of(spark, sf_dir).postings), "gaps"))


@query(_sizes("64", "64"))
def standard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.term_sizes(index_of(spark, sf_dir).postings, "standard")


@query(_sizes(_VB.format("gap"), _VB.format("tf")))
def vbe_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.term_sizes(index_of(spark, sf_dir).postings, "vbe")


@query(_sizes(_GAMMA.format("gap + 1"), _GAMMA.format("tf")))
def elias_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.term_sizes(index_of(spark, sf_dir).postings, "elias")


@query(f"""WITH {_GAPS}, s AS (SELECT term, 8 * count(*) AS sp, 8 * count(*) AS st, sum({_VB.format("gap")}) / 8 AS vp, sum({_VB.format("tf")}) / 8 AS vt,
  ceil(sum({_GAMMA.format("gap + 1")}) / 8) AS ep, ceil(sum({_GAMMA.format("tf")}) / 8) AS et FROM g GROUP BY term),
t AS (SELECT 'standard' AS encoder, count(*) AS terms, sum(sp) AS p, sum(st) AS t, sum(sp) + sum(st) AS base FROM s
  UNION ALL SELECT 'vbe', count(*), sum(vp), sum(vt), sum(sp) + sum(st) FROM s UNION ALL SELECT 'elias', count(*), sum(ep), sum(et), sum(sp) + sum(st) FROM s)
SELECT encoder, terms, CAST(p AS BIGINT) AS postings_bytes, CAST(t AS BIGINT) AS tf_bytes, CAST(p + t AS BIGINT) AS total_bytes,
  round((p + t) / base, 6) AS ratio, round((1 - (p + t) / base) * 100, 6) AS saving FROM t""")
def compression_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compression.report(index_of(spark, sf_dir).postings), "ratio", "saving")


def _vb_sql(v: str) -> str:
    """Hexadecimal variable-byte digits of a number, in SQL."""
    n = f"CAST(ceil({_BITS.format(v)} / 7) AS BIGINT)"
    return f"array_to_string([lpad(lower(to_hex(((CAST({v} AS BIGINT) >> CAST(7 * ({n} - i) AS INTEGER)) & 127) + CASE WHEN i = {n} THEN 128 ELSE 0 END)), 2, '0') FOR i IN range(1, {n} + 1)], '')"


@query(f"WITH {_GAPS} SELECT term, doc_id >> 16 AS block, string_agg({_vb_sql('gap')}, '' ORDER BY doc_id) AS postings_hex, string_agg({_vb_sql('tf')}, '' ORDER BY doc_id) AS tf_hex FROM g GROUP BY ALL")
def vbe_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.vbe_segments(index_of(spark, sf_dir).postings)


@query(f"WITH {_GAPS} SELECT term, doc_id, repeat('0', length(bin(gap + 1)) - 1) || bin(gap + 1) AS gap_bits, repeat('0', length(bin(CAST(tf AS BIGINT))) - 1) || bin(CAST(tf AS BIGINT)) AS tf_bits FROM g")
def elias_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gap_rows(index_of(spark, sf_dir).postings)
    return rows.select("term", "doc_id", gamma_string(F.col("gap") + 1).alias("gap_bits"), gamma_string(F.col("tf").cast("bigint")).alias("tf_bits"))


def _roundtrip(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        stored = materialize(compression.encoded(index_of(spark, sf_dir).postings, name), f"encoded-{name}")
        return compression.decoded(stored, name)

    run.__name__ = f"{name}_roundtrip"
    run.__doc__ = f"All postings encoded by {name}, stored, read and decoded."
    return run


for _name in ("standard", "vbe", "elias"):
    query(f"WITH {_POST} SELECT * FROM post")(_roundtrip(_name))


@query(f"WITH {_POST} SELECT doc_id, term, CAST({_BITS.format('tf')} AS BIGINT) AS bits FROM post")
def tf_bit_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir).postings.select("doc_id", "term", bit_length(F.col("tf").cast("bigint")).cast("bigint").alias("bits"))


# Evaluation

_QRELS = f"""{_QUERY}, size AS (SELECT qid, count(*) AS size FROM qd GROUP BY qid),
have AS (SELECT qid, doc_id, count(*) AS have FROM qd JOIN post USING (term) GROUP BY ALL),
qrels AS (SELECT qid, doc_id, 1 AS rel FROM have JOIN size USING (qid) WHERE have = size)"""


def _judged(scored: str, name: str, k: int = 1000) -> str:
    """A common table of ranked, judged results."""
    return f"{name} AS (SELECT r.qid, r.rank, r.doc_id, coalesce(j.rel, 0) AS rel FROM ({_ranked(scored, k)}) r LEFT JOIN qrels j ON r.qid = j.qid AND r.doc_id = j.doc_id)"


def _metric_sql(name: str, key: str = "qid") -> str:
    return f"""{name}_x AS (SELECT *, sum(CASE WHEN rel = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY rank ROWS UNBOUNDED PRECEDING) AS hits,
  row_number() OVER (PARTITION BY qid ORDER BY rel DESC) AS place FROM {name}),
{name}_y AS (SELECT qid, 0.2::DOUBLE * sum(rel * pow(0.8::DOUBLE, rank - 1)) AS rbp, sum(rel / log2(rank + 1.0::DOUBLE)) AS dcg, sum(rel / log2(place + 1.0::DOUBLE)) AS best,
  sum(CASE WHEN rel = 1 THEN hits / rank ELSE 0 END) AS s, sum(rel) AS total FROM {name}_x GROUP BY qid),
{name}_m AS (SELECT qid, rbp, dcg, CASE WHEN best > 0 THEN dcg / best ELSE 0 END AS ndcg, CASE WHEN total > 0 THEN s / total ELSE 0 END AS ap FROM {name}_y)"""


_RANK = f"{_QRELS}, {_judged(_scored(_bm25()), 'r')}"
_EACH = f"WITH {_RANK}, {_metric_sql('r')}"


def _ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = retrieval.search_bm25(queries_of(spark, sf_dir), index_of(spark, sf_dir), 1000)
    return evaluation.ranking(results, qrels_of(spark, sf_dir)).select("qid", "rank", "doc_id", "rel")


@query(f"WITH {_QRELS} SELECT qid, doc_id, CAST(rel AS INTEGER) AS rel FROM qrels")
def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qrels_of(spark, sf_dir)


@query(f"WITH {_RANK} SELECT qid, rank, doc_id, CAST(rel AS INTEGER) AS rel FROM r")
def ranking_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 to rank 1000 with the relevance of each result."""
    return _ranking(spark, sf_dir)


@query(f"{_EACH} SELECT qid, round(rbp, 6) AS rbp FROM r_m")
def rbp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.rbp(_ranking(spark, sf_dir)), "rbp")


@query(f"{_EACH} SELECT qid, round(dcg, 6) AS dcg FROM r_m")
def dcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.dcg(_ranking(spark, sf_dir)), "dcg")


@query(f"WITH {_RANK} SELECT qid, round(sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1.0::DOUBLE) ELSE 0 END), 6) AS dcg FROM r GROUP BY qid")
def dcg_at_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.dcg(_ranking(spark, sf_dir), 10), "dcg")


@query(f"{_EACH} SELECT qid, round(ndcg, 6) AS ndcg FROM r_m")
def ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.ndcg(_ranking(spark, sf_dir)), "ndcg")


@query(f"""WITH {_RANK}, x AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rel DESC) AS place FROM r),
y AS (SELECT qid, sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1.0::DOUBLE) ELSE 0 END) AS dcg, sum(CASE WHEN place <= 10 THEN rel / log2(place + 1.0::DOUBLE) ELSE 0 END) AS best FROM x GROUP BY qid)
SELECT qid, round(CASE WHEN best > 0 THEN dcg / best ELSE 0 END, 6) AS ndcg FROM y""")
def ndcg_at_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.ndcg(_ranking(spark, sf_dir), 10), "ndcg")


@query(f"{_EACH} SELECT qid, round(ap, 6) AS ap FROM r_m")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluation.average_precision(_ranking(spark, sf_dir)), "ap")


_MEANS = "round(avg(coalesce(rbp, 0)), 6) AS rbp, round(avg(coalesce(dcg, 0)), 6) AS dcg, round(avg(coalesce(ndcg, 0)), 6) AS ndcg, round(avg(coalesce(ap, 0)), 6) AS ap"
_EVERY = "(SELECT DISTINCT item_id AS qid FROM benchmark)"


@query(f"{_EACH} SELECT {_MEANS} FROM {_EVERY} LEFT JOIN r_m USING (qid)")
def evaluate_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = retrieval.search_bm25(queries_of(spark, sf_dir), index_of(spark, sf_dir), 1000)
    return rounded(evaluation.evaluate(results, qrels_of(spark, sf_dir), queries_of(spark, sf_dir)), *evaluation.METRICS)


_WEIGHTS = {"tfidf": _scored(_TFIDF), "bm25": _scored(_bm25()), "wand": _scored(_bm25(), "qd")}
_COMPARED = f"WITH {_QRELS}, " + ", ".join(f"{_judged(sql, name)}, {_metric_sql(name)}" for name, sql in _WEIGHTS.items())
_COMPARED += ", c AS (" + " UNION ALL ".join(f"SELECT '{name}' AS method, {_MEANS} FROM {_EVERY} LEFT JOIN {name}_m USING (qid)" for name in _WEIGHTS) + ")"


def _comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, i = queries_of(spark, sf_dir), index_of(spark, sf_dir)
    results = {name: search(q, i, 1000) for name, search in retrieval.METHODS.items()}
    return rounded(evaluation.compare(results, qrels_of(spark, sf_dir), q), *evaluation.METRICS)


@query(f"{_COMPARED} SELECT * FROM c")
def compare_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _comparison(spark, sf_dir)


@query(f"""{_COMPARED}, l AS (UNPIVOT c ON rbp, dcg, ndcg, ap INTO NAME metric VALUE value), h AS (SELECT *, max(value) OVER (PARTITION BY metric) AS high FROM l)
SELECT metric, arg_min(method, CASE method WHEN 'tfidf' THEN 1 WHEN 'bm25' THEN 2 ELSE 3 END) AS method,
  arg_min(value, CASE method WHEN 'tfidf' THEN 1 WHEN 'bm25' THEN 2 ELSE 3 END) AS value FROM h WHERE value >= high - 1e-9 GROUP BY metric""")
def best_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.best_methods(_comparison(spark, sf_dir), list(retrieval.METHODS))


# Sources

_QUERY_LINES = ["Q1 alpha beta", "Quick brown fox", "Q7", "  ", "plain words", "　Q2 x y "]
_PATHS = ["./collection/1/17.txt", "a/b/c/9.txt", "/x/y/12.txt", "b/c/3.txt", "./collection/1/none.txt", "./collection/2/18.md"]
_VALUES = lambda xs: ", ".join("(" + repr(x) + ")" for x in xs)
_WORDS = _split("line")


@query(f"""WITH l(line) AS (VALUES {", ".join(f"('{x}')" for x in _QUERY_LINES)}), w AS (SELECT line, {_WORDS} AS w FROM l)
SELECT CASE WHEN len(w) >= 2 AND starts_with(w[1], 'Q') THEN w[1] ELSE '*' END AS qid,
  array_to_string(CASE WHEN len(w) >= 2 AND starts_with(w[1], 'Q') THEN w[2:] ELSE w END, ' ') AS query FROM w WHERE len(w) > 0""")
def query_file_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(x,) for x in _QUERY_LINES], "line string").where(F.size(tokens("line")) > 0)
    return rows.select(query_id("line").alias("qid"), query_text("line").alias("query"))


@query(f"WITH p(path) AS (VALUES {', '.join(f'({x!r})' for x in _PATHS)}) SELECT path, TRY_CAST(nullif(regexp_extract(path, '/.*/.*/(.*)\\.txt', 1), '') AS INTEGER) AS docno FROM p")
def docno_from_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in _PATHS], "path string").select("path", document_number("path").alias("docno"))


def _text_file(spark: SparkSession, name: str, lines: DataFrame) -> str:
    """One column of lines written as text files in the shared folder."""
    path = shared_path(spark, name)
    lines.write.text(path)
    return path


@query(f"""WITH w AS (SELECT item_id, {_split('text')} AS w FROM benchmark), l AS (SELECT CASE WHEN item_id % 3 = 0 THEN w ELSE list_concat(['Q' || item_id], w) END AS w FROM w)
SELECT CASE WHEN len(w) >= 2 AND starts_with(w[1], 'Q') THEN w[1] ELSE '*' END AS qid,
  array_to_string(CASE WHEN len(w) >= 2 AND starts_with(w[1], 'Q') THEN w[2:] ELSE w END, ' ') AS query FROM l WHERE len(w) > 0""")
def query_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query file of all benchmark items, two thirds with ids, written and read."""
    line = F.array_join(tokens("text"), " ")
    lines = table(spark, sf_dir, "benchmark").select(F.when(F.col("item_id") % 3 == 0, line).otherwise(F.concat(F.lit("Q"), "item_id", F.lit(" "), line)))
    return collection.read_queries(spark, _text_file(spark, "queries", lines))


@query(f"WITH w AS (SELECT item_id, {_split('text')} AS w FROM benchmark) SELECT 'Q' || item_id AS qid, array_to_string(w, ' ') AS query FROM w")
def evaluation_query_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An evaluation query file of all benchmark items, written and read."""
    lines = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("Q"), "item_id", F.lit("  "), F.array_join(tokens("text"), " ")))
    return collection.read_evaluation_queries(spark, _text_file(spark, "queries", lines))


@query(f"WITH {_QRELS} SELECT 'Q' || qid AS qid, CAST(doc_id AS INTEGER) AS docno, 1 AS rel FROM qrels")
def qrels_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judgement file of all relevant pairs, written and read."""
    lines = qrels_of(spark, sf_dir).select(F.concat(F.lit("Q"), "qid", F.lit(" "), "doc_id"))
    return collection.read_qrels(spark, _text_file(spark, "qrels", lines))


# Vectors


def _vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20."""
    return table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.vec_id AS qid, e.vec_id, list_inner_product(q.v, e.v) AS score FROM e q, e WHERE q.vec_id % 20 = 0)
SELECT qid, rank, vec_id, round(score, 6) AS score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, vec_id) AS INTEGER) AS rank FROM s) WHERE rank <= 10""")
def vector_topk_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(vector.search_exact(_vector_queries(spark, sf_dir), table(spark, sf_dir, "embeddings")), "score")


@query("""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM e)
SELECT vec_id, i, round(CASE WHEN n > 0 THEN v[i] / n ELSE v[i] END, 6) AS x FROM n, LATERAL (SELECT unnest(range(1, len(v) + 1)) AS i)""")
def vector_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = vector.normalize(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding")
    return rounded(unit.select("vec_id", F.posexplode("embedding").alias("p", "x")).select("vec_id", (F.col("p") + 1).cast("bigint").alias("i"), "x"), "x")


@query()
def vector_topk_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search by clusters: an approximation, tested by its recall."""
    cells, centroids = _once(spark, sf_dir, "cells", lambda: vector.build_cells(table(spark, sf_dir, "embeddings")))
    queries = _vector_queries(spark, sf_dir)
    n_probe = _once(spark, sf_dir, "n_probe", lambda: vector.probes_for(queries, cells, centroids))
    return rounded(vector.search_cells(queries, cells, centroids, n_probe=n_probe), "score")
