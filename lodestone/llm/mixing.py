"""Temperature mixing of sources, in DataFrame operations only.

Source shares p are raised to an exponent a in [0, 1] and normalised. Entropy falls and the need to repeat small sources
shrinks as a grows, so both conditions are met by bisecting the exponent, eighteen halvings deep. The weights are realised as a budgeted block permutation: in every epoch a source's documents are shuffled by a
keyed hash, its stream stops at its token budget, and the stream is laid evenly over the blocks, so every block holds
the target mixture.

Token sums within a source are prefix sums in two levels: over hash ranges of the shuffle order, then inside each range,
so a source that holds a third of all rows is summed by thousands of tasks.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialize, writers
from .rowkeys import row_key, unused

#: Words as everywhere in this subpackage.
WORD = r"[^\x20\x09-\x0D]+"
#: Parameters of the registered query and of the pipeline: entropy as a share of the largest possible, repeats of a
#: source, output tokens as a share of the input's, tokens of a block.
ENTROPY, REPEATS, BUDGET, BLOCK_TOKENS, SEED = 0.97, 4.0, 1.0, 100_000, 17
#: Binary places of the exponent.
BITS = 18
#: Budgets that are whole but for the last digits of a sum are whole, in whatever order it was added.
ROUNDED_UP = 1 + 1e-12
#: Shares of a source's documents.
SALTS = 64
#: Bytes of documents whose token counts make a file.
COUNTED = 1 << 30


def source_tokens(docs: DataFrame, id_col: str, text_col: str, source_col: str, keyed: bool = False) -> DataFrame:
    """(id, source, n_tokens): words of each whole text, and with ``keyed`` the row's key (x, y). A null source is the source ''; a null text has no words."""
    n = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    key = row_key(id_col, text_col)
    more = [key["x"].alias("x"), key["y"].alias("y")] if keyed else []
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), n.alias("n_tokens"), *more)


def exponent(totals: DataFrame, entropy: float, repeats: float, budget: float) -> float:
    """The largest exponent whose entropy reaches ``entropy``, or the smallest that repeats no source more than ``repeats`` times, whichever is larger.

    ``totals`` (source, n > 0). Entropy is a share of the log of the number of sources. Both exponents are bisected at once, in
    multiples of 2**-BITS: a round is one aggregate of ``totals`` to two booleans. No exponent up to 1 that keeps the limit: 1.
    """
    total, sources = totals.agg(F.sum("n"), F.count("*")).first()
    if not sources:
        return 1.0
    shares = totals.select("n", F.ln(F.col("n") / F.lit(total)).alias("l"))
    one = 1 << BITS
    # the entropy is reached up to ``wide``, not from ``narrow`` on; repeats are too many up to ``many``, not from ``few`` on
    wide, narrow, many, few = 0, one + 1, -1, one
    while narrow - wide > 1 or few - many > 1:
        x, y = (wide + narrow) // 2, (many + few) // 2
        e, d = F.exp(F.lit(x / one) * F.col("l")), F.exp(F.lit(y / one) * F.col("l"))
        sums = shares.agg(F.sum(e).alias("z"), F.sum(e * F.col("l")).alias("zl"), F.sum(d).alias("w"), F.max(d / F.col("n")).alias("top"))
        reached = F.ln("z") - F.lit(x / one) * F.col("zl") / F.col("z") >= F.lit(entropy * log(sources)) - F.lit(1e-9)
        kept = F.lit(budget) * F.lit(total) * F.col("top") / F.col("w") <= F.lit(repeats) + F.lit(1e-9)
        reached, kept = sums.select(reached, kept).first()
        if narrow - wide > 1:
            wide, narrow = (x, narrow) if reached else (wide, x)
        if few - many > 1:
            many, few = (many, y) if kept else (y, few)
    return max(wide, few) / one


def mixture(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    entropy: float = ENTROPY,
    repeats: float = REPEATS,
    budget: float = BUDGET,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = SEED,
) -> DataFrame:
    """(block, position, id_col, source, epoch, n_tokens): the mixed order of all documents that the budget takes.

    A source's budget is its weight times ``budget`` times all tokens, in whole tokens. Epoch by epoch its documents follow in the order of
    md5(seed:epoch:id), ties by id and token count; a document is taken if the tokens before it are under the budget. Block
    numbers are the share of the budget before the document, so repeated rows and ids keep their own places. Documents without words
    are taken where they fall and cost nothing; a source without any word is left out, as is everything if no text has
    words. A null id is shuffled as the text ''. Columns of other names are ignored. No rows: no rows.
    """
    return _placed(materialize(source_tokens(docs, id_col, text_col, source_col), "tokens"), id_col, entropy, repeats, budget, block_tokens, seed)


def _placed(rows: DataFrame, id_col: str, entropy: float, repeats: float, budget: float, block_tokens: int, seed: int) -> DataFrame:
    """``mixture`` of (id, source, n_tokens) rows; further columns settle ties and go along."""
    more = rows.columns[3:]
    totals = rows.groupBy("source").agg(F.sum("n_tokens").alias("n")).where("n > 0")
    totals = materialize(totals, "totals")
    a = exponent(totals, entropy, repeats, budget)
    total = totals.agg(F.sum("n")).first()[0] or 0
    power = totals.withColumn("e", F.exp(F.lit(a) * F.ln(F.col("n") / F.lit(total))))
    norm = power.agg(F.sum("e")).first()[0] or 1.0
    target = F.floor(F.lit(budget) * F.lit(total) * F.col("e") / F.lit(norm) * F.lit(ROUNDED_UP)).cast("long")
    blocks = max(1, ceil(budget * total / block_tokens))
    plan = power.select("source", "n", target.alias("target"), F.lit(blocks).cast("long").alias("blocks")).where("target > 0")
    epochs = F.explode(F.expr("sequence(0L, cast(ceil(target / n) as long) - 1)"))
    # a source's row of the plan is copied for SALTS shares of its documents, so a hot source is joined by as many tasks
    plan = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id", "n_tokens"), F.lit(SALTS)).cast("int"))
    taken = salted.join(plan, ["source", "salt"]).select("id", "source", "n_tokens", *more, "n", "target", "blocks", epochs.alias("epoch"))
    key = F.md5(F.concat_ws(":", F.lit(seed), "epoch", F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"))
    taken = taken.withColumn("key", key).withColumn("range", F.substring("key", 1, 3))
    sums = taken.groupBy("source", "epoch", "range").agg(F.sum("n_tokens").alias("in_range"))
    before = Window.partitionBy("source", "epoch").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "epoch", "range", F.coalesce(F.sum("in_range").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("source", "epoch", "range").orderBy("key", F.coalesce("id", F.lit(-1)), "n_tokens", *more).rowsBetween(Window.unboundedPreceding, -1)
    placed = taken.withColumn("own", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(sums, ["source", "epoch", "range"])
    placed = placed.withColumn("start", F.col("epoch") * F.col("n") + F.col("before") + F.col("own")).where("start < target")
    block = F.least(F.floor(F.col("start").cast("double") / F.col("target") * F.col("blocks")), F.col("blocks") - 1).cast("long")
    order = Window.partitionBy("block").orderBy("key", "source", F.coalesce("id", F.lit(-1)), "n_tokens", *more)
    out = placed.withColumn("block", block).withColumn("position", F.row_number().over(order).cast("long"))
    return out.select("block", "position", F.col("id").alias(id_col), "source", "epoch", "n_tokens", *more)


def mixed_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    entropy: float = ENTROPY,
    repeats: float = REPEATS,
    budget: float = BUDGET,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = SEED,
) -> DataFrame:
    """``mixture`` with the text of each row as ``text``, one row for each place.

    Rows are told apart by id and text, so null and repeated ids keep their own texts. The counts, some 40 bytes a row, are exchanged
    before they are written, so the tasks that read the texts open no files.
    """
    counted = source_tokens(docs, id_col, text_col, source_col, keyed=True)
    rows = materialize(counted.repartition(writers(docs, COUNTED)), "tokens")
    plan = _placed(rows, unused(["x", "y"], id_col), entropy, repeats, budget, block_tokens, seed)
    key = row_key(id_col, text_col)
    texts = docs.select(key["x"].alias("x"), key["y"].alias("y"), F.col(text_col).alias("text")).dropDuplicates(["x", "y"])
    return plan.join(texts, ["x", "y"]).drop("x", "y").withColumnRenamed(unused(["x", "y"], id_col), id_col)


#: The SQL has no loop, so it searches the same multiples by sections: 64 cubed is 2**BITS.
SECTIONS, ROUNDS = 64, 3


def oracle(entropy: float = ENTROPY, repeats: float = REPEATS, budget: float = BUDGET, block_tokens: int = BLOCK_TOKENS, seed: int = SEED) -> str:
    """``mixture`` over ``documents`` in DuckDB SQL."""
    rounds, low, high, step = [], "0.0", "0.0", 1.0
    for k in range(ROUNDS):
        step /= SECTIONS
        last = k == ROUNDS - 1
        found_low = "coalesce(max(CASE WHEN kind = 'h' AND wide THEN a END), 0.0)"
        found_high = "coalesce(min(CASE WHEN kind = 'r' AND few THEN a END), 1.0)"
        rounds.append(f"""
g{k} AS (SELECT kind, a, sum(exp(a * l)) AS z, sum(exp(a * l) * l) AS y, max(exp(a * l) / n) AS top
  FROM shares, (SELECT 'h' AS kind, {low} + i * {step!r}::DOUBLE AS a FROM range({SECTIONS + 1}) t(i)
                UNION ALL SELECT 'r', {high} + i * {step!r}::DOUBLE FROM range({SECTIONS + 1}) t(i)) GROUP BY kind, a),
h{k} AS (SELECT kind, a, ln(z) - a * y / z >= {entropy!r}::DOUBLE * ln((SELECT count(*) FROM totals)) - 1e-9 AS wide,
                {budget!r}::DOUBLE * (SELECT s FROM base) * top / z <= {repeats!r}::DOUBLE + 1e-9 AS few FROM g{k}),
f{k} AS (SELECT {found_low if last else f'least({1 - step!r}::DOUBLE, {found_low})'} AS low,
                {found_high if last else f'greatest(0.0, {found_high} - {step!r}::DOUBLE)'} AS high FROM h{k})""")
        low, high = f"(SELECT low FROM f{k})::DOUBLE", f"(SELECT high FROM f{k})::DOUBLE"
    return f"""
WITH tok AS (SELECT doc_id AS id, coalesce(source, '') AS source,
    CAST(len([x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF x <> '']) AS BIGINT) AS n_tokens FROM documents),
totals AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS n FROM tok GROUP BY source HAVING sum(n_tokens) > 0),
base AS (SELECT CAST(sum(n) AS DOUBLE) AS s FROM totals),
shares AS (SELECT source, n, ln(n / (SELECT s FROM base)) AS l FROM totals),{",".join(rounds)},
e AS (SELECT source, n, exp((SELECT greatest(low, high) FROM f{ROUNDS - 1}) * l) AS e FROM shares),
plan AS (SELECT source, n, CAST(floor({budget!r}::DOUBLE * (SELECT s FROM base) * e / (SELECT sum(e) FROM e) * {ROUNDED_UP!r}::DOUBLE) AS BIGINT) AS target,
    greatest(1, CAST(ceil({budget!r}::DOUBLE * (SELECT s FROM base) / {block_tokens}) AS BIGINT)) AS blocks FROM e),
taken AS (SELECT id, source, n_tokens, n, target, blocks, unnest(range(CAST(ceil(target / n) AS BIGINT))) AS epoch
    FROM tok JOIN plan USING (source) WHERE target > 0),
keyed AS (SELECT *, md5(concat_ws(':', '{seed}', CAST(epoch AS VARCHAR), coalesce(CAST(id AS VARCHAR), ''))) AS key FROM taken),
placed AS (SELECT *, epoch * n + coalesce(CAST(sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY key, coalesce(id, -1), n_tokens
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start FROM keyed),
cut AS (SELECT *, least(CAST(floor(start::DOUBLE / target * blocks) AS BIGINT), blocks - 1) AS block FROM placed WHERE start < target)
SELECT block, row_number() OVER (PARTITION BY block ORDER BY key, source, coalesce(id, -1), n_tokens) AS position,
    id AS doc_id, source, epoch, n_tokens FROM cut
"""


ORACLE = oracle()
