"""Mixing sources to target weights: token weights raked to source, language and topic marginals, then sampled by document.

All of it is DataFrame operations. Documents are summed to cells (source, language, topic) first; raking works on cells, so its
size is the number of distinct combinations and not of documents.

A document can be taken once, so no value can give more tokens than it has. Targets are made feasible first: what a value lacks
is spread over the values that have room, in proportion to their shares. Raking then fits one factor for each value: a cell's
probability is the product of its three factors, 1 at most, and each step scales one dimension's factors by target / expected
tokens. Each document is taken if a hash of its id, as a number in [0, 1), lies below its cell's probability.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanforge.llm._shared import Scratch, table, written

#: Share of all tokens to take; the exponent that flattens the given shares into targets.
RATE, TEMPER, SEED = 0.5, 0.5, 42
#: Rounds of raking at most, and the largest change of a factor in a round at which it is done.
ROUNDS, SETTLED = 8, 1e-12
#: Rounds that are planned together, without a job between them.
AT_ONCE = 4
#: Cells up to which their table is broadcast (about 100 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 50_000
DIMENSIONS = ("source", "lang", "topic")
NONE = "(none)"
_WORD_GAP = r"[\x09-\x0D ]+"


def words_in(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), _WORD_GAP), "")).cast("long")


def topic_of(text: Column) -> Column:
    """A coarse topic from the form of the text."""
    return (
        F.when(F.coalesce(text, F.lit("")) == "", "empty")
        .when(F.contains(text, F.lit(" | ")), "table")
        .when(text.rlike("[#$%&*]{3}"), "symbols")
        .when(text.rlike("[A-Z]!! [A-Z]"), "capitals")
        .when(F.octet_length(text) < 1000, "short")
        .otherwise("prose")
    )


def with_cells(docs: DataFrame, source: str = "source", lang: str = "lang", text: str = "text", topic: Column | None = None) -> DataFrame:
    """(doc, source, lang, topic, tokens): each row of docs as a struct, and its cell (null: '(none)') and tokens.

    topic: any column of docs; a rule on the text by default.
    """
    topic = topic_of(F.col(text)) if topic is None else topic
    named = {"source": F.col(source), "lang": F.col(lang), "topic": topic}
    return docs.select(F.struct("*").alias("doc"), *(F.coalesce(c.cast("string"), F.lit(NONE)).alias(k) for k, c in named.items()), words_in(F.col(text)).alias("tokens"))


def tempered(cells: DataFrame, dimension: str, temper: float) -> DataFrame:
    """(value, share): the shares of tokens to the power temper, scaled to sum to one."""
    sums = cells.groupBy(F.col(dimension).alias("value")).agg(F.pow(F.sum("tokens").cast("double"), F.lit(temper)).alias("p"))
    return sums.crossJoin(F.broadcast(sums.agg(F.sum("p").alias("all")))).select("value", F.expr("try_divide(p, all)").alias("share"))


def feasible(cells: DataFrame, dimension: str, shares: DataFrame, wanted: float) -> DataFrame:
    """(value, target): the tokens to take of each value, at most those it has, wanted in all.

    target is the lesser of the value's tokens and level * share. Values in order of tokens / share are full up to some place;
    the level is the greatest of those that each place would give: one number, which comes to the driver.
    """
    have = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").cast("double").alias("have")).join(shares, "value").where("share > 0 AND have > 0")
    order = Window.orderBy(F.col("have") / F.col("share"), "value")
    before = F.coalesce(F.sum("have").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("share").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = have.select(((F.lit(wanted) - before) / after).alias("level")).agg(F.max("level")).first()[0]
    return have.select("value", F.least(F.col("have"), F.lit(level or 0.0) * F.col("share")).alias("target"))


def raked(cells: DataFrame, targets: dict[str, DataFrame], rate: float = RATE, rounds: int = ROUNDS) -> DataFrame:
    """cells(source, lang, topic, tokens) with probability, by iterative proportional fitting.

    targets: for each dimension, (value, share); values without a share are not taken. rate * all tokens are taken, or all
    that there is of the values with a share.
    """
    known = cells.where("tokens > 0")
    for k in DIMENSIONS:
        known = known.join(targets[k].where("share > 0").select(F.col("value").alias(k)), k, "left_semi")
    known = written(known, "cells")
    wanted = min((cells.agg(F.sum("tokens")).first()[0] or 0) * rate, float(known.agg(F.sum("tokens")).first()[0] or 0))
    now = known.withColumn("factor", F.lit(1.0))
    for k in DIMENSIONS:
        # Few values have many cells; their targets are joined to them, however the plan does it.
        now = now.join(feasible(known, k, targets[k], wanted).select(F.col("value").alias(k), F.col("target").alias(f"target_{k}")), k)
    scratch = Scratch(cells.sparkSession)
    now = scratch.written(now, "raking")
    for first in range(0, rounds, AT_ONCE):
        for _ in range(first, min(rounds, first + AT_ONCE)):
            now = now.withColumn("last", F.col("factor"))
            for k in DIMENSIONS:
                # Over cells, not documents; a join back to grouped sums would double the plan at each step.
                expected = F.sum(F.col("tokens") * F.least(F.col("factor"), F.lit(1.0))).over(Window.partitionBy(k))
                now = now.withColumn("factor", F.col("factor") * F.coalesce(F.try_divide(f"target_{k}", expected), F.lit(0.0)))
        now = scratch.written(now, "raking")
        scratch.forget(1)
        # The one number of a few rounds that comes to the driver.
        if (now.agg(F.max(F.abs(F.col("factor") - F.col("last")))).first()[0] or 0.0) <= SETTLED:
            break
    found = now.select(*DIMENSIONS, F.round(F.least(F.col("factor"), F.lit(1.0)), 9).alias("probability"))
    return cells.join(found, list(DIMENSIONS), "left").select(*DIMENSIONS, "tokens", F.coalesce("probability", F.lit(0.0)).alias("probability"))


def residuals(fitted: DataFrame, targets: dict[str, DataFrame], rate: float = RATE) -> DataFrame:
    """(dimension, value, target, expected): feasible targets against the expected tokens of cells with a probability."""
    wanted = (fitted.agg(F.sum("tokens")).first()[0] or 0) * rate
    out = None
    for k in DIMENSIONS:
        expected = fitted.groupBy(F.col(k).alias("value")).agg(F.sum(F.col("tokens") * F.col("probability")).alias("expected"))
        rows = feasible(fitted, k, targets[k], wanted).join(expected, "value").select(F.lit(k).alias("dimension"), "value", "target", "expected")
        out = rows if out is None else out.unionByName(rows)
    return out


def uniform(id: Column, seed: int) -> Column:
    """A number in [0, 1) from the id."""
    key = F.concat(F.coalesce(id.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _calibrated(docs: DataFrame, targets: dict[str, DataFrame] | None, id: str, rate: float, temper: float, rounds: int, seed: int, **columns) -> DataFrame:
    """(doc, source, lang, topic, tokens, probability, sampled)"""
    dealt = with_cells(docs, **columns)
    cells = written(dealt.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    targets = targets or {k: tempered(cells, k, temper) for k in DIMENSIONS}
    fitted = written(raked(cells, targets, rate, rounds), "raked").drop("tokens")
    if fitted.count() <= MOST_BROADCAST:
        fitted = F.broadcast(fitted)
    taken = F.coalesce(uniform(F.col(f"doc.`{id}`"), seed) < F.col("probability"), F.lit(False))
    return dealt.join(fitted, list(DIMENSIONS), "left").withColumn("sampled", taken)


def calibrated(docs: DataFrame, targets: dict[str, DataFrame] | None = None, id: str = "doc_id", rate: float = RATE, temper: float = TEMPER, rounds: int = ROUNDS, seed: int = SEED, **columns) -> DataFrame:
    """docs with __cell, __probability and __sampled (which replace columns of these names).

    targets: (value, share) by dimension; by default the tempered shares. Null source, language or topic count as one value;
    null and empty texts have no tokens and probability 0; equal ids are taken or left together, repeated rows each get a
    row; a very long text counts like any other; an empty table gives an empty one.
    """
    found = _calibrated(docs, targets, id, rate, temper, rounds, seed, **columns)
    own = {"__cell": F.struct(*DIMENSIONS, "tokens"), "__probability": F.col("probability"), "__sampled": F.col("sampled")}
    return found.select(*(F.col(f"doc.`{c}`") for c in docs.columns if c.lower() not in own), *(c.alias(k) for k, c in own.items()))


def mixed(docs: DataFrame, targets: dict[str, DataFrame] | None = None, id: str = "doc_id", rate: float = RATE, temper: float = TEMPER, rounds: int = ROUNDS, seed: int = SEED, **columns) -> DataFrame:
    """The rows of docs that are taken, with their columns; the cases are those of calibrated."""
    return _calibrated(docs, targets, id, rate, temper, rounds, seed, **columns).where("sampled").select("doc.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, lang, topic, tokens, probability, sampled) of every document; the cases are those of calibrated."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return calibrated(docs).select("doc_id", F.col("__cell.source").alias("source"), F.col("__cell.lang").alias("lang"), F.col("__cell.topic").alias("topic"), F.col("__cell.tokens").alias("tokens"), F.col("__probability").alias("probability"), F.col("__sampled").alias("sampled"))


def _sql() -> str:
    steps = [
        f"""d AS (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
  CASE WHEN coalesce(text, '') = '' THEN 'empty' WHEN contains(text, ' | ') THEN 'table' WHEN regexp_matches(text, '[#$%&*]{{3}}') THEN 'symbols'
       WHEN regexp_matches(text, '[A-Z]!! [A-Z]') THEN 'capitals' WHEN strlen(text) < 1000 THEN 'short' ELSE 'prose' END AS topic,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x09-\\x0D ]+'))::BIGINT AS tokens FROM documents)""",
        "c AS (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ALL)",
    ]
    for k in DIMENSIONS:
        steps.append(f"q_{k} AS (SELECT {k}, have, p / sum(p) OVER () AS share FROM (SELECT {k}, sum(tokens)::DOUBLE AS have, pow(sum(tokens)::DOUBLE, {TEMPER}) AS p FROM c GROUP BY {k}))")
    shares = " ".join(f"JOIN q_{k} USING ({k})" for k in DIMENSIONS)
    known = " AND ".join(f"q_{k}.share > 0" for k in DIMENSIONS)
    steps.append(f"known AS (SELECT source, lang, topic, c.tokens FROM c {shares} WHERE c.tokens > 0 AND {known})")
    steps.append(f"r AS (SELECT least((SELECT {RATE} * sum(tokens) FROM c), (SELECT sum(tokens)::DOUBLE FROM known)) AS wanted)")
    for k in DIMENSIONS:
        steps.append(
            f"""t_{k} AS (SELECT {k}, least(have, share * max((wanted - before) / after) OVER ()) AS target FROM (
  SELECT *, coalesce(sum(have) OVER (ORDER BY have / share, {k} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(share) OVER (ORDER BY have / share, {k} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after
  FROM (SELECT {k}, sum(known.tokens)::DOUBLE AS have, any_value(share) AS share FROM known JOIN q_{k} USING ({k}) GROUP BY {k})), r)"""
        )
    joins = " ".join(f"JOIN t_{k} USING ({k})" for k in DIMENSIONS)
    targets = ", ".join(f"t_{k}.target AS target_{k}" for k in DIMENSIONS)
    steps.append(f"w0 AS (SELECT known.*, 1.0::DOUBLE AS f, {targets} FROM known {joins})")
    n = 0
    for _ in range(ROUNDS):
        for k in DIMENSIONS:
            steps.append(f"w{n + 1} AS MATERIALIZED (SELECT * REPLACE (coalesce(f * target_{k} / nullif(sum(tokens * least(f, 1.0)) OVER (PARTITION BY {k}), 0), 0) AS f) FROM w{n})")
            n += 1
    steps.append(f"f AS (SELECT source, lang, topic, round(coalesce(least(f, 1.0), 0), 9) AS probability FROM c LEFT JOIN w{n} USING (source, lang, topic))")
    return (
        "WITH "
        + ",\n".join(steps)
        + f"""
SELECT doc_id, source, lang, topic, d.tokens, probability,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{SEED}'), 1, 13))::BIGINT / {float(1 << 52)!r} < probability AS sampled
FROM d JOIN f USING (source, lang, topic)"""
    )


OP3_SQL = _sql()
