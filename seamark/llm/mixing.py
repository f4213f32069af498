"""Mixing sources to target weights by iterative proportional fitting (DataFrame operations only).

Token weights of the cells source x language x topic are raked, axis after axis, until their marginals meet the
targets within TOLERANCE; a document is then kept with its cell's calibrated probability, the raked weight over the
observed one, scaled so that the largest is 1. So the kept tokens meet all three marginals in expectation and no
document is repeated.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, bytes_of, durable, if_small, table, tidy

AXES = ("source", "lang", "topic")
#: Without given targets: a value's share is in proportion to its observed tokens to this power.
TEMPER = {"source": 0.5, "lang": 0.7, "topic": 0.9}
#: Largest relative distance of a marginal from its target, and sweeps over the axes to get there.
TOLERANCE, MAX_SWEEPS, SWEEPS_A_WRITE = 1e-9, 60, 6
UNKNOWN = "unknown"
COLUMNS, SYMBOLS = "|\t", "#&*<=>@{}~"


def _share(text: Column, characters: str) -> Column:
    """The share of a text's bytes that are one of ``characters`` (ASCII)."""
    size = F.octet_length(text)
    return functools.reduce(lambda n, c: n + size - F.octet_length(F.replace(text, F.lit(c), F.lit(""))), characters, F.lit(0)) / F.greatest(size, F.lit(1))


def topic_of(text: Column) -> Column:
    """A stand-in for a topic where none is given: what a text is by its form, whatever its words are."""
    return (
        F.when(_share(text, COLUMNS) >= 0.01, "tabular")
        .when(_share(text, SYMBOLS) >= 0.03, "symbols")
        .when(F.octet_length(text) < 300, "note")
        .when(F.octet_length(text) < 5000, "prose")
        .otherwise("long")
    )


def tokens_of(text: Column) -> Column:
    """A stand-in for a count of tokens where none is given: four characters to a token, at least one a text."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("bigint")


def observed(cells: DataFrame) -> DataFrame:
    """axis, value and t, the value's tokens, for all values of all axes."""
    return functools.reduce(DataFrame.unionByName, (cells.groupBy(F.lit(a).alias("axis"), F.col(a).alias("value")).agg(F.sum("tokens").cast("double").alias("t")) for a in AXES))


def tempered(cells: DataFrame, temper: dict[str, float] = TEMPER) -> DataFrame:
    """Targets (axis, value, share) from observed tokens: to the power of ``temper``, in proportion."""
    power = functools.reduce(lambda when, a: when.when(F.col("axis") == a, F.lit(float(temper[a]))), AXES, F)
    return observed(cells).select("axis", "value", F.pow("t", power).alias("share"))


def checked(targets: DataFrame) -> DataFrame:
    """``targets`` as given by a caller, written; a null value is ``unknown``."""
    targets = durable(targets.select("axis", F.coalesce("value", F.lit(UNKNOWN)).alias("value"), F.col("share").cast("double").alias("share")))
    bad = targets.where(F.col("axis").isNull() | ~F.col("axis").isin(*AXES) | F.col("share").isNull() | (F.col("share") < 0) | F.isnan("share")).count()
    if bad or targets.groupBy("axis", "value").count().where("count > 1").count():
        raise ValueError("targets need an axis, one share a value, and no negative share")
    return targets


def _with_shares(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds each axis's target share of the cell's value, in proportion over the values that occur.

    An axis without any target keeps its observed shares; a value without one on an axis that has some gets none.
    """
    given = targets.select("axis").distinct().withColumn("given", F.lit(True))
    rows = observed(cells).join(targets, ["axis", "value"], "left").join(F.broadcast(given), "axis", "left")  # three rows at most
    rows = rows.select("axis", "value", F.when(F.col("given"), F.coalesce("share", F.lit(0.0))).otherwise(F.col("t")).alias("share"))
    whole = rows.groupBy("axis").agg(F.sum("share").alias("whole"))
    shares = durable(rows.join(F.broadcast(whole), "axis").select("axis", "value", F.when(F.col("whole") > 0, F.col("share") / F.col("whole")).alias("share")))  # three rows
    if not shares.where("share is null").isEmpty():
        raise ValueError("no value that occurs on an axis has a target share")
    side = F.broadcast if bytes_of(shares) <= BROADCAST_BYTES // 4 else (lambda rows: rows)
    for axis in AXES:
        cells = cells.join(side(shares.where(F.col("axis") == axis).select(F.col("value").alias(axis), F.col("share").alias(f"{axis}_share"))), axis)
    return cells


def rake(cells: DataFrame, targets: DataFrame, strict: bool = True, tolerance: float = TOLERANCE, max_sweeps: int = MAX_SWEEPS) -> DataFrame:
    """``cells`` has the axes and tokens, one row a cell; adds weight, raked to ``targets`` (axis, value, share).

    A sweep fits one axis after the other. Cells of a few megabytes are swept in one task, several times before they are
    written. More of them are written after each sweep: sources may be many, with few cells each, and their sums
    are taken in place; a language or topic may have most of the cells, and its sum is aggregated in parts and joined.
    Where cells that don't occur make the targets unreachable, ``strict`` raises an error; otherwise the last
    sweep counts, in which the last axis is met.
    """
    whole = float(cells.agg(F.sum("tokens").cast("double")).first()[0] or 0)
    cells = durable(_with_shares(cells, targets).withColumn("weight", F.col("tokens").cast("double")))
    small = bytes_of(cells) <= BROADCAST_BYTES // 4
    gap, gaps = float("inf"), [f"{axis}_gap" for axis in AXES]

    def swept(cells: DataFrame) -> DataFrame:
        for axis in AXES:
            if small or axis == "source":
                cells = cells.withColumn("now", F.sum("weight").over(Window.partitionBy(axis)))
            else:
                cells = cells.join(cells.groupBy(axis).agg(F.sum("weight").alias("now")), axis)
            want = F.col(f"{axis}_share") * F.lit(whole)
            off = F.when(want > 0, F.abs(F.col("now") / want - 1)).otherwise(F.col("now") / F.lit(whole))
            cells = cells.withColumns({f"{axis}_gap": off, "weight": F.when(F.col("now") > 0, F.col("weight") * (want / F.col("now"))).otherwise(0.0)}).drop("now")
        return cells

    done = 0 if whole else max_sweeps
    while done < max_sweeps:
        cells = cells.coalesce(1) if small else cells  # one task needs no shuffle
        for _ in range(SWEEPS_A_WRITE if small else 1):
            cells, done = swept(cells), done + 1
        cells = durable(cells)
        gap = cells.agg(F.max(F.greatest(*gaps))).first()[0]
        cells = cells.drop(*gaps)
        if gap <= tolerance:
            break
    else:
        if strict and whole:
            raise ValueError(f"the marginals are still {gap:.2g} off their targets after {max_sweeps} sweeps: the cells that occur can't meet them")
    return cells.select(*AXES, "tokens", "weight")


@tidy
def mix(docs: DataFrame, targets: DataFrame | None = None, topic: Column | None = None, tokens: Column | None = None, seed: str = "mix") -> DataFrame:
    """Sample ``docs`` (doc_id, text, lang, source) to the target marginals ``targets`` (axis, value, share).

    Without ``targets`` they are ``tempered``. ``topic`` and ``tokens`` are columns of ``docs`` to use, say from a
    classifier and from counted tokens; without them the text's form and length stand in. A null lang, source or topic is the
    value ``unknown``; null texts are empty; a row weighs one token at least. Of equal draws all are kept or none: a row is
    kept when the md5 of the seed and its id, as a number from 0 to 1, is below its probability, so repeated rows of an id
    stay or go together, and a run can be repeated. Targets that are given must be within reach of what occurs, else a
    ValueError is raised. Texts are only measured, so very long ones take no more memory than their row. Returns doc_id,
    source, lang, topic, tokens, probability (6 places) of the kept rows; no rows for an empty table. Other columns are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    kind = topic_of(text) if topic is None else F.coalesce(topic.cast("string"), F.lit(UNKNOWN))
    weight = tokens_of(text) if tokens is None else F.greatest(F.coalesce(tokens.cast("bigint"), F.lit(1)), F.lit(1))
    slim = durable(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("source", F.lit(UNKNOWN)).alias("source"), F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), kind.alias("topic"), weight.cast("bigint").alias("tokens")))
    cells = durable(slim.groupBy(*AXES).agg(F.sum("tokens").alias("tokens")))
    raked = rake(cells, tempered(cells) if targets is None else checked(targets), strict=targets is not None)
    factor = F.col("weight") / F.col("tokens")
    most = raked.agg(F.max(factor).alias("most"))
    rate = durable(raked.crossJoin(most).select(*AXES, (factor / F.col("most")).alias("probability")))  # most is one row
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    kept = slim.join(if_small(rate), list(AXES)).where(draw < F.col("probability"))
    return kept.select("doc_id", *AXES, "tokens", F.round("probability", 6).alias("probability"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def oracle(docs: str = "documents", temper: dict[str, float] = TEMPER, sweeps: int = 40, seed: str = "mix") -> str:
    """The same with a fixed number of sweeps, more than enough to settle."""
    steps, last = [], "w0"
    for k in range(sweeps):
        for axis in AXES:
            name = f"w{k}_{axis}"
            steps.append(f"{name} AS (SELECT * REPLACE (weight * ({axis}_share * total / sum(weight) OVER (PARTITION BY {axis})) AS weight) FROM {last})")
            last = name
    shares = ", ".join(f"{a}_t AS (SELECT {a}, pow(t, {temper[a]}) / sum(pow(t, {temper[a]})) OVER () AS {a}_share FROM (SELECT {a}, sum(tokens)::DOUBLE AS t FROM cells GROUP BY {a}))" for a in AXES)
    share = lambda characters: f"({' + '.join(f"strlen(x) - strlen(replace(x, chr({ord(c)}), ''))" for c in characters)}) / greatest(strlen(x), 1)::DOUBLE"
    return f"""
    WITH slim AS (SELECT doc_id, coalesce(source, '{UNKNOWN}') AS source, coalesce(lang, '{UNKNOWN}') AS lang,
      CASE WHEN {share(COLUMNS)} >= 0.01 THEN 'tabular' WHEN {share(SYMBOLS)} >= 0.03 THEN 'symbols'
        WHEN strlen(x) < 300 THEN 'note' WHEN strlen(x) < 5000 THEN 'prose' ELSE 'long' END AS topic,
      greatest(1, ceil(length(x) / 4))::BIGINT AS tokens FROM (SELECT *, coalesce(text, '') AS x FROM {docs})),
    cells AS (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM slim GROUP BY ALL),
    {shares},
    w0 AS (SELECT *, tokens::DOUBLE AS weight, (SELECT sum(tokens)::DOUBLE FROM cells) AS total FROM cells JOIN source_t USING (source) JOIN lang_t USING (lang) JOIN topic_t USING (topic)),
    {", ".join(steps)},
    rate AS (SELECT source, lang, topic, (weight / tokens) / max(weight / tokens) OVER () AS probability FROM {last})
    SELECT doc_id, source, lang, topic, slim.tokens AS tokens, round(probability, 6) AS probability FROM slim JOIN rate USING (source, lang, topic)
    WHERE ('0x' || substr(md5('{seed}' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE < probability"""
