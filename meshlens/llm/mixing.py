"""Operator 3, mixing sources to target weights by iterative proportional fitting (DataFrame functions only).

Documents fall into cells (source, language, topic).  The cells' token weights are raked to the target marginals of
source, language and topic in turn, in rounds of ``SWEEPS`` sweeps, until no marginal is off by more than ``TOLERANCE``;
targets that contradict each other are raked until a round no longer helps, and the error that is left is warned of.

The draw is calibrated to a budget: the expected tokens of the sample are ``share`` of all tokens.  A cell's probability
is min(1, lambda * weight / tokens); a cell at 1 is kept whole and the others share the rest of the budget, so a rare
cell never lowers the others.  With ``share=None`` the largest ratio is scaled to 1 instead: all marginals are exact,
but one rare cell of a high ratio shrinks the whole sample.

Unless targets are given, a value's target share is its share of the tokens to the power ``EXPONENT``, which damps
large sources and languages.  A document is kept when a number drawn from the md5 of its id is below its probability,
so the sample is the same at any partitioning.

A table without topics gets a stand-in: of four classes of words by their first letter, the one with the most words in
the whole text.

Scale: one aggregation over the documents, pre-aggregated per task, gives the cells; raking works on the cells alone,
whose number is that of (source, language, topic) triples.  A hot source is one row per language and topic there.

Cases: a null source, language or topic is the value ``unknown``; null text counts as empty; a cell without tokens
has probability 0; values missing from given targets have target 0; a null id counts as the text ``null``; repeated
rows share one decision; an empty table gives no rows; other columns are ignored by ``mix`` and kept by ``sample``.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meshlens.llm.common import Scratch

DIMS = ("source", "lang", "topic")
EXPONENT = 0.7
SWEEPS = 12
#: Sweeps in one plan; it moves work only.
SAVED = 2
#: Largest difference of a raked share from its target share, and the least gain of a round of sweeps.
TOLERANCE = 1e-4
GAIN = 0.01
#: Share of the tokens that a sample keeps.
SHARE = 0.65
#: Stand-in topics: first letters of the words that speak for each.
TOPICS = {"t0": "a-fA-F", "t1": "g-mG-M", "t2": "n-sN-S", "t3": "t-zT-Z"}

_WORD = r"[^\x20\x09-\x0D]+"


def topic_of(text: Column) -> Column:
    """A stand-in topic for tables without one: the class of the most words of the text, ties by name."""
    words = F.concat(F.lit(" "), text)
    best = F.greatest(*(F.struct(F.regexp_count(words, F.lit(rf"[\x20\x09-\x0D][{letters}]")).alias("n"),
                                 F.lit(-i).alias("i"), F.lit(t).alias("topic")) for i, (t, letters) in enumerate(TOPICS.items())))
    return best["topic"]


def described(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """``docs`` with the columns that mixing needs, under names that can't clash; ``topic``: the tables' own topic."""
    text = F.coalesce("text", F.lit(""))
    topic = topic_of(text) if topic is None else F.coalesce(topic.cast("string"), F.lit("unknown"))
    return docs.withColumns({"_source": F.coalesce(F.col("source").cast("string"), F.lit("unknown")),
                             "_lang": F.coalesce(F.col("lang").cast("string"), F.lit("unknown")),
                             "_topic": topic, "_tokens": F.regexp_count(text, F.lit(_WORD)).cast("long")})


def _targeted(cells: DataFrame, targets: dict[str, DataFrame] | None) -> DataFrame:
    state = cells.withColumn("w", F.col("tokens").cast("double"))
    for d in DIMS:
        if targets and d in targets:
            given = targets[d].select(F.col("value").alias(d), F.col("share").cast("double").alias(f"t_{d}"))
            state = state.join(given, d, "left").withColumn(f"t_{d}", F.coalesce(f"t_{d}", F.lit(0.0)))
        else:
            state = state.withColumn(f"t_{d}", F.pow(F.sum("tokens").over(Window.partitionBy(d)).cast("double"),
                                                     F.lit(EXPONENT)))
    return state


def _swept(state: DataFrame, sweeps: int) -> DataFrame:
    for _ in range(sweeps):
        for d in DIMS:
            total = F.sum("w").over(Window.partitionBy(d))
            state = state.withColumn("w", F.when(total > 0, F.col("w") * F.col(f"t_{d}") / total).otherwise(0.0))
    return state


def _saved_sweeps(state: DataFrame, sweeps: int, scratch: Scratch) -> DataFrame:
    """``sweeps`` sweeps, saved after every SAVED: one plan of all would have a nested exchange per sweep and dimension,
    and the driver plans and logs the whole of it anew whenever one of them ends."""
    for done in range(0, sweeps, SAVED):
        state = scratch.save(_swept(state, min(SAVED, sweeps - done)))
    return state


def rake(cells: DataFrame, targets: dict[str, DataFrame] | None = None, sweeps: int = SWEEPS) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with raked weights ``w``; ``targets``: per dimension (value, share)."""
    scratch = Scratch(cells.sparkSession)
    return _saved_sweeps(scratch.save(_targeted(cells, targets)), sweeps, scratch).select(*DIMS, "tokens", "w")


def marginal_error(state: DataFrame) -> float:
    """The largest difference of a value's share of ``w`` from its target share, over the values that have weight."""
    worst = 0.0
    for d in DIMS:
        sums = (state.groupBy(d).agg(F.sum("w").alias("w"), F.max(f"t_{d}").alias("t")).where("w > 0")
                .agg(F.collect_list("w").alias("ws"), F.sum("w").alias("w"), F.collect_list("t").alias("ts"),
                     F.sum("t").alias("t")))
        off = F.zip_with("ws", "ts", lambda w, t: F.abs(w / F.col("w") - t / F.col("t")))
        worst = max(worst, sums.select(F.array_max(off)).first()[0] or 0.0)
    return worst


def _raked_to_tolerance(cells: DataFrame, targets: dict[str, DataFrame] | None, scratch: Scratch) -> DataFrame:
    state, last = scratch.save(_targeted(cells, targets)), float("inf")
    while True:
        state = _saved_sweeps(state, SWEEPS, scratch)
        error = marginal_error(state)
        if error > TOLERANCE and error > (1 - GAIN) * last:
            warnings.warn(f"mixing: the targets contradict each other; a share stays {error:.2g} off", stacklevel=2)
            break
        if error <= TOLERANCE:
            break
        last = error
    return state.select(*DIMS, "tokens", "w")


def probabilities(rows: DataFrame, targets: dict[str, DataFrame] | None = None, share: float | None = None) -> DataFrame:
    """(_source, _lang, _topic, probability) of every cell of described ``rows``."""
    scratch = Scratch(rows.sparkSession)
    cells = scratch.save(rows.groupBy(*(F.col(f"_{d}").alias(d) for d in DIMS)).agg(F.sum("_tokens").alias("tokens")))
    raked = rake(cells, targets) if share is None else _raked_to_tolerance(cells, targets, scratch)
    raked = scratch.save(raked.withColumn("ratio", F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(0.0)))
    if share is None:
        p = F.col("ratio") / F.lit(raked.agg(F.max("ratio")).first()[0] or 1.0)
    else:
        p = F.least(F.lit(1.0), F.col("ratio") * F.lit(_calibrated(raked, share)))
    return raked.select(*(F.col(d).alias(f"_{d}") for d in DIMS), F.round(p, 9).alias("probability"))


def _calibrated(raked: DataFrame, share: float) -> float:
    """The lambda at which sum(min(1, lambda * ratio) * tokens) is ``share`` of all tokens.

    With the cells by falling ratio and the first k at 1, the others need (budget - their tokens) / (weight left);
    that grows while a cell so reaches 1 and falls afterwards, so lambda is the largest of these.
    """
    budget = share * (raked.agg(F.sum("tokens")).first()[0] or 0)
    order = Window.orderBy(F.desc("ratio"), *DIMS)
    whole = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    return raked.where("ratio > 0").select(((F.lit(budget) - whole) / left).alias("l")).agg(F.max("l")).first()[0] or 0.0


def _decided(docs: DataFrame, targets: dict[str, DataFrame] | None, share: float | None,
             topic: Column | None) -> DataFrame:
    rows = described(docs, topic)
    draw = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"))
    draw = F.conv(F.substring(draw, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    return (rows.join(probabilities(rows, targets, share), [f"_{d}" for d in DIMS])
            .withColumn("_kept", draw < F.col("probability")))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, share: float | None = SHARE,
        topic: Column | None = None) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, probability and kept of every row of ``docs``."""
    return _decided(docs, targets, share, topic).select(
        "doc_id", *(F.col(f"_{d}").alias(d) for d in DIMS), F.col("_tokens").alias("n_tokens"), "probability",
        F.col("_kept").alias("kept"))


def sample(docs: DataFrame, targets: dict[str, DataFrame] | None = None, share: float | None = SHARE,
           topic: Column | None = None) -> DataFrame:
    """The sampled rows of ``docs``, all columns."""
    return _decided(docs, targets, share, topic).where("_kept").select(*docs.columns)


def oracle() -> str:
    """The query in DuckDB SQL, with one round of sweeps."""
    steps = []
    last = "start"
    for i in range(SWEEPS):
        for d in DIMS:
            steps.append(f"s{i}{d} AS (SELECT source, lang, topic, tokens, t_source, t_lang, t_topic, "
                         f"CASE WHEN sum(w) OVER (PARTITION BY {d}) > 0 THEN w * t_{d} / sum(w) OVER (PARTITION BY {d}) "
                         f"ELSE 0 END AS w FROM {last})")
            last = f"s{i}{d}"
    targets = ", ".join(f"power(CAST(sum(tokens) OVER (PARTITION BY {d}) AS DOUBLE), {EXPONENT}) AS t_{d}" for d in DIMS)
    hits = ", ".join(rf"len(regexp_extract_all(' ' || coalesce(text, ''), '[\x20\x09-\x0D][{x}]'))" for x in TOPICS.values())
    names = ", ".join(f"'{t}'" for t in TOPICS)
    order = "ORDER BY ratio DESC, source, lang, topic ROWS BETWEEN"
    return f"""
WITH h AS (SELECT doc_id, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang, [{hits}] AS hits,
                  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents),
     d AS (SELECT doc_id, source, lang, [{names}][list_position(hits, list_max(hits))] AS topic, n_tokens FROM h),
     cells AS (SELECT source, lang, topic, sum(n_tokens) AS tokens FROM d GROUP BY ALL),
     start AS (SELECT *, CAST(tokens AS DOUBLE) AS w, {targets} FROM cells),
     {", ".join(steps)},
     r AS (SELECT source, lang, topic, tokens, w, CASE WHEN tokens > 0 THEN w / tokens ELSE 0 END AS ratio FROM {last}),
     l AS (SELECT max((budget - before) / rest) AS factor FROM (
             SELECT {SHARE} * (SELECT sum(tokens) FROM r) AS budget,
                    coalesce(sum(tokens) OVER ({order} UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                    sum(w) OVER ({order} CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
             FROM r WHERE ratio > 0)),
     p AS (SELECT source, lang, topic, round(least(1.0, ratio * (SELECT factor FROM l)), 9) AS probability FROM r)
SELECT doc_id, source, lang, topic, n_tokens, probability,
       CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0 < probability AS kept
FROM d JOIN p USING (source, lang, topic)"""
