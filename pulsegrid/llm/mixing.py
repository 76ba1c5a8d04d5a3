"""Mixing sources to target weights (operator 9).

Method: iterative proportional fitting.  Token counts by (source, language,
topic) cell are raked until their source, language and topic marginals have
the target shares.  A document of a cell is then sampled with probability
min(1, scale * raked weight / tokens of the cell); the scale makes the expected
number of tokens the budget.  The draw is a hash of the document's id, so it
is the same on every run and every machine.

The cell table, not the corpus, is fitted.  Up to ``LOCAL_CELLS`` cells are
fitted on the driver; more are fitted by DataFrame steps with checkpoints, by
the same arithmetic.

Target shares are given, or powers of the corpus' own.  Tokens and topics are
columns of the caller's; else tokens are words between white space, and topics
are forms of text, since these documents carry none.

Defined cases: null source, language or topic is a value of its own ("(none)");
null and empty texts have no tokens and stay only if their probability, that of
their cell, draws them; targets for absent values are left out and the others
rescaled, and if none is present the dimension is as if none was given; a target
of 0 samples nothing; an empty table gives an empty result; rows without an id
are drawn alike, and so are rows that repeat one and a cell; columns named as
the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fits, stored

LOCAL_CELLS = 200_000
ROUNDS, TOLERANCE = 60, 1e-10
NONE = "(none)"
ADDED = ["source_key", "lang_key", "topic", "tokens"]
DIMS = ["source_key", "lang_key", "topic"]


def topic_of(text: Column) -> Column:
    """A coarse topic from the form of a text, for corpora that carry none."""
    n = F.size(F.split(text, "\\s+"))
    tabular = F.size(F.split(text, "\\|")) > 4
    return F.when(text.isNull(), NONE).when(tabular, "tabular").when(n < 60, "brief").when(n < 600, "article").otherwise("long")


def described(docs: DataFrame, topic: Column | None = None, tokens: Column | None = None) -> DataFrame:
    """``docs`` with its three keys and its number of tokens."""
    text = F.col("text")
    return docs.withColumns({
        "source_key": F.coalesce(F.col("source").cast("string"), F.lit(NONE)),
        "lang_key": F.coalesce(F.col("lang").cast("string"), F.lit(NONE)),
        "topic": F.coalesce((topic if topic is not None else topic_of(text)).cast("string"), F.lit(NONE)),
        "tokens": F.coalesce(tokens if tokens is not None else F.size(F.filter(F.split(text, "\\s+"), lambda w: w != "")), F.lit(0)).cast("long"),
    })


def rake(cells: list[np.ndarray], tokens: np.ndarray, targets: list[np.ndarray]) -> np.ndarray:
    """Weights of the cells, which sum to 1; cells[d] is each cell's index in targets[d].

    A round scales the weights to each dimension's targets in turn and then to
    the sum 1, until no marginal was off by ``TOLERANCE``, or ``ROUNDS`` times.
    """
    w = tokens / max(tokens.sum(), 1e-300)
    for _ in range(ROUNDS):
        off = 0.0
        for at, want in zip(cells, targets, strict=True):
            have = np.bincount(at, w, len(want))
            ratio = np.divide(want, have, out=np.zeros(len(want)), where=have > 0)
            off = max(off, float(np.abs(have - want)[have > 0].max(initial=0.0)))
            w = w * ratio[at]
        w /= max(w.sum(), 1e-300)
        if off < TOLERANCE:
            break
    return w


def rake_table(cells: DataFrame, targets: list[DataFrame]) -> DataFrame:
    """The same by DataFrame steps; targets[d] is (dim, share).  Adds w, which sums to 1."""
    whole = cells.agg(F.sum("tokens")).first()[0] or 1
    w = cells.withColumn("w", F.col("tokens") / F.lit(float(whole)))
    for _ in range(ROUNDS):
        off = 0.0
        for dim, want in zip(DIMS, targets, strict=True):
            have = w.groupBy(dim).agg(F.sum("w").alias("_have")).join(want, dim, "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
            have = stored(have.withColumn("_ratio", F.when(F.col("_have") > 0, F.col("share") / F.col("_have")).otherwise(0.0)), "mix-ratios")
            off = max(off, have.where("_have > 0").agg(F.max(F.abs(F.col("_have") - F.col("share")))).first()[0] or 0.0)
            w = w.join(have.select(dim, "_ratio"), dim).withColumn("w", F.col("w") * F.col("_ratio")).drop("_ratio")
        w = stored(w, "mix-weights")
        total = max(w.agg(F.sum("w")).first()[0] or 0.0, 1e-300)
        w = w.withColumn("w", F.col("w") / F.lit(total))
        if off < TOLERANCE:
            break
    return w


def scale_for(budget: float, measure: Callable[[float], tuple[float, float]]) -> float:
    """The scale at which the kept tokens, sum(tokens * min(1, scale * rate)), are the budget, or as near as it gets.

    ``measure`` gives the kept tokens at a scale and their slope.  They are
    concave and linear by pieces in the scale: tangents come from below, and
    each step halves the rest or the slope.
    """
    scale = 0.0
    for _ in range(200):
        kept, slope = measure(scale)
        if not slope or kept >= budget * (1 - 1e-12):
            break
        scale += (budget - kept) / slope
    return scale


def probabilities(rows: DataFrame, fraction: float, powers: tuple[float, float, float], targets: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """(source_key, lang_key, topic, probability) for each cell of ``rows``, which are ``described``.

    Up to ``LOCAL_CELLS`` cells are fitted on the driver, more by DataFrame
    steps: the same arithmetic in another place.
    """
    cells = stored(rows.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")), "mix-cells")
    return (_local if fits(cells, LOCAL_CELLS) else _distributed)(cells, fraction, powers, targets or {})


def _local(cells: DataFrame, fraction: float, powers, targets) -> DataFrame:
    held = cells.toPandas().sort_values(DIMS, ignore_index=True)
    tokens, at, want = held.tokens.to_numpy(np.float64), [], []
    for dim, power in zip(DIMS, powers, strict=True):
        totals = held.groupby(dim).tokens.sum().to_dict()
        given = {k: v for k, v in targets.get(dim, {}).items() if totals.get(k, 0) > 0}
        raised = given or {k: float(v) ** power for k, v in totals.items() if v > 0}
        whole = sum(raised.values()) or 1.0
        names = sorted(totals)
        want.append(np.array([raised.get(n, 0.0) / whole for n in names]))
        at.append(held[dim].map({n: i for i, n in enumerate(names)}).to_numpy(np.int64))
    w = rake(at, tokens, want)
    rate = np.divide(w, tokens, out=np.zeros(len(w)), where=tokens > 0)
    some = rate > 0
    measure = lambda s: (float((tokens * np.minimum(1.0, s * rate)).sum()), float(w[some & (s * rate < 1)].sum()))
    p = np.minimum(1.0, scale_for(min(fraction * tokens.sum(), tokens[some].sum()), measure) * rate)
    return cells.sparkSession.createDataFrame(held[DIMS].assign(probability=p), "source_key string, lang_key string, topic string, probability double")


def _distributed(cells: DataFrame, fraction: float, powers, targets) -> DataFrame:
    spark, want = cells.sparkSession, []
    for dim, power in zip(DIMS, powers, strict=True):
        totals = stored(cells.groupBy(dim).agg(F.sum("tokens").alias("t")).where("t > 0"), "mix-totals")
        given = targets.get(dim, {})
        raised = totals.join(spark.createDataFrame(sorted(given.items()), f"{dim} string, r double"), dim) if given else None
        if raised is None or not raised.limit(1).count():
            raised = totals.withColumn("r", F.pow(F.col("t").cast("double"), F.lit(power)))
        whole = raised.agg(F.sum("r")).first()[0] or 1.0
        want.append(raised.select(dim, (F.col("r") / F.lit(whole)).alias("share")))
    w = rake_table(cells, want).withColumn("rate", F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(0.0))
    w = stored(w, "mix-weights")
    total, reach = w.agg(F.sum("tokens"), F.sum(F.when(F.col("rate") > 0, F.col("tokens")))).first()

    def measure(scale):
        scaled = F.col("rate") * F.lit(scale)
        return w.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), scaled)), F.sum(F.when((F.col("rate") > 0) & (scaled < 1), F.col("w")))).first()

    scale = scale_for(min(fraction * (total or 0), reach or 0), measure)
    return w.select(*DIMS, F.least(F.lit(1.0), F.col("rate") * F.lit(scale)).alias("probability"))


def draw(id_col: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from the id alone."""
    return F.shiftrightunsigned(F.xxhash64(id_col, F.lit(seed)), 11) / F.lit(float(1 << 53))


def sampled(docs: DataFrame, fraction: float = 0.6, powers: tuple[float, float, float] = (0.5, 0.7, 0.7), targets: dict[str, dict[str, float]] | None = None, topic: Column | None = None, tokens: Column | None = None, seed: int = 0) -> DataFrame:
    """``docs`` with keys, tokens, probability and ``kept``: whether the draw keeps the document.  Every row stays."""
    rows = described(docs.drop("probability", "kept"), topic, tokens)
    p = probabilities(rows, fraction, powers, targets)
    p = F.broadcast(p) if fits(p, LOCAL_CELLS) else p
    joined = rows.join(p, DIMS, "left").withColumn("probability", F.coalesce("probability", F.lit(0.0)))
    return joined.withColumn("kept", F.coalesce(draw(F.col("doc_id"), seed) < F.col("probability"), F.lit(False)))
