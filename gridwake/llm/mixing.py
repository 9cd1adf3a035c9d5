"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions alone.

Documents are summed to cells of equal margins (say source, language and topic). Each round scales the
cells' weights so that one margin after the other has its target shares. A cell's final weight over its
tokens is its rate; documents are kept with a probability in proportion to it, by a hash of their id.
"""

from __future__ import annotations

import math
import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import small, stored

#: Least rounds of fitting, and exponent that turns shares into target shares.
ROUNDS, TEMPER = 6, 0.7
#: Fitting goes on until each value's share is met but for this part of it, or stops where more rounds don't help.
TOLERANCE, MOST_ROUNDS = 1e-3, 200
#: Cells that one task fits; more are dealt out.
FEW_CELLS = 100_000
#: Stands for a null in a margin.
NONE = "(none)"
_STEPS = 1 << 52


def words(text: str | Column) -> Column:
    """Tokens of a text as the mix counts them: its words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def draw(key: str | Column, seed: int) -> Column:
    """A number from 0 to 1 that is fixed by the key and the seed; a null key has one, too."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce((F.col(key) if isinstance(key, str) else key).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / _STEPS


def raked(cells: DataFrame, margins: list[str], targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """``cells`` (margins and ``tokens``) with ``weight``, fitted so that each margin's shares meet its target.

    ``targets`` holds for a margin a frame of its values and their ``share``; by default a margin's target
    shares are its shares to the power TEMPER, scaled to sum to 1. Values without a target, and cells
    without tokens, get no weight. After ``rounds`` rounds, more follow until all shares are met within
    TOLERANCE; a warning tells if targets exclude each other. Up to FEW_CELLS cells are fitted in one task, a round
    at a time; more are dealt out, and one frame of them is kept per margin. No cell leaves the cluster.
    """
    few = cells.count() <= FEW_CELLS
    together = lambda df: df.coalesce(1) if few else df  # noqa: E731  # one partition needs no exchange to add up a margin
    cells = together(cells)
    goals = _goals(cells, margins, targets)
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    errors: list[float] = []
    if few:
        for m in margins:
            now = now.join(goals[m].withColumnRenamed("share", f"_share_{m}"), m, "left")
        now = together(stored(now, "cells"))
    while True:
        for m in margins:
            if few:
                sum_ = F.sum("weight").over(Window.partitionBy(m))
                now = now.withColumn("weight", F.col("weight") * F.coalesce(F.try_divide(F.col(f"_share_{m}") * total, sum_), F.lit(0.0)))
                continue
            sums = now.groupBy(m).agg(F.sum("weight").alias("sum"))
            factor = sums.join(goals[m], m).select(m, F.try_divide(F.col("share") * total, F.col("sum")).alias("factor"))
            now = now.join(factor, m, "left").withColumn("weight", F.col("weight") * F.coalesce("factor", F.lit(0.0))).drop("factor").checkpoint()
        now = together(stored(now, "cells"))  # a checkpoint keeps the plan's size estimate, which is squared with each step
        rounds -= 1
        if rounds > 0:
            continue
        errors.append(_error(now, goals, total))
        if errors[-1] <= TOLERANCE:
            return now.drop(*[f"_share_{m}" for m in margins])
        if len(errors) > MOST_ROUNDS or len(errors) > 8 and errors[-1] > 0.95 * errors[-9]:
            warnings.warn(f"no weights found that meet all margins: a share is off by {errors[-1]:.2g} of its target", stacklevel=2)
            return now.drop(*[f"_share_{m}" for m in margins])


def _goals(cells: DataFrame, margins: list[str], targets: dict[str, DataFrame] | None) -> dict[str, DataFrame]:
    goals = {}
    for m in margins:
        goal = (targets or {}).get(m)
        if goal is None:
            sums = cells.where("tokens > 0").groupBy(m).agg(F.sum("tokens").cast("double").alias("sum")).withColumn("part", F.pow("sum", F.lit(TEMPER))).checkpoint()
            whole = sums.agg(F.sum("part")).first()[0] or 1.0
            goal = sums.select(m, (F.col("part") / whole).alias("share"))
        goals[m] = small(goal.checkpoint())
    return goals


def _error(cells: DataFrame, goals: dict[str, DataFrame], total: float) -> float:
    """The greatest distance of a value's weight from its target, as a part of the target."""
    off = F.abs(F.try_divide("sum", F.col("share") * total) - 1)
    parts = [cells.groupBy(m).agg(F.sum("weight").alias("sum")).join(goal, m).where("share > 0").select(off.alias("off")) for m, goal in goals.items()]
    return reduce(DataFrame.unionByName, parts).agg(F.max("off")).first()[0] or 0.0


def reached(out: DataFrame, margins: list[str], targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """``margin``, ``value``, its ``target`` share, and the shares of tokens ``expected`` and ``kept``, for a result of ``mixed``."""
    names = [f"mix_{m}" for m in margins]
    kept = F.when(F.col("mix_kept"), F.col("mix_tokens")).otherwise(0)
    cells = out.groupBy(*names).agg(F.sum("mix_tokens").alias("tokens"), F.sum(F.col("mix_tokens") * F.col("mix_probability")).alias("expected"), F.sum(kept).alias("kept")).checkpoint()
    whole = cells.agg(F.sum("expected").alias("e"), F.sum("kept").alias("k")).first()
    parts = []
    for m, goal in _goals(cells, names, targets).items():
        sums = cells.groupBy(m).agg((F.sum("expected") / (whole["e"] or 1.0)).alias("expected"), (F.sum("kept") / (whole["k"] or 1)).alias("kept"))
        parts.append(sums.join(goal, m, "full").select(F.lit(m[4:]).alias("margin"), F.col(m).alias("value"), F.coalesce("share", F.lit(0.0)).alias("target"), F.coalesce("expected", F.lit(0.0)).alias("expected"), F.coalesce("kept", F.lit(0.0)).alias("kept")))
    return reduce(DataFrame.unionByName, parts)


def mixed(docs: DataFrame, margins: dict[str, Column], tokens: Column, key: str, seed: int = 0, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with ``mix_<margin>`` columns, ``mix_tokens``, ``mix_probability`` and ``mix_kept``.

    Probabilities are the cells' rates over the greatest one, so the kept tokens meet the targets in
    expectation; of all tokens, one over the greatest rate is kept. ``reached`` reports the shares. A null in a margin is a value of its own. A document without tokens is in no cell's weight but has
    its cell's probability; one whose cell has no tokens at all is kept. Rows with equal ids are kept or left
    together. ``docs`` may have any other columns; an empty table gives an empty one.
    """
    names = [f"mix_{m}" for m in margins]
    rows = docs.withColumns({f"mix_{m}": F.coalesce(c.cast("string"), F.lit(NONE)) for m, c in margins.items()} | {"mix_tokens": tokens})
    cells = rows.groupBy(*names).agg(F.sum("mix_tokens").alias("tokens")).checkpoint()
    fitted = raked(cells, names, targets, rounds).withColumn("rate", F.try_divide("weight", "tokens"))
    top = fitted.agg(F.max("rate")).first()[0]
    scale = top if top and math.isfinite(top) else 1.0
    chance = fitted.select(*names, F.least(F.lit(1.0), F.coalesce(F.col("rate") / scale, F.lit(1.0))).alias("mix_probability"))
    out = rows.join(small(chance), names, "left")
    return out.withColumn("mix_kept", draw(key, seed) < F.col("mix_probability"))


def topics(docs: DataFrame, embeddings: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``mix_label``: the label of the document's vector, null if it has none."""
    labels = embeddings.select(F.col("vec_id").cast("long").alias("mix_id"), "label").where("mix_id is not null").groupBy("mix_id").agg(F.min("label").alias("mix_label"))
    return docs.join(small(labels), docs[id_col].cast("long") == F.col("mix_id"), "left").drop("mix_id")
