"""Mixing documents to target weights: raking of a contingency table, then sampling.

Documents are counted once into cells (source, language, topic). Iterative
proportional fitting scales the cells' token weights until their sums match
the targets of each margin. A document of a cell is then kept with the
probability of the cell. No cell can give more tokens than it has, so the
sample is raked again under that bound: cells that reach probability 1 stay
there and the others make up for them, until the margins of the sample meet
their targets within the token budget. A category whose target exceeds all it
holds is kept whole, and the others of its margin share the rest in proportion
to their targets (``sample_goals``). The cells are few against the documents and stay
a distributed table; the documents are read once more for the join with their
cell's probability. DataFrame functions only.

Defined cases: a NULL or empty source or language is the category "(none)";
NULL and empty texts have no tokens and topic "empty", and are kept with the
probability of their cell like any other; cells without tokens get probability
1; a repeated row shares its twin's fate; a very long text weighs by all its
words; an empty table gives an empty result;
added columns replace input columns of the same name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkgrid.llm.common import packed, text_or_empty, unpacked
from sparkgrid.session import join_small, stage

MARGINS = ("source", "lang", "topic")
NONE = "(none)"
TEMPER = 0.7         # share of a category in the target: found share to this power
BUDGET = 0.7         # share of all tokens that the sample is to hold
SWEEPS = 24          # at most so many sweeps over the margins
SWEEPS_PER_PLAN = 4  # written in between, so that plans stay short
TOLERANCE = 1e-6
SEED = 20_231


def category(name: str) -> Column:
    c = F.col(name).cast("string")
    return F.when(c.isNull() | (c == ""), F.lit(NONE)).otherwise(c)


def tokens(c: Column) -> Column:
    """Words between ASCII white space, counted at their first characters."""
    return F.regexp_count(c, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def topic(c: Column) -> Column:
    """Kind of content: of rough surface signs, the first that holds."""
    def has(*parts: str) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(c, F.lit(p)) for p in parts])
    return (F.when(F.trim(c) == "", "empty")
            .when(has("License", "Copyright", "licensed under", "All rights reserved"), "legal")
            .when(has(" | "), "tabular")
            .when(has(" = \"", "http://", "https://", "@"), "technical")
            .otherwise("prose"))


def tempered_targets(cells: DataFrame, margin: str, power: float = TEMPER) -> DataFrame:
    """Target shares of one margin: found token shares, flattened by ``power``."""
    sums = cells.groupBy(margin).agg(F.sum("tokens").cast("double").alias("found"))
    return sums.select(margin, F.when(F.col("found") > 0, F.pow("found", F.lit(power))).otherwise(0.0).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS,
         tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` with ``weight``: tokens scaled until the sums of each margin match its target shares.

    Target shares need not sum to one; those of categories that no cell has
    are left out. Margins that contradict one another end at the last sweep.
    """
    total = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    fitted = cells.withColumn("weight", F.col("tokens").cast("double"))
    for margin, target in targets.items():
        present = target.join(cells.where("tokens > 0").select(margin).distinct(), margin, "left_semi")
        sums = present.agg(F.sum("share")).first()[0] or 1.0
        fitted = join_small(fitted, present.select(margin, (F.col("share") / sums * total).alias(f"goal_{margin}")),
                            [margin], "left").fillna(0.0, [f"goal_{margin}"])
    fitted = stage(fitted, "cells")
    for done in range(0, sweeps, SWEEPS_PER_PLAN):
        for _ in range(min(SWEEPS_PER_PLAN, sweeps - done)):
            for margin in targets:
                found = F.sum("weight").over(Window.partitionBy(margin))
                fitted = fitted.withColumn(
                    "weight", F.when(found > 0, F.col("weight") * F.col(f"goal_{margin}") / found).otherwise(0.0))
        fitted = stage(fitted, "cells")
        if max(_deviation(fitted, m) for m in targets) <= tolerance * max(total, 1):
            break
    return fitted.drop(*[f"goal_{m}" for m in targets])


def _deviation(cells: DataFrame, margin: str) -> float:
    sums = cells.groupBy(margin).agg(F.sum("weight").alias("sum"), F.first(f"goal_{margin}").alias("goal"))
    return sums.agg(F.max(F.abs(F.col("sum") - F.col("goal")))).first()[0] or 0.0


def probabilities(cells: DataFrame, budget: float = BUDGET) -> DataFrame:
    """``cells`` with ``probability`` = min(1, scale * weight / tokens), expected tokens = budget * all tokens.

    The scale is found by setting cells that reach 1 aside and scaling the
    rest again; cells only ever join those set aside, so this ends.
    """
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens"))
    total = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    scale, capped = 0.0, -1
    while True:
        full = (ratio * F.lit(scale) >= 1) if scale else F.lit(False)
        row = cells.agg(F.sum(F.when(full, 1).otherwise(0)).alias("capped"),
                        F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("kept"),
                        F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("free")).first()
        if row.capped == capped or not row.free:
            break
        capped, scale = row.capped, max((budget * total - row.kept) / row.free, scale)
    return cells.withColumn("probability", F.coalesce(F.round(F.least(F.lit(1.0), ratio * F.lit(scale)), 9), F.lit(1.0)))


def sample_goals(cells: DataFrame, target: DataFrame, margin: str, budget: float = BUDGET) -> DataFrame:
    """(margin, goal): tokens of each category in a sample of ``budget`` times all tokens.

    Goals are in proportion to the target shares; a category that has fewer
    tokens than that is kept whole, and the others share the rest.
    """
    found = stage(join_small(cells.groupBy(margin).agg(F.sum("tokens").alias("tokens")),
                             target.select(margin, F.col("share").cast("double").alias("weight")), [margin],
                             "left").fillna(0.0, ["weight"]), "goals")
    return probabilities(found, budget).select(margin, (F.col("tokens") * F.col("probability")).alias("goal"))


def rake_sample(cells: DataFrame, targets: dict[str, DataFrame], budget: float = BUDGET, sweeps: int = SWEEPS,
                tolerance: float = TOLERANCE) -> DataFrame:
    """``cells`` of ``rake`` with ``probability``: tokens * probability meets the goals of each margin.

    A factor per category scales the cells, of which none passes 1. Of the
    cells by falling ratio, let the first k be full: the factor that then meets
    the goal is (goal - full tokens) / rest, and the largest over all k is the
    one that holds. Goals that contradict one another end at the last sweep.
    """
    total = cells.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    fitted = cells.withColumn("ratio", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens") * budget))
    for margin, target in targets.items():
        goals = sample_goals(cells, target, margin, budget)
        fitted = join_small(fitted, goals.withColumnRenamed("goal", f"goal_{margin}"), [margin])
    fitted = stage(fitted, "cells")
    expected = F.col("tokens") * F.least(F.lit(1.0), F.col("ratio"))
    for done in range(0, sweeps, SWEEPS_PER_PLAN):
        if max(_deviation(fitted.withColumn("weight", expected), m) for m in targets) <= tolerance * max(total, 1):
            break
        for _ in range(min(SWEEPS_PER_PLAN, sweeps - done)):
            for margin in targets:
                falling = Window.partitionBy(margin).orderBy(F.desc("ratio"))
                full = F.coalesce(F.sum("tokens").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
                rest = F.sum(F.col("tokens") * F.col("ratio")).over(falling.rowsBetween(0, Window.unboundedFollowing))
                factor = F.when(rest > 0, (F.col(f"goal_{margin}") - full) / rest)
                fitted = fitted.withColumn("factor", factor).withColumn("ratio", F.col("ratio") * F.coalesce(
                    F.max("factor").over(Window.partitionBy(margin)), F.lit(1.0))).drop("factor")
        fitted = stage(fitted, "cells")
    return fitted.withColumn("probability", F.coalesce(
        F.round(F.least(F.lit(1.0), F.col("ratio")), 9), F.lit(1.0))).drop("ratio", *[f"goal_{m}" for m in targets])


def mix(df: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET,
        text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """All rows of ``df`` with source, lang, topic, n_tokens, weight, probability and sampled.

    ``targets`` maps a margin to a table (category, share); by default the
    found shares, tempered. ``weight`` is fitted over found tokens.
    """
    body = text_or_empty(text)
    draw = F.pmod(F.xxhash64(F.lit(SEED), F.col(f"`{id_column}`"), F.crc32(F.encode(body, "UTF-8"))), F.lit(1 << 40))
    rows = df.select(packed(df), category("source").alias("source"), category("lang").alias("lang"),
                     topic(body).alias("topic"), tokens(body).alias("tokens"), (draw / (1 << 40)).alias("draw"))
    cells = stage(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents")), "cells")
    if targets is None:
        targets = {m: tempered_targets(cells, m) for m in MARGINS}
    fitted = stage(rake_sample(rake(cells, targets), targets, budget).select(
        *MARGINS, F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(1.0).alias("weight"),
        "probability"), "probabilities")
    joined = join_small(rows, fitted, list(MARGINS))
    return unpacked(joined, source=F.col("source"), lang=F.col("lang"), topic=F.col("topic"),
                    n_tokens=F.col("tokens"), weight=F.round("weight", 9), probability=F.col("probability"),
                    sampled=F.col("draw") < F.col("probability"))


def sampled_documents(df: DataFrame, **options) -> DataFrame:
    """The sampled rows, with the columns of ``df`` only."""
    keys = df.select(packed(df, "document"), "doc_id", "source", "lang", "text")
    return mix(keys, **options).where("sampled").select("document.*")
