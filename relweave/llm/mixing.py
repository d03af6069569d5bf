"""Mixing sources to target weights by iterative proportional fitting, then sampling.

Token totals of the cells (source, language, topic) are raked: in turn, for each margin, every cell is
scaled so that the margin's values get their target shares.  The totals of the cells are one small
aggregation; everything after it, windows over the cells included, works on one row for each cell.  A
document's probability is its cell's factor over the largest factor, so no probability is above 1 and the
expected tokens of the sample have the raked shares.  Documents are drawn by a hash of their id, the same
ones on every run.  All of it is DataFrame functions.

By default a margin's target shares are its token shares to the power ``TEMPER``, scaled to 1, which takes
weight from large sources and languages without naming them.

A null in a margin is a value of its own.  A null or empty text has 0 tokens; a cell without tokens has
nothing to weigh, and its documents have probability 1.  A document without an id is drawn as the text
'null'.  Equal rows are drawn alike.  Empty tables give no rows.  Columns of the input may have any name;
``mix`` returns all of them and no other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from relweave.llm.tables import keep

#: Exponent of the default target shares.
TEMPER = 0.7
#: Rounds of fitting, each over all margins.
ROUNDS = 8
#: Rounds in one plan.
STORED_ROUNDS = 8
#: Digits kept of a probability, so that the order of additions does not decide about a document.
DIGITS = 9

MARGINS = ("source", "lang", "topic")


def tokens(text: str = "text") -> Column:
    """Parts of a text between spaces and line ends, each counted alone; 0 if it is null or empty."""
    column = F.col(text)
    bare = F.replace(F.replace(column, F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))
    return F.when(F.coalesce(F.length(column), F.lit(0)) > 0, F.length(column) - F.length(bare) + 1).otherwise(0).cast("long")


def topic(text: str = "text") -> Column:
    """A stand-in for a topic label, which the table lacks: the kind of content."""
    column = F.coalesce(F.col(text), F.lit(""))
    return (
        F.when(column.contains("License") | column.contains("All rights reserved"), "licensed")
        .when(column.contains(" | "), "tabular")
        .when(F.length(column) < 1000, "short")
        .otherwise("prose")
    )


def tempered(cells: DataFrame, margin: str, power: float = TEMPER) -> DataFrame:
    """Default targets of a margin: value, share."""
    totals = cells.groupBy(F.col(margin).alias("value")).agg(F.sum("tokens").cast("double").alias("total"))
    raised = F.when(F.col("total") > 0, F.pow("total", F.lit(power))).otherwise(0.0)
    return totals.select("value", (raised / F.sum(raised).over(Window.partitionBy())).alias("share"))


def raked(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """The cells with ``weight``, their share of the tokens after fitting.

    ``targets`` gives for each margin a frame (value, share); values without a target get none.
    """
    frame = cells.withColumn("weight", F.col("tokens").cast("double"))
    for margin, target in targets.items():
        wanted = target.select(F.col("value").alias("t_value"), F.col("share").alias(f"t_{margin}"))
        frame = frame.join(wanted, F.col(margin).eqNullSafe(F.col("t_value")), "left").drop("t_value")
        frame = frame.withColumn(f"t_{margin}", F.coalesce(f"t_{margin}", F.lit(0.0)))
    frame = keep(frame, "cells")
    for done in range(1, rounds + 1):
        for margin in targets:
            held = F.sum("weight").over(Window.partitionBy(margin))
            frame = frame.withColumn("weight", F.when(held > 0, F.col("weight") * F.col(f"t_{margin}") / held).otherwise(0.0))
        if done % STORED_ROUNDS == 0 and done < rounds:  # keeps the plan short
            frame = keep(frame, "cells")
    return keep(frame.select(*cells.columns, "weight"), "raked")


def probabilities(cells: DataFrame) -> DataFrame:
    """Cells with ``probability``: the factor of each over the largest."""
    factor = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens"))
    largest = cells.select(F.max(factor)).first()[0]
    share = F.round(F.coalesce(factor / F.lit(largest), F.lit(1.0)), DIGITS) if largest else F.lit(1.0)
    return cells.withColumn("probability", share)


def draw(doc_id: str = "doc_id") -> Column:
    """A number in [0, 1) that follows from an id alone."""
    digest = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def _with_probability(rows: DataFrame, targets: dict[str, DataFrame] | None, rounds: int) -> DataFrame:
    """Rows (with the margins and tokens) and the probability of their cell."""
    cells = keep(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "cell-tokens")
    wanted = targets or {margin: tempered(cells, margin) for margin in MARGINS}
    chances = probabilities(raked(cells, wanted, rounds)).select(*[F.col(m).alias(f"c_{m}") for m in MARGINS], "probability")
    same = F.lit(True)
    for margin in MARGINS:
        same = same & F.col(margin).eqNullSafe(F.col(f"c_{margin}"))
    return rows.join(chances, same, "left").drop(*[f"c_{m}" for m in MARGINS])


def calibrated(documents: DataFrame, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, tokens, probability, sampled."""
    rows = documents.select("doc_id", "source", "lang", topic().alias("topic"), tokens().alias("tokens"))
    return _with_probability(rows, targets, rounds).withColumn("sampled", draw() < F.col("probability"))


def mix(documents: DataFrame, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """The sampled documents with all columns of the input."""
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    rows = documents.select("doc_id", "source", "lang", topic().alias("topic"), tokens().alias("tokens"), row)
    return _with_probability(rows, targets, rounds).where(draw() < F.col("probability")).select("row.*")
