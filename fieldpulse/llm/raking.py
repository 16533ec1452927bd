"""Source mixing by iterative proportional fitting.

Token counts by (source, language, topic) are raked: factors per source, per language and per topic are
set in turn so that the weighted tokens match that dimension's target shares, until all three do.
A document's weight is the product of its three factors; its sampling probability is the weight over
the largest one, so the expected token mix of the sample is the target mix.  The draw is a fixed
hash of the key: the same document is drawn alike in every run and at every size.

With ``keep`` the sample has that share of all tokens instead, whatever the rarest cell is: probabilities
are raked themselves, at most 1 each.  A value that has fewer tokens than its target is taken in full and
the others of its dimension share the rest; so does a cell within its values.  Rounds end when every
total is within ``TOLERANCE`` of its target; targets that cannot be met together give a warning with the gap.

Only the table of cells and the factors take part in the rounds; every step is one aggregate over the
cells and is written, so plans stay small.  A hot source is one row of its cell table.

Edge cases: null source or language count as the value ``''``; null and empty texts have no tokens and
are drawn like the others of their cell; values whose cells hold no token get factor 0; targets
are scaled to the values that occur; a null key has a draw of its own; repeated rows share their draw;
an empty table gives an empty result; columns named like a result are replaced, but ``drawn_rows`` keeps them.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

DIMENSIONS = ("source", "lang", "topic")
ROUNDS = 8
#: Share of all tokens that the pipeline draws.
KEEP = 0.6
#: Relative distance to a target at which bounded rounds end, and their number at most.
TOLERANCE = 0.01
MAX_ROUNDS = 30
#: A share is raised to this power, which lifts small values: the default targets.
TEMPER = {"source": 0.7, "lang": 0.9, "topic": 0.9}
TOKEN = r"[^\x20\x09-\x0D]+"
#: Topics by the form of a text, the first that fits; a text of none of them is prose.
FORMS = (("licence", "Licensed under"), ("table", " | "), ("symbols", "%%%"), ("shout", "!!"))
DRAW_DIGITS = 13


def tokens_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("bigint")


def topic_of(text: Column) -> Column:
    out = F.lit("prose")
    for name, mark in reversed(FORMS):
        out = F.when(F.contains(text, F.lit(mark)), name).otherwise(out)
    return out


def draw_of(key: Column) -> Column:
    """A number in [0, 1) from the MD5 of the key as text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, DRAW_DIGITS), 16, 10).cast("double") / float(16 ** DRAW_DIGITS)


def _value(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("")).alias(column)


def cells_of(docs: DataFrame, text: str = "text", topic: Column | None = None) -> DataFrame:
    """``(source, lang, topic, tokens)``."""
    return docs.select(
        _value("source"), _value("lang"), (topic_of(F.col(text)) if topic is None else topic).alias("topic"),
        tokens_of(F.col(text)).alias("tokens"),
    ).groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens"))


def tempered(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """``(dimension, share)``: the token shares of its values, raised to a power."""
    return cells.groupBy(dimension).agg(F.sum("tokens").alias("t")).where("t > 0").select(
        dimension, F.pow(F.col("t").cast("double"), F.lit(power)).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], rounds: int = ROUNDS) -> DataFrame:
    """``(source, lang, topic, tokens, weight, gap)``; ``targets``: ``(dimension, share)`` per dimension.

    Shares need not add up to 1.  ``gap`` is the largest relative distance between a weighted
    total and its target after the last round: near 0 when the targets can be met together.  A warning tells
    a gap over ``TOLERANCE``.
    """
    scaled = {}
    for d in DIMENSIONS:
        here = targets[d].join(cells.where("tokens > 0").select(d).distinct(), d)
        scaled[d] = materialise(here.withColumn("_all", here.agg(F.sum("share").alias("s")).scalar())
                                .select(d, (F.col("share") / F.col("_all")).alias("share")))
    factors = {d: scaled[d].select(d, F.lit(1.0).alias(f"f_{d}")) for d in DIMENSIONS}

    def weighted(dims: list[str]) -> DataFrame:
        out = cells.withColumn("w", F.col("tokens").cast("double"))
        for d in dims:
            out = out.join(factors[d], d, "left").withColumn("w", F.col("w") * F.coalesce(f"f_{d}", F.lit(0.0)))
        return out

    for _ in range(rounds):
        for d in DIMENSIONS:
            others = [x for x in DIMENSIONS if x != d]
            total = weighted(others).groupBy(d).agg(F.sum("w").alias("t"))
            factors[d] = materialise(total.join(scaled[d], d).select(
                d, F.when(F.col("t") > 0, F.col("share") / F.col("t")).otherwise(0.0).alias(f"f_{d}")))
    found = materialise(weighted(list(DIMENSIONS)).select(
        *DIMENSIONS, "tokens", "w",
        F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens")).otherwise(0.0).alias("weight")))
    parts = [
        found.groupBy(d).agg(F.sum("w").alias("t")).join(scaled[d], d).select((F.abs(F.col("t") / F.col("share") - 1)).alias("off"))
        for d in DIMENSIONS]
    gap = parts[0].union(parts[1]).union(parts[2]).agg(F.max("off").alias("gap")).first()["gap"]
    if gap is not None and gap > TOLERANCE:
        warnings.warn(f"the weights miss a target by {gap:.1%} after {rounds} rounds", stacklevel=2)
    return found.withColumn("gap", F.lit(gap).cast("double")).drop("w")


def reachable(cells: DataFrame, target: DataFrame, dimension: str, goal: float) -> DataFrame:
    """``(dimension, goal)``: tokens by the shares of ``target``, at most those there are, ``goal`` in all."""
    base = materialise(
        cells.groupBy(dimension).agg(F.sum("tokens").cast("double").alias("has")).join(target, dimension).where("share > 0"))
    scale, full = 0.0, -1
    while True:  # each round takes more values in full
        row = base.agg(
            F.sum(F.when(F.col("share") * scale >= F.col("has"), F.col("has"))).alias("taken"),
            F.sum(F.when(F.col("share") * scale < F.col("has"), F.col("share"))).alias("open"),
            F.count(F.when(F.col("share") * scale >= F.col("has"), 1)).alias("n")).first()
        if row["n"] == full or not row["open"]:
            break
        full, scale = row["n"], max(scale, (goal - (row["taken"] or 0.0)) / row["open"])
    return materialise(base.select(dimension, F.least(F.col("has"), F.col("share") * scale).alias("goal")))


def margins(cells: DataFrame, goals: dict[str, DataFrame]) -> DataFrame:
    """``(dimension, value, goal, reached)`` in tokens, of cells with ``tokens`` and ``probability``."""
    value = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in DIMENSIONS]))
    reached = cells.select(value.alias("v"), (F.col("tokens") * F.col("probability")).alias("x")).groupBy("v.dimension", "v.value").agg(
        F.sum("x").alias("reached"))
    wanted = reduce(DataFrame.union, [goals[d].select(F.lit(d).alias("dimension"), F.col(d).alias("value"), "goal") for d in DIMENSIONS])
    return reached.join(wanted, ["dimension", "value"]).select("dimension", "value", "goal", "reached")


def bounded(cells: DataFrame, targets: dict[str, DataFrame], keep: float = KEEP,
            rounds: int = MAX_ROUNDS) -> tuple[DataFrame, dict[str, DataFrame], float]:
    """``(source, lang, topic, tokens, probability)``, the goals in tokens and the largest relative distance to one."""
    some = materialise(cells.where("tokens > 0"))
    goal = keep * (some.agg(F.sum("tokens")).first()[0] or 0)
    goals = {d: reachable(some, targets[d], d, goal) for d in DIMENSIONS}
    now = some.withColumn("raw", F.lit(float(keep)))
    chance = F.least(F.col("raw"), F.lit(1.0)).alias("probability")
    gap = float("inf")
    for _ in range(rounds):
        for d in DIMENSIONS:
            reached = now.groupBy(d).agg(F.sum(F.col("tokens") * chance).alias("t"))
            ratio = reached.join(goals[d], d).where("t > 0").select(d, (F.col("goal") / F.col("t")).alias("ratio"))
            now = materialise(now.join(ratio, d, "left").select(
                *DIMENSIONS, "tokens", (F.col("raw") * F.coalesce("ratio", F.lit(0.0))).alias("raw")))
        off = margins(now.select(*DIMENSIONS, "tokens", chance), goals)
        gap = off.agg(F.max(F.abs(F.col("reached") / F.col("goal") - 1))).first()[0] or 0.0
        if gap <= TOLERANCE:
            break
    else:
        warnings.warn(f"the mixture misses a target by {gap:.1%} after {rounds} rounds", stacklevel=2)
    found = now.select(*DIMENSIONS, "tokens", chance)
    return found.union(cells.where("tokens <= 0").select(*DIMENSIONS, "tokens", F.lit(0.0))), goals, gap


def calibrated(docs: DataFrame, cells: DataFrame, key: str = "doc_id", text: str = "text",
               topic: Column | None = None) -> DataFrame:
    """``docs`` with ``topic``, ``weight``, ``probability`` and ``sampled``; ``cells`` come from ``rake`` or ``bounded``."""
    own = [c for c in docs.columns if c not in ("topic", "weight", "probability", "sampled")]
    rows = docs.select(
        *own, (topic_of(F.col(text)) if topic is None else topic).alias("topic"),
        _value("source").alias("_source"), _value("lang").alias("_lang"))
    if "probability" in cells.columns:  # bounded: there is no largest weight to divide by
        cells, top = cells.withColumnRenamed("probability", "weight"), F.lit(1.0)
    else:
        top = cells.agg(F.max("weight").alias("m")).scalar()
    known = cells.select(
        F.col("source").alias("_source"), F.col("lang").alias("_lang"), "topic", "weight").withColumn("_top", top)
    met = rows.join(known, ["_source", "_lang", "topic"], "left")
    weight = F.coalesce("weight", F.lit(0.0))
    chance = F.when(F.col("_top") > 0, weight / F.col("_top")).otherwise(0.0)
    return met.select(*own, "topic", weight.alias("weight"), chance.alias("probability")).withColumn(
        "sampled", draw_of(F.col(key)) < F.col("probability"))


def mix(docs: DataFrame, powers: dict[str, float] | None = None, rounds: int = ROUNDS, key: str = "doc_id",
        text: str = "text", topic: Column | None = None, keep: float | None = None) -> DataFrame:
    """``calibrated`` towards tempered shares of the given documents themselves.

    With ``keep`` that share of the tokens is drawn and ``rounds`` is not used; ``weight`` is the probability then.
    """
    powers = powers or TEMPER
    cells = materialise(cells_of(docs, text, topic))
    targets = {d: tempered(cells, d, powers[d]) for d in DIMENSIONS}
    if keep is not None:
        return calibrated(docs, bounded(cells, targets, keep)[0], key, text, topic)
    return calibrated(docs, rake(cells, targets, rounds), key, text, topic)


def drawn_rows(docs: DataFrame, powers: dict[str, float] | None = None, rounds: int = ROUNDS, key: str = "doc_id",
               text: str = "text", keep: float | None = None) -> DataFrame:
    """The rows of ``docs`` that ``mix`` draws, all columns as they are, also those named like its results."""
    used = docs.select(F.struct(*docs.columns).alias("_row"), key, text, "source", "lang")
    return mix(used, powers, rounds, key, text, keep=keep).where("sampled").select("_row.*")
