"""Components of links, and how often a round reads its links: the driver keeps the plan of every job that has run."""

import random

from pyspark.sql import functions as F

from fieldpulse.llm import raking
from fieldpulse.llm.components import _large_star, _small_star, components

LINKS = "a bigint, b bigint"


def reads(df):
    return df._jdf.queryExecution().sparkPlan().collectLeaves().size()


def test_components_of_chains_stars_loops_and_repeats(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(-40, 0)] + [(100, 100 + i) for i in range(50)]
    links += [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(90)] * 2
    root = {x: x for ab in links for x in ab}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    met = {x for a, b in links if a != b for x in (a, b)}
    found = components(spark.createDataFrame(links, LINKS)).collect()
    assert sorted(map(tuple, found)) == sorted((x, find(x)) for x in met)


def test_no_links_no_components(spark):
    assert components(spark.createDataFrame([], LINKS)).collect() == []


def test_a_round_reads_its_links_four_times(spark):
    assert reads(_small_star(_large_star(spark.range(10).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))))) <= 4


def test_margins_read_the_cells_once(spark):
    cells = spark.range(4).select(*[F.col("id").cast("string").alias(d) for d in raking.DIMENSIONS],
                                  F.lit(10).alias("tokens"), F.lit(0.5).alias("probability"))
    goals = {d: spark.range(3).select(F.col("id").cast("string").alias(d), F.lit(6.0).alias("goal")) for d in raking.DIMENSIONS}
    off = raking.margins(cells, goals)
    assert reads(off) == 4
    assert sorted(map(tuple, off.collect())) == sorted((d, v, 6.0, 5.0) for d in raking.DIMENSIONS for v in "012")
