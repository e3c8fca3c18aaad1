"""Classification trees without a limit on depth or on the number of cuts: every value of every feature is a candidate.

Trees grow level by level, all nodes of all trees at once. A node's rows are summed per feature and distinct value, and running
sums in the order of the values price every cut (Gini). The order is made in blocks: cut points from approximate
quantiles deal the values of a feature into blocks of some ten thousand, a block's sums are made on their own, and one
row a block carries them on, so that neither the root nor a frequent value is sorted in one task. Cut points only make blocks
even; every value is a candidate wherever it falls.

A level is a written table of nodes; the rows below its splits are written again for the next level, without those in
leaves, so a lost executor costs a level at most. Nodes are joined with rows, never collected: a tree may have as many leaves as
there are rows. Growth ends where a node is pure or no feature tells its rows apart.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, factorial

from pyspark.sql import Column, DataFrame, Window, functions as F

from placewise.constants import SEED
from placewise.plans.ranges import with_bucket
from placewise.session import stage

BLOCK = 1 << 16  # distinct values of a feature whose order is made in one task
CUT_BASE = 16  # parts that a step of the search for a block tells apart
STEPS = 6  # levels that scoring walks in one job
BAG = [sum(exp(-1) / factorial(i) for i in range(k + 1)) for k in range(12)]  # Poisson(1): chance of at most k copies

NODE = ["tree", "node"]


@dataclass
class ExactTrees:
    """``levels``: tables (tree, node, n0, n1, share, feature, threshold, left, right), the last four null in a leaf.

    ``share`` is the weighted share of label 1. Rows with a value up to the threshold go left.
    """

    features: list[str]
    num_trees: int
    levels: list[DataFrame]

    def nodes(self) -> DataFrame:
        """All nodes with their level, feature by name."""
        tables = [t.withColumn("level", F.lit(i)) for i, t in enumerate(self.levels)]
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out.withColumn("feature", F.get(F.array(*[F.lit(c) for c in self.features]), F.col("feature")))

    def score(self, df: DataFrame, key: str, out: str = "probability_1") -> DataFrame:
        """``key`` (unique) and the mean share over the trees' leaves."""
        rows = df.select(F.col(key).alias("key"), _values(self.features).alias("x"),
                         F.explode(F.sequence(F.lit(0), F.lit(self.num_trees - 1))).alias("tree"),
                         F.lit(1).cast("long").alias("node"), F.lit(None).cast("double").alias("p"))
        for i, level in enumerate(self.levels, 1):
            met = rows.join(level, NODE, "left")
            rows = met.select("key", "x", "tree", F.when(F.col("feature").isNotNull(), _child()).alias("node"),
                              F.coalesce("p", F.when(F.col("feature").isNull(), F.col("share"))).alias("p"))
            if i % STEPS == 0:
                rows = stage(rows, "tree_walk")
        return rows.groupBy(F.col("key").alias(key)).agg(F.avg("p").alias(out))


def fit_exact_trees(df: DataFrame, label: str, features: list[str], key: str, num_trees: int = 1, bootstrap: bool = False,
                    max_features: int | None = None, balanced: bool = False, seed: int = SEED,
                    max_levels: int | None = None) -> ExactTrees:
    """Trees for a 0/1 ``label`` (rows without one are left out) over numeric ``features``; null and NaN lie below all numbers.

    A node takes the cut with the greatest weighted Gini gain among ``max_features`` of the features that tell its rows
    apart (all by default); on ties the first feature, then the lowest cut, halfway between neighbours. ``bootstrap`` gives each
    row a Poisson(1) number of copies per tree, drawn by the hash of its ``key``; ``balanced`` weighs classes inversely to
    their rows. The same rows give the same trees on any partitioning.
    """
    rows = df.where(F.col(label).isNotNull()).select(
        F.col(label).cast("int").alias("label"), _values(features).alias("x"), F.col(key).alias("key"),
        F.explode(F.sequence(F.lit(0), F.lit(num_trees - 1))).alias("tree"), F.lit(1).cast("long").alias("node"))
    drawn = _unit(F.lit(seed), "tree", "key")
    copies = sum(((drawn > p).cast("long") for p in BAG), F.lit(0)) if bootstrap else F.lit(1)
    rows = stage(rows.withColumn("n", copies.cast("long")).where("n > 0").drop("key"), "tree_rows")
    counts = rows.agg(F.sum(F.when(F.col("label") == 0, F.col("n"))), F.sum(F.when(F.col("label") == 1, F.col("n")))).first()
    if counts[0] is None and counts[1] is None:
        raise ValueError("no rows to learn from")
    weights = [sum(c or 0 for c in counts) / (2 * c) if balanced and c else 1.0 for c in counts]
    cuts, levels = _cut_points(rows, len(features)), []
    while True:
        last = max_levels is not None and len(levels) == max_levels
        nodes = stage(_level(rows, len(features), cuts, weights, max_features, seed, last), "tree_nodes")
        levels.append(nodes)
        inner = nodes.where(F.col("feature").isNotNull())
        if inner.isEmpty():
            return ExactTrees(features, num_trees, levels)
        rows = stage(rows.join(inner, NODE).select("label", "x", "tree", _child().alias("node"), "n"), "tree_rows")


def _values(features: list[str]) -> Column:
    lowest = F.lit(float("-inf"))
    return F.array(*[F.coalesce(F.nanvl(F.col(c).cast("double"), lowest), lowest) for c in features])


def _child() -> Column:
    return F.when(F.get("x", F.col("feature")) <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))


def _unit(*parts) -> Column:
    """A number in [0, 1) that the parts fix."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def _cut_points(rows: DataFrame, n_features: int) -> tuple[Column, int]:
    """For each feature the points that cut its distinct values into blocks, as a one-row subquery, and how many steps
    of a search among ``CUT_BASE`` find a value's place."""
    n_blocks = rows.count() // BLOCK + 1
    shares = [i / n_blocks for i in range(1, n_blocks)]
    if not shares:
        return F.array(*[F.array().cast("array<double>") for _ in range(n_features)]), 1
    levels = 1
    while CUT_BASE ** levels < n_blocks:
        levels += 1
    points = rows.agg(F.array(*[F.array_distinct(F.percentile_approx(F.get("x", F.lit(i)), shares)) for i in range(n_features)]))
    return stage(points.toDF("cuts"), "tree_cuts").scalar(), levels


def _level(rows: DataFrame, n_features: int, cuts: tuple[Column, int], weights: list[float], max_features: int | None, seed: int,
           last: bool) -> DataFrame:
    """The nodes that the rows stand in, with their best split."""
    ends = F.array(*[F.struct(F.lit(i).alias("feature"), F.min(F.get("x", F.lit(i))).alias("lo"),
                              F.max(F.get("x", F.lit(i))).alias("hi")) for i in range(n_features)])
    sums = [F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (0, 1)]
    nodes = rows.groupBy(*NODE).agg(*sums, ends.alias("ends"))
    open_features = F.transform(F.filter("ends", lambda e: e["lo"] < e["hi"]), lambda e: e["feature"])
    if max_features is not None:
        drawn = F.transform(open_features, lambda f: F.struct(F.xxhash64(F.lit(seed), "tree", "node", f).alias("h"), f.alias("f")))
        open_features = F.slice(F.transform(F.array_sort(drawn), lambda d: d["f"]), 1, max_features)
    w0, w1 = (F.col(f"n{k}") * F.lit(weights[k]) for k in (0, 1))
    share = w1 / (w0 + w1)
    leaf = nodes.select(*NODE, "n0", "n1", share.alias("share"),
                        F.when((F.col("n0") > 0) & (F.col("n1") > 0) & F.lit(not last), open_features)
                        .otherwise(F.array().cast("array<int>")).alias("tried"))
    # written, its size is known: few nodes are sent to the rows, which would else all move to the task of their node
    leaf = stage(leaf, "tree_open")
    best = _best_cuts(rows, leaf.where(F.size("tried") > 0).select(*NODE, "tried"), *cuts, weights)
    numbered = best.withColumn("i", F.row_number().over(Window.partitionBy("tree").orderBy("node")).cast("long"))
    numbered = numbered.select(*NODE, "feature", "threshold", (2 * F.col("i")).alias("left"), (2 * F.col("i") + 1).alias("right"))
    return leaf.drop("tried").join(numbered, NODE, "left")


def _best_cuts(rows: DataFrame, nodes: DataFrame, cuts: Column, cut_levels: int, weights: list[float]) -> DataFrame:
    """tree, node, feature and threshold of the cut with the least impurity on its two sides."""
    tried = rows.join(nodes, NODE).select(*NODE, "label", "n", "x", F.explode("tried").alias("feature"))
    tried = tried.withColumn("all_cuts", cuts).select(
        *NODE, "feature", F.get("x", F.col("feature")).alias("value"), "label", "n", F.get("all_cuts", F.col("feature")).alias("cuts"))
    tried = with_bucket(tried, "value", "cuts", CUT_BASE, cut_levels, "block").drop("cuts")
    cell = [*NODE, "feature"]
    values = tried.groupBy(*cell, "block", "value").agg(
        *[F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (0, 1)])
    blocks = values.groupBy(*cell, "block").agg(F.sum("n0").alias("b0"), F.sum("n1").alias("b1"), F.min("value").alias("first"))
    order = Window.partitionBy(*cell).orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*cell)
    blocks = blocks.select(*cell, "block", *[F.coalesce(F.sum(f"b{k}").over(before), F.lit(0)).alias(f"a{k}") for k in (0, 1)],
                           *[F.sum(f"b{k}").over(whole).alias(f"t{k}") for k in (0, 1)], F.lead("first").over(order).alias("after"))
    inside = Window.partitionBy(*cell, "block").orderBy("value")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    sides = values.join(blocks, [*cell, "block"]).select(
        *cell, "value", F.coalesce(F.lead("value").over(inside), F.col("after")).alias("next"),
        *[(F.col(f"a{k}") + F.sum(f"n{k}").over(upto)).alias(f"l{k}") for k in (0, 1)], "t0", "t1").where("next is not null")
    l0, l1 = (F.col(f"l{k}") * F.lit(weights[k]) for k in (0, 1))
    r0, r1 = ((F.col(f"t{k}") - F.col(f"l{k}")) * F.lit(weights[k]) for k in (0, 1))
    purity = (l0 * l0 + l1 * l1) / (l0 + l1) + (r0 * r0 + r1 * r1) / (r0 + r1)
    middle = F.col("value") / 2 + F.col("next") / 2
    threshold = F.when(middle < F.col("next"), middle).otherwise(F.col("value"))
    cut = F.struct(purity.alias("purity"), (-F.col("feature")).alias("first"), (-F.col("value")).alias("low"),
                   F.col("feature").alias("feature"), threshold.alias("threshold"))
    return sides.groupBy(*NODE).agg(F.max(cut).alias("cut")).select(*NODE, "cut.feature", "cut.threshold")
