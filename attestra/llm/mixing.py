"""Problem 8: mixing sources to target shares of the total size.

Method: hierarchical budgeting. Weights go down a tree of domain, language and source;
a leaf can give its size times its repeats; what it cannot give goes to its siblings
before their ancestors' siblings; every leaf then takes a prefix of its token sequence
over seeded epochs (each epoch is the leaf's documents in another random order), and what
is left of its budget before the document at the edge is carried to the next leaf of the tree.

Scale: leaf sizes are pre-aggregated and budgets are window sums over the table of leaves,
so no number of leaves is refused; the last, partial epoch is found by bucket sums. Only the
carrying visits the leaves (categories, not documents) one after another, in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.llm.prefix import up_to_budget
from attestra.tables import materialize

PATH = ("domain", "language", "source")


def water_fill(rows: DataFrame, by: Sequence[str], order: Sequence[str], pool: str, room: str, weight: str) -> DataFrame:
    """Adds ``took``: the pool of each group poured over its rows by weight, none above its room.

    What a full row cannot take goes to the others by weight. Rows without room or weight take nothing, null counts as 0.
    """
    value = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    usable = (value(room) > 0) & (value(weight) > 0)
    d = rows.withColumns({"_r": F.when(usable, value(room)).otherwise(0.0), "_w": F.when(usable, value(weight)).otherwise(0.0)})
    d = d.withColumn("_ratio", F.when(usable, F.col("_r") / F.col("_w")))
    group = Window.partitionBy(F.lit(0), *by)
    up_to = group.orderBy(F.col("_ratio").asc_nulls_last(), *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the pool at which a row is full: all smaller ones are full by then, the others have as much for each unit of weight
    need = F.sum("_r").over(up_to) + F.col("_ratio") * (F.sum("_w").over(group) - F.sum("_w").over(up_to))
    d = d.withColumn("_full", F.coalesce(usable & (need <= value(pool)), F.lit(False)))
    filled = F.sum(F.when(F.col("_full"), F.col("_r")).otherwise(0.0)).over(group)
    others = F.sum(F.when(~F.col("_full"), F.col("_w")).otherwise(0.0)).over(group)
    part = F.least(F.col("_r"), F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col("_w") * (value(pool) - filled), others), F.lit(0.0))))
    return d.withColumn("took", F.when(F.col("_full"), F.col("_r")).otherwise(part)).drop("_r", "_w", "_ratio", "_full")


def wants(leaves: DataFrame, path: Sequence[str], total: float) -> DataFrame:
    """Adds wanted, unmet and budget to leaves with ``weight`` (share of ``total``) and ``capacity``.

    ``wanted`` goes down the tree by weight, ``budget`` is what the leaf can give of it, ``unmet`` what it lacks.
    """
    d = leaves
    at: Column = F.lit(float(total)) * F.sum("weight").over(Window.partitionBy(F.lit(0)))
    for depth in range(len(path)):
        up, down = (Window.partitionBy(F.lit(0), *path[:k]) for k in (depth, depth + 1))
        at = at * F.coalesce(F.try_divide(F.sum("weight").over(down), F.sum("weight").over(up)), F.lit(0.0))
    # leaves of one path are one leaf, so the last share is the leaf's own
    return d.withColumn("wanted", at).withColumn("budget", F.least("wanted", "capacity")).withColumn("unmet", F.col("wanted") - F.col("budget"))


def budgets(wanted: DataFrame, path: Sequence[str]) -> DataFrame:
    """``budget`` of each leaf after shortages were taken over, by siblings first, then by the branches of each ancestor."""
    d = wanted.withColumn("_left", F.col("unmet"))
    for depth in range(len(path) - 1, -1, -1):
        d = materialize(_take_over(d, path, depth), "budgets")  # a few bytes for each leaf
    return d.drop("_left")


def _take_over(leaves: DataFrame, path: Sequence[str], depth: int) -> DataFrame:
    """One round: what the branches of each node of a depth could not give is poured over that node's branches, down to the leaves."""
    node = list(path[:depth])
    d = leaves.withColumn("_room", F.col("capacity") - F.col("budget"))
    lacking = F.sum("_left").over(Window.partitionBy(F.lit(0), *node))
    d = d.withColumn("_pool", lacking)
    for level in range(depth, len(path)):
        parent, child = list(path[:level]), list(path[: level + 1])
        if level == len(path) - 1:
            d = water_fill(d, parent, child, "_pool", "_room", "weight")
        else:
            branch = d.groupBy(*child).agg(F.sum("_room").alias("_room"), F.sum(F.when(F.col("_room") > 0, F.col("weight"))).alias("weight"), F.first("_pool").alias("_pool"))
            poured = water_fill(branch, parent, child, "_pool", "_room", "weight").select(*child, F.col("took").alias("_pool"))
            d = d.drop("_pool").join(poured, child)
    got = F.sum("took").over(Window.partitionBy(F.lit(0), *node))
    rest = F.greatest(F.lit(0.0), lacking - got)
    # what is still lacking stays with one leaf of the node, for the ancestors' round
    first = F.row_number().over(Window.partitionBy(F.lit(0), *node).orderBy(*path)) == 1
    d = d.withColumn("_rest", F.when(first, rest).otherwise(0.0))
    return d.withColumn("budget", F.col("budget") + F.col("took")).withColumn("_left", F.col("_rest")).drop("_room", "_pool", "took", "_rest")


def carry(edges: pd.DataFrame, path: Sequence[str]) -> pd.DataFrame:
    """Leaves (path, lacking, edge: size of the document at the edge) that take that document: the tree's order, what is over is carried on."""
    edges = edges.sort_values(list(path))
    over, up = 0.0, []
    for lacking, edge in zip(edges.lacking, edges.edge):
        over += lacking
        up.append(bool(edge == edge and over >= edge - 1e-6))
        over -= edge if up[-1] else 0.0
    return edges.assign(up=up)[[*path, "up"]]


class SourceMix:
    """Documents mixed to the target shares of their sources.

    ``sized``: doc_id, domain, language, source (nulls become 'none'), n_tokens. ``targets``: source,
    target_share, max_repeats (null: share 0, one use); repeated sources are added up. A source without a
    target is not used; a target without documents is a leaf of size 0. The total is the size of
    all documents unless given; shares are of the total, so where they add up to less than 1 the rest stays unused.
    Documents of no tokens are never chosen, rows without a doc_id are left out, and rows of one doc_id are
    one document (the smallest row). The selection stays below its budget by less than one document, the largest at an edge.
    """

    def __init__(self, sized: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 1):
        named = [F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("none")).alias(c) for c in PATH]
        clean = sized.select("doc_id", *named, F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens")).where("doc_id is not null")
        one = clean.groupBy("doc_id").agg(F.min(F.struct(*PATH, "n_tokens")).alias("x"))
        self.sized, self.seed = one.select("doc_id", "x.*"), seed
        sizes = materialize(self.sized.groupBy(*PATH).agg(F.sum("n_tokens").alias("tokens")), "leaves")
        wanted = targets.where("source is not null").groupBy("source").agg(F.sum(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
        self.all_tokens = sizes.agg(F.sum("tokens")).first()[0] or 0
        self.total = self.all_tokens if total is None else total
        leaves = wanted.join(sizes, "source", "left").select(*[F.coalesce(c, F.lit("none")).alias(c) for c in PATH], "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"))
        # a source's share is split over its leaves as its tokens are
        own = F.sum("tokens").over(Window.partitionBy("source"))
        part = F.when(own > 0, F.col("tokens") / own).otherwise(F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy("source")))
        leaves = leaves.withColumns({"weight": F.col("target_share") * part, "capacity": (F.col("tokens") * F.col("max_repeats")).cast("double")})
        self.wanted = wants(leaves, PATH, self.total)
        self._leaves = self._chosen = None

    @property
    def leaves(self) -> DataFrame:
        """The leaves with wanted, unmet, budget, whole epochs and the rest taken from the epoch that is cut."""
        if self._leaves is None:
            filled = budgets(materialize(self.wanted, "wanted"), PATH)
            epochs = F.when(F.col("tokens") > 0, F.least(F.floor((F.col("budget") + 1e-6) / F.col("tokens")), F.col("max_repeats").cast("long"))).otherwise(0).cast("int")
            self._leaves = filled.withColumn("epochs", epochs).withColumn("rest", F.greatest(F.lit(0.0), F.col("budget") - F.col("epochs") * F.col("tokens")))
        return self._leaves

    def short_sources(self) -> DataFrame:
        """Sources whose leaves could not give what came down the tree to them."""
        per = self.wanted.groupBy("source").agg(F.sum("unmet").alias("unmet"), F.sum("wanted").alias("wanted"))
        return per.where(F.col("unmet") > 1e-9 * F.col("wanted")).select("source")

    def selection(self) -> DataFrame:
        """doc_id, path, n_tokens, copies: how often each document appears."""
        if self._chosen is not None:
            return self._chosen
        path = list(PATH)
        leaves = self.leaves
        leafed = self.sized.where("n_tokens > 0").join(leaves.select(*path, "epochs"), path)
        # the order of the epoch that is cut depends on the seed, the leaf's epoch number and the document
        keyed = leafed.withColumn("_key", F.xxhash64(F.lit(self.seed), F.col("epochs"), F.col("doc_id").cast("string")))
        part = up_to_budget(keyed, leaves.select(*path, F.floor(F.col("rest") + 1e-6).alias("budget")), path, "_key", "doc_id", "n_tokens", edge="at_edge")
        part = materialize(part.select("doc_id", *path, "n_tokens", "at_edge"), "epoch")
        taken = part.groupBy(*path).agg(F.sum(F.when(~F.col("at_edge"), F.col("n_tokens"))).alias("taken"), F.max(F.when(F.col("at_edge"), F.col("n_tokens"))).alias("edge"))
        edges = leaves.where("rest > 0").join(taken, path, "left").select(*path, (F.col("rest") - F.coalesce("taken", F.lit(0))).alias("lacking"), F.col("edge").cast("double").alias("edge"))
        schema = ", ".join(f"{c} string" for c in path) + ", up boolean"
        up = edges.groupBy(F.lit("tree")).applyInPandas(lambda pdf: carry(pdf, path), schema)
        extra = part.join(up, path, "left").where("not at_edge or up").select("doc_id", F.lit(1).alias("extra"))
        chosen = leafed.join(extra, "doc_id", "left").withColumn("copies", F.col("epochs") + F.coalesce("extra", F.lit(0)))
        self._chosen = materialize(chosen.where("copies > 0").select("doc_id", *path, "n_tokens", "copies"), "mix")
        return self._chosen

    def report(self) -> DataFrame:
        """Per source: target share, share reached by the selection, tokens wanted and given, whether it falls short."""
        given = self.selection().groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("given"), F.max("copies").alias("most_copies"))
        per = self.leaves.groupBy("source").agg(F.max("target_share").alias("target_share"), F.sum("wanted").alias("wanted"), F.sum("capacity").cast("long").alias("capacity"), F.sum("unmet").alias("unmet"))
        out = per.join(given, "source", "left").withColumn("given", F.coalesce("given", F.lit(0)))
        share = F.try_divide(F.col("given").cast("double"), F.lit(float(self.total)))
        return out.select("source", "target_share", share.alias("actual_share"), "wanted", "capacity", "given", F.coalesce("most_copies", F.lit(0)).alias("most_copies"), (F.col("unmet") > 1e-9 * F.col("wanted")).alias("short"))

    def levels(self) -> DataFrame:
        """level, domain, language (null above its level), wanted, budget, given and the shares of the total wanted and reached, for the root and every inner node of the tree."""
        given = self.selection().groupBy(*PATH).agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("given"))
        leaves = self.leaves.select(*PATH, "wanted", "budget").join(given, list(PATH), "left")
        nodes = leaves.rollup("domain", "language").agg(F.grouping_id().alias("g"), F.sum("wanted").alias("wanted"), F.sum("budget").alias("budget"), F.coalesce(F.sum("given"), F.lit(0)).alias("given"))
        share = lambda c: F.try_divide(F.col(c).cast("double"), F.lit(float(self.total)))
        return nodes.select(F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "domain").otherwise("language").alias("level"), "domain", "language", "wanted", "budget", "given", share("wanted").alias("target_share"), share("given").alias("actual_share"))
