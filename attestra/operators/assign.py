"""One-to-one assignment: most pairs first, then the greatest total score."""

from __future__ import annotations

from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1_000_000


def one_to_one(edges: list[tuple]) -> list[tuple]:
    """Edges (l, r, score) of a matching of greatest size and, among those, of greatest total score.

    Successive cheapest augmenting paths with node potentials; parallel edges keep their best
    score, and the result does not depend on the order of the input.
    """
    best: dict = {}
    for l, r, s in edges:
        if (l, r) not in best or s > best[l, r]:
            best[l, r] = s
    out: dict = {}
    for (l, r), s in sorted(best.items(), key=lambda e: (str(e[0][0]), str(e[0][1]))):
        out.setdefault(l, []).append((r, SCALE - round(s * SCALE)))
    partner_l: dict = {}
    partner_r: dict = {}
    height_l, height_r = dict.fromkeys(out, 0), {r: 0 for l in out for r, _ in out[l]}
    cost = {(l, r): c for l in out for r, c in out[l]}
    while True:
        dist_l = {l: 0 for l in out if l not in partner_l}
        if not dist_l:
            break
        dist_r: dict = {}
        via: dict = {}
        queue = [(0, i, l) for i, l in enumerate(dist_l)]
        tick, settled = len(queue), set()
        end = None
        while queue:
            d, _, l = heappop(queue)
            if d > dist_l.get(l, d):
                continue
            for r, c in out[l]:
                if partner_l.get(l) == r:
                    continue
                nd = d + c + height_l[l] - height_r[r]
                if nd < dist_r.get(r, float("inf")):
                    dist_r[r], via[r] = nd, l
                    if r in partner_r:
                        back = partner_r[r]
                        total = nd - cost[back, r] + height_r[r] - height_l[back]
                        if total < dist_l.get(back, float("inf")):
                            dist_l[back] = total
                            heappush(queue, (total, tick, back))
                            tick += 1
        free = [(d + height_r[r], i, r) for i, (r, d) in enumerate(dist_r.items()) if r not in partner_r]
        del settled
        if not free:
            break
        end = min(free)[2]
        limit = dist_r[end]
        for l in out:
            height_l[l] += min(dist_l.get(l, limit), limit)
        for r in height_r:
            height_r[r] += min(dist_r.get(r, limit), limit)
        while end is not None:
            l = via[end]
            partner_l[l], partner_r[end], end = end, l, partner_l.get(l)
    return [(l, r, best[l, r]) for l, r in sorted(partner_l.items(), key=lambda e: (str(e[0]), str(e[1])))]


def assign(edge_rows: DataFrame, group: list[str]) -> DataFrame:
    """l, r, score, method of the matching within each group; parallel edges of a pair keep the best.

    An edge that is the only one at both of its ends is in every best matching and never leaves the JVM; only
    entangled edges are matched in Python, a page at a time.
    """
    edge_rows = edge_rows.groupBy(*group, "l", "r").agg(F.max_by(F.struct("score", "method"), "score").alias("b")).select(*group, "l", "r", "b.*")
    ends = lambda c: F.count(F.lit(1)).over(Window.partitionBy(*group, c))
    edge_rows = edge_rows.withColumn("_alone", (ends("l") == 1) & (ends("r") == 1))
    kinds = {c: edge_rows.schema[c].dataType.simpleString() for c in (*group, "l", "r")}
    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", score double, method string"

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        method = {(l, r): m for l, r, m in zip(pdf.l, pdf.r, pdf.method)}
        rows = [[*key, l, r, s, method[l, r]] for l, r, s in one_to_one(list(zip(pdf.l, pdf.r, pdf.score)))]
        return pd.DataFrame(rows, columns=[*group, "l", "r", "score", "method"])

    columns = [*group, "l", "r", "score", "method"]
    entangled = edge_rows.where("not _alone").select(*columns).groupBy(*group).applyInPandas(run, schema)
    return edge_rows.where("_alone").select(*columns).unionByName(entangled)


def records(left: DataFrame, left_id: str, assigned: DataFrame, edge_rows: DataFrame, columns: list[str]) -> DataFrame:
    """Every left row: its partner if assigned, else its best edge as a near miss."""
    near = edge_rows.groupBy("l").agg(F.max_by(F.struct("r", "score"), F.struct("score", F.col("r").cast("string"))).alias("near"))
    out = left.select(F.col(left_id).alias("l"), *columns).join(assigned.select("l", "r", "score", "method"), "l", "left").join(near, "l", "left")
    return out.select("l", *columns, "r", "score", "method", F.when(F.col("r").isNotNull(), "assigned").otherwise("unassigned").alias("assignment_status"), F.when(F.col("r").isNull(), F.col("near.r")).alias("near_r"), F.when(F.col("r").isNull(), F.col("near.score")).alias("near_score"))


def overlap_summary(left: DataFrame, right: DataFrame, pairs: DataFrame, left_id: str, right_id: str, code: str) -> DataFrame:
    """a, b, matched, match_rate (of b), code_agreement (of the matched) and workload a + b - matched."""
    l = left.select(F.col(left_id).alias("l"), F.col(code).alias("cl"))
    r = right.select(F.col(right_id).alias("r"), F.col(code).alias("cr"))
    m = pairs.select("l", "r").join(l, "l").join(r, "r").agg(F.count(F.lit(1)).alias("matched"), F.count_if(F.col("cl") == F.col("cr")).alias("same"))
    one = left.agg(F.count(F.lit(1)).alias("a")).join(right.agg(F.count(F.lit(1)).alias("b")), F.lit(True)).join(m, F.lit(True))
    return one.select("a", "b", "matched", F.try_divide(F.col("matched").cast("double"), F.col("b")).alias("match_rate"), F.try_divide(F.col("same").cast("double"), F.col("matched")).alias("code_agreement"), (F.col("a") + F.col("b") - F.col("matched")).alias("workload"))
