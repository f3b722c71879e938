"""Problem 1: a consensus from several annotators' labels.

Method: minimax conditional entropy. The probability that annotator j labels item i of
true class c with k is exp(s_j[r] + t_i[r]) / Z, r = relation(c, k): same, kin, other,
from and to the null class. Annotator and item tilts are tied by that relation, so that
votes for several wrong codes are as cheap to explain as equally many for one. Both are
fitted by regularised dual coordinate ascent, alternating with the posteriors of the
labels: item tilts coordinate by coordinate within a pass (each pass solves them anew, their
penalised dual has one maximum), annotator tilts by coordinate sweeps over the dual's
second-order model, whose objective every pass reports and must not lower. Agreement is
reported separately (Krippendorff's alpha).

Reviews have two parts, which are two consensus problems (:class:`Reviews`): a reviewer who wrongly keeps an
item still codes it by its content, so that equal codes say nothing about the decision.

Scale: an item's labels are one row; item tilts and posteriors are local to it, and a
pass only sends sums per annotator and relation. The driver holds a few dozen numbers for
each annotator and class, whatever the number of items; nothing is refused or left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.tables import materialize

#: Relations: null->null, null->class, class->null, class->same, class->kin, class->other.
RELATIONS = 6
ITERATIONS = 25
ITEM_ROUNDS = 4
#: Weights of the quadratic penalties on annotator and item tilts.
LAMBDA_ANNOTATOR, LAMBDA_ITEM = 0.5, 4.0
CELLS = 4_000_000
#: Marks of a label whose class is not known, and of the candidate that stands for all classes no one named.
UNKNOWN, UNSEEN = -1, -2
#: Label of a vote for a class that is not named (the item is no null item).
SOME_CLASS = "\x00"


def relation(true: np.ndarray, label: np.ndarray, kin: np.ndarray) -> np.ndarray:
    """Relation of each pair; class 0 is the null class (no code: the item is excluded)."""
    same_kin = (kin[np.maximum(true, 0)] == kin[np.maximum(label, 0)]) & (true != UNSEEN)
    return np.where(true == 0, np.where(label == 0, 0, 1), np.where(label == 0, 2, np.where(true == label, 3, np.where(same_kin, 4, 5))))


class Model:
    """Scores batches of items given the annotators' tilts."""

    def __init__(self, tilts: np.ndarray, prior: np.ndarray, kin: np.ndarray, votes_only: bool = False):
        self.tilts, self.kin, self.votes_only = tilts, kin, votes_only  # tilts: annotators x relations
        self.prior = prior
        self.coded = max(len(kin) - 1, 0)
        self.kin_size = np.bincount(kin[1:], minlength=int(kin.max()) + 1)[kin].astype(float) if self.coded else np.ones(len(kin))

    def sizes(self, true: np.ndarray) -> np.ndarray:
        """Labels in each relation to a true class."""
        own = np.where(true > 0, self.kin_size[np.maximum(true, 0)], self.kin_size[1:].mean() if self.coded else 1.0)
        zero, one = np.zeros(true.shape), np.ones(true.shape)
        null = true == 0
        return np.stack([np.where(null, 1, zero), np.where(null, self.coded, zero), np.where(null, zero, one), np.where(null, zero, one), np.where(null, zero, own - 1), np.where(null, zero, np.maximum(self.coded - own, 0))], -1)

    def score(self, who: np.ndarray, label: np.ndarray) -> dict:
        """Posterior over candidate classes of items with equally many labels, item tilts, and the sums of their annotators.

        Candidates are the null class, every class named on the item and, as one, all classes no one named.
        """
        n, k = label.shape
        seen = np.sort(label, axis=1)
        seen[:, 1:][seen[:, 1:] == seen[:, :-1]] = 0
        true = np.concatenate([np.zeros((n, 1), int), np.maximum(seen, 0), np.full((n, 1), UNSEEN)], axis=1)
        ok = np.concatenate([np.ones((n, 1), bool), seen > 0, np.ones((n, 1), bool)], axis=1)
        named = np.where(ok[:, 1:-1], self.prior[true[:, 1:-1]], 0.0)
        rest = np.maximum(1 - self.prior[0] - named.sum(1), 1e-12)
        log_prior = np.log(np.maximum(np.concatenate([np.full((n, 1), self.prior[0]), named, rest[:, None]], axis=1), 1e-300))
        rel = relation(true[:, :, None], label[:, None, :], self.kin)  # items, candidates, labels
        sizes = self.sizes(true)
        told = (label != UNKNOWN)[:, None, :]
        s = self.tilts[who]  # items, labels, relations
        tilt = np.zeros((n, RELATIONS))
        hits = [(rel == r) & told for r in range(RELATIONS)]
        to_null = np.where(true == 0, 0, 2)[:, :, None]
        at = np.arange(n)[:, None, None], np.arange(k)[None, None, :]
        for step in range(ITEM_ROUNDS + 1):
            e = np.exp(s + tilt[:, None, :])
            z = np.einsum("nmr,nkr->nmk", sizes, e)
            log_p = np.where(told, np.log(e)[at[0], at[1], rel] - np.log(z), np.log(np.maximum(1 - e[at[0], at[1], to_null] / z, 1e-12)))
            if self.votes_only:  # plain shares of the votes
                votes = np.where(ok, ((true[:, :, None] == label[:, None, :]) & told).sum(2) + 1e-3, 0)
                post, fit = votes / votes.sum(1, keepdims=True), np.zeros(n)
                break
            total = np.where(ok, log_prior + log_p.sum(2), -np.inf)
            top = total.max(1, keepdims=True)
            weight = np.exp(total - top)
            post, fit = weight / weight.sum(1, keepdims=True), top[:, 0] + np.log(weight.sum(1)) - LAMBDA_ITEM / 2 * (tilt**2).sum(1)
            if step == ITEM_ROUNDS:
                break
            q = post[:, :, None] * told
            for r in range(RELATIONS):  # one coordinate of every item's dual at a time
                p = sizes[:, :, None, r] * e[:, None, :, r] / z
                slope = (q * (hits[r] - p)).sum((1, 2)) - LAMBDA_ITEM * tilt[:, r]
                move = np.clip(slope / ((q * p * (1 - p)).sum((1, 2)) + LAMBDA_ITEM), -1, 1)
                tilt[:, r] += move
                new = e[:, :, r] * np.exp(move)[:, None]
                z = z + sizes[:, :, None, r] * (new - e[:, :, r])[:, None, :]
                e[:, :, r] = new
        q = post[:, :, None] * told
        p = sizes[:, :, None, :] * e[:, None, :, :] / z[..., None]
        expected = np.einsum("nmk,nmkr->nkr", q, p)
        grad = np.stack([(q * h).sum(1) for h in hits], -1)
        if not self.votes_only:
            grad = grad - expected
        curve = -np.einsum("nmk,nmkr,nmks->nkrs", q, p, p)
        curve[..., np.arange(RELATIONS), np.arange(RELATIONS)] += expected
        names, inverse = np.unique(who.ravel(), return_inverse=True)
        sums = np.zeros((len(names), RELATIONS + RELATIONS**2))
        np.add.at(sums, inverse, np.concatenate([grad.reshape(n * k, -1), curve.reshape(n * k, -1)], axis=1))
        return {"true": true, "post": post, "who": names, "sums": sums, "fit": float(fit.sum()), "ok": ok}


def _same_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of equally many labels, in chunks of bounded size: row numbers, annotators, labels."""
    who, label = batch.column("who"), batch.column("label")
    n = np.diff(who.offsets.to_numpy())
    starts = np.r_[0, np.cumsum(n)[:-1]]
    flat_who, flat_label = who.flatten().to_numpy(), label.flatten().to_numpy()
    for k in np.unique(n).tolist():
        if not k:
            continue
        rows = np.flatnonzero(n == k)
        step = max(1, CELLS // (k * (k + 2) * RELATIONS))
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            index = starts[part][:, None] + np.arange(k)[None, :]
            yield part, flat_who[index].astype(int), flat_label[index].astype(int)


class Consensus:
    """Consensus over ``labels``: item, annotator, label (the null class is the empty string), one row per annotator and item.

    A label of ``SOME_CLASS`` is a vote for a class that is not named: it counts against the null class and
    for no class in particular. Rows with a null in any of the three are left out; of several rows of an annotator
    for an item the greatest label counts. Classes are the labels seen; ``kin_of`` gives the family of a label.
    Where no label is the null class, no item is taken for one. ``result`` has one row per item that has a label; ties go to the class first in label order. ``objective``
    lists the penalised dual after each pass.
    """

    def __init__(self, labels: DataFrame, kin_of=lambda label: label.split(".", 1)[0]):
        clean = labels.select(F.col("item"), F.col("annotator"), F.col("label")).na.drop()
        clean = clean.groupBy("item", "annotator").agg(F.max("label").alias("label"))
        clean = materialize(clean, "labels")
        self.annotators = [r[0] for r in clean.select("annotator").distinct().orderBy("annotator").collect()]
        self.classes = [""] + [r[0] for r in clean.where(~F.col("label").isin("", SOME_CLASS)).select("label").distinct().orderBy("label").collect()]
        kin_names = {k: i for i, k in enumerate(dict.fromkeys(kin_of(c) for c in self.classes))}
        self.kin = np.array([kin_names[kin_of(c)] for c in self.classes])
        spark = labels.sparkSession
        names = lambda values, col, num: spark.createDataFrame(values, f"{col} string, {num} int")
        self.labels, self.null = clean, bool(clean.where("label = ''").limit(1).count())
        self.objective: list[float] = []
        if not self.annotators:
            self.items = None
            return
        numbers = [(v, i) for i, v in enumerate(self.classes)] + [(SOME_CLASS, UNKNOWN)]
        numbered = clean.join(names([(v, i) for i, v in enumerate(self.annotators)], "annotator", "w"), "annotator").join(names(numbers, "label", "l"), "label")
        # one partition per slot of the shuffle: rows are few bytes but cost much Python time
        spread = numbered.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "item")
        packed = spread.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("w", "l"))).alias("x"))
        self.items = materialize(packed.select("item", F.expr("x.w").alias("who"), F.expr("x.l").alias("label")), "items")
        self._fit()

    def _fit(self) -> None:
        a, c = len(self.annotators), len(self.classes)
        null = 0.5 if self.null else 0.0
        prior = np.r_[null, np.full(c - 1, (1 - null) / max(c - 1, 1))] if c > 1 else np.ones(1)
        # start and centre of the penalty: how often all annotators together show each relation to the votes' majority
        _, sums, mass = self._pass(np.zeros((a, RELATIONS)), prior, votes_only=True)
        pooled = sums[:, :RELATIONS].sum(0) + 1.0
        rate = np.r_[pooled[:2] / pooled[:2].sum(), pooled[2:] / pooled[2:].sum()]
        sizes = Model(np.zeros((1, RELATIONS)), prior, self.kin).sizes(np.array([0, UNSEEN]))
        centre = np.log(rate / np.maximum(np.r_[sizes[0, :2], sizes[1, 2:]], 1.0))
        self.start = centre
        tilts, prior = np.tile(centre, (a, 1)), self._prior(mass)
        last, kept = -np.inf, tilts
        for _ in range(ITERATIONS):
            fit, sums, mass = self._pass(tilts, prior)
            fit -= LAMBDA_ANNOTATOR / 2 * ((tilts - centre) ** 2).sum()
            if fit < last - 1e-9 * abs(last):  # the step went too far: half of it
                tilts = kept + (tilts - kept) / 2
                if np.abs(tilts - kept).max() < 1e-4:
                    break
                continue
            self.objective.append(fit)
            slope = sums[:, :RELATIONS] - LAMBDA_ANNOTATOR * (tilts - centre)
            curve = sums[:, RELATIONS:].reshape(a, RELATIONS, RELATIONS)
            move = np.zeros((a, RELATIONS))
            for _ in range(20):  # coordinate sweeps; annotators do not meet in the dual
                for r in range(RELATIONS):
                    others = (curve[:, r] * move).sum(1) - curve[:, r, r] * move[:, r]
                    move[:, r] = np.clip((slope[:, r] - others) / (curve[:, r, r] + LAMBDA_ANNOTATOR), -1, 1)
            done = fit - last < 1e-6 * abs(fit) or np.abs(move).max() < 0.005
            last, kept = fit, tilts
            prior = self._prior(mass)
            if done:
                break
            tilts = tilts + move
        self.tilts, self.prior = kept, prior

    def _prior(self, mass: np.ndarray) -> np.ndarray:
        """Class shares from posterior mass (the last entry is that of classes no one named)."""
        null = (mass[0] + 1.0) / (mass.sum() + 2.0) if self.null else 0.0
        named = mass[1:-1] + 1.0
        return np.r_[null, (1 - null) * named / named.sum()] if len(named) else np.ones(1)

    def _pass(self, tilts: np.ndarray, prior: np.ndarray, votes_only: bool = False) -> tuple[float, np.ndarray, np.ndarray]:
        kin, a, c, width = self.kin, len(self.annotators), len(self.classes), RELATIONS + RELATIONS**2

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = Model(tilts, prior, kin, votes_only)
            sums, mass, fit = {}, np.zeros(c + 1), 0.0
            for batch in batches:
                for _, who, label in _same_length(batch):
                    x = model.score(who, label)
                    for j, row in zip(x["who"].tolist(), x["sums"]):
                        sums[j] = sums[j] + row if j in sums else row
                    np.add.at(mass, np.where(x["true"] == UNSEEN, c, x["true"])[x["ok"]], x["post"][x["ok"]])
                    fit += x["fit"]
            at = np.concatenate([np.array([j], np.int64) * width + np.arange(width) for j in sums] + [a * width + np.arange(c + 2)])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.concatenate([*sums.values(), mass, [fit]]))], names=["at", "v"])

        rows = self.items.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v")).collect()
        flat = np.zeros(a * width + c + 2)
        for at, v in rows:
            flat[at] = v
        return float(flat[-1]), flat[: a * width].reshape(a, width), flat[a * width : -1]

    def result(self) -> DataFrame:
        """item, keep (the null class is less likely than all others together), label (null where no class is named), p_keep, p_label."""
        spark, schema = self.labels.sparkSession, "item string, keep boolean, label string, p_keep double, p_label double"
        if self.items is None:
            return spark.createDataFrame([], schema)
        tilts, prior, kin, classes = self.tilts, self.prior, self.kin, self.classes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = Model(tilts, prior, kin)
            for batch in batches:
                for rows, who, label in _same_length(batch):
                    x = model.score(who, label)
                    true, post = x["true"], x["post"]
                    coded = np.where(true > 0, post, -1.0)
                    best = coded.argmax(1)
                    at = np.arange(len(rows))
                    p_keep = 1 - post[:, 0]
                    has = true[at, best] > 0
                    p_label = np.where(has, coded[at, best] / np.maximum(p_keep, 1e-300), 0.0)
                    names = [classes[t] if h else None for t, h in zip(true[at, best].tolist(), has.tolist())]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(p_keep > 0.5), pa.array(names, pa.string()), pa.array(p_keep), pa.array(p_label)], names=["item", "keep", "label", "p_keep", "p_label"])

        return self.items.mapInArrow(run, schema)

    def reliability(self) -> DataFrame:
        """annotator, n_labels, p_null_right, p_keep_right, p_label_right: chances given by the fitted tilts, averaged over the class prior."""
        spark, schema = self.labels.sparkSession, "annotator string, p_null_right double, p_keep_right double, p_label_right double"
        rows = []
        if self.items is not None:
            sizes = Model(self.tilts, self.prior, self.kin).sizes(np.arange(len(self.classes)))
            w = self.prior[1:] / max(self.prior[1:].sum(), 1e-300)
            for name, e in zip(self.annotators, np.exp(self.tilts)):
                z = sizes @ e
                keep, right = 1 - e[2] / z[1:], e[3] / z[1:]
                rows.append((name, float(e[0] / z[0]), float((w * keep).sum()) if len(w) else None, float((w * right).sum()) if len(w) else None))
        counts = self.labels.groupBy("annotator").agg(F.count(F.lit(1)).alias("n_labels"))
        return counts.join(spark.createDataFrame(rows, schema), "annotator")


class Reviews:
    """Decisions and codes of reviewed items: ``reviews`` has item, annotator, decision (keep or exclude) and code, one row per annotator and item.

    A keep without a code counts for the decision only; nulls in item, annotator or decision are left out.
    """

    def __init__(self, reviews: DataFrame):
        kept = F.col("decision") == "keep"
        self.decisions = Consensus(reviews.select("item", "annotator", F.when(kept, "keep").when(F.col("decision") == "exclude", "").alias("label")))
        self.codes = Consensus(reviews.where(kept & (F.col("code") != "")).select("item", "annotator", F.col("code").alias("label")))

    def result(self) -> DataFrame:
        """item, keep, label (the likeliest code anyone gave it; null if no one did), p_keep, p_label."""
        codes = self.codes.result().select("item", "label", "p_label")
        return self.decisions.result().select("item", "keep", "p_keep").join(codes, "item", "left").select("item", "keep", "label", "p_keep", "p_label")

    def reliability(self) -> DataFrame:
        """annotator, n_labels, p_null_right and p_keep_right (decisions on excluded and on kept items), n_codes and p_label_right (codes)."""
        decided = self.decisions.reliability().select("annotator", "n_labels", "p_null_right", "p_keep_right")
        coded = self.codes.reliability().select("annotator", F.col("n_labels").alias("n_codes"), "p_label_right")
        return decided.join(coded, "annotator", "left").select("annotator", "n_labels", "p_null_right", "p_keep_right", F.coalesce("n_codes", F.lit(0)).alias("n_codes"), "p_label_right")


def krippendorff(labels: DataFrame, groups: list[str], item: str, label: str) -> DataFrame:
    """Nominal alpha per group from items with two labels or more: n_items, n_labels, observed and expected disagreement, alpha (null where no disagreement is possible)."""
    per = labels.na.drop(subset=[item, label]).groupBy(*groups, item, label).agg(F.count(F.lit(1)).alias("n"))
    m = F.sum("n").over(Window.partitionBy(*groups, item))
    per = per.withColumn("m", m).where("m > 1")
    items = per.groupBy(*groups, item).agg(F.max("m").alias("m"), F.sum(F.col("n") * (F.col("m") - F.col("n"))).alias("unlike"))
    seen = items.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_items"), F.sum("m").alias("n_labels"), F.sum(F.col("unlike") / (F.col("m") - 1)).alias("unlike"))
    totals = per.groupBy(*groups, label).agg(F.sum("n").alias("n")).groupBy(*groups).agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"), F.sum("n").alias("all"))
    both = seen.join(totals, groups)
    observed = F.col("unlike") / F.col("n_labels")
    expected = F.try_divide(F.col("all").cast("double") * F.col("all") - F.col("squares"), F.col("all").cast("double") * (F.col("all") - 1))
    return both.select(*groups, "n_items", F.col("n_labels").cast("long").alias("n_labels"), observed.alias("observed"), expected.alias("expected"), (1 - F.try_divide(observed, expected)).alias("alpha"))


def decision(c: Column) -> Column:
    """keep or exclude, read without regard to case and outer blanks; anything else is null."""
    d = F.lower(F.trim(c))
    return F.when(d.isin("keep", "exclude"), d)


def all_reviews(reviewed: DataFrame, labels: DataFrame, reviewers: tuple[str, ...] = ("martin", "dominik")) -> DataFrame:
    """item, annotator, decision, code: of one reviewer's rows for a candidate the latest stands (ties: the greater decision, then code)."""
    sides = [F.struct(F.lit(r).alias("annotator"), decision(F.col(f"inclusion_decision_{r}")).alias("decision"), F.trim(f"final_code1_{r}").alias("code")) for r in reviewers]
    wide = reviewed.select(F.col("candidate_id").alias("item"), F.explode(F.array(*sides)).alias("s")).select("item", "s.*", F.lit(None).cast("timestamp_ntz").alias("at"))
    long_ = labels.select(F.col("candidate_id").alias("item"), F.lower(F.trim("reviewer")).alias("annotator"), decision(F.col("inclusion_decision")).alias("decision"), F.trim("final_code1").alias("code"), F.col("reviewed_at").cast("timestamp_ntz").alias("at"))
    rows = wide.unionByName(long_).where("item is not null and annotator is not null and decision is not null")
    early = F.coalesce("at", F.lit("0001-01-01").cast("timestamp_ntz"))
    last = rows.groupBy("item", "annotator").agg(F.max(F.struct(early.alias("at"), "decision", F.coalesce("code", F.lit("")).alias("code"))).alias("x"))
    return last.select("item", "annotator", F.col("x.decision").alias("decision"), F.nullif(F.col("x.code"), F.lit("")).alias("code"))
