"""Evaluation of binary predictions.

Everything works on the score table: one row per distinct score with its positives and negatives. Curves need running
counts over scores; those come from a bucketed scan, so no task orders all scores.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.scan import double_levels, ordered_scan
from ..session import stage

# Fixed value: probabilities are kept this far from 0 and 1 before taking the logit.
LOGIT_MARGIN = 1e-7
# Fixed value: beyond every octave of double_levels, for scores that are no numbers.
OUTSIDE = 10_000


def score_table(predictions: DataFrame, unlabelled: bool = True) -> DataFrame:
    """``p, pos, neg, n`` per distinct score from rows ``p, y``, written once: every metric reads it.

    A null label counts as negative, without ``unlabelled`` in ``n`` alone.
    """
    negative = F.when(F.col("y") == 1, 0).otherwise(1) if unlabelled else F.when(F.col("y") != 1, 1).otherwise(0)
    counts = predictions.groupBy("p").agg(
        F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("pos"),
        F.sum(negative).alias("neg"),
        F.count(F.lit(1)).alias("n"),
    )
    return stage(counts, "scores")


def cumulated(scores: DataFrame) -> DataFrame:
    """Adds ``tp, fp``: positives and negatives at or above each score."""
    down = -F.col("p")
    return ordered_scan(scores, [], double_levels(down), [down], sums={"tp": F.col("pos"), "fp": F.col("neg")})


def cumulated_over_all(scores: DataFrame) -> DataFrame:
    """As :func:`cumulated`, with NaN above all scores and null below, and with null where there is no label at or above the score."""
    side = F.when(F.col("p").isNull(), 1).when(F.isnan("p"), -1).otherwise(0)
    down = F.when(side == 0, -F.col("p")).otherwise(F.lit(0.0))
    octave, part = double_levels(down)
    levels = [F.when(side == 0, octave).otherwise(side * OUTSIDE), part]
    out = ordered_scan(scores, [], levels, [side, down], sums={"tp": F.col("pos"), "fp": F.col("neg")})
    seen = F.col("tp") + F.col("fp") > 0
    return out.withColumns({"tp": F.when(seen, F.col("tp")), "fp": F.when(seen, F.col("fp"))})


def _totals(scores: DataFrame) -> tuple[int, int]:
    row = scores.agg(F.sum("pos"), F.sum("neg")).first()
    return int(row[0] or 0), int(row[1] or 0)


# ---- discrimination --------------------------------------------------------------------------------------------


def roc_auc(scores: DataFrame) -> DataFrame:
    """One row ``auroc``; a tie counts one half. Null with a single class and without scores."""
    above = F.col("tp") - F.col("pos") / 2
    area = F.try_divide(F.sum(F.col("neg") * above), F.sum("pos").cast("double") * F.sum("neg").cast("double"))
    return cumulated(scores).agg(area.alias("auroc"))


def average_precision(scores: DataFrame) -> DataFrame:
    """One row ``auprc``: precision at each score weighted by the recall it adds. Null without positives."""
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    return cumulated(scores).agg(F.try_divide(F.sum(F.col("pos") * precision), F.sum("pos")).alias("auprc"))


def pr_auc(scores: DataFrame) -> DataFrame:
    """One row ``pr_auc``: trapezoids under the precision-recall curve, which starts at recall 0, precision 1. Null without positives."""
    before = F.col("tp") - F.col("pos") + F.col("fp") - F.col("neg")
    earlier = F.when(before > 0, (F.col("tp") - F.col("pos")) / before).otherwise(F.lit(1.0))
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    area = F.try_divide(F.sum(F.col("pos") * (precision + earlier) / 2), F.sum("pos"))
    return cumulated(scores).agg(area.alias("pr_auc"))


def prevalence(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.sum("n").alias("n"),
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
        (F.sum("pos") / F.sum("n")).alias("prevalence"),
    )


def roc_points(scores: DataFrame) -> DataFrame:
    """``threshold, fpr, tpr`` at every distinct score, and the curve's start: nothing is positive at an infinite threshold."""
    n_pos, n_neg = _totals(scores)
    points = cumulated_over_all(scores).select(
        F.col("p").alias("threshold"),
        F.try_divide(F.col("fp"), F.lit(n_neg)).alias("fpr"),
        F.try_divide(F.col("tp"), F.lit(n_pos)).alias("tpr"),
        "tp",
        "fp",
    )
    start = [(float("inf"), 0.0, 0.0, 0, 0)]
    return points.union(points.sparkSession.createDataFrame(start, "threshold double, fpr double, tpr double, tp long, fp long"))


def pr_points(scores: DataFrame) -> DataFrame:
    """``threshold, recall, precision`` at every distinct score, and the curve's end: recall 0 with precision 1 at no threshold."""
    n_pos, _ = _totals(scores)
    points = cumulated(scores).select(
        F.col("p").alias("threshold"),
        F.try_divide(F.col("tp"), F.lit(n_pos)).alias("recall"),
        (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
    )
    end = [(None, 0.0, 1.0)]
    return points.union(points.sparkSession.createDataFrame(end, "threshold double, recall double, precision double"))


# ---- thresholds ------------------------------------------------------------------------------------------------

THRESHOLD_METHODS = ("youden", "high_sensitivity", "best_f1")


def select_threshold(scores: DataFrame, method: str = "youden", target_sensitivity: float = 0.9) -> DataFrame:
    """One row ``threshold``.

    ``youden``: largest TPR - FPR, the highest threshold on ties (infinite when nothing beats chance).
    ``high_sensitivity``: the highest threshold whose TPR reaches the target, else the Youden point.
    ``best_f1``: largest F1, the lowest threshold on ties.
    """
    if method not in THRESHOLD_METHODS:
        raise ValueError(f"unknown threshold method {method!r}; one of {THRESHOLD_METHODS}")
    if method == "best_f1":
        points = pr_points(scores)
        f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))
        best = F.max(F.struct(F.round(f1, 12).alias("f"), (-F.col("threshold")).alias("t")))
        return points.filter(F.col("precision") + F.col("recall") > 0).agg((-best["t"]).alias("threshold"))
    points = roc_points(scores)
    best = F.max(F.struct(F.round(F.col("tpr") - F.col("fpr"), 12).alias("j"), F.col("threshold").alias("t")))
    youden = F.when(best["j"] > 0, best["t"]).otherwise(F.lit(float("inf")))
    if method == "youden":
        return points.agg(youden.alias("threshold"))
    reached = F.max(F.when(F.col("tpr") >= target_sensitivity, F.col("threshold")))
    return points.agg(F.coalesce(reached, youden).alias("threshold"))


def threshold_metrics(scores: DataFrame, threshold: float, strict: bool = False) -> DataFrame:
    """Confusion counts and rates at a threshold (scores at it count as positive unless ``strict``); 0/0 is NULL."""
    hit = F.col("p") > threshold if strict else F.col("p") >= threshold
    out = scores.agg(
        *[
            F.coalesce(F.sum(F.when(test, F.col(c))), F.lit(0)).alias(name)
            for name, test, c in (("tp", hit, "pos"), ("fp", hit, "neg"), ("tn", ~hit, "neg"), ("fn", ~hit, "pos"))
        ]
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    out = out.withColumns(
        {
            "threshold": F.lit(float(threshold)),
            "sensitivity": F.try_divide(tp, tp + fn),
            "specificity": F.try_divide(tn, tn + fp),
            "ppv": F.try_divide(tp, tp + fp),
            "npv": F.try_divide(tn, tn + fn),
            "accuracy": F.try_divide(tp + tn, tp + fp + tn + fn),
        }
    )
    return out.withColumn(
        "f1", F.try_divide(2 * F.col("ppv") * F.col("sensitivity"), F.col("ppv") + F.col("sensitivity"))
    )


# ---- calibration -----------------------------------------------------------------------------------------------


def brier(scores: DataFrame) -> DataFrame:
    p = F.col("p")
    loss = F.try_divide(F.sum(F.col("pos") * (1 - p) * (1 - p) + F.col("neg") * p * p), F.sum("n"))
    return scores.agg(loss.alias("brier"))


def reliability(scores: DataFrame, bins: int = 10, strategy: str = "quantile") -> DataFrame:
    """``bin, mean_p, observed, n`` for each non-empty bin; edges are score quantiles or equally spaced."""
    if strategy == "quantile":
        row = exact_quantiles(scores, [], "p", [i / bins for i in range(bins + 1)], weight="n").first()
        edges = sorted({row[f"q{i}"] for i in range(bins + 1)} - {None}) if row else []
    else:
        edges = [i / bins for i in range(bins + 1)]
    inner = edges[1:-1]
    at = F.lit(0)
    for edge in inner:
        at = at + (F.col("p") >= edge).cast("int")
    at = F.least(at, F.lit(max(len(edges) - 2, 0)))
    return (
        scores.groupBy(at.alias("bin"))
        .agg(F.sum(F.col("p") * F.col("n")).alias("sp"), F.sum("pos").alias("pos"), F.sum("n").alias("n"))
        .select("bin", (F.col("sp") / F.col("n")).alias("mean_p"), (F.col("pos") / F.col("n")).alias("observed"), "n")
    )


def calibration_error(curve: DataFrame) -> DataFrame:
    """One row ``ece`` from a reliability table."""
    gap = F.try_divide(F.sum(F.col("n") * F.abs(F.col("observed") - F.col("mean_p"))), F.sum("n"))
    return curve.agg(gap.alias("ece"))


def calibration_fit(scores: DataFrame, iters: int = 50, tolerance: float = 1e-8) -> tuple[float, float]:
    """Slope and intercept of a logistic fit of the outcome on logit(p); NaN with a single class.

    Newton steps; each is one aggregation of the score table to five sums.
    """
    n_pos, n_neg = _totals(scores)
    if n_pos == 0 or n_neg == 0:
        return float("nan"), float("nan")
    p = F.greatest(F.lit(LOGIT_MARGIN), F.least(F.lit(1 - LOGIT_MARGIN), F.col("p")))
    table = stage(scores.select(F.log(p / (1 - p)).alias("x"), "pos", "n"), "logits")
    a, b = 0.0, 0.0
    for _ in range(iters):
        x = F.col("x")
        mu = 1 / (1 + F.exp(-(F.lit(a) + F.lit(b) * x)))
        w, r = F.col("n") * mu * (1 - mu), F.col("pos") - F.col("n") * mu
        g0, g1, h0, h1, h2 = table.agg(
            F.sum(r), F.sum(r * x), F.sum(w), F.sum(w * x), F.sum(w * x * x)
        ).first()
        det = h0 * h2 - h1 * h1
        if not det > 0:
            break
        da, db = (h2 * g0 - h1 * g1) / det, (h0 * g1 - h1 * g0) / det
        a, b = a + da, b + db
        if max(abs(da), abs(db)) < tolerance:
            break
    return b, a


# ---- bootstrap -------------------------------------------------------------------------------------------------

_AREA = "part long, wp array<double>, wn array<double>, area array<double>, loss array<double>"
_PRECISION = "part long, gain array<double>"
_BLOCK = 4096


def _draw(pdf: pd.DataFrame, n: int, seed: int, part: int):
    """Blocks of resampled counts of a part's scores, best first: (positives, negatives) of shape (rows, n)."""
    pdf = pdf.sort_values("p", ascending=False)
    pos, neg = pdf["pos"].to_numpy(float), pdf["neg"].to_numpy(float)
    rng = np.random.default_rng([seed, part])
    rows = max(1, _BLOCK * 256 // max(n, 1))
    for i in range(0, len(pos), rows):
        yield rng.poisson(pos[i : i + rows, None], (len(pos[i : i + rows]), n)).astype(float), rng.poisson(
            neg[i : i + rows, None], (len(neg[i : i + rows]), n)
        ).astype(float)


def bootstrap_samples(scores: DataFrame, n: int = 2000, seed: int = 42, parts_per_octave: int = 64) -> DataFrame:
    """``replicate, auroc, auprc, brier`` for ``n`` resamples of the predictions.

    A resample gives every prediction a Poisson(1) count, so a distinct score with k positives gets Poisson(k) of them. Scores
    are cut into parts by value. A part reports, for every replicate, its weights and the pairs it orders correctly;
    parts are then combined from the highest scores down, and a second pass adds up precision using the
    weights above each part. Draws are seeded by part, so both passes and any retry see the same ones.
    """
    levels = double_levels(F.col("p"))
    within = F.greatest(F.least(levels[1] - 4096, F.lit(4095)), F.lit(0))
    part = levels[0].cast("long") * parts_per_octave + F.floor(within * parts_per_octave / 4096)
    parted = stage(scores.select(part.alias("part"), "p", "pos", "neg"), "bootstrap-scores")

    def area(pdf: pd.DataFrame) -> pd.DataFrame:
        key = int(pdf["part"].iloc[0])
        wp, wn, ordered, loss, at = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n), 0
        score = np.sort(pdf["p"].to_numpy(float))[::-1, None]
        for p, q in _draw(pdf, n, seed, key):
            here, at = score[at : at + len(p)], at + len(p)
            loss += (p * (1 - here) ** 2 + q * here**2).sum(axis=0)
            above = wp + np.cumsum(p, axis=0)
            ordered += (q * (above - p / 2)).sum(axis=0)
            wp, wn = wp + p.sum(axis=0), wn + q.sum(axis=0)
        return pd.DataFrame({"part": [key], "wp": [wp], "wn": [wn], "area": [ordered], "loss": [loss]})

    areas = stage(parted.groupBy("part").applyInPandas(area, _AREA), "bootstrap-areas")
    long = areas.select("part", F.posexplode(F.arrays_zip("wp", "wn", "area", "loss")).alias("replicate", "w")).select("part", "replicate", "w.*")
    # per replicate there is one row per part, and parts are bounded by the range of doubles
    down = [-F.col("part")]
    long = ordered_scan(long, ["replicate"], [], down, sums={"tp": F.col("wp"), "fp": F.col("wn")})
    above = long.withColumns({"tp": F.col("tp") - F.col("wp"), "fp": F.col("fp") - F.col("wn")})
    by_replicate = F.array_sort(F.collect_list(F.struct("replicate", "tp", "fp")))
    starts = above.groupBy("part").agg(by_replicate.alias("s")).select(
        "part", F.transform("s", lambda r: r["tp"]).alias("tp"), F.transform("s", lambda r: r["fp"]).alias("fp")
    )

    def precision(pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or start.empty:
            return pd.DataFrame({"part": [], "gain": []})
        key = int(pdf["part"].iloc[0])
        tp, fp = np.array(start["tp"].iloc[0], float), np.array(start["fp"].iloc[0], float)
        gain = np.zeros(n)
        for p, q in _draw(pdf, n, seed, key):
            t, f = tp + np.cumsum(p, axis=0), fp + np.cumsum(q, axis=0)
            gain += np.divide(p * t, t + f, out=np.zeros_like(t), where=t + f > 0).sum(axis=0)
            tp, fp = tp + p.sum(axis=0), fp + q.sum(axis=0)
        return pd.DataFrame({"part": [key], "gain": [gain]})

    gains = parted.groupBy("part").cogroup(starts.groupBy("part")).applyInPandas(precision, _PRECISION)
    gains = (
        gains.select(F.posexplode("gain").alias("replicate", "gain"))
        .groupBy("replicate")
        .agg(F.sum("gain").alias("gain"))
    )
    totals = above.groupBy("replicate").agg(
        F.sum("wp").alias("wp"),
        F.sum("wn").alias("wn"),
        F.sum(F.col("area") + F.col("wn") * F.col("tp")).alias("area"),
        F.sum("loss").alias("loss"),
    )
    both = totals.filter("wp > 0 AND wn > 0").join(gains, "replicate")  # single-class resamples are left out
    return both.select(
        "replicate",
        (F.col("area") / (F.col("wp") * F.col("wn"))).alias("auroc"),
        (F.col("gain") / F.col("wp")).alias("auprc"),
        (F.col("loss") / (F.col("wp") + F.col("wn"))).alias("brier"),
    )


def bootstrap(scores: DataFrame, n: int = 2000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """``metric, value, lo, hi``: percentile intervals; the table of replicates has ``n`` rows.

    Resamples with a single class are left out. Where there is one class only, or no scores at all, what is undefined is null.
    """
    samples = stage(bootstrap_samples(scores, n, seed), "bootstrap-samples")
    out = None
    for metric, point in (("auroc", roc_auc(scores)), ("auprc", average_precision(scores)), ("brier", brier(scores))):
        value = point.first()[0]
        ends = F.percentile(metric, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
        row = samples.agg(ends.alias("q")).select(
            F.lit(metric).alias("metric"),
            F.lit(value).cast("double").alias("value"),
            F.col("q")[0].alias("lo"),
            F.col("q")[1].alias("hi"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def rate_intervals(counts: dict[str, int], n: int = 2000, seed: int = 42, alpha: float = 0.05) -> dict[str, tuple[float, float]]:
    """Percentile intervals of sensitivity, specificity and PPV from the confusion counts ``tp, fp, tn, fn``.

    In a Poisson resample the four counts are Poisson draws with the counts as means, so nothing else is needed. Resamples in
    which a rate is undefined are left out; a rate that is never defined has no interval.
    """
    rng = np.random.default_rng(seed)
    tp, fp, tn, fn = (rng.poisson(counts[c], n).astype(float) for c in ("tp", "fp", "tn", "fn"))
    out = {}
    for name, part, rest in (("sensitivity", tp, fn), ("specificity", tn, fp), ("ppv", tp, fp)):
        known = part + rest > 0
        if known.any():
            lo, hi = np.quantile(part[known] / (part + rest)[known], [alpha / 2, 1 - alpha / 2])
            out[name] = (float(lo), float(hi))
    return out


# ---- reports ---------------------------------------------------------------------------------------------------


def perplexity(log_probs: DataFrame) -> DataFrame:
    """One row ``perplexity`` from ``log_p`` over rows whose ``label_id`` is not ignored."""
    return log_probs.filter(F.col("label_id") != -100).agg(F.exp(-F.avg("log_p")).alias("perplexity"))


def evaluate(test: DataFrame, val: DataFrame | None = None, n_resamples: int = 2000, seed: int = 42) -> DataFrame:
    """The whole report as rows ``section, metric, value, lo, hi``.

    Operating thresholds are chosen on ``val``; without it they come from the test scores, which is marked by
    ``thresholds_from_test`` = 1.
    """
    spark = test.sparkSession
    scores = score_table(test)
    chosen_on = scores if val is None else score_table(val)
    rows: list[tuple[str, str, float | None, float | None, float | None]] = []

    def add(section, metric, value, lo=None, hi=None):
        rows.append((section, metric, None if value is None else float(value), lo, hi))

    for r in bootstrap(scores, n_resamples, seed).collect():  # three rows
        add("calibration" if r["metric"] == "brier" else "discrimination", r["metric"], r["value"], r["lo"], r["hi"])
    add("discrimination", "pr_auc", pr_auc(scores).first()[0])
    for metric, value in prevalence(scores).first().asDict().items():
        add("discrimination", metric, value)
    add("thresholds", "thresholds_from_test", 1.0 if val is None else 0.0)
    points = {m: select_threshold(chosen_on, m).first()[0] for m in ("youden", "high_sensitivity")}
    for name, threshold in {**points, "fixed": 0.5}.items():
        found = threshold_metrics(scores, threshold).first().asDict()
        ends = rate_intervals(found, n_resamples, seed)
        for metric, value in found.items():
            add(name, metric, value, *ends.get(metric, (None, None)))
    curve = reliability(scores)
    add("calibration", "ece", calibration_error(curve).first()[0])
    for i, r in enumerate(curve.orderBy("bin").collect()):  # a row for each bin
        add("reliability", f"bin_{i}_predicted", r["mean_p"])
        add("reliability", f"bin_{i}_observed", r["observed"])
    slope, intercept = calibration_fit(scores)
    add("calibration", "slope", slope)
    add("calibration", "intercept", intercept)
    return spark.createDataFrame(rows, "section string, metric string, value double, lo double, hi double")
