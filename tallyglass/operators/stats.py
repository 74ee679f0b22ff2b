"""Statistics of evaluations as DataFrame aggregates: intervals, paired tests, agreement, ranking, calibration, resampling.

Inputs have one row an item (and rater or system); results are rounded to six decimals where they are not counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.session import importable

Z = 1.96


def r6(c: Column) -> Column:
    return F.round(c, 6)


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or null."""
    return F.when(b != 0, a.cast("double") / b).otherwise(F.lit(0.0))


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """Bounds of the Wilson score interval, clamped to [0, 1]; (0, 0) without items."""
    p = k / n
    den = 1 + z * z / n
    centre, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    bound = lambda x: F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), x / den))).otherwise(F.lit(0.0))
    return bound(centre - half), bound(centre + half)


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x >= 1: Stirling's series eight places up, where its fourth term is below 1e-11."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5)))
    below = x
    for k in range(1, 8):
        below = below * (x + k)
    return series - F.log(below)


def binomial_tail(k: Column, n: Column) -> Column:
    """P(X <= k) of n fair trials, for k up to n / 2.

    The term of k comes from log_gamma and each one below it from the one above; terms further than 7 standard widths below
    are too small to count, so the sum has at most 7 * sqrt(n) terms and nothing underflows.
    """
    k, n = k.cast("double"), n.cast("double")
    log_first = log_gamma(n + 1) - log_gamma(k + 1) - log_gamma(n - k + 1) - n * math.log(2)
    last = F.least(k, F.ceil(7 * F.sqrt(n)).cast("double")).cast("int")
    steps = F.when(last >= 1, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] * (k - i) / (n - k + i + 1)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    return F.exp(log_first) * F.aggregate(steps, start, step, lambda s: s["total"])


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p of b and c discordant pairs; 1 without any."""
    return F.when(b + c == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * binomial_tail(F.least(b, c), b + c)))


def two_sided(k: int, n: int) -> float:
    """Exact two-sided p of k successes in n fair trials: all outcomes that are no likelier."""
    k = min(k, n - k)
    if not n or 2 * k == n:
        return 1.0
    first = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) - n * math.log(2))
    term = total = 1.0
    for i in range(min(k, math.ceil(7 * math.sqrt(n)))):
        term *= (k - i) / (n - k + i + 1)
        total += term
    return min(1.0, 2 * first * total)


def mcnemar_full(b: int, c: int) -> dict[str, float]:
    """Exact p, chi-square with continuity correction and its p, odds ratio (infinite where only c is 0, 0 where b is)."""
    n = b + c
    chi2 = (abs(b - c) - 1) ** 2 / n if n else 0.0
    odds = b / c if c else math.inf if b else 0.0
    return {"p_exact": two_sided(min(b, c), n), "chi2": chi2, "p_chi2": math.erfc(math.sqrt(chi2 / 2)) if n else 1.0, "odds_ratio": odds}


def paired(results: DataFrame) -> DataFrame:
    """a, b, both, only_a, only_b, neither, net, p of each pair of systems over the items both have.

    results: system, item, correct. Items meet by an equi-join; the pairs are systems, not items.
    """
    x = results.select(F.col("system").alias("a"), "item", F.col("correct").alias("ca"))
    y = results.select(F.col("system").alias("b"), "item", F.col("correct").alias("cb"))
    count = lambda c: F.sum(c.cast("long"))
    pairs = x.join(y, "item").where("a < b").groupBy("a", "b").agg(
        count(F.col("ca") & F.col("cb")).alias("both"), count(F.col("ca") & ~F.col("cb")).alias("only_a"),
        count(~F.col("ca") & F.col("cb")).alias("only_b"), count(~F.col("ca") & ~F.col("cb")).alias("neither"),
    )
    return pairs.select("*", (F.col("only_b") - F.col("only_a")).alias("net"), r6(mcnemar(F.col("only_a"), F.col("only_b"))).alias("p"))


def holm(tests: DataFrame) -> DataFrame:
    """name, p, adjusted: step-down adjusted p values."""
    order = Window.orderBy("p", "name")
    ranked = tests.withColumn("i", F.row_number().over(order) - 1).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))))
    running = F.max((F.col("m") - F.col("i")) * F.col("p")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.select("name", "p", r6(F.least(F.lit(1.0), running)).alias("adjusted"))


def binary_confusion(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn and their rates from truth and pred (booleans); rates with nothing to divide by are 0."""
    t, p = F.col("truth"), F.col("pred")
    n = rows.groupBy(*by).agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn")
    )
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    precision, recall, specificity = ratio(tp, tp + fp), ratio(tp, tp + fn), ratio(tn, tn + fp)
    mcc = ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    rates = {
        "precision": precision, "recall": recall, "f1": ratio(2 * precision * recall, precision + recall), "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "specificity": specificity, "npv": ratio(tn, tn + fn), "balanced": (recall + specificity) / 2, "mcc": mcc,
    }
    return n.select(*by, "tp", "fp", "fn", "tn", *[r6(v).alias(k) for k, v in rates.items()])


def multiclass(rows: DataFrame) -> DataFrame:
    """macro_f1, weighted_f1, micro_f1, balanced from truth and pred labels."""
    cells = rows.groupBy("truth", "pred").agg(F.count(F.lit(1)).alias("n"))
    have = cells.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("have"))
    said = cells.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("said"))
    hits = cells.where("truth = pred").select(F.col("truth").alias("label"), F.col("n").alias("hit"))
    each = have.join(said, "label", "full").join(hits, "label", "left").fillna(0)
    p, r = ratio(F.col("hit"), F.col("said")), ratio(F.col("hit"), F.col("have"))
    each = each.withColumn("f1", ratio(2 * p * r, p + r)).withColumn("recall", r)
    return each.agg(
        r6(F.avg("f1")).alias("macro_f1"),
        r6(F.sum(F.col("f1") * F.col("have")) / F.sum("have")).alias("weighted_f1"),
        r6(F.sum("hit") / F.sum("have")).alias("micro_f1"),
        r6(F.avg(F.when(F.col("have") > 0, F.col("recall")))).alias("balanced"),
    )


def kappa(rows: DataFrame) -> DataFrame:
    """n, agreement, kappa, kappa_linear, kappa_quadratic, pabak, ac1 of two raters' labels x and y.

    Labels are weighted by their place in alphabetical order. pabak is 2 * agreement - 1; ac1 takes chance agreement as
    the sum of q * (1 - q) over the labels' mean shares q.
    """
    labels = rows.select(F.col("x").alias("label")).union(rows.select("y")).distinct()
    placed = labels.select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("i"))
    cells = rows.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    cells = cells.join(placed.select(F.col("label").alias("x"), F.col("i").alias("i")), "x").join(placed.select(F.col("label").alias("y"), F.col("i").alias("j")), "y")
    size = cells.agg(F.sum("n").alias("n")).first()["n"]
    k = placed.count()
    xs = cells.groupBy(F.col("i").alias("label")).agg(F.sum("n").alias("nx"))
    ys = cells.groupBy(F.col("j").alias("label")).agg(F.sum("n").alias("ny"))
    scale = float(max(1, k - 1))
    d = F.abs(F.col("i") - F.col("j"))
    weights = {"kappa": (d != 0).cast("double"), "kappa_linear": d / F.lit(scale), "kappa_quadratic": (d / F.lit(scale)) ** 2}
    seen = cells.agg(*[F.sum(w * F.col("n")).alias(name) for name, w in weights.items()], F.sum(F.when(d == 0, F.col("n")).otherwise(0)).alias("same")).first()
    # the expected sums over all pairs of labels, from the margins and their running totals
    margins = xs.join(ys, "label", "full").fillna(0)
    upto = Window.orderBy("label").rowsBetween(Window.unboundedPreceding, 0)
    margins = margins.withColumn("fx", F.sum("nx").over(upto)).withColumn("fy", F.sum("ny").over(upto))
    x, y, at = F.col("nx").cast("double"), F.col("ny").cast("double"), F.col("label")
    m = margins.agg(
        F.sum(x * y).alias("same"), F.sum(F.col("fx") * (size - F.col("fy")) + F.col("fy") * (size - F.col("fx"))).cast("double").alias("linear"),
        F.sum(at * at * (x + y)).alias("squares"), F.sum(at * x).alias("mx"), F.sum(at * y).alias("my"),
        F.sum((x + y) / (2.0 * size) * (1 - (x + y) / (2.0 * size))).alias("even"),
    ).first()
    chance = {"kappa": size * size - m.same, "kappa_linear": m.linear / scale, "kappa_quadratic": (size * m.squares - 2 * m.mx * m.my) / scale**2}
    even = m.even
    po = seen["same"] / size
    value = {name: 1 - seen[name] * size / chance[name] if chance[name] else 1.0 for name in weights}
    ac1 = (po - even) / (1 - even) if even != 1 else 1.0
    row = (size, round(po, 6), *(round(value[name], 6) for name in weights), round(2 * po - 1, 6), round(ac1, 6))
    return rows.sparkSession.createDataFrame([row], "n long, agreement double, kappa double, kappa_linear double, kappa_quadratic double, pabak double, ac1 double")


def fleiss(ratings: DataFrame) -> DataFrame:
    """n_items, kappa of (item, rater, label) where every item has as many ratings."""
    cells = ratings.groupBy("item", "label").agg(F.count(F.lit(1)).alias("c"))
    items = cells.groupBy("item").agg(F.sum("c").alias("r"), F.sum(F.col("c") * (F.col("c") - 1)).alias("pairs"))
    mean = items.agg(F.count(F.lit(1)).alias("n_items"), F.avg(F.col("pairs") / (F.col("r") * (F.col("r") - 1))).alias("p"), F.sum("r").alias("total"))
    share = cells.groupBy("label").agg(F.sum("c").alias("c"))
    chance = share.agg(F.sum(F.col("c") * F.col("c")).alias("squares"))
    e = F.col("squares") / (F.col("total") * F.col("total"))
    return mean.join(F.broadcast(chance)).select("n_items", r6(F.when(e == 1, 1.0).otherwise((F.col("p") - e) / (1 - e))).alias("kappa"))


def krippendorff(ratings: DataFrame) -> DataFrame:
    """n_units, alpha (nominal) of (item, rater, label); units with one rating are left out."""
    cells = ratings.where(F.col("label").isNotNull()).groupBy("item", "label").agg(F.count(F.lit(1)).alias("c"))
    sizes = cells.groupBy("item").agg(F.sum("c").alias("m")).where("m > 1")
    pairable = cells.join(sizes, "item")
    observed = pairable.agg(F.sum(F.col("c") * (F.col("m") - F.col("c")) / (F.col("m") - 1)).alias("do"), F.count_distinct("item").alias("n_units"), F.sum("c").alias("n"))
    squares = pairable.groupBy("label").agg(F.sum("c").alias("nc")).agg(F.sum(F.col("nc") * F.col("nc")).alias("squares"))
    de = (F.col("n") * F.col("n") - F.col("squares")) / (F.col("n") - 1)
    return observed.join(F.broadcast(squares)).select("n_units", r6(F.when(de == 0, 1.0).otherwise(1 - F.col("do") / de)).alias("alpha"))


def unanimity(ratings: DataFrame) -> DataFrame:
    """n_labels, n_items: how many items have so many different labels."""
    return ratings.groupBy("item").agg(F.count_distinct("label").alias("n_labels")).groupBy("n_labels").agg(F.count(F.lit(1)).alias("n_items"))


#: Buckets of a score in [0, 1] for prefix sums in two levels: over the buckets, then within each.
SCORE_BUCKETS = 4096


def score_bucket() -> Column:
    return F.floor(F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0)) * SCORE_BUCKETS).cast("int")


def auc(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """n_pos, n_neg, auc from score in [0, 1] and truth, ties at average ranks.

    Scores are counted before they are ranked, and the counts are summed in two levels, so no window holds all scores.
    """
    levels = scored.groupBy(*by, score_bucket().alias("bucket"), "score").agg(F.count_if("truth").alias("pos"), F.count_if(~F.col("truth")).alias("neg"))
    sums = levels.groupBy(*by, "bucket").agg(F.sum("neg").alias("neg"))
    before = Window.partitionBy(*by).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*by, "bucket", F.coalesce(F.sum("neg").over(before), F.lit(0)).alias("base"))
    below = Window.partitionBy(*by, "bucket").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    at = levels.withColumn("below", F.coalesce(F.sum("neg").over(below), F.lit(0))).join(bases, [*by, "bucket"])
    won = at.withColumn("won", F.col("pos") * (F.col("base") + F.col("below") + F.col("neg") / 2))
    return won.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum("won").alias("w")).select(
        *by, "n_pos", "n_neg", r6(ratio(F.col("w"), F.col("n_pos") * F.col("n_neg"))).alias("auc")
    )


def by_falling_score(scored: DataFrame, item: str) -> DataFrame:
    """scored with at (place from 1), hits (true ones so far), n (rows): by falling score in [0, 1], equal scores in the order of `item`.

    Places are prefix sums in two levels, so no window holds all rows; only the one over the SCORE_BUCKETS counts is global.
    """
    hit = F.col("truth").cast("long")
    tagged = scored.withColumn("bucket", score_bucket())
    sums = tagged.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), F.sum(hit).alias("right"))
    before = Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    base = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    bases = sums.select("bucket", base("rows").alias("rows_before"), base("right").alias("right_before"), F.sum("rows").over(Window.partitionBy()).alias("n"))
    order = Window.partitionBy("bucket").orderBy(F.desc("score"), item)
    within = tagged.withColumn("at", F.row_number().over(order)).withColumn("hits", F.sum(hit).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = within.join(F.broadcast(bases), "bucket")  # SCORE_BUCKETS + 1 rows at most
    return found.withColumn("at", F.col("at") + F.col("rows_before")).withColumn("hits", F.col("hits") + F.col("right_before")).drop("bucket", "rows_before", "right_before")


def average_precision(scored: DataFrame, item: str) -> DataFrame:
    """ap from score and truth; equal scores are taken in the order of `item`."""
    ranked = by_falling_score(scored, item)
    return ranked.agg(r6(ratio(F.sum(F.when(F.col("truth"), F.col("hits") / F.col("at"))), F.count_if("truth"))).alias("ap"))


def calibration_bins(scored: DataFrame, bins: int = 15) -> DataFrame:
    """bin, n, confidence, accuracy from score in [0, 1] and truth."""
    at = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).alias("bin")
    return scored.groupBy(at).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("score")).alias("confidence"), r6(F.avg(F.col("truth").cast("double"))).alias("accuracy"))


def calibration(scored: DataFrame, bins: int = 15) -> DataFrame:
    """ece, mce, brier, nll (scores clipped to [1e-6, 1 - 1e-6])."""
    y, p = F.col("truth").cast("double"), F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("score")))
    at = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).alias("bin")
    each = scored.groupBy(at).agg(
        F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"), F.sum(y).alias("y"), F.sum((F.col("score") - y) ** 2).alias("b"),
        F.sum(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("l"),
    )
    gap = F.abs(F.col("s") - F.col("y"))
    n = F.sum("n")
    return each.agg(r6(F.sum(gap) / n).alias("ece"), r6(F.max(gap / F.col("n"))).alias("mce"), r6(F.sum("b") / n).alias("brier"), r6(F.sum("l") / n).alias("nll"))


def risk_coverage(scored: DataFrame, item: str, points: int = 50) -> DataFrame:
    """pos, coverage, accuracy: running accuracy by falling score, at every n // points rows and at the last."""
    run = by_falling_score(scored, item)
    step = F.greatest(F.lit(1), F.floor(F.col("n") / points))
    kept = run.where((F.col("at") % step == 0) | (F.col("at") == F.col("n")))
    return kept.select(F.col("at").alias("pos"), r6(F.col("at") / F.col("n")).alias("coverage"), r6(F.col("hits") / F.col("at")).alias("accuracy"))


def risk_summary(scored: DataFrame, item: str, points: int = 50) -> DataFrame:
    """n_points, aurc (mean risk over the points of risk_coverage), at_half (accuracy at the coverage nearest one half, the lower of two)."""
    nearest = F.min_by("accuracy", F.struct(F.abs(F.col("coverage") - 0.5), "pos"))
    return risk_coverage(scored, item, points).agg(F.count(F.lit(1)).alias("n_points"), r6(F.avg(1 - F.col("accuracy"))).alias("aurc"), nearest.alias("at_half"))


def association(rows: DataFrame, a: str, b: str) -> DataFrame:
    """n, v2: chi-square over cells that occur, divided by n * (least number of labels - 1)."""
    cells = rows.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    x, y = cells.groupBy(a).agg(F.sum("n").alias("nx")), cells.groupBy(b).agg(F.sum("n").alias("ny"))
    total = cells.agg(F.sum("n").alias("n"), F.count_distinct(a).alias("ka"), F.count_distinct(b).alias("kb")).first()
    e = F.col("nx") * F.col("ny") / F.lit(float(total.n))
    den = total.n * max(1, min(total.ka, total.kb) - 1)
    return cells.join(x, a).join(y, b).agg(F.sum("n").alias("n"), r6(F.sum((F.col("n") - e) ** 2 / e) / den).alias("v2"))


#: Resamples of a bootstrap.
RESAMPLES = 2000


#: Steps and multipliers of a 64-bit mixing function.
STEP, MIX_1, MIX_2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
#: A mean up to which a Poisson number is found by inversion; beyond, it is a rounded normal number of that variance.
INVERTED, MOST_INVERTED = 30, 80
#: Levels whose draws are in memory at once, and groups whose sums are: a task that meets more passes them on.
LEVELS_AT_ONCE, GROUPS_AT_ONCE = 128, 256


def mixed(key: np.ndarray, resamples: int) -> np.ndarray:
    """A 64-bit number for each key and resample."""
    with np.errstate(over="ignore"):
        h = key[:, None] + np.arange(resamples, dtype=np.uint64)[None, :] * np.uint64(STEP)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX_1)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX_2)
    return h ^ (h >> np.uint64(31))


def poisson(h: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """Poisson numbers of each row's mean: two uniform numbers are the halves of `h`."""
    u = ((h >> np.uint64(32)).astype(np.float64) + 0.5) / 2.0**32
    out = np.empty_like(u)
    small = mean <= INVERTED
    for m in np.unique(mean[small]):
        p = np.exp(-m) * np.cumprod(np.concatenate([[1.0], m / np.arange(1, MOST_INVERTED)]))
        at = mean == m
        out[at] = np.searchsorted(np.cumsum(p), u[at])
    if not small.all():
        v = ((h[~small] & np.uint64(0xFFFFFFFF)).astype(np.float64) + 0.5) / 2.0**32
        m = mean[~small][:, None]
        out[~small] = np.maximum(0.0, np.floor(m + np.sqrt(m) * np.sqrt(-2 * np.log(u[~small])) * np.cos(2 * np.pi * v) + 0.5))
    return out


def resampled(rows: DataFrame, value: str, by: Sequence[str] = (), resamples: int = RESAMPLES, seed: int = 11) -> DataFrame:
    """by, resample, m: the mean of `value` (to six decimals) in each of `resamples` Poisson resamples.

    Equal values are counted first; a value that n rows have occurs a Poisson number of times of mean n in a resample, drawn
    from a hash of group, value and resample. A task adds its values to one vector of sums a group, and the vectors are
    added up: what travels is vectors, one a task and group, however many values there are. A resample without rows has the mean of all.
    """
    level = F.col(value).cast("decimal(20,6)")
    return _weighed_draws(rows.where(F.col(value).isNotNull()).select(*by, level.alias("value"), F.lit(1).alias("n")), by, resamples, seed)


def _accumulate(n_by: int, resamples: int):
    """A function over batches of (by, key, value, n): the vectors of each group, for mapInArrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def out() -> pa.RecordBatch:
            columns = [pa.array([g[k] for g in held], kinds[k]) for k in range(n_by)]
            columns += [pa.array([x[k] for x in held.values()], pa.float64()) for k in (0, 1)]
            columns += [pa.array([x[k] for x in held.values()], pa.list_(pa.float64())) for k in (2, 3)]
            return pa.RecordBatch.from_arrays(columns, [*names, "n", "total", "s", "w"])

        for batch in batches:
            names, kinds = batch.schema.names[:n_by], batch.schema.types[:n_by]
            groups = list(zip(*(batch.column(k).to_pylist() for k in range(n_by)), strict=True)) if n_by else [()] * len(batch)
            key, value, n = (batch.column(n_by + k).to_numpy(zero_copy_only=False) for k in range(3))
            for at in range(0, len(batch), LEVELS_AT_ONCE):
                part = slice(at, at + LEVELS_AT_ONCE)
                w = poisson(mixed(key[part].astype(np.uint64), resamples), n[part].astype(np.float64))
                s = w * value[part][:, None]
                of: dict[tuple, list[int]] = {}
                for i, g in enumerate(groups[part]):
                    of.setdefault(g, []).append(i)
                for g, i in of.items():
                    if g not in held:
                        if len(held) >= GROUPS_AT_ONCE:
                            yield out()
                            held.clear()
                        held[g] = [0.0, 0.0, np.zeros(resamples), np.zeros(resamples)]
                    x = held[g]
                    x[0] += float(n[part][i].sum())
                    x[1] += float((n[part][i] * value[part][i]).sum())
                    x[2] += s[i].sum(axis=0)
                    x[3] += w[i].sum(axis=0)
        if held:
            yield out()

    return run


def _weighed_draws(rows: DataFrame, by: Sequence[str], resamples: int, seed: int) -> DataFrame:
    """resampled() of rows that have value and n, how often they are there."""
    importable(rows.sparkSession)
    levels = rows.groupBy(*by, "value").agg(F.sum("n").alias("n"))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*by, "value")])), 1, 15), 16, 10).cast("long")
    keyed = levels.select(*by, key.alias("key"), F.col("value").cast("double").alias("value"), F.col("n").cast("long").alias("n"))
    kinds = {f.name: f.dataType.simpleString() for f in keyed.schema.fields}
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in by], "n double, total double, s array<double>, w array<double>"])
    vectors = keyed.mapInArrow(_accumulate(len(by), resamples), schema)
    each = vectors.select(*by, "n", "total", F.posexplode(F.arrays_zip("s", "w")).alias("resample", "x"))
    sums = each.groupBy(*by, "resample").agg(F.sum("x.s").alias("s"), F.sum("x.w").alias("w"), (F.sum("total") / F.sum("n")).alias("mean"))
    return sums.select(*by, "resample", F.when(F.col("w") > 0, F.col("s") / F.col("w")).otherwise(F.col("mean")).alias("m"), "mean")


def intervals(draws: DataFrame, by: Sequence[str] = (), level: float = 0.95) -> DataFrame:
    """by, mean, low, high: the order statistics of the resampled means."""
    order = Window.partitionBy(*by).orderBy("m", "resample")
    tail = (1 - level) / 2
    placed = draws.withColumn("i", F.row_number().over(order) - 1).withColumn("of", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    at = lambda q: F.max(F.when(F.col("i") == F.least(F.floor(F.col("of") * q + 1e-9), F.col("of") - 1), F.col("m")))
    return placed.groupBy(*by).agg(r6(F.first("mean")).alias("mean"), r6(at(tail)).alias("low"), r6(at(1 - tail)).alias("high"))


def bootstrap_mean(rows: DataFrame, value: str, by: Sequence[str] = (), resamples: int = RESAMPLES, seed: int = 11, level: float = 0.95) -> DataFrame:
    """by, mean, low, high: percentile interval of the mean by a Poisson bootstrap over the histogram of the values."""
    return intervals(resampled(rows, value, by, resamples, seed), by, level)


def paired_delta(pairs: DataFrame, by: Sequence[str] = (), resamples: int = RESAMPLES, seed: int = 11) -> DataFrame:
    """by, delta, low, high, p, prob_better of x - y over pairs that have both: bootstrap of the mean difference.

    prob_better is the share of resamples above 0, and p twice the lesser of it and the rest, 1 at most.
    """
    differ = pairs.where("x IS NOT NULL AND y IS NOT NULL").select(*by, (F.col("x").cast("double") - F.col("y").cast("double")).alias("d"))
    draws = resampled(differ, "d", by, resamples, seed)
    ends = intervals(draws, by).withColumnRenamed("mean", "delta")
    above = draws.groupBy(*by).agg(F.avg((F.col("m") > 0).cast("double")).alias("better"))
    both = ends.join(above, list(by)) if by else ends.join(F.broadcast(above))
    better = F.col("better")
    return both.select(*by, "delta", "low", "high", r6(F.least(F.lit(1.0), 2 * F.least(better, 1 - better))).alias("p"), r6(better).alias("prob_better"))


def pooled(rows: DataFrame, by: Sequence[str], value: str, weight: str) -> DataFrame:
    """Weighted mean of `value` over the sets of each group."""
    return rows.groupBy(*by).agg(r6(F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(value), F.sum(weight).alias(weight))


# ---- panels: every pair of systems at once ---------------------------------------------------------------------------


def pair_cells(outcomes: DataFrame) -> DataFrame:
    """a, b, x, y, n: how often systems a < b give an item (of system, item, outcome) the outcomes x and y.

    Items meet by an equi-join. The table has at most pairs of systems times pairs of outcomes rows, whatever the items.
    """
    x = outcomes.select(F.col("system").alias("a"), "item", F.col("outcome").alias("x"))
    y = outcomes.select(F.col("system").alias("b"), "item", F.col("outcome").alias("y"))
    return x.join(y, "item").where("a < b").groupBy("a", "b", "x", "y").agg(F.count(F.lit(1)).alias("n"))


def _margins(cells: DataFrame) -> DataFrame:
    """a, b, label, nx, ny of pair_cells()."""
    none = F.lit(0).cast("long")
    sides = [F.struct(label.alias("label"), nx.alias("nx"), ny.alias("ny")) for label, nx, ny in ((F.col("x"), F.col("n"), none), (F.col("y"), none, F.col("n")))]
    either = cells.select("a", "b", F.inline(F.array(*sides)))
    return either.groupBy("a", "b", "label").agg(F.sum("nx").cast("double").alias("nx"), F.sum("ny").cast("double").alias("ny"))


def agreement_panel(cells: DataFrame, labels: Sequence[str]) -> DataFrame:
    """a, b, n, agreement, kappa, kappa_linear, kappa_quadratic, pabak, ac1 of each pair of systems; `labels` in order of weight."""
    place = F.create_map(*[v for i, name in enumerate(labels) for v in (F.lit(name), F.lit(i))])
    far = F.abs(place[F.col("x")] - place[F.col("y")]).cast("double")
    scale = float(max(1, len(labels) - 1))
    weights = {"kappa": (F.col("x") != F.col("y")).cast("double"), "kappa_linear": far / scale, "kappa_quadratic": (far / scale) ** 2}
    seen = cells.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)).alias("same"), *[F.sum(w * F.col("n")).alias(k) for k, w in weights.items()])
    m = _margins(cells)
    across = m.select("a", "b", F.col("label").alias("x"), "nx").join(m.select("a", "b", F.col("label").alias("y"), "ny"), ["a", "b"])
    chance = across.groupBy("a", "b").agg(*[F.sum(w * F.col("nx") * F.col("ny")).alias(f"e_{k}") for k, w in weights.items()])
    share = m.join(seen.select("a", "b", "n"), ["a", "b"]).withColumn("q", (F.col("nx") + F.col("ny")) / (2 * F.col("n")))
    even = share.groupBy("a", "b").agg(F.sum(F.col("q") * (1 - F.col("q"))).alias("even"))
    full = seen.join(chance, ["a", "b"]).join(even, ["a", "b"])
    po = F.col("same") / F.col("n")
    kappas = [r6(F.when(F.col(f"e_{k}") == 0, 1.0).otherwise(1 - F.col(k) * F.col("n") / F.col(f"e_{k}"))).alias(k) for k in weights]
    return full.select("a", "b", "n", r6(po).alias("agreement"), *kappas, r6(2 * po - 1).alias("pabak"), r6(F.when(F.col("even") == 1, 1.0).otherwise((po - F.col("even")) / (1 - F.col("even")))).alias("ac1"))


def association_matrix(cells: DataFrame) -> DataFrame:
    """a, b, v2: chi-square over cells that occur, by n * (least number of labels - 1), 1 at most, for each pair of systems."""
    m = _margins(cells)
    total = cells.groupBy("a", "b").agg(F.sum("n").alias("t"), F.count_distinct("x").alias("kx"), F.count_distinct("y").alias("ky"))
    full = cells.join(m.select("a", "b", F.col("label").alias("x"), "nx"), ["a", "b", "x"]).join(m.select("a", "b", F.col("label").alias("y"), "ny"), ["a", "b", "y"]).join(total, ["a", "b"])
    e = F.col("nx") * F.col("ny") / F.col("t")
    den = F.first(F.col("t") * F.greatest(F.lit(1), F.least("kx", "ky") - 1))
    return full.groupBy("a", "b").agg(r6(F.least(F.lit(1.0), F.sum((F.col("n") - e) ** 2 / e) / den)).alias("v2"))


def significance(verdicts: DataFrame, resamples: int = 1000, seed: int = 11) -> DataFrame:
    """Paired tests of every measure and pair of systems, over the items that both have a verdict for.

    verdicts: measure, system, item, verdict (boolean, null where not scorable). Returns measure, a, b, n, rate_a, rate_b, only_a,
    only_b, p (exact McNemar), holm_p over all rows, delta, low, high (paired bootstrap of a - b).
    """
    known = verdicts.where("verdict IS NOT NULL").select("measure", "system", "item", F.col("verdict").cast("int").alias("v"))
    x, y = known.withColumnsRenamed({"system": "a", "v": "x"}), known.withColumnsRenamed({"system": "b", "v": "y"})
    cells = x.join(y, ["measure", "item"]).where("a < b").groupBy("measure", "a", "b", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    by = ["measure", "a", "b"]
    n = F.col("n")
    counts = cells.groupBy(*by).agg(
        F.sum("n").alias("n"), r6(F.sum(F.col("x") * n) / F.sum("n")).alias("rate_a"), r6(F.sum(F.col("y") * n) / F.sum("n")).alias("rate_b"),
        F.sum(F.when(F.expr("x > y"), n).otherwise(0)).alias("only_a"), F.sum(F.when(F.expr("x < y"), n).otherwise(0)).alias("only_b"),
    )
    tested = counts.withColumn("p", mcnemar(F.col("only_a"), F.col("only_b"))).withColumn("name", F.concat_ws("|", *by))
    adjusted = holm(tested.select("name", "p")).select("name", F.col("adjusted").alias("holm_p"))
    draws = _weighed_draws(cells.withColumn("value", (F.col("x") - F.col("y")).cast("decimal(20,6)")), by, resamples, seed)
    ends = intervals(draws, by).withColumnRenamed("mean", "delta")
    return tested.join(adjusted, "name").join(ends, by).select(*by, "n", "rate_a", "rate_b", "only_a", "only_b", r6(F.col("p")).alias("p"), "holm_p", "delta", "low", "high")
