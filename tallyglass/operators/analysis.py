"""Putting an analysis together: side-cars, summaries by set and system, panels over pairs of systems, benchmark and latency summaries."""

from __future__ import annotations

import statistics
import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyglass.operators import items, stats

#: Fixed value: outcomes of an item, from best to worst.
OUTCOMES = ("executed_exact", "executed_match", "valid_wrong", "invalid")
MEASURES = {"valid": "valid", "exact": "exact", "exec": "executed"}


def with_sidecars(scored: DataFrame, confidence: DataFrame | None = None, self_consistency: DataFrame | None = None, robustness: DataFrame | None = None) -> DataFrame:
    """Item scores with what optional runs add, by (set, system, idx); an item without it has nulls, and no item is added.

    confidence: confidence. self_consistency: pass_at_k, majority_correct, agreement. robustness: robust.
    """
    key = ["set", "system", "idx"]
    for side in (confidence, self_consistency, robustness):
        if side is not None:
            scored = scored.join(side.dropDuplicates(key), key, "left")
    return scored


def outcome_rows(scored: DataFrame) -> DataFrame:
    """set, system, item, outcome of item scores."""
    return scored.select("set", "system", F.col("idx").alias("item"), "outcome")


def verdicts(scored: DataFrame) -> DataFrame:
    """measure, system, item, verdict: each item's binary outcomes; execution is null where it cannot be scored."""
    each = F.array(*[F.struct(F.lit(name).alias("measure"), F.col(column).cast("boolean").alias("verdict")) for name, column in MEASURES.items()])
    return scored.select("system", F.concat_ws(":", "set", "idx").alias("item"), F.inline(each)).select("measure", "system", "item", "verdict")


def assemble(scored: DataFrame, resamples: int = stats.RESAMPLES) -> dict[str, DataFrame]:
    """All tables of an analysis of item scores, lazily: each is one aggregate over the items or over a bounded table of cells."""
    rows = outcome_rows(scored).select("system", F.concat_ws(":", "set", "item").alias("item"), "outcome")
    cells = stats.pair_cells(rows)
    summary = items.summary(scored)
    return {
        "summary": summary,
        "intervals": items.summary_intervals(scored, resamples=resamples),
        "micro_link": items.micro_link(scored),
        "signatures": items.signature_matrix(scored),
        "clauses": items.clause_confusion(scored),
        "by_family": items.accuracy_by(scored, "family"),
        "by_length": items.accuracy_by(scored, "length_bin"),
        "outcomes": rows.groupBy("system", "outcome").agg(F.count(F.lit(1)).alias("n")),
        "outcome_pairs": cells,
        "agreement": stats.agreement_panel(cells, OUTCOMES),
        "association": stats.association_matrix(cells),
        "significance": stats.significance(verdicts(scored)),
        "pooled": stats.pooled(summary.where("scored > 0"), ["system"], "ex_rate", "scored"),
    }


def benchmark_summary(rows: DataFrame) -> DataFrame:
    """n, valid, ex, em with their rates, repairs tried and succeeded with their rate (1 without any), avg_latency_ms.

    rows: valid, executed, exact, was_repaired, success, latency_ms.
    """
    n, rate = F.col("n"), lambda c: F.round(stats.ratio(F.col(c), F.col("n")), 6).alias(f"{c}_rate")
    agg = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("valid"), F.count_if("executed").alias("ex"), F.count_if("exact").alias("em"),
        F.count_if("was_repaired").alias("repairs"), F.count_if(F.col("was_repaired") & F.col("success")).alias("repaired"), F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"),
    )
    recovery = F.when(F.col("repairs") > 0, F.round(F.col("repaired") / F.col("repairs"), 6)).otherwise(1.0)
    return agg.select(n, "valid", rate("valid"), "ex", rate("ex"), "em", rate("em"), "repairs", "repaired", recovery.alias("recovery_rate"), F.coalesce("avg_latency_ms", F.lit(0.0)).alias("avg_latency_ms"))


def latency_benchmark(operations: Mapping[str, Callable[[], object]], times: int = 20) -> dict[str, dict[str, float]]:
    """p50, p95, least and most milliseconds of each operation, called `times` times after one call that is not counted."""
    out = {}
    for name, operation in operations.items():
        operation()
        spent = []
        for _ in range(times):
            began = time.perf_counter()
            operation()
            spent.append((time.perf_counter() - began) * 1000)
        spent.sort()
        out[name] = {"p50": statistics.median(spent), "p95": spent[min(len(spent) - 1, int(0.95 * len(spent)))], "least": spent[0], "most": spent[-1]}
    return out


def shares(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """How many rows of each group, and their share of all."""
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select(*by, "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))
