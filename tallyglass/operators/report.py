"""Reports: summaries of systems as a table, the gate, paired tests, and the folders of failures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass.operators.scoring import gate, seed_fold
from tallyglass.operators.stats import mcnemar_full, paired
from tallyglass.sources.files import latest_summaries


def markdown_table(columns: Sequence[str], rows: Sequence[Sequence[object]]) -> str:
    shown = lambda v: "–" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = [list(columns), ["---"] * len(columns), *[[shown(v) for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(cells) + " |" for cells in lines)


def wilson_interval(k: int, n: int, z: float = 1.96) -> tuple[float, float]:
    if not n:
        return 0.0, 0.0
    p, den = k / n, 1 + z * z / n
    centre, half = p + z * z / (2 * n), z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5
    return max(0.0, (centre - half) / den), min(1.0, (centre + half) / den)


#: A row of `summary` in a run's folder.
SUMMARY = (
    "system string, role string, hardware string, n_questions long, ex_heldout double, refusal_rate double, agreement double, flip_rate double, p50_latency_ms double, "
    "n_failures long, generated_at string"
)


def folders(spark: SparkSession, run: str) -> list[str]:
    """The run's folder, or those of the runs in it, in order of name: each has a `summary`."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    system = hadoop(run).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(hadoop(f"{run}/summary")):
        return [run]
    below = sorted(f.getPath().getName() for f in (system.listStatus(hadoop(run)) if system.exists(hadoop(run)) else []) if f.isDirectory())
    return [f"{run}/{name}" for name in below if system.exists(hadoop(f"{run}/{name}/summary"))]


def report_run(spark: SparkSession, run: str, dataset: str) -> tuple[str, dict[str, int]]:
    """Markdown of a run, or of several runs in one folder, and the failures of each system; the pages of the failures are written.

    Of a system with several summaries the last generated counts. Candidate seeds fold into one row of their mean, whose middle
    seed stands for them in the paired tests. The gate compares the candidate with the reference.
    """
    paths = folders(spark, run)
    if not paths:
        raise FileNotFoundError(f"no summaries in {run}")
    found = latest_summaries(spark, [f"{p}/summary" for p in paths], T.StructType.fromDDL(SUMMARY)).withColumn("folder", F.regexp_replace("path", "/summary/[^/]*$", ""))
    rows = [r.asDict() for r in found.orderBy("role", "system").collect()]
    scored = None
    for row in rows:
        one = spark.read.parquet(f"{row['folder']}/scored/system={row['system']}").where("kind = 'headline'").withColumn("system", F.lit(row["system"]))
        scored = one if scored is None else scored.unionByName(one)
    seeds = [r for r in rows if r["role"] == "candidate_seed"]
    shown = [r for r in rows if r["role"] != "candidate_seed"]
    stands_for = {}
    if seeds:
        fold = seed_fold(spark.createDataFrame([(r["role"], r["system"], r["ex_heldout"], r["flip_rate"], r["n_failures"]) for r in seeds], "role string, system string, ex double, flip double, n_failures long")).first()
        name = f"candidate (mean of {len(seeds)} seeds)"
        middle = next(r for r in seeds if r["system"] == fold.representative)
        shown.append(middle | {"system": name, "role": "candidate", "ex_heldout": fold.mean_ex, "flip_rate": fold.flip, "n_failures": fold.n_failures})
        stands_for[name] = fold.representative
    systems = [{"system": r["system"], "role": r["role"], "n": r["n_questions"], "ex": r["ex_heldout"], "refusal_rate": r["refusal_rate"], "agreement": r["agreement"], "flip": r["flip_rate"], "p50_latency_ms": r["p50_latency_ms"]} for r in shown]
    of = {role: next((r["system"] for r in shown if r["role"] == role), None) for role in ("candidate", "baseline", "reference")}
    counts = {(r.a, r.b): (r.only_a, r.only_b) for r in paired(scored.select("system", F.col("question_id").alias("item"), "correct")).collect()}
    tested = [stands_for.get(of["candidate"], of["candidate"]), *[r["system"] for r in seeds]]
    pairs = {}
    for a in dict.fromkeys(x for x in tested if x):
        for b in (of["baseline"], of["reference"]):
            if b and a != b:
                n = counts.get((a, b)) or tuple(reversed(counts.get((b, a), (0, 0))))
                pairs[a, b] = n
    text = render(dataset, systems, pairs, of["candidate"], of["reference"])
    write_failures(scored, f"{run}/failures")
    return text, {r["system"]: r["n_failures"] for r in rows}


def render(dataset: str, systems: Sequence[Mapping], pairs: Mapping[tuple[str, str], tuple[int, int]], candidate: str | None = None, baseline: str | None = None) -> str:
    """Markdown of one run: a row a system, the gate's verdict if both systems are there, one line a paired test."""
    rows = []
    for s in systems:
        low, high = wilson_interval(round(s["ex"] * s["n"]), s["n"])
        rows.append((s["system"], s["role"], s["n"], s["ex"], f"[{low:.3f}, {high:.3f}]", s["refusal_rate"], s["agreement"], s["flip"], s["p50_latency_ms"]))
    out = [f"# {dataset}", markdown_table(("system", "role", "n", "EX", "95 % CI", "refusals", "agreement", "flips", "p50 ms"), rows)]
    by = {s["system"]: s for s in systems}
    if candidate in by and baseline in by:
        a, b = by[candidate], by[baseline]
        passes = gate(a["ex"], b["ex"], a["flip"], b["flip"])
        out.append(f"Gate: {candidate} {'passes' if passes else 'does not pass'} against {baseline}.")
        out += [
            f"Fallback: {s['system']}: EX {s['ex']:.3f}, flips {s['flip']:.3f} against {baseline}: EX {b['ex']:.3f}, flips {b['flip']:.3f}."
            for s in systems
            if s["role"] == "onprem" and not passes
        ]
    for (a, b), (only_a, only_b) in sorted(pairs.items()):
        out.append(f"{a} against {b}: {only_a} only {a}, {only_b} only {b}, exact p = {mcnemar_full(only_a, only_b)['p_exact']:.4f}")
    return "\n\n".join(out) + "\n"


def write_failures(results: DataFrame, path: str) -> None:
    """One text row a wrong answer, a folder for each system and class."""
    page = F.format_string("# %s\n\n%s\n\n```sql\n%s\n```\n", "question_id", F.coalesce("reason", F.lit("")), F.coalesce("pred_sql", F.lit("")))
    results.where(~F.col("correct")).select("system", "error_class", page.alias("value")).write.mode("overwrite").partitionBy("system", "error_class").text(path)
