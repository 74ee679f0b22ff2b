"""Validating a question set: labels, execution, drift, leaks, wording; and the manifest of what is left."""

from __future__ import annotations

import datetime
from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from tallyglass.functions.canon import canonical_hash
from tallyglass.operators import guard
from tallyglass.sources.files import LEGAL

#: Fixed value: words of a question that are relative to now.
TEMPORAL = ("today", "yesterday", "last week", "last month", "this month", "currently", "recent", "latest", "now")


@dataclass(frozen=True)
class Finding:
    question_id: str
    check: str
    detail: str


@dataclass
class Report:
    scorable: int = 0
    splits: Counter = field(default_factory=Counter)
    excluded: list[Finding] = field(default_factory=list)
    warnings: list[Finding] = field(default_factory=list)

    @property
    def clean(self) -> bool:
        return not self.excluded


def expected_rows(spark: SparkSession, sql: str, **limits) -> dict[str, object]:
    """The fingerprint a gold query is stored with."""
    rows, _, _ = guard.execute(spark, sql, **limits)
    sha, n = canonical_hash(rows)
    return {"sha256": sha, "n_rows": n}


def window_dependent(clamped: SparkSession, sql: str, sha256: str) -> bool:
    return expected_rows(clamped, sql)["sha256"] != sha256


def illegal(question: Mapping) -> str | None:
    """The first label that is not legal."""
    return next((name for name, legal in LEGAL.items() if question[name] not in legal), None)


def validate(spark: SparkSession, questions: Sequence[Mapping], clamped: SparkSession | None = None) -> Report:
    """Every question is excluded at its first failure; a train_ok question that reads the holdout, or fails on the shadow, leaks."""
    report = Report()
    repeated = [i for i, n in Counter(x["id"] for x in questions).items() if n > 1]
    if repeated:
        report.excluded.append(Finding("-", "duplicate_ids", ", ".join(sorted(repeated)[:5])))
    for x in questions:
        if name := illegal(x):
            report.excluded.append(Finding(x["id"], name, str(x[name])))
            continue
        try:
            found = expected_rows(spark, x["gold_sql"])
        except Exception as e:  # noqa: BLE001  (any failure of a gold query excludes it)
            report.excluded.append(Finding(x["id"], "gold_sql", f"{type(e).__name__}: {str(e)[:80]}"))
            continue
        if found["sha256"] != x["expected_rows"]["sha256"]:
            report.excluded.append(Finding(x["id"], "expected_rows_drift", found["sha256"][:12]))
            continue
        if x["split"] == "train_ok":
            if any(word in x["question"].lower() for word in TEMPORAL):
                report.warnings.append(Finding(x["id"], "temporal_term", "mentions relative time"))
            if clamped is not None:
                try:
                    leaked = window_dependent(clamped, x["gold_sql"], x["expected_rows"]["sha256"])
                except Exception as e:  # noqa: BLE001  (not answerable without the holdout)
                    report.excluded.append(Finding(x["id"], "holdout_leak", f"{type(e).__name__}"))
                    continue
                if leaked:
                    report.excluded.append(Finding(x["id"], "holdout_leak", "differs without the holdout"))
                    continue
        report.scorable += 1
        report.splits[x["split"]] += 1
    return report


def manifest(questions: Sequence[Mapping], fingerprint: str, cutoff: str | None, seed: int) -> dict[str, object]:
    """The identity card of a question set."""
    counts = {name: dict(Counter(x[name] for x in questions)) for name in ("difficulty", "category", "split")}
    return {"n_questions": len(questions), "counts": counts, "db_fingerprint": fingerprint, "holdout_cutoff": cutoff, "seed": seed, "generated_on": datetime.date.today().isoformat()}
