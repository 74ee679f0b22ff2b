"""Command line: python -m tallyglass.cli VERB --data FOLDER [...]; the folder holds one Parquet per table."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyglass import __version__, catalogue
from tallyglass.operators import corpus, evaluate, guard, profile, report, retrieval, shadow, validation
from tallyglass.plans import authoring
from tallyglass.session import build_session, table
from tallyglass.sources import catalog, files


#: The star schema's declarations, for a folder that has none of its own.
STAR = catalog.Dataset(tuple(sorted({*catalog.PRIMARY_KEYS, "lineitem"})), catalog.PRIMARY_KEYS, catalog.FOREIGN_KEYS, {}, ("orders", "o_orderdate", 6))


def _dataset(data: str) -> catalog.Dataset:
    declared = Path(data) / "catalog.json"
    return catalog.Dataset.of(json.loads(declared.read_text())) if declared.exists() else STAR


def _catalog(spark: SparkSession, data: str):
    declared = _dataset(data)
    tables = {name: table(spark, data, name) for name in declared.tables}
    return tables, declared.catalog(tables)


def _shadow(spark: SparkSession, tables, a):
    declared = _dataset(a.data)
    name, column, months = a.holdout or declared.holdout
    cutoff = profile.cutoff(tables[name], column, int(months))
    return cutoff, shadow.session_of(spark, shadow.clamp(tables, name, column, cutoff, declared.foreign_keys))


def ingest(spark, a) -> int:
    """Load the tables of a configuration, note its keys, indexes and holdout beside them, and report how far the keys hold."""
    config = json.loads(Path(a.config).read_text())
    counts = files.ingest(spark, config["tables"], config.get("columns", {}), a.data)
    declared = catalog.Dataset.of(config)
    (Path(a.data) / "catalog.json").write_text(declared.dump())
    tables, found = _catalog(spark, a.data)
    said = {"rows": counts, "fingerprint": found.fingerprint()}
    if declared.primary_keys:
        said["repeated_keys"] = {r.table_name: r.n_rows - r.n_keys for r in profile.key_duplicates(tables, found).collect()}
    if declared.foreign_keys:
        said["orphans"] = {r.fk: r.n_orphans for r in profile.orphans(tables, declared.foreign_keys).collect()}
    if declared.holdout:
        said["cutoff"] = profile.cutoff(tables[declared.holdout[0]], *declared.holdout[1:])
    print(json.dumps(said))
    return 0


def show_profile(spark, a) -> int:
    tables, found = _catalog(spark, a.data)
    cutoff, _ = _shadow(spark, tables, a)
    print(json.dumps({"tables": {n: found.tables[n].rows for n in found.names()}, "ddl_sha256": found.ddl_sha256(), "fingerprint": found.fingerprint(), "cutoff": cutoff}, indent=1))
    return 0


def author(spark, a) -> int:
    tables, found = _catalog(spark, a.data)
    full = shadow.session_of(spark, tables)
    _, clamped = _shadow(spark, tables, a)
    out = Path(a.out)
    if out.exists() and not a.force:
        print(f"{out} exists; --force replaces it", file=sys.stderr)
        return 1
    with out.open("w") as f:
        for i, c in enumerate(authoring.drafted(full, authoring.discover(tables, found, seed=a.seed), a.n, a.seed)):
            expected = validation.expected_rows(full, c.sql)
            split = "heldout" if validation.window_dependent(clamped, c.sql, expected["sha256"]) else "train_ok"
            row = {"id": f"q{i:04d}", "question": c.question, "gold_sql": c.sql, "expected_rows": expected, "date": "", "difficulty": c.difficulty, "category": c.category, "split": split, "source": "template+human-verified"}
            f.write(json.dumps(row) + "\n")
    return 0


def _questions(path: str) -> list[dict]:
    return [json.loads(x) for x in Path(path).read_text().splitlines() if x.strip()]


def validate(spark, a) -> int:
    tables, found = _catalog(spark, a.data)
    cutoff, clamped = _shadow(spark, tables, a)
    questions = _questions(a.questions)
    report = validation.validate(shadow.session_of(spark, tables), questions, clamped)
    for x in report.excluded:
        print(f"excluded {x.question_id}: {x.check}: {x.detail}")
    if report.clean:
        print(json.dumps(validation.manifest(questions, found.fingerprint(), cutoff, 1), indent=1))
    return 0 if report.clean else 1


def _ranked(spark, a):
    tables, found = _catalog(spark, a.data)
    caps = {k: int(v) for k, v in (x.split(":") for x in a.row_caps.split(",") if x)}
    docs = retrieval.index_docs({t: tables[t] for t in (a.tables.split(",") if a.tables else tables)}, found, caps)
    asked = spark.createDataFrame([(q["id"], q["question"], q["gold_sql"], q["split"]) for q in _questions(a.questions)], "question_id string, question string, gold_sql string, split string")
    return found, docs, asked, retrieval.bm25(asked.select("question_id", "question"), docs)


def retrieve(spark, a) -> int:
    found, docs, asked, ranked = _ranked(spark, a)
    files.freeze_packs(retrieval.packs(asked.select("question_id", "question"), ranked, docs, found.ddl_sha256()), a.out)
    return 0


def triples(spark, a) -> int:
    found, docs, asked, ranked = _ranked(spark, a)
    positives = ranked.where("rank <= 4").select("question_id", "table_name", "row_id")
    draws = corpus.kinds(asked, a.per_question, a.seed)
    negatives = corpus.distractors(draws, positives, docs.select("table_name", "row_id"), a.seed)
    made = corpus.triples(asked.drop("split"), draws, positives, negatives, retrieval.rendered(docs).select("table_name", "row_id", "row_text"), found.ddl(), a.seed)
    files.write_jsonl(made, a.out)
    print(json.dumps({r.kind: r.n_triples for r in corpus.ledger(spark.read.json(a.out)).collect()}))
    return 0


def evaluate_systems(spark, a) -> int:
    tables, found = _catalog(spark, a.data)
    asked = files.read_questions(spark, a.questions).where(F.col("split") == a.split).withColumnRenamed("id", "question_id")
    if asked.isEmpty():
        print(f"no '{a.split}' questions", file=sys.stderr)
        return 2
    systems = [s for s in evaluate.systems_of(Path(a.systems).read_text()) if not a.roles or s.role in a.roles.split(",")]
    if not systems:
        print(f"no systems with roles {a.roles}", file=sys.stderr)
        return 2
    packs = files.thaw_packs(spark, a.packs, T.StructType.fromDDL(retrieval.PACK)).join(asked.select("question_id"), "question_id", "left_semi")
    for s in evaluate.evaluate(spark, shadow.session_of(spark, tables), systems, asked, packs, found.ddl(), a.out, authoring.to_spark, a.resume):
        print(f"{s['system']}: EX {s['ex_heldout']:.3f}, flips {s['flip_rate']:.3f}, refusals {s['refusal_rate']:.3f}, failures {s['n_failures']}")
    return 0


def show_report(spark, a) -> int:
    try:
        text, failures = report.report_run(spark, a.run, Path(a.data).name)
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return 2
    (Path(a.run) / "report.md").write_text(text)
    print(text)
    print(json.dumps({"failures": failures}))
    return 0


def all_stages(spark, a) -> int:
    """Every stage into one folder: questions, packs, triples, runs, report. Stops at the first that fails."""
    out = Path(a.out)
    out.mkdir(parents=True, exist_ok=True)
    a.questions, a.packs, a.run = str(out / "questions.jsonl"), str(out / "packs"), str(out / "run")
    stages = (("profile", show_profile, None), ("author", author, a.questions), ("validate", validate, None), ("retrieve", retrieve, a.packs), ("triples", triples, str(out / "triples")), ("eval", evaluate_systems, a.run), ("report", show_report, None))
    for name, stage, target in stages:
        a.out = target or a.out
        if code := stage(spark, a):
            print(f"stopped at {name}", file=sys.stderr)
            return code
    return 0


def sql(spark, a) -> int:
    tables, _ = _catalog(spark, a.data)
    found = guard.safe_execute(shadow.session_of(spark, tables), authoring.to_spark(a.text))
    print("\t".join(found.columns), *("\t".join(map(str, r)) for r in found.rows), sep="\n") if found.success else print(found.error, file=sys.stderr)
    return 0 if found.success else 1


def run(spark, a) -> int:
    catalogue.queries()[a.query](spark, a.data).write.mode("overwrite").parquet(a.out)
    return 0


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tallyglass", description=__doc__)
    verbs = parser.add_subparsers(dest="verb", required=True)
    verbs.add_parser("version")
    for name, f in (("ingest", ingest), ("profile", show_profile), ("author", author), ("validate", validate), ("retrieve", retrieve), ("triples", triples), ("eval", evaluate_systems), ("report", show_report), ("all", all_stages), ("sql", sql), ("run", run)):
        p = verbs.add_parser(name)
        p.set_defaults(f=f)
        p.add_argument("--data", required=True)
        p.add_argument("--holdout", nargs=3, metavar=("TABLE", "COLUMN", "MONTHS"))
        p.add_argument("--seed", type=int, default=1)
        needed = (
            ("--config", "ingest"), ("--questions", "validate retrieve triples eval"), ("--out", "author retrieve triples eval all run"), ("--text", "sql"), ("--query", "run"),
            ("--packs", "eval"), ("--systems", "eval all"), ("--run", "report"),
        )
        for flag, verbs_ in needed:
            if name in verbs_.split():
                p.add_argument(flag, required=True)
        p.add_argument("--n", type=int, default=20)
        p.add_argument("--force", action="store_true")
        p.add_argument("--row-caps", default="")
        p.add_argument("--tables", default="")
        p.add_argument("--per-question", type=int, default=8)
        p.add_argument("--split", default="heldout")
        p.add_argument("--roles", default="")
        p.add_argument("--resume", action="store_true", help="go on with a run that was killed")
    a = parser.parse_args(argv)
    if a.verb == "version":
        print(__version__)
        return 0
    return a.f(spark or build_session("tallyglass"), a)


if __name__ == "__main__":
    sys.exit(main())
