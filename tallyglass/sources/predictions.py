"""Loading runs: predictions under many column names, evaluation items, splits, and the corpus's sources."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyglass.operators.corpus import draw, folded

#: Names under which a prediction file may hold each field.
ALIASES = {
    "idx": ("idx", "index", "id", "item"), "question": ("question", "prompt", "input"), "gold_sql": ("gold_sql", "gold", "reference", "target"),
    "pred_sql": ("pred_sql", "pred", "prediction", "output", "generated_sql"), "valid": ("valid", "valid_sql", "is_valid"),
    "exact": ("exact", "exact_match", "em"), "executed": ("executed", "exec_match", "execution_match", "ex"), "set": ("set", "split", "eval_set"),
}
TRUE, FALSE = ("true", "yes", "y", "1", "t"), ("false", "no", "n", "0", "f")


def plain_name(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", name.strip().lower()).strip("_")


def tolerant_bool(c: Column) -> Column:
    """Yes, no or null of a text in any usual spelling."""
    text = F.lower(F.trim(c.cast("string")))
    return F.when(text.isin(*TRUE), True).when(text.isin(*FALSE), False)


def ratio(c: Column) -> Column:
    """A share in [0, 1] from `87.5 %`, `87.5` or `0.875`."""
    text = F.trim(c.cast("string"))
    number = F.regexp_replace(text, r"[%\s]", "").try_cast("double")
    return F.when(text.contains("%") | (number > 1), number / 100).otherwise(number)


def _typed(found: Mapping[str, Column]) -> list[Column]:
    flags = ("valid", "exact", "executed")
    return [*[c.cast("string").alias(n) for n, c in found.items() if n not in flags], *[tolerant_bool(found[n]).alias(n) for n in flags]]


def normalised(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Predictions with the names of ALIASES, the first alias that is there, and the columns `keep`; what is missing is null."""
    have = {plain_name(c): c for c in raw.columns if c not in keep}
    found = {name: next((F.col(f"`{have[a]}`") for a in aliases if a in have), F.lit(None)) for name, aliases in ALIASES.items()}
    return raw.select(*_typed(found), *keep)


#: A line of a Markdown table, its cells' separator, and what stands for a line break in a cell.
ROW, SEPARATOR, BREAK = r"^\s*\|.*\|\s*$", r"(?<!\\)\|", r"(?i)<br\s*/?>"


def markdown_rows(texts: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Predictions of the tables of Markdown texts (value) that have a prediction's column, typed as normalised() types them.

    A table is the lines of one block that begin and end with a bar: names, a ruler, rows. Cells are trimmed, empty ones null,
    an escaped bar is a bar and <br> a line break. Tables of different files may have different columns.
    """
    blocks = texts.select(*keep, F.explode(F.split(F.regexp_replace("value", r"\r", ""), r"\n\s*\n")).alias("block"))
    lines = blocks.select(*keep, F.filter(F.split("block", "\n"), lambda x: x.rlike(ROW)).alias("lines")).where(F.size("lines") > 2)
    inner = lambda x: F.regexp_replace(x, r"^\s*\||\|\s*$", "")
    names = F.transform(F.split(inner(F.get("lines", F.lit(0))), SEPARATOR), lambda x: F.regexp_replace(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "_"), "^_+|_+$", ""))
    tables = lines.select(*keep, names.alias("names"), F.explode(F.slice("lines", F.lit(3), F.size("lines"))).alias("line"))
    tables = tables.where(F.arrays_overlap("names", F.array(*map(F.lit, ALIASES["pred_sql"]))))
    text = lambda x: F.nullif(F.trim(F.regexp_replace(F.regexp_replace(x, BREAK, "\n"), r"\\\|", "|")), F.lit(""))
    cells = F.transform(F.split(inner(F.col("line")), SEPARATOR), text)
    rows = tables.select(*keep, "names", cells.alias("cells"))
    of = lambda name: F.when(F.array_position("names", name) > 0, F.get("cells", (F.array_position("names", name) - 1).cast("int")))
    return rows.select(*_typed({name: F.coalesce(*map(of, aliases)) for name, aliases in ALIASES.items()}), *keep)


def read_predictions(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """JSON (lines or one document), CSV or Markdown files of predictions, with the run and set of `<system>__<set>.json` file names."""
    kind = lambda p: {"csv": "csv", "md": "md"}.get(p.rpartition(".")[2].lower(), "json")
    by = {k: [p for p in paths if kind(p) == k] for k in ("csv", "md", "json")}
    file, out = F.col("_metadata.file_name").alias("__file"), []
    if by["csv"]:
        out.append(normalised(spark.read.options(header=True, multiLine=True, escape='"').csv(by["csv"]).select("*", file), ["__file"]))
    if by["md"]:
        out.append(markdown_rows(spark.read.text(by["md"], wholetext=True).select("value", file), ["__file"]))
    if by["json"]:
        out.append(normalised(spark.read.option("multiLine", any(p.endswith(".json") for p in by["json"])).json(by["json"]).select("*", file), ["__file"]))
    part = F.regexp_extract("__file", r"__(.*?)\.", 1)
    named = reduce(DataFrame.unionByName, out).withColumn("system", F.regexp_extract("__file", r"^(.*?)(?:__|\.)", 1))
    return named.withColumn("set", F.coalesce("set", F.when(part != "", part), F.lit("in_dist"))).drop("__file")


def resolved(items: DataFrame, predictions: DataFrame) -> DataFrame:
    """Items with their predictions by (set, idx); more predictions than items of a set are an error, fewer leave items out."""
    extra = predictions.join(items, ["set", "idx"], "left_anti")
    if not extra.isEmpty():
        raise ValueError(f"predictions without items: {extra.count()}")
    return items.join(predictions, ["set", "idx"])


def carved(rows: DataFrame, n: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(test, train): the first n questions of a seeded order, and the rest without any of their texts."""
    order = rows.withColumn("__at", draw("question", seed=seed)).orderBy("__at", "question").limit(n)
    test = order.drop("__at")
    held = test.select(folded(F.col("question")).alias("__q")).distinct()
    return test, rows.join(held, folded(F.col("question")) == F.col("__q"), "left_anti")


def overlap(train: DataFrame, held: DataFrame) -> float:
    """Percent of held-out questions whose folded text is in the training rows."""
    a = train.select(folded(F.col("question")).alias("q")).distinct()
    b = held.select(folded(F.col("question")).alias("q")).distinct()
    n = b.count()
    return 100.0 * b.join(a, "q", "left_semi").count() / n if n else 0.0


def mixed(sources: Mapping[str, DataFrame], filters: Mapping[str, Callable[[DataFrame], DataFrame]], sizes: Mapping[str, int], seed: int = 1) -> DataFrame:
    """Rows of all sources: each source's filter, then its first rows in a seeded order, tagged with its name."""
    parts: Iterable[DataFrame] = [
        filters.get(name, lambda d: d)(df).withColumn("__at", draw("question", seed=seed)).orderBy("__at", "question").limit(sizes[name]).drop("__at").withColumn("source", F.lit(name))
        for name, df in sorted(sources.items())
    ]
    first, *rest = parts
    for df in rest:
        first = first.unionByName(df)
    return first
