"""Training triples: seeded draws, hard negatives, ledger, decontamination and mix.

Every draw is a hash of what it is drawn for and a seed, so it is the same at any partitioning and in any engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.session import held

#: Shares of the kinds of triples, in percent, and the texts of a prompt.
SHARES = (("grounded", 70), ("refusal", 15), ("schema_only", 15))
SYSTEM = "Answer with SQL and cite evidence rows as [table:row_id]; refuse when the evidence does not suffice."
#: Characters over which a text exceeds three quarters of a 4096-token context at four characters a token.
CONTEXT_CHARS = 12_288


def draw(*key: Column | str, seed: int) -> Column:
    """A number in [0, 2 ** 32) from the key and the seed."""
    parts = [F.lit(str(seed)), *[F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in key]]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def kinds(questions: DataFrame, per_question: int, seed: int) -> DataFrame:
    """question_id, draw_no, kind: `per_question` draws of each train_ok question, by SHARES."""
    rolled = questions.where(F.col("split") == "train_ok").select("question_id", F.explode(F.sequence(F.lit(0), F.lit(per_question - 1))).alias("draw_no"))
    roll, edge, kind = draw("question_id", "draw_no", seed=seed) % 100, 0, None
    for name, share in SHARES:
        edge += share
        kind = F.when(roll < edge, name) if kind is None else kind.when(roll < edge, name)
    return rolled.withColumn("kind", kind)


#: Primes by which a draw steps through numbered rows.
STEPS = (2_147_483_647, 2_147_483_629, 2_147_483_587, 2_147_483_579, 2_147_483_563)


def place(j: Column, size: Column, *key: Column | str, seed: int) -> Column:
    """The j-th of a seeded order of the numbers below `size`: a start and a step from the key, the step prime to the size."""
    at = draw(*key, F.lit("step"), seed=seed) % len(STEPS)
    steps = [F.array(*[F.lit(STEPS[(i + k) % len(STEPS)]) for k in range(len(STEPS))]) for i in range(len(STEPS))]
    turned = F.element_at(F.array(*steps), (at + 1).cast("int"))
    step = F.element_at(F.filter(turned, lambda p: size % p != 0), 1)
    return (draw(*key, F.lit("start"), seed=seed) + j.cast("decimal(38,0)") * step) % size


#: Rows of a bucket of ranks, about; a bucket is a beginning of the order's hexadecimal digits.
BUCKET_ROWS = 4096
#: Drawn buckets that are broadcast at most; more meet the rows in a shuffle.
BROADCAST_BUCKETS = 200_000


def at_ranks(drawn: DataFrame, rows: DataFrame, order: Column, sizes: DataFrame, ties: str = "row_id") -> DataFrame:
    """drawn (table_name, number, others) with the row that has that number, from 0, in its table's order: the columns of `rows`.

    `order` is a hexadecimal text, equal ones are numbered by the column `ties`; `sizes` has table_name, size. A directory of the rows in each bucket of
    the order says which bucket a number falls into; only those buckets' rows are numbered.
    """
    total = sizes.agg(F.max("size")).first()[0] or 0
    digits = 1
    while 16**digits * BUCKET_ROWS < total:
        digits += 1
    bucket = F.substring(order, 1, digits)
    counts = rows.groupBy("table_name", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    # prefix sums in two levels: over leading digits, then within them
    lead = F.substring("bucket", 1, digits // 2)
    counts = held(counts.withColumn("lead", lead))
    leads = counts.groupBy("table_name", "lead").agg(F.sum("n").alias("m"))
    before = lambda of, *by: F.coalesce(F.sum(of).over(Window.partitionBy("table_name", *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = leads.select("table_name", "lead", before("m", "lead").alias("above"))
    directory = counts.withColumn("inner", before("n", "lead", "bucket")).join(bases, ["table_name", "lead"])
    directory = directory.select("table_name", "bucket", (F.col("above") + F.col("inner")).alias("base"), "n")
    # numbers meet buckets in cells of equal width, of which a bucket covers few
    cells = F.sequence(F.floor(F.col("base") / BUCKET_ROWS), F.floor((F.col("base") + F.col("n") - 1) / BUCKET_ROWS))
    covered = directory.withColumn("cell", F.explode(cells)).withColumnRenamed("table_name", "t")
    within = (F.col("number") >= F.col("base")) & (F.col("number") < F.col("base") + F.col("n"))
    meets = (F.col("table_name") == F.col("t")) & (F.floor(F.col("number") / BUCKET_ROWS) == F.col("cell")) & within
    placed = held(drawn.join(covered, meets).drop("t", "cell", "n"))
    wanted = held(placed.select(F.col("table_name").alias("t"), F.col("bucket").alias("b"), "base").distinct())
    hint = "broadcast" if wanted.count() <= BROADCAST_BUCKETS else "shuffle_hash"
    tagged = rows.withColumns({"o": order, "bucket": bucket})
    some = tagged.join(wanted.hint(hint), (F.col("table_name") == F.col("t")) & (F.col("bucket") == F.col("b")))
    rank = F.row_number().over(Window.partitionBy("table_name", "bucket").orderBy("o", ties))
    numbered = some.withColumn("number", F.col("base") + rank - 1).select(*rows.columns, "number")
    return placed.drop("bucket", "base").join(numbered, ["table_name", "number"])


def distractors(draws: DataFrame, positives: DataFrame, rows: DataFrame, seed: int, low: int = 2, high: int = 5) -> DataFrame:
    """question_id, draw_no, table_name, row_id, position: hard negatives of each draw, never one of its question's positives.

    draws: question_id, draw_no, kind. positives: question_id, table_name, row_id. rows: table_name, row_id. A grounded
    draw gets low..high, a refusal as many as the question has positives and 3 at least, schema_only none; fewer only where
    there are no more rows. Rows of the positives' tables come before all others.

    Every row can be drawn: rows have numbers within their table, in the order of a hash, and a draw steps through the
    numbers of its near tables, laid end to end, in a seeded order of its own; as many numbers as it wants and its question
    has positives always hold enough. Then it steps through the other tables. Which rows have the drawn numbers, at_ranks()
    says; no other rows are numbered.
    """
    sizes = held(rows.groupBy("table_name").agg(F.count(F.lit(1)).alias("size")))
    per = positives.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_pos"), F.collect_set("table_name").alias("near"))
    tables = sizes.agg(F.sort_array(F.collect_list(F.struct("table_name", "size"))).alias("tables"))  # one element a table
    wanted = F.when(F.col("kind") == "grounded", low + draw("question_id", "draw_no", F.lit("n"), seed=seed) % (high - low + 1))
    wanted = wanted.when(F.col("kind") == "refusal", F.greatest(F.coalesce("n_pos", F.lit(0)), F.lit(3))).otherwise(0)
    asked = draws.join(per, "question_id", "left").withColumn("wanted", wanted).where("wanted > 0").join(F.broadcast(tables))
    near = F.coalesce("near", F.array().cast("array<string>"))
    group = lambda far, of, most: F.struct(F.lit(far).alias("far"), of.alias("of"), most.cast("long").alias("most"))
    groups = F.array(
        group(0, F.filter("tables", lambda t: F.array_contains(near, t["table_name"])), F.col("wanted") + F.coalesce("n_pos", F.lit(0))),
        group(1, F.filter("tables", lambda t: ~F.array_contains(near, t["table_name"])), F.col("wanted")),
    )
    each = asked.select("question_id", "draw_no", "wanted", F.inline(groups))
    each = each.withColumn("total", F.aggregate("of", F.lit(0).cast("long"), lambda s, t: s + t["size"])).where("total > 0")
    each = each.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("most"), F.col("total")) - 1)))
    each = each.withColumn("at", place(F.col("j"), F.col("total"), "question_id", "draw_no", "far", seed=seed).cast("long"))
    # the table in which the number falls, and the number within it
    begin = F.struct(F.lit(None).cast("string").alias("table_name"), F.col("at").alias("left"))

    def into(s: Column, t: Column) -> Column:
        here = s["table_name"].isNull() & (s["left"] < t["size"])
        passed = s["table_name"].isNull() & (s["left"] >= t["size"])
        return F.struct(F.when(here, t["table_name"]).otherwise(s["table_name"]).alias("table_name"), F.when(passed, s["left"] - t["size"]).otherwise(s["left"]).alias("left"))

    found = each.withColumn("in", F.aggregate("of", begin, into)).select("question_id", "draw_no", "wanted", "far", "j", F.col("in.table_name").alias("table_name"), F.col("in.left").alias("number"))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), "table_name", "row_id"))
    negative = at_ranks(found, rows.select("table_name", "row_id"), order, sizes).join(positives, ["question_id", "table_name", "row_id"], "left_anti")
    turn = Window.partitionBy("question_id", "draw_no").orderBy("far", "j")
    return negative.withColumn("position", F.row_number().over(turn)).where(F.col("position") <= F.col("wanted")).select("question_id", "draw_no", "table_name", "row_id", "position")


def triples(questions: DataFrame, draws: DataFrame, positives: DataFrame, negatives: DataFrame, row_texts: DataFrame, ddl: str, seed: int, cited: int = 2) -> DataFrame:
    """question_id, draw_no, kind, prompt, target, evidence_row_ids.

    Evidence is shown in a seeded order: positives and negatives for grounded, negatives for refusal, none for
    schema_only. The target cites the first positives, refuses, or gives the SQL alone.
    """
    grounded = draws.where("kind = 'grounded'").join(positives, "question_id").select("question_id", "draw_no", "table_name", "row_id")
    shown = grounded.unionByName(negatives.select("question_id", "draw_no", "table_name", "row_id")).join(row_texts, ["table_name", "row_id"])
    item = F.struct(draw("question_id", "draw_no", "row_text", seed=seed).alias("at"), "row_text", F.concat_ws(":", "table_name", "row_id").alias("id"))
    evidence = shown.groupBy("question_id", "draw_no").agg(F.sort_array(F.collect_list(item)).alias("e"))
    cites = positives.groupBy("question_id").agg(F.sort_array(F.collect_list(F.concat(F.lit("["), "table_name", F.lit(":"), "row_id", F.lit("]")))).alias("cites"))
    full = draws.join(questions, "question_id").join(evidence, ["question_id", "draw_no"], "left").join(cites, "question_id", "left")
    text = F.coalesce(F.array_join("e.row_text", "\n"), F.lit(""))
    prompt = F.concat(F.lit(f"{SYSTEM}\n\nSCHEMA:\n{ddl}\n\nQUESTION: "), "question", F.lit("\n\nRETRIEVED EVIDENCE:\n"), text)
    answer = F.concat(F.lit("SQL:\n"), "gold_sql", F.lit("\nANSWER:\n"), F.array_join(F.slice(F.coalesce("cites", F.array().cast("array<string>")), 1, cited), " "))
    target = F.when(F.col("kind") == "refusal", "REFUSAL: the evidence does not answer the question").when(F.col("kind") == "grounded", answer)
    target = target.otherwise(F.concat(F.lit("SQL:\n"), "gold_sql", F.lit("\nANSWER:\n")))
    return full.select("question_id", "draw_no", "kind", prompt.alias("prompt"), target.alias("target"), F.coalesce("e.id", F.array().cast("array<string>")).alias("evidence_row_ids"))


def ledger(made: DataFrame) -> DataFrame:
    """kind, n_triples, n_evidence (distinct rows)."""
    counts = made.groupBy("kind").agg(F.count(F.lit(1)).alias("n_triples"))
    rows = made.select("kind", F.explode("evidence_row_ids").alias("id")).groupBy("kind").agg(F.count_distinct("id").alias("n_evidence"))
    return counts.join(rows, "kind", "left").select("kind", "n_triples", F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"))


def invalid_triples(made: DataFrame) -> DataFrame:
    """Triples without an id, a prompt or a target."""
    missing = [F.coalesce(F.trim(c), F.lit("")) == "" for c in ("question_id", "kind", "prompt", "target")]
    return made.where(missing[0] | missing[1] | missing[2] | missing[3])


def over_context(made: DataFrame) -> DataFrame:
    """Triples flagged as longer than the context budget; none is dropped."""
    return made.withColumn("over_context", F.length("prompt") + F.length("target") > CONTEXT_CHARS)


#: Longest schema text of a training item.
SCHEMA_CHARS = 3_000


def executable_only(items: DataFrame, executed: DataFrame, want: int | None = None, longest: int = SCHEMA_CHARS, seed: int = 1) -> DataFrame:
    """items (question_id, schema, ...) whose gold ran, gave at least one row, and whose schema text is short enough.

    executed: question_id, error, n_rows. want: the feature's own limit, the first so many in a seeded order; None keeps all.
    """
    ran = executed.where("error IS NULL AND n_rows > 0").select("question_id").distinct()
    kept = items.where(F.length("schema") <= longest).join(ran, "question_id", "left_semi")
    return kept if want is None else seeded_order(kept, "question_id", seed, want)


def folded(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def decontaminate(train: DataFrame, held: DataFrame) -> DataFrame:
    """Training rows whose folded text is none of the evaluation texts; both have `text`."""
    return train.join(held.select(folded(F.col("text")).alias("__t")).distinct(), folded(F.col("text")) == F.col("__t"), "left_anti")


def keep_first(rows: DataFrame, by: Column, order: str) -> DataFrame:
    """The first row, by `order`, of each value of `by`; as an aggregate, so copies combine before the shuffle."""
    picked = rows.groupBy(by.alias("__by")).agg(F.min_by(F.struct(*rows.columns), F.col(order)).alias("r"))
    return picked.select("r.*")


def seeded_order(rows: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """`n` rows, the first by a seeded hash: a shuffle and limit that any engine repeats."""
    return rows.withColumn("__at", draw(key, seed=seed)).orderBy("__at", key).limit(n).drop("__at")
