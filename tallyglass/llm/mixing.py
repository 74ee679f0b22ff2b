"""Mixing sources to target weights by hierarchical budgeting.

Leaves are the (domain, language, source) triples of the corpus. A token budget flows down the tree: at each node it is
divided among the children in proportion to their target weights, no child getting more than its capacity (its tokens
times `max_epochs`); what a child cannot use goes to its siblings in proportion to theirs. A node's capacity is the sum
of its children's, so a shortage leaves a subtree only once no sibling below can take it. The level at which a node's
children saturate is found in closed form from cumulative sums over the children, ordered by capacity per weight.

A leaf's budget is filled from seeded epochs: epoch e holds all of the leaf's documents in the order of
md5(seed:e:doc_id), rows without a doc_id by a hash of their text in its place. Full epochs are taken whole; of the last one the longest prefix is taken whose tokens fit.
Prefix sums are made in two levels (buckets of the leading hash digits, then within a bucket), so a leaf with a third
of all rows is summed by many tasks.

Everything is DataFrame code; no Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.llm.common import fresh, located, materialize, text_of

LEAF = ("domain", "lang", "source")


@dataclass(frozen=True)
class Mix:
    """Target weights by name at each level (a name not listed has `other`), the budget and the draw.

    budget: tokens; where None, `share` of the corpus's tokens. domains: how many groups sources are hashed into where
    the documents have no domain of their own.
    """

    domain_weights: dict[str, float] = field(default_factory=dict)
    lang_weights: dict[str, float] = field(default_factory=dict)
    source_weights: dict[str, float] = field(default_factory=dict)
    other: float = 1.0
    budget: int | None = None
    share: float = 0.7
    max_epochs: int = 2
    seed: int = 17
    domains: int = 4
    #: Rows of a leaf for each bucket of the order hash; a bucket is named by at least two leading hexadecimal digits.
    bucket_rows: int = 1 << 18


def token_count() -> Column:
    """Words of the text, `[^\\x20\\x09-\\x0D]+`."""
    return F.size(F.filter(F.split(text_of(), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def domain_of(source: Column, domains: int) -> Column:
    """A group of sources, by the first eight hexadecimal digits of md5 of the name."""
    return F.concat(F.lit("d"), (F.conv(F.substring(F.md5(source), 1, 8), 16, 10).cast("long") % domains).cast("string"))


def weight(level: str, names: dict[str, float], other: float) -> Column:
    """The target weight of a name; weights at or under zero get no budget."""
    found = F.lit(other)
    for name, w in sorted(names.items()):
        found = F.when(F.col(level) == name, F.lit(float(w))).otherwise(found)
    return F.greatest(found, F.lit(0.0))


def divide(children: DataFrame, parent: list[str], child: str) -> DataFrame:
    """`children` (parent, child, w, capacity, given) with `budget`: the parent's `given` divided by weight under the capacities.

    In the order of capacity per weight a child is full when what the fuller ones leave, divided by the weights from it
    on, gives it its capacity at least; all others share what is left at one level. Past the first child that is not full
    the quotient only falls, so the level is its maximum over those that are not.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("w"), child)
    upto, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    positive = children.where("w > 0 AND capacity > 0")
    at = positive.withColumn("left", F.col("given") - F.coalesce(F.sum("capacity").over(upto), F.lit(0))).withColumn("weights", F.sum("w").over(after))
    at = at.withColumn("full", F.col("capacity") * F.col("weights") <= F.col("left") * F.col("w"))
    level = F.max(F.when(~F.col("full"), F.col("left") / F.col("weights"))).over(Window.partitionBy(*parent))
    return at.withColumn("budget", F.when(F.col("full"), F.col("capacity").cast("double")).otherwise(level * F.col("w"))).drop("left", "weights", "full")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """leaves (domain, lang, source, tokens) with `budget` tokens each; leaves without budget are left out."""
    leaves = leaves.withColumn("capacity", F.col("tokens") * mix.max_epochs)
    given = F.lit(float(mix.budget if mix.budget is not None else (leaves.agg(F.sum("tokens")).first()[0] or 0) * mix.share))
    by_domain = leaves.groupBy("domain").agg(F.sum("capacity").alias("capacity")).withColumn("w", weight("domain", mix.domain_weights, mix.other))
    by_domain = by_domain.select("domain", "capacity", "w", given.alias("given"), F.lit(0).alias("tree"))
    domain = divide(by_domain, ["tree"], "domain").select("domain", F.col("budget").alias("given"))
    by_lang = leaves.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity")).withColumn("w", weight("lang", mix.lang_weights, mix.other))
    lang = divide(by_lang.join(domain, "domain"), ["domain"], "lang").select("domain", "lang", F.col("budget").alias("given"))
    by_source = leaves.withColumn("w", weight("source", mix.source_weights, mix.other))
    return divide(by_source.join(lang, ["domain", "lang"]), ["domain", "lang"], "source").select(*LEAF, "tokens", F.floor(F.col("budget") + 1e-6).alias("budget"))


def described(docs: DataFrame, mix: Mix, *more: str) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, ident of each row, and the columns `more`; null names count as the name ''."""
    domain = F.col("domain").cast("string") if "domain" in docs.columns else domain_of(F.coalesce("source", F.lit("")), mix.domains)
    named = [F.coalesce(domain, F.lit("")).alias("domain"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in LEAF[1:])]
    ident = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.concat(F.lit("t"), F.md5(text_of())))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *named, token_count().alias("n_tokens"), ident.alias("ident"), *more)


def _taken(docs: DataFrame, mix: Mix, *more: str) -> DataFrame:
    """mix_sources() with the columns `more`, by which tied rows are ordered at last."""
    rows = materialize(described(docs, mix, *more), "mix-rows")
    leaves = materialize(rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("size")), "mix-leaves")
    buckets, digits = (leaves.agg(F.max("size")).first()[0] or 0) / mix.bucket_rows, 2
    while 16**digits < buckets:
        digits += 1
    shares = materialize(budgets(leaves.drop("size"), mix), "mix-budgets")
    full = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0)
    epochs = shares.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.least(full, F.lit(mix.max_epochs - 1)).cast("int"))))
    epochs = epochs.select(*LEAF, "epoch", F.least("tokens", F.col("budget") - F.col("epoch") * F.col("tokens")).alias("room"))

    key = F.md5(F.concat_ws(":", F.lit(str(mix.seed)), F.col("epoch").cast("string"), F.col("ident")))
    drawn = rows.join(epochs, list(LEAF)).withColumn("key", key).withColumn("bucket", F.substring("key", 1, digits))
    part = [*LEAF, "epoch", "bucket"]
    sums = drawn.groupBy(*part).agg(F.sum("n_tokens").alias("n"))
    before = Window.partitionBy(*LEAF, "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy(*part).orderBy("key", "n_tokens", *more).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = drawn.withColumn("upto", F.sum("n_tokens").over(within)).join(bases, part)
    return running.where(F.col("upto") + F.col("base") <= F.col("room")).select("doc_id", *LEAF, "n_tokens", "epoch", *more)


def mix_sources(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row per taken document and epoch: doc_id, domain, lang, source, n_tokens, epoch.

    Documents without tokens cost nothing and are taken where they come before the cut; a leaf of such alone has no budget. Rows that
    repeat a doc_id within a leaf are tied in the order and then ordered by size; a row without a doc_id is ordered by its text.
    Columns other than doc_id, text, lang, source and domain are ignored. An empty table gives no rows.
    """
    return _taken(docs, mix)


def keep_mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """`docs` with each row as often as the mix takes it, repeated rows each for themselves; columns unchanged."""
    at, of, copies, copy = fresh(docs.columns, "at", "of", "copies", "copy")
    rows = located(docs, at)
    taken = _taken(rows, mix, at).groupBy(F.col(at).alias(of)).agg(F.count(F.lit(1)).cast("int").alias(copies))
    joined = rows.join(taken.hint("shuffle_hash"), F.col(at) == F.col(of))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
