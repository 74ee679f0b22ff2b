"""Conversations are made to alternate again: the cheapest edits by an error-correcting Earley parse of their roles.

Roles must read `(s?(ua)+)?` by their initials. Turns that are blank or said before must go, turns that break off cost
more to keep, and the parser (earley.py) deletes, re-labels and inserts turns at the least cost; of equally cheap repairs
the one whose letters come first is taken.

No conversation has to fit into a task. Turns are described without their texts, equal turns are counted before
anything is shuffled, and the descriptions are ordered by range over (conversation, turn), so a long conversation is cut into
segments, one a partition. Only conversations that cross a partition's border, one a border at most, need more than one
pass: each segment gives the cost from every nonterminal to every other, these tables (16 numbers a segment) are combined
from the last segment back, and each segment is then parsed again knowing what follows it. Texts are shuffled once, by the
digest of their turn, to meet the edits that keep them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyglass.llm import earley
from tallyglass.llm.common import lean, materialize, shuffle_partitions

#: Groups of turns said before that are broadcast at most (a digest and a turn each); more are shuffled.
BROADCAST_SAID = 200_000

BLANK = r"^[\x20\x09-\x0D]*$"
#: A text is whole if its last character that is no space ends a sentence.
WHOLE = r"[.!?][\x20\x09-\x0D]*$"
#: Pairs of neighbouring role initials that may be.
LEGAL = ("su", "ua", "au")

NEVER = 1 << 60
ORDER = ("conv_id", "turn", "role", "said")
PIECE = "segment int, conv_id long"
COSTS = ", ".join(f"{n} long" for n in earley.NONTERMINALS)


def digest(*parts: Column) -> Column:
    """SHA-256 of texts of which each stands with its length; null and empty differ."""
    known = [F.coalesce(F.concat(F.char_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]
    return F.unhex(F.sha2(F.concat(*known), 256))


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, key (digest of all), said (digest of all but the turn); a null role or text is one space."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    return rows.withColumns({"said": digest(conv, F.col("role"), F.col("text")), "key": digest(conv, turn, F.col("role"), F.col("text"))})


def described(rows: DataFrame) -> DataFrame:
    """One row for all equal turns: ORDER, key, n, blank, cut, late (another turn said it first)."""
    facts = rows.select("conv_id", "turn", "role", "said", "key", F.col("text").rlike(BLANK).alias("blank"), (~F.col("text").rlike(WHOLE)).alias("cut"))
    counted = materialize(facts.groupBy(*facts.columns).agg(F.count(F.lit(1)).alias("n")), "turns")
    place = F.struct(F.col("turn").isNotNull().alias("has"), "turn")
    again = counted.groupBy("said").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").select(F.col("said").alias("before"), "first")
    again = materialize(again, "turns-said")
    hint = "broadcast" if again.count() <= BROADCAST_SAID else "merge"  # rows of a frequent turn are split by AQE
    joined = counted.join(again.hint(hint), F.col("said") == F.col("before"), "left")
    return joined.withColumn("late", F.coalesce(place > F.col("first"), F.lit(False))).drop("before", "first")


class Piece(NamedTuple):
    """The turns of a conversation in one segment; costs of what follows (None: nothing does), and where the chosen repair enters."""

    segment: int
    conv_id: int | None
    after: dict[str, int] | None
    entry: str | None
    rows: list[dict]

    def tokens(self) -> list[tuple[int, earley.Token]]:
        """Tokens with the numbers of their rows: of equal turns the first may stay, if nobody said it before."""
        out = []
        for i, r in enumerate(self.rows):
            may = not r["blank"] and not r["late"]
            initial = r["role"][:1]
            if may:
                out.append((i, earley.Token(initial, r["cut"])))
            if r["n"] > may:
                out.append((i, earley.Token(initial, banned=True, times=r["n"] - may)))
        return out

    def parse(self, after: dict[str, int]) -> list[dict[str, earley.Value]]:
        return earley.parse([t for _, t in self.tokens()], earley.ends(after))

    def follows(self) -> dict[str, int]:
        return dict.fromkeys(earley.EMPTY, 0) if self.after is None else self.after


def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[Piece]:
    """Runs of rows with one segment and conversation; rows come in ORDER within each segment."""
    held: list[dict] = []
    name = lambda r: (r["segment"], r["conv_id"])

    def piece() -> Piece:
        r = held[0]
        known = {k: r[k] for k in earley.NONTERMINALS if r.get(k) is not None}
        return Piece(*name(r), {k: v for k, v in known.items() if v < NEVER} if known else None, r.get("entry"), held)

    for batch in batches:
        for row in batch.to_pylist():
            if held and name(row) != name(held[0]):
                yield piece()
                held = []
            held.append(row)
    if held:
        yield piece()


def _table(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _arrow(*fields: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema(list(fields))


def crossings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each piece and each nonterminal that may follow it, the cost of each nonterminal at its beginning."""
    schema = _arrow(("segment", pa.int32()), ("conv_id", pa.int64()), ("following", pa.string()), *[(n, pa.int64()) for n in earley.NONTERMINALS])

    def rows() -> Iterator[tuple]:
        for p in pieces(batches):
            for name in earley.NONTERMINALS:
                front = p.parse({name: 0})[-1]
                yield p.segment, p.conv_id, name, *[front[n].cost if n in front else NEVER for n in earley.NONTERMINALS]

    return _table(rows(), schema)


def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each piece, which nonterminal the best repair that enters at each nonterminal leaves at."""
    schema = _arrow(("segment", pa.int32()), ("conv_id", pa.int64()), *[(n, pa.string()) for n in earley.NONTERMINALS])

    def rows() -> Iterator[tuple]:
        for p in pieces(batches):
            front = p.parse(p.follows())[-1]
            yield p.segment, p.conv_id, *[earley.chain(front[n].audit)[1] if n in front else None for n in earley.NONTERMINALS]

    return _table(rows(), schema)


def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of each piece in order: key of the turn they are about, letter, times, the role that they leave, cost, initial of the turn, illegal pairs within the piece."""
    schema = _arrow(
        ("segment", pa.int32()), ("conv_id", pa.int64()), ("pos", pa.int64()), ("key", pa.binary()), ("edit", pa.string()), ("times", pa.int64()), ("role", pa.string()),
        ("cost", pa.int64()), ("initial", pa.string()), ("illegal", pa.int64()),
    )

    def rows() -> Iterator[tuple]:
        for p in pieces(batches):
            tokens = p.tokens()
            done, _ = earley.chain(p.parse(p.follows())[-1][p.entry or earley.ALL].audit)
            before = None
            for pos, e in enumerate(done):
                if e.letter == "I":
                    yield p.segment, p.conv_id, pos, None, "I", 1, earley.ROLES[e.role], earley.INSERT, None, 0
                    continue
                i, token = tokens[e.token]
                row, initial = p.rows[i], token.initial
                illegal = (before is not None and before + initial not in LEGAL) + (token.times - 1) * (initial * 2 not in LEGAL)
                before = initial
                role = row["role"] if e.letter == "K" else earley.ROLES.get(e.role)
                cost = earley.DELETE * token.times if e.letter == "D" else earley.CUT * token.cut + earley.REROLE * (e.letter == "R")
                yield p.segment, p.conv_id, pos, row["key"], e.letter, token.times, None if e.letter == "D" else role, cost, initial, illegal

    return _table(rows(), schema)


def backwards(following, tables):
    """pandas: costs of what follows each segment of a conversation, from the last segment back."""
    import pandas as pd

    out, v = [], dict.fromkeys(earley.EMPTY, 0)
    for segment, table in sorted(tables.groupby("segment"), key=lambda x: -x[0]):
        out.append({"segment": segment, **{n: v.get(n, NEVER) for n in earley.NONTERMINALS}})
        rows = table.set_index("following")
        v = {n: min(int(rows.loc[x, n]) + cost for x, cost in v.items()) for n in earley.NONTERMINALS}
        v = {n: c for n, c in v.items() if c < NEVER}
    found = pd.DataFrame(out)
    found.insert(1, "conv_id", pd.array([following[0]] * len(found), "Int64"))
    return found


def forwards(conversation, ways):
    """pandas: where the chosen repair enters each segment of a conversation."""
    import pandas as pd

    out, at = [], earley.ALL
    for row in ways.sort_values("segment").to_dict("records"):
        out.append({"segment": row["segment"], "conv_id": conversation[0], "entry": at})
        at = row[at]
    return pd.DataFrame(out).astype({"conv_id": "Int64"})


def ordered(rows: DataFrame) -> DataFrame:
    """A segment a task, in the order of its turns."""
    n = shuffle_partitions(rows.sparkSession)
    return rows.repartitionById(n, F.col("segment")).sortWithinPartitions("segment", *ORDER)


def planned(turns_: DataFrame) -> DataFrame:
    """The edits of described turns: segment, conv_id, pos, key, edit, times, role, cost, initial, illegal."""
    n = shuffle_partitions(turns_.sparkSession)
    dealt = turns_.repartitionByRange(n, *ORDER).withColumn("segment", F.spark_partition_id())
    dealt = materialize(dealt, "turns-dealt")
    # a conversation that has turns in several segments crosses a border, and each border has one at most
    across = dealt.groupBy("conv_id").agg(F.min("segment").alias("a"), F.max("segment").alias("b")).where("a < b").select(F.col("conv_id").alias("c"))
    across = materialize(across, "turns-across")
    schema = f"{PIECE}, pos long, key binary, edit string, times long, role string, cost long, initial string, illegal long"
    if across.isEmpty():
        return materialize(ordered(dealt).mapInArrow(lean(edits), schema), "edits")
    cut = ordered(dealt.join(F.broadcast(across), F.col("conv_id").eqNullSafe(F.col("c")), "left_semi"))
    tables = materialize(cut.mapInArrow(lean(crossings), f"{PIECE}, following string, {COSTS}"), "turns-crossings")
    after = materialize(tables.groupBy("conv_id").applyInPandas(backwards, f"{PIECE}, {COSTS}"), "turns-after")

    def known(rows: DataFrame, facts: DataFrame) -> DataFrame:
        """rows with the facts of their piece; there are two pieces a border at most, or one a segment."""
        facts = facts.withColumnsRenamed({"segment": "s", "conv_id": "c"})
        return rows.join(F.broadcast(facts), (F.col("segment") == F.col("s")) & F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("s", "c")

    ways = ordered(known(cut, after)).mapInArrow(lean(exits), ", ".join([PIECE, *[f"{n} string" for n in earley.NONTERMINALS]]))
    entered = materialize(ways.groupBy("conv_id").applyInPandas(forwards, f"{PIECE}, entry string"), "turns-entered")
    return materialize(ordered(known(known(dealt, after), entered)).mapInArrow(lean(edits), schema), "edits")


class Repair(NamedTuple):
    """What repair() gives."""

    steps: DataFrame
    summary: DataFrame


def repair(conversations: DataFrame) -> Repair:
    """steps: conv_id, segment, pos, edit, times, role, text: what is done, ordered by (segment, pos) in a conversation.
    summary: conv_id, gaps, blank, duplicate, truncated, illegal, cost, a row a conversation.

    `conversations` needs conv_id, turn, role and text; other columns are ignored, whatever their names. edit is K (keep), R
    (another role), D (delete; role and text are null; `times` equal turns) or I (insert; the text is empty). A null role or text is one
    space, so its turn is blank. Turns are in the order of turn (nulls first), then role, then a digest of the turn; equal
    rows are all but one duplicates. Null conv_ids are one conversation. Gaps ignore null turns. An empty table has no rows.
    """
    rows = turns(conversations)
    told = materialize(described(rows), "turns-told")
    plan = planned(told)
    texts = rows.groupBy("key").agg(F.any_value("text").alias("text"))  # equal turns meet before the shuffle
    named = ["conv_id", "segment", "pos", "edit", "times", "role"]
    kept = plan.where("edit IN ('K', 'R')").select(*named, "key").join(texts, "key").select(*named, "text")
    other = plan.where("edit IN ('D', 'I')").select(*named, F.when(F.col("edit") == "I", "").alias("text"))

    fault = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    stays = ~F.col("blank") & ~F.col("late")
    counts = told.groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"),
        fault(F.col("blank")).alias("blank"),
        F.sum(F.when(stays, F.col("n") - 1).when(~F.col("blank"), F.col("n")).otherwise(0)).alias("duplicate"),
        F.sum(F.when(stays & F.col("cut"), 1).otherwise(0)).alias("truncated"),
    )
    at = F.when(F.col("initial").isNotNull(), F.col("pos"))
    ends = plan.groupBy("conv_id", "segment").agg(
        F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"), F.min_by("initial", at).alias("a"), F.max_by("initial", at).alias("z")
    )
    last = F.lag("z").over(Window.partitionBy("conv_id").orderBy("segment"))  # a row a segment of a conversation
    joint = ends.withColumn("joint", F.coalesce((~F.concat(last, F.col("a")).isin(*LEGAL)).cast("long"), F.lit(0)))
    sums = joint.groupBy(F.col("conv_id").alias("c")).agg(F.sum("cost").alias("cost"), (F.sum("illegal") + F.sum("joint")).alias("illegal"))
    summary = counts.join(sums, F.col("conv_id").eqNullSafe(F.col("c")))
    names = ("blank", "duplicate", "truncated", "illegal", "cost")
    return Repair(kept.unionByName(other), summary.select("conv_id", F.coalesce("gaps", F.lit(0)).alias("gaps"), *[F.col(n).cast("long").alias(n) for n in names]))


def digested(steps: DataFrame) -> DataFrame:
    """conv_id, audit, repaired_sha256: the letters of a conversation's edits, and the SHA-256 of its repaired `role:text` lines.

    A SHA-256 is made from front to back, so the lines of a conversation pass through one task; they pass in order, from a
    sort that spills, and none is held.
    """
    schema = _arrow(("conv_id", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            conv, letters, lines, begun = None, [], 0, False
            state = hashlib.sha256()
            for batch in batches:
                for c, edit, times, role, text in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                    if begun and c != conv:
                        yield conv, "".join(letters), state.hexdigest()
                    if not begun or c != conv:
                        conv, letters, lines, begun, state = c, [], 0, True, hashlib.sha256()
                    letters.append(edit * times)
                    if edit != "D":
                        state.update(f"\n{role}:{text}".encode()[0 if lines else 1 :])
                        lines += 1
            if begun:
                yield conv, "".join(letters), state.hexdigest()

        return _table(rows(), schema)

    rows = steps.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "pos").select("conv_id", "edit", "times", "role", "text")
    return rows.mapInArrow(lean(run), "conv_id long, audit string, repaired_sha256 string")


def repairs(conversations: DataFrame, originals: DataFrame) -> DataFrame:
    """repair() and digested() of each conversation named in `originals` (conv_id); one without turns has zeros, no edits and the hash of nothing."""
    steps, summary = repair(conversations)
    named = originals.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    same = lambda other: F.col("conv_id").eqNullSafe(F.col(other))
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    found = named.join(summary.withColumnRenamed("conv_id", "c1"), same("c1"), "left").join(digested(steps).withColumnRenamed("conv_id", "c2"), same("c2"), "left")
    nothing = hashlib.sha256().hexdigest()
    values = [*[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers], F.coalesce("audit", F.lit("")).alias("audit")]
    return found.select("conv_id", *values, F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after a seeded damage: of twenty turns one is dropped, one emptied, one loses its sentence ends, one is said twice, one is given to the user."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    rows = conversations.select("conv_id", "turn", name("role").alias("role"), name("text").alias("text"), fate.alias("fate")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
    changed = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("fate") == 3, 2).otherwise(1).alias("times"))
    return changed.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(1), F.col("times"))).alias("copy")).drop("copy")
