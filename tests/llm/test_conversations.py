"""Conversation repair against a plain dynamic program over whole conversations, and the parser against it in segments."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tallyglass.llm import conversations, earley

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"
MOVES = {"start": [("s", "pair"), ("u", "a")], "pair": [("u", "a")], "a": [("a", "even")], "even": [("u", "a")]}


def cheapest(tokens):
    """(cost, audit) of (initial, cut, banned) tokens, by whole strings from each token and state on."""
    known = {}
    for i in range(len(tokens), -1, -1):
        now = {}
        for state, moves in MOVES.items():
            found = [(0, "")] if i == len(tokens) and state in ("start", "even") else []
            if i < len(tokens):
                initial, cut, banned = tokens[i]
                cost, audit = known[state]
                found.append((cost + 4, "D" + audit))
                for x, to in () if banned else moves:
                    cost, audit = known[to]
                    found += [(cost + 3 * cut, "K" + audit)] * (initial == x) + [(cost + 3 * cut + 3, "R" + audit)] * (x != "s")
            now[state] = min(found, default=(10**9, ""))
        for _ in MOVES:
            for state, moves in MOVES.items():
                for x, to in moves:
                    if x != "s":
                        now[state] = min(now[state], (now[to][0] + 3, "I" + now[to][1]))
        known = now
    return known["start"]


def repaired(rows, audit):
    """Lines that an audit leaves of (role, text) rows."""
    out, state, at = [], "start", 0
    for letter in audit:
        role, text = rows[at] if letter != "I" else (None, "")
        at += letter != "I"
        if letter == "D":
            continue
        moves = dict(MOVES[state])
        x = role[:1] if letter == "K" else next(x for x in moves if x != "s")
        state = moves[x]
        out.append((role if letter == "K" else {"u": "user", "a": "assistant"}[x]) + ":" + text)
    assert at == len(rows)
    return out


def tie(*parts):
    """The digest that orders turns of one number and role."""
    return hashlib.sha256("".join("-" if p is None else f"{len(str(p))}:{p}" for p in parts).encode()).hexdigest()


def expected(rows, originals):
    """conv_id -> the result of op13 for rows (conv_id, turn, role, text) after damage."""
    groups = defaultdict(list)
    for c, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        groups[c].append((turn is not None, turn or 0, role, text))
    out = {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for c in originals}
    for c, found in groups.items():
        found.sort(key=lambda r: (r[:3], tie(c, *r[2:])))
        numbers = {t for has, t, *_ in found if has}
        said, tokens, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in found:
            fault = None
            if not text.strip(SPACE):
                fault = "blank"
            elif (role, text) in said:
                fault = "duplicate"
            elif text.rstrip(SPACE)[-1] not in ".!?":
                fault = "truncated"
            said.add((role, text))
            if fault:
                faults[fault] += 1
            tokens.append((role[:1], fault == "truncated", fault in ("blank", "duplicate")))
        cost, audit = cheapest(tokens)
        lines = repaired([r[2:] for r in found], audit)
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(tokens, tokens[1:], strict=False))
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        out[c] = (gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def damage(rows):
    out = []
    for c, turn, role, text in rows:
        c_, turn_, role, text = (" " if x is None else x for x in (c, turn, role, text))
        fate = zlib.crc32(f"{c_}:{turn_}".encode()) % 20
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            out += [(c, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def result(df):
    rows = df.select(*COLUMNS).collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r[1:]) for r in rows}


@pytest.fixture(scope="module")
def rows():
    """Nulls in every column, blank and very long texts, ties, repeated rows, roles of other names, one long conversation."""
    rng = random.Random(3)
    texts = ["Yes.", "No!", "Why?", "cut off", " \t", "", None, "Ünï. ", "So be it.\n", "x" * 200_000 + "."]
    out = []
    for c in [*range(60), None]:
        for t in range(rng.randint(1, 9)):
            out.append((c, None if rng.random() < 0.05 else t + (rng.random() < 0.1), rng.choice(["user", "assistant", "system", "tool", "", None, "usher"]), rng.choice(texts)))
    out += out[:20]
    for t in range(700):  # crosses many segments
        out.append((500, t, ["user", "assistant", "system"][0 if rng.random() < 0.1 else 2 if rng.random() < 0.1 else t % 2], f"{rng.randint(0, 400)}" + rng.choice([".", "", "?"])))
    out += [(501, 1, "assistant", "again.")] * 90 + [(501, 5, "assistant", "again.")] * 3 + [(502, 3, "user", " ")]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("n", [1, 4, 37])
def test_repairs_equal_a_plain_dynamic_program(spark, rows, n):
    keep = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        table = spark.createDataFrame(rows, SCHEMA)
        got = result(conversations.repairs(table, table))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", keep)
    assert got == expected(rows, {r[0] for r in rows})


def test_damaged_conversations_of_a_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    got = result(conversations.repairs(conversations.damaged(table), table))
    assert got == expected(damage(rows), {r[0] for r in rows})
    assert sum(v[1] + v[2] + v[3] for v in got.values()) > 10 and any("R" in v[6] for v in got.values()) and any("I" in v[6] or "D" in v[6] for v in got.values())


def test_damage_of_nulls_and_clashing_columns(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA)
    wide = table.selectExpr("*", "1 AS segment", "2 AS key", "3 AS said", "4 AS fate", "5 AS copy", "6 AS n", "7 AS blank", "8 AS pos", "9 AS audit")
    assert result(conversations.repairs(conversations.damaged(wide), wide)) == expected(damage(rows), {r[0] for r in rows})


def test_an_empty_table_and_conversations_that_lost_all_turns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    named = spark.createDataFrame([(7, 0, "user", "Hi."), (None, None, None, None)], SCHEMA)
    assert conversations.repairs(empty, empty).count() == 0
    assert conversations.repair(empty).steps.count() == 0
    assert result(conversations.repairs(empty, named)) == expected([], {7, None})


def test_steps_name_roles_and_texts(spark):
    table = spark.createDataFrame([(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Bye."), (1, 3, "user", "")], SCHEMA)
    steps = [tuple(r) for r in conversations.repair(table).steps.orderBy("segment", "pos").select("edit", "times", "role", "text").collect()]
    assert steps == [("K", 1, "system", "Be kind."), ("I", 1, "user", ""), ("K", 1, "assistant", "Hello."), ("K", 1, "user", "Bye."), ("D", 1, None, None), ("I", 1, "assistant", "")]


@pytest.mark.parametrize("seed", range(5))
def test_a_parse_in_segments_equals_a_parse_of_all(seed):
    rng = random.Random(seed)
    end = earley.ends(dict.fromkeys(earley.EMPTY, 0))
    for _ in range(200):
        tokens = [earley.Token(rng.choice("suax"), rng.random() < 0.3, rng.random() < 0.2) for _ in range(rng.randint(0, 12))]
        value = earley.parse(tokens, end)[-1][earley.ALL]
        letters = "".join(e.letter for e in earley.chain(value.audit)[0])
        assert (value.cost, letters) == cheapest([t[:3] for t in tokens])
        at = rng.randint(0, len(tokens))
        back = earley.parse(tokens[at:], end)[-1]
        front = earley.parse(tokens[:at], earley.ends({n: v.cost for n, v in back.items()}))[-1][earley.ALL]
        first, way = earley.chain(front.audit)
        assert front.cost == value.cost and "".join(e.letter for e in first + earley.chain(back[way].audit)[0]) == letters
