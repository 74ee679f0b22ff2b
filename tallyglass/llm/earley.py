"""Error-correcting Earley parsing of role sequences.

The grammar is the one of a repaired conversation, `(s?(ua)+)?` over role initials, with productions for the errors: a
turn may be deleted, given another role, or a missing one inserted, each at a cost. It is read from the last turn to the
first: an audit (the letters of the edits, in order) then grows at its front, so of two equally cheap derivations of one
item the lesser audit is found by comparing from the front, and nothing is compared twice. Every chart item keeps its least
(cost, audit); audits are linked and share their tails.

A sequence may be parsed in segments. What lies after a segment enters its chart as the costs of the nonterminals
derived there; each audit ends in the nonterminal it continues.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

#: What a conversation derives to from some turn on: all of it, pairs of turns, one answer and then pairs or none, pairs or none.
ALL, PAIRS, ANSWER, REST = NONTERMINALS = ("All", "Pairs", "Answer", "Rest")
#: Nonterminals that derive the empty sequence.
EMPTY = (ALL, REST)
#: Costs of the edits, and of a cut-off text that is not deleted.
DELETE, REROLE, INSERT, CUT = 4, 3, 3, 3

ROLES = {"u": "user", "a": "assistant"}

#: Productions from the last turn to the first: left side, right side.
GRAMMAR = (
    (ALL, (ALL, "deleted")), (ALL, (PAIRS, "system")), (ALL, (ANSWER, "user")),
    (PAIRS, (PAIRS, "deleted")), (PAIRS, (ANSWER, "user")),
    (ANSWER, (ANSWER, "deleted")), (ANSWER, (REST, "assistant")),
    (REST, (REST, "deleted")), (REST, (ANSWER, "user")),
    ("deleted", ("D",)),
    ("system", ("Ks",)),
    ("user", ("Ku",)), ("user", ("Ru",)), ("user", ("Iu",)),
    ("assistant", ("Ka",)), ("assistant", ("Ra",)), ("assistant", ("Ia",)),
)


class Token(NamedTuple):
    """A turn, or `times` equal turns that must go."""

    initial: str
    cut: bool = False
    banned: bool = False
    times: int = 1


class Edit(NamedTuple):
    """One edit and those after it; `role` is the initial of what it leaves. The last one names the nonterminal that goes on."""

    letter: str
    role: str
    token: int
    rest: Edit | None


class Value(NamedTuple):
    cost: int
    audit: Edit


def ends(costs: Mapping[str, int]) -> dict[str, Value]:
    """The nonterminals that are derived after the last token, with their costs."""
    return {name: Value(cost, Edit("", name, -1, None)) for name, cost in costs.items()}


def less(a: Value, b: Value) -> bool:
    """Whether a is cheaper than b, or as cheap with an audit that comes before b's."""
    if a.cost != b.cost:
        return a.cost < b.cost
    x, y = a.audit, b.audit
    while x is not y:
        if x.letter != y.letter:
            return y.rest is not None and (x.rest is None or x.letter < y.letter)
        if x.rest is None or y.rest is None:
            return False
        x, y = x.rest, y.rest
    return False


class _Column:
    """Chart items of one place: (production, dot, origin) -> value, by the symbol that each waits for."""

    __slots__ = ("done", "items", "waiting")

    def __init__(self):
        self.items: dict[tuple[int, int, int], Value] = {}
        self.waiting: dict[str, list[tuple[int, int, int]]] = {}
        self.done: dict[str, Value] = {}


#: Productions of each nonterminal.
_OF: dict[str, list[int]] = {}
for _k, (_left, _) in enumerate(GRAMMAR):
    _OF.setdefault(_left, []).append(_k)
#: Whether a symbol is one of the edits.
_EDITS = {right[0] for _, right in GRAMMAR if len(right) == 1}


def _terminal(symbol: str, token: Token) -> int | None:
    """What an edit that reads this token costs; None where it cannot."""
    kind = symbol[0]
    if kind == "D":
        return DELETE * token.times
    if token.banned or kind == "I" or (kind == "K" and token.initial != symbol[1]):
        return None
    return (REROLE if kind == "R" else 0) + (CUT if token.cut else 0)


_FREE = Value(0, Edit("", "", -1, None))


def parse(tokens: Sequence[Token], after: Mapping[str, Value]) -> list[dict[str, Value]]:
    """For every place, from behind the last token to before the first, what each nonterminal costs from there on."""
    first = _Column()
    columns = {0: first}
    derived: list[dict[str, Value]] = []

    def put(column: _Column, agenda: list, item: tuple[int, int, int], value: Value) -> None:
        old = column.items.get(item)
        if old is None:
            production, dot, _ = item
            right = GRAMMAR[production][1]
            if dot < len(right):
                column.waiting.setdefault(right[dot], []).append(item)
        elif not less(value, old):
            return
        column.items[item] = value
        agenda.append(item)

    def finish(name: str, origin: int, value: Value, place: int, agenda: list, edit: str, token: int) -> None:
        """The completer: advance what waited for `name` where it began. An edit goes before the audit of what waited."""
        if name in NONTERMINALS:
            old = columns[place].done.get(name)
            if old is not None and not less(value, old):
                return
            columns[place].done[name] = value
        source = columns[origin]
        for item in source.waiting.get(name, ()):
            production, dot, begun = item
            if name in NONTERMINALS:
                advanced = value
            else:
                held = source.items[item]
                advanced = Value(held.cost + value.cost, Edit(edit[0], edit[1:], token, held.audit))
            put(columns[place], agenda, (production, dot + 1, begun), advanced)

    def close(place: int, agenda: list) -> None:
        """Predictor and completer until nothing gets better."""
        column, predicted = columns[place], set()
        while agenda:
            item = agenda.pop()
            production, dot, origin = item
            left, right = GRAMMAR[production]
            if dot == len(right):
                finish(left, origin, column.items[item], place, agenda, "", -1)
                continue
            symbol = right[dot]
            if symbol in _EDITS:
                continue
            if symbol not in predicted:
                predicted.add(symbol)
                for k in _OF[symbol]:
                    put(column, agenda, (k, 0, place), _FREE)
            for k in _OF[symbol]:  # an insertion reads nothing: what waits for it goes on at once
                edit = GRAMMAR[k][1][0]
                if edit[0] == "I":
                    held = column.items[item]
                    put(column, agenda, (production, dot + 1, origin), Value(held.cost + INSERT, Edit("I", edit[1:], -1, held.audit)))

    agenda: list = []
    for name in NONTERMINALS:
        for k in _OF[name]:
            put(first, agenda, (k, 0, 0), _FREE)
    agenda.clear()
    for name, value in after.items():
        finish(name, 0, value, 0, agenda, "", -1)
    close(0, agenda)
    derived.append(first.done)
    for back in range(len(tokens)):
        token, k = tokens[-1 - back], len(tokens) - 1 - back
        columns[back + 1] = column = _Column()
        agenda = []
        for symbol in _EDITS & columns[back].waiting.keys():
            if (cost := _terminal(symbol, token)) is not None:
                for production, _, origin in columns[back].waiting[symbol]:
                    finish(GRAMMAR[production][0], origin, Value(cost, _FREE.audit), back + 1, agenda, symbol, k)
        close(back + 1, agenda)
        derived.append(column.done)
        if back:
            del columns[back]  # an edit reads one token at most, so nothing waits here any more
    return derived


def chain(audit: Edit) -> tuple[list[Edit], str]:
    """The edits in the order of the conversation, and the nonterminal that goes on after the last of them."""
    found = []
    while audit.rest is not None:
        found.append(audit)
        audit = audit.rest
    return found, audit.role
