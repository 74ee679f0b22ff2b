"""The bounded, driver-side parts of a question-answering session: intent, diagnosis, repair, events, state."""

from __future__ import annotations

import difflib
import json
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The five intents of a turn, and the words and phrases that tell them.
COMMANDS = ("exit", "quit", "q")
GREETINGS = (
    "hi", "hey", "hello", "hola", "yo", "sup", "good morning", "good afternoon", "good evening", "who are you", "what are you", "what can you do", "help",
)
CLOCK = ("what time", "current time", "what date", "todays date", "today's date", "what day is it")
ABOUT_TABLES = ("what tables", "list tables", "show tables", "database schema", "table list", "how many tables")
TERMS = (
    "customer", "customers", "order", "orders", "product", "products", "item", "items", "review", "reviews", "sales", "revenue", "price", "stock", "spent", "spending",
    "bought", "buy", "purchase", "purchases", "highest", "lowest", "average", "total", "sum", "count", "top", "tier", "platinum", "gold", "silver", "bronze", "country",
)
ASKS = (
    "who spent", "how many", "which customer", "which product", "list all", "show me all", "find all", "calculate the", "what is the total", "what are the top", "rank the",
)
COMMAND, CHAT, SYSTEM_STATE, METADATA, DATA = INTENTS = ("COMMAND", "CONVERSATIONAL", "REALTIME_SYS", "DB_META", "DB_QUERY")
#: Fixed value: characters that are neither of a word nor white space.
MARKS = r"[^\p{L}\p{N}_\s]"


def intent(text: Column, tables: Sequence[str] = ()) -> Column:
    """Which of INTENTS a turn has; names of tables count as terms. Whole turns decide first, then phrases, then words. Null is empty."""
    said = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""))
    bare = F.regexp_replace(said, MARKS, "")
    any_of = lambda phrases: F.exists(F.array(*map(F.lit, phrases)), lambda p: said.contains(p))
    terms = F.array(*map(F.lit, [*TERMS, *(t.lower() for t in tables)]))
    tells = (
        (COMMAND, said.startswith(":") | said.isin(*COMMANDS)),
        (CHAT, bare.isin(*GREETINGS)),
        (SYSTEM_STATE, any_of(CLOCK)),
        (METADATA, any_of(ABOUT_TABLES)),
        (DATA, F.arrays_overlap(F.split(bare, r"\s+"), terms) | any_of(ASKS)),
    )
    return F.coalesce(*[F.when(holds, label) for label, holds in tells], F.lit(CHAT))


#: Error texts and what they are about.
DIAGNOSES = (
    ("unknown_column", r"UNRESOLVED_COLUMN|no such column|column .* (?:does not exist|cannot be resolved)"),
    ("unknown_table", r"TABLE_OR_VIEW_NOT_FOUND|no such table|relation .* does not exist|unknown relation"),
    ("ambiguous", r"AMBIGUOUS_REFERENCE|ambiguous"),
    ("syntax", r"PARSE_SYNTAX_ERROR|does not parse|syntax error"),
    ("grouping", r"MISSING_AGGREGATION|MISSING_GROUP_BY|must appear in the group by"),
    ("timeout", r"Timeout|exceeded"),
)


@dataclass(frozen=True)
class Diagnosis:
    kind: str
    name: str | None
    suggestions: list[str]


def diagnose(error: str, names: Sequence[str]) -> Diagnosis:
    """What went wrong, the name it is about, and the known names closest to it."""
    kind = next((k for k, pattern in DIAGNOSES if re.search(pattern, error, re.I)), "other")
    m = re.search(r"[`'\"]([A-Za-z_]\w*)[`'\"]", error)
    close = difflib.get_close_matches(m[1].lower(), [n.lower() for n in names], n=3, cutoff=0.5) if m else []
    return Diagnosis(kind, m[1] if m else None, close)


@dataclass
class Repair:
    """Attempts to mend one query, up to a budget; the model is a callable of the prompt."""

    question: str
    most: int = 3
    attempts: list[tuple[str, str]] = field(default_factory=list)
    repaired: bool = False

    def prompt(self, names: Sequence[str]) -> str:
        told = [f"Attempt {i}: {sql}\nError: {error}\nHint: {', '.join(diagnose(error, names).suggestions) or 'none'}" for i, (sql, error) in enumerate(self.attempts, 1)]
        return "\n\n".join([f"Question: {self.question}", *told, "Write a corrected query."])

    def run(self, sql: str, execute: Callable[[str], object], model: Callable[[str], str], names: Sequence[str] = ()):
        """The first outcome that succeeds, or the last. `execute` gives outcomes with success and error."""
        outcome = execute(sql)
        while not outcome.success and len(self.attempts) < self.most:
            self.attempts.append((sql, outcome.error))
            sql = model(self.prompt(names))
            outcome = execute(sql)
        self.repaired = outcome.success and bool(self.attempts)
        return outcome


def repair_stats(sessions: DataFrame) -> DataFrame:
    """n, attempted, repaired, rate from (attempts, repaired) of each session."""
    tried = F.col("attempts") > 0
    found = sessions.agg(F.count(F.lit(1)).alias("n"), F.count_if(tried).alias("attempted"), F.count_if("repaired").alias("repaired"))
    return found.withColumn("rate", F.when(F.col("attempted") > 0, F.round(F.col("repaired") / F.col("attempted"), 6)).otherwise(0.0))


@dataclass
class Events:
    """An append-only log with listeners; a listener that fails does not disturb the log."""

    log: list[dict] = field(default_factory=list)
    listeners: list[Callable[[dict], None]] = field(default_factory=list)

    def emit(self, kind: str, **details) -> None:
        event = {"event_type": kind, **details}
        self.log.append(event)
        for listener in self.listeners:
            try:
                listener(event)
            except Exception:  # noqa: BLE001,S110  (listeners are foreign code)
                pass

    def latency(self) -> dict[str, float]:
        total, n = defaultdict(float), Counter(e["event_type"] for e in self.log)
        for e in self.log:
            total[e["event_type"]] += e.get("latency_ms", 0.0)
        return {k: total[k] / n[k] for k in sorted(n)}


@dataclass
class Dialogue:
    """A session's turns with the tables and entities in play; goes to text and back."""

    turns: list[dict] = field(default_factory=list)
    tables: set[str] = field(default_factory=set)
    entities: list[str] = field(default_factory=list)

    def record(self, question: str, sql: str, rows: Sequence[Sequence], most: int = 10) -> None:
        self.turns.append({"question": question, "sql": sql, "sample": [list(map(str, r)) for r in rows[:5]]})
        self.tables |= {t.lower() for t in re.findall(r"\b(?:from|join)\s+([A-Za-z_]\w*)", sql, re.I)}
        for value in (v for r in rows[:3] for v in r if isinstance(v, str) and 2 <= len(v) <= 40):
            if value not in self.entities and len(self.entities) < most:
                self.entities.append(value)

    def dump(self) -> str:
        return json.dumps({"turns": self.turns, "tables": sorted(self.tables), "entities": self.entities})

    @classmethod
    def load(cls, text: str) -> Dialogue:
        d = json.loads(text)
        return cls(d["turns"], set(d["tables"]), d["entities"])
