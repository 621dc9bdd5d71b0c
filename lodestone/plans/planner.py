"""Routes a question and, where it asks for a computed value, plans one aggregate: as a DataFrame, and as SQL to cite."""

from __future__ import annotations

import calendar
import re
from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.errors import PlanError
from lodestone.plans.lexicon import ISO, Lexicon, tokens

#: How strongly words ask for an aggregate.
CUES = {
    "how many": 1.0, "how much": 0.9, "number of": 0.9, "count": 0.9, "total": 0.85, "sum": 0.85, "average": 0.9, "avg": 0.9,
    "mean": 0.7, "median": 0.8, "highest": 0.8, "lowest": 0.8, "maximum": 0.85, "minimum": 0.85, "max": 0.7, "min": 0.7,
    "most": 0.6, "least": 0.6, "per": 0.5, "for each": 0.7, "each": 0.35, "breakdown": 0.8, "aggregate": 0.8, "grouped by": 0.8,
    "group by": 0.8, "overall": 0.4, "combined": 0.5, "altogether": 0.6, "in total": 0.9, "tally": 0.8,
}
#: What asks for the schema itself.
SCHEMA_CUES = ("what columns", "which columns", "what fields", "which fields", "what attributes", "which attributes", "columns does", "columns are in", "fields does", "schema of", "schema for", "structure of", "describe the", "what does the", "columns of", "fields of", "data type", "column types")
SUPERLATIVE = re.compile(r"(?i)\b(?:highest|lowest|largest|smallest|biggest|greatest|most|least|top|bottom)\b")
#: The words of each aggregate, in the order they're looked for.
AGGREGATES = (
    ("COUNT", ("how many", "number of", "count of", "count", "how much", "tally")),
    ("AVG", ("average", "avg", "mean", "typical")),
    ("SUM", ("total", "sum", "combined", "altogether", "in total")),
    ("MAX", ("maximum", "max", "highest", "largest", "biggest", "greatest", "most")),
    ("MIN", ("minimum", "min", "lowest", "smallest", "least")),
)
#: Words that a grouping follows; `by` does after one of DIVIDED.
DISTRIBUTIVE, DIVIDED = {"per", "each", "every"}, {"group", "grouped", "down", "split", "divided"}
MONTHS = {m.lower(): i for i, m in enumerate(calendar.month_name) if m} | {m.lower(): i for i, m in enumerate(calendar.month_abbr) if m} | {"sept": 9}


@dataclass(frozen=True)
class Route:
    name: str  # lookup, aggregate or hybrid
    confidence: float
    reason: str
    tables: tuple[str, ...] = ()
    schema_question: bool = False


def aggregate_score(question: str) -> float:
    line = f" {' '.join(tokens(question))} "
    return max((w for cue, w in CUES.items() if f" {cue} " in line), default=0.0)


def classify(question: str, lex: Lexicon | None = None) -> Route:
    """Schema questions look up a card; two tables or more are hybrid; a cue of half or a superlative is an aggregate."""
    if not question or not question.strip():
        return Route("lookup", 0.0, "empty question")
    named = tuple(lex.match_tables(question)) if lex else ()
    if any(cue in question.lower() for cue in SCHEMA_CUES):
        return Route("lookup", 0.9, "asks for the schema", named, True)
    tables = tuple(dict.fromkeys([*named, *(m.table for m in [*scoped(lex, question, named)])])) if lex else ()
    if len(tables) >= 2:
        return Route("hybrid", 0.7 + min(0.25, 0.1 * len(tables)), "several tables", tables)
    score = aggregate_score(question)
    if score >= 0.5:
        return Route("aggregate", score, "aggregate cue", tables)
    if SUPERLATIVE.search(question):
        return Route("aggregate", 0.55, "superlative", tables)
    return Route("lookup", 0.6 if tables else 0.4, "no cue", tables)


def scoped(lex: Lexicon, question: str, named) -> list:
    """Columns and values a question names; those of a named table win over namesakes elsewhere."""
    out = []
    for found in (lex.match_columns(question), lex.match_values(question)):
        by_place: dict = {}
        for m in found:
            by_place.setdefault((m.start, m.size), []).append(m)
        for own in by_place.values():
            out += [m for m in own if m.table in named] or own[:1]
    return out


@dataclass(frozen=True)
class Condition:
    table: str
    column: str
    op: str  # = < >= in
    value: object


@dataclass
class AggPlan:
    table: str
    agg: str
    target: str | None = None
    group: tuple[str, str] | None = None
    conditions: list[Condition] = field(default_factory=list)
    hops: list[tuple[str, str, str, str]] = field(default_factory=list)  # table, column, next table, its column

    def tables(self) -> list[str]:
        return [self.table, *(h[2] for h in self.hops)]


def window(question: str) -> tuple[date | None, date | None] | None:
    """The half-open date range [lo, hi) a question names; None for none. A named part of a year isn't widened."""
    line, iso = question.lower(), [date.fromisoformat(x) for x in ISO.findall(question) if _valid(x)]
    day = timedelta(days=1)
    early, late = re.search(r"\b(before|prior to|up to)\b", line), re.search(r"\b(after|since)\b", line)
    if len(iso) >= 2:
        return min(iso[:2]), max(iso[:2]) + day
    if iso:
        return (None, iso[0]) if early else (iso[0] + day, None) if late else (iso[0], iso[0] + day)
    if re.search(r"\b(first|second) half\b|\bq[1-4]\b|\bquarter\b", line):
        raise PlanError("a named part of a year isn't understood")
    words = tokens(question)
    years = [int(w) for w in words if re.fullmatch(r"(?:19|20)\d\d", w)]
    months = [MONTHS[w] for i, w in enumerate(words) if w in MONTHS and (w != "may" or i + 1 < len(words) and words[i + 1].isdigit())]
    if years and months:
        y, m = years[0], months[0]
        return date(y, m, 1), date(y + m // 12, m % 12 + 1, 1)
    if len(years) >= 2:
        return date(min(years[:2]), 1, 1), date(max(years[:2]) + 1, 1, 1)
    if years:
        y = years[0]
        return (None, date(y, 1, 1)) if early else (date(y + 1, 1, 1), None) if late else (date(y, 1, 1), date(y + 1, 1, 1))
    return None


def _valid(text: str) -> bool:
    try:
        date.fromisoformat(text)
    except ValueError:
        return False
    return True


def grouping(question: str, most: int = 6) -> str:
    """The words after the first sign of a grouping; empty for none."""
    words = tokens(question)
    for k, w in enumerate(words):
        if w in DISTRIBUTIVE or w == "by" and k and words[k - 1] in DIVIDED:
            return " ".join(words[k + 1 : k + 1 + most])
    return ""


def plan(question: str, lex: Lexicon) -> AggPlan:
    """Fills the slots of one aggregate, or says why it can't. What a question limits is never dropped."""
    if wrong := lex.unresolved_constraints(question):
        raise PlanError("no such value: " + ", ".join(f"{v!r} for {c}" for v, c in wrong))
    line = f" {' '.join(tokens(question))} "
    agg = next((a for a, cues in AGGREGATES if any(f" {c} " in line for c in cues)), None)
    if agg is None:
        raise PlanError("no aggregate in the question")
    named = lex.match_tables(question)
    points: dict[str, float] = {}
    for t in named:
        points[t] = points.get(t, 0) + 2.0
    for m in scoped(lex, question, named):
        points[m.table] = points.get(m.table, 0) + (1.0 if m.value is None else 1.5)
    if not points:
        raise PlanError("no known table or column in the question")
    first = {t: line.find(f" {f} ") for f, t in lex.tables.items() if f" {f} " in line}
    table = min(points, key=lambda t: (-points[t], first.get(t, 999), t)) if not named else min(named, key=lambda t: min(line.find(f" {f} ") for f, o in lex.tables.items() if o == t and f" {f} " in line))
    target = None
    if agg != "COUNT":
        own = [m for m in lex.match_columns(question) if lex.role(m.table, m.column) == "NUMERIC"]
        here = [m for m in own if m.table == table]
        if here:
            target = max(here, key=lambda m: m.size).column
        elif own and not any(m.table == table for m in own):
            best = max(own, key=lambda m: (m.table in named, m.size))
            table, target = best.table, best.column
        elif len(found := lex.of_role(table, "NUMERIC")) == 1:
            target = found[0]
        else:
            raise PlanError(f"{agg} needs a numeric column of {table}")
    out = AggPlan(table, agg, target)
    wanted = [m for m in scoped(lex, question, named or [table]) if m.value is not None]
    by_column: dict[tuple[str, str], list[str]] = {}
    for m in wanted:
        by_column.setdefault((m.table, m.column), []).append(m.value)
    for (t, c), values in by_column.items():
        out.conditions.append(Condition(t, c, "=", values[0]) if len(values) == 1 else Condition(t, c, "in", tuple(sorted(values))))
    if phrase := grouping(question):
        options = [m for m in lex.match_columns(phrase) if lex.role(m.table, m.column) in ("CATEGORICAL", "DATE", "BOOLEAN", "ID")]
        if options:
            best = min(options, key=lambda m: (m.table != table, lex.role(m.table, m.column) != "CATEGORICAL", -m.size, m.column))
            out.group = (best.table, best.column)
    for t in dict.fromkeys([c.table for c in out.conditions] + ([out.group[0]] if out.group else [])):
        at = out.tables()
        if t in at:
            continue
        route = lex.catalog.route(table, t)
        if route is None:
            raise PlanError(f"{t} isn't reachable from {table}")
        here = table
        for column, other, theirs in route:
            if other not in out.tables():
                out.hops.append((here, column, other, theirs))
            here = other
    span = window(question)
    if span:
        dates = lex.of_role(table, "DATE")
        if not dates:
            raise PlanError(f"{table} has no date")
        lo, hi = span
        out.conditions += [Condition(table, dates[0], ">=", lo)] * (lo is not None) + [Condition(table, dates[0], "<", hi)] * (hi is not None)
    return out


FUNCTIONS = {"COUNT": F.count, "AVG": F.avg, "SUM": F.sum, "MIN": F.min, "MAX": F.max}


def to_frame(p: AggPlan, lex: Lexicon) -> DataFrame:
    """The plan as a DataFrame: filters on the scans, inner joins along references, one aggregate."""
    needed = lambda t: sorted({c.column for c in p.conditions if c.table == t} | {h[1] for h in p.hops if h[0] == t} | {h[3] for h in p.hops if h[2] == t} | ({p.target} if t == p.table and p.target else set()) | ({p.group[1]} if p.group and p.group[0] == t else set()))

    def scan(t: str) -> DataFrame:
        df = lex.catalog.data(t)
        for c in (c for c in p.conditions if c.table == t):
            x = F.col(c.column)
            df = df.where(x.isin(*c.value) if c.op == "in" else x == c.value if c.op == "=" else x >= F.lit(c.value) if c.op == ">=" else x < F.lit(c.value))
        return df.select(*(F.col(c).alias(f"{t}.{c}") for c in needed(t)))

    df = scan(p.table)
    for a, column, b, theirs in p.hops:
        df = df.join(scan(b), F.col(f"`{a}.{column}`") == F.col(f"`{b}.{theirs}`"))
    value = F.count(F.lit(1)) if p.agg == "COUNT" else FUNCTIONS[p.agg](F.col(f"`{p.table}.{p.target}`"))
    if p.group is None:
        return df.agg(value.alias("value"))
    key = F.col(f"`{p.group[0]}.{p.group[1]}`").alias(p.group[1])
    return df.groupBy(key).agg(value.alias("value")).orderBy(F.col("value").desc(), p.group[1])


def ident(name: str) -> str:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name or ""):
        raise PlanError(f"unsafe name: {name!r}")
    return f"`{name}`"


def quoted(name: str) -> str:
    """Any name in backticks, its own doubled; a NUL is refused."""
    if not name or "\x00" in name:
        raise PlanError(f"unsafe name: {name!r}")
    return "`" + name.replace("`", "``") + "`"


def qualified(*parts: str) -> str:
    """schema.table and the like, each part in backticks; empty parts are left out."""
    return ".".join(quoted(p) for p in parts if p)


def table_named(source, name: str) -> str:
    """The table of a source that a name means: as it is, by its last part, or whatever its case."""
    last = name.replace("`", "").split(".")[-1]
    for known in source.tables():
        if known in (name, last):
            return known
    same = [t for t in source.tables() if t.lower() == last.lower()]
    if len(same) != 1:
        raise PlanError(f"no such table: {name}")
    return same[0]


def literal(value) -> str:
    text = str(value)
    if "\\" in text:
        raise PlanError("unsafe value")
    quoted = "'" + text.replace("'", "''") + "'"
    return f"DATE {quoted}" if isinstance(value, date) else quoted


def to_sql(p: AggPlan) -> str:
    """The same plan as one SELECT."""
    name = lambda t, c: f"{ident(t)}.{ident(c)}"
    value = "COUNT(*)" if p.agg == "COUNT" else f"{p.agg}({name(p.table, p.target)})"
    key = name(*p.group) if p.group else None
    sql = f"SELECT {key + ', ' if key else ''}{value} AS value FROM {ident(p.table)}"
    for a, column, b, theirs in p.hops:
        sql += f" JOIN {ident(b)} ON {name(a, column)} = {name(b, theirs)}"
    tests = [f"{name(c.table, c.column)} IN ({', '.join(map(literal, c.value))})" if c.op == "in" else f"{name(c.table, c.column)} {c.op} {literal(c.value)}" for c in p.conditions]
    if tests:
        sql += " WHERE " + " AND ".join(tests)
    return sql + (f" GROUP BY {key} ORDER BY value DESC, {key}" if key else "")
