"""Read-only guard: a lexical check of the text, then a check of what Spark itself parsed.

The text alone can't be trusted: Spark honours a backslash before a quote, so text that looks like a string to a
plain SQL lexer may be code to Spark. So backslashes are refused, and the parsed plan decides.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from lodestone.errors import SourceError, UnsafeQueryError

#: Words that never occur in the code of a read-only statement.
DENY_WORDS = frozenset(
    "INSERT UPDATE DELETE DROP ALTER CREATE TRUNCATE GRANT REVOKE ATTACH DETACH PRAGMA VACUUM REINDEX CLUSTER COPY MERGE UPSERT CALL DO EXECUTE PREPARE DEALLOCATE LOCK UNLOCK NOTIFY LISTEN UNLISTEN DISCARD RESET BEGIN COMMIT ROLLBACK SAVEPOINT RELEASE START RETURNING INTO SET REFRESH IMPORT LOAD INSTALL ATTACHED SHUTDOWN CHECKPOINT".split()
)
#: Functions that reach outside the data.
DENY_FUNCTIONS = frozenset(
    "pg_read_file pg_read_binary_file pg_ls_dir pg_stat_file pg_logdir_ls lo_import lo_export lo_put pg_terminate_backend pg_cancel_backend pg_sleep pg_sleep_for dblink dblink_exec postgres_fdw_handler writefile readfile edit load_extension fts3_tokenizer system shell eval exec xp_cmdshell".split()
)
#: Functions of Spark that run code or leave the data.
SPARK_FUNCTIONS = frozenset("reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length read_files".split())
#: What the root of a parsed query may be.
ROOTS = frozenset("Project UnresolvedWith Sort GlobalLimit LocalLimit Offset Distinct Union Intersect Except Aggregate UnresolvedHaving Filter SubqueryAlias UnresolvedInlineTable WithWindowDefinition UnresolvedOrderBy Tail Sample".split())

LEXEME = re.compile(r"(?P<string>'(?:[^']|'')*')|(?P<ident>\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`)|(?P<line>--[^\n]*)|(?P<open>/\*)|(?P<dollar>\$[A-Za-z_]*\$)|(?P<bad>['\"`])|(?P<code>[^'\"`$/-]+|.)", re.S)
WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_$]*")


@dataclass(frozen=True)
class Segment:
    kind: str  # code, string, ident or comment
    text: str


def segments(sql: str) -> list[Segment]:
    """Code, strings, quoted names and comments. Block comments nest; dollar quotes and open ends are refused."""
    out, at = [], 0
    while at < len(sql):
        m = LEXEME.match(sql, at)
        kind, text = m.lastgroup, m.group()
        if kind == "bad":
            raise UnsafeQueryError(f"unterminated {text}")
        if kind == "dollar":
            raise UnsafeQueryError("dollar quoting is not permitted")
        if kind == "open":
            depth, end = 1, m.end()
            while depth:
                step = re.compile(r"/\*|\*/").search(sql, end)
                if step is None:
                    raise UnsafeQueryError("unterminated comment")
                depth += 1 if step.group() == "/*" else -1
                end = step.end()
            kind, text = "comment", sql[at:end]
        out.append(Segment({"line": "comment"}.get(kind, kind), text))
        at += len(text)
    return out


def code_only(sql: str) -> str:
    """The statement with everything but code blanked out."""
    return "".join(s.text if s.kind == "code" else " " for s in segments(sql))


def lint(sql: str) -> str:
    """One SELECT or WITH statement without forbidden words, less its trailing semicolon; else an error."""
    if not isinstance(sql, str) or not sql.strip():
        raise UnsafeQueryError("empty query")
    sql = sql.strip()
    if any(ord(c) < 32 and c not in "\t\r\n" for c in sql):
        raise UnsafeQueryError("control character in query")
    code = code_only(sql).strip()
    body = code.removesuffix(";")
    if ";" in body:
        raise UnsafeQueryError("more than one statement")
    found = WORD.findall(body)
    if not found or found[0].upper() not in ("SELECT", "WITH"):
        raise UnsafeQueryError(f"not a query: {found[0].upper() if found else 'no keyword'}")
    words = {w.upper() for w in found}
    if "SELECT" not in words:
        raise UnsafeQueryError("WITH without SELECT")
    if wrong := sorted(words & DENY_WORDS) or sorted({w.lower() for w in found} & DENY_FUNCTIONS):
        raise UnsafeQueryError(f"forbidden: {wrong[0]}")
    return sql.removesuffix(";").strip() if code.endswith(";") else sql


def is_readonly(sql: str) -> bool:
    try:
        lint(sql)
    except UnsafeQueryError:
        return False
    return True


def guard(spark: SparkSession, sql: str, tables: set[str] | None = None) -> str:
    """lint, then the parsed plan: a query root, no function that runs code, no path as a table, known tables only."""
    sql = lint(sql)
    if "\\" in sql:
        raise UnsafeQueryError("backslash in query")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise UnsafeQueryError(f"not parsed: {str(e).splitlines()[0][:200]}") from None
    names = {x["name"] for x in _tree(plan)}
    root = plan.getClass().getSimpleName()
    if root not in ROOTS:
        raise UnsafeQueryError(f"not a query: {root}")
    text = plan.toString()
    if m := re.search(r"'(\w+)\s*\(", text):
        for name in re.findall(r"'(\w+)\s*\(", text):
            if name.lower() in SPARK_FUNCTIONS:
                raise UnsafeQueryError(f"forbidden function: {name}")
    if bad := [n for n in names if n.endswith("Command") or n.startswith("Insert") or n in ("SetCatalogAndNamespace", "CacheTable", "ScriptTransformation")]:
        raise UnsafeQueryError(f"forbidden: {bad[0]}")
    ctes = {c.lower() for c in re.findall(r"(?i)(?:\bwith\b(?:\s+recursive)?|,)\s*`?(\w+)`?\s*(?:\([^()]*\))?\s+as\s*\(", sql)}
    for parts in re.findall(r"UnresolvedRelation \[([^\]]*)\]", text):
        name = [p.strip() for p in parts.split(",")]
        if len(name) > 1:
            raise UnsafeQueryError(f"not a table: {'.'.join(name)}")
        if tables is not None and name[0].lower() not in {t.lower() for t in tables} | ctes:
            raise UnsafeQueryError(f"unknown table: {name[0]}")
    if re.search(r"(?i)\b(?:" + "|".join(sorted(SPARK_FUNCTIONS)) + r")\b\s*\(", code_only(sql)):
        raise UnsafeQueryError("forbidden function")
    return sql


def _tree(plan) -> list[dict]:
    out, todo = [], [plan]
    while todo:
        node = todo.pop()
        out.append({"name": node.getClass().getSimpleName()})
        kids = node.children()
        todo += [kids.apply(k) for k in range(kids.size())]
    return out


@dataclass(frozen=True)
class QueryResult:
    columns: tuple[str, ...]
    rows: list[tuple]
    sql: str
    truncated: bool = False

    @property
    def scalar(self):
        """The value of a result of one row and one column, else None."""
        return self.rows[0][0] if len(self.rows) == 1 and len(self.columns) == 1 else None

    def as_dicts(self) -> list[dict]:
        return [dict(zip(self.columns, r)) for r in self.rows]


def execute_readonly(spark: SparkSession, sql: str, max_rows: int | None = 1000, tables: set[str] | None = None) -> QueryResult:
    """Runs a guarded query and takes at most max_rows rows (all, if that is None or not positive)."""
    checked = guard(spark, sql, tables)
    try:
        df: DataFrame = spark.sql(checked)
        rows = df.take(max_rows + 1) if max_rows and max_rows > 0 else df.collect()
    except Exception as e:
        raise SourceError(str(e).splitlines()[0][:300]) from None
    cut = bool(max_rows and max_rows > 0 and len(rows) > max_rows)
    return QueryResult(tuple(df.columns), [tuple(r) for r in (rows[:max_rows] if cut else rows)], checked, cut)
