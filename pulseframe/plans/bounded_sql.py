"""A guard for ad-hoc SQL: one read-only SELECT over one of the tenant's tables, at most 500 rows.

The statement is parsed by Spark's own parser and its unresolved plan is walked; what isn't allowed by name is
refused. It then runs in a session of its own, whose views hold the tenant's rows only, so even a statement that slipped
through the guard sees nothing else, and statements of several tenants at once don't share names. Rows are fetched within a
time limit, after which the statement's jobs are cancelled by their tag.
"""

from __future__ import annotations

import re
import threading
import uuid

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

#: Tables that may be read (fixed values).
TABLES = ("daily_health_metrics", "daily_features", "strength_events", "cardio_events", "biometrics", "anomaly_events", "metric_patterns", "weekly_activity_summary", "daily_goal_snapshot", "goals", "running_sessions", "daily_briefings", "interventions", "metric_baselines")
MOST = 500
PLANS = {"Project", "Filter", "Sort", "GlobalLimit", "LocalLimit", "Aggregate", "UnresolvedRelation", "Distinct", "UnresolvedHaving", "SubqueryAlias", "WithWindowDefinition", "Window"}
#: Functions that reach outside the rows (fixed values).
FUNCTIONS = {"reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length", "current_user", "user", "session_user", "current_database", "current_schema", "current_catalog", "version", "uuid", "rand", "randn", "raise_error", "assert_true", "sleep", "read_files", "monotonically_increasing_id", "spark_partition_id"}


SECONDS = 15.0


class Refused(ValueError):
    """The statement isn't allowed."""


class TimeLimit(RuntimeError):
    """The statement took too long and was cancelled."""


def check(spark: SparkSession, sql: str, user_id: str) -> str:
    """SQL-01: the statement, limited to 500 rows; Refused with a reason."""
    text = re.sub(r";\s*$", "", sql.strip())
    if ";" in re.sub(r"'(?:[^'\\]|\\.|'')*'", "", text) or "--" in text or "/*" in text:
        raise Refused("one statement without comments")
    if not re.match(r"(?i)select\b", text):
        raise Refused("a SELECT")
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except Exception as e:
        raise Refused(f"it can't be parsed: {str(e)[:200]}") from None
    tables, conds, limit = [], [], None

    def expressions(node):
        it = node.expressions().iterator()
        while it.hasNext():
            yield from inside(it.next())

    def inside(e):
        yield e
        it = e.children().iterator()
        while it.hasNext():
            yield from inside(it.next())

    def conjuncts(e):
        if e.nodeName() == "And":
            it = e.children().iterator()
            while it.hasNext():
                yield from conjuncts(it.next())
        else:
            yield e

    def walk(node):
        nonlocal limit
        name = node.nodeName()
        kind = name if name in PLANS else node.getClass().getSimpleName()
        if kind not in PLANS:
            raise Refused(f"{kind} isn't allowed")
        if kind == "SubqueryAlias" and node.child().getClass().getSimpleName() != "UnresolvedRelation":
            raise Refused("subqueries aren't allowed")
        if kind == "UnresolvedRelation":
            tables.append(node.tableName().lower())
        if kind == "Filter":
            conds.append(node.condition())
        if kind == "GlobalLimit":
            limit = node.limitExpr().toString()
        for e in expressions(node):
            c = e.getClass().getSimpleName()
            if c in ("Or", "ScalarSubquery", "Exists", "ListQuery", "InSubquery", "LateralSubquery") or "Subquery" in c:
                raise Refused(f"{c} isn't allowed")
            if c == "UnresolvedFunction":
                f = e.nameParts().mkString(".").lower()
                if f in FUNCTIONS or "." in f:
                    raise Refused(f"{f}() isn't allowed")
        it = node.children().iterator()
        while it.hasNext():
            walk(it.next())

    walk(plan)
    if len(tables) != 1 or tables[0] not in TABLES:
        raise Refused("exactly one of the readable tables")
    if not conds:
        raise Refused("a WHERE with the user's id")

    def mine(e) -> bool:
        if e.nodeName() not in ("EqualTo",) and e.getClass().getSimpleName() != "EqualTo":
            return False
        a, b = e.children().apply(0).toString(), e.children().apply(1).toString()
        return {a.lower().split(".")[-1].strip("'`"), b.strip("'")} == {"user_id", user_id} or {b.lower().split(".")[-1].strip("'`"), a.strip("'")} == {"user_id", user_id}

    if not any(mine(x) for c in conds for x in conjuncts(c)):
        raise Refused("user_id must be compared with the user's id in a conjunct of its own")
    if limit is None:
        return f"{text} LIMIT {MOST}"
    if not limit.isdigit():
        raise Refused("a LIMIT must be a number")
    return text if int(limit) <= MOST else f"SELECT * FROM ({text}) LIMIT {MOST}"


def tenant_session(spark: SparkSession, tables: dict[str, DataFrame], user_id: str) -> SparkSession:
    """SQL-03: a new session with views of the tenant's rows under the tables' names."""
    own = spark.newSession()
    for name, df in tables.items():
        shared = f"tenant_{uuid.uuid4().hex}"
        df.where(F.col("user_id") == user_id).createGlobalTempView(shared)
        try:  # the view takes the plan over, so the shared name can go
            own.table(f"global_temp.{shared}").createOrReplaceTempView(name)
        finally:
            spark.catalog.dropGlobalTempView(shared)
    return own


def run(spark: SparkSession, sql: str, tables: dict[str, DataFrame], user_id: str) -> DataFrame:
    """SQL-02: the checked statement's rows, not yet computed."""
    return tenant_session(spark, tables, user_id).sql(check(spark, sql, user_id))


def fetch(spark: SparkSession, sql: str, tables: dict[str, DataFrame], user_id: str, seconds: float = SECONDS) -> list[Row]:
    """SQL-02: the checked statement's rows, at most 500; TimeLimit if that takes longer than `seconds`."""
    df, sc, tag, over, done = run(spark, sql, tables, user_id), spark.sparkContext, f"bounded-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch():
        if not done.wait(seconds):
            over.set()
            while not done.wait(0.2):  # jobs that the statement starts meanwhile go too
                sc.cancelJobsWithTag(tag)

    watcher = threading.Thread(target=watch, daemon=True)
    sc.addJobTag(tag)
    watcher.start()
    try:
        return df.collect()
    except Exception as e:
        if over.is_set():
            raise TimeLimit(f"more than {seconds:g} seconds") from e
        raise
    finally:
        done.set()
        sc.removeJobTag(tag)
        watcher.join()


def ask(spark: SparkSession, question: str, tables: dict[str, DataFrame], user_id: str, llm, shown: int = 20, seconds: float = SECONDS) -> dict:
    """SQL-02: an injected `llm(system, text)` writes the statement and words the answer; errors come back as ok=False."""
    reply = llm("Write one SELECT.", question)
    found = re.search(r"(?s)```(?:sql)?\s*\n?(.*?)```", reply)
    sql = (found[1] if found else reply).strip()
    try:
        rows = [r.asDict() for r in fetch(spark, sql, tables, user_id, seconds)]
    except Exception as e:
        return {"ok": False, "error": str(e)[:500], "sql": sql, "rows": []}
    return {"ok": True, "sql": sql, "rows": rows, "summary": llm("Sum up.", repr(rows[:shown]))}


def chat_turn(messages: list[dict], context: str, llm, history=None, tools: tuple[str, ...] = ("log_run", "set_goal", "add_journal", "add_phase", "add_exception")) -> dict:
    """SQL-04: one turn over the last 12 messages: at most one history query; write tools become pending writes."""
    import json

    text = context + "\n" + "\n".join(f"{m['role']}: {m['content']}" for m in messages[-12:])
    reply = llm("Coach.", text)
    calls = []
    for line in reply.splitlines():
        try:
            c = json.loads(line)
        except json.JSONDecodeError:
            continue
        if isinstance(c, dict) and "tool" in c:
            calls.append(c)
    asked = next((c for c in calls if c["tool"] == "query_history"), None)
    if asked and history:
        reply = llm("Coach.", f"{text}\nresult: {history(asked.get('question', ''))}")
    return {"reply": reply, "pending_writes": [c for c in calls if c["tool"] in tools]}
