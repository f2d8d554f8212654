"""Running many SQL texts and comparing their results as sets of rows.

Each distinct (database, text) runs once, and its result is reduced on the executors to
one fixed-width row: row count, distinct count and a 256-bit set fingerprint. Many texts
share a Spark job, whose rows carry the number of their text. Pairs are then judged by
joining those rows, so no result row is ever shuffled per pair, a gold query shared by
many predictions is computed once, and one failing or slow query cannot touch the others.
An ``OutcomeStore`` keeps outcomes, so that a text runs again only when its database
has changed.
"""

from __future__ import annotations

import concurrent.futures as cf
import itertools
import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import ParseException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from queryscore import fixed_values as fv
from queryscore.functions.row_key import (
    FINGERPRINT_WORDS, KEY, drained, row_keys, set_fingerprint,
)
from queryscore.functions.sql_text import cap_cell, is_blank, looks_like_write, row_text
from queryscore.operators.dispatch import (
    NotAllowed, TooSlow, Watcher, halves, input_bytes, message_of, packs, read_only_query, thrown,
)
from queryscore.operators.lookups import (
    LEAST_LOOKUPS, LOOKUPS, NUMBERED, Lookup, failing_rows, looked_up, lookup_of, shape_of, shape_order, stand_in,
)
from queryscore.operators.outcomes import OutcomeStore
from queryscore.operators.skew import left_join_skewed
from queryscore.scratch import materialise, scratch_dir
from queryscore.sources.database import register_database

OK = "ok"
EMPTY_SQL = "empty_sql"
NO_DB = "no_db"
EXEC_ERROR = "exec_error"
TIMEOUT = "timeout"
EMPTY_RESULT = "empty_result"

_WORDS = [f"f{i}" for i in range(FINGERPRINT_WORDS)]

OUTCOME_SCHEMA = T.StructType(
    [
        T.StructField("db_id", T.StringType()),
        T.StructField("sql", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("parsed", T.BooleanType()),
        T.StructField("seconds", T.DoubleType()),
        T.StructField("n_rows", T.LongType()),
        T.StructField("n_distinct", T.LongType()),
        *[T.StructField(w, T.LongType()) for w in _WORDS],
        T.StructField("text", T.StringType()),
        T.StructField("uses", T.LongType()),
    ]
)

# How many outcomes the driver gathers; batches of them are written to scratch.
_BATCH_ROWS = 1000
# Functions that call any Java method.
_REFLECTION = ("reflect", "java_method", "try_reflect")
#: Texts that share a job, and the bytes they may read together; a text that reads more runs alone.
PACK, PACK_BYTES = 32, 256 << 20


def _refuse(*args):
    raise ValueError("not allowed")


def isolate(session: SparkSession) -> None:
    """Let queries of ``session`` see its own views only: no files, no Java methods."""
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    for name in _REFLECTION:
        # A function of the session hides the built-in one of that name; it only ever refuses.
        session.udf.register(name, _refuse)


class DatabaseSessions:
    """One session per database directory, so equal table names do not clash.

    Queries arrive in directory order, so a few open databases are enough.
    """

    def __init__(self, spark: SparkSession, keep: int = 32):
        self._spark = spark
        self._keep = keep
        self._sessions: dict[str, cf.Future] = {}
        self._lock = threading.Lock()

    def get(self, path: str) -> SparkSession:
        """The session of a database; whoever asks first opens it, others wait for that one only."""
        with self._lock:
            opened = self._sessions.get(path)
            mine = opened is None
            if mine:
                while len(self._sessions) >= self._keep:
                    self._sessions.pop(next(iter(self._sessions)))
                opened = self._sessions[path] = cf.Future()
        if mine:
            try:
                opened.set_result(self._open(path))
            except Exception as e:
                opened.set_exception(e)
        return opened.result()

    def _open(self, path: str) -> SparkSession:
        session = self.empty()
        register_database(session, path)
        isolate(session)
        return session

    def empty(self) -> SparkSession:
        """A new session with the settings of all and no tables."""
        session = self._spark.newSession()
        for key, value in self._spark.conf.getAll.items():
            if key.startswith("spark.sql.") and session.conf.isModifiable(key):
                session.conf.set(key, value)
        return session


@dataclass
class _Run:
    """What queries are reduced to."""

    mode: str
    timeout_s: float
    float_digits: int | None = None
    max_rows: int = fv.PREVIEW_ROWS
    max_cell: int = fv.CELL_CHARS

    @property
    def key(self) -> str:
        """Names everything that an outcome depends on beside the text and its database."""
        shape = {"match": f"-{self.float_digits}", "preview": f"-{self.max_rows}-{self.max_cell}"}
        return self.mode + shape.get(self.mode, "")

    def _rows(self, df: DataFrame) -> DataFrame:
        if self.mode == "preview":
            return preview_rows(df, self.max_rows, self.max_cell)
        keys = row_keys(df, self.float_digits)
        # At the top of the plan the limit reads one partition after another.
        return keys.limit(1) if self.mode == "first_row" else keys

    def _reduced(self, rows: DataFrame, by: list[str], least: str | None = None) -> DataFrame:
        if self.mode == "match":
            return set_fingerprint(rows, by, least)
        return drained(rows, by, least) if self.mode == "drain" else rows

    def outcomes(self, frames: list[DataFrame]) -> list[dict]:
        """One outcome per query, from one job: rows carry the number of their query."""
        if len(frames) == 1:
            found = {0: self._reduced(self._rows(frames[0]), []).collect()}
        else:
            numbered = [self._rows(df).withColumn("query", F.lit(i)) for i, df in enumerate(frames)]
            found = {}
            for row in self._reduced(reduce(DataFrame.union, numbered), ["query"]).collect():
                found.setdefault(row["query"], []).append(row)
        return [self._outcome(found.get(i, [])) for i in range(len(frames))]

    def outcomes_of_lookups(self, session: SparkSession, lookup: Lookup, texts: list[str]) -> tuple[list[dict | None], dict[int, int]]:
        """(one outcome per text, all from one join, None for a text that breaks; the hash of a row for each of these)."""
        keys = row_keys(looked_up(session, lookup, texts), self.float_digits, NUMBERED)
        found, failing = {}, {}
        for row in self._reduced(keys, NUMBERED[:2], NUMBERED[2]).collect():
            if row["failed"]:
                failing[row["query"]] = row["failing"]
            else:
                found[row["query"]] = [row]
        return [None if i in failing else self._outcome(found.get(i, [])) for i in range(len(texts))], failing

    def _outcome(self, rows: list) -> dict:
        if self.mode == "first_row":
            return {"n_rows": len(rows)}
        if self.mode == "preview":
            shown = [r.line for r in rows]
            return {"n_rows": len(shown), "text": preview_text(shown, self.max_rows)}
        if not rows:  # no row of a query has come to the common reduction
            empty = dict.fromkeys(_WORDS, 0) | {"n_distinct": 0} if self.mode == "match" else {"f0": None}
            return empty | {"n_rows": 0}
        return {k: v for k, v in rows[0].asDict().items() if k not in NUMBERED}


def _message(e: Exception) -> str:
    if isinstance(e, Py4JJavaError):
        # The cause, without the Java stack below it.
        return str(e.java_exception.toString()).split("\n\tat ")[0]
    return (e.getMessage() if isinstance(e, PySparkException) else None) or str(e)


def _failed(e: Exception) -> dict:
    if isinstance(e, TooSlow):
        return {"status": TIMEOUT, "error": str(e)}
    return {"status": EXEC_ERROR, "error": _message(e), "parsed": not isinstance(e, ParseException)}


@dataclass
class _Prepared:
    row: dict
    df: DataFrame
    bytes: int


def _row(item) -> dict:
    return dict.fromkeys(OUTCOME_SCHEMA.names) | {"db_id": item.db_id, "sql": item.sql, "uses": item.uses, "parsed": True, "seconds": 0.0, "steady": True}


def _run_batch(items: list, sessions: DatabaseSessions, watcher: Watcher, run: _Run, pack: int) -> list[dict]:
    """Outcomes of some texts: each is analysed and planned by itself, then they run in few jobs."""
    out, ready = [], []

    def prepare(path: str, sql: str) -> tuple[DataFrame, int, bool]:
        df = read_only_query(sessions.get(path), sql)
        return df, input_bytes(df), df._jdf.queryExecution().analyzed().deterministic()

    for item in items:
        row = _row(item)
        try:
            sessions.get(item.dir)  # opening a database is not the text's time
            (df, size, steady), _ = watcher.limited(lambda i=item: prepare(i.dir, i.sql), run.timeout_s)
            ready.append(_Prepared(row | {"steady": steady}, df, size))
        except Exception as e:  # any failure of one query, its database included, is that query's outcome
            out.append(row | _failed(e))

    def together(some: list[_Prepared]) -> list[dict]:
        found, seconds = watcher.limited(lambda: run.outcomes([p.df for p in some]), run.timeout_s, len(some))
        return [p.row | one | {"status": OK, "seconds": seconds} for p, one in zip(some, found)]

    def alone(one: _Prepared, e: Exception) -> dict:
        return one.row | _failed(e) | ({"seconds": run.timeout_s} if isinstance(e, TooSlow) else {})

    # a preview keeps its limit at the top of its plan
    for some in packs(ready, lambda p: p.bytes, 1 if run.mode == "preview" else pack, PACK_BYTES):
        out += halves(some, together, alone)
    return out


@dataclass
class _Batch:
    """Texts for a worker: one join if they share a ``lookup``, else jobs of at most ``pack``."""

    items: list
    pack: int
    lookup: Lookup | None = None
    tried: bool = False
    failing: DataFrame | None = None  # rows that break the texts
    unparsed: bool = False  # whether a text like these does not parse

    @property
    def joined(self) -> bool:
        return self.lookup is not None and not self.tried and self.failing is None


#: A join that fails is tried again in so many parts; texts of one as small as this are tried one by one.
_PARTS, _SMALL_JOIN = 8, 32
#: Texts that a worker asks for their errors at once, and joins that run at once.
_ERRORS, _JOINS = 256, 1


def _parts(batch: _Batch) -> list[_Batch]:
    size = -(-len(batch.items) // _PARTS)
    small = len(batch.items) <= _SMALL_JOIN
    return [_Batch(batch.items[i : i + size], batch.pack, batch.lookup, small) for i in range(0, len(batch.items), size)]


def _run_lookups(batch: _Batch, sessions: DatabaseSessions, watcher: Watcher, run: _Run) -> tuple[list[dict], list[_Batch]]:
    """(outcomes, batches to run instead): a join that fails as a whole says nothing about its texts."""
    items, lookup = batch.items, batch.lookup

    def join(some: list) -> tuple[SparkSession, Lookup, list[str]]:
        session = sessions.empty()
        if lookup.checked:  # parts that expressions share would be computed outside of what catches failures
            session.conf.set("spark.sql.subexpressionElimination.enabled", "false")
        return session, lookup, [i.sql for i in some]

    try:
        (found, failing), seconds = watcher.limited(lambda: run.outcomes_of_lookups(*join(items)), run.timeout_s, len(items))
    except Exception:
        return [], _parts(batch)
    out = [_row(i) | one | {"status": OK, "seconds": seconds} for i, one in zip(items, found) if one is not None]
    broken, size, rows = [items[i] for i in failing], _SMALL_JOIN, None
    if broken:
        try:
            sought = lambda: materialise(failing_rows(*join(broken), list(failing.values())), "failing")
            (rows, _), size = watcher.limited(sought, run.timeout_s, len(broken)), _ERRORS
        except Exception:  # each tells its error by itself
            pass
    more = []
    for i in range(0, len(broken), size):
        own = None if rows is None else rows.where(F.col("query").between(i, i + size - 1))
        more.append(_Batch(broken[i : i + size], batch.pack, lookup, own is None, own))
    return out, more


def _with_errors(items: list, ask: Callable[[str], dict | None], watcher: Watcher, run: _Run) -> tuple[list[dict], list]:
    """(outcomes of the texts whose error ``ask`` knows, the others)."""
    try:
        found, _ = watcher.limited(lambda: [ask(i.sql) for i in items], run.timeout_s, len(items))
    except Exception:
        return [], items
    return [_row(i) | one for i, one in zip(items, found) if one], [i for i, one in zip(items, found) if not one]


def _run_broken(batch: _Batch, sessions: DatabaseSessions, watcher: Watcher, run: _Run) -> tuple[list[dict], list[_Batch]]:
    """Texts that a join has shown to break: each runs on a row that breaks it, while it is planned, for its error."""
    session, rest = sessions.empty(), batch.items
    try:
        isolate(session)
        watcher.limited(lambda: stand_in(session, batch.lookup, batch.failing), run.timeout_s, len(rest))

        analyse = session._jsparkSession.sql

        def ask(sql: str) -> dict | None:
            error = thrown(analyse(sql).queryExecution().optimizedPlan)
            message = error and message_of(error)
            return message and {"status": EXEC_ERROR, "error": message, "parsed": True}

        out, rest = _with_errors(rest, ask, watcher, run)
    except Exception:
        out = []
    return out, [_Batch(rest, batch.pack)] if rest else []


def _run_unparsed(batch: _Batch, sessions: DatabaseSessions, watcher: Watcher, run: _Run) -> tuple[list[dict], list[_Batch]]:
    """Texts of a shape of which one does not parse: (those that do not either, a batch of the others)."""

    def ask(sql: str) -> dict | None:
        error = thrown(parse, sql)
        message = error and message_of(error, "org.apache.spark.sql.catalyst.parser.ParseException")
        return message and {"status": EXEC_ERROR, "error": message, "parsed": False}

    try:
        parse = sessions.get(batch.items[0].dir)._jsparkSession.sessionState().sqlParser().parsePlan
    except Exception:
        return [], [_Batch(batch.items, batch.pack)]
    out, rest = _with_errors(batch.items, ask, watcher, run)
    return out, [_Batch(rest, batch.pack)] if rest else []


def _run_tried(batch: _Batch, sessions: DatabaseSessions, watcher: Watcher, run: _Run) -> tuple[list[dict], list[_Batch]]:
    """Texts of a failed join, each drained by itself, which needs no shuffle: (those that break, a batch of the others)."""
    out, whole, drain = [], [], _Run("drain", run.timeout_s)
    for item in batch.items:
        try:
            session = sessions.get(item.dir)
            # another text of this shape has been checked
            watcher.limited(lambda i=item: drain.outcomes([session.sql(i.sql)]), run.timeout_s)
            whole.append(item)
        except TooSlow:  # its own run will tell
            whole.append(item)
        except Exception as e:
            out.append(_row(item) | _failed(e))
    return out, [_Batch(whole, batch.pack)] if whole else []


def _grouped(items: Iterator, find: Callable[[object], tuple[Lookup | None, bool]]) -> Iterator[tuple[list, Lookup | None, bool]]:
    """(texts, what they look up, whether one does not parse): neighbours of one shape together if it is either, all others one by one."""
    for (_, shape), alike in itertools.groupby(items, lambda i: (i.dir, shape_of(i.sql))):
        first = [] if shape is None else list(itertools.islice(alike, LEAST_LOOKUPS))
        lookup, unparsed = find(first[0]) if len(first) == LEAST_LOOKUPS else (None, False)
        alike = itertools.chain(first, alike)
        if lookup is None and not unparsed:
            yield from (([i], None, False) for i in alike)
            continue
        while some := list(itertools.islice(alike, _ERRORS if unparsed else LOOKUPS)):
            yield some, lookup, unparsed


def _batches(groups: Iterator[tuple[list, Lookup | None, bool]], concurrency: int, most: int) -> Iterator[_Batch]:
    """Batches of texts, small ones first, so that a few texts are spread over all workers too."""
    sizes = itertools.chain.from_iterable(itertools.repeat(min(4 << i, most), concurrency) for i in itertools.count())
    size, open_ = next(sizes), []
    for items, lookup, unparsed in groups:
        if lookup is not None or unparsed:
            yield _Batch(items, most, lookup, unparsed=unparsed)
            continue
        open_ += items
        if len(open_) >= size:
            yield _Batch(open_, most)
            size, open_ = next(sizes), []
    if open_:
        yield _Batch(open_, most)


def _bounded_map(submit: Callable[[object], cf.Future], items: Iterator, ahead: int) -> Iterator:
    """``map`` on a pool that never holds more than ``ahead`` items at once.

    What is submitted returns (result, more items); these come before the next ones.
    """
    waiting: set[cf.Future] = set()
    again: list = []
    while True:
        while len(waiting) < ahead and (item := again.pop() if again else next(items, None)) is not None:
            waiting.add(submit(item))
        if not waiting:
            return
        done, waiting = cf.wait(waiting, return_when=cf.FIRST_COMPLETED)
        for f in done:
            result, more = f.result()
            again += more
            yield result


def run_queries(
    spark: SparkSession,
    queries: DataFrame,
    databases: DataFrame,
    mode: str,
    timeout_s: float,
    concurrency: int = 8,
    sessions: DatabaseSessions | None = None,
    store: OutcomeStore | None = None,
    pack: int = PACK,
    **options,
) -> DataFrame:
    """Run every distinct (db_id, sql) of ``queries`` and return one outcome row each.

    The driver only sees query texts, a partition of them at a time, and one small row
    per finished query; these go to the shared scratch folder in batches. Texts of unknown
    databases have no outcome. ``uses`` counts the input rows of each text. Texts that
    ``store`` knows do not run, and it learns the others. At most ``pack`` texts share a job, but
    those that are alike up to the keys they look up, ``LOOKUPS`` of which are one join.
    """
    out = scratch_dir(spark, "outcomes")
    run = _Run(mode, timeout_s, **options)
    sessions = sessions or DatabaseSessions(spark)
    distinct = (
        queries.groupBy("db_id", "sql").agg(F.count(F.lit(1)).alias("uses"))
        .join(databases.groupBy("db_id").agg(F.min("dir").alias("dir")), "db_id")
    )
    known, versions = None, None
    if store is not None:
        versions = store.versions(databases)
        distinct, known = store.split(distinct, versions, run.key, OUTCOME_SCHEMA)

    schema = T.StructType([*OUTCOME_SCHEMA.fields, T.StructField("steady", T.BooleanType())])

    def write(rows: list[dict]) -> None:
        # By way of Arrow: a local relation whose size the planner knows.
        table = pa.Table.from_pylist(rows, to_arrow_schema(schema))
        spark.createDataFrame(table, schema).coalesce(1).write.mode("append").parquet(out)

    rows: list[dict] = []
    watcher = Watcher(spark.sparkContext)
    # previews and first rows stop early, each by itself
    joins = pack > 1 and mode in ("match", "drain")

    def lookup(item) -> tuple[Lookup | None, bool]:
        try:
            session = sessions.get(item.dir)
            return watcher.limited(lambda: lookup_of(session, item.sql), run.timeout_s)[0], False
        except Exception as e:  # its own run will tell
            return None, isinstance(e, ParseException)

    def work(batch: _Batch) -> tuple[list[dict], list[_Batch]]:
        if batch.joined:
            return _run_lookups(batch, sessions, watcher, run)
        special = _run_tried if batch.tried else _run_broken if batch.failing is not None else _run_unparsed if batch.unparsed else None
        return special(batch, sessions, watcher, run) if special else (_run_batch(batch.items, sessions, watcher, run, batch.pack), [])

    try:
        # A join takes all cores: the time of many at once would be that of all.
        with cf.ThreadPoolExecutor(concurrency) as pool, cf.ThreadPoolExecutor(min(_JOINS, concurrency)) as joining:
            if joins:
                # Written first: the optimiser would follow the shape through all joins before, a sort compute it at each comparison.
                distinct = materialise(distinct, "texts").withColumn("shape", shape_order(F.col("sql")))
            texts = distinct.orderBy("dir", *(["shape"] if joins else []), "sql").toLocalIterator()
            groups = _grouped(texts, lookup) if joins else (([t], None, False) for t in texts)
            batches = _batches(groups, concurrency, pack)
            for found in _bounded_map(lambda b: (joining if b.joined else pool).submit(work, b), batches, 2 * concurrency):
                rows += found
                if len(rows) >= _BATCH_ROWS:
                    write(rows)
                    rows = []
        write(rows)
    finally:
        watcher.close()
    new = spark.read.schema(schema).parquet(out)
    if store is None:
        return new.drop("steady")
    # an overrun depends on the load, and an unsteady query on the moment: they are run again
    store.add(new.where((F.col("status") != TIMEOUT) & F.col("steady")).drop("steady", "uses"), versions, run.key)
    return new.drop("steady").unionByName(known)


# --- one query ------------------------------------------------------------------------


def preview_rows(df: DataFrame, max_rows: int = fv.PREVIEW_ROWS, max_cell: int = fv.CELL_CHARS) -> DataFrame:
    """Up to ``max_rows`` + 1 result rows as display text (the extra row shows truncation)."""
    by_position = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    cells = [cap_cell(F.col(c), max_cell) for c in by_position.columns]
    return by_position.select(row_text(cells).alias("line")).limit(max_rows + 1)


def preview_text(lines: list[str], max_rows: int = fv.PREVIEW_ROWS) -> str:
    if not lines:
        return "(0 rows)"
    shown = lines[:max_rows]
    note = f"\n(showing first {max_rows})" if len(lines) > max_rows else ""
    return f"{len(shown)} row(s):\n" + "\n".join(shown) + note


def preview(
    spark: SparkSession, queries: DataFrame, databases: DataFrame,
    max_rows: int = fv.PREVIEW_ROWS, max_cell: int = fv.CELL_CHARS,
    timeout_s: float = fv.PREVIEW_TIMEOUT_S, concurrency: int = 8,
) -> DataFrame:
    """(…, text, truncated) for a table of (…, db_id, sql): what a reader of the results sees."""
    known = _with_known_db(queries, databases)
    write = F.coalesce(looks_like_write(F.col("sql")), F.lit(False))
    blank = is_blank(F.col("sql"))
    may_run = F.col("has_db") & ~write & ~blank
    outcomes = run_queries(
        spark, known.filter(may_run), databases, "preview", timeout_s, concurrency,
        max_rows=max_rows, max_cell=max_cell,
    )
    out = F.col("outcome")
    failed = F.when(write, F.lit(f"Error: {fv.READ_ONLY_ERROR}")).when(blank, F.lit("Error: SQL error: empty query")).otherwise(
        F.concat(F.lit("Error: SQL error: "), F.coalesce(out["error"], F.lit("no such database")))
    )
    return _with_outcome(known, outcomes, "sql", may_run, "outcome").select(
        *queries.columns,
        F.when(out["status"] == OK, out["text"]).otherwise(failed).alias("text"),
        F.coalesce((out["status"] == OK) & (out["n_rows"] > max_rows), F.lit(False)).alias("truncated"),
    )


def result_set_match(pred: DataFrame, gold: DataFrame, float_digits: int | None = None) -> DataFrame:
    """One row, ``ex`` 1 or 0: both results hold the same set of rows.

    Row keys of both sides meet in one aggregation keyed by row; bit 1 stands for the
    prediction, bit 2 for the gold, and every key must carry both.
    """
    sides = row_keys(pred, float_digits).withColumn("side", F.lit(1)).unionByName(
        row_keys(gold, float_digits).withColumn("side", F.lit(2))
    )
    return (
        sides.groupBy(*KEY).agg(F.bit_or("side").alias("sides"))
        .agg(F.coalesce(F.min("sides"), F.lit(3)).alias("least"))
        .select((F.col("least") == 3).cast("int").alias("ex"))
    )


# --- batches --------------------------------------------------------------------------


def _with_known_db(rows: DataFrame, databases: DataFrame) -> DataFrame:
    """``rows`` plus ``has_db``; a database that is listed twice counts once."""
    known = databases.select("db_id", F.lit(True).alias("has_db")).distinct()
    return left_join_skewed(rows, known, ["db_id"]).withColumn("has_db", F.coalesce("has_db", F.lit(False)))


def _with_outcome(
    rows: DataFrame, outcomes: DataFrame, sql: str, may_run: Column, name: str
) -> DataFrame:
    """Add the outcome of each row's text as a struct ``name``, null where it did not run.

    Rows that did not run get a null key, so every other key has an outcome that knows how
    many rows use it: one text shared by a third of the rows does not unbalance the join.
    """
    found = outcomes.select(
        "db_id", F.col("sql").alias("_key"), "uses",
        F.struct(*[c for c in outcomes.columns if c not in ("db_id", "sql", "uses")]).alias(name),
    )
    keyed = rows.withColumn("_key", F.when(may_run, F.col(sql)))
    return left_join_skewed(keyed, found, ["db_id", "_key"], "uses").drop("_key", "uses")


def _status(outcome: str, sql: str) -> Column:
    return (
        F.when(is_blank(F.col(sql)), EMPTY_SQL).when(~F.col("has_db"), NO_DB)
        .otherwise(F.col(f"{outcome}.status"))
    )


def match_batch(
    spark: SparkSession, pairs: DataFrame, databases: DataFrame,
    timeout_s: float = fv.MATCH_TIMEOUT_S, concurrency: int = 8,
    float_digits: int | None = None, sessions: DatabaseSessions | None = None,
    store: OutcomeStore | None = None, pack: int = PACK,
) -> DataFrame:
    """``pairs`` plus (ex, pred_status, gold_status, pred_parsed, pred_seconds).

    ``pred_parsed`` is false for a prediction that is not SQL, and null for one that did not run.

    ``pairs`` needs (db_id, pred_sql, gold_sql) and is read three times: materialise it
    first when it is costly. The joins bring one fixed-width row per distinct text.
    """
    known = _with_known_db(pairs, databases)
    may_run = {s: F.col("has_db") & ~is_blank(F.col(s)) for s in ("pred_sql", "gold_sql")}
    texts = [known.filter(may_run[s]).select("db_id", F.col(s).alias("sql")) for s in may_run]
    outcomes = run_queries(
        spark, texts[0].unionByName(texts[1]), databases, "match", timeout_s, concurrency,
        sessions, store, pack, float_digits=float_digits,
    )
    joined = _with_outcome(known, outcomes, "pred_sql", may_run["pred_sql"], "pred")
    joined = _with_outcome(joined, outcomes, "gold_sql", may_run["gold_sql"], "gold")
    same = (F.col("pred.status") == OK) & (F.col("gold.status") == OK)
    for part in ("n_distinct", *_WORDS):
        # an empty result has words of null if it ran alone, of 0 if with others
        same = same & (F.coalesce(f"pred.{part}", F.lit(0)) == F.coalesce(f"gold.{part}", F.lit(0)))
    return joined.select(
        *pairs.columns,
        F.coalesce(same.cast("int"), F.lit(0)).alias("ex"),
        _status("pred", "pred_sql").alias("pred_status"),
        _status("gold", "gold_sql").alias("gold_status"),
        F.col("pred.parsed").alias("pred_parsed"),
        F.col("pred.seconds").alias("pred_seconds"),
    )


def executes_ok(
    spark: SparkSession, queries: DataFrame, databases: DataFrame,
    timeout_s: float = fv.PREVIEW_TIMEOUT_S, concurrency: int = 8,
) -> DataFrame:
    """``queries`` plus ``executes``: not blank, not a write, and the first row arrives in time."""
    known = _with_known_db(queries, databases)
    sql = F.col("sql")
    may_run = F.col("has_db") & ~is_blank(sql) & ~looks_like_write(sql)
    outcomes = run_queries(
        spark, known.filter(may_run), databases, "first_row", timeout_s, concurrency
    )
    return _with_outcome(known, outcomes, "sql", may_run, "outcome").select(
        *queries.columns, F.coalesce(F.col("outcome.status") == OK, F.lit(False)).alias("executes")
    )


def with_executes(
    spark: SparkSession, scored: DataFrame, databases: DataFrame,
    timeout_s: float = fv.PREVIEW_TIMEOUT_S, concurrency: int = 8,
    sessions: DatabaseSessions | None = None, store: OutcomeStore | None = None,
) -> DataFrame:
    """Add ``executes`` to the rows of ``match_batch``, running as few queries as possible.

    A match, or a whole result within the limit, already proves that a first row can be
    had. Only predictions that ran longer or broke later are tried again.
    """
    write = looks_like_write(F.col("pred_sql"))
    quick = (F.col("ex") == 1) | (F.col("pred_seconds") <= timeout_s)
    proven = (F.col("pred_status") == OK) & quick & ~write
    open_ = F.col("pred_status").isin(OK, EXEC_ERROR, TIMEOUT) & ~write & ~proven
    outcomes = run_queries(
        spark, scored.filter(open_).select("db_id", F.col("pred_sql").alias("sql")), databases,
        "first_row", timeout_s, concurrency, sessions, store,
    )
    return _with_outcome(scored, outcomes, "pred_sql", open_, "outcome").select(
        *scored.columns, (proven | F.coalesce(F.col("outcome.status") == OK, F.lit(False))).alias("executes")
    )


def gold_filter(
    spark: SparkSession, questions: DataFrame, databases: DataFrame,
    timeout_s: float = fv.MATCH_TIMEOUT_S, concurrency: int = 8, store: OutcomeStore | None = None,
) -> DataFrame:
    """``questions`` plus (keep, reason): only golds that run and return rows are kept."""
    known = _with_known_db(questions, databases)
    gold = F.col("gold_sql")
    may_run = F.col("has_db") & ~is_blank(gold)
    outcomes = run_queries(
        spark, known.filter(may_run).select("db_id", gold.alias("sql")), databases, "drain",
        timeout_s, concurrency, store=store,
    )
    reason = (
        F.when(is_blank(gold), EMPTY_SQL)
        .when(~F.col("has_db"), NO_DB)
        .when(F.col("outcome.status") != OK, EXEC_ERROR)
        .when(F.col("outcome.n_rows") == 0, EMPTY_RESULT)
        .otherwise(OK)
    )
    return _with_outcome(known, outcomes, "gold_sql", may_run, "outcome").select(
        *questions.columns, reason.alias("reason"), (reason == OK).alias("keep")
    )


def self_match(
    spark: SparkSession, questions: DataFrame, databases: DataFrame,
    timeout_s: float = fv.MATCH_TIMEOUT_S, concurrency: int = 8,
) -> DataFrame:
    """``questions`` plus (gold_runs, missing_db): every gold compared with itself."""
    pairs = questions.withColumn("pred_sql", F.col("gold_sql"))
    return match_batch(spark, pairs, databases, timeout_s, concurrency).select(
        *questions.columns,
        F.col("ex").alias("gold_runs"),
        (F.col("gold_status") == NO_DB).alias("missing_db"),
    )
