"""Running untrusted SQL texts from the driver: checked plans, limits, many texts in one job.

A text is parsed by itself and its plan is walked: what it is and what it reads is known from the
tree, not from how it is written or printed. Analysis, planning and tasks each have a limit, kept by
one watcher for all texts. Prepared texts with small inputs share a job; a job that fails or takes too
long is split in halves until the text that is to blame runs alone.
"""

from __future__ import annotations

import json
import queue
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import CALL_COMMAND_NAME, END_COMMAND_PART, Py4JJavaError, get_return_value
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

LOGICAL = "org.apache.spark.sql.catalyst.plans.logical."
#: Leaves of an analysed query that read nothing outside it.
_OWN_LEAVES = {"OneRowRelation", "LocalRelation", "Range", "CTERelationRef", "UnionLoopRef", "EmptyRelation"}


class NotAllowed(Exception):
    """A text is no query, or names something outside its own database."""


class TooSlow(Exception):
    """A limit has passed."""


# --- what a text is -------------------------------------------------------------------------


class _Kinds:
    """What Spark's plan classes are, asked once per class."""

    def __init__(self, spark: SparkSession):
        of = spark.sparkContext._jvm.java.lang.Class.forName
        self._of = of
        self._plan = of(LOGICAL + "LogicalPlan")
        self._leaf = of(LOGICAL + "LeafNode")
        self._statements = [of(LOGICAL + "Command"), of(LOGICAL + "ParsedStatement")]
        self._known: dict[str, tuple[bool, bool]] = {}

    def of(self, name: str) -> tuple[bool, bool]:
        """(may be part of a query, is a leaf of plans)."""
        if name not in self._known:
            kind = self._of(name)
            acts = any(s.isAssignableFrom(kind) for s in self._statements) or "ScriptTransformation" in name
            self._known[name] = (not acts, self._leaf.isAssignableFrom(kind))
        return self._known[name]


_kinds: dict[int, _Kinds] = {}


def _kinds_of(spark: SparkSession) -> _Kinds:
    return _kinds.setdefault(id(spark.sparkContext._jvm), _Kinds(spark))


def trees(value) -> list[list[dict]]:
    """All trees in a plan's JSON: a tree is the list of its nodes, parents first."""
    found, open_ = [], [value]
    while open_:
        now = open_.pop()
        if isinstance(now, list):
            if now and isinstance(now[0], dict) and "class" in now[0] and "num-children" in now[0]:
                found.append(now)
            open_ += now
        elif isinstance(now, dict):
            open_ += now.values()
    return found


def own_view(node: dict) -> bool:
    return node["class"] == LOGICAL + "View" and node.get("isTempView") is True and "database" not in node["desc"]["identifier"]


def _outside_views(tree: list[dict]) -> list[dict]:
    """The nodes of a tree without what lies below views of the session."""
    kept, skip = [], 0
    for node in tree:
        if skip:
            skip += node["num-children"] - 1
            continue
        if own_view(node):
            skip = node["num-children"]
            continue
        kept.append(node)
    return kept


def check_tree(kinds: _Kinds, plan, analysed: bool) -> None:
    """Raises unless the plan is a query; an analysed one must read views of the session only."""
    open_ = trees(json.loads(plan.toJSON()))[:1]
    while open_:
        for node in _outside_views(open_.pop()):
            may, leaf = kinds.of(node["class"])
            if not may:
                raise NotAllowed("only a query can be run")
            name = node["class"].removeprefix(LOGICAL).rstrip("$")
            if analysed and (name == "View" or leaf and name not in _OWN_LEAVES):
                raise NotAllowed("only the tables of the database can be read")
            open_ += trees([v for k, v in node.items() if k != "class"])


def read_only_query(spark: SparkSession, sql: str) -> DataFrame:
    """The result of ``sql``, a single query over the views of the session and nothing else.

    The text must parse by itself. The parsed plan shows that it is a query; the analysed one shows
    what it reads, in subqueries and common table expressions too.
    """
    kinds = _kinds_of(spark)
    check_tree(kinds, spark._jsparkSession.sessionState().sqlParser().parsePlan(sql), analysed=False)
    df = spark.sql(sql)
    check_tree(kinds, df._jdf.queryExecution().analyzed(), analysed=True)
    return df


def thrown(method, *args):
    """What a JVM method throws, None if it returns.

    PySpark's own errors fetch their stack trace and that of each cause, and log them: up to 0.1 s each.
    """
    arguments, _ = method._build_args(*args)
    command = CALL_COMMAND_NAME + method.command_header + arguments + END_COMMAND_PART
    try:
        get_return_value(method.gateway_client.send_command(command), method.gateway_client, method.target_id, method.name)
    except Py4JJavaError as e:
        return e.java_exception
    return None


class _Errors:
    """The JVM's methods that tell what was thrown, looked up once."""

    def __init__(self, jvm):
        self.is_a = jvm.py4j.reflection.TypeUtil.isInstanceOf
        self.condition, self.parameters = jvm.PythonErrorUtils.getCondition, jvm.PythonErrorUtils.getMessageParameters
        self.message = jvm.org.apache.spark.SparkThrowableHelper.getMessage


_errors: dict[int, _Errors] = {}


def message_of(error, kind: str = "org.apache.spark.SparkThrowable") -> str | None:
    """``getMessage`` of the PySpark error for what a JVM method has thrown; None if it is of another kind or Spark has no text for it."""
    jvm = SparkContext._gateway.jvm
    known = _errors.get(id(jvm)) or _errors.setdefault(id(jvm), _Errors(jvm))
    condition = known.condition(error) if known.is_a(kind, error) else None
    return condition and known.message(condition, known.parameters(error))


def input_bytes(df: DataFrame) -> int:
    """What the optimised plan of ``df`` reads, as Spark estimates it; asking for it plans the query."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


# --- limits -----------------------------------------------------------------------------------


@dataclass
class _Task:
    fn: Callable
    limit_s: float
    driver_limit_s: float
    group: str = field(default_factory=lambda: f"query-{uuid.uuid4().hex}")
    ended: threading.Event = field(default_factory=threading.Event)
    started: bool = False
    driver_s: float = 0.0
    task_s: float = 0.0
    expired_at: float | None = None
    result: object = None
    error: BaseException | None = None


class _Lane(threading.Thread):
    """A thread that runs tasks one after the other, each in a job group of its own."""

    def __init__(self, context: SparkContext):
        super().__init__(daemon=True)
        self._context = context
        self._tasks: queue.SimpleQueue = queue.SimpleQueue()
        self.jvm_thread = None
        self.start()

    def give(self, task: _Task | None) -> None:
        self._tasks.put(task)

    def run(self) -> None:
        thread = self._context._jvm.java.lang.Thread
        self.jvm_thread = thread.currentThread()
        while (task := self._tasks.get()) is not None:
            thread.interrupted()  # a late interrupt of the task before
            self._context.setJobGroup(task.group, "query under test", interruptOnCancel=True)
            task.started = True
            try:
                task.result = task.fn()
            except BaseException as e:
                task.error = e
            task.ended.set()


class Watcher(threading.Thread):
    """Keeps the limits of all tasks of a batch.

    The driver's part (analysis, planning) and the running tasks of a job are timed apart, each
    against the limit; a job that waits for free cores, because others run, loses nothing. A task over
    its limit is cancelled and its thread interrupted. One that does not end even then, such as an
    expression evaluated while planning, is left behind, and its lane gets a new thread.
    """

    POLL_S = 0.1
    GRACE_S = 2.0

    def __init__(self, context: SparkContext):
        super().__init__(daemon=True)
        self._context = context
        self._lock = threading.Lock()
        self._running: dict[str, tuple[_Task, _Lane]] = {}
        self._stop = threading.Event()
        self._free: list[_Lane] = []
        self.start()

    def limited(self, fn: Callable, limit_s: float, texts: int = 1) -> tuple[object, float]:
        """(result, seconds its jobs had running tasks) of ``fn``; raises what it raises, or ``TooSlow``.

        The driver may take the limit for each of the ``texts`` that ``fn`` plans together.
        """
        task = _Task(fn, limit_s, limit_s * texts)
        with self._lock:
            lane = self._free.pop() if self._free else None
        lane = lane or _Lane(self._context)
        with self._lock:
            self._running[task.group] = (task, lane)
        lane.give(task)
        task.ended.wait()
        with self._lock:
            self._running.pop(task.group, None)
            left_behind = task.result is None and task.error is None and task.expired_at is not None
            if not left_behind:
                self._free.append(lane)
        if left_behind:
            lane.give(None)
        if task.expired_at is not None:
            raise TooSlow(f"no result within {limit_s:g} s")
        if task.error is not None:
            raise task.error
        return task.result, task.task_s

    def _look(self, task: _Task, lane: _Lane, active: set[int], seconds: float) -> None:
        tracker = self._context.statusTracker()
        jobs = [j for j in tracker.getJobIdsForGroup(task.group) if j in active]
        if not jobs:
            task.driver_s += seconds
        else:
            stages = [s for j in jobs if (job := tracker.getJobInfo(j)) for s in job.stageIds]
            if any((stage := tracker.getStageInfo(s)) and stage.numActiveTasks for s in stages):
                task.task_s += seconds
        now = time.monotonic()
        if task.driver_s > task.driver_limit_s or task.task_s > task.limit_s:
            self._context.cancelJobGroup(task.group)
            if task.expired_at is None:
                task.expired_at = now
                if lane.jvm_thread is not None:
                    lane.jvm_thread.interrupt()
            elif now - task.expired_at > self.GRACE_S:
                task.ended.set()

    def run(self) -> None:
        last = time.monotonic()
        while not self._stop.wait(self.POLL_S):
            now = time.monotonic()
            seconds, last = now - last, now
            with self._lock:
                running = list(self._running.values())
            active = set(self._context.statusTracker().getActiveJobsIds()) if running else set()
            for task, lane in running:
                if task.started and not task.ended.is_set():
                    self._look(task, lane, active, seconds)

    def close(self) -> None:
        self._stop.set()
        with self._lock:
            for lane in self._free:
                lane.give(None)
            self._free.clear()


# --- many texts in one job ----------------------------------------------------------------------


def halves(items: list, run: Callable[[list], list], failed: Callable[[object, Exception], object]) -> list:
    """``run`` of all items at once; where that raises, of each half, down to the single items to blame."""
    if not items:
        return []
    try:
        return run(items)
    except Exception as e:  # any failure of one item is that item's outcome
        if len(items) == 1:
            return [failed(items[0], e)]
        middle = len(items) // 2
        return halves(items[:middle], run, failed) + halves(items[middle:], run, failed)


def packs(items: list, weight: Callable[[object], int], most: int, heaviest: int) -> list[list]:
    """Consecutive items in packs of at most ``most`` items and ``heaviest`` weight; a heavier item is alone."""
    out: list[list] = []
    total = 0
    for item in items:
        own = weight(item)
        if not out or len(out[-1]) >= most or total + own > heaviest:
            out.append([])
            total = 0
        out[-1].append(item)
        total += own
    return out
