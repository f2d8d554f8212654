"""Texts that are alike but for the whole numbers they look up, run as one join.

``SELECT … FROM t WHERE k = 7`` for thousands of keys would be analysed thousands of times and read ``t`` as
often. Such texts become one: their numbers are a table of keys, joined with the table that one of them reads, and
its expressions are computed from the rows of this join. Only texts that project a filtered table of their database
are taken, so the rows of a key are those that its text returns alone. An expression that fails marks its row and
with it the text, no other; the failing rows tell the error of each text.
"""

from __future__ import annotations

import itertools
import json
import re
import uuid
from dataclasses import dataclass
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from queryscore.operators.dispatch import LOGICAL, own_view, read_only_query, trees

#: Texts that share a join, and the fewest that are worth one.
LOOKUPS, LEAST_LOOKUPS = 16384, 16

# A number that is compared for equality; and texts in which it can be nothing else: no quotes and no comments.
_NUMBER = r"(?<![<>!=])=[ \t\r\n]*([0-9]{1,9})(?![A-Za-z0-9_.])"
_PLAIN = r"[A-Za-z0-9_ \t\r\n.,()<>=*+/%-]*"

_EXPRESSIONS = "org.apache.spark.sql.catalyst.expressions."
# Conditions that cannot fail and hold for a row only if each of their parts does.
_CONDITIONS = {"And", "EqualTo", "LessThan", "LessThanOrEqual", "GreaterThan", "GreaterThanOrEqual", "IsNotNull", "IsNull"}
_VALUES = {"AttributeReference", "Literal"}
_INTEGRAL = {"byte", "short", "integer", "long"}


def shape_of(sql: str) -> str | None:
    """The text with ``?`` for each number that it may look up; None if there is none."""
    plain = re.fullmatch(_PLAIN, sql) and "--" not in sql and "/*" not in sql
    shape, found = re.subn(_NUMBER, "= ?", sql) if plain else (None, 0)
    return shape if found else None


def shape_order(sql: Column) -> Column:
    """``shape_of`` to sort by."""
    plain = sql.rlike(f"^{_PLAIN}\\z") & ~sql.contains("--") & ~sql.contains("/*")
    return F.when(plain & sql.rlike(_NUMBER), F.regexp_replace(sql, _NUMBER, "= ?"))


@dataclass
class Lookup:
    """What texts of one shape look up: the columns of a table, in the order of the numbers."""

    shape: str
    table: str
    columns: list[str]
    types: list
    plan: object  # the analysed plan of one such text

    def __post_init__(self):
        node, self._projects = self.plan, []
        while _kind(node) != "Filter":
            if _kind(node) == "Project":
                self._projects.insert(0, _items(node.projectList()))
            node = node.children().apply(0)
        self._table, conditions = node.children().apply(0), _conditions(node.condition())
        self._equal = [c for c in conditions if _is_key(c)]
        self._others = [c for c in conditions if not _is_key(c)]
        read = [*itertools.chain(*self._projects), *conditions]
        ids = {a.exprId().toString() for e in read for a in _items(e.references().toSeq())}
        output = list(enumerate(_items(self._table.output())))
        self._read = [(i, a) for i, a in output if a.exprId().toString() in ids]
        computing = [i for i, items in enumerate(self._projects) if not all(map(_plain, items))]
        #: The one projection that computes anything; values that others compute from may be dropped unseen.
        self._computing = computing[0] if len(computing) == 1 else None

    @property
    def checked(self) -> bool:
        """Whether rows that break their text can be told from others."""
        return self._computing is not None


def _name(node: dict) -> str:
    return node["class"].removeprefix(LOGICAL).removeprefix(_EXPRESSIONS)


def _size(nodes: list[dict]) -> int:
    """How many nodes from the first on are its tree."""
    open_ = 1
    for i, node in enumerate(nodes):
        open_ += node["num-children"] - 1
        if open_ == 0:
            return i + 1
    return len(nodes)


def _key_column(equal: list[dict]) -> str | None:
    """The name of the whole-number column in ``column = number``, from the nodes that begin there."""
    column, value = equal[1:3]
    widened = column["class"].endswith(".Cast")  # a narrower column
    if widened:
        column, value = equal[2:4]
    if value["class"].endswith(".Cast"):
        value = equal[equal.index(value) + 1]
    whole = _name(column) == "AttributeReference" and column["dataType"] in _INTEGRAL
    return column["name"] if whole and _name(value) == "Literal" and value["dataType"] == "integer" else None


def _conjuncts(nodes: list[dict]) -> list[list[dict]]:
    """The conditions that must all hold, each as its nodes."""
    if _name(nodes[0]) != "And":
        return [nodes]
    end = 1 + _size(nodes[1:])
    return _conjuncts(nodes[1:end]) + _conjuncts(nodes[end:])


def _keys_of_condition(nodes: list[dict]) -> tuple[list[str], list[str]] | None:
    """(columns that rows must have equal to a whole number, these numbers); None if a condition does anything but compare."""
    columns, numbers = [], []
    for part in _conjuncts(nodes):
        if _name(part[0]) == "EqualTo" and (column := _key_column(part)) is not None:
            columns.append(column)
            numbers.append(next(n["value"] for n in part if _name(n) == "Literal"))
            continue
        for i, node in enumerate(part):
            constant = _name(node) == "Cast" and _name(part[i + 1]) == "Literal"
            if _name(node) not in _CONDITIONS and _name(node) not in _VALUES and not constant:
                return None
    return columns, numbers


# The same of the plans themselves.


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _conditions(condition) -> list:
    return _conditions(condition.left()) + _conditions(condition.right()) if _kind(condition) == "And" else [condition]


def _is_key(condition) -> bool:
    return _kind(condition) == "EqualTo" and _key_column(trees(json.loads(condition.toJSON()))[0]) is not None


def _plain(item) -> bool:
    """Whether a projected column is one of the columns below or a constant."""
    return _kind(item.child() if _kind(item) == "Alias" else item) in _VALUES


def lookup_of(session: SparkSession, sql: str) -> Lookup | None:
    """What ``sql`` looks up; None unless it only projects and sorts rows of one table, all numbers of its shape being keys."""
    shape = shape_of(sql)
    if shape is None:
        return None
    # numbers that the text does not have: where they show up is where its own are
    unused = (str(n) for n in itertools.count(1_000_000) if str(n) not in sql)
    numbers = list(itertools.islice(unused, shape.count("?")))
    df = read_only_query(session, _filled(shape, numbers))
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return None
    nodes = trees(json.loads(plan.toJSON()))[0]
    end = next((i + 1 for i, node in enumerate(nodes) if own_view(node)), 0)
    nodes = nodes[:end]
    kinds = [_name(n) for n in nodes]
    if kinds.count("Filter") != 1 or any(n["num-children"] != 1 for n in nodes[:-1]):
        return None
    at = kinds.index("Filter")
    if not set(kinds[:at]) <= {"Project", "Sort"} or "Project" not in kinds[:at] or not set(kinds[at + 1 : -1]) <= {"SubqueryAlias"}:
        return None
    inner = [t for n in nodes[:-1] for t in trees([v for k, v in n.items() if k != "class"])]
    if any(n["class"].startswith(LOGICAL) or "Subquery" in n["class"] or n["class"].endswith(".Exists") for t in inner for n in t):
        return None
    order = [n for s in nodes[:at] if _name(s) == "Sort" for t in trees(s["order"]) for n in t]
    if any(_name(n) not in {"SortOrder", "AttributeReference"} for n in order):
        return None
    found = _keys_of_condition(trees(nodes[at]["condition"])[0])
    if found is None or found[1] != numbers:
        return None
    return Lookup(shape, nodes[-1]["desc"]["identifier"]["table"], found[0], [f.dataType for f in df.schema.fields], plan)


def _filled(shape: str, values: list[str]) -> str:
    parts = shape.split("?")
    return parts[0] + "".join(v + p for v, p in zip(values, parts[1:], strict=True))


def _column(session: SparkSession, expression) -> Column:
    return Column(session._jvm.org.apache.spark.sql.classic.ExpressionUtils.column(expression))


def _tried(session: SparkSession, values: list) -> Column:
    """A struct of values; null if one of them fails."""
    jvm = session._jvm
    expressions = jvm.org.apache.spark.sql.catalyst.expressions
    literal = getattr(getattr(expressions, "Literal$"), "MODULE$")
    fields = [x for i, value in enumerate(values) for x in (literal.apply(f"c{i}"), value)]
    return _column(session, expressions.TryEval(expressions.CreateNamedStruct(jvm.PythonUtils.toSeq(fields))))


def _table(session: SparkSession, lookup: Lookup) -> DataFrame:
    return DataFrame(session._jvm.org.apache.spark.sql.classic.Dataset.ofRows(session._jsparkSession, lookup._table), session)


def _joined(session: SparkSession, lookup: Lookup, texts: list[str], more: pa.Array | None = None) -> tuple[DataFrame, Column, Column]:
    """(the rows of the table that a text wants, with two more columns: the number of this text; what ``more`` has for it)."""
    own = uuid.uuid4().hex
    query, extra, *keys = [f"{name}_{own}" for name in ("query", "more", *range(len(lookup.columns)))]
    numbers = [[int(x) for x in re.findall(_NUMBER, text)] for text in texts]
    columns = {query: pa.array(range(len(texts)), pa.int32())}
    columns |= {k: pa.array([n[i] for n in numbers], pa.int32()) for i, k in enumerate(keys)}
    columns[extra] = pa.nulls(len(texts), pa.int64()) if more is None else more
    rows = _table(session, lookup)
    for condition in lookup._others:
        rows = rows.where(_column(session, condition))
    same = [_column(session, e.left()) == F.col(k) for e, k in zip(lookup._equal, keys, strict=True)]
    # a row per text, LOOKUPS at most
    rows = rows.join(F.broadcast(session.createDataFrame(pa.table(columns))), reduce(and_, same))
    return rows, F.col(query), F.col(extra)


def _hashed(session: SparkSession, lookup: Lookup) -> list[Column]:
    """What the texts read of the table, but for types without a hash."""
    return [_column(session, a) for _, a in lookup._read if not re.search("map<|variant", a.dataType().catalogString())]


#: The first columns of ``looked_up``.
NUMBERED = ["query", "failed", "failing"]


def looked_up(session: SparkSession, lookup: Lookup, texts: list[str]) -> DataFrame:
    """The rows of all texts behind ``NUMBERED``: the number of the text, whether the row breaks it, and if so a hash of that row.

    A row that breaks its text has null values. ``session`` must not take common parts out of
    expressions, or they fail outside of what marks failures.
    """
    jvm = session._jvm
    rows, query, _ = _joined(session, lookup, texts)
    kept, failing = [query], F.lit(None).cast("long")
    for at, items in enumerate(lookup._projects):
        if at == lookup._computing:
            computed = [i for i in items if not _plain(i)]
            tried, name = (f"{name}_{uuid.uuid4().hex}" for name in ("tried", "failing"))
            rows = rows.select("*", _tried(session, [i.child() for i in computed]).alias(tried))
            field = jvm.org.apache.spark.sql.catalyst.expressions.GetStructField
            struct = rows._jdf.queryExecution().analyzed().output().last()
            values = iter([field(struct, i, jvm.scala.Option.empty()) for i in range(len(computed))])
            items = [i if _plain(i) else i.withNewChildren(jvm.PythonUtils.toSeq([next(values)])) for i in items]
            failing = F.when(F.col(tried).isNull(), F.xxhash64(*_hashed(session, lookup)))
            rows = rows.select(query, failing.alias(name), *[_column(session, i) for i in items])
            kept.append(failing := F.col(name))
        else:
            rows = rows.select(*kept, *[_column(session, i) for i in items])
    values = [_column(session, i) for i in _items(lookup.plan.output())]
    rows = rows.select(query, failing.isNotNull(), failing, *values)
    if [f.dataType for f in rows.schema.fields[len(NUMBERED):]] != lookup.types:
        raise ValueError("the texts have other columns together")
    return rows


def failing_rows(session: SparkSession, lookup: Lookup, texts: list[str], failing: list[int]) -> DataFrame:
    """(query, …): for each text that breaks a row of the table with the hash given, as far as the text reads it."""
    rows, query, failing = _joined(session, lookup, texts, pa.array(failing, pa.int64()))
    rows = rows.where(F.xxhash64(*_hashed(session, lookup)) == failing)
    read = [F.first(_column(session, a)).alias(f"c{i}") for i, a in lookup._read]
    return rows.groupBy(query.alias("query")).agg(*read)


def stand_in(session: SparkSession, lookup: Lookup, failing: DataFrame) -> None:
    """Let the texts read some of their ``failing_rows`` in place of their table: what breaks them does so while planning."""
    types = [f.dataType for f in _table(session, lookup).schema.fields]
    names = [a.name() for a in _items(lookup._table.output())]
    found = {f"c{i}" for i, _ in lookup._read}
    cells = [(F.col(f"c{i}") if f"c{i}" in found else F.lit(None).cast(t)).alias(name) for i, (name, t) in enumerate(zip(names, types, strict=True))]
    rows = failing.select(*cells)._jdf
    session._jsparkSession.createDataFrame(rows.collectAsList(), rows.schema()).createOrReplaceTempView(f"`{lookup.table}`")
