"""Prompts and training examples as arrays of messages, and corpus selection.

Everything about one question happens inside its row; schema texts, table lists and
table descriptions are attached by one equi-join per database.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queryscore import fixed_values as fv
from queryscore.functions.messages import (
    TOOL_CALL, message, question_text, schema_question_text, system_message,
)
from queryscore.functions.similarity import table_names
from queryscore.functions.sql_text import strip
from queryscore.operators.filters import usable
from queryscore.operators.skew import SMALL_HEAD, dealt_by_order, first_per_group, left_join_skewed, nth_by_counts
from queryscore.scratch import materialise
from queryscore.sources.database import list_tables



def prompt_messages() -> Column:
    """System and user message of the tool-using prompt."""
    user = question_text(F.col("question"), F.col("db_id"), F.col("evidence"))
    return F.array(system_message(), message("user", user))


def grpo_dataset(questions: DataFrame) -> DataFrame:
    """(qid, prompt, gold_sql, db_path)."""
    return questions.select("qid", prompt_messages().alias("prompt"), "gold_sql", "db_path")


def attach_schema(records: DataFrame, schemas: DataFrame) -> DataFrame:
    """Add ``schema`` by ``db_id``; "" where there is none."""
    joined = left_join_skewed(records, schemas.select("db_id", "schema"), ["db_id"])
    return joined.withColumn("schema", F.coalesce("schema", F.lit("")))


def _schema_prompt(question: str, evidence: str) -> list[Column]:
    user = schema_question_text(F.col("schema"), F.col(question), F.col(evidence))
    return [system_message(), message("user", user)]


def singleturn_prompts(questions: DataFrame, schemas: DataFrame) -> DataFrame:
    """(qid, messages): schema and question in one prompt."""
    return attach_schema(questions, schemas).select(
        "qid", F.array(*_schema_prompt("question", "evidence")).alias("messages")
    )


def sft_examples(questions: DataFrame, schemas: DataFrame, databases: DataFrame) -> DataFrame:
    """(qid, messages): the single-turn prompt answered with the gold query."""
    answer = message("assistant", F.concat(F.lit(fv.FINAL_MARKER), F.col("gold_sql")))
    return attach_schema(usable(questions, databases), schemas).select(
        "qid", F.array(*_schema_prompt("question", "evidence"), answer).alias("messages")
    )


def synth_to_sft(synth: DataFrame, schemas: DataFrame) -> DataFrame:
    """(pos, messages): synthetic records answered with their reasoning and query."""
    blank = {c: F.coalesce(c, F.lit("")) for c in ("db_id", "question", "external_knowledge", "cot", "sql")}
    answer = strip(F.concat("cot", F.lit("\n" + fv.FINAL_MARKER), "sql"))
    return attach_schema(synth.withColumns(blank), schemas).select(
        "pos",
        F.array(*_schema_prompt("question", "external_knowledge"), message("assistant", answer)).alias("messages"),
    )


def mix_corpora(**sources: DataFrame | None) -> DataFrame:
    """(source, messages) over the given corpora; sources passed as None are left out."""
    parts = [
        df.select(F.lit(name).alias("source"), "messages")
        for name, df in sources.items() if df is not None
    ]
    if not parts:
        raise ValueError("no corpus given")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _catalog(columns: DataFrame) -> DataFrame:
    """(db_id, _all, _by_name, _list): table names, their spelling by lower case, list text."""
    # Of names that differ in case only, the first stands for all.
    lower = F.transform("tables", F.lower)
    firsts = F.array_distinct(lower)
    by_name = F.map_from_arrays(firsts, F.transform(firsts, lambda n: F.get("tables", (F.array_position(lower, n) - 1).cast("int"))))
    return list_tables(columns).select(
        "db_id", F.col("tables").alias("_all"), by_name.alias("_by_name"), F.col("text").alias("_list")
    )


def _named_tables(sql: str) -> Column:
    named = F.array_compact(F.transform(table_names(F.col(sql)), lambda t: F.col("_by_name")[t]))
    return F.when(F.size(named) > 0, named).otherwise(F.slice("_all", 1, fv.FALLBACK_TABLES))


def gold_tables(queries: DataFrame, columns: DataFrame, sql: str = "gold_sql") -> DataFrame:
    """Add ``tables``: the query's tables that exist, in catalog spelling and query order.

    Without any, the first few tables of the database by name.
    """
    joined = left_join_skewed(queries, _catalog(columns), ["db_id"])
    return joined.select(*queries.columns, _named_tables(sql).alias("tables"))


def agentic_trajectories(
    questions: DataFrame, databases: DataFrame, columns: DataFrame, descriptions: DataFrame
) -> DataFrame:
    """(qid, messages): list the tables, describe those the gold query uses, answer.

    Questions without gold, and those of a database without tables or descriptions, are left
    out (``written_and_skipped`` counts them); no row is null.
    """
    described = descriptions.groupBy("db_id").agg(
        F.map_from_entries(F.collect_list(F.struct("table_name", "text"))).alias("_texts")
    )
    per_db = _catalog(columns).join(described, "db_id")
    rows = left_join_skewed(
        usable(questions, databases), per_db, ["db_id"]
    ).filter(F.col("_list").isNotNull()).withColumn("tables", _named_tables("gold_sql"))

    list_call = F.array(_call(F.lit(1), fv.LIST_TABLES, F.lit("{}")))
    table_call = lambda t, i: _call(
        i + 2, fv.DESCRIBE_TABLE, F.to_json(F.struct(t.alias("table")))
    )
    call_id = lambda i: F.concat(F.lit("call_"), (i + 2).cast("string"))
    results = F.transform(
        "tables",
        lambda t, i: message("tool", F.col("_texts")[t], call_id=call_id(i), name=F.lit(fv.DESCRIBE_TABLE)),
    )
    messages = F.concat(
        prompt_messages(),
        F.array(
            message("assistant", F.lit(fv.LIST_TABLES_TURN), list_call),
            message("tool", F.col("_list"), call_id=F.lit("call_1"), name=F.lit(fv.LIST_TABLES)),
            message("assistant", F.lit(fv.DESCRIBE_TURN), F.transform("tables", table_call)),
        ),
        results,
        F.array(message("assistant", F.concat(F.lit(fv.FINAL_MARKER), F.col("gold_sql")))),
    )
    told = F.forall("tables", lambda t: F.col("_texts")[t].isNotNull())
    return rows.filter(told).select("qid", messages.alias("messages"))


def written_and_skipped(questions: DataFrame, examples: DataFrame) -> DataFrame:
    """One row (written, skipped)."""
    written = examples.agg(F.count(F.lit(1))).scalar()
    return questions.agg(F.count(F.lit(1)).alias("asked")).select(
        written.alias("written"), (F.col("asked") - written).alias("skipped")
    )


def _call(number: Column, name: str, arguments: Column) -> Column:
    call = F.struct(
        F.concat(F.lit("call_"), number.cast("string")).alias("id"),
        F.lit(name).alias("name"), arguments.alias("arguments"),
    )
    return call.cast(TOOL_CALL)


def stratified_head(
    df: DataFrame, key: str, total: int, order: str, strata: int = fv.STRATA
) -> DataFrame:
    """Per stratum the first ``total // strata`` records (at least 1) by ``order``, at most
    ``total`` in all; a missing stratum counts as "_".

    The cuts come from counts of (stratum, range of positions): no stratum, and no head of
    ``total`` rows, meets in one task; a small total is ranked at once instead. They then filter the
    wide records where they are, without shuffling them. Positions must be unique.
    """
    per = max(1, total // strata)
    stratum = F.coalesce(F.col(key).cast("string"), F.lit("_"))
    narrow = df.select(stratum.alias("_stratum"), F.col(order).alias("_place"))
    if total <= SMALL_HEAD:
        chosen = first_per_group(narrow, ["_stratum"], "_place", per).orderBy("_place").limit(total)
        cuts = chosen.groupBy("_stratum").agg(F.max("_place").alias("_last"))
        rows = df.withColumn("_stratum", stratum).join(cuts, "_stratum").where(F.col(order) <= F.col("_last"))
        return rows.drop("_stratum", "_last")
    places = dealt_by_order(narrow, "_place")
    cuts = materialise(nth_by_counts(places, ["_stratum"], "_place", per), "cuts")
    chosen = left_join_skewed(places, cuts, ["_stratum"]).where("_last IS NULL OR _place <= _last").drop("_last")
    # of what the strata admit, the first ``total``
    last = nth_by_counts(chosen, [], "_place", total).agg(F.max("_last")).scalar()
    rows = df.withColumn("_stratum", stratum).join(cuts, "_stratum", "left").where(F.col("_last").isNull() | (F.col(order) <= F.col("_last")))
    return rows.where(last.isNull() | (F.col(order) <= last)).drop("_stratum", "_last")
