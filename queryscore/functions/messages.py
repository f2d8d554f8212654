"""Column functions over chat messages: arrays of (role, content, tool_calls) structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from queryscore import fixed_values as fv

TOOL_CALL = "struct<id:string,name:string,arguments:string>"
MESSAGE = (
    f"struct<role:string,content:string,tool_calls:array<{TOOL_CALL}>,"
    "tool_call_id:string,name:string>"
)


def completion_text(messages: Column) -> Column:
    """Message contents joined by line breaks; null contents are skipped."""
    return F.concat_ws("\n", messages.getField("content"))


def tool_names(messages: Column) -> Column:
    """Names of the called tools in order; null and empty names are dropped."""
    calls = F.flatten(F.array_compact(messages.getField("tool_calls")))
    names = F.coalesce(calls.getField("name"), F.array().cast("array<string>"))
    return F.array_remove(F.array_compact(names), "")


def called_describe(messages: Column) -> Column:
    """A describe call was made, or the text mentions one."""
    called = F.array_contains(tool_names(messages), fv.DESCRIBE_TABLE)
    return F.coalesce(called, F.lit(False)) | completion_text(messages).contains(fv.DESCRIBE_TABLE)


def message(
    role: str, content: Column, tool_calls: Column | None = None,
    call_id: Column | None = None, name: Column | None = None,
) -> Column:
    null = F.lit(None)
    return F.struct(
        F.lit(role).alias("role"),
        content.alias("content"),
        (null if tool_calls is None else tool_calls).cast(f"array<{TOOL_CALL}>").alias("tool_calls"),
        (null if call_id is None else call_id).cast("string").alias("tool_call_id"),
        (null if name is None else name).cast("string").alias("name"),
    )


def _with_evidence(text: Column, evidence: Column) -> Column:
    return F.concat(
        text,
        F.when(F.coalesce(evidence, F.lit("")) != "", F.concat(F.lit("\nEvidence: "), evidence))
        .otherwise(""),
    )


def question_text(question: Column, db_id: Column, evidence: Column) -> Column:
    """User text of the tool-using prompt."""
    return _with_evidence(
        F.concat(F.lit("Question: "), question, F.lit("\nDatabase: "), db_id), evidence
    )


def schema_question_text(schema: Column, question: Column, evidence: Column) -> Column:
    """User text of the single-turn prompt."""
    return _with_evidence(
        F.concat(F.lit("Schema:\n"), schema, F.lit("\n\nQuestion: "), question), evidence
    )


def system_message() -> Column:
    return message("system", F.lit(fv.SYSTEM_PROMPT))
