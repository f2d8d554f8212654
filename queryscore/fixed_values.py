"""Fixed values that results depend on: they must stay exactly as they are.

Word lists, weights, patterns and message formats only; no logic lives here.
"""

# Words a statement may not start with (prefix match after left trim, lower case).
WRITE_WORDS = [
    "insert", "update", "delete", "drop", "alter", "create", "replace",
    "attach", "detach", "pragma", "vacuum", "reindex", "truncate", "begin",
    "commit",
]

# Words a scoreable statement must start with.
SELECT_WORDS = ["select", "with"]

# Reward weights.
R2_EXEC = 3.0
R2_SYNTAX = 1.0
R2_SCHEMA = 1.0
R2_NGRAM = 1.0
R2_FORMAT = 1.0
R3_DESCRIBE = 0.2
R3_EXECUTABLE = 0.3
R3_EXEC = 1.0
R1_MAX = 1.0
R2_MAX = 7.0

# Limits.
PREVIEW_ROWS = 50
CELL_CHARS = 200
SAMPLE_ROWS = 3
FALLBACK_TABLES = 3
ERROR_CHARS = 200
MAX_TURNS = 8
PREVIEW_TIMEOUT_S = 5.0
MATCH_TIMEOUT_S = 30.0
ROLLING_WINDOW = 12
TAIL_STEPS = 50
STRATA = 4

# Tool names.
LIST_TABLES = "list_tables"
DESCRIBE_TABLE = "describe_table"
RUN_SQL = "run_sql"

# Texts.
SYSTEM_PROMPT = (
    "You are a Text-to-SQL agent. Inspect the database with the tools, then answer.\n"
    "Tools: list_tables; describe_table(table); run_sql(query) — read-only SELECT only.\n"
    "When confident, output the final query on its own line exactly as:\n"
    "FINAL SQL: <single SELECT query>"
)
ELLIPSIS = "…"
NULL_CELL = "NULL"
FINAL_MARKER = "FINAL SQL: "
LIST_TABLES_TURN = "Let me see the available tables."
DESCRIBE_TURN = "Let me inspect the relevant tables."
READ_ONLY_ERROR = "read-only: write statements are rejected"
NO_TABLES = "No tables."

# White space as Unicode text functions strip it, usable as a trim list ...
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# ... and as the body of a regex character class.
SPACE_CLASS = (
    r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a"
    r"\u2028\u2029\u202f\u205f\u3000"
)
# A word token (ASCII letter or underscore, then Unicode letters, digits, underscores)
# or any single other visible character.
TOKEN_PATTERN = rf"[A-Za-z_][\p{{L}}\p{{N}}_]*|[^{SPACE_CLASS}]"
# The answer marker, then everything after it.
FINAL_SQL_PATTERN = rf"(?is)final[{SPACE_CLASS}]+sql:[{SPACE_CLASS}]*(.*)"
# A leading fenced block.
FENCE_PATTERN = rf"(?is)\A```(?:sql)?[{SPACE_CLASS}]*(.+?)```"
