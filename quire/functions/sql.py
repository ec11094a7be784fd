"""The library's rules as SQL functions, for queries that are text alone; ``register(spark)`` names them for a session.

They are expressions, so Catalyst sees through them: filters are pushed and columns pruned as if they were written out. Each says what the
function of the same purpose in ``columns`` or ``questions`` says, which the tests hold against each other.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from quire.functions import columns, questions

_SPAN = "STRUCT<start: INT, end: INT>"
#: name -> (arguments, result, expression)
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    "quire_token_count": ("text STRING", "INT", f"CAST(greatest(1, ceil(length(text) / {columns.CHARS_PER_TOKEN})) AS INT)"),
    "quire_offsets_fit": (
        "content STRING, name STRING, s INT, e INT",
        "BOOLEAN",
        "coalesce(s >= 0 AND e > s AND e <= length(content) AND (contains(lower(substring(content, s + 1, e - s)), lower(name)) OR contains(lower(name), lower(substring(content, s + 1, e - s)))), false)",
    ),
    "quire_resolve_offsets": (
        "content STRING, name STRING, s INT, e INT",
        _SPAN,
        "CASE WHEN quire_offsets_fit(content, name, s, e) THEN named_struct('start', s, 'end', e) "
        "WHEN length(name) > 0 AND instr(lower(content), lower(name)) > 0 THEN named_struct('start', instr(lower(content), lower(name)) - 1, 'end', instr(lower(content), lower(name)) - 1 + length(name)) END",
    ),
    "quire_snippet": ("content STRING, s INT, e INT", "STRING", "substring(content, greatest(0, s - 40) + 1, e + 40 - greatest(0, s - 40))"),
    "quire_global_offset": ("base INT, at INT", "INT", "coalesce(base, 0) + at"),
    "quire_quote_plan": (
        "n INT",
        "STRUCT<want: INT, sections: INT>",
        f"CASE WHEN n > 0 THEN named_struct('want', least(n, {questions.MOST_QUOTES}), 'sections', least({questions.MOST_SECTIONS}, least(n, {questions.MOST_QUOTES}) + {questions.MARGIN})) "
        f"ELSE named_struct('want', {questions.DEFAULT_QUOTES}, 'sections', {questions.LEAST_SECTIONS}) END",
    ),
    "quire_display_title": ("title STRING, number INT", "STRING", "coalesce(nullif(title, ''), concat('Chapter ', CAST(number AS STRING)))"),
    "quire_content_hash": ("data STRING", "STRING", "sha2(CAST(data AS BINARY), 256)"),
}


def register(spark: SparkSession) -> None:
    for name, (args, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} RETURN {body}")
