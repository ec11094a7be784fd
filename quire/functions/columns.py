"""Text functions as column expressions. Offsets count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 4


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def token_count(text: Column | str) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(col(text)) / CHARS_PER_TOKEN)).cast("int")


def strip(text: Column | str) -> Column:
    """Without white space, in Unicode's sense, at either end."""
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")


# Marks around a public-domain text, and titles and files that hold no prose.
END_MARK = r"(?is)\*{3}\s*END OF (?:THIS |THE )?PROJECT GUTENBERG.*"
START_MARK = r"(?is)^.*?\*{3}\s*START OF (?:THIS |THE )?PROJECT GUTENBERG[^\*]*\*{3}"
NON_BODY_TITLE = (
    r"(?i)^\s*(title\s*page?|copyright|table\s*of\s*contents?|contents?|dedication|preface|foreword|introduction\s+by"
    r"|acknowledgements?|appendix|bibliography|index|glossary|notes?|about\s*the\s*author|colophon|epigraph|halftitle|cover)\s*$"
)
NON_CONTENT_FILE = r"(?i)(cover|toc|nav|ncx|colophon|titlepage|frontmatter|copyright)"


def strip_boilerplate(text: Column | str) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(col(text), END_MARK, ""), START_MARK, ""))


def is_non_body(title: Column | str) -> Column:
    return F.coalesce(col(title).rlike(NON_BODY_TITLE), F.lit(False))


def is_navigation_file(path: Column | str) -> Column:
    return F.coalesce(F.regexp_extract(col(path), r"([^/]*)$", 1).rlike(NON_CONTENT_FILE), F.lit(False))


def offsets_fit(content: Column, name: Column, start: Column, end: Column) -> Column:
    """Whether [start, end) lies in content and holds the name, or a part of it, in any case."""
    inside = start.isNotNull() & end.isNotNull() & (start >= 0) & (end > start) & (end <= F.length(content))
    held = F.lower(F.substring(content, start + 1, end - start))
    return F.coalesce(inside & (held.contains(F.lower(name)) | F.lower(name).contains(held)), F.lit(False))


def resolve_offsets(content: Column, name: Column, start: Column, end: Column) -> Column:
    """struct(start, end): as given where they fit, else of the name's first place in any case, else null."""
    found = F.instr(F.lower(content), F.lower(name)) - 1
    given = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))
    first = F.struct(found.cast("int").alias("start"), (found + F.length(name)).cast("int").alias("end"))
    return F.when(offsets_fit(content, name, start, end), given).when((F.length(name) > 0) & (found >= 0), first)


def content_hash(data: Column | str) -> Column:
    return F.sha2(col(data).cast("binary"), 256)


def global_offset(base: Column | str, offset: Column | str) -> Column:
    """An offset in a section as one in its chapter; a section without a start begins with it."""
    return F.coalesce(col(base), F.lit(0)) + col(offset)


def embed_version(version: Column | str) -> Column:
    """At least 1, which is also that of a book that has none."""
    return F.greatest(col(version), F.lit(1))


def snippet(content: Column, start: Column, end: Column, window: int = 40) -> Column:
    lo = F.greatest(F.lit(0), start - window)
    return F.substring(content, lo + 1, end + window - lo)


def display_title(title: Column | str, number: Column | str) -> Column:
    return F.coalesce(F.nullif(col(title), F.lit("")), F.concat(F.lit("Chapter "), col(number).cast("string")))


def any_summary(summary: Column | str, micro: Column | str, message: str) -> Column:
    return F.coalesce(F.nullif(col(summary), F.lit("")), F.nullif(col(micro), F.lit("")), F.lit(message))


def cover_url(mime: Column | str, data: Column | str) -> Column:
    return F.concat(F.lit("data:"), col(mime), F.lit(";base64,"), F.base64(col(data)))


def entity_type(label: Column | str) -> Column:
    return F.when(F.lower(col(label)) == "character", "PERSON").otherwise("PLACE")


def fenced_json(text: Column | str) -> Column:
    """Without the code fence around it: the first line where that opens one, and then the last where it closes it."""
    whole = strip(text)
    inner = F.regexp_replace(F.regexp_replace(whole, r"(?s)^```[^\n]*\n?", ""), r"(?s)\n?[ \t]*```[ \t]*$", "")
    return F.when(F.startswith(whole, F.lit("```")), inner).otherwise(whole)


def reader_reply(raw: Column | str) -> Column:
    """struct(answer, quotes) of a reader's reply: JSON, else the widest braces in it as JSON, else the raw text without quotes."""
    raw = col(raw)
    shape = "struct<answer:string,verbatim_quotes:array<string>>"
    whole = F.when(F.try_parse_json(raw).isNotNull(), F.from_json(raw, shape))
    braces = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    inner = F.when(F.try_parse_json(braces).isNotNull(), F.from_json(braces, shape))
    got = F.coalesce(whole, inner)
    answer = F.coalesce(F.nullif(strip(got["answer"]), F.lit("")), strip(raw))
    return F.struct(answer.alias("answer"), F.coalesce(got["verbatim_quotes"], F.array().cast("array<string>")).alias("quotes"))


def highlight(content: Column | str, text: Column, offset: Column) -> Column:
    """struct(start, end) of a quote in its passage: at its offset, else at its first place; null where it does not fit."""
    content = col(content)
    start = F.coalesce(offset, F.nullif(F.instr(content, text), F.lit(0)) - 1)
    end = start + F.length(text)
    return F.when((start >= 0) & (end <= F.length(content)), F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))
