"""Splitters as table functions, for SQL: ``SELECT ... FROM documents d, LATERAL quire_chunks(d.text) c``.

``register(spark)`` names them:

* ``quire_chunks(text [, tokens [, overlap]])``: the overlapping chunks of a text's sections
* ``quire_sections(text [, tokens])``: its sections
* ``quire_headed(text)``: its chapters, by their headings, with their titles; a text without two of them is one chapter without a title

Rows are (ordinal from 0, content, char_start, char_end), or (ordinal, title, content). A null or empty text has none. Arguments are
looked at when a query is analysed: the text must be a string, and sizes constant whole numbers above zero (an overlap below its chunk).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, NullType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quire.functions import passages

PARTS = StructType().add("ordinal", IntegerType()).add("content", StringType()).add("char_start", IntegerType()).add("char_end", IntegerType())
TITLED = StructType().add("ordinal", IntegerType()).add("title", StringType()).add("content", StringType())


def _checked(name: str, schema: StructType, text: AnalyzeArgument, *sizes: AnalyzeArgument) -> AnalyzeResult:
    if text.isTable or not isinstance(text.dataType, (StringType, NullType)):
        raise ValueError(f"{name}: the text must be a string, not {text.dataType.simpleString()}")
    for s in sizes:
        if not s.isConstantExpression or not isinstance(s.value, int) or s.value < 1:
            raise ValueError(f"{name}: sizes must be constant whole numbers above zero")
    return AnalyzeResult(schema)


@udtf
class Chunks:
    @staticmethod
    def analyze(text: AnalyzeArgument, *sizes: AnalyzeArgument) -> AnalyzeResult:
        out = _checked("quire_chunks", PARTS, text, *sizes)
        given = [s.value for s in sizes]
        if len(given) > 2 or (len(given) == 2 and given[1] >= given[0]):
            raise ValueError("quire_chunks: an overlap must be below its chunk")
        return out

    def eval(self, text: str, tokens: int = passages.CHUNK_TOKENS, overlap: int = passages.OVERLAP_TOKENS) -> Iterator[tuple]:
        n = 0
        for section, at, _ in passages.sections(text):
            for content, start, end in passages.chunks(section, tokens, overlap):
                yield n, content, at + start, at + end
                n += 1


@udtf
class Sections:
    @staticmethod
    def analyze(text: AnalyzeArgument, *sizes: AnalyzeArgument) -> AnalyzeResult:
        if len(sizes) > 1:
            raise ValueError("quire_sections takes a text and a size")
        return _checked("quire_sections", PARTS, text, *sizes)

    def eval(self, text: str, tokens: int = passages.SECTION_TOKENS) -> Iterator[tuple]:
        for n, part in enumerate(passages.sections(text, tokens)):
            yield n, *part


@udtf
class Headed:
    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        return _checked("quire_headed", TITLED, text)

    def eval(self, text: str) -> Iterator[tuple]:
        from quire.sources import epub

        if not (text or "").strip():
            return
        for n, c in enumerate(epub.untitled([("text.xhtml", text.strip())])):
            yield n, None if c.is_synthetic else c.title, c.text


def register(spark: SparkSession) -> None:
    for name, f in (("quire_chunks", Chunks), ("quire_sections", Sections), ("quire_headed", Headed)):
        spark.udtf.register(name, f)
