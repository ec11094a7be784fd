"""What the recipes take from a library before a model is asked, chapter detection, and extraction, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import columns as C
from quire.functions import questions as Q
from quire.operators import extraction, graph, lookups, patterns, quotes, retrieval
from quire.plans import catalog
from quire.plans.catalog import CH, DATES, VECTORS, M_SQL, chapters, first_vector, mentions, nations, query, read, vectors
from quire.sources import epub

# searches

_TF = "ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))"
_COS = "1 - list_cosine_similarity(e.embedding::DOUBLE[], vq.v::DOUBLE[])"


def _hybrid_sql(top: int, lists: int, boost: float = 1.0, dates: bool = False, cut: int | None = None) -> str:
    """The fusion of the best ``lists`` by words ("thing"), by vector, and maybe of ten dates."""
    from quire.functions.english import STOP

    stop = ", ".join("'" + w + "'" for w in sorted(STOP))
    third = " UNION ALL SELECT section_id, 2, rank, 0.5 FROM dl" if dates else ""
    date_cte = f", {DATES}, dl AS (SELECT *, row_number() OVER (ORDER BY section_id) AS rank FROM (SELECT DISTINCT section_id::VARCHAR AS section_id FROM od WHERE raw_text ILIKE '%1995%' OR raw_text ILIKE '%may%' ORDER BY 1 LIMIT 10))" if dates else ""
    return f"""
WITH {CH}, {VECTORS}, w AS (SELECT chapter_id, is_body, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+'), lambda x: x NOT IN ({stop})) AS w FROM num),
c AS (SELECT chapter_id, is_body, len(w)::DOUBLE AS n, len(list_filter(w, lambda x: regexp_matches(x, '^thing(e|s|es|ed|ing|ings|ness|ful)?$')))::DOUBLE AS tf FROM w WHERE len(w) > 0),
g AS (SELECT count(*)::DOUBLE AS docs, avg(n) AS mean, count(*) FILTER (WHERE tf > 0)::DOUBLE AS df FROM c),
ll AS (SELECT chapter_id::VARCHAR AS section_id, row_number() OVER (ORDER BY {_TF} DESC, chapter_id::VARCHAR) AS rank FROM c, g WHERE is_body AND tf > 0 QUALIFY rank <= {lists}),
vq AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0),
near AS (SELECT section_id, {_COS} AS distance FROM v e, vq WHERE is_body ORDER BY 2, section_id LIMIT {lists}),
sl AS (SELECT section_id::VARCHAR AS section_id, row_number() OVER (ORDER BY distance, section_id::VARCHAR) AS rank FROM near){date_cte},
u AS (SELECT section_id, 0 AS list_no, rank, {boost} AS w FROM ll UNION ALL SELECT section_id, 1, rank, 1.0 FROM sl{third}),
f AS (SELECT section_id, sum(w / (60 + rank)) AS score, min({{'l': list_no, 'r': rank}}) AS first FROM u GROUP BY 1),
b AS (SELECT *, row_number() OVER (ORDER BY score DESC, first.l, first.r, section_id) AS place FROM f QUALIFY place <= {top})
SELECT section_id, round(score, 9) AS score FROM b{f" WHERE place <= {cut}" if cut else ""}"""


def _search(spark, d, top: int, lists: int, boost: bool = False, dates: bool = False):
    lexical = retrieval.text_search(catalog._text_sections(spark, d), "the thing", lists)
    near = retrieval.semantic_search(vectors(spark, d).withColumn("section_id", F.col("section_id").cast("string")), first_vector(spark, d), lists)
    found = retrieval.date_sections(catalog.order_dates(spark, d).withColumn("section_id", F.col("section_id").cast("string")), "What came in May 1995?") if dates else None
    return retrieval.hybrid_search(lexical, near, found, boost, top)


def _rounded(rows):
    return rows.select("section_id", F.round("score", 9).alias("score"))


@query(_hybrid_sql(10, 20, dates=True))
def hybrid_search(spark, d):
    return _rounded(_search(spark, d, 10, 20, dates=True))


@query(_hybrid_sql(10, 20, boost=1.5))
def hybrid_boosted(spark, d):
    return _rounded(_search(spark, d, 10, 20, boost=True))


@query(_hybrid_sql(5, 10, cut=3))
def fact_sections(spark, d):
    """The sections that a fact question reads: three of the best five."""
    return _rounded(retrieval.first_sections(_search(spark, d, 5, 10), 3))


@query(_hybrid_sql(6, 12, cut=3))
def generic_sections(spark, d):
    return _rounded(retrieval.first_sections(_search(spark, d, 6, 12), 3))


@query(_hybrid_sql(10, 20))
def quote_sections(spark, d):
    """The sections that a question for seven quotes reads: as many as the plan says, and no fewer than five."""
    plan = spark.range(1).select(Q.quote_plan(Q.quote_count(F.lit("Give me 7 quotes about the thing")))["sections"]).first()[0]
    return _rounded(_search(spark, d, max(5, plan), 2 * max(5, plan)))


@query(_hybrid_sql(3, 6, cut=1).replace("SELECT section_id, round(score, 9) AS score FROM b", "SELECT section_id, ordinal::BIGINT AS ordinal FROM b JOIN ch ON chapter_id::VARCHAR = section_id"))
def why_anchor(spark, d):
    """The section that a why-question starts from, and the ordinal of its chapter, behind which it goes on."""
    hits = retrieval.first_sections(_search(spark, d, 3, 6), 1)
    at = chapters(spark, d).select(F.col("chapter_id").cast("string").alias("section_id"), F.col("ordinal").cast("long").alias("ordinal"))
    return hits.select("section_id").join(at, "section_id")


@query(
    """
SELECT n_nationkey AS entity_id, count(s_suppkey) AS places, min(s_suppkey)::INT AS first FROM nation JOIN region ON n_regionkey = r_regionkey
LEFT JOIN supplier ON s_nationkey = n_nationkey WHERE n_name ILIKE '%NATION_1%' OR r_name ILIKE '%NATION_1%' GROUP BY 1
"""
)
def located_entities(spark, d):
    """What "Where does NATION_1 appear?" finds: the name, the entities that hold it, and where they occur."""
    name = spark.range(1).select(Q.entity_name(F.lit("Where does NATION_1 appear in the book?"))).first()[0]
    rows = lookups.entities(nations(spark, d), catalog.nation_places(spark, d), chapters(spark, d), name)
    return rows.select("entity_id", F.size("occurrences").cast("long").alias("places"), F.get("occurrences", F.lit(0))["char_offset_start"].alias("first"))


@query(f"WITH {CH} SELECT book_id, 'Chapter ' || number AS title, coalesce(nullif(text, ''), 'No summary available.') AS summary FROM num WHERE is_body AND number = 3")
def asked_chapter(spark, d):
    """The chapter that "Sum up the third chapter" means, with its summary, of each book."""
    n = spark.range(1).select(Q.chapter_number(F.lit("Sum up the third chapter"))).first()[0]
    rows = lookups.chapter(chapters(spark, d, text=True), n)
    return rows.select("book_id", C.display_title(F.lit(""), "number").alias("title"), C.any_summary("text", F.lit(None).cast("string"), "No summary available.").alias("summary"))


@query(
    f"""
WITH {M_SQL}, t AS (SELECT * FROM e ORDER BY shared DESC, a, b LIMIT 12), k AS (SELECT n_name AS name, n_regionkey <= 2 AS person FROM nation)
SELECT CASE WHEN x.person AND y.person THEN 'people' ELSE 'places' END AS block, '  ' || a || ' + ' || b || ': ' || shared AS line FROM t JOIN k x ON x.name = a JOIN k y ON y.name = b
"""
)
def structured_edges(spark, d):
    """The strongest edges as the view of relations shows them."""
    return graph.edge_lines(graph.edges(mentions(spark, d), 12), nations(spark, d)).select("block", "line")


# chapter detection

BOUNDED = "CASE doc_id % 4 WHEN 0 THEN 'Front matter *** START OF THE PROJECT GUTENBERG EBOOK ' || doc_id || ' *** ' || text || ' *** END OF THE PROJECT GUTENBERG EBOOK *** licence' WHEN 1 THEN text || '***END OF PROJECT GUTENBERG ' || lang WHEN 2 THEN 'x *** start of this project gutenberg book ***' || text ELSE text END"


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(b, '(?is)\*{3}\s*END OF (?:THIS |THE )?PROJECT GUTENBERG.*', ''), '(?is)^.*?\*{3}\s*START OF (?:THIS |THE )?PROJECT GUTENBERG[^\*]*\*{3}', ''), '^\s+|\s+$', '', 'g')) AS digest FROM (SELECT doc_id, " + BOUNDED + " AS b FROM documents)")
def boilerplate(spark, d):
    rows = read(spark, d, "documents").select("doc_id", C.strip_boilerplate(F.expr(BOUNDED)).alias("text"))
    return rows.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


TITLE = "CASE event_id % 8 WHEN 0 THEN ' Table of Contents ' WHEN 1 THEN 'Contents and ' || event_type WHEN 2 THEN 'ABOUT  THE AUTHOR' WHEN 3 THEN 'Preface' WHEN 4 THEN 'Introduction by' WHEN 5 THEN 'notes' WHEN 6 THEN event_type ELSE NULL END"
FILE = "CASE event_id % 5 WHEN 0 THEN 'OEBPS/nav/ch' || event_id || '.xhtml' WHEN 1 THEN 'text/Cover.xhtml' WHEN 2 THEN 'toc.ncx' WHEN 3 THEN 'OEBPS/' || event_type || '.html' ELSE 'a/titlepage/b.xhtml' END"


@query("SELECT event_id, coalesce(regexp_matches(" + TITLE + ", '" + C.NON_BODY_TITLE + "'), false) AS title, regexp_matches(regexp_extract(" + FILE + ", '([^/]*)$', 1), '" + C.NON_CONTENT_FILE + "') AS file FROM events")
def no_prose(spark, d):
    """Titles and files that hold no prose."""
    return read(spark, d, "events").select("event_id", C.is_non_body(F.expr(TITLE)).alias("title"), C.is_navigation_file(F.expr(FILE)).alias("file"))


@query(
    """
WITH f AS (SELECT conv_id, turn, trim(text) AS t, turn = 0 AS nav FROM conversations), n AS (SELECT conv_id, count(*) FILTER (WHERE length(t) >= 100) AS long FROM f GROUP BY 1),
k AS (SELECT f.*, long >= 2 AS by_file FROM f JOIN n USING (conv_id) WHERE CASE WHEN long >= 2 THEN length(t) >= 100 ELSE t <> '' END)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS ordinal, length(t)::INT AS chars, NOT (by_file AND nav) AS is_body, false AS is_synthetic FROM k
"""
)
def untitled_chapters(spark, d):
    """Chapters of books without a table of contents: a conversation is a book, a turn a file of its spine, the first one its navigation."""
    files = read(spark, d, "conversations").where("text IS NOT NULL")
    name = F.when(F.col("turn") == 0, "text/nav.xhtml").otherwise(F.concat(F.lit("text/part"), F.col("turn").cast("string")))
    return epub.spine_chapters(files, "conv_id", "turn", name, F.trim("text")).select("conv_id", "ordinal", F.length("text").alias("chars"), "is_body", "is_synthetic")


# quotes and extraction

QUOTED = "CASE doc_id % 4 WHEN 0 THEN substring(text, 11, 40) WHEN 1 THEN substring(text, greatest(1, length(text) - 20), 15) WHEN 2 THEN 'zq' || substring(text, 3, 9) || 'qz' ELSE '  ' END"


@query("WITH q AS (SELECT doc_id, text, " + QUOTED + " AS q FROM documents) SELECT doc_id, CASE WHEN trim(q) <> '' AND contains(text, q) THEN (instr(text, q) - 1)::INT END AS quote_start, CASE WHEN trim(q) <> '' AND contains(text, q) THEN (instr(text, q) - 1 + length(q))::INT END AS quote_end FROM q")
def quote_align(spark, d):
    """Quotes from within a text, from its end, changed ones and blank ones; a text of other spacing or case is tested by brute force."""
    rows = read(spark, d, "documents").withColumn("quote", F.expr(QUOTED))
    return quotes.locate(rows, "text", "quote").select("doc_id", "quote_start", "quote_end")


def payloads(spark, d):
    """Orders as sections of their customers' books, with what models reply: right, wrong, missing, textual and padded."""
    o, n = read(spark, d, "orders"), F.col("o_orderkey")
    content = F.concat(F.lit("On "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" Clerk "), F.col("o_orderpriority"), F.lit(" and "), F.col("o_orderstatus"), F.lit("town met."))
    kind = F.when(n % 7 == 0, "organization").when(n % 2 == 0, " character").otherwise("location")
    spot = lambda name, at: F.struct(name.alias("name"), kind.alias("type"), at.cast("int").alias("offset_start"), (at + F.length(name)).cast("int").alias("offset_end"))
    town = F.concat(F.lit("  "), F.col("o_orderstatus"), F.lit("TOWN "))
    who = F.array(spot(F.concat(F.lit("Clerk "), F.col("o_orderpriority")), F.lit(14)), spot(town, F.lit(3)), spot(F.lit("Nobody"), F.lit(5)), spot(F.lit(" "), F.lit(0)))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    when = F.array(F.struct(F.concat(F.lit(" "), day, F.lit("  ")).alias("raw_text"), F.when(n % 3 == 0, "soon").otherwise(day).alias("normalized"), F.lit(99).alias("offset_start"), F.lit(None).cast("int").alias("offset_end")))
    anchor = F.when(n % 4 == 0, "7").when(n % 4 == 1, "many").when(n % 4 == 2, F.when(n % 3 == 0, "500").otherwise("-1"))
    what = F.array(F.struct(F.concat(F.lit(" Ftown and "), F.col("o_orderstatus"), F.lit("town meet ")).alias("description"), anchor.alias("anchor_offset")), F.struct(F.lit("none").alias("description"), F.lit("0").alias("anchor_offset")))
    rows = o.select(F.col("o_custkey").cast("string").alias("book_id"), F.lit("c").alias("chapter_id"), n.alias("section_id"), content.alias("content"), F.when(n % 5 > 0, n).cast("long").alias("char_offset_start"), who.alias("entities"), when.alias("dates"), what.alias("events"))
    return rows.withColumn("payload", F.struct("entities", "dates", "events")).drop("entities", "dates", "events")


_P = "p AS (SELECT o_custkey::VARCHAR AS book_id, o_orderkey AS section_id, o_orderkey % 7 > 0 AS known, o_orderkey % 2 = 0 AS even, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey ELSE 0 END AS base, 'Clerk ' || o_orderpriority AS who, o_orderstatus || 'TOWN' AS town, o_orderstatus AS st, o_orderpriority AS pr, o_orderdate::DATE AS day FROM orders)"


@query(f"WITH {_P}, n AS (SELECT book_id, section_id, even, who AS name FROM p WHERE known UNION ALL SELECT book_id, section_id, even, town FROM p WHERE known UNION ALL SELECT book_id, section_id, even, 'Nobody' FROM p WHERE known) SELECT book_id, name, CASE WHEN arg_max(even, section_id) THEN 'character' ELSE 'location' END AS type FROM n GROUP BY 1, 2")
def extracted_names(spark, d):
    return extraction.candidates(payloads(spark, d))


def clusters(spark, d):
    """Towns with an alias each, a town that is a person as well, a clerk, and groups that are no entities."""
    towns = [("F", 0), ("O", 1), ("P", 2)]
    rows = [(f"{s}town", i, "location", [f" {s}burg ", " "]) for s, i in towns] + [("Clerk 1-URGENT", 3, "character", None), ("Otown", 4, "character", ["Otto"]), ("Clerk 2-HIGH", 5, "organization", []), ("  ", 6, "location", ["Clerk 3-MEDIUM"]), (" Clerk Low ", 7, " character ", ["clerk 5-low"])]
    books = read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("book_id")).distinct()
    named = F.explode(F.array(*(F.struct(F.lit(n).alias("canonical"), F.lit(i).alias("position"), F.lit(t).alias("type"), (F.array(*map(F.lit, a)) if a is not None else F.lit(None)).cast("array<string>").alias("aliases")) for n, i, t, a in rows)))
    return books.select("book_id", named.alias("c")).select("book_id", "c.*")


@query(f"""WITH {_P} SELECT book_id, section_id, st || 'town' AS name, (base + instr('On 2000-01-01 Clerk ' || pr || ' and ', ' and ') + 4)::BIGINT AS start, CASE WHEN st = 'O' THEN 'PERSON' ELSE 'PLACE' END AS entity_type FROM p
UNION ALL SELECT book_id, section_id, CASE WHEN pr = '5-LOW' THEN 'Clerk Low' ELSE who END, (base + 14)::BIGINT, 'PERSON' FROM p WHERE pr IN ('1-URGENT', '5-LOW')""")
def extracted_occurrences(spark, d):
    """Where names that clusters know occur, by offsets that fit or are found anew, in the chapter's offsets. Otown is last claimed as a person."""
    c = clusters(spark, d)
    rows = extraction.named_occurrences(payloads(spark, d), extraction.aliases(c), extraction.entities(c))
    return rows.select("book_id", "section_id", "name", F.col("char_offset_start").cast("long").alias("start"), "entity_type")


@query("SELECT DISTINCT o_custkey::VARCHAR AS book_id, name, entity_type, aliases FROM orders, (VALUES ('Ftown', 'PLACE', 'Fburg'), ('Otown', 'PLACE', 'Oburg'), ('Otown', 'PERSON', 'Otto'), ('Ptown', 'PLACE', 'Pburg'), ('Clerk 1-URGENT', 'PERSON', ''), ('Clerk Low', 'PERSON', 'clerk 5-low')) AS c(name, entity_type, aliases)")
def extracted_entities(spark, d):
    """A name of two types is two entities, here since an alias still stands for the first; blank names and other types are none."""
    return extraction.entities(clusters(spark, d)).select("book_id", "name", "entity_type", F.array_join("aliases", ",").alias("aliases"))


@query(f"WITH {_P} SELECT book_id, section_id, day::VARCHAR AS raw_text, CASE WHEN section_id % 3 > 0 THEN day END AS normalized_date, (base + 3)::BIGINT AS start, left('On ' || day || ' Clerk ' || pr || ' and ' || st || 'town met.', 53) AS context FROM p")
def extracted_dates(spark, d):
    rows = extraction.dates(payloads(spark, d))
    return rows.select("book_id", "section_id", "raw_text", "normalized_date", F.col("char_offset_start").cast("long").alias("start"), "context")


@query(f"WITH {_P} SELECT book_id, section_id, 'Ftown and ' || st || 'town meet' AS description, (base + 7)::BIGINT AS start, (CASE st WHEN 'F' THEN 1 WHEN 'O' THEN 3 ELSE 2 END)::INT AS named FROM p WHERE section_id % 4 = 0 UNION ALL SELECT book_id, section_id, 'none', base::BIGINT, NULL FROM p")
def extracted_events(spark, d):
    """Only events whose anchor is a number within their section; Otown is two entities."""
    rows = extraction.events(payloads(spark, d), extraction.entities(clusters(spark, d)))
    return rows.select("book_id", "section_id", "description", F.col("char_offset_start").cast("long").alias("start"), F.when(F.col("entity_ids").isNotNull(), F.size("entity_ids")).alias("named"))


@query(
    """
WITH n AS (SELECT DISTINCT p_brand AS book_id, p_type AS type, p_name AS name FROM part),
w AS (SELECT book_id, type, name, unnest(list_distinct(regexp_extract_all(lower(name), '[a-z0-9]+'))) AS w FROM n)
SELECT book_id, type, count(DISTINCT name) AS names, count(DISTINCT w) AS words FROM w GROUP BY 1, 2"""
)
def name_words(spark, d):
    """Brands as books: the distinct words that names are linked by."""
    from quire.operators import naming

    rows = read(spark, d, "part").select(F.col("p_brand").alias("book_id"), F.col("p_type").alias("type"), F.col("p_name").alias("name")).distinct()
    rows = rows.select("book_id", "type", "name", F.explode(naming.words("name")).alias("w"))
    return rows.groupBy("book_id", "type").agg(F.count_distinct("name").alias("names"), F.count_distinct("w").alias("words"))


@query()
def name_groups(spark, d):
    """Parts' names of each brand and type in groups of names that may mean the same."""
    from quire.operators import naming

    return naming.groups(read(spark, d, "part").select(F.col("p_brand").alias("book_id"), F.col("p_type").alias("type"), F.col("p_name").alias("name")), 10)


_LONG_WORDS = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS p FROM documents"


@query(f"WITH w AS ({_LONG_WORDS}) SELECT item_id, count(*) AS words, sum(instr(lower(text), p) - 1)::BIGINT AS places FROM benchmark JOIN w ON contains(lower(text), p) GROUP BY 1")
def many_names(spark, d):
    """Which of all longer words of the corpus each benchmark text holds, also within its own words, and where first."""
    words = read(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{6,})"), 1)).alias("p"))
    rows = patterns.marked(read(spark, d, "benchmark").select("item_id", "text"), F.lower("text"), words)
    rows = rows.select("item_id", F.explode("found").alias("f"))
    return rows.groupBy("item_id").agg(F.count("*").alias("words"), F.sum("f.start").alias("places"))


HEADED = "'CHAPTER I' || chr(10) || text || chr(10) || 'Chapter II: ' || coalesce(lang, 'none') || chr(10) || text"


@query(
    f"""
WITH t AS (SELECT doc_id, lang, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t, {HEADED} AS whole FROM documents WHERE text IS NOT NULL)
SELECT doc_id, 0 AS ordinal, 'CHAPTER I' AS title, length(t)::INT AS chars FROM t WHERE length(t) >= 100
UNION ALL SELECT doc_id, 1, 'Chapter II: ' || coalesce(lang, 'none'), length(t)::INT FROM t WHERE length(t) >= 100
UNION ALL SELECT doc_id, 0, NULL, length(trim(whole, ' ' || chr(9) || chr(10) || chr(13)))::INT FROM t WHERE length(t) < 100
"""
)
def headed_chapters(spark, d):
    """Chapters of books of one file, by their headings; a text that is too short for two chapters stays one."""
    files = read(spark, d, "documents").where("text IS NOT NULL")
    rows = epub.spine_chapters(files, "doc_id", "lang", F.lit("text/all.xhtml"), C.strip(F.expr(HEADED)))
    return rows.select("doc_id", "ordinal", "title", F.length("text").alias("chars"))


@query(
    r"""
WITH RECURSIVE s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM documents WHERE text IS NOT NULL),
w AS (
  SELECT doc_id, 1 AS i, 0 AS g, greatest(1, ceil(length(ss[1]) / 4.0)) AS size FROM s
  UNION ALL
  SELECT doc_id, i + 1, CASE WHEN size + n > 200 THEN g + 1 ELSE g END, CASE WHEN size + n > 200 THEN n ELSE size + n END
  FROM (SELECT w.*, greatest(1, ceil(length(ss[i + 1]) / 4.0)) AS n FROM w JOIN s USING (doc_id) WHERE i < len(ss))
), c AS (SELECT doc_id, g, regexp_replace(string_agg(ss[i], ' ' ORDER BY i), '^\s+|\s+$', '', 'g') AS content FROM w JOIN s USING (doc_id) GROUP BY 1, 2),
p AS (SELECT *, coalesce(sum(length(content) + 1) OVER (PARTITION BY doc_id ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM c)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1)::INT AS ordinal, start::INT AS char_start, (start + length(content))::INT AS char_end, md5(content) AS digest FROM p WHERE content <> ''
"""
)
def paragraph_split(spark, d):
    """Long paragraphs as sections of whole sentences."""
    from quire.functions import passages
    from quire.operators import segment

    parts = segment.explode_text(read(spark, d, "documents"), "text", lambda t: passages.paragraph_sections(t or "", 0, 200), ["doc_id"])
    return parts.select("doc_id", "ordinal", "char_start", "char_end", F.md5(F.col("content").cast("binary")).alias("digest"))
