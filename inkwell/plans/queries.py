"""Queries over the driver's tables, one or more for each operator, each with SQL for the same result where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.functions import geometry as G
from inkwell.functions import pointers as P
from inkwell.functions import text as X
from inkwell.operators import chunking, consensus, evidence, history, metrics, peers, regions, schemas
from inkwell.operators import lines as L
from inkwell.operators.grouping import spread
from inkwell.plans import providers
from inkwell.plans.adapt import LINES_SQL, lines, low_regions, reads, table
from inkwell.plans.extract import extract_chunks, merge_tree
from inkwell.sources import files, parsed, sinks, snapshots
from inkwell.sources.store import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


ANOMALY_SQL = "list_bool_or([contains(text, repeat(c, 8)) FOR c IN list_distinct(string_split(text, ''))])"


@query(f"WITH {LINES_SQL} SELECT doc_id, id, page, text, x1, y1, x2, y2, confidence, confidence < 0.9::DOUBLE AS low FROM lines")
def line_catalog(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "id", "page", "text", "x1", "y1", "x2", "y2", "confidence", X.is_low_confidence(F.col("confidence")).alias("low"))


@query(f"""WITH {LINES_SQL}, marked AS (SELECT doc_id, id, confidence, CASE WHEN doc_id % 9 = 0 THEN text || '11111111' ELSE text END AS text FROM lines),
flags AS (SELECT doc_id, id, confidence < 0.9::DOUBLE AS low, coalesce({ANOMALY_SQL}, false) AS odd FROM marked)
SELECT * FROM flags WHERE low OR odd""")
def anomaly_lines(spark, sf_dir):
    marked = lines(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 9 == 0, F.concat("text", F.lit("11111111"))).otherwise(F.col("text")))
    return marked.select("doc_id", "id", X.is_low_confidence(F.col("confidence")).alias("low"), X.has_anomaly(F.col("text")).alias("odd")).where("low OR odd")


@query("""WITH r AS (SELECT o_orderkey, o_orderkey % 7 + 1 AS a, o_orderkey % 7 + 1 + o_orderkey % 5 AS b, o_orderkey % 11 + 1 AS c FROM orders),
p AS (SELECT o_orderkey, unnest(generate_series(a, b)) AS page FROM r UNION SELECT o_orderkey, c FROM r)
SELECT DISTINCT o_orderkey, CAST(page AS BIGINT) AS page FROM p""")
def page_ranges(spark, sf_dir):
    k = F.col("o_orderkey")
    value = F.concat((k % 7 + 1).cast("string"), F.lit("-"), (k % 7 + 1 + k % 5).cast("string"), F.lit(" , "), (k % 11 + 1).cast("string"))
    return table(spark, sf_dir, "orders").select(k, F.explode(files.page_range(value)["pages"]).alias("page"))


@query(f"""WITH {LINES_SQL}, moved AS (SELECT doc_id, id, trim(text) AS text, greatest(x1 - 60, 0) AS x1, greatest(y1 - 60, 0) AS y1, least(greatest(x2 - 60, 0), 300) AS x2, least(greatest(y2 - 60, 0), 30) AS y2 FROM lines)
SELECT * FROM moved WHERE x2 > x1 AND y2 > y1 AND text <> ''""")
def ocr_clamp(spark, sf_dir):
    moved = lines(spark, sf_dir).withColumns({c: F.col(c) - 60 for c in ("x1", "y1", "x2", "y2")}).withColumns({"shot_w": F.lit(300.0), "shot_h": F.lit(30.0)})
    return regions.bounded_lines(moved).select("doc_id", "id", "text", "x1", "y1", "x2", "y2")


@query(f"""WITH {LINES_SQL}, c AS (SELECT doc_id, CAST(count(*) FILTER (confidence < 0.83::DOUBLE) AS BIGINT) AS issues FROM lines GROUP BY doc_id)
SELECT doc_id, issues, CASE WHEN trim(text) = '' THEN 'failed' WHEN issues > 3 THEN 'partial' ELSE 'complete' END AS status FROM documents JOIN c USING (doc_id)""")
def doc_status(spark, sf_dir):
    issues = lines(spark, sf_dir).groupBy("doc_id").agg(F.count_if(F.col("confidence") < 0.83).alias("issues"))
    docs = table(spark, sf_dir, "documents").join(issues, "doc_id")
    return docs.select("doc_id", "issues", L.overall_status(F.col("text"), F.lit(None).cast("string"), F.when(F.col("issues") > 3, F.col("issues")).otherwise(0)).alias("status"))


@query(f"""WITH {LINES_SQL} SELECT doc_id || '/' || page AS region_id, CASE WHEN bool_or((doc_id + pos) % 211 = 0) THEN 'disagreement' ELSE 'consensus' END AS status,
CAST(2 AS INTEGER) AS calls, CASE WHEN NOT bool_or((doc_id + pos) % 211 = 0) THEN count(*) ELSE 0 END AS agreed_lines FROM lines GROUP BY doc_id, page""")
def consensus_two(spark, sf_dir):
    found = consensus.resolve_reads(_wide(reads(spark, sf_dir)))
    return found.select("region_id", "status", "calls", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("agreed_lines"))


def _wide(df: DataFrame) -> DataFrame:
    """Empty lines still have a box of some width."""
    return df.withColumn("x2", F.greatest("x2", F.col("x1") + 1))


@query(f"""WITH {LINES_SQL}, v AS (SELECT doc_id, page, idx, text, (doc_id + pos) % 422 = 0 AS lost FROM lines)
SELECT doc_id || '/' || page AS region_id, CASE WHEN bool_or(lost) THEN 'disagreement' ELSE 'majority' END AS status, CAST(3 AS INTEGER) AS calls,
CASE WHEN bool_or(lost) THEN NULL ELSE string_agg(text, chr(10) ORDER BY idx) END AS text FROM v GROUP BY doc_id, page""")
def consensus_majority(spark, sf_dir):
    found = consensus.resolve_reads(_wide(reads(spark, sf_dir, third=True)))
    return found.select("region_id", "status", "calls", F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("text"))


@query(f"""WITH {LINES_SQL}, r AS (SELECT doc_id || '/' || page AS region_id, doc_id, page, bool_or((doc_id + pos) % 211 = 0) AS torn FROM lines GROUP BY doc_id, page)
SELECT region_id, CASE WHEN torn OR (doc_id + page) % 5 < 2 THEN 'disagreement' ELSE 'consensus' END AS status, CAST(2 AS INTEGER) AS calls FROM r""")
def consensus_empty_reads(spark, sf_dir):
    """Two reads of each page; of some pages the first, of others the second, found nothing."""
    two = _wide(reads(spark, sf_dir))
    made = two.select("region_id", "read_no").distinct()
    place = (F.split_part("region_id", F.lit("/"), F.lit(1)).cast("long") + F.split_part("region_id", F.lit("/"), F.lit(2)).cast("long")) % 5
    found = consensus.resolve_reads(two.where(place != F.col("read_no") - 1), made=made)
    return found.select("region_id", "status", "calls")


@query(f"""WITH {LINES_SQL}, r AS (SELECT doc_id, CAST(1 + (page - 1) // 4 AS INTEGER) AS page, pos, x1, y1 + CAST((page - 1) % 4 AS DOUBLE) * 100 AS y1 FROM lines WHERE confidence < 0.9::DOUBLE),
a AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY y1, x1) AS page_rank FROM r),
b AS (SELECT *, CASE WHEN page_rank <= 8 THEN row_number() OVER (PARTITION BY doc_id, page_rank <= 8 ORDER BY page, y1, x1) END AS doc_rank FROM a)
SELECT doc_id, page, y1, CAST(page_rank AS INTEGER) AS page_rank, CASE WHEN page_rank > 8 THEN 'page_budget' WHEN doc_rank > 20 THEN 'document_budget' ELSE 'kept' END AS verdict,
CASE WHEN page_rank <= 8 AND doc_rank <= 20 THEN printf('p%d-r%03d', page, doc_rank) END AS region_id FROM b""")
def repair_budget(spark, sf_dir):
    r = low_regions(spark, sf_dir).withColumn("y1", F.col("y1") + ((F.col("page") - 1) % 4).cast("double") * 100).withColumn("page", F.expr("cast(1 + (page - 1) div 4 as int)"))
    return regions.budget(r, per_document=20).select("doc_id", "page", "y1", "page_rank", "verdict", "region_id")


@query(f"""WITH {LINES_SQL}, hit AS (SELECT DISTINCT doc_id, page FROM lines WHERE page % 3 = 0 AND doc_id % 2 = 0 AND idx IN (2, 3))
SELECT l.doc_id, l.page, CASE WHEN h.doc_id IS NOT NULL AND idx IN (2, 3) THEN text || '~' ELSE text END AS text, (h.doc_id IS NOT NULL AND idx IN (2, 3)) AS repaired
FROM lines l LEFT JOIN hit h ON l.doc_id = h.doc_id AND l.page = h.page""")
def repair_lines(spark, sf_dir):
    base = _wide(lines(spark, sf_dir)).withColumn("line_no", F.col("idx"))
    areas = base.where("page % 3 = 0").select("doc_id", "page", F.lit("r1").alias("region_id"), F.lit(0.0).alias("x1"), F.lit(47.0).alias("y1"), F.lit(612.0).alias("x2"), F.lit(71.0).alias("y2")).distinct()
    fresh = base.where("page % 3 = 0 AND doc_id % 2 = 0 AND idx IN (2, 3)").select("doc_id", "page", F.lit("r1").alias("region_id"), "x1", "y1", "x2", "y2", F.concat("text", F.lit("~")).alias("text"), "line_no")
    return regions.replace_lines(base, areas, fresh).select("doc_id", "page", "text", "repaired")


@query(f"""WITH {LINES_SQL} SELECT CAST(doc_id AS VARCHAR) AS doc_id, page, x1, y1, greatest(x2, x1 + 1) AS x2, y2, CASE WHEN idx IN (2, 3) THEN upper(replace(text, 'ß', 'SS')) ELSE text END AS text, CAST(NULL AS DOUBLE) AS confidence, idx IN (2, 3) AS repaired FROM lines""")
def repair_in_order(spark, sf_dir):
    """Regions of a page are applied one after another, each seeing what the earlier ones changed."""
    base = _wide(lines(spark, sf_dir)).select(F.col("doc_id").cast("string").alias("doc_id"), "page", "x1", "y1", "x2", "y2", "text", F.col("idx").alias("line_no"))
    fresh = base.where("line_no IN (2, 3)").select("*", (F.col("line_no") - 1).alias("region_no"), F.lit(0.0).alias("rx1"), (F.col("y1") - 1).alias("ry1"), F.lit(612.0).alias("rx2"), (F.col("y2") + 1).alias("ry2")).withColumn("text", F.upper("text"))
    return regions.repair_pages(base, fresh)


@query()
def region_merge(spark, sf_dir):
    """Rows only: hulls are merged until nothing changes; tests hold it against a brute-force fixpoint."""
    return regions.merge_regions(low_regions(spark, sf_dir).withColumn("doc_id", F.col("doc_id").cast("string")))


@query(f"""WITH {LINES_SQL}, pairs AS (SELECT a.doc_id, a.page, a.idx, b.idx AS other_no,
greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2 + 3) - greatest(a.y1, b.y1 + 3), 0) AS common, (a.x2 - a.x1) * (a.y2 - a.y1) AS sa, (b.x2 - b.x1) * (b.y2 - b.y1) AS sb
FROM lines a JOIN lines b ON a.doc_id = b.doc_id AND a.page = b.page AND a.text = b.text AND a.text <> ''),
o AS (SELECT doc_id, page, idx, other_no, CASE WHEN common > 0 THEN common / (sa + sb - common) ELSE 0 END AS overlap FROM pairs)
SELECT doc_id, page, idx AS line_no, other_no, overlap FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, idx ORDER BY overlap DESC, other_no) AS n FROM o) WHERE n = 1""")
def iou_top_match(spark, sf_dir):
    own = lines(spark, sf_dir).where("text <> ''").withColumn("line_no", F.col("idx")).select("doc_id", "page", "line_no", "text", "x1", "y1", "x2", "y2")
    moved = own.withColumns({"y1": F.col("y1") + 3, "y2": F.col("y2") + 3})
    return metrics.top_overlap(own, moved, ["doc_id", "page"]).select("doc_id", "page", "line_no", "other_no", "overlap")


#: The overlap of boxes a and b, as both lines and their boxes are named in the SQL of a query.
IOU_SQL = """CASE WHEN least(a.x2, b.x2) > greatest(a.x1, b.x1) AND least(a.y2, b.y2) > greatest(a.y1, b.y1) THEN
(least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1))
/ ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1))) ELSE 0 END"""


@query(f"""WITH {LINES_SQL}, whole AS (SELECT * FROM lines WHERE text <> ''), ocr AS (SELECT * FROM whole WHERE (doc_id + pos) % 3 <> 0),
o AS (SELECT a.doc_id, a.id, coalesce(max({IOU_SQL}), -1) AS overlap FROM whole a LEFT JOIN ocr b ON a.doc_id = b.doc_id AND a.page = b.page AND trim(a.text) = trim(b.text) GROUP BY 1, 2)
SELECT doc_id, id, CASE WHEN overlap < 0.35 THEN 'native' WHEN doc_id % 4 = 0 THEN 'repair_400' ELSE 'ocr_300' END AS source FROM o""")
def catalog_provenance(spark, sf_dir):
    """All lines with text, those that repeat on their page too."""
    whole = lines(spark, sf_dir).where("text <> ''")
    items = whole.select("doc_id", "page", "idx", "text", F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1")).alias("height"), "id")
    ocr = whole.where("(doc_id + pos) % 3 <> 0").select("doc_id", "page", F.col("idx").alias("line_no"), "text", "x1", "y1", "x2", "y2", "confidence", (F.col("doc_id") % 4 == 0).alias("repaired"))
    # The catalog numbers a page's items anew, since lines without text are no items.
    number = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("idx"))
    ids = items.select("doc_id", F.col("id").alias("line"), X.line_id(F.col("page"), number).alias("id"))
    return L.line_catalog(items, ocr).join(ids, ["doc_id", "id"]).select("doc_id", F.col("line").alias("id"), "source")


@query()
def cer_pairs(spark, sf_dir):
    """Rows only: DuckDB's distance counts bytes, and takes too long on whole texts."""
    a = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t"))
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("t").alias("u"))
    return spread(a, "doc_id").join(spread(b, "doc_id"), "doc_id").select("doc_id", X.cer(F.col("t"), F.col("u")).alias("c")).select("doc_id", "c.edits", "c.rate", "c.score")


@query("SELECT page_id, CAST(1 + page_id % 6 AS INTEGER) AS level, trim(regexp_extract(html, '<h1>(.*?)</h1>', 1)) AS title FROM pages WHERE trim(regexp_extract(html, '<h1>(.*?)</h1>', 1)) <> ''")
def headings_html(spark, sf_dir):
    title = F.trim(F.regexp_extract("html", "<h1>(.*?)</h1>", 1))
    md = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("intro\n"), F.repeat(F.lit("#"), F.expr("cast(1 + page_id % 6 as int)")), F.lit(" "), title, F.lit("\nbody")).alias("md"))
    return md.select("page_id", F.inline(X.headings(F.col("md")))).select("page_id", "level", F.col("text").alias("title"))


#: White space as one blank, as ``collapse`` has it for the texts at hand.
BLANKS_SQL = "trim(regexp_replace({}, '[\\s\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{3000}}]+', ' ', 'g'))"


@query(f"""WITH {LINES_SQL} SELECT doc_id, CAST(1 + pos % 7 AS INTEGER) AS level, nfc_normalize(trim({BLANKS_SQL.format("text")} || ' é')) AS title FROM lines WHERE pos % 7 < 6""")
def heading_levels(spark, sf_dir):
    """Headings of all documents' lines, with accents that stand apart and blanks of several kinds; seven signs are none."""
    title = F.concat(F.regexp_replace(X.collapse(F.col("text")), " ", "  "), F.lit(" \u00a0e\u0301 \t"))
    md = lines(spark, sf_dir).select("doc_id", "pos", F.concat(F.repeat(F.lit("#"), F.expr("cast(1 + pos % 7 as int)")), F.lit("\u2003"), title).alias("line"))
    whole = md.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\r\n").alias("md"))
    return whole.select("doc_id", F.inline(X.headings(F.col("md")))).select("doc_id", "level", F.col("text").alias("title"))


@query(f"""WITH {LINES_SQL}, t AS (SELECT doc_id, pos, {BLANKS_SQL.format("text")} AS t FROM lines), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) % 4 AS k FROM t WHERE t <> '')
SELECT doc_id, string_agg(CASE WHEN k = 3 THEN '• a' || chr(10) || chr(10) || '• ' ELSE '' END || t, chr(10) || chr(10) ORDER BY pos) AS text FROM n GROUP BY doc_id""")
def clipboard_text(spark, sf_dir):
    """What a reader sees of all documents' lines as Markdown: headings with emphasis, quotes, nested lists and links."""
    bare = X.collapse(F.col("text"))
    marked = F.regexp_replace(bare, r"([!-/:-@\[-`{-~])", r"\\$1")
    whole = lines(spark, sf_dir).select("doc_id", "pos", marked.alias("t")).where("t <> ''").groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]).alias("ts"))
    form = lambda t, i: F.when(i % 4 == 0, F.concat(F.lit("## _"), t, F.lit("_"))).when(i % 4 == 1, F.concat(F.lit("> **"), t, F.lit("**"))).when(i % 4 == 2, F.concat(F.lit("- a\n  - "), t)).otherwise(F.concat(F.lit("["), t, F.lit('](u "t")')))
    return whole.select("doc_id", X.clipboard(F.array_join(F.transform("ts", form), "\n\n")).getField("text").alias("text"))


@query(f"WITH {LINES_SQL} SELECT CAST(doc_id AS VARCHAR) AS doc_id, page, count(*) AS items, CAST(sum(length(text)) AS BIGINT) AS chars, min(y1) AS top FROM lines WHERE page IN (1, 2, 4) GROUP BY 1, 2")
def parsed_pages(spark, sf_dir):
    """All documents as a folder of parsed pages, of which a selection is read back."""
    own = lines(spark, sf_dir)
    box = F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1")).alias("height")
    items = own.select("doc_id", "page", "idx", "text", *box)
    pages = own.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "\n").alias("markdown")).withColumns({"width": F.lit(612.0), "height": F.lit(792.0)})
    sources = own.groupBy("doc_id").agg(F.max("page").alias("total_pages")).select("doc_id", F.format_string("doc-%d", "doc_id").alias("source_name"), F.lit("h").alias("source_hash"), "total_pages")
    blocks, shots = (spark.createDataFrame([], parsed.TABLES[t]) for t in ("blocks", "screenshots"))
    folder = f"{shared_dir(spark)}/inkwell-parsed-{uuid.uuid4().hex}"
    parsed.write_parsed(parsed.pack_pages(sources, pages, items, blocks, shots), folder)
    read = parsed.read_parsed(spark, folder, "items", pages="1-2,4")
    return read.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("items"), F.sum(F.char_length("text")).cast("long").alias("chars"), F.min("y").alias("top"))


def _nation_tables(spark, sf_dir, row, cell, head, tail):
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    text = F.concat(*row(F.col("n_nationkey").cast("string"), F.col("n_name")))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", text.alias("t")))), lambda s: s["t"]), cell)
    return both.groupBy("r_name").agg(F.concat(F.lit(head), body, F.lit(tail)).alias("md"))


def _cells(tables: DataFrame) -> DataFrame:
    one = tables.select("r_name", F.explode("t").alias("rows")).select("r_name", F.posexplode("rows").alias("row_no", "cells"))
    return one.select("r_name", "row_no", F.posexplode("cells").alias("col_no", "value"))


NATION_CELLS = """WITH n AS (SELECT r_name, CAST(row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey) AS INTEGER) AS row_no, CAST(n_nationkey AS VARCHAR) AS k, n_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT r_name, row_no, CAST(0 AS INTEGER) AS col_no, k AS value FROM n UNION ALL SELECT r_name, row_no, CAST(1 AS INTEGER), n_name FROM n
UNION ALL SELECT DISTINCT r_name, CAST(0 AS INTEGER), CAST(0 AS INTEGER), 'key' FROM n UNION ALL SELECT DISTINCT r_name, CAST(0 AS INTEGER), CAST(1 AS INTEGER), 'name' FROM n"""


@query(NATION_CELLS)
def pipe_table_cells(spark, sf_dir):
    md = _nation_tables(spark, sf_dir, lambda k, n: (F.lit("| "), k, F.lit(" | "), n, F.lit(" |")), "\n", "| key | name |\n|---|---|\n", "\n\nend")
    return _cells(md.select("r_name", X.tables("md").alias("t")))


@query(NATION_CELLS)
def html_table_cells(spark, sf_dir):
    md = _nation_tables(spark, sf_dir, lambda k, n: (F.lit("<tr><td>"), k, F.lit("</td><td>"), n, F.lit("</td></tr>")), "", "<table><tr><th>key</th><th>name</th></tr>", "</table>")
    return _cells(md.select("r_name", X.tables("md").alias("t")))


#: Pages as visible text: unseen parts out, a line break after each block, bullets, tags out, the entities of these pages.
VISIBLE_SQL = """WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script\\b.*?</script\\s*>', '', 'gis'), '<style\\b.*?</style\\s*>', '', 'gis'), '<head\\b.*?</head\\s*>', '', 'gis'), '<!--.*?-->', '', 'gs'), '<![^>]*>', '', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '<li(\\s[^<>]*)?>', '• ', 'gi'), '<br(\\s[^<>]*)?/?>', chr(10), 'gi'), '</(td|th)\\s*>', chr(9), 'gi'), '</(tr|blockquote|div|h[1-6]|li|ol|p|pre|table|ul)\\s*>', chr(10), 'gi') AS t FROM a),
c AS (SELECT page_id, regexp_replace(t, '</?[A-Za-z][^<>]*>', '', 'g') AS t FROM b),
d AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(t, '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', chr(160)), '&copy;', '©'), '&amp;', '&') AS t FROM c)
SELECT page_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^[\\s\\x{A0}]+|[\\s\\x{A0}]+$', '', 'g') AS text FROM d"""


@query(VISIBLE_SQL)
def html_visible_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.visible_text("html").alias("text"))


BAGS = f"""WITH {LINES_SQL}, a AS (SELECT doc_id, text, count(*) AS c FROM lines GROUP BY 1, 2),
b AS (SELECT doc_id, CASE WHEN (doc_id + pos) % 7 = 0 THEN text || '#' ELSE text END AS text, count(*) AS r FROM lines GROUP BY 1, 2),
m AS (SELECT doc_id, CAST(sum(least(coalesce(c, 0), coalesce(r, 0))) AS BIGINT) AS matched, CAST(sum(coalesce(c, 0)) AS BIGINT) AS candidate, CAST(sum(coalesce(r, 0)) AS BIGINT) AS reference FROM a FULL JOIN b USING (doc_id, text) GROUP BY doc_id)"""


def _bags(spark, sf_dir):
    own = lines(spark, sf_dir)
    other = own.select("doc_id", F.when((F.col("doc_id") + F.col("pos")) % 7 == 0, F.concat("text", F.lit("#"))).otherwise(F.col("text")).alias("text"))
    return metrics.bag_matches(own, other, ["doc_id"], "text")


@query(BAGS + """ SELECT doc_id, matched, candidate, reference, matched / CAST(candidate AS DOUBLE) AS precision, matched / CAST(reference AS DOUBLE) AS recall,
CASE WHEN matched = 0 THEN 0 ELSE 2 * (matched / CAST(candidate AS DOUBLE)) * (matched / CAST(reference AS DOUBLE)) / (matched / CAST(candidate AS DOUBLE) + matched / CAST(reference AS DOUBLE)) END AS f1 FROM m""")
def line_text_f1(spark, sf_dir):
    return _bags(spark, sf_dir).withColumn("s", metrics.precision_recall(F.col("matched"), F.col("candidate"), F.col("reference"))).select("doc_id", "matched", "candidate", "reference", "s.precision", "s.recall", "s.f1")


@query(BAGS + """ SELECT source, CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(candidate) AS BIGINT) AS candidate, CAST(sum(reference) AS BIGINT) AS reference, sum(matched) / CAST(sum(candidate) AS DOUBLE) AS precision
FROM m JOIN documents USING (doc_id) GROUP BY source""")
def micro_scores(spark, sf_dir):
    both = _bags(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    total = both.groupBy("source").agg(*[F.sum(c).alias(c) for c in ("matched", "candidate", "reference")])
    return total.select("*", metrics.precision_recall(F.col("matched"), F.col("candidate"), F.col("reference"))["precision"].alias("precision"))


RUNS = """WITH r AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'legacy' ELSE 'accuracy' END AS policy, CASE WHEN doc_id % 11 = 0 THEN 'failed' ELSE 'complete' END AS status, n_chars AS size, doc_id % 4 AS repairs, doc_id % 3 AS dis FROM documents)"""


def _runs(spark, sf_dir):
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(F.when(k % 2 == 0, "legacy").otherwise("accuracy").alias("policy"), F.when(k % 11 == 0, "failed").otherwise("complete").alias("status"), F.col("n_chars").cast("double").alias("size"), (k % 4).alias("repairs"), (k % 3).alias("repair_disagreements"))


@query(RUNS + """ SELECT policy, count(*) FILTER (status = 'complete') AS successful, count(*) FILTER (status <> 'complete') AS failed, sum(CASE WHEN status = 'complete' THEN size ELSE 0 END) / CAST(greatest(1, count(*) FILTER (status = 'complete')) AS DOUBLE) AS size,
CAST(sum(repairs) AS BIGINT) AS repairs, CAST(sum(dis) AS BIGINT) AS repair_disagreements FROM r GROUP BY policy""")
def policy_report(spark, sf_dir):
    return metrics.policy_report(_runs(spark, sf_dir), ["size"])


@query(RUNS + """, m AS (SELECT policy, sum(CASE WHEN status = 'complete' THEN size ELSE 0 END) / CAST(greatest(1, count(*) FILTER (status = 'complete')) AS DOUBLE) AS v FROM r GROUP BY policy)
SELECT 'size' AS metric, (SELECT v FROM m WHERE policy = 'accuracy') - (SELECT v FROM m WHERE policy = 'legacy') AS delta""")
def policy_delta(spark, sf_dir):
    return metrics.policy_delta(metrics.policy_report(_runs(spark, sf_dir), ["size"]), ["size"])


#: Greedy pairing in SQL, as the tables ``own`` (n numbers the lines of one text on one page) and ``moved`` stand: each line of
#: own in order takes the unused one of moved that it overlaps most.
GREEDY_SQL = f"""o AS (SELECT a.doc_id, a.page, a.text, a.n, a.idx AS cand_no, list({{'ref': b.idx, 'iou': {IOU_SQL}}} ORDER BY {IOU_SQL} DESC, b.idx) AS choice
FROM own a JOIN moved b ON a.doc_id = b.doc_id AND a.page = b.page AND a.text = b.text GROUP BY ALL),
f AS (SELECT doc_id, page, text, n, cand_no, choice[1] AS pick, [choice[1].ref] AS used FROM o WHERE n = 1
UNION ALL SELECT o.doc_id, o.page, o.text, o.n, o.cand_no, list_filter(o.choice, lambda c: NOT list_contains(f.used, c.ref))[1], list_append(f.used, list_filter(o.choice, lambda c: NOT list_contains(f.used, c.ref))[1].ref)
FROM f JOIN o ON o.doc_id = f.doc_id AND o.page = f.page AND o.text = f.text AND o.n = f.n + 1 WHERE len(f.used) < len(o.choice))"""
OWN_SQL = f"WITH RECURSIVE {LINES_SQL}, own AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page, text ORDER BY idx) AS n FROM lines WHERE text <> '')"


@query(f"""{OWN_SQL},
moved AS (SELECT doc_id, page, text, idx, x1, y1 + 12 AS y1, x2, y2 + 12 AS y2 FROM own), {GREEDY_SQL}
SELECT doc_id, page, text, pick.ref AS ref_no, cand_no, CAST(pick.iou AS DOUBLE) AS iou FROM f""")
def greedy_grounding(spark, sf_dir):
    """Lines against the same lines one place down, so that repeated lines compete."""
    own = lines(spark, sf_dir).where("text <> ''").select("doc_id", "page", "text", F.col("idx").alias("line_no"), "x1", "y1", "x2", "y2")
    return metrics.greedy_matches(own, own.withColumns({"y1": F.col("y1") + 12, "y2": F.col("y2") + 12}), ["doc_id", "page"])


@query(f"""{OWN_SQL},
moved AS (SELECT doc_id, page, CASE WHEN (doc_id + pos) % 7 = 0 THEN text || '#' ELSE text END AS text, idx, x1, y1 + 3 AS y1, x2, y2 + 3 AS y2 FROM own WHERE (doc_id + pos) % 11 <> 0), {GREEDY_SQL},
c AS (SELECT doc_id, page, text, count(*) AS c FROM own GROUP BY ALL), r AS (SELECT doc_id, page, text, count(*) AS r FROM moved GROUP BY ALL),
bags AS (SELECT doc_id, page, CAST(sum(least(coalesce(c, 0), coalesce(r, 0))) AS BIGINT) AS matched, CAST(sum(coalesce(c, 0)) AS BIGINT) AS candidate, CAST(sum(coalesce(r, 0)) AS BIGINT) AS reference FROM c FULL JOIN r USING (doc_id, page, text) GROUP BY ALL),
g AS (SELECT doc_id, page, count(*) AS grounded, avg(pick.iou) AS mean_iou FROM f GROUP BY ALL)
SELECT b.doc_id, b.page, matched, candidate, reference, CAST(coalesce(grounded, 0) AS BIGINT) AS grounded, round(mean_iou, 6) AS mean_iou FROM bags b LEFT JOIN g ON b.doc_id = g.doc_id AND b.page = g.page""")
def page_grounding(spark, sf_dir):
    """The line catalog against a ground truth that lacks some lines, reads others differently and has all a little lower."""
    whole = lines(spark, sf_dir).where("text <> ''").withColumn("document", F.col("doc_id"))
    own = whole.select("document", "page", F.col("idx").alias("line_no"), "text", "x1", "y1", "x2", "y2")
    text = F.when((F.col("doc_id") + F.col("pos")) % 7 == 0, F.concat("text", F.lit("#"))).otherwise(F.col("text"))
    truth = whole.where("(doc_id + pos) % 11 <> 0").select("document", "page", F.col("idx").alias("line_no"), text.alias("text"), (F.col("x1") / 612).alias("xmin"), ((F.col("y1") + 3) / 792).alias("ymin"), (F.col("x2") / 612).alias("xmax"), ((F.col("y2") + 3) / 792).alias("ymax"))
    sizes = own.select("document", "page").distinct().withColumns({"width": F.lit(612.0), "height": F.lit(792.0)})
    found = metrics.grounding_pages(own, truth, sizes)
    return found.select(F.col("document").alias("doc_id"), "page", "lines.*", F.coalesce("grounding.matched", F.lit(0)).alias("grounded"), F.round("grounding.mean_iou", 6).alias("mean_iou"))


@query(f"WITH {LINES_SQL} SELECT text, idx FROM lines WHERE doc_id % 2 = 0 INTERSECT ALL SELECT text, idx FROM lines WHERE doc_id % 2 = 1")
def bag_intersect(spark, sf_dir):
    own = lines(spark, sf_dir)
    return own.where("doc_id % 2 = 0").select("text", "idx").intersectAll(own.where("doc_id % 2 = 1").select("text", "idx"))


#: NFC and case folding of the texts at hand: beside lower case, only the sharp s folds to something else.
FOLD_SQL = "lower(replace(nfc_normalize(trim(regexp_replace({}, '[\\s\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{3000}}]+', ' ', 'g'))), 'ß', 'ss'))"
EVIDENCE = f"""WITH {LINES_SQL}, e AS (SELECT doc_id, '/data/' || (pos + 1) AS path, text, CASE WHEN doc_id % 5 = 0 THEN 'zzz' ELSE upper(replace(substr(text, 3, 20), 'ß', 'SS')) END AS quote, doc_id % 7 <> 0 AS known_ids FROM lines),
g AS (SELECT doc_id, path, known_ids, known_ids AND {FOLD_SQL.format("quote")} <> '' AND contains({FOLD_SQL.format("text")}, {FOLD_SQL.format("quote")}) AS trusted FROM e)"""


def _extractions(spark, sf_dir):
    """Evidence for every line of every page."""
    own = lines(spark, sf_dir)
    quote = F.when(F.col("doc_id") % 5 == 0, "zzz").otherwise(F.upper(F.substring("text", 3, 20)))
    cited = F.when(F.col("doc_id") % 7 != 0, F.col("id")).otherwise("p9-l9999")
    each = own.select("doc_id", F.concat(F.lit("/data/"), F.col("pos") + 1).alias("path"), F.array(cited).alias("line_ids"), quote.alias("quote"))
    read = each.groupBy("doc_id").agg(F.collect_list(F.struct("path", "line_ids", "quote")).alias("evidence"), F.collect_list("path").alias("leaves"))
    return read, own.select("doc_id", "id", "text")


@query(EVIDENCE + " SELECT doc_id, path, known_ids, trusted FROM g")
def evidence_grounding(spark, sf_dir):
    read, own = _extractions(spark, sf_dir)
    return evidence.check_evidence(read, own).select("doc_id", "path", "known_ids", "trusted")


@query(EVIDENCE + " SELECT doc_id, path FROM g WHERE NOT trusted")
def uncovered_leaves(spark, sf_dir):
    read, own = _extractions(spark, sf_dir)
    return evidence.uncovered_leaves(read, evidence.check_evidence(read, own), generic=False)


@query(f"""WITH {LINES_SQL} SELECT doc_id, id || '+' AS path, CAST(p - 1 AS INTEGER) AS pos, CASE WHEN p = 1 THEN id ELSE printf('p%d-l%04d', page, 1) END AS id
FROM lines, (SELECT 1 AS p UNION ALL SELECT 3) WHERE p = 1 OR p = 3""")
def evidence_sources(spark, sf_dir):
    own = lines(spark, sf_dir)
    cited = own.select("doc_id", F.concat("id", F.lit("+")).alias("path"), F.lit("q").alias("quote"), F.array("id", F.lit("nowhere"), X.line_id(F.col("page"), F.lit(1))).alias("line_ids"))
    found = L.expand_sources(cited, own)
    out = found.select("doc_id", "path", F.posexplode("sources").alias("n", "s"))
    return out.select("doc_id", "path", (F.col("n") * 2).alias("pos"), F.col("s.id").alias("id"))


@query("""WITH i AS (SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) - 1 AS n FROM lineitem)
SELECT o_orderkey, '/data/status~1code' AS path, o_orderstatus AS value FROM orders
UNION ALL SELECT o_orderkey, '/data/items/' || n || '/no', CAST(l_linenumber AS VARCHAR) FROM orders JOIN i ON l_orderkey = o_orderkey
UNION ALL SELECT o_orderkey, '/data/items/' || n || '/flag', l_returnflag FROM orders JOIN i ON l_orderkey = o_orderkey""")
def leaf_pointers(spark, sf_dir):
    return P.leaf_pointers(order_documents(spark, sf_dir).select("o_orderkey", F.parse_json("body").alias("v")), "v", depth=3)


def order_documents(spark, sf_dir):
    """o_orderkey and a JSON text of each order with its items."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))), lambda s: F.struct(s["l_linenumber"].alias("no"), s["l_returnflag"].alias("flag"))).alias("items"))
    return table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.to_json(F.struct(F.col("o_orderstatus").alias("status/code"), "items", F.lit(None).cast("string").alias("note"))).alias("body"))


POINTERS = ["/data/status~1code", "/data/items/0/flag", "/data/items/3/no", "/data/items/x", "/data/nothing", "/other"]


@query(f"""WITH i AS (SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) - 1 AS n FROM lineitem),
p AS (SELECT unnest({POINTERS}) AS path), a AS (SELECT o_orderkey, o_orderstatus, path FROM orders, p)
SELECT o_orderkey, path, CASE path WHEN '/data/status~1code' THEN o_orderstatus WHEN '/data/items/0/flag' THEN x.l_returnflag WHEN '/data/items/3/no' THEN CAST(y.l_linenumber AS VARCHAR) END AS value
FROM a LEFT JOIN i x ON x.l_orderkey = o_orderkey AND x.n = 0 LEFT JOIN i y ON y.l_orderkey = o_orderkey AND y.n = 3""")
def resolve_pointers(spark, sf_dir):
    docs = order_documents(spark, sf_dir).select("o_orderkey", F.parse_json("body").alias("v"), F.explode(F.array(*map(F.lit, POINTERS))).alias("path"))
    return docs.select("o_orderkey", "path", P.resolved(F.col("v"), F.col("path")).cast("string").alias("value"))


#: What an order may look like, for the checks of all orders: about every keyword is broken by some of them.
ORDER_SCHEMA = {
    "type": "object",
    "required": ["key", "status", "price", "words", "size"],
    "additionalProperties": False,
    "properties": {
        "key": {"type": "integer", "not": {"multipleOf": 7}},
        "status": {"enum": ["O", "F", 1]},
        "price": {"type": "number", "minimum": 2000, "exclusiveMaximum": 250000},
        "priority": {"type": "string", "pattern": "^[1-4]-", "maxLength": 10},
        "words": {"type": "array", "maxItems": 2, "prefixItems": [{"const": "order"}], "items": {"type": "string", "minLength": 2}, "uniqueItems": True},
        "size": {"oneOf": [{"type": "number", "minimum": 40}, {"type": "integer", "maximum": 60}]},
    },
    "if": {"properties": {"status": {"const": "F"}}},
    "then": {"required": ["priority"]},
    "else": {"dependentRequired": {"priority": ["note"]}},
}


@query("""WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS price, o_orderpriority AS prio, o_orderkey % 3 <> 0 AS has, o_orderkey % 5 AS five, o_orderkey % 100 AS size FROM orders),
checks AS (
  SELECT k, '/key' AS path, 'not' AS keyword, k % 7 = 0 AS hit FROM o
  UNION ALL SELECT k, '/status', 'enum', s NOT IN ('O', 'F') FROM o
  UNION ALL SELECT k, '/price', 'minimum', price < 2000 FROM o
  UNION ALL SELECT k, '/price', 'exclusiveMaximum', price >= 250000 FROM o
  UNION ALL SELECT k, '/priority', 'pattern', has AND NOT regexp_matches(prio, '^[1-4]-') FROM o
  UNION ALL SELECT k, '/priority', 'maxLength', has AND length(prio) > 10 FROM o
  UNION ALL SELECT k, '/words/0', 'const', five = 1 FROM o
  UNION ALL SELECT k, '/words/1', 'minLength', five = 2 FROM o
  UNION ALL SELECT k, '/words', 'maxItems', five = 3 FROM o
  UNION ALL SELECT k, '/words', 'uniqueItems', five = 3 FROM o
  UNION ALL SELECT k, '/words/1', 'type', five = 4 FROM o
  UNION ALL SELECT k, '/size', 'oneOf', size BETWEEN 40 AND 60 FROM o
  UNION ALL SELECT k, '', 'required', s = 'F' AND NOT has FROM o
  UNION ALL SELECT k, '', 'dependentRequired', s <> 'F' AND has FROM o
  UNION ALL SELECT k, '', 'additionalProperties', k % 11 = 0 FROM o)
SELECT k AS o_orderkey, path, keyword FROM checks WHERE hit""")
def schema_checks(spark, sf_dir):
    """Orders as JSON, checked against ORDER_SCHEMA: a row for each problem."""
    k = F.col("o_orderkey")
    words = F.when(k % 5 == 1, F.lit('["sale","ab"]')).when(k % 5 == 2, F.lit('["order","x"]')).when(k % 5 == 3, F.lit('["order","ab","ab"]')).when(k % 5 == 4, F.lit('["order",5]')).otherwise(F.lit('["order","ab"]'))
    body = F.struct(
        F.concat(k.cast("string"), F.lit(".0")).cast("decimal(20,1)").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.when(k % 3 != 0, F.col("o_orderpriority")).alias("priority"),
        F.parse_json(words).alias("words"), (k % 100).alias("size"), F.when(k % 11 == 0, 1).alias("more"),
    )
    docs = table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(body).alias("body"))
    found = schemas.check_json(docs, ORDER_SCHEMA, json_column="body", keep=["o_orderkey"])
    return found.select("o_orderkey", F.inline("problems"))


@query("""WITH e AS (SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
SELECT event_id, k < 10 AS low, k % 7 = 0 AS seventh, event_type = 'error' AND k > 90 AS loud FROM e WHERE k < 10 OR k % 7 = 0 OR (event_type = 'error' AND k > 90)""")
def event_schema_checks(spark, sf_dir):
    """The properties of all events with the event's type, by a schema with a condition."""
    schema = {"properties": {"props": {"properties": {"k": {"type": "integer", "minimum": 10, "not": {"multipleOf": 7}}}}}, "if": {"properties": {"type": {"const": "error"}}}, "then": {"allOf": [{"properties": {"props": {"properties": {"k": {"maximum": 90}}}}}]}}
    docs = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("type"), F.parse_json("props").alias("props"))).alias("body"))
    found = schemas.check_json(docs, schema, json_column="body", keep=["event_id"]).where(F.size("problems") > 0)
    has = lambda word: F.exists("problems", lambda p: p["keyword"] == word)
    return found.select("event_id", has("minimum").alias("low"), has("not").alias("seventh"), has("maximum").alias("loud"))


@query(f"""WITH RECURSIVE {LINES_SQL}, p AS (SELECT doc_id, page, CAST(sum(length(text)) AS BIGINT) AS size FROM lines GROUP BY doc_id, page),
f AS (SELECT doc_id, page, size, 0 AS chunk, 1 AS items, size AS chars FROM p WHERE page = 1
UNION ALL SELECT p.doc_id, p.page, p.size, CASE WHEN f.items >= 8 OR f.chars + p.size > 6000 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.items >= 8 OR f.chars + p.size > 6000 THEN 1 ELSE f.items + 1 END,
CASE WHEN f.items >= 8 OR f.chars + p.size > 6000 THEN p.size ELSE f.chars + p.size END FROM f JOIN p ON p.doc_id = f.doc_id AND p.page = f.page + 1)
SELECT doc_id, page, size, CAST(chunk AS INTEGER) AS chunk FROM f""")
def pack_chunks(spark, sf_dir):
    sizes = lines(spark, sf_dir).groupBy("doc_id", "page").agg(F.sum(F.char_length("text")).alias("size"))
    whole = sizes.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "size"))).alias("pages"))
    numbered = whole.select("doc_id", "pages", chunking.fold_chunks(F.transform("pages", lambda p: p["size"]), 8, 6000).alias("chunks"))
    zipped = numbered.select("doc_id", F.explode(F.arrays_zip("pages", "chunks")).alias("z"))
    return zipped.select("doc_id", "z.pages.page", "z.pages.size", F.col("z.chunks").alias("chunk"))


def _chunks(spark, sf_dir):
    own = lines(spark, sf_dir).withColumn("doc_id", F.col("doc_id").cast("string"))
    pages = own.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("idx", "id", "text"))).alias("l"))
    pages = pages.select("doc_id", "page", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("markdown"), F.lit("").alias("catalog"), F.transform("l", lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text"))).alias("lines"))
    return chunking.chunk_documents(pages, 2, 4000), own


@query()
def chunk_documents(spark, sf_dir):
    """Rows only: pages beyond the limit are split line by line (state)."""
    return _chunks(spark, sf_dir)[0]


@query()
def extract_and_merge(spark, sf_dir):
    """Rows only: calls to a provider (the deterministic stand-in), checks, a retry and the merge tree."""
    chunks, own = _chunks(spark, sf_dir)
    return merge_tree(extract_chunks(chunks, own, providers.echo_lines), providers.join_results, own).select("doc_id", "result", "status")


@query(f"""WITH RECURSIVE {LINES_SQL}, n AS (SELECT doc_id, max(page) AS n FROM lines GROUP BY doc_id), t AS (SELECT doc_id, 1 AS level, CAST(n AS BIGINT) AS inputs FROM n
UNION ALL SELECT doc_id, level + 1, (inputs + 9) // 10 FROM t WHERE inputs > 1)
SELECT doc_id, CAST(level AS INTEGER) AS level, inputs, (inputs + 9) // 10 AS groups, (inputs + 9) // 10 - CASE WHEN inputs % 10 = 1 THEN 1 ELSE 0 END AS calls FROM t WHERE inputs > 1""")
def merge_levels(spark, sf_dir):
    return chunking.merge_levels(lines(spark, sf_dir).groupBy("doc_id").agg(F.max("page").alias("n")))


@query("""WITH src AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents),
n AS (SELECT DISTINCT doc_id, nfc_normalize(trim(regexp_replace(text, '[\\s\\x{A0}\\x{2000}-\\x{200A}\\x{3000}]+', ' ', 'g'))) AS signature FROM src),
s AS (SELECT * FROM n WHERE length(signature) >= 8 AND NOT regexp_matches(signature, '[\\p{Nd}\\p{No}☐☑☒□■✓✗✔✘]')),
c AS (SELECT signature, count(*) - 1 AS peers FROM s GROUP BY signature)
SELECT doc_id, signature, peers FROM s JOIN c USING (signature) WHERE peers >= 2""")
def peer_blocks(spark, sf_dir):
    """Every line, normalised as blocks are."""
    each = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("text"))
    plain = each.select("doc_id", X.normalize_inline(F.col("text")).alias("signature")).distinct()
    signed = plain.where(peers.is_safe_signature(F.col("signature"))).select(F.lit("corpus").alias("doc_id"), F.lit("line").alias("kind"), F.col("doc_id").alias("page"), "signature")
    return peers.peer_blocks(signed).select(F.col("page").alias("doc_id"), "signature", "peers")


STEMS = r"""WITH b AS (SELECT page_id, regexp_extract(url, '([^/\\]*)[/\\]*$', 1) AS base FROM pages), s AS (SELECT page_id, CASE WHEN regexp_matches(base, '.\.[^.]*$') THEN regexp_replace(base, '\.[^.]*$', '') ELSE base END AS stem FROM b),
c AS (SELECT page_id, substr(regexp_replace(regexp_replace(stem, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), 1, 80) AS clean FROM s), d AS (SELECT page_id, CASE WHEN clean = '' THEN 'document' ELSE clean END AS stem FROM c)"""


@query(STEMS + " SELECT page_id, stem FROM d")
def safe_stems(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.safe_stem(F.col("url")).alias("stem"))


@query(STEMS + ", n AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY page_id) AS k FROM d) SELECT page_id, CASE WHEN k = 1 THEN stem ELSE stem || '-' || k END AS stem FROM n")
def zip_names(spark, sf_dir):
    return sinks.numbered_stems(table(spark, sf_dir, "pages"), seq="page_id", name="url").select("page_id", "stem")


def _history(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    created = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return events.select(F.format_string("a%04d", "user_id").alias("artifact_id"), "event_id", created.alias("created_at"), F.octet_length("props").cast("long").alias("retained_bytes"))


HISTORY = """WITH e AS (SELECT printf('a%04d', user_id) AS artifact_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS created_at, CAST(strlen(props) AS BIGINT) AS retained_bytes FROM events),
u AS (SELECT artifact_id, event_id, created_at, retained_bytes FROM (SELECT *, row_number() OVER (PARTITION BY artifact_id ORDER BY created_at DESC, event_id DESC) AS n FROM e) WHERE n = 1)"""


@query(HISTORY + " SELECT * FROM u")
def history_upsert(spark, sf_dir):
    """The earlier half of the time is stored, the later half is new."""
    whole = _history(spark, sf_dir)
    middle = whole.agg(((F.min("created_at") + F.max("created_at")) / 2).alias("middle"))
    dated = whole.crossJoin(F.broadcast(middle)).withColumn("late", F.coalesce(F.col("created_at") >= F.col("middle"), F.lit(False))).drop("middle")
    return history.upsert(dated.where("not late").drop("late"), dated.where("late").drop("late"), ["created_at", "event_id"])


@query(HISTORY + " SELECT * FROM u WHERE created_at + 86400 > 1706500000")
def history_ttl(spark, sf_dir):
    rows = history_upsert(spark, sf_dir).withColumn("expires_at", F.col("created_at") + history.DAY)
    return history.purge(rows, 1706500000).drop("expires_at")


@query(HISTORY + ", t AS (SELECT *, sum(retained_bytes) OVER (ORDER BY created_at DESC, artifact_id DESC ROWS UNBOUNDED PRECEDING) AS total FROM u) SELECT artifact_id, event_id, created_at, retained_bytes FROM t WHERE total <= 600")
def history_prune(spark, sf_dir):
    return history.prune(history_upsert(spark, sf_dir), 600)


@query(HISTORY + ", l AS (SELECT * FROM u WHERE created_at + 86400 > 1706500000), t AS (SELECT *, sum(retained_bytes) OVER (ORDER BY created_at DESC, artifact_id DESC ROWS UNBOUNDED PRECEDING) AS total FROM l) SELECT artifact_id, event_id, created_at, retained_bytes FROM t WHERE total <= 400")
def history_commits(spark, sf_dir):
    """The history as snapshots: the earlier and the later half as commits, then a purge and a prune."""
    whole = _history(spark, sf_dir).withColumn("expires_at", F.col("created_at") + history.DAY)
    middle = whole.agg((F.min("created_at") + F.max("created_at")) / 2).first()[0]
    table_ = snapshots.History(spark, f"{shared_dir(spark)}/inkwell-history-{uuid.uuid4().hex}", "artifact_id string, event_id bigint, created_at bigint, retained_bytes bigint, expires_at bigint")
    for late in (False, True):
        half = whole.where(F.coalesce(F.col("created_at") >= F.lit(middle), F.lit(False)) == F.lit(late))
        table_.upsert(history.upsert(half.limit(0), half, ["created_at", "event_id"]), ["created_at", "event_id"])
    table_.purge(1706500000)
    return table_.read(table_.prune(400)).drop("expires_at")


@query(HISTORY + " SELECT artifact_id, created_at FROM u ORDER BY created_at DESC, artifact_id DESC LIMIT 20")
def history_recent(spark, sf_dir):
    rows = history_upsert(spark, sf_dir).withColumns({"source_name": F.lit("x"), "status": F.lit("complete"), "expires_at": F.lit(0)})
    return history.recent(rows, 20).select("artifact_id", "created_at")


@query("SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def source_digests(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc"))


@query(f"WITH {LINES_SQL} SELECT doc_id, CASE WHEN confidence < 0.85::DOUBLE THEN 'low' ELSE 'fine' END AS code, page, min(pos) AS seq FROM lines GROUP BY 1, 2, 3")
def issue_dedup(spark, sf_dir):
    issues = lines(spark, sf_dir).select("doc_id", F.when(F.col("confidence") < 0.85, "low").otherwise("fine").alias("code"), "page", F.col("pos").alias("seq"))
    return L.distinct_issues(issues, ["code", "page"])


@query(f"""WITH {LINES_SQL}, c AS (SELECT doc_id, count(*) AS n, max(page) AS pages FROM lines GROUP BY doc_id), f AS (SELECT * FROM lines WHERE pos = 0)
SELECT d.doc_id, 'doc-' || d.doc_id AS source_name, CASE WHEN trim(d.text) = '' THEN 'failed' ELSE 'complete' END AS status, sha256(d.text) AS digest, '2.2' AS version, CAST(c.pages AS INTEGER) AS last_page, CAST(c.n AS INTEGER) AS n_evidence,
f.text AS first_text, 'p1-l0001' AS first_line, f.y2 AS bottom, 'skipped' AS annotation, 'complete' AS extraction
FROM documents d JOIN c ON c.doc_id = d.doc_id JOIN f ON f.doc_id = d.doc_id""")
def envelope_fields(spark, sf_dir):
    """Exported documents with each line as a value with its evidence, read back by paths into their JSON."""
    own = lines(spark, sf_dir).withColumn("source", F.lit("native"))
    rows = own.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "text"))).alias("l"))
    data = rows.select("doc_id", F.parse_json(F.to_json(F.struct(F.transform("l", lambda x: F.struct(x["text"].alias("value"))).alias("fields")))).alias("data"))
    cited = own.select("doc_id", F.col("pos").alias("ev_no"), F.concat(F.lit("/data/fields/"), "pos", F.lit("/value")).alias("path"), F.array("id").alias("line_ids"), F.col("text").alias("quote"))
    pages = own.groupBy("doc_id").agg(F.array_sort(F.collect_set("page")).alias("processed_pages"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.format_string("doc-%d", "doc_id").alias("source_name"), F.sha2("text", 256).alias("hash"), F.col("text").alias("markdown"))
    docs = docs.join(data, "doc_id").join(pages, "doc_id").join(L.evidence_with_sources(cited, own), "doc_id")
    none = F.array().cast("array<struct<code:string,message:string,stage:string>>")
    docs = docs.withColumns({"issues": none, "repairs": none, "status": L.overall_status(F.col("markdown"), F.lit("complete"), F.lit(0))})
    docs = docs.withColumn("stages", L.stage_statuses(F.col("markdown"), F.col("issues"), F.lit(False), F.lit(False), F.lit("complete"))).withColumn("document", F.struct(F.col("hash").alias("id"), "source_name", "processed_pages"))
    out = L.envelope(docs).withColumn("v", F.parse_json("output_json"))
    at = lambda path, kind="string": F.variant_get("v", path, kind)
    return out.select(
        "doc_id", "source_name", at("$.status").alias("status"), at("$.document.id").alias("digest"), at("$.schema_version").alias("version"), F.array_max(at("$.document.processed_pages", "array<int>")).alias("last_page"), F.size(at("$.evidence", "array<variant>")).alias("n_evidence"),
        at("$.data.fields[0].value").alias("first_text"), at("$.evidence[0].sources[0].id").alias("first_line"), at("$.evidence[0].sources[0].bbox[3]", "double").alias("bottom"), at("$.stages.annotation").alias("annotation"), at("$.stages.extraction").alias("extraction"),
    )


@query(f"""WITH {LINES_SQL} SELECT doc_id, id, CASE WHEN doc_id % 3 = 0 THEN 'red' WHEN doc_id % 3 = 1 THEN 'green' ELSE 'blue' END AS colour, greatest(x1 * 2 - CASE WHEN doc_id % 3 = 0 THEN 4 ELSE 0 END, 0) AS left_edge,
CAST(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS INTEGER) AS width FROM lines""")
def annotation_boxes(spark, sf_dir):
    source = F.when(F.col("doc_id") % 3 == 0, "repair_400").when(F.col("doc_id") % 3 == 1, "ocr_300").otherwise("native")
    own = lines(spark, sf_dir).withColumn("source", source)
    pages = own.select("doc_id", "page").distinct().withColumns({"width": F.lit(612.0), "height": F.lit(792.0), "shot_w": F.lit(1224), "shot_h": F.lit(1584)})
    return sinks.annotations(own, pages).select("doc_id", "id", "colour", F.col("frame.x1").alias("left_edge"), "width")


@query(f"WITH {LINES_SQL} SELECT doc_id, page, count(*) AS n FROM lines WHERE page <= 3 GROUP BY 1, 2")
def selected_pages(spark, sf_dir):
    """The first three pages of every document."""
    own = lines(spark, sf_dir).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"))
    total = own.groupBy("doc_id").agg(F.max("page").alias("m"))
    wanted = total.select("doc_id", F.sequence(F.lit(1), F.least(F.lit(3), "m")).cast("array<bigint>").alias("selected"))
    return files.select_pages(own, wanted)


@query(f"""WITH {LINES_SQL}, k AS (SELECT *, (doc_id + pos) % 12 AS k FROM lines)
SELECT doc_id, pos, CASE WHEN k = 0 THEN 'not an object' WHEN k = 1 THEN 'unknown key: note' WHEN k = 2 OR text = '' THEN 'no text' WHEN k IN (3, 4) THEN 'no box of four numbers' WHEN k = 5 OR x2 <= x1 THEN 'the box is not an ordered rectangle'
WHEN k = 6 THEN 'confidence is not from 0 to 1' WHEN k = 7 THEN 'polygon is not a list of points' WHEN k = 8 THEN 'unknown kind of source' END AS reason, k.confidence AS was FROM k WHERE k < 9 OR text = '' OR x2 <= x1""")
def quarantined_lines(spark, sf_dir):
    """All lines as JSON as a reader might send them, three quarters of them broken in some way."""
    k = (F.col("doc_id") + F.col("pos")) % 12
    none = F.lit(None).cast("variant")
    box = F.when(k == 3, F.parse_json(F.lit("[1, 2, 3]"))).when(k == 4, F.parse_json(F.lit('[1, 2, 3, "4"]'))).when(k == 5, F.parse_json(F.lit("[5, 0, 5, 9]"))).otherwise(F.parse_json(F.to_json(F.array("x1", "y1", "x2", "y2"))))
    body = F.to_json(F.struct(F.when(k == 2, F.parse_json(F.lit("7"))).otherwise(F.to_variant_object(F.array("text"))).alias("t"), box.alias("bbox"), F.when(k == 6, 1.5).otherwise(F.col("confidence")).alias("confidence"), F.when(k == 7, F.parse_json(F.lit('[[1, "x"]]'))).when(k == 9, F.parse_json(F.lit("[[1, 2], [3, 4.5]]"))).otherwise(none).alias("polygon"), F.when(k == 8, "painted").when(k == 10, "printed").alias("source_kind"), F.when(k == 1, 1).alias("note")))
    # The text is put in as it is: a member of an array came out as one.
    sent = F.regexp_replace(F.regexp_replace(body, r'^\{"t":\["', '{"text":"'), r'"\],"bbox"', '","bbox"')
    raw = lines(spark, sf_dir).select("doc_id", "pos", F.col("confidence").alias("was"), F.when(k == 0, F.lit("[1]")).otherwise(F.regexp_replace(sent, r'^\{"t":7', '{"text":7')).alias("line"))
    return regions.quarantine_lines(raw)[1].select("doc_id", "pos", "reason", "was")


@query()
def page_evaluation(spark, sf_dir):
    """Rows only: edit distances, headings and tables of Unicode Markdown."""
    own = lines(spark, sf_dir).groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("idx", F.col("text").alias("t")))).alias("l"))
    truth = own.select(F.col("doc_id").alias("document"), "page", F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("markdown"))
    read = truth.where("(document + page) % 10 <> 0").withColumn("markdown", F.when(F.col("document") % 3 == 0, F.concat("markdown", F.lit(" x"))).otherwise(F.col("markdown")))
    pages = metrics.evaluate_pages(read, truth)
    return metrics.evaluate_documents(pages).select("document", "pages", "success_rate", "cer", "lines_score")


@query(f"WITH {LINES_SQL} SELECT doc_id, page, x1 * 2 AS x1, y1 * 2 AS y1 FROM lines")
def point_to_pixel(spark, sf_dir):
    moved = G.rescale(G.box("x1", "y1", "x2", "y2"), F.lit(612.0), F.lit(792.0), F.lit(1224.0), F.lit(1584.0))
    return lines(spark, sf_dir).select("doc_id", "page", moved["x1"].alias("x1"), moved["y1"].alias("y1"))
