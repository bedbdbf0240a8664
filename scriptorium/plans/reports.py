"""Queries of mappings, documents' reports and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import scripts as S
from scriptorium.operators import content, gates, geometry, layout, leaks, mapping, parity, validation
from scriptorium.operators import fonts as font_ops
from scriptorium.operators import segments as seg
from scriptorium.plans import bindings as B
from scriptorium.tables import spread, table


def merge_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second and fourth line of each document's first page as a declared merge; one in five is misspelt."""
    s = B.segments(spark, sf_dir)
    first = s.filter("page = 0 and id in (1, 3)").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("id", "text"))).alias("m"))
    lines = F.transform("m", lambda x: F.when((F.col("doc_id") % 5 == 0) & (x["id"] == 3), F.concat(x["text"], F.lit("?!"))).otherwise(x["text"]))
    merges = first.select("doc_id", F.lit(0).alias("merge_no"), F.lit(0).alias("page"), lines.alias("lines"))
    return mapping.merge_matches(s, merges).select("doc_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "n_lines", "matched")


MERGE_MATCHES = f"""WITH {B.SQL_SEGMENTS}, m AS (SELECT doc_id, count(*) AS n, max(text) FILTER (id = 1) AS l1, max(text) FILTER (id = 3) || CASE WHEN doc_id % 5 = 0 THEN '?!' ELSE '' END AS l3 FROM segments WHERE page = 0 AND id IN (1, 3) GROUP BY doc_id),
a AS (SELECT m.*, (SELECT min(id) FROM segments s WHERE s.doc_id = m.doc_id AND s.page = 0 AND s.text = m.l1) AS i1 FROM m),
b AS (SELECT a.*, (SELECT min(id) FROM segments s WHERE s.doc_id = a.doc_id AND s.page = 0 AND s.text = a.l3 AND s.id > a.i1) AS i3 FROM a)
SELECT doc_id, concat_ws(',', i1, CASE WHEN n = 2 THEN i3 END) AS ids, CAST(n AS INTEGER) AS n_lines, n = 1 OR i3 IS NOT NULL AS matched FROM b"""


def advanced_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("part_no"), F.col("l_quantity").alias("width"), F.lit(2.0).alias("gap"))
    out = geometry.advanced(parts)
    return out.select("run_id", F.col("part_no.l_linenumber").alias("line"), F.col("part_no.l_partkey").alias("part"), "dx")


ADVANCED_PARTS = """SELECT l_orderkey AS run_id, l_linenumber AS line, l_partkey AS part, coalesce(sum(l_quantity + 2) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS dx FROM lineitem"""


def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: verdict by source, pages and segments by their lines."""
    lines = B.lines(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("segments"))
    files = table(spark, sf_dir, "documents").join(lines, "doc_id").select(F.col("source").alias("verdict"), F.floor((F.col("segments") + 11) / 12).alias("pages"), "segments")
    return mapping.corpus_summary(files)


CORPUS_SUMMARY = """WITH f AS (SELECT source AS verdict, len(string_split(text, chr(10))) AS segments FROM documents)
SELECT verdict, count(*) AS n_files, CAST(sum((segments + 11) // 12) AS BIGINT) AS n_pages, CAST(sum(segments) AS BIGINT) AS n_segments FROM f GROUP BY ROLLUP (verdict)"""


def first_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.lines(spark, sf_dir).select("doc_id", "text", F.col("line_no").alias("ord"))
    return mapping.distinct_in_order(rows, ["doc_id", "text"]).select("doc_id", F.md5("text").alias("text"), "ord")


FIRST_OCCURRENCES = f"WITH {B.SQL_LINES} SELECT doc_id, md5(text) AS text, min(line_no) AS ord FROM lines GROUP BY doc_id, lines.text"


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    n = table(spark, sf_dir, "orders").select((k % 100).alias("doc_id"), k.alias("notice_no"), (k % 7 - 1).cast("int").alias("page"), F.when(k % 11 != 0, F.col("o_orderpriority")).alias("text"), F.when(k % 13 == 0, F.array(F.lit(1.0))).otherwise(F.array(F.lit(10.0), F.lit(10.0), (k % 30).cast("double"), F.lit(20.0))).alias("box"))
    counts = spark.range(100).select(F.col("id").alias("doc_id"), F.lit(4).alias("n_pages"))
    return mapping.notice_violations(n, counts)


NOTICES = """SELECT o_orderkey % 100 AS doc_id, o_orderkey AS notice_no, CASE WHEN o_orderkey % 11 = 0 THEN 'text' WHEN o_orderkey % 7 - 1 NOT BETWEEN 0 AND 3 THEN 'page' WHEN o_orderkey % 13 = 0 THEN 'box' WHEN o_orderkey % 30 <= 10 THEN 'empty-box' END AS reason
FROM orders WHERE reason IS NOT NULL"""


def united_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "customer").select(F.array("c_mktsegment", F.concat("c_mktsegment", (F.col("c_nationkey") % 3).cast("string"))).alias("skip"), F.array((F.col("c_nationkey")).cast("string")).alias("center"))
    return mapping.united_lists(files, ["skip", "center"]).select("name", F.array_join("members", ",").alias("members"))


UNITED_LISTS = """WITH m AS (SELECT 'skip' AS name, c_mktsegment AS x FROM customer UNION SELECT 'skip', concat(c_mktsegment, c_nationkey % 3) FROM customer UNION SELECT 'center', CAST(c_nationkey AS VARCHAR) FROM customer)
SELECT name, string_agg(x, ',' ORDER BY x) AS members FROM m GROUP BY 1"""


def merge_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.segments(spark, sf_dir)
    found = seg.merge_candidates(s).select("doc_id", "page", "ids").withColumn("kind", F.lit("merge-candidate")).withColumn("warning_no", F.get("ids", F.lit(0)))
    proposals = seg.merge_proposals(found, s)
    return proposals.select("doc_id", "warning_no", "page", F.md5(F.array_join("lines", "|")).alias("lines"), "align")


MERGE_PROPOSALS = f"""WITH {B.SQL_SEGMENTS}, s AS (
  SELECT *, lag(x0) OVER w AS px, lag(y0) OVER w AS py, lag(core) OVER w AS pc FROM segments WHERE NOT passthrough
  WINDOW w AS (PARTITION BY doc_id, page ORDER BY y0, x0, id)), b AS (
  SELECT *, CASE WHEN px IS NOT NULL AND abs(x0 - px) < 4 AND y0 - py > 0.5 AND y0 - py < 22 AND NOT regexp_matches(rtrim(pc), '[.!?…:;]$') THEN 0 ELSE 1 END AS br FROM s), i AS (
  SELECT *, sum(br) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, id) AS island FROM b)
SELECT doc_id, min(id) AS warning_no, page, md5(string_agg(trim(text), '|' ORDER BY id)) AS lines, 'left' AS align FROM i GROUP BY doc_id, page, island HAVING count(*) >= 2"""


def script_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three or more Latin words of each document, by length."""
    runs = leaks.script_runs(spread(table(spark, sf_dir, "documents")), allow=["the", "und"])
    return runs.groupBy("doc_id", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("n_words"))


_RUN = "[A-Za-z][A-Za-z''\\-]*(?:\\s+[A-Za-z][A-Za-z''\\-]*){2,}"
SCRIPT_RUNS = f"""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_RUN}')) AS run FROM documents),
k AS (SELECT doc_id, 'running' AS bucket, len(regexp_extract_all(run, '[A-Za-z][A-Za-z''\\-]*')) AS w FROM r WHERE len(list_filter(regexp_extract_all(run, '[A-Za-z'']+'), lambda x: lower(x) NOT IN ('the', 'und'))) >= 3
  UNION ALL SELECT doc_id, 'isolated', 1 FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '{_RUN}', ' ', 'g'), '[A-Za-z][A-Za-z''\\-]{{3,}}')) AS word FROM documents) WHERE lower(word) NOT IN ('the', 'und'))
SELECT doc_id, bucket, count(*) AS n, CAST(sum(w) AS BIGINT) AS n_words FROM k GROUP BY ALL"""


def kinsoku_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as lines of Chinese or Japanese text: some begin or end with what may not stand there."""
    lines = B.segments(spark, sf_dir).withColumnRenamed("id", "line_no")
    text = F.concat(F.when(F.col("line_no") % 3 == 1, F.lit("。")).otherwise(F.lit("")), F.lit("文"), F.col("text"), F.when(F.col("line_no") % 5 == 0, F.lit("「")).otherwise(F.lit("")))
    return layout.kinsoku(layout.stacks(lines.withColumn("text", text)))


def gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several gates over documents with planted problems, in the report's order."""
    docs = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    first = F.substring_index("text", "\n", 1)
    inputs = {
        "documents": docs.select("doc_id"),
        "text": docs.select("doc_id", "text"),
        "targets": docs.select("doc_id", F.when(k % 7 == 0, F.concat(first, F.lit(" zz"))).otherwise(first).alias("target")),
        "trials": docs.select("doc_id", (k % 3).alias("n_fields"), (k % 4 != 1).alias("text_kept"), F.lit(None).cast("boolean").alias("box_kept")),
        "scale": docs.select("doc_id", F.when(k % 2 == 0, F.slice(F.array(F.lit(1), F.lit(2)), F.lit(1), (k % 3).cast("int"))).alias("runs")),
        "ink_pages": docs.select("doc_id", F.lit(0).alias("page"), (k % 50).alias("ink_a"), (k % 90).alias("ink_b")),
        "shaping": docs.filter("doc_id % 10 = 0").select("doc_id", F.when(k % 20 == 0, "REVIEW").otherwise("PASS").alias("status")),
    }
    return gates.report(inputs)


GATE_REPORT = """WITH d AS (SELECT doc_id AS k, text, split_part(text, chr(10), 1) || CASE WHEN doc_id % 7 = 0 THEN ' zz' ELSE '' END AS t FROM documents),
p AS (SELECT k, length(trim(regexp_replace(t, '[ \\t\\r\\n]+', ' ', 'g'))) >= 2 AND NOT contains(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')), trim(regexp_replace(t, '[ \\t\\r\\n]+', ' ', 'g'))) AS bad FROM d)
SELECT k AS doc_id, 'placement' AS gate, 18 AS ord, CASE WHEN bad THEN 'FAIL' ELSE 'PASS' END AS status, CAST(bad AS BIGINT) AS n_findings FROM p
UNION ALL SELECT k, 'fill-roundtrip', 3, CASE WHEN k % 3 = 0 THEN 'SKIP' WHEN k % 4 = 1 THEN 'FAIL' ELSE 'PASS' END, CAST(k % 4 = 1 AS BIGINT) FROM d
UNION ALL SELECT k, 'scaled-runs', 25, CASE WHEN k % 2 = 1 THEN 'SKIP' WHEN k % 3 = 0 THEN 'PASS' ELSE 'REVIEW' END, CASE WHEN k % 2 = 1 THEN 0 ELSE k % 3 END FROM d
UNION ALL SELECT k, 'ink-ratio', 6, CASE WHEN k % 50 < 20 THEN 'SKIP' WHEN (k % 90) / (k % 50) BETWEEN 0.4 AND 3.0 THEN 'PASS' ELSE 'FAIL' END, CASE WHEN k % 50 < 20 OR (k % 90) / (k % 50) BETWEEN 0.4 AND 3.0 THEN 0 ELSE 1 END FROM d
UNION ALL SELECT k, 'conjunct-shaping', 10, CASE WHEN k % 20 = 0 THEN 'REVIEW' ELSE 'PASS' END, CAST(k % 20 = 0 AS BIGINT) FROM d WHERE k % 10 = 0"""

def concatenated_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as mappings with two lists."""
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.array("o_orderstatus", "o_orderpriority", "o_orderstatus").alias("merges"), F.array(F.col("o_custkey").cast("string")).alias("overrides"))
    return mapping.concatenated(files, ["merges", "overrides"])


CONCATENATED_LISTS = """SELECT 'merges' AS name, o_orderkey AS ord, place, CASE place WHEN 1 THEN o_orderpriority ELSE o_orderstatus END AS member FROM orders, (SELECT CAST(unnest(range(3)) AS INTEGER) AS place)
UNION ALL SELECT 'overrides', o_orderkey, 0, CAST(o_custkey AS VARCHAR) FROM orders"""


def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as fields of nations; those without an urgent order are missing from the output."""
    fields = table(spark, sf_dir, "customer").select((F.col("c_nationkey")).alias("doc_id"), F.col("c_custkey").cast("string").alias("name"))
    ordered = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").cast("string").alias("name")).join(fields, "name")
    return parity.missing_of(fields, ordered, ["doc_id", "name"])


MISSING_FIELDS = "SELECT c_nationkey AS doc_id, CAST(c_custkey AS VARCHAR) AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')"


def target_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as occurrences of their customer, lines as style runs whose font is the return flag: A serif, R bold sans,
    N not resolved. All but half-open orders are authored, a run a line state that names its lines of up to 45 pieces;
    customers of one segment lack the bold face."""
    name = lambda c: F.concat(F.lit("s"), F.col(c).cast("string"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("k"), name("o_orderkey").alias("occurrence_id"), "o_orderstatus")
    run = F.concat(name("l_orderkey"), F.lit("/r"), F.col("l_linenumber").cast("string"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), run.alias("run_id"), "l_returnflag", "l_linestatus", "l_quantity")
    by_order = lines.groupBy("k").agg(F.collect_list(F.struct("run_id", F.lit("x").alias("text"), F.col("l_returnflag").alias("font_id"))).alias("style_runs"))
    segments = orders.join(by_order, "k").select("doc_id", "occurrence_id", F.lit("x").alias("text"), "style_runs")
    asked = lines.filter("l_quantity <= 45").groupBy("k", "l_linestatus").agg(F.collect_list("run_id").alias("source_runs"))
    runs = asked.groupBy("k").agg(F.collect_list(F.struct(F.col("l_linestatus").alias("text"), "source_runs")).alias("runs"))
    targets = orders.filter("o_orderstatus <> 'P'").join(runs, "k").select("doc_id", "occurrence_id", "runs")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), "c_mktsegment")
    known = F.array(*(F.struct(F.lit(f).alias("font_id"), F.lit(c).alias("class"), F.lit(b).alias("bold"), F.lit(False).alias("italic")) for f, c, b in (("A", "serif", False), ("R", "sans", True), ("N", "unknown", False))))
    fonts = customers.select("doc_id", F.inline(known))
    faces = customers.select("doc_id", F.inline(F.array(*(F.struct(F.lit(c).alias("class"), F.lit(r).alias("role")) for c, r in (("serif", "regular"), ("sans", "regular"))))))
    faces = faces.unionByName(customers.filter("c_mktsegment <> 'BUILDING'").select("doc_id", F.lit("sans").alias("class"), F.lit("bold").alias("role")))
    return validation.target_violations(targets, segments, fonts, faces)


TARGET_ALIGNMENT = """WITH l AS (SELECT o_custkey AS doc_id, 's' || o_orderkey AS occurrence_id, o_orderstatus, l_linenumber AS run, l_returnflag AS f, l_linestatus AS s, l_quantity AS q, c_mktsegment AS m
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey),
a AS (SELECT doc_id, occurrence_id, s, run FROM l WHERE o_orderstatus <> 'P' AND q <= 45),
t AS (SELECT DISTINCT doc_id, occurrence_id FROM a),
met AS (SELECT doc_id, occurrence_id, a.s, f, m FROM a JOIN l USING (doc_id, occurrence_id, run))
SELECT DISTINCT doc_id, occurrence_id, 'missing' AS rule FROM l ANTI JOIN t USING (doc_id, occurrence_id)
UNION ALL SELECT DISTINCT doc_id, occurrence_id, 'references' FROM (SELECT doc_id, occurrence_id FROM a GROUP BY doc_id, occurrence_id, s HAVING count(*) > count(DISTINCT run))
UNION ALL SELECT DISTINCT doc_id, occurrence_id, 'unresolved-style' FROM met WHERE f = 'N'
UNION ALL SELECT DISTINCT doc_id, occurrence_id, 'missing-face' FROM met WHERE f = 'R' AND m = 'BUILDING'
UNION ALL SELECT DISTINCT doc_id, occurrence_id, 'mixed-styles' FROM (SELECT doc_id, occurrence_id FROM met WHERE f <> 'N' GROUP BY doc_id, occurrence_id, s HAVING count(DISTINCT f) > 1)
UNION ALL SELECT DISTINCT doc_id, occurrence_id, 'omitted-run' FROM l SEMI JOIN t USING (doc_id, occurrence_id) ANTI JOIN a USING (doc_id, occurrence_id, run)"""


def fonts_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return flags and line states of an order as the fonts that are drawn, a fixed map as those that are configured."""
    fonts = F.create_map(*(F.lit(x) for pair in (("N", "Sans"), ("R", "Serif"), ("O", "Mono"), ("X", "None")) for x in pair))
    drawn = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_set("l_returnflag").alias("drawn"))
    return drawn.select("doc_id", F.array_join(font_ops.fonts_in_use(fonts, F.col("drawn")), ",").alias("fonts"))


FONTS_IN_USE = "SELECT l_orderkey AS doc_id, coalesce(string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) FILTER (l_returnflag IN ('N', 'R', 'O', 'X')), '') AS fonts FROM lineitem GROUP BY 1"


def object_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a part as named objects of a page."""
    objects = F.create_map(F.col("p_type"), F.col("p_partkey"), F.concat("p_brand", F.lit("/2")), F.col("p_partkey") + 1, F.lit("Im0"), F.col("p_partkey") + 2)
    entries = F.transform(content.in_name_order(objects), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(entries, ";").alias("objects"))


OBJECT_ORDER = "SELECT p_partkey, array_to_string(list_sort([concat(p_type, '=', p_partkey), concat(p_brand, '/2=', p_partkey + 1), concat('Im0=', p_partkey + 2)]), ';') AS objects FROM part"


def page_line_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as lines of pages."""
    k = F.col("p_partkey")
    lines = table(spark, sf_dir, "part").select((k % 40).alias("doc_id"), (k % 3).alias("page"), k.alias("line_no"), ((k * 37) % 50).alias("x0"), ((k * 91) % 70).alias("y0"))
    return layout.page_line_order(lines).select("doc_id", "page", "line_no", "place")


PAGE_LINE_ORDER = "SELECT p_partkey % 40 AS doc_id, p_partkey % 3 AS page, p_partkey AS line_no, CAST(row_number() OVER (PARTITION BY p_partkey % 40, p_partkey % 3 ORDER BY (p_partkey * 91) % 70, (p_partkey * 37) % 50, p_partkey) - 1 AS INTEGER) AS place FROM part"


def leak_scan_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with Han and Thai put in by number as sources and outputs; the tell judged every third."""
    k = F.col("doc_id")
    said = lambda n: F.element_at(F.array(F.lit("文字文字"), F.lit("ข้อความ"), F.lit("plain words")), (k % n % 3 + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", S.dominant_script(said(7)).alias("source_script"), S.dominant_script(said(5)).alias("output_script"), (k % 3 == 0).alias("by_tell"))
    return gates.leak_scan(docs)


LEAK_SCAN_GATE = """SELECT doc_id, 'leak-scan' AS gate, 13 AS ord, CASE WHEN doc_id % 3 = 0 THEN 'SKIP' ELSE 'REVIEW' END AS status, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS n_findings
FROM documents WHERE doc_id % 7 % 3 = doc_id % 5 % 3 AND doc_id % 7 % 3 < 2"""

QUERIES = {
    "concatenated_lists": (concatenated_lists, CONCATENATED_LISTS),
    "missing_fields": (missing_fields, MISSING_FIELDS),
    "target_alignment": (target_alignment, TARGET_ALIGNMENT),
    "fonts_in_use": (fonts_in_use, FONTS_IN_USE),
    "object_order": (object_order, OBJECT_ORDER),
    "page_line_order": (page_line_order, PAGE_LINE_ORDER),
    "leak_scan_gate": (leak_scan_gate, LEAK_SCAN_GATE),
    "merge_matches": (merge_matches, MERGE_MATCHES),
    "advanced_parts": (advanced_parts, ADVANCED_PARTS),
    "corpus_summary": (corpus_summary, CORPUS_SUMMARY),
    "first_occurrences": (first_occurrences, FIRST_OCCURRENCES),
    "notices": (notices, NOTICES),
    "united_lists": (united_lists, UNITED_LISTS),
    "merge_proposals": (merge_proposals, MERGE_PROPOSALS),
    "script_runs": (script_runs, SCRIPT_RUNS),
    "kinsoku_lines": (kinsoku_lines, None),
    "gate_report": (gate_report, GATE_REPORT),
}
