"""Citation tables derived from the relational test tables.

paper = customer, section = order, reference = line item, first author = nation of the
supplier, title = part and supplier names, year = ship year.  Everything is
deterministic, so the same tables can be written in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper_id, section_id, pos, ref_id, fam, title, yr, doi; position within the paper."""
    line, order = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    part, supplier, nation = (table(spark, sf_dir, n) for n in ("part", "supplier", "nation"))
    rows = (
        line.join(order.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part.select("p_partkey", "p_name", "p_type", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier.select("s_suppkey", "s_name", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation.select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    )
    order_in_paper = Window.partitionBy("o_custkey").orderBy(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"
    )
    return rows.select(
        F.col("o_custkey").alias("paper_id"),
        F.col("o_orderkey").alias("section_id"),
        F.row_number().over(order_in_paper).alias("pos"),
        F.lower("n_name").alias("fam"),
        F.concat_ws(" ", "p_name", F.lower("p_type"), "p_brand", "s_name").alias("title"),
        F.year("l_shipdate").alias("yr"),
        F.concat_ws("/", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("doi"),
    )


#: The same references in SQL, as a common table expression.
REFS_SQL = """refs AS (
  SELECT o_custkey AS paper_id, o_orderkey AS section_id,
         CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS INTEGER) AS pos,
         lower(n_name) AS fam, concat_ws(' ', p_name, lower(p_type), p_brand, s_name) AS title,
         CAST(year(l_shipdate) AS INTEGER) AS yr, concat_ws('/', l_partkey, l_suppkey) AS doi
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
       JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def works(refs: DataFrame) -> DataFrame:
    """A catalog of perturbed references, so that every class of match occurs:
    year shifted, title cut or the author replaced by turns of position."""
    k = F.col("pos") % 6
    return refs.select(
        "paper_id",
        "pos",
        F.when(k == 0, F.col("yr") + 5).when(k == 1, F.lit(None)).otherwise(F.col("yr") + 1).cast("int").alias("year"),
        F.when(k == 2, F.array_join(F.slice(F.split("title", " "), 1, 3), " "))
        .when(k == 3, F.concat(F.col("title"), F.lit(" revisited once more with feeling")))
        .otherwise(F.col("title")).alias("title"),
        F.when(k == 4, F.lit("Nobody Else")).when(k == 1, F.lit("")).otherwise(F.col("fam")).alias("author"),
        (F.col("pos") * 7 % 100).cast("long").alias("cited_by"),
        F.when(F.col("pos") % 3 == 0, F.concat(F.lit("10.5555/"), F.col("doi"))).alias("doi"),
        F.when(F.col("pos") % 2 == 0, "openalex").otherwise("semanticscholar").alias("source"),
    )


WORKS_SQL = """works AS (
  SELECT paper_id, pos, CAST(CASE pos % 6 WHEN 0 THEN yr + 5 WHEN 1 THEN NULL ELSE yr + 1 END AS INTEGER) AS year,
         CASE pos % 6 WHEN 2 THEN array_to_string(string_split(title, ' ')[1:3], ' ') WHEN 3 THEN title || ' revisited once more with feeling' ELSE title END AS title,
         CASE pos % 6 WHEN 4 THEN 'Nobody Else' WHEN 1 THEN '' ELSE fam END AS author, CAST(pos * 7 % 100 AS BIGINT) AS cited_by,
         CASE WHEN pos % 3 = 0 THEN '10.5555/' || doi END AS doi,
         CASE WHEN pos % 2 = 0 THEN 'openalex' ELSE 'semanticscholar' END AS source
  FROM refs)"""


def entries(refs: DataFrame) -> DataFrame:
    """Raw bibliography entries in four formats by turns of position."""
    title = F.concat(F.upper(F.substring("title", 1, 1)), F.expr("substring(title, 2)"))
    name = F.concat(F.upper(F.substring("fam", 1, 1)), F.expr("substring(replace(fam, ' ', ''), 2)"))
    k, yr = F.col("pos") % 4, F.col("yr").cast("string")
    raw = (
        F.when(k == 0, F.concat(name, F.lit(", A. ("), yr, F.lit("). "), title, F.lit(". Journal of Parts, 12(3):45-67.")))
        .when(k == 1, F.concat(F.lit("A. "), name, F.lit(', "'), title, F.lit('," In Proceedings of the Parts Conference, '), yr, F.lit(".")))
        .when(k == 2, F.concat(F.lit("Ann "), name, F.lit(". "), yr, F.lit(". "), title, F.lit(". In Parts Workshop, pages 1-9. doi:10.5555/"), F.col("doi"), F.lit(".")))
        .otherwise(F.concat(F.lit("Ann "), name, F.lit(". "), title, F.lit(". CoRR abs/9701.0"), F.lpad(F.col("pos").cast("string"), 4, "0"), F.lit(", "), yr, F.lit(".")))
    )
    return refs.select("paper_id", "section_id", "pos", F.concat(F.lit("["), "pos", F.lit("] "), raw).alias("raw"), title.alias("true_title"), name.alias("true_family"), "yr", "doi", "fam")


#: The same entries in SQL, after refs: title (t), family (f) and raw text of each reference.
ENTRIES_SQL = """ents AS (SELECT *, CASE pos % 4 WHEN 0 THEN f || ', A. (' || yr || '). ' || t || '. Journal of Parts, 12(3):45-67.'
    WHEN 1 THEN 'A. ' || f || ', "' || t || '," In Proceedings of the Parts Conference, ' || yr || '.'
    WHEN 2 THEN 'Ann ' || f || '. ' || yr || '. ' || t || '. In Parts Workshop, pages 1-9. doi:10.5555/' || doi || '.'
    ELSE 'Ann ' || f || '. ' || t || '. CoRR abs/9701.0' || lpad(CAST(pos AS VARCHAR), 4, '0') || ', ' || yr || '.' END AS body
  FROM (SELECT *, upper(substr(title, 1, 1)) || substr(title, 2) AS t, upper(substr(fam, 1, 1)) || substr(replace(fam, ' ', ''), 2) AS f FROM refs))"""


def numbered_sections(refs: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """A text per section that cites its references: a list marker, a range and an orphan."""
    own = refs.groupBy("paper_id", "section_id").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    lo, hi = F.col("lo").cast("string"), F.col("hi").cast("string")
    text = F.concat(
        F.lit("Prior work ["), lo, F.lit(", "), hi, F.lit("] is broad. Series ["), lo, F.lit("-"), hi,
        F.lit("] extends it! An orphan [999] stays. Section "), F.col("section_id").cast("string"), F.lit(" ends here without any marker at all."),
    )
    return own.select("paper_id", "section_id", "lo", "hi", text.alias("text"))


def layout_lines(docs: DataFrame) -> DataFrame:
    """Documents as layout lines of twelve to a page, with synthetic geometry."""
    rows = docs.select(F.col("doc_id").alias("paper_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "text"))
    k = F.col("line_no") % 12
    return rows.select(
        "paper_id", "line_no", "text", F.floor(F.col("line_no") / 12).cast("int").alias("page"),
        F.when(k == 0, 30.0).when(k == 11, 760.0).otherwise(60.0 + 55.0 * k).alias("y0"),
        F.when((F.col("paper_id") % 3 == 0) & (k >= 6), 320.0).otherwise(72.0).alias("x0"),
        F.when(F.col("line_no") % 7 == 0, 12.0).otherwise(10.0).alias("size"),
        (F.col("line_no") % 5 == 0).alias("bold"), F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"),
    )


LINES_SQL = r"""lines AS (
  SELECT paper_id, CAST(line_no AS INTEGER) AS line_no, text, CAST(line_no // 12 AS INTEGER) AS page,
         CASE line_no % 12 WHEN 0 THEN 30.0 WHEN 11 THEN 760.0 ELSE 60.0 + 55.0 * (line_no % 12) END AS y0,
         CASE WHEN paper_id % 3 = 0 AND line_no % 12 >= 6 THEN 320.0 ELSE 72.0 END AS x0,
         CASE WHEN line_no % 7 = 0 THEN 12.0::DOUBLE ELSE 10.0 END AS size, line_no % 5 = 0 AS bold, 612.0 AS page_width, 792.0 AS page_height
  FROM (SELECT doc_id AS paper_id, unnest(range(len(p))) AS line_no, unnest(p) AS text
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)))"""
