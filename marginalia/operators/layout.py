"""Layout lines: furniture, headings, sections, and the reference list.

All tables are keyed by paper_id with line_no as the explicit order; windows are per paper.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as T

# Canonical section names and the shapes of headings and entries.
HEADINGS = (
    "abstract", "introduction", "related work", "background", "preliminaries", "method", "methods", "methodology", "approach",
    "model", "experiments", "experimental setup", "evaluation", "results", "results and discussion", "analysis", "discussion",
    "limitations", "conclusion", "conclusions", "future work", "acknowledgments", "acknowledgements", "references",
    "bibliography", "works cited", "literature cited", "appendix", "appendices", "broader impact", "ethics statement",
)
REF_HEADINGS = ("references", "bibliography", "works cited", "literature cited")
END_HEADINGS = ("appendix", "appendices", "acknowledgments", "acknowledgements", "supplementary material")
END_PREFIX = r"^(?:appendix|acknowledgment|acknowledgement|supplementary)"
NUMBERED = r"^(?:\d+|[IVXL]+)(?:\.\d+)*\.?\s+[A-Z“\"]"
NUMBER_ONLY = r"^(?:\d+(?:\.\d+)*|[IVXL]+)\.?$"
HEADING_NUMBER = r"^(?:\d+|[IVXL]+)(?:\.\d+)*\.?\s+"
STOP_LINE = (
    r"(?i)^(?:appendices\s*$|appendix\b|acknowledg?e?ments\b|supplementary\b|(?:figure|table|fig\.|tab\.)\s*\d|.{0,50}visualizations?\s*$)"
)
CITATION_SHAPED = r"(?U)^(?:\[\d{1,3}\]|\d{1,3}\.\s|[A-Z][\w'\-]+,?\s+(?:[A-Z]\.\s*)+)"
AUTHOR_START = r"(?U)^[A-Z][\w'\-]+,?\s+(?:[A-Z]\.|[A-Z][\w'\-]+)"
BRACKET_ENTRY = r"\[(\d+)\]\s+(?=[A-Z])"
DOT_NUMBER = r"^(\d{1,3})\.\s+(?=\S)"
BAND = 0.08


def in_order():
    """The lines of each paper in their order."""
    return Window.partitionBy("paper_id").orderBy("line_no")


def clean_spans(spans: DataFrame) -> DataFrame:
    """Lines from raw text spans: no vertical or blank text, arXiv banner, or page number at the foot."""
    banner = r"^arXiv:\d{4}\.\d{4,5}(?:v\d+)?\s+\[[\w.\-]+\]\s+\d{1,2}\s+\w{3,9}\s+\d{4}"
    foot = F.col("y0") > F.col("page_height") * (1 - BAND)
    t = T.strip(F.col("text"))
    return spans.where((F.abs(F.coalesce("dir_y", F.lit(0.0))) <= 0.5) & (t != "") & ~t.rlike(banner) & ~(foot & t.rlike(r"^\d{1,3}$"))).withColumn("size", F.round("size", 1))


def in_band() -> Column:
    height = F.coalesce("page_height", F.lit(792.0))
    return (F.col("y0") < height * BAND) | (F.col("y0") > height * (1 - BAND))


def drop_furniture(lines: DataFrame) -> DataFrame:
    """Without the texts that stand in the edge bands of three pages or more, there only."""
    often = lines.where(in_band()).groupBy("paper_id", "text").agg(F.countDistinct("page").alias("pages")).where("pages >= 3")
    marked = lines.join(often.select("paper_id", "text", F.lit(True).alias("often")), ["paper_id", "text"], "left")
    return marked.where(F.col("often").isNull() | ~in_band()).select(*lines.columns)


def body_size(lines: DataFrame) -> DataFrame:
    """The size with most characters; the first seen wins ties."""
    each = lines.groupBy("paper_id", "size").agg(F.sum(F.char_length("text")).alias("n"), F.min("line_no").alias("first"))
    return each.groupBy("paper_id").agg(F.max_by("size", F.struct("n", -F.col("first"))).alias("body"))


def page_count(lines: DataFrame) -> DataFrame:
    return lines.groupBy("paper_id").agg((F.max("page") + 1).cast("int").alias("pages"))


def two_column_pages(lines: DataFrame) -> DataFrame:
    """Per page its number of lines and whether it is set in two columns."""
    first = F.first_value("page_width").over(Window.partitionBy("paper_id", "page").orderBy("line_no"))
    w = F.when(F.col("width") == 0, 612.0).otherwise(F.coalesce("width", F.lit(612.0)))
    rows = lines.withColumn("width", first).withColumn("width", w).withColumn("right", F.col("x0") >= F.col("width") * 0.40)
    pages = rows.groupBy("paper_id", "page").agg(
        F.count("*").alias("n"), F.count_if("right").alias("n_right"), F.min("width").alias("width"),
        F.sort_array(F.collect_list(F.when(F.col("right"), F.col("x0")))).alias("xs"),
    )
    middle = F.get("xs", (F.size("xs") / 2).cast("int"))
    two = (F.col("n_right") >= 8) & (F.col("n") - F.col("n_right") >= 8) & (middle > F.col("width") * 0.38)
    return pages.select("paper_id", "page", "n", F.coalesce(two, F.lit(False)).alias("two"))


def detect_layout(lines: DataFrame) -> DataFrame:
    pages = two_column_pages(lines).groupBy("paper_id").agg(
        F.count_if((F.col("n") >= 10) & F.col("two")).alias("two"), F.count_if((F.col("n") >= 10) & ~F.col("two")).alias("one")
    )
    kind = F.when((F.col("two") >= 2) & (F.col("one") >= 2), "Mixed layout").when(F.col("two") > F.col("one"), "Two-column").otherwise("Single column")
    return pages.select("paper_id", kind.alias("layout"))


def is_upper(t: Column) -> Column:
    return t.rlike(r"(?U)\p{Lu}") & ~t.rlike(r"(?U)\p{Ll}")


def normalize_heading(t: Column) -> Column:
    return F.lower(F.regexp_replace(T.strip(F.regexp_replace(t, HEADING_NUMBER, "")), r"[:. ]+$", ""))


def emphasized(t: Column) -> Column:
    return (F.col("size") > F.col("body") + 0.3) | F.col("bold") | is_upper(t)


def is_heading(text: Column) -> Column:
    """Boolean over a line with text, size, bold and its paper's body size."""
    t = T.strip(text)
    numbered = t.rlike(NUMBERED) & emphasized(t) & ~t.rlike(r"[.,;]$")
    leading = F.regexp_extract(t, r"^(\d+)", 1)
    fits = (F.char_length(t) <= 70) & ~t.rlike(r":\s+[a-z]") & ((leading == "") | (leading.try_cast("int") <= 99))
    named = normalize_heading(t).isin(*HEADINGS) & emphasized(t)
    return (t != "") & (F.char_length(t) <= 120) & F.when(numbered, F.coalesce(fits, F.lit(False))).otherwise(named)


def heading_level(text: Column) -> Column:
    dots = F.regexp_extract(T.strip(text), r"^(\d+(?:\.\d+)*)", 1)
    return F.when(dots == "", 1).otherwise(F.size(F.split(dots, r"\."))).cast("int")


def merge_split_headings(lines: DataFrame) -> DataFrame:
    """A line that is just a number and the emphasised line beside it become one."""
    t = T.strip(F.col("text"))
    after = {c: F.lead(c).over(in_order()) for c in ("text", "page", "y0", "size", "bold")}
    rows = lines.withColumns({f"next_{c}": v for c, v in after.items()})
    nt = T.strip(F.col("next_text"))
    strong = (F.col("next_size") > F.col("body") + 0.3) | F.col("next_bold") | F.col("bold") | is_upper(nt)
    starts = t.rlike(NUMBER_ONLY) & (F.col("page") == F.col("next_page")) & (F.abs(F.col("y0") - F.col("next_y0")) < 3) & nt.rlike("^[A-Z]") & strong
    rows = rows.withColumn("wants", F.coalesce(starts, F.lit(False)))
    # A line that was taken cannot start a merge: in a run of wishes every second counts.
    gap = F.max(F.when(~F.col("wants"), F.col("line_no"))).over(in_order())
    nth = F.count_if("wants").over(Window.partitionBy("paper_id", "gap").orderBy("line_no"))
    rows = rows.withColumn("gap", F.coalesce(gap, F.lit(-1))).withColumn("nth", nth).withColumn("merges", F.col("wants") & (F.col("nth") % 2 == 1))
    taken = F.coalesce(F.lag("merges").over(in_order()), F.lit(False))
    rows = rows.withColumn("taken", taken).where(~F.col("taken"))
    return rows.select(
        *[c for c in lines.columns if c not in ("text", "size", "bold")],
        F.when(F.col("merges"), F.concat_ws(" ", t, nt)).otherwise(F.col("text")).alias("text"),
        F.when(F.col("merges"), F.greatest("size", "next_size")).otherwise(F.col("size")).alias("size"),
        F.when(F.col("merges"), F.col("bold") | F.col("next_bold")).otherwise(F.col("bold")).alias("bold"),
    )


def title_of(lines: DataFrame) -> DataFrame:
    """The first three of the largest among the first 18 lines of page one."""
    top = lines.where("page = 0").withColumn("k", F.row_number().over(in_order())).where("k <= 18")
    t = T.strip(F.col("text"))
    top = top.where((F.char_length(t) > 3) & ~t.rlike(NUMBERED))
    top = top.withColumn("most", F.max("size").over(Window.partitionBy("paper_id"))).where("size >= most - 0.2")
    top = top.withColumn("k", F.row_number().over(in_order())).where("k <= 3")
    return top.groupBy("paper_id").agg(T.join_hyphenated(F.array_sort(F.collect_list(F.struct("k", "text")))["text"]).alias("title"))


def sections(lines: DataFrame, body: DataFrame) -> DataFrame:
    """paper_id, section_id, sec_no, title, level, text; 'abstract' apart, text before headings dropped."""
    rows = lines.join(body, "paper_id").withColumn("head", is_heading(F.col("text")))
    rows = rows.withColumn("sec_no", F.sum(F.col("head").cast("int")).over(in_order())).where("sec_no > 0")
    per = Window.partitionBy("paper_id", "sec_no").orderBy("line_no")
    rows = rows.withColumn("heading", F.first_value("text").over(per))
    abstract = normalize_heading(F.col("heading")) == "abstract"
    slack = F.when(abstract, 1.2).otherwise(0.7)
    kept = F.when(~F.col("head") & (F.col("size") >= F.col("body") - slack), F.struct("line_no", "text"))
    out = rows.groupBy("paper_id", "sec_no", "heading").agg(F.array_sort(F.collect_list(kept))["text"].alias("parts"))
    out = out.withColumn("abstract", normalize_heading(F.col("heading")) == "abstract")
    rank = F.sum((~F.col("abstract")).cast("int")).over(Window.partitionBy("paper_id").orderBy("sec_no"))
    return out.select(
        "paper_id", F.when(F.col("abstract"), "abstract").otherwise(F.concat(F.lit("sec"), rank)).alias("section_id"), F.col("sec_no").cast("int").alias("sec_no"),
        T.strip(F.col("heading")).alias("title"), heading_level(F.col("heading")).alias("level"), T.join_hyphenated(F.col("parts")).alias("text"),
    )


def is_table_row(text: Column) -> Column:
    t = T.strip(text)
    w = T.words(t)
    tiny = F.size(F.filter(w, lambda x: F.char_length(F.regexp_replace(x, "[^A-Za-z0-9]", "")) <= 3))
    return (t != "") & ~t.rlike(r"^\[\d+\]") & ~t.rlike(DOT_NUMBER) & (F.size(w) >= 4) & (tiny * 10 >= F.size(w) * 7)


def ends_references(text: Column) -> Column:
    """Whether a line (text, size, bold, body) is no longer bibliography."""
    t = T.strip(text)
    norm = normalize_heading(t)
    return (t != "") & (t.rlike(STOP_LINE) | ((norm.isin(*END_HEADINGS) | norm.rlike(END_PREFIX)) & (is_heading(text) | emphasized(t))))


def reference_lines(lines: DataFrame, body: DataFrame) -> DataFrame:
    """The lines of the reference list: after the last such heading up to its end or
    the second table row in a row; single table rows are skipped."""
    rows = lines.join(body, "paper_id")
    named = normalize_heading(F.col("text")).isin(*REF_HEADINGS)
    start = rows.groupBy("paper_id").agg(
        F.coalesce(F.max(F.when(named & is_heading(F.col("text")), F.col("line_no"))), F.max(F.when(named, F.col("line_no")))).alias("start")
    )
    after = rows.join(start.where("start is not null"), "paper_id").where("line_no > start")
    after = after.withColumn("row", is_table_row(F.col("text"))).withColumn("stop", ends_references(F.col("text")))
    kept_before = F.coalesce(F.count_if(~F.col("row")).over(in_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    second = F.col("row") & F.coalesce(F.lag("row").over(in_order()), F.lit(False)) & (kept_before > 0)
    after = after.withColumn("end", F.col("stop") | second)
    after = after.withColumn("over", F.max(F.col("end").cast("int")).over(in_order().rowsBetween(Window.unboundedPreceding, 0)))
    return after.where("over = 0 and not row").select(*lines.columns)


def longest_citation_run(lines: DataFrame) -> DataFrame:
    """paper_id, start, length of the longest run of citation-shaped lines in the last third.

    A run survives three misses in a row.  Broken by a fourth, it is one
    line short (its count of misses includes the line at hand); the run open at the end keeps its tail and wins only
    if strictly longer.  Runs under five lines do not count.
    """
    n = F.count("*").over(Window.partitionBy("paper_id"))
    i = F.row_number().over(in_order()) - 1
    rows = lines.withColumn("i", i).withColumn("n", n).where("i >= floor(2 * n / 3)").withColumn("i", F.col("i") - F.floor(2 * F.col("n") / 3))
    rows = rows.withColumn("m", F.col("n") - F.floor(2 * F.col("n") / 3))
    hits = rows.where(T.strip(F.col("text")).rlike(CITATION_SHAPED))
    by_i = Window.partitionBy("paper_id").orderBy("i")
    new = (F.col("i") - F.lag("i").over(by_i) > 4) | F.lag("i").over(by_i).isNull()
    hits = hits.withColumn("island", F.sum(new.cast("int")).over(by_i))
    runs = hits.groupBy("paper_id", "island", "m").agg(F.min("i").alias("start"), F.max("i").alias("last"))
    broken = F.col("last") + 4 < F.col("m")
    runs = runs.withColumn("length", F.when(broken, F.col("last") - F.col("start")).otherwise(F.col("m") - F.col("start")))
    best = runs.groupBy("paper_id").agg(F.max_by(F.struct("start", "length"), F.struct("length", -F.col("start"))).alias("x"))
    return best.where("x.length >= 5").select("paper_id", F.col("x.start").cast("int").alias("start"), F.col("x.length").cast("int").alias("length"))


def sequential(numbers: DataFrame) -> DataFrame:
    """paper_id, ok for numbers (paper_id, k, num): three or more from 1 or 2, four fifths of steps in 1..3."""
    by_k = Window.partitionBy("paper_id").orderBy("k")
    rows = numbers.withColumn("step", F.col("num") - F.lag("num").over(by_k))
    g = rows.groupBy("paper_id").agg(F.count("*").alias("n"), F.min_by("num", "k").alias("first"), F.count_if(F.col("step").between(1, 3)).alias("good"))
    return g.select("paper_id", ((F.col("n") >= 3) & (F.col("first") <= 2) & (F.col("good") * 10 >= (F.col("n") - 1) * 8)).alias("ok"))


def sequence_gaps(numbers: DataFrame) -> DataFrame:
    """paper_id, gaps: 'a → b' where the next number is not the successor, the first eight."""
    by_k = Window.partitionBy("paper_id").orderBy("k")
    rows = numbers.withColumn("next", F.lead("num").over(by_k)).where("next <> num + 1")
    rows = rows.withColumn("r", F.row_number().over(by_k)).where("r <= 8")
    gap = F.concat(F.col("num"), F.lit(" → "), F.col("next"))
    return rows.groupBy("paper_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("r", gap.alias("g"))))["g"], ", ").alias("gaps"))


def split_block(blocks: DataFrame) -> DataFrame:
    """Bracket entries of a joined block (paper_id, blob), cut before each marker wherever it stands."""
    pieces = F.split("blob", r"(?=\[\d+\]\s+[A-Z])")
    rows = blocks.select("paper_id", F.posexplode(pieces).alias("k", "entry")).where(F.col("entry").rlike("^" + BRACKET_ENTRY))
    return rows.select("paper_id", "k", F.regexp_extract("entry", r"^\[(\d+)\]", 1).try_cast("int").alias("num"), T.strip_trailing_junk(F.col("entry")).alias("entry"))


def split_on_line_start(lines: DataFrame, pattern: str = DOT_NUMBER) -> DataFrame:
    """Entries that begin at each line with the pattern (the first line begins one anyway)."""
    rows = lines.withColumn("k", F.sum(F.col("text").rlike(pattern).cast("int")).over(in_order()))
    first = F.min("line_no").over(Window.partitionBy("paper_id"))
    lead_in = F.max(F.when(F.col("line_no") == F.col("first"), (F.col("k") == 0).cast("int"))).over(Window.partitionBy("paper_id"))
    rows = rows.withColumn("first", first).withColumn("k", F.col("k") + lead_in)
    return rows.groupBy("paper_id", "k").agg(T.join_hyphenated(F.array_sort(F.collect_list(F.struct("line_no", "text")))["text"]).alias("entry"))


def column_of() -> Column:
    return F.when(F.col("x0") < F.col("page_width") / 2, 0).otherwise(1)


def entry_starts(lines: DataFrame) -> DataFrame:
    """paper_id, page, col, start: the x0 where entries begin, where it looks like that."""
    rows = lines.withColumn("col", column_of()).withColumn("x", F.bround("x0").cast("int"))
    group = ["paper_id", "page", "col"]
    counts = rows.groupBy(*group, "x").agg(F.count("*").alias("n"), F.min("line_no").alias("first"))
    counts = counts.withColumn("r", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), "first"))).where("r <= 2")
    top = counts.groupBy(*group).agg(F.min_by("x", "r").alias("a"), F.max_by("x", "r").alias("b"))
    top = top.withColumn("start", F.when(F.abs(F.col("a") - F.col("b")) > 4, F.least("a", "b")).otherwise(F.col("a")))
    near = rows.join(top, group).where("abs(x - start) <= 2")
    good = near.groupBy(*group, "start").agg(F.count("*").alias("n"), F.count_if(F.col("text").rlike(AUTHOR_START)).alias("like"))
    return good.where("like >= greatest(2, n * 0.5)").select(*group, "start")


def author_year_entries(lines: DataFrame) -> DataFrame:
    """Entries by hanging indent where any group has starts, else by the shape of authors.

    A paper whose lines (more than four) give one entry comes back as its remainder:
    k = 0 and remainder = true, nothing dropped.
    """
    starts = entry_starts(lines)
    any_start = starts.select("paper_id").distinct().withColumn("indent", F.lit(True))
    rows = lines.withColumn("col", column_of()).join(starts, ["paper_id", "page", "col"], "left").join(any_start, "paper_id", "left")
    by_indent = F.coalesce(F.abs(F.bround("x0") - F.col("start")) <= 2, F.lit(False))
    begins = F.when(F.col("indent"), by_indent).otherwise(F.col("text").rlike(AUTHOR_START))
    first = F.row_number().over(in_order()) == 1
    rows = rows.withColumn("begins", begins).withColumn("first", first)
    rows = rows.withColumn("k", F.sum((F.col("begins") | F.col("first")).cast("int")).over(in_order()))
    per = Window.partitionBy("paper_id")
    rows = rows.withColumn("n_entries", F.max("k").over(per)).withColumn("n_lines", F.count("*").over(per))
    rows = rows.withColumn("remainder", (F.col("n_entries") <= 1) & (F.col("n_lines") > 4)).withColumn("k", F.when(F.col("remainder"), 0).otherwise(F.col("k")))
    out = rows.groupBy("paper_id", "k", "remainder", "indent").agg(T.join_hyphenated(F.array_sort(F.collect_list(F.struct("line_no", "text")))["text"]).alias("entry"))
    scheme = F.when(F.col("indent"), "author-year-indent").otherwise("author-year-regex")
    return out.select("paper_id", F.col("k").cast("int").alias("k"), "remainder", scheme.alias("scheme"), T.strip_trailing_junk(F.col("entry")).alias("entry"))
