"""Review findings: structural checks, and validation of given judgments.

Judgments (queries, picks, verdicts, claims, flags) are input tables; what is computed here is which
of them count.  Every finding has paper_id, pass, pos, kind, section_id, claim, confidence, rationale and ref_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators.layout import normalize_heading

# Caps of a run, and headings that are not reviewed.
MAX_SECTIONS, MAX_QUERIES, MAX_CHECKS, MAX_STRUCTURAL = 6, 2, 15, 12
SKIP = ("abstract", "references", "bibliography", "acknowledgments", "acknowledgements", "appendix", "appendices")
VERDICT_KIND = (("does_not_support", "mismatch"), ("cannot_tell", "unverifiable"))


def finding(rows: DataFrame, number: int, **columns: Column) -> DataFrame:
    blank = F.lit(None).cast("string")
    names = ("kind", "section_id", "claim", "confidence", "rationale", "ref_id")
    return rows.select("paper_id", F.lit(number).alias("pass"), columns["pos"].cast("long").alias("pos"), *[columns.get(n, blank).cast("string").alias(n) for n in names])


def reviewable_sections(sections: DataFrame) -> DataFrame:
    rows = sections.where((F.char_length("text") > 300) & ~normalize_heading(F.col("title")).isin(*SKIP))
    k = F.row_number().over(Window.partitionBy("paper_id").orderBy("sec_no"))
    return rows.withColumn("k", k).where(F.col("k") <= MAX_SECTIONS).drop("k")


def sentence_with(text: Column, ref_id: Column) -> Column:
    """The first sentence with the reference in one of its tokens, else ''."""
    hit = F.filter(T.split_sentences(text), lambda s: F.array_contains(T.extract_tokens(s), ref_id))
    return F.coalesce(F.get(hit, F.lit(0)), F.lit(""))


def bundles(citations: DataFrame) -> DataFrame:
    """The four largest resolved markers of four works or more, in order of size."""
    rows = citations.where(F.col("resolved") & (F.size("ref_ids") >= 4)).withColumn("n", F.size("ref_ids"))
    k = F.row_number().over(Window.partitionBy("paper_id").orderBy(F.desc("n"), "cit_no"))
    return rows.withColumn("k", k).where("k <= 4")


def concentration(refs: DataFrame) -> DataFrame:
    """paper_id, fam, n, total where a first author has four references and a tenth of all."""
    total = refs.groupBy("paper_id").agg(F.count("*").alias("total"))
    fams = refs.where("fam <> ''").groupBy("paper_id", F.lower("fam").alias("fam")).agg(F.count("*").alias("n"), F.min("pos").alias("first")).where("n >= 4")
    return fams.join(total, "paper_id").where("n * 10 >= total")


def structural_checks(citations: DataFrame, refs: DataFrame, sections: DataFrame) -> DataFrame:
    b = bundles(citations).join(sections.select("paper_id", "section_id", "text"), ["paper_id", "section_id"], "left")
    first = finding(
        b, 3, pos=F.col("k"), kind=F.lit("redundant_citation"), section_id=F.col("section_id"), claim=F.coalesce(sentence_with(F.col("text"), F.get("ref_ids", F.lit(0))), F.lit("")),
        confidence=F.lit("medium"), rationale=F.concat(F.col("n"), F.lit(" works are cited together for one claim")),
    )
    c = concentration(refs)
    second = finding(
        c, 3, pos=F.lit(100) + F.col("first"), kind=F.lit("info"), confidence=F.lit("low"),
        rationale=F.concat(F.lit("Citation diversity: "), F.col("n"), F.lit(" of "), F.col("total"), F.lit(" references share the first author '"), F.initcap("fam"), F.lit("'")),
    )
    both = first.unionByName(second)
    k = F.row_number().over(Window.partitionBy("paper_id").orderBy("pos"))
    return both.withColumn("k", k).where(F.col("k") <= MAX_STRUCTURAL).drop("k")


def missing_work(sections: DataFrame, queries: DataFrame, hits: DataFrame, picks: DataFrame) -> DataFrame:
    """Picks (by index into the first six hits of a section) as findings; a section without hits says so.

    queries: paper_id, section_id, query_no, query; hits: paper_id, section_id, rank, title, url; picks:
    paper_id, section_id, pick_no, index, confidence, rationale.
    """
    key = ["paper_id", "section_id"]
    asked = reviewable_sections(sections).select(*key, "sec_no").join(
        queries.where(T.strip(F.col("query")) != "").where(F.col("query_no") < MAX_QUERIES).select(*key).distinct(), key
    )
    six = hits.where("rank <= 6")
    none = asked.join(six.select(*key).distinct(), key, "left_anti")
    info = finding(none, 1, pos=F.col("sec_no") * 10, kind=F.lit("info"), section_id=F.col("section_id"), confidence=F.lit("low"), rationale=F.lit("No candidate works found."))
    two = picks.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("pick_no"))).where("k <= 2")
    chosen = asked.join(two, key).join(six.select(*key, (F.col("rank") - 1).alias("index"), "title"), [*key, "index"])
    good = finding(
        chosen, 1, pos=F.col("sec_no") * 10 + F.col("k"), kind=F.lit("missing_citation"), section_id=F.col("section_id"), claim=F.col("title"),
        confidence=F.coalesce("confidence", F.lit("medium")), rationale=F.substring("rationale", 1, 600),
    )
    return info.unionByName(good)


def citation_checks(citations: DataFrame, sections: DataFrame, refs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Claims of resolved markers against abstracts: first two references, claims of 40 characters or more.

    The cap is tested per marker and counted per reference, so up to one more may pass.
    """
    rows = citations.where("resolved").join(sections.select("paper_id", "section_id", "text"), ["paper_id", "section_id"])
    rows = rows.withColumn("claim", sentence_with(F.col("text"), F.get("ref_ids", F.lit(0)))).where(F.char_length("claim") >= 40)
    rows = rows.withColumn("two", F.slice("ref_ids", 1, 2))
    before = F.coalesce(F.sum(F.size("two")).over(Window.partitionBy("paper_id").orderBy("cit_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", before).where(F.col("before") < MAX_CHECKS)
    each = rows.select("paper_id", "section_id", "cit_no", "claim", F.posexplode("two").alias("j", "ref_id"))
    each = each.join(refs.select("paper_id", "ref_id", "abstract"), ["paper_id", "ref_id"]).join(verdicts, ["paper_id", "cit_no", "ref_id"], "left")
    none = F.coalesce("abstract", F.lit("")) == ""
    kind = F.when(none, "unverifiable")
    for verdict, k in VERDICT_KIND:
        kind = kind.when(F.col("verdict") == verdict, k)
    each = each.where(none | F.col("verdict").isNotNull())
    return finding(
        each, 4, pos=F.col("cit_no") * 2 + F.col("j"), kind=kind.otherwise("info"), section_id=F.col("section_id"), claim=F.col("claim"), confidence=F.lit("medium"),
        rationale=F.when(none, "No abstract available.").otherwise(F.col("verdict")), ref_id=F.col("ref_id"),
    )


def uncited_claims(sections: DataFrame, claims: DataFrame) -> DataFrame:
    """The first three claimed sentences of a section that stand in it verbatim, uncited, of 40 characters or more."""
    key = ["paper_id", "section_id"]
    three = claims.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("claim_no"))).where("k <= 3")
    rows = reviewable_sections(sections).join(three, key)
    flat = F.array_join(T.words(F.col("sentence")), " ")
    body = F.array_join(T.words(F.substring("text", 1, 4000)), " ")
    ok = (F.char_length(flat) >= 40) & F.contains(body, flat) & ~F.col("sentence").rlike(T.TOKEN)
    return finding(rows.where(ok), 2, pos=F.col("sec_no") * 10 + F.col("k"), kind=F.lit("uncited_claim"), section_id=F.col("section_id"), claim=flat, confidence=F.lit("medium"))


def all_findings(*passes: DataFrame) -> DataFrame:
    """All passes as one table, numbered in their order."""
    out = passes[0]
    for p in passes[1:]:
        out = out.unionByName(p)
    return out.withColumn("finding_no", F.row_number().over(Window.partitionBy("paper_id").orderBy("pass", "pos")))


def new_uncited_sentences(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """Sentences of new_text that old_text lacks, without a token, of 40 characters or more; in order, with repeats."""

    def norm(x: Column) -> Column:
        return F.lower(F.array_join(T.words(x), " "))

    old = F.transform(T.split_sentences(F.col("old_text")), norm)
    rows = diffs.withColumn("old", old).select(*keys, "old", F.posexplode(T.split_sentences(F.col("new_text"))).alias("sent_no", "sentence"))
    ok = ~F.array_contains("old", norm(F.col("sentence"))) & ~F.col("sentence").rlike(T.TOKEN)
    return rows.where(ok).withColumn("sentence", T.strip(F.col("sentence"))).where(F.char_length("sentence") >= 40).drop("old")


def post_edit_warnings(diffs: DataFrame, flags: DataFrame, keys: list[str]) -> DataFrame:
    """Warnings for flagged sentences among the first six new ones; the first three flags of a diff count."""
    rows = new_uncited_sentences(diffs, keys).withColumn("index", F.row_number().over(Window.partitionBy(*keys).orderBy("sent_no")) - 1).where("index < 6")
    three = flags.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("flag_no"))).where("k <= 3")
    return rows.join(three, [*keys, "index"]).select(
        *keys, "k", F.concat(F.lit("the edited sentence “"), F.substring("sentence", 1, 160), F.lit("” may need a citation — "), F.substring("why", 1, 200)).alias("warning")
    )
