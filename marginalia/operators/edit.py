"""Edits: the token multiset invariant, proposals, their acceptance and undoing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import text as T

# Decisions on a proposal and the states they lead to.
TRANSITIONS = (("pending", "approve", "applied"), ("pending", "reject", "rejected"), ("applied", "undo", "undone"))
ACTIONS = ("rewrite", "shorten", "add_citations")


def token_counts(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, ref_id, n: the multiset of citation tokens of a text column."""
    return rows.select(*keys, F.explode(T.extract_tokens(F.col(column))).alias("ref_id")).groupBy(*keys, "ref_id").agg(F.count("*").alias("n"))


def integrity(diffs: DataFrame, keys: list[str], allowed: DataFrame | None = None) -> DataFrame:
    """keys, ref_id, before, after, allowed: the tokens that an edit loses.

    One signed union of both multisets and one aggregation; a row that is not allowed is a violation.
    """
    signed = diffs.select(*keys, F.explode(T.extract_tokens(F.col("old_text"))).alias("ref_id"), F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(
        diffs.select(*keys, F.explode(T.extract_tokens(F.col("new_text"))).alias("ref_id"), F.lit(0).alias("b"), F.lit(1).alias("a"))
    )
    lost = signed.groupBy(*keys, "ref_id").agg(F.sum("b").alias("before"), F.sum("a").alias("after")).where("after < before")
    if allowed is None:
        return lost.withColumn("allowed", F.lit(False))
    return lost.join(allowed.withColumn("allowed", F.lit(True)), [*keys, "ref_id"], "left").na.fill(False, ["allowed"])


def unknown_tokens(rows: DataFrame, known: DataFrame, keys: list[str], column: str = "new_text") -> DataFrame:
    """keys, ref_id of tokens that are no reference of the paper."""
    each = rows.select("paper_id", *[k for k in keys if k != "paper_id"], F.explode(T.extract_tokens(F.col(column))).alias("ref_id")).distinct()
    return each.join(known.select("paper_id", "ref_id"), ["paper_id", "ref_id"], "left_anti").select(*keys, "ref_id")


def invented_tokens(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens in the new text that the old one does not have."""
    new = diffs.select(*keys, F.explode(T.extract_tokens(F.col("new_text"))).alias("ref_id"))
    old = diffs.select(*keys, F.explode(T.extract_tokens(F.col("old_text"))).alias("ref_id"))
    return new.join(old, [*keys, "ref_id"], "left_anti").distinct()


def valid_operations(plans: DataFrame, sections: DataFrame) -> DataFrame:
    """The first four plan rows of a known action on a known section."""
    ok = plans.where(F.col("action").isin(*ACTIONS)).join(sections.select("paper_id", "section_id").distinct(), ["paper_id", "section_id"], "left_semi")
    return ok.withColumn("k", F.row_number().over(Window.partitionBy("paper_id").orderBy("op_no"))).where("k <= 4").drop("k")


def accepted_rewrites(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """The first of at most two attempts that is not blank and neither loses nor invents tokens."""
    a = attempts.where((F.col("attempt") <= 2) & (T.strip(F.col("new_text")) != ""))
    every = [*keys, "attempt"]
    bad = integrity(a, every).select(*every).unionByName(invented_tokens(a, every).select(*every)).distinct()
    ok = a.join(bad, every, "left_anti")
    return ok.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("attempt"))).where("r = 1").drop("r")


def place_citations(sections: DataFrame, picks: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sections with tokens put into sentences, and the new references.

    picks has paper_id, section_id, sentence_index, candidate_index, in order pick_no; the first three with both
    indexes in range are placed.  Numbers go on from n_refs, one per distinct candidate in the order placed
    (from the last sentence to the first).
    """
    rows = picks.join(sections.select("paper_id", "section_id", F.size(T.split_sentences(F.col("text"))).alias("n")), ["paper_id", "section_id"])
    rows = rows.where("sentence_index >= 0 and sentence_index < n and candidate_index >= 0")
    first = Window.partitionBy("paper_id", "section_id")
    rows = rows.withColumn("k", F.row_number().over(first.orderBy("pick_no"))).where("k <= 3")
    placed = F.row_number().over(first.orderBy(F.desc("sentence_index"), "k"))
    rows = rows.withColumn("placed", placed).withColumn("first", F.min("placed").over(Window.partitionBy("paper_id", "section_id", "candidate_index")))
    rows = rows.withColumn("nth", F.dense_rank().over(first.orderBy("first"))).join(counts, "paper_id")
    rows = rows.withColumn("ref_id", F.concat(F.lit("ref"), F.col("n_refs") + F.col("nth")))
    tokens = rows.groupBy("paper_id", "section_id", "sentence_index").agg(F.array_join(F.array_sort(F.collect_list(F.struct("placed", "ref_id")))["ref_id"], "]] [[cite:").alias("t"))
    per = tokens.groupBy("paper_id", "section_id").agg(F.map_from_entries(F.collect_list(F.struct("sentence_index", F.concat(F.lit("[[cite:"), "t", F.lit("]]"))))).alias("m"))
    both = sections.join(per, ["paper_id", "section_id"])
    new = F.array_join(
        F.transform(T.split_sentences(F.col("text")), lambda s, i: F.when(F.element_at("m", i).isNotNull(), T.insert_citation(s, F.element_at("m", i))).otherwise(s)), " "
    )
    return both.select("paper_id", "section_id", F.col("text").alias("old_text"), new.alias("new_text")), rows.select("paper_id", "section_id", "ref_id", "candidate_index").distinct()


def apply_diffs(sections: DataFrame, diffs: DataFrame, refs: DataFrame, new_refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sections after the approved diffs, diffs refused with the first failing test).

    Tests in order: the section exists, no token of the current text is lost, new references
    have a source other than the pdf, all tokens are known.  A diff is judged against the
    text as it is now.
    """
    key = ["paper_id", "section_id"]
    rows = diffs.join(sections.select(*key, F.col("text").alias("now")), key, "left")
    live = rows.where("now is not null").select(*key, F.col("now").alias("old_text"), "new_text")
    lost = integrity(live, key).select(*key).distinct().withColumn("lost", F.lit(True))
    good_refs = new_refs.where("source is not null and source <> 'pdf'")
    bad = new_refs.where("source is null or source = 'pdf'").select("paper_id").distinct().withColumn("bad_ref", F.lit(True))
    known = refs.select("paper_id", "ref_id").unionByName(good_refs.select("paper_id", "ref_id"))
    strange = unknown_tokens(live, known, key).select(*key).distinct().withColumn("unknown", F.lit(True))
    judged = rows.join(lost, key, "left").join(bad, "paper_id", "left").join(strange, key, "left")
    reason = F.when(F.col("now").isNull(), "no such section").when(F.col("lost"), "drops citations").when(F.col("bad_ref"), "no provenance").when(F.col("unknown"), "unknown citation")
    judged = judged.withColumn("reason", reason)
    ok = judged.where("reason is null").select(*key, F.col("new_text").alias("put"))
    after = sections.join(ok, key, "left").withColumn("text", F.coalesce("put", "text")).drop("put")
    return after, judged.where("reason is not null").select(*key, "reason")


def undo(sections: DataFrame, diffs: DataFrame, added: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sections after undoing, diffs that cannot be undone, added references still cited).

    A diff can be undone while its section still has its new text; tokens of references that the proposal
    added may go, others not.
    """
    key = ["paper_id", "section_id"]
    rows = diffs.join(sections.select(*key, F.col("text").alias("now")), key, "left")
    allowed = diffs.select(*key).join(added.select("paper_id", "ref_id"), "paper_id")
    lost = integrity(rows.select(*key, F.col("new_text").alias("swap"), "old_text").select(*key, F.col("swap").alias("old_text"), F.col("old_text").alias("new_text")), key, allowed)
    lost = lost.where("not allowed").select(*key).distinct().withColumn("lost", F.lit(True))
    judged = rows.join(lost, key, "left")
    reason = F.when(F.col("now").isNull() | (F.col("now") != F.col("new_text")), "text has changed").when(F.col("lost"), "drops citations")
    judged = judged.withColumn("reason", reason)
    back = judged.where("reason is null").select(*key, F.col("old_text").alias("put"))
    after = sections.join(back, key, "left").withColumn("text", F.coalesce("put", "text")).drop("put")
    cited = after.select("paper_id", F.explode(T.extract_tokens(F.col("text"))).alias("ref_id")).distinct()
    return after, judged.where("reason is not null").select(*key, "reason"), added.join(cited, ["paper_id", "ref_id"], "left_semi")


def decide(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """proposal_id, status after the decision, and whether it was a conflict."""
    spark = proposals.sparkSession
    moves = spark.createDataFrame(list(TRANSITIONS), "status string, decision string, next string")
    rows = proposals.join(decisions, "proposal_id").join(F.broadcast(moves), ["status", "decision"], "left")
    return rows.select("proposal_id", "decision", F.coalesce("next", "status").alias("status"), F.col("next").isNull().alias("conflict"))


def folded_operations(operations: DataFrame, sections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one diff per section, the text that each operation starts from).

    operations: paper_id, section_id, op_no, new_text (null where it failed), notes (array).  A later operation starts from
    what the last successful one made; the diff goes from the original text to the last result and has all their notes.
    """
    key = ["paper_id", "section_id"]
    rows = operations.join(sections.select(*key, "text"), key)
    before = Window.partitionBy(*key).orderBy("op_no").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.select(*key, "op_no", F.coalesce(F.last("new_text", ignorenulls=True).over(before), "text").alias("base_text"))
    done = rows.where("new_text is not null").groupBy(*key).agg(
        F.first("text").alias("old_text"), F.max_by("new_text", "op_no").alias("new_text"), F.flatten(F.array_sort(F.collect_list(F.struct("op_no", "notes")))["notes"]).alias("notes"),
        F.min("op_no").alias("at"),
    )
    return done, base


def edit_summary(diffs: DataFrame, added: DataFrame) -> DataFrame:
    """paper_id, summary, failed: how many sections a proposal changes and what it adds."""
    d, a = diffs.groupBy("paper_id").agg(F.count("*").alias("d")), added.groupBy("paper_id").agg(F.count("*").alias("a"))
    rows = d.join(a, "paper_id", "full").na.fill(0, ["d", "a"])
    return rows.select("paper_id", F.concat("d", F.lit(" section(s) changed, "), "a", F.lit(" new reference(s).")).alias("summary"), (F.col("d") == 0).alias("failed"))


def undo_candidates(proposals: DataFrame) -> DataFrame:
    """The last applied proposal of each paper, which the page offers to undo."""
    return proposals.where("status = 'applied'").groupBy("paper_id").agg(F.max_by("proposal_id", "seq").alias("proposal_id"))


def proposal_summary(proposals: DataFrame, diffs: DataFrame, new_refs: DataFrame) -> DataFrame:
    """Counts of diffs and new references; a proposal with neither has failed."""
    d = diffs.groupBy("proposal_id").agg(F.count("*").alias("n_diffs"))
    n = new_refs.groupBy("proposal_id").agg(F.count("*").alias("n_refs"))
    rows = proposals.join(d, "proposal_id", "left").join(n, "proposal_id", "left").na.fill(0, ["n_diffs", "n_refs"])
    return rows.withColumn("status", F.when((F.col("n_diffs") == 0) & (F.col("n_refs") == 0), "failed").otherwise(F.col("status")))
