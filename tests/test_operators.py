"""Operators on small tables, by behaviour."""

import random
import re

from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import edit, entries, export, layout, link, qa, resolve, review

LINE = "paper_id long, line_no int, text string, size double, bold boolean, x0 double, y0 double, page int, page_width double, page_height double"


def lines(spark, rows):
    """rows of (text, size, bold, x0)."""
    full = [(1, i, t, s, b, x, 100.0 + i * 12, 0, 612.0, 792.0) for i, (t, s, b, x) in enumerate(rows)]
    return spark.createDataFrame(full, LINE)


def plain(spark, texts):
    return lines(spark, [(t, 10.0, False, 72.0) for t in texts])


def test_sections_and_title(spark):
    df = lines(spark, [
        ("A Long Study", 17.0, True, 72.0), ("of Parts", 17.0, True, 72.0), ("Abstract", 12.0, True, 72.0), ("We look at multi-", 10.0, False, 72.0), ("ple parts.", 9.0, False, 72.0),
        ("2", 12.0, True, 72.0), ("Model", 12.0, True, 90.0), ("Body text here.", 10.0, False, 72.0), ("footnote", 7.0, False, 72.0), ("2.1 Details", 12.0, True, 72.0), ("2. a list item that ends so.", 10.0, True, 72.0),
    ])
    df = df.withColumn("y0", F.when(F.col("line_no") == 6, F.lit(160.0)).otherwise(F.col("y0")))
    body = layout.body_size(df)
    assert body.first()["body"] == 10.0
    assert layout.title_of(df).first()["title"] == "A Long Study of Parts"
    merged = layout.merge_split_headings(df.join(body, "paper_id")).select(*df.columns)
    got = {r["section_id"]: (r["title"], r["level"], r["text"]) for r in layout.sections(merged, body).collect()}
    assert got == {"abstract": ("Abstract", 1, "We look at multiple parts."), "sec1": ("2 Model", 1, "Body text here."), "sec2": ("2.1 Details", 2, "2. a list item that ends so.")}


def test_reference_lines_stop(spark):
    df = plain(spark, ["References", "[1] A. Bee. A title.", "PE LS 1 hop", "[2] C. Dee. Some title.", "a b c d", "e f g h", "[3] lost"])
    df = df.withColumn("bold", F.col("line_no") == 0)
    got = [r["line_no"] for r in layout.reference_lines(df, layout.body_size(df)).orderBy("line_no").collect()]
    assert got == [1, 3]


def test_longest_run_is_one_short_when_broken(spark):
    hit, miss = "[1] A. Bee", "plain"
    texts = [miss] * 40 + [hit] * 7 + [miss] * 4 + [hit] * 2 + [miss] * 7
    got = layout.longest_citation_run(plain(spark, texts)).first()
    assert (got["start"], got["length"]) == (0, 6)
    open_end = layout.longest_citation_run(plain(spark, [miss] * 20 + [hit] * 5 + [miss] * 3)).first()
    assert open_end["length"] == 8


def test_entries_by_indent_and_remainder(spark):
    rows = [("Bee, A. Title one", 10.0, False, 72.0), ("goes on", 10.0, False, 84.0), ("Cee, B. Title two", 10.0, False, 72.0), ("goes on", 10.0, False, 84.0), ("Dee, C. Title", 10.0, False, 72.0)]
    got = layout.author_year_entries(lines(spark, rows)).orderBy("k").collect()
    assert [r["entry"] for r in got] == ["Bee, A. Title one goes on", "Cee, B. Title two goes on", "Dee, C. Title"]
    assert {r["scheme"] for r in got} == {"author-year-indent"}
    flat = layout.author_year_entries(plain(spark, ["all lower"] * 6)).collect()
    assert len(flat) == 1 and flat[0]["remainder"] and flat[0]["entry"].count("all lower") == 6


def test_dot_numbers_and_block(spark):
    df = plain(spark, ["1. First entry", "goes on", "2. Second entry Figure 3 junk"])
    assert [r["entry"] for r in layout.split_on_line_start(df).orderBy("k").collect()] == ["1. First entry goes on", "2. Second entry Figure 3 junk"]
    blob = spark.createDataFrame([(1, "[1] Bee one. [2] Cee two. Table 4 leaked")], "paper_id long, blob string")
    assert [(r["num"], r["entry"]) for r in layout.split_block(blob).orderBy("k").collect()] == [(1, "[1] Bee one."), (2, "[2] Cee two.")]


def test_parse_failed_and_partial(spark):
    rows = spark.createDataFrame([(1, "[1] ???"), (2, "Smith, J. Only names here"), (3, ""), (4, None), (5, "Z. Ghahramani. A clockwork thing for all. In ICML, 2014.")], "k long, raw string")
    got = {r["k"]: r for r in entries.parse_entries(rows).collect()}
    assert got[1]["parse_status"] == got[3]["parse_status"] == got[4]["parse_status"] == "failed"
    assert got[2]["parse_status"] == "partial"
    assert (got[5]["title"], got[5]["year"], got[5]["container_title"], got[5]["type"]) == ("A clockwork thing for all", 2014, "ICML", "paper-conference")


def test_title_may_end_in_a_number_that_ends_like_a_year(spark):
    rows = spark.createDataFrame([
        (1, "[1] Ann Lee. 1995. Small ring Brand#3 Supplier#000001997. In Parts Workshop, pages 1-9."),
        (2, "[2] Lee, A. (1995). Small ring Brand#3 Supplier#000002001. Journal of Parts, 12(3):45-67."),
        (3, '[3] A. Lee, "Small ring Brand#3 Supplier#000061999," In Proceedings of the Parts Conference, 1995.'),
        (4, "[4] Ann Lee. Small ring Brand#3 Supplier#000002100. CoRR abs/9701.00004, 1995."),
        (5, '[5] A. Lee, "A clockwork thing for all, 2014," In Proceedings of the Parts Conference, 1995.'),
    ], "k long, raw string")
    got = {r["k"]: (r["title"], r["year"]) for r in entries.parse_entries(rows).collect()}
    ends = {1: "000001997", 2: "000002001", 3: "000061999", 4: "000002100"}
    assert got == {k: (f"Small ring Brand#3 Supplier#{x}", 1995) for k, x in ends.items()} | {5: ("A clockwork thing for all", 1995)}


def _numbered_title(spark):
    return spark.createDataFrame([(1, 1, "ref1", "[1] Ann Lee. 1995. Small ring Supplier#000001997. In Parts Workshop, pages 1-9.")], "paper_id long, pos int, ref_id string, raw string")


def test_bibliography_keeps_a_number_that_ends_like_a_year(spark):
    row = entries.parse_entries(_numbered_title(spark)).select(export.entry_text(F.lit("ieee")).alias("ieee"), export.entry_text(F.lit("apa")).alias("apa")).first()
    assert row["ieee"] == "A. Lee, “Small ring Supplier#000001997,” in Parts Workshop, 1995."
    assert row["apa"] == "Lee, A. (1995). Small ring Supplier#000001997. Parts Workshop."


def test_bibtex_keeps_a_number_that_ends_like_a_year(spark):
    assert "  title = {Small ring Supplier#000001997}," in export.bibtex(entries.parse_entries(_numbered_title(spark))).first()["bibtex"]


def test_prompt_lines_keep_a_number_that_ends_like_a_year(spark):
    assert qa.reference_lines(entries.parse_entries(_numbered_title(spark))).first()["line"] == "ref1: Small ring Supplier#000001997 (Lee, 1995)"


REFS = "paper_id long, pos int, ref_id string, yr int, names array<string>, raw string"


def test_author_year_ambiguity(spark):
    refs = spark.createDataFrame([(1, 1, "ref1", 2019, ["kim"], "Kim 2019a"), (1, 2, "ref2", 2019, ["kim"], "Kim 2019b"), (1, 3, "ref3", 2020, ["gülçehre"], "Gülçehre (2020)"), (1, 4, "ref4", 2020, ["lee"], "Lee")], REFS)
    sections = spark.createDataFrame([(1, 1, "As Kim et al. (2019) say (Kim, 2019a; Lee, 2020, p. 3). Gülçehre and Cho (2020) and Appendix (2017). [1, 9] [2-4]")], "paper_id long, section_id long, text string")
    text, cits = link.tokenize(sections, refs)
    assert text.first()["text"] == "As Kim et al. (2019) say [[cite:ref1,ref4]]. [[cite:ref3]] and Appendix (2017). [1, 9] [[cite:ref2,ref3,ref4]]"
    got = {r["raw"]: (r["cit_id"], r["resolved"]) for r in cits.collect()}
    assert got == {"[1, 9]": ("cit1", False), "[2-4]": ("cit2", True), "(Kim, 2019a; Lee, 2020, p. 3)": ("cit3", True), "Gülçehre and Cho (2020)": ("cit4", True)}


def test_integrity_is_a_multiset_order(spark):
    rows = [(1, "[[cite:ref1]] [[cite:ref1]]", "[[cite:ref1]]"), (2, "[[cite:ref1,ref2]]", "[[cite:ref2]] x [[cite:ref1]]"), (3, "[[cite:ref3]]", "none")]
    df = spark.createDataFrame(rows, "k long, old_text string, new_text string")
    got = {(r["k"], r["ref_id"], r["before"], r["after"]) for r in edit.integrity(df, ["k"]).collect()}
    assert got == {(1, "ref1", 2, 1), (3, "ref3", 1, 0)}
    allowed = spark.createDataFrame([(3, "ref3")], "k long, ref_id string")
    assert [r["allowed"] for r in edit.integrity(df, ["k"], allowed).where("k = 3").collect()] == [True]


def test_rewrite_attempts(spark):
    rows = [(1, 1, "[[cite:ref1]] a", "gone"), (1, 2, "[[cite:ref1]] a", "kept [[cite:ref1]]"), (2, 1, "a", "new [[cite:ref9]]"), (2, 2, "a", "  "), (3, 1, "a", "b"), (3, 2, "a", "c"), (4, 3, "a", "late")]
    df = spark.createDataFrame(rows, "k long, attempt int, old_text string, new_text string")
    assert {(r["k"], r["new_text"]) for r in edit.accepted_rewrites(df, ["k"]).collect()} == {(1, "kept [[cite:ref1]]"), (3, "b")}


def test_placements(spark):
    sections = spark.createDataFrame([(1, 1, "One is. Two is! Three")], "paper_id long, section_id long, text string")
    picks = spark.createDataFrame([(1, 1, 1, 0, 5), (1, 1, 2, 2, 7), (1, 1, 3, 9, 7), (1, 1, 4, 1, 5), (1, 1, 5, 0, 8)], "paper_id long, section_id long, pick_no int, sentence_index int, candidate_index int")
    counts = spark.createDataFrame([(1, 10)], "paper_id long, n_refs int")
    diffs, refs = edit.place_citations(sections, picks, counts)
    assert diffs.first()["new_text"] == "One is [[cite:ref12]]. Two is [[cite:ref12]]! Three [[cite:ref11]]"
    assert {(r["ref_id"], r["candidate_index"]) for r in refs.collect()} == {("ref11", 7), ("ref12", 5)}


def test_undo_drops_only_added(spark):
    sections = spark.createDataFrame([(1, 1, "new [[cite:ref9]]"), (1, 2, "other")], "paper_id long, section_id long, text string")
    diffs = spark.createDataFrame([(1, 1, "old", "new [[cite:ref9]]"), (1, 2, "was", "not this")], "paper_id long, section_id long, old_text string, new_text string")
    added = spark.createDataFrame([(1, "ref9")], "paper_id long, ref_id string")
    after, refused, still = edit.undo(sections, diffs, added)
    assert {(r["section_id"], r["text"]) for r in after.collect()} == {(1, "old"), (2, "other")}
    assert [(r["section_id"], r["reason"]) for r in refused.collect()] == [(2, "text has changed")]
    assert still.count() == 0
    assert edit.undo(sections, diffs.where("section_id = 1"), added.limit(0))[1].first()["reason"] == "drops citations"


def test_candidates_block_without_loss(spark):
    import random

    rng = random.Random(1)
    titles = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]) for _ in range(rng.randint(1, 7))) for _ in range(60)]
    df = spark.createDataFrame([(0, str(i), t) for i, t in enumerate(titles)], "all int, id string, title string")
    refs, works = df.select("all", F.col("id").alias("ref_key"), "title"), df.select("all", F.col("id").alias("work_id"), "title")
    got = {(r["ref_key"], r["work_id"]) for r in resolve.title_candidates(refs, works, ["all", "ref_key"], ["all"]).collect()}
    both = df.alias("a").crossJoin(df.alias("b")).where(T.title_similarity(F.col("a.title"), F.col("b.title")) >= T.MATCH)
    want = {(r[0], r[1]) for r in both.select("a.id", "b.id").collect()}
    assert want <= got


def test_normalisers_and_keys(spark):
    rows = spark.createDataFrame([("W1", "https://doi.org/10.1/X", "T", 2000, ["Ann van Bee", "Solo"], {"world": [1], "hello": [0, 2]}, "V", 3)], "id string, doi string, title string, year int, names array<string>, inverted map<string,array<int>>, venue string, cited_by long")
    r = resolve.normalise_openalex(rows).first()
    assert (r["abstract"], r["doi"], r["url"]) == ("hello world hello", "10.1/X", "https://doi.org/10.1/X")
    assert [(a["family"], a["given"]) for a in r["authors"]] == [("Bee", "Ann van"), ("Solo", "")]
    s2 = spark.createDataFrame([("p1", "https://x/search?q", None, "T", 1, ["A B"], None, None, None)], "paper_id string, url string, doi string, title string, year int, names array<string>, abstract string, venue string, cited_by long")
    assert resolve.normalise_semantic_scholar(s2).first()["url"].endswith("/paper/p1")
    key = spark.range(1).select(resolve.cache_key(F.lit("s"), F.lit("e"), F.lit("p")).alias("k"), resolve.work_keys(F.lit("10.1/Ab"), F.lit("A b!")).alias("w")).first()
    assert len(key["k"]) == 32 and key["w"] == ["10.1/ab", "ab"]


def test_review_caps(spark):
    cits = spark.createDataFrame([(1, 1, i, ["ref1", "ref2", "ref3"], True) for i in range(1, 12)], "paper_id long, section_id long, cit_no int, ref_ids array<string>, resolved boolean")
    sections = spark.createDataFrame([(1, 1, "This is a sentence of more than forty characters [[cite:ref1]].")], "paper_id long, section_id long, text string")
    refs = spark.createDataFrame([(1, f"ref{i}", "" if i == 2 else "text") for i in range(1, 4)], "paper_id long, ref_id string, abstract string")
    verdicts = spark.createDataFrame([(1, i, "ref1", "does_not_support") for i in range(1, 12)], "paper_id long, cit_no int, ref_id string, verdict string")
    got = review.citation_checks(cits, sections, refs, verdicts)
    assert got.count() == 16
    assert {r["kind"] for r in got.collect()} == {"mismatch", "unverifiable"}


def test_uncited_and_missing(spark):
    body = "A claim that is surely longer than forty characters in all. " * 6
    sections = spark.createDataFrame([(1, 1, 1, "2 Model", body), (1, 2, 2, "References", body)], "paper_id long, section_id long, sec_no int, title string, text string")
    claims = spark.createDataFrame([(1, 1, 1, "A claim  that is surely longer than forty characters in all."), (1, 1, 2, "not there, though it is long enough to be counted"), (1, 2, 1, "A claim that is surely longer than forty characters in all.")], "paper_id long, section_id long, claim_no int, sentence string")
    assert [r["section_id"] for r in review.uncited_claims(sections, claims).collect()] == ["1"]
    queries = spark.createDataFrame([(1, 1, 0, "q"), (1, 2, 0, "q")], "paper_id long, section_id long, query_no int, query string")
    hits = spark.createDataFrame([(1, 1, k, f"Hit {k}", "u") for k in range(1, 9)], "paper_id long, section_id long, rank int, title string, url string")
    picks = spark.createDataFrame([(1, 1, 1, 0, None, "why"), (1, 1, 2, 7, "high", "no"), (1, 1, 3, 1, "low", "late")], "paper_id long, section_id long, pick_no int, index int, confidence string, rationale string")
    got = review.missing_work(sections, queries, hits, picks).collect()
    assert [(r["claim"], r["confidence"]) for r in got] == [("Hit 1", "medium")]
    none = review.missing_work(sections, queries, hits.limit(0), picks).collect()
    assert [r["kind"] for r in none] == ["info"]
    assert review.all_findings(review.uncited_claims(sections, claims), review.missing_work(sections, queries, hits, picks)).count() == 2


def test_export(spark):
    rows = spark.createDataFrame([(1, "[1] A. Bee, \"Fine & good,\" In Proceedings of the X Conf, 1999."), (2, "[2] ??")], "pos int, raw string").withColumn("paper_id", F.lit(1)).withColumn("ref_id", F.concat(F.lit("ref"), "pos"))
    parsed = entries.parse_entries(rows)
    got = {r["pos"]: r["bibtex"] for r in export.bibtex(parsed).collect()}
    assert got[1].startswith("@inproceedings{ref1,\n  title = {Fine \\& good},\n  author = {Bee, A},") and "Unparsed" in got[2]
    items = export.latex_items(parsed.withColumn("entry", export.entry_text(F.lit("ieee"))))
    sections = spark.createDataFrame([(1, 1, "1 Intro", 1, "See [[cite:ref1]].")], "paper_id int, sec_no int, title string, level int, text string")
    papers = spark.createDataFrame([(1, "A_B")], "paper_id int, title string")
    text = export.documents(papers, sections, items).first()["latex"]
    assert "\\title{A\\_B}" in text and "\\section{Intro}" in text and "See~\\cite{ref1}." in text and "WARNING" in text


def test_answers(spark):
    index = spark.createDataFrame([(1, "sec1#0", "sec1", "A sentence of evidence.")], "paper_id long, sid string, section_id string, sentence string")
    given = spark.createDataFrame(
        [(1, 1, "q", "An answer", True, ["(sec1#0)"], []), (1, 2, "q", "?", True, [], []), (1, 3, "q", "not answered", False, ["x"], []), (1, 4, "q", "An answer of some length", True, ["sec1#0", "sec1#0"], ["ref1"])],
        "paper_id long, answer_id long, question string, answer string, answered boolean, evidence array<string>, cited_refs array<string>",
    )
    refs = spark.createDataFrame([(1, "ref1", 1, "t")], "paper_id long, ref_id string, pos int, title string")
    got = {r["answer_id"]: r for r in qa.answers(index, given, refs).collect()}
    assert (got[1]["warning"], got[1]["n_sources"]) == ("", 1)
    assert got[2]["warning"] == qa.NO_SOURCE and got[3]["answer"] == qa.REFUSAL and got[4]["warning"] == qa.BAD_IDS


def test_stream_of_decisions(spark, tmp_path):
    from marginalia.streaming.decisions import decide_stream

    spark.createDataFrame([(1, 1, "approve"), (1, 2, "approve"), (1, 3, "undo"), (2, 1, "reject")], "proposal_id long, seq long, decision string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("proposal_id long, seq long, decision string").parquet(str(tmp_path / "in"))
    run = decide_stream(stream).writeStream.format("memory").queryName("decided").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = {(r["proposal_id"], r["decision"], r["status"], r["conflict"]) for r in spark.table("decided").collect()}
    assert got == {(1, "approve", "applied", False), (1, "approve", "applied", True), (1, "undo", "undone", False), (2, "reject", "rejected", False)}


def test_whole_table_exports(spark, tmp_path):
    """A paper with an entry of each format: all are exported, and every section comes out."""
    from marginalia.plans import queries as Q

    tables = {
        "lineitem": ([(1, 1, 7, i, 1.0, f"199{i}-05-01") for i in range(1, 5)], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_shipdate string"),
        "orders": ([(1, 3)], "o_orderkey long, o_custkey long"),
        "part": ([(7, "hot gear", "STANDARD", "Brand#1")], "p_partkey long, p_name string, p_type string, p_brand string"),
        "supplier": ([(i, f"Supplier#{i}", i) for i in range(1, 5)], "s_suppkey long, s_name string, s_nationkey int"),
        "nation": ([(1, "PERU"), (2, "CHINA"), (3, "KENYA"), (4, "FRANCE")], "n_nationkey int, n_name string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    title = [f"Hot gear standard Brand#1 Supplier#{i}" for i in range(1, 5)]
    bib = {r["pos"]: r["bibtex"] for r in Q.QUERIES["bibtex_entries"](spark, str(tmp_path)).collect()}
    assert bib == {
        1: f"@inproceedings{{ref1,\n  title = {{{title[0]}}},\n  author = {{Peru, A}},\n  year = {{1991}},\n  booktitle = {{Parts Conference}},\n}}",
        2: f"@inproceedings{{ref2,\n  title = {{{title[1]}}},\n  author = {{China, Ann}},\n  year = {{1992}},\n  booktitle = {{Parts Workshop}},\n  doi = {{10.5555/7/2}},\n  url = {{https://doi.org/10.5555/7/2}},\n}}",
        3: f"@misc{{ref3,\n  title = {{{title[2]}}},\n  author = {{Kenya, Ann}},\n  year = {{1993}},\n  url = {{https://arxiv.org/abs/9701.00003}},\n  eprint = {{9701.00003}},\n  eprinttype = {{arxiv}},\n}}",
        4: f"@article{{ref4,\n  title = {{{title[3]}}},\n  author = {{France}},\n  year = {{1994}},\n  journal = {{Journal of Parts}},\n}}",
    }
    listed = {r["pos"]: (r["ieee"], r["apa"], r["ieee_entry"], r["apa_entry"]) for r in Q.QUERIES["bibliography"](spark, str(tmp_path)).collect()}
    assert sorted(listed) == [1, 2, 3, 4]
    assert listed[3] == ("[3]", "(Kenya, 1993)", f"A. Kenya, “{title[2]},” 1993. https://arxiv.org/abs/9701.00003", f"Kenya, A. (1993). {title[2]}. https://arxiv.org/abs/9701.00003")
    assert listed[4] == ("[4]", "(France, 1994)", f"France, “{title[3]},” Journal of Parts, vol. 12, no. 3, pp. 45-67, 1994.", f"France (1994). {title[3]}. Journal of Parts, 12(3), 45-67.")
    ids = [r["section_id"] for r in Q.QUERIES["sections"](spark, str(tmp_path)).collect()]
    assert set(ids) > {"abstract", "sec1", "sec2"}


def test_similar_titles_equal_all_pairs(spark):
    """Few tokens in many titles, some contained in others, of one token or of none."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(12)]
    titles = sorted({" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 13))) for _ in range(300)} | {"", "a b", "w1 W1", "w1", "w2 w1 w3!", "w1 w2 w3", "w1 w2 w3 x y z w9"})
    rows = spark.createDataFrame([(t,) for t in titles], "title string")
    got = [tuple(r) for r in resolve.similar_titles(rows).collect()]
    each = [(a, set(re.findall("[a-z0-9]{2,}", a.lower()))) for a in titles]
    want = {(a, b) for a, x in each for b, y in each if a != b and x and y and (4 * len(x & y) >= 3 * max(len(x), len(y)) or len(x & y) == min(len(x), len(y)) >= 3)}
    assert len(got) == len(set(got)) and set(got) == want


def test_similar_titles_of_a_small_vocabulary(spark):
    """Thousands of titles that all share tokens with most others."""
    titles = [f"type{t} Brand#{b} adj{a} noun{n}" for t in range(6) for b in range(10, 20) for a in range(8) for n in range(8)]
    out = resolve.similar_titles(spark.createDataFrame([(t,) for t in titles], "title string"))
    assert out.count() == len(titles) * (5 + 9 + 7 + 7)
