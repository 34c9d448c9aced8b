"""Registered queries over the derived corpus, each with the same result in SQL.

Every query runs over its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marginalia.functions import text as T
from marginalia.operators import edit, entries, export, layout, link, papers, qa, resolve, review
from marginalia.sources import corpus
from marginalia.sources.corpus import ENTRIES_SQL, LINES_SQL, REFS_SQL, WORKS_SQL, references, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _ids(refs: DataFrame) -> DataFrame:
    return refs.withColumn("ref_id", F.concat(F.lit("ref"), "pos"))


def _linkable(refs: DataFrame) -> DataFrame:
    """References as the author-year join wants them: names, raw text and year."""
    names = T.author_tokens(F.col("fam"), F.lit(""), F.lit(""))
    return _ids(refs).select("paper_id", "pos", "ref_id", "yr", names.alias("names"), F.concat_ws(" ", "fam", "title").alias("raw"))


# --- text ---------------------------------------------------------------------------


@query(r"""SELECT doc_id, count(*) AS n_sentences, CAST(max(length(s)) AS BIGINT) AS longest FROM (
  SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])[ \t\n\r\f\v]+', '\1' || chr(1), 'g'), chr(1))) AS s FROM documents WHERE text IS NOT NULL)
  GROUP BY doc_id""")
def sentences(spark, sf_dir):
    rows = _documents(spark, sf_dir).where("text is not null").select("doc_id", F.explode(T.split_sentences(F.col("text"))).alias("s"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.max(F.char_length("s")).cast("bigint").alias("longest"))


@query(r"""WITH s AS (SELECT doc_id, unnest(range(len(p))) AS sent_no, unnest(p) AS s FROM (
    SELECT doc_id, string_split(regexp_replace(substr(text, 1, 2600), '([.!?])[ \t\n\r\f\v]+', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents WHERE text IS NOT NULL)),
  n AS (SELECT doc_id, sent_no, regexp_replace(trim(regexp_replace(s, '[ \t\n\r\f\v]+', ' ', 'g')), '[ ]+([.,;:!?])', '\1', 'g') AS sentence FROM s)
  SELECT doc_id, 'body#' || sent_no AS sid, sentence FROM n WHERE length(sentence) >= 20""")
def sentence_index(spark, sf_dir):
    docs = _documents(spark, sf_dir).where("text is not null")
    index = qa.sentence_index(docs.select(F.col("doc_id").alias("paper_id"), F.lit("body").alias("section_id"), F.lit("Body").alias("title"), "text"))
    return index.select(F.col("paper_id").alias("doc_id"), "sid", "sentence")


@query(r"""SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(list_sort(t), ' ') AS tokens FROM (
  SELECT doc_id, list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]{2,}'), lambda x: lower(x))) AS t FROM documents)""")
def title_tokens(spark, sf_dir):
    t = T.title_tokens(F.col("text"))
    return _documents(spark, sf_dir).select("doc_id", F.size(t).cast("bigint").alias("n_tokens"), F.array_join(F.array_sort(t), " ").alias("tokens"))


@query(r"""SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]', '', 'g') AS norm FROM documents""")
def norm_title(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.norm_title(F.coalesce("text", F.lit(""))).alias("norm"))


@query(r"""SELECT doc_id, array_to_string(list_transform(string_split(coalesce(text, ''), ''), lambda c: CASE c WHEN '\' THEN '\textbackslash{}' WHEN '&' THEN '\&' WHEN '%' THEN '\%'
    WHEN '$' THEN '\$' WHEN '#' THEN '\#' WHEN '_' THEN '\_' WHEN '{' THEN '\{' WHEN '}' THEN '\}' WHEN '~' THEN '\textasciitilde{}' WHEN '^' THEN '\textasciicircum{}' ELSE c END), '') AS latex FROM documents""")
def latex_escape(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", T.latex_escape(F.coalesce("text", F.lit(""))).alias("latex"))


# --- entries and links ---------------------------------------------------------------


@query(f"""WITH {REFS_SQL} SELECT paper_id, pos, upper(substr(title, 1, 1)) || substr(title, 2) AS title, yr AS year,
  upper(substr(fam, 1, 1)) || substr(replace(fam, ' ', ''), 2) AS family, 'parsed' AS parse_status,
  CASE pos % 4 WHEN 0 THEN 'Journal of Parts' WHEN 1 THEN 'Parts Conference' WHEN 2 THEN 'Parts Workshop' END AS venue,
  CASE WHEN pos % 4 = 2 THEN '10.5555/' || doi END AS doi FROM refs""")
def parse_entries(spark, sf_dir):
    parsed = entries.parse_entries(corpus.entries(references(spark, sf_dir)).select("paper_id", "pos", "raw"))
    return parsed.select("paper_id", "pos", "title", "year", F.col("authors")[0]["family"].alias("family"), "parse_status", F.col("container_title").alias("venue"), "doi")


@query(f"""WITH {REFS_SQL}, s AS (SELECT paper_id, section_id, min(pos) AS lo, max(pos) AS hi FROM refs GROUP BY ALL),
  m AS (SELECT paper_id, section_id, 0 AS pos, list_value(lo, hi) AS nums FROM s UNION ALL
        SELECT paper_id, section_id, 1, CASE WHEN hi - lo < 50 THEN range(lo, hi + 1) ELSE [] END FROM s)
  SELECT paper_id, section_id, CAST(pos AS INTEGER) AS pos, array_to_string(list_transform(nums, lambda n: 'ref' || n), ',') AS ref_ids, len(nums) > 0 AS resolved FROM m
  UNION ALL SELECT paper_id, section_id, 2, '', false FROM s""")
def numeric_links(spark, sf_dir):
    refs = references(spark, sf_dir)
    sections = corpus.numbered_sections(refs)
    found = F.regexp_extract_all("text", F.lit(T.NUMERIC_MARKER), F.lit(0))
    markers = sections.select("paper_id", "section_id", F.posexplode(found).alias("pos", "raw"))
    out = link.numeric_links(markers, refs.groupBy("paper_id").agg(F.count("*").alias("n_refs")))
    return out.select("paper_id", "section_id", "pos", F.array_join("ref_ids", ",").alias("ref_ids"), "resolved")


@query(f"""WITH {REFS_SQL}, s AS (SELECT paper_id, section_id, min(pos) AS lo, max(pos) AS hi FROM refs GROUP BY ALL)
  SELECT paper_id, section_id, 'Prior work [[cite:ref' || lo || ',ref' || hi || ']] is broad. Series ' ||
    CASE WHEN hi - lo < 50 THEN '[[cite:' || array_to_string(list_transform(range(lo, hi + 1), lambda n: 'ref' || n), ',') || ']]' ELSE '[' || lo || '-' || hi || ']' END ||
    ' extends it! An orphan [999] stays. Section ' || section_id || ' ends here without any marker at all.' AS text FROM s""")
def tokenized_sections(spark, sf_dir):
    refs = references(spark, sf_dir)
    text, _ = link.tokenize(corpus.numbered_sections(refs).select("paper_id", "section_id", "text"), _linkable(refs))
    return text.select("paper_id", "section_id", "text")


@query(f"""WITH {REFS_SQL} SELECT paper_id, fam, yr, CASE WHEN count(*) = 1 THEN 'ref' || min(pos) END AS ref_id, count(*) AS candidates FROM refs GROUP BY paper_id, fam, yr""")
def author_year_links(spark, sf_dir):
    refs = references(spark, sf_dir)
    asked = refs.select("paper_id", F.col("fam").alias("surname"), F.col("yr").cast("string").alias("year")).distinct()
    # The catalog entry without its title: names decide, as in the SQL.
    known = _linkable(refs).withColumn("raw", F.lit(""))
    hit = link.author_year_match(asked, known, ["paper_id", "surname", "year"])
    return hit.select("paper_id", F.col("surname").alias("fam"), F.col("year").cast("int").alias("yr"), "ref_id", "candidates")


@query(f"""WITH {REFS_SQL}, k AS (SELECT paper_id, fam, yr, count(*) AS n, min(pos) AS p FROM refs GROUP BY ALL), t AS (
    SELECT paper_id, section_id, pos, upper(substr(fam, 1, 1)) || substr(fam, 2) AS name, k.n, k.p, yr FROM refs JOIN k USING (paper_id, fam, yr))
  SELECT paper_id, pos, 'As ' || CASE WHEN n = 1 THEN '[[cite:ref' || p || ']]' ELSE name || ' et al. (' || yr || ')' END || ' show, and ' ||
    CASE WHEN n = 1 THEN '[[cite:ref' || p || ']]' ELSE '(' || name || ', ' || yr || ')' END || ' too.' AS text FROM t""")
def author_year_text(spark, sf_dir):
    refs = references(spark, sf_dir)
    name, yr = F.concat(F.upper(F.substring("fam", 1, 1)), F.substring("fam", 2, 100)), F.col("yr").cast("string")
    text = F.concat(F.lit("As "), name, F.lit(" et al. ("), yr, F.lit(") show, and ("), name, F.lit(", "), yr, F.lit(") too."))
    sections = refs.select("paper_id", F.col("pos").cast("bigint").alias("section_id"), text.alias("text"))
    known = _linkable(refs).withColumn("raw", F.lit(""))
    out, _ = link.tokenize(sections, known)
    return out.select("paper_id", F.col("section_id").cast("int").alias("pos"), "text")


@query(f"""WITH {REFS_SQL}, c AS (SELECT paper_id, section_id, pos, CASE WHEN pos % 7 = 0 THEN '(A, ' || yr || ')' ELSE '[' || pos || ']' END AS raw FROM refs)
  SELECT paper_id, CASE WHEN count(*) FILTER (raw LIKE '[%') * 2 >= count(*) THEN 'ieee' ELSE 'apa' END AS style, count(*) > 0 AS detected FROM c GROUP BY paper_id""")
def detected_style(spark, sf_dir):
    return link.detect_style(_markers(references(spark, sf_dir)))


def _markers(refs: DataFrame) -> DataFrame:
    raw = F.when(F.col("pos") % 7 == 0, F.concat(F.lit("(A, "), F.col("yr"), F.lit(")"))).otherwise(F.concat(F.lit("["), "pos", F.lit("]")))
    return refs.select("paper_id", "section_id", F.lit(1).alias("pass"), "pos", raw.alias("raw"))


@query(f"""WITH {REFS_SQL}, c AS (SELECT paper_id, section_id, pos, pos % 7 <> 0 AS num, CASE WHEN pos % 7 = 0 THEN '(A, ' || yr || ')' ELSE '[' || pos || ']' END AS raw FROM refs),
  g AS (SELECT paper_id, count(*) AS n, count(*) FILTER (num) AS nn FROM c GROUP BY paper_id),
  h AS (SELECT *, least(nn, n - nn) AS minor, nn < n - nn AS mnum FROM g WHERE n >= 5 AND least(nn, n - nn) > 0 AND least(nn, n - nn) * 5 <= n),
  f AS (SELECT c.*, h.n, h.minor, h.mnum, row_number() OVER (PARTITION BY paper_id ORDER BY section_id, pos) AS k FROM c JOIN h USING (paper_id) WHERE num = mnum)
  SELECT paper_id, 'Mixed citation styles: ' || (n - minor) || CASE WHEN mnum THEN ' author-year' ELSE ' numeric' END || ' marker(s) but ' || minor || ' stray ' || CASE WHEN mnum THEN 'numeric' ELSE 'author-year' END ||
    ' marker(s) (e.g. ' || string_agg(raw, ', ' ORDER BY k) || '). Consider normalizing them.' AS message FROM f WHERE k <= 3 GROUP BY paper_id, n, minor, mnum""")
def style_lint(spark, sf_dir):
    return link.style_lint(_markers(references(spark, sf_dir)))


@query(f"""WITH {REFS_SQL} SELECT fam AS family, paper_id, count(*) AS n, any_value(total) AS total FROM (SELECT *, count(*) OVER (PARTITION BY paper_id) AS total FROM refs)
  GROUP BY paper_id, fam HAVING count(*) >= 4 AND count(*) * 10 >= any_value(total)""")
def concentration(spark, sf_dir):
    return review.concentration(references(spark, sf_dir)).select("paper_id", F.col("fam").alias("family"), "n", "total")


def _citations(refs: DataFrame) -> DataFrame:
    """One resolved marker per section that cites all its references."""
    own = refs.groupBy("paper_id", "section_id").agg(F.array_sort(F.collect_list("pos")).alias("p"))
    ids = F.transform("p", lambda n: F.concat(F.lit("ref"), n))
    cits = own.select("paper_id", "section_id", ids.alias("ref_ids"), F.lit(True).alias("resolved"))
    return cits.withColumn("cit_no", F.row_number().over(Window.partitionBy("paper_id").orderBy("section_id")))


@query(f"""WITH {REFS_SQL}, s AS (SELECT paper_id, section_id, count(*) AS n FROM refs GROUP BY ALL HAVING count(*) >= 4)
  SELECT paper_id, section_id, n, k FROM (SELECT *, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY n DESC, section_id) AS INTEGER) AS k FROM s) WHERE k <= 4""")
def bundles(spark, sf_dir):
    return review.bundles(_citations(references(spark, sf_dir))).select("paper_id", "section_id", F.col("n").cast("bigint").alias("n"), "k")


@query(f"""WITH {REFS_SQL}, s AS (SELECT paper_id, section_id, count(*) AS n FROM refs GROUP BY ALL HAVING count(*) >= 4),
  b AS (SELECT paper_id, k AS pos, 'redundant_citation' AS kind, n || ' works are cited together for one claim' AS rationale FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY n DESC, section_id) AS k FROM s) WHERE k <= 4),
  c AS (SELECT paper_id, 100 + min(pos) AS pos, 'info' AS kind, 'Citation diversity: ' || count(*) || ' of ' || any_value(total) || ' references share the first author ''' || upper(substr(fam, 1, 1)) || substr(fam, 2) || '''' AS rationale
    FROM (SELECT *, count(*) OVER (PARTITION BY paper_id) AS total FROM refs) GROUP BY paper_id, fam HAVING count(*) >= 4 AND count(*) * 10 >= any_value(total))
  SELECT paper_id, CAST(pos AS BIGINT) AS pos, kind, rationale FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY pos) AS r FROM (SELECT * FROM b UNION ALL SELECT * FROM c)) WHERE r <= 12""")
def structural_checks(spark, sf_dir):
    refs = references(spark, sf_dir)
    sections = corpus.numbered_sections(refs).select("paper_id", "section_id", "text")
    return review.structural_checks(_citations(refs), refs, sections).select("paper_id", "pos", "kind", "rationale")


@query(f"""WITH {REFS_SQL}, s AS (SELECT paper_id, section_id, min(pos) AS lo, max(pos) AS hi FROM refs GROUP BY ALL),
  cited AS (SELECT paper_id, lo AS pos FROM s UNION SELECT paper_id, hi FROM s)
  SELECT paper_id, 'ref' || pos AS ref_id FROM refs ANTI JOIN cited USING (paper_id, pos)""")
def uncited_references(spark, sf_dir):
    """References that no marker of a text links to; each section cites its first and last one."""
    refs = references(spark, sf_dir)
    text = F.concat(F.lit("Prior work ["), "lo", F.lit(", "), "hi", F.lit("] is broad."))
    own = corpus.numbered_sections(refs).select("paper_id", "section_id", text.alias("text"))
    _, cits = link.tokenize(own, _linkable(refs))
    return link.uncited(_ids(refs), cits).select("paper_id", "ref_id")


@query(f"""WITH {REFS_SQL}, s AS (SELECT DISTINCT paper_id, section_id FROM refs), m AS (SELECT *, unnest([0, 1, 2]) AS pos FROM s)
  SELECT paper_id, section_id, pos, 'cit' || row_number() OVER (PARTITION BY paper_id ORDER BY section_id, pos) AS cit_id FROM m""")
def citation_ids(spark, sf_dir):
    """A list, a range and an orphan in every section; their ids run over the paper."""
    refs = references(spark, sf_dir)
    _, cits = link.tokenize(corpus.numbered_sections(refs).select("paper_id", "section_id", "text"), _linkable(refs))
    return cits.select("paper_id", "section_id", "pos", "cit_id")


# --- resolution ----------------------------------------------------------------------


def _pairs(refs: DataFrame) -> DataFrame:
    w = corpus.works(refs)
    near = w.select("paper_id", (F.col("pos") - 1).alias("pos"), (F.col("pos") + 0).alias("cand_pos"), "year", "title", "author").unionByName(
        w.select("paper_id", "pos", F.col("pos").alias("cand_pos"), "year", "title", "author")
    )
    cand = near.select("paper_id", "pos", "cand_pos", F.col("year").alias("cand_year"), F.col("title").alias("cand_title"), F.col("author").alias("cand_family"))
    return refs.select("paper_id", "pos", "title", "yr", F.concat_ws(" ", "fam", "title").alias("raw")).join(cand, ["paper_id", "pos"])


_MATCH_SQL = f"""WITH {REFS_SQL}, {WORKS_SQL}, cand AS (SELECT paper_id, pos, pos AS cp, year, title, author FROM works UNION ALL SELECT paper_id, pos - 1, pos, year, title, author FROM works),
  p AS (SELECT r.paper_id, r.pos, cp, year, author, yr, r.fam || ' ' || r.title AS raw,
      list_distinct(list_transform(regexp_extract_all(r.title, '[A-Za-z0-9]{{2,}}'), lambda x: lower(x))) AS a, list_distinct(list_transform(regexp_extract_all(c.title, '[A-Za-z0-9]{{2,}}'), lambda x: lower(x))) AS b
    FROM refs r JOIN cand c ON r.paper_id = c.paper_id AND r.pos = c.pos),
  q AS (SELECT *, len(list_intersect(a, b)) AS n, least(len(a), len(b)) AS lo, greatest(len(a), len(b)) AS hi FROM p),
  s AS (SELECT *, CASE WHEN lo = 0 THEN 0.0 WHEN n = lo AND lo >= 3 THEN 1.0 ELSE n / hi END AS score, abs(yr - year) <= 1 AS yok,
      CASE WHEN length(string_split(author, ' ')[-1]) > 2 THEN contains(lower(raw), lower(string_split(author, ' ')[-1])) END AS aok FROM q),
  t AS (SELECT *, CASE WHEN score < 0.75 THEN 'rejected' WHEN yok = false OR aok = false THEN 'low-confidence' WHEN yok OR aok THEN 'verified' WHEN score >= 0.9 THEN 'verified' ELSE 'low-confidence' END AS st FROM s)"""


@query(_MATCH_SQL + " SELECT st AS match_status, count(*) AS n FROM t GROUP BY st")
def match_classes(spark, sf_dir):
    rows = _pairs(references(spark, sf_dir))
    year_ok, author_ok = T.corroborate(F.col("yr"), F.col("cand_year"), F.col("raw"), F.col("cand_family"))
    status = T.classify_match(T.title_similarity(F.col("title"), F.col("cand_title")), year_ok, author_ok)
    return rows.groupBy(status.alias("match_status")).agg(F.count("*").alias("n"))


@query(_MATCH_SQL + """ SELECT paper_id, pos, CAST(cp AS INTEGER) AS work_pos, st AS match_status, round(score, 6) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY paper_id, pos ORDER BY st = 'verified' DESC, score DESC, cp) AS r FROM t WHERE st <> 'rejected') WHERE r = 1""")
def best_matches(spark, sf_dir):
    best = resolve.best_match(_pairs(references(spark, sf_dir)), ["paper_id", "pos"])
    return best.select("paper_id", "pos", F.col("cand_pos").cast("int").alias("work_pos"), "match_status", F.round("score", 6).alias("score"))


@query(f"""WITH {REFS_SQL}, u AS (SELECT p_partkey, any_value(title) AS title FROM (SELECT split_part(doi, '/', 1) AS p_partkey, title FROM refs) GROUP BY 1), tok AS (
    SELECT title, list_distinct(list_transform(regexp_extract_all(title, '[A-Za-z0-9]{{2,}}'), lambda x: lower(x))) AS t FROM (SELECT DISTINCT lower(p_type) || ' ' || p_brand || ' ' || p_name AS title FROM part)),
  pr AS (SELECT a.title AS title, b.title AS work, len(list_intersect(a.t, b.t)) AS n, least(len(a.t), len(b.t)) AS lo, greatest(len(a.t), len(b.t)) AS hi FROM tok a, tok b WHERE a.title <> b.title)
  SELECT title, work FROM pr WHERE n / hi >= 0.75 OR (n = lo AND lo >= 3)""")
def similar_titles(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return resolve.similar_titles(part.select(F.concat_ws(" ", F.lower("p_type"), "p_brand", "p_name").alias("title")).distinct())


@query(f"""WITH {REFS_SQL}, {WORKS_SQL}, r AS (SELECT paper_id, pos, source, title, cited_by, CASE WHEN doi IS NULL THEN regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]', '', 'g') ELSE doi END AS k, CASE WHEN source = 'semanticscholar' THEN 0 ELSE 1 END AS rs FROM works WHERE title <> ''),
  d AS (SELECT *, row_number() OVER (PARTITION BY paper_id, k ORDER BY rs, pos) AS r FROM r)
  SELECT paper_id, pos, cited_by, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY cited_by DESC, rs, pos) AS rank FROM d WHERE r = 1) WHERE rank <= 8""")
def merged_hits(spark, sf_dir):
    hits = resolve.merge_providers(corpus.works(references(spark, sf_dir)), ["paper_id"], 8)
    return hits.select("paper_id", "pos", "cited_by", "rank")


@query(f"""WITH {REFS_SQL}, {WORKS_SQL}, ck AS (SELECT DISTINCT paper_id, unnest([lower('10.5555/' || doi), regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]', '', 'g')]) AS k FROM refs WHERE pos % 2 = 0),
  wk AS (SELECT paper_id, pos, unnest([lower(doi), regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]', '', 'g')]) AS k FROM works),
  hit AS (SELECT DISTINCT wk.paper_id, wk.pos FROM wk JOIN ck ON wk.paper_id = ck.paper_id AND wk.k = ck.k)
  SELECT w.paper_id, w.pos FROM works w LEFT JOIN hit h ON w.paper_id = h.paper_id AND w.pos = h.pos WHERE h.pos IS NULL""".replace("refs AS (", "refs AS MATERIALIZED (", 1))
def uncited_hits(spark, sf_dir):
    refs = references(spark, sf_dir)
    cited = refs.where("pos % 2 = 0").withColumn("doi", F.concat(F.lit("10.5555/"), "doi"))
    return resolve.exclude_cited(corpus.works(refs), cited, ["paper_id", "pos"]).select("paper_id", "pos")


def _catalog(refs: DataFrame) -> DataFrame:
    """One work per part and supplier, with ids of three kinds by turns."""
    one = refs.groupBy("doi").agg(F.min("yr").alias("yr"))
    n = F.split("doi", "/")[0].cast("int")
    return one.select(
        F.concat(F.lit("W"), "doi").alias("work_id"), F.when(n % 3 == 0, "openalex").otherwise("semanticscholar").alias("source"),
        F.when(n % 3 == 2, F.lit("")).otherwise(F.concat(F.lit("10.5555/"), "doi")).alias("doi"), F.when(n % 3 == 2, F.concat(F.lit("9701."), "doi")).alias("arxiv_id"),
    )


@query(f"""WITH {REFS_SQL} SELECT paper_id, pos, CASE CAST(split_part(doi, '/', 1) AS INTEGER) % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS tier, 'W' || doi AS work_id FROM refs""")
def identifier_cascade(spark, sf_dir):
    refs = references(spark, sf_dir)
    ask = refs.select("paper_id", "pos", F.concat(F.lit("10.5555/"), "doi").alias("doi"), F.concat(F.lit("arXiv:9701."), "doi").alias("number"))
    return resolve.lookup_identifiers(ask, _catalog(refs)).select("paper_id", "pos", "tier", "work_id")


@query(_MATCH_SQL + """, b AS (SELECT paper_id, pos, cp, st, row_number() OVER (PARTITION BY paper_id, pos ORDER BY st = 'verified' DESC, score DESC, cp) AS r FROM t WHERE st <> 'rejected' AND pos % 2 = 1)
  SELECT paper_id, pos, CASE CAST(split_part(doi, '/', 1) AS INTEGER) % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS tier, 'W' || doi AS work_id, 'verified' AS match_status FROM refs WHERE pos % 2 = 0
  UNION ALL SELECT refs.paper_id, refs.pos, CASE WHEN b.cp IS NULL THEN NULL ELSE 4 END, CAST(b.cp AS VARCHAR), b.st FROM refs LEFT JOIN b ON b.paper_id = refs.paper_id AND b.pos = refs.pos AND b.r = 1 AND length(refs.title) > 15 WHERE refs.pos % 2 = 1""")
def resolved_references(spark, sf_dir):
    """Identifiers first (every second reference has some), then the best corroborated title."""
    refs = references(spark, sf_dir)
    known = F.col("pos") % 2 == 0
    ask = refs.select(
        "paper_id", "pos", "title", F.when(known, F.concat(F.lit("10.5555/"), "doi")).otherwise("").alias("doi"), F.when(known, F.concat(F.lit("arXiv:9701."), "doi")).otherwise("").alias("number")
    )
    pairs = _pairs(refs).withColumn("work_id", F.col("cand_pos").cast("string"))
    return resolve.resolve_references(ask, _catalog(refs), pairs, ["paper_id", "pos"]).select("paper_id", "pos", "tier", "work_id", "match_status")


@query(f"""WITH {REFS_SQL}, {WORKS_SQL}, h AS (SELECT paper_id, pos, source, title, doi, row_number() OVER (PARTITION BY paper_id, source ORDER BY pos) AS n FROM works),
  k AS (SELECT *, CASE WHEN source = 'semanticscholar' THEN 0 ELSE 1 END AS rs, coalesce(doi, regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS key FROM h WHERE n <= CASE WHEN source = 'semanticscholar' THEN 1 ELSE 5 END AND title <> ''),
  d AS (SELECT *, row_number() OVER (PARTITION BY paper_id, key ORDER BY rs, n) AS r FROM k)
  SELECT paper_id, pos, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY rs, n) AS INTEGER) AS rank FROM d WHERE r = 1""")
def title_hits(spark, sf_dir):
    """The first hit of one provider and the first five of the other, once for each key."""
    return resolve.title_hits(corpus.works(references(spark, sf_dir)), ["paper_id"]).select("paper_id", "pos", "rank")


_SEARCH_SQL = f"""WITH RECURSIVE {REFS_SQL}, s AS (SELECT paper_id, pos, 'T' || (pos * 5 % 7) AS title, CASE WHEN pos % 3 = 0 THEN '10.1/' || (pos % 4) ELSE '' END AS doi, CASE WHEN pos % 8 = 7 THEN '' ELSE 'a' END AS abstract FROM refs),
  q AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY pos) AS k, list_filter([lower(doi), lower(title)], lambda x: x <> '') AS keys FROM s WHERE NOT (pos % 7 = 0)),
  g AS (SELECT paper_id, 0::BIGINT AS k, []::VARCHAR[] AS seen, []::INTEGER[] AS kept FROM (SELECT DISTINCT paper_id FROM q) UNION ALL
    SELECT g.paper_id, q.k, CASE WHEN list_has_any(g.seen, q.keys) OR q.abstract = '' THEN g.seen ELSE list_concat(g.seen, q.keys) END, CASE WHEN list_has_any(g.seen, q.keys) OR q.abstract = '' THEN g.kept ELSE list_append(g.kept, q.pos) END
    FROM g JOIN q ON q.paper_id = g.paper_id AND q.k = g.k + 1)"""


@query(_SEARCH_SQL + " SELECT paper_id, unnest(max_by(kept, k)) AS pos FROM g GROUP BY paper_id")
def new_hits(spark, sf_dir):
    """Search results in order, each kept if it shares no key with a cited work or one kept before."""
    refs = references(spark, sf_dir)
    p = F.col("pos")
    hits = refs.select(
        "paper_id", "pos", F.concat(F.lit("T"), p * 5 % 7).alias("title"), F.when(p % 3 == 0, F.concat(F.lit("10.1/"), p % 4)).otherwise("").alias("doi"), F.when(p % 8 == 7, "").otherwise("a").alias("abstract"),
    )
    cited = hits.where("pos % 7 = 0").select("paper_id", F.lit("").alias("doi"), F.lit("T0").alias("title")).distinct()
    return resolve.new_results(hits, cited, "paper_id", "pos").select("paper_id", "pos")


_STATE_SQL = f"""WITH {REFS_SQL}, st AS (SELECT paper_id, pos, CASE WHEN pos % 11 = 0 THEN 'failed' ELSE 'parsed' END AS parse_status, CASE pos % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'unverified' ELSE 'low-confidence' END AS resolution_status,
    CASE pos % 4 WHEN 0 THEN 'https://x.org/search?q=1' WHEN 1 THEN 'https://arxiv.org/abs/1' ELSE NULL END AS url, CASE WHEN pos % 5 = 0 THEN 'https://p.org/search?q=2' WHEN pos % 5 = 1 THEN 'https://p.org/1' END AS provenance_url FROM refs),
  f AS (SELECT paper_id, pos, CASE WHEN pos % 4 < 2 THEN 'verified' ELSE 'low-confidence' END AS match_status, CASE WHEN pos % 6 = 0 THEN 'https://s.org/search' ELSE 'https://s.org/' || pos END AS url FROM refs WHERE pos % 2 = 0)"""


def _states(refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    p = F.col("pos")
    state = refs.select(
        "paper_id", "pos", F.when(p % 11 == 0, "failed").otherwise("parsed").alias("parse_status"),
        F.when(p % 3 == 0, "verified").when(p % 3 == 1, "unverified").otherwise("low-confidence").alias("resolution_status"), F.lit("").alias("resolution_note"),
        F.when(p % 4 == 0, "https://x.org/search?q=1").when(p % 4 == 1, "https://arxiv.org/abs/1").alias("url"),
        F.when(p % 5 == 0, "https://p.org/search?q=2").when(p % 5 == 1, "https://p.org/1").alias("provenance_url"), F.lit(None).cast("string").alias("doi"), F.lit(None).cast("string").alias("number"),
    )
    found = refs.where("pos % 2 = 0").select(
        "paper_id", "pos", F.when(p % 4 < 2, "verified").otherwise("low-confidence").alias("match_status"), F.lit("semanticscholar").alias("source"), p.cast("string").alias("external_id"),
        F.when(p % 6 == 0, "https://s.org/search").otherwise(F.concat(F.lit("https://s.org/"), "pos")).alias("url"), F.lit("").alias("abstract"), F.lit("").alias("doi"),
    )
    return state, found


@query(_STATE_SQL + f""" SELECT st.paper_id, st.pos, CASE WHEN st.resolution_status = 'verified' THEN 'verified' WHEN f.url IS NOT NULL AND NOT contains(f.url, '/search') THEN f.match_status ELSE st.resolution_status END AS resolution_status,
  CASE WHEN st.resolution_status = 'verified' THEN '' WHEN f.url IS NOT NULL AND NOT contains(f.url, '/search') THEN CASE WHEN f.match_status = 'low-confidence' THEN '{resolve.LOW}' ELSE '' END
    WHEN parse_status <> 'failed' AND st.resolution_status = 'unverified' THEN '{resolve.NO_MATCH}' ELSE '' END AS resolution_note FROM st LEFT JOIN f ON st.paper_id = f.paper_id AND st.pos = f.pos""".replace("refs AS (", "refs AS MATERIALIZED (", 1))
def retried_references(spark, sf_dir):
    state, found = _states(references(spark, sf_dir))
    return resolve.retry_unverified(state, found, ["paper_id", "pos"]).select("paper_id", "pos", "resolution_status", "resolution_note")


@query(_STATE_SQL + """, x AS (SELECT *, CASE WHEN NOT contains(url, '/search') THEN url END AS u, CASE WHEN NOT contains(provenance_url, '/search') THEN provenance_url END AS p FROM st)
  SELECT paper_id, pos, coalesce(p, u, '') AS best, parse_status <> 'failed' AND p IS NULL AND u IS NULL AS needs_lookup FROM x""")
def repaired_references(spark, sf_dir):
    state, _ = _states(references(spark, sf_dir))
    best = T.best_url(F.col("provenance_url"), F.col("url"), F.col("doi"), F.col("number"))
    return resolve.repair(state).select("paper_id", "pos", best.alias("best"), "needs_lookup")


@query(_STATE_SQL + """, g AS (SELECT paper_id, count(*) AS n, count(*) FILTER (parse_status = 'parsed') AS p, count(*) FILTER (resolution_status = 'verified') AS v FROM st GROUP BY 1),
  c AS (SELECT paper_id, count(*) AS cn, count(*) FILTER (pos % 3 > 0) AS cr FROM st GROUP BY 1),
  m AS (SELECT paper_id, 'parsed' AS metric, p AS ok, n AS total FROM g UNION ALL SELECT paper_id, 'verified', v, n FROM g UNION ALL SELECT paper_id, 'resolved', cr, cn FROM c)
  SELECT *, CASE WHEN total = 0 THEN 'warn' WHEN ok = total THEN 'ok' WHEN ok * 10 >= total * 8 THEN 'warn' ELSE 'bad' END AS band FROM m""")
def coverage(spark, sf_dir):
    refs = references(spark, sf_dir)
    state, _ = _states(refs)
    return resolve.coverage(state, refs.select("paper_id", (F.col("pos") % 3 > 0).alias("resolved")))


# --- layout --------------------------------------------------------------------------


def _lines(spark, sf_dir):
    return corpus.layout_lines(_documents(spark, sf_dir))


_BAND = "(y0 < page_height * 0.08 OR y0 > page_height * 0.92)"


@query(f"""WITH {LINES_SQL}, o AS (SELECT paper_id, text FROM lines WHERE {_BAND} GROUP BY ALL HAVING count(DISTINCT page) >= 3)
  SELECT paper_id, line_no, text FROM lines l WHERE NOT ({_BAND} AND EXISTS (SELECT 1 FROM o WHERE o.paper_id = l.paper_id AND o.text = l.text))""")
def without_furniture(spark, sf_dir):
    return layout.drop_furniture(_lines(spark, sf_dir)).select("paper_id", "line_no", "text")


@query(f"""WITH {LINES_SQL}, e AS (SELECT paper_id, size, sum(length(text)) AS n, min(line_no) AS f FROM lines GROUP BY ALL), p AS (SELECT paper_id, CAST(max(page) + 1 AS INTEGER) AS pages FROM lines GROUP BY 1)
  SELECT paper_id, size AS body, pages FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY n DESC, f) AS r FROM e) JOIN p USING (paper_id) WHERE r = 1""")
def body_size(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return layout.body_size(lines).join(layout.page_count(lines), "paper_id")


@query(f"""WITH {LINES_SQL}, p AS (SELECT paper_id, page, count(*) AS n, count(*) FILTER (x0 >= 244.8) AS r FROM lines GROUP BY ALL),
  q AS (SELECT paper_id, count(*) FILTER (n >= 10 AND r >= 8 AND n - r >= 8) AS two, count(*) FILTER (n >= 10 AND NOT (r >= 8 AND n - r >= 8)) AS one FROM p GROUP BY 1)
  SELECT paper_id, CASE WHEN two >= 2 AND one >= 2 THEN 'Mixed layout' WHEN two > one THEN 'Two-column' ELSE 'Single column' END AS layout FROM q""")
def detected_layout(spark, sf_dir):
    return layout.detect_layout(_lines(spark, sf_dir))


@query(rf"""WITH {LINES_SQL}, w AS (SELECT paper_id, line_no, trim(text) AS t, list_filter(regexp_split_to_array(text, '[ \t\r\f\v\n]+'), lambda x: x <> '') AS w FROM lines)
  SELECT paper_id, line_no FROM w WHERE t <> '' AND NOT regexp_matches(t, '^\[[0-9]+\]') AND NOT regexp_matches(t, '^[0-9]{{1,3}}\.\s+\S') AND len(w) >= 4
    AND len(list_filter(w, lambda x: length(regexp_replace(x, '[^A-Za-z0-9]', '', 'g')) <= 3)) * 10 >= len(w) * 7""")
def table_rows(spark, sf_dir):
    return _lines(spark, sf_dir).where(layout.is_table_row(F.col("text"))).select("paper_id", "line_no")


def _paper_lines(refs: DataFrame) -> DataFrame:
    """Papers as lines: a title, an abstract, two sections, entries, and an appendix."""
    raw = corpus.entries(refs).select("paper_id", (F.col("pos") + 8).alias("line_no"), F.col("raw").alias("text"))
    n = refs.groupBy("paper_id").agg(F.count("*").alias("n"))
    fixed = ("A Study of Parts", "Abstract", "We study parts that are sup-", "plied by many.", "1 Introduction", "Parts matter to all.", "1.1 Setting", "We fix a setting.", "References")
    head = n.select("paper_id", F.posexplode(F.array(*[F.lit(x) for x in fixed])).alias("line_no", "text"))
    tail = n.select("paper_id", (F.col("n") + 9).alias("line_no"), F.lit("Appendix A").alias("text"))
    rows = head.unionByName(raw).unionByName(tail)
    bold = F.col("text").isin("Abstract", "1 Introduction", "1.1 Setting", "References", "Appendix A")
    return rows.select(
        "paper_id", F.col("line_no").cast("int").alias("line_no"), "text", F.floor(F.col("line_no") / 40).cast("int").alias("page"), F.when(F.col("line_no") == 0, 17.0).otherwise(10.0).alias("size"),
        bold.alias("bold"), F.lit(72.0).alias("x0"), (F.lit(80.0) + F.col("line_no") % 40 * 15).alias("y0"), F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"),
    )


@query(f"""WITH {REFS_SQL}, {ENTRIES_SQL}, p AS (SELECT DISTINCT paper_id FROM refs) SELECT paper_id, * EXCLUDE (paper_id) FROM p, (VALUES ('abstract', 'Abstract', 1, 'We study parts that are supplied by many.'),
  ('sec1', '1 Introduction', 1, 'Parts matter to all.'), ('sec2', '1.1 Setting', 2, 'We fix a setting.')) t(section_id, title, level, text)
  UNION ALL SELECT paper_id, 'sec3', 'References', 1, string_agg('[' || pos || '] ' || body, ' ' ORDER BY pos) || ' Appendix A' FROM ents GROUP BY paper_id""")
def sections(spark, sf_dir):
    lines = _paper_lines(references(spark, sf_dir))
    return layout.sections(lines, layout.body_size(lines)).select("paper_id", "section_id", "title", "level", "text")


@query(f"""WITH {REFS_SQL} SELECT paper_id, CAST(pos + 8 AS INTEGER) AS line_no FROM refs""")
def reference_lines(spark, sf_dir):
    lines = _paper_lines(references(spark, sf_dir))
    return layout.reference_lines(lines, layout.body_size(lines)).select("paper_id", "line_no")


@query(f"""WITH {REFS_SQL}, g AS (SELECT paper_id, pos, row_number() OVER (PARTITION BY paper_id ORDER BY pos) AS k FROM refs WHERE pos % 5 <> 3),
  s AS (SELECT *, lead(pos) OVER (PARTITION BY paper_id ORDER BY k) AS nx, pos - lag(pos) OVER (PARTITION BY paper_id ORDER BY k) AS st FROM g),
  ok AS (SELECT paper_id, count(*) >= 3 AND min_by(pos, k) <= 2 AND count(*) FILTER (st BETWEEN 1 AND 3) * 10 >= (count(*) - 1) * 8 AS sequential FROM s GROUP BY 1),
  r AS (SELECT paper_id, pos || ' → ' || nx AS gap, row_number() OVER (PARTITION BY paper_id ORDER BY k) AS r FROM s WHERE nx <> pos + 1)
  SELECT paper_id, sequential, string_agg(gap, ', ' ORDER BY r) FILTER (r <= 8) AS gaps FROM ok LEFT JOIN r USING (paper_id) GROUP BY ALL""")
def number_sequences(spark, sf_dir):
    nums = references(spark, sf_dir).where("pos % 5 <> 3").select("paper_id", F.col("pos").alias("num"), F.col("pos").alias("k"))
    ok = layout.sequential(nums).withColumnRenamed("ok", "sequential")
    return ok.join(layout.sequence_gaps(nums), "paper_id", "left")


@query(f"""WITH {REFS_SQL}, l AS (SELECT paper_id, pos - 1 AS i, count(*) OVER (PARTITION BY paper_id) AS n, pos % 9 < 5 AS hit FROM refs), t AS (SELECT paper_id, i - 2 * n // 3 AS i, n - 2 * n // 3 AS m, hit FROM l WHERE i >= 2 * n // 3),
  h AS (SELECT *, CASE WHEN i - lag(i) OVER w > 4 OR lag(i) OVER w IS NULL THEN 1 ELSE 0 END AS nw FROM t WHERE hit WINDOW w AS (PARTITION BY paper_id ORDER BY i)),
  s AS (SELECT *, sum(nw) OVER (PARTITION BY paper_id ORDER BY i) AS g FROM h), u AS (SELECT paper_id, g, m, min(i) AS st, max(i) AS la FROM s GROUP BY ALL),
  v AS (SELECT paper_id, st, CASE WHEN la + 4 < m THEN la - st ELSE m - st END AS ln FROM u)
  SELECT paper_id, CAST(st AS INTEGER) AS start, CAST(ln AS INTEGER) AS length FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY ln DESC, st) AS r FROM v) WHERE r = 1 AND ln >= 5""")
def longest_run(spark, sf_dir):
    text = F.when(F.col("pos") % 9 < 5, F.concat(F.lit("["), "pos", F.lit("] X"))).otherwise("plain words")
    return layout.longest_citation_run(references(spark, sf_dir).select("paper_id", F.col("pos").alias("line_no"), text.alias("text")))


@query(f"""WITH {REFS_SQL}, {ENTRIES_SQL} SELECT paper_id, CAST(pos AS INTEGER) AS num, '[' || pos || '] ' || body AS entry FROM ents""")
def split_entries(spark, sf_dir):
    """Entries whose lines break inside words, joined and split again at their markers."""
    raw = corpus.entries(references(spark, sf_dir))
    # A break behind the second letter of the title, with a hyphen.
    halves = F.array(F.concat(F.expr("substring(raw, 1, instr(raw, true_title) + 1)"), F.lit("-")), F.expr("substring(raw, instr(raw, true_title) + 2)"))
    lines = raw.select("paper_id", F.col("pos").alias("line_no"), F.posexplode(halves).alias("half", "text"))
    blob = lines.groupBy("paper_id").agg(T.join_hyphenated(F.array_sort(F.collect_list(F.struct("line_no", "half", "text")))["text"]).alias("blob"))
    return layout.split_block(blob).select("paper_id", "num", "entry")


# --- editing, questions, export ---------------------------------------------------------


_DIFF_SQL = f"""WITH {REFS_SQL}, s AS (SELECT paper_id, section_id, min(pos) AS lo, max(pos) AS hi FROM refs GROUP BY ALL)"""


def _diffs(refs: DataFrame) -> DataFrame:
    """Edits of sections that keep, lose or invent a token by turns of section."""
    s = refs.groupBy("paper_id", "section_id").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    old = F.concat(F.lit("Known [[cite:ref"), "lo", F.lit(",ref"), "hi", F.lit("]] fact. Again [[cite:ref"), "lo", F.lit("]].")).alias("old_text")
    k = F.col("section_id") % 4
    new = (
        F.when(k == 0, F.concat(F.lit("Kept [[cite:ref"), "hi", F.lit(",ref"), "lo", F.lit("]] and [[cite:ref"), "lo", F.lit("]].")))
        .when(k == 1, F.concat(F.lit("Lost [[cite:ref"), "lo", F.lit("]].")))
        .when(k == 2, F.concat(F.lit("More [[cite:ref"), "lo", F.lit(",ref"), "hi", F.lit("]] [[cite:ref"), "lo", F.lit("]] [[cite:ref99999]].")))
        .otherwise(F.lit("None."))
    )
    return s.select("paper_id", "section_id", old, new.alias("new_text"))


@query(_DIFF_SQL + """, o AS (SELECT paper_id, section_id, lo AS p, 2 + (lo = hi)::INT AS b FROM s UNION ALL SELECT paper_id, section_id, hi, 1 FROM s WHERE hi <> lo)
  SELECT paper_id, section_id, 'ref' || p AS ref_id, CAST(b AS BIGINT) AS before, CAST(a AS BIGINT) AS after FROM (SELECT o.*, CASE section_id % 4 WHEN 1 THEN (p = lo)::INT WHEN 3 THEN 0 ELSE b END AS a FROM o JOIN s USING (paper_id, section_id)) WHERE a < b""")
def integrity_violations(spark, sf_dir):
    out = edit.integrity(_diffs(references(spark, sf_dir)), ["paper_id", "section_id"])
    return out.select("paper_id", "section_id", "ref_id", "before", "after")


@query(_DIFF_SQL + " SELECT paper_id, section_id, 'ref99999' AS ref_id FROM s WHERE section_id % 4 = 2")
def unknown_citations(spark, sf_dir):
    refs = references(spark, sf_dir)
    return edit.unknown_tokens(_diffs(refs), _ids(refs), ["paper_id", "section_id"])


@query(_DIFF_SQL + """ SELECT paper_id, section_id, CASE section_id % 4 WHEN 1 THEN 'drops citations' WHEN 3 THEN 'drops citations' WHEN 2 THEN 'unknown citation' END AS reason,
    CASE WHEN section_id % 4 = 0 THEN 'Kept [[cite:ref' || hi || ',ref' || lo || ']] and [[cite:ref' || lo || ']].' ELSE 'Known [[cite:ref' || lo || ',ref' || hi || ']] fact. Again [[cite:ref' || lo || ']].' END AS text FROM s""")
def applied_diffs(spark, sf_dir):
    refs = references(spark, sf_dir)
    diffs = _diffs(refs)
    sections_ = diffs.select("paper_id", "section_id", F.col("old_text").alias("text"))
    none = _ids(refs).select("paper_id", "ref_id", F.lit("openalex").alias("source")).limit(0)
    after, refused = edit.apply_diffs(sections_, diffs.select("paper_id", "section_id", "new_text"), _ids(refs), none)
    return after.join(refused, ["paper_id", "section_id"], "left").select("paper_id", "section_id", "reason", "text")


@query(_DIFF_SQL + """ SELECT paper_id, section_id, CASE WHEN section_id % 5 = 0 THEN 'text has changed' WHEN section_id % 4 = 2 AND false THEN '' END AS reason FROM s WHERE section_id % 4 IN (0, 2) AND section_id % 5 = 0""")
def refused_undos(spark, sf_dir):
    refs = references(spark, sf_dir)
    diffs = _diffs(refs).where("section_id % 4 in (0, 2)")
    now = diffs.select("paper_id", "section_id", F.when(F.col("section_id") % 5 == 0, F.lit("edited since")).otherwise(F.col("new_text")).alias("text"))
    added = refs.select("paper_id", F.lit("ref99999").alias("ref_id")).distinct()
    return edit.undo(now, diffs, added)[1]


@query("""WITH p AS (SELECT o_orderkey AS proposal_id, CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'applied' WHEN 2 THEN 'rejected' ELSE 'undone' END AS status, CASE o_custkey % 3 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' ELSE 'undo' END AS decision FROM orders)
  SELECT proposal_id, decision, coalesce(nx, status) AS status, nx IS NULL AS conflict FROM (SELECT *, CASE WHEN status = 'pending' AND decision = 'approve' THEN 'applied' WHEN status = 'pending' AND decision = 'reject' THEN 'rejected' WHEN status = 'applied' AND decision = 'undo' THEN 'undone' END AS nx FROM p)""")
def decisions(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey") % 3
    p = o.select(F.col("o_orderkey").alias("proposal_id"), F.when(k == 0, "pending").when(k == 1, "applied").when(k == 2, "rejected").otherwise("undone").alias("status"))
    d = o.select(F.col("o_orderkey").alias("proposal_id"), F.when(c == 0, "approve").when(c == 1, "reject").otherwise("undo").alias("decision"))
    return edit.decide(p, d)


@query("""WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations)
  SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'Q: ' ELSE 'A: ' END || substr(text, 1, 500), chr(10) ORDER BY turn) AS history FROM t WHERE k <= 6 GROUP BY conv_id""")
def chat_windows(spark, sf_dir):
    return qa.chat_window(table(spark, sf_dir, "conversations"))


@query(r"""WITH a AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS old FROM conversations WHERE role = 'assistant'),
  p AS (SELECT conv_id, turn, string_split(regexp_replace(old, '([.!?])[ \t\n\r\f\v]+', '\1' || chr(1), 'g'), chr(1)) AS o, string_split(regexp_replace(text, '([.!?])[ \t\n\r\f\v]+', '\1' || chr(1), 'g'), chr(1)) AS n FROM a WHERE old IS NOT NULL),
  s AS (SELECT conv_id, turn, list_transform(o, lambda x: lower(trim(regexp_replace(x, '[ \t\n\r\f\v]+', ' ', 'g')))) AS o, CAST(unnest(range(len(n))) AS INTEGER) AS sent_no, unnest(n) AS sentence FROM p)
  SELECT conv_id, turn, sent_no, trim(sentence, chr(10) || chr(9) || ' ') AS sentence FROM s WHERE NOT list_contains(o, lower(trim(regexp_replace(sentence, '[ \t\n\r\f\v]+', ' ', 'g')))) AND length(trim(sentence, chr(10) || chr(9) || ' ')) >= 40""")
def new_uncited_sentences(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    rows = said.select("conv_id", "turn", F.col("text").alias("new_text"), F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("old_text"))
    return review.new_uncited_sentences(rows.where("old_text is not null"), ["conv_id", "turn"]).select("conv_id", "turn", "sent_no", "sentence")


@query(_DIFF_SQL + """ SELECT paper_id, section_id, 'Prior work~\\cite{ref' || lo || ',ref' || hi || '} costs 5\\% \\& more~\\cite{ref' || lo || '}.' AS latex FROM s""")
def latex_text(spark, sf_dir):
    s = references(spark, sf_dir).groupBy("paper_id", "section_id").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    text = F.concat(F.lit("Prior work  [[cite:ref"), "lo", F.lit(",ref"), "hi", F.lit("]] costs 5% & more [[cite:ref"), "lo", F.lit("]]."))
    return s.select("paper_id", "section_id", T.text_to_latex(text).alias("latex"))


def _all_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(entries.parse_entries(corpus.entries(references(spark, sf_dir)).select("paper_id", "pos", "raw")))


@query(f"""WITH {REFS_SQL}, {ENTRIES_SQL}, x AS (SELECT *, '9701.0' || lpad(CAST(pos AS VARCHAR), 4, '0') AS ax FROM ents)
  SELECT paper_id, pos, CASE pos % 4 WHEN 0 THEN '@article' WHEN 3 THEN '@misc' ELSE '@inproceedings' END || '{{ref' || pos || ',' || chr(10) || '  title = {{' || t || '}},' || chr(10) || '  author = {{' || f ||
    CASE pos % 4 WHEN 0 THEN '' WHEN 1 THEN ', A' ELSE ', Ann' END || '}},' || chr(10) || '  year = {{' || yr || '}},' || chr(10) || CASE pos % 4 WHEN 0 THEN '  journal = {{Journal of Parts}},' WHEN 1 THEN '  booktitle = {{Parts Conference}},'
    WHEN 2 THEN '  booktitle = {{Parts Workshop}},' || chr(10) || '  doi = {{10.5555/' || doi || '}},' || chr(10) || '  url = {{https://doi.org/10.5555/' || doi || '}},'
    ELSE '  url = {{https://arxiv.org/abs/' || ax || '}},' || chr(10) || '  eprint = {{' || ax || '}},' || chr(10) || '  eprinttype = {{arxiv}},' END || chr(10) || '}}' AS bibtex FROM x""")
def bibtex_entries(spark, sf_dir):
    """Every reference, of all entry formats."""
    return export.bibtex(_all_parsed(spark, sf_dir))


@query(f"""WITH {REFS_SQL}, {ENTRIES_SQL}, x AS (SELECT *, CASE pos % 4 WHEN 2 THEN ' https://doi.org/10.5555/' || doi WHEN 3 THEN ' https://arxiv.org/abs/9701.0' || lpad(CAST(pos AS VARCHAR), 4, '0') ELSE '' END AS link FROM ents)
  SELECT paper_id, pos, '[' || pos || ']' AS ieee, '(' || f || ', ' || yr || ')' AS apa,
    CASE WHEN pos % 4 = 0 THEN '' ELSE 'A. ' END || f || ', “' || t || ',” ' || CASE pos % 4 WHEN 0 THEN 'Journal of Parts, vol. 12, no. 3, pp. 45-67, ' WHEN 1 THEN 'in Parts Conference, ' WHEN 2 THEN 'in Parts Workshop, ' ELSE '' END || yr || '.' || link AS ieee_entry,
    f || CASE WHEN pos % 4 = 0 THEN '' ELSE ', A.' END || ' (' || yr || '). ' || t || '.' || CASE pos % 4 WHEN 0 THEN ' Journal of Parts, 12(3), 45-67.' WHEN 1 THEN ' Parts Conference.' WHEN 2 THEN ' Parts Workshop.' ELSE '' END || link AS apa_entry FROM x""")
def bibliography(spark, sf_dir):
    """Every reference, of all entry formats."""
    ieee, apa = F.lit("ieee"), F.lit("apa")
    return _all_parsed(spark, sf_dir).select("paper_id", "pos", export.inline_label(ieee).alias("ieee"), export.inline_label(apa).alias("apa"), export.entry_text(ieee).alias("ieee_entry"), export.entry_text(apa).alias("apa_entry"))


def _given_answers(docs: DataFrame) -> DataFrame:
    return docs.where("text is not null").select(
        F.col("doc_id").alias("paper_id"), F.col("doc_id").alias("answer_id"), F.lit("What of reference 2?").alias("question"), F.lit("See ref 3.").alias("answer"), F.lit(True).alias("answered"),
        F.array(F.lit("body#0"), F.lit("(body#1) "), F.lit("body#0"), F.lit("body#999999")).alias("evidence"), F.array(F.lit("ref1"), F.lit("ref77")).alias("cited_refs"),
    )


@query(r"""WITH s AS (SELECT doc_id, unnest(range(len(p))) AS sent_no, unnest(p) AS s FROM (
    SELECT doc_id, string_split(regexp_replace(substr(text, 1, 2600), '([.!?])[ \t\n\r\f\v]+', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents WHERE text IS NOT NULL)),
  n AS (SELECT doc_id, sent_no, regexp_replace(trim(regexp_replace(s, '[ \t\n\r\f\v]+', ' ', 'g')), '[ ]+([.,;:!?])', '\1', 'g') AS sentence FROM s)
  SELECT doc_id AS answer_id, 'See ref 3.' AS answer, count(*) FILTER (length(sentence) >= 20 AND sent_no < 2) AS n_sources, 'ref1,ref2,ref3' AS ref_ids, 'Some claimed evidence ids were invalid and were removed.' AS warning FROM n GROUP BY doc_id""")
def checked_answers(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    index = qa.sentence_index(docs.where("text is not null").select(F.col("doc_id").alias("paper_id"), F.lit("body").alias("section_id"), F.lit("Body").alias("title"), "text"))
    refs = docs.select(F.col("doc_id").alias("paper_id"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("pos")).withColumn("title", F.lit("short"))
    return qa.answers(index, _given_answers(docs), _ids(refs))


@query(f"""WITH {REFS_SQL}, p AS (SELECT DISTINCT paper_id FROM refs) SELECT paper_id, 'A Study of Parts' AS title FROM p""")
def paper_titles(spark, sf_dir):
    return layout.title_of(_paper_lines(references(spark, sf_dir)))


@query(f"""WITH {REFS_SQL} SELECT paper_id, pos || '. ' || title || ' con' || 'tinued here.' AS entry FROM refs""")
def dot_entries(spark, sf_dir):
    """Entries numbered with a dot, each over two lines that break a word."""
    refs = references(spark, sf_dir)
    halves = F.array(F.concat("pos", F.lit(". "), "title", F.lit(" con-")), F.lit("tinued here."))
    lines = refs.select("paper_id", "pos", F.posexplode(halves).alias("half", "text")).select("paper_id", (F.col("pos") * 2 + F.col("half")).alias("line_no"), "text")
    return layout.split_on_line_start(lines).select("paper_id", "entry")


def _hanging(refs: DataFrame) -> DataFrame:
    """Author-year entries of three lines on one page; those of even papers are indented from the second line on."""
    name = F.concat(F.initcap("fam"), F.lit(", A. Some title number "), "pos")
    lines = refs.select("paper_id", "pos", F.posexplode(F.array(name, F.lit("and lower words"), F.lit("that follow."))).alias("half", "text"))
    x0 = F.when((F.col("paper_id") % 2 == 0) & (F.col("half") > 0), 84.0).otherwise(72.0)
    return lines.select("paper_id", (F.col("pos") * 3 + F.col("half")).alias("line_no"), "text", F.lit(0).alias("page"), x0.alias("x0"), F.lit(612.0).alias("page_width"))


@query(f"""WITH {REFS_SQL}, e AS (SELECT paper_id, pos, count(*) OVER (PARTITION BY paper_id) AS n, upper(substr(fam, 1, 1)) || substr(fam, 2) || ', A. Some title number ' || pos || ' and lower words that follow.' AS entry, row_number() OVER (PARTITION BY paper_id ORDER BY pos) AS k FROM refs)
  SELECT paper_id, CAST(k AS INTEGER) AS k, CASE WHEN paper_id % 2 = 0 AND n >= 2 THEN 'author-year-indent' ELSE 'author-year-regex' END AS scheme, entry FROM e""")
def author_year_entries(spark, sf_dir):
    return layout.author_year_entries(_hanging(references(spark, sf_dir))).select("paper_id", "k", "scheme", "entry")


def _plans(s: DataFrame) -> DataFrame:
    """Three operations for each section: one that stands, one of an unknown action, one on a section that its paper lacks."""
    # Sections lie within a span of the paper's; a step longer than that leads out of it, however large the table.
    of_paper = Window.partitionBy("paper_id")
    step = F.greatest(F.lit(1000000), F.max("section_id").over(of_paper) - F.min("section_id").over(of_paper) + 1)
    ops = s.withColumn("step", step).select("paper_id", F.inline(F.array(
        F.struct("section_id", F.lit(0).alias("no"), F.lit("rewrite").alias("action")), F.struct("section_id", F.lit(1).alias("no"), F.lit("translate").alias("action")),
        F.struct((F.col("section_id") + F.col("step")).alias("section_id"), F.lit(2).alias("no"), F.lit("shorten").alias("action")),
    )))
    return ops.withColumn("op_no", F.col("section_id") * 3 + F.col("no"))


@query(_DIFF_SQL + """, o AS (SELECT paper_id, section_id, 0 AS op_no, 'rewrite' AS action FROM s UNION ALL SELECT paper_id, section_id, 1, 'translate' FROM s UNION ALL SELECT paper_id, section_id + 1000000, 2, 'shorten' FROM s),
  v AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY section_id * 3 + op_no) AS k FROM o WHERE action = 'rewrite') SELECT paper_id, section_id, action FROM v WHERE k <= 4""")
def planned_operations(spark, sf_dir):
    s = _diffs(references(spark, sf_dir)).select("paper_id", "section_id")
    return edit.valid_operations(_plans(s), s).select("paper_id", "section_id", "action")


@query(_DIFF_SQL + """ SELECT paper_id, section_id, CASE WHEN section_id % 4 = 0 THEN 1 ELSE 2 END AS attempt FROM s WHERE section_id % 4 = 0 OR section_id % 3 = 0""")
def accepted_rewrites(spark, sf_dir):
    """First attempts as in the diffs (kept only for one in four); every third section has a second one that keeps all."""
    d = _diffs(references(spark, sf_dir))
    second = d.where("section_id % 3 = 0").withColumn("new_text", F.concat(F.lit("Again: "), "old_text")).withColumn("attempt", F.lit(2))
    third = d.withColumn("new_text", F.col("old_text")).withColumn("attempt", F.lit(3))
    tries = d.withColumn("attempt", F.lit(1)).unionByName(second).unionByName(third)
    return edit.accepted_rewrites(tries, ["paper_id", "section_id"]).select("paper_id", "section_id", "attempt")


@query(_DIFF_SQL + """, n AS (SELECT paper_id, count(*) AS n FROM refs GROUP BY 1)
  SELECT paper_id, section_id, 'One part! Two parts [[cite:ref' || (n + 1) || ']]. Three [[cite:ref' || (n + 1) || ']] [[cite:ref' || (n + 2) || ']]?' AS new_text FROM s JOIN n USING (paper_id)""")
def placed_citations(spark, sf_dir):
    """Picks in order: a candidate twice, one out of range, and one beyond the third."""
    refs = references(spark, sf_dir)
    s = refs.select("paper_id", "section_id").distinct().withColumn("text", F.lit("One part! Two parts. Three?"))
    picks = s.select("paper_id", "section_id", F.inline(F.array(*[
        F.struct(F.lit(k).alias("pick_no"), F.lit(i).alias("sentence_index"), F.lit(c).alias("candidate_index")) for k, (i, c) in enumerate(((2, 4), (9, 1), (2, 7), (1, 4), (0, 2)))
    ])))
    return edit.place_citations(s, picks, refs.groupBy("paper_id").agg(F.count("*").alias("n_refs")))[0].select("paper_id", "section_id", "new_text")


def _long_sections(refs: DataFrame) -> DataFrame:
    """Sections long enough to be reviewed, but for the least of each paper, which is its abstract."""
    s = refs.groupBy("paper_id", "section_id").agg(F.min("pos").alias("lo"))
    first = F.min("section_id").over(Window.partitionBy("paper_id"))
    text = F.concat(F.lit("Parts are said to last for many years [[cite:ref"), "lo", F.lit("]]. A claim without any source stands in this long sentence. "), F.repeat(F.lit("More of it. "), 30))
    return s.select("paper_id", "section_id", F.col("section_id").alias("sec_no"), F.when(F.col("section_id") == first, "Abstract").otherwise("Results").alias("title"), text.alias("text"), "lo")


_REVIEW_SQL = _DIFF_SQL + """, z AS (SELECT paper_id, section_id, lo, row_number() OVER (PARTITION BY paper_id ORDER BY section_id) - 1 AS k FROM s), r AS (SELECT * FROM z WHERE k BETWEEN 1 AND 6)"""


@query(_REVIEW_SQL + """ SELECT paper_id, section_id, 'info' AS kind, NULL AS claim, 'No candidate works found.' AS rationale FROM r WHERE section_id % 3 = 0 UNION ALL
  SELECT paper_id, section_id, 'missing_citation', 'Hit 2', 'why 1' FROM r WHERE section_id % 3 > 0 UNION ALL SELECT paper_id, section_id, 'missing_citation', 'Hit 1', 'why 0' FROM r WHERE section_id % 3 > 0""")
def missing_works(spark, sf_dir):
    s = _long_sections(references(spark, sf_dir))
    key = ["paper_id", "section_id"]
    asked = s.select(*key, F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("query_no")).withColumn("query", F.lit("parts"))
    hits = s.where("section_id % 3 > 0").select(*key, F.explode(F.sequence(F.lit(1), F.lit(8))).alias("rank")).withColumn("title", F.concat(F.lit("Hit "), "rank"))
    picks = s.select(*key, F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("pick_no")).select(
        *key, "pick_no", F.col("pick_no").alias("index"), F.lit(None).cast("string").alias("confidence"), F.concat(F.lit("why "), "pick_no").alias("rationale")
    )
    return review.missing_work(s, asked, hits, picks).select("paper_id", "section_id", "kind", "claim", "rationale")


@query(_REVIEW_SQL + """, c AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY section_id) AS n FROM z) SELECT paper_id, section_id, 'ref' || lo AS ref_id, CASE WHEN lo % 4 = 0 THEN 'unverifiable' WHEN lo % 3 = 0 THEN 'mismatch' WHEN lo % 3 = 1 THEN 'unverifiable' ELSE 'info' END AS kind,
    'Parts are said to last for many years [[cite:ref' || lo || ']].' AS claim FROM c WHERE n <= 15""")
def citation_checks(spark, sf_dir):
    refs = _ids(references(spark, sf_dir))
    s = _long_sections(refs)
    cits = s.select("paper_id", "section_id", F.row_number().over(Window.partitionBy("paper_id").orderBy("section_id")).alias("cit_no"), F.lit(True).alias("resolved"), F.array(F.concat(F.lit("ref"), "lo")).alias("ref_ids"), "lo")
    told = F.when(F.col("lo") % 3 == 0, "does_not_support").when(F.col("lo") % 3 == 1, "cannot_tell").otherwise("supports")
    verdicts = cits.select("paper_id", "cit_no", F.get("ref_ids", F.lit(0)).alias("ref_id"), told.alias("verdict"))
    known = refs.select("paper_id", "ref_id", F.when(F.col("pos") % 4 == 0, "").otherwise("An abstract.").alias("abstract"))
    return review.citation_checks(cits.drop("lo"), s, known, verdicts).select("paper_id", "section_id", "ref_id", "kind", "claim")


@query(_REVIEW_SQL + """ SELECT paper_id, section_id, 'A claim without any source stands in this long sentence.' AS claim FROM r""")
def uncited_claims(spark, sf_dir):
    """Claims of which one is in the text, one has a citation, one is not there and one is too short."""
    s = _long_sections(references(spark, sf_dir))
    said = ("A  claim without any source\nstands in this long sentence.", "Parts are said to last for many years [[cite:ref1]].", "A sentence that nobody wrote in this section at all.", "More of it.")
    claims = s.select("paper_id", "section_id", F.posexplode(F.array(*[F.lit(x) for x in said])).alias("claim_no", "sentence"))
    return review.uncited_claims(s, claims).select("paper_id", "section_id", "claim")


@query(_DIFF_SQL + """ SELECT paper_id, section_id, 'the edited sentence “This is a new sentence without any source in section ' || section_id || '.” may need a citation — no source' AS warning FROM s WHERE section_id % 2 = 0""")
def edit_warnings(spark, sf_dir):
    """A new sentence in every section, flagged in every second one; flags of places that don't exist."""
    d = _diffs(references(spark, sf_dir))
    new = F.concat("old_text", F.lit(" This is a new sentence without any source in section "), "section_id", F.lit(". Short one."))
    key = ["paper_id", "section_id"]
    flags = d.where("section_id % 2 = 0").select(*key, F.posexplode(F.array(F.lit(5), F.lit(0))).alias("flag_no", "index")).withColumn("why", F.lit("no source"))
    return review.post_edit_warnings(d.withColumn("new_text", new), flags, key).select(*key, "warning")


# --- papers as a whole ------------------------------------------------------------------


@query(_STATE_SQL + """, i AS (SELECT *, 'ref' || pos AS ref_id, row_number() OVER (PARTITION BY paper_id, parse_status ORDER BY pos) AS fk, row_number() OVER (PARTITION BY paper_id, resolution_status = 'unverified' AND parse_status <> 'failed' ORDER BY pos) AS uk FROM st),
  g AS (SELECT paper_id, count(*) AS n, count(*) FILTER (parse_status = 'failed') AS f, string_agg(ref_id, ', ' ORDER BY pos) FILTER (parse_status = 'failed' AND fk <= 10) AS fi, count(*) FILTER (resolution_status = 'verified') AS v,
    count(*) FILTER (resolution_status = 'low-confidence') AS l, count(*) FILTER (resolution_status = 'unverified' AND parse_status <> 'failed') AS u, string_agg(ref_id, ', ' ORDER BY pos) FILTER (resolution_status = 'unverified' AND parse_status <> 'failed' AND uk <= 10) AS ui FROM i GROUP BY paper_id)
  SELECT paper_id, 0 AS k, 'warning' AS severity, f || ' reference(s) could not be parsed into fields (kept raw): ' || fi AS message FROM g WHERE f > 0 UNION ALL
  SELECT paper_id, 2, 'info', 'Segmented ' || n || ' entries using the ''bracket'' scheme.' FROM g UNION ALL
  SELECT paper_id, 3, 'info', 'Linked ' || (v + l) || ' reference(s) to Semantic Scholar or OpenAlex (' || v || ' verified, ' || l || ' low-confidence).' FROM g WHERE v + l > 0 UNION ALL
  SELECT paper_id, 4, 'warning', u || ' parsed reference(s) could not be verified against OpenAlex/Semantic Scholar (kept, flagged unverified): ' || ui FROM g WHERE u > 0""")
def diagnostics(spark, sf_dir):
    state, _ = _states(references(spark, sf_dir))
    return papers.diagnostics(_ids(state), "bracket")


@query(_DIFF_SQL + """, t AS (SELECT paper_id, section_id, 'Known [[cite:ref' || lo || ',ref' || hi || ']] fact. Again [[cite:ref' || lo || ']].' AS text FROM s)
  SELECT paper_id, section_id, 5 AS n_words, 3 AS n_citations, '- ' || section_id || ': "Part" (5 words, 3 citations)' AS line FROM t""")
def section_outline(spark, sf_dir):
    d = _diffs(references(spark, sf_dir))
    return papers.outline(d.select("paper_id", "section_id", F.lit("Part").alias("title"), F.col("old_text").alias("text")))


def _findings(refs: DataFrame) -> DataFrame:
    """A finding for every fifth reference of the papers not divisible by three; verdicts for some."""
    p = F.col("pos")
    return _ids(refs).where("paper_id % 3 <> 0 and pos % 5 = 0").select(
        "paper_id", "ref_id", p.cast("int").alias("finding_no"), F.when(p % 2 == 0, "info").otherwise("mismatch").alias("kind"), F.when(p % 10 == 0, "supports").when(p % 15 == 0, "").alias("verdict"),
    )


def _proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("paper_id"), F.col("o_orderkey").alias("proposal_id"), F.col("o_orderkey").alias("seq"), F.when(k == 0, "pending").when(k == 1, "applied").when(k == 2, "rejected").otherwise("undone").alias("status"),
    )


_PAPERS_SQL = f"""WITH {REFS_SQL}, p AS (SELECT c_custkey AS paper_id FROM customer), f AS (SELECT paper_id, 'ref' || pos AS ref_id, pos AS finding_no, CASE WHEN pos % 2 = 0 THEN 'info' ELSE 'mismatch' END AS kind,
    CASE WHEN pos % 10 = 0 THEN 'supports' WHEN pos % 15 = 0 THEN '' END AS verdict FROM refs WHERE paper_id % 3 <> 0 AND pos % 5 = 0),
  o AS (SELECT o_custkey AS paper_id, o_orderkey AS proposal_id, CASE o_orderkey % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'applied' WHEN 2 THEN 'rejected' ELSE 'undone' END AS status FROM orders)"""


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("paper_id"))
    name = F.concat(F.lit("paper_"), F.lpad(F.col("paper_id") % 20, 2, "0"), F.lit("05.12345v2.pdf"))
    return c.select("paper_id", name.alias("filename"), F.when(F.col("paper_id") % 2 == 0, "1987").otherwise("").alias("year"))


@query(_PAPERS_SQL + """ SELECT p.paper_id, coalesce(a.n, 0) AS n_problems, coalesce(b.n, 0) AS n_pending FROM p LEFT JOIN (SELECT paper_id, count(*) FILTER (kind <> 'info') AS n FROM f GROUP BY 1) a ON p.paper_id = a.paper_id
  LEFT JOIN (SELECT paper_id, count(*) FILTER (status = 'pending') AS n FROM o GROUP BY 1) b ON p.paper_id = b.paper_id""")
def paper_counts(spark, sf_dir):
    return papers.counts(_papers(spark, sf_dir), _findings(references(spark, sf_dir)), _proposals(spark, sf_dir))


@query(_PAPERS_SQL + " SELECT paper_id, proposal_id, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY proposal_id DESC) AS INTEGER) AS rank FROM o")
def proposal_history(spark, sf_dir):
    return papers.history(_proposals(spark, sf_dir)).select("paper_id", "proposal_id", "rank")


@query(_PAPERS_SQL + " SELECT paper_id, ref_id, finding_no, verdict FROM f WHERE verdict <> ''")
def reference_verdicts(spark, sf_dir):
    refs = references(spark, sf_dir)
    return papers.verdicts_of(_findings(refs), _ids(refs)).select("paper_id", "ref_id", "finding_no", "verdict")


@query(_PAPERS_SQL + f"""SELECT p.paper_id, CASE WHEN p.paper_id % 2 = 0 THEN '1987' ELSE CAST(2000 + p.paper_id % 20 AS VARCHAR) END AS year, coalesce(b.n, 0) AS n_entries, b.first_entry, CASE WHEN p.paper_id % 4 = 0 THEN -1 ELSE coalesce(g.n, 0) END AS n_findings,
    g.kinds, coalesce(h.ids, '') AS proposals FROM p LEFT JOIN (SELECT paper_id, count(*) AS n, min_by('E' || pos, pos) AS first_entry FROM refs GROUP BY 1) b ON p.paper_id = b.paper_id
  LEFT JOIN (SELECT paper_id, count(*) AS n, string_agg(kind, ',' ORDER BY finding_no) AS kinds FROM f WHERE paper_id % 4 <> 0 GROUP BY 1) g ON p.paper_id = g.paper_id
  LEFT JOIN (SELECT paper_id, string_agg(CAST(proposal_id AS VARCHAR), ',' ORDER BY proposal_id) AS ids FROM o GROUP BY 1) h ON p.paper_id = h.paper_id""")
def paper_payload(spark, sf_dir):
    """The read model; papers divisible by four were never reviewed (-1), others may have no finding (0)."""
    refs, own = references(spark, sf_dir), _papers(spark, sf_dir)
    runs = own.where("paper_id % 4 <> 0")
    out = papers.payload(own, refs.select("paper_id", "pos", F.concat(F.lit("E"), "pos").alias("entry")), runs, _findings(refs).where("paper_id % 4 <> 0"), _proposals(spark, sf_dir))
    kinds = F.when(F.size("findings") > 0, F.array_join(F.transform("findings", lambda x: x["kind"]), ","))
    return out.select(
        "paper_id", "year", F.size("bibliography").cast("long").alias("n_entries"), F.get("bibliography", F.lit(0)).alias("first_entry"), F.coalesce(F.size("findings"), F.lit(-1)).cast("long").alias("n_findings"),
        kinds.alias("kinds"), F.array_join(F.transform("proposals", lambda x: x.cast("string")), ",").alias("proposals"),
    )


@query("""WITH p AS (SELECT c_custkey AS paper_id, CASE WHEN c_custkey % 2 = 0 THEN 'ieee' ELSE 'apa' END AS style, c_custkey % 3 = 0 AS d, CASE c_custkey % 5 WHEN 0 THEN 'apa' WHEN 1 THEN 'ieee' WHEN 2 THEN 'mla' END AS c FROM customer)
  SELECT paper_id, CASE WHEN c IN ('ieee', 'apa') THEN c ELSE style END AS style, d AND c IS DISTINCT FROM 'ieee' AND c IS DISTINCT FROM 'apa' AS style_detected, coalesce(c = 'mla', false) AS refused FROM p""")
def chosen_styles(spark, sf_dir):
    k = F.col("paper_id")
    own = _papers(spark, sf_dir).select("paper_id", F.when(k % 2 == 0, "ieee").otherwise("apa").alias("style"), (k % 3 == 0).alias("style_detected"))
    asked = own.where("paper_id % 5 < 3").select("paper_id", F.when(k % 5 == 0, "apa").when(k % 5 == 1, "ieee").otherwise("mla").alias("style"))
    return papers.with_style(own, asked)


@query(f"""WITH {REFS_SQL}, {ENTRIES_SQL} SELECT paper_id, pos, 'ref' || pos || ': ' || t || ' (' || f || ', ' || yr || ')' AS line FROM ents""")
def prompt_references(spark, sf_dir):
    return qa.reference_lines(_all_parsed(spark, sf_dir))


@query(_DIFF_SQL + """ SELECT paper_id, section_id, 'Start ' || lo AS old_text, CASE section_id % 4 WHEN 1 THEN 'Op1' WHEN 2 THEN 'Op0' ELSE 'Op2' END AS new_text, CASE section_id % 4 WHEN 1 THEN 'n0,n1' WHEN 2 THEN 'n0' ELSE 'n0,n1,n2' END AS notes,
    CASE section_id % 4 WHEN 2 THEN 'Op0' ELSE 'Op1' END AS base_of_last FROM s WHERE section_id % 4 <> 3""")
def folded_edits(spark, sf_dir):
    """Three operations a section, of which some fail; each starts from what was made before it."""
    s = references(spark, sf_dir).groupBy("paper_id", "section_id").agg(F.min("pos").alias("lo"))
    text = s.select("paper_id", "section_id", F.concat(F.lit("Start "), "lo").alias("text"))
    k, n = F.col("section_id") % 4, F.col("op_no")
    ops = s.select("paper_id", "section_id", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("op_no"))
    failed = (k == 3) | ((k == 1) & (n == 2)) | ((k == 2) & (n > 0))
    ops = ops.select("paper_id", "section_id", "op_no", F.when(~failed, F.concat(F.lit("Op"), n)).alias("new_text"), F.array(F.concat(F.lit("n"), n)).alias("notes"))
    diffs, base = edit.folded_operations(ops, text)
    last = base.where("op_no = 2").select("paper_id", "section_id", F.col("base_text").alias("base_of_last"))
    return diffs.join(last, ["paper_id", "section_id"]).select("paper_id", "section_id", "old_text", "new_text", F.array_join("notes", ",").alias("notes"), "base_of_last")


@query(f"""WITH {REFS_SQL}, n AS (SELECT *, CAST(split_part(doi, '/', 1) AS INTEGER) % 3 AS m FROM refs)
  SELECT paper_id, pos, CASE WHEN m < 2 AND pos % 2 = 0 OR m = 2 AND pos % 2 = 1 THEN 'W' || doi END AS work_id FROM n""")
def batch_works(spark, sf_dir):
    """A list of identifiers for each paper; the result has a place for each, found or not."""
    refs = references(spark, sf_dir)
    ask = refs.select("paper_id", "pos", F.when(F.col("pos") % 2 == 0, F.concat(F.lit("doi:10.5555/"), "doi")).otherwise(F.concat(F.lit("ARXIV:9701."), "doi")).alias("key"))
    return resolve.batch_lookup(ask, _catalog(refs)).select("paper_id", "pos", "work_id")


# --- flagship --------------------------------------------------------------------------


@query(f"""WITH {REFS_SQL}, k AS (SELECT paper_id, fam, yr, count(*) AS n FROM refs GROUP BY ALL), a AS (SELECT paper_id, count(*) FILTER (n = 1) AS linked, count(*) FILTER (n > 1) AS ambiguous FROM k GROUP BY 1),
  c AS (SELECT paper_id, count(*) AS heavy FROM (SELECT paper_id, fam FROM (SELECT *, count(*) OVER (PARTITION BY paper_id) AS total FROM refs) GROUP BY paper_id, fam HAVING count(*) >= 4 AND count(*) * 10 >= any_value(total)) GROUP BY 1)
  SELECT a.*, coalesce(heavy, 0) AS heavy_authors FROM a LEFT JOIN c USING (paper_id)""")
def paper_report(spark, sf_dir):
    """Per paper: author-year keys that link, those that are ambiguous, over-represented first authors."""
    refs = references(spark, sf_dir)
    asked = refs.select("paper_id", F.col("fam").alias("surname"), F.col("yr").cast("string").alias("year")).distinct()
    hit = link.author_year_match(asked, _linkable(refs).withColumn("raw", F.lit("")), ["paper_id", "surname", "year"])
    linked = hit.groupBy("paper_id").agg(F.count("ref_id").alias("linked"), F.count_if(F.col("ref_id").isNull()).alias("ambiguous"))
    heavy = review.concentration(refs).groupBy("paper_id").agg(F.count("*").alias("heavy_authors"))
    return linked.join(heavy, "paper_id", "left").na.fill(0, ["heavy_authors"])


FLAGSHIP = "paper_report"
