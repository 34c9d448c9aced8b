"""Text functions as Column expressions.

Java's ``\\w`` and ``\\s`` are ASCII unless ``(?U)`` stands in front, so every
pattern that touches names carries it.  All of these are built-ins, evaluated in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The grammar of markers, tokens and identifiers.
NUMERIC_MARKER = r"\[(\d{1,3}(?:\s*[,–—-]\s*\d{1,3})*)\]"
PAREN_MARKER = (
    r"\((?=[^()]*\d{4})([A-Z][^()]{0,150}?\d{4}[a-z]?(?:,\s*p+\.\s*[\d–-]+)?"
    r"(?:;\s*[^();]{0,150}?\d{4}[a-z]?)*)\)"
)
NARRATIVE_MARKER = (
    r"(?U)\b([A-Z][\w'@.&-]+)(?:\s+et al\.?|\s+(?:and|&)\s+[A-Z][\w'\-]+)?"
    r"\s+\(((?:19|20)\d{2}[a-z]?)\)"
)
YEAR_TOKEN = r"((?:19|20)\d{2})([a-z])?((?:\s*,\s*[a-z]\b)*)"
SURNAME = r"(?U)[A-Z][\w'@.&-]+"
TOKEN = r"\[\[cite:([A-Za-z0-9_,-]+)\]\]"
DOI = r"(?i)\b(10\.\d{4,9}/[^\s,;]+)"
ARXIV = r"(?i)arxiv\D{0,15}(\d{4}\.\d{4,5})"
CORR = r"(?i)\babs[/:]\s*(\d{4}\.\d{4,5})"
URL = r"https?://[^\s,;]+"
SPLIT_ID = r"(?i)((?:arxiv:|abs/|arxiv\.org/abs/)\d{4}\.)\s+(\d{4,5})"
PAREN_YEAR = r"\(((?:19|20)\d{2})[a-z]?\)"
SENTENCE_YEAR = r"\.\s*((?:19|20)\d{2})[a-z]?\.\s+"
#: A year that is no part of a number range: nothing like "-" or ":" before or a dash after it.
FREE_YEAR = r"(?<![-–—:])(?<![-–—:]\s)(?<![-–—:]\s\s)\b((?:19|20)\d{2})[a-z]?\b(?![-–—])"
ENTRY_MARKER = r"^(?:\[\d+\]|\d{1,3}\.)\s*"
TRAILING_JUNK = (
    r"\s+(?=(?:Figure|Table|Fig\.|Tab\.)\s*\d|APPENDICES\b|Appendix\s+[A-Z0-9]|"
    r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\s+Visualizations?\b)"
)
NAME_TOKEN = r"(?U)^(?:[A-Z][\w'À-ſ\-]*\.?|and|&|et|al\.?|[A-Z]\.)$"
FUNCTION_WORDS = ("a", "an", "the", "of", "for", "in", "on", "to", "with", "from", "using", "via", "into", "over", "by", "at")
PARTICLES = ("van", "von", "der", "den", "de", "del", "della", "da", "di", "la", "le", "ter", "ten", "dos", "du")
JOURNAL = r"(?U)([A-Z][\w.\-&\s]{2,60}?),\s*(\d{1,4})\s*(?:\((\d[\d\-–]*)\))?:(\d+(?:[\-–]\s?\d+)?)"
VENUE = (
    r"(?U)\bIn\s+(?:Proceedings of\s+(?:the\s+)?)?([A-Z][\w&()\-\s.]{2,80}?)"
    r"(?=,\s*(?:19|20)\d{2}|,\s*(?:pages?|pp)\b|,\s*vol\b|\.\s|\.$|$)"
)
MAX_AUTHORS = 25
MATCH, NEAR_PERFECT = 0.75, 0.9


def strip(x: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def strip_chars(x: Column, chars: str) -> Column:
    """Without any of chars at the ends; chars as in a character class."""
    return F.regexp_replace(x, rf"^[{chars}]+|[{chars}]+$", "")


def words(x: Column) -> Column:
    """Runs without white space."""
    return F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")


def split_sentences(x: Column) -> Column:
    """Parts after '.', '!' or '?' and white space."""
    return F.split(x, r"(?<=[.!?])\s+")


def expand_numeric(group: Column) -> Column:
    """Numbers of '1, 4-6'; a range of 50 or more, or reversed, gives none."""

    def one(part: Column) -> Column:
        p = strip(part)
        lo = F.regexp_extract(p, r"^(\d+)\s*[–—-]\s*(\d+)$", 1)
        hi = F.regexp_extract(p, r"^(\d+)\s*[–—-]\s*(\d+)$", 2)
        a, b = lo.try_cast("int"), hi.try_cast("int")
        none = F.array().cast("array<int>")
        return (
            F.when(p.rlike(r"^\d+$"), F.array(p.try_cast("int")))
            .when((lo != "") & (b >= a) & (b - a < 50), F.sequence(a, F.greatest(a, b)))
            .otherwise(none)
        )

    return F.flatten(F.transform(F.split(group, "[,;]"), one))


def year_tokens(chunk: Column) -> Column:
    """'2023, 2024a,b' as 2023, 2024a, 2024b."""
    found = F.regexp_extract_all(chunk, F.lit(YEAR_TOKEN), F.lit(0))

    def letters(m: Column) -> Column:
        year = F.substring(m, 1, 4)
        tail = F.regexp_extract_all(F.substring(m, 5, 200), F.lit("[a-z]"), F.lit(0))
        return F.when(F.size(tail) == 0, F.array(year)).otherwise(F.transform(tail, lambda c: F.concat(year, c)))

    return F.flatten(F.transform(found, letters))


def author_tokens(family: Column, given: Column, literal: Column) -> Column:
    """Names of a first author that a surname may equal, lower case."""
    name = r"(?U)[A-Za-z][\w'\-]{2,}"
    fam, lit = F.lower(F.coalesce(family, F.lit(""))), F.lower(F.coalesce(literal, F.lit("")))
    full = F.concat_ws(" ", F.coalesce(given, F.lit("")), F.coalesce(family, F.lit("")))
    of_full = F.transform(F.regexp_extract_all(full, F.lit(name), F.lit(0)), F.lower)
    last = F.slice(of_full, F.greatest(F.size(of_full) - 2, F.lit(1)), F.lit(3))
    every = F.concat(F.array(fam, lit), F.regexp_extract_all(lit, F.lit(name), F.lit(0)), last)
    return F.array_remove(F.array_distinct(every), "")


def extract_tokens(x: Column) -> Column:
    """Reference ids in the citation tokens of a text, in order, with repeats."""
    groups = F.regexp_extract_all(x, F.lit(TOKEN), F.lit(1))
    return F.array_remove(F.flatten(F.transform(groups, lambda g: F.split(g, ","))), "")


def repair_wrapped_ids(x: Column) -> Column:
    return F.regexp_replace(x, SPLIT_ID, "$1$2")


def null_if_empty(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def doi(x: Column) -> Column:
    return null_if_empty(F.regexp_replace(F.regexp_extract(x, DOI, 1), r"\.+$", ""))


def url(x: Column) -> Column:
    return null_if_empty(F.regexp_replace(F.regexp_extract(x, URL, 0), r"\.+$", ""))


def arxiv_id(x: Column) -> Column:
    return F.coalesce(null_if_empty(F.regexp_extract(x, ARXIV, 1)), null_if_empty(F.regexp_extract(x, CORR, 1)))


def year_from_arxiv(identifier: Column, pivot: int = 80) -> Column:
    yy = F.substring(identifier, 1, 2).try_cast("int")
    return F.when(yy < pivot, yy + 2000).otherwise(yy + 1900)


def extract_year(x: Column) -> Column:
    """A year in parentheses, else one that is a sentence, else the last free one."""
    free = F.regexp_extract_all(x, F.lit(FREE_YEAR), F.lit(1))
    return F.coalesce(
        null_if_empty(F.regexp_extract(x, PAREN_YEAR, 1)),
        null_if_empty(F.regexp_extract(x, SENTENCE_YEAR, 1)),
        F.try_element_at(free, F.lit(-1)),
    ).try_cast("int")


def infer_year(filename: Column, page_one: Column) -> Column:
    """Year from an arXiv file name, else a venue with year on page one, else ''."""
    yy = F.regexp_extract(filename, r"(?:^|[^\d])(\d{2})\d{2}\.\d{4,5}", 1)
    venue = (
        r"(?i)(?:©|copyright|\b(?:ICLR|NeurIPS|NIPS|ICML|ACL|EMNLP|NAACL|EACL|COLING|CVPR|ICCV|ECCV|AAAI|IJCAI|KDD|WWW|CHI)\b)"
        r"\s+((?:19|20)\d{2})"
    )
    return F.when(yy != "", year_from_arxiv(yy, 90).cast("string")).otherwise(F.regexp_extract(page_one, venue, 1))


def looks_like_name_list(x: Column) -> Column:
    parts = F.filter(F.split(strip_chars(x, r" ."), r"[\s,]+"), lambda w: w != "")
    lower = F.transform(parts, lambda w: F.lower(strip_chars(w, ".,;:")))
    namey = F.size(F.filter(parts, lambda w: w.rlike(NAME_TOKEN)))
    return (
        ~F.contains(x, F.lit(":")) & F.contains(x, F.lit(",")) & (F.size(parts) > 0)
        & ~F.arrays_overlap(lower, F.array(*[F.lit(w) for w in FUNCTION_WORDS]))
        & (namey * 10 >= F.size(parts) * 8)
    )


def looks_like_title(x: Column) -> Column:
    s = F.regexp_replace(strip(x), r"\.+$", "")
    return (
        (F.char_length(s) >= 8) & (F.size(words(s)) >= 2) & ~s.rlike(r"(?U)\b[A-Z][^\w\s]{0,2}$")
        & ~looks_like_name_list(s) & ~s.rlike(r"^In\s+[A-Z]")
    )


def split_authors(segment: Column) -> Column:
    """Array of (family, given, literal) of an author segment."""
    parts = F.split(F.regexp_replace(segment, r"\b(?:and|&)\b", ","), r",\s*")
    parts = F.filter(F.transform(parts, lambda p: strip_chars(p, r" .")), lambda p: (F.char_length(p) >= 2) & p.rlike("[A-Za-z]{2}"))
    blank = F.lit(None).cast("string")

    def name(p: Column) -> Column:
        w = words(p)
        small = F.array_position(
            F.transform(w, lambda x, i: (i > 0) & (i < F.size(w) - 1) & F.lower(x).isin(*PARTICLES)), F.lit(True)
        ).cast("int")
        caps = F.filter(w, lambda x: x.rlike(r"(?U)^\p{Lu}") & (F.char_length(strip_chars(x, ".")) > 1))
        family = F.when(F.size(caps) > 0, F.element_at(caps, -1)).otherwise(F.element_at(w, -1))
        plain = F.struct(
            strip_chars(family, ".").alias("family"),
            strip_chars(F.replace(p, family, F.lit("")), r" ,.").alias("given"), blank.alias("literal"),
        )
        particled = F.struct(
            strip_chars(F.array_join(F.slice(w, F.greatest(small, F.lit(1)), F.size(w)), " "), ".").alias("family"),
            strip_chars(F.array_join(F.slice(w, 1, F.greatest(small - 1, F.lit(0))), " "), r" ,.").alias("given"), blank.alias("literal"),
        )
        org = F.struct(blank.alias("family"), blank.alias("given"), p.alias("literal"))
        return F.when(F.contains(p, F.lit("@")) | p.rlike(r"[A-Za-z]-AI\b"), org).when(small > 0, particled).otherwise(plain)

    return F.slice(F.transform(parts, name), 1, MAX_AUTHORS)


def venue(rest: Column) -> Column:
    """Struct (container_title, volume, issue, page, type) of the text after a title."""
    journal = strip(F.regexp_extract(rest, JOURNAL, 1))
    place = F.regexp_replace(strip(F.regexp_extract(rest, VENUE, 1)), "[,.]+$", "")
    is_journal, is_place = journal != "", F.char_length(place).between(3, 80)

    def of_journal(k: int) -> Column:
        return F.when(is_journal, null_if_empty(F.regexp_extract(rest, JOURNAL, k)))

    return F.struct(
        F.when(is_journal, journal).when(is_place, place).alias("container_title"),
        of_journal(2).alias("volume"), of_journal(3).alias("issue"), F.replace(of_journal(4), F.lit(" "), F.lit("")).alias("page"),
        F.when(~is_journal & is_place, F.lit("paper-conference")).alias("type"),
    )


def strip_trailing_junk(x: Column) -> Column:
    """Cut at figure, table, appendix or visualization text after an entry."""
    return strip(F.get(F.split(x, TRAILING_JUNK, 2), F.lit(0)))


def norm_title(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]", "")


def title_tokens(x: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit("[A-Za-z0-9]{2,}"), F.lit(0))
    return F.array_distinct(F.transform(found, F.lower))


def set_similarity(a: Column, b: Column) -> Column:
    """Overlap by the larger set; 1 where a smaller set of three or more lies in the other."""
    n = F.size(F.array_intersect(a, b))
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    return F.when(small == 0, F.lit(0.0)).when((n == small) & (small >= 3), F.lit(1.0)).otherwise(n / F.greatest(large, F.lit(1)))


def title_similarity(a: Column, b: Column) -> Column:
    return set_similarity(title_tokens(a), title_tokens(b))


def corroborate(local_year: Column, year: Column, raw: Column, family: Column) -> tuple[Column, Column]:
    """(year_ok, author_ok): true agrees, false contradicts, null unknown."""
    year_ok = F.when((local_year != 0) & (year != 0), F.abs(local_year - year) <= 1)
    last = F.element_at(F.split(strip(F.coalesce(family, F.lit(""))), r"(?U)\s+"), -1)
    author_ok = F.when(F.char_length(last) > 2, F.contains(F.lower(F.coalesce(raw, F.lit(""))), F.lower(last)))
    return year_ok, author_ok


def classify_match(score: Column, year_ok: Column, author_ok: Column) -> Column:
    return (
        F.when(score < MATCH, "rejected")
        .when((year_ok == F.lit(False)) | (author_ok == F.lit(False)), "low-confidence")
        .when(year_ok | author_ok, "verified")
        .when(score >= NEAR_PERFECT, "verified")
        .otherwise("low-confidence")
    )


# Spacing accents and the combining marks they stand for.
ACCENTS = {
    "\u00a8": "\u0308", "\u00b4": "\u0301", "\u0060": "\u0300", "\u02c6": "\u0302", "\u02dc": "\u0303",
    "\u02c7": "\u030c", "\u02da": "\u030a", "\u00af": "\u0304", "\u02dd": "\u030b",
}


def fix_diacritics(x: Column) -> Column:
    """Spacing accent and letter composed into one letter, detached cedillas and
    initial periods re-attached.

    Spark has no Unicode normalisation: the accent becomes a combining mark behind
    its letter, then each pair that Unicode can compose is replaced by
    the letter, tried only on texts that hold the mark.
    """
    import string
    import unicodedata

    def composed(accent: str, mark: str):
        def of(text: Column) -> Column:
            fixed = F.regexp_replace(F.regexp_replace(text, f"{accent}\\s?\u0131", f"{accent}i"), f"{accent}\\s?([A-Za-z])", f"$1{mark}")
            for base in string.ascii_letters:
                whole = unicodedata.normalize("NFC", base + mark)
                if len(whole) == 1:
                    fixed = F.replace(fixed, F.lit(base + mark), F.lit(whole))
            return F.when(F.contains(text, F.lit(accent)), fixed).otherwise(text)

        return of

    out = x
    for accent, mark in ACCENTS.items():
        # A name for the text so far: each accent uses it three times.
        out = F.get(F.transform(F.array(out), composed(accent, mark)), F.lit(0))
    for base in "csgCSG":
        out = F.regexp_replace(out, f"{base}\\s?\u00b8", unicodedata.normalize("NFC", base + "\u0327"))
    return F.regexp_replace(out, r"(?U)(?<![\w.])([A-Z\u00c0-\u00de])\s\.", "$1.")


def join_hyphenated(parts: Column) -> Column:
    """Wrapped lines as one text: hyphens at line ends repaired, split ids joined."""

    def step(out: Column, part: Column) -> Column:
        p = strip(part)
        last = F.element_at(F.split(F.regexp_replace(out, "-+$", ""), " "), -1)
        return (
            F.when(p == "", out)
            .when(out == "", p)
            .when(out.endswith("-") & p.rlike(r"^\p{Ll}"), F.when(F.contains(last, F.lit("-")), F.concat(out, p)).otherwise(F.concat(F.left(out, F.char_length(out) - 1), p)))
            .when(out.rlike(r"(?i)(?:arxiv:|abs/|arxiv\.org/abs/)\d{4}\.$") & p.rlike(r"^\d{4,5}\b"), F.concat(out, p))
            .otherwise(F.concat(out, F.lit(" "), p))
        )

    return F.aggregate(parts, F.lit(""), step)


def latex_escape(x: Column) -> Column:
    """The ten special characters; the backslash goes first, by way of a placeholder."""
    out = F.replace(x, F.lit("\\"), F.lit("\u0000"))
    for c in "&%$#_{}":
        out = F.replace(out, F.lit(c), F.lit("\\" + c))
    for c, name in (("~", "asciitilde"), ("^", "asciicircum"), ("\u0000", "backslash")):
        out = F.replace(out, F.lit(c), F.lit(f"\\text{name}{{}}"))
    return out


def text_to_latex(x: Column) -> Column:
    """Escaped text with citation tokens as cite commands, spaces before them removed."""
    pieces = F.split(x, TOKEN, -1)
    keys = F.regexp_extract_all(x, F.lit(TOKEN), F.lit(1))
    parts = F.transform(
        pieces,
        lambda p, i: F.when(
            i < F.size(keys), F.concat(F.regexp_replace(latex_escape(p), r"(?U)\s+$", ""), F.lit("~\\cite{"), F.get(keys, i), F.lit("}"))
        ).otherwise(latex_escape(p)),
    )
    return F.array_join(parts, "")


def bibtex_escape(x: Column) -> Column:
    out = F.replace(x, F.lit("\\"), F.lit(""))
    for c in "{}&%":
        out = F.replace(out, F.lit(c), F.lit("\\" + c))
    return out


def qa_plain(x: Column) -> Column:
    """A section's text without tokens, at most 2600 characters."""
    return F.substring(F.regexp_replace(x, TOKEN, ""), 1, 2600)


def qa_sentence(x: Column) -> Column:
    """White space single, none before punctuation."""
    return F.regexp_replace(F.array_join(words(x), " "), r"\s+([.,;:!?])", "$1")


def chip_label(labels: Column) -> Column:
    """Labels that all start with '[' run together, others as '(a; b)'."""
    plain = F.transform(labels, lambda x: F.regexp_replace(x, r"^\(|\)$", ""))
    return F.when(F.forall(labels, lambda x: x.startswith("[")), F.array_join(labels, "")).otherwise(
        F.concat(F.lit("("), F.array_join(plain, "; "), F.lit(")"))
    )


def insert_citation(sentence: Column, token: Column) -> Column:
    """The token before a final '.', '!' or '?', else at the end."""
    s = F.regexp_replace(sentence, r"(?U)\s+$", "")
    inside = F.concat(F.left(s, F.char_length(s) - 1), F.lit(" "), token, F.right(s, F.lit(1)))
    return F.when(s.rlike("[.!?]$"), inside).otherwise(F.concat(s, F.lit(" "), token))


def is_search_url(x: Column) -> Column:
    return F.coalesce(F.contains(x, F.lit("/search")), F.lit(False))


def best_url(provenance_url: Column, csl_url: Column, doi_: Column, number: Column, ui_order: bool = False) -> Column:
    """The paper page of a reference, never a search listing; '' if there is none."""
    own = F.when(~is_search_url(provenance_url), null_if_empty(provenance_url))
    link = F.when(csl_url.startswith("http") & ~is_search_url(csl_url), csl_url)
    by_doi = F.concat(F.lit("https://doi.org/"), null_if_empty(doi_))
    by_arxiv = F.when(F.lower(number).startswith("arxiv:"), F.concat(F.lit("https://arxiv.org/abs/"), F.substring(number, 7, 100)))
    order = (own, by_doi, by_arxiv, link) if ui_order else (own, link, by_doi, by_arxiv)
    return F.coalesce(*order, F.lit(""))


def link_label(x: Column) -> Column:
    return (
        F.when(F.contains(x, F.lit("doi.org")), "doi")
        .when(F.contains(x, F.lit("arxiv.org")), "arXiv")
        .when(F.contains(x, F.lit("semanticscholar.org")), "Semantic Scholar")
        .when(F.contains(x, F.lit("openalex.org")), "OpenAlex")
        .otherwise("open paper")
    )
