"""Text functions on literal cases and against plain Python."""

import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.functions import text as T

RELAXED = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize(
    ("group", "want"),
    [("3", [3]), ("1, 4-6", [1, 4, 5, 6]), ("2–4", [2, 3, 4]), ("5-80", []), ("9-3", []), ("1, 5-80", [1]), ("7—8,2", [7, 8, 2])],
)
def test_expand_numeric(spark, group, want):
    assert one(spark, group, T.expand_numeric) == want


@pytest.mark.parametrize(
    ("chunk", "want"), [("Li, 2023, 2024a,b", ["2023", "2024a", "2024b"]), ("1999", ["1999"]), ("none 3021", []), ("2001a; x", ["2001a"])]
)
def test_year_tokens(spark, chunk, want):
    assert one(spark, chunk, T.year_tokens) == want


@pytest.mark.parametrize(
    ("raw", "year"),
    [
        ("Kim, J. (2011). Things.", 2011), ("Kim. 2012. Things. Place, 1990.", 2012), ("Kim. Things. Place, pages 1914– 1925, 2013.", 2013),
        ("Things 15(1):1929-1958", None), ("no year", None), ("first 1999 then 2003b.", 2003),
    ],
)
def test_extract_year(spark, raw, year):
    assert one(spark, raw, T.extract_year) == year


def test_identifiers(spark):
    assert one(spark, "doi:10.1234/ab.c-9. Next", T.doi) == "10.1234/ab.c-9"
    assert one(spark, "arXiv preprint: 1502.03044", T.arxiv_id) == "1502.03044"
    assert one(spark, "CoRR abs/1409.0473", T.arxiv_id) == "1409.0473"
    assert one(spark, "see abs/1611. 06194 now", T.repair_wrapped_ids) == "see abs/1611.06194 now"
    assert one(spark, "7912", T.year_from_arxiv) == 2079 and one(spark, "8112", T.year_from_arxiv) == 1981


def test_diacritics(spark):
    got = one(spark, "G¨ulc¸ehre, Koutn´ık, P´ eter, C¸ .", T.fix_diacritics)
    assert got == unicodedata.normalize("NFC", "Gülçehre, Koutník, Péter, Ç.")


def test_hyphens(spark):
    f = lambda x: T.join_hyphenated(F.split(x, r"\|"))
    assert one(spark, "trans-|formers are|state-of-the-|art", f) == "transformers are state-of-the-art"
    assert one(spark, "see arXiv:1611.|06194 ok| |Pre-|Trained", f) == "see arXiv:1611.06194 ok Pre- Trained"


def test_names_and_titles(spark):
    assert one(spark, "G. Hinton, Y. LeCun, and Y. Bengio", T.looks_like_name_list)
    assert not one(spark, "Show, Attend and Tell: neural captions", T.looks_like_name_list)
    assert one(spark, "A Study of Very Deep Nets", T.looks_like_title)
    assert not one(spark, "In CoNLL", T.looks_like_title)
    assert not one(spark, "Quoc V.", T.looks_like_title)
    got = one(spark, "Laurens van der Maaten, G. Hinton and AI@Meta", T.split_authors)
    assert [(a["family"], a["given"], a["literal"]) for a in got] == [("van der Maaten", "Laurens", None), ("Hinton", "G", None), (None, None, "AI@Meta")]


def test_similarity_and_classes(spark):
    pair = spark.createDataFrame([("Deep nets for all", "deep nets for all people everywhere"), ("a b", "Neural nets"), ("one two", "one two three"), ("", "x y")], "a string, b string")
    assert [r[0] for r in pair.select(T.title_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 2 / 3, 0.0]
    rows = spark.createDataFrame(
        [(0.7, True, True, "rejected"), (0.8, False, True, "low-confidence"), (0.8, None, True, "verified"), (0.8, None, None, "low-confidence"), (0.95, None, None, "verified"), (0.95, None, False, "low-confidence")],
        "s double, y boolean, a boolean, want string",
    )
    assert all(r[0] == r[1] for r in rows.select(T.classify_match(F.col("s"), F.col("y"), F.col("a")), "want").collect())


@RELAXED
@given(st.lists(st.text(alphabet="abAB01 é-", max_size=25), min_size=2, max_size=8))
def test_similarity_is_symmetric(spark, texts):
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    for x, y in df.select(T.title_similarity(F.col("a"), F.col("b")), T.title_similarity(F.col("b"), F.col("a"))).collect():
        assert x == y and 0 <= x <= 1


@RELAXED
@given(st.lists(st.lists(st.integers(1, 99), min_size=1, max_size=4), max_size=5))
def test_tokens_round_trip(spark, groups):
    text = " and ".join("[[cite:" + ",".join(f"ref{i}" for i in g) + "]]" for g in groups)
    assert one(spark, text, T.extract_tokens) == [f"ref{i}" for g in groups for i in g]


@RELAXED
@given(st.lists(st.text(alphabet="ab.!? \n", max_size=40), min_size=1, max_size=10))
def test_sentences_equal_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "x string").select("x", T.split_sentences(F.col("x")).alias("y"))
    assert all(r["y"] == re.split(r"(?<=[.!?])\s+", r["x"]) for r in df.collect())


def test_latex_and_labels(spark):
    assert one(spark, r"50% of a_b \ {x} ~^", T.latex_escape) == r"50\% of a\_b \textbackslash{} \{x\} \textasciitilde{}\textasciicircum{}"
    assert one(spark, "so  [[cite:ref1,ref2]] & on", T.text_to_latex) == "so~\\cite{ref1,ref2} \\& on"
    assert one(spark, r"a\b {c} & 5%", T.bibtex_escape) == r"ab \{c\} \& 5\%"
    assert one(spark, "[1]|[2]", lambda x: T.chip_label(F.split(x, r"\|"))) == "[1][2]"
    assert one(spark, "(A, 1999)|[2]", lambda x: T.chip_label(F.split(x, r"\|"))) == "(A, 1999; [2])"
    assert one(spark, "It works! ", lambda x: T.insert_citation(x, F.lit("[[cite:ref3]]"))) == "It works [[cite:ref3]]!"
    assert one(spark, "https://doi.org/10.1/arxiv.org", T.link_label) == "doi"
