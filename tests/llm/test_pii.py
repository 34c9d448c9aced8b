import hashlib
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.llm import pii
from tests.llm.helpers import docs_frame, odd_docs

PLAIN = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    out = []
    for k, pattern in enumerate(PLAIN):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = (True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), 14 <= len(d) <= 19 and luhn(d), 10 <= len(d) <= 15)[k]
            if ok:
                out.append((m.start(), k, f"{pii.BASE[k]}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def report(spark, rows):
    return {r["doc_id"]: r for r in pii.pii_report(docs_frame(spark, rows)).collect()}


CASES = [
    "mail a.b@c.de, then x@y.z_w@v.u and a@b.c@d.e", "1.2.3.4.5 and 256.1.1.1 and 010.0.0.255 😀 9.9.9.9", "card 4111 1111 1111 1111 or 4111-1111-1111-1112.",
    "call +1 (555) 123-4567 now +49 30 1234567890123", "é@ü.de a@b", "5500005555555559 5500 0055 5555 5559-", None, "", "+1-2-3 +++1234567890)",
]


def test_base_spans_equal_plain_search(spark):
    got = report(spark, list(enumerate(CASES)))
    for i, text in enumerate(CASES):
        assert got[i]["base_sha256"] == hashlib.sha256(brute(text).encode()).hexdigest(), text


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="a1@.-+ ()0_5é", max_size=60), min_size=1, max_size=30))
def test_base_spans_of_random_texts(spark, texts):
    got = report(spark, list(enumerate(texts)))
    for i, text in enumerate(texts):
        assert got[i]["base_sha256"] == hashlib.sha256(brute(text).encode()).hexdigest(), text


def test_checksums_and_context(spark):
    got = report(spark, [(1, "bank account DE89 3704 0044 0532 0130 00 ok"), (2, "account DE89 3704 0044 0532 0130 01 ok"), (3, "my ssn 123-45-6789"), (4, "part 123-45-6789")])
    assert got[1]["spans"] == "iban:13:40"
    assert "iban" not in got[2]["spans"]
    assert got[3]["spans"] == "ssn:7:18"
    assert got[4]["spans"] == ""


def test_context_reaches_over_neighbours(spark):
    """The window is of the text, not of what stands since the last match."""
    got = report(spark, [(1, "my ssn 123-45-6789, 123-45-6788"), (2, "SSN: 123-45-6789, 234-56-7890 345-67-8901"), (3, "ssn " + "x" * 40 + " 123-45-6789"), (4, "tel 1 2 3 4 5 6 7 8 +49 30 1234567")])
    assert got[1]["spans"] == "ssn:7:18,ssn:20:31"
    assert got[2]["spans"] == "ssn:5:16,ssn:18:29,ssn:30:41"
    assert got[3]["spans"] == ""
    assert got[4]["max_score"] == 0.7


def test_texts_of_many_matches(spark):
    text = " ".join(f"user{i}@host{i % 7}.org" for i in range(40_000))
    got = report(spark, [(1, text), (2, text[::-1])])
    for i, t in ((1, text), (2, text[::-1])):
        assert got[i]["base_sha256"] == hashlib.sha256(brute(t).encode()).hexdigest()
    assert got[1]["n_email"] == 40_000


def test_odd_rows(spark):
    rows = pii.pii_report(odd_docs(spark)).collect()
    assert len(rows) == 9
    assert all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in rows)
    assert pii.pii_report(odd_docs(spark).where(F.lit(False))).count() == 0


def test_stays_in_the_jvm(spark):
    plan = pii.pii_report(docs_frame(spark, [(1, "x")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
