"""Personal data: patterns propose spans, checksums confirm, context scores.

All of it is built-in SQL functions.  Positions come from cutting the text at
the matches: the lengths of the pieces and of the matches add up to the
offsets, in code points, by a running total that doubles its stride (n log n steps for n matches).  The patterns are written so that no run of
characters is scanned from each of its positions: a match starts at the edge
of a run or right where the last match ended, and repeats that cannot give
characters back are possessive.  Very long texts therefore cost time in
proportion to their length, and to the logarithm of the number of matches.

Kinds email, ip, card and phone are the base and always stay.  Kinds iban
(mod-97) and ssn (structure rules) are added by the method where the score
reaches ``ADD_AT``.

Score of a span: 0.4 for the pattern, 0.4 when a checksum or structure test
confirms it, 0.2 when one of the kind's context words stands within
``WINDOW`` code points before it.

Defined results.  Null text counts as empty: zero counts, empty spans, the hash
of the empty string.  Spans that start together (ties) stand in the order of the kinds above.  Null and repeated doc_id values are passed on, one result
per row.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import let

WINDOW = 40
ADD_AT = 0.75
BASE = ("email", "ip", "card", "phone")
#: Fewest characters of a match of each kind: so many matches back reach over ``WINDOW``.
LEAST = {"email": 5, "ip": 7, "card": 2, "phone": 4, "iban": 15, "ssn": 11}

# The patterns of the kinds, anchored at the edge of a run.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
}
# Words that make a kind likelier when they stand before a span.
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "ip|server|host|address",
    "card": "card|visa|mastercard|credit|payment",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|account|bank|transfer",
    "ssn": "ssn|social|security",
}


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digit string passes: every second digit from the right is
    doubled, nine taken off where that exceeds nine, and ten divides the sum."""
    figures = F.transform(F.split(F.reverse(number), "(?!^)(?=.)"), lambda c: F.expr("0") + c.cast("int"))

    def weigh(d: Column, i: Column) -> Column:
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    total = F.aggregate(F.transform(figures, weigh), F.lit(0), lambda a, b: a + b)
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether the account number leaves 1 when divided by 97."""
    plain = F.regexp_replace(iban, r"\x20", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    rest = F.aggregate(
        F.split(turned, "(?!^)(?=.)"),
        F.lit(0),
        lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97),
    )
    return (rest == 1) & F.char_length(plain).between(15, 34)


def _part_ok(part: Column) -> Column:
    value = F.regexp_replace(part, "^0+(?=.)", "")
    return (F.char_length(value) <= 3) & (F.substring(value, 1, 3).cast("int") <= 255)


def passes(kind: str, m: Column) -> Column:
    """Whether a match is a span at all."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), _part_ok)
    if kind == "card":
        return let(digits(m), lambda d: F.when(F.char_length(d).between(14, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.char_length(digits(m)).between(10, 15)
    if kind == "iban":
        return mod97(m)
    if kind == "ssn":
        return ~m.rlike(r"^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def confirmed(kind: str) -> float:
    """What the checksum or structure test of the kind adds to its score."""
    return {"card": 0.4, "iban": 0.4, "ip": 0.2, "phone": 0.1, "email": 0.2, "ssn": 0.2}[kind]


def running_total(x: Column) -> Column:
    """The sums of the first 1, 2, 3 ... elements.  Pass k adds the element 2**k places before."""
    passes = F.sequence(F.lit(0), F.char_length(F.bin(F.size(x))).cast("int"))

    def add(acc: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.when(F.size(acc) > back, F.transform(acc, lambda v, i: v + F.coalesce(F.get(acc, i - back), F.lit(0)))).otherwise(acc)

    return F.aggregate(passes, x, add)


def spans_of(kind: str, text: Column, hint: Column) -> Column:
    """Array of struct(start, kind_no, kind, end, score) of the passing matches.

    hint is a cheap test without which there can be no match.
    """
    pattern = F.lit(PATTERNS[kind])
    order = list(PATTERNS).index(kind)
    none = F.array().cast("array<struct<start:int,kind_no:int,kind:string,end:int,score:double>>")

    def part(x: Column, i: Column) -> Column:
        return F.substring(F.coalesce(F.get(x, i), F.lit("")), -WINDOW, WINDOW)

    def place(found: Column) -> Column:
        def by_piece(pieces: Column) -> Column:
            def by_end(ends: Column) -> Column:
                def span(m: Column, i: Column) -> Column:
                    end = F.get(ends, i)
                    # What stands before the match: earlier matches and the pieces between.
                    before = [y for k in range(-(-WINDOW // LEAST[kind]), 0, -1) for y in (part(pieces, i - k), part(found, i - k))]
                    near = F.lower(F.substring(F.concat(*before, part(pieces, i)), -WINDOW, WINDOW)).rlike(rf"\b(?:{CONTEXT[kind]})")
                    score = F.round(F.lit(0.4 + confirmed(kind)) + F.when(near, 0.2).otherwise(0.0), 2)
                    keep = passes(kind, m)
                    if kind not in BASE:
                        keep = keep & (score >= ADD_AT)
                    return F.when(
                        keep,
                        F.struct(
                            (end - F.char_length(m)).alias("start"), F.lit(order).alias("kind_no"), F.lit(kind).alias("kind"),
                            end.alias("end"), score.cast("double").alias("score"),
                        ),
                    )

                return F.filter(F.transform(found, span), lambda x: x.isNotNull())

            widths = F.transform(found, lambda m, i: F.char_length(F.get(pieces, i)) + F.char_length(m))
            return let(running_total(widths), by_end)

        cut = F.split(text, PATTERNS[kind], -1)
        return F.when(F.size(found) > 0, let(cut, by_piece)).otherwise(none)

    return F.when(hint, let(F.regexp_extract_all(text, pattern, F.lit(0)), place)).otherwise(none)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and ``pii``: all spans of the text by start, then kind."""
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", t.alias("text"))
    text = F.col("text")
    digit = text.rlike("[0-9]")
    rows = rows.withColumn("has_digit", digit)
    has = F.col("has_digit")
    hints = {
        "email": F.contains(text, F.lit("@")),
        "ip": has & F.contains(text, F.lit(".")),
        "card": has,
        "phone": has & F.contains(text, F.lit("+")),
        "iban": has,
        "ssn": has & F.contains(text, F.lit("-")),
    }
    every = F.concat(*[spans_of(k, text, hints[k]) for k in PATTERNS])
    return rows.select("doc_id", F.sort_array(every).alias("pii"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of base spans and all spans."""
    found = find_pii(docs)
    pii = F.col("pii")

    def count(kind: str) -> Column:
        return F.size(F.filter(pii, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(k) for k in BASE],
        F.sha2(joined(F.filter(pii, lambda s: s["kind_no"] < len(BASE))), 256).alias("base_sha256"),
        joined(pii).alias("spans"),
        F.coalesce(F.array_max(F.transform(pii, lambda s: s["score"])), F.lit(0.0)).alias("max_score"),
    )
