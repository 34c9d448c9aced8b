"""Secret scan: base patterns, and a randomness battery under false-discovery control.

Candidates are runs of at least ``MIN_RUN`` characters of
``[A-Za-z0-9+/_=-]`` with letters and digits.  For each, the narrowest encoding
that covers it (hex, base32, base36, base62, base64, base64url) is inferred, with ``=`` as padding
only.  A run that none covers is cut after each ``=`` and, where that leaves both ``+/`` and ``-_``, at
the symbols of one base64; parts of ``MIN_RUN`` characters are candidates of their own, and without any the
run is one of encoding ``mixed``.  The battery takes three statistics of a candidate, each near
standard normal for random symbols of its encoding: chi-squared of a uniform alphabet, the runs about the
median symbol, and the serial correlation.  None may reject randomness at ``ALPHA`` after Bonferroni's correction.

The null hypothesis of the false-discovery control is natural text: letters by their frequency in
sticky character classes.  How the three statistics spread there depends on encoding and length; mean and
deviation come from ``DRAWN`` texts of that model at the lengths of a grid.  Each statistic then gives
a likelihood ratio of random symbols against text, as does the run's symbol sequence itself.  Their geometric
mean is an e-value (its expectation under the null is 1 at most, however the four depend on each other, as far as the
normal shape holds), so p = min(1, 1/e) is a valid p-value by Markov's inequality, which falls with length as the evidence grows.
Benjamini and Hochberg's procedure at level ``FDR`` runs apart in each band of lengths
over all candidates of the corpus: the p-values are counted in bins of a tenth
of a decade per band, a table of bounded size, so no candidate goes to the driver.

Added spans have the kind ``random`` and never overlap a base span.

Defined results.  Null text counts as empty: zero counts, no spans.  Repeated
rows are judged row by row.  An empty table gives an empty result.  Other columns
are not read.  Very long runs of one encoding are one candidate, tested whole.  Candidates with equal
evidence (ties) are accepted or not together.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from functools import cache
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import staged

MIN_RUN = 20
ALPHA = 0.001
FDR = 0.01
BIN = 0.1
MAX_BIN = 400
#: Bands of candidate lengths, by their least length.
BANDS = (20, 24, 32, 48, 64, 128)
STICK = 0.85
#: Texts drawn per encoding and length to learn how the battery spreads on text, and the lengths.
DRAWN = 240
LENGTHS = (20, 26, 34, 48, 72, 128, 256, 1024)
#: Most that one statistic says for or against text, in natural logarithms.
MOST = 30.0

BASE = ("assign", "access", "hex")
# The base patterns; letters of the assign key words in either case.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_RUN)
# The alphabets of the encodings, narrowest first.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "mixed": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_=",
}
# The symbols of one base64, with padding.
ONE_BASE64 = re.compile(r"[A-Za-z0-9+/]*=*|[A-Za-z0-9_-]*=*")
PADDED = re.compile(r"[^=]+=*|=+")
STANDARD, URL_SAFE = re.compile(r"[A-Za-z0-9+/]+=*"), re.compile(r"[A-Za-z0-9_-]+=*")
# Letter frequencies of English text, a to z, in thousandths.
LETTERS = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)


def _tables():
    code = {}
    for name, alphabet in ALPHABETS.items():
        t = np.full(128, -1, np.int16)
        t[np.frombuffer(alphabet.encode(), np.uint8)] = np.arange(len(alphabet))
        code[name] = t
    log_in = np.full(128, math.log(1 / 5))  # symbols
    kind = np.full(128, 3)
    for i, n in enumerate(LETTERS):
        log_in[97 + i] = log_in[65 + i] = math.log(n / sum(LETTERS))
        kind[97 + i], kind[65 + i] = 0, 1
    log_in[48:58], kind[48:58] = math.log(1 / 10), 2
    return code, log_in, kind


CODE, LOG_IN, KIND = _tables()


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def encoding(raw: np.ndarray) -> tuple[str, np.ndarray]:
    """The narrowest encoding of a run without padding, and its symbols' numbers."""
    for name, table in CODE.items():
        x = table[raw]
        if (x >= 0).all():
            break
    return name, x


def statistics(x: np.ndarray, size: int) -> tuple[float, float, float]:
    """Chi-squared, runs and serial correlation of symbol numbers, each near standard normal if random."""
    n = len(x)
    expected = n / size
    chi = float((np.bincount(x, minlength=size) ** 2).sum() / expected - n)
    # Wilson and Hilferty: the cube root of chi-squared over its freedom is near normal.
    free = size - 1
    z = ((max(chi, 0) / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))
    high = x >= size / 2
    a, b = int(high.sum()), int(n - high.sum())
    runs = 1 + int((high[1:] != high[:-1]).sum())
    mean = 2 * a * b / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    y = x - x.mean()
    power = float((y * y).sum())
    return (
        z,
        (runs - mean) / math.sqrt(var) if var > 0 else -MOST,
        float((y[1:] * y[:-1]).sum()) / power * math.sqrt(n) if power else MOST,
    )


@cache
def _on_text(name: str, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of the statistics on the text model, at a length of the grid."""
    rng = np.random.default_rng([len(name), length, *name.encode()])
    symbols = np.frombuffer(ALPHABETS[name].encode(), np.uint8)
    classes = [symbols[KIND[symbols] == k] for k in range(4)]
    weight = [np.exp(LOG_IN[c]) / np.exp(LOG_IN[c]).sum() if len(c) else None for c in classes]
    there = [k for k in range(4) if len(classes[k])]
    out = []
    for _ in range(DRAWN):
        switch = rng.random(length) >= STICK
        turn = np.cumsum(switch)
        # The class of each stretch, by steps to another class.
        steps = rng.integers(1, max(2, len(there)), turn[-1] + 1)
        order = (rng.integers(0, len(there)) + np.cumsum(steps)) % len(there)
        kinds = np.array(there)[order[turn]]
        raw = np.empty(length, np.uint8)
        for k in there:
            at = np.flatnonzero(kinds == k)
            raw[at] = rng.choice(classes[k], len(at), p=weight[k])
        out.append(statistics(CODE[name][raw], len(symbols)))
    x = np.clip(np.array(out), -1e3, 1e3)
    return x.mean(axis=0), np.maximum(x.std(axis=0), 0.5)


def against_text(name: str, n: int, stats: tuple[float, float, float]) -> list[float]:
    """Per statistic the log likelihood ratio of random symbols against text."""
    k = min(range(len(LENGTHS)), key=lambda i: abs(math.log(LENGTHS[i] / n)))
    mean, dev = _on_text(name, LENGTHS[k])
    out = []
    for z, m, s in zip(stats, mean.tolist(), dev.tolist(), strict=True):
        ratio = -z * z / 2 + ((z - m) / s) ** 2 / 2 + math.log(s)
        out.append(max(-MOST, min(MOST, ratio)))
    return out


def battery(run: str) -> tuple[str, float, float]:
    """Encoding, p-value of randomness, and the log of the e-value against text."""
    raw = np.frombuffer(run.rstrip("=").encode(), np.uint8)
    if len(raw) < 2:
        return "base64", 0.0, -1.0
    name, x = encoding(raw)
    n, size = len(x), len(ALPHABETS[name])
    z = statistics(x, size)
    p_chi = _normal_tail(z[0]) / 2 if z[0] > 0 else 1.0
    kinds = KIND[raw]
    switches = int((kinds[1:] != kinds[:-1]).sum())
    words = float(LOG_IN[raw].sum()) + switches * math.log((1 - STICK) / 3) + (n - 1 - switches) * math.log(STICK)
    ratios = [*against_text(name, n, z), -n * math.log(size) - words]
    return name, min(1.0, 3 * min(p_chi, _normal_tail(z[1]), _normal_tail(z[2]))), sum(ratios) / len(ratios)


def parts_of(run: str) -> list[tuple[int, int]]:
    """(start, end) of the candidates in a run: the run itself if one base64 covers it."""
    if ONE_BASE64.fullmatch(run):
        return [(0, len(run))]
    out = []
    for m in PADDED.finditer(run):
        cuts = [[m.span()]]
        if not ONE_BASE64.fullmatch(m[0]):
            cuts = [[(m.start() + x.start(), m.start() + x.end()) for x in p.finditer(m[0])] for p in (STANDARD, URL_SAFE)]
        out += max(cuts, key=lambda c: max((e - s for s, e in c), default=0))
    return [(s, e) for s, e in out if e - s >= MIN_RUN] or [(0, len(run))]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base kinds."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, runs: list[re.Match], base: list[tuple[int, int, int]]):
    """(start, end, encoding, bin) of the runs that stand apart from base spans (sorted by start)."""
    starts = [s for s, _, _ in base]
    ends = list(accumulate((e for _, _, e in base), max))
    for m in runs:
        for lo, hi in parts_of(m[0]):
            run, start, end = m[0][lo:hi], m.start() + lo, m.start() + hi
            if not (re.search("[0-9]", run) and re.search("[A-Za-z]", run)):
                continue
            before = bisect_left(starts, end)
            if before and ends[before - 1] > start:
                continue
            name, random, evidence = battery(run)
            score = max(0.0, evidence) / math.log(10) if random >= ALPHA else 0.0
            yield start, end, name, min(MAX_BIN, int(score / BIN))


def band(length) -> F.Column:
    out = F.lit(0)
    for i, least in enumerate(BANDS):
        out = F.when(length >= least, i).otherwise(out) if i else out
    return out


def _scan(batches):
    import pandas as pd

    for pdf in batches:
        rows = []
        for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
            text = text or ""
            runs = list(RUN.finditer(text))
            # Every hex span lies in a run, an assigned value need not.
            low = text.lower() if runs or "AKIA" in text else None
            base = base_spans(text) if runs or "AKIA" in text or any(k in (low or text.lower()) for k in KEYS) else []
            cand = [dict(zip(("start", "end", "encoding", "bin"), c, strict=True)) for c in candidates(text, runs, base)]
            rows.append((doc_id, [{"start": s, "kind": k, "end": e} for s, k, e in base], cand))
        out = pd.DataFrame(rows, columns=["doc_id", "base", "cand"])
        out["doc_id"] = out["doc_id"].astype("Int64")
        yield out


def thresholds(scanned: DataFrame) -> list[int]:
    """Per band the least bin to accept, from the counts of all candidates."""
    c = F.explode("cand").alias("c")
    counted = (
        scanned.select(c)
        .groupBy(band(F.col("c.end") - F.col("c.start")).alias("band"), F.col("c.bin").alias("bin"))
        .agg(F.count("*").alias("n"))
        .collect()  # at most len(BANDS) * (MAX_BIN + 1) rows
    )
    least = []
    for k in range(len(BANDS)):
        own = {r["bin"]: r["n"] for r in counted if r["band"] == k}
        total, upto, accept = sum(own.values()), 0, MAX_BIN + 1
        for b in sorted(own, reverse=True):
            upto += own[b]
            if b > 0 and 10 ** (-b * BIN) <= FDR * upto / total:
                accept = b
        least.append(accept)
    return least


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base (array of start, kind, end) and added (start, end, encoding)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = (
        "doc_id long, base array<struct<start:int,kind:int,end:int>>, "
        "cand array<struct<start:int,end:int,encoding:string,bin:int>>"
    )
    scanned = staged(rows.mapInPandas(_scan, schema), "secrets")
    least = F.array(*[F.lit(x) for x in thresholds(scanned)])
    added = F.filter("cand", lambda c: c["bin"] >= F.get(least, band(c["end"] - c["start"])))
    return scanned.select("doc_id", "base", added.alias("added"))


def secrets_report(docs: DataFrame) -> DataFrame:
    found = find_secrets(docs)
    kinds = F.array(*[F.lit(k) for k in BASE])
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("k"), F.get(kinds, s["kind"]).alias("kind"), s["end"].alias("end")))
    more = F.transform("added", lambda s: F.struct(s["start"].alias("start"), F.lit(len(BASE)).alias("k"), F.lit("random").alias("kind"), s["end"].alias("end")))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(k: int):
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{BASE[k]}")

    return found.select(
        "doc_id",
        *[count(k) for k in range(len(BASE))],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.sort_array(F.concat(base, more))).alias("spans"),
        F.size("added").cast("long").alias("n_random"),
    )


def digest(spans: list[str]) -> str:
    return hashlib.sha256(",".join(spans).encode()).hexdigest()
