"""Language of each word by Viterbi, of each document by the labelled spans.

The model holds, for each language, log probabilities of hashed character
n-grams (1 to 4, with word borders) in a table of ``BUCKETS`` rows, learned
from a sample of at most about ``SAMPLE`` labelled documents per language (drawn by a
hash of the text's identifier; the bound is this parameter).  A word's score for a
language is the sum over its n-grams.  Words are runs of letters (Unicode categories L*).  The scripts of the words seen in
training narrow the candidates: a word in a script that some languages use
is only scored for those.  A word of several scripts has that of most of its letters.  Viterbi over the word scores with a penalty ``SWITCH`` for each
change of language labels spans, from the start of their first word to the end of their last,
in code points of the text as it is given; the language of the document is the one
with most letters in its spans, and its score the share of the letters it holds, weighed
with the mean posterior.

Viterbi is skipped where it provably returns one language: if no stretch of words
favours another language over the best one by more than half a penalty, no path with
switches can win.  Both ways give the same labels.

Defined results.  Null text, or text without letters: ``und`` with score 0 and no spans.  Letters
of a script never seen are scored for all languages.  Ties go to the
alphabetically first language.  Without any labelled document every
text is ``und``.  Texts of any length are read whole; they are taken in groups of bounded size, a longer text
alone, so that memory follows the longest text.  Repeated rows are judged row by row.  An empty table gives an
empty result.  Other columns are not read.
"""

from __future__ import annotations

import re
import sys
import unicodedata

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import id_crc
from marginalia.llm.words import mix

BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
#: Labelled documents per language that the model is fitted on, in the mean.
SAMPLE = 1500
SWITCH = 12.0
SMOOTH = 0.5
#: Distinct words whose scores a task remembers.
CACHE_WORDS = 400_000
#: Words scored at once.
CHUNK = 20_000
#: Characters of a group of texts that are scored at once.
GROUP = 1 << 19
#: Numerals that are no letters though they count as word characters; blanks stand in for them.
_NUMERALS = {c: " " for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal()}
_BLANKS = str.maketrans(_NUMERALS)
WORD = re.compile(r"[^\W\d_]+")

# Script ranges by first code point; a letter belongs to the last range that starts at or before it.
SCRIPTS = (
    (0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"),
    (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "other"), (0x20000, "han"),
)
_STARTS = np.array([s for s, _ in SCRIPTS])
_NAMES = sorted({n for _, n in SCRIPTS})
_LATIN = _NAMES.index("latin")
_NUMBER = np.array([_NAMES.index(n) for _, n in SCRIPTS])


def script(word: str) -> int:
    """The script of most letters of a word; the alphabetically first of several."""
    if word.isascii():
        return _LATIN
    codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), "<u4")
    spots = np.maximum(np.searchsorted(_STARTS, codes, side="right") - 1, 0)
    return int(np.bincount(_NUMBER[spots]).argmax())


def plain(text: str) -> str:
    """The text that words are found in."""
    if text.isascii():
        return text.lower()
    low = unicodedata.normalize("NFC", text).lower()
    return low if _NUMERALS.keys().isdisjoint(low) else low.translate(_BLANKS)


def words_of(text: str) -> list[str]:
    return WORD.findall(plain(text))


def places(text: str, low: str) -> list[tuple[int, int]] | None:
    """(start, end) in text for each character of low = plain(text); None where they are the same.

    The text is cut before each character that does not change with those before it, so that
    the parts can be made plain one by one."""
    if len(low) == len(text) and (text.isascii() or unicodedata.is_normalized("NFC", text)):
        return None
    cuts = [0]
    own = text[:1]
    for i, c in enumerate(text[1:], 1):
        if c.isascii() or (not unicodedata.combining(c) and plain(own + c) == plain(own) + plain(c)):
            cuts.append(i)
            own = c
        else:
            own += c
    out: list[tuple[int, int]] = []
    for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True):
        out += [(a, b)] * len(plain(text[a:b]))
    return out


def span_edges(text: str, first: list[int]) -> list[tuple[int, int]]:
    """(start, end) in text of the spans that start at these words, the last up to the last word."""
    low = plain(text)
    if len(first) == 1:
        edges = [(WORD.search(low).start(), len(low) - WORD.search(low[::-1]).start())]
    else:
        at = [m.span() for m in WORD.finditer(low)]
        edges = [(at[a][0], at[b - 1][1]) for a, b in zip(first, [*first[1:], len(at)], strict=True)]
    own = places(text, low)
    return edges if own is None else [(own[a][0], own[b - 1][1]) for a, b in edges]


def gram_buckets(words: list[str]):
    """For each order, the bucket of the n-gram of bytes that starts at each byte
    of the bordered words and a mask of those that end in the same word; then
    the first byte of each word."""
    raw = [b"\x02" + w.encode("utf-8", "replace") + b"\x03" for w in words]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    buf = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    ends = np.cumsum(sizes)
    room = np.repeat(ends, sizes) - np.arange(len(buf))
    h, out = np.zeros(len(buf), np.uint64), []
    for n in ORDERS:
        shifted = np.zeros(len(buf), np.uint64)
        shifted[: len(buf) - n + 1] = buf[n - 1 :]
        h = h * np.uint64(257) + shifted
        out.append(((mix(h + np.uint64(n << 40)) % np.uint64(BUCKETS)).astype(np.int64), room >= n))
    return out, ends - sizes


def _count(batches):
    """Partition counts: (lang, bucket, n), and (lang, -1 - script, n)."""
    import pandas as pd
    from collections import Counter

    seen: dict[str, Counter] = {}
    for pdf in batches:
        for lang, text in zip(pdf["lang"], pdf["text"], strict=True):
            seen.setdefault(lang, Counter()).update(words_of(text or ""))
    for lang, words in seen.items():
        table = np.zeros(BUCKETS, np.int64)
        scripts: Counter = Counter()
        listed = list(words)
        for lo in range(0, len(listed), CHUNK):
            part = listed[lo : lo + CHUNK]
            orders, starts = gram_buckets(part)
            times = np.fromiter(map(words.__getitem__, part), np.int64, len(part))
            each = np.repeat(times, np.diff(np.append(starts, len(orders[0][0]))))
            for spots, ok in orders:
                table += np.bincount(spots[ok], weights=each[ok], minlength=BUCKETS).astype(np.int64)
        for w, n in words.items():
            scripts[script(w)] += n
        spots = np.flatnonzero(table)
        yield pd.DataFrame(
            {
                "lang": lang,
                "bucket": np.concatenate((spots, [-1 - s for s in scripts])).astype(np.int64),
                "n": np.concatenate((table[spots], list(scripts.values()))).astype(np.int64),
            }
        )


class Model:
    """langs, the table of log probabilities, and the languages allowed per script."""

    def __init__(self, langs: list[str], table: np.ndarray, allowed: np.ndarray):
        self.langs, self.table, self.allowed = langs, table, allowed
        self.cache: dict[str, int] = {}
        self.rows = np.empty((0, len(langs)))

    def score(self, words: list[str]) -> np.ndarray:
        """Log scores, one row per word, relative to the best language."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
            self.rows = self.rows[:0]
        fresh = list(set(words).difference(self.cache))
        if fresh:
            new = np.concatenate([self._fresh(fresh[lo : lo + CHUNK]) for lo in range(0, len(fresh), CHUNK)])
            new -= new.max(axis=1, keepdims=True)
            np.maximum(new, -60.0, out=new)
            self.cache.update(zip(fresh, range(len(self.rows), len(self.rows) + len(fresh)), strict=True))
            self.rows = np.concatenate((self.rows, new))
        return self.rows[np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))]

    def _fresh(self, words: list[str]) -> np.ndarray:
        orders, starts = gram_buckets(words)
        at = sum(self.table[spots] * ok[:, None] for spots, ok in orders)
        x = np.add.reduceat(at, starts, axis=0) / len(ORDERS)
        ok = self.allowed[np.fromiter(map(script, words), np.int64, len(words))]
        ruled_out = ~ok & ok.any(axis=1, keepdims=True)
        return np.where(ruled_out, x.min(axis=1, keepdims=True) - 50.0, x)


def fit(docs: DataFrame) -> Model | None:
    """The model of docs with text and lang.

    The counts that reach the driver are bounded by languages times BUCKETS.
    """
    rows = docs.where("text is not null and lang is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    )
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, SAMPLE / n)).otherwise(share)
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(1 << 20)) < share * (1 << 20)
    counts = (
        rows.where(draw).select("lang", "text").mapInPandas(_count, "lang string, bucket long, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    )
    langs = sorted(sizes)
    table = np.zeros((BUCKETS, len(langs)))
    allowed = np.zeros((len(_NAMES), len(langs)), bool)
    for k, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        grams_ = own[own["bucket"] >= 0]
        table[grams_["bucket"].to_numpy(), k] = grams_["n"].to_numpy()
        scripts = own[own["bucket"] < 0]
        total = max(1, scripts["n"].sum())
        for b, n in zip(scripts["bucket"], scripts["n"], strict=True):
            allowed[-1 - b, k] = n >= 0.001 * total
    table = np.log(table + SMOOTH) - np.log(table.sum(axis=0) + SMOOTH * BUCKETS)
    return Model(langs, table, allowed)


def viterbi(scores: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The best language of each word of one text."""
    n, size = scores.shape
    back = np.empty((n, size), np.int16)
    best = scores[0].copy()
    stay = np.arange(size)
    for t in range(1, n):
        top = int(best.argmax())
        switch = best[top] - penalty
        moved = best < switch
        back[t] = np.where(moved, top, stay)
        best = np.where(moved, switch, best) + scores[t]
    out = np.empty(n, np.int64)
    out[-1] = int(best.argmax())
    for t in range(n - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def settled(scores: np.ndarray, first: np.ndarray, best: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """Per text, whether no stretch favours another language over ``best`` by
    more than half a penalty.  first: numbers of the first words, one more than texts."""
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(counts)), counts)
    ok = np.ones(len(counts), bool)
    if not len(scores):
        return ok
    for k in range(scores.shape[1]):
        gain = scores[:, k] - scores[np.arange(len(scores)), best[doc]]
        total = np.cumsum(gain)
        # Each text starts lower than all before it, so one running minimum serves all.
        base = np.repeat(np.concatenate(([0.0], total))[first[:-1]], counts)
        total -= base
        width = np.abs(total).max() + np.abs(gain).max() + 1.0
        total -= doc * 3 * width
        lowest = np.minimum.accumulate(np.minimum(total, -doc * 3 * width))
        high = (total - lowest) > penalty / 2
        ok[np.unique(doc[high])] = False
    return ok


def grouped(texts: list[str | None]):
    """(start, end) of groups of at most 256 texts and about GROUP characters."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and (i - lo == 256 or size + len(t or "") > GROUP):
            yield lo, i
            lo, size = i, 0
        size += len(t or "")
    if lo < len(texts):
        yield lo, len(texts)


def _predict(model: Model):
    def run(batches):
        import pandas as pd

        langs = model.langs
        for pdf in batches:
            texts = pdf["text"].tolist()
            names, scores_out, spans = [], [], []
            for lo, hi in grouped(texts):
                listed = [words_of(t or "") for t in texts[lo:hi]]
                words = [w for x in listed for w in x]
                first = np.concatenate(([0], np.cumsum([len(x) for x in listed])))
                scores = model.score(words)
                letters = np.fromiter(map(len, words), np.int64, len(words))
                csum = np.concatenate((np.zeros((1, len(langs))), np.cumsum(scores, axis=0)))
                total = csum[first[1:]] - csum[first[:-1]]
                best = total.argmax(axis=1)
                ok = settled(scores, first, best)
                for k in range(len(listed)):
                    a, b = first[k], first[k + 1]
                    if a == b:
                        names.append("und"), scores_out.append(0.0), spans.append([])
                        continue
                    own = scores[a:b]
                    if ok[k]:
                        pick, share, starts, held_by = int(best[k]), 1.0, [0], [int(best[k])]
                    else:
                        path = viterbi(own)
                        held = np.bincount(path, weights=letters[a:b], minlength=len(langs))
                        pick = int(held.argmax())
                        share = float(held[pick] / held.sum())
                        starts = [0, *(np.flatnonzero(path[1:] != path[:-1]) + 1).tolist()]
                        held_by = path[starts].tolist()
                    mean = own.sum(axis=0) / np.sqrt(len(own))
                    p = np.exp(mean - mean.max())
                    names.append(langs[pick])
                    edges = span_edges(texts[lo + k], starts)
                    spans.append([{"start": s, "end": e, "lang": langs[x]} for (s, e), x in zip(edges, held_by, strict=True)])
                    scores_out.append(float(min(1.0, max(0.0, share * p[pick] / p.sum()))))
            out = pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "held_out": pdf["held_out"], "lang_pred": names, "score": scores_out, "spans": spans})
            yield out

    return run


SPANS = "array<struct<start:int,end:int,lang:string>>"


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_spans and spans (start, end, lang); held_out has to be in docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("held_out"))
    if model is None:
        found = rows.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.array().cast(SPANS).alias("spans"))
    else:
        found = rows.mapInPandas(_predict(model), f"doc_id long, held_out boolean, lang_pred string, score double, spans {SPANS}")
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"), "spans")


def language_report(docs: DataFrame) -> DataFrame:
    """Fit on the documents whose crc32 of doc_id mod 4 is not 2, predict all."""
    held = id_crc() % 4 == 2
    model = fit(docs.where(~held))
    return predict(docs.select("doc_id", "text", held.alias("held_out")), model)
