"""Benchmark decontamination: a BM25 index of the items, block-max WAND, overlap tests.

Every document is cut into chunks of ``STRIDE`` words; each pair of neighbouring chunks is
a passage, and every passage queries the index of benchmark items.  Impacts are
BM25 term scores divided by what the item's own text would score, so that one
threshold serves all items; items longer than a passage are scaled to its length.

Items stand in an order of fixed blocks.  For all passages at once, an upper bound of
the score in each of at most ``SUPER`` super-blocks is summed from the terms'
largest impacts there (an array lookup per word).  Only where the bound
reaches the threshold does WAND run: cursors over postings in item order, a
pivot where the bounds of the lists add up to the threshold, a check of the block maxima
at the pivot, and a full score only past both.  Everything above the threshold is retrieved.

A retrieved item is verified around the passages that retrieved it, an item's length to
either side: the share of the question's five-word shingles there, and that of the words of the
answer (the last sentence of an item, else its last quarter).  A question of fewer than five
words is one shingle of its own width, looked for among the document's shingles of that width.

The index is sent to the tasks, up to ``INDEX_BYTES`` of item text; a larger
benchmark is indexed in several parts.  Each part is a pass over the documents of its own, so
that a task never holds more than one of them, and the counts of BM25 (items, mean length,
items with a term) are those of the whole benchmark in every part: parts change no score.

Defined results.  Items with null or wordless text are left out; null documents
count as empty and match nothing.  Items with equal text all match; a repeated row of the benchmark counts once.
Items at the threshold (ties) are retrieved.  Repeated documents give repeated rows.  Documents of any length are
searched whole.  An empty table on either side gives an empty result.  Null
item_id and doc_id are passed on.  Other columns pass through ``drop_contaminated`` untouched.
"""

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import give_back, staged
from marginalia.llm.words import groups, mix, word_hashes

STRIDE = 32
THRESHOLD = 0.5
K1, B = 1.2, 0.75
BLOCK = 8
SUPER = 64
INDEX_BYTES = 8 << 20
WIDTH = 5
QUESTION_SHARE = 0.6
ANSWER_SHARE = 0.5
_COEF = mix(np.arange(1, WIDTH + 1, dtype=np.uint64)) | np.uint64(1)
_END = 1 << 60


def shingles(hashes: np.ndarray, width: int = WIDTH) -> np.ndarray:
    width = min(width, len(hashes))
    if not width:
        return hashes
    x = np.zeros(len(hashes) - width + 1, np.uint64)
    for k in range(width):
        x += hashes[k : len(hashes) - width + 1 + k] * _COEF[k]
    return mix(x)


def encode(texts: list[str | None]) -> list[bytes]:
    return [(t or "").lower().encode("utf-8", "replace") for t in texts]


def split_item(text: str) -> tuple[str, str]:
    """Question and answer of an item."""
    cut = [m.end() for m in re.finditer(r"[.!?]\s+(?=\S)|\n+(?=\S)", text)]
    for at in reversed(cut):
        if len(text[at:].split()) >= 3 and len(text[:at].split()) >= WIDTH:
            return text[:at], text[at:]
    words = text.split()
    k = max(1, len(words) * 3 // 4)
    return " ".join(words[:k]), " ".join(words[k:])


class Index:
    """The inverted index of a bounded list of items.

    counts are those of the whole benchmark: items, words, and items by the hash of a term;
    without them the items are all there is.
    """

    def __init__(self, items: list[tuple[int | None, str]], counts: tuple[int, int, dict[int, int]] | None = None):
        self.ids = [i for i, _ in items]
        hashes, first = word_hashes(encode([t for _, t in items]))
        own = [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        parts = [split_item(t) for _, t in items]
        asked = [word_hashes(encode([q]))[0] for q, _ in parts]
        self.width = [min(WIDTH, len(x)) for x in asked]
        self.question = [np.unique(shingles(x)) for x in asked]
        self.answer = [np.unique(word_hashes(encode([a]))[0]) for _, a in parts]
        self.terms, number = np.unique(hashes, return_inverse=True)
        n, sizes = len(items), np.array([len(x) for x in own])
        self.sizes = sizes
        lists: list[list[tuple[int, float]]] = [[] for _ in self.terms]
        each = [np.unique(number[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:], strict=True)]
        if counts is None:
            df, mean, every = np.bincount(np.concatenate([t for t, _ in each]), minlength=len(self.terms)), sizes.sum() / n, n
        else:
            every, mean = counts[0], counts[1] / counts[0]
            df = np.fromiter((counts[2][t] for t in self.terms.tolist()), np.int64, len(self.terms))
        idf = np.log1p((every - df + 0.5) / (df + 0.5))
        for i, (t, tf) in enumerate(each):
            w = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[i] / mean))
            full = w.sum() * min(1.0, 1.5 * STRIDE / sizes[i])
            for term, x in zip(t.tolist(), (w / full).tolist(), strict=True):
                lists[term].append((i, x))
        self.docs = [[i for i, _ in x] for x in lists]
        self.impacts = [[w for _, w in x] for x in lists]
        #: Largest impact of each list, and of each of its blocks of postings with the block's last item.
        self.top = np.array([max(x) for x in self.impacts])
        self.block_top = [[max(x[k : k + BLOCK]) for k in range(0, len(x), BLOCK)] for x in self.impacts]
        self.block_last = [[x[min(k + BLOCK, len(x)) - 1] for k in range(0, len(x), BLOCK)] for x in self.docs]
        width = max(BLOCK, -(-n // SUPER))
        #: Largest impacts by term (the last row: of no term) and super-block.
        self.bounds = np.zeros((len(self.terms) + 1, -(-n // width)), np.float32)
        for t, (items_, ws) in enumerate(zip(self.docs, self.impacts, strict=True)):
            for i, w in zip(items_, ws, strict=True):
                self.bounds[t, i // width] = max(self.bounds[t, i // width], w)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Term numbers of words; that of no term is the number of terms."""
        at = np.searchsorted(self.terms, hashes)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == hashes, at, len(self.terms))

    def wand(self, query: list[int], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """All items whose score for the distinct terms of query reaches threshold."""
        threshold -= 1e-9
        cursors = [[self.docs[t][0], 0, t] for t in query]
        out = []
        while True:
            cursors.sort()
            bound, pivot = 0.0, None
            for k, c in enumerate(cursors):
                if c[0] == _END:
                    break
                bound += self.top[c[2]]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot is None:
                return out
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            shallow, edge = 0.0, _END
            for _, _, t in cursors[: pivot + 1]:
                b = bisect_left(self.block_last[t], item)
                if b < len(self.block_last[t]):
                    shallow += self.block_top[t][b]
                    edge = min(edge, self.block_last[t][b] + 1)
            if pivot + 1 < len(cursors):
                edge = min(edge, cursors[pivot + 1][0])
            if shallow < threshold:
                self._advance(cursors[: pivot + 1], max(edge, item + 1))
            elif cursors[0][0] == item:
                score = sum(self.impacts[t][at] for doc, at, t in cursors if doc == item)
                if score >= threshold:
                    out.append((item, score))
                self._advance(cursors[: pivot + 1], item + 1)
            else:
                self._advance(cursors[:pivot], item)

    def _advance(self, cursors: list[list[int]], item: int) -> None:
        for c in cursors:
            if c[0] < item:
                docs = self.docs[c[2]]
                c[1] = bisect_left(docs, item, c[1])
                c[0] = docs[c[1]] if c[1] < len(docs) else _END

    def verify(self, item: int, words: np.ndarray) -> tuple[float, float]:
        """Shares of the question's shingles and of the answer's words in some words of a document."""
        q, a, width = self.question[item], self.answer[item], self.width[item]
        if width > len(words):
            return 0.0, 0.0
        return (
            float(np.isin(q, shingles(words, width)).mean()) if len(q) else 1.0,
            float(np.isin(a, words).mean()) if len(a) else 1.0,
        )

    def matches(self, texts: list[str | None]) -> list[list[tuple[int | None, float, float, float]]]:
        """Per text the verified items: id, score, question share, answer share."""
        raw, out = encode(texts), []
        for part in groups(raw, 1 << 20):
            hashes, first = word_hashes(raw[part])
            at = self.numbers(hashes)
            for k, hits in enumerate(self._retrieve(at, first)):
                words, found = hashes[first[k] : first[k + 1]], []
                for item, passages in sorted(hits.items()):
                    room, best = int(self.sizes[item]), None
                    for score, start in sorted(passages, key=lambda x: (-x[0], x[1])):
                        q, a = self.verify(item, words[max(0, start - room) : start + 2 * STRIDE + room])
                        if q >= QUESTION_SHARE and a >= ANSWER_SHARE and (best is None or (q, a) > best[2:]):
                            best = (self.ids[item], score, q, a)
                            if q == a == 1.0:
                                break
                    if best:
                        found.append((best[0], max(x for x, _ in passages), *best[2:]))
                out.append(found)
        return out

    def _retrieve(self, at: np.ndarray, first: np.ndarray) -> list[dict[int, list[tuple[float, int]]]]:
        """Per text the items above the threshold, each with the scores and first words of its passages."""
        hits: list[dict[int, list[tuple[float, int]]]] = [{} for _ in range(len(first) - 1)]
        starts = [np.arange(a, b, STRIDE) for a, b in zip(first[:-1], first[1:], strict=True)]
        doc = np.repeat(np.arange(len(starts)), [len(s) for s in starts])
        chunk = np.concatenate(starts).astype(np.int64) if len(starts) else np.empty(0, np.int64)
        if not len(chunk):
            return hits
        sums = np.add.reduceat(self.bounds[at], chunk, axis=0)
        # A passage is a chunk with the next one of its document.
        follows = np.zeros(len(chunk), bool)
        follows[:-1] = doc[1:] == doc[:-1]
        sums[:-1] += sums[1:] * follows[:-1, None]
        for p in np.flatnonzero(sums.max(axis=1) >= THRESHOLD - 1e-4):
            k = doc[p]
            query = np.unique(at[chunk[p] : min(chunk[p] + 2 * STRIDE, first[k + 1])])
            query = query[query < len(self.terms)]
            if self.bounds[query].sum(axis=0).max(initial=0) < THRESHOLD - 1e-4:
                continue
            for item, score in self.wand(query.tolist()):
                hits[k].setdefault(item, []).append((score, int(chunk[p] - first[k])))
        return hits


def _item_rows(benchmark: DataFrame) -> DataFrame:
    rows = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).distinct()


def _term_rows(batches):
    import pandas as pd

    for pdf in batches:
        for text, part in zip(pdf["text"], pdf["part"], strict=True):
            yield pd.DataFrame({"term": np.unique(word_hashes(encode([text]))[0]).view(np.int64), "part": part})


def index_parts(benchmark: DataFrame):
    """Bounded lists of (item_id, text) that together hold all items, each with the counts
    of the whole benchmark for its terms (None where there is one part)."""
    rows = _item_rows(benchmark)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // INDEX_BYTES)
    if parts > 1:
        rows = staged(rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int")), "items")
        terms = rows.select("text", "part").mapInPandas(_term_rows, "term long, part int")
        df = staged(terms.groupBy("term").agg(F.count("*").alias("df"), F.collect_set("part").alias("parts")), "df")
        n = rows.count()
        words = rows.select(F.size(F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")).cast("long").alias("n")).agg(F.sum("n")).first()[0]
    for k in range(parts):
        own = rows.where(F.col("part") == k).select("item_id", "text") if parts > 1 else rows
        items = sorted(((r["item_id"], r["text"]) for r in own.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        counts = None
        if parts > 1:
            found = df.where(F.array_contains("parts", F.lit(k))).select("term", "df").collect()
            counts = (n, words, {r["term"] & (1 << 64) - 1: r["df"] for r in found})
        if items:
            yield items, counts


MATCH = "item_id long, score double, question_share double, answer_share double"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row per document and verified item: doc_id, item_id, score and both shares."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], f"doc_id long, {MATCH}")
    for k, sent in enumerate(spark.sparkContext.broadcast(x) for x in index_parts(benchmark)):
        found = rows.mapInPandas(_matches(sent), f"doc_id long, {MATCH}")
        out = found if k == 0 else out.unionByName(found)
    return out.withColumn("score", F.round("score", 6))


def _matches(sent):
    def run(batches):
        import pandas as pd

        index = Index(*sent.value)
        for pdf in batches:
            rows = [(doc_id, *m) for doc_id, found in zip(pdf["doc_id"], index.matches(pdf["text"].tolist()), strict=True) for m in found]
            out = pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "question_share", "answer_share"])
            yield out.astype({"doc_id": "Int64", "item_id": "Int64", "score": float, "question_share": float, "answer_share": float})

    return run


def _clean(sent):
    import pandas as pd

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(*sent.value)
        for texts in batches:
            yield pd.Series([not found for found in index.matches(texts.tolist())], dtype=bool)
            del texts
            give_back()

    return clean


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, with the columns of docs."""
    out = docs
    for k, sent in enumerate(docs.sparkSession.sparkContext.broadcast(x) for x in index_parts(benchmark)):
        out = staged(out, "clean") if k else out
        out = out.where(_clean(sent)(F.col("text").cast("string")))
    return out
