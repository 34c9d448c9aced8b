"""Near duplicates by Order MinHash, verified by banded alignment.

Each text becomes the sequence of its shingles of five words (lower case),
labelled by their occurrence number.  For each of some hash functions the
``KEEP`` smallest labelled shingles are taken and put back in text order;
the hash of that ordered tuple is one bucket key.  At a similarity of 0.8 two
long texts share a key with probability about 0.8**4, short ones with less (``C(L, 4) / C(n + m - L, 4)``).
The number of hash functions follows from the length (24 for long texts), so that a pair
at 0.8 misses all of them in at most ``MISS`` of the cases, whatever the lengths.

Similarity is L / (n + m - L), with n and m labelled shingles and L those that a
common alignment keeps in order (for texts without moved parts the
Jaccard similarity of the labelled shingles).  A pair with similarity 0.8 has
an alignment within (n + m) / 9 of the diagonal, so the band loses nothing.

Classes are the connected components of verified links.  Copies with equal text
are one node.  In a bucket, members are compared with a hub, the one that meets most others over all buckets, instead
of with each other.  Where that leaves several classes in a bucket, a bucket of up to ``SMALL``
members compares all of different classes.

The members of larger ones (texts that share a long passage but are not similar, or variants
of one text on both sides of the threshold) go an exact way, so that neither a cap
nor all pairs of a bucket are needed: their shingles are put in one order, rarest among these
members first.  Two texts of n and m shingles at 0.8 have at least a = 4 (n + m) / 9 in common,
so the first n - a + 1 of the one and the first m - a + 1 of the other meet in a shingle.  These
prefixes are rows by shingle and pair of length bands (``BAND``), and only pairs of different
classes that meet there are verified.  Passages that many texts share stand last in
that order and propose nothing; texts with more shingles of their own than a prefix
holds are done at once.  All work is joins and aggregates on longs.

Defined results.  Null text counts as empty; texts without words are alone in their
class.  Texts with fewer than five words have one shingle.  Null doc_id values take
part; the id of a class is its least non-null doc_id, or null; among several texts with that id the one of least MD5 stays.  Texts
of any length are hashed whole.  Repeated rows
are copies of each other.  An empty table gives an empty result.  Other columns pass
through ``one_of_each`` untouched, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import cache
from math import ceil, comb, log, log1p

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import give_back, staged
from marginalia.llm.words import groups, mix, word_hashes

WIDTH = 5
KEEP, MISS = 4, 5e-6
#: Most sketches of one kind; where more were needed they keep fewer shingles.
MOST = 120
#: Texts of more shingles have the sketches of this number, which suffice for them.
LONG = 400
SMALL = 8
#: Rows of a batch whose texts are Python's at a time.
PART = 512
#: Lengths whose ratio is below this share a band in the exact way.
BAND = 1.1
#: Up to so many rows of a few longs (under 64 bytes each) are broadcast.
BROADCAST_KEYS = 100_000
_SEEDS = mix(np.arange(1, 128, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
#: Whether lengths allow a similarity of 0.8.
FIT = "5 * least({0}, {1}) >= 4 * greatest({0}, {1})"
_COEF = mix(np.arange(1, 64, dtype=np.uint64) * np.uint64(0xE7037ED1A0B428DB)) | np.uint64(1)


def labelled_shingles(hashes: np.ndarray) -> np.ndarray:
    """Occurrence-labelled shingles of one text from its word hashes, in order."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(WIDTH, n)
    x = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        x += hashes[k : n - width + 1 + k] * _COEF[k]
    x = mix(x + np.uint64(width))
    order = np.argsort(x, kind="stable")
    ordered = x[order]
    same = np.concatenate(([False], ordered[1:] == ordered[:-1]))
    if same.any():
        at = np.arange(len(x))
        run = np.maximum.accumulate(np.where(same, 0, at))
        occurrence = np.empty(len(x), np.uint64)
        occurrence[order] = (at - run).astype(np.uint64)
        x = mix(x + occurrence * np.uint64(0x8EBC6AF09C88C6E3))
    return x


@cache
def needed(n: int, keep: int, miss: float) -> tuple[int, int]:
    """Shingles to keep and number of sketches, with which two texts at similarity 0.8, the
    longer of n shingles, are missed in at most miss of the cases."""
    for k in range(min(keep, n), 0, -1):
        p = 1.0
        for m in range(-(-4 * n // 5), n + 1):
            common = -(-4 * (n + m) // 9)
            p = min(p, comb(common, k) / comb(n + m - common, k))
        sketches = 1 if p == 1 else ceil(log(miss) / log1p(-p)) if p else MOST + 1
        if sketches <= MOST:
            break
    return k, sketches


@cache
def kinds(n: int, keep: int, miss: float) -> dict[int, int]:
    """Sketches of each number of shingles, for all pairs that a text of n shingles can be in."""
    out: dict[int, int] = {}
    for longer in range(n, 5 * n // 4 + 1):
        k, sketches = needed(min(longer, LONG), keep, miss)
        out[k] = max(sketches, out.get(k, 0))
    return out


def bucket_keys(shingles: np.ndarray, keep: int = KEEP, miss: float = MISS) -> np.ndarray:
    """The bucket keys of a text; none without words."""
    if not len(shingles):
        return np.empty(0, np.int64)
    own = kinds(min(len(shingles), LONG), keep, miss)
    return np.concatenate([sketch(shingles, sketches, k) for k, sketches in own.items()]).astype(np.int64)


def sketch(shingles: np.ndarray, sketches: int, keep: int) -> np.ndarray:
    """The hashes of the ordered tuples of one number of shingles."""
    n, keep = len(shingles), min(keep, len(shingles))
    out = np.empty(sketches, np.uint64)
    step = sketches if n < 1 << 14 else 1
    for lo in range(0, sketches, step):
        seeds = _SEEDS[lo : min(lo + step, sketches), None]
        v = mix(shingles[None, :] ^ seeds)
        spots = np.argpartition(v, keep - 1, axis=1)[:, :keep] if keep < n else np.tile(np.arange(n), (len(seeds), 1))
        spots.sort(axis=1)
        out[lo : lo + step] = mix((shingles[spots] * _COEF[:keep]).sum(axis=1, dtype=np.uint64) ^ seeds[:, 0])
    return out


def aligned(a: np.ndarray, b: np.ndarray) -> int:
    """Shingles that the best alignment within the band keeps: the longest
    increasing run of matched positions."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    inside = np.abs(i - j) <= (len(a) + len(b)) // 9
    i, j = i[inside], j[inside]
    j = j[np.argsort(i)]
    if len(j) < 2 or (j[1:] > j[:-1]).all():
        return len(j)
    tops: list[int] = []
    for x in j.tolist():
        k = bisect_right(tops, x)
        tops[k : k + 1] = [x]
    return len(tops)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether L / (n + m - L) is 0.8 or more, in whole numbers."""
    return 9 * aligned(a, b) >= 4 * (len(a) + len(b))


def _shingles_of(texts: list[str]):
    for lo in range(0, len(texts), 256):
        raw = [(t or "").lower().encode("utf-8", "replace") for t in texts[lo : lo + 256]]
        for part in groups(raw):
            hashes, first = word_hashes(raw[part])
            for k in range(len(first) - 1):
                yield labelled_shingles(hashes[first[k] : first[k + 1]])


def _parts(batches):
    """The Arrow batches, which hold up to 10,000 texts, in parts whose texts may become Python's together."""
    for batch in batches:
        for lo in range(0, batch.num_rows, PART):
            yield batch.slice(lo, PART)
        del batch
        give_back()


def _sketch(batches):
    import pyarrow as pa

    for part in _parts(batches):
        n, keys = [], []
        for x in _shingles_of(part.column("text").to_pylist()):
            n.append(len(x))
            keys.append(bucket_keys(x))
        ends = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
        lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys), pa.int64()))
        columns = {"doc_id": part.column("doc_id"), "tkey": part.column("tkey"), "n": pa.array(n, pa.int32()), "keys": lists}
        yield pa.RecordBatch.from_pydict(columns)


def has_words(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[^\x20\x09-\x0D]"), F.lit(False))


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _verify(batches):
    import pyarrow as pa

    known: dict[int, np.ndarray] = {}
    for part in _parts(batches):
        ok = []
        hubs, own_texts, texts = (part.column(x).to_pylist() for x in ("hub", "hub_text", "text"))
        for hub, own, other in zip(hubs, own_texts, _shingles_of(texts), strict=True):
            if hub not in known:
                if len(known) > 64:
                    known.clear()
                known[hub] = next(_shingles_of([own]))
            ok.append(similar(known[hub], other))
        yield part.select(["node", "hub"]).filter(pa.array(ok, pa.bool_()))


def _small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, to be broadcast where it has few rows of a few longs."""
    few = rows if rows is not None else df.limit(BROADCAST_KEYS + 1).count()
    return F.broadcast(df) if few <= BROADCAST_KEYS else df


def components(links: DataFrame) -> DataFrame:
    """node, label: the least node of each component, for the nodes of links (node, hub).

    Each round every node goes to its least neighbour, if that is less, and on to where that one goes; links
    between the nodes that are left make the next, smaller graph.  At most half of the nodes are left by a round, so
    all rounds together join a few times the links, and so does putting their steps together, from the last back.
    """
    links = staged(links.select(F.col("node").alias("a"), F.col("hub").alias("b")).where("a <> b").distinct(), "edges")
    steps = []
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("to")), "steps")
        on = step.select(F.col("node").alias("to"), F.col("to").alias("on"))
        step = staged(step.join(_small(on), "to").select("node", F.col("on").alias("to")), "steps")
        steps.append(step)
        ends = [_small(step.select(F.col("node").alias(k), F.col("to").alias(f"to_{k}"))) for k in "ab"]
        left = links.join(ends[0], "a").join(ends[1], "b").where("to_a <> to_b")
        links = staged(left.select(F.greatest("to_a", "to_b").alias("a"), F.least("to_a", "to_b").alias("b")).distinct(), "edges")
        if links.isEmpty():
            break
    final = steps.pop().withColumnRenamed("to", "label")
    while steps:
        step = steps.pop()
        rest = _small(final.select(F.col("node").alias("to"), "label"))
        final = staged(step.join(rest, "to", "left").select("node", F.coalesce("label", "to").alias("label")), "labels")
    return final


def merged_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels after more links: components of the classes that these connect."""
    if links.isEmpty():
        return labels
    own = labels.select("node", F.col("label").alias("a"))
    hub = labels.select(F.col("node").alias("hub"), F.col("label").alias("b"))
    classes = links.join(own, "node", "left").join(hub, "hub", "left").select(F.coalesce("a", "node").alias("node"), F.coalesce("b", "hub").alias("hub"))
    found = components(classes.where("node <> hub"))
    moved = labels.join(_small(found.select(F.col("node").alias("label"), F.col("label").alias("to"))), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    fresh = found.join(labels.select("node"), "node", "left_anti")
    return staged(moved.unionByName(fresh), "classes")


def text_classes(docs: DataFrame) -> DataFrame:
    """One row per different text with words: tkey, doc_id (its least), rows
    (with that doc_id), node, and label, the node that stands for its class."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where(has_words(F.col("text"))).withColumn("tkey", text_key(F.col("text")))
    slim = staged(rows.mapInArrow(_sketch, "doc_id long, tkey binary, n int, keys array<long>"), "sketch")
    ids = (
        slim.groupBy("tkey", "doc_id").agg(F.count("*").alias("rows"))
        .groupBy("tkey").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rows")).alias("least"))
    )
    uniq = slim.select("tkey", "n", "keys").dropDuplicates(["tkey"]).join(ids, "tkey")
    uniq = staged(
        uniq.select(
            F.monotonically_increasing_id().alias("node"), "tkey", "n", "keys",
            F.col("least.doc_id").alias("doc_id"), F.col("least.rows").alias("rows"),
        ),
        "texts",
    )
    members = _members(uniq.select("node", "n", F.explode("keys").alias("h")))
    texts = _texts(rows, uniq, members.select("node").distinct())
    pairs = members.where(f"node <> hub and {FIT.format('n', 'hub_n')}")
    pairs = staged(pairs.select(F.greatest("node", "hub").alias("node"), F.least("node", "hub").alias("hub")).distinct(), "pairs")
    labels = components(_verified(texts, pairs))
    crowd = _open(members, labels)
    dense = crowd.where(F.col("size") > SMALL).select("node", "label").distinct()
    wanted = _across(crowd.where((F.col("size") > 2) & (F.col("size") <= SMALL) & (F.col("node") != F.col("hub"))).select("h", "node", "n", "label"))
    wanted = wanted.unionByName(_rare_pairs(texts, staged(dense, "dense")))
    more = staged(wanted.distinct().join(pairs, ["node", "hub"], "left_anti"), "pairs")
    labels = merged_labels(labels, _verified(texts, more))
    return uniq.join(labels, "node", "left").select("node", "tkey", "doc_id", "rows", F.coalesce("label", "node").alias("label"))


def _members(bands: DataFrame) -> DataFrame:
    """The rows of buckets with several texts, with the bucket's hub, its length, and the bucket's size.

    The hub is the member that meets most others over all its buckets, the least node of equals: among variants of
    one text that is one near their centre, so that fewer classes are left apart.
    """
    crowd = bands.groupBy("h").agg(F.count("*").alias("size")).where("size > 1")
    members = staged(bands.join(crowd, "h"), "members")
    met = members.groupBy("node").agg(F.sum("size").alias("met"))
    best = members.join(_small(met), "node").groupBy("h").agg(F.max(F.struct("met", (-F.col("node")).alias("less"), "n")).alias("x"))
    return staged(members.join(best.select("h", (-F.col("x.less")).alias("hub"), F.col("x.n").alias("hub_n")), "h"), "hubs")


def _open(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of buckets in which there are several classes, with their labels."""
    at = members.join(_small(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = at.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("h")
    return staged(at.join(_small(mixed), "h"), "open")


def _across(rows: DataFrame) -> DataFrame:
    """Pairs of different classes whose lengths fit, from rows (h, node, n, label) that meet in h."""
    least = rows.select("h", F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("label").alias("hub_label"))
    both = rows.join(least, "h").where(f"hub < node and label <> hub_label and {FIT.format('n', 'hub_n')}")
    return both.select("node", "hub")


@cache
def band_starts() -> list[int]:
    """The least length of each band; whole numbers, the same everywhere."""
    out = [1]
    while out[-1] < 1 << 31:
        out.append(max(out[-1] + 1, int(out[-1] * BAND)))
    return out


def prefix_keys(n: int, before: int, rare: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys (shingle, band of the shorter and of the longer text) of the prefixes of a text of n
    shingles, the side on which it stands in each (0 shorter, 1 longer, 2 both in one band), and the
    shingle's place in the common order.  The first before of them no other text has; rare are the next ones."""
    starts = band_starts()
    own, keys, sides, places = bisect_right(starts, n) - 1, [], [], []
    least = -(-4 * n // 5)
    for band in range(bisect_right(starts, least) - 1, bisect_right(starts, 5 * n // 4)):
        other = max(starts[band], least)
        size = min(n - -(-4 * (n + other) // 9) + 1 - before, len(rare))
        if size > 0:
            lo, hi = sorted((own, band))
            keys.append(mix(rare[:size] + np.uint64((lo * 4096 + hi + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)))
            sides.append(np.full(size, 2 if lo == hi else int(own == hi), np.int32))
            places.append(np.arange(before, before + size, dtype=np.int32))
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int32)
    return np.concatenate(keys), np.concatenate(sides), np.concatenate(places)


def _frames(rows, columns: tuple[str, ...], most: int = 1 << 18):
    """Frames of bounded size (but for single texts) from rows (lists, scalars) with a row per entry of
    the lists, which become longs."""
    import pandas as pd

    def frame(held):
        counts = [len(lists[0]) for lists, _ in held]
        out = {}
        for k, column in enumerate(columns):
            n = len(held[0][0])
            if k < n:
                own = np.concatenate([lists[k] for lists, _ in held])
                out[column] = own.view(np.int64) if own.dtype == np.uint64 else own
            else:
                out[column] = np.repeat(np.array([more[k - n] for _, more in held], np.int64), counts)
        return pd.DataFrame(out)

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[0][0])
        if size > most:
            yield frame(held)
            held, size = [], 0
    if held:
        yield frame(held)


def _shingle_rows(batches):
    for pdf in batches:
        each = zip(pdf["node"], pdf["n"], pdf["label"], _shingles_of(pdf["text"].tolist()), strict=True)
        yield from _frames((((x,), more) for *more, x in each), ("s", "node", "n", "label"))


def _prefix_rows(batches):
    for pdf in batches:
        each = zip(pdf["node"], pdf["n"], pdf["label"], pdf["known"], pdf["rare"], strict=True)
        rows = ((prefix_keys(n, n - known, np.asarray(rare, np.int64).view(np.uint64)), (i, n, label)) for i, n, label, known, rare in each)
        yield from _frames(rows, ("h", "side", "place", "node", "n", "label"))


def _rare_pairs(texts: DataFrame, dense: DataFrame) -> DataFrame:
    """All pairs (node, hub) of different classes among dense whose prefixes meet."""
    rows = texts.select("node", "n", "text").join(_small(dense), "node").mapInPandas(_shingle_rows, "s long, node long, n int, label long")
    rows = staged(rows, "shingles")
    common = rows.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    # One text's shingles are one row: as long as the text at most.
    ranked = rows.join(common, "s").groupBy("node", "n", "label").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("x"))
    ranked = ranked.select("node", "n", "label", F.slice("x.s", F.lit(1), (F.col("n") / 5 + 2).cast("int")).alias("rare"), F.size("x").alias("known"))
    keyed = staged(ranked.mapInPandas(_prefix_rows, "h long, side int, place int, node long, n int, label long"), "prefixes")
    mixed = keyed.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("h")
    at = staged(keyed.join(_small(mixed), "h"), "open")
    other = at.select("h", *[F.col(own).alias(name) for own, name in (("side", "hub_side"), ("place", "hub_place"), ("node", "hub"), ("n", "hub_n"), ("label", "hub_label"))])
    sides = "((side = 0 and hub_side = 1) or (side = 2 and hub_side = 2 and hub < node))"
    # Bands only bound the prefixes; these are the two texts' own.
    within = "9 * (n - place) >= 4 * (n + hub_n) and 9 * (hub_n - hub_place) >= 4 * (n + hub_n)"
    both = at.join(other, "h").where(f"{sides} and label <> hub_label and {within} and {FIT.format('n', 'hub_n')}")
    return both.select(F.greatest("node", "hub").alias("node"), F.least("node", "hub").alias("hub"))


def _texts(rows: DataFrame, uniq: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, n and text of some nodes, from one row of each."""
    wanted = _small(uniq.join(nodes, "node").select("node", "n", "tkey", F.col("doc_id").alias("own_id")))
    texts = rows.join(wanted, (F.col("doc_id").eqNullSafe(F.col("own_id"))) & (rows["tkey"] == wanted["tkey"]))
    return staged(texts.select("node", "n", "text").dropDuplicates(["node"]), "payload")


def _verified(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of pairs whose texts are similar.  Hubs are joined under a salt, so that one
    with many members is spread over tasks."""
    loads = pairs.groupBy("hub").agg((F.count("*") / 256).cast("int").alias("more"))
    texts = texts.select("node", "text")
    own = pairs.join(loads, "hub").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("more") + 1).cast("int")).join(texts, "node")
    hub_texts = (
        texts.withColumnsRenamed({"node": "hub", "text": "hub_text"})
        .join(loads, "hub")
        .select("hub", "hub_text", F.explode(F.sequence(F.lit(0), F.col("more"))).alias("salt"))
    )
    both = own.select("node", "hub", "salt", "text").join(hub_texts, ["hub", "salt"])
    return staged(both.select("node", "hub", "text", "hub_text").mapInArrow(_verify, "node long, hub long"), "links")


def _with_survivors(texts: DataFrame) -> DataFrame:
    """texts plus, for each, the text and doc_id that stand for its class."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tkey", "rows"))
    chosen = texts.groupBy("label").agg(first.alias("x"), F.sum("rows").alias("size"))
    return texts.join(chosen, "label").select(
        "tkey", F.col("x.doc_id").alias("class_id"), F.col("x.tkey").alias("class_tkey"), F.col("x.rows").alias("class_rows")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class) and kept, a row per row of docs."""
    classes = _with_survivors(text_classes(docs)).select("tkey", "class_id")
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), has_words(text).alias("worded"), text_key(text).alias("tkey"))
    found = rows.where("worded").join(classes, "tkey").select("doc_id", "class_id")
    alone = rows.where("not worded").select("doc_id", F.col("doc_id").alias("class_id"))
    return found.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of docs for each class, the one with the least doc_id; texts without words stay."""
    p = "__near_dup_"
    columns = docs.columns
    first = _with_survivors(text_classes(docs)).where("tkey = class_tkey")
    first = first.select(F.col("class_tkey").alias(p + "tkey"), F.col("class_id").alias(p + "id"), F.col("class_rows").alias(p + "rows"))
    text = F.col("text").cast("string")
    worded = docs.where(has_words(text)).withColumn(p + "key", text_key(text))
    # Joined on both, so that the copies of one text are dealt out by their doc_id.
    kept = worded.join(first, F.col("doc_id").cast("long").eqNullSafe(F.col(p + "id")) & (F.col(p + "key") == F.col(p + "tkey")))
    several = F.col(p + "rows") > 1
    once = kept.where(several).dropDuplicates([p + "key"])
    alone = docs.where(~has_words(text))
    return kept.where(~several).unionByName(once).select(*columns).unionByName(alone)
