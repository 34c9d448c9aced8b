import math
import random

import numpy as np
from pyspark.sql import functions as F

from marginalia.llm import near_dup as N
from marginalia.llm.words import word_hashes
from tests.llm.helpers import docs_frame, odd_docs


def shingles(text):
    return N.labelled_shingles(word_hashes([text.lower().encode()])[0])


def brute_classes(texts):
    """Connected components over all pairs that are similar."""
    own = {i: shingles(t) for i, t in texts.items() if t and t.split()}
    label = {i: i for i in texts}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in own:
        for j in own:
            if i < j and N.similar(own[i], own[j]):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {i: root(i) for i in texts}


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    texts = {}
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(8, 160))]
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 60))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts[len(texts)] = " ".join(w)
    for _ in range(30):
        texts[len(texts)] = " ".join([rng.choice(vocabulary) for _ in range(30)] + passage + [rng.choice(vocabulary) for _ in range(30)])
    texts[len(texts)] = "a b"
    texts[len(texts)] = "A  b"
    texts[len(texts)] = texts[0]
    return texts


def test_classes_equal_brute_force(spark):
    texts = corpus()
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(docs_frame(spark, list(texts.items()))).collect()}
    assert got == brute_classes(texts)


def test_crowded_bucket_of_dissimilar_texts(spark, monkeypatch):
    monkeypatch.setattr(N, "SMALL", 2)
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(400))
    texts = {i: passage + " " + " ".join(f"v{rng.randrange(10**6)}" for _ in range(110)) for i in range(40)}
    texts[40] = texts[7] + " extra"
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(docs_frame(spark, list(texts.items()))).collect()}
    assert got == brute_classes(texts) and got[40] == 7


def test_crowd_of_short_variants(spark):
    """Short texts that meet in crowded buckets only, with a hub that most are not similar to."""
    core = " ".join(f"c{i}" for i in range(8))
    texts = {i: f"{core} x{i}" for i in range(80)}
    texts[80] = core
    middle = " ".join(f"m{i}" for i in range(11))
    for i in range(300):
        texts[100 + 2 * i] = f"p{i} {middle} q{2 * i}"
        texts[101 + 2 * i] = f"p{i} {middle} q{2 * i + 1}"
    want = brute_classes(texts)
    assert {want[i] for i in range(81)} == {0} and len(set(want.values())) == 301
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(docs_frame(spark, list(texts.items()))).collect()}
    assert got == want


def test_sketches_meet_the_miss_rate():
    keep, miss = N.KEEP, N.MISS
    for n in range(1, 120):
        for m in range(-(-4 * n // 5), n + 1):
            same = -(-4 * (n + m) // 9)
            a, b = N.kinds(n, keep, miss), N.kinds(m, keep, miss)
            missed = 1.0
            for k in a.keys() & b.keys():
                p = math.comb(same, k) / math.comb(n + m - same, k)
                missed = min(missed, (1 - p) ** min(a[k], b[k]))
            assert missed <= miss, (n, m)


def test_prefixes_of_similar_texts_meet():
    """Any two sets that share enough for 0.8 have a prefix key in common, whatever is rare."""
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 90))
        m = int(rng.integers(-(-4 * n // 5), n + 1))
        same = -(-4 * (n + m) // 9)
        if same > m:
            continue
        pool = rng.permutation(n + m - same).astype(np.uint64) + np.uint64(1)
        a, b = np.sort(pool[:n]), np.sort(np.concatenate((pool[:same], pool[n:])))
        assert len(b) == m
        assert meet(N.prefix_keys(n, 0, a), N.prefix_keys(m, 0, b), n, m)
        # Those that only one has stand first and are left out.
        alone = [np.concatenate((np.setdiff1d(x, y), np.intersect1d(x, y))) for x, y in ((a, b), (b, a))]
        own = [N.prefix_keys(len(x), len(x) - same, z[len(x) - same :]) for x, z in ((a, alone[0]), (b, alone[1]))]
        assert meet(*own, n, m)


def meet(a, b, n, m):
    """Whether a key is common to both, on the two sides of it and within their own prefixes."""
    first = {k: (s, at) for k, s, at in zip(*(x.tolist() for x in a))}
    for k, s, at in zip(*(x.tolist() for x in b)):
        if k in first and {first[k][0], s} in ({0, 1}, {2}) and 9 * (n - first[k][1]) >= 4 * (n + m) <= 9 * (m - at):
            return True
    return False


def longest_common(a, b):
    """The longest common subsequence, without a band."""
    row = [0] * (len(b) + 1)
    for x in a:
        above = row
        row = [0]
        for j, y in enumerate(b):
            row.append(above[j] + 1 if x == y else max(above[j + 1], row[j]))
    return row[-1]


def test_alignment_equals_the_full_one_where_texts_are_similar():
    rng = np.random.default_rng(8)
    for _ in range(120):
        a = rng.permutation(60).astype(np.uint64)
        b = np.delete(a, rng.integers(0, 60, int(rng.integers(0, 8))))
        at = rng.integers(0, len(b), int(rng.integers(0, 6)))
        b = np.insert(b, at, np.arange(100, 100 + len(at)).astype(np.uint64))
        if rng.random() < 0.4:
            i, j = sorted(rng.integers(0, len(b), 2))
            b = np.concatenate((b[:i], b[j:], b[i:j]))
        full = longest_common(a.tolist(), b.tolist())
        assert N.aligned(a, b) <= full
        assert N.similar(a, b) == (9 * full >= 4 * (len(a) + len(b)))


def test_components_of_chains_and_stars(spark):
    rng = random.Random(6)
    ids = rng.sample(range(10_000), 400)
    links = [(ids[i], ids[i + 1]) for i in range(120)] + [(ids[200], x) for x in ids[201:260]] + [(x, y) for x, y in zip(ids[300:350], ids[301:351])] + [(ids[300], ids[350]), (ids[399], ids[399])]
    links += links[:5] + [(y, x) for x, y in links[5:9]]
    label = {x: x for pair in links for x in pair if pair[0] != pair[1]}
    for _ in label:
        for x, y in links:
            if x != y:
                label[x] = label[y] = min(label[x], label[y])
    got = {r["node"]: r["label"] for r in N.components(spark.createDataFrame(links, "node long, hub long")).collect()}
    assert got == label
    assert N.components(spark.createDataFrame([], "node long, hub long")).count() == 0


def test_one_of_each(spark):
    texts = corpus(5)
    kept = {r["doc_id"] for r in N.one_of_each(docs_frame(spark, list(texts.items()))).collect()}
    assert kept == set(brute_classes(texts).values())


def test_alignment():
    a = np.arange(1, 101, dtype=np.uint64)
    assert N.aligned(a, a) == 100
    assert N.aligned(a, a[::-1].copy()) == 1
    assert N.similar(a, np.concatenate((a[:95], a[:5] + np.uint64(1000))))


def test_odd_rows(spark):
    df = odd_docs(spark)
    rows = N.near_duplicates(df).collect()
    assert len(rows) == 9
    kept = N.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 7]
    assert N.near_duplicates(df.where(F.lit(False))).count() == 0


def test_texts_become_pythons_in_parts():
    """Each part of an Arrow batch comes out before the next is read, with the rows and keys of the whole."""
    import pyarrow as pa

    texts = [" ".join(f"w{k * i % 89}" for k in range(i % 40)) for i in range(2000)] + [None]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(2001), pa.int64()), "text": pa.array(texts), "tkey": pa.array([b"k"] * 2001)})
    out = list(N._sketch([batch, batch.slice(0, 0)]))
    assert max(x.num_rows for x in out) <= N.PART < 2001 == sum(x.num_rows for x in out)
    rows = [r for x in out for r in x.to_pylist()]
    want = [N.bucket_keys(x) for x in N._shingles_of([t or "" for t in texts])]
    assert [r["keys"] for r in rows] == [x.tolist() for x in want] and [r["doc_id"] for r in rows] == list(range(2001))
    same = pa.RecordBatch.from_pydict({"node": pa.array(range(2001), pa.int64()), "hub": pa.array([7] * 2001, pa.int64()), "text": pa.array(texts), "hub_text": pa.array([texts[39]] * 2001)})
    found = [r for x in N._verify([same]) for r in x.to_pylist()]
    hub = next(N._shingles_of([texts[39]]))
    assert found == [{"node": i, "hub": 7} for i, x in enumerate(N._shingles_of([t or "" for t in texts])) if N.similar(hub, x)]
