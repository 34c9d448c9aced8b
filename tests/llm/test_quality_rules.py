import glob
import random
import re

from pyspark.sql import functions as F

from marginalia.llm import quality_rules as Q
from marginalia.llm.common import staged_since, staged_so_far
from tests.llm.helpers import docs_frame, odd_docs


def brute(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {k for v in seen.values() if len(v) > 1 for i in v for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_counts_equal_brute_force(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "b", "é", "#x", "\n", "\t", "zz zz"]) for _ in range(rng.randint(0, 400))) for _ in range(40)]
    texts += [None, "", "a b", "a b c", "a a a a", "same\nsame\n\n \nsame"]
    rows = Q.quality_report(docs_frame(spark, list(enumerate(texts)))).collect()
    for r in rows:
        want = brute(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_buckets_are_monotone_and_tight(spark):
    rows = spark.range(0, 300_000, 7).select("id", Q.bucket(F.col("id")).alias("b"))
    rows = rows.withColumn("lo", Q.bucket_floor(F.col("b"))).orderBy("id").collect()
    assert all(x["b"] <= y["b"] for x, y in zip(rows, rows[1:]))
    assert all(r["lo"] <= r["id"] <= r["lo"] * (1 + 1 / 64) + 1 for r in rows)


def test_sketch_quartile_and_verdict(spark):
    rng = random.Random(2)
    good = [(i, " ".join(f"w{rng.randint(0, 10**6):06d}" for _ in range(80)), "en", "s") for i in range(400)]
    junk = [(1000 + i, " ".join(f"w{rng.randint(0, 10**6):06d}###" for _ in range(80)), "en", "s") for i in range(10)]
    got = {r["doc_id"]: r["kept"] for r in Q.quality_report(docs_frame(spark, good + junk)).collect()}
    assert all(got[i] for i in range(400))
    assert not any(got[1000 + i] for i in range(10))


def spread_docs():
    """Two large sources, one of which often has symbols, and a small one."""
    rng = random.Random(5)

    def text(symbols):
        words = [f"w{rng.randint(0, 10**6):06d}" for _ in range(rng.randint(60, 400))]
        return " ".join(w[:-1] + "#" if rng.random() < symbols else w for w in words)

    rows = [(i, text(0), "en", "prose") for i in range(300)]
    rows += [(1000 + i, text(rng.random() * 0.3), "en", "code") for i in range(300)]
    rows += [(2000 + i, text(0), "en", "small") for i in range(3)]
    probe = " ".join(f"w{i:05d}#" for i in range(200))
    return rows + [(5000, probe, "en", "prose"), (5001, probe, "en", "code"), (5002, probe, "en", "small"), (5003, probe, None, None)]


def test_sources_decide_differently(spark):
    got = {r["doc_id"]: r["kept"] for r in Q.quality_report(docs_frame(spark, spread_docs())).collect()}
    assert not got[5000] and got[5001]
    assert sum(got[i] for i in range(300)) >= 294 and sum(got[1000 + i] for i in range(300)) >= 294


def test_thresholds_equal_brute_force(spark):
    """Quantiles of the sorted values, drawn toward language and everything."""
    docs = docs_frame(spark, spread_docs())
    featured = Q.with_features(docs)
    f = F.col(Q._F)
    values = featured.select("lang", "source", *[(Q.bucket(v)).alias(k) for k, v in Q.metric_values(f).items()], Q.base_failed(f).alias("bad")).where("not bad").collect()
    got = {(r["g_lang"], r["g_source"]): r["fence"] for r in Q.fences(Q.sketches(featured)).collect()}

    def cut(rows, metric, percent):
        own = sorted(r[metric] for r in rows)
        return 1000 * own[-(-len(own) * percent // 100) - 1]

    def drawn(rows, metric, coarse):
        n = len(rows)
        return [(n * cut(rows, metric, p) + Q.PRIOR * c) // (n + Q.PRIOR) for p, c in zip((100 - Q.UPPER, 50, Q.UPPER), coarse)]

    assert len(got) == 4
    for (lang, source), fence in got.items():
        of_lang = [r for r in values if r["lang"] == lang]
        own = [r for r in of_lang if r["source"] == source]
        for metric, two_sided in Q.METRICS.items():
            top = [cut(values, metric, p) for p in (100 - Q.UPPER, 50, Q.UPPER)]
            a, b, c = drawn(own, metric, drawn(of_lang, metric, top))
            assert fence[metric]["hi"] == c + Q.REACH * max(c - b, 1000)
            assert fence[metric]["lo"] == (a - Q.REACH * max(b - a, 1000) if two_sided else -1)


def test_texts_alike_up_to_the_resolution_stay(spark):
    """Where most values share a bucket, those of the next ones are no outliers."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(10**5)}" for _ in range(90)), "en", "s") for i in range(200)]
    got = Q.quality_report(docs_frame(spark, rows)).where("kept").count()
    assert got >= 198


def test_small_group_leans_on_its_language(spark):
    """With three documents the thresholds are the language's; with many, those of texts like them."""
    rows = spread_docs()
    few = {r["g_source"]: r["fence"]["symbols"]["hi"] for r in Q.fences(Q.sketches(Q.with_features(docs_frame(spark, rows)))).collect()}
    more = [(9000 + i, r[1], "en", "small") for i, r in enumerate(rows[:300])]
    many = {r["g_source"]: r["fence"]["symbols"]["hi"] for r in Q.fences(Q.sketches(Q.with_features(docs_frame(spark, rows + more)))).collect()}
    assert abs(many["small"] - many["prose"]) < abs(few["small"] - few["prose"]) / 2


def test_odd_rows(spark):
    df = odd_docs(spark)
    assert Q.quality_report(df).count() == 9
    assert Q.keep_good(df).columns == df.columns
    assert Q.keep_good(df.where(F.lit(False))).count() == 0


def test_small_tables_have_few_files(spark):
    docs = docs_frame(spark, [(i, " ".join(f"w{i}x{k}" for k in range(60)), f"l{i % 7}", f"s{i % 40}") for i in range(300)])
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, old = staged_so_far(), {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert Q.quality_report(docs).where("kept").count() == 300
        files = {p.rsplit("marginalia-")[-1].split("-")[0]: len(glob.glob(f"{p.removeprefix('file:')}/part-*")) for p in staged_since(before)}
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert files["quantiles"] <= 2 and files["fences"] <= 2
