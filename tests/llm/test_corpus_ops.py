"""Decontamination, mixing, URL rules and the pipeline."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.llm import decontam, mixing, url_rules
from tests.llm.helpers import docs_frame, odd_docs

BENCH = "item_id long, text string"


def bench_frame(spark, rows):
    return spark.createDataFrame(rows, BENCH)


def test_wand_equals_full_scores():
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(120)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 40)))) for i in range(70)]
    index = decontam.Index(items)
    for _ in range(60):
        query = sorted(rng.sample(range(len(index.terms)), rng.randint(1, 40)))
        full: dict[int, float] = {}
        for t in query:
            for i, w in zip(index.docs[t], index.impacts[t]):
                full[i] = full.get(i, 0.0) + w
        for threshold in (0.1, 0.3, 0.5):
            got = dict(index.wand(query, threshold))
            want = {i: s for i, s in full.items() if s >= threshold - 1e-9}
            assert got.keys() == want.keys()
            assert all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_contamination_equals_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(900)]

    def words(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    items = [(i, " ".join(words(rng.randint(12, 60))) + ". So it is " + " ".join(words(4)) + ".") for i in range(20)]
    items += [(20, items[3][1]), (21, None), (22, "  ")]
    docs, want = [], set()
    for d in range(60):
        w = words(rng.randint(0, 300))
        if d % 3 == 0:
            i = rng.randrange(20)
            at = rng.randint(0, len(w))
            w[at:at] = items[i][1].upper().split()
            want.add((d, i))
            if i == 3:
                want.add((d, 20))
        docs.append((d, " ".join(w)))
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs_frame(spark, docs), bench_frame(spark, items)).collect()}
    assert got == want
    monkeypatch.setattr(decontam, "INDEX_BYTES", 1500)
    parts = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs_frame(spark, docs), bench_frame(spark, items)).collect()}
    assert parts == want
    left = {r["doc_id"] for r in decontam.drop_contaminated(docs_frame(spark, docs), bench_frame(spark, items)).collect()}
    assert left == set(range(60)) - {d for d, _ in want}


def test_parts_change_no_score(spark, monkeypatch):
    rng = random.Random(13)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(8, 30)))) for i in range(25)] + [(3, "w1 w2 w3")] * 2
    docs = [(d, " ".join(rng.choice(vocabulary) for _ in range(40)) + " " + rng.choice(items)[1]) for d in range(40)]

    def found():
        return sorted(map(tuple, decontam.contaminated(docs_frame(spark, docs), bench_frame(spark, items)).collect()))

    whole = found()
    assert whole
    monkeypatch.setattr(decontam, "INDEX_BYTES", 900)
    assert found() == whole


def test_answer_has_to_stand_by_the_question(spark):
    """A long text that holds all words of the answer, but far from the question, is clean."""
    question = " ".join(f"q{i}" for i in range(20))
    answer = "red green blue"
    item = f"{question}. {answer}"
    filler = " ".join(f"f{i}" for i in range(400))
    docs = [(1, f"{question}. none of those {filler} {answer}"), (2, f"{filler} {item} {filler}")]
    got = {r["doc_id"] for r in decontam.contaminated(docs_frame(spark, docs), bench_frame(spark, [(1, item)])).collect()}
    assert got == {2}


def test_items_of_few_words(spark):
    items = [(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in range(1, 8)] + [(10, "Who wrote Hamlet ? William Shakespeare")]
    filler = " ".join(f"f{k}" for k in range(70))
    docs, want = [], set()
    for n, (item, text) in enumerate(items):
        docs += [(10 * n, text), (10 * n + 1, f"{filler} {text.upper()} {filler}"), (10 * n + 2, f"{filler} {' '.join(text.split()[:-1][::-1])}")]
        want |= {(10 * n, item), (10 * n + 1, item)}
    docs.append((900, filler))
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs_frame(spark, docs), bench_frame(spark, items)).collect()}
    assert got == want
    left = {r["doc_id"] for r in decontam.drop_contaminated(docs_frame(spark, docs), bench_frame(spark, items)).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in want}


def test_decontamination_odd_rows(spark):
    items = bench_frame(spark, [(1, "w1x1 w2x2 w3x3 w4x4 w5x5 w6x6 w7x7"), (None, "nothing like that here at all")])
    df = odd_docs(spark)
    kept = decontam.drop_contaminated(df, items)
    assert kept.columns == df.columns and kept.count() == 7
    assert decontam.drop_contaminated(df, bench_frame(spark, [])).count() == 9
    assert decontam.contaminated(df.where(F.lit(False)), items).count() == 0


def labels_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def mix_case(spark):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(300):
        q, t = int(rng.random() < 0.6), int(rng.random() < 0.3)
        w = [f"w{rng.randrange(50)}" for _ in range(rng.randint(20, 60))]
        w = w if q else [x + "###" for x in w]
        w += ["awful", "nasty", "vile"] if t else []
        docs.append((i, " ".join(w)))
        labels.append((i, q, t))
    return docs_frame(spark, docs), labels_frame(spark, labels)


def test_rates_meet_the_targets(spark):
    docs, labels = mix_case(spark)
    rows = mixing.mixing_report(docs, labels).collect()
    total = sum(r["n_tokens"] for r in rows)
    assert min(r["rate"] for r in rows) >= 0
    for d, share in mixing.TARGETS.items():
        assert abs(sum(r["n_tokens"] * r[f"p_{d}"] * r["rate"] for r in rows) - share * total) < 0.01 * total
    truth = {r["doc_id"]: f"q{r['quality']}t{r['toxic']}" for r in labels.collect()}
    assert sum(max(mixing.TARGETS, key=lambda d: r[f"p_{d}"]) == truth[r["doc_id"]] for r in rows) >= 0.95 * len(rows)
    plan = mixing.mixing_report(docs, labels)._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_rates_solve_the_least_squares_problem(spark):
    """Against non-negative least squares by enumeration of supports, on targets that can't be met."""
    docs, labels = mix_case(spark)
    targets = {"q1t0": 0.2, "q0t1": 0.8}
    rows = mixing.mixing_report(docs, labels, targets).collect()
    domains = sorted(k[2:] for k in rows[0].asDict() if k.startswith("p_"))
    a = np.array([[r["n_tokens"] * r[f"p_{d}"] for r in rows] for d in domains])
    total = sum(r["n_tokens"] for r in rows)
    goal = np.array([targets.get(d, 0.0) for d in domains]) * total
    rate = np.array([r["rate"] for r in rows])
    gap = np.abs(a @ rate - goal).sum() / total
    assert rate.min() >= 0 and abs(gap - rows[0]["residual"]) < 1e-2 * max(gap, 1e-3)
    # Plain projected gradient on the same problem, in many small steps.
    metric, r = np.linalg.pinv(a @ (a / a.sum(axis=0)).T), np.ones(len(rows))
    share = a / a.sum(axis=0)
    for _ in range(4000):
        r = np.maximum(0, r - 0.5 * share.T @ metric @ (a @ r - goal))
    assert np.abs(a @ r - goal).sum() / total >= gap - 0.02


def test_evidence_beyond_the_strongest_tokens(spark):
    """Each text has one of 120 telling words: no short list of tokens could tell them apart."""
    rng = random.Random(17)
    docs, labels = [], []
    for i in range(1200):
        q = int(rng.random() < 0.5)
        docs.append((i, " ".join(f"w{rng.randrange(30)}" for _ in range(12)) + "".join(f" {'good' if q else 'bad'}{rng.randrange(60)}" for _ in range(10))))
        labels.append((i, q, 0))
    rows = {r["doc_id"]: r for r in mixing.mixing_report(docs_frame(spark, docs), labels_frame(spark, labels)).collect()}
    assert sum((rows[i]["p_q1t0"] > 0.5) == bool(q) for i, q, _ in labels) >= 0.97 * len(labels)


def test_mixed_repeats_by_rate(spark):
    docs, labels = mix_case(spark)
    rate = {r["doc_id"]: r["rate"] for r in mixing.mixing_report(docs, labels).collect()}
    count = {r["doc_id"]: r["count"] for r in mixing.mixed(docs, labels).groupBy("doc_id").count().collect()}
    assert all(int(rate[i]) <= count.get(i, 0) <= int(rate[i]) + 1 for i in rate)


def test_mixing_odd_rows(spark):
    df, none = odd_docs(spark), labels_frame(spark, [])
    assert mixing.mixed(df, none).columns == df.columns
    assert {r["rate"] for r in mixing.mixing_report(df, none).collect()} == {1.0}
    some = labels_frame(spark, [(4, 1, 0), (5, 0, 1), (None, 1, 1), (7, None, None)])
    assert mixing.mixing_report(df, some).count() == 9
    assert mixing.mixed(df.where(F.lit(False)), some).count() == 0


URLS = [
    "http://A.Org/x", "https://sub.example.org/es/1?q", "http://example.org/en/12", "http://example.org/en/2", "https://b.com/fr/x#y", "https://com/de/", "http://x.net/de/1",
    "no scheme", None, "http://org?x=/", "ftp://u:p@h.org/a://b.com/de/", "http://notorg/",
]


def plain_verdict(url):
    url = url or ""
    if "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = rest
    for c in "/?#":
        host = host.split(c)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in url_rules.RULES:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best and best[0], best[1] if best else "allow"


def test_url_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_rules.url_verdicts(pages, labels_frame(spark, [])).collect()}
    assert got == {i: plain_verdict(u) for i, u in enumerate(URLS)}


def test_mined_rules(spark):
    rng = random.Random(7)
    pages, labels = [], []
    for i in range(400):
        bad = rng.random() < 0.2
        pages.append((i, f"http://{'spam' if bad else 'good' + str(rng.randrange(9))}.net/{rng.choice(['en', 'fr'])}/{i}"))
        labels.append((i, 0 if bad else 1, 0))
    pages += [(1000, "http://spam.net/it/9"), (1001, "http://spam.org/it/9"), (None, None), (5, "http://good1.net/en/1")]
    frame = spark.createDataFrame(pages, "page_id long, url string")
    got = {r["page_id"]: r for r in url_rules.url_verdicts(frame, labels_frame(spark, labels)).collect()}
    assert got[1000]["verdict"] == "block" and got[1000]["mined"]
    assert got[1001]["verdict"] == "allow" and got[1001]["mined"]
    assert all((got[i]["verdict"] == "block") == (q == 0) for i, q, _ in labels)
    rules = url_rules.mine(
        frame.withColumn("host", F.lit("x")).withColumn("tokens", url_rules.url_tokens(F.col("url"), *url_rules.host_and_path(F.col("url")))), labels_frame(spark, labels)
    )[0].collect()
    assert [r["tokens"] for r in rules] == [["h:spam"]]
    assert url_rules.url_verdicts(frame.where(F.lit(False)), labels_frame(spark, labels)).count() == 0


def test_mined_verdicts_equal_brute_force(spark):
    """Every combination of tokens of every labelled page is counted."""
    from itertools import combinations

    rng = random.Random(19)
    pages, labels = [], []
    for i in range(260):
        host, first, names = rng.choice("abcd"), rng.choice(["1", "a-very-long-first-segment-of-a-path", "x", ""]), [n for n in ("u", "v") if rng.random() < 0.4]
        names += ["m1", "m2", "m3"] if rng.random() < 0.2 else []
        url = f"http://{host}.net/{first}" + ("?" + "&".join(n + "=1" for n in names) if names else "") + "#z?w=1"
        pages.append((i, url))
        if i < 200:
            labels.append((i, int(rng.random() > (0.9 if host == "a" and first == "1" else 0.95 if "m2" in names else 0.1)), 0))
    pages.append((999, "http://b.net/x?m3=2"))
    frame = spark.createDataFrame(pages, "page_id long, url string")
    host, path = url_rules.host_and_path(F.col("url"))
    tokens = {r["page_id"]: set(r["t"]) for r in frame.select("page_id", url_rules.url_tokens(F.col("url"), host, path).alias("t")).collect()}
    assert not any("q:w" in t for t in tokens.values()) and any("p:a-very-long-first-segment-of-a-path" in t for t in tokens.values())
    bad = {i for i, q, _ in labels if q == 0}
    least = max(url_rules.LEAST_COUNT, -(-len(bad) * 2 // 100))
    count: dict[tuple, list[int]] = {}
    for i, _, _ in labels:
        for size in range(1, len(tokens[i]) + 1):
            for x in combinations(sorted(tokens[i]), size):
                own = count.setdefault(x, [0, 0])
                own[0] += 1
                own[1] += i in bad
    rules = [set(x) for x, (n, b) in count.items() if b >= least and b / n >= url_rules.MIN_CONFIDENCE and b / n / (len(bad) / len(labels)) >= url_rules.MIN_LIFT]
    assert rules
    got = {r["page_id"]: r["mined"] for r in url_rules.url_verdicts(frame, labels_frame(spark, labels)).collect()}
    assert got == {i: any(x <= t for x in rules) for i, t in tokens.items()}
    assert got[999]


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(11)

    def text(n=90):
        return " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))

    item = text(30)
    rows = [(i, text(), "en", "s") for i in range(60)]
    rows += [(100, rows[0][1], "en", "s"), (101, rows[1][1] + " more", "en", "s"), (102, text() + " " + item, "en", "s"), (103, "short", "en", "s"), (104, None, "en", "s")]
    docs = docs_frame(spark, rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench_frame(spark, [(1, item)]).write.parquet(str(tmp_path / "benchmark.parquet"))
    labels_frame(spark, []).write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == before.columns, name
    out = pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(60)) == sorted(r["doc_id"] for r in docs.collect())


def test_pipeline_of_odd_rows(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    bench_frame(spark, [(1, "some item text of a few words")]).write.parquet(str(tmp_path / "benchmark.parquet"))
    labels_frame(spark, [(4, 1, 0)]).write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in pipeline.STAGES:
        for df in (odd_docs(spark), odd_docs(spark).where(F.lit(False))):
            stage(spark, df, str(tmp_path)).collect()


def test_pipeline_leaves_one_stage_on_disk(spark, tmp_path):
    """Stages written and read one by one, as their contract has it: what earlier ones put aside goes."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(12)
    rows = [(i, " ".join(f"w{rng.randrange(10**5)}" for _ in range(90))) for i in range(40)]
    docs_frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    bench_frame(spark, [(1, "an item of some words that none has")]).write.parquet(str(tmp_path / "benchmark.parquet"))
    labels_frame(spark, []).write.parquet(str(tmp_path / "labels.parquet"))
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    others = set(shared.glob("*"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), set()
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        left = set(shared.glob("*")) - others
        assert not left & seen, name
        seen = left
        out.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
    assert sorted(r["doc_id"] for r in docs.collect()) == list(range(40))
    before = set(shared.glob("*"))
    assert pipeline.run(spark, str(tmp_path)).count() == 40
    # The result and the token files are all that stays.
    assert sorted(p.name.split("-")[1] for p in set(shared.glob("*")) - before) == ["sst", "stage"]
