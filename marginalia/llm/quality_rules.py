"""Quality rules with adaptive thresholds.

Four metrics of each document (mean word length, share of symbols, share of
repeated lines, share of words in repeated three-word windows) are counted into
a log-linear histogram per language and source.  Such a histogram is a
mergeable quantile sketch: sketches of two sets of documents add up bucket by
bucket, the result does not depend on the order of the parts, and any quantile
comes out with a relative error below 1/64.  Shares follow the rule of succession,
(k + 1) / (n + 2), so that texts without a single symbol still spread by their lengths
and every group has a scale of its own.

Thresholds are quantiles of the sketch, extended by the ratio they have to the median: a
group's upper threshold is U * (U / M) ** ``REACH`` with M its median and U its ``UPPER``
quantile, and the lower one of mean word length mirrors it.  Buckets are logarithms, so
this is linear in bucket numbers; a distance below the sketch's resolution counts as one bucket.  There is no constant margin: the same text can be an outlier of
one source and usual in another.
The quantiles of a group of n documents are drawn toward those of its language, and these toward
those of everything, with the weight of ``PRIOR`` documents: a large group decides for itself, a
small one moves smoothly to its language.

Everything runs as DataFrame expressions.  Documents are reduced to bucket
counts before any shuffle, so a source with a third of all rows costs no more
than the others.

Defined results.  Null text counts as empty: no words, which fails the base
rule.  Null lang or source is a group of its own.  Repeated rows are judged
row by row.  A value equal to its threshold (a tie) passes.  Texts of any length are read whole.  An
empty table gives an empty result.  Other columns pass through ``keep_good`` untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import SPACE, let, staged

MIN_WORDS = 50
#: Documents that the quantiles of the coarser group count as, in those of the finer one.
PRIOR = 50
#: The upper quantile in percent; the lower one lies as far below the median.
UPPER = 80
#: Thresholds lie this many times the distance from the median beyond the quantile, in logarithms.
REACH = 4
#: metric -> whether there is a lower threshold too; metrics are integers, shares in millionths.
METRICS = {"word_len": True, "symbols": False, "dup_lines": False, "repeats": False}
#: Up to so many groups their fences (under 100 bytes each) are broadcast.
BROADCAST_GROUPS = 50_000
_F = "__quality_rules"


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def _with_windows(df: DataFrame, width: int = 3) -> DataFrame:
    """Columns with the windows of words as 64-bit hashes, and those hashes that
    occur twice or more.  Each is a column of its own, so that it is built once
    and sorted as plain longs in generated code."""
    words = F.col(f"{_F}_w")
    windows = F.slice(
        F.transform(words, lambda x, i: F.xxhash64(x, *[F.get(words, i + k) for k in range(1, width)])),
        F.lit(1),
        F.greatest(F.size(words) - (width - 1), F.lit(0)),
    )
    h, s = F.col(f"{_F}_h"), F.col(f"{_F}_s")
    df = df.withColumn(f"{_F}_h", windows)
    df = df.withColumn(
        f"{_F}_s",
        F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(h)).otherwise(F.array().cast("array<bigint>")),
    )
    return df.withColumn(f"{_F}_d", F.array_distinct(F.filter(s, lambda x, i: F.get(s, i + 1) == x)))


#: Up to so many repeated windows a text is searched for each of them; beyond,
#: its windows are sorted with their positions.  Both ways give the same.
FEW_REPEATED = 48


def repeated_window_words(width: int = 3) -> Column:
    """Words inside windows of three that occur at least twice in the text."""
    h, d = F.col(f"{_F}_h"), F.col(f"{_F}_d")

    def covered(spots: Column) -> Column:
        return F.size(F.array_distinct(F.flatten(F.transform(spots, lambda i: F.array(*[i + k for k in range(width)])))))

    def of_sorted(s: Column) -> Column:
        again = F.filter(
            s,
            lambda e, k: F.coalesce(e["h"] == F.get(s, k - 1)["h"], F.lit(False))
            | F.coalesce(e["h"] == F.get(s, k + 1)["h"], F.lit(False)),
        )
        return covered(F.transform(again, lambda e: e["i"]))

    numbered = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    few = F.array_remove(F.transform(h, lambda x, i: F.when(F.array_contains(d, x), i).otherwise(-1)), -1)
    return (
        F.when(F.size(d) == 0, F.lit(0))
        .when(F.size(d) <= FEW_REPEATED, covered(few))
        .otherwise(let(F.sort_array(numbered), of_sorted))
    )


def with_features(docs: DataFrame) -> DataFrame:
    """docs plus one struct column with the counts of each text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    out = _with_windows(docs.withColumn(f"{_F}_w", word_list(text)))
    words, of_lines = F.col(f"{_F}_w"), F.col(f"{_F}_l")
    return (
        out.withColumn(f"{_F}_l", lines)
        .withColumn(
            _F,
            F.struct(
                F.size(words).cast("long").alias("n_words"),
                F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
                F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
                (F.size(of_lines) - F.size(F.array_distinct(of_lines))).cast("long").alias("n_dup_lines"),
                F.size(of_lines).cast("long").alias("n_lines"),
                repeated_window_words().cast("long").alias("n_repeat_words"),
            ),
        )
        .drop(*[f"{_F}_{k}" for k in "whsdl"])
    )


def base_failed(f: Column) -> Column:
    return (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > 50 * f["n_words"])


def metric_values(f: Column) -> dict[str, Column]:
    """Integer metrics, so that every engine and order of rows gives the same."""

    def share(part: Column, whole: Column) -> Column:
        return _div((part + 1) * 1_000_000, whole + 2)

    return {
        "word_len": _div(f["word_chars"] * 1000, F.greatest(f["n_words"], F.lit(1))),
        "symbols": share(f["n_symbols"], f["word_chars"]),
        "dup_lines": share(f["n_dup_lines"], f["n_lines"]),
        "repeats": share(f["n_repeat_words"], f["n_words"]),
    }


def _div(a: Column, b: Column) -> Column:
    """The whole part of a quotient of longs that are not negative."""
    return F.call_function("div", a.cast("long"), b.cast("long"))


def bucket(v: Column) -> Column:
    """Log-linear bucket: exact below 128, then 64 buckets to each doubling."""
    e = F.greatest(F.char_length(F.bin(v)) - 7, F.lit(0))
    return (F.call_function("shiftright", v, e) + 64 * e).cast("int")


def bucket_floor(b: Column) -> Column:
    """The least value of a bucket."""
    e = F.greatest(F.floor(b / 64) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", (b - 64 * e).cast("long"), e)


def sketches(featured: DataFrame) -> DataFrame:
    """Bucket counts per lang, source and metric of the texts past the base rule."""
    f = F.col(_F)
    pairs = F.explode(
        F.array(*[F.struct(F.lit(k).alias("metric"), bucket(v).alias("b")) for k, v in metric_values(f).items()])
    )
    return (
        featured.where(~base_failed(f))
        .select(F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), pairs.alias("m"))
        .groupBy("lang", "source", "m.metric", "m.b")
        .agg(F.count("*").alias("n"))
    )


def quantiles(sketch: DataFrame) -> DataFrame:
    """Per group and metric the buckets of the three quantiles, in thousandths: lower, mid and upper.

    Buckets per metric are bounded (64 to each doubling), so each window below holds a
    few thousand rows at most, whatever the number of documents.
    """
    from pyspark.sql import Window

    nothing = F.lit(None).cast("string")
    levels = F.explode(
        F.array(
            F.struct(F.lit(2).alias("level"), F.col("lang").alias("g_lang"), F.col("source").alias("g_source")),
            F.struct(F.lit(1).alias("level"), F.col("lang").alias("g_lang"), nothing.alias("g_source")),
            F.struct(F.lit(0).alias("level"), nothing.alias("g_lang"), nothing.alias("g_source")),
        )
    )
    merged = (
        sketch.select(levels.alias("g"), "metric", "b", "n").groupBy("g", "metric", "b").agg(F.sum("n").alias("n"))
    )
    w = Window.partitionBy("g", "metric")
    ranked = merged.withColumn("upto", F.sum("n").over(w.orderBy("b"))).withColumn("total", F.sum("n").over(w))

    def quantile(percent: int) -> Column:
        return (F.min(F.when(F.col("upto") * 100 >= F.col("total") * percent, F.col("b"))) * 1000).cast("long")

    q = ranked.groupBy("g", "metric").agg(
        F.max("total").alias("n"), *[quantile(k).alias(name) for name, k in (("lower", 100 - UPPER), ("mid", 50), ("upper", UPPER))]
    )
    return q.select("g.level", "g.g_lang", "g.g_source", "metric", "n", "lower", "mid", "upper")


def fences(sketch: DataFrame) -> DataFrame:
    """One row per language and source with the thresholds of each metric, in thousandths of buckets."""
    q = staged(quantiles(sketch), "quantiles", small=True)
    names = ("lower", "mid", "upper")

    def drawn(own: DataFrame, coarse: DataFrame, on) -> DataFrame:
        coarse = coarse.select(*[F.col(c).alias(f"c_{c}") for c in ("g_lang", "metric", *names)])
        both = own.join(coarse, (F.col("metric") == F.col("c_metric")) & on, "left")
        moved = [_div(F.col("n") * F.col(c) + PRIOR * F.col(f"c_{c}"), F.col("n") + PRIOR).alias(c) for c in names]
        return both.select("g_lang", "g_source", "metric", "n", *moved)

    everything, langs, groups = (q.where(F.col("level") == k) for k in range(3))
    langs = drawn(langs, everything, F.lit(True))
    groups = drawn(groups, langs, F.col("g_lang").eqNullSafe(F.col("c_g_lang")))
    two_sided = F.col("metric").isin([k for k, v in METRICS.items() if v])
    # The sketch tells distances to a bucket; a smaller one counts as that.
    up, down = (F.greatest(F.col(a) - F.col(b), F.lit(1000)) for a, b in (("upper", "mid"), ("mid", "lower")))
    hi = F.col("upper") + REACH * up
    lo = F.when(two_sided, F.col("lower") - REACH * down).otherwise(-1)
    return (
        groups.select("g_lang", "g_source", "metric", F.struct(lo.cast("long").alias("lo"), hi.alias("hi")).alias("f"))
        .groupBy("g_lang", "g_source").agg(F.map_from_entries(F.collect_list(F.struct("metric", "f"))).alias("fence"))
    )


def judged(featured: DataFrame) -> DataFrame:
    """featured plus boolean columns for the base rule and the verdict."""
    table = staged(fences(sketches(featured)), "fences", small=True)
    few = table.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    side = table.select(F.col("g_lang").alias(f"{_F}_l"), F.col("g_source").alias(f"{_F}_s"), F.col("fence").alias(f"{_F}_f"))
    on = F.col("lang").cast("string").eqNullSafe(F.col(f"{_F}_l")) & F.col("source").cast("string").eqNullSafe(F.col(f"{_F}_s"))
    out = featured.join(F.broadcast(side) if few else side, on, "left").drop(f"{_F}_l", f"{_F}_s")
    f, fence = F.col(_F), F.col(f"{_F}_f")
    inside = F.lit(True)
    for k, v in metric_values(f).items():
        inside = inside & F.coalesce((bucket(v).cast("long") * 1000).between(fence[k]["lo"], fence[k]["hi"]), F.lit(True))
    return out.withColumn(f"{_F}_bad", base_failed(f)).withColumn(f"{_F}_ok", ~F.col(f"{_F}_bad") & inside)


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept, one row per row of docs."""
    f = F.col(_F)
    slim = staged(with_features(docs.select("doc_id", "text", "lang", "source")).drop("text"), "features")
    return judged(slim).select(
        "doc_id",
        *[f[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.col(f"{_F}_bad").alias("base_failed"),
        F.col(f"{_F}_ok").alias("kept"),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, with the columns of docs."""
    full = staged(with_features(docs), "featured")
    return judged(full).where(F.col(f"{_F}_ok")).select(*docs.columns)
