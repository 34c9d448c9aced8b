"""Document rates that bring soft domains to target weights.

Domains are the combinations of the labels' quality and toxic marks.  A naive Bayes
classifier over all distinct tokens of a text, learned from the labelled
documents, gives every document its posterior over domains.  Tokens are words (lower-case
runs of letters, digits and characters beyond ASCII) and marks of
document statistics: the shares of symbols, of capitals and of distinct
words, in steps.  Tokens are hashed to ``BUCKETS`` weights per domain, the log odds of presence; absence
counts through a constant.  Each weight is drawn toward 0
by 1 - ``NOISE`` / v, with v the token's mean square contingency (chi-squared per text): no number of
tokens is fixed, and those whose presence hardly depends on the domain, but comes in thousands in a
long text, add nothing.  A temperature, fitted on a fifth of the labelled sample kept back, undoes
what overconfidence is left.

The rates r (times that a document is to be used) minimise ||A r - T||^2 under
r >= 0, where column d of A is the document's token count times its posteriors
and T the target tokens per domain.  Projected gradient descent starts at r = 1.  The
residual is measured in the metric of the inverse Gram matrix of A and steps
are per token, which makes the Lipschitz constant 1 (so step 1 descends
in every iteration) and the first step exact unless a rate would fall below zero.
Each iteration is one aggregation of the documents' slim rows; only vectors and
matrices of the size of the number of domains reach the driver.  It ends at ``TOLERANCE``, where
it stalls, or after ``ITERATIONS``; the report's column ``residual`` says how far the totals are from the targets.

All of it is DataFrame expressions.

Defined results.  Null text counts as empty: no tokens, rate as any other.  Labels with
nulls are ignored; of several for one doc_id the largest marks count.
Without labels there is one domain and every rate is 1.  Domains without labels are left out
and the targets of the others scaled up.  Repeated rows have rates row by row; an
empty table gives an empty result.  Ties between domains need no rule, since posteriors are used as they
are.  Texts of any length count whole.  Other columns pass through ``mixed`` untouched.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import SPACE, let, staged

#: Target share of tokens by domain (quality, toxic), where a call gives none.
TARGETS = {"q1t0": 0.90, "q1t1": 0.04, "q0t0": 0.05, "q0t1": 0.01}
BUCKETS = 1 << 15
#: Labelled documents that the classifier is fitted on, in the mean.
SAMPLE = 8_000
LEAST_COUNT = 5
#: Mean square contingency up to which a token counts as noise.
NOISE = 0.03
ITERATIONS = 24
TOLERANCE = 1e-6
#: Targets that no rates can meet: the descent ends once a step lowers the objective by less than this share.
STALL = 0.002
_P = "__mixing"


def tokens(text: Column) -> Column:
    """The distinct tokens of a text as 64-bit hashes, with the marks of its statistics."""
    words = F.array_remove(F.split(F.lower(text), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")
    size = F.greatest(F.char_length(text), F.lit(1))
    symbols = F.regexp_count(text, F.lit(r"[#*$%&|<>!]"))
    capitals = F.regexp_count(text, F.lit(r"[A-Z]"))

    def step(share: Column, by: int, most: int, name: str) -> Column:
        return F.xxhash64(F.lit(name), F.least(F.floor(share * by), F.lit(most)))

    hashes = F.transform(words, lambda x: F.xxhash64(x))

    def marked(distinct: Column) -> Column:
        return F.concat(
            distinct,
            F.array(
                step(symbols / size, 100, 6, "symbols"),
                step(capitals / size, 10, 6, "capitals"),
                step(F.size(distinct) / F.greatest(F.size(words), F.lit(1)), 10, 9, "distinct"),
            ),
        )

    return let(F.array_distinct(hashes), marked)


def n_tokens(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, f"{SPACE}+"), "")).cast("long")


class Classifier:
    """Domains, their constants, a row of weights per domain, and the temperature."""

    def __init__(self, domains: list[str], constant: list[float], weights: np.ndarray | None, temperature: float = 1.0):
        self.domains, self.constant, self.weights, self.temperature = domains, constant, weights, temperature

    def evidence(self, found: Column) -> Column:
        """Per domain the sum of the weights of a text's tokens.  Buckets with a weight have a slot; the
        slots of all buckets and the weights by slot are constants of the plan, looked up by position."""
        told = np.flatnonzero(np.abs(self.weights).sum(axis=0))
        slots = np.zeros(BUCKETS, int)
        slots[told] = np.arange(1, len(told) + 1)
        slot = _constant(map(str, slots.tolist()), "int")
        rows = [_constant(["0", *(f"{w:.2f}" for w in row[told])], "double") for row in self.weights]

        def total(x: Column, row: Column) -> Column:
            return F.aggregate(x, F.lit(0.0), lambda acc, i: acc + F.get(row, i))

        spots = F.filter(F.transform(found, lambda t: F.get(slot, F.pmod(t, F.lit(BUCKETS)).cast("int"))), lambda i: i > 0)
        return let(spots, lambda x: F.array(*[total(x, row) for row in rows]))

    def posterior(self, found: Column) -> Column:
        """Array of posteriors by domain from the array of a text's tokens."""
        if self.weights is None or len(self.domains) == 1:
            return F.array(*[F.lit(1.0 / len(self.domains)) for _ in self.domains])
        return softmax(self.evidence(found), self.constant, F.lit(float(self.temperature)))


def _constant(values, kind: str) -> Column:
    """An array of numbers that the optimizer folds to one constant."""
    return F.split(F.lit(",".join(values)), ",").cast(f"array<{kind}>")


def softmax(sums: Column, constant: list[float], temperature: Column) -> Column:
    start = _constant(map(repr, map(float, constant)), "double")
    logs = F.transform(sums, lambda x, k: (F.get(start, k) + x) / temperature)

    def normal(x: Column) -> Column:
        weights = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
        return let(weights, lambda w: F.transform(w, lambda v: v / F.aggregate(w, F.lit(0.0), lambda a, b: a + b)))

    return let(logs, normal)


#: Temperatures tried.
GRID = tuple(float(x) for x in np.round(np.geomspace(1, 64, 25), 4))


def fit(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Learn from a sample of the labelled documents, drawn by a hash of doc_id."""
    truth = (
        labels.where("doc_id is not null and quality is not null and toxic is not null")
        .groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
        .select("id", F.concat(F.lit("q"), (F.col("q") > 0).cast("int"), F.lit("t"), (F.col("t") > 0).cast("int")).alias("domain"))
    )
    n = truth.count()
    if not n:
        return Classifier(["all"], [0.0], None)
    draw = F.pmod(F.xxhash64("id", F.lit(31)), F.lit(1 << 20)) < min(1.0, SAMPLE / n) * (1 << 20)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), tokens(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("tokens"))
    rows = rows.withColumn("kept", F.pmod(F.xxhash64("id", F.lit(41)), F.lit(5)) == 0)
    sample = staged(rows.where(draw).join(truth.where(draw), "id"), "mix-sample")
    sizes = {r["domain"]: r["count"] for r in sample.groupBy("domain").count().collect()}
    if not sizes:
        return Classifier(["all"], [0.0], None)
    domains = sorted(sizes)
    constant = [float(np.log(sizes[d] / sum(sizes.values()))) for d in domains]
    each = sample.where("not kept").select("domain", F.explode("tokens").alias("t")).select("domain", F.pmod("t", F.lit(BUCKETS)).cast("int").alias("b"))
    each = each.groupBy("b").agg(*[F.count(F.when(F.col("domain") == d, 1)).alias(d) for d in domains])
    counts = np.zeros((len(domains), BUCKETS))
    for r in each.collect():  # at most BUCKETS rows
        counts[:, r["b"]] = [r[d] for d in domains]
    texts = sample.where("not kept").groupBy("domain").count().collect()
    share = np.array([sum(r["count"] for r in texts if r["domain"] == d) for d in domains], float)
    total, number = counts.sum(axis=0), max(1.0, share.sum())
    expected = share[:, None] / number * total
    chi = ((counts - expected) ** 2 / np.maximum(expected, 1e-9)).sum(axis=0) / number
    drawn = np.maximum(0.0, 1 - NOISE / np.maximum(chi, 1e-12)) * (total >= LEAST_COUNT)
    present = np.clip((counts + total / number) / (share[:, None] + 1), 1e-6, 0.99)
    weights = np.round(drawn * (np.log(present) - np.log1p(-present)), 2)
    constant = [c + float(x) for c, x in zip(constant, (drawn * np.log1p(-present)).sum(axis=1), strict=True)]
    model = Classifier(domains, constant, weights)
    if len(domains) == 1:
        return model
    own = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("domain")).cast("int") - 1
    scored = sample.where("kept").select(own.alias("own"), model.evidence(F.col("tokens")).alias("sums"))
    grid = _constant(map(repr, GRID), "double")
    losses = F.transform(grid, lambda t: -F.log(F.get(softmax(F.col("sums"), constant, t), F.col("own")) + 1e-12))
    loss = {r["pos"]: r["loss"] for r in scored.select(F.posexplode(losses)).groupBy("pos").agg(F.sum("col").alias("loss")).collect()}
    if loss:
        model.temperature = GRID[min(loss, key=lambda k: (loss[k], k))]
    return model


def with_posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = docs.withColumn(f"{_P}_t", tokens(text))
    return out.withColumn(f"{_P}_p", model.posterior(F.col(f"{_P}_t"))).withColumn(f"{_P}_n", n_tokens(text)).drop(f"{_P}_t")


def rate(steps: list[np.ndarray]) -> Column:
    """The rate after the given steps: r = max(0, r - P.y) for each y.  The steps are one constant, so
    that the code of a plan is the same in every iteration."""
    if not steps:
        return F.lit(1.0)
    size = len(steps[0])
    p = [F.get(F.col(f"{_P}_p"), F.lit(k)) for k in range(size)]
    flat = _constant((repr(float(v)) for y in steps for v in y), "double")

    def step(r: Column, i: Column) -> Column:
        return F.greatest(F.lit(0.0), r - sum(p[k] * F.get(flat, i * size + k) for k in range(size)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(steps) - 1)), F.lit(1.0), step)


def solve(rows: DataFrame, domains: list[str], targets: dict[str, float] | None = None) -> tuple[list[np.ndarray], float]:
    """The steps of projected gradient descent, and the residual after them: the sum of the distances
    from the targets as a share of all tokens.  rows have posteriors and token counts."""
    targets = TARGETS if targets is None else targets
    size = len(domains)
    p = [F.get(F.col(f"{_P}_p"), F.lit(k)) for k in range(size)]
    n = F.col(f"{_P}_n")
    gram = rows.agg(
        F.sum(n).alias("n"), *[F.sum(n * p[a] * p[b]).alias(f"g{a}_{b}") for a in range(size) for b in range(a, size)]
    ).first()
    if not gram["n"]:
        return [], 0.0
    wanted = np.array([targets.get(d, 0.0) for d in domains])
    if not wanted.sum():
        return [], 0.0
    goal = wanted / wanted.sum() * gram["n"]
    g = np.zeros((size, size))
    for a in range(size):
        for b in range(a, size):
            g[a, b] = g[b, a] = gram[f"g{a}_{b}"]
    metric = np.linalg.pinv(g, rcond=1e-10)
    steps: list[np.ndarray] = []
    last = float("inf")
    while True:
        r = rate(steps)
        now = rows.agg(*[F.sum(n * p[k] * r).alias(f"s{k}") for k in range(size)]).first()
        gap = np.array([now[f"s{k}"] for k in range(size)]) - goal
        residual = float(np.abs(gap).sum() / gram["n"])
        now_at = float(gap @ metric @ gap)
        if residual <= TOLERANCE or len(steps) == ITERATIONS or now_at > (1 - STALL) * last:
            return steps, residual
        last = now_at
        # Nine significant digits: sums in another order give the same steps.
        steps.append(np.array([float(f"{v:.9g}") for v in metric @ gap]))


def mixing_report(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_tokens, a column of posteriors per domain, rate, and the residual of the whole fit."""
    model = fit(docs, labels)
    rows = staged(with_posteriors(docs.select("doc_id", "text"), model).drop("text"), "mix")
    steps, residual = solve(rows, model.domains, targets)
    return rows.select(
        "doc_id",
        F.col(f"{_P}_n").alias("n_tokens"),
        *[F.get(F.col(f"{_P}_p"), F.lit(k)).alias(f"p_{d}") for k, d in enumerate(model.domains)],
        rate(steps).alias("rate"),
        F.lit(float(f"{residual:.3g}")).alias("residual"),
    )


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """docs with each row as often as its rate says, with the columns of docs.

    The whole part of the rate is taken as it is; its fraction is the chance of one more, decided by a
    hash of doc_id and text, so that a repeated run gives the same rows.
    """
    model = fit(docs, labels)
    rows = staged(with_posteriors(docs, model), "mixed")
    steps, _ = solve(rows, model.domains, targets)
    r = rate(steps)
    part = F.pmod(F.xxhash64("doc_id", "text", F.lit(37)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = (F.floor(r) + F.when(part < r - F.floor(r), 1).otherwise(0)).cast("int")
    out = rows.withColumn(f"{_P}_k", times).where(F.col(f"{_P}_k") > 0)
    return out.withColumn(f"{_P}_i", F.explode(F.sequence(F.lit(1), F.col(f"{_P}_k")))).select(*docs.columns)
