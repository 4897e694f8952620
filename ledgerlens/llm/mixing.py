"""Mixing documents to target domain weights, in DataFrame operations only.

A multinomial classifier over hashed words, counted on a labelled table, gives each document soft
domain memberships. Nonnegative rates per document are fitted by projected gradient least
squares so that the expected tokens of each domain, sum of rate x tokens x membership, meet the
targets. Residuals are weighted by 1/N (N a domain's tokens at rate 1) and steps scaled by
1/tokens; in that metric the largest eigenvalue is 1, so a step of 1 always converges. Each
iteration is one aggregation to a number for each domain.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import Scratch

LAST_ID = (1 << 63) - 1
BUCKETS = 4096
SHARPNESS = 20.0
#: A derived budget over the least one; by how much it grows, how often, and the miss that is let pass.
SLACK, MORE, TRIES, NEAR = 1.1, 1.25, 4, 0.01
STALLED = 12  # rounds without progress after which fitting ends


def _words(docs: DataFrame) -> DataFrame:
    word = F.explode(F.split(F.lower("text"), r"[\x20\x09-\x0D]+")).alias("w")
    return docs.select(*[c for c in docs.columns if c != "text"], word).filter("w <> ''").withColumn("bucket", F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).cast("int")).drop("w")


def memberships(docs: DataFrame, labelled: DataFrame, domains: list[str], scratch: Scratch) -> DataFrame:
    """docs(doc_id, text), labelled(text, domain) -> (doc_id, n, p): tokens and memberships, one row
    for each doc_id. A document's log likelihoods are averaged over its words and sharpened by a
    constant, so that long documents do not all become certain. No words: n 0 and the prior."""
    counts = _words(labelled.filter(F.col("domain").isin(domains))).groupBy("bucket", "domain").count()
    table = scratch.save(counts, "counts")  # at most BUCKETS rows for each domain
    rows = table.collect()
    total = {d: sum(r["count"] for r in rows if r["domain"] == d) for d in domains}
    seen = {(r["bucket"], r["domain"]): r["count"] for r in rows}
    ll = [tuple([b] + [math.log((seen.get((b, d), 0) + 1) / (total[d] + BUCKETS)) for d in domains]) for b in range(BUCKETS)]
    weights = docs.sparkSession.createDataFrame(ll, "bucket int, " + ", ".join(f"l{j} double" for j in range(len(domains))))
    sums = _words(docs).join(F.broadcast(weights), "bucket").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"l{j}").alias(f"l{j}") for j in range(len(domains))])
    z = F.array(*[SHARPNESS * F.col(f"l{j}") for j in range(len(domains))])
    e = F.transform("z", lambda x: F.exp(x - F.array_max("z")))
    soft = sums.select("doc_id", "n", z.alias("z")).select("doc_id", "n", e.alias("e"))
    soft = soft.select("doc_id", "n", F.transform("e", lambda x: x / F.aggregate("e", F.lit(0.0), lambda a, y: a + y)).alias("p"))
    prior = [max(1, t) / sum(max(1, v) for v in total.values()) for t in total.values()]
    empty = docs.select("doc_id").distinct().join(soft.select("doc_id").hint("merge"), "doc_id", "left_anti")
    return soft.union(empty.select("doc_id", F.lit(0).cast("long"), F.array(*map(F.lit, prior))))


def fit_rates(members: DataFrame, weights: list[float], scratch: Scratch, low: float = 0.0, high: float = math.inf, budget: float | None = 1.0, rounds: int = 240, tolerance: float = 1e-4) -> DataFrame:
    """members(doc_id, n, p) -> with rate and missed, the part of its goal by which the worst domain
    misses it, the same in each row. Rounds end when all goals are met or no longer come nearer. The target of domain d is budget x all tokens x
    weights[d] / sum(weights); rates stay within low and high. Budget None takes the least with which
    no rate need fall under 1, and some more for what documents hold of domains they are not of;
    where targets are still missed, it grows. A domain that is no document's likeliest has no target then."""
    base = scratch.save(members, "members")
    k = len(weights)
    at = lambda j: F.element_at("p", j + 1)

    def totals(df: DataFrame) -> list[float]:
        row = df.agg(*[F.coalesce(F.sum(F.col("rate") * F.col("n") * at(j)), F.lit(0.0)).alias(f"t{j}") for j in range(k)]).first()
        return [row[j] for j in range(k)]

    ones = totals(base.withColumn("rate", F.lit(1.0)))
    start = base.withColumn("rate", F.lit(min(max(1.0, low), high)).cast("double"))

    def fitted(budget: float, goal: list[float | None]) -> tuple[DataFrame, float]:
        """Rates, and by which part of its goal the worst domain misses it."""
        df, best, since = start, math.inf, 0
        for i in range(rounds + 1):
            now = totals(df)
            missed = [(abs(a - g), max(g, 1.0)) for a, g in zip(now, goal, strict=True) if g is not None]
            worst = max([m / g for m, g in missed], default=0.0)
            since = 0 if worst < 0.999 * best else since + 1
            best = min(best, worst)
            if i == rounds or worst <= tolerance or since >= STALLED:
                break
            step: Column = F.lit(0.0)
            for j in range(k):
                if ones[j] > 0 and goal[j] is not None:
                    step = step + at(j) * F.lit((now[j] - goal[j]) / ones[j])
            df = df.withColumn("rate", F.least(F.lit(float(high)), F.greatest(F.lit(low), F.col("rate") - step)))
            if i % 6 == 5:
                df = scratch.save(df, "rates")
        return df.withColumn("missed", F.lit(worst)), worst

    if budget is not None:
        return fitted(budget, [budget * sum(ones) * w / sum(weights) for w in weights])[0]
    likely = base.filter("n > 0").select(F.array_position("p", F.array_max("p")).alias("d")).distinct().collect()  # at most k rows
    there = {r["d"] - 1 for r in likely}
    whole = sum(w for j, w in enumerate(weights) if j in there)
    shares = [(ones[j] / sum(ones)) / (weights[j] / whole) for j in there if weights[j] > 0]
    budget = SLACK * max([1.0, *shares])
    for _ in range(TRIES):
        df, missed = fitted(budget, [budget * sum(ones) * w / whole if j in there else None for j, w in enumerate(weights)])
        if missed <= NEAR:
            break
        budget *= MORE
    return df


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], low: float = 0.0, high: float = math.inf, budget: float | None = 1.0) -> DataFrame:
    """One row for each doc_id: doc_id, n_tokens, membership (by the order of targets), rate, missed.

    missed is the part of its goal by which the worst domain misses it, in every row; goals that no rates
    reach (a domain without tokens, or bounds given) show there and not as an error.

    docs needs doc_id and text, labelled needs text and domain; others are ignored, as are labels
    not among the targets. Null text has no tokens and the prior's membership. Rows that repeat a
    doc_id count together; null ids are one document. An empty table gives no rows; with no
    labels the memberships are even.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    marks = labelled.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("domain").cast("string").alias("domain"))
    out = fit_rates(memberships(rows, marks, list(targets), scratch), list(targets.values()), scratch, low, high, budget)
    return out.select(F.nullif("doc_id", F.lit(LAST_ID)).alias("doc_id"), F.col("n").alias("n_tokens"), F.col("p").alias("membership"), "rate", "missed")


def copies(rate: Column, key: Column, seed: int = 42) -> Column:
    """How many times a document is used: the rate's whole part, plus one with the chance of the rest by hash."""
    draw = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).cast("int")
