"""Mixing sources to target shares: subset-sum budget fitting over exact length counts.

1. Documents are counted by (source, exact token length): a histogram of at most sources x longest text rows, the only
   thing the driver sees.
2. Every source gets a budget of tokens. As many whole passes as fit are taken of all its documents; the rest of the
   budget is filled proportionally over the lengths, and what then remains by a bounded-knapsack dynamic programme
   over bit sets, which finds the exact sum or the nearest below. Its bit sets are as long as a few of the source's
   longest texts (in tokens), one for each length and power of two: some hundred kilobytes each for a text of a million
   tokens.
3. Of each (source, length) the needed number of documents is chosen by a seeded hash. Groups above ``HOT`` documents
   are ranked in hash ranges of about that size, so none is sorted in one task.

Without ``total`` the mixture is the largest in which every target can be met under its cap of repeats. With a
``total``, a source that can't fill its budget is used up to its cap and reported as not met.

Defined cases: documents without id, without a listed source or without tokens are left out; a target without documents gets
nothing and is reported as not met; targets are scaled to sum to 1; repeated rows are documents of their own.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HOT = 1_000_000


@dataclass
class SourcePlan:
    """What is taken of a source: ``passes`` of every document, and ``need`` more documents of each length."""

    share: float
    budget: int
    available: int
    passes: int = 0
    need: dict[int, int] = field(default_factory=dict)

    @property
    def tokens(self) -> int:
        return self.passes * self.available + sum(n * c for n, c in self.need.items())


def knapsack(counts: dict[int, int], goal: int) -> dict[int, int]:
    """How many of each size to take, at most ``counts``, for the largest sum up to ``goal``."""
    mask = (1 << (goal + 1)) - 1
    reach, steps = 1, []
    for size in sorted(counts, reverse=True):
        left, chunk = min(counts[size], goal // size), 1
        while left > 0 and not reach >> goal & 1:
            n = min(chunk, left)
            new = (reach | reach << (n * size)) & mask
            steps.append((size, n, reach))
            reach, left, chunk = new, left - n, chunk * 2
        if reach >> goal & 1:
            break
    at, taken = reach.bit_length() - 1, {}
    for size, n, before in reversed(steps):
        if not before >> at & 1:
            taken[size] = taken.get(size, 0) + n
            at -= n * size
    return taken


def fill(counts: dict[int, int], goal: int) -> dict[int, int]:
    """A sub-multiset of ``counts`` (length: documents) with a sum as near ``goal`` from below as can be, spread over all lengths."""
    total = sum(n * c for n, c in counts.items())
    if goal >= total:
        return dict(counts)
    taken = {n: c * goal // total for n, c in counts.items()}
    rest = goal - sum(n * c for n, c in taken.items())
    bound = 2 * max(counts)
    for n in sorted(counts, key=lambda n: (n * 2654435761) % (1 << 32)):  # one more of some lengths, in a fixed shuffled order
        if rest <= bound:
            break
        if taken[n] < counts[n] and n <= rest:
            taken[n] += 1
            rest -= n
    while rest > bound:  # lengths are few and documents many
        n = max((n for n in counts if taken[n] < counts[n]), default=0)
        if not n:
            break
        k = min(counts[n] - taken[n], max(1, (rest - bound) // n))
        taken[n] += k
        rest -= k * n
    left = lambda: {n: counts[n] - taken[n] for n in counts if taken[n] < counts[n]}
    extra = knapsack(left(), rest)
    if sum(n * c for n, c in extra.items()) < rest:  # not exact: give back some and choose again
        limit = max(bound, min(16 * bound, 1 << 22))
        for n in sorted(taken, reverse=True):
            k = min(taken[n], max(0, (limit - rest) // n))
            taken[n] -= k
            rest += k * n
        extra = knapsack(left(), rest)
    for n, c in extra.items():
        taken[n] += c
    return {n: c for n, c in taken.items() if c}


def plan(histogram: dict[str, dict[int, int]], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[str, SourcePlan]:
    """Budgets and choices of every target."""
    weight = sum(max(0.0, s) for s, _ in targets.values()) or 1.0
    share = {k: max(0.0, s) / weight for k, (s, _) in targets.items()}
    available = {k: sum(n * c for n, c in histogram.get(k, {}).items()) for k in targets}
    if total is None:
        total = min((int(available[k] * targets[k][1] / share[k]) for k in targets if share[k] > 0 and available[k] > 0), default=0)
    floor = {k: int(share[k] * total) for k in targets}
    for k in sorted(targets, key=lambda k: (floor[k] - share[k] * total, k))[: total - sum(floor.values())]:
        floor[k] += 1
    plans = {}
    for k, (_, repeats) in targets.items():
        p = plans[k] = SourcePlan(share[k], floor[k], available[k])
        if available[k] and repeats > 0:
            p.passes = min(p.budget // available[k], repeats)
            if p.passes < repeats:
                p.need = fill(histogram[k], p.budget - p.passes * available[k])
    return plans


def mix(documents: DataFrame, targets: dict[str, tuple[float, int]], total: int | None = None, seed: int = 17) -> tuple[DataFrame, dict[str, SourcePlan]]:
    """(``id, source, n_tokens, uses``; the plan). ``documents`` has id, source, n_tokens and is read several times: give a written table."""
    spark = documents.sparkSession
    listed = documents.select("id", "source", "n_tokens").where(F.col("source").isin(list(targets)) & (F.col("n_tokens") > 0) & F.col("id").isNotNull())
    histogram: dict[str, dict[int, int]] = {}
    for source, n, count in listed.groupBy("source", "n_tokens").count().collect():
        histogram.setdefault(source, {})[n] = count
    plans = plan(histogram, targets, total)
    place = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30))
    rows = listed.withColumn("place", place)
    parts = {(s, n): ceil(c / HOT) for s, lengths in histogram.items() for n, c in lengths.items() if c > HOT and plans[s].need.get(n, 0) < c}
    needs = []
    if parts:
        hot = spark.createDataFrame([(s, n, p) for (s, n), p in parts.items()], "source string, n_tokens bigint, parts int")
        rows = rows.join(F.broadcast(hot), ["source", "n_tokens"], "left").withColumn("part", F.floor(F.col("place") / (1 << 30) * F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        sizes = sorted(rows.join(F.broadcast(hot.select("source", "n_tokens")), ["source", "n_tokens"]).groupBy("source", "n_tokens", "part").count().collect())
        before: dict = {}
        for s, n, part, count in sizes:
            done = before.get((s, n), 0)
            needs.append((s, n, part, max(0, min(count, plans[s].need.get(n, 0) - done)), plans[s].passes))
            before[s, n] = done + count
    else:
        rows = rows.withColumn("part", F.lit(0))
    needs += [(s, n, 0, plans[s].need.get(n, 0), plans[s].passes) for s, lengths in histogram.items() for n in lengths if (s, n) not in parts]
    if not needs:
        return spark.createDataFrame([], "id bigint, source string, n_tokens bigint, uses int"), plans
    wanted = spark.createDataFrame(needs, "source string, n_tokens bigint, part int, need bigint, passes int").where("need > 0 OR passes > 0")
    ranked = rows.join(wanted, ["source", "n_tokens", "part"]).withColumn("rank", F.row_number().over(Window.partitionBy("source", "n_tokens", "part").orderBy("place", "id")))
    uses = (F.col("passes") + F.when(F.col("rank") <= F.col("need"), 1).otherwise(0)).cast("int")
    return ranked.select("id", "source", "n_tokens", uses.alias("uses")).where("uses > 0"), plans
