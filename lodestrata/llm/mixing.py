"""Problem 7: mixing sources to target weights.

Weights come from temperature: source token shares are raised to an exponent
and normalised; the exponent is found by bisection so that the weights reach a
target entropy, or stay within the repetition limits where that needs less
flatness (``fit``). Explicit target shares are used as they are. Either way a
mix is realised as budgeted block permutations: a source's rows are one block,
its budget is so many whole blocks plus the first rows of a permutation of the
block, so no row is used more than one time more often than another.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import exp, log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestrata.llm.quota import take_quota, uniform
from lodestrata.staging import stage

SEED, STEPS = 20240602, 80
#: Beyond this exponent shares that differ in the ninth digit are apart by more than a double holds.
MOST_EXPONENT = 2.0**40


def tempered(shares: dict[str, float], exponent: float) -> dict[str, float]:
    """``shares`` to the power of ``exponent``, normalised; sources without share stay at 0."""
    top = max((log(v) for v in shares.values() if v > 0), default=0.0)
    raised = {s: exp(exponent * (log(v) - top)) if v > 0 else 0.0 for s, v in shares.items()}
    total = sum(raised.values()) or 1.0
    return {s: v / total for s, v in raised.items()}


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * log(w) for w in weights.values() if w > 0)


def bisect_exponent(
    shares: dict[str, float],
    target_entropy: float | None = None,
    budget: float | None = None,
    sizes: dict[str, float] | None = None,
    most_repeats: dict[str, float] | None = None,
) -> float:
    """The least exponent of 0 or more at which the tempered shares meet the target.

    With ``target_entropy`` the weights have that entropy at most (entropy
    falls as the exponent grows, down to that of the largest sources alone;
    a target below that gives the exponent at which nothing else is left).
    Otherwise it is the flattest mix at which no source needs more than its
    size times its repeats out of ``budget``; 1 (the natural mix) where even
    that needs more.
    """
    if not any(v > 0 for v in shares.values()):
        return 1.0

    def flat_enough(x: float) -> bool:
        weights = tempered(shares, x)
        if target_entropy is not None:
            return entropy(weights) <= target_entropy
        return all(weights[s] * budget <= sizes[s] * most_repeats.get(s, 1) * (1 + 1e-12) for s in shares)

    low, high = 0.0, 1.0
    if flat_enough(low):
        return low
    if target_entropy is not None:
        while not flat_enough(high) and high < MOST_EXPONENT:  # widen until the target lies inside
            low, high = high, high * 2
    for _ in range(STEPS):
        middle = (low + high) / 2
        low, high = (low, middle) if flat_enough(middle) else (middle, high)
    return high


@dataclass(frozen=True)
class Source:
    """What a mix asks of a source, and what the source has."""

    share: float
    most_repeats: float
    tokens: float
    rows: float


def fit(sources: dict[str, Source], total_rows: float) -> tuple[float, float, float, dict[str, float], dict[str, float]]:
    """(entropy exponent, limit exponent, exponent, token shares, weights) of one mix.

    The weights have the entropy of the explicit shares, unless a source would
    then be repeated too often: then they are the flattest within the limits.
    """
    tokens = {s: v.tokens for s, v in sources.items()}
    total = sum(tokens.values())
    shares = {s: v / (total or 1.0) for s, v in tokens.items()}
    full = max(sum(v > 0 for v in shares.values()), 1)
    wanted = bisect_exponent(shares, target_entropy=min(entropy({s: v.share for s, v in sources.items()}), log(full)))
    mean = total / max(sum(v.rows for v in sources.values()), 1.0)
    within = bisect_exponent(shares, budget=mean * total_rows, sizes=tokens, most_repeats={s: v.most_repeats for s, v in sources.items()})
    # beyond 1 small sources shrink, within their limits at first; a large one may then need too much
    exponent = wanted if wanted >= within and _within(tempered(shares, wanted), sources, mean * total_rows) else within
    return wanted, within, exponent, shares, tempered(shares, exponent)


def _within(weights: dict[str, float], sources: dict[str, Source], budget: float) -> bool:
    return all(weights[s] * budget <= v.tokens * v.most_repeats * (1 + 1e-9) for s, v in sources.items())


def mix_report(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Each row of ``targets`` with what its source can give.

    ``rows``: mix, id, source; an id counts once in a mix. ``targets``: mix,
    source, target_share, max_repeats, total_rows. Adds available (distinct
    ids), wanted_rows, capacity (available * max_repeats), short (capacity
    below the wanted rows), budget (rows used) and repeats (most uses of a
    row). A source without rows, as every source of an empty table, is short
    unless its share is 0.
    """
    seen = rows.groupBy("mix", "source").agg(F.count_distinct("id").alias("available"))
    return (
        targets.join(seen, ["mix", "source"], "left")
        .withColumn("available", F.coalesce("available", F.lit(0)).cast("bigint"))
        .withColumn("wanted_rows", F.col("target_share") * F.col("total_rows"))
        .withColumn("capacity", F.col("available") * F.col("max_repeats"))
        .withColumn("short", F.col("capacity") < F.col("wanted_rows"))
        .withColumn("budget", F.least(F.col("capacity"), F.round("wanted_rows").cast("bigint")))
        .withColumn("repeats", F.when(F.col("available") > 0, F.ceil(F.col("budget") / F.col("available"))).otherwise(0).cast("bigint"))
    )


def mix(rows: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """(mix, source, id, used, position): the rows of every mix.

    ``used`` counts the uses of a row before this one, ``position`` orders a
    mix so that every stretch holds the sources in about their shares: the
    j-th of a source's b rows stands near (j + 1/2) / b of the mix. Sources
    without a target are left out.
    """
    one = rows.where("source is not null").select("mix", "source", "id").distinct()
    report = stage(mix_report(rows, targets), "budgets")  # as many rows as targets
    return permuted(one, report, seed)


def permuted(one: DataFrame, report: DataFrame, seed: int = SEED) -> DataFrame:
    """The blocks of ``report`` (mix, source, available, budget) out of distinct (mix, source, id)."""
    plan = report.where("budget > 0").select(
        "mix",
        "source",
        F.col("available").alias("group_rows"),
        "budget",
        F.floor(F.col("budget") / F.col("available")).cast("int").alias("blocks"),
        (F.col("budget") % F.col("available")).alias("quota"),
    )
    offered = one.join(plan, ["mix", "source"])
    whole = offered.where("blocks > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("used"))
    last = take_quota(
        offered.where("quota > 0").withColumn("u", uniform(seed, "mix", "id", "blocks")), ["mix", "source"]
    ).withColumn("used", F.col("blocks"))
    names = ["mix", "source", "id", "used", "group_rows", "budget"]
    placed = whole.select(*names).unionByName(last.select(*names))
    # within its block a row lies at a keyed place; a block covers its part of the mix
    block = F.col("group_rows") / F.col("budget")
    start = F.col("used") * block
    length = F.least(block, 1.0 - start)
    return placed.select("mix", "source", "id", "used", (start + uniform(seed + 1, "mix", "id", "used") * length).alias("position"))


def actual_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows and share of each target's source in the mix that was made, beside its target.

    ``missing`` rows of a source are those that its target asks for and its
    repetition limit does not give; the other sources do not fill them up.
    """
    got = mixed.groupBy("mix", "source").agg(
        F.count("*").alias("rows"), F.count_distinct("id").alias("records"), (F.max("used") + 1).alias("most_uses")
    )
    return (
        targets.join(got, ["mix", "source"], "left")
        .na.fill(0, ["rows", "records", "most_uses"])
        .withColumn("share", F.col("rows") / F.greatest(F.sum("rows").over(Window.partitionBy("mix")), F.lit(1)))
        .withColumn("missing", F.greatest(F.lit(0), F.round(F.col("target_share") * F.col("total_rows")).cast("bigint") - F.col("rows")))
    )


def short_sources(rows: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """Each target with the rows it got in the mix, where these and all its source may give stay below its share.

    ``rows`` and ``targets`` as of ``mix``. A mix that has fewer rows by
    rounding alone is not short: all rows of its source are not used up.
    """
    got = mix(rows, targets, seed).groupBy("mix", "source").agg(F.count("*").alias("rows"))
    report = mix_report(rows, targets).join(got, ["mix", "source"], "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    return report.where((F.col("rows") < F.col("wanted_rows")) & (F.col("rows") == F.col("capacity")))
