"""Temperature mixing of sources, in DataFrame operations only.

Each source's share of all tokens is raised to an exponent in [0, 1] and normalised to its weight.
The exponent is found by bisection on a grid of 2^-20: the largest whose weights still have the
target entropy, raised where a source would otherwise repeat beyond the limit. Every pass aggregates
the table of sources for 31 exponents at once, five bisection levels, and sends those rows only to
the driver.

A source's token budget is realised as whole permutations of its documents (blocks) and a prefix of
one more. The order within a block is by an MD5 of seed, block and doc_id, so it needs no sort of a
source: tokens are summed by radix buckets of about ``BUCKET`` documents, the end of the prefix is
looked for digit by digit, 16 sums of a source at a time, and only the documents of the bucket that
holds it are put in order.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterglass.llm.common import WORD, cut_lineage, whole_text

GRID = 1 << 20
BUCKET = 1024
#: A table of sources of up to so many rows is broadcast; beyond, it is joined by shuffle.
BROADCAST_SOURCES = 20_000


@dataclass(frozen=True)
class Mixture:
    """``entropy`` is a part of the largest possible one, ``budget`` a multiple of all tokens."""

    entropy: float = 0.97
    max_repeats: float = 4.0
    budget: float = 1.0
    seed: int = 7


def order_key(seed: int, block: Column, doc_id: str = "doc_id") -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), block.cast("string"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))


def token_counts(docs: DataFrame) -> DataFrame:
    """doc_id, source and n_tokens (words) of every whole text."""
    return docs.select("doc_id", "source", F.regexp_count(whole_text(), F.lit(WORD)).cast("long").alias("n_tokens"))


def _weigh(totals: DataFrame, exponents: list[int], budget_x: float) -> list[tuple[int, float, float]]:
    """(exponent, entropy, repeats) for grid points; sums are of decimals, so their order is no matter."""
    each = totals.select("share", F.explode(F.array(*map(F.lit, exponents))).alias("at"))
    raised = F.pow("share", F.col("at") / GRID)
    exact = lambda c: F.sum(c.cast("decimal(38,18)")).cast("double")
    sums = each.groupBy("at").agg(
        exact(raised).alias("z"), exact(raised * F.log("share")).alias("zl"), F.max(raised / F.col("share")).alias("r")
    )
    return sorted(
        (r["at"], math.log(r["z"]) - r["at"] / GRID * r["zl"] / r["z"], budget_x * r["r"] / r["z"]) for r in sums.collect()
    )


def bisect_exponent(totals: DataFrame, mix: Mixture) -> float:
    """The exponent for sources with ``share`` > 0; without any it is 1.

    Entropy falls and repetition falls as the exponent grows, so both are settled by bisection; the
    limit on repetition goes before the entropy.
    """
    ends = {at: (h, r) for at, h, r in _weigh(totals, [0, GRID], mix.budget)}
    if not ends:
        return 1.0
    target = mix.entropy * ends[0][0]

    def last_true(ok) -> int:
        """The largest grid point where ok holds, which holds at 0 and from some point on not."""
        lo, hi = 0, GRID
        if ok(*ends[GRID]):
            return GRID
        while hi - lo > 1:
            step = max(1, (hi - lo) // 32)
            points = list(range(lo + step, min(hi, lo + 32 * step), step))
            held = [at for at, h, r in _weigh(totals, points, mix.budget) if ok(h, r)]
            lo, hi = max(held, default=lo), min([x for x in points if x > max(held, default=lo)], default=hi)
        return lo

    by_entropy = last_true(lambda h, r: h >= target)
    if ends[0][1] <= mix.max_repeats:
        return by_entropy / GRID
    by_repeats = min(GRID, last_true(lambda h, r: r > mix.max_repeats) + 1)
    return max(by_entropy, by_repeats) / GRID


def plan_mixture(counts: DataFrame, mix: Mixture) -> DataFrame:
    """One row per source: weight, target_tokens, full_blocks and cut, the last order key of the prefix.

    ``cut`` is null where no rest of the budget is left. A null source is a source; one without
    tokens has weight 0 and gives no rows.
    """
    totals = counts.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs"))
    totals = cut_lineage(totals.filter("tokens > 0"))
    all_tokens = totals.agg(F.sum("tokens")).first()[0] or 0
    totals = totals.withColumn("share", F.col("tokens") / F.lit(all_tokens))
    exponent = bisect_exponent(totals, mix)
    z = totals.agg(F.sum(F.pow("share", F.lit(exponent)).cast("decimal(38,18)")).cast("double")).first()[0]
    plan = totals.withColumns(
        {
            "weight": F.pow("share", F.lit(exponent)) / F.lit(z),
            "digits": F.greatest(F.lit(0), F.ceil(F.log(F.col("n_docs") / BUCKET) / math.log(16))).cast("int"),
        }
    )
    plan = plan.withColumn("target_tokens", F.floor(F.col("weight") * F.lit(mix.budget * all_tokens)).cast("long"))
    plan = plan.withColumns(
        {
            "full_blocks": F.expr("target_tokens div tokens"),
            "rest": F.expr("target_tokens % tokens"),
        }
    )
    plan = cut_lineage(plan)
    keyed = with_source(counts, plan.select("source", "full_blocks", "rest", "digits")).filter("rest > 0")
    keyed = keyed.withColumn("key", order_key(mix.seed, F.col("full_blocks")))
    keyed = keyed.withColumn("bucket", F.substring("key", F.lit(1), F.col("digits")))
    cuts = cut_within(keyed, cut_bucket(keyed, plan))
    both = plan.alias("p").join(cuts.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")), "left")
    return cut_lineage(both.select("p.source", "p.weight", "p.target_tokens", "p.full_blocks", "c.cut"))


def cut_bucket(keyed: DataFrame, plan: DataFrame) -> DataFrame:
    """source, bucket, left: the bucket in which the source's ``rest`` ends and what of it is left there.

    A digit of the bucket is found at a time, from sums over the 16 that may follow; the sums of all
    buckets, one for some ``BUCKET`` documents, are made once.
    """
    sums = cut_lineage(keyed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n")))
    at = plan.filter("rest > 0").select("source", "digits", F.lit("").alias("prefix"), F.col("rest").alias("left"))
    depth = plan.agg(F.max("digits")).first()[0] or 0
    for level in range(1, depth + 1):
        inside = with_source(sums, at.filter(F.col("digits") >= level)).filter(F.col("bucket").startswith(F.col("prefix")))
        child = F.substring("bucket", 1, level).alias("child")
        each = inside.groupBy("source", child, "left").agg(F.sum("n").alias("n"))
        order = Window.partitionBy("source").orderBy("child")  # 16 rows of a source
        each = each.withColumn("upto", F.sum("n").over(order)).filter("upto > left")
        first = each.groupBy("source").agg(F.min(F.struct("child", (F.col("left") - F.col("upto") + F.col("n")).alias("left"))).alias("to"))
        a, b = at.alias("a"), first.alias("b")
        at = a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")), "left").select(
            "a.source", "digits", F.coalesce("to.child", "prefix").alias("prefix"), F.coalesce("to.left", "a.left").alias("left")
        )
        at = cut_lineage(at)
    return at.select("source", F.col("prefix").alias("cut_bucket"), "left")


def cut_within(keyed: DataFrame, buckets: DataFrame) -> DataFrame:
    """source, cut: the last key that the prefix takes, the bucket itself where it takes none of it.

    A bucket sorts after all keys before it and before its own, so it cuts just there.
    """
    own = with_source(keyed.select("source", "bucket", "key", "n_tokens"), buckets).filter("bucket = cut_bucket")
    own = own.groupBy("source", "cut_bucket", "left", "key").agg(F.sum("n_tokens").alias("n"))
    order = Window.partitionBy("source").orderBy("key")  # some BUCKET rows of a source
    own = own.withColumn("upto", F.sum("n").over(order))
    last = F.max(F.when(F.col("upto") <= F.col("left"), F.col("key")))
    return own.groupBy("source", "cut_bucket").agg(last.alias("key")).select("source", F.coalesce("key", "cut_bucket").alias("cut"))


def with_source(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with the columns of their source; the plan is broadcast where it is small enough."""
    small = plan.withColumnRenamed("source", "plan_source")
    if small.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        small = F.broadcast(small)
    return rows.join(small, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")


def realise(rows: DataFrame, plan: DataFrame, mix: Mixture) -> DataFrame:
    """A row of ``rows`` (doc_id, source, ...) for each block that takes it, with block and order_key."""
    taken = with_source(rows, plan)
    inside = F.coalesce(order_key(mix.seed, F.col("full_blocks")) <= F.col("cut"), F.lit(False))
    n = F.col("full_blocks") + F.when(inside, 1).otherwise(0)
    taken = taken.withColumn("block", F.explode(F.filter(F.sequence(F.lit(0).cast("long"), n), lambda b: b < n)))
    return taken.withColumn("order_key", order_key(mix.seed, F.col("block")))


def mix_sources(docs: DataFrame, mix: Mixture = Mixture()) -> DataFrame:
    """doc_id, source, n_tokens, block, order_key, weight: the schedule of the mixture.

    Reading it by block and order_key gives each source's permutations. A document appears once per
    block that takes it, not at all where the budget of its source ends before it. Documents whose
    ids repeat share an order key and are taken together; a null id counts as ''. An empty table
    gives no rows.
    """
    counts = cut_lineage(token_counts(docs))
    rows = realise(counts, plan_mixture(counts, mix), mix)
    return rows.select("doc_id", "source", "n_tokens", "block", "order_key", F.round("weight", 9).alias("weight"))


def mix_documents(docs: DataFrame, mix: Mixture = Mixture()) -> DataFrame:
    """The rows of ``docs`` that the mixture takes, once per block, with the columns of ``docs``.

    Nulls, repeated ids and empty tables are treated as by ``mix_sources``; a null text or one
    without words has no tokens and goes with its source's blocks. A text longer than a source's
    rest of the budget ends that source's prefix before it. Texts are read, not shuffled.
    """
    plan = plan_mixture(cut_lineage(token_counts(docs)), mix)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return realise(docs.select("doc_id", "source", row.alias("row")), plan, mix).select("row.*")
