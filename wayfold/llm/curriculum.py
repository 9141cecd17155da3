"""Time-varying curriculum: which documents a training mix takes, how often, and when. DataFrame functions only.

Targets. Sources, in code-point order with the null source last, take weights in turn and share `share` of all words by weight;
no target exceeds `repeats` times its source's words, and what is over is reshared by weight (water-filling: target =
min(cap, level x weight), the level found from prefix sums over the sources by cap / weight).

Order. A source's documents are dealt by a hash of the row, after those that hold more than a hundredth of its words each, longest first.
Prefix sums of sizes run over hash buckets of each source and then within each bucket, so that a source of any share is spread over many tasks. A copy is taken while the words before its
middle are below the target; whole copies only, at most `repeats` of each document.

Time. Training time runs from 0 to 1. A schedule multiplies a source's weight by a piecewise-linear factor of time, one schedule
for each weight in turn. Integrated and scaled to the target, it gives the words that are due by a time; its inverse at the
middle of a copy is the copy's position. Documents are range-sorted by position.

Defined results: null or wordless texts have size 0, take 0 words and no copy; equal rows are interchangeable; sources of no
words have target 0; an empty table gives no rows; reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_ids, landed, numbered, read_table, scratch, under_own_names

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
REPEATS = 2
#: For each weight, factors at evenly spaced times from 0 to 1: heavy sources first, light ones last.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
#: Hash buckets of a source; each is summed in one task.
BUCKETS = 4096
#: A text of more than one LONG-th of its source's words is long.
LONG = 100
WORD = r"[^\x20\x09-\x0D]+"


def _pick(values, at: Column) -> Column:
    """values[at] for a column of positions."""
    return F.element_at(F.array(*(F.lit(float(v)) for v in values)), (at + 1).cast("int"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source_null, source_key, rank, source_size, target) from rows of (source_null, source_key, size).

    Sources are few (a mix names a weight for each), so ranks and prefix sums over them run in one task.
    """
    totals = sizes.groupBy("source_null", "source_key").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy("source_null", "source_key")) - 1)
    ranked = ranked.withColumn("weight", _pick(weights, F.col("rank") % len(weights))).withColumn("cap", F.col("source_size") * F.lit(float(repeats)))
    ranked = ranked.withColumn("demand", F.sum("source_size").over(everything) * F.lit(share))
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    # the level at which this source would be the first that isn't full
    level = (F.col("demand") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    filled = ranked.withColumn("level", level)
    # full sources come first by fill; the level of the first other one holds for all others
    open_level = F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(everything)
    target = F.least("cap", F.coalesce(open_level["level"] * F.col("weight"), F.col("cap")))
    return filled.select("source_null", "source_key", "rank", "source_size", target.alias("target"))


def due_time(done: Column, rank: Column, schedules=SCHEDULES) -> Column:
    """The time in [0, 1] by which the share `done` of a source's target is due."""
    cases = None
    for i, factors in enumerate(schedules):
        step = 1.0 / (len(factors) - 1)
        areas = [(a + b) / 2 * step for a, b in zip(factors, factors[1:], strict=False)]
        total = sum(areas)
        value = F.lit(1.0)
        ends = [sum(areas[: k + 1]) for k in range(len(areas))]
        for k in reversed(range(len(areas))):
            due = F.greatest(done * F.lit(total) - F.lit(ends[k] - areas[k]), F.lit(0.0))
            slope, start = (factors[k + 1] - factors[k]) / step, factors[k]
            # start * t + slope * t^2 / 2 = due, in the form without cancellation
            t = F.when(due <= 0, F.lit(0.0)).otherwise(2 * due / (F.lit(start) + F.sqrt(F.greatest(F.lit(start * start) + 2 * slope * due, F.lit(0.0)))))
            value = F.when(done * F.lit(total) <= F.lit(ends[k]), F.lit(k * step) + t).otherwise(value)
        case = rank % len(schedules) == i
        cases = F.when(case, value) if cases is None else cases.when(case, value)
    return F.least(F.greatest(cases, F.lit(0.0)), F.lit(1.0))


def plan_mix(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, schedules=SCHEDULES, buckets: int = BUCKETS, row: str | None = None
) -> DataFrame:
    """For each row of `docs`: its doc_id, row_key (the column `row` if it names one that tells rows apart, else a hash of the whole row), size,
    source_size, target, taken, and positions, the times of its copies."""
    sizes = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.col(f"`{source}`").isNull().alias("source_null"),
        F.coalesce(F.col(f"`{source}`"), F.lit("")).alias("source_key"),
        F.coalesce(F.regexp_count(f"`{text}`", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns if c != row)).alias("deal"),
        *([F.col(f"`{row}`").alias("row_key")] if row else []),
    )
    sizes = landed(sizes if row else sizes.withColumn("row_key", F.col("deal")), "sizes")
    targets = landed(source_targets(sizes, weights, share, repeats), "targets")
    source_keys = ["source_null", "source_key"]
    # a source's long texts, fewer than LONG of them, come first and the longest before others, so that what is cut at the target is short
    dealt = sizes.join(targets.select(*source_keys, "source_size"), source_keys)
    dealt = dealt.withColumn("bucket", F.when(F.col("size") * LONG > F.col("source_size"), -1).otherwise(F.pmod("deal", F.lit(buckets)))).drop("source_size")
    in_bucket = dealt.groupBy(*source_keys, "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy(*source_keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = in_bucket.withColumn("offset", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0))).drop("bucket_size")
    offsets = offsets.join(targets, source_keys)
    order = [F.when(F.col("bucket") == -1, -F.col("size")), F.col("deal"), F.col("row_key"), F.col("doc_id"), F.col("size")]
    within = Window.partitionBy(*source_keys, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, [*source_keys, "bucket"])
    middle = F.col("offset") + F.col("ahead") + F.col("size") / 2.0
    copies = F.filter(F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda k: middle + k * F.col("source_size")), lambda m: (m < F.col("target")) & (F.col("size") > 0))
    placed = placed.withColumn("middles", copies)
    return placed.select(
        "doc_id",
        "row_key",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.size("middles")).alias("taken"),
        F.transform("middles", lambda m: due_time(m / F.col("target"), F.col("rank"), schedules)).alias("positions"),
    )


def mix(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of `docs` that the mix takes, once for each copy, range-sorted by position; the columns of `docs`. The plan is made of
    sizes and of the rows' places in their files (or of numbers, with which rows of another origin are written first), and texts are shuffled to be sorted by position only, or once more where the plan
    is too large to broadcast."""

    def step(d: DataFrame, c: dict[str, str]) -> DataFrame:
        row = c["_row_of_mix"]
        plan = plan_mix(d, doc_id=c[doc_id], text=c[text], source=c[source], row=row, **options)
        plan = landed(plan.filter("taken > 0").select(F.col("row_key").alias(row), "positions"), "plan", keep=True)
        taken = join_ids(d, plan, row, "inner").withColumn("_position", F.explode("positions"))
        return taken.orderBy("_position", row)

    with scratch(docs.sparkSession):
        return under_own_names(numbered(docs, "_row_of_mix"), step, without=("_row_of_mix",))


def op8_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; those that are taken first by the position of their first copy, then the others."""
    plan = plan_mix(read_table(spark, sf_dir, "documents"))
    first = F.try_element_at("positions", F.lit(1))
    return plan.select("doc_id", "size", "source_size", "target", "taken", first.alias("first_position"), F.size("positions").alias("copies")).orderBy(F.col("first_position").asc_nulls_last(), "doc_id")
