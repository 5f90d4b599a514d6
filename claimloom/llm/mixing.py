"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash. A source whose target is r whole passes and a rest takes all its
documents r times, and once more those with a hash below the source's threshold. The threshold
is found without sorting: sizes are summed by source and hash bucket, the cumulative sums over
the few buckets show which bucket holds the boundary, and only that bucket is summed again by
its finer hash bits. Only sums are shuffled, combined before the shuffle; the final filter is a
comparison with the source's threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.llm.storage import stored

#: Hash bits of each refinement; together they are the whole non-negative hash.
LEVELS = (12, 12, 12, 12)
BITS = sum(LEVELS)
PASSES = 3


def words_of(text: Column) -> Column:
    """Number of runs of bytes other than space and 0x09-0x0D; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, passes: int = PASSES) -> DataFrame:
    """(source, weight, source_size, target) from (source, source_size).

    Sources by code point, null last, weigh 1, 2, 3, repeating. A target that would exceed
    `passes` times its source's size stops there; the excess is shared by weight among the
    others. With level = limit / weight, the sources that stop are those with the lowest
    levels, so one ordered pass finds the common level of the others.
    """
    # a row per source: the ranking is one task by nature, as small as the list of sources
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary")))
    ranked = sizes.withColumn("weight", ((rank - 1) % 3 + 1).cast("double"))
    limit = F.col("source_size") * float(passes)
    own = ranked.withColumn("level", limit / F.col("weight"))
    by_level = Window.orderBy("level", F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    own = (
        own.withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("left_weight", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("stopped", F.coalesce(F.sum(limit).over(before), F.lit(0.0)))
        .withColumn("share", (F.col("total") - F.col("stopped")) / F.col("left_weight"))
    )
    # the first source in order of level whose own limit is not reached sets the common level
    common = F.min(F.when(F.col("level") >= F.col("share"), F.struct("level", "share"))).over(everything)["share"]
    return own.withColumn("common", common).select(
        "source",
        F.col("weight").cast("int").alias("weight"),
        "source_size",
        F.least(limit, F.coalesce(F.col("common") * F.col("weight"), limit)).alias("target"),
    )


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """(source, passes, below): whole passes, and the hash below which one more is taken.

    sized: (source, size, h). The rest of a budget is met as nearly as whole documents allow:
    the boundary hash value is included if that comes nearer to the target.
    """
    state = goals.where("source_size > 0").select(
        "source",
        F.floor(F.col("target") / F.col("source_size")).cast("bigint").alias("passes"),
        F.pmod(F.col("target"), F.col("source_size").cast("double")).alias("rest"),
        F.lit(0).cast("bigint").alias("low"),
        F.lit(True).alias("open"),
    )
    shift = BITS
    for bits in LEVELS:
        shift -= bits
        bounds = state.where("open").select(F.col("source").alias("s"), "low")
        inner = sized.join(
            bounds,
            sized.source.eqNullSafe(bounds.s)
            & (F.shiftright(sized.h, shift + bits) == F.shiftright(bounds.low, shift + bits)),
        )
        bucket = F.shiftright("h", shift)
        sums = inner.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("sum"))
        upto = Window.partitionBy("source").orderBy("bucket")
        sums = sums.withColumn("through", F.sum("sum").over(upto)).withColumnRenamed("source", "s")
        crossing = sums.join(state.select(F.col("source").alias("s2"), "rest"), F.col("s").eqNullSafe(F.col("s2")))
        crossing = (
            crossing.where("through > rest").groupBy("s").agg(F.min(F.struct("bucket", "sum", "through")).alias("at"))
        )
        state = state.join(crossing, state.source.eqNullSafe(crossing.s), "left").select(
            "source",
            "passes",
            F.when(F.col("at").isNull(), F.col("rest")).otherwise(F.col("rest") - (F.col("at.through") - F.col("at.sum"))).alias("rest"),
            F.when(F.col("at").isNull(), F.col("low")).otherwise(F.shiftleft("at.bucket", shift)).alias("low"),
            F.col("at").isNotNull().alias("open"),
            F.col("at.sum").alias("last"),
        )
        state = stored(state, "mix-bounds")
    nearer = F.coalesce(F.col("rest") * 2 >= F.col("last"), F.lit(False))
    return state.select("source", "passes", (F.col("low") + nearer.cast("bigint")).alias("below"))


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    code = F.xxhash64(F.col(id_col), F.xxhash64(F.col(text_col).cast("string")))
    return docs.withColumns({"__mix_h": F.shiftrightunsigned(code, 64 - BITS), "__mix_source": F.col(source_col).cast("string")})


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    sized = _keyed(docs, id_col, text_col, source_col).select(
        F.col(id_col).alias("id"),
        F.col("__mix_source").alias("source"),
        words_of(F.col(text_col).cast("string")).alias("size"),
        F.col("__mix_h").alias("h"),
    )
    return stored(sized, "mix-sizes")


def _plan(sized: DataFrame, passes: int) -> DataFrame:
    """(s, source_size, target, passes, below) of every source: as many rows as sources."""
    goals = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), passes), "mix-goals")
    bounds = thresholds(sized.where("size > 0").select("source", "size", "h"), goals)
    plan = goals.join(bounds.withColumnRenamed("source", "s"), goals.source.eqNullSafe(F.col("s")), "left")
    plan = plan.select(
        F.col("source").alias("s"),
        "source_size",
        "target",
        F.coalesce("passes", F.lit(0)).cast("bigint").alias("passes"),
        F.coalesce("below", F.lit(0)).alias("below"),
    )
    return stored(plan, "mix-plan")


def _times(h: str, passes: int) -> Column:
    more = (F.col(h) < F.col("below")).cast("bigint")
    return F.least(F.col("passes") + more, F.lit(passes).cast("bigint"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", passes: int = PASSES
) -> DataFrame:
    """(id, source, size, source_size, target, times, taken) of every row of docs.

    times: how often the mix takes the document, `passes` at most; taken = times * size. Null
    texts have size 0; a null source is a source of its own. Rows equal in id and text have
    one hash and are taken alike. Nothing depends on partitioning, so reruns agree. An empty
    table gives no rows. Other columns are not read, whatever their names.
    """
    sized = _sized(docs, id_col, text_col, source_col)
    plan = _plan(sized, passes)
    out = sized.join(plan, sized.source.eqNullSafe(plan.s)).withColumn("times", _times("h", passes))
    return out.select("id", "source", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", passes: int = PASSES
) -> DataFrame:
    """The rows of the mix with the columns of docs, each repeated as often as it is taken.

    The plan has a row per source and is joined to the documents where they are: no text is
    shuffled while the planner finds the plan small enough to broadcast.
    """
    plan = _plan(_sized(docs, id_col, text_col, source_col), passes)
    own = _keyed(docs, id_col, text_col, source_col)
    plan = plan.select(F.col("s").alias("__mix_s"), "passes", "below").withColumnsRenamed(
        {"passes": "__mix_passes", "below": "__mix_below"}
    )
    more = (F.col("__mix_h") < F.col("__mix_below")).cast("bigint")
    times = F.least(F.col("__mix_passes") + more, F.lit(passes).cast("bigint")).cast("int")
    taken = own.join(plan, own["__mix_source"].eqNullSafe(plan["__mix_s"])).withColumn("__mix_times", times)
    copies = taken.where("__mix_times > 0").withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_times"))))
    return copies.select(*[F.col(f"`{c}`") for c in docs.columns])
