"""Mixing sources to target weights with nested hash thresholds instead of a sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prudentia.llm.common import WORD_PATTERN, stored, text_of

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Hex digits of a document's hash: 15 of its md5, read three at a time, 4096 buckets a level.
DIGITS = 15
STEP = 3


def document_hash() -> Column:
    return F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, DIGITS)


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words, NULL text: 0) and the hash by which documents are drawn."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.regexp_count(text_of(), F.lit(WORD_PATTERN)).cast("long").alias("size"),
        document_hash().alias("hash"))


def source_targets(by_source: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
                   most: float = MOST) -> DataFrame:
    """source, source_size and target: ``share`` of all sizes dealt out by weight.

    Sources in order of their code points, NULL last, take the weights in turn. No
    target exceeds ``most`` times its source's size; what is over goes to the others by
    weight until none is above. With the sources in order of limit / weight that is one
    pass: those whose limit is below what the rest would get per weight are full. The
    windows run over one row per source.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    full = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    number = F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights)))
    weighed = (by_source.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), number + 1))
               .withColumn("limit", F.lit(float(most)) * F.col("source_size"))
               .withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(every)))
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    after = full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rate = (F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    return (weighed.withColumn("rate", rate)
            .withColumn("level", F.max(F.when(F.col("rate") * F.col("weight") <= F.col("limit"), F.col("rate"))).over(every))
            .select("source", "source_size",
                    F.coalesce(F.least(F.col("limit"), F.col("level") * F.col("weight")), F.col("limit")).alias("target")))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def mixing_plan(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: s, source_size, target, passes and the threshold below which a hash is drawn once more.

    Sizes are summed by source and leading digits of the hash, the bucket in which the
    budget ends is found, and only that bucket is summed by further digits. What is left
    of it after the last digit are documents of one hash; they are taken if that brings
    the source nearer to its target.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(by_source, weights, share, most), "targets").select(
        "source", "source_size", "target",
        F.least(F.floor(F.col("target") / F.greatest("source_size", F.lit(1))), F.lit(most)).cast("long").alias("passes"))
    rest = F.when(F.col("source_size") > 0, F.col("target") - F.col("passes") * F.col("source_size")).otherwise(0.0)
    state = targets.select(F.col("source").alias("s"), F.lit("").alias("prefix"), F.lit(0).cast("long").alias("below"),
                           rest.alias("rest"))
    for digits in range(STEP, DIGITS + 1, STEP):
        inside = sized.join(state, _same(F.col("source"), F.col("s"))
                            & (F.substring("hash", 1, digits - STEP) == F.col("prefix")))
        counted = inside.groupBy("s", F.substring("hash", 1, digits).alias("bucket"), "below", "rest").agg(
            F.sum("size").alias("words"))
        upto = F.col("below") + F.sum("words").over(Window.partitionBy("s").orderBy("bucket"))
        bucket = F.struct("bucket", (F.col("upto") - F.col("words")).alias("below"), "rest", "upto")
        ended = counted.withColumn("upto", upto).where("upto > rest").groupBy("s").agg(F.min_by(bucket, "bucket").alias("x"))
        # a source of size 0 has no bucket in which its budget ends
        state = stored(ended.select("s", F.col("x.bucket").alias("prefix"), "x.below", "x.rest", "x.upto"), "thresholds")
    nearer_with = F.col("upto") - F.col("rest") < F.col("rest") - F.col("below")
    bound = state.select("s", F.when(nearer_with, F.concat("prefix", F.lit("~"))).otherwise(F.col("prefix")).alias("threshold"))
    return stored(targets.join(bound, _same(F.col("source"), F.col("s")), "left").select(
        F.col("source").alias("s"), "source_size", "target", "passes", "threshold"), "mix")


def _copies(most: int) -> Column:
    drawn = F.coalesce((F.col("hash") < F.col("threshold")).cast("int"), F.lit(0))
    return F.when(F.col("source_size") == 0, 1).otherwise(F.least(F.col("passes") + drawn, F.lit(most))).cast("long")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken (words), copies of every row of ``docs``.

    A source's target is met by as many whole passes over its documents as fit, and by
    the documents of lowest hash for the rest (see ``mixing_plan``). Documents are
    filtered by the threshold, never sorted, so the mix depends on doc_id alone and
    reruns agree.

    Rows of one doc_id share a hash and are taken together, rows without doc_id too. A
    NULL source is a source. Empty texts have size 0: taking them changes nothing, and
    a source of size 0 takes one copy of each. No document is taken more than ``most``
    times. An empty table gives an empty result.
    """
    sized = stored(sizes(docs), "sizes")
    plan = mixing_plan(sized, weights, share, most)
    return (sized.join(plan, _same(F.col("source"), F.col("s"))).withColumn("copies", _copies(most))
            .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"))


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``docs`` with each row repeated as often as ``mix`` takes it; rows taken 0 times go."""
    plan = mixing_plan(stored(sizes(docs), "sizes"), weights, share, most)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    drawn = docs.select(own, F.col("source").cast("string").alias("source"), document_hash().alias("hash")).join(
        plan, _same(F.col("source"), F.col("s")))
    return drawn.select("own", F.explode(F.array_repeat(F.lit(1), _copies(most).cast("int")))).select("own.*")
