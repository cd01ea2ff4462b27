"""Mixing sources to target weights by hash-threshold histograms.

Each document has a hash; a source gives the mix its documents below a threshold of its own. The
thresholds come from histograms: tokens are summed by source and hash bucket, the bucket in which a
source's budget ends is found, and only that bucket is cut into finer ones, over and over, down to
single hashes. Nothing is sorted. Budgets are nested: with a larger budget a source keeps what it
gave under a smaller one. Every further pass reads the sizes, not the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinspan.llm.words import word_count
from twinspan.plans.scratch import save
from twinspan.sources.tables import table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Bits of the hash that a pass resolves, and the passes; after them a bucket is one hash.
BITS, PASSES = 10, 4
#: Sources whose thresholds may be broadcast: under 100 bytes each, so 5 MB at most.
BROADCAST_ROWS = 50_000
#: A null source is a source of its own.
SAME = "source <=> of"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, weight, target) of the rows (source, source_size), one for each source.

    Weights repeat along the sources by code point, null last. The budget, `share` of all sizes, is
    shared by weight; a share above `most` times its source's size stops there and what it leaves is
    shared anew among the others. A source of size 0 has target 0.
    """
    sizes = save(sizes, "sources")
    # Ranks without one task for all sources: ranges of sources, each numbered on from the ranges before it.
    ranges = sizes.withColumn("name", F.coalesce(F.encode("source", "utf-8"), F.lit(b""))).repartitionByRange(F.col("source").isNull(), "name")
    ranges = save(ranges.withColumn("range", F.spark_partition_id()), "ranges")
    before = ranges.groupBy("range").count().withColumn("start", F.sum("count").over(Window.orderBy("range")) - F.col("count"))
    rank = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").isNull(), "name"))
    ranked = ranges.join(F.broadcast(before), "range").withColumn("nth", F.col("start") + rank - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int")).cast("double")
    weighted = save(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(most)).alias("cap")), "weights")
    budget = float(weighted.agg(F.sum("source_size")).first()[0] or 0) * share
    # One number tells who stops: a source's cap against level times its weight. It rises until nobody new stops.
    level = -1.0
    while True:
        stopped = F.col("cap") <= F.col("weight") * level
        full, open_weight = weighted.agg(F.sum(F.when(stopped, F.col("cap"))), F.sum(F.when(~stopped, F.col("weight")))).first()
        if not open_weight:
            break
        now = max(budget - (full or 0.0), 0.0) / open_weight
        if now <= level:
            break
        level = now
    target = F.least("cap", F.col("weight") * level) if level >= 0 else F.lit(0.0)
    return weighted.select("source", "source_size", "weight", target.cast("double").alias("target"))


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """(of, rounds, below), `of` a source, from rows (source, size, hash) and (source, source_size, target).

    Every document is taken `rounds` times whole, and once more if its hash is under `below`. The
    bucket that holds a budget's end is refined until it is a single hash; that one is taken if this
    brings the sum nearer to the target.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    at = goals.withColumn("rounds", whole).select(F.col("source").alias("of"), "rounds", F.lit(0).cast("long").alias("prefix"), (F.col("target") - F.col("rounds") * F.col("source_size")).alias("rest"))
    at = save(at, "budgets")
    for done in range(0, BITS * PASSES, BITS):
        shift = BITS * PASSES - done
        inside = sized.join(_small(at), F.expr(f"{SAME} and shiftrightunsigned(hash, {shift}) = prefix"))
        bucket = F.shiftrightunsigned("hash", shift - BITS).alias("bucket")
        filled = inside.groupBy("of", bucket).agg(F.sum("size").alias("tokens"))
        running = F.sum("tokens").over(Window.partitionBy("of").orderBy("bucket"))
        rest = at.select(F.col("of").alias("source"), "rest")
        found = filled.withColumn("upto", running).join(_small(rest), F.expr(SAME))
        last = done + BITS == BITS * PASSES
        # The first bucket that is not wholly within the budget; its share is what the buckets before it left.
        over = found.where("upto > rest").groupBy("of").agg(F.min_by(F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("left"), "tokens"), "bucket").alias("b"))
        end = F.coalesce(F.col("b.bucket"), F.shiftleft(F.col("prefix") + 1, BITS))
        if last:
            end = F.when(F.col("b").isNotNull() & (2 * F.col("b.left") >= F.col("b.tokens")), F.col("b.bucket") + 1).otherwise(end)
        left = F.coalesce(F.col("b.left"), F.lit(0.0))
        over = over.withColumnRenamed("of", "source")
        at = save(at.join(_small(over), F.expr(SAME), "left").select("of", "rounds", end.alias("prefix"), left.alias("rest")), "budgets")
    return at.select("of", "rounds", F.col("prefix").alias("below"))


def _small(by_source: DataFrame) -> DataFrame:
    """One row for each source, sent to all executors if they are few enough; else Spark joins as it sees fit."""
    return F.broadcast(by_source) if by_source.count() <= BROADCAST_ROWS else by_source


def _spread(docs: DataFrame) -> Column:
    """A row's hash: of its id, and, as rows may lack one or share it, of all its columns of text."""
    texts = [F.col(f"`{name}`") for name, kind in docs.dtypes if kind == "string" and name != "doc_id"]
    return F.shiftrightunsigned(F.xxhash64(F.lit(41), "doc_id", *texts), 64 - BITS * PASSES)


def _times() -> Column:
    """How often the mix takes a document, from its hash and its source's threshold."""
    return (F.col("rounds") + F.when(F.col("hash") < F.col("below"), 1).otherwise(0)).cast("int")


def _sized(docs: DataFrame, size: Column) -> DataFrame:
    """(doc_id, source, size, hash): what is left of the texts."""
    return save(docs.select("doc_id", "source", size.alias("size"), _spread(docs).alias("hash")), "sizes")


def _cuts(sized: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(of, source_size, target, rounds, below) of each source."""
    goals = save(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "goals")
    return save(goals.join(thresholds(sized, goals), F.expr(SAME)).drop("source", "weight"), "cuts")


def mix(docs: DataFrame, size: Column, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document.

    taken is `size` times the times that the mix repeats the document. A null text has size 0. Rows that are
    equal in doc_id and all text share a hash, and so are all taken or not. An empty table gives no rows.
    """
    sized = _sized(docs, size)
    out = sized.join(_small(_cuts(sized, weights, share, most)), F.expr(SAME))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * _times()).alias("taken"))


def mixed(docs: DataFrame, size: Column, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The rows of the mix, with the columns of `docs`: each document as often as the mix takes it."""
    cuts = _cuts(_sized(docs, size), weights, share, most).select("of", "rounds", "below")
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "source", _spread(docs).alias("hash"))
    taken = row.join(_small(cuts), F.expr(SAME)).where(_times() > 0)
    return taken.select("row", F.explode(F.array_repeat(F.lit(True), _times()))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs, word_count(F.col("text")))
