"""Approximate nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. Blocks of vectors are indexed each by inverted
files: for each pivot, which vectors of the block have it among their nearest, and in which place. A
query reads the files of its own nearest pivots, adds up the footrule distance between the two orders
(a pivot that one of them lacks counts as the place after the last). Orders tell of directions only, so the distance becomes a cosine
by the line that fits pairs of the block best, and with the vector's length an inner product. The share of the block's
vectors where that is greatest, those of least distance if all are of one length, is ranked by the inner product in double precision.
The best of all blocks are merged.

Vectors lie in blocks of bounded size, dealt by row; the queries too. Every block of vectors meets every
block of queries, as the search is over all rows, by a join on block numbers; neither side is broadcast or
gathered, and each pair of blocks gives its few best rows for a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twinspan.plans.scratch import bounded_batches, save
from twinspan.sources.tables import table

TOP = 20
PIVOTS = 256
#: Length of a representation.
PLACES = 64
#: Share of a block's vectors, those of greatest expected inner product, whose inner products are computed.
RERANKED = 0.2
#: Rows of a block of vectors, of a block of queries, and of the sample that the pivots are taken from.
BLOCK, QUERY_BLOCK, SAMPLE = 4096, 512, 4096
#: Vectors of a block that are compared with all of it, to tell cosines from distances.
FITTED = 16


def usable(v: Column) -> Column:
    """Whether a vector takes part: not null or empty, no null, infinite or NaN component, not zero."""
    d = lambda x: x.cast("double")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(d(x)) & (F.abs(d(x)) < float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: d(x) != 0), F.lit(False))


def pivots(vectors: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Unit vectors, far apart: from the sample, each next one the least like those chosen."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    chosen = [0]
    like = unit @ unit[0]
    while len(chosen) < min(count, len(unit)):
        chosen.append(int(np.argmin(like)))
        like = np.maximum(like, unit @ unit[chosen[-1]])
    return unit[chosen]


def orders(vectors: np.ndarray, by: np.ndarray, places: int = PLACES) -> np.ndarray:
    """Each vector's nearest pivots, nearest first."""
    like = vectors @ by.T
    places = min(places, by.shape[0])
    near = np.argpartition(-like, places - 1, axis=1)[:, :places]
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(like, near, 1), axis=1, kind="stable"), 1)


class Block:
    """Vectors with the inverted files of their pivots."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, by: np.ndarray):
        self.ids, self.vectors, self.by = ids, vectors, by
        order = orders(vectors, by)
        self.places = order.shape[1]
        pivot, row = order.ravel(), np.repeat(np.arange(len(ids)), self.places)
        place = np.tile(np.arange(self.places), len(ids))
        by_pivot = np.argsort(pivot, kind="stable")
        self.row, self.place = row[by_pivot], place[by_pivot].astype(np.int32)
        self.file = np.searchsorted(pivot[by_pivot], np.arange(len(by) + 1))
        self.norms = np.linalg.norm(vectors, axis=1)
        tried = np.linspace(0, len(ids) - 1, min(FITTED, len(ids))).astype(int)
        x = np.concatenate([self.distances(order[i]) for i in tried]).astype(float)
        y = np.concatenate([vectors @ vectors[i] / self.norms / self.norms[i] for i in tried])
        x -= (middle := x.mean())
        fall = min(-1e-9, float(x @ y / max(x @ x, 1e-9)))  # a greater distance is never taken for a nearer vector
        self.line = float(y.mean()) - fall * middle, fall

    def distances(self, order: np.ndarray) -> np.ndarray:
        """Footrule to each vector, less a constant: as if no pivot were shared; each posting read corrects that for its vector."""
        distance = np.zeros(len(self.ids), np.int32)
        for j, p in enumerate(order):
            at = slice(self.file[p], self.file[p + 1])
            distance[self.row[at]] += np.abs(self.place[at] - j) - (self.places - self.place[at]) - (self.places - j)
        return distance

    def search(self, ids: np.ndarray, queries: np.ndarray, top: int = TOP, share: float = RERANKED) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and inner products of the best rows of this block, its own id left out."""
        take = min(len(self.ids), max(top + 1, int(np.ceil(share * len(self.ids)))))
        for q, query, order in zip(ids, queries, orders(queries, self.by), strict=True):
            expected = self.norms * (self.line[0] + self.line[1] * self.distances(order))
            near = np.argpartition(-expected, take - 1)[:take] if take < len(expected) else np.arange(len(expected))
            near = near[self.ids[near] != q]
            score = (self.vectors[near] * query).sum(1)  # the same sum whatever the rows beside it
            best = np.lexsort((self.ids[near], -score))[:top]
            yield self.ids[near][best], score[best]


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(float).reshape(-1, dims)


def _blocks(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """The rows gathered into `size` or so for a block, dealt by row: one row (name, ids, vectors) for each block."""
    count = max(1, -(-rows.count() // size))
    dealt = rows.withColumn(name, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(count)))
    gathered = F.collect_list(F.struct("vec_id", "v"))
    return dealt.groupBy(name).agg(gathered.alias("rows")).select(name, F.col("rows.vec_id").alias("ids"), F.flatten("rows.v").alias("vectors")), count


def nearest(vectors: DataFrame, is_query: Column, top: int = TOP, share: float = RERANKED) -> DataFrame:
    """(query_id, rank, vec_id, score) of the `top` nearest rows found for each query row.

    vectors: (vec_id, embedding). Vectors that are null, zero, or hold null or non-finite components,
    and such of another length than most (the shorter on a tie), take no part, nor do rows without an
    id. A row is never its own neighbour; rows that repeat an id count once each as candidates of others, and
    a repeated query is answered once, for the least of its vectors. With fewer candidates than `top`, all are given. Ties go to the
    smaller vec_id. An empty table gives no rows. Columns beside the two are left alone.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = save(rows.select("vec_id", is_query.alias("is_query"), F.col("embedding").cast("array<double>").alias("v")), "vectors")
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    if sizes is None:
        return none
    dims = sizes["dims"]
    rows = rows.where(F.size("v") == dims)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toPandas()["v"]
    sent = spark.sparkContext.broadcast(pivots(np.array(sample.tolist())))  # at most PIVOTS vectors

    data, _ = _blocks(rows.select("vec_id", "v"), BLOCK, "block")
    asked, count = _blocks(rows.where("is_query").groupBy("vec_id").agg(F.min("v").alias("v")), QUERY_BLOCK, "asked")
    asked = save(asked.select("asked", F.col("ids").alias("query_ids"), F.col("vectors").alias("queries")), "queries")
    pairs = data.withColumn("asked", F.explode(F.sequence(F.lit(0), F.lit(count - 1)).cast("array<bigint>"))).join(asked, "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                if number != one.column("block")[0].as_py():
                    number = one.column("block")[0].as_py()
                    known = Block(np.asarray(one.column("ids").flatten()), _matrix(one.column("vectors"), dims), sent.value)
                queries = np.asarray(one.column("query_ids").flatten())
                found = [(q, *x) for q, x in zip(queries, known.search(queries, _matrix(one.column("queries"), dims), top, share), strict=True)]
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array(np.repeat([x[0] for x in found], [len(x[1]) for x in found]).astype(np.int64)),
                    "vec_id": pa.array(np.concatenate([x[1] for x in found])),
                    "score": pa.array(np.concatenate([x[2] for x in found])),
                })

    bounded_batches(spark)
    found = pairs.select("block", "ids", "vectors", "query_ids", "queries").mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= top)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
