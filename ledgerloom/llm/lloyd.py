"""Lloyd's clustering with the dimensions of the vectors dealt over tasks, in whole numbers.

Vectors become whole numbers and are cut into blocks of columns. A shard is a block of
some thousand vectors; it is what a task works on.

1. Each shard meets its own slice of the centroids and gives the exact squared distance
   over its columns, of each of its vectors to each centroid.
2. The distances of the blocks of the same vectors are added up under one key, and each
   vector takes the nearest centroid (the smaller number of equal ones).
3. Each shard adds up its own columns by cluster; per block of columns these sums make
   the new slice of the centroids. A cluster without vectors keeps its slice.

Centroids are never in one place whole: a slice is a row of ``k`` times ``block_dims``
numbers, whatever the data, and only these rows are broadcast (``k`` times ``dims``
numbers in all). Distances and labels are kept by rounds in the shared folder. Shards
hold the smallest whole numbers that fit their values, so one round shuffles less than
the vectors hold; no key is hot, as keys are shards of one size.

Defined results: vectors that are null, of another length, or hold a null or non-finite
component take no part. Ties go to the smaller centroid number. Rows that repeat an id
are vectors of their own. A null id takes part but is no starting centroid, unless too
few others are there; equal starting hashes stand by their components. With fewer
vectors than ``k`` each is a centroid at the start. An empty table gives no rows. Other
columns are not read. A component beyond 2^26 after scaling ends the job: its squared
distance might not fit a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import arrow_rows, settled

LARGEST = 2**26
SHARD_ROWS = 4096
BLOCK_DIMS = 32
_SIZES = (np.int8, np.int16, np.int32, np.int64)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes that hold them all, after one byte for their width."""
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    kind = next(k for k in _SIZES if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + values.astype(kind).tobytes()


def unpacked(data) -> np.ndarray:
    data = memoryview(data)
    return np.frombuffer(data[1:], f"<i{data[0]}").astype(np.int64)


def kept_vectors(rows: DataFrame, id_col: str, vec_col: str, dims: int, scale: int) -> DataFrame:
    """``id`` and ``x``: the vectors that take part, in whole numbers."""
    vec = F.col(f"`{vec_col}`")

    def fine(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))

    return (rows.select(F.col(f"`{id_col}`").alias("id"), F.transform(vec, lambda c: c.cast("double")).alias("v"))
            .where((F.size("v") == dims) & F.forall("v", fine))
            .select("id", F.transform("v", lambda c: F.when(F.abs(c) * scale < LARGEST, F.floor(c * scale)).otherwise(
                F.raise_error(F.lit("a component is too large for exact distances")).cast("long"))).alias("x")))


def start_centroids(kept: DataFrame, k: int, seed: int) -> DataFrame:
    """``number`` and ``x`` of the ``k`` vectors with the smallest hashes of seed and id."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    first = kept.select(drawn.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k)
    # ``k`` rows, whatever the data.
    return first.agg(F.array_sort(F.collect_list(F.struct(F.col("h").isNull().alias("unknown"), "h", "x"))).alias("s")).select(
        F.posexplode(F.transform("s", lambda s: s["x"])).alias("number", "x"))


def shards_of(kept: DataFrame, dims: int, shard_rows: int, block_dims: int) -> DataFrame:
    """``shard``, ``block``, ``x`` (packed, row after row); block 0 also has the ``ids``."""
    ids = T.ArrayType(kept.schema["id"].dataType)
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("block", T.IntegerType()),
                           T.StructField("x", T.BinaryType()), T.StructField("ids", ids)])
    starts = range(0, dims, block_dims)

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, shard_rows):
                part = batch.slice(at, shard_rows)
                flat = part.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                owners = part.column("id")
                of_ids = pa.array([owners.to_pylist()] + [None] * (len(starts) - 1), pa.list_(owners.type))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(starts), pa.int64()), pa.array(range(len(starts)), pa.int32()),
                     pa.array([packed(flat[:, s:s + block_dims]) for s in starts], pa.binary()), of_ids],
                    ["shard", "block", "x", "ids"])
                number += 1

    return arrow_rows(kept, run, schema)


def nearest(shards: DataFrame, slices: DataFrame, k: int) -> DataFrame:
    """Per shard ``labels`` and ``distances`` of its vectors, both packed."""
    with_slices = shards.select("shard", "block", "x").join(F.broadcast(slices), "block")

    def partial(batches):
        for batch in batches:
            for shard, x, c in zip(*(batch.column(n) for n in ("shard", "x", "centroids"))):
                c = c.values.to_numpy(zero_copy_only=False).reshape(k, -1)
                x = unpacked(x.as_buffer()).reshape(-1, c.shape[1])
                far = np.empty((len(x), k), np.int64)
                for number in range(k):
                    apart = x - c[number]
                    far[:, number] = np.einsum("ij,ij->i", apart, apart)
                yield pa.RecordBatch.from_arrays([pa.array([shard.as_py()]), pa.array([packed(far)], pa.binary())],
                                                 ["shard", "far"])

    # One row per block of columns meets under a shard's key.
    met = (arrow_rows(with_slices, partial, "shard long, far binary").groupBy("shard")
           .agg(F.collect_list("far").alias("far")))

    def decide(batches):
        for batch in batches:
            for shard, far in zip(batch.column("shard"), batch.column("far")):
                total = sum(unpacked(part.as_buffer()) for part in far.values).reshape(-1, k)
                label = total.argmin(axis=1)
                least = total[np.arange(len(total)), label]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard.as_py()]), pa.array([packed(label)], pa.binary()),
                     pa.array([packed(least)], pa.binary())], ["shard", "labels", "distances"])

    return arrow_rows(met, decide, "shard long, labels binary, distances binary")


def moved(shards: DataFrame, labels: DataFrame, slices: DataFrame, k: int) -> DataFrame:
    """The slices of the next round, from each shard's sums of its own columns."""
    marked = shards.select("shard", "block", "x").join(labels.select("shard", "labels"), "shard")

    def sums(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for block, x, label in zip(*(batch.column(n) for n in ("block", "x", "labels"))):
                label = unpacked(label.as_buffer())
                x = unpacked(x.as_buffer()).reshape(len(label), -1)
                block = block.as_py()
                if block not in held:
                    held[block] = np.zeros(k, np.int64), np.zeros((k, x.shape[1]), np.int64)
                held[block][0][:] += np.bincount(label, minlength=k)
                np.add.at(held[block][1], label, x)
        for block, (count, total) in held.items():
            for number in np.flatnonzero(count):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int32()), pa.array([number], pa.int32()),
                     pa.array([count[number]]), pa.array([total[number].tolist()])],
                    ["block", "number", "n", "total"])

    parts = arrow_rows(marked, sums, "block int, number int, n long, total array<long>")
    added = parts.select("block", "number", "n", F.posexplode("total").alias("place", "t")).groupBy(
        "block", "number", "place").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    # A floor, also of negative sums.
    mean = F.expr("(t - pmod(t, n)) div n")
    now = added.groupBy("block", "number").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", mean.alias("c")))), lambda s: s["c"]).alias("fresh"))
    old = split_slices(slices, k)
    return joined_slices(old.join(now, ["block", "number"], "left").select(
        "block", "number", F.coalesce("fresh", "x").alias("x")))


def split_slices(slices: DataFrame, k: int) -> DataFrame:
    """``block``, ``number``, ``x`` from ``block``, ``centroids`` (k slices in one array)."""
    width = (F.size("centroids") / k).cast("int")
    number = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    return slices.select("block", "centroids", width.alias("w"), number.alias("number")).select(
        "block", "number", F.slice("centroids", F.col("number") * F.col("w") + 1, F.col("w")).alias("x"))


def joined_slices(parts: DataFrame) -> DataFrame:
    held = F.array_sort(F.collect_list(F.struct("number", "x")))  # k entries
    return parts.groupBy("block").agg(F.flatten(F.transform(held, lambda s: s["x"])).alias("centroids"))


def cluster(rows: DataFrame, k: int, rounds: int, dims: int, scale: int = 64, seed: int = 1,
            id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD_ROWS,
            block_dims: int = BLOCK_DIMS) -> tuple[DataFrame, DataFrame]:
    """(``id``, ``cluster``, ``distance`` per vector; ``cluster``, ``centroid`` per centroid)
    after ``rounds`` rounds and a last assignment."""
    kept = kept_vectors(rows, id_col, vec_col, dims, scale)
    shards = settled(shards_of(kept, dims, shard_rows, block_dims), "lloyd-shards")
    start = settled(start_centroids(kept, k, seed), "lloyd-start")
    k = max(1, start.count())
    blocks = -(-dims // block_dims)
    cut = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    slices = settled(joined_slices(start.select("number", "x", cut.alias("block")).select(
        "block", "number", F.slice("x", F.col("block") * block_dims + 1, F.lit(block_dims)).alias("x"))), "lloyd-centroids")
    for _ in range(rounds):
        labels = settled(nearest(shards, slices, k), "lloyd-labels")
        slices = settled(moved(shards, labels, slices, k), "lloyd-centroids")
    last = nearest(shards, slices, k)

    def rows_of(batches):
        for batch in batches:
            for ids, label, far in zip(*(batch.column(n) for n in ("ids", "labels", "distances"))):
                yield pa.RecordBatch.from_arrays(
                    [ids.values, pa.array(unpacked(label.as_buffer()).astype(np.int32)),
                     pa.array(unpacked(far.as_buffer()))], ["id", "cluster", "distance"])

    schema = T.StructType([T.StructField("id", kept.schema["id"].dataType), T.StructField("cluster", T.IntegerType()),
                           T.StructField("distance", T.LongType())])
    owners = shards.where("block = 0").select("shard", "ids")
    found = settled(arrow_rows(owners.join(last, "shard"), rows_of, schema), "lloyd-clusters")
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "x"))), lambda s: s["x"]))  # few blocks
    return found, split_slices(slices, k).groupBy("number").agg(whole.alias("centroid")).select(
        F.col("number").alias("cluster"), "centroid")


def clustered(rows: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, id_col: str = "vec_id",
              **options) -> DataFrame:
    """Per vector: id, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and
    ``centroid_sha256``."""
    found, centroids = cluster(rows, k, rounds, dims, id_col=id_col, **options)
    # At most ``k`` rows from here on.
    per_cluster = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    totals = per_cluster.groupBy(F.lit(1)).agg(
        F.collect_list(F.struct("cluster", "cluster_inertia")).alias("all"),
        F.sum("cluster_inertia").alias("inertia")).select(F.inline("all"), "inertia")
    digest = F.sha2(F.concat_ws(",", F.transform("centroid", lambda c: c.cast("string"))).cast("binary"), 256)
    named = totals.join(F.broadcast(centroids.select("cluster", digest.alias("centroid_sha256"))), "cluster")
    return found.join(F.broadcast(named), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
