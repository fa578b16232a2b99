"""Approximate nearest neighbours by one small-world graph for each shard.

Equal vectors are one node, which keeps the few smallest ids that any query can
need, so a vector that a third of all rows share is no hot spot in the graph. Nodes
are dealt to shards by hash; each shard's graph is written as flat arrays to the
shared folder; each block of queries meets each shard once; the best of every shard
are merged. Found candidates are scored again in double precision on the original
vectors, term by term from the left.

Defined results: vectors that are null, zero, empty, hold a null or non-finite
component or are not of the table's most common length take no part, as query or
candidate; null ids take no part; a row repeated as a whole counts once; with fewer
candidates than asked for, all found are returned; an empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import send_code, settled
from ledgerloom.llm.hnsw import Graph, lengthened

SHARD_ROWS, BLOCK_ROWS, SEARCH_WIDTH = 8192, 4096, 96


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` (long) and ``v`` (array of double) of the rows that take part."""
    v = F.col(f"`{vector_col}`")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.coalesce(fine & F.exists("v", lambda x: x != 0), F.lit(False)))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").head(1)
    return rows.where(F.size("v") == (common[0]["n"] if common else 0)).distinct()


def build_index(rows: DataFrame, most_ids: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row for each shard: its graph as flat arrays, original vectors and ids.

    ``rows`` have ``id`` and ``v``; a node keeps its ``most_ids`` smallest ids.
    """
    # The limit on ranks is applied within each task before the shuffle.
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    nodes = settled(rows.withColumn("_r", rank).where(F.col("_r") <= most_ids)
                    .groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vector-nodes")
    shards = max(1, -(-nodes.count() // shard_rows))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ids", key=lambda s: s.map(lambda x: x[0]))
        original = np.array(group["v"].tolist(), np.float64)
        ids = [list(x) for x in group["ids"]]
        graph = Graph(lengthened(original), seed=int(group["shard"].iloc[0])).arrays()
        return pd.DataFrame({
            "shard": [group["shard"].iloc[0]], "entry": [graph["entry"]], "flat": [graph["flat"]],
            "vectors": [graph["vectors"]], "width": [graph["width"]], "original": [original.tobytes()],
            "ids": [np.concatenate(ids).astype("<i8").tobytes()],
            "counts": [np.array([len(x) for x in ids], "<i4").tobytes()]})

    send_code(dealt.sparkSession)
    return settled(dealt.groupBy("shard").applyInPandas(
        build, "shard int, entry int, flat array<binary>, vectors binary, width int, original binary, "
               "ids binary, counts binary"), "vector-index")


def search(index: DataFrame, queries: DataFrame, k: int, width: int = SEARCH_WIDTH,
           block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` for ``queries`` (``id`` and ``v``)."""
    blocks = max(1, -(-queries.count() // block_rows))
    shards = index.select("shard").count()
    asked = (queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
             .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(max(0, shards * 1 - 1))))))
    numbered = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # Shards without nodes have no row: number those that have.
    order = index.select("shard", (F.row_number().over(Window.orderBy("shard")) - 1).alias("number"))
    numbered = numbered.join(F.broadcast(order), "shard").drop("shard").withColumnRenamed("number", "shard")

    def look(graph: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"),
                             "score": pd.Series(dtype="float64")})
        if not len(graph) or not len(asked):
            return none
        g = graph.iloc[0]
        made = Graph.of(int(g["entry"]), list(g["flat"]), g["vectors"], int(g["width"]))
        original = np.frombuffer(g["original"], np.float64).reshape(len(made.x), -1)
        counts = np.frombuffer(g["counts"], "<i4").astype(np.int64)
        ids, first = np.frombuffer(g["ids"], "<i8"), np.cumsum(counts) - counts
        q = np.array(asked["v"].tolist(), np.float64)
        query_id = asked["id"].to_numpy(np.int64)
        # Only the direction of a query matters for the order; the added coordinate is 0.
        longest = np.sqrt(np.einsum("ij,ij->i", original, original).max())
        unit = q / np.sqrt(np.einsum("ij,ij->i", q, q))[:, None] * longest
        found = made.search(np.column_stack([unit, np.zeros(len(q))]).astype(np.float32), width)
        a, b = np.nonzero(found >= 0)
        node = found[a, b]
        score = np.zeros(len(node))
        for d in range(q.shape[1]):  # left to right, as a plain loop would add
            score += q[a, d] * original[node, d]
        spread = counts[node]
        row = np.repeat(np.arange(len(node)), spread)
        place = np.arange(len(row)) - np.repeat(np.cumsum(spread) - spread, spread)
        out = pd.DataFrame({"query_id": query_id[a[row]], "vec_id": ids[first[node[row]] + place], "score": score[row]})
        out = out[out["query_id"] != out["vec_id"]].sort_values(
            ["query_id", "score", "vec_id"], ascending=[True, False, True])
        return out.groupby("query_id", sort=False).head(k)

    send_code(queries.sparkSession)
    found = numbered.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(
        look, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def neighbours(vectors: DataFrame, query: Column, k: int = 20, id_col: str = "vec_id",
               vector_col: str = "embedding", width: int = SEARCH_WIDTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The ``k`` nearest found for every row whose id (called ``id``) meets ``query``."""
    rows = settled(usable(vectors, id_col, vector_col), "vectors")
    # A query may meet itself among a node's ids, so one more id is kept.
    index = build_index(rows, k + 1, shard_rows)
    return search(index, rows.where(query), k, width)
