"""Exact nearest neighbours in blocks."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FOUND = "query_id long, vec_id long, similarity double"


def nearest(queries: DataFrame, rows: DataFrame, k: int, query_block: int = 2048, row_block: int = 20_000) -> DataFrame:
    """(query_id, vec_id, similarity, rank): for each query vector the ``k`` rows of greatest cosine, ties by vec_id.

    Queries are dealt into blocks of about ``query_block`` and rows into slices of about ``row_block``; one task holds one block and one
    slice, finds the best ``k`` of the slice for each query by a matrix product, and only these are shuffled on. Exact; null
    vectors and those of length 0 have no neighbours; all vectors have one dimension."""
    q = queries.where("embedding is not null").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    r = rows.where("embedding is not null").select("vec_id", "embedding")
    blocks = max(1, -(-q.count() // query_block))
    slices = max(1, -(-r.count() // row_block))
    # a block of queries goes to every slice of rows and a slice of rows to every block of queries
    numbers = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("slice", numbers(slices))
    r = r.withColumn("slice", F.pmod(F.xxhash64("vec_id"), F.lit(slices))).withColumn("block", numbers(blocks))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "similarity": []}).astype({"query_id": "int64", "vec_id": "int64"})
        a, b = (np.stack([np.asarray(v, float) for v in c]) for c in (left["q"], right["embedding"]))
        na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
        s = (a @ b.T) / np.maximum(np.outer(na, nb), 1e-300)
        s[na == 0], s[:, nb == 0] = -np.inf, -np.inf
        ids, vec, out = left["query_id"].to_numpy(), right["vec_id"].to_numpy(), []
        for i, row in enumerate(np.round(s, 9)):
            # only what reaches the k-th value is put in order, with all that equal it
            near = np.flatnonzero(row >= np.partition(row, len(row) - k)[len(row) - k]) if k < len(row) else np.arange(len(row))
            out += [(ids[i], vec[j], s[i, j]) for j in near[np.lexsort((vec[near], -row[near]))][:k] if np.isfinite(row[j])]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "similarity"]).astype({"query_id": "int64", "vec_id": "int64", "similarity": "float64"})

    best = q.groupBy("block", "slice").cogroup(r.groupBy("block", "slice")).applyInPandas(run, FOUND)
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "vec_id")
    return best.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def unordered_matches(found: DataFrame, kinds: DataFrame, least: float) -> DataFrame:
    """(x, y, similarity): each pair of different rows of one kind once, by the greater of both directions, at least ``least``;
    the pairs were ranked among all rows, themselves included, before kinds are compared."""
    kind = lambda c: kinds.select(F.col("vec_id").alias(c), F.col("kind").alias(f"kind_{c}"))
    p = found.where((F.col("query_id") != F.col("vec_id")) & (F.col("similarity") >= least))
    p = p.join(kind("query_id"), "query_id").join(kind("vec_id"), "vec_id").where("kind_query_id = kind_vec_id")
    return p.groupBy(F.least("query_id", "vec_id").alias("x"), F.greatest("query_id", "vec_id").alias("y")).agg(F.max("similarity").alias("similarity"))
