"""Search over product codes (C5): inverted cells, lookup tables, code scan, exact re-rank.

The index holds codes only. A query builds one table per subspace (its inner products with that
subspace's code vectors); the approximate score of a row is the sum of the table entries its codes
name. A scan multiplies a block of queries with the vectors that a block of codes stands for, and
sums table entries only for the rows that this product, less its rounding error, leaves among the
best; the outcome is that of the tables alone. The ``keep`` best rows of each query are then
scored with the exact vectors, and the ``k`` best of them are the result.

Cells are scanned by the grouped kernel of ``pairs`` (blocks on both sides, joined by cell; a cell
holding a third of all rows is several tasks, and gives ``keep`` rows a query however large it is). The code book is measured; beyond ``MAX_BROADCAST_BYTES`` rows
are decoded by a join instead and scanned as vectors, with the same scores.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..session import cut_lineage
from . import pairs as P
from . import quantize as QZ
from .centroids import MAX_BROADCAST_BYTES
from .neighbors import _rank_topk, assign_cells, normalized


def default_cells(n: int) -> int:
    """Number of cells for ``n`` rows: their square root, at least 16."""
    return max(16, round(n**0.5))


def code_scan(queries: DataFrame, data: DataFrame, book: np.ndarray, keep: int, block_rows: int = P.DEFAULT_BLOCK_ROWS) -> DataFrame:
    """``(query_id, neighbor_id, similarity)``: per query and cell the ``keep`` rows of largest
    approximate score. ``queries``: ``(query_id, cell, u)``; ``data``: ``(item_id, cell, codes)``;
    ``book``: ``[subspace, code, dimension]``."""
    held = queries.sparkSession.sparkContext.broadcast(book)

    def decoded(codes: np.ndarray) -> np.ndarray:
        return held.value[np.arange(codes.shape[1]), codes.astype(np.int64)].reshape(len(codes), -1)

    def exact(u: np.ndarray, codes: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        m, _, width = held.value.shape
        q, at = u.reshape(len(u), m, width), codes[c].astype(np.int64)
        out = np.zeros(len(r))
        for s in range(m):
            table = q[:, s] @ held.value[s].T
            out += table[r, at[:, s]]
        return out

    start = lambda left: P._TopK(left, keep, ("query_id", "neighbor_id"), decoded, exact)
    pairs = P.grouped_pairs(queries, data, ["cell"], "u", "codes", block_rows)
    return pairs.mapInArrow(P._meet(start), "query_id long, neighbor_id long, similarity double")


def knn_pq(
    df: DataFrame, cells: DataFrame, codebook: DataFrame, k: int = 10, nprobe: int = 12, keep: int = 50, m: int = 32, vec: str = "z",
    max_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Cosine neighbours of every row through product codes: ``(item_id, rank, neighbor_id,
    similarity)`` with exact similarities. ``keep`` rows a query are scored exactly."""
    u = cut_lineage(normalized(df.select("item_id", vec), vec, "u").select("item_id", "u"))
    codes = QZ.pq_encode(u, codebook, m, "u", normalize=False)
    unit_cells = normalized(cells, "mu", "mu")
    data = assign_cells(codes, unit_cells, "u", 1).select("item_id", "cell", "codes")
    queries = assign_cells(u.withColumnRenamed("item_id", "query_id"), unit_cells, "u", nprobe).drop("probe")
    if QZ.book_bytes(codebook) <= max_bytes:
        near = code_scan(queries, data, np.array(codebook.first()["codebook"]), keep)
    else:
        decoded = QZ.pq_decode(data, codebook).select("item_id", "cell", F.col("recon").alias("u"))
        near = P.knn_within_groups(queries, decoded, ["cell"], "u", keep)
    short = _rank_topk(near, "query_id", keep).select("query_id", "neighbor_id")
    exact = (
        short.join(u.select(F.col("item_id").alias("query_id"), F.col("u").alias("a")), "query_id")
        .join(u.select(F.col("item_id").alias("neighbor_id"), F.col("u").alias("b")), "neighbor_id")
        .select(F.col("query_id").alias("item_id"), "neighbor_id", V.dot("a", "b").alias("similarity"))
    )
    return _rank_topk(exact, "item_id", k).select("item_id", "rank", "neighbor_id", "similarity")
