"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors of cosine c or more are within squared distance 2 - 2c. They are rotated by one random orthogonal matrix
and split into blocks; in at least one block a pair is within its proportional part of that budget. Each block is
range-joined on a grid of cells as wide as the block's radius, and what passes the block's budget is verified exactly on
the whole vectors. A pair counts in the first block whose budget it meets, so the union of candidates has no repeats.

Equal vectors are put together first. Cells of more than TILE vectors are cut into tiles, and a tile returns counts and
a spanning set of links, never its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelsieve.llm.common import stored
from labelsieve.llm.components import components

#: Vectors of one side of a tile.
TILE = 2000
BLOCKS = 8
#: A grid has one axis up to this size of the largest label, and one more for each further factor of PER_AXIS, as far as
#: blocks have coordinates.
ONE_AXIS, PER_AXIS = 20_000, 32


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random orthogonal matrix, the same for the same size."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _budget(cosine: float) -> float:
    return 2 - 2 * cosine + 1e-9


def _unit(column, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in double precision, as they are and rotated to blocks after scaling to length 1."""
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten().to_numpy(zero_copy_only=False)
    x = flat.astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return x, x @ rotation(dim)


def _bounds(dim: int) -> np.ndarray:
    return np.linspace(0, dim, min(BLOCKS, dim) + 1).astype(int)


def _cells(cosine: float, axes: int):
    """Each vector into its cells: its own and the next along each axis, in each block."""

    def run(batches):
        for batch in batches:
            sizes = np.diff(batch["vec"].offsets.to_numpy())
            for dim in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dim))
                _, y = _unit(part["vec"], int(dim))
                at = _bounds(int(dim))
                width = np.sqrt(_budget(cosine) / (len(at) - 1))
                for b in range(len(at) - 1):
                    grid = np.floor(y[:, at[b] : min(at[b] + axes, at[b + 1])] / width).astype(np.int64)
                    for shift in np.ndindex(*(2,) * grid.shape[1]):
                        cell = [" ".join(map(str, row)) for row in (grid + shift).tolist()]
                        n = part.num_rows
                        yield pa.RecordBatch.from_arrays([part["cls"], part["label"], part["vec"], part["rows"], pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, b, np.int32)), pa.array(cell)], names=["cls", "label", "vec", "rows", "dim", "block", "cell"])

    return run


def local_components(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component."""
    low = np.arange(n)
    while True:
        least = np.minimum(low[i], low[j])
        new = low.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _tile(cosine: float, axes: int):
    def run(table: pa.Table) -> pa.Table:
        # Of the rows of a tile each side comes in one order, so that results don't depend on the shuffle.
        table = table.sort_by("cls")
        dim, block, cell = table["dim"][0].as_py(), table["block"][0].as_py(), np.array(list(map(int, table["cell"][0].as_py().split())))
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        cls, rows, salt = table["cls"].to_numpy(), table["rows"].to_numpy(), table["salt"].to_numpy()
        x, y = _unit(table["vec"], dim)
        at = _bounds(dim)
        most = _budget(cosine) / (len(at) - 1)
        own = slice(at[block], at[block + 1])
        grid = np.floor(y[:, at[block] : min(at[block] + axes, at[block + 1])] / np.sqrt(most)).astype(np.int64)
        a, b = np.flatnonzero(salt == low), np.flatnonzero(salt == high)
        square = (y[:, own] ** 2).sum(axis=1)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(0, len(a), 500):
            mine = a[k : k + 500]
            near = square[mine][:, None] + square[b][None, :] - 2 * y[mine, own] @ y[b, own].T <= most + 1e-12
            i, j = np.nonzero(near)
            i, j = mine[i], b[j]
            # Each pair once, in the cell that is the larger along each axis of the two own ones.
            use = (np.maximum(grid[i], grid[j]) == cell).all(axis=1) & ((i < j) if low == high else True)
            i, j = i[use], j[use]
            for e in range(block):
                part = slice(at[e], at[e + 1])
                earlier = ((y[i, part] - y[j, part]) ** 2).sum(axis=1) <= most + 1e-12
                i, j = i[~earlier], j[~earlier]
            same = np.einsum("nd,nd->n", x[i], x[j]) >= cosine
            left.append(i[same])
            right.append(j[same])
        i, j = np.concatenate(left), np.concatenate(right)
        links = np.bincount(i, rows[j], minlength=len(cls)) + np.bincount(j, rows[i], minlength=len(cls))
        root = local_components(len(cls), i, j)
        hit = links > 0
        kind = table["cls"].type
        return pa.table({"cls": pa.array(cls[hit], kind), "links": links[hit].astype(np.int64), "root": pa.array(cls[root][hit], kind)})

    return run


def embedding_groups(vectors: DataFrame, cosine: float = 0.98, vec_id: str = "vec_id", vec: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Two vectors link when their labels are equal and not null, their sizes are equal and their cosine in double
    precision reaches `cosine`. A vector that is null, empty, zero, or holds null or non-finite components, or whose
    identifier is null, links with nothing, is its own component and is kept. Equal vectors of a label are told by two hashes, of 64 and 32 bits. Rows that repeat are vectors of their own and link with each other.
    Identifiers may be numbers or text, compared as such. An empty table gives an empty result; other columns aren't read.
    """
    types = dict(vectors.dtypes)
    key = "string" if types[vec_id] == "string" else "long"
    # Single precision travels as it is, at half the size; it is widened where it is compared.
    body = F.col(vec) if types[vec] == "array<float>" else F.col(vec).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast(key).alias("vec_id"), F.col(label).cast("string").alias("label"), body.alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    valid = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("vec") > 0) & fine, F.lit(False))
    keyed = rows.withColumn("k1", F.when(valid, F.xxhash64("label", "vec"))).withColumn("k2", F.when(valid, F.hash("vec", "label")))
    classes = keyed.filter("k1 is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("cls"), F.count(F.lit(1)).alias("rows"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    axes = 1
    while most > ONE_AXIS * PER_AXIS ** (axes - 1):
        axes += 1
    spread = classes.select("cls", "label", "vec", "rows").mapInArrow(_cells(cosine, axes), f"cls {key}, label string, vec {dict(rows.dtypes)['vec']}, rows long, dim int, block int, cell string")
    place = ["label", "dim", "block", "cell"]
    full = spread.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("parts")).filter("parts > 1")
    salted = spread.join(full, place, "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("salt", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    tiled = salted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("low", F.least("salt", "other")).withColumn("high", F.greatest("salt", "other"))
    found = tiled.groupBy(*place, "low", "high").applyInArrow(_tile(cosine, axes), f"cls {key}, links long, root {key}")
    found = stored(found, "vector-links")
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    named = classes.select("k1", "k2", "cls", "rows").join(counts, "cls", "left").join(roots, F.col("cls") == F.col("node"), "left")
    named = named.select("k1", "k2", (F.col("rows") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("component_id"))
    out = keyed.select("vec_id", "k1", "k2").join(named, ["k1", "k2"], "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select(F.col("vec_id").cast(types[vec_id]).alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"))
