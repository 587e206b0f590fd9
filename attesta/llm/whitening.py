"""Whitened leading components of embeddings; the eigenpairs come from contour integration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from attesta.llm import feast
from attesta.session import materialise

COMPONENTS = 4
SCALE = 256
#: Share of the trace below which an eigenvalue counts as zero: such a component has no whitened form.
ZERO = 1e-12


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """Rows whose vector is there, has the commonest length (of equally common ones the longest) and only finite entries."""
    v = F.col(vector)
    kind = rows.schema[vector].dataType.elementType.simpleString()
    finite = lambda c: c.isNotNull() if kind not in ("float", "double") else c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    whole = rows.filter(v.isNotNull() & (F.size(v) > 0) & F.forall(v, finite))
    lengths = whole.groupBy(F.size(v).alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    return whole.filter(F.size(v) == (lengths[0]["length"] if lengths else 0))


def quantised(vector: Column) -> Column:
    """floor(256 c) of each entry, as long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long"))


def _summed(parts: DataFrame) -> dict[tuple[int, int], float]:
    """Sums of the tasks' partial matrices, given by rows (row, values), by place; bounded by the square of the dimension."""
    each = parts.select("row", F.posexplode("values").alias("column", "value")).groupBy("row", "column").agg(F.sum("value").alias("value"))
    return {(r["row"], r["column"]): r["value"] for r in each.collect()}


def _stacked(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def products(fit: DataFrame, mean: np.ndarray, turn: np.ndarray | None = None) -> np.ndarray:
    """Sum of the outer products of all centred vectors, or of their images under `turn`. Each task adds up its own."""
    width = len(mean)
    size = width if turn is None else turn.shape[1]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            x = _stacked(batch.column(0), width).astype(np.float64) - mean
            x = x if turn is None else x @ turn
            total += x.T @ x
        values = pa.array([row[i:] for i, row in enumerate(total)], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), values], ["row", "values"])

    out = np.zeros((size, size))
    for (i, k), value in _summed(fit.select("x").mapInArrow(partial, "row int, values array<double>")).items():
        out[i, i + k] = out[i + k, i] = value
    return out


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: list[int]
    turn: np.ndarray
    explained: list[float]
    identity_error: float


def fit(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """Components of the distinct quantised vectors of usable rows; None where there is no vector.

    Sums are exact; the covariance is added up from centred vectors in the tasks, and only matrices of the
    dimension come to the driver. Eigenvalues that are zero have no component.
    """
    distinct = materialise(rows.select(quantised(F.col(vector)).alias("x")).distinct(), "vectors")
    each = distinct.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("s"))
    totals = sorted((r["at"], r["n"], int(r["s"])) for r in each.collect())  # one row for each dimension
    if not totals:
        return None
    n, sums = totals[0][1], [s for _, _, s in totals]
    mean = np.array([s / n for s in sums])
    covariance = products(distinct, mean) / n
    trace = float(np.trace(covariance))
    values, vectors = feast.leading(covariance, components)
    there = values > ZERO * trace
    turn = vectors[:, there] / np.sqrt(values[there])
    error = np.abs(products(distinct, mean, turn) / n - np.eye(turn.shape[1])).max(initial=0.0)
    return Whitening(n, sums, turn, [float(v) / trace for v in values[there]], float(error))


def deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum of (n x - S)^2 over the dimensions of each row; None where a long cannot hold it."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * n + max(map(abs, sums))
    if most * most * len(sums) < 2**63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    return [d if d < 2**63 else None for d in exact]


def whiten(rows: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each usable row and component up to `components`.

    Rows with null vectors, null or non-finite entries, or a length other than the commonest have none. Repeated
    rows and ids have theirs each; components of zero variance, and tables without usable rows, give no rows.
    """
    whole = usable(rows, vector)
    found = fit(whole, vector, components)
    if found is None:
        found = Whitening(0, [], np.zeros((0, 0)), [], 0.0)
    mean = np.array([s / found.n for s in found.sums])

    @pandas_udf("deviation long, whitened array<double>")
    def placed(x: pd.Series) -> pd.DataFrame:
        if not len(x) or not found.n:
            return pd.DataFrame({"deviation": pd.Series([], dtype="Int64"), "whitened": pd.Series([], dtype=object)})
        stack = np.stack(x.to_numpy()).astype(np.int64)
        exact = pd.Series(deviation(stack, found.n, found.sums), dtype="Int64")
        return pd.DataFrame({"deviation": exact, "whitened": list((stack - mean) @ found.turn)})

    shares = F.element_at(F.lit(found.explained).cast("array<double>"), F.col("component"))
    each = whole.select(id_col, placed(quantised(F.col(vector))).alias("placed")).select(id_col, "placed.deviation", F.posexplode("placed.whitened").alias("at", "whitened"))
    return each.withColumn("component", F.col("at") + 1).select(
        id_col, "component", F.lit(found.n).cast("long").alias("n"), "deviation", "whitened", shares.alias("explained"),
        F.lit(found.identity_error).alias("identity_error"),
    )
