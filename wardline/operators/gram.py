"""Cross-products of many columns in one pass: matrices of Arrow batches within tasks, summed cell by cell across them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many columns their products are plain sums of one aggregate, which stay in the JVM.
NARROW = 8
#: Numbers that a task holds for its groups before it passes them on.
HELD = 8_000_000


def grams(df: DataFrame, columns: Sequence[str], by: str | None = None, weight: str | None = None) -> dict:
    """{group: (Z'WZ, rows)} of Z = columns, for each value of `by` or for None without one. The rows must hold no null.

    Wide designs are multiplied as matrices, a batch at a time. A task passes on one number for each group and pair of columns, these
    are summed by group and pair, and only groups x k (k + 1) / 2 sums reach the driver.
    """
    k, zs = len(columns), [F.col(c).cast("double") for c in columns]
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows, cols = np.triu_indices(k)
    if k <= NARROW:
        sums = [F.count("*"), *[F.sum(w * zs[i] * zs[j]) for i, j in zip(rows, cols, strict=True)]]
        got = df.groupBy(by).agg(*sums).collect() if by else [(None, *df.agg(*sums).first())]
        return {r[0]: (_square([float(v or 0) for v in r[2:]], k), int(r[1])) for r in got if by or r[1]}
    kind = df.select(by).schema[0].dataType.simpleString() if by else "int"
    g = F.col(by) if by else F.lit(0)

    def products(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict = {}
        names = None

        def flush():
            for start in range(0, len(keys := list(held)), 64):
                some = keys[start : start + 64]
                v = np.concatenate([[held[x][1], *held[x][0][rows, cols]] for x in some])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(some)), 1 + len(rows))).cast(pa.int32()) if names is None else pa.array([x for x in some for _ in range(1 + len(rows))], names), pa.array(np.tile(np.arange(1 + len(rows), dtype=np.int32), len(some))), pa.array(v)], ["g", "pair", "v"])

        for b in batches:
            names = b.schema.field("g").type
            z = np.column_stack([b.column(j + 2).to_numpy(zero_copy_only=False) for j in range(k)])
            zw = z * b.column(1).to_numpy(zero_copy_only=False)[:, None]
            coded = b.column(0).dictionary_encode()
            code = coded.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            starts = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1))
            for key, a, e in zip(coded.dictionary.to_pylist(), starts[:-1], starts[1:], strict=True):
                own = slice(None) if len(coded.dictionary) == 1 else order[a:e]
                total, n = held.get(key, (0.0, 0))
                held[key] = (total + zw[own].T @ z[own], n + int(e - a))
            if len(held) * k * k > HELD:
                yield from flush()
                held.clear()
        if held:
            yield from flush()

    parts = df.select(g.alias("g"), w.alias("w"), *[z.alias(f"z{j}") for j, z in enumerate(zs)]).mapInArrow(products, f"g {kind}, pair int, v double")
    out: dict = {}
    for key, pair, v in parts.groupBy("g", "pair").agg(F.sum("v")).collect():
        out.setdefault(key if by else None, np.zeros(1 + len(rows)))[pair] = v
    return {key: (_square(v[1:], k), int(v[0])) for key, v in out.items()}


def gram(df: DataFrame, columns: Sequence[str], weight: str | None = None) -> tuple[np.ndarray, int]:
    return grams(df, columns, None, weight).get(None, (np.zeros((len(columns), len(columns))), 0))


def _square(upper: Sequence[float], k: int) -> np.ndarray:
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = upper
    return out + np.triu(out, 1).T
