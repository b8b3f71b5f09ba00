"""Optimal one-to-one matching of reference and predicted boxes.

Small sides are solved natively: a fold over the boxes of one side keeps the
best sum for every set of used boxes of the other. Rows whose smaller side is
larger than MASK_BOXES go through an Arrow function with the assignment
algorithm, so every size is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioframe.functions import geometry

#: Largest smaller side of the native fold (2^n states).
MASK_BOXES = 6


def weight_matrix(gt: Column, pred: Column) -> Column:
    return F.transform(gt, lambda g: F.transform(pred, lambda p: geometry.iou(g, p)))


def _bit(j: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), j)


def folded_best(rows: Column, n_cols: Column) -> Column:
    """Best sum of a matching of a weight matrix with few columns."""
    states = F.array_repeat(F.lit(0.0), _bit(n_cols))

    def add(best: Column, row: Column) -> Column:
        def state(old: Column, mask: Column) -> Column:
            def through(w: Column, j: Column) -> Column:
                bit = _bit(j)
                return F.when(mask.bitwiseAND(bit) != 0, F.get(best, mask - bit) + w).otherwise(0.0)

            return F.greatest(old, F.coalesce(F.array_max(F.transform(row, through)), F.lit(0.0)))

        return F.transform(best, state)

    return F.array_max(F.aggregate(rows, states, add))


def best_sum(gt: Column, pred: Column) -> Column:
    """Native best matching sum; the smaller side is the mask side (at most MASK_BOXES)."""
    n, m = F.coalesce(F.size(gt), F.lit(0)), F.coalesce(F.size(pred), F.lit(0))
    wide = folded_best(weight_matrix(gt, pred), m)
    tall = folded_best(weight_matrix(pred, gt), n)
    return F.when((n <= 0) | (m <= 0), 0.0).when(m <= n, wide).otherwise(tall)


def assignment(weights: list[list[float]]) -> float:
    """Largest sum of a one-to-one matching (shortest augmenting paths, any size)."""
    if not weights or not weights[0]:
        return 0.0
    if len(weights) > len(weights[0]):
        weights = [list(c) for c in zip(*weights)]
    n, m = len(weights), len(weights[0])
    u, v, owner = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, back, done = [float("inf")] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while True:
            done[j0] = True
            i0, delta, j1 = owner[j0], float("inf"), 0
            for j in range(1, m + 1):
                if not done[j]:
                    cost = -weights[i0 - 1][j - 1] - u[i0] - v[j]
                    if cost < least[j]:
                        least[j], back[j] = cost, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(m + 1):
                if done[j]:
                    u[owner[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0], j0 = owner[back[j0]], back[j0]
    return sum(weights[owner[j] - 1][j - 1] for j in range(1, m + 1) if owner[j])


def with_page_sums(df: DataFrame, gt: str, pred: str, out: str) -> DataFrame:
    """Add ``out``: per page of two page-wise box columns struct(best, n_gt, n_pred). Missing pages are empty.

    All in the row: nothing is exploded or shuffled. Rows with a page whose
    smaller side is larger than MASK_BOXES go through the Arrow function instead.
    """
    none = F.array().cast("array<array<double>>")
    at = lambda pages, i: F.coalesce(F.get(F.col(pages), i), none)
    n = F.greatest(F.coalesce(F.size(gt), F.lit(0)), F.coalesce(F.size(pred), F.lit(0)))
    index = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    big = F.exists(index, lambda i: F.least(F.size(at(gt, i)), F.size(at(pred, i))) > MASK_BOXES)

    def page(i: Column, best: Column) -> Column:
        return F.struct(best.alias("best"), F.size(at(gt, i)).alias("n_gt"), F.size(at(pred, i)).alias("n_pred"))

    native = df.filter(~big).withColumn(out, F.transform(index, lambda i: page(i, best_sum(at(gt, i), at(pred, i)))))
    many = df.filter(big).withColumn("__best", _assigned(F.col(gt), F.col(pred)))
    many = many.withColumn(out, F.transform(index, lambda i: page(i, F.get("__best", i)))).drop("__best")
    return native.unionByName(many)


def box_iou(a, b) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(0.0, w) * max(0.0, h)
    size = lambda x: max(0.0, x[2] - x[0]) * max(0.0, x[3] - x[1])
    union = size(a) + size(b) - both
    return both / union if union > 0 else 0.0


def _assigned(gt: Column, pred: Column) -> Column:
    import pandas as pd

    def one(g, p):
        if g is None or p is None:
            return None
        pages = [(g[i] if i < len(g) else [], p[i] if i < len(p) else []) for i in range(max(len(g), len(p)))]
        return [assignment([[box_iou(x, y) for y in q] for x in page]) for page, q in pages]

    def over(gts: pd.Series, preds: pd.Series) -> pd.Series:
        return pd.Series([one(g, p) for g, p in zip(gts, preds)], dtype="object")

    over.__annotations__ = {"gts": pd.Series, "preds": pd.Series, "return": pd.Series}
    return F.pandas_udf(over, "array<double>")(gt, pred)
