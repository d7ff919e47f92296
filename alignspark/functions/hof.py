"""The default machine's recurrence as nested higher-order functions: scores without a Python worker.

For features whose value follows from the two characters (bias, match, numeric).  Rows of the lattice are arrays that
aggregate() carries from one character of s1 to the next.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from alignspark.functions.features import DIGITS, elements
from alignspark.spec import FeatureSpec


def _marked(column: str) -> Column:
    """The sequence's elements with whether each is a digit, which is matched once for each and not for each cell."""
    return F.transform(elements(column), lambda x: F.struct(x.alias("c"), x.rlike(DIGITS).alias("d")))


def _once(value: Column, f) -> Column:
    """f of a value through a lambda's variable, so that it is worked out once however often f names it."""
    return F.transform(F.array(value), f)[0]


def _dot(theta: np.ndarray, spec: FeatureSpec, c1: Column, c2: Column) -> Column:
    out = F.lit(0.0)
    for k, name in enumerate(spec.planes):
        w = F.lit(float(theta[k]))
        if name == "bias":
            out = out + w * float(spec.bias)
        elif name == "match":
            out = out + F.when(c1["c"] == c2["c"], w).otherwise(0.0)
        elif name == "numeric":
            out = out + F.when(c1["d"] & c2["d"], w).otherwise(0.0)
        else:
            raise ValueError(f"{name} has no higher-order form")
    return out


def class_log_weight(theta: np.ndarray, spec: FeatureSpec, n_classes: int, c: int, best: bool = False) -> Column:
    """Log weight of class c of the pair s1, s2; null where a sequence is null or empty."""
    node, mat, ins, dele = (theta[c + m * n_classes] for m in range(4))
    a, b = _marked("s1"), _marked("s2")

    def add(x: Column, y: Column, z: Column) -> Column:
        if best:
            return F.greatest(x, y, z)
        # an array and a fold, so that each of the three is worked out once
        most = lambda v: F.transform(F.array(F.struct(v.alias("v"), F.array_max(v).alias("m"))), lambda s: s["m"] + F.log(F.aggregate(s["v"], F.lit(0.0), lambda t, w: t + F.exp(w - s["m"]))))[0]
        return F.transform(F.array(F.array(x, y, z)), most)[0]

    def pushed(row: Column, value: Column) -> Column:
        return F.concat(row, F.array(value))

    def body(a: Column, b: Column) -> Column:
        rest = lambda x: F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0)))
        at = lambda row, j: F.element_at(row, j.cast("int"))
        head, first = F.element_at(a, 1), F.element_at(b, 1)
        top = F.aggregate(rest(b), F.array(_dot(node, spec, head, first)), lambda row, y: pushed(row, F.element_at(row, -1) + _dot(ins + node, spec, head, y)))

        def next_row(above: Column, x: Column) -> Column:
            begin = F.array(F.element_at(above, 1) + _dot(dele + node, spec, x, first))

            def cell(row: Column, j: Column) -> Column:
                y = at(b, j)
                come = add(at(above, j - 1) + _dot(mat, spec, x, y), F.element_at(row, -1) + _dot(ins, spec, x, y), at(above, j) + _dot(dele, spec, x, y))
                return F.when(j == 1, row).otherwise(pushed(row, come + _dot(node, spec, x, y)))

            return F.aggregate(F.sequence(F.lit(1), F.size(b)), begin, cell)

        return F.aggregate(rest(a), top, next_row, lambda row: F.element_at(row, -1))

    # through a lambda's variable, so that the strings are split once and not for each cell
    whole = _once(F.struct(a.alias("a"), b.alias("b")), lambda p: body(p["a"], p["b"]))
    return F.when((F.char_length("s1") > 0) & (F.char_length("s2") > 0), whole)


def probabilities(theta: np.ndarray, spec: FeatureSpec, n_classes: int, best: bool = False) -> Column:
    """Array of the classes' probabilities, in the order of their rows in theta."""
    z = F.array(*[class_log_weight(theta, spec, n_classes, c, best) for c in range(n_classes)])
    # each step names the one before it several times, and the weights are a walk of the whole lattice
    shares = lambda exps: _once(F.struct(exps.alias("e"), F.aggregate(exps, F.lit(0.0), lambda s, v: s + v).alias("t")), lambda p: F.transform(p["e"], lambda v: v / p["t"]))
    scaled = lambda p: F.when(p["m"].isNotNull(), _once(F.transform(p["z"], lambda v: F.exp(v - p["m"])), shares))
    return _once(z, lambda z: _once(F.struct(z.alias("z"), F.array_max(z).alias("m")), scaled))
