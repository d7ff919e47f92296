"""Features of the cells of a pair as Column expressions: one row for each cell, or one for each feature's value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alignspark.spec import CHARACTERS, FeatureSpec

# Characters that are digits to Python's isdigit but aren't decimal digits (superscripts, circled digits
# and the like), as ranges of a character class.
OTHER_DIGITS = r"²³¹፩-፱᧚⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒"
DIGITS = rf"^[\p{{Nd}}{OTHER_DIGITS}]+$"


def elements(column: str, tokens: bool = False) -> Column:
    """The sequence as an array: characters of a string, or the elements of an array."""
    c = F.col(column)
    return c if tokens else F.when(F.char_length(c) > 0, F.split(c, "")).otherwise(F.array().cast("array<string>"))


def cells(pairs: DataFrame, tokens: bool = False, digits: bool = False) -> DataFrame:
    """pair_id, i, j, c1, c2, n1, n2: every cell of every pair; narrow, no join.  Null and empty sequences have no cells.

    digits: also d1 and d2, whether c1 and c2 are digits, which is matched once for each element and not for each cell.
    """
    marked = lambda c: F.transform(elements(c, tokens), lambda x: F.struct(x.alias("c"), x.rlike(DIGITS).alias("d"))) if digits else elements(c, tokens)
    both = pairs.select("pair_id", marked("s1").alias("a"), marked("s2").alias("b"))
    one = both.select("pair_id", "b", F.size("a").alias("n1"), F.size("b").alias("n2"), F.posexplode("a").alias("i", "c1"))
    every = one.select("pair_id", "i", "c1", "n1", "n2", F.posexplode("b").alias("j", "c2"))
    if not digits:
        return every
    return every.select("pair_id", "i", "n1", "n2", "j", F.col("c1.c").alias("c1"), F.col("c2.c").alias("c2"), F.col("c1.d").alias("d1"), F.col("c2.d").alias("d2"))


def bias(value: float = 1.0) -> Column:
    return F.lit(float(value))


def start() -> Column:
    return ((F.col("i") == 0) | (F.col("j") == 0)).cast("double")


def end() -> Column:
    return ((F.col("i") == F.col("n1") - 1) | (F.col("j") == F.col("n2") - 1)).cast("double")


def match() -> Column:
    return (F.col("c1") == F.col("c2")).cast("double")


def numeric(known: bool = False) -> Column:
    """known: the cells have d1 and d2."""
    return ((F.col("d1") & F.col("d2")) if known else F.col("c1").rlike(DIGITS) & F.col("c2").rlike(DIGITS)).cast("double")


def transition() -> Column:
    """Index of the pair of lower-cased characters, null where one isn't known."""
    at = lambda c: F.nullif(F.instr(F.lit(CHARACTERS), F.lower(c)), F.lit(0)) - 1
    first, second = (F.when(F.char_length(c) == 1, at(F.col(c))) for c in ("c1", "c2"))
    return second + len(CHARACTERS) * first


_PLANES = {"start": start, "end": end, "match": match, "numeric": numeric}


def planes(spec: FeatureSpec, known: bool = False) -> list[Column]:
    """The spec's features that every cell has a value of, in order (those in SQL; a caller's functions need a kernel); known as in numeric."""
    if spec.real or spec.sparse:
        raise ValueError("a caller's functions have no Column form; use operators.scoring.feature_rows")
    return [bias(spec.bias) if name == "bias" else numeric(known) if name == "numeric" else _PLANES[name]() for name in spec.planes]


def feature_long(pairs: DataFrame, spec: FeatureSpec, tokens: bool = False) -> DataFrame:
    """pair_id, i, j, k, value: one row for each feature that isn't zero."""
    entries = [F.struct(F.lit(k).alias("k"), value.alias("value")) for k, value in enumerate(planes(spec, spec.numeric))]
    entries += [F.struct((transition() + at).cast("int").alias("k"), F.lit(1.0).alias("value")) for name, at, _ in spec.blocks if name == "transition"]
    rows = cells(pairs, tokens, spec.numeric).select("pair_id", "i", "j", F.explode(F.array(*entries)).alias("f"))
    return rows.select("pair_id", "i", "j", "f.k", "f.value").where("k IS NOT NULL AND value <> 0")
