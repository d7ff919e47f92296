"""The lattices of very long pairs, cut into tiles that many tasks work on: a wave of tiles a step, borders exchanged by key.

Tile (u, v) of a pair holds the cells of a block of s1 and a block of s2.  All tiles with the same u + v are a wave: each
needs the last rows of the tile above, the last columns of the tile to the left and the corner of the one between, as many
as the longest move reaches.  A wave's borders are written as a table and joined by (pair, u, v) with the texts' blocks for
the next one, so a pair of any length is shared by as many tasks as a wave has tiles, a task holds one tile at a time,
and a lost task is worked out again from the last wave.  Work stays the product of the lengths; use it where one task
would take too long over a pair, and operators.scoring otherwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alignspark.operators.encoded import _log_sum
from alignspark.operators.kernels import Batch, _groups, features, of_classes, potentials
from alignspark.operators.relational import shared, written
from alignspark.operators.scoring import Parameters

BORDERS = "pair_id long, u int, v int, kind string, data binary"


def tile_weights(a: str, b: str, at: tuple[int, int], lengths: tuple[int, int], model: Parameters) -> np.ndarray:
    """Potentials of a tile's cells (I, J, rows of theta); at: where the tile begins, lengths: those of the whole pair."""
    batch = Batch.of([a], [b])
    planes, blocks = features(batch, model.spec)
    i, j = at[0] + np.arange(len(a))[:, None], at[1] + np.arange(len(b))[None, :]
    for k, name in enumerate(model.spec.planes):  # these look at the whole pair's ends
        if name == "start":
            planes[0, ..., k] = (i == 0) | (j == 0)
        elif name == "end":
            planes[0, ..., k] = (i == lengths[0] - 1) | (j == lengths[1] - 1)
    return potentials(planes, blocks, model.theta)[0]


def advance(weights: np.ndarray, model: Parameters, borders: dict[str, np.ndarray], first: bool, reach: tuple[int, int], best: bool) -> np.ndarray:
    """Log weights (rows above + I, columns to the left + J, states) of a tile whose borders are given."""
    machine, (above, left) = model.machine, reach
    size1, size2 = weights.shape[:2]
    states = machine.n_states
    alpha = np.full((above + size1, left + size2, states), -np.inf)
    if "top" in borders:
        alpha[:above, left:] = borders["top"].reshape(above, size2, states)
    if "left" in borders:
        alpha[above:, :left] = borders["left"].reshape(size1, left, states)
    if "corner" in borders:
        alpha[:above, :left] = borders["corner"].reshape(above, left, states)
    groups = _groups(machine)
    for d in range(size1 + size2 - 1):
        i = np.arange(max(0, d - size2 + 1), min(size1 - 1, d) + 1)
        j = d - i
        own = weights[i, j]
        come = np.full((len(groups), len(i), states), -np.inf)
        for g, ((di, dj), (s0, s1, t)) in enumerate(groups):
            come[g][:, s1] = alpha[above + i - di, left + j - dj][:, s0] + own[:, states + t] + own[:, s1]
        with np.errstate(divide="ignore"):
            here = come.max(0) if best else _log_sum(come)
        if first and d == 0:
            for s in machine.start_states:
                here[0, s] = own[0, s]
        alpha[above + i, left + j] = here
    return alpha


def class_log_weights(pairs: DataFrame, model: Parameters, tile: int = 1024, best: bool = False) -> DataFrame:
    """pair_id, weights: each class's log weight, classes sorted; null where a pair has no result.

    pairs: pair_id (unique), s1, s2 strings; tile: characters of a block, at least as long as the longest move.
    """
    spark, machine, spec = pairs.sparkSession, model.machine, model.spec
    if not machine.static or spec.real or spec.sparse or spec.handle_invalid != "keep":
        raise ValueError("tiles know static moves, features without a caller's functions, and characters that are left out")
    reach = tuple(max((d[k] for _, _, d in machine.transitions), default=0) for k in (0, 1))
    if tile < max(*reach, 1):
        raise ValueError(f"a tile of {tile} is shorter than a move")
    at = shared(spark, "tiles")
    sizes = pairs.select("pair_id", F.length("s1").alias("n1"), F.length("s2").alias("n2")).where("n1 > 0 AND n2 > 0")

    def blocks(column: str, number: str, text: str) -> DataFrame:
        cut = pairs.where(F.length(column) > 0).select("pair_id", column, F.explode(F.sequence(F.lit(0), F.floor((F.length(column) - 1) / tile).cast("int"))).alias(number))
        return cut.select("pair_id", number, F.substring(F.col(column), F.col(number) * tile + 1, F.lit(tile)).alias(text))

    ones, twos = written(blocks("s1", "u", "a"), f"{at}/one"), written(blocks("s2", "v", "b"), f"{at}/two")
    sizes = written(sizes, f"{at}/sizes")
    grid = sizes.select("pair_id", "n1", "n2", F.ceil(F.col("n1") / tile).cast("int").alias("tiles1"), F.ceil(F.col("n2") / tile).cast("int").alias("tiles2"))
    waves = grid.agg(F.max(F.col("tiles1") + F.col("tiles2") - 1)).first()[0] or 0
    names = [c.split()[0] for c in BORDERS.split(", ")]

    def run(batches):
        above, left = reach
        for part in batches:
            for row in part.to_pylist():
                u, v, a, b = row["u"], row["v"], row["a"], row["b"]
                borders = {x["kind"]: np.frombuffer(x["data"]) for x in row["borders"] or []}
                weights = tile_weights(a, b, (u * tile, v * tile), (row["n1"], row["n2"]), model)
                alpha = advance(weights, model, borders, u == v == 0, reach, best)
                last = u == row["tiles1"] - 1 and v == row["tiles2"] - 1
                bottom, right = alpha[alpha.shape[0] - above :, left:], alpha[above:, alpha.shape[1] - left :]
                out = [(u, v, "done", alpha[-1, -1])] if last else []
                out += [(u + 1, v, "top", bottom)] if u + 1 < row["tiles1"] else []
                out += [(u, v + 1, "left", right)] if v + 1 < row["tiles2"] else []
                out += [(u + 1, v + 1, "corner", alpha[alpha.shape[0] - above :, alpha.shape[1] - left :])] if u + 1 < row["tiles1"] and v + 1 < row["tiles2"] else []
                if out:
                    columns = [[row["pair_id"]] * len(out), *zip(*[(x, y, kind, np.ascontiguousarray(data).tobytes()) for x, y, kind, data in out], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary()), strict=True)], names)

    borders: list[DataFrame] = []
    for wave in range(waves):
        here = grid.select("*", F.explode(F.sequence(F.greatest(F.lit(0), F.lit(wave) - F.col("tiles2") + 1), F.least(F.lit(wave), F.col("tiles1") - 1))).alias("u")).where(F.lit(wave) <= F.col("tiles1") + F.col("tiles2") - 2)
        here = here.withColumn("v", F.lit(wave) - F.col("u")).join(ones, ["pair_id", "u"]).join(twos, ["pair_id", "v"])
        if borders:
            near = borders[-1] if len(borders) == 1 else borders[-1].unionByName(borders[-2])  # corners come from two waves before
            sides = near.where("kind <> 'done'").groupBy("pair_id", "u", "v").agg(F.collect_list(F.struct("kind", "data")).alias("borders"))
            here = here.join(sides, ["pair_id", "u", "v"], "left")
        else:
            here = here.withColumn("borders", F.lit(None).cast("array<struct<kind:string,data:binary>>"))
        here = here.select("pair_id", "u", "v", "n1", "n2", "tiles1", "tiles2", "a", "b", "borders").repartition(F.col("pair_id"), F.col("u"))
        borders.append(written(here.mapInArrow(run, BORDERS), f"{at}/wave-{wave}"))
    done = spark.createDataFrame([], BORDERS) if not borders else borders[0]
    for more in borders[1:]:
        done = done.unionByName(more)

    def ends(batches):
        for part in batches:
            z = of_classes(np.array([np.frombuffer(x) for x in part.column("data").to_pylist()]).reshape(-1, machine.n_states), machine)
            yield pa.RecordBatch.from_arrays([part.column("pair_id"), pa.array(list(z), pa.list_(pa.float64()))], ["pair_id", "weights"])

    found = done.where("kind = 'done'").select("pair_id", "data").mapInArrow(ends, "pair_id long, weights array<double>")
    return pairs.select("pair_id").join(found, "pair_id", "left")
