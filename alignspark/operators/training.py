"""Training: pairs are encoded once, losses and gradients are summed over their partitions, the optimiser runs at the driver."""

from __future__ import annotations

import logging
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alignspark.operators import encoded, kernels, lbfgs
from alignspark.operators.scoring import Parameters, balanced, zeros
from alignspark.spec import FeatureSpec, StateMachine

log = logging.getLogger(__name__)

#: Gradients that are added in one place; classes that a label column may have.
FAN, MOST_CLASSES = 64, 1000


def counted(labelled: DataFrame, parts: int) -> DataFrame:
    """s1, s2, label and times: equal pairs once, with how often they occur, dealt by cost to parts; null ones go."""
    rows = labelled.where("s1 IS NOT NULL AND s2 IS NOT NULL AND label IS NOT NULL").groupBy("s1", "s2", "label").agg(F.count(F.lit(1)).cast("double").alias("times"))
    return balanced(rows, parts)


def encoded_batches(pairs: DataFrame, spec: FeatureSpec, machine: StateMachine) -> DataFrame:
    """Pairs (s1, s2, label, times) as rows of encoded batches, one narrow pass: what each evaluation needs, worked out once."""

    def run(batches):
        for part in batches:
            first, second, labels, times = (part.column(c).to_pylist() for c in ("s1", "s2", "label", "times"))
            for batch in encoded.encode(first, second, labels, times, spec, machine):
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in batch.to_row()], list(encoded.ARRAYS))

    return pairs.select("s1", "s2", "label", "times").mapInArrow(run, encoded.SCHEMA)


def summed(batches: DataFrame, model: Parameters, parts: int | None = None) -> tuple[float, np.ndarray]:
    """Loss and gradient over encoded batches, or, where moves are a caller's functions, over pairs (s1, s2, label, times).

    Each partition gives one row; theta goes out in a broadcast.  Unless batches are known to have few parts, rows are
    first added on executors, FAN at a time and then again.  Rows are added in the partitions' order, so the same
    partitioning gives the same bits.
    """
    sent = batches.sparkSession.sparkContext.broadcast(model.theta)
    spec, machine = model.spec, model.machine

    def whole(part: pa.RecordBatch) -> tuple[float, np.ndarray]:
        first, second, labels, times = (part.column(c).to_pylist() for c in ("s1", "s2", "label", "times"))
        own: tuple[list, list, list] = ([], [], [])  # pairs are repeated as often as they occur
        for row, n in zip(zip(first, second, labels, strict=True), times, strict=True):
            for column, value in zip(own, row, strict=True):
                column += [value] * int(n)
        return kernels.loss_gradient(*own, spec, machine, sent.value)

    def run(parts_):
        from pyspark import TaskContext

        total, gradient = 0.0, np.zeros_like(sent.value)
        for part in parts_:
            if machine.static:
                for row in zip(*part.columns, strict=True):
                    value, own = encoded.loss_gradient(encoded.Encoded.from_row(row), spec, machine, sent.value)
                    total, gradient = total + value, gradient + own
            else:
                value, own = whole(part)
                total, gradient = total + value, gradient + own
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total]), pa.array([gradient.ravel()], pa.list_(pa.float64()))], ["part", "value", "gradient"])

    def add(group: pa.Table) -> pa.Table:
        group = group.sort_by("part")
        total = np.sum([np.asarray(g) for g in group["gradient"].to_pylist()], 0)
        return pa.table([group["part"].slice(0, 1), pa.array([float(np.sum(group["value"].to_numpy()))]), pa.array([total], pa.list_(pa.float64()))], names=["part", "value", "gradient"])

    schema = "part long, value double, gradient array<double>"
    rows = batches.mapInArrow(run, schema)
    if parts is None or parts > FAN:
        for level in (FAN, FAN * FAN):
            rows = rows.groupBy(F.floor(F.col("part") / level)).applyInArrow(add, schema)
    rows = rows.toArrow().sort_by("part")
    sent.destroy()
    value = float(np.sum(rows["value"].to_numpy())) if len(rows) else 0.0
    gradient = np.zeros(model.theta.size)
    for g in rows["gradient"].to_pylist():
        gradient += np.array(g)
    return value, gradient.reshape(model.theta.shape)


def log_likelihood(labelled: DataFrame, model: Parameters, parts: int | None = None) -> tuple[float, np.ndarray]:
    """Sum of log p(label) over labelled pairs (s1, s2, label) and its gradient."""
    pairs = labelled.select("s1", "s2", "label", F.lit(1.0).alias("times")).where("s1 IS NOT NULL AND s2 IS NOT NULL AND label IS NOT NULL")
    return summed(encoded_batches(pairs, model.spec, model.machine) if model.machine.static else pairs, model, parts)


def pair_slopes(labelled: DataFrame, model: Parameters, direction: np.ndarray) -> DataFrame:
    """pair_id, ll, slope: each labelled pair's log p(label), and its derivative along a direction of the parameters.

    Whole texts, in memory that grows with a root of their lattices; pairs of similar lengths go together.  Pairs without a
    result give no row.
    """
    spec, machine, theta = model.spec, model.machine, model.theta
    if not machine.static:
        raise ValueError("moves that a function decides have no encoded form")

    def run(batches):
        for part in batches:
            ids, first, second, labels = (part.column(c).to_pylist() for c in ("pair_id", "s1", "s2", "label"))
            for rows, batch in encoded.encode_rows(first, second, labels, [1.0] * len(ids), spec, machine):
                values, slopes = encoded.loss_slopes(batch, spec, machine, theta, direction)
                yield pa.RecordBatch.from_arrays([pa.array([ids[r] for r in rows], pa.int64()), pa.array(values), pa.array(slopes)], ["pair_id", "ll", "slope"])

    good = labelled.where("s1 IS NOT NULL AND s2 IS NOT NULL AND label IS NOT NULL")
    return good.select("pair_id", "s1", "s2", "label").mapInArrow(run, "pair_id long, ll double, slope double")


def penalised(value: float, gradient: np.ndarray, theta: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """Less l2 times the squares of theta but its very first number."""
    free = theta.copy()
    free.flat[0] = 0.0
    return value - l2 * float((free * free).sum()), gradient - 2 * l2 * free


def fit(labelled: DataFrame, spec: FeatureSpec, l2: float = 0.0, machine: StateMachine | None = None, optimizer: Callable | None = None, optimizer_kwargs: dict | None = None, tolerance: float = 1e-5, iterations: int = 200, verbosity: int = 0) -> tuple[Parameters, list[float]]:
    """Parameters that maximise the penalised likelihood of labelled pairs (s1, s2, label), and the objective's history.

    optimizer(objective, start, **optimizer_kwargs) gives the best point as its first result; without one, L-BFGS.
    Equal pairs are counted, dealt by cost to the session's shuffle partitions, or to one for each core if these are
    more, encoded once and held for the iterations; classes are the labels, sorted.
    """
    spark = labelled.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    if machine is None:
        found = labelled.select("label").where("label IS NOT NULL").distinct().limit(MOST_CLASSES + 1).collect()
        if len(found) > MOST_CLASSES:
            raise ValueError(f"label has more than {MOST_CLASSES} values")
        machine = StateMachine.default([r[0] for r in found])
    machine = StateMachine.of(machine)
    pairs = counted(labelled.select("s1", "s2", "label"), parts)
    batches = (encoded_batches(pairs, spec, machine) if machine.static else pairs).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        start, history = zeros(spec, machine), []

        def objective(flat: np.ndarray) -> tuple[float, np.ndarray]:
            theta = np.asarray(flat, float).reshape(start.shape)
            value, gradient = penalised(*summed(batches, Parameters(spec, machine, theta), parts), theta, l2)
            history.append(value)
            if verbosity and len(history) % verbosity == 0:
                log.info("evaluation %d: %.6f, gradient %.3g", len(history), value, np.abs(gradient).max())
            return -value, -gradient.ravel()

        if optimizer:
            best = np.asarray(optimizer(objective, start.ravel(), **(optimizer_kwargs or {}))[0])
        else:
            best = lbfgs.minimise(objective, start.ravel(), tolerance=tolerance, most=iterations).x
        return Parameters(spec, machine, best.reshape(start.shape)), history
    finally:
        batches.unpersist()


def accuracy(scored: DataFrame) -> float:
    """Share of rows whose prediction is their label."""
    return scored.agg(F.avg((F.col("prediction") == F.col("label").cast("string")).cast("double"))).first()[0]
