"""Training to convergence (M-12, M-13, M-15): limited-memory quasi-Newton over gradients that Spark adds up.

A round is one pass (rarely more, when the line search has to shorten the
step): every partition returns its summed loss and gradient, Spark adds the
partitions up, and the driver, which holds nothing but a few vectors of the
model's size, takes the next step (L-BFGS: two-loop recursion over the last
``memory`` steps, Armijo line search).  Rounds end when the gradient's largest
component falls below ``tolerance``.

After every round the state is appended to a table in the shared folder, so a
run whose driver was lost goes on from its last full round.  With a
validation table the ``keep`` best rounds by validation loss are kept in the
state as well, and the run stops after ``patience`` rounds without a better one.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MEMORY = 10
TOLERANCE = 1e-6
MAX_ROUNDS = 500
L2 = 1e-3


@dataclass
class State:
    """All that a run needs to go on."""

    round: int
    w: np.ndarray
    loss: float
    gradient: np.ndarray
    steps: list = field(default_factory=list)  # the last (step, change of gradient) pairs
    best: list = field(default_factory=list)  # (validation loss, round, weights), best first
    since_best: int = 0
    losses: list = field(default_factory=list)

    @property
    def gradient_norm(self) -> float:
        return float(np.abs(self.gradient).max(initial=0.0))


# ------------------------------------------------------------------ objectives
def _softmax(z: np.ndarray, y: list) -> tuple[float, np.ndarray]:
    """Loss and its derivative by the scores; ``y``: one class each."""
    z = z - z.max(axis=1, keepdims=True)
    p = np.exp(z)
    total = p.sum(axis=1, keepdims=True)
    rows, own = np.arange(len(z)), np.array(y, dtype=np.int64)
    loss = float((np.log(total[:, 0]) - z[rows, own]).sum())
    p /= total
    p[rows, own] -= 1.0
    return loss, p


def _logistic(z: np.ndarray, y: list) -> tuple[float, np.ndarray]:
    """The same for independent labels; ``y``: a list of label numbers each."""
    t = np.zeros_like(z)
    counts = np.fromiter((len(k or ()) for k in y), dtype=np.int64, count=len(y))
    t[np.repeat(np.arange(len(z)), counts), np.array([i for k in y for i in (k or ())], dtype=np.int64)] = 1.0
    loss = float((np.logaddexp(0.0, z) - t * z).sum())
    return loss, 1.0 / (1.0 + np.exp(-np.clip(z, -700, 700))) - t


KINDS = {"softmax": _softmax, "logistic": _logistic}


def batch_vectors(column: pa.Array) -> np.ndarray:
    """An Arrow column of equally long arrays as a matrix."""
    return np.array(column.flatten(), dtype=np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def linear_objective(data: DataFrame, kind: str, outputs: int, dims: int, l2: float = L2, vector_col: str = "x", target_col: str = "y") -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """Mean loss of a linear model with bias over ``data`` plus ``l2 / 2`` times the squared weights (not the biases).

    Weights are ``outputs x (dims + 1)`` numbers, the bias last.  ``data`` is
    read once per evaluation: pass a written table.
    """
    rows = data.select(F.col(vector_col).alias("x"), F.col(target_col).alias("y"))
    n = rows.count()

    def evaluate(w: np.ndarray) -> tuple[float, np.ndarray]:
        matrix = w.reshape(outputs, dims + 1)

        def partial(batches):
            loss, g = 0.0, np.zeros_like(matrix)
            for b in batches:
                if b.num_rows:
                    x = np.concatenate([batch_vectors(b.column(0)), np.ones((b.num_rows, 1))], axis=1)
                    part, by_score = KINDS[kind](x @ matrix.T, b.column(1).to_pylist())
                    loss, g = loss + part, g + by_score.T @ x
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, g.size)), pa.array(np.concatenate([[loss], g.ravel()]))], names=["at", "x"])

        got = rows.mapInArrow(partial, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
        total = np.zeros(matrix.size + 1)
        total[got.column("at").to_numpy() + 1] = got.column("x").to_numpy()
        weights = matrix.copy()
        weights[:, -1] = 0.0
        count = max(n, 1)
        return total[0] / count + l2 / 2 * float((weights**2).sum()), total[1:] / count + l2 * weights.ravel()

    return evaluate


# ------------------------------------------------------------------ state table
def save_state(spark: SparkSession, path: str, state: State) -> None:
    rows = spark.createDataFrame([(state.round, bytearray(pickle.dumps(state)))], "round int, state binary")
    rows.coalesce(1).write.mode("append").parquet(path)


def load_state(spark: SparkSession, path: str) -> State | None:
    """The last full round below ``path``; None when there is none."""
    try:
        found = spark.read.schema("round int, state binary").parquet(path).orderBy(F.desc("round")).first()
    except Exception as exc:  # no folder yet
        if "PATH_NOT_FOUND" in str(exc) or "Path does not exist" in str(exc):
            return None
        raise
    return pickle.loads(bytes(found["state"])) if found else None


# ------------------------------------------------------------------ the method
def _direction(gradient: np.ndarray, steps: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Two-loop recursion: minus the gradient times the inverse Hessian that the last steps suggest."""
    q, kept = gradient.copy(), []
    for s, y in reversed(steps):
        a = s @ q / (s @ y)
        q -= a * y
        kept.append(a)
    if steps:
        s, y = steps[-1]
        q *= (s @ y) / (y @ y)
    for (s, y), a in zip(steps, reversed(kept)):
        q += (a - y @ q / (s @ y)) * s
    return -q


def minimise(
    evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]],
    start: np.ndarray,
    tolerance: float = TOLERANCE,
    max_rounds: int = MAX_ROUNDS,
    memory: int = MEMORY,
    validate: Callable[[np.ndarray], float] | None = None,
    patience: int | None = None,
    keep: int = 2,
    spark: SparkSession | None = None,
    path: str | None = None,
) -> State:
    """Run until the gradient is small, ``max_rounds`` are done, or validation has not improved for ``patience`` rounds.

    With ``path`` the state of every round is written there, and a run finds and
    continues what an earlier one left.
    """
    state = load_state(spark, path) if path else None
    if state is None:
        loss, gradient = evaluate(start)
        state = State(0, start.copy(), loss, gradient, losses=[loss])
    while state.gradient_norm > tolerance and state.round < max_rounds and (patience is None or state.since_best < patience):
        direction = _direction(state.gradient, state.steps)
        slope = float(direction @ state.gradient)
        if slope >= 0:  # rounding has spoilt the recursion: start it anew
            state.steps, direction = [], -state.gradient
            slope = float(direction @ state.gradient)
        size = 1.0 if state.steps else min(1.0, 1.0 / max(float(np.abs(state.gradient).sum()), 1e-300))
        for _ in range(40):
            w = state.w + size * direction
            loss, gradient = evaluate(w)
            # near the optimum the losses agree to the last digits: there the slope decides
            if loss <= state.loss + 1e-4 * size * slope or (abs(loss - state.loss) <= 1e-13 * abs(state.loss) and abs(float(gradient @ direction)) <= abs(slope)):
                break
            size /= 2
        else:
            break  # no step lowers the loss: as good as it gets
        s, y = w - state.w, gradient - state.gradient
        steps = state.steps + [(s, y)] if s @ y > 1e-12 * np.linalg.norm(s) * np.linalg.norm(y) else list(state.steps)
        best, since = state.best, 0
        if validate is not None:
            found = sorted([*state.best, (validate(w), state.round + 1, w)], key=lambda b: b[:2])[:keep]
            since = 0 if found[0][1] == state.round + 1 else state.since_best + 1
            best = found
        state = State(state.round + 1, w, loss, gradient, steps[-memory:], best, since, [*state.losses, loss])
        if path:
            save_state(spark, path, state)
    return state


def train_linear(
    train: DataFrame,
    kind: str,
    outputs: int,
    l2: float = L2,
    validation: DataFrame | None = None,
    patience: int | None = None,
    tolerance: float = TOLERANCE,
    max_rounds: int = MAX_ROUNDS,
    path: str | None = None,
    vector_col: str = "x",
    target_col: str = "y",
) -> State:
    """M-12 (``softmax``, target: a class number) and M-13 (``logistic``, target: an array of label numbers).

    ``train`` and ``validation`` are read once a round: pass written tables.
    The weights are ``state.w.reshape(outputs, -1)``, the bias last; with a
    validation table ``state.best`` holds the two best rounds (M-15).
    """
    first = train.select(F.size(vector_col)).first()
    dims = first[0] if first else 0
    evaluate = linear_objective(train, kind, outputs, dims, l2, vector_col, target_col)
    validate = None
    if validation is not None:
        held_out = linear_objective(validation, kind, outputs, dims, 0.0, vector_col, target_col)
        validate = lambda w: held_out(w)[0]
    return minimise(evaluate, np.zeros(outputs * (dims + 1)), tolerance, max_rounds, validate=validate, patience=patience, spark=train.sparkSession, path=path)
