"""Mini-batch training of a small network on chips, driven batch by batch.

The network sees a pixel and its eight neighbours (outside the chip is 0): one hidden layer, two classes.
The loss is the cross-entropy, averaged over a batch's valid pixels. A batch's gradient is a sum over
its chips, so every task adds up its own, some groups of tasks add up theirs, and the driver gets a few
rows. Adam keeps its state on the driver. After each epoch the validation chips are scored; the
parameters, Adam's state and the history are written, and a run that was interrupted goes on from there.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INPUTS = 9
#: Rows of partial sums that reach the driver.
GROUPS = 8


@dataclass(frozen=True)
class Settings:
    """How to train. A batch has about ``batch`` chips, more where an epoch would have more than ``most_batches`` of them: each is a round through the driver."""

    epochs: int = 3
    batch: int = 64
    most_batches: int = 20
    hidden: int = 8
    rate: float = 0.02
    seed: int = 0


@dataclass
class State:
    """Where a training stands: parameters, Adam's moments and step, and the epochs so far."""

    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    step: int = 0
    history: list[dict] = field(default_factory=list)
    best: dict = field(default_factory=lambda: {"epoch": -1, "val_iou": -1.0})
    best_weights: np.ndarray | None = None


def start(settings: Settings) -> State:
    n = (INPUTS + 1) * settings.hidden + (settings.hidden + 1) * 2
    w = np.random.default_rng(settings.seed).standard_normal(n) * 0.3
    return State(w, np.zeros(n), np.zeros(n))


def patches(p: np.ndarray, side: int) -> np.ndarray:
    """(chips * pixels, 9) of maps (chips, pixels): each pixel's neighbourhood by rows."""
    padded = np.pad(p.reshape(-1, side, side), ((0, 0), (1, 1), (1, 1)))
    return np.stack([padded[:, dr : dr + side, dc : dc + side] for dr in range(3) for dc in range(3)], -1).reshape(-1, INPUTS)


def _parts(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = (len(w) - 2) // (INPUTS + 3)
    cut = (INPUTS + 1) * hidden
    return w[:cut].reshape(INPUTS + 1, hidden), w[cut:].reshape(hidden + 1, 2)


def forward(w: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hidden values, probabilities of the two classes) of pixels."""
    below, above = _parts(w)
    h = np.tanh(x @ below[:-1] + below[-1])
    odds = h @ above[:-1] + above[-1]
    odds = np.exp(odds - odds.max(1, keepdims=True))
    return h, odds / odds.sum(1, keepdims=True)


def gradient(w: np.ndarray, p: np.ndarray, target: np.ndarray, valid: np.ndarray, side: int) -> np.ndarray:
    """Sums over valid pixels: the gradient's numerator, then the loss, then how many there are."""
    x, t, v = patches(p, side), target.ravel().astype(int), valid.ravel().astype(float)
    h, share = forward(w, x)
    loss = -np.log(np.maximum(share[np.arange(len(t)), t], 1e-300)) * v
    error = share.copy()
    error[np.arange(len(t)), t] -= 1
    error *= v[:, None]
    back = error @ _parts(w)[1][:-1].T * (1 - h * h)
    sums = [x.T @ back, back.sum(0)[None], h.T @ error, error.sum(0)[None]]
    return np.concatenate([*[s.ravel() for s in sums], [loss.sum(), v.sum()]])


def adam(state: State, g: np.ndarray, rate: float) -> None:
    state.step += 1
    state.first = 0.9 * state.first + 0.1 * g
    state.second = 0.999 * state.second + 0.001 * g * g
    state.weights = state.weights - rate * (state.first / (1 - 0.9**state.step)) / (np.sqrt(state.second / (1 - 0.999**state.step)) + 1e-8)


def _matrices(batch: pa.RecordBatch) -> list[np.ndarray]:
    flat = batch.column("px").flatten()
    return [flat.field(c).to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) for c in ("p", "target", "valid")]


def batch_sums(chips: DataFrame, weights: np.ndarray, side: int) -> np.ndarray:
    """The sums of ``gradient`` over chips (px), added up in tasks, then in groups of tasks, then here."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(weights) + 2)
        for b in batches:
            if b.num_rows:
                total += gradient(weights, *_matrices(b), side)
        yield pa.RecordBatch.from_pydict({"s": [total.tolist()]})

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(weights) + 2)
        for b in batches:
            total += b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).sum(0)
        yield pa.RecordBatch.from_pydict({"s": [total.tolist()]})

    parts = chips.select("px").mapInArrow(partial, "s array<double>")
    few = parts.coalesce(GROUPS).mapInArrow(group, "s array<double>")
    return np.sum([r["s"] for r in few.collect()] or [np.zeros(len(weights) + 2)], axis=0)


def predict(chips: DataFrame, weights: np.ndarray, side: int) -> DataFrame:
    """``chips`` with ``predicted``, 1 for each pixel where class one is the likelier (array<int>)."""

    @F.arrow_udf("array<int>")
    def run(px: pa.Array) -> pa.Array:
        p = px.flatten().field("p").to_numpy(zero_copy_only=False).reshape(len(px), -1)
        likely = (forward(weights, patches(p, side))[1][:, 1] > 0.5).astype(np.int32).reshape(p.shape)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(px) + 1, dtype=np.int32) * p.shape[1]), pa.array(likely.ravel()))

    return chips.withColumn("predicted", run(F.col("px")))


def probabilities(chips: DataFrame, weights: np.ndarray, side: int) -> DataFrame:
    """``chips`` whose pixels' ``p`` is the probability of class one."""

    @F.arrow_udf("array<double>")
    def run(px: pa.Array) -> pa.Array:
        p = px.flatten().field("p").to_numpy(zero_copy_only=False).reshape(len(px), -1)
        share = forward(weights, patches(p, side))[1][:, 1]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(px) + 1, dtype=np.int32) * p.shape[1]), pa.array(share))

    return chips.withColumn("px", F.zip_with("px", run(F.col("px")), lambda x, y: x.withField("p", y)))


def scores(chips: DataFrame, weights: np.ndarray, side: int) -> tuple[float, float] | None:
    """The means over chips of IoU and F1 among valid pixels; None without chips."""
    seen = F.zip_with("px", "predicted", lambda x, y: F.when(x["valid"] == 1, x["target"] * 2 + y))
    n = lambda k: F.size(F.filter(seen, lambda s: s == k))
    counted = predict(chips, weights, side).select(n(3).alias("tp"), n(1).alias("fp"), n(2).alias("fn"))
    some = F.col("tp") + F.col("fp") + F.col("fn")
    iou = F.when(some == 0, 1.0).otherwise(F.col("tp") / some)
    f1 = F.when(some == 0, 1.0).otherwise(2 * F.col("tp") / (some + F.col("tp")))
    row = counted.agg(F.avg(iou).alias("iou"), F.avg(f1).alias("f1")).first()
    return None if row["iou"] is None else (row["iou"], row["f1"])


def _told(state: State) -> str:
    known = {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in state.__dict__.items()}
    return json.dumps(known)


def load(spark: SparkSession, path: str) -> State | None:
    """The last epoch's state of a run's folder; None where there is none."""
    try:
        row = spark.read.schema("epoch int, state string").parquet(f"{path}/epochs").orderBy(F.desc("epoch")).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if row is None:
        return None
    known = json.loads(row["state"])
    for k in ("weights", "first", "second", "best_weights"):
        known[k] = None if known[k] is None else np.array(known[k])
    return State(**known)


def train(chips: DataFrame, validation: DataFrame | None, side: int, path: str, settings: Settings = Settings(), key: str = "vec_id") -> State:  # noqa: B008
    """Trains on chips (key, px) for the settings' epochs and returns the state; ``path`` is the run's folder, which all executors see.

    A batch is what a hash of key, seed and epoch makes of it. Batches of an
    epoch are written side by side, so a batch reads its own chips only. An epoch is better if its
    validation IoU is larger than all before; without validation the last epoch is the best. A folder
    with epochs of an earlier run is gone on with; to begin anew takes another folder.
    """
    spark = chips.sparkSession
    state = load(spark, path) or start(settings)
    batches = max(1, min(settings.most_batches, math.ceil(chips.count() / settings.batch)))
    for epoch in range(len(state.history) + 1, settings.epochs + 1):
        own = F.pmod(F.xxhash64(F.col(key), F.lit(settings.seed), F.lit(epoch)), F.lit(batches)).cast("int")
        dealt = f"{path}/batches"
        chips.select("px", own.alias("batch")).repartition("batch").write.mode("overwrite").partitionBy("batch").parquet(dealt)
        losses = []
        for b in range(batches):
            rows = spark.read.schema(chips.select("px", F.lit(0).alias("batch")).schema).option("basePath", dealt).parquet(dealt).where(F.col("batch") == b)
            sums = batch_sums(rows, state.weights, side)
            if sums[-1] > 0:
                adam(state, sums[:-2] / sums[-1], settings.rate)
                losses.append(float(sums[-2] / sums[-1]))
        found = scores(validation, state.weights, side) if validation is not None else None
        state.history.append({"epoch": epoch, "train_loss_mean": sum(losses) / len(losses) if losses else float("nan"), "val_iou": found and found[0], "val_f1": found and found[1]})
        if found is None or found[0] > state.best["val_iou"]:
            state.best = {"epoch": epoch, "val_iou": float(found[0] if found else epoch)}
            state.best_weights = state.weights.copy()
        spark.createDataFrame([(epoch, _told(state))], "epoch int, state string").coalesce(1).write.mode("append").parquet(f"{path}/epochs")
    return state


def history(spark: SparkSession, state: State) -> DataFrame:
    """(epoch, train_loss_mean, val_iou, val_f1, best) of a training."""
    rows = [(h["epoch"], h["train_loss_mean"], h["val_iou"], h["val_f1"], h["epoch"] == state.best["epoch"]) for h in state.history]
    return spark.createDataFrame(rows, "epoch int, train_loss_mean double, val_iou double, val_f1 double, best boolean")
