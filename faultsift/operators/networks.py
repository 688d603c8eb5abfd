"""Networks with one hidden layer, trained side by side.

Rows are dealt evenly to tasks and kept there as blocks of numbers, once for all networks and with a weight
instead of copies. A step of every network that is still in training is one pass over the blocks; only
sums of losses and gradients reach the driver, which takes the steps (L-BFGS, ten corrections).
"""

from __future__ import annotations

import math
from collections.abc import Generator, Iterator

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row

#: Rows whose hidden layer is held at a time.
BLOCK_ROWS = 512
CORRECTIONS = 10
#: Losses a loss is compared with.
LOSSES = 20
SUFFICIENT, CURVATURE, TRIALS = 1e-4, 0.9, 10


def trained(
    rows: DataFrame, scales: dict[int, tuple[np.ndarray, np.ndarray]], layers: tuple[int, int, int], start: np.ndarray,
    iterations: int, tolerance: float,
) -> dict[int, np.ndarray]:
    """Weights of a network per key of `scales`, laid out as Spark ML does.

    `rows` has (features array<double>, label double, weight double, fold int); the network of a key sees all rows but
    those of that fold, less the first and times the second of its `scales`. Training ends after `iterations`, or
    where the loss is within `tolerance` of the first loss to the largest of the last twenty.
    """
    context = rows.sparkSession.sparkContext
    even = rows.select("features", "label", "weight", "fold").repartition(max(context.defaultParallelism, rows.rdd.getNumPartitions()))
    blocks = even.sortWithinPartitions("fold").rdd.mapPartitions(_blocks).persist(StorageLevel.MEMORY_AND_DISK)
    networks = {key: descent(start, iterations, tolerance) for key in scales}
    points, out = {key: next(network) for key, network in networks.items()}, {}
    try:
        while points:
            asked = context.broadcast({key: (point, *scales[key]) for key, point in points.items()})
            sums = blocks.mapPartitions(lambda held: [_sums(held, asked.value, layers)]).treeReduce(np.add)  # noqa: B023
            asked.destroy()
            following = {}
            for key, (weight, loss, *gradient) in zip(points, sums):
                try:
                    following[key] = networks[key].send((loss / weight, np.array(gradient) / weight))
                except StopIteration as end:
                    out[key] = end.value
            points = following
    finally:
        blocks.unpersist()
    return out


def _blocks(rows: Iterator[Row]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(fold, features, labels, weights) of rows in a row that have the same fold."""
    held, fold = [], None
    for row in rows:
        if held and (row.fold != fold or len(held) == BLOCK_ROWS):
            yield _block(fold, held)
            held = []
        fold = row.fold
        held.append(row)
    if held:
        yield _block(fold, held)


def _block(fold: int, rows: list[Row]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    features = np.array([r.features for r in rows], float)
    return fold, features, np.array([r.label for r in rows], int), np.array([r.weight for r in rows], float)


def _sums(blocks, asked: dict[int, tuple[np.ndarray, ...]], layers: tuple[int, int, int]) -> np.ndarray:
    """Sums of weights, losses and gradients over the blocks, a line per network."""
    width = len(next(iter(asked.values()))[0])
    out = np.zeros((len(asked), width + 2))
    for fold, features, labels, weights in blocks:
        for line, (key, (point, mean, scale)) in zip(out, asked.items()):
            if fold != key:
                loss, gradient = loss_and_gradient(point, (features - mean) * scale, labels, weights, layers)
                line[0] += weights.sum()
                line[1] += loss
                line[2:] += gradient
    return out


def loss_and_gradient(
    point: np.ndarray, x: np.ndarray, labels: np.ndarray, weights: np.ndarray, layers: tuple[int, int, int]
) -> tuple[float, np.ndarray]:
    """Cross entropy of a sigmoid layer and a softmax layer over weighted rows, and its gradient."""
    inputs, hidden, outputs = layers
    ends = np.cumsum([hidden * inputs, hidden, outputs * hidden])
    first, first_bias, second, second_bias = np.split(point, ends)
    first, second = first.reshape(inputs, hidden), second.reshape(hidden, outputs)
    with np.errstate(over="ignore", divide="ignore"):
        inner = 1.0 / (1.0 + np.exp(-(x @ first + first_bias)))
        above = inner @ second + second_bias
        odds = np.exp(above - above.max(axis=1, keepdims=True))
        share = odds / odds.sum(axis=1, keepdims=True)
        own = (np.arange(len(labels)), labels)
        loss = -float(weights @ np.log(share[own]))
    share[own] -= 1.0
    share *= weights[:, None]
    back = (share @ second.T) * (inner * (1.0 - inner))
    parts = (x.T @ back).ravel(), back.sum(axis=0), (inner.T @ share).ravel(), share.sum(axis=0)
    return loss, np.concatenate(parts)


def descent(x: np.ndarray, iterations: int, tolerance: float) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Yields points, is sent (loss, gradient) of each and returns the last point of L-BFGS."""
    value, gradient = yield x
    first, values, pairs, done, failed = value, [math.inf], [], 0, False
    while (
        done < iterations
        and not abs(value - max(values)) <= tolerance * first
        and np.linalg.norm(gradient) > max(tolerance * abs(value), 1e-8)
    ):
        way = _direction(gradient, pairs)
        found = yield from _searched(x, value, gradient, way, 1.0 if done else 1.0 / np.linalg.norm(way))
        if found is None:
            if failed:
                break
            failed, pairs = True, []
            continue
        pairs = [(found[0] - x, found[2] - gradient), *pairs][:CORRECTIONS]
        x, value, gradient = found
        values = [*values, value][-LOSSES:]
        done, failed = done + 1, False
    return x


def _direction(gradient: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Minus the gradient times the inverse Hessian that the last steps and changes of the gradient tell."""
    way, parts = gradient.copy(), []
    for step, change in pairs:
        part = (step @ way) / (step @ change)
        way -= part * change
        parts.append(part)
    if pairs:
        step, change = pairs[0]
        way *= (step @ change) / (change @ change)
    for (step, change), part in zip(reversed(pairs), reversed(parts)):
        way += (part - (change @ way) / (step @ change)) * step
    return -way


def _searched(x: np.ndarray, value: float, gradient: np.ndarray, way: np.ndarray, t: float):
    """(point, loss, gradient) along `way` by the strong Wolfe conditions, None where none is found."""
    slope = float(gradient @ way)
    if not slope <= 0:
        return None
    low, enough = (0.0, slope, value), lambda t: value + SUFFICIENT * t * slope
    high = None
    for i in range(TRIALS):
        point = x + way * t
        new_value, new_gradient = yield point
        now = (t, float(new_gradient @ way), new_value)
        if not math.isfinite(new_value):
            t /= 2.0
            continue
        if new_value > enough(t) or (i > 0 and new_value >= low[2]):
            high = now
            break
        if abs(now[1]) <= CURVATURE * abs(slope):
            return _long_enough(t, gradient, point, new_value, new_gradient)
        if now[1] >= 0:
            low, high = now, low
            break
        low, t = now, t * 1.5
    if high is None:
        return None
    for _ in range(TRIALS):
        t = _between(*sorted((low, high), key=lambda place: place[0]))
        point = x + way * t
        new_value, new_gradient = yield point
        now = (t, float(new_gradient @ way), new_value)
        if new_value > enough(t) or new_value >= low[2]:
            high = now
            continue
        if abs(now[1]) <= CURVATURE * abs(slope):
            return _long_enough(t, gradient, point, new_value, new_gradient)
        if now[1] * (high[0] - low[0]) >= 0:
            high = low
        low = now
    return None


def _long_enough(t: float, gradient: np.ndarray, *found):
    return None if t * np.linalg.norm(gradient) < 1e-10 else found


def _between(left: tuple[float, float, float], right: tuple[float, float, float]) -> float:
    """The least place of the cubic through two places (t, slope, loss), not too near to either."""
    (a, a_slope, a_value), (b, b_slope, b_value) = left, right
    d = a_slope + b_slope - 3 * (a_value - b_value) / (a - b)
    under = d * d - a_slope * b_slope
    root = math.sqrt(under) if under >= 0 else math.nan
    below = b_slope - a_slope + 2 * root
    t = b - (b - a) * (b_slope + root - d) / below if below else math.nan
    low, high = a + 0.1 * (b - a), a + 0.9 * (b - a)
    return (low + high) / 2 if math.isnan(t) else min(max(t, low), high)
