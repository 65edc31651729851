"""Numerical fits that need only sums over rows, and the perceptron, which works on a bounded sample.

`newton` asks for loss, gradient and Hessian at a point; where these sums are made is the caller's matter:
over arrays in a task, or as partial sums of a stored table, one job for each step.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def newton(sums: Callable, width: int, tol: float, steps: int) -> np.ndarray:
    """The minimum of a convex function, by Newton steps that are halved until they gain enough."""
    w = np.zeros(width)
    loss, gradient, hessian = sums(w)
    bound = tol * max(np.linalg.norm(gradient), 1e-300)
    for _ in range(steps):
        if np.linalg.norm(gradient) <= bound:
            break
        step, size = np.linalg.lstsq(hessian, -gradient, rcond=None)[0], 1.0
        while True:
            after = sums(w + size * step)
            if after[0] <= loss + 1e-4 * size * (gradient @ step) or size < 1e-6:
                break
            size /= 2
        if after[0] > loss:
            break
        w = w + size * step
        loss, gradient, hessian = after
    return w


def squared_hinge(x: np.ndarray, sign: np.ndarray, weight: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Sums over rows of weight * max(0, 1 - sign * margin) ** 2; `w` ends with the intercept."""
    lack = 1 - sign * (x @ w[:-1] + w[-1])
    on = lack > 0
    x, lack, sign, weight = np.column_stack([x[on], np.ones(on.sum())]), lack[on], sign[on], weight[on]
    return float(weight @ lack ** 2), -2 * x.T @ (weight * sign * lack), 2 * (x.T * weight) @ x


def with_penalty(sums, w: np.ndarray, c: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Half the squared norm, intercept included, and c times the sums."""
    loss, gradient, hessian = sums
    return 0.5 * float(w @ w) + c * loss, w + c * gradient, np.eye(len(w)) + c * hessian


def logistic(margin: np.ndarray, target: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Sums over rows of the cross entropy of `target` in [0, 1] and the logistic of w[0] * margin + w[1]."""
    z = w[0] * margin + w[1]
    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    x = np.column_stack([margin, np.ones(len(margin))])
    return float(np.sum(np.logaddexp(0, z) - target * z)), x.T @ (p - target), (x.T * (p * (1 - p))) @ x


def platt_targets(hit: np.ndarray, hits: int, misses: int) -> np.ndarray:
    """Smoothed 1 and 0, so that a calibration of separable margins stays finite."""
    return np.where(hit, (hits + 1.0) / (hits + 2.0), 1.0 / (misses + 2.0))


# The perceptron ----------------------------------------------------------------------------------

def forward(layers, x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(inputs of each layer, probabilities): ReLU inside; a logistic unit for two classes, else softmax."""
    seen = [x]
    for w, b in layers[:-1]:
        seen.append(np.maximum(seen[-1] @ w + b, 0.0))
    w, b = layers[-1]
    z = seen[-1] @ w + b
    if z.shape[1] == 1:
        one = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        return seen, np.hstack([1 - one, one])
    e = np.exp(z - z.max(1, keepdims=True))
    return seen, e / e.sum(1, keepdims=True)


def loss_and_gradients(layers, x: np.ndarray, y: np.ndarray, l2: float):
    """Mean cross entropy and half the squared weights times l2 / rows, and its gradients."""
    seen, p = forward(layers, x)
    n = len(x)
    loss = -np.log(np.maximum(p[np.arange(n), y], 1e-300)).mean() + 0.5 * l2 * sum((w ** 2).sum() for w, _ in layers) / n
    delta = p.copy()
    delta[np.arange(n), y] -= 1
    delta = delta[:, 1:] if layers[-1][0].shape[1] == 1 else delta
    gradients = []
    for i in range(len(layers) - 1, -1, -1):
        w, _ = layers[i]
        gradients.append(((seen[i].T @ delta + l2 * w) / n, delta.sum(0) / n))
        if i:
            delta = (delta @ w.T) * (seen[i] > 0)
    return loss, gradients[::-1]


def fit_perceptron(x: np.ndarray, y: np.ndarray, classes: int, hidden, batch: int, epochs: int, rate: float, l2: float, patience: int,
                   held: float, seed: int, tol: float = 1e-4) -> tuple[list, list[float]]:
    """(layers of the best epoch, held-out accuracy after each epoch) by mini-batch Adam.

    A stratified part of the rows is held out; after `patience` epochs without a gain of `tol` the fit ends.
    With too few rows to hold any out, the training loss takes the accuracy's place."""
    draw = np.random.default_rng(seed)
    test = np.zeros(len(y), bool)
    for c in np.unique(y):
        own = draw.permutation(np.flatnonzero(y == c))
        test[own[:int(round(held * len(own)))]] = True
    if not test.any() or test.all():
        test[:] = False
    train_x, train_y, test_x, test_y = x[~test], y[~test], x[test], y[test]
    sizes = [x.shape[1], *hidden, 1 if classes == 2 else classes]
    layers = []
    for i, (a, b) in enumerate(zip(sizes[:-1], sizes[1:])):
        bound = np.sqrt((6.0 if i < len(sizes) - 2 else 2.0) / (a + b))
        layers.append((draw.uniform(-bound, bound, (a, b)), draw.uniform(-bound, bound, b)))
    flat = [v for layer in layers for v in layer]
    first, second, t = [np.zeros_like(v) for v in flat], [np.zeros_like(v) for v in flat], 0
    best, best_score, waited, scores = [v.copy() for v in flat], -np.inf, 0, []
    for _ in range(epochs):
        order, total = draw.permutation(len(train_y)), 0.0
        for lo in range(0, len(order), batch):
            some = order[lo:lo + batch]
            loss, gradients = loss_and_gradients(list(zip(flat[::2], flat[1::2])), train_x[some], train_y[some], l2)
            total += loss * len(some)
            t += 1
            for i, g in enumerate(v for layer in gradients for v in layer):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                flat[i] = flat[i] - rate * np.sqrt(1 - 0.999 ** t) / (1 - 0.9 ** t) * first[i] / (np.sqrt(second[i]) + 1e-8)
        now = list(zip(flat[::2], flat[1::2]))
        score = float((forward(now, test_x)[1].argmax(1) == test_y).mean()) if len(test_y) else -total / max(1, len(order))
        scores.append(score)
        waited = 0 if score > best_score + tol else waited + 1
        if score > best_score:
            best, best_score = [v.copy() for v in flat], score
        if waited >= patience:
            break
    return list(zip(best[::2], best[1::2])), scores
