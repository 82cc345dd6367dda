"""Arithmetic of the sequence regressor on one batch, in numpy.

Stacked LSTM layers, dropout between them, and a linear layer on the last hidden state.
Inside, arrays are (step, unit, sample), so that the gates of one step are contiguous, and
keep the dtype of the weights.
"""

from __future__ import annotations

import numpy as np

Weights = dict[str, np.ndarray]

# Order of the four gates in the stacked weights, and the names of the arrays.
GATES = ("input", "forget", "cell", "output")
LAYER_NAMES = ("lstm.weight_ih_l{}", "lstm.weight_hh_l{}", "lstm.bias_ih_l{}", "lstm.bias_hh_l{}")
HEAD_NAMES = ("fc.weight", "fc.bias")


_kept: dict[tuple, np.ndarray] = {}


def _workspace(use: str, layer: int, shape: tuple[int, ...], dtype: np.dtype) -> np.ndarray:
    """An array with undefined content that the next batch of the same shape gets again.

    A batch needs several megabytes; taking them anew each time costs as much as the sums.
    """
    key = use, layer, dtype
    if key not in _kept or _kept[key].shape != shape:
        _kept[key] = np.empty(shape, dtype)
    return _kept[key]


def weight_shapes(n_features: int, hidden: int, layers: int) -> dict[str, tuple[int, ...]]:
    gates = len(GATES) * hidden
    shapes: dict[str, tuple[int, ...]] = {}
    for layer in range(layers):
        dims = ((gates, n_features if layer == 0 else hidden), (gates, hidden), (gates,), (gates,))
        shapes.update((name.format(layer), dim) for name, dim in zip(LAYER_NAMES, dims))
    shapes.update(zip(HEAD_NAMES, ((1, hidden), (1,))))
    return shapes


def initial_weights(n_features: int, hidden: int, layers: int, seed: int) -> Weights:
    """Uniform within one over the root of the hidden size."""
    rng = np.random.default_rng(seed)
    bound = 1 / np.sqrt(hidden)
    return {name: rng.uniform(-bound, bound, shape).astype(np.float32)
            for name, shape in weight_shapes(n_features, hidden, layers).items()}


def _layer(weights: Weights, layer: int) -> list[np.ndarray]:
    return [weights[name.format(layer)] for name in LAYER_NAMES]


def _n_layers(weights: Weights) -> int:
    return sum(name.startswith("lstm.weight_hh_l") for name in weights)


def _inward(x: np.ndarray, dtype: np.dtype) -> np.ndarray:
    """From (sample, step, feature) to (step, feature, sample)."""
    return np.ascontiguousarray(x.transpose(1, 2, 0), dtype=dtype)


def _run_layer(x: np.ndarray, params: list[np.ndarray], layer: int) -> tuple[np.ndarray, ...]:
    """Joined inputs, gates, cell states and squashed cell states of one layer over all steps.

    What goes into step ``t`` is its input on top of the previous hidden state, so the hidden
    states are the lower part of the joined inputs from the second step on.
    """
    w_in, w_rec, b_in, b_rec = params
    steps, n_in, batch = x.shape
    hidden = w_rec.shape[1]
    # tanh(v) = 2 sigmoid(2v) - 1, so doubling the cell gate lets one sigmoid serve all gates.
    double = np.ones((len(GATES), hidden, 1), x.dtype)
    double[GATES.index("cell")] = 2
    double = double.reshape(-1, 1)
    weight = np.hstack((w_in, w_rec)) * -double
    bias = (b_in + b_rec)[:, None] * -double
    joined = _workspace("joined", layer, (steps + 1, n_in + hidden, batch), x.dtype)
    gates = _workspace("gates", layer, (steps, len(GATES) * hidden, batch), x.dtype)
    cells = _workspace("cells", layer, (steps + 1, hidden, batch), x.dtype)
    squashed = _workspace("squashed", layer, (steps, hidden, batch), x.dtype)
    joined[:steps, :n_in] = x
    joined[0, n_in:] = 0
    cells[0] = 0
    with np.errstate(over="ignore"):
        for t in range(steps):
            g = gates[t]
            np.matmul(weight, joined[t], out=g)
            g += bias
            np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)
            cell_gate = g[2 * hidden:3 * hidden]
            cell_gate *= 2
            cell_gate -= 1
            np.multiply(g[hidden:2 * hidden], cells[t], out=cells[t + 1])
            cells[t + 1] += g[:hidden] * cell_gate
            np.tanh(cells[t + 1], out=squashed[t])
            np.multiply(g[3 * hidden:], squashed[t], out=joined[t + 1, n_in:])
    return joined, gates, cells, squashed


def _states(run: tuple[np.ndarray, ...]) -> np.ndarray:
    joined, _, _, squashed = run
    return joined[1:, joined.shape[1] - squashed.shape[1]:]


def predict(weights: Weights, x: np.ndarray) -> np.ndarray:
    """One value per window of ``x``, shaped (sample, step, feature). No dropout."""
    out = _inward(x, weights["fc.weight"].dtype)
    for layer in range(_n_layers(weights)):
        out = _states(_run_layer(out, _layer(weights, layer), layer))
    return weights["fc.weight"][0] @ out[-1] + weights["fc.bias"][0]


def _layer_gradients(params: list[np.ndarray], run: tuple[np.ndarray, ...], d_out: np.ndarray,
                     d_in: np.ndarray | None) -> list[np.ndarray]:
    """Gradients of one layer's four arrays, given those of its output.

    The gradient of its input goes into ``d_in``, unless that is None.
    """
    w_in, w_rec = params[:2]
    joined, gates, cells, squashed = run
    steps, hidden, batch = squashed.shape
    n_in = w_in.shape[1]
    back, into = np.ascontiguousarray(w_rec.T), np.ascontiguousarray(w_in.T)
    d_state = np.zeros((hidden, batch), gates.dtype)
    d_cell = np.zeros_like(d_state)
    d_pre = np.empty((len(GATES), hidden, batch), gates.dtype)
    rows = d_pre.reshape(-1, batch)
    d_weight = np.zeros((len(GATES) * hidden, n_in + hidden), gates.dtype)
    d_bias = np.zeros(len(GATES) * hidden, gates.dtype)
    for t in reversed(range(steps)):
        i, f, c, o = gates[t].reshape(d_pre.shape)
        s = squashed[t]
        d_state += d_out[t]
        d_cell += d_state * o * (1 - s * s)
        np.multiply(d_cell * c, i * (1 - i), out=d_pre[0])
        np.multiply(d_cell * cells[t], f * (1 - f), out=d_pre[1])
        np.multiply(d_cell * i, 1 - c * c, out=d_pre[2])
        np.multiply(d_state * s, o * (1 - o), out=d_pre[3])
        np.matmul(back, rows, out=d_state)
        d_cell *= f
        d_weight += rows @ joined[t].T
        d_bias += rows.sum(axis=1)
        if d_in is not None:
            np.matmul(into, rows, out=d_in[t])
    return [d_weight[:, :n_in], d_weight[:, n_in:], d_bias, d_bias]


def loss_and_gradient(weights: Weights, x: np.ndarray, y: np.ndarray, dropout: float = 0.0,
                      rng: np.random.Generator | None = None) -> tuple[float, Weights]:
    """Mean squared error of a batch and its gradient."""
    errors, gradient = errors_and_gradient(weights, x, y, dropout, rng)
    return float(np.mean(errors)), gradient


def errors_and_gradient(weights: Weights, x: np.ndarray, y: np.ndarray, dropout: float = 0.0,
                        rng: np.random.Generator | None = None) -> tuple[np.ndarray, Weights]:
    """Squared error of each sample of a batch, and the gradient of their mean."""
    dtype = weights["fc.weight"].dtype
    layers = _n_layers(weights)
    out, runs, masks = _inward(x, dtype), [], []
    for layer in range(layers):
        runs.append(_run_layer(out, _layer(weights, layer), layer))
        out = _states(runs[layer])
        if dropout and layer < layers - 1:
            draws = rng.random(out=_workspace("draws", layer, out.shape, np.dtype(np.float32)), dtype=np.float32)
            masks.append((draws >= dropout) * dtype.type(1 / (1 - dropout)))
            out = np.multiply(out, masks[layer], out=_workspace("dropped", layer, out.shape, dtype))

    last, head = out[-1], weights["fc.weight"]
    error = head[0] @ last + weights["fc.bias"][0] - y.astype(dtype)
    d_error = (2 / len(y)) * error
    grad = {"fc.weight": (last @ d_error)[None, :], "fc.bias": d_error.sum(keepdims=True)}
    d_out = _workspace("d_out", layers, out.shape, dtype)
    d_out[:-1] = 0
    d_out[-1] = head[0][:, None] * d_error
    for layer in reversed(range(layers)):
        below = _workspace("d_out", layer, out.shape, dtype) if layer else None
        grads = _layer_gradients(_layer(weights, layer), runs[layer], d_out, below)
        grad.update(zip((n.format(layer) for n in LAYER_NAMES), grads))
        if layer and masks:
            below *= masks[layer - 1]
        d_out = below
    return np.square(error, dtype=np.float64), {name: grad[name].astype(dtype) for name in weights}


def to_vector(weights: Weights) -> np.ndarray:
    return np.concatenate([w.ravel() for w in weights.values()])


def from_vector(vector: np.ndarray, shapes: dict[str, tuple[int, ...]]) -> Weights:
    ends = np.cumsum([int(np.prod(shape)) for shape in shapes.values()])
    return {name: part.reshape(shape)
            for (name, shape), part in zip(shapes.items(), np.split(vector, ends[:-1]))}


class Adam:
    """Adam on the driver's weight vector."""

    # Decay rates and guard of the optimiser.
    DECAY, SQUARE_DECAY, GUARD = 0.9, 0.999, 1e-8

    def __init__(self, size: int, rate: float):
        self.rate, self.steps = rate, 0
        self.mean, self.square = np.zeros(size), np.zeros(size)

    def at(self, mean: np.ndarray, square: np.ndarray, steps: int) -> Adam:
        """The same optimiser after other steps."""
        moved = Adam(len(mean), self.rate)
        moved.mean, moved.square, moved.steps = mean.copy(), square.copy(), steps
        return moved

    def step(self, vector: np.ndarray, grad: np.ndarray) -> np.ndarray:
        self.steps += 1
        self.mean += (1 - self.DECAY) * (grad - self.mean)
        self.square += (1 - self.SQUARE_DECAY) * (grad * grad - self.square)
        mean = self.mean / (1 - self.DECAY ** self.steps)
        square = self.square / (1 - self.SQUARE_DECAY ** self.steps)
        return (vector - self.rate * mean / (np.sqrt(square) + self.GUARD)).astype(vector.dtype)
