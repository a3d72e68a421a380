"""Reverse-mode differentiation over NumPy arrays, as much as the small networks here need."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np


def _fit(grad: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """Sums a gradient over what was broadcast."""
    while grad.ndim > len(shape):
        grad = grad.sum(axis=0)
    for axis, size in enumerate(shape):
        if size == 1 and grad.shape[axis] != 1:
            grad = grad.sum(axis=axis, keepdims=True)
    return grad


class Node:
    """A value, and how its gradient reaches the values that it came from."""

    __slots__ = ("value", "parents", "grad")

    def __init__(self, value, parents: Sequence[tuple[Node, Callable]] = ()):
        self.value = np.asarray(value, float)
        self.parents = tuple(parents)
        self.grad: np.ndarray | None = None

    @property
    def shape(self):
        return self.value.shape

    def __add__(self, other):
        b = lift(other)
        return Node(self.value + b.value, [(self, lambda g: _fit(g, self.shape)), (b, lambda g: _fit(g, b.shape))])

    def __mul__(self, other):
        b = lift(other)
        return Node(self.value * b.value, [(self, lambda g: _fit(g * b.value, self.shape)), (b, lambda g: _fit(g * self.value, b.shape))])

    __radd__, __rmul__ = __add__, __mul__

    def __neg__(self):
        return self * -1.0

    def __sub__(self, other):
        return self + -lift(other)

    def __rsub__(self, other):
        return lift(other) - self

    def __truediv__(self, other):
        return self * lift(other).apply(lambda v: 1 / v, lambda v, out: -out * out)

    def __matmul__(self, other):
        b = lift(other)
        return Node(self.value @ b.value, [(self, lambda g: g @ b.value.T), (b, lambda g: self.value.T @ g)])

    def __getitem__(self, key):
        def back(g):
            out = np.zeros(self.shape)
            np.add.at(out, key, g)
            return out

        return Node(self.value[key], [(self, back)])

    def apply(self, f: Callable, slope: Callable) -> Node:
        out = f(self.value)
        return Node(out, [(self, lambda g: g * slope(self.value, out))])

    def tanh(self):
        return self.apply(np.tanh, lambda v, o: 1 - o * o)

    def sigmoid(self):
        return self.apply(lambda v: 1 / (1 + np.exp(-np.clip(v, -60, 60))), lambda v, o: o * (1 - o))

    def leaky(self, slope: float = 0.2):
        return self.apply(lambda v: np.where(v > 0, v, slope * v), lambda v, o: np.where(v > 0, 1.0, slope))

    def bent(self, scale: float, low: float):
        """scale * x above 0, scale * low * (e**x - 1) below."""
        below = lambda v: scale * low * np.exp(np.minimum(v, 0.0))
        return self.apply(lambda v: np.where(v > 0, scale * v, below(v) - scale * low), lambda v, o: np.where(v > 0, scale, below(v)))

    def exp(self):
        return self.apply(lambda v: np.exp(np.clip(v, -60, 60)), lambda v, o: o)

    def sqrt(self):
        return self.apply(lambda v: np.sqrt(v + 1e-12), lambda v, o: 0.5 / o)

    def abs(self):
        return self.apply(np.abs, lambda v, o: np.sign(v))

    def softplus(self):
        return self.apply(lambda v: np.logaddexp(0, v), lambda v, o: 1 / (1 + np.exp(-np.clip(v, -60, 60))))

    def sum(self, axis=None):
        def back(g):
            return np.broadcast_to(g if axis is None else np.expand_dims(g, axis), self.shape)

        return Node(self.value.sum(axis=axis), [(self, back)])

    def mean(self, axis=None):
        return self.sum(axis) * (1.0 / (self.value.size if axis is None else self.shape[axis]))

    def backward(self) -> None:
        order, seen, stack = [], set(), [(self, False)]
        while stack:
            node, done = stack.pop()
            if done:
                order.append(node)
            elif id(node) not in seen:
                seen.add(id(node))
                stack.append((node, True))
                stack += [(p, False) for p, _ in node.parents]
        for node in order:
            node.grad = None
        self.grad = np.ones(self.shape)
        for node in reversed(order):
            for parent, back in node.parents:
                g = back(node.grad)
                parent.grad = g if parent.grad is None else parent.grad + g


def lift(x) -> Node:
    return x if isinstance(x, Node) else Node(x)


def concat(nodes: Sequence[Node], axis: int = 1) -> Node:
    nodes = [lift(n) for n in nodes]
    ends = np.cumsum([0, *(n.shape[axis] for n in nodes)])
    parents = [(n, lambda g, a=a, b=b: np.take(g, np.arange(a, b), axis=axis)) for n, a, b in zip(nodes, ends, ends[1:])]
    return Node(np.concatenate([n.value for n in nodes], axis=axis), parents)


def bce(logits: Node, real: bool) -> Node:
    """Binary cross-entropy of logits against one label."""
    return (logits.softplus() - logits * (1.0 if real else 0.0)).mean()


class Adam:
    def __init__(self, params: Sequence[Node], rate: float = 1e-3, betas: tuple[float, float] = (0.9, 0.999)):
        self.params, self.rate, self.betas, self.t = list(params), rate, betas, 0
        self.m = [np.zeros(p.shape) for p in self.params]
        self.v = [np.zeros(p.shape) for p in self.params]

    def step(self, loss: Node) -> float:
        for p in self.params:
            p.grad = None
        loss.backward()
        self.t += 1
        a, b = self.betas
        for p, m, v in zip(self.params, self.m, self.v):
            if p.grad is None:
                continue
            g = np.clip(p.grad, -5, 5)
            m += (1 - a) * (g - m)
            v += (1 - b) * (g * g - v)
            p.value = p.value - self.rate * (m / (1 - a**self.t)) / (np.sqrt(v / (1 - b**self.t)) + 1e-8)
        return float(loss.value)


class Dense:
    def __init__(self, rng: np.random.Generator, n_in: int, n_out: int):
        self.w = Node(rng.normal(0, np.sqrt(2 / (n_in + n_out)), (n_in, n_out)))
        self.b = Node(np.zeros((1, n_out)))
        self.params = [self.w, self.b]

    def __call__(self, x) -> Node:
        return lift(x) @ self.w + self.b


_SELU, _SELU_LOW = 1.0507009873554805, 1.6732632423543772
#: Between layers, by name.
ACTIVATE: dict[str, Callable[[Node], Node]] = {
    "tanh": Node.tanh, "sigmoid": Node.sigmoid, "linear": lambda x: x, "relu": lambda x: x.leaky(0.0), "leaky": Node.leaky,
    "elu": lambda x: x.bent(1.0, 1.0), "selu": lambda x: x.bent(_SELU, _SELU_LOW), "swish": lambda x: x * x.sigmoid(), "gelu": lambda x: x * (x * 1.702).sigmoid(),
}


class Mlp:
    """Dense layers with an activation between them; dropout works where a generator is given to the call."""

    def __init__(self, rng: np.random.Generator, sizes: Sequence[int], activation: str = "leaky", dropout: float = 0.0):
        self.layers = [Dense(rng, a, b) for a, b in zip(sizes, sizes[1:])]
        self.params = [p for layer in self.layers for p in layer.params]
        self.activate, self.dropout = ACTIVATE[activation], dropout

    def __call__(self, x, rng: np.random.Generator | None = None) -> Node:
        for k, layer in enumerate(self.layers):
            x = layer(x)
            if k < len(self.layers) - 1:
                x = self.activate(x)
                if rng is not None and self.dropout:
                    x = x * ((rng.random(x.shape) >= self.dropout) / (1 - self.dropout))
        return x


class Gru:
    """A gated recurrent layer with a dense output at each step."""

    def __init__(self, rng: np.random.Generator, n_in: int, hidden: int, n_out: int, squash: bool = True):
        self.gates, self.new, self.out = Dense(rng, n_in + hidden, 2 * hidden), Dense(rng, n_in + hidden, hidden), Dense(rng, hidden, n_out)
        self.hidden, self.squash = hidden, squash
        self.params = [p for d in (self.gates, self.new, self.out) for p in d.params]

    def __call__(self, steps: Sequence) -> list[Node]:
        h = Node(np.zeros((lift(steps[0]).shape[0], self.hidden)))
        outs = []
        for x in steps:
            g = self.gates(concat([x, h])).sigmoid()
            z, r = g[:, : self.hidden], g[:, self.hidden :]
            new = self.new(concat([x, r * h])).tanh()
            h = z * h + (1.0 - z) * new
            y = self.out(h)
            outs.append(y.sigmoid() if self.squash else y)
        return outs


class Lstm:
    """A long short-term memory layer that gives its last hidden state."""

    def __init__(self, rng: np.random.Generator, n_in: int, hidden: int):
        self.gates, self.hidden = Dense(rng, n_in + hidden, 4 * hidden), hidden
        self.params = self.gates.params

    def __call__(self, steps: Sequence) -> Node:
        n, k = lift(steps[0]).shape[0], self.hidden
        h, c = Node(np.zeros((n, k))), Node(np.zeros((n, k)))
        for x in steps:
            g = self.gates(concat([x, h]))
            i, f, o, u = g[:, :k].sigmoid(), g[:, k : 2 * k].sigmoid(), g[:, 2 * k : 3 * k].sigmoid(), g[:, 3 * k :].tanh()
            c = f * c + i * u
            h = o * c.tanh()
        return h
