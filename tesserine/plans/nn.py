"""Network layers as plans, and reverse-mode gradients over small driver tensors."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import ufuncs
from ..operators import contractions, reductions
from .array import SparkArray
from .shapes import axis_of


# over cells: one grouped pass for each statistic
def softmax(x: SparkArray, axis: int = -1) -> SparkArray:
    axis = axis_of(axis, x.rank)
    shifted = (x - reductions.reduce(x, "max", axis, True)).map(ufuncs.exp)
    return shifted / reductions.reduce(shifted, "sum", axis, True)


def log_softmax(x: SparkArray, axis: int = -1) -> SparkArray:
    axis = axis_of(axis, x.rank)
    shifted = x - reductions.reduce(x, "max", axis, True)
    return shifted - reductions.reduce(shifted.map(ufuncs.exp), "sum", axis, True).map(ufuncs.log)


def _reduced(x: SparkArray, how: str) -> SparkArray:
    return x if how == "none" else reductions.reduce(x, how)


def mse_loss(x: SparkArray, y: SparkArray, reduction: str = "mean") -> SparkArray:
    return _reduced((x - y).map(ufuncs.square), reduction)


def cross_entropy(x: SparkArray, target: SparkArray, reduction: str = "mean") -> SparkArray:
    lost = log_softmax(x).df.join(target.df.select("i0", F.col("v").alias("t")), "i0").where("i1 = t")
    return _reduced(SparkArray(lost.select("i0", (-F.col("v")).alias("v")), (x.shape[0],)), reduction)


def linear(x: SparkArray, weight: SparkArray, bias: SparkArray | None = None) -> SparkArray:
    y = contractions.matmul(x, weight.transpose())
    return y if bias is None else y + bias


def layer_norm(x: SparkArray, weight: SparkArray, bias: SparkArray, eps: float = 1e-5) -> SparkArray:
    centred = x - reductions.reduce(x, "mean", -1, True)
    spread = reductions.reduce(x, "variance", -1, True).map(lambda v: F.sqrt(v + eps))
    return centred / spread * weight + bias


def rms_norm(x: SparkArray, weight: SparkArray, eps: float = 1e-6) -> SparkArray:
    return x / reductions.reduce(x.map(ufuncs.square), "mean", -1, True).map(lambda v: F.sqrt(v + eps)) * weight


def embedding(table: SparkArray, ids: SparkArray) -> SparkArray:
    return table.take_array(ids)


def dropout(x: SparkArray, p: float, seed: int = 0, training: bool = True) -> SparkArray:
    from ..operators.random import unit

    if not training or p == 0:
        return x
    at = x.flat()
    return SparkArray(x.df.select(*x.index, F.when(unit(seed, at) < p, 0.0).otherwise(F.col("v") / (1 - p)).alias("v")), x.shape)


def rotary(x: SparkArray, base: float = 10_000.0) -> SparkArray:
    """Halves of the last axis turned by an angle of position (the last axis but one) and component."""
    d, pos, k = x.shape[-1], f"i{x.rank - 2}", f"i{x.rank - 1}"
    half = d // 2
    turned = SparkArray(x.df.select(*(((F.col(c) + half) % d).alias(c) if c == k else F.col(c) for c in x.index), F.when(F.col(k) >= half, -F.col("v")).otherwise(F.col("v")).alias("v")), x.shape)
    both, _ = x.paired(turned)
    angle: Column = F.col(pos) * F.pow(F.lit(base), -2.0 * (F.col(k) % half) / d)
    return SparkArray(both.select(*x.index, (F.col("v") * F.cos(angle) + F.col("w") * F.sin(angle)).alias("v")), x.shape)


def attention(q: SparkArray, k: SparkArray, v: SparkArray, mask: SparkArray | None = None, causal: bool = False) -> SparkArray:
    lead = "".join("abcdef"[: q.rank - 2])
    s = contractions.einsum(f"{lead}qd,{lead}kd->{lead}qk", q, k) * (1 / math.sqrt(q.shape[-1]))
    if mask is not None:
        s = s + mask
    if causal:
        a, b = f"i{s.rank - 2}", f"i{s.rank - 1}"
        s = SparkArray(s.df.select(*s.index, F.when(F.col(b) > F.col(a), F.lit(float("-inf"))).otherwise(F.col("v")).alias("v")), s.shape)
    return contractions.einsum(f"{lead}qk,{lead}kd->{lead}qd", softmax(s), v)


def multihead(q: SparkArray, k: SparkArray, v: SparkArray, weights: dict[str, SparkArray], heads: int, causal: bool = False) -> SparkArray:
    """Rows by width; weights q, k, v and o of width by width."""
    width = q.shape[-1]

    def cut(x: SparkArray, name: str) -> SparkArray:
        return linear(x, weights[name]).reshape(x.shape[0], heads, width // heads).swapaxes(0, 1)

    joined = attention(cut(q, "q"), cut(k, "k"), cut(v, "v"), causal=causal).swapaxes(0, 1).reshape(q.shape[0], width)
    return linear(joined, weights["o"])


def _plus(x: SparkArray, f: Callable[[SparkArray], SparkArray], norm: tuple[SparkArray, SparkArray], first: bool) -> SparkArray:
    return x + f(layer_norm(x, *norm)) if first else layer_norm(x + f(x), *norm)


def encoder_layer(x: SparkArray, p: dict, heads: int, norm_first: bool = True) -> SparkArray:
    """Attention and a gelu layer, each with its sum and norm; p holds self, norm1, norm2, w1 and w2."""
    x = _plus(x, lambda y: multihead(y, y, y, p["self"], heads), p["norm1"], norm_first)
    return _plus(x, lambda y: linear(linear(y, p["w1"]).map(ufuncs.gelu), p["w2"]), p["norm2"], norm_first)


def decoder_layer(x: SparkArray, memory: SparkArray, p: dict, heads: int, norm_first: bool = True) -> SparkArray:
    """Causal attention, attention to the memory and a gelu layer; p holds cross and norm3 too."""
    x = _plus(x, lambda y: multihead(y, y, y, p["self"], heads, True), p["norm1"], norm_first)
    x = _plus(x, lambda y: multihead(y, memory, memory, p["cross"], heads), p["norm2"], norm_first)
    return _plus(x, lambda y: linear(linear(y, p["w1"]).map(ufuncs.gelu), p["w2"]), p["norm3"], norm_first)


def geglu(x: SparkArray, w1: SparkArray, w2: SparkArray, w3: SparkArray) -> SparkArray:
    return swiglu(x, w1, w2, w3, ufuncs.gelu)


def swiglu(x: SparkArray, w1: SparkArray, w2: SparkArray, w3: SparkArray, gate: Callable = ufuncs.silu) -> SparkArray:
    return linear(linear(x, w1).map(gate) * linear(x, w2), w3)


def conv2d(x: SparkArray, weight: SparkArray, bias: SparkArray | None = None, stride: int = 1, padding: int = 0) -> SparkArray:
    """Batch x channel x height x width by output x channel x rows x columns."""
    from .array import small

    n, _, h, w = x.shape
    out, _, kh, kw = weight.shape
    oh, ow = (h + 2 * padding - kh) // stride + 1, (w + 2 * padding - kw) // stride + 1
    kernel = small(weight.df.select(F.col("i0").alias("o"), F.col("i1"), F.col("i2").alias("r"), F.col("i3").alias("c"), F.col("v").alias("k")), weight.shape)
    hit = x.df.join(kernel, "i1").withColumn("y", F.col("i2") + padding - F.col("r")).withColumn("z", F.col("i3") + padding - F.col("c"))
    hit = hit.where(f"y >= 0 and z >= 0 and y % {stride} = 0 and z % {stride} = 0 and y < {oh * stride} and z < {ow * stride}")
    got = hit.groupBy("i0", "o", (F.col("y") / stride).cast("bigint").alias("p"), (F.col("z") / stride).cast("bigint").alias("q")).agg(F.sum(F.col("v") * F.col("k")).alias("v"))
    y = SparkArray(got.select("i0", F.col("o").alias("i1"), F.col("p").alias("i2"), F.col("q").alias("i3"), "v"), (n, out, oh, ow))
    return y if bias is None else y + bias.reshape(1, -1, 1, 1)


# gradients: the graph and its small parameters are on the driver
class Tensor:
    """A driver array that remembers how it was made."""

    def __init__(self, value, parents: tuple = (), requires_grad: bool = False):
        self.value = np.asarray(value, float)
        self.parents = parents  # (tensor, gradient rule)
        self.requires_grad = requires_grad or any(p.requires_grad for p, _ in parents)
        self.grad: np.ndarray | None = None

    @staticmethod
    def of(x) -> Tensor:
        return x if isinstance(x, Tensor) else Tensor(x)

    def detach(self) -> Tensor:
        return Tensor(self.value)

    def __add__(self, o):
        o = Tensor.of(o)
        return Tensor(self.value + o.value, ((self, lambda g: g), (o, lambda g: g)))

    def __mul__(self, o):
        o = Tensor.of(o)
        return Tensor(self.value * o.value, ((self, lambda g: g * o.value), (o, lambda g: g * self.value)))

    def __neg__(self):
        return self * -1.0

    def __sub__(self, o):
        return self + -Tensor.of(o)

    def __truediv__(self, o):
        return self * Tensor.of(o) ** -1.0

    def __pow__(self, k: float):
        return Tensor(self.value**k, ((self, lambda g: g * k * self.value ** (k - 1)),))

    def __matmul__(self, o):
        return Tensor(self.value @ o.value, ((self, lambda g: g @ o.value.swapaxes(-1, -2)), (o, lambda g: self.value.swapaxes(-1, -2) @ g)))

    def _by(self, value, slope):
        return Tensor(value, ((self, lambda g: g * slope),))

    def exp(self):
        e = np.exp(self.value)
        return self._by(e, e)

    def log(self):
        return self._by(np.log(self.value), 1 / self.value)

    def sqrt(self):
        return self**0.5

    def relu(self):
        return self._by(np.maximum(self.value, 0), self.value > 0)

    def sigmoid(self):
        s = 1 / (1 + np.exp(-self.value))
        return self._by(s, s * (1 - s))

    def tanh(self):
        t = np.tanh(self.value)
        return self._by(t, 1 - t * t)

    def sum(self, axis=None, keepdims: bool = False):
        def spread(g):
            return np.broadcast_to(g if keepdims or axis is None else np.expand_dims(g, axis), self.value.shape)

        return Tensor(self.value.sum(axis=axis, keepdims=keepdims), ((self, spread),))

    def mean(self, axis=None):
        n = self.value.size if axis is None else self.value.shape[axis]
        return self.sum(axis) * (1 / n)

    def reshape(self, *shape):
        return Tensor(self.value.reshape(*shape), ((self, lambda g: g.reshape(self.value.shape)),))

    def transpose(self, *axes):
        back = np.argsort(axes) if axes else None
        return Tensor(self.value.transpose(*axes), ((self, lambda g: g.transpose(back) if axes else g.transpose()),))

    def __getitem__(self, at):
        def scatter(g):
            out = np.zeros_like(self.value)
            np.add.at(out, at, g)
            return out

        return Tensor(self.value[at], ((self, scatter),))

    def softmax(self, axis: int = -1):
        e = np.exp(self.value - self.value.max(axis=axis, keepdims=True))
        s = e / e.sum(axis=axis, keepdims=True)
        return Tensor(s, ((self, lambda g: s * (g - (g * s).sum(axis=axis, keepdims=True))),))

    def log_softmax(self, axis: int = -1):
        z = self.value - self.value.max(axis=axis, keepdims=True)
        out = z - np.log(np.exp(z).sum(axis=axis, keepdims=True))
        return Tensor(out, ((self, lambda g: g - np.exp(out) * g.sum(axis=axis, keepdims=True)),))

    def cross_entropy(self, target):
        rows = np.arange(len(target))
        return -self.log_softmax()[rows, np.asarray(target)].mean()

    def backward(self) -> None:
        """Gradients of this value in every tensor that asks for one, in reverse topological order."""
        order, seen, stack = [], set(), [(self, False)]
        while stack:
            t, done = stack.pop()
            if done:
                order.append(t)
            elif id(t) not in seen:
                seen.add(id(t))
                stack.append((t, True))
                stack += [(p, False) for p, _ in t.parents if p.requires_grad]
        grads = {id(self): np.ones_like(self.value)}
        for t in reversed(order):
            g = grads.pop(id(t))
            if not t.parents:
                t.grad = g if t.grad is None else t.grad + g
            for p, rule in t.parents:
                if p.requires_grad:
                    d = rule(g)
                    while d.ndim > p.value.ndim:  # sum over what broadcasting added
                        d = d.sum(axis=0)
                    for k, n in enumerate(p.value.shape):
                        if n == 1 and d.shape[k] != 1:
                            d = d.sum(axis=k, keepdims=True)
                    grads[id(p)] = grads[id(p)] + d if id(p) in grads else d


def concatenate(tensors: list[Tensor], axis: int = 0) -> Tensor:
    cuts = np.cumsum([t.value.shape[axis] for t in tensors])[:-1]
    return Tensor(np.concatenate([t.value for t in tensors], axis), tuple((t, lambda g, k=k: np.split(g, cuts, axis)[k]) for k, t in enumerate(tensors)))


class Optimizer:
    def __init__(self, parameters: list[Tensor], lr: float):
        self.parameters, self.lr, self.t = parameters, lr, 0
        self.state: list[dict] = [{} for _ in parameters]

    def zero_grad(self) -> None:
        for p in self.parameters:
            p.grad = None

    def step(self) -> None:
        self.t += 1
        for p, s in zip(self.parameters, self.state):
            if p.grad is not None:
                p.value = self.moved(p.value, p.grad, s)


class SGD(Optimizer):
    def __init__(self, parameters, lr=0.01, momentum=0.0, nesterov=False, weight_decay=0.0):
        super().__init__(parameters, lr)
        self.momentum, self.nesterov, self.decay = momentum, nesterov, weight_decay

    def moved(self, x, g, s):
        g = g + self.decay * x
        if self.momentum:
            s["v"] = self.momentum * s["v"] + g if "v" in s else g
            g = g + self.momentum * s["v"] if self.nesterov else s["v"]
        return x - self.lr * g


class Adam(Optimizer):
    decoupled = False

    def __init__(self, parameters, lr=1e-3, betas=(0.9, 0.999), eps=1e-8, weight_decay=0.0):
        super().__init__(parameters, lr)
        self.betas, self.eps, self.decay = betas, eps, weight_decay

    def moved(self, x, g, s):
        if self.decoupled:
            x = x - self.lr * self.decay * x
        else:
            g = g + self.decay * x
        b1, b2 = self.betas
        s["m"] = b1 * s.get("m", 0) + (1 - b1) * g
        s["v"] = b2 * s.get("v", 0) + (1 - b2) * g * g
        return x - self.lr * (s["m"] / (1 - b1**self.t)) / (np.sqrt(s["v"] / (1 - b2**self.t)) + self.eps)


class AdamW(Adam):
    decoupled = True
