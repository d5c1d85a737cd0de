"""Averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent in numpy.

A text is a bag of hashed n-grams of its normalised bytes (A-Z lower-cased; digits, punctuation and white space become a
space, runs of which count once). Each bucket has an embedding; the bag's mean goes through a linear softmax. As both parts
are linear, a trained model is folded into one table of bucket x class scores, whose means are the logits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: Letters stay, ASCII capitals are lowered, everything above ASCII stays, the rest is a space.
NORMAL = np.full(256, 0x20, np.uint8)
NORMAL[0x61:0x7B] = np.arange(0x61, 0x7B)
NORMAL[0x41:0x5B] = np.arange(0x61, 0x7B)
NORMAL[0x80:] = np.arange(0x80, 0x100)


def normalised(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes with a space before each text, and the new offsets. Runs of spaces are one."""
    n = len(offsets) - 1
    wide = np.full(len(values) + n, 0x20, np.uint8)
    wide[np.arange(len(values)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))] = NORMAL[values]
    begins = offsets + np.arange(n + 1)
    keep = np.ones(len(wide), bool)
    keep[1:] = (wide[1:] != 0x20) | (wide[:-1] != 0x20)
    keep[begins[:-1]] = True
    places = np.concatenate(([0], np.cumsum(keep)))
    return wide[keep], places[begins]


def buckets(raw: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The bucket of each run of n bytes; the last n - 1 places have none."""
    h = raw[: len(raw) - n + 1].astype(np.uint32)
    for k in range(1, n):
        h *= np.uint32(0x01000193 * 2 + 1)
        h += raw[k : len(raw) - n + 1 + k]
    h *= np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    return (h >> np.uint32(32 - bits)).astype(np.int32) if len(h) else np.zeros(0, np.int32)


def inside_words(raw: np.ndarray, n: int) -> np.ndarray:
    """Whether each run of n bytes has no space but at its ends."""
    spaces = np.concatenate(([0], np.cumsum(raw == 0x20)))
    k = len(raw) - n + 1
    return spaces[n - 1 : n - 1 + k] == spaces[1 : 1 + k] if k > 0 else np.zeros(0, bool)


@dataclass
class Subwords:
    """A folded model: logits are scale * mean(table[buckets]) + bias."""

    orders: tuple[int, ...]
    bits: int
    table: np.ndarray  # (orders, buckets, classes), float32
    bias: np.ndarray
    classes: list
    within: bool = False  # only n-grams without a space inside
    floor: int = 1  # bags with fewer n-grams are filled up to it
    fill: np.ndarray | None = None  # the class scores of what they are filled up with; neutral without

    def sums(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Summed scores and numbers of n-grams of each span of the normalised bytes; offsets must ascend."""
        n_class = self.table.shape[2]
        total, count = np.zeros((len(offsets) - 1, n_class)), np.zeros(len(offsets) - 1)
        for k, n in enumerate(self.orders):
            ids = buckets(raw, n, self.bits)
            lo = np.minimum(offsets[:-1], len(ids))
            hi = np.maximum(np.minimum(offsets[1:] - n + 1, len(ids)), lo)
            good = inside_words(raw, n) if self.within else None
            count += hi - lo if good is None else _between(good, lo, hi)
            for c in range(n_class):
                sums = np.zeros(len(ids) + 1)
                part = self.table[k, :, c][ids]
                np.cumsum(part if good is None else part * good, out=sums[1:])
                total[:, c] += sums[hi] - sums[lo]
        return total, count

    def logits(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total, count = self.sums(raw, offsets)
        if self.fill is not None:
            total = total + np.maximum(self.floor - count, 0)[:, None] * self.fill
        return total / np.maximum(count, self.floor)[:, None] + self.bias


def _between(flags: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags)))
    return sums[hi] - sums[lo]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def bags(raw: np.ndarray, offsets: np.ndarray, orders: tuple[int, ...], bits: int, within: bool = False) -> Callable[[int], tuple[np.ndarray, np.ndarray]]:
    """A function from a text's number to its bag: the distinct buckets, ascending over all orders, and their counts."""
    size = 1 << bits
    each = [buckets(raw, n, bits) + np.int32(k * size) for k, n in enumerate(orders)]
    good = [inside_words(raw, n) if within else None for n in orders]

    def bag(t: int) -> tuple[np.ndarray, np.ndarray]:
        parts = []
        for k, n in enumerate(orders):
            span = slice(offsets[t], max(offsets[t], offsets[t + 1] - n + 1))
            parts.append(each[k][span] if good[k] is None else each[k][span][good[k][span]])
        return np.unique(np.concatenate(parts), return_counts=True)

    return bag


def train(raw: np.ndarray, offsets: np.ndarray, labels: np.ndarray, classes: list, orders: tuple[int, ...], bits: int, weights: np.ndarray | None = None, within: bool = False, **options) -> Subwords:
    """descend() on the bags of the texts of some normalised bytes, without those too short for an n-gram."""
    weights = np.ones(len(labels), np.float32) if weights is None else weights.astype(np.float32)
    rows = np.flatnonzero((np.diff(offsets) >= min(orders)) & (weights > 0))
    return descend(bags(raw, offsets, orders, bits, within), rows, labels, weights, classes, orders, bits, within=within, **options)


def descend(bag: Callable[[int], tuple[np.ndarray, np.ndarray]], rows: np.ndarray, labels: np.ndarray, weights: np.ndarray, classes: list, orders: tuple[int, ...], bits: int, dim: int = 8, epochs: int = 3, rate: float = 0.5, batch: int = 64, seed: int = 7, gain: float = 10.0, floor: int = 1, least: int = 1, decay: float = 0.0, within: bool = False) -> Subwords:
    """Minibatch descent with AdaGrad steps on embeddings and softmax together, over the texts numbered in `rows`. `gain`
    multiplies the mean vector, which lets rare telling n-grams matter early; buckets that fewer than `least` of the texts have
    stay neutral. Deterministic for the same rows in the same order."""
    rng = np.random.default_rng(seed)
    size, n_class = 1 << bits, len(classes)
    emb = rng.normal(0, 0.1, (len(orders) * size, dim)).astype(np.float32)
    out = rng.normal(0, 0.1, (dim, n_class)).astype(np.float32)
    bias = np.zeros(n_class, np.float32)
    g_emb, g_out, g_bias = np.full(len(emb), 1e-6, np.float32), np.full_like(out, 1e-6), np.full_like(bias, 1e-6)
    weights = weights.astype(np.float32)
    known = np.ones(len(emb), bool)
    if least > 1:
        seen = np.zeros(len(emb), np.int32)
        for t in rows.tolist():
            seen[bag(t)[0]] += 1
        known = seen >= least
    emb[~known] = 0
    for _ in range(epochs):
        order = rng.permutation(rows)
        for at in range(0, len(order), batch):
            picked = order[at : at + batch]
            held_bags = [bag(t) for t in picked.tolist()]
            who = np.repeat(np.arange(len(picked), dtype=np.int32), [len(ids) for ids, _ in held_bags])
            what = np.concatenate([ids for ids, _ in held_bags]).astype(np.int64)
            times = np.concatenate([counts for _, counts in held_bags])
            length = np.maximum([counts.sum() for _, counts in held_bags], floor).astype(np.float32)
            who, what, times = who[known[what]], what[known[what]], times[known[what]]
            share = (times / length[who]).astype(np.float32) * gain
            edges = np.searchsorted(who, np.arange(len(picked) + 1))
            held = emb[what] * share[:, None]
            sums = np.concatenate((np.zeros((1, dim)), np.cumsum(held, axis=0, dtype=np.float64)))
            mean = (sums[edges[1:]] - sums[edges[:-1]]).astype(np.float32)
            grad = softmax(mean @ out + bias)
            grad[np.arange(len(picked)), labels[picked]] -= 1
            grad *= weights[picked][:, None] / len(picked)
            d_out, d_bias = mean.T @ grad, grad.sum(0)
            d_each = (grad @ out.T)[who] * share[:, None]
            touched, where = np.unique(what, return_inverse=True)
            d_emb = np.stack([np.bincount(where, d_each[:, d], len(touched)) for d in range(dim)], 1).astype(np.float32)
            g_emb[touched] += (d_emb**2).mean(1)
            emb[touched] -= rate * (d_emb / np.sqrt(g_emb[touched])[:, None] + decay * emb[touched])
            g_out += d_out**2
            g_bias += d_bias**2
            out -= rate * 0.2 * d_out / np.sqrt(g_out)
            bias -= rate * 0.2 * d_bias / np.sqrt(g_bias)
    table = (emb @ out * gain).reshape(len(orders), size, n_class)
    return Subwords(orders, bits, np.ascontiguousarray(table), bias.astype(np.float64), list(classes), within, floor)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss on held rows, by search over a fixed grid."""
    grid = np.exp(np.linspace(-3, 3, 61))
    loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])
