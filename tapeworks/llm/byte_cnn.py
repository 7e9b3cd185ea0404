"""A small convolutional network on bytes: filters of several widths, max pooling over a window, softmax. Training and inference in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WIDTHS, FILTERS = (2, 3, 4), 8
LENGTH, REACH = 256, max(WIDTHS) - 1
BLOCK = 512
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cuts texts, one after the other in data, into windows of LENGTH bytes; each also sees the REACH bytes after it.

    Returns the padded windows, the text of each and how many bytes of its own each has. An empty text has none.
    """
    sizes = np.diff(offsets)
    counts = -(-sizes // LENGTH)
    text = np.repeat(np.arange(len(sizes)), counts)
    start = offsets[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)) * LENGTH
    end = offsets[1:][text]
    at = start[:, None] + np.arange(LENGTH + REACH)
    inside = at < end[:, None]
    cut = np.where(inside, LOWER[data[np.minimum(at, max(0, len(data) - 1))]], 0) if len(data) else np.zeros(at.shape, np.uint8)
    return cut.astype(np.uint8), text, np.minimum(LENGTH, end - start)


@dataclass
class Network:
    filters: list[np.ndarray]  # for each width: (width, 256, FILTERS); byte 0 is padding and has weight 0
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    def tables(self) -> list[list[tuple[int, bool, np.ndarray]]]:
        """For each width its lookups (place, of a byte pair?, table): a pair's table is the sum of two bytes' weights."""
        out = []
        for w in self.filters:
            parts, k = [], 0
            while k < len(w):
                if k + 1 < len(w):
                    parts.append((k, True, (w[k][:, None, :] + w[k + 1][None, :, :]).reshape(65536, -1).astype(np.float32)))
                else:
                    parts.append((k, False, w[k].astype(np.float32)))
                k += 2
            out.append(parts)
        return out

    def predict(self, cut: np.ndarray, tables=None) -> np.ndarray:
        """Class probabilities of padded windows, a block at a time."""
        tables = tables or self.tables()
        out = np.zeros((len(cut), len(self.offset)), np.float32)
        for b in range(0, len(cut), BLOCK):
            x = cut[b : b + BLOCK]
            pairs = x[:, :-1].astype(np.uint16) << 8 | x[:, 1:]
            pooled = []
            for parts in tables:
                total = None
                for place, paired, table in parts:
                    at = (pairs if paired else x)[:, place : place + LENGTH]
                    got = table.take(at, axis=0)
                    total = got if total is None else np.add(total, got, out=total)
                pooled.append(total.max(axis=1))
            hidden = np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0)
            out[b : b + BLOCK] = softmax(hidden @ self.dense + self.offset)
        return out


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def train(cut: np.ndarray, labels: np.ndarray, classes: int, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam on the cross entropy; classes weigh alike. A filter's gradient goes to the bytes at its largest place in the window only."""
    rng = np.random.default_rng(seed)
    net = Network([rng.normal(0, 0.3, (w, 256, FILTERS)) for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS)), rng.normal(0, 0.3, (FILTERS * len(WIDTHS), classes)), np.zeros(classes))
    for f in net.filters:
        f[:, 0] = 0
    share = np.bincount(labels, minlength=classes).astype(float)
    weight = len(labels) / np.maximum(share, 1) / max(1, (share > 0).sum())
    params = [*net.filters, net.bias, net.dense, net.offset]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(cut))
        for b in range(0, len(order), batch):
            rows = order[b : b + batch]
            x, y = cut[rows], labels[rows]
            pooled, places = [], []
            for f in net.filters:
                total = sum(f[k].take(x[:, k : k + LENGTH], axis=0) for k in range(len(f)))
                at = total.argmax(axis=1)
                places.append(at)
                pooled.append(np.take_along_axis(total, at[:, None], axis=1)[:, 0])
            pre = np.concatenate(pooled, axis=1) + net.bias
            hidden = np.maximum(pre, 0)
            slope = softmax(hidden @ net.dense + net.offset)
            slope[np.arange(len(y)), y] -= 1
            slope *= weight[y][:, None] / len(y)
            back = (slope @ net.dense.T) * (pre > 0)
            grads = []
            for k, (f, at) in enumerate(zip(net.filters, places, strict=True)):
                g, own = np.zeros_like(f), back[:, k * FILTERS : (k + 1) * FILTERS]
                for place in range(len(f)):
                    np.add.at(g[place], (np.take_along_axis(x, at + place, axis=1), np.arange(FILTERS)[None, :]), own)
                g[:, 0] = 0
                grads.append(g)
            grads += [back.sum(0), hidden.T @ slope + 1e-4 * net.dense, slope.sum(0)]
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net
