"""A convolutional network over bytes, trained in numpy.

Bytes are embedded, filters of several widths slide over them, each filter keeps its greatest
response in the window (max pooling), and a softmax layer turns the responses into class
probabilities. Windows have a fixed length; shorter texts are padded with byte 0.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

LENGTH = 64
DIM = 8
WIDTHS = (3, 4, 5)
FILTERS = 32


def windows(texts: list[bytes], stride: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows by LENGTH, index of the text of each). A text of up to LENGTH bytes gives one window.

    Windows start every stride bytes; the last one of a long text ends at the text's end.
    """
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    buffer = np.frombuffer(b"".join(texts) + bytes(LENGTH), np.uint8)
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(texts) else sizes
    more = np.maximum(0, -(-(sizes - LENGTH) // stride)) + 1
    owner = np.repeat(np.arange(len(texts)), more)
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(more) - more, more)
    offset = np.minimum(rank * stride, np.maximum(0, sizes[owner] - LENGTH))
    column = np.arange(LENGTH)
    got = buffer[(begins[owner] + offset)[:, None] + column]
    got[column >= (sizes[owner] - offset)[:, None]] = 0
    return got, owner


@dataclass
class ByteCNN:
    classes: tuple[str, ...]
    embedding: np.ndarray = field(default=None, repr=False)
    filters: list[np.ndarray] = field(default=None, repr=False)
    bias: np.ndarray = field(default=None, repr=False)
    out: np.ndarray = field(default=None, repr=False)
    out_bias: np.ndarray = field(default=None, repr=False)
    #: Tables of the trained filters, made where they are first used.
    looked_up: tuple | None = field(default=None, repr=False)

    def __post_init__(self):
        if self.embedding is None:
            rng, k = np.random.default_rng(7), FILTERS * len(WIDTHS)
            f32 = lambda x: x.astype(np.float32)
            self.embedding = f32(rng.normal(0, 0.5, (256, DIM)))
            self.embedding[0] = 0
            self.filters = [f32(rng.normal(0, (2 / (w * DIM)) ** 0.5, (w * DIM, FILTERS))) for w in WIDTHS]
            self.bias = np.zeros(k, np.float32)
            self.out = f32(rng.normal(0, (1 / k) ** 0.5, (k, len(self.classes))))
            self.out_bias = np.zeros(len(self.classes), np.float32)

    def _pooled(self, x: np.ndarray):
        e = self.embedding[x]
        best, at, columns = [], [], []
        for w, f in zip(WIDTHS, self.filters):
            n = LENGTH - w + 1
            c = np.lib.stride_tricks.sliding_window_view(e, (w, DIM), (1, 2)).reshape(len(x), n, w * DIM)
            z = (c.reshape(-1, w * DIM) @ f).reshape(len(x), n, FILTERS)
            best.append(z.max(1))
            at.append(z)
            columns.append(c)
        return np.concatenate(best, 1) + self.bias, at, columns

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def _tables(self) -> tuple[np.ndarray, ...]:
        """What each pair of bytes adds to the filters: at their first two places, and at their next two; then the scale.

        The numbers are whole ones of 16 bits, scaled so that no sum of them can overflow.
        """
        first, second = (np.zeros((256, 256, FILTERS * len(WIDTHS)), np.float32) for _ in range(2))
        for i, (w, f) in enumerate(zip(WIDTHS, self.filters)):
            part = [self.embedding @ f[k * DIM : (k + 1) * DIM] for k in range(w)]
            mine = slice(i * FILTERS, (i + 1) * FILTERS)
            first[:, :, mine] = part[0][:, None] + part[1][None]
            second[:, :, mine] = part[2][:, None] + (part[3][None] if w > 3 else 0)
        fifth = self.embedding @ self.filters[-1][4 * DIM :]
        scale = np.float32(32_000 / max(1e-9, sum(float(np.abs(t).max()) for t in (first, second, fifth))))
        first, second, fifth = (np.round(t * scale).astype(np.int16) for t in (first, second, fifth))
        first, second = first.reshape(-1, first.shape[2]), second.reshape(-1, second.shape[2])
        return first, second, np.ascontiguousarray(first[:, :-FILTERS]), np.ascontiguousarray(second[:, :-FILTERS]), fifth, scale

    def probabilities(self, x: np.ndarray, batch: int = 128) -> np.ndarray:
        """Class probabilities of each window. The filters' responses are sums of looked-up pairs, a small batch at a time."""
        if not len(x):
            return np.zeros((0, len(self.classes)), np.float32)
        if self.looked_up is None:
            self.looked_up = self._tables()
        first, second, first_short, second_short, fifth, scale = self.looked_up
        whole, got, k = LENGTH - WIDTHS[-1] + 1, [], first.shape[1]
        room = [np.empty((batch, whole, n), np.int16) for n in (k, k, FILTERS)]
        for i in range(0, len(x), batch):
            y = x[i : i + batch].astype(np.intp)
            pair, n = y[:, :-1] * 256 + y[:, 1:], len(y)
            look = lambda table, at, j: np.take(table, at, axis=0, out=room[j][:n], mode="clip")  # noqa: B023, E731
            z = look(first, pair[:, :whole], 0)
            z += look(second, pair[:, 2 : whole + 2], 1)
            z[:, :, -FILTERS:] += look(fifth, y[:, 4:], 2)
            best = z.max(1)
            # The shorter filters also fit at the last places.
            ends = first_short[pair[:, whole : whole + 2]]
            ends += second_short[np.concatenate((pair[:, whole + 2 :], y[:, -1:] * 256), 1)]
            best[:, :FILTERS] = np.maximum(best[:, :FILTERS], ends[:, :, :FILTERS].max(1))
            best[:, FILTERS:-FILTERS] = np.maximum(best[:, FILTERS:-FILTERS], ends[:, 0, FILTERS:])
            got.append(self._softmax(np.maximum(best / scale + self.bias, 0) @ self.out + self.out_bias))
        return np.concatenate(got)

    def fit(self, texts: list[bytes], labels: np.ndarray, steps: int, batch: int = 128, rate: float = 5e-3, seed: int = 11) -> None:
        """Adam on random windows of the texts. labels: class indices; classes are drawn evenly."""
        rng, self.looked_up = np.random.default_rng(seed), None
        by_class = [np.flatnonzero(labels == c) for c in range(len(self.classes))]
        held = [c for c in range(len(self.classes)) if len(by_class[c])]
        if not held:
            return
        params = [self.embedding, *self.filters, self.bias, self.out, self.out_bias]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            which = np.concatenate([rng.choice(by_class[c], -(-batch // len(held))) for c in held])[:batch]
            x = np.zeros((batch, LENGTH), np.uint8)
            for i, j in enumerate(which):
                t = texts[j]
                s = rng.integers(0, len(t) - LENGTH + 1) if len(t) > LENGTH else 0
                part = np.frombuffer(t[s : s + LENGTH], np.uint8)
                x[i, : len(part)] = part
            y = labels[which]
            grads = self._gradients(x, y)
            lr = rate * min(1, step / 50) * (1 - step / (steps + 1)) ** 0.5
            for p, g, a, b in zip(params, grads, m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-7)
            self.embedding[0] = 0

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        n = len(x)
        pooled, responses, columns = self._pooled(x)
        active = np.maximum(pooled, 0)
        p = self._softmax(active @ self.out + self.out_bias)
        p[np.arange(n), y] -= 1
        p /= n
        d_out, d_out_bias = active.T @ p, p.sum(0)
        d_pooled = (p @ self.out.T) * (pooled > 0)
        d_embedding, d_filters, rows = np.zeros_like(self.embedding), [], np.arange(n)
        for i, (w, f) in enumerate(zip(WIDTHS, self.filters)):
            d = d_pooled[:, i * FILTERS : (i + 1) * FILTERS]
            at = responses[i].argmax(1)  # only the position that won gets a gradient
            c = columns[i][rows[:, None], at]
            d_filters.append(np.einsum("nf,nfk->kf", d, c))
            back = (d[:, :, None] * f.T[None]).reshape(n, FILTERS, w, DIM)
            bytes_at = x[rows[:, None, None], at[:, :, None] + np.arange(w)]
            for k in range(DIM):
                d_embedding[:, k] += np.bincount(bytes_at.ravel(), back[..., k].ravel(), 256)
        return [d_embedding, *d_filters, d_pooled.sum(0), d_out, d_out_bias]
