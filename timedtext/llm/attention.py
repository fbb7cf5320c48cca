"""A small causal self-attention model in numpy: windows, forward and backward passes, training.

Windows hold CONTEXT ids that are only seen and SPAN ids that are scored, so they overlap and each id is scored once.
One attention layer reads queries, keys and values from tables by id; positions enter as a learnt bias of the
attention scores, with future places masked. What attention gathers and a table entry of the id before make a hidden
layer, and the output is a class of ids, then a member of it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

CONTEXT, SPAN = 8, 24
SEEN = CONTEXT + SPAN - 1
DIM, HIDDEN, SIDE = 16, 31, 32
#: The network's ids: those of their own, one for all others, the end of a text, and padding before its start.
IDS = SIDE * SIDE
OTHER, END, PAD = IDS - 2, IDS - 1, IDS
BATCH = 256
#: Windows that train_once() mixes at once (4 MB).
HELD = 1 << 16
#: Numbers that a step of learning changes at once.
AT_ONCE = 1 << 13


def windows(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows over texts of the given lengths whose ids stand one after another, and the text of each window.

    Each text begins with padding; padding in a scored place is no token.
    """
    steps = -(-lengths // SPAN)
    first = np.cumsum(steps * SPAN + CONTEXT) - (steps * SPAN + CONTEXT)
    flat = np.full(int((steps * SPAN + CONTEXT).sum()), PAD, np.int16)
    flat[np.arange(len(ids)) + np.repeat(first + CONTEXT - (np.cumsum(lengths) - lengths), lengths)] = ids
    text = np.repeat(np.arange(len(lengths)), steps)
    order = np.arange(len(text)) - np.repeat(np.cumsum(steps) - steps, steps)
    return flat[(first[text] + order * SPAN)[:, None] + np.arange(CONTEXT + SPAN)], text


class Network:
    NAMES = ("q", "k", "v", "r", "pos", "w1", "b1", "wc", "bc", "wm", "bm")

    def __init__(self, seed: int = 0, values: dict | None = None):
        rng = np.random.default_rng(seed)
        table = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        none = lambda *shape: np.zeros(shape, np.float32)
        self.p = values or {
            "q": table(IDS + 1, DIM),
            "k": table(IDS + 1, DIM),
            "v": table(IDS + 1, DIM),
            "r": table(IDS + 1, HIDDEN),
            "pos": none(SPAN, SEEN),
            "w1": table(DIM, HIDDEN),
            "b1": none(HIDDEN),
            "wc": table(HIDDEN, SIDE),
            "bc": none(SIDE),
            "wm": table(SIDE, HIDDEN, SIDE),
            "bm": none(SIDE, SIDE),
        }
        i, j = np.indices((SPAN, SEEN))
        self.mask = np.where(j < i + CONTEXT, 0, -1e9).astype(np.float32)
        self.ready: dict | None = None

    def _prepared(self) -> dict:
        """Tables in the form that log_p reads: sums and biases become columns of ones."""
        p = self.p
        ones = lambda x: np.concatenate([x, np.ones((len(x), 1), x.dtype)], axis=1)
        t = {
            "q": p["q"] / DIM**0.5,
            "v": ones(p["v"]),
            "pos": p["pos"] + self.mask,
            "r": ones(p["r"] + p["b1"]),
            "w": np.concatenate([p["w1"], np.zeros((DIM, 1), p["w1"].dtype)], axis=1),
            "c": np.concatenate([p["wc"], p["bc"][None]]),
            "m": np.concatenate([p["wm"], p["bm"][:, None]], axis=1),
        }
        # no score can exceed what the longest query and key make, so most models need no cap before exp
        longest = [np.sqrt((x.astype(np.float64) ** 2).sum(1).max()) for x in (t["q"], p["k"])]
        t["cap"] = longest[0] * longest[1] + p["pos"].max() > 60
        return t

    def _both(self) -> np.ndarray:
        """Weights and biases of the classes and of each class's members, side by side."""
        p = self.p
        out = np.empty((SIDE, HIDDEN + 1, 2 * SIDE), p["wm"].dtype)
        out[:, :HIDDEN, :SIDE], out[:, HIDDEN, :SIDE] = p["wc"], p["bc"]
        out[:, :HIDDEN, SIDE:], out[:, HIDDEN, SIDE:] = p["wm"], p["bm"]
        return out

    def log_p(self, x: np.ndarray) -> np.ndarray:
        """Natural log of the probability of the id in each scored place, (windows, SPAN); 0 where there is padding."""
        t = self.ready = self.ready or self._prepared()
        x = x.astype(np.intp)
        ask, see, y = x[:, CONTEXT - 1 : -1], x[:, :-1], x[:, CONTEXT:].ravel()
        s = t["q"].take(ask, axis=0) @ self.p["k"].take(see, axis=0).transpose(0, 2, 1)
        s += t["pos"]
        if t["cap"]:
            np.minimum(s, 60, out=s)
        np.exp(s, out=s)
        o = (s @ t["v"].take(see, axis=0)).reshape(-1, DIM + 1)
        h = (o[:, :DIM] / np.maximum(o[:, DIM:], 1e-30)) @ t["w"]
        h += t["r"].take(ask.ravel(), axis=0)
        np.maximum(h, 0, out=h)
        real = y != PAD
        y = np.where(real, y, 0)
        c = (y // SIDE).astype(np.uint8)
        out = _log_share(h @ t["c"], c)
        order = np.argsort(c, kind="stable")
        cut, h = np.searchsorted(c[order], np.arange(SIDE + 1)), h.take(order, axis=0)
        logits = np.empty((len(h), SIDE), h.dtype)
        for k in range(SIDE):
            a, b = cut[k], cut[k + 1]
            if a < b:
                np.matmul(h[a:b], t["m"][k], out=logits[a:b])
        out[order] += _log_share(logits, y[order] % SIDE)
        out *= real
        return out.reshape(-1, SPAN)

    def gradients(self, x: np.ndarray) -> tuple[float, int, dict]:
        """Sum of log probabilities, tokens, and the gradient of the mean loss."""
        p, n = self.p, len(x)
        kind, scale = p["q"].dtype, 1 / DIM**0.5
        x = x.astype(np.intp)
        ask, see, y = x[:, CONTEXT - 1 : -1], x[:, :-1], x[:, CONTEXT:].ravel()
        q = (p["q"] * scale).take(ask, axis=0)
        kv = np.concatenate([p["k"], p["v"], np.ones((IDS + 1, 1), kind)], axis=1).take(see, axis=0)  # a column of ones makes the sums
        k, v = kv[:, :, :DIM], kv[:, :, DIM:]
        e = q @ k.transpose(0, 2, 1)
        e += p["pos"] + self.mask
        _capped(e, 60)
        np.exp(e, out=e)
        o = (e @ v).reshape(-1, DIM + 1)
        inverse = 1 / np.maximum(o[:, DIM:], 1e-30)
        # hidden layer with a column of ones for the biases; rows by class, those of padding (class SIDE) left out at the end
        c = np.where(y == PAD, SIDE, y // SIDE).astype(np.uint8)
        order = np.argsort(c, kind="stable")
        cut = np.searchsorted(c[order], np.arange(SIDE + 1))
        order = order[: cut[SIDE]]
        before, y = ask.ravel()[order], y[order]
        mean = o[:, :DIM].take(order, axis=0)
        mean *= inverse.take(order, axis=0)
        h = np.concatenate([p["r"] + p["b1"], np.ones((IDS + 1, 1), kind)], axis=1).take(before, axis=0)
        h += mean @ np.concatenate([p["w1"], np.zeros((DIM, 1), kind)], axis=1)
        np.maximum(h, 0, out=h)
        both = self._both()
        share, dh, g_both = np.empty((len(h), 2 * SIDE), kind), np.empty_like(h), np.zeros_like(both)
        parts = [(j, slice(cut[j], cut[j + 1])) for j in range(SIDE) if cut[j] < cut[j + 1]]
        for j, at in parts:
            np.matmul(h[at], both[j], out=share[at])
        loss = _pick(share.reshape(-1, SIDE), np.stack([y // SIDE, y % SIDE], axis=1).ravel())
        for j, at in parts:
            np.matmul(h[at].T, share[at], out=g_both[j])
            np.matmul(share[at], both[j].T, out=dh[at])
        dh *= h > 0
        do = np.zeros((n * SPAN, DIM + 1), kind)
        d_mean = np.empty((len(h), DIM + 1), kind)
        np.matmul(dh, np.concatenate([p["w1"].T, np.zeros((1, DIM), kind)]), out=d_mean[:, :DIM])
        d_mean[:, DIM] = -np.einsum("ij,ij->i", d_mean[:, :DIM], mean)
        d_mean *= inverse.take(order, axis=0)
        do[order] = d_mean
        do = do.reshape(n, SPAN, DIM + 1)
        ds = do @ v.transpose(0, 2, 1)
        ds *= e
        seen = np.zeros((n, SEEN, 3 * DIM), kind)  # gradients of k, v and q by place
        np.matmul(ds.transpose(0, 2, 1), q, out=seen[:, :, :DIM])
        np.matmul(e.transpose(0, 2, 1), do[:, :, :DIM], out=seen[:, :, DIM : 2 * DIM])
        np.matmul(ds, k, out=seen[:, CONTEXT - 1 :, 2 * DIM :])
        r, seen = _by_id(before, dh)[:, :HIDDEN], _by_id(see.ravel(), seen.reshape(-1, 3 * DIM))
        g_class = g_both[:, :, :SIDE].sum(0)
        g = {
            "q": seen[:, 2 * DIM :] * scale,
            "k": seen[:, :DIM],
            "v": seen[:, DIM : 2 * DIM],
            "r": r,
            "pos": ds.reshape(n, SPAN * SEEN).sum(0).reshape(SPAN, SEEN),
            "w1": (mean.T @ dh)[:, :HIDDEN],
            "b1": r.sum(0),
            "wc": g_class[:HIDDEN],
            "bc": g_class[HIDDEN],
            "wm": g_both[:, :HIDDEN, SIDE:],
            "bm": g_both[:, HIDDEN, SIDE:],
        }
        return float(loss.sum()), len(h), {name: g[name] / max(1, len(h)) for name in self.NAMES}

    def train(self, x: np.ndarray, steps: int, rate: float, seed: int = 1) -> None:
        """Adam over random batches with a falling rate; batches go through all windows before any comes again."""
        rng, adam = np.random.default_rng(seed), Adam(self)
        order, at = rng.permutation(len(x)), 0
        for t in range(1, steps + 1):
            if at >= len(x):
                order, at = rng.permutation(len(x)), 0
            adam.step(x[order[at : at + BATCH]], rate * min(1, 2 * (1 - t / (steps + 1))))
            at += BATCH
        self.ready = None

    def train_once(self, parts: Iterable[np.ndarray], rate: float, seed: int = 1) -> int:
        """One pass over windows that come in parts, each window once; returns how many there were.

        As many windows as HELD are held and mixed at once. Nobody knows beforehand how many come, so the rate stays and
        the tables become means over all steps, in which a step counts by about the cube of its number.
        """
        rng, adam, seen = np.random.default_rng(seed), Adam(self), 0
        mean = adam.p.astype(np.float64)
        for x in held(parts):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                adam.step(x[order[at : at + BATCH]], rate, mean)
            seen += len(x)
        if seen:
            adam.p[:] = mean
        self.ready = None
        return seen


class Adam:
    """Steps over all tables as one vector, AT_ONCE numbers at a time, which stay in the cache."""

    def __init__(self, net: Network):
        self.net, self.t = net, 0
        self.p = np.concatenate([net.p[k].ravel() for k in net.NAMES])
        ends = np.cumsum([net.p[k].size for k in net.NAMES])
        net.p = {k: part.reshape(net.p[k].shape) for k, part in zip(net.NAMES, np.split(self.p, ends[:-1]), strict=True)}  # views
        self.m, self.v = np.zeros_like(self.p), np.zeros_like(self.p)
        self.spare, self.wide = np.empty((2, AT_ONCE), self.p.dtype), np.empty(AT_ONCE)

    def step(self, x: np.ndarray, rate: float, mean: np.ndarray | None = None) -> None:
        """One step; mean, if given, becomes the mean of the tables over all steps, in which a step counts by about the cube of its number."""
        self.t += 1
        _, _, g = self.net.gradients(x)
        spread = (1 - 0.99**self.t) ** 0.5
        grad, far = np.concatenate([g[k].ravel() for k in self.net.NAMES]), rate * spread / (1 - 0.9**self.t)
        for a in range(0, len(grad), AT_ONCE):
            at = slice(a, a + AT_ONCE)
            g, m, v, p = grad[at], self.m[at], self.v[at], self.p[at]
            step, root = self.spare[:, : len(g)]
            np.subtract(g, m, out=step)
            step *= 0.1
            m += step
            np.multiply(g, g, out=step)
            step -= v
            step *= 0.01
            v += step
            np.sqrt(v, out=root)
            root += 1e-8 * spread
            np.divide(m, root, out=step)
            step *= far
            p -= step
            if mean is not None:
                wide = self.wide[: len(g)]
                np.subtract(p, mean[at], out=wide)
                wide *= 4 / (self.t + 3)
                mean[at] += wide


def held(parts: Iterable[np.ndarray]) -> Iterator[np.ndarray]:
    """The windows of all parts, HELD at a time."""
    now, n = [], 0
    for x in parts:
        while len(x):
            now.append(x[: HELD - n])
            x, n = x[HELD - n :], n + len(now[-1])
            if n == HELD:
                yield np.concatenate(now)
                now, n = [], 0
    if n:
        yield np.concatenate(now)


def _by_id(ids: np.ndarray, grad: np.ndarray) -> np.ndarray:
    """Sums of gradient rows, of an even number of columns, by id."""
    out = np.zeros((IDS + 1, grad.shape[1]), grad.dtype)
    if len(ids):
        ids = ids.astype(np.int16)
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        pairs = grad.take(order, axis=0).view(np.result_type(grad, np.complex64))  # two columns at a time, as one complex number
        out[ids[first]] = np.add.reduceat(pairs, first, axis=0).view(grad.dtype)
    return out


def _capped(x: np.ndarray, most: float) -> None:
    """Nothing above most, so that exp stays finite; hardly ever is there anything to do."""
    if x.size and not x.max() <= most:
        np.minimum(x, most, out=x)


def _log_share(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log probability of the chosen column of each row."""
    _capped(logits, 80)
    chosen = logits.reshape(-1)[np.arange(len(at)) * SIDE + at]
    np.exp(logits, out=logits)
    return chosen - np.log(logits @ np.ones(SIDE, logits.dtype))


def _pick(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log probability of the chosen column of each row; the loss's gradient by the logits takes their place."""
    _capped(logits, 80)
    place = np.arange(len(at)) * SIDE + at
    flat = logits.reshape(-1)
    chosen = flat[place]
    np.exp(logits, out=logits)
    total = logits @ np.ones(SIDE, logits.dtype)
    logits *= (1 / total)[:, None]
    flat[place] -= 1
    return chosen - np.log(total)
