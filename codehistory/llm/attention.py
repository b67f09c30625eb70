"""Causal self-attention language model in numpy, on subword ids.

One block: embeddings, one head of causal attention with a learned bias for each distance,
a feed-forward layer, residuals, and a softmax in two levels (class of the next subword,
then the subword in its class), both of which see the hidden state. A text is cut into
windows that overlap: each window begins with the last OVERLAP subwords of the one before as
context and scores only what comes after, so every subword is scored once and sees from
OVERLAP to WINDOW - 1 subwords before it, or all that there are.

Every subword that the training documents hold has a number of its own. Their counts choose
the classes and set the output biases. Weights begin with a bounded sample; then every
partition of the corpus trains them on windows of all its texts, and the results are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

WIDTH, HIDDEN, WINDOW, OVERLAP = 16, 24, 64, 32
BATCH = 1024
#: Windows of a step of learning.
LEARNED = 64
#: Windows that are scored together, so that their scores stay in a core's cache, and how many such groups choose targets together.
CHUNKS, GROUPS = 64, 6
F32 = np.float32
#: Bound of a logit.
LOGIT = 40


@dataclass
class Vocabulary:
    """Own numbers of subwords. number[id] is its number; those without a count share `other`. Beyond them: end, other, begin of a text."""

    number: np.ndarray
    rare: np.ndarray
    size: int

    @property
    def begin(self) -> int:
        return self.size + 2

    @property
    def end(self) -> int:
        return self.size

    @property
    def other(self) -> int:
        return self.size + 1


def vocabulary(counts: np.ndarray) -> tuple[Vocabulary, np.ndarray]:
    """All subwords with a count, log10 probabilities of the others among themselves, and counts by own number (but for the end)."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    order = order[counts[order] > 0]
    number = np.full(len(counts), len(order) + 1)
    number[order] = np.arange(len(order))
    others = number == len(order) + 1
    rare = np.where(others, np.log10((counts + 0.5) / (counts[others].sum() + 0.5 * max(1, others.sum()))), 0.0)
    return Vocabulary(number, rare, len(order)), np.concatenate([counts[order], [0, counts[others].sum()]])


def windows(
    numbers: list[np.ndarray], v: Vocabulary, opens: np.ndarray | None = None, closes: np.ndarray | None = None, every: int = 1, batch: int = BATCH
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Batches of windows: inputs, targets, whether a target is scored, and the text of each window.

    A window has WINDOW inputs, -1 where the text has not begun, and a target for each of them after the first OVERLAP.
    Where a text does not open (close) a document, its first subword (end) is not scored. Of `every` windows one is taken,
    counted through all texts.
    """
    size = np.array([len(x) + 1 for x in numbers], np.int64)
    flat = np.concatenate([np.concatenate([x, [v.end]]) for x in numbers]) if len(numbers) else np.zeros(0, np.int64)
    first = np.cumsum(size) - size
    step = WINDOW - OVERLAP
    n = -(-size // step)
    doc = np.repeat(np.arange(len(size)), n)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * step
    doc, start = doc[::every], start[::every]
    for a in range(0, len(doc), batch):
        d, s = doc[a : a + batch], start[a : a + batch]
        last, begin = size[d][:, None] - 1, first[d][:, None]
        place = s[:, None] + np.arange(step)
        y = flat[np.minimum(place, last) + begin]
        seen = s[:, None] + np.arange(-OVERLAP, step)
        x = np.where(seen > 0, flat[np.clip(seen - 1, 0, last) + begin], np.where(seen == 0, v.begin, -1))
        on = place <= last
        if opens is not None:
            on &= opens[d][:, None] | (place > 0)
        if closes is not None:
            on &= closes[d][:, None] | (y != v.end)
        yield x, y, on, d


def _clip(x: np.ndarray) -> np.ndarray:
    """Bounded logits, in place: they are a few units, and a bound is cheaper than the maximum of each row."""
    return np.clip(x, -LOGIT, LOGIT, out=x)


class Model:
    """Weights, and what maps an own number to its class and place in it."""

    def __init__(self, counts: np.ndarray, group: np.ndarray, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        n, d = len(counts), WIDTH
        self.n_classes = int(group.max()) + 1
        self.group = group
        order = np.lexsort((np.arange(n), group))
        self.members = [order[group[order] == c] for c in range(self.n_classes)]
        self.slot = np.zeros(n, np.int64)
        self.first = np.zeros(self.n_classes + 1, np.int64)
        for c, m in enumerate(self.members):
            self.slot[m] = np.arange(len(m))
            self.first[c + 1] = self.first[c] + len(m)
        make = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(F32)
        share = np.log((counts + 0.5) / (counts + 0.5).sum()).astype(F32)
        class_share = np.array([np.logaddexp.reduce(share[m]) for m in self.members], F32)
        self.p: dict[str, np.ndarray] = {
            "E": (rng.standard_normal((n + 1, d)) * 0.3).astype(F32), "Q": make(d, d), "K": make(d, d), "V": make(d, d), "O": make(d, d) * F32(0.5),
            "R": (-0.15 * np.arange(WINDOW)).astype(F32), "A": make(d, HIDDEN), "a": np.zeros(HIDDEN, F32), "B": make(HIDDEN, d) * F32(0.5), "b": np.zeros(d, F32),
            "C": make(d, self.n_classes) * F32(0.3), "c": class_share, "W": make(d, n) * F32(0.3), "w": share[order].copy(),
        }
        self.order = order
        i, j = np.arange(OVERLAP, WINDOW), np.arange(WINDOW)
        self.lag = np.maximum(i[:, None] - j, 0)
        self.causal = (i[:, None] >= j).astype(F32)

    def hidden(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        p = self.p
        e = p["E"][x]
        own = e[:, OVERLAP:]
        q, k, u = own @ p["Q"], e @ p["K"], e @ p["V"]
        s = q @ k.transpose(0, 2, 1)
        s *= F32(WIDTH**-0.5)
        np.exp(_clip(s), out=s)
        s *= np.exp(p["R"])[self.lag] * self.causal
        early = np.flatnonzero(x[:, 0] < 0)
        s[early] *= (x[early] >= 0)[:, None, :]
        s /= s @ np.ones((WINDOW, 1), F32)
        t = s @ u
        h = own + t @ p["O"]
        f = h @ p["A"] + p["a"]
        np.maximum(f, 0, out=f)
        return h + f @ p["B"] + p["b"], (x, e, q, k, u, s, t, h, f)

    def score(self, x: np.ndarray, y: np.ndarray, on: np.ndarray) -> np.ndarray:
        """Natural log probabilities of the scored targets, in order."""
        z, _ = self.hidden(x)
        return self._targets(z[on], y[on])[0]

    def _targets(self, z: np.ndarray, y: np.ndarray, learn: bool = False) -> tuple[np.ndarray, dict | None, np.ndarray | None]:
        p = self.p
        g = self.group[y]
        e = _clip(z @ p["C"] + p["c"])
        at = np.arange(len(y))
        out = e[at, g]
        np.exp(e, out=e)
        total = e @ np.ones(e.shape[1], F32)
        out -= np.log(total)
        grads, dz = None, None
        if learn:
            e /= total[:, None]
            e[at, g] -= 1
            grads = {"C": z.T @ e, "c": e.sum(0), "W": np.zeros_like(p["W"]), "w": np.zeros_like(p["w"])}
            dz = e @ p["C"].T
        turn = np.argsort(g, kind="stable")
        edge = np.searchsorted(g[turn], np.arange(self.n_classes + 1))
        for c in range(self.n_classes):
            mine = turn[edge[c] : edge[c + 1]]
            a, b = self.first[c], self.first[c + 1]
            if not len(mine) or b - a == 1:
                continue
            zc = z[mine]
            logits = _clip(zc @ p["W"][:, a:b] + p["w"][a:b])
            s = self.slot[y[mine]]
            i = np.arange(len(mine))
            own = logits[i, s]
            np.exp(logits, out=logits)
            total = logits @ np.ones(b - a, F32)
            out[mine] += own - np.log(total)
            if learn:
                logits /= total[:, None]
                logits[i, s] -= 1
                grads["W"][:, a:b] = zc.T @ logits
                grads["w"][a:b] = logits.sum(0)
                dz[mine] += logits @ p["W"][:, a:b].T
        return out, grads, dz

    def gradients(self, x: np.ndarray, y: np.ndarray, on: np.ndarray) -> tuple[float, dict]:
        """Loss per scored target and its gradients."""
        p = self.p
        z, (x, e, q, k, u, s, t, h, f) = self.hidden(x)
        logp, g, dz_on = self._targets(z[on], y[on], learn=True)
        n = F32(max(1, len(logp)))
        dz = np.zeros_like(z)
        dz[on] = dz_on
        flat = lambda m: m.reshape(-1, m.shape[-1])
        g["B"], g["b"] = flat(f).T @ flat(dz), flat(dz).sum(0)
        df = (dz @ p["B"].T) * (f > 0)
        g["A"], g["a"] = flat(h).T @ flat(df), flat(df).sum(0)
        dh = dz + df @ p["A"].T
        g["O"] = flat(t).T @ flat(dh)
        dt = dh @ p["O"].T
        ds = dt @ u.transpose(0, 2, 1)
        du = s.transpose(0, 2, 1) @ dt
        ds = s * (ds - (ds * s).sum(-1, keepdims=True))
        g["R"] = np.bincount(self.lag.ravel(), weights=(ds.sum(0) * self.causal).ravel(), minlength=WINDOW).astype(F32)
        ds *= F32(WIDTH**-0.5)
        dq, dk = ds @ k, ds.transpose(0, 2, 1) @ q
        g["Q"], g["K"], g["V"] = flat(e[:, OVERLAP:]).T @ flat(dq), flat(e).T @ flat(dk), flat(e).T @ flat(du)
        de = dk @ p["K"].T + du @ p["V"].T
        de[:, OVERLAP:] += dh + dq @ p["Q"].T
        g["E"] = np.zeros_like(p["E"])
        at = x.ravel() % len(p["E"])
        turn = np.argsort(at, kind="stable")
        at = at[turn]
        edge = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        g["E"][at[edge]] = np.add.reduceat(flat(de)[turn], edge)
        return -float(logp.mean()) if len(logp) else 0.0, {k: v / n for k, v in g.items()}


def groups(before: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Classes of subwords that follow similar subwords: k-means on reduced counts (rows) of what stands before each.

    About as many classes as the root of the subwords; those of more subwords than that are split by frequency, so no softmax is wide.
    """
    left, n = before / np.maximum(before.sum(1, keepdims=True), 1), len(counts)
    classes = max(1, round(n**0.5))
    np.sqrt(left, out=left)
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(left @ rng.standard_normal((left.shape[1], 16)).astype(F32))
    for _ in range(3):
        q, _ = np.linalg.qr(left @ (left.T @ q))
    points = left @ (left.T @ q)
    points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)
    centres = points[np.argsort(-counts, kind="stable")[: max(1, 2 * classes // 3)]].copy()
    for _ in range(8):
        group = (points @ centres.T).argmax(1)
        for c in range(len(centres)):
            if (group == c).any():
                m = points[group == c].mean(0)
                centres[c] = m / max(np.linalg.norm(m), 1e-9)
    order = np.lexsort((-counts, group))
    first = np.searchsorted(group[order], group[order])
    part = np.empty(n, np.int64)
    part[order] = (np.arange(n) - first) // classes
    return np.unique(group * n + part, return_inverse=True)[1]


class Adam:
    """Steps of Adam on the weights of a model, with gradients clipped to a norm of 1."""

    def __init__(self, model: Model) -> None:
        self.model, self.i = model, 0
        self.m1 = {k: np.zeros_like(w) for k, w in model.p.items()}
        self.m2 = {k: np.zeros_like(w) for k, w in model.p.items()}

    def step(self, x: np.ndarray, y: np.ndarray, on: np.ndarray, rate: float) -> None:
        self.i += 1
        _, g = self.model.gradients(x, y, on)
        norm = np.sqrt(sum(float((d * d).sum()) for d in g.values()))
        less = F32(min(1.0, 1.0 / max(norm, 1e-9)))
        for k, w in self.model.p.items():
            self.m1[k] += F32(0.1) * (g[k] * less - self.m1[k])
            self.m2[k] += F32(0.01) * ((g[k] * less) ** 2 - self.m2[k])
            w -= F32(rate / (1 - 0.9**self.i)) * self.m1[k] / (np.sqrt(self.m2[k] / F32(1 - 0.99**self.i)) + F32(1e-8))


def train(sample: list[np.ndarray], v: Vocabulary, counts: np.ndarray, group: np.ndarray, opens: np.ndarray | None = None, closes: np.ndarray | None = None, rounds: int = 1200, seed: int = 11) -> Model:
    """First weights: Adam on batches of windows of a sample, in an order fixed by the seed."""
    model = Model(counts.astype(float), group)
    parts = list(windows(sample, v, opens, closes))
    if not parts:
        return model
    x, y, on = (np.concatenate([p[i] for p in parts]) for i in range(3))
    rng, adam = np.random.default_rng(seed), Adam(model)
    for i in range(1, rounds + 1):
        at = rng.integers(0, len(x), min(LEARNED, len(x)))
        adam.step(x[at], y[at], on[at], 0.012 * min(1, i / 50) * (0.05 + 0.95 * 0.5 * (1 + np.cos(np.pi * i / rounds))))
    return model


class Scorer:
    """Scores of whole texts, with the products of embeddings and weights worked out once for each subword.

    Texts stand one after the other in chunks of WINDOW - OVERLAP inputs. A window is a chunk
    and OVERLAP inputs before it, so windows are views and every product is made once.
    """

    def __init__(self, model: Model) -> None:
        p, self.model = model.p, model
        self.q, self.k = p["E"] @ p["Q"] * F32(WIDTH**-0.5), p["E"] @ p["K"]
        self.u = np.hstack([p["E"] @ p["V"] @ p["O"], np.ones((len(p["E"]), 1), F32)])
        self.mask = np.exp(p["R"])[model.lag] * model.causal
        longest = lambda m, axis: float(np.sqrt((m * m).sum(axis).max()))
        self.bounded = longest(self.q, 1) * longest(self.k, 1) <= LOGIT
        # no logit of a state shorter than this passes its bound
        self.short = (LOGIT - max(float(np.abs(p[k]).max()) for k in "cw")) / max(longest(p["C"], 0), longest(p["W"], 0), 1e-9)

    def _targets(self, z: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log probabilities of targets: of their classes, then in those, class by class."""
        p, m = self.model.p, self.model
        clip = (lambda x: x) if float(np.sqrt(np.einsum("ij,ij->i", z, z).max(initial=0))) <= self.short else _clip
        g = m.group[y].astype(np.int16)
        e = z @ p["C"]
        e += p["c"]
        clip(e)
        out = e[np.arange(len(y)), g]
        np.exp(e, out=e)
        out -= np.log(e @ np.ones(e.shape[1], F32))
        turn = np.argsort(g, kind="stable")
        edge = np.searchsorted(g[turn], np.arange(m.n_classes + 1))
        z, slot, inner = z.take(turn, 0), m.slot[y[turn]], np.zeros(len(y), F32)
        for c in np.flatnonzero((np.diff(edge) > 0) & (np.diff(m.first) > 1)).tolist():
            i, j, a, b = edge[c], edge[c + 1], m.first[c], m.first[c + 1]
            e = z[i:j] @ p["W"][:, a:b]
            e += p["w"][a:b]
            clip(e)
            own = e[np.arange(j - i), slot[i:j]]
            np.exp(e, out=e)
            inner[i:j] = own - np.log(e @ np.ones(b - a, F32))
        out[turn] += inner
        return out

    def __call__(self, flat: np.ndarray, size: np.ndarray, begin: int, chunks: int = CHUNKS) -> np.ndarray:
        """Natural log probabilities of all targets: own numbers of each text and its end, one text after the other."""
        p, step = self.model.p, WINDOW - OVERLAP
        n = -(-size // step)
        base, first = np.cumsum(n) - n, np.cumsum(size) - size
        rows = np.arange(len(flat)) + np.repeat(base * step - first, size) + OVERLAP
        total = int(n.sum())
        # OVERLAP inputs more in front, so that each chunk has as many before it
        x, y, on = np.full(total * step + OVERLAP, begin, np.int32), np.zeros(total * step + OVERLAP, np.int32), np.zeros(total * step + OVERLAP, bool)
        before = np.append(begin, flat[:-1])[: len(flat)]
        before[first] = begin
        x[rows], y[rows], on[rows] = before, flat, True
        y, on = y[OVERLAP:], on[OVERLAP:]
        # chunks of each text, counted from its begin
        place = np.arange(total) - np.repeat(base, n)
        out: list[np.ndarray] = []
        states: list[np.ndarray] = []
        last = 0
        for a in range(0, total, chunks):
            b = min(total, a + chunks)
            near = x[a * step : b * step + OVERLAP]
            own = near[OVERLAP:]
            view = lambda m: np.lib.stride_tricks.as_strided(m, (b - a, WINDOW, m.shape[1]), (step * m.strides[0], *m.strides))  # noqa: B023, E731
            s = self.q.take(own, 0).reshape(b - a, step, WIDTH) @ view(self.k.take(near, 0)).transpose(0, 2, 1)
            if not self.bounded:
                _clip(s)
            np.exp(s, out=s)
            s *= self.mask
            # what stands before a text is not seen
            for j in range(-(-OVERLAP // step)):
                s[place[a:b] == j, :, : OVERLAP - j * step] = 0
            t = (s @ view(self.u.take(near, 0))).reshape(-1, WIDTH + 1)
            h = t[:, :WIDTH] / t[:, WIDTH:]
            h += p["E"].take(own, 0)
            f = h @ p["A"] + p["a"]
            np.maximum(f, 0, out=f)
            z = f @ p["B"]
            z += h
            z += p["b"]
            states.append(z)
            if b - last >= GROUPS * chunks or b == total:
                asked = on[last * step : b * step]
                out.append(self._targets(np.concatenate(states)[asked], y[last * step : b * step][asked]))
                states, last = [], b
        return np.concatenate(out) if out else np.zeros(0, F32)


def score_each(model: Model, v: Vocabulary, ids: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each subword and the end of each text, given as subword ids, in order."""
    if not ids:
        return np.zeros(0)
    flat = np.concatenate([y for x in ids for y in (x, [len(v.rare)])]).astype(np.int64)
    return score_flat(Scorer(model), v, flat, np.array([len(x) + 1 for x in ids], np.int64))


def score_flat(scorer: Scorer, v: Vocabulary, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The same for texts that stand one after the other, each with its end (an id beyond all subwords)."""
    number, rare = np.append(v.number, v.end), np.append(v.rare, 0.0) * np.log(10)
    return scorer(number[flat], size, v.begin) + rare[flat]
