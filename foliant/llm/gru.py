"""A gated recurrent network over words in classes, in numpy.

Inputs are ids with a row each in a table that is already projected to the gates.  The output is
factored: a softmax over classes, and within a class one over its frequent words and the rest of
it, both from the network's state.  Lanes hold documents one after another, so that all lanes are
busy; they run side by side, window by window, and a lane's state is carried from one window to
the next until its document ends.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np

#: Steps through which errors are sent back.
WINDOW = 24
#: Documents that run side by side, at most; windows that an epoch has at least, if it can with LEAST lanes.
LANES, UPDATES, LEAST = 768, 300, 32
#: The bias of a word that a class does not have.
NEVER = -1e9
#: Rows whose outputs are worked out at a time, so that they stay in a core's cache.
BLOCK = 1024
#: Outputs up to this size have exponentials without a maximum taken off: their sums fit 32 bits.
SAFE = 60.0


@dataclass
class Gru:
    table: np.ndarray  # input id -> gates z, r, n
    u: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    inner: np.ndarray  # class -> state to words; word 0 stands for all that have no place of their own
    inner_bias: np.ndarray

    @staticmethod
    def new(inputs: int, hidden: int, bias: np.ndarray, inner_bias: np.ndarray, seed: int = 0) -> Gru:
        rng = np.random.default_rng(seed)
        draw = lambda *size: rng.normal(0, 0.2, size).astype(np.float32)
        model = Gru(draw(inputs, 3 * hidden), draw(hidden, 3 * hidden), draw(hidden, len(bias)), bias.astype(np.float32), np.zeros((len(bias), hidden, inner_bias.shape[1]), np.float32), inner_bias.astype(np.float32))
        model.table[:, :hidden] += 1.0  # keep the state at first
        return model

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, f.name).ravel() for f in fields(self)])

    def unflat(self, v: np.ndarray) -> Gru:
        """A network of this one's shapes."""
        parts, at = {}, 0
        for f in fields(self):
            old = getattr(self, f.name)
            parts[f.name] = v[at : at + old.size].reshape(old.shape).astype(np.float32)
            at += old.size
        return Gru(**parts)


class Room:
    """Arrays that windows use again and again, told by name."""

    def __init__(self, kind: np.dtype):
        self.kind, self.held = kind, {}

    def __call__(self, name: str, *shape: int) -> np.ndarray:
        """Of this shape, with any contents."""
        size = math.prod(shape)
        got = self.held.get(name)
        if got is None or len(got) < size:
            got = self.held[name] = np.empty(size, self.kind)
        return got[:size].reshape(shape)


def gates(v: np.ndarray) -> np.ndarray:
    """Columns z, r, n as three tables, so that what is done to a gate runs through memory in order."""
    return np.ascontiguousarray(v.reshape(len(v), 3, -1).transpose(1, 0, 2))


def forward(m: Gru, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, room: Room, keep: bool = False):
    """States after each step of a window: x is (steps, lanes), h the state before; ``fresh`` marks
    the first words of documents, whose state before is zero.  Results lie in ``room``."""
    steps, lanes = x.shape
    k = m.u.shape[0]
    states = room("states", steps, lanes, k)
    held = steps if keep else 1
    g, n, before = room("gates", held, 3, lanes, k), room("new", held, lanes, k), room("before", held, lanes, k)
    a = room("inputs", 3, lanes, k)
    # sigmoids are 1 / (1 + exp(-a)): the sign is taken to the weights
    table, u = gates(m.table), gates(m.u)
    table[:2] *= -1
    u[:2] *= -1
    starts = fresh.any(1)
    with np.errstate(over="ignore"):
        for t in range(steps):
            at = t if keep else 0
            if keep or starts[t]:
                before[at] = h
                h = before[at]
                if starts[t]:
                    h[fresh[t]] = 0
            table.take(x[t], 1, a, "clip")
            b, new, nn = g[at], states[t], n[at]
            np.matmul(h, u, out=b)
            zr = b[:2]
            zr += a[:2]
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            np.multiply(b[1], b[2], out=nn)
            nn += a[2]
            np.tanh(nn, out=nn)
            np.subtract(h, nn, out=new)
            new *= b[0]
            new += nn
            h = new
    return states, (before, g, n)


def log_softmax(o: np.ndarray) -> np.ndarray:
    """Along the first axis, in place."""
    o -= o.max(0)
    o -= np.log(np.exp(o).sum(0))
    return o


def class_logs(m: Gru, states: np.ndarray) -> np.ndarray:
    """Log probabilities (classes, rows)."""
    o = m.out.T @ states.reshape(-1, states.shape[-1]).T
    o += m.bias[:, None]
    return log_softmax(o)


def by_class(classes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows in order of their classes."""
    return rows[np.argsort(classes[rows].astype(np.uint8 if classes.max(initial=0) < 256 else np.int64), kind="stable")]


def inner_logs(m: Gru, k: int, states: np.ndarray) -> np.ndarray:
    """Log probabilities of a class's words (words, rows)."""
    o = m.inner[k].T @ states.T
    o += m.inner_bias[k][:, None]
    return log_softmax(o)


def unshifted(weights: np.ndarray, bias: np.ndarray, peak: float) -> bool:
    """Whether exponentials of all outputs stay far from the ends of their type, as states are
    ``peak`` at most; if so, a softmax needs no maximum."""
    return float((np.abs(weights).sum(-2) * peak + np.where(bias > NEVER / 2, np.abs(bias), 0)).max()) < SAFE


def picked(o: np.ndarray, at: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities of the outputs at flat places ``at``, one in a column of ``o``.  In ``o`` stays
    the gradient of their negative sum, but for the second result, which divides each column."""
    if not safe:
        o -= o.max(0)
    flat = o.reshape(-1)
    hit = flat[at]
    np.exp(o, out=o)
    total = o.sum(0)
    flat[at] -= total
    return hit - np.log(total), total


def outputs(m: Gru, s: np.ndarray, cls: np.ndarray, word: np.ndarray, peak: float, room: Room, grads: dict[str, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Log probability of each row's class and word, from states ``s`` in order of classes.  With
    ``grads`` those of the mean loss are added there, and the states' come second."""
    rows, (k, classes) = len(s), m.out.shape
    scale = 1 / max(1, rows) if grads is not None else 0.0
    out, bias = np.ascontiguousarray(m.out.T), m.bias[:, None]
    ds = room("ds", rows, k) if scale else None
    got = np.empty(rows)
    safe = unshifted(m.out, m.bias, peak)
    for a in range(0, rows, BLOCK):
        part = s[a : a + BLOCK]
        o = room("classes", classes, len(part))
        np.matmul(out, part.T, out=o)
        o += bias
        got[a : a + BLOCK], total = picked(o, cls[a : a + BLOCK] * len(part) + np.arange(len(part)), safe)
        if scale:
            share = scale / total
            grads["out"] += (o @ (part * share[:, None])).T
            grads["bias"] += o @ share
            back = ds[a : a + BLOCK]
            np.matmul(o.T, out, out=back)
            back *= share[:, None]
    own = (m.inner_bias[:, 1:] > NEVER / 2).any(1)
    having = np.flatnonzero(own[cls])
    if not len(having):
        return got, ds
    s, cls, word = s[having], cls[having], word[having]
    edges = np.searchsorted(cls, np.arange(classes + 1))
    runs = [(c, edges[c], edges[c + 1]) for c in np.flatnonzero(edges[1:] > edges[:-1]).tolist()]
    e = room("words", m.inner_bias.shape[1], len(having))
    inner = np.ascontiguousarray(m.inner.transpose(0, 2, 1))
    for c, a, z in runs:
        part = e[:, a:z]
        np.matmul(inner[c], s[a:z].T, out=part)
        part += m.inner_bias[c][:, None]
    p, total = picked(e, word * len(having) + np.arange(len(having)), unshifted(m.inner, m.inner_bias, peak))
    got[having] += p
    if scale:
        share = scale / total
        back, s = room("back", len(having), k), s * share[:, None]
        for c, a, z in runs:
            part = e[:, a:z]
            np.matmul(s[a:z].T, part.T, out=grads["inner"][c])
            np.matmul(part.T, inner[c], out=back[a:z])
            np.matmul(part, share[a:z], out=grads["inner_bias"][c])
        back *= share[:, None]
        ds[having] += back
    return got, ds


class Lanes:
    """Documents in lanes: the longest first, each to the lane that is shortest so far."""

    def __init__(self, lengths: np.ndarray, lanes: int | None = None):
        self.lengths = lengths
        self.starts = np.cumsum(lengths) - lengths
        lanes = max(1, min(lanes or LANES, len(lengths)))
        heap = [(0, k) for k in range(lanes)]
        held: list[list[int]] = [[] for _ in range(lanes)]
        for d in np.argsort(-lengths, kind="stable").tolist():
            n, k = heap[0]
            held[k].append(d)
            heapq.heapreplace(heap, (n + int(lengths[d]), k))
        # longest lanes first, so that those still running are the first ones
        held.sort(key=lambda own: -int(lengths[own].sum()) if own else 0)
        self.held = [np.array(own, np.int64) for own in held if own]
        self.totals = np.array([int(lengths[own].sum()) for own in self.held], np.int64)
        #: place in the flat arrays of each lane's tokens, and whether a document begins there
        self.order = [np.repeat(self.starts[own] - (np.cumsum(lengths[own]) - lengths[own]), lengths[own]) + np.arange(n) for own, n in zip(self.held, self.totals.tolist(), strict=True)]

    def windows(self, size: int = WINDOW, longest: int = WINDOW) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(lanes that run, places (steps, lanes), fresh)``; a place of -1 is before a lane's start.

        All lanes end together: the longest run alone at first, so that the last windows, whose
        lessons are best remembered, are those of most documents.  A window in which few lanes run
        has more steps, ``longest`` at most, and no more places than one of all lanes.
        """
        begins = np.zeros(int(self.lengths.sum()) + 1, bool)
        begins[self.starts] = True
        flat = np.concatenate(self.order) if self.order else np.zeros(0, np.int64)
        at = np.cumsum(self.totals) - self.totals
        most = end = int(self.totals.max(initial=0))
        cuts = []
        while end > 0:
            live = int(np.searchsorted(-self.totals, end - most, side="left"))
            steps = min(end, max(size, min(longest, size * len(self.totals) // live)))
            cuts.append((end - steps, steps, live))
            end -= steps
        for t, steps, live in reversed(cuts):
            step = t + np.arange(steps)[:, None] - (most - self.totals[:live])
            inside = step >= 0
            place = np.where(inside, flat[np.where(inside, at[:live] + step, 0)], -1)
            yield live, place, begins[place] & inside


def log_likelihood(m: Gru, lengths: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Natural log probability of each document, complete: of its classes ``y`` and of the words
    ``w`` in them.  Arrays are those of all documents one after another; none is empty."""
    got = np.zeros(len(x))
    lanes, room = Lanes(lengths), Room(m.u.dtype)
    h = np.zeros((len(lanes.held), m.u.shape[0]), m.u.dtype)
    for live, place, fresh in lanes.windows(longest=WINDOW * LANES):
        states, _ = forward(m, x[place], fresh, h[:live], room)
        h[:live] = states[-1]
        flat = place.ravel()
        cls = y[flat]
        order = by_class(cls, np.flatnonzero(flat >= 0))
        own = flat[order]
        s = states.reshape(-1, states.shape[-1]).take(order, 0)
        got[own] = outputs(m, s, cls[order].astype(np.int64), w[own].astype(np.int64), 1.0, room)[0]
    return np.add.reduceat(got, lanes.starts) if len(lengths) else np.zeros(0)


class Trainer:
    """Truncated backpropagation through time with Adam."""

    def __init__(self, model: Gru, rate: float):
        self.m, self.rate, self.step = model, rate, 0
        #: all weights one after another; the network's are views of them
        self.all = model.flat()
        self.first, self.second = np.zeros_like(self.all), np.zeros_like(self.all)
        self.shapes = {f.name: getattr(model, f.name).shape for f in fields(model)}
        self.room = Room(self.all.dtype)
        for k, v in self.views(self.all).items():
            setattr(model, k, v)

    def views(self, v: np.ndarray) -> dict[str, np.ndarray]:
        ends = np.cumsum([math.prod(s) for s in self.shapes.values()])
        return {k: part.reshape(s) for (k, s), part in zip(self.shapes.items(), np.split(v, ends[:-1]), strict=True)}

    def update(self, g: np.ndarray, share: float = 1.0) -> None:
        """A step, as long as the share of the lanes that the gradients ``g`` come from, which are spent."""
        self.step += 1
        a, b = 1 - 0.9**self.step, 1 - 0.99**self.step
        f, s, t = self.first, self.second, self.room("update", len(g))
        np.clip(g, -1, 1, out=g)
        f *= 0.9
        np.multiply(g, 0.1, out=t)
        f += t
        g *= g
        g *= 0.01
        s *= 0.99
        s += g
        # rate * (f / a) / (sqrt(s / b) + 1e-6)
        np.sqrt(s, out=t)
        t += 1e-6 * math.sqrt(b)
        np.divide(f, t, out=t)
        t *= self.rate * share * math.sqrt(b) / a
        self.all -= t

    def gradients(self, x: np.ndarray, fresh: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float, int]:
        """Gradients of a window, its last states, loss and tokens; y is -1 where nothing is."""
        g, last, loss, n = self._gradients(x, fresh, y, w, h)
        return self.views(g), last, loss, n

    def _gradients(self, x: np.ndarray, fresh: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, int]:
        """The same with all gradients one after another."""
        m, k, room = self.m, self.m.u.shape[0], self.room
        peak = max(1.0, float(np.abs(h).max(initial=0)))
        states, (before, g, nn) = forward(m, x, fresh, h, room, keep=True)
        flat = y.ravel()
        order = by_class(flat, np.flatnonzero(flat >= 0))
        every = np.zeros_like(self.all)
        grads = self.views(every)
        got, ds = outputs(m, states.reshape(-1, k).take(order, 0), flat[order].astype(np.int64), w.ravel()[order].astype(np.int64), peak, room, grads)
        dstates = room("dstates", *states.shape)
        dstates.fill(0)
        dstates.reshape(-1, k)[order] = ds
        # what an error of a new state is times to be one of z, r, n as the state's share sees it, and n
        p, one = room("factors", len(x), 4, *h.shape), room("one", *states.shape)
        z, r, c = g[:, 0], g[:, 1], g[:, 2]
        pz, pr, pc, pn = (p[:, i] for i in range(4))
        np.subtract(1, z, out=one)
        np.multiply(nn, nn, out=pn)
        np.subtract(1, pn, out=pn)
        pn *= one
        np.subtract(before, nn, out=pz)
        pz *= z
        pz *= one
        np.multiply(pn, r, out=pc)
        np.subtract(1, r, out=pr)
        pr *= pc
        pr *= c
        ut = np.ascontiguousarray(gates(m.u).transpose(0, 2, 1))
        dh, sent = np.zeros_like(h), room("sent", 3, *h.shape)
        starts = fresh.any(1)
        for t in range(len(x) - 1, -1, -1):
            dh += dstates[t]
            a = p[t]
            a *= dh
            np.matmul(a[:3], ut, out=sent)
            dh *= z[t]
            dh += sent[0]
            dh += sent[1]
            dh += sent[2]
            if starts[t]:
                dh[fresh[t]] = 0
        grads["u"][:] = (before.transpose(0, 2, 1)[:, None] @ p[:, :3]).sum(0).transpose(1, 0, 2).reshape(k, 3 * k)
        ids = x.ravel()
        order = np.argsort(ids.astype(np.uint16), kind="stable") if len(m.table) < 65_536 else np.argsort(ids, kind="stable")
        ids = ids[order]
        begin = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        dx = room("dx", len(ids), 3, k)
        for i, v in enumerate((pz, pr, pn)):
            dx.reshape(*x.shape, 3, k)[:, :, i] = v
        grads["table"][ids[begin]] = np.add.reduceat(dx.reshape(-1, 3 * k).take(order, 0), begin, axis=0)
        return every, states[-1], -float(got.sum()), len(got)

    def epoch(self, lengths: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, int]:
        """One pass over documents; loss (natural) and number of tokens."""
        total, tokens = 0.0, 0
        lanes = Lanes(lengths, min(LANES, max(LEAST, int(lengths.sum()) // (WINDOW * UPDATES))))
        h = np.zeros((len(lanes.held), self.m.u.shape[0]), self.m.u.dtype)
        for live, place, fresh in lanes.windows():
            inside = place >= 0
            g, h[:live], loss, n = self._gradients(np.where(inside, x[place], 0), fresh, np.where(inside, y[place], -1), w[place], h[:live])
            self.update(g, n / (len(h) * WINDOW))
            total, tokens = total + loss, tokens + n
        return total, tokens
