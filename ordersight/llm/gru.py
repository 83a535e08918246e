"""A gated recurrent language model in numpy, with a class-factored output.

``P(token) = P(class | state) * P(member | class, state)``. A frequent word is
one of ``members`` in one of ``classes`` groups of like frequency, with a
softmax over the group. The other words fall into ``buckets`` (by their last
bytes): a bucket is a class of its own, and its words share its probability by
their corpus counts, which the caller adds.

Documents run in parallel lanes, longest first. Windows of ``window`` steps are
the reach of the truncated backpropagation; the state is carried from window to
window and starts anew with each document, so a whole document is scored with
one state, however long it is.
"""

from __future__ import annotations

import heapq

import numpy as np

#: Chosen by held-out score, see the README.
CLASSES, MEMBERS, BUCKETS, HIDDEN = 64, 64, 64, 32
WORDS = CLASSES * MEMBERS
START = WORDS + BUCKETS
_SHAPES = {"wx": (START + 1, 3 * HIDDEN), "bx": (3 * HIDDEN,), "u": (HIDDEN, 3 * HIDDEN),
           "wc": (HIDDEN, CLASSES + BUCKETS), "bc": (CLASSES + BUCKETS,),
           "ws": (CLASSES, HIDDEN, MEMBERS), "bs": (CLASSES, MEMBERS)}
_ENDS = np.cumsum([0, *(int(np.prod(s)) for s in _SHAPES.values())]).tolist()
SIZE = _ENDS[-1]


def views(flat: np.ndarray) -> dict[str, np.ndarray]:
    """The named parameters, as views of one flat vector."""
    return {name: flat[a:b].reshape(shape) for (name, shape), a, b in zip(_SHAPES.items(), _ENDS, _ENDS[1:], strict=False)}


def start(n_words: int, class_share: np.ndarray, member_share: np.ndarray, seed: int = 5) -> np.ndarray:
    """First parameters: output biases from corpus shares, unused members out of reach."""
    r = np.random.default_rng(seed)
    flat = (r.normal(size=SIZE) * 0.1).astype(np.float32)
    p = views(flat)
    p["bx"][:] = 0
    p["bc"][:] = np.log(np.maximum(class_share, 1e-9))
    p["bs"][:] = np.log(np.maximum(member_share, 1e-9)).reshape(CLASSES, MEMBERS)
    p["bs"].reshape(-1)[n_words:] = -30
    return flat


def lanes(lengths: list[int], n: int) -> list[list[int]]:
    """Documents dealt to ``n`` lanes, longest first, to the lane with the fewest tokens; longest lane first."""
    heap = [(0, k) for k in range(n)]
    out: list[list[int]] = [[] for _ in range(n)]
    for d in sorted(range(len(lengths)), key=lambda d: -lengths[d]):
        held, k = heapq.heappop(heap)
        out[k].append(d)
        heapq.heappush(heap, (held + lengths[d], k))
    return sorted((x for x in out if x), key=lambda x: -sum(lengths[d] for d in x))


class Streams:
    """Documents in ``n`` lanes, as windows of (steps, lanes).

    The tokens stand lane after lane in flat arrays, so that memory goes with the tokens, however much longer
    one lane is than the others; a window is gathered when its turn comes.
    """

    def __init__(self, docs: list[np.ndarray], n: int):
        dealt = lanes([len(d) for d in docs], n)
        self.length = np.array([sum(len(docs[d]) for d in x) for x in dealt])
        self.first = np.cumsum(np.r_[0, self.length[:-1]])
        order = [d for x in dealt for d in x]
        self.targets = np.concatenate([docs[d] for d in order]).astype(np.int32)
        sizes = np.array([len(docs[d]) for d in order])
        self.owner = np.repeat(np.array(order, dtype=np.int32), sizes)
        self.inputs = np.r_[np.int32(START), self.targets[:-1]]
        self.inputs[np.cumsum(np.r_[0, sizes[:-1]])] = START

    def windows(self, window: int):
        """``(inputs, targets, owner)`` of each window, of the lanes that go on: the first ones.

        The input of a document's first step is START; ``owner`` is the document of the target, -1 after a lane's end.
        """
        steps = int(self.length[0])
        for at in range(0, steps, window):
            n = int((self.length > at).sum())
            step = np.arange(at, min(at + window, steps))[:, None]
            inside = step < self.length[:n]
            where = np.where(inside, self.first[:n] + step, 0)
            yield (np.where(inside, self.inputs[where], np.int32(START)), np.where(inside, self.targets[where], np.int32(0)),
                   np.where(inside, self.owner[where], np.int32(-1)))


def streams(docs: list[np.ndarray], n: int):
    """All steps of the lanes as one window, and the length of each lane."""
    lane = Streams(docs, n)
    return *next(lane.windows(int(lane.length[0]))), lane.length


def _run(p: dict, x: np.ndarray, h: np.ndarray):
    """States after each step of a window, and what the way back needs; ``h`` is (features, lanes).

    Arrays are (steps, lanes, features), with the three gates as blocks of their own, so that no step works on
    parts of rows and the output layers get the states as they are.
    """
    steps, n = x.shape
    hs, before, inner = (np.empty((steps, n, HIDDEN), dtype=np.float32) for _ in range(3))
    xt = p["wx"][x]
    xt += p["bx"]
    gates = np.ascontiguousarray(xt.reshape(steps, n, 3, HIDDEN).transpose(0, 2, 1, 3))  # update, reset, new state
    u, a = _by_gate(p["u"]), np.empty((3, n, HIDDEN), dtype=np.float32)
    h, carry = np.ascontiguousarray(h.T), (x != START).astype(np.float32)[:, :, None]
    with np.errstate(over="ignore"):  # 1 / (1 + inf) is the limit
        for t in range(steps):
            np.multiply(h, carry[t], out=before[t])
            np.matmul(before[t], u, out=a)
            z, r, m = g = gates[t]
            zr = g[:2]
            zr += a[:2]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            inner[t] = a[2]
            m += np.multiply(r, a[2], out=a[2])
            m *= 2  # tanh(m) is 1 - 2 / (1 + exp(2 m))
            np.exp(m, out=m)
            m += 1
            np.divide(-2, m, out=m)
            m += 1
            h = np.subtract(before[t], m, out=hs[t])
            h *= z
            h += m
    return hs, gates, before, inner


def _by_gate(u: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(u.reshape(HIDDEN, 3, HIDDEN).transpose(1, 0, 2))


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Where each value of sorted keys begins."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])


def _order(y: np.ndarray) -> np.ndarray:
    """Positions sorted by token, and so by class; 16 bits make it a radix sort."""
    return np.argsort(y.astype(np.uint16), kind="stable")


def _classes(y: np.ndarray) -> np.ndarray:
    return np.where(y < WORDS, y // MEMBERS, y - WORDS + CLASSES)


def _cuts(c: np.ndarray) -> list[tuple[int, int, int]]:
    """``(class, first, end)`` of the word classes that occur in sorted classes."""
    at = np.searchsorted(c, np.arange(CLASSES + 1)).tolist()
    return [(k, i, j) for k, (i, j) in enumerate(zip(at, at[1:], strict=False)) if i < j]


#: Logits and biases up to this have exponentials, and products and sums of these, that 32 bits hold.
_TAME = 35


def _tame(w: np.ndarray, b: np.ndarray) -> bool:
    """Whether no state, whose values lie in -1 to 1, can get a logit out of bounds; the inputs are along axis -2."""
    return bool(np.abs(w).sum(axis=-2).max(initial=0) < _TAME and np.abs(b).max(initial=0) < _TAME)


def _exponentials(v: np.ndarray, bias: np.ndarray, blocks: list[tuple[int, int, int]], at: np.ndarray, tame: bool):
    """Softmax of the logits ``v`` (overwritten) plus ``bias[k]`` for the rows of each block ``(k, first, end)``.

    Returns the log-probability of column ``at`` of each row, exponentials ``e``, their factors ``f[k]`` and sums
    ``total``, so that the probabilities are ``e * f[k] / total``. Tame logits need no maximum taken off.
    """
    if not tame:
        for k, i, j in blocks:
            v[i:j] += bias[k]
        v -= v.max(axis=1, keepdims=True)
        bias = np.zeros_like(bias)
    chosen = v[np.arange(len(v)), at]
    chosen += bias[np.repeat([k for k, _, _ in blocks], [j - i for _, i, j in blocks]), at]
    np.exp(v, out=v)
    factor, total = np.exp(bias), np.empty(len(v), dtype=np.float32)
    for k, i, j in blocks:
        np.matmul(v[i:j], factor[k], out=total[i:j])
    return chosen - np.log(total), v, factor, total


def _members(f: np.ndarray, p: dict, cuts: list, at: np.ndarray, tame: bool):
    """``_exponentials`` of the members of the classes, for rows sorted by class."""
    v = np.empty((len(f), MEMBERS), dtype=np.float32)
    for k, i, j in cuts:
        np.matmul(f[i:j], p["ws"][k], out=v[i:j])
    return _exponentials(v, p["bs"], cuts, at, tame)


def log_likelihood(flat: np.ndarray, docs: list[np.ndarray], window: int = 32, width: int = 512) -> np.ndarray:
    """Natural log-likelihood of each document (its classes, and members of the word classes)."""
    out = np.zeros(len(docs))
    if not docs:
        return out
    p = views(flat)
    tame = _tame(p["wc"], p["bc"]), _tame(p["ws"], p["bs"])
    _keep_heap()
    lane = Streams(docs, width)
    h = np.zeros((HIDDEN, len(lane.length)), dtype=np.float32)
    for inputs, targets, owner in lane.windows(window):
        hs, *_ = _run(p, inputs, h[:, :inputs.shape[1]])
        h = hs[-1].T
        order = _order(targets.ravel())
        f, y, who = hs.reshape(-1, HIDDEN)[order], targets.ravel()[order], owner.ravel()[order]
        c = _classes(y)
        cuts = _cuts(c)
        words = cuts[-1][2] if cuts else 0
        got = np.empty(len(y), dtype=np.float32)
        for i in range(0, len(y), _ROWS):
            some = f[i:i + _ROWS]
            got[i:i + _ROWS] = _exponentials(some @ p["wc"], p["bc"][None], [(0, 0, len(some))], c[i:i + _ROWS], tame[0])[0]
        if words:
            got[:words] += _members(f[:words], p, cuts, y[:words] % MEMBERS, tame[1])[0]
        real = who >= 0
        out += np.bincount(who[real], weights=got[real], minlength=len(docs))
    return out


def _keep_heap() -> None:
    """Lets the C library keep the memory of freed arrays for the next window's; else each window's pages are made anew.

    It keeps for reuse what is smaller than the largest block it has got back from the system, which this one is.
    """
    np.empty(7_000_000, dtype=np.float32)


#: Rows whose exponentials over all classes stay in a core's cache.
_ROWS = 2048


def gradient(flat: np.ndarray, x: np.ndarray, y: np.ndarray, real: np.ndarray, h: np.ndarray):
    """Mean log-loss of a window, its gradient and the last states.

    The probabilities ``e * factor / total`` are never made: their factors go to the smaller sides of the products.
    """
    p, grad = views(flat), np.zeros(SIZE, dtype=np.float32)
    g = views(grad)
    hs, gates, before, inner = _run(p, x, h)
    steps, n = x.shape
    order = _order(y.ravel())
    f, yy, live = hs.reshape(-1, HIDDEN)[order], y.ravel()[order], real.ravel()[order].astype(np.float32)
    scale = live / max(1.0, float(live.sum()))
    c = _classes(yy)
    cuts = _cuts(c)
    words = cuts[-1][2] if cuts else 0
    weighed = f * scale[:, None]

    logp, e, factor, total = _exponentials(f @ p["wc"], p["bc"][None], [(0, 0, len(f))], c, _tame(p["wc"], p["bc"]))
    loss, part, factor = -float(logp @ scale), scale / total, factor[0]
    first = _firsts(c)
    g["wc"][:] = (f * part[:, None]).T @ e
    g["wc"][:] *= factor
    g["wc"][:, c[first]] -= np.add.reduceat(weighed, first, axis=0).T
    g["bc"][:] = factor * (part @ e)
    g["bc"][c[first]] -= np.add.reduceat(scale, first)
    d = e @ (p["wc"] * factor).T
    d *= part[:, None]
    d -= scale[:, None] * p["wc"].T[c]

    if words:
        seen, member = [k for k, _, _ in cuts], yy[:words] % MEMBERS
        logp, e, factor, total = _members(f[:words], p, cuts, member, _tame(p["ws"][seen], p["bs"][seen]))
        loss -= float(logp @ scale[:words])
        part = scale[:words] / total
        shared, back = f[:words] * part[:, None], np.empty((words, HIDDEN), dtype=np.float32)
        wf = (p["ws"][seen] * factor[seen, None]).transpose(0, 2, 1)
        made, sums = np.empty((len(seen), HIDDEN, MEMBERS), dtype=np.float32), np.empty((len(seen), MEMBERS), dtype=np.float32)
        for q, (_, i, j) in enumerate(cuts):
            own = e[i:j]
            np.matmul(shared[i:j].T, own, out=made[q])
            np.matmul(part[i:j], own, out=sums[q])
            np.matmul(own, wf[q], out=back[i:j])
        made *= factor[seen, None]
        sums *= factor[seen]
        g["ws"][seen], g["bs"][seen] = made, sums
        back *= part[:, None]
        d[:words] += back
        first = _firsts(yy[:words])
        g["ws"][c[first], :, member[first]] -= np.add.reduceat(weighed[:words], first, axis=0)
        g["bs"][c[first], member[first]] -= np.add.reduceat(scale[:words], first)
        d[:words] -= scale[:words, None] * p["ws"][c[:words], :, member]

    dh = np.empty_like(d)
    dh[order] = d
    dh = dh.reshape(steps, n, HIDDEN)
    z, r, m = gates.transpose(1, 0, 2, 3)
    of_update, of_reset, of_new = (1 - z) * (before - m), r * (1 - r) * inner, 1 - m * m
    # of the update gate, the reset gate, the new state's part from the state, and the new state
    ways, ut = np.empty((4, steps, n, HIDDEN), dtype=np.float32), np.ascontiguousarray(_by_gate(p["u"]).transpose(0, 2, 1))
    back, carry = np.zeros((n, HIDDEN), dtype=np.float32), (x != START).astype(np.float32)[:, :, None]
    a = np.empty((3, n, HIDDEN), dtype=np.float32)
    for t in range(steps - 1, -1, -1):
        through = dh[t]
        through += back
        keep = through * z[t]
        through -= keep
        dm = np.multiply(through, of_new[t], out=ways[3, t])
        np.multiply(keep, of_update[t], out=ways[0, t])
        np.multiply(dm, of_reset[t], out=ways[1, t])
        np.multiply(dm, r[t], out=ways[2, t])
        np.matmul(ways[:3, t], ut, out=a)
        back = keep
        for part in a:
            back += part
        back *= carry[t]  # the state before a document's first step is no parameter's doing
    ways = ways.reshape(4, -1, HIDDEN)
    order = _order(x.ravel())
    ids = x.ravel()[order]
    first = _firsts(ids)
    dx = np.empty((steps * n, 3 * HIDDEN), dtype=np.float32)
    for k, way in enumerate((0, 1, 3)):
        own = slice(k * HIDDEN, (k + 1) * HIDDEN)
        g["u"][:, own] = before.reshape(-1, HIDDEN).T @ ways[k]
        dx[:, own] = ways[way][order]
    rows = np.add.reduceat(dx, first, axis=0)
    g["bx"][:] = rows.sum(axis=0)
    g["wx"][ids[first]] = rows
    return loss, grad, hs[-1].T


def _step(flat: np.ndarray, square: np.ndarray, grad: np.ndarray, inputs: np.ndarray, targets: np.ndarray,
          share: float, rate: float) -> None:
    """One step of AdaGrad in place, over the parameters that the window's tokens have a part in; the others have no gradient."""
    p, s, g = views(flat), views(square), views(grad)
    met = np.zeros(START + 1, dtype=bool)
    met[inputs] = True
    classes = np.zeros(CLASSES + BUCKETS, dtype=bool)
    classes[_classes(targets)] = True
    at = {"wx": np.flatnonzero(met), "ws": np.flatnonzero(classes[:CLASSES])}
    at["bs"] = at["ws"]
    every = slice(None)
    parts = [(name, at.get(name, every), g[name][at.get(name, every)] * np.float32(share)) for name in g]
    norm = float(np.sqrt(sum(float(np.vdot(x, x)) for _, _, x in parts)))
    for name, own, x in parts:
        if norm > 1:
            x /= norm
        total = s[name][own] + x * x
        s[name][own] = total
        np.sqrt(total, out=total)
        x *= rate
        x /= total
        p[name][own] -= x


def train(flat: np.ndarray, square: np.ndarray, docs: list[np.ndarray], window: int = 16, width: int = 256,
          rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """One pass of truncated backpropagation with AdaGrad over the documents; new parameters and sums of squares.

    A document is one lane's from its first token to its last, as in scoring: its state is carried over all windows.
    A window's gradient counts by its share of lanes that go on, so that each token weighs the same and the last
    lanes' long documents don't steer the model.
    """
    flat, square = flat.copy(), square.copy()
    if not docs:
        return flat, square
    _keep_heap()
    lane = Streams(docs, width)
    h = np.zeros((HIDDEN, len(lane.length)), dtype=np.float32)
    for inputs, targets, owner in lane.windows(window):
        _, grad, h = gradient(flat, inputs, targets, owner >= 0, h[:, :inputs.shape[1]])
        _step(flat, square, grad, inputs, targets, inputs.shape[1] / len(lane.length), rate)
    return flat, square
