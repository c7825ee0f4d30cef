"""A gated recurrent language model in numpy: truncated backpropagation and a class-factored softmax.

Words of a shortlist fall into classes of equal size by frequency; all other words fall into rare classes by
their last characters. P(word) = P(class | state) * P(word | class, state) for shortlist words; within a rare
class the words keep their corpus frequencies, so P(word | class) needs no weights.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np

#: Width of states and embeddings, words of a shortlist class, shortlist classes, rare classes.
WIDTH = 16
CLASS_WORDS = 64
CLASSES = 32
RARE = 32
SHORT = CLASS_WORDS * CLASSES
#: Steps that gradients go back, lanes in training and in scoring.
WINDOW = 32
TRAIN_LANES = 128
SCORE_LANES = 512
RATE = 0.01
#: No chance counts as less.
LEAST = 1e-37
NAMES = ("emb", "wx", "wh", "b", "wc", "bc", "ww", "bw")


def shapes() -> dict[str, tuple[int, ...]]:
    h = WIDTH
    return {"emb": (SHORT + RARE, h), "wx": (h, 3 * h), "wh": (h, 3 * h), "b": (3 * h,), "wc": (h, CLASSES + RARE), "bc": (CLASSES + RARE,), "ww": (SHORT, h), "bw": (SHORT,)}


def initial(word_weight: np.ndarray, class_weight: np.ndarray, seed: int = 1) -> dict[str, np.ndarray]:
    """Small seeded weights; biases give the corpus's frequencies. Unused shortlist places get next to no chance."""
    rng = np.random.default_rng(seed)
    p = {k: np.zeros(s, np.float32) for k, s in shapes().items()}
    for k in ("emb", "wx", "wh"):
        p[k] = rng.normal(0, 0.25, p[k].shape).astype(np.float32)
    p["bw"][:] = -30
    p["bw"][: len(word_weight)] = np.log(word_weight)
    p["bc"][:] = np.log(np.maximum(class_weight, 1e-9) / max(class_weight.sum(), 1e-9))
    return p


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in NAMES])


def unflat(v: np.ndarray) -> dict[str, np.ndarray]:
    """The parameters as views of one vector."""
    out, at = {}, 0
    v = np.ascontiguousarray(v)
    for k, s in shapes().items():
        n = int(np.prod(s))
        out[k] = v[at : at + n].reshape(s)
        at += n
    return out


@dataclass
class Lanes:
    """Documents laid one behind another on lanes of about equal length, longest lane first."""

    target: np.ndarray  # (steps, lanes) positions in the joined tokens, -1 where a lane has ended
    active: np.ndarray  # lanes that have not ended, by step
    fresh: np.ndarray  # (steps, lanes) whether a document begins
    n: int = field(default=0)


def lay(sizes: np.ndarray, lanes: int) -> Lanes:
    lanes = max(1, min(lanes, len(sizes)))
    heap = [(0, k) for k in range(lanes)]
    docs: list[list[int]] = [[] for _ in range(lanes)]
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, k = heapq.heappop(heap)
        docs[k].append(i)
        heapq.heappush(heap, (size + int(sizes[i]), k))
    ends = np.cumsum(sizes)
    load = np.zeros(lanes, np.int64)
    for size, k in heap:
        load[k] = size
    order = np.argsort(-load, kind="stable")
    steps = int(load.max(initial=0))
    target = np.full((steps, lanes), -1, np.int32)
    fresh = np.zeros((steps, lanes), bool)
    for column, k in enumerate(order.tolist()):
        if docs[k]:
            d = np.array(docs[k])
            n = sizes[d]
            at = np.cumsum(n) - n
            target[: load[k], column] = np.repeat(ends[d] - n - at, n) + np.arange(load[k])
            fresh[at[n > 0], column] = True
    active = np.searchsorted(-load[order], -np.arange(steps), "left")
    return Lanes(target, active, fresh, lanes)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def _softmax(x: np.ndarray, above: float) -> np.ndarray:
    """Each row's exponentials below a bound on all entries, over their sum; in place."""
    x -= above
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], np.float32)
    x /= total[:, None]
    return x


def _chances(states: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """softmax(states @ w + b) by row.

    States lie within -1 and 1, so column sums of |w| bound the logits from both sides: one shift for all rows
    does where no row can lose all its entries to it; else each row has its own.
    """
    x = states @ w
    x += b
    reach = np.abs(w).sum(0)
    above, sure = float((b + reach).max()), float((b - reach).max())
    if above - sure > 60:
        x -= x.max(1, keepdims=True)
        above = 0.0
    return _softmax(x, above)


def classes_of(symbols: np.ndarray) -> np.ndarray:
    """Classes of symbols: shortlist places 0..SHORT-1, and SHORT + r for rare class r."""
    return np.where(symbols < SHORT, symbols // CLASS_WORDS, symbols - SHORT + CLASSES)


def _by_class(symbols: np.ndarray):
    """(class, positions) of the shortlist symbols."""
    short = np.flatnonzero(symbols < SHORT)
    k = (symbols[short] // CLASS_WORDS).astype(np.uint8)  # sorted by radix
    order = np.argsort(k, kind="stable")
    cuts = np.searchsorted(k[order], np.arange(CLASSES + 1))
    for c in range(CLASSES):
        if cuts[c] < cuts[c + 1]:
            yield c, short[order[cuts[c] : cuts[c + 1]]]


def _run(p: dict[str, np.ndarray], xw: np.ndarray, prev: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool):
    """States after each step of a window; with keep, what going back needs."""
    steps, n = prev.shape
    w = WIDTH
    hs = np.empty((steps, n, w), np.float32)
    kept = []
    begins = fresh.any(1)
    for t in range(steps):
        old = h * ~fresh[t][:, None] if begins[t] else h
        x = xw[prev[t]]
        g = old @ p["wh"]
        rz = x[:, : 2 * w]
        rz += g[:, : 2 * w]
        _sigmoid(rz)
        r, z = rz[:, :w], rz[:, w:]
        new = r * g[:, 2 * w :]
        new += x[:, 2 * w :]
        np.tanh(new, out=new)
        h = old - new
        if keep:
            kept.append((old, r, z, new, g[:, 2 * w :], h.copy()))
        h *= z
        h += new
        hs[t] = h
    return hs, h, kept


def score(p: dict[str, np.ndarray], symbols: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """log P of each token (natural; rare ones up to their class), each document from a zero state.

    State is carried from window to window, so a document is scored as a whole however long it is.
    """
    out = np.zeros(len(symbols), np.float64)
    if not len(symbols):
        return out
    before = np.concatenate([[end], symbols[:-1]]).astype(symbols.dtype)
    lanes = lay(sizes, SCORE_LANES)
    xw = p["emb"] @ p["wx"] + p["b"]
    h = np.zeros((lanes.n, WIDTH), np.float32)
    for a in range(0, len(lanes.target), WINDOW):
        n = int(lanes.active[a])
        target = lanes.target[a : a + WINDOW, :n]
        fresh = lanes.fresh[a : a + WINDOW, :n]
        there = target >= 0
        prev = np.where(fresh, end, before[np.maximum(target, 0)])
        hs, h, _ = _run(p, xw, prev, fresh, h[:n], False)
        at = target[there]
        out[at] = token_log(p, hs[there], symbols[at])
    return out


def token_log(p: dict[str, np.ndarray], hs: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    q = _chances(hs, p["wc"], p["bc"])
    got = q[np.arange(len(symbols)), classes_of(symbols)].astype(np.float64)
    for c, at in _by_class(symbols):
        words = slice(c * CLASS_WORDS, (c + 1) * CLASS_WORDS)
        q = _chances(hs[at], p["ww"][words].T, p["bw"][words])
        got[at] *= q[np.arange(len(at)), symbols[at] - c * CLASS_WORDS]
    return np.log(np.maximum(got, LEAST))


def gradients(p: dict[str, np.ndarray], prev: np.ndarray, fresh: np.ndarray, want: np.ndarray, there: np.ndarray, h: np.ndarray):
    """Mean loss over the tokens there, its gradients, and the state after the window; nothing goes back before it."""
    w = WIDTH
    xw = p["emb"] @ p["wx"] + p["b"]
    hs, last, kept = _run(p, xw, prev, fresh, h, True)
    n = max(1, int(there.sum()))
    whole = bool(there.all())
    flat_h, symbols = (hs.reshape(-1, w), want.ravel()) if whole else (hs[there], want[there])
    g = unflat(np.zeros(sum(v.size for v in p.values()), hs.dtype))
    d = _chances(flat_h, p["wc"], p["bc"])
    rows, k = np.arange(len(symbols)), classes_of(symbols)
    loss = -float(np.log(np.maximum(d[rows, k], LEAST)).sum())
    d[rows, k] -= 1
    d /= n
    np.matmul(flat_h.T, d, out=g["wc"])
    d.sum(0, out=g["bc"])
    dh = d @ p["wc"].T
    for c, at in _by_class(symbols):
        words = slice(c * CLASS_WORDS, (c + 1) * CLASS_WORDS)
        states = flat_h[at]
        dw = _chances(states, p["ww"][words].T, p["bw"][words])
        mine = np.arange(len(at)), symbols[at] - c * CLASS_WORDS
        loss -= float(np.log(np.maximum(dw[mine], LEAST)).sum())
        dw[mine] -= 1
        dw /= n
        np.matmul(dw.T, states, out=g["ww"][words])
        dw.sum(0, out=g["bw"][words])
        dh[at] += dw @ p["ww"][words]
    if whole:
        dhs = dh.reshape(hs.shape)
    else:
        dhs = np.zeros_like(hs)
        dhs[there] = dh
    dx = np.empty((*prev.shape, 3 * w), np.float32)
    back = np.zeros_like(h)
    begins = fresh.any(1)
    for t in range(len(prev) - 1, -1, -1):
        old, r, z, new, gn, apart = kept[t]
        now = dhs[t] + back
        keep = now * z
        out = dx[t]
        dr, dz, dnew = out[:, :w], out[:, w : 2 * w], out[:, 2 * w :]
        np.subtract(now, keep, out=dnew)
        dnew *= 1 - new * new
        np.multiply(keep, apart, out=dz)
        dz *= 1 - z
        dg = np.empty_like(out)
        np.multiply(dnew, r, out=dg[:, 2 * w :])
        np.multiply(dg[:, 2 * w :], gn, out=dr)
        dr *= 1 - r
        dg[:, : 2 * w] = out[:, : 2 * w]
        g["wh"] += old.T @ dg
        keep += dg @ p["wh"].T
        back = keep * ~fresh[t][:, None] if begins[t] else keep
    dx = dx.reshape(-1, 3 * w)
    which = prev.ravel().astype(np.uint16)  # sorted by radix
    order = np.argsort(which, kind="stable")
    which = which[order]
    first = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
    seen = which[first]
    per = np.add.reduceat(dx[order], first, axis=0)
    g["emb"][seen] = per @ p["wx"].T
    np.matmul(p["emb"][seen].T, per, out=g["wx"])
    per.sum(0, out=g["b"])
    return loss / n, g, last


def train(p: dict[str, np.ndarray], symbols: np.ndarray, sizes: np.ndarray, end: int, rate: float = RATE) -> dict[str, np.ndarray]:
    """One pass over the documents with Adam; windows of WINDOW steps over TRAIN_LANES lanes, state carried between them."""
    whole = flat(p)
    p = unflat(whole)  # views of the one vector that Adam moves
    if not len(symbols):
        return p
    m, v, step, root = (np.zeros_like(whole) for _ in range(4))
    before = np.concatenate([[end], symbols[:-1]])
    lanes = lay(sizes, TRAIN_LANES)
    h = np.zeros((lanes.n, WIDTH), np.float32)
    for i, a in enumerate(range(0, len(lanes.target), WINDOW), 1):
        n = int(lanes.active[a])
        target, fresh = lanes.target[a : a + WINDOW, :n], lanes.fresh[a : a + WINDOW, :n]
        there = target >= 0
        prev = np.where(fresh, end, before[np.maximum(target, 0)])
        want = symbols[np.maximum(target, 0)]
        _, g, h = gradients(p, prev, fresh, want, there, h[:n])
        d = g["emb"].base
        d *= min(1.0, 1.0 / max(float(np.sqrt(np.dot(d, d))), 1e-9))
        m *= 0.9
        np.multiply(d, 0.1, out=step)
        m += step
        v *= 0.99
        np.multiply(d, d, out=step)
        step *= 0.01
        v += step
        np.multiply(v, np.float32(1 / (1 - 0.99**i)), out=root)
        np.sqrt(root, out=root)
        root += np.float32(1e-6)
        np.divide(m, root, out=step)
        step *= np.float32(rate / (1 - 0.9**i))
        whole -= step
    return p
