"""A bidirectional LSTM over characters with CRF transitions, in numpy: training, and decoding of whole batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

KINDS = ("email", "ip", "card", "phone")
#: O, then begin and inside of each kind.
LABELS = 1 + 2 * len(KINDS)
_PUNCTUATION = "@.,:;-_+()[]{}<>/\\|%#&*='\"!?$~^`"
SYMBOLS = 1 + 26 + 1 + len(_PUNCTUATION) + 4
#: The score of a transition that no labelling has: into the inside of a kind from anything but that kind.
NEVER = -1e4
#: What the gates of padding get: a logistic of this is nothing.
SHUT = -40.0


def _table() -> np.ndarray:
    out = np.full(0x3000, SYMBOLS - 1, np.uint8)  # what is no letter, and other scripts
    for c in range(0x80, 0x3000):
        if chr(c).isalpha():
            out[c] = SYMBOLS - 2
    for i in range(26):
        out[[97 + i, 65 + i]] = 1 + i
    out[48:58] = 27  # digits are one: what they must be is checked, and few examples show them all
    for i, c in enumerate(_PUNCTUATION):
        out[ord(c)] = 28 + i
    out[[9, 11, 12, 13, 32]] = SYMBOLS - 4
    out[10] = SYMBOLS - 3
    return out


_TABLE = _table()


def symbols(text: str) -> np.ndarray:
    """A number from 1 for each character; 0 is padding."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _TABLE[np.minimum(points, len(_TABLE) - 1)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    """Padding (symbol 0) closes the gates, so that states start anew after it and no output depends on how far a row is padded."""

    def __init__(self, hidden: int = 16, seed: int = 0):
        r = np.random.default_rng(seed)
        self.h = hidden
        draw = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"out": draw(2 * hidden, LABELS, scale=0.3), "bias": np.zeros(LABELS, np.float32), "move": np.zeros((LABELS, LABELS), np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": draw(SYMBOLS, 4 * hidden, scale=0.3), f"h{d}": draw(hidden, 4 * hidden, scale=0.3 / hidden**0.5)}
            self.p[f"x{d}"][:, hidden : 2 * hidden] += 1  # remember at first
            self.p[f"x{d}"][0] = np.repeat(np.float32([SHUT, SHUT, 0, 0]), hidden)
        self.barred = np.zeros((LABELS, LABELS), np.float32)
        for k in range(len(KINDS)):
            self.barred[:, 2 + 2 * k] = NEVER
            self.barred[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0

    def moves(self) -> np.ndarray:
        return self.p["move"] + self.barred

    def _passes(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        """The states of both directions (2, rows, positions, hidden), each in its own order of positions, and what each step had; the directions go side by side."""
        (n, t), h = x.shape, self.h
        wx, wh = np.stack([self.p["xf"], self.p["xb"]]), np.stack([self.p["hf"], self.p["hb"]])
        both, way = np.stack([x, x[:, ::-1]]), np.arange(2)[:, None]
        out, kept = np.zeros((2, n, t, h), np.float32), []
        state = cell = np.zeros((2, n, h), np.float32)
        for i in range(t):
            z = wx[way, both[:, :, i]] + state @ wh
            s = _sigmoid(z[..., : 3 * h])
            a, f, o, g = s[..., :h], s[..., h : 2 * h], s[..., 2 * h :], np.tanh(z[..., 3 * h :])
            new = f * cell + a * g
            tc = np.tanh(new)
            kept.append((state, cell, a, f, o, g, tc))
            state, cell = o * tc, new
            out[:, :, i] = state
        return out, kept

    def emissions(self, x: np.ndarray, each: Callable[[int, np.ndarray], None] | None = None) -> np.ndarray:
        """(positions, labels, rows) for x (rows, positions); features lie outermost, so that every step works on whole rows of memory.

        each: called with each position and its scores, the last first, as soon as these are known.
        """
        (n, t), h = x.shape, self.h
        at = np.ascontiguousarray(x.T).astype(np.intp)
        out = np.empty((t, LABELS, n), np.float32)
        bias = self.p["bias"][:, None]
        halved = np.repeat(np.float32([0.5, 0.5, 0.5, 1]), h)  # a logistic gate is a tanh of half its argument
        z, fed, told = np.empty((4 * h, n), np.float32), np.empty((4 * h, n), np.float32), np.empty((LABELS, n), np.float32)
        for d, own in (("f", self.p["out"][:h]), ("b", self.p["out"][h:])):
            wx, wh, own = np.ascontiguousarray((self.p[f"x{d}"] * halved).T), np.ascontiguousarray((self.p[f"h{d}"] * halved).T), np.ascontiguousarray(own.T)
            state, cell, new = (np.zeros((h, n), np.float32) for _ in range(3))
            gates, a, f, o, g = z[: 3 * h], z[:h], z[h : 2 * h], z[2 * h : 3 * h], z[3 * h :]
            for i in range(t) if d == "f" else range(t - 1, -1, -1):
                wx.take(at[i], 1, z, "clip")
                np.matmul(wh, state, out=fed)
                np.add(z, fed, out=z)
                np.tanh(z, out=z)
                np.multiply(gates, 0.5, out=gates)
                np.add(gates, 0.5, out=gates)
                np.multiply(cell, f, out=cell)
                np.multiply(a, g, out=new)
                np.add(cell, new, out=cell)
                np.tanh(cell, out=new)
                np.multiply(o, new, out=state)
                e = out[i]
                if d == "f":
                    np.matmul(own, state, out=e)
                    np.add(e, bias, out=e)
                else:
                    np.matmul(own, state, out=told)
                    np.add(e, told, out=e)
                    if each is not None:
                        each(i, e)
        return out

    def _bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """What the move adds, at most, at the first position of a span of each kind and at each later one, against staying O.

        A label may carry any amount from the moves to it over to the moves from it without changing a labelling's score;
        each carries so much that leaving it for O gains nothing and that a span begins after another no better than after O.
        Then a span that loses by these bounds is better left out, so the best labelling has none; what
        no gaining span can cover is O in it.
        """
        moves = self.moves() - self.p["move"][0, 0]
        begin, inside = np.arange(1, LABELS, 2), np.arange(2, LABELS, 2)
        carried = np.minimum(-moves[:, 0], (moves[0, begin] - moves[:, begin]).min(1))
        carried[0] = 0
        moves = moves + carried[:, None] - carried
        return moves[0, begin], np.maximum(moves[inside, inside], moves[begin, inside])

    def summarised(self, x: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The emissions of x (rows, positions) and, by kind and row, over the positions from start to end of each row: the best gain of
        a span that begins there and goes no further, of one that goes on, what one that covers all gains there, and what one which comes in gains there at best.
        """
        first, later = (x_[:, None].astype(np.float32) for x_ in self._bounds())
        n, t = x.shape
        best, last, total, prefix = (np.full((len(KINDS), n), np.float32(v)) for v in (NEVER, NEVER, 0, 0))
        gain, begun, held = (np.empty((len(KINDS), n), np.float32) for _ in range(3))
        whole = int(start.max(initial=0)), int(end.min(initial=t))

        def each(i: int, e: np.ndarray) -> None:
            np.subtract(e[2::2], e[0], out=gain)
            np.subtract(e[1::2], e[0], out=begun)
            np.add(gain, later, out=gain)
            np.add(begun, first, out=begun)
            if not whole[0] <= i < whole[1]:
                out = (i < start) | (i >= end)
                gain[:, out], begun[:, out] = 0, NEVER
            np.add(begun, prefix, out=held)
            np.maximum(best, held, out=best)
            np.add(begun, total, out=held)
            np.maximum(last, held, out=last)
            np.add(total, gain, out=total)
            np.add(prefix, gain, out=prefix)
            np.maximum(prefix, 0, out=prefix)

        return self.emissions(x, each), np.stack([best, last, total, prefix])

    def live(self, e: np.ndarray) -> np.ndarray:
        """The positions, of emissions (positions, labels), that some span may cover in the best labelling."""
        first, later = self._bounds()
        out = np.zeros(len(e), bool)
        for k in range(len(KINDS)):
            begun = (e[:, 1 + 2 * k] - e[:, 0]).astype(np.float64) + first[k]
            sums = np.cumsum((e[:, 2 + 2 * k] - e[:, 0]).astype(np.float64) + later[k])
            out |= np.maximum.accumulate(begun - sums) + np.maximum.accumulate(sums[::-1])[::-1] > 0
        return out

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of labels y for a batch, and its gradient."""
        states, kept = self._passes(x)
        both = np.concatenate([states[0], states[1][:, ::-1]], 2)
        e = (both @ self.p["out"] + self.p["bias"]).astype(np.float64)
        n, t, _ = e.shape
        moves = self.moves().astype(np.float64)
        mx = moves.max()
        em = np.exp(moves - mx)
        alpha, scale = np.zeros_like(e), np.zeros((n, t))
        peak = e.max(2, keepdims=True)
        ee = np.exp(e - peak)
        alpha[:, 0] = ee[:, 0]
        for i in range(t):
            if i:
                alpha[:, i] = (alpha[:, i - 1] @ em) * ee[:, i]
            scale[:, i] = alpha[:, i].sum(1)
            alpha[:, i] /= scale[:, i : i + 1]
        beta = np.ones_like(e)
        pair = np.zeros_like(em)
        for i in range(t - 1, 0, -1):
            next_ = ee[:, i] * beta[:, i] / scale[:, i : i + 1]
            pair += alpha[:, i - 1].T @ next_
            beta[:, i - 1] = next_ @ em.T
        marginal = alpha * beta
        pair *= em
        log_z = (np.log(scale).sum(1) + peak[:, :, 0].sum(1) + mx * (t - 1)).sum()
        rows, cols = np.arange(n)[:, None], np.arange(t)[None, :]
        gold = e[rows, cols, y].sum() + moves[y[:, :-1], y[:, 1:]].sum()
        marginal[rows, cols, y] -= 1
        np.subtract.at(pair, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        de = (marginal / n).astype(np.float32)
        out = {"move": (pair / n).astype(np.float32), "out": both.reshape(-1, 2 * self.h).T @ de.reshape(-1, LABELS), "bias": de.sum((0, 1))}
        back = de @ self.p["out"].T
        hot = np.zeros((n * t, SYMBOLS), np.float32)
        hot[np.arange(n * t), x.ravel()] = 1
        part = np.stack([back[:, :, : self.h], back[:, ::-1, self.h :]])
        wh = np.stack([self.p["hf"], self.p["hb"]]).transpose(0, 2, 1)
        dz, dwh = np.zeros((2, n, t, 4 * self.h), np.float32), np.zeros((2, self.h, 4 * self.h), np.float32)
        dh = dc = np.zeros((2, n, self.h), np.float32)
        for i in range(t - 1, -1, -1):
            state, cell, a, f, o, g, tc = kept[i]
            dh = dh + part[:, :, i]
            dc = dc + dh * o * (1 - tc * tc)
            z = np.concatenate([dc * g * a * (1 - a), dc * cell * f * (1 - f), dh * tc * o * (1 - o), dc * a * (1 - g * g)], 2)
            dz[:, :, i] = z
            dwh += state.transpose(0, 2, 1) @ z
            dh, dc = z @ wh, dc * f
        for d, own, steps in (("f", dwh[0], dz[0]), ("b", dwh[1], dz[1][:, ::-1])):
            out |= {f"h{d}": own, f"x{d}": hot.T @ steps.reshape(n * t, -1)}
            out[f"x{d}"][0] = 0
        return (log_z - gold) / n, out

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.02, seed: int = 0) -> float:
        """Adam, with steps that shrink to nothing; returns the last epoch's mean loss."""
        r, step, steps = np.random.default_rng(seed), 0, epochs * max(1, len(x) // batch)
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        mean = 0.0
        for _ in range(epochs):
            losses = []
            for at in np.array_split(r.permutation(len(x)), max(1, len(x) // batch)):
                loss, g = self.gradient(x[at], y[at])
                losses.append(loss)
                step += 1
                norm, now = sum(float((w * w).sum()) for w in g.values()) ** 0.5, rate * (1 + np.cos(np.pi * step / steps)) / 2
                for k in self.p:
                    own = g[k] * min(1, 5 / max(norm, 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * own
                    v[k] = 0.99 * v[k] + 0.01 * own * own
                    self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            mean = float(np.mean(losses))
        return mean

    def decode(self, e: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The best labelling of each sequence of a padded batch of emissions (rows, positions, labels); what comes before and after a sequence is O."""
        n, t, _ = e.shape
        moves = self.moves()
        best, back, shortest = e[:, 0] + moves[0], np.zeros((n, t, LABELS), np.int8), int(lengths.min())
        for i in range(1, t):
            scores = best[:, :, None] + moves
            came, new = scores.argmax(1), scores.max(1) + e[:, i]
            if i >= shortest:
                ended = i >= lengths
                came[ended], new[ended] = np.arange(LABELS), best[ended]
            back[:, i], best = came, new
        out = np.zeros((n, t), np.int8)
        at = (best + moves[:, 0]).argmax(1)
        for i in range(t - 1, -1, -1):
            out[:, i] = at
            at = back[np.arange(n), i, at]
        out[np.arange(t)[None] >= lengths[:, None]] = 0
        return out


def label_row(length: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    """Labels for spans (kind, start, end), earlier kinds first where they overlap."""
    out = np.zeros(length, np.int8)
    for kind, a, z in sorted(spans, key=lambda s: KINDS.index(s[0])):
        a, z = max(a, 0), min(z, length)
        if a < z and not out[a:z].any():
            out[a:z] = 2 + 2 * KINDS.index(kind)
            out[a] -= 1
    return out


def spans_of(labels: np.ndarray) -> list[tuple[str, int, int]]:
    out, start, kind = [], None, None
    for i, x in enumerate([*labels.tolist(), 0]):
        if start is not None and x != 2 + 2 * kind:
            out.append((KINDS[kind], start, i))
            start = None
        if x % 2 == 1:
            start, kind = i, (x - 1) // 2
    return out
