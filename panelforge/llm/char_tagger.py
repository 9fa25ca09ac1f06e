"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Characters are seen by class: digits, small and capital letters each as one, punctuation as
itself. Tags are outside, and begin and inside of each kind. Training runs on windows;
a text of any length is decoded from overlapping windows over all of it, whose emissions are
averaged where they meet before the best path of tags over the whole text is sought.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)
PAD, DIGIT, SMALL, CAPITAL, LINE, LETTER, OTHER = 0, 1, 2, 3, 4, 5, 6
PUNCTUATION = " !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CLASSES = 7 + len(PUNCTUATION)

_ASCII = np.full(128, OTHER, np.uint8)
_ASCII[ord("0") : ord("9") + 1] = DIGIT
_ASCII[ord("a") : ord("z") + 1] = SMALL
_ASCII[ord("A") : ord("Z") + 1] = CAPITAL
_ASCII[9:14] = LINE
for _i, _c in enumerate(PUNCTUATION):
    _ASCII[ord(_c)] = 7 + _i


def classes(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le"), "<u4")
    out = np.full(len(code), LETTER, np.uint8)
    low = code < 128
    out[low] = _ASCII[code[low]]
    return out


@dataclass(frozen=True)
class TaggerParams:
    width: int = 8
    hidden: int = 16
    window: int = 64  #: of characters, in training
    decode_window: int = 256
    overlap: int = 32  #: of neighbouring windows in decoding
    batch: int = 64
    batches: int = 240
    rate: float = 0.02
    seed: int = 9


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


_GRID = (np.arange(1 << 14) - (1 << 13)) * (20 / (1 << 14))
_SIGMOID, _TANH = sigmoid(_GRID).astype(np.float32), np.tanh(_GRID).astype(np.float32)


class Tagger:
    def __init__(self, p: TaggerParams = TaggerParams()):
        rng, h = np.random.default_rng(p.seed), p.hidden
        self.p = p
        uniform = lambda *shape: (rng.uniform(-1, 1, shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w: dict[str, np.ndarray] = {"embed": rng.normal(0, 0.5, (CLASSES, p.width)).astype(np.float32), "out": uniform(2 * h, TAGS), "out_b": np.zeros(TAGS, np.float32), "step": np.zeros((TAGS, TAGS), np.float32), "start": np.zeros(TAGS, np.float32)}
        for d in ("f", "b"):
            self.w |= {f"x{d}": uniform(p.width, 4 * h), f"u{d}": uniform(h, 4 * h), f"c{d}": np.zeros(4 * h, np.float32)}
            self.w[f"c{d}"][h : 2 * h] = 1

    def _run(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States of one direction for classes x (time, rows); gates are in, forget, out, new."""
        h, w = self.p.hidden, self.w
        table = w["embed"] @ w[f"x{d}"] + w[f"c{d}"]
        state, cell = np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32)
        out, saved = np.empty((*x.shape, h), np.float32), []
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = table[x[t]] + state @ w[f"u{d}"]
            g, new = sigmoid(z[:, : 3 * h]), np.tanh(z[:, 3 * h :])
            before = cell
            cell = g[:, h : 2 * h] * cell + g[:, :h] * new
            if keep:
                saved.append((t, state, before, g, new, cell))
            state = g[:, 2 * h :] * np.tanh(cell)
            out[t] = state
        return out, saved

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """(time, rows, tags) for classes (time, rows)."""
        both = np.concatenate([self._run(x, "f", False)[0], self._run(x, "b", False)[0]], axis=2)
        return both @ self.w["out"] + self.w["out_b"]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss for a row, and its gradients, for tags y (time, rows)."""
        w, (n, rows), h = self.w, x.shape, self.p.hidden
        (fw, kept_f), (bw, kept_b) = self._run(x, "f", True), self._run(x, "b", True)
        both = np.concatenate([fw, bw], axis=2)
        e = (both @ w["out"] + w["out_b"]).astype(np.float64)
        step, start, r = w["step"].astype(np.float64), w["start"].astype(np.float64), np.arange(rows)
        ahead, back = np.empty_like(e), np.zeros_like(e)
        soft = lambda a, axis: (m := a.max(axis=axis)) + np.log(np.exp(a - np.expand_dims(m, axis)).sum(axis=axis))
        ahead[0] = start + e[0]
        for t in range(1, n):
            ahead[t] = soft(ahead[t - 1][:, :, None] + step, 1) + e[t]
        for t in range(n - 2, -1, -1):
            back[t] = soft(step + (e[t + 1] + back[t + 1])[:, None, :], 2)
        whole = soft(ahead[-1], 1)
        marginal = np.exp(ahead + back - whole[:, None])
        gold = start[y[0]] + e[0, r, y[0]] + sum(step[y[t - 1], y[t]] + e[t, r, y[t]] for t in range(1, n))
        pair = np.exp(ahead[:-1, :, :, None] + step + (e[1:] + back[1:])[:, :, None, :] - whole[:, None, None]).sum(axis=(0, 1))
        np.subtract.at(pair, (y[:-1].ravel(), y[1:].ravel()), 1)
        d_e = marginal.copy()
        np.subtract.at(d_e, (np.arange(n)[:, None], r[None, :], y), 1)
        d_e = (d_e / rows).astype(np.float32)
        g = {k: np.zeros_like(v) for k, v in w.items()}
        g["step"], g["start"] = (pair / rows).astype(np.float32), d_e[0].sum(axis=0)
        g["out"], g["out_b"] = both.reshape(-1, 2 * h).T @ d_e.reshape(-1, TAGS), d_e.sum(axis=(0, 1))
        d_both = d_e @ w["out"].T
        for d, saved, d_out in (("f", kept_f, d_both[:, :, :h]), ("b", kept_b, d_both[:, :, h:])):
            d_state, d_cell = np.zeros((rows, h), np.float32), np.zeros((rows, h), np.float32)
            d_table = np.zeros((CLASSES, 4 * h), np.float32)
            for t, state, before, gate, new, cell in reversed(saved):
                into, forget, out = gate[:, :h], gate[:, h : 2 * h], gate[:, 2 * h :]
                flat = np.tanh(cell)
                d_s = d_out[t] + d_state
                d_cell = d_cell + d_s * out * (1 - flat**2)
                d_z = np.concatenate([d_cell * new * into * (1 - into), d_cell * before * forget * (1 - forget), d_s * flat * out * (1 - out), d_cell * into * (1 - new**2)], axis=1)
                d_cell = d_cell * forget
                g[f"u{d}"] += state.T @ d_z
                d_state = d_z @ w[f"u{d}"].T
                np.add.at(d_table, x[t], d_z)
            g[f"c{d}"], g[f"x{d}"] = d_table.sum(axis=0), w["embed"].T @ d_table
            g["embed"] += d_table @ w[f"x{d}"].T
        return float((whole - gold).mean()), g

    def fit(self, x: np.ndarray, y: np.ndarray) -> float:
        """Adam on windows x and tags y (rows, time), always the same batches; the last loss."""
        p, rng, loss = self.p, np.random.default_rng(self.p.seed), float("nan")
        m, v = {k: np.zeros_like(a) for k, a in self.w.items()}, {k: np.zeros_like(a) for k, a in self.w.items()}
        for i in range(p.batches if len(x) else 0):
            pick = rng.integers(0, len(x), p.batch)
            loss, grads = self.gradients(x[pick].T, y[pick].T)
            rate = p.rate * min(1.0, 2 * (1 - i / p.batches))
            for k, g in grads.items():
                g = np.clip(g, -1, 1)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.w[k] -= rate * (m[k] / (1 - 0.9 ** (i + 1))) / (np.sqrt(v[k] / (1 - 0.99 ** (i + 1))) + 1e-8)
        return loss

    def _emissions(self, x: np.ndarray) -> np.ndarray:
        """(time, tags, rows) for classes (time, rows): as emissions, without what training keeps.

        The gates' functions are read from tables of 2**14 values over [-10, 10], which is off
        by 6e-4 at most, and a state is weighed for the tags while it is at hand, so that little
        memory is touched.
        """
        h, (n, rows), w = self.p.hidden, x.shape, self.w
        per_unit, middle = _SIGMOID.size / 20, _SIGMOID.size / 2 + 0.5  # places of the table; casting cuts, so one half more
        embed, out = np.ascontiguousarray(w["embed"].T.astype(np.float32)), w["out"].astype(np.float32).T
        e = np.empty((n, TAGS, rows), np.float32)
        e[:] = w["out_b"][:, None]
        z, at = np.empty((4 * h, rows), np.float32), np.empty((4 * h, rows), np.intp)
        s, add = np.empty((h, rows), np.float32), np.empty((TAGS, rows), np.float32)
        gates, (into, forget, gate), new = z[: 3 * h], (z[:h], z[h : 2 * h], z[2 * h : 3 * h]), z[3 * h :]
        for d, weigh, order in (("f", np.ascontiguousarray(out[:, :h]), range(n)), ("b", np.ascontiguousarray(out[:, h:]), range(n - 1, -1, -1))):
            weights = np.concatenate([w[f"u{d}"], w[f"x{d}"], w[f"c{d}"][None]]) * per_unit
            weights[-1] += middle
            weights = np.ascontiguousarray(weights.T.astype(np.float32))
            seen = np.ones((h + self.p.width + 1, rows), np.float32)
            state, shown, cell = seen[:h], seen[h:-1], np.zeros((h, rows), np.float32)
            state[:] = 0
            with np.errstate(over="ignore"):  # 1 / (1 + inf) is 0
                for t in order:
                    np.take(embed, x[t], axis=1, out=shown, mode="clip")
                    np.matmul(weights, seen, out=z)
                    np.copyto(at, z, casting="unsafe")
                    np.take(_SIGMOID, at[: 3 * h], out=gates, mode="clip")
                    np.take(_TANH, at[3 * h :], out=new, mode="clip")
                    cell *= forget
                    into *= new
                    cell += into
                    np.multiply(cell, -2, out=s)
                    np.exp(s, out=s)
                    s += 1
                    np.divide(2, s, out=s)
                    s -= 1
                    np.multiply(gate, s, out=state)
                    e[t] += np.matmul(weigh, state, out=add)
        return e

    def sure(self, lead: np.ndarray) -> np.ndarray:
        """Positions where every best path is outside, for the lead of the best other tag over outside.

        A stretch of other tags gains at most the sum of its leads and of the best steps into
        it, within it and out of it over the path that is outside there. Where no stretch that
        holds a position can gain, the position is outside. Sums go on over the whole array.
        """
        step, start = self.w["step"].astype(np.float64), self.w["start"].astype(np.float64)
        within = float(step[1:, 1:].max() - step[0, 0])
        edges = max(float(step[0, 1:].max() - step[0, 0]), float((start[1:] - start[0]).max())) + max(float(step[1:, 0].max() - step[0, 0]), 0.0) - within
        upto, chunk = np.empty(len(lead), np.float32), 1 << 20  # best sum of a stretch that ends here
        carry = 0.0
        for i in range(0, len(lead), chunk):
            sums = np.cumsum(lead[i : i + chunk].astype(np.float64) + within)
            here = sums - np.minimum.accumulate(np.concatenate([[-carry], sums[:-1]]))
            upto[i : i + chunk], carry = here, max(0.0, float(here[-1]))
        out, carry = np.empty(len(lead), bool), 0.0
        for i in range((len(lead) - 1) // chunk * chunk, -1, -chunk):
            gain = lead[i : i + chunk].astype(np.float64) + within
            sums = np.cumsum(gain[::-1])
            here = sums - np.minimum.accumulate(np.concatenate([[-carry], sums[:-1]]))
            carry = max(0.0, float(here[-1]))
            out[i : i + chunk] = upto[i : i + chunk] + here[::-1] - gain + edges < -1e-2
        return out

    def decode(self, texts: list[np.ndarray], rows: int = 1536) -> list[list[tuple[int, int, int]]]:
        """(kind, start, end) of the tagged stretches of whole texts of classes.

        Every character is read, in overlapping windows; where two meet, each counts for the
        half that is farther from its edge. The best path over a whole text follows from its
        unsure stretches, each between two characters that are surely outside.
        """
        n, half, step = self.p.decode_window, self.p.overlap // 2, self.p.decode_window - self.p.overlap
        size = np.array([len(t) for t in texts], np.int64)
        base = np.cumsum(size + 1) - size - 1  # a place between texts that is always outside
        flat = np.zeros(int((size + 1).sum()) + n, np.uint8)
        for at, t in zip(base.tolist(), texts, strict=True):
            flat[at : at + len(t)] = t
        count = np.where(size > 0, np.maximum(1, -(-(size - 2 * half) // step)), 0)
        text = np.repeat(np.arange(len(texts)), count)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        first, end = base[text] + nth * step, (base + size)[text]
        lo, hi = first + half * (nth > 0), np.where(nth == count[text] - 1, end, first + n - half)

        def read(which: np.ndarray):
            """Of these windows, some at a time: places, whether each counts (rows, time), and emissions."""
            for i in range(0, len(which), rows):
                w = which[i : i + rows]
                place = first[w][:, None] + np.arange(n)
                x = np.where(place < end[w][:, None], flat[place], PAD)
                own = (place >= lo[w][:, None]) & (place < hi[w][:, None])
                yield place, own, self._emissions(np.ascontiguousarray(x.T))

        lead = np.full(len(flat) - n, -1e4, np.float32)
        for place, own, e in read(np.arange(len(text))):
            lead[place[own]] = (e[:, 1:].max(axis=1) - e[:, 0]).T[own]
        unsure = ~self.sure(lead)
        unsure[base + size] = False
        before = np.concatenate([[0], np.cumsum(unsure)])
        kept = []
        for place, own, e in read(np.flatnonzero(before[hi] > before[lo])):
            own[own] = unsure[place[own]]
            kept.append((place[own], e.transpose(2, 0, 1)[own]))
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if not kept:
            return out
        places, e = (np.concatenate(x) for x in zip(*kept, strict=True))
        cuts = np.append(0, np.flatnonzero(np.diff(places) > 1) + 1)
        lengths = np.diff(np.append(cuts, len(places)))
        of = np.searchsorted(base, places[cuts], side="right") - 1
        at_start, at_end = places[cuts] == base[of], places[cuts] + lengths == base[of] + size[of]
        tags = np.zeros(len(places), np.uint8)
        order = np.argsort(lengths, kind="stable")
        for i in range(0, len(order), 256):
            group = order[i : i + 256]
            grid = np.zeros((int(lengths[group[-1]]), len(group), TAGS), np.float32)
            for k, r in enumerate(group.tolist()):
                grid[: lengths[r], k] = e[cuts[r] : cuts[r] + lengths[r]]
            for r, best in zip(group.tolist(), self._viterbi(grid, lengths[group], at_start[group], at_end[group]), strict=True):
                tags[cuts[r] : cuts[r] + lengths[r]] = best
        for r in range(len(cuts)):
            mine = tags[cuts[r] : cuts[r] + lengths[r]]
            if mine.any():
                shift = int(places[cuts[r]] - base[of[r]])
                out[of[r]] += [(k, shift + s, shift + t) for k, s, t in spans_of(mine)]
        return out

    def _viterbi(self, e: np.ndarray, lengths: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
        """Best tags of each row; rows that aren't first or last in their text stand beside an outside tag there."""
        n, rows, _ = e.shape
        step, end = self.w["step"], np.where(last[:, None], 0, self.w["step"][:, 0])
        came = np.zeros((n, rows, TAGS), np.uint8)
        best, at_end = np.where(first[:, None], self.w["start"], step[0]) + e[0], np.zeros((rows, TAGS), np.float32)
        at_end[lengths == 1] = (best + end)[lengths == 1]
        for t in range(1, n):
            score = best[:, :, None] + step
            came[t] = score.argmax(axis=1)
            best = score.max(axis=1) + e[t]
            ends = lengths == t + 1
            at_end[ends] = (best + end)[ends]
        tags = np.zeros((n, rows), np.uint8)
        r, now = np.arange(rows), at_end.argmax(axis=1)
        for t in range(n - 1, -1, -1):
            live = lengths > t
            tags[t, live] = now[live]
            now = np.where(live, came[t, r, now], now)
        return [tags[: lengths[k], k] for k in range(rows)]


def spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the tagged stretches; a begin tag or another kind starts a new one."""
    out, kind, start = [], -1, 0
    for i in np.append(np.flatnonzero(np.diff(tags, prepend=0) != 0), len(tags)):
        t = int(tags[i]) if i < len(tags) else 0
        this = (t - 1) // 2 if t else -1
        if kind >= 0 and (this != kind or t % 2 == 1):
            out.append((kind, start, int(i)))
            kind = -1
        if this >= 0 and kind < 0:
            kind, start = this, int(i)
    return out
