"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import numpy as np

SIZE, EMBED, HIDDEN = 129, 12, 20  # characters below 128, one for all others


def codes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    return np.minimum(raw, SIZE - 1).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    """Windows of characters in, one tag a character out. Arrays are (time, window, ...)."""

    def __init__(self, tags: int, seed: int = 7):
        draw = np.random.default_rng(seed)
        scale = lambda *shape: (draw.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"embed": scale(SIZE, EMBED) * 3, "out": scale(2 * HIDDEN, tags), "bias": np.zeros(tags, np.float32)}
        self.p |= {"step": scale(tags, tags) * 0.1, "first": np.zeros(tags, np.float32), "last": np.zeros(tags, np.float32)}
        for side in "fb":
            self.p |= {f"x{side}": scale(EMBED, 4 * HIDDEN), f"h{side}": scale(HIDDEN, 4 * HIDDEN), f"c{side}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"c{side}"][HIDDEN : 2 * HIDDEN] = 1  # remember at first

    def _lstm(self, given: np.ndarray, weights: np.ndarray, keep: list | None = None) -> np.ndarray:
        time, windows, _ = given.shape
        h = c = np.zeros((windows, HIDDEN), np.float32)
        out = np.empty((time, windows, HIDDEN), np.float32)
        for t in range(time):
            z = given[t] + h @ weights
            s = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            before, c_before = h, c
            c = f * c + i * g
            tc = np.tanh(c)
            out[t] = h = o * tc
            if keep is not None:
                keep.append((i, f, o, g, tc, before, c_before))
        return out

    def emissions(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Scores of every tag for characters x (time, window)."""
        p, sides = self.p, []
        for side in "fb":
            order = x if side == "f" else x[::-1]
            table = p["embed"] @ p[f"x{side}"] + p[f"c{side}"]
            cells = [] if keep is not None else None
            h = self._lstm(table[order], p[f"h{side}"], cells)
            sides.append(h if side == "f" else h[::-1])
            if keep is not None:
                keep[side] = cells
        both = np.concatenate(sides, axis=2)
        if keep is not None:
            keep["both"] = both
        return both @ p["out"] + p["bias"]

    def _lstm_back(self, side: str, x: np.ndarray, dh: np.ndarray, cells: list, grads: dict) -> None:
        weights = self.p[f"h{side}"]
        time, windows, _ = dh.shape
        dz = np.empty((time, windows, 4 * HIDDEN), np.float32)
        next_h = next_c = np.zeros((windows, HIDDEN), np.float32)
        for t in range(time - 1, -1, -1):
            i, f, o, g, tc, before, c_before = cells[t]
            d = dh[t] + next_h
            dc = next_c + d * o * (1 - tc * tc)
            dz[t] = np.concatenate([dc * g * i * (1 - i), dc * c_before * f * (1 - f), d * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            next_h, next_c = dz[t] @ weights.T, dc * f
        flat = dz.reshape(-1, 4 * HIDDEN)
        grads[f"h{side}"] = np.concatenate([c[5] for c in cells]).T @ flat
        grads[f"c{side}"] = flat.sum(axis=0)
        by_code = np.zeros((SIZE, 4 * HIDDEN), np.float32)
        np.add.at(by_code, x.ravel(), flat)
        grads[f"x{side}"] = self.p["embed"].T @ by_code
        grads["embed"] = grads.get("embed", 0) + by_code @ self.p[f"x{side}"].T

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of tags y for characters x, and its gradients."""
        p, keep = self.p, {}
        e = self.emissions(x, keep).astype(np.float64)
        time, windows, tags = e.shape
        step, at = p["step"].astype(np.float64), np.arange(windows)
        ahead, back = np.empty_like(e), np.empty_like(e)
        ahead[0] = p["first"] + e[0]
        for t in range(1, time):
            ahead[t] = _log_sum(ahead[t - 1][:, :, None] + step, 1) + e[t]
        back[-1] = p["last"]
        for t in range(time - 2, -1, -1):
            back[t] = _log_sum(step + (e[t + 1] + back[t + 1])[:, None, :], 2)
        total = _log_sum(ahead[-1] + p["last"], 1)
        one = np.exp(ahead + back - total[:, None])
        gold = p["first"][y[0]] + p["last"][y[-1]] + e[np.arange(time)[:, None], at, y].sum(axis=0) + step[y[:-1], y[1:]].sum(axis=0)
        grads = {"first": one[0].sum(axis=0), "last": one[-1].sum(axis=0)}
        np.subtract.at(grads["first"], y[0], 1)
        np.subtract.at(grads["last"], y[-1], 1)
        pair = np.exp(ahead[:-1, :, :, None] + step + (e[1:] + back[1:])[:, :, None, :] - total[:, None, None])
        grads["step"] = pair.sum(axis=(0, 1))
        np.subtract.at(grads["step"], (y[:-1], y[1:]), 1)
        one[np.arange(time)[:, None], at, y] -= 1
        de = (one / windows).astype(np.float32)
        for name in ("first", "last", "step"):
            grads[name] = grads[name] / windows
        grads["out"] = keep["both"].reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, tags)
        grads["bias"] = de.sum(axis=(0, 1))
        dh = de @ p["out"].T
        self._lstm_back("f", x, dh[:, :, :HIDDEN], keep["f"], grads)
        self._lstm_back("b", x[::-1], dh[::-1, :, HIDDEN:], keep["b"], grads)
        return float((total - gold).mean()), grads

    def train(self, x: np.ndarray, y: np.ndarray, rounds: int = 6, batch: int = 64, rate: float = 0.02, seed: int = 11) -> list[float]:
        """Adam over windows x, y (window, time); gives the loss of each round."""
        draw, losses, n = np.random.default_rng(seed), [], 0
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        for round_ in range(rounds):
            order, held = draw.permutation(len(x)), []
            for start in range(0, len(x), batch):
                own = order[start : start + batch]
                loss, grads = self.gradients(np.ascontiguousarray(x[own].T), np.ascontiguousarray(y[own].T))
                n += 1
                pace = rate * (1 - round_ / rounds)
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                for k, g in grads.items():
                    g = np.asarray(g, np.float32) * min(1.0, 5.0 / max(norm, 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] = (self.p[k] - pace * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-8)).astype(np.float32)
                held.append(loss)
            losses.append(float(np.mean(held)))
        return losses

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tags (window, time) of characters x (window, time), by Viterbi."""
        e = self.emissions(np.ascontiguousarray(x.T))
        time, windows, tags = e.shape
        best, from_ = self.p["first"] + e[0], np.empty((time, windows, tags), np.int8)
        for t in range(1, time):
            ways = best[:, :, None] + self.p["step"]
            from_[t] = ways.argmax(axis=1)
            best = ways.max(axis=1) + e[t]
        out = np.empty((windows, time), np.int64)
        out[:, -1] = (best + self.p["last"]).argmax(axis=1)
        for t in range(time - 1, 0, -1):
            out[:, t - 1] = from_[t][np.arange(windows), out[:, t]]
        return out
