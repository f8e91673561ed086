"""A small gated recurrent language model in NumPy: truncated backpropagation, and a softmax factored by classes.

Token 0 is any word outside the vocabulary, token 1 the end of a text; both are classes of their own, and the other tokens share
classes of CLASS_SIZE by frequency. A token's probability is that of its class times that within its class.
"""

from __future__ import annotations

import numpy as np

OTHER, END = 0, 1
HIDDEN, CLASS_SIZE = 16, 34
WINDOW, STREAMS = 20, 32  # steps of truncated backpropagation, texts read side by side in training
BLOCK, CELLS = 32, 1 << 21  # steps whose states are scored at once, tokens of one group of texts


class Model:
    def __init__(self, tokens: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        h, c = HIDDEN, 2 + -(-(tokens - 2) // CLASS_SIZE)
        self.tokens, self.classes = tokens, c
        scale = 1 / np.sqrt(h)
        draw = lambda *s: (rng.normal(size=s) * scale).astype(np.float32)
        self.p = {
            "embed": draw(tokens, h), "wx": draw(h, 3 * h), "wh": draw(h, 3 * h), "b": np.zeros(3 * h, np.float32),
            "wc": draw(h, c) * 0.1, "bc": np.zeros(c, np.float32), "ww": draw(c, h, CLASS_SIZE) * 0.1, "bw": np.zeros((c, CLASS_SIZE), np.float32),
        }
        last = tokens - 2 - (c - 3) * CLASS_SIZE if c > 2 else 0
        if c > 2:
            self.p["bw"][c - 1, last:] = -1e9  # places of the last class that no token has
        self.empty = self.p["bw"] < -1e8

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, flat: np.ndarray) -> Model:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        self.p["bw"][self.empty] = -1e9
        return self

    def class_of(self, y):
        return np.where(y < 2, y, 2 + (y - 2) // CLASS_SIZE)

    def _gates(self, table, h, y):
        n = HIDDEN
        gx, gh = table[y], h @ self.p["wh"]
        rz = 1 / (1 + np.exp(-(gx[:, : 2 * n] + gh[:, : 2 * n])))
        r, z = rz[:, :n], rz[:, n:]
        new = np.tanh(gx[:, 2 * n :] + r * gh[:, 2 * n :])
        return r, z, new, gh[:, 2 * n :]

    def _log_prob(self, s, y, grads=None):
        """Log-probability of tokens `y` after states `s`; adds to `grads` and returns the states' gradient if given."""
        p, cls = self.p, self.class_of(y)
        rows = np.arange(len(y))
        logit = s @ p["wc"] + p["bc"]
        logit -= logit.max(1, keepdims=True)
        e = np.exp(logit)
        total = e.sum(1)
        out = (logit[rows, cls] - np.log(total)).astype(np.float64)
        ds = None
        if grads is not None:
            d = e / total[:, None]
            d[rows, cls] -= 1
            grads["wc"] += s.T @ d
            grads["bc"] += d.sum(0)
            ds = d @ p["wc"].T
        order = np.argsort(cls, kind="stable")
        bounds = np.searchsorted(cls[order], np.arange(self.classes + 1))
        for c in range(2, self.classes):
            at = order[bounds[c] : bounds[c + 1]]
            if not len(at):
                continue
            sub, word = s[at], (y[at] - 2) % CLASS_SIZE
            logit = sub @ p["ww"][c] + p["bw"][c]
            logit -= logit.max(1, keepdims=True)
            e = np.exp(logit)
            total, k = e.sum(1), np.arange(len(at))
            out[at] += logit[k, word] - np.log(total)
            if grads is not None:
                d = e / total[:, None]
                d[k, word] -= 1
                grads["ww"][c] += sub.T @ d
                grads["bw"][c] += d.sum(0)
                ds[at] += d @ p["ww"][c].T
        return out, ds

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural log-probability of whole texts (tokens, the end last). The state runs through a text from its first token to its last."""
        out = np.zeros(len(texts))
        length = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-length, kind="stable")
        table = self.p["embed"] @ self.p["wx"] + self.p["b"]
        i = 0
        while i < len(order):
            j = min(len(order), i + max(1, CELLS // max(1, int(length[order[i]]))), i + 1024)
            out[order[i:j]] = self._score_group([texts[k] for k in order[i:j]], length[order[i:j]], table)
            i = j
        return out

    def _score_group(self, texts, length, table):
        m, most = len(texts), int(length[0])
        ids = np.zeros((most, m), np.int16)
        for k, t in enumerate(texts):
            ids[: len(t), k] = t
        active = np.searchsorted(-length, -np.arange(most), side="left")  # texts longer than t
        h, total = np.zeros((m, HIDDEN), np.float32), np.zeros(m)
        for begin in range(0, most, BLOCK):
            states, wanted, who = [], [], []
            for t in range(begin, min(begin + BLOCK, most)):
                a = int(active[t])
                y = ids[t, :a].astype(np.int64)
                now = h[:a]
                states.append(now)
                wanted.append(y)
                who.append(np.arange(a))
                _, z, new, _ = self._gates(table, now, y)
                h = new + z * (now - new)
            logp, _ = self._log_prob(np.concatenate(states), np.concatenate(wanted))
            total += np.bincount(np.concatenate(who), weights=logp, minlength=m)
        return total

    def train(self, texts: list[np.ndarray], rate: float, passes: int = 1, streams: int = STREAMS) -> Model:
        """Adam over windows of WINDOW steps; states run on from window to window and start anew after an end. Streams are filled
        up with the first tokens again, so that none is left out."""
        texts = [t for t in texts if len(t)]
        if not texts:
            return self
        flow = np.concatenate(texts).astype(np.int64)
        m = max(1, min(streams, len(flow) // WINDOW))
        steps = -(-len(flow) // m)
        flow = np.resize(flow, (m, steps)).T
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(passes):
            h = np.zeros((m, HIDDEN), np.float32)
            for begin in range(0, steps, WINDOW):
                grads, h = self._window(flow[begin : begin + WINDOW], h)
                step += 1
                norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
                shrink = min(1.0, 1.0 / (norm + 1e-9))
                for k, g in grads.items():
                    g *= shrink
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
                self.p["bw"][self.empty] = -1e9
        return self

    def _window(self, ids, h):
        p, n = self.p, HIDDEN
        table = p["embed"] @ p["wx"] + p["b"]
        grads = {k: np.zeros_like(v) for k, v in p.items()}
        kept = []
        for y in ids:
            r, z, new, hn = self._gates(table, h, y)
            kept.append((h, r, z, new, hn))
            h = (new + z * (h - new)) * (y != END)[:, None]
        states = np.concatenate([k[0] for k in kept])
        _, ds = self._log_prob(states, ids.ravel(), grads)
        ds = ds.reshape(len(ids), -1, n)
        dh, d_table = np.zeros_like(h), np.zeros_like(table)
        for t in range(len(ids) - 1, -1, -1):
            before, r, z, new, hn = kept[t]
            dh = dh * (ids[t] != END)[:, None]
            dz = dh * (before - new) * z * (1 - z)
            dn = dh * (1 - z) * (1 - new**2)
            dr = dn * hn * r * (1 - r)
            np.add.at(d_table, ids[t], np.concatenate([dr, dz, dn], 1))
            gh = np.concatenate([dr, dz, dn * r], 1)
            grads["wh"] += before.T @ gh
            dh = dh * z + gh @ p["wh"].T + ds[t]
        grads["wx"] += p["embed"].T @ d_table
        grads["embed"] += d_table @ p["wx"].T
        grads["b"] += d_table.sum(0)
        for g in grads.values():
            g /= ids.size
        return grads, h
