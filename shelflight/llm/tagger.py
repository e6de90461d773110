"""A character tagger in numpy: two LSTMs, one per direction, under a linear chain of tags (a CRF)."""

from __future__ import annotations

import dataclasses

import numpy as np

Grads = dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _lstm(p: Grads, side: str, codes: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states (rows, steps, hidden) and what the way back needs."""
    drive = p[f"{side}_in"][codes]
    size = p[f"{side}_rec"].shape[0]
    h = c = np.zeros((len(codes), size))
    out, kept = np.empty((*codes.shape, size)), []
    for t in range(codes.shape[1]):
        z = drive[:, t] + h @ p[f"{side}_rec"]
        gates = _sigmoid(z[:, : 3 * size])
        i, f, o = gates[:, :size], gates[:, size : 2 * size], gates[:, 2 * size :]
        g = np.tanh(z[:, 3 * size :])
        kept.append((h, c, i, f, o, g))
        c = f * c + i * g
        h = o * np.tanh(c)
        out[:, t] = h
    return out, kept


def _lstm_back(p: Grads, side: str, codes: np.ndarray, kept: list, d_out: np.ndarray, grads: Grads) -> None:
    d_in, d_rec = np.zeros_like(p[f"{side}_in"]), np.zeros_like(p[f"{side}_rec"])
    dh = dc = np.zeros_like(kept[0][0])
    for t in reversed(range(codes.shape[1])):
        before, c_before, i, f, o, g = kept[t]
        tanh_c = np.tanh(f * c_before + i * g)
        dh = dh + d_out[:, t]
        dc = dc + dh * o * (1 - tanh_c**2)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c_before * f * (1 - f), dh * tanh_c * o * (1 - o), dc * i * (1 - g**2)], axis=1)
        d_rec += before.T @ dz
        np.add.at(d_in, codes[:, t], dz)
        dh, dc = dz @ p[f"{side}_rec"].T, dc * f
    grads[f"{side}_in"], grads[f"{side}_rec"] = d_in, d_rec


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclasses.dataclass
class Tagger:
    """Weights, and which tag may follow which (0, or a large negative number)."""

    weights: Grads
    allowed: np.ndarray

    @classmethod
    def fresh(cls, symbols: int, hidden: int, allowed: np.ndarray, seed: int) -> Tagger:
        draw, tags = np.random.default_rng(seed), len(allowed)
        weights: Grads = {}
        for side in ("ahead", "back"):
            weights[f"{side}_in"] = draw.normal(0, 0.3, (symbols, 4 * hidden))
            weights[f"{side}_in"][:, hidden : 2 * hidden] += 1.0  # begin by remembering
            weights[f"{side}_rec"] = draw.normal(0, 0.3, (hidden, 4 * hidden))
        weights |= {"out": draw.normal(0, 0.3, (2 * hidden, tags)), "bias": np.zeros(tags), "step": np.zeros((tags, tags))}
        return cls(weights, allowed)

    def _emit(self, codes: np.ndarray) -> tuple[np.ndarray, tuple]:
        ahead, kept_a = _lstm(self.weights, "ahead", codes)
        back, kept_b = _lstm(self.weights, "back", codes[:, ::-1])
        both = np.concatenate([ahead, back[:, ::-1]], axis=2)
        return both @ self.weights["out"] + self.weights["bias"], (both, kept_a, kept_b)

    def _chain(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log sums of all ways to, and from, each tag; and log sums of whole ways."""
        step = self.weights["step"] + self.allowed
        to, from_ = np.empty_like(scores), np.zeros_like(scores)
        to[:, 0] = scores[:, 0]
        for t in range(1, scores.shape[1]):
            to[:, t] = scores[:, t] + _logsum(to[:, t - 1, :, None] + step, 1)
        for t in reversed(range(scores.shape[1] - 1)):
            from_[:, t] = _logsum(step + (scores[:, t + 1] + from_[:, t + 1])[:, None, :], 2)
        return to, from_, _logsum(to[:, -1], 1)

    def gradients(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, Grads]:
        """Mean negative log likelihood of the tags, and its gradient."""
        scores, (both, kept_a, kept_b) = self._emit(codes)
        to, from_, total = self._chain(scores)
        step, rows = self.weights["step"] + self.allowed, np.arange(len(codes))[:, None]
        share = np.exp(to + from_ - total[:, None, None])
        d_step = np.zeros_like(step)
        for t in range(1, codes.shape[1]):
            pair = to[:, t - 1, :, None] + step + (scores[:, t] + from_[:, t])[:, None, :] - total[:, None, None]
            d_step += np.exp(pair).sum(axis=0)
        np.add.at(d_step, (tags[:, :-1], tags[:, 1:]), -1.0)
        truth = scores[rows, np.arange(codes.shape[1]), tags].sum() + step[tags[:, :-1], tags[:, 1:]].sum()
        d_scores = share
        np.add.at(d_scores, (rows, np.arange(codes.shape[1]), tags), -1.0)
        d_scores, d_step = d_scores / len(codes), d_step / len(codes)
        d_both = d_scores @ self.weights["out"].T
        grads: Grads = {"out": np.einsum("nth,ntk->hk", both, d_scores), "bias": d_scores.sum(axis=(0, 1)), "step": d_step}
        half = both.shape[2] // 2
        _lstm_back(self.weights, "ahead", codes, kept_a, d_both[:, :, :half], grads)
        _lstm_back(self.weights, "back", codes[:, ::-1], kept_b, d_both[:, ::-1, half:], grads)
        return float((total.sum() - truth) / len(codes)), grads

    def train(self, codes: np.ndarray, tags: np.ndarray, batches: int, rows: int, rate: float, seed: int) -> list[float]:
        """Adam over random batches; returns the losses."""
        draw = np.random.default_rng(seed)
        first, second = ({k: np.zeros_like(v) for k, v in self.weights.items()} for _ in range(2))
        losses = []
        for n in range(1, batches + 1):
            some = draw.integers(0, len(codes), min(rows, len(codes)))
            loss, grads = self.gradients(codes[some], tags[some])
            losses.append(loss)
            norm = np.sqrt(sum((g**2).sum() for g in grads.values()))
            pace = rate * min(1.0, 2 * (1 - n / (batches + 1)))
            for k, g in grads.items():
                g = g * min(1.0, 5.0 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.weights[k] -= pace * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.999**n)) + 1e-8)
        return losses

    def _scores(self, codes: np.ndarray) -> np.ndarray:
        """The scores of `_emit` step by step, without what the way back needs: windows may be long."""
        p, out = self.weights, np.split(self.weights["out"], 2)
        size = len(out[0])
        scores = np.empty((*codes.shape, len(self.allowed)))
        scores[:] = p["bias"]
        steps = range(codes.shape[1])
        for side, weights, order in (("ahead", out[0], steps), ("back", out[1], reversed(steps))):
            h = c = np.zeros((len(codes), size))
            for t in order:
                z = p[f"{side}_in"][codes[:, t]] + h @ p[f"{side}_rec"]
                gates = _sigmoid(z[:, : 3 * size])
                c = gates[:, size : 2 * size] * c + gates[:, :size] * np.tanh(z[:, 3 * size :])
                h = gates[:, 2 * size :] * np.tanh(c)
                scores[:, t] += h @ weights
        return scores

    def decode(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags of each row, and the probability of each of them. Takes about 170 bytes a code with nine tags."""
        scores, step = self._scores(codes), self.weights["step"] + self.allowed
        to, back = np.empty_like(scores), np.zeros(scores.shape, dtype=np.int8)
        to[:, 0] = best = scores[:, 0]
        for t in range(1, codes.shape[1]):
            to[:, t] = scores[:, t] + _logsum(to[:, t - 1, :, None] + step, 1)
            ways = best[:, :, None] + step
            back[:, t] = ways.argmax(axis=1)
            best = ways.max(axis=1) + scores[:, t]
        tags, share, rows = np.empty(codes.shape, dtype=np.int8), np.empty(codes.shape), np.arange(len(codes))
        total, tag, from_ = _logsum(to[:, -1], 1), best.argmax(axis=1), np.zeros_like(best)
        for t in reversed(range(codes.shape[1])):
            tags[:, t], share[:, t] = tag, np.exp(to[rows, t, tag] + from_[rows, tag] - total)
            from_ = _logsum(step + (scores[:, t] + from_)[:, None, :], 2)
            tag = back[rows, t, tag]
        return tags, share
