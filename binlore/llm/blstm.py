"""A bidirectional LSTM in numpy that labels every element of a sequence: inference, and training by back-propagation through time."""

from __future__ import annotations

import numpy as np

HIDDEN = 32


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fresh_weights(dim: int, hidden: int = HIDDEN, seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    out = {}
    for way in ("f", "b"):
        out["x" + way] = rng.normal(0, 1 / np.sqrt(dim), (dim, 4 * hidden)).astype(np.float32)
        out["h" + way] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)).astype(np.float32)
        bias = np.zeros(4 * hidden, np.float32)
        bias[hidden : 2 * hidden] = 1  # gates: input, forget, output, candidate
        out["c" + way] = bias
    out["o"] = rng.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden,)).astype(np.float32)
    out["d"] = np.zeros(1, np.float32)
    return out


def _run(x: np.ndarray, mask: np.ndarray, wx, wh, bias, keep: bool):
    """Hidden states of a time-major batch (steps, pages, dim); masked steps leave the state as it is."""
    steps, pages, _ = x.shape
    hidden = wh.shape[0]
    pre = (x.reshape(-1, x.shape[2]) @ wx + bias).reshape(steps, pages, -1)
    h = c = np.zeros((pages, hidden), np.float32)
    out, memory = np.zeros((steps, pages, hidden), np.float32), []
    for t in range(steps):
        z = pre[t] + h @ wh
        gates = _sigmoid(z[:, : 3 * hidden])
        i, f, o = gates[:, :hidden], gates[:, hidden : 2 * hidden], gates[:, 2 * hidden :]
        g = np.tanh(z[:, 3 * hidden :])
        m = mask[t][:, None]
        c1 = f * c + i * g
        tc = np.tanh(c1)
        if keep:
            memory.append((h, c, i, f, o, g, tc, m))
        c = np.where(m, c1, c)
        h = np.where(m, o * tc, h)
        out[t] = h
    return out, memory


def _reverse(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each page's steps in reverse order, padding left at the end."""
    t = np.arange(x.shape[0])[:, None]
    index = np.where(t < lengths, lengths - 1 - t, t)
    return x[index, np.arange(x.shape[1])[None, :]]


def scores(weights: dict, x: np.ndarray, lengths: np.ndarray, keep: bool = False):
    """(steps, pages) probabilities of a padded time-major batch."""
    mask = np.arange(x.shape[0])[:, None] < lengths
    hf, mf = _run(x, mask, weights["xf"], weights["hf"], weights["cf"], keep)
    xr = _reverse(x, lengths)
    hb, mb = _run(xr, mask, weights["xb"], weights["hb"], weights["cb"], keep)
    hidden = weights["hf"].shape[0]
    p = _sigmoid(hf @ weights["o"][:hidden] + _reverse(hb, lengths) @ weights["o"][hidden:] + weights["d"])
    return (p, mask, xr, hf, hb, mf, mb) if keep else p


def _back(dout: np.ndarray, x: np.ndarray, memory: list, wh: np.ndarray):
    steps, pages, hidden = dout.shape
    dpre = np.zeros((steps, pages, 4 * hidden), np.float32)
    dwh = np.zeros_like(wh)
    dh, dc = np.zeros((pages, hidden), np.float32), np.zeros((pages, hidden), np.float32)
    for t in range(steps - 1, -1, -1):
        h, c, i, f, o, g, tc, m = memory[t]
        dh = dh + dout[t]
        dh1, dc1 = np.where(m, dh, 0), np.where(m, dc, 0)
        dc1 = dc1 + dh1 * o * (1 - tc * tc)
        dz = np.concatenate([dc1 * g * i * (1 - i), dc1 * c * f * (1 - f), dh1 * tc * o * (1 - o), dc1 * i * (1 - g * g)], axis=1)
        dpre[t] = dz
        dwh += h.T @ dz
        dh = np.where(m, 0, dh) + dz @ wh.T
        dc = np.where(m, dc1 * f, dc)
    flat = dpre.reshape(-1, dpre.shape[2])
    return x.reshape(-1, x.shape[2]).T @ flat, dwh, flat.sum(0)


def gradients(weights: dict, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean cross-entropy over the real steps, and its gradients."""
    p, mask, xr, hf, hb, mf, mb = scores(weights, x, lengths, keep=True)
    n = mask.sum()
    loss = float(-(np.log(np.where(y > 0, p, 1 - p) + 1e-7) * mask).sum() / n)
    dz = ((p - y) * mask / n).astype(np.float32)
    hidden = weights["hf"].shape[0]
    hb_in_order = _reverse(hb, lengths)
    out = {"o": np.concatenate([np.einsum("tp,tph->h", dz, hf), np.einsum("tp,tph->h", dz, hb_in_order)]), "d": np.array([dz.sum()], np.float32)}
    out["xf"], out["hf"], out["cf"] = _back(dz[:, :, None] * weights["o"][:hidden], x, mf, weights["hf"])
    out["xb"], out["hb"], out["cb"] = _back(_reverse(dz, lengths)[:, :, None] * weights["o"][hidden:], xr, mb, weights["hb"])
    return loss, out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(p) for p in pages], np.int64)
    x = np.zeros((int(lengths.max(initial=1)), len(pages), pages[0].shape[1]), np.float32)
    for k, p in enumerate(pages):
        x[: len(p), k] = p
    return x, lengths


def train(pages: list[np.ndarray], labels: list[np.ndarray], epochs: int, batch: int = 32, rate: float = 0.01, seed: int = 0) -> dict:
    """Adam over batches of pages of similar length, in an order fixed by the seed."""
    weights = fresh_weights(pages[0].shape[1], seed=seed)
    rng = np.random.default_rng(seed)
    order = np.argsort([len(p) for p in pages], kind="stable")
    batches = [order[i : i + batch] for i in range(0, len(order), batch)]
    m, v, step = {k: np.zeros_like(w) for k, w in weights.items()}, {k: np.zeros_like(w) for k, w in weights.items()}, 0
    total = epochs * len(batches)
    for _ in range(epochs):
        for k in rng.permutation(len(batches)):
            x, lengths = padded([pages[i] for i in batches[k]])
            y = np.zeros(x.shape[:2], np.float32)
            for j, i in enumerate(batches[k]):
                y[: len(labels[i]), j] = labels[i]
            _, grads = gradients(weights, x, lengths, y)
            step += 1
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            now = rate * (1 - step / (total + 1))
            for name, g in grads.items():
                g = g * min(1, 1 / (norm + 1e-9))
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.999 * v[name] + 0.001 * g * g
                weights[name] = (weights[name] - now * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return weights
