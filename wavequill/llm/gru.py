"""A bidirectional gated recurrent network over bytes, in numpy: inference in bulk, training by backpropagation through time.

Arrays are (units, windows), so that every step is a few operations on long rows. A step, for either direction:
  a = table[:, byte];  r, z = sigmoid(a_rz + U_rz h);  n = tanh(a_n + r * (U_n h));  h = h + z * (n - h)
Every position has logits from the states of both directions there. Both directions begin anew in every window of WINDOW
bytes, in training and inference alike, so a position knows its window and nothing beyond.
"""

from __future__ import annotations

import numpy as np

#: Units of each direction, bytes of a window, windows that inference takes at once.
UNITS, WINDOW, BULK = 8, 64, 2048


def _sigmoid(x):
    """In place, by tanh, which doesn't overflow."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1.0
    x *= 0.5
    return x


def new_model(classes: int, seed: int = 7, units: int = UNITS) -> dict:
    rng = np.random.default_rng(seed)
    normal = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
    model = {"out": normal(classes, 2 * units, s=0.3), "bias": np.zeros((classes, 1), np.float32)}
    for d in "fb":
        model |= {f"table_{d}": normal(3 * units, 256, s=0.4), f"u_{d}": normal(3 * units, units, s=1 / np.sqrt(units))}
        model[f"table_{d}"][units : 2 * units] -= 1.0  # remember, to begin with
    return model


def _run(table, u, rows, h, keep=None):
    """One direction over rows (steps of (windows,) bytes; shorter steps touch the first windows only)."""
    n = u.shape[1]
    for t, x in rows:
        m = len(x)
        a, hm = table[:, x], h[:, :m]
        g = u @ hm
        rz = a[: 2 * n] + g[: 2 * n]
        _sigmoid(rz)
        c = g[2 * n :] * rz[:n]
        c += a[2 * n :]
        np.tanh(c, out=c)
        c -= hm
        c *= rz[n:]
        hm += c
        if keep is not None:
            keep[t][:, :m] = hm
        yield t, m


def probabilities(model: dict, windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(classes, windows): the sums over positions of the class probabilities there. lengths must not increase."""
    n, (steps, width) = model["u_f"].shape[1], windows.shape
    steps = min(steps, int(lengths[0])) if width else 0
    active = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(steps)]
    rows = [(t, windows[t, :m]) for t, m in enumerate(active)]
    kept = np.empty((max(steps, 1), n, width), np.float32)
    for _ in _run(model["table_f"], model["u_f"], rows, np.zeros((n, width), np.float32), kept):
        pass
    total, h = np.zeros((len(model["out"]), width), np.float32), np.zeros((n, width), np.float32)
    for t, m in _run(model["table_b"], model["u_b"], rows[::-1], h):
        p = model["out"][:, :n] @ kept[t][:, :m]
        p += model["out"][:, n:] @ h[:, :m]
        p += model["bias"]
        p -= p.max(axis=0)
        np.exp(p, out=p)
        p /= p.sum(axis=0)
        total[:, :m] += p
    return total


def pooled(model: dict, texts: list[bytes], window: int = WINDOW, bulk: int = BULK) -> np.ndarray:
    """(texts, classes): mean over every byte of each text; zeros for an empty one."""
    classes = len(model["out"])
    out = np.zeros((len(texts), classes))
    sizes = np.array([len(t) for t in texts], np.int64)
    if not sizes.sum():
        return out
    flat = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum(sizes) - sizes
    pieces = -(-sizes // window)
    owner = np.repeat(np.arange(len(texts)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = begin[owner] + nth * window
    length = np.minimum(window, sizes[owner] - nth * window)
    order = np.argsort(-length, kind="stable")
    for at in range(0, len(order), bulk):
        mine = order[at : at + bulk]
        index = start[mine] + np.arange(window)[:, None]
        sums = probabilities(model, flat[np.minimum(index, len(flat) - 1)], length[mine])
        for c in range(classes):
            out[:, c] += np.bincount(owner[mine], weights=sums[c], minlength=len(texts))
    return out / np.maximum(sizes, 1)[:, None]


def _forward(table, u, x):
    n, steps = u.shape[1], len(x)
    h, saved = np.zeros((n, x.shape[1]), np.float32), []
    for t in range(steps):
        a, g = table[:, x[t]], u @ h
        rz = _sigmoid(a[: 2 * n] + g[: 2 * n])
        r, z = rz[:n], rz[n:]
        c = np.tanh(a[2 * n :] + r * g[2 * n :])
        saved.append((h, r, z, c, g[2 * n :]))
        h = h + z * (c - h)
        saved[-1] += (h,)
    return saved


def _backward(u, x, saved, down):
    """Gradients of table and u; down[t]: of the state after step t."""
    n = u.shape[1]
    dtable, du, dh = np.zeros((3 * n, 256), np.float32), np.zeros_like(u), 0.0
    for t in range(len(x) - 1, -1, -1):
        before, r, z, c, gn, _ = saved[t]
        dh = dh + down[t]
        dc = dh * z * (1 - c * c)
        dz = dh * (c - before) * z * (1 - z)
        dr = dc * gn * r * (1 - r)
        da = np.concatenate([dr, dz, dc])
        dg = np.concatenate([dr, dz, dc * r])
        for i in range(3 * n):
            dtable[i] += np.bincount(x[t], weights=da[i], minlength=256)
        du += dg @ before.T
        dh = dh * (1 - z) + u.T @ dg
    return dtable, du


def gradients(model: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean loss over all positions of windows x (steps, windows) of classes y, and its gradients."""
    n, (steps, width) = model["u_f"].shape[1], x.shape
    f, b = _forward(model["table_f"], model["u_f"], x), _forward(model["table_b"], model["u_b"], x[::-1])
    loss, down_f, down_b = 0.0, [], [None] * steps
    grad = {"out": np.zeros_like(model["out"]), "bias": np.zeros_like(model["bias"])}
    hot = np.zeros((len(model["out"]), width), np.float32)
    hot[y, np.arange(width)] = 1
    for t in range(steps):
        h = np.concatenate([f[t][-1], b[steps - 1 - t][-1]])
        p = model["out"] @ h + model["bias"]
        p = np.exp(p - p.max(axis=0))
        p /= p.sum(axis=0)
        loss -= float(np.log(p[y, np.arange(width)] + 1e-9).mean()) / steps
        d = (p - hot) / (width * steps)
        grad["out"] += d @ h.T
        grad["bias"] += d.sum(axis=1, keepdims=True)
        up = model["out"].T @ d
        down_f.append(up[:n])
        down_b[steps - 1 - t] = up[n:]
    grad["table_f"], grad["u_f"] = _backward(model["u_f"], x, f, down_f)
    grad["table_b"], grad["u_b"] = _backward(model["u_b"], x[::-1], b, down_b)
    return loss, grad


def train(windows: np.ndarray, classes: np.ndarray, n_classes: int, steps: int = 300, batch: int = 192, rate: float = 0.03, seed: int = 7) -> dict:
    """Adam over batches of windows (n, WINDOW) of bytes with their classes."""
    model, rng = new_model(n_classes, seed), np.random.default_rng(seed + 1)
    first, second = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    for i in range(1, steps + 1):
        pick = rng.integers(0, len(windows), batch)
        _, grad = gradients(model, np.ascontiguousarray(windows[pick].T), classes[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        lr = rate * min(1.0, 2.0 * (1 - i / (steps + 1)))
        for k, g in grad.items():
            g = g * min(1.0, 1.0 / max(norm, 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            model[k] = (model[k] - lr * (first[k] / (1 - 0.9**i)) / (np.sqrt(second[k] / (1 - 0.99**i)) + 1e-6)).astype(np.float32)
    return model
