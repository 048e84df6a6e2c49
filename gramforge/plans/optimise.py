"""A derivative-free minimiser for kernels without scipy."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np


def nelder_mead(f: Callable[[np.ndarray], float], start: Sequence[float], *, step: float = 0.1, tol: float = 1e-9, max_iter: int = 4000) -> tuple[np.ndarray, float]:
    """Adaptive simplex search; values that are not finite count as very large."""
    x0 = np.array(start, float)
    n = len(x0)
    val = lambda x: v if np.isfinite(v := f(x)) else 1e300
    pts = np.vstack([x0, *[x0 + np.eye(n)[i] * (step * max(1.0, abs(x0[i]))) for i in range(n)]])
    fs = np.array([val(p) for p in pts])
    expand, contract, shrink = 1 + 2 / n, 0.75 - 0.5 / n if n > 1 else 0.5, 1 - 1 / n if n > 1 else 0.5
    for _ in range(max_iter):
        order = np.argsort(fs, kind="stable")
        pts, fs = pts[order], fs[order]
        if fs[-1] - fs[0] <= tol * (1 + abs(fs[0])) and np.abs(pts[1:] - pts[0]).max() <= 1e-6 * (1 + np.abs(pts[0]).max()):
            break
        mid = pts[:-1].mean(axis=0)
        r = mid + (mid - pts[-1])
        fr = val(r)
        if fr < fs[0]:
            e = mid + expand * (mid - pts[-1])
            fe = val(e)
            pts[-1], fs[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < fs[-2]:
            pts[-1], fs[-1] = r, fr
        else:
            c = mid + contract * ((r if fr < fs[-1] else pts[-1]) - mid)
            fc = val(c)
            if fc < min(fr, fs[-1]):
                pts[-1], fs[-1] = c, fc
            else:
                pts[1:] = pts[0] + shrink * (pts[1:] - pts[0])
                fs[1:] = [val(p) for p in pts[1:]]
    i = int(np.argmin(fs))
    return pts[i], float(fs[i])


def hessian(f: Callable[[np.ndarray], float], x: np.ndarray, step: float = 1e-4) -> np.ndarray:
    n = len(x)
    h = step * np.maximum(1, np.abs(x))
    out = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            a, b = np.eye(n)[i] * h[i], np.eye(n)[j] * h[j]
            out[i, j] = out[j, i] = (f(x + a + b) - f(x + a - b) - f(x - a + b) + f(x - a - b)) / (4 * h[i] * h[j])
    return out
