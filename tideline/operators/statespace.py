"""Small numerical kernels for one series or a few: Kalman filter and smoother, maximum likelihood, smoothers, sampling.

They run inside grouped-map tasks, on one group each; how groups are formed and spread is in fits.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

#: Variance of a state about which nothing is known, and of an innovation from which a step says nothing about the parameters.
DIFFUSE, UNINFORMATIVE = 1e7, 1e5


@dataclass
class Model:
    """y_t = Z a_t + e, e ~ diag(h); a_{t+1} = T a_t + w, w ~ diag(q); a_1 ~ (0, diag(p1))."""

    T: np.ndarray
    Z: np.ndarray
    q: np.ndarray
    h: np.ndarray
    p1: np.ndarray
    names: list[str] = field(default_factory=list)


def seasonal(T: np.ndarray, at: int, period: int) -> None:
    """Puts a dummy seasonal of period - 1 states into a transition matrix."""
    T[at, at : at + period - 1] = -1
    for k in range(1, period - 1):
        T[at + k, at + k - 1] = 1


def structural(trend: str = "damped", phi: float = 0.85, period: int = 4, slope_in_level: float = 1.0) -> Model:
    """Level, slope (damped, or local_linear with phi 1, or none for level_only) and dummy seasonal of one series.

    slope_in_level: what the level takes from the slope in a step.
    """
    m = (1 if trend == "level_only" else 2) + period - 1
    T = np.zeros((m, m))
    T[0, 0] = 1
    if trend != "level_only":
        damping = 1.0 if trend == "local_linear" else phi
        T[0, 1], T[1, 1] = slope_in_level, damping
    s = m - period + 1
    seasonal(T, s, period)
    Z = np.zeros((1, m))
    Z[0, 0] = Z[0, s] = 1
    q = np.zeros(m)
    return Model(T, Z, q, np.ones(1), np.full(m, DIFFUSE), ["level", "slope"][: s] + [f"season{k}" for k in range(period - 1)])


def joint(weights: list[float] | None, target: bool = True, drifting: bool = False, phi: float = 0.85, period: int = 4) -> Model:
    """Arrivals, grants and (with target) the published figure on one level: states level, slope, seasonal, lagged levels, drift.

    weights: of the level and its lags in the grants row, for lags 0, 1, ..; the longest lag takes the first weight.
    """
    lags = len(weights) - 1 if weights else 0
    m = 2 + period - 1 + lags + (drifting and target)
    T = np.zeros((m, m))
    T[0, 0] = T[0, 1] = 1
    T[1, 1] = phi
    seasonal(T, 2, period)
    first = 1 + period
    for k in range(lags):
        T[first + k, 0 if k == 0 else first + k - 1] = 1
    Z = np.zeros((3 if target else 2, m))
    Z[0, 0] = Z[0, 2] = 1
    if lags:
        for k in range(lags + 1):
            Z[1, 0 if k == 0 else first + k - 1] = weights[lags - k]
    else:
        Z[1, 0] = 1
    p1 = np.concatenate([[DIFFUSE, DIFFUSE], np.ones(period - 1), np.full(lags, 100.0)])
    if target:
        Z[2, 0] = 1
        if drifting:
            T[-1, -1] = Z[2, -1] = 1
            p1 = np.append(p1, DIFFUSE)
    return Model(T, Z, np.zeros(m), np.ones(len(Z)), p1)


def filtered(model: Model, y: np.ndarray) -> dict:
    """Log likelihood, and predicted and filtered states of y (n x p, NaN where unknown). Observations of a step are taken one at a time."""
    n, m = len(y), len(model.T)
    a, P = np.zeros(m), np.diag(model.p1).astype(float)
    out = {k: np.zeros((n, m)) for k in ("ap", "af")} | {k: np.zeros((n, m, m)) for k in ("Pp", "Pf")}
    loglik = 0.0
    for t in range(n):
        if t:
            a, P = model.T @ a, model.T @ P @ model.T.T + np.diag(model.q)
        out["ap"][t], out["Pp"][t] = a, P
        for i in range(len(model.Z)):
            if np.isfinite(y[t, i]):
                z = model.Z[i]
                v, Pz = y[t, i] - z @ a, P @ z
                f = z @ Pz + model.h[i]
                if f > 1e-12:
                    if f < UNINFORMATIVE:
                        loglik -= 0.5 * (np.log(2 * np.pi * f) + v * v / f)
                    a, P = a + Pz * (v / f), P - np.outer(Pz, Pz) / f
        P = (P + P.T) / 2
        out["af"][t], out["Pf"][t] = a, P
    return out | {"loglik": loglik}


def smoothed(model: Model, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariances of the states given all of y."""
    f = filtered(model, y)
    a, P = f["af"].copy(), f["Pf"].copy()
    for t in range(len(y) - 2, -1, -1):
        gain = f["Pf"][t] @ model.T.T @ np.linalg.pinv(f["Pp"][t + 1])
        a[t] = f["af"][t] + gain @ (a[t + 1] - f["ap"][t + 1])
        P[t] = f["Pf"][t] + gain @ (P[t + 1] - f["Pp"][t + 1]) @ gain.T
    return a, P


def minimised(f, x: np.ndarray, steps: int = 60, tolerance: float = 1e-6) -> tuple[np.ndarray, float]:
    """A local minimum by BFGS with differences for gradients and halving steps."""
    x = np.asarray(x, float)

    def slope(x, fx):
        return np.array([(f(x + d) - fx) / 1e-5 for d in np.eye(len(x)) * 1e-5])

    fx = f(x)
    g, B = slope(x, fx), np.eye(len(x))
    for _ in range(steps):
        d = -B @ g
        if d @ g >= 0:
            B, d = np.eye(len(x)), -g
        step = min(1.0, 3.0 / max(1e-12, np.abs(d).max()))
        while step > 1e-8 and not (new := f(x + step * d)) < fx + 1e-4 * step * (d @ g):
            step /= 2
        if step <= 1e-8:
            break
        s = step * d
        x, done, fx = x + s, abs(fx - new) < tolerance * (1 + abs(fx)), new
        fresh = slope(x, fx)
        k = fresh - g
        g = fresh
        if done:
            break
        if s @ k > 1e-10:
            r, one = 1 / (s @ k), np.eye(len(x))
            B = (one - r * np.outer(s, k)) @ B @ (one - r * np.outer(k, s)) + r * np.outer(s, s)
    return x, fx


def estimated(model: Model, y: np.ndarray, free_q: list[int], free_h: list[int], start: list[float]) -> tuple[Model, float]:
    """The model with maximum-likelihood variances; start: log variances, of h first."""

    def put(x):
        v = np.exp(np.clip(x, -30, 15))
        q, h = model.q.copy(), model.h.copy()
        h[free_h], q[free_q] = v[: len(free_h)], v[len(free_h) :]
        return Model(model.T, model.Z, q, h, model.p1, model.names)

    def loss(x):
        value = -filtered(put(x), y)["loglik"]
        return value if np.isfinite(value) else 1e10

    x, value = minimised(loss, np.array(start))
    return put(x), -value


def forecast(model: Model, y: np.ndarray, row: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and standard errors of one observation row: the smoothed signal, then predictions `steps` ahead (with observation error)."""
    a, P = smoothed(model, y)
    z = model.Z[row]
    mean, var = a @ z, np.einsum("i,tij,j->t", z, P, z)
    x, V = a[-1], P[-1]
    for _ in range(steps):
        x, V = model.T @ x, model.T @ V @ model.T.T + np.diag(model.q)
        mean, var = np.append(mean, z @ x), np.append(var, z @ V @ z + model.h[row])
    return mean, np.sqrt(np.maximum(var, 0))


def hodrick_prescott(y: np.ndarray, weight: float = 1600.0) -> np.ndarray:
    """The trend whose second differences are penalised; below four points y itself. The system has five bands: it is factored in them, in time and memory that grow with the points."""
    n = len(y)
    if n < 4:
        return y.copy()
    middle, beside = np.full(n, 1 + 6 * weight), np.full(n - 1, -4 * weight)
    middle[[0, -1]], middle[[1, -2]] = 1 + weight, 1 + 5 * weight
    beside[[0, -1]] = -2 * weight
    return five_bands(middle.tolist(), beside.tolist(), [float(weight)] * (n - 2), y)


def five_bands(middle: list[float], beside: list[float], outer: list[float], y: np.ndarray) -> np.ndarray:
    """The solution of a symmetric positive system whose rows reach two places to either side, by its factors in the bands."""
    n = len(middle)
    d, one, two, z = [0.0] * n, [0.0] * n, [0.0] * n, [float(v) for v in y]
    for i in range(n):
        a, b, at = middle[i], beside[i] if i < n - 1 else 0.0, z[i]
        if i:
            a -= one[i - 1] ** 2 * d[i - 1]
            b -= two[i - 1] * one[i - 1] * d[i - 1]
            at -= one[i - 1] * z[i - 1]
        if i > 1:
            a -= two[i - 2] ** 2 * d[i - 2]
            at -= two[i - 2] * z[i - 2]
        d[i], one[i], two[i], z[i] = a, b / a, outer[i] / a if i < n - 2 else 0.0, at
    for i in reversed(range(n)):
        z[i] = z[i] / d[i] - (one[i] * z[i + 1] if i < n - 1 else 0.0) - (two[i] * z[i + 2] if i < n - 2 else 0.0)
    return np.array(z)


def local_regression(x: np.ndarray, y: np.ndarray, at: np.ndarray, span: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """Local quadratic regression with tricube weights over the nearest span of points; values and standard errors, NaN where it has none."""
    n = len(x)
    k = max(4, min(n, int(np.ceil(span * n))))
    scale = max(np.ptp(x), 1e-12)

    def weights(p):
        d = np.abs(x - p) / scale
        reach = np.sort(d)[k - 1] * max(1.0, span)
        w = np.where(d < reach * (1 + 1e-9), (1 - np.minimum(d / max(reach * (1 + 1e-9), 1e-12), 1) ** 3) ** 3, 0.0)
        X = np.stack([np.ones(n), (x - p) / scale, ((x - p) / scale) ** 2], 1)
        return np.linalg.pinv(X.T @ (w[:, None] * X))[0] @ (X * w[:, None]).T

    own = np.stack([weights(p) for p in x])
    left = (np.eye(n) - own).T @ (np.eye(n) - own)
    residual = y - own @ y
    sigma = np.sqrt(residual @ residual / max(np.trace(left), 1e-9))
    rows = np.stack([weights(p) for p in at])
    return rows @ y, sigma * np.sqrt((rows**2).sum(1))


def adaptive_metropolis(log_density, starts: np.ndarray, draws: int, warmup: int, seed: int, scale: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """(chains x draws x parameters, acceptance rates) of random walks whose proposals learn the covariance of all of them during warm-up and then stay.

    log_density takes a point of each chain, one a row, and gives their log densities: chains move together, one call a step. Each chain has a generator of its own.
    """
    x = np.array(starts, float)
    c, d = x.shape
    rngs = [np.random.default_rng(seed + k) for k in range(c)]
    value = log_density(x)
    factor, history, kept, accepted = np.ones(c), [], [], np.zeros(c)
    root = np.repeat((np.eye(d) * scale)[None], c, 0)
    for t in range(warmup + draws):
        step = np.stack([r.standard_normal(d) for r in rngs])
        new = x + factor[:, None] * (root @ step[:, :, None])[:, :, 0]
        there = log_density(new)
        ok = np.log([r.random() for r in rngs]) < there - value
        x, value = np.where(ok[:, None], new, x), np.where(ok, there, value)
        if t < warmup:
            history.append(x)
            factor *= np.exp((ok - 0.28) / np.sqrt(t + 1))
            if (t + 1) * c >= 20 * d and t % 25 == 24:
                seen = np.array(history[len(history) // 2 :]).reshape(-1, d)
                root = np.repeat(np.linalg.cholesky(np.cov(seen.T).reshape(d, d) * 2.38**2 / d + 1e-8 * np.eye(d))[None], c, 0)
        else:
            accepted += ok
            kept.append(x)
    return np.array(kept).reshape(-1, c, d).transpose(1, 0, 2), accepted / max(1, draws)


def effective_draws(chains: np.ndarray) -> np.ndarray:
    """How many independent draws each parameter's draws are worth: all of them over one plus twice the autocorrelations, up to the first pair that sums below zero. chains: chains x draws x parameters."""
    c, n, d = chains.shape
    centred = chains - chains.mean(1, keepdims=True)
    spectrum = np.fft.rfft(centred, 2 * n, axis=1)
    cov = np.fft.irfft(spectrum * spectrum.conj(), axis=1)[:, :n].mean(0) / n
    within = cov[0] * n / max(1, n - 1)
    between = chains.mean(1).var(0, ddof=1) if c > 1 else np.zeros(d)
    whole = np.maximum(within * (n - 1) / n + between, 1e-300)
    rho = 1 - (within - cov) / whole
    out = np.empty(d)
    for k in range(d):
        pairs = rho[1 : 1 + 2 * ((n - 1) // 2), k].reshape(-1, 2).sum(1)
        stop = np.flatnonzero(pairs < 0)
        out[k] = c * n / max(1e-12, 1 + 2 * pairs[: stop[0] if len(stop) else None].sum())
    return np.minimum(out, c * n)


def split_rhat(chains: list[np.ndarray]) -> np.ndarray:
    """Gelman and Rubin's ratio of each parameter, of chains cut in halves; near 1 when they agree."""
    halves = [h for c in chains for h in (c[: len(c) // 2], c[len(c) // 2 : 2 * (len(c) // 2)])]
    n, means = len(halves[0]), np.array([h.mean(0) for h in halves])
    within, between = np.mean([h.var(0, ddof=1) for h in halves], 0), n * means.var(0, ddof=1)
    return np.sqrt(((n - 1) / n * within + between / n) / np.maximum(within, 1e-300))
