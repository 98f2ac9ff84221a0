"""Gaussian mixture fitted by expectation-maximization, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


#: added to the covariances
RIDGE = 0.02


@dataclass
class Mixture:
    """Full-covariance mixture over standardized columns."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    centers: np.ndarray
    inverse: np.ndarray
    log_det: np.ndarray

    def posterior(self, x: np.ndarray) -> np.ndarray:
        """Responsibilities (rows sum to 1) of the components for raw rows."""
        z = (x - self.mean) / self.scale
        p = np.log(self.weights) - 0.5 * (self.log_det + _distance(z, self.centers, self.inverse))
        p -= p.max(1, keepdims=True)
        np.exp(p, out=p)
        return p / p.sum(1, keepdims=True)


    def sums(self, x: np.ndarray) -> np.ndarray:
        """What raw rows add to the next round of EM: for each component its mass, the sums of the standardized rows
        and of their products, and (in the first component only) the log-likelihood."""
        z = (x - self.mean) / self.scale
        n, d = z.shape
        p = np.log(self.weights) - 0.5 * (self.log_det + _distance(z, self.centers, self.inverse))
        top = p.max(1, keepdims=True) if n else np.zeros((0, 1))
        r = np.exp(p - top)
        s = r.sum(1, keepdims=True)
        r /= s
        out = np.zeros((len(self.weights), 2 + d + d * d))
        out[:, 0] = r.sum(0)
        out[:, 1 : 1 + d] = r.T @ z
        for k in range(len(out)):
            out[k, 1 + d : -1] = ((r[:, k, None] * z).T @ z).ravel()
        out[0, -1] = (top + np.log(s)).sum()
        return out

    def refit(self, sums: np.ndarray, ridge: float = RIDGE) -> tuple[Mixture, float]:
        """The mixture after a round with these ``sums`` and the mean log-likelihood before it."""
        d = self.centers.shape[1]
        mass = sums[:, 0] + 1e-9
        centers = sums[:, 1 : 1 + d] / mass[:, None]
        cov = sums[:, 1 + d : -1].reshape(-1, d, d) / mass[:, None, None] - centers[:, :, None] * centers[:, None, :]
        cov += ridge * np.eye(d)
        new = Mixture(self.mean, self.scale, mass / mass.sum(), centers, np.linalg.inv(cov), np.linalg.slogdet(cov)[1])
        return new, float(sums[0, -1] / mass.sum())


def _distance(z: np.ndarray, centers: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    out = np.empty((len(z), len(centers)))
    for k, (c, v) in enumerate(zip(centers, inverse, strict=True)):
        d = z - c
        out[:, k] = np.einsum("ij,jk,ik->i", d, v, d)
    return out


def fit(x: np.ndarray, components: int, mean: np.ndarray, scale: np.ndarray, seed: int = 0, rounds: int = 80, ridge: float = RIDGE, starts: np.ndarray | None = None) -> Mixture:
    """Fit by EM. ``mean`` and ``scale`` standardize (a zero scale counts as 1); ``starts`` are raw rows to
    begin centers from, the rest is chosen far apart (k-means++). ``ridge`` is added to the covariances."""
    rng = np.random.default_rng(seed)
    scale = np.where(scale > 0, scale, 1.0)
    z = (x - mean) / scale
    n, d = z.shape
    components = max(1, min(components, n))
    centers = [] if starts is None else list((starts - mean) / scale)[:components]
    if not centers:
        centers.append(z[rng.integers(n)])
    far = np.min([((z - c) ** 2).sum(1) for c in centers], axis=0)
    while len(centers) < components:
        total = far.sum()
        c = z[rng.choice(n, p=far / total)] if total > 0 else z[rng.integers(n)]
        centers.append(c)
        far = np.minimum(far, ((z - c) ** 2).sum(1))
    centers = np.array(centers)
    near = np.argmin(((z[:, None, :] - centers[None]) ** 2).sum(2), 1)
    r = np.full((n, components), 1e-3 / components)
    r[np.arange(n), near] += 1
    r /= r.sum(1, keepdims=True)
    last = -np.inf
    for _ in range(rounds):
        mass = r.sum(0) + 1e-9
        weights = mass / mass.sum()
        centers = (r.T @ z) / mass[:, None]
        cov = np.empty((components, d, d))
        for k in range(components):
            e = z - centers[k]
            cov[k] = (r[:, k, None] * e).T @ e / mass[k] + ridge * np.eye(d)
        inverse, log_det = np.linalg.inv(cov), np.linalg.slogdet(cov)[1]
        p = np.log(weights) - 0.5 * (log_det + _distance(z, centers, inverse))
        top = p.max(1, keepdims=True)
        r = np.exp(p - top)
        s = r.sum(1, keepdims=True)
        r /= s
        now = float((top + np.log(s)).mean())
        if now - last < 1e-5:
            break
        last = now
    return Mixture(mean, scale, weights, centers, inverse, log_det)
