"""Camera calibration from stored point pairs: intrinsics from boards, extrinsics from a scene."""

from __future__ import annotations

import numpy as np

from kinelake.functions.linalg import distort, rodrigues, rotation_vector


def project(k: np.ndarray, dist: np.ndarray, rvec: np.ndarray, tvec: np.ndarray, points: np.ndarray) -> np.ndarray:
    c = points @ rodrigues(rvec).T + tvec
    xy = distort(c[:, :2] / c[:, 2:], dist)
    return xy * [k[0, 0], k[1, 1]] + [k[0, 2], k[1, 2]]


def refine(residual, start: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Levenberg-Marquardt with numeric derivatives."""
    x, damping = start.astype(float), 1e-3
    r = residual(x)
    for _ in range(rounds):
        step = 1e-6 * np.maximum(np.abs(x), 1.0)
        j = np.stack([(residual(x + e) - r) / s for e, s in zip(np.diag(step), step, strict=True)], axis=1)
        h, g = j.T @ j, j.T @ r
        while damping < 1e12:
            trial = x - np.linalg.solve(h + damping * np.diag(np.diag(h) + 1e-12), g)
            t = residual(trial)
            if t @ t < r @ r:
                break
            damping *= 10
        else:
            break
        gain = r @ r - t @ t
        x, r, damping = trial, t, max(damping / 10, 1e-12)
        if gain < 1e-14 * max(1.0, r @ r):
            break
    return x


def _normaliser(p: np.ndarray) -> np.ndarray:
    d = p.shape[1]
    centre = p.mean(axis=0)
    s = np.sqrt(d) / max(np.sqrt(((p - centre) ** 2).sum(axis=1)).mean(), 1e-12)
    t = np.eye(d + 1) * s
    t[:d, d], t[d, d] = -s * centre, 1
    return t


def homography(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The plane mapping that sends points a to b, by the normalised direct linear transform."""
    ta, tb = _normaliser(a), _normaliser(b)
    ha, hb = (np.c_[p, np.ones(len(p))] @ t.T for p, t in ((a, ta), (b, tb)))
    rows = np.concatenate([np.c_[ha * hb[:, 2:], np.zeros_like(ha), -ha * hb[:, :1]], np.c_[np.zeros_like(ha), ha * hb[:, 2:], -ha * hb[:, 1:2]]])
    h = np.linalg.svd(rows)[2][-1].reshape(3, 3)
    return np.linalg.inv(tb) @ h @ ta


def extrinsics(image: np.ndarray, world: np.ndarray, k: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Rotation vector, translation, root mean and root sum of squared pixel errors from six or more points."""
    from kinelake.functions.linalg import undistort

    xy = undistort(image, k, dist, np.eye(3))
    tw, ti = _normaliser(world), _normaliser(xy)
    hw, hi = np.c_[world, np.ones(len(world))] @ tw.T, np.c_[xy, np.ones(len(xy))] @ ti.T
    rows = np.concatenate([np.c_[hw, np.zeros_like(hw), -hw * hi[:, :1]], np.c_[np.zeros_like(hw), hw, -hw * hi[:, 1:2]]])
    p = np.linalg.inv(ti) @ np.linalg.svd(rows)[2][-1].reshape(3, 4) @ tw
    u, s, v = np.linalg.svd(p[:, :3])
    sign = np.sign(np.linalg.det(u @ v))
    r, t = sign * u @ v, sign * p[:, 3] / s.mean()
    x = refine(lambda q: (project(k, dist, q[:3], q[3:], world) - image).ravel(), np.r_[rotation_vector(r), t])
    e = project(k, dist, x[:3], x[3:], world) - image
    total = float((e**2).sum())
    return x[:3], x[3:], float(np.sqrt(total / len(image))), float(np.sqrt(total))


def intrinsics(images: list[np.ndarray], boards: list[np.ndarray], size: tuple[float, float]) -> tuple[np.ndarray, np.ndarray, float]:
    """K, distortion (k1, k2, p1, p2) and root mean squared pixel error from views of a flat board (z = 0)."""
    hs = [homography(b[:, :2], a) for a, b in zip(images, boards, strict=True)]

    def v(h: np.ndarray, i: int, j: int) -> np.ndarray:
        return np.array([h[0, i] * h[0, j], h[0, i] * h[1, j] + h[1, i] * h[0, j], h[1, i] * h[1, j], h[2, i] * h[0, j] + h[0, i] * h[2, j], h[2, i] * h[1, j] + h[1, i] * h[2, j], h[2, i] * h[2, j]])

    # Principal point at the middle to begin with: only the two focal lengths are open.
    centre = np.array([[1, 0, -size[0] / 2], [0, 1, -size[1] / 2], [0, 0, 1.0]])
    rows, right = [], []
    for h in hs:
        h = centre @ h
        for c in (v(h, 0, 1), v(h, 0, 0) - v(h, 1, 1)):
            rows.append([c[0], c[2]])
            right.append(-c[5])
    a, b = np.abs(np.linalg.lstsq(np.array(rows), np.array(right), rcond=None)[0])
    k = np.array([[1 / np.sqrt(a), 0, size[0] / 2], [0, 1 / np.sqrt(b), size[1] / 2], [0, 0, 1]])
    poses = []
    for h in hs:
        m = np.linalg.inv(k) @ h
        m = m / np.linalg.norm(m[:, 0]) * (1 if m[2, 2] > 0 else -1)
        u, _, w = np.linalg.svd(np.c_[m[:, 0], m[:, 1], np.cross(m[:, 0], m[:, 1])])
        poses.append(np.r_[rotation_vector(u @ w), m[:, 2]])

    def residual(x: np.ndarray) -> np.ndarray:
        m = np.array([[x[0], 0, x[2]], [0, x[1], x[3]], [0, 0, 1]])
        return np.concatenate([(project(m, x[4:8], q[:3], q[3:], board) - image).ravel() for q, image, board in zip(x[8:].reshape(-1, 6), images, boards, strict=True)])

    x = refine(residual, np.r_[k[0, 0], k[1, 1], k[0, 2], k[1, 2], np.zeros(4), *poses])
    e = residual(x)
    return np.array([[x[0], 0, x[2]], [0, x[1], x[3]], [0, 0, 1]]), x[4:8], float(np.sqrt((e**2).sum() / (len(e) / 2)))
