"""Bundle adjustment of poses over planar voxels: exact derivatives of least eigenvalues, and a damped solver.

A frame's cluster is the 4x4 moment S = [[sum p p^T, sum p], [sum p^T, n]] in its own coordinates. With T = [R t] the
voxel's covariance is C = M / N - m m^T / N^2 for M = sum T S T^T and m = sum T S e4, so derivatives of C follow from
those of T, and those of its least eigenvalue from perturbation theory.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

from .inertial import DIM, Delta, State, factor
from .rotation import hat

BASIS = np.array([hat(e) for e in np.eye(3)])


def moment(points: np.ndarray) -> np.ndarray:
    """The 4x4 moment of points (a row each)."""
    h = np.hstack([points, np.ones((len(points), 1))])
    return h.T @ h


def frames_of(states: Sequence[State]) -> np.ndarray:
    return np.array([np.hstack([s.r, s.p[:, None]]) for s in states])


def _sums(s: np.ndarray, t: np.ndarray, fixed: np.ndarray) -> tuple[np.ndarray, ...]:
    st = np.einsum("vfab,fib->vfia", s, t)
    m2 = np.einsum("fia,vfja->vij", t, st) + fixed[:, :3, :3]
    m1 = st[..., 3].sum(axis=1) + fixed[:, :3, 3]
    n = s[:, :, 3, 3].sum(axis=1) + fixed[:, 3, 3]
    return st, m1, n, m2 / n[:, None, None] - np.einsum("vi,vj->vij", m1, m1) / (n * n)[:, None, None]


def lidar_cost(s: np.ndarray, t: np.ndarray, fixed: np.ndarray, weight: np.ndarray) -> float:
    """Weighted sum of the least eigenvalues. s: voxels x frames x 4 x 4; t: frames x 3 x 4; fixed: voxels x 4 x 4 in the world."""
    return float(weight @ np.linalg.eigvalsh(_sums(s, t, fixed)[3])[:, 0]) if len(s) else 0.0


def lidar_terms(s: np.ndarray, t: np.ndarray, fixed: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """lidar_cost, its gradient and Hessian by (rotation, translation) of each frame."""
    f = t.shape[0]
    if not len(s):
        return 0.0, np.zeros(6 * f), np.zeros((6 * f, 6 * f))
    st, m1, n, c = _sums(s, t, fixed)
    values, vectors = np.linalg.eigh(c)
    u = vectors[:, :, 0]
    d = np.zeros((f, 6, 3, 4))  # of T by each parameter
    d[:, :3, :, :3] = np.einsum("fij,kjl->fkil", t[:, :, :3], BASIS)
    d[:, 3:, :, 3] = np.eye(3)
    dst = np.einsum("fkia,vfab->vfkib", d, s)
    half = np.einsum("vfkib,fjb->vfkij", dst, t)
    dm = dst[..., 3]
    n1, n2 = n[:, None, None, None, None], (n * n)[:, None, None, None, None]
    outer = np.einsum("vfki,vj->vfkij", dm, m1)
    dc = (half + half.transpose(0, 1, 2, 4, 3)) / n1 - (outer + outer.transpose(0, 1, 2, 4, 3)) / n2
    du = np.einsum("vfkij,vj->vfki", dc, u)
    grad = np.einsum("vfki,vi->vfk", du, u)
    udm = np.einsum("vfki,vi->vfk", dm, u)
    um = np.einsum("vi,vi->v", u, m1)
    hess = -2 / (n * n)[:, None, None, None, None] * np.einsum("vfk,vgl->vfkgl", udm, udm)
    for k in (1, 2):
        a = np.einsum("vfki,vi->vfk", du, vectors[:, :, k])
        hess += (2 / np.minimum(values[:, 0] - values[:, k], -1e-9))[:, None, None, None, None] * np.einsum("vfk,vgl->vfkgl", a, a)
    ud = np.einsum("vi,fkia->vfka", u, d)
    same = 2 * np.einsum("vfka,vfab,vflb->vfkl", ud, s, ud) / n[:, None, None, None]
    two = (np.einsum("kij,ljm->klim", BASIS, BASIS) + np.einsum("lij,kjm->klim", BASIS, BASIS)) / 2
    ud2 = np.einsum("vi,fij,kljm->vfklm", u, t[:, :, :3], two)
    ust = np.einsum("vfia,vi->vfa", st, u)
    same[:, :, :3, :3] += 2 * np.einsum("vfklm,vfm->vfkl", ud2, ust[..., :3]) / n[:, None, None, None]
    same[:, :, :3, :3] -= 2 * (um / (n * n))[:, None, None, None] * np.einsum("vfklm,vfm->vfkl", ud2, s[:, :, :3, 3])
    for i in range(f):
        hess[:, i, :, i, :] += same[:, i]
    return float(weight @ values[:, 0]), np.einsum("v,vfk->fk", weight, grad).ravel(), np.einsum("v,vfkgl->fkgl", weight, hess).reshape(6 * f, 6 * f)


def normal_terms(scan: np.ndarray, world: np.ndarray, frame: np.ndarray, t: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Half the weighted squared part of each turned scan normal across its map normal, with gradient and Gauss-Newton Hessian by rotation."""
    f = t.shape[0]
    g, h, cost = np.zeros(6 * f), np.zeros((6 * f, 6 * f)), 0.0
    for n, m, i, w in zip(scan, world, frame, weight, strict=True):
        across = np.eye(3) - np.outer(m, m)
        r, j = across @ t[i, :, :3] @ n, -across @ t[i, :, :3] @ hat(n)
        at = slice(6 * i, 6 * i + 3)
        cost += 0.5 * w * float(r @ r)
        g[at] += w * j.T @ r
        h[at, at] += w * j.T @ j
    return cost, g, h


def adjust(states: list[State], terms: Callable, cost: Callable, deltas: Sequence[Delta] = (), gravity: bool = False, max_iter: int = 10, tol: float = 1e-6, lidar_weight: float = 1.0) -> tuple[list[State], list[float]]:
    """Damped least squares over states: lidar terms(frames) -> (cost, g, H), cost(frames) -> cost, and inertial deltas between neighbours.

    The first state stays (with gravity: its rotation and position), which fixes the gauge. Without deltas only poses
    move. A step that doesn't lower the cost is taken back and the damping grows. Returns the states and the costs.
    """
    n, extra = len(states), 3 if gravity else 0
    size = DIM * n + extra
    pose = np.concatenate([np.arange(DIM * i, DIM * i + 6) for i in range(n)])
    bias = [(np.zeros(3), np.zeros(3)) for _ in deltas]
    fixed = list(range(6 if gravity else DIM)) if len(deltas) else [*range(DIM), *(k for i in range(n) for k in range(DIM * i + 6, DIM * i + DIM))]

    def inertial(x: list[State], b: list, derivatives: bool) -> tuple[float, np.ndarray, np.ndarray]:
        total, g, h = 0.0, np.zeros(size), np.zeros((size, size))
        for i, d in enumerate(deltas):
            c, jj, jr = factor(d, x[i], x[i + 1], *b[i], gravity=gravity, derivatives=derivatives)
            total += c
            if derivatives:
                at = np.concatenate([np.arange(DIM * i, DIM * i + 2 * DIM), np.arange(DIM * n, size)])
                h[np.ix_(at, at)] += jj
                g[at] += jr
        return total, g, h

    damping, grow, costs, fresh = 0.01, 2.0, [], True
    for _ in range(max_iter):
        if fresh:
            now, g, h = inertial(states, bias, True)
            c, gl, hl = terms(frames_of(states))
            now += lidar_weight * c
            g[pose] += lidar_weight * gl / 2
            h[np.ix_(pose, pose)] += lidar_weight * hl / 2
            h[fixed, :] = h[:, fixed] = 0
            h[fixed, fixed], g[fixed] = 1, 0
            costs.append(now)
        diag = np.diag(np.maximum(np.diag(h), 1e-12))
        move = np.linalg.solve(h + damping * diag, -g)
        tried = [s.plus(move[DIM * i : DIM * i + DIM]) for i, s in enumerate(states)]
        if gravity:
            for s in tried:
                s.g = s.g + move[DIM * n :]
        tried_bias = [(b + move[DIM * i + 9 : DIM * i + 12], a + move[DIM * i + 12 : DIM * i + 15]) for i, (b, a) in enumerate(bias)]
        then = inertial(tried, tried_bias, False)[0] + lidar_weight * cost(frames_of(tried))
        if now > then:
            gain = (now - then) / max(float(move @ (damping * diag @ move - g)), 1e-300)
            states, bias, fresh, grow = tried, tried_bias, True, 2.0
            damping *= max(1 / 3, 1 - (2 * gain - 1) ** 3)
        else:
            fresh, damping, grow = False, damping * grow, 2 * grow
        if abs(now - then) < tol * abs(now):
            break
    return states, [*costs, min(now, then)]
