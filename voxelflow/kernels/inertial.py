"""States, preintegrated inertial factors and their residuals.

Error vectors of a state are ordered rotation, position, velocity, gyro bias, accelerometer bias, three numbers each.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np

from .rotation import exp, exp_rate, hat, log, right_jacobian, right_jacobian_inverse

R, P, V, BG, BA = (slice(3 * k, 3 * k + 3) for k in range(5))
DIM = 15
zeros = lambda *s: field(default_factory=lambda: np.zeros(s))
eye = lambda n: field(default_factory=lambda: np.eye(n))


@dataclass
class State:
    t: float = 0.0
    r: np.ndarray = eye(3)
    p: np.ndarray = zeros(3)
    v: np.ndarray = zeros(3)
    bg: np.ndarray = zeros(3)
    ba: np.ndarray = zeros(3)
    g: np.ndarray = field(default_factory=lambda: np.array([0.0, 0.0, -9.8]))
    cov: np.ndarray = eye(DIM)

    def plus(self, d: np.ndarray) -> State:
        """The state moved by an error vector (rotation on the right)."""
        return replace(self, r=self.r @ exp(d[R]), p=self.p + d[P], v=self.v + d[V], bg=self.bg + d[BG], ba=self.ba + d[BA])

    def minus(self, other: State) -> np.ndarray:
        """The error vector that takes other to this state."""
        return np.concatenate([log(other.r.T @ self.r), self.p - other.p, self.v - other.v, self.bg - other.bg, self.ba - other.ba])


@dataclass
class Noise:
    gyro: float = 1e-3
    acc: float = 1e-2
    walk_gyro: float = 1e-5
    walk_acc: float = 1e-4


@dataclass
class Delta:
    """What a run of readings adds up to, apart from the state that it starts in, with derivatives by the biases and a covariance."""

    dt: float = 0.0
    r: np.ndarray = eye(3)
    p: np.ndarray = zeros(3)
    v: np.ndarray = zeros(3)
    r_bg: np.ndarray = zeros(3, 3)
    p_bg: np.ndarray = zeros(3, 3)
    p_ba: np.ndarray = zeros(3, 3)
    v_bg: np.ndarray = zeros(3, 3)
    v_ba: np.ndarray = zeros(3, 3)
    cov: np.ndarray = zeros(DIM, DIM)

    def then(self, o: Delta) -> Delta:
        """This run followed by o. It is associative, so runs can be folded in parts and the parts merged in order."""
        turn, a, b = o.r.T, np.eye(DIM), np.eye(DIM)
        a[R, R], a[P, R], a[P, V], a[V, R] = turn, -self.r @ hat(o.p), np.eye(3) * o.dt, -self.r @ hat(o.v)
        b[P, P] = b[V, V] = self.r
        return Delta(
            dt=self.dt + o.dt, r=self.r @ o.r, p=self.p + self.v * o.dt + self.r @ o.p, v=self.v + self.r @ o.v,
            r_bg=turn @ self.r_bg + o.r_bg,
            p_bg=self.p_bg + self.v_bg * o.dt + self.r @ (o.p_bg - hat(o.p) @ self.r_bg), p_ba=self.p_ba + self.v_ba * o.dt + self.r @ o.p_ba,
            v_bg=self.v_bg + self.r @ (o.v_bg - hat(o.v) @ self.r_bg), v_ba=self.v_ba + self.r @ o.v_ba,
            cov=a @ self.cov @ a.T + b @ o.cov @ b.T,
        )


def step(gyro: np.ndarray, acc: np.ndarray, dt: float, noise: Noise) -> Delta:
    """One interval of constant rates, free of bias."""
    half, jac = 0.5 * dt * dt * np.eye(3), right_jacobian(gyro * dt)
    b = np.zeros((9, 6))
    b[R, :3], b[P, 3:], b[V, 3:] = jac * dt, half, dt * np.eye(3)
    cov = np.zeros((DIM, DIM))
    cov[:9, :9] = b @ np.diag([noise.gyro] * 3 + [noise.acc] * 3) @ b.T
    cov[9:, 9:] = np.diag([noise.walk_gyro] * 3 + [noise.walk_acc] * 3) * dt
    return Delta(dt=dt, r=exp_rate(gyro, dt), p=half @ acc, v=acc * dt, r_bg=-jac * dt, p_ba=-half, v_ba=-dt * np.eye(3), cov=cov)


def preintegrate(t: np.ndarray, gyro: np.ndarray, acc: np.ndarray, bg: np.ndarray, ba: np.ndarray, scale: float = 1.0, noise: Noise | None = None) -> Delta:
    """The Delta of readings in order of time, each interval at the mean of its ends."""
    out, noise = Delta(), noise or Noise()
    for k in range(1, len(t)):
        out = out.then(step((gyro[k - 1] + gyro[k]) / 2 - bg, (acc[k - 1] + acc[k]) / 2 * scale - ba, float(t[k] - t[k - 1]), noise))
    return out


def residual(d: Delta, a: State, b: State, dbg: np.ndarray, dba: np.ndarray) -> tuple[np.ndarray, dict]:
    """How b differs from a moved by d (biases changed by dbg, dba since), and what the Jacobians need."""
    turn = d.r @ exp(d.r_bg @ dbg)
    rel_v = a.r.T @ (b.v - a.v - d.dt * a.g)
    rel_p = a.r.T @ (b.p - a.p - a.v * d.dt - 0.5 * d.dt**2 * a.g)
    rot = turn.T @ a.r.T @ b.r
    res = np.concatenate([log(rot), rel_p - (d.p + d.p_bg @ dbg + d.p_ba @ dba), rel_v - (d.v + d.v_bg @ dbg + d.v_ba @ dba), b.bg - a.bg, b.ba - a.ba])
    return res, {"rot": rot, "rel_v": rel_v, "rel_p": rel_p}


def jacobians(d: Delta, a: State, b: State, dbg: np.ndarray, at: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the residual by the errors of a and of b, and by the gravity."""
    ja, jb, jg, inv, back = np.zeros((DIM, DIM)), np.zeros((DIM, DIM)), np.zeros((DIM, 3)), right_jacobian_inverse(at["rot"]), a.r.T
    ja[R, R], jb[R, R] = -inv @ b.r.T @ a.r, inv
    ja[R, BG] = -inv @ at["rot"].T @ right_jacobian(d.r_bg @ dbg) @ d.r_bg
    ja[P, R], ja[P, P], ja[P, V], ja[P, BG], ja[P, BA], jb[P, P] = hat(at["rel_p"]), -back, -back * d.dt, -d.p_bg, -d.p_ba, back
    ja[V, R], ja[V, V], ja[V, BG], ja[V, BA], jb[V, V] = hat(at["rel_v"]), -back, -d.v_bg, -d.v_ba, back
    for s in (BG, BA):
        ja[s, s], jb[s, s] = -np.eye(3), np.eye(3)
    jg[P], jg[V] = -0.5 * d.dt**2 * back, -d.dt * back
    return ja, jb, jg


def factor(d: Delta, a: State, b: State, dbg: np.ndarray, dba: np.ndarray, gravity: bool = False, derivatives: bool = True) -> tuple[float, np.ndarray | None, np.ndarray | None]:
    """Cost of the factor, and J^T W J and J^T W r over (a, b) or (a, b, gravity)."""
    res, at = residual(d, a, b, dbg, dba)
    weight = np.linalg.inv(d.cov)
    if not derivatives:
        return float(res @ weight @ res), None, None
    ja, jb, jg = jacobians(d, a, b, dbg, at)
    j = np.hstack([ja, jb, jg] if gravity else [ja, jb])
    return float(res @ weight @ res), j.T @ weight @ j, j.T @ weight @ res


def propagate(x: State, t: np.ndarray, gyro: np.ndarray, acc: np.ndarray, begin: float, end: float, scale: float = 1.0, noise: Noise | None = None) -> tuple[State, list[tuple]]:
    """The state at `end` from readings around (begin, end], and the poses (t, r, p, v, gyro, acc) at which intervals start. The first interval begins no earlier than `begin`; the last rates are carried to `end`, forward or back."""
    noise, poses = noise or Noise(), []
    r, p, v, cov, w, a = x.r, x.p, x.v, x.cov, np.zeros(3), np.zeros(3)
    for k in range(len(t) - 1):
        if t[k + 1] <= begin:
            continue
        now = max(float(t[k]), begin)
        dt, w = float(t[k + 1]) - now, (gyro[k] + gyro[k + 1]) / 2 - x.bg
        body = (acc[k] + acc[k + 1]) / 2 * scale - x.ba
        a = r @ body + x.g
        poses.append((now, r, p, v, w, a))
        f, q = np.eye(DIM), np.zeros((DIM, DIM))
        f[R, R], f[R, BG], f[P, V], f[V, R], f[V, BA] = exp_rate(w, -dt), -np.eye(3) * dt, np.eye(3) * dt, -r @ hat(body) * dt, -r * dt
        q[R, R], q[V, V], q[BG, BG], q[BA, BA] = (n * np.eye(3) * dt * dt for n in (noise.gyro, noise.acc, noise.walk_gyro, noise.walk_acc))
        cov = f @ cov @ f.T + q
        p, v, r = p + v * dt + 0.5 * a * dt * dt, v + a * dt, r @ exp_rate(w, dt)
    dt = end - (float(t[-1]) if len(t) else begin)
    return replace(x, t=end, r=r @ exp_rate(w, dt), p=p + v * dt + 0.5 * a * dt * dt, v=v + a * dt, cov=cov), poses


def deskew(points: np.ndarray, times: np.ndarray, poses: list[tuple], end: State, ext_r: np.ndarray, ext_p: np.ndarray) -> np.ndarray:
    """Points moved to where the sensor saw them from at the scan's end: each from the latest pose strictly before it; those before all poses stay."""
    out, starts = points.astype(float).copy(), np.array([q[0] for q in poses])
    which = np.searchsorted(starts, times, "left") - 1
    for k in np.unique(which[which >= 0]):
        t0, r, p, v, w, a = poses[k]
        for i in np.flatnonzero(which == k):
            dt = times[i] - t0
            world = r @ exp_rate(w, dt) @ (ext_r @ points[i] + ext_p) + p + v * dt + 0.5 * a * dt * dt
            out[i] = ext_r.T @ (end.r.T @ (world - end.p) - ext_p)
    return out


def gravity_to_z(states: list[State]) -> list[State]:
    """All states turned so that the gravity of the first points along z (down or up, as it nearly did); one that does already stays."""
    g = states[0].g
    target = np.array([0.0, 0.0, np.sign(g[2]) or -1.0])
    axis = np.cross(g / np.linalg.norm(g), target)
    s = float(np.linalg.norm(axis))
    if s < 1e-12:
        return states
    turn = exp(axis / s * np.arctan2(s, float(g @ target) / float(np.linalg.norm(g))))
    return [replace(x, r=turn @ x.r, p=turn @ x.p, v=turn @ x.v, g=turn @ x.g) for x in states]
