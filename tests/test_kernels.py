import numpy as np
import pytest

from voxelflow.kernels import bundle, filter as ekf
from voxelflow.kernels.inertial import DIM, Delta, State, deskew, factor, gravity_to_z, jacobians, preintegrate, propagate, residual
from voxelflow.kernels.rotation import exp, log, right_jacobian, right_jacobian_inverse

rng = np.random.default_rng(4)


def some_state(spread=0.1):
    return State().plus(rng.normal(size=DIM) * spread)


@pytest.mark.parametrize("scale", [1e-12, 1e-5, 0.1, 1.0, 3.0])
def test_log_undoes_exp(scale):
    w = rng.normal(size=3)
    w *= scale / np.linalg.norm(w)
    assert np.allclose(log(exp(w)), w, atol=1e-8)


def test_right_jacobian():
    w, d = rng.uniform(-1.5, 1.5, 3), rng.normal(size=3) * 1e-6
    assert np.allclose(log(exp(w).T @ exp(w + d)), right_jacobian(w) @ d, atol=1e-11)
    assert np.allclose(right_jacobian(w) @ right_jacobian_inverse(exp(w)), np.eye(3), atol=1e-9)


def readings(n=40):
    return np.cumsum(rng.uniform(0.004, 0.006, n)), rng.normal(size=(n, 3)), rng.normal(size=(n, 3)) * 3


@pytest.mark.parametrize("cut", [1, 7, 20, 38])
def test_merged_preintegration_is_the_whole(cut):
    t, g, a = readings()
    bg, ba = np.full(3, 0.01), np.full(3, 0.1)
    whole = preintegrate(t, g, a, bg, ba)
    parts = preintegrate(t[: cut + 1], g[: cut + 1], a[: cut + 1], bg, ba).then(preintegrate(t[cut:], g[cut:], a[cut:], bg, ba))
    for f in Delta.__dataclass_fields__:
        assert np.allclose(getattr(whole, f), getattr(parts, f), atol=1e-13)


def test_factor_jacobians():
    t, g, a = readings()
    d, x, y, zero = preintegrate(t, g, a, np.zeros(3), np.zeros(3)), some_state(), some_state(), np.zeros(3)
    _, at = residual(d, x, y, zero, zero)
    jx, jy, _ = jacobians(d, x, y, zero, at)
    for k in range(DIM):
        e = np.zeros(DIM)
        e[k] = 1e-6
        nx = (residual(d, x.plus(e), y, e[9:12], e[12:])[0] - residual(d, x.plus(-e), y, -e[9:12], -e[12:])[0]) / 2e-6
        ny = (residual(d, x, y.plus(e), zero, zero)[0] - residual(d, x, y.plus(-e), zero, zero)[0]) / 2e-6
        assert np.allclose(nx, jx[:, k], atol=1e-7) and np.allclose(ny, jy[:, k], atol=1e-7)
    cost, h, _ = factor(d, x, y, zero, zero, gravity=True)
    assert h.shape == (33, 33) and cost > 0


def walls(n=60):
    """Points on six walls of a room, in the world."""
    out = []
    for axis in range(3):
        for side in (-4.0, 4.0):
            p = rng.uniform(-4, 4, (n, 3))
            p[:, axis] = side
            out.append(p)
    return out


def window(poses, noise=0.0):
    """Clusters of each wall as each pose sees them."""
    s = np.zeros((6, len(poses), 4, 4))
    for f, x in enumerate(poses):
        for v, p in enumerate(walls()):
            local = (p - x.p) @ x.r + rng.normal(size=p.shape) * noise
            s[v, f] = bundle.moment(local)
    return s


def test_lidar_derivatives():
    poses = [some_state() for _ in range(3)]
    s, fixed, w = window(poses, 0.05), np.zeros((6, 4, 4)), np.ones(6)
    start = [p.plus(np.concatenate([rng.normal(size=6) * 0.02, np.zeros(9)])) for p in poses]

    def cost(d):
        return bundle.lidar_cost(s, bundle.frames_of([x.plus(np.concatenate([d[6 * i : 6 * i + 6], np.zeros(9)])) for i, x in enumerate(start)]), fixed, w)

    c, g, h = bundle.lidar_terms(s, bundle.frames_of(start), fixed, w)
    e = np.eye(18) * 1e-4
    assert np.isclose(c, cost(np.zeros(18)))
    assert np.allclose(g, [(cost(v) - cost(-v)) / 2e-4 for v in e], atol=1e-6)
    assert np.allclose(h, [[(cost(a + b) - cost(a - b) - cost(b - a) + cost(-a - b)) / 4e-8 for b in e] for a in e], atol=1e-5)


def test_adjustment_finds_the_poses():
    truth = [State(p=np.array([0.1 * i, 0.05 * i, 0.0]), r=exp(np.array([0, 0, 0.03 * i]))) for i in range(4)]
    s, fixed, w = window(truth), np.zeros((6, 4, 4)), np.ones(6)
    start = [truth[0], *(x.plus(np.concatenate([rng.normal(size=6) * 0.01, np.zeros(9)])) for x in truth[1:])]
    found, costs = bundle.adjust(start, lambda t: bundle.lidar_terms(s, t, fixed, w), lambda t: bundle.lidar_cost(s, t, fixed, w), max_iter=20)
    assert costs[-1] < costs[0] * 1e-3
    for a, b in zip(found, truth, strict=True):
        assert np.linalg.norm(a.minus(b)[:6]) < 1e-3


def test_propagation_of_a_still_sensor():
    t = np.arange(0, 1.01, 0.01)
    x, poses = propagate(State(), t, np.zeros((101, 3)), np.tile([0, 0, 9.8], (101, 1)), 0.0, 1.0)
    assert np.allclose(x.p, 0, atol=1e-9) and np.allclose(x.r, np.eye(3)) and len(poses) == 100
    points = rng.normal(size=(5, 3))
    assert np.allclose(deskew(points, np.linspace(0.05, 0.9, 5), poses, x, np.eye(3), np.zeros(3)), points)


def test_points_before_all_poses_stay():
    x, poses = propagate(State(v=np.array([1.0, 0, 0])), np.array([0.5, 1.0]), np.zeros((2, 3)), np.tile([0, 0, 9.8], (2, 1)), 0.5, 1.0)
    p = np.array([[1.0, 2, 3], [1.0, 2, 3]])
    moved = deskew(p, np.array([0.5, 0.75]), poses, x, np.eye(3), np.zeros(3))
    assert np.allclose(moved[0], p[0]) and np.allclose(moved[1], [0.75, 2, 3])


def test_filter_reaches_the_match():
    truth = State(p=np.array([0.2, -0.1, 0.05]), r=exp(np.array([0.02, -0.01, 0.03])))
    n = rng.normal(size=(300, 3))
    n /= np.linalg.norm(n, axis=1)[:, None]
    q = rng.normal(size=(300, 3)) * 3
    body = (q - truth.p) @ truth.r

    def match(x):
        j = np.hstack([np.cross(body, n @ x.r), n])
        r = np.einsum("ij,ij->i", n, body @ x.r.T + x.p - q)
        return 1e4 * j.T @ j, -1e4 * j.T @ r, n.T @ n

    x, posed, used = ekf.iterate(State(), match)
    assert posed and used <= 4 and np.linalg.norm(x.minus(truth)[:6]) < 1e-3
    corridor = ekf.iterate(State(), lambda s: (*match(s)[:2], np.diag([100.0, 100, 0])))
    assert not corridor[1]


def test_gravity_is_turned_to_z():
    states = [State(g=np.array([1.0, 0.5, -9.7])), some_state()]
    turned = gravity_to_z(states)
    assert np.allclose(turned[0].g[:2], 0, atol=1e-12) and np.isclose(np.linalg.norm(turned[0].g), np.linalg.norm(states[0].g))
    assert gravity_to_z([State()])[0].g[2] == -9.8


def test_normal_factor_gradient():
    poses, n = [some_state(), some_state()], rng.normal(size=(4, 3))
    n /= np.linalg.norm(n, axis=1)[:, None]
    world = np.roll(n, 1, axis=0)
    terms = lambda x: bundle.normal_terms(n, world, np.array([0, 0, 1, 1]), bundle.frames_of(x), np.ones(4))
    _, g, _ = terms(poses)
    for i in range(2):
        for k in range(6):
            d = np.zeros(DIM)
            d[k] = 1e-6
            up, down = ([x.plus(s * d) if j == i else x for j, x in enumerate(poses)] for s in (1, -1))
            assert np.isclose((terms(up)[0] - terms(down)[0]) / 2e-6, g[6 * i + k], atol=1e-6)
