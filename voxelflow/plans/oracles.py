"""DuckDB SQL of the registered queries, by their names; helpers build the parts that many of them share."""

from __future__ import annotations

from math import pi, radians, sin

from ..operators import points
from .sensor import DIGITS, LAYERS, LEAST, RATIO, SHIFT, SIZE, THIN, TURN

SYM = ("xx", "xy", "xz", "yy", "yz", "zz")
CLOUD = """cloud AS (SELECT CAST(l_linenumber AS BIGINT) AS scan, l_orderkey AS i, l_partkey AS pk, l_suppkey AS sk,
  (l_quantity - 25) / 7 AS x, (l_extendedprice - 50000) / 20999.3 AS y, (l_discount - 0.05) * 130 / 3.1 AS z,
  CAST(l_suppkey % 256 AS DOUBLE) AS intensity, CAST(round(l_tax * 100) AS BIGINT) * 15000000 AS offset_ns FROM lineitem)"""
SMALL = "small AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS frame, " + ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) * 10 AS {c}" for k, c in enumerate("xyz")) + " FROM embeddings)"
EVENTS = "ev AS (SELECT user_id AS session, epoch_us(ts) AS us, event_type AS kind, value, event_id AS id FROM events)"


def r(e: str, digits: int = 6) -> str:
    return f"round({e}, {digits}) + 0.0"


def key(c: str, size: float) -> str:
    return f"CAST(trunc(CASE WHEN {c} / {size} < 0 THEN {c} / {size} - 1 ELSE {c} / {size} END) AS BIGINT)"


def keys(size: float, names: tuple[str, ...] = ("vx", "vy", "vz")) -> str:
    return ", ".join(f"{key(c, size)} AS {n}" for c, n in zip("xyz", names, strict=True))


def keyed(name: str, source: str, size: float) -> str:
    return f"{name} AS (SELECT *, {keys(size)} FROM {source})"


def moments(name: str, source: str, by: str, size: float | None) -> str:
    """Moments about the voxel's centre, or (no size) the origin."""
    p = {a: f"({a} - (v{a} + 0.5) * {size})" if size else a for a in "xyz"}
    sums = [f"sum({p[a]}) AS s{a}" for a in "xyz"] + [f"sum({p[s[0]]} * {p[s[1]]}) AS s{s}" for s in SYM]
    return f"{name} AS (SELECT {by + ', ' if by else ''}count(*) AS n, {', '.join(sums)} FROM {source} {'GROUP BY ' + by if by else ''})"


def covariance(name: str, source: str, digits: int | None = None) -> str:
    entry = lambda s: f"s{s} / n - (s{s[0]} / n) * (s{s[1]} / n)"
    out = [f"s{a} / n AS m{a}" for a in "xyz"] + [f"{f'round({entry(s)}, {digits})' if digits else entry(s)} AS c{s}" for s in SYM]
    return f"{name} AS (SELECT *, {', '.join(out)} FROM {source})"


def eigen(name: str, source: str, digits: int | None = DIGITS) -> str:
    """name: source with l0, l1, l2."""
    v = lambda e: f"round({e}, {digits})" if digits else e
    return f"""{name}_q AS (SELECT *, (cxx + cyy + czz) / 3 AS q FROM {source}),
{name}_p AS (SELECT *, sqrt(((cxx - q) * (cxx - q) + (cyy - q) * (cyy - q) + (czz - q) * (czz - q) + 2 * (cxy * cxy + cxz * cxz + cyz * cyz)) / 6) AS p,
  (cxx - q) * ((cyy - q) * (czz - q) - cyz * cyz) - cxy * (cxy * (czz - q) - cyz * cxz) + cxz * (cxy * cyz - (cyy - q) * cxz) AS det FROM {name}_q),
{name}_a AS (SELECT *, acos(CASE WHEN p < 1e-15 THEN 0.0 ELSE greatest(-1.0, least(1.0, det / (2 * nullif(p * p * p, 0.0)))) END) / 3 AS phi FROM {name}_p),
{name}_l AS (SELECT *, q + 2 * p * cos(phi) AS hi, q + 2 * p * cos(phi + {2 * pi / 3!r}) AS lo FROM {name}_a),
{name} AS (SELECT * EXCLUDE (q, p, det, phi, hi, lo), {v('lo')} AS l0, {v('3 * q - lo - hi')} AS l1, {v('hi')} AS l2 FROM {name}_l)"""


def normals(name: str, source: str) -> str:
    at = lambda i, j, l: ("(c" + "xyz"[min(i, j)] + "xyz"[max(i, j)] + (f" - {l})" if i == j else ")"))  # noqa: E731, E741
    entry = lambda i, j: "(" + " + ".join(f"{at(i, k, 'l1')} * {at(k, j, 'l2')}" for k in range(3)) + ") / nullif((l0 - l1) * (l0 - l2), 0.0)"
    p = ", ".join(f"{entry('xyz'.index(s[0]), 'xyz'.index(s[1]))} AS p{s}" for s in SYM)
    pick = lambda x, y, z: f"(CASE WHEN pxx = top THEN {x} WHEN pyy = top THEN {y} ELSE {z} END) / sqrt(nullif(top, 0.0))"
    return f"""{name}_p AS (SELECT *, {p} FROM {source}),
{name}_t AS (SELECT *, greatest(pxx, pyy, pzz) AS top FROM {name}_p),
{name} AS (SELECT *, {pick('pxx', 'pxy', 'pxz')} AS nx, {pick('pxy', 'pyy', 'pyz')} AS ny, {pick('pxz', 'pyz', 'pzz')} AS nz FROM {name}_t)"""


def digits_sql(source: str, name: str, size: float, layers: int) -> str:
    """source (with voxel keys) and path."""
    ctes, before, quarter = [], source, size / 4
    centre = {a: f"(v{a} + 0.5) * {size}" for a in "xyz"}
    for k in range(layers):
        up = {a: f"CAST({a} > {centre[a]} AS INT)" for a in "xyz"}
        ctes.append(f"{name}_{k} AS (SELECT * {f'EXCLUDE (cx_, cy_, cz_)' if k else ''}, CAST(4 * {up['x']} + 2 * {up['y']} + {up['z']} AS VARCHAR) AS d{k}, " + ", ".join(f"{centre[a]} + (2 * {up[a]} - 1) * {quarter} AS c{a}_" for a in "xyz") + f" FROM {before})")
        before, quarter = f"{name}_{k}", quarter / 2
        centre = {a: f"c{a}_" for a in "xyz"}
    return ",\n".join(ctes) + f",\n{name} AS (SELECT * EXCLUDE (cx_, cy_, cz_), " + " || ".join(f"d{k}" for k in range(layers)) + f" AS path FROM {before})"


def octree(name: str, source: str, size: float, layers: int, thin: float, ratio, least, split=None, by: str = "", digits: int = DIGITS) -> str:  # noqa: ANN001
    """Leaf nodes of source (x, y, z and by): the levels as one CTE each."""
    k = f"{by}{', ' if by else ''}vx, vy, vz"
    ctes = [keyed(f"{name}_k", source, size)]
    todo = f"{name}_k"
    if layers:
        ctes.append(digits_sql(todo, f"{name}_d", size, layers))
        todo = f"{name}_d"
    else:
        ctes.append(f"{name}_d AS (SELECT *, '' AS path FROM {todo})")
        todo = f"{name}_d"
    ctes.append(f"{name}_t0 AS (SELECT * FROM {todo})")
    for layer in range(layers + 1):
        n = f"{name}_{layer}"
        ctes.append(f"{n}_s AS (SELECT * REPLACE (substr(path, 1, {layer}) AS path), path AS whole FROM {name}_t{layer})")
        ctes.append(moments(f"{n}_m", f"{n}_s", f"{k}, path", size))
        ctes.append(covariance(f"{n}_c", f"{n}_m", digits))
        ctes.append(eigen(f"{n}_e", f"{n}_c", digits))
        ctes.append(f"{n}_f AS (SELECT *, {layer} AS layer, n > {least[layer]} AND l0 < {thin} AND l0 < {ratio[layer]} * l2 AS is_plane FROM {n}_e)")
        ctes.append(f"{n} AS (SELECT *, n > {least[layer]} AND NOT is_plane AND {str(layer < layers).upper()}{f' AND n >= {split[layer]}' if split else ''} AS splits FROM {n}_f)")
        if layer < layers:
            on = " AND ".join(f"t.{c.strip()} = g.{c.strip()}" for c in k.split(","))
            ctes.append(f"{name}_t{layer + 1} AS (SELECT t.* FROM {name}_t{layer} t SEMI JOIN (SELECT * FROM {n} WHERE splits) g ON {on} AND substr(t.path, 1, {layer}) = g.path)")
    ctes.append(f"{name} AS (" + " UNION ALL BY NAME ".join(f"SELECT * FROM {name}_{layer} WHERE NOT splits" for layer in range(layers + 1)) + ")")
    return ",\n".join(ctes)


BEARING, DEPTH = sin(radians(0.05)) ** 2, 0.02**2


def with_variance(name: str, source: str) -> str:
    """The covariance by an explicit basis across the beam, where the library uses a closed form."""
    entry = lambda a, b: f"d{a} * d{b} * {DEPTH!r} + rr * {BEARING!r} * (u{a} * u{b} + w{a} * w{b})"
    return f"""{name}_z AS (SELECT * REPLACE (CASE WHEN z = 0 THEN 1e-4 ELSE z END AS z) FROM {source}),
{name}_r AS (SELECT *, x * x + y * y + z * z AS rr FROM {name}_z),
{name}_d AS (SELECT *, x / sqrt(rr) AS dx, y / sqrt(rr) AS dy, z / sqrt(rr) AS dz FROM {name}_r),
{name}_a AS (SELECT *, CASE WHEN abs(dx) < 0.6 THEN 0.0 ELSE dz END AS ax, CASE WHEN abs(dx) < 0.6 THEN dz ELSE 0.0 END AS ay, CASE WHEN abs(dx) < 0.6 THEN -dy ELSE -dx END AS az FROM {name}_d),
{name}_u AS (SELECT *, ax / sqrt(ax * ax + ay * ay + az * az) AS ux, ay / sqrt(ax * ax + ay * ay + az * az) AS uy, az / sqrt(ax * ax + ay * ay + az * az) AS uz FROM {name}_a),
{name}_w AS (SELECT *, dy * uz - dz * uy AS wx, dz * ux - dx * uz AS wy, dx * uy - dy * ux AS wz FROM {name}_u),
{name} AS (SELECT scan, i, pk, sk, x, y, z, {', '.join(f'{entry(s[0], s[1])} AS v{s}' for s in SYM)} FROM {name}_w)"""


def turned(c: int, t: bool = True) -> str:
    return " + ".join(f"({TURN[c][k]!r}) * {a}" for k, a in enumerate("xyz")) + (f" + ({SHIFT[c]!r})" if t else "")


PLANES = octree("leaves", "(SELECT x, y, z FROM cloud WHERE scan <> 1)", SIZE, LAYERS, THIN, RATIO, LEAST) + ",\n" + normals("fit", "(SELECT * FROM leaves WHERE is_plane)") + ",\nplanes AS (SELECT *, " + ", ".join(f"(v{a} + 0.5) * {SIZE} + round(m{a}, {DIGITS}) AS q{a}" for a in "xyz") + " FROM fit)"
MATCHED = f"""{CLOUD},
{PLANES},
{with_variance('noisy', '(SELECT * FROM cloud WHERE scan = 1)')},
{keyed('mine_k', 'noisy', SIZE)},
{digits_sql('mine_k', 'mine', SIZE, LAYERS)},
near AS (SELECT m.scan, m.i, m.pk, m.sk, m.x, m.y, m.z, m.vx, m.vy, m.vz, p.path AS node, p.nx, p.ny, p.nz, p.qx, p.qy, p.qz, p.l2 AS radius,
  abs(p.nx * (m.x - p.qx) + p.ny * (m.y - p.qy) + p.nz * (m.z - p.qz)) AS off,
  (m.x - p.qx) * (m.x - p.qx) + (m.y - p.qy) * (m.y - p.qy) + (m.z - p.qz) * (m.z - p.qz) AS d2,
  p.l0 / p.n + p.nx * p.nx * m.vxx + p.ny * p.ny * m.vyy + p.nz * p.nz * m.vzz + 2 * (p.nx * p.ny * m.vxy + p.nx * p.nz * m.vxz + p.ny * p.nz * m.vyz) AS sigma
  FROM mine m JOIN planes p ON m.vx = p.vx AND m.vy = p.vy AND m.vz = p.vz AND substr(m.path, 1, p.layer) = p.path),
matched AS (SELECT * FROM near WHERE d2 - off * off <= 9 * radius AND off < 3 * sqrt(sigma))"""

_FIRST_SECOND = ["sx", "sy", "sz", *("s" + s for s in SYM)]
_MEANS = ["mx", "my", "mz", *("c" + s for s in SYM)]
_V = "vx, vy, vz"


def _r_list(names, digits: int = 6) -> str:  # noqa: ANN001
    return ", ".join(f"{r(n, digits)} AS {n}" for n in names)


def _decode(kind: str) -> str:
    """Counts and sums by scan of what a decoder keeps; t is the time column, r2 what the range test looks at."""
    t = {"velodyne": "offset_ns * 1e-9", "livox": "offset_ns * 1e-9", "ouster": "offset_ns / 1e9", "robosense": "(1000.0 + offset_ns * 1e-9) - 1000.0", "xyz": "0.0"}.get(kind, "(1000.0 + offset_ns * 1e-9) - (1000.0 + first_ns * 1e-9)")
    intensity = "0.0" if kind in ("velodyne", "xyz") else "intensity"
    r2 = "x * x + y * y" if kind == "robosense" else "x * x + y * y + z * z"
    keep = "TRUE" if kind == "xyz" else f"i % 3 = 0 AND {r2} > 2.25"
    timed = " AND last_ns * 1e-9 > 0.01 AND last_ns * 1e-9 < 0.12" if kind == "velodyne" else ""
    return f"""WITH {CLOUD}, ends AS (SELECT scan, first(offset_ns ORDER BY i DESC, offset_ns DESC) AS last_ns, first(offset_ns ORDER BY i, offset_ns) AS first_ns FROM cloud GROUP BY scan)
SELECT scan AS scan_id, count(*) AS n, CAST(sum(i) AS BIGINT) AS sum_i, {r('avg(x)')} AS mean_x, {r(f'avg({intensity})', 4)} AS mean_intensity, {r(f'sum({t})', 4)} AS sum_t
FROM cloud JOIN ends USING (scan) WHERE {keep}{timed} GROUP BY scan"""


def _downsampled(source: str, size: float, by: str = "", order: str = "i, scan, pk, sk") -> str:
    return f"SELECT {by}{_V}, count(*) AS n, first(intensity ORDER BY {order}) AS intensity, {', '.join(f'{r(f"avg({a})")} AS {a}' for a in 'xyz')} FROM (SELECT *, {keys(size)} FROM {source}) GROUP BY {by}{_V}"


def _jet() -> str:
    """Colours of v by the straight lines between the fixed knots."""
    at, heights = points.JET_KNOTS, {"red": points.JET_RED, "green": points.JET_GREEN, "blue": points.JET_BLUE}
    line = lambda h, k: f"{h[k]} + (v - {at[k]}) * {(h[k + 1] - h[k]) / (at[k + 1] - at[k])!r}"
    return ", ".join(f"CAST(floor(255 * greatest(0.0, least(1.0, CAST(CASE {' '.join(f'WHEN v < {at[k + 1]} THEN {line(h, k)}' for k in range(5))} ELSE {h[5]} END AS DOUBLE)))) AS INT) AS {c}" for c, h in heights.items())


def _exp(factor: float) -> str:
    w = {a: f"({a} * {factor})" if factor != 1 else a for a in "xyz"}
    names = {"x": "kx", "y": "ky", "z": "kz"}
    return f"""{SMALL}, ang AS (SELECT *, sqrt({' + '.join(f'{w[a]} * {w[a]}' for a in 'xyz')}) AS th FROM small),
ax AS (SELECT *, {', '.join(f'CASE WHEN th >= 1e-9 THEN {w[a]} / th ELSE 0.0 END AS {names[a]}' for a in 'xyz')}, sin(th) AS s, 1 - cos(th) AS c FROM ang),
rot AS (SELECT id, 1 - c * (ky * ky + kz * kz) AS r00, c * kx * ky - s * kz AS r01, c * kx * kz + s * ky AS r02, c * kx * ky + s * kz AS r10, 1 - c * (kx * kx + kz * kz) AS r11, c * ky * kz - s * kx AS r12, c * kx * kz - s * ky AS r20, c * ky * kz + s * kx AS r21, 1 - c * (kx * kx + ky * ky) AS r22 FROM ax)"""


def _voxel_moments(source: str, size: float, where: str = "") -> str:
    return f"SELECT {_V}, n, {_r_list(_FIRST_SECOND)} FROM m {where}"


_NODE = "vx, vy, vz, layer, path, n"
_SCAN_TREE = octree("nodes", "(SELECT scan, x, y, z FROM cloud)", SIZE, 1, 0.02, RATIO, [2, 2], [6, 6], "scan", 9)
_TREE = octree("nodes", "(SELECT x, y, z FROM cloud)", SIZE, LAYERS, THIN, RATIO, LEAST)
_GOOD = "(SELECT *, 1 - l0 / nullif(l0 + l1 + l2, 0.0) AS quality, sqrt(greatest(0.0, l0) / nullif(l0 + l1 + l2, 0.0)) AS sigma_n FROM nodes WHERE is_plane AND l1 > 1e-12 AND l0 / nullif(l1, 0.0) <= {ratio})"
_J = [f"(y * t2 - z * t1)", "(z * t0 - x * t2)", "(x * t1 - y * t0)", "nx", "ny", "nz"]
_D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
_KNN = f"""{SMALL}, pairs AS (SELECT a.id, b.id AS near, {_D2} AS d2 FROM small a JOIN small b ON a.id <> b.id),
five AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, near) AS rank FROM pairs QUALIFY rank <= 5)"""

ORACLES: dict[str, str] = {
    "voxel_plane_map": f"WITH {CLOUD}, {keyed('k', 'cloud', SIZE)}, {moments('m', 'k', _V, SIZE)}, {covariance('c', 'm', DIGITS)}, {eigen('e', 'c')} SELECT {_V}, n, {_r_list(['l0', 'l1', 'l2'])}, n > 20 AND l0 < {THIN} AND l0 < 0.25 * l2 AS is_plane FROM e",
    "voxel_keys": f"WITH {CLOUD} SELECT scan, i, pk, sk, {keys(0.5)} FROM cloud",
    "range_filter": f"WITH {CLOUD} SELECT scan, i, pk, sk, x, y, z FROM cloud WHERE x * x + y * y + z * z > 2.25",
    "decimate": f"WITH {CLOUD} SELECT scan, i, pk, sk FROM cloud WHERE i % 3 = 0",
    "inside_box": f"WITH {CLOUD} SELECT scan, i, pk, sk FROM cloud WHERE x BETWEEN -0.5 AND 1.5 AND y BETWEEN -1 AND 1 AND z BETWEEN -1.5 AND 0.5",
    "display_colours": f"WITH {CLOUD}, v AS (SELECT *, intensity / 255.0 AS v FROM cloud WHERE i % 3 = 0) SELECT scan, i, pk, sk, {_jet()} FROM v",
    "voxel_markers": f"""WITH {CLOUD}, h AS (SELECT {_V}, CAST(count(*) AS DOUBLE) AS n FROM (SELECT {keys(0.1)} FROM cloud) GROUP BY {_V}),
m AS (SELECT *, {', '.join(f'CAST(round((CAST(v{a} AS DOUBLE) + 0.5) * 0.1 * 1000) AS BIGINT) AS i{a}, {r(f"(CAST(v{a} AS DOUBLE) + 0.5) * 0.1")} AS {a}' for a in 'xyz')}, greatest(0.0, least(1.0, (n - 1) / 15)) AS v FROM h)
SELECT CAST(abs(xor(xor(ix * 73856093, iy * 19349663), iz * 83492791)) & 2147483647 AS INT) AS id, count(*) OVER (PARTITION BY id) AS nodes, x, y, z, {_jet()} FROM m QUALIFY row_number() OVER (PARTITION BY id ORDER BY x, y, z) = 1""",
    "sensor_to_body": f"WITH {CLOUD}, {with_variance('v', 'cloud')} SELECT scan, i, pk, sk, CAST(sk % 256 AS DOUBLE) AS intensity, " + ", ".join(f"{r(turned(k))} AS {a}" for k, a in enumerate("xyz")) + ", "
    + ", ".join(r(" + ".join(f"({TURN['xyz'.index(s[0])][a] * TURN['xyz'.index(s[1])][b]!r}) * v{''.join(sorted('xyz'[a] + 'xyz'[b]))}" for a in range(3) for b in range(3)), 9) + f" AS v{s}" for s in SYM) + " FROM v",
    **{"decode_" + k: _decode(k) for k in ("livox", "velodyne", "ouster", "hesai", "robosense", "xyz")},
    "scan_points": f"""WITH {CLOUD}, p AS (SELECT scan AS scan_id, i, x, y, z, intensity, offset_ns * 1e-9 AS t_off FROM cloud WHERE i % 3 = 0 AND x * x + y * y + z * z > 2.2 * 2.2),
e AS (SELECT s.scan_id, t.i, 0.0 AS x, 0.0 AS y, 0.0 AS z, 0.0 AS intensity, t.t_off FROM (SELECT unnest(range(0, 12)) AS scan_id) s, (VALUES (0, 0.0), (1, 0.09)) t(i, t_off) WHERE s.scan_id NOT IN (SELECT scan_id FROM p))
SELECT CAST(scan_id AS BIGINT) AS scan_id, CAST(i AS BIGINT) AS i, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(z AS DOUBLE) AS z, CAST(intensity AS DOUBLE) AS intensity, {r('CAST(t_off AS DOUBLE)', 9)} AS t_off FROM (SELECT * FROM p UNION ALL SELECT * FROM e) WHERE t_off <= 0.11""",
    "rigid_transform": f"WITH {CLOUD} SELECT scan, i, pk, sk, " + ", ".join(f"{r(turned(k))} AS {a}" for k, a in enumerate("xyz")) + " FROM cloud",
    "point_covariance": f"WITH {CLOUD}, {with_variance('v', 'cloud')} SELECT scan, i, pk, sk, {_r_list(['v' + s for s in SYM], 9)} FROM v",
    "covariance_in_world": f"WITH {CLOUD}, {with_variance('v', 'cloud')} SELECT scan, i, pk, sk, "
    + ", ".join(
        r(
            " + ".join(f"({TURN['xyz'.index(s[0])][a] * TURN['xyz'.index(s[1])][b]!r}) * v{''.join(sorted('xyz'[a] + 'xyz'[b]))}" for a in range(3) for b in range(3))
            + (f" + 1e-4 * (x * x + y * y + z * z - {s[0]} * {s[0]}) + 4e-4" if s[0] == s[1] else f" - 1e-4 * {s[0]} * {s[1]}"), 9,
        ) + f" AS w{s}" for s in SYM
    ) + " FROM v",
    "rotation_exp": f"WITH {_exp(1)} SELECT id, {_r_list([f'r{i}{k}' for i in range(3) for k in range(3)])} FROM rot",
    "rotation_log": f"""WITH {_exp(0.2)}, t AS (SELECT *, CASE WHEN r00 + r11 + r22 > 3 - 1e-6 THEN 0.0 ELSE acos(greatest(-1.0, least(1.0, 0.5 * (r00 + r11 + r22 - 1)))) END AS th FROM rot),
f AS (SELECT *, CASE WHEN th < 0.001 THEN 0.5 ELSE 0.5 * th / nullif(sin(th), 0.0) END AS f FROM t)
SELECT id, {r('f * (r21 - r12)')} AS wx, {r('f * (r02 - r20)')} AS wy, {r('f * (r10 - r01)')} AS wz FROM f""",
    "rotation_quaternion": f"""WITH {SMALL}, h AS (SELECT *, sqrt(x * x + y * y + z * z) * 0.2 AS th FROM small),
q AS (SELECT id, CASE WHEN th < 1e-9 THEN 0.0 ELSE sin(th / 2) / (th / 0.2) END AS f, cos(th / 2) AS c, x, y, z FROM h)
SELECT id, {', '.join(f"{r(f'CASE WHEN c < 0 THEN -1 ELSE 1 END * f * {a}')} AS q{a}" for a in 'xyz')}, {r('abs(c)')} AS qw FROM q""",
    "voxel_downsample": f"WITH {CLOUD} {_downsampled('cloud', 0.25)}",
    "voxel_downsample_cov": f"WITH {CLOUD}, {with_variance('v', 'cloud')} SELECT {_V}, count(*) AS n, " + ", ".join(f"{r(f'avg({c})', 8)} AS {c}" for c in ("x", "y", "z", *("v" + s for s in SYM))) + f" FROM (SELECT *, {keys(0.5)} FROM v) GROUP BY {_V}",
    "adaptive_downsample": f"""WITH {CLOUD}, mine AS (SELECT * FROM cloud),
coarse AS ({_downsampled('mine', 0.5, 'scan, ', 'i, pk, sk')}), fine AS ({_downsampled('mine', 0.25, 'scan, ', 'i, pk, sk')}), c AS (SELECT scan, count(*) AS cells FROM coarse GROUP BY scan)
SELECT coarse.*, CAST(0.5 AS DOUBLE) AS size FROM coarse JOIN c USING (scan) WHERE cells >= 330 UNION ALL SELECT fine.*, CAST(0.25 AS DOUBLE) AS size FROM fine JOIN c USING (scan) WHERE cells < 330""",
    "union_downsample": f"WITH {CLOUD} {_downsampled('cloud', 0.5)}",
    "voxel_representative": f"""WITH {SMALL}, {keyed('k', 'small', 1.0)}, m AS (SELECT {_V}, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, count(*) AS n FROM k GROUP BY {_V}),
d AS (SELECT k.*, n, round((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz), 12) AS d2 FROM k JOIN m USING ({_V}))
SELECT {_V}, n, id, {_r_list('xyz')} FROM d QUALIFY row_number() OVER (PARTITION BY {_V} ORDER BY d2, id) = 1""",
    "cluster_moments": f"WITH {CLOUD}, {keyed('k', 'cloud', 0.5)}, {moments('m', 'k', _V, 0.5)} {_voxel_moments('k', 0.5)}",
    "cluster_merge": f"WITH {CLOUD}, {keyed('k', 'cloud', 0.5)}, {moments('m', 'k', _V, 0.5)} {_voxel_moments('k', 0.5)}",
    "cluster_retract": f"WITH {CLOUD}, {keyed('k', '(SELECT * FROM cloud WHERE scan <> 1)', 0.5)}, {moments('m', 'k', _V, 0.5)} {_voxel_moments('k', 0.5)}",
    "cluster_covariance": f"WITH {CLOUD}, {keyed('k', 'cloud', 0.5)}, {moments('m', 'k', _V, 0.5)}, {covariance('c', 'm')} SELECT {_V}, n, {_r_list(_MEANS)} FROM c",
    "cluster_transform": f"WITH {CLOUD}, w AS (SELECT scan, {', '.join(f'{turned(k)} AS {a}' for k, a in enumerate('xyz'))} FROM cloud), {moments('m', 'w', 'scan', None)}, {covariance('c', 'm')} SELECT scan, n, {_r_list(_MEANS)} FROM c",
    "sliding_window_moments": f"WITH {CLOUD}, f AS (SELECT *, CAST(floor(pk / 20) AS BIGINT) AS frame FROM cloud), {moments('a', 'f', 'frame', None)}, m AS (SELECT frame, CAST(sum(n) OVER w AS BIGINT) AS n, {', '.join(f'sum({c}) OVER w AS {c}' for c in _FIRST_SECOND)} FROM a WINDOW w AS (ORDER BY frame ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)), {covariance('c', 'm')} SELECT frame, n, {_r_list(_MEANS)} FROM c",
    "octree_paths": f"WITH {CLOUD}, {keyed('k', 'cloud', SIZE)}, {digits_sql('k', 'd', SIZE, 3)} SELECT scan, i, pk, sk, {_V}, path FROM d",
    "octree_planes": f"WITH {CLOUD}, {_TREE} SELECT {_NODE}, is_plane, {_r_list(['l0', 'l1', 'l2'])} FROM nodes",
    "plane_factors": f"WITH {CLOUD}, {_TREE} SELECT {_NODE}, {_r_list(['l0', 'l1'])} FROM nodes WHERE is_plane AND l0 <= 0.12 * l1",
    "scan_octree_planes": f"WITH {CLOUD}, {_SCAN_TREE} SELECT scan, {_NODE}, is_plane, {_r_list(['l0', 'l1', 'l2'])} FROM nodes",
    "scan_planes": f"WITH {CLOUD}, {_SCAN_TREE} SELECT scan, {_NODE}, {_r_list(['l0', 'quality', 'sigma_n'])} FROM {_GOOD.format(ratio=0.12)} WHERE quality > 0.5",
    "asof_strict": f"WITH {EVENTS} SELECT c.session, c.id, c.us, e.us AS right_us, e.id AS right_id, e.value AS right_value FROM (SELECT * FROM ev WHERE kind = 'click') c ASOF LEFT JOIN (SELECT * FROM ev WHERE kind = 'error') e ON c.session = e.session AND c.us > e.us",
    "asof_inner": f"WITH {EVENTS} SELECT c.session, c.id, c.us, e.us AS right_us, e.id AS right_id, e.value AS right_value FROM (SELECT * FROM ev WHERE kind = 'click') c ASOF JOIN (SELECT * FROM ev WHERE kind = 'error') e ON c.session = e.session AND c.us > e.us",
    "interval_slice": f"""WITH {EVENTS}, s AS (SELECT session, us AS end_us, lag(us) OVER (PARTITION BY session ORDER BY us) AS begin_us FROM ev WHERE kind = 'purchase'),
late AS (SELECT session, max(us) AS latest FROM ev WHERE kind = 'view' GROUP BY session)
SELECT s.session, end_us, count(*) AS n, {r('sum(value)')} AS total, min(us) AS first_us, max(us) AS last_us FROM s JOIN late USING (session) JOIN ev ON ev.session = s.session AND kind = 'view' AND us <= end_us AND (begin_us IS NULL OR us > begin_us)
WHERE end_us < latest GROUP BY s.session, end_us HAVING count(*) > 4""",
    "interval_slice_untimed": f"""WITH {EVENTS}, s AS (SELECT session, us AS end_us, lag(us) OVER (PARTITION BY session ORDER BY us) AS begin_us FROM ev WHERE kind = 'purchase')
SELECT s.session, end_us, count(*) AS n, {r('sum(value)')} AS total FROM s JOIN ev ON ev.session = s.session AND kind = 'view' AND us <= end_us AND us > begin_us WHERE begin_us IS NOT NULL GROUP BY s.session, end_us""",
    "imu_midpoint": f"WITH {EVENTS}, m AS (SELECT session, id, (us - lag(us) OVER w) * 1e-6 AS dt, (value + lag(value) OVER w) * 0.5 AS mid_value FROM ev WINDOW w AS (PARTITION BY session ORDER BY us)) SELECT session, id, {_r_list(['dt', 'mid_value'])} FROM m WHERE dt IS NOT NULL",
    "imu_static_init": f"""WITH {EVENTS}, f AS (SELECT session, value / 100 AS ax, sin(id) AS ay, value / 40 - 1 AS az FROM ev QUALIFY row_number() OVER (PARTITION BY session ORDER BY us) <= 30),
m AS (SELECT session, count(*) AS n, avg(ax) AS mean_ax, avg(ay) AS mean_ay, avg(az) AS mean_az FROM f GROUP BY session HAVING count(*) >= 30),
s AS (SELECT *, CASE WHEN sqrt(mean_ax * mean_ax + mean_ay * mean_ay + mean_az * mean_az) < 2 THEN CAST(9.8 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS scale FROM m)
SELECT session, n, scale, {r('mean_ax')} AS mean_ax, {', '.join(f"{r(f'-mean_{a} * scale')} AS g_{a}" for a in ('ax', 'ay', 'az'))} FROM s""",
    "dead_reckon_1d": f"""WITH {EVENTS}, m AS (SELECT session, id, us, (us - lag(us) OVER w) * 1e-8 AS dt, ((value - 50) / 1e5 + (lag(value) OVER w - 50) / 1e5) * 0.5 AS acc FROM ev WINDOW w AS (PARTITION BY session ORDER BY us)),
v AS (SELECT *, sum(acc * dt) OVER (PARTITION BY session ORDER BY us ROWS UNBOUNDED PRECEDING) AS speed FROM m WHERE dt IS NOT NULL)
SELECT session, id, {r('speed')} AS speed, {r('place')} AS place FROM (SELECT *, sum((speed - acc * dt) * dt + 0.5 * acc * dt * dt) OVER (PARTITION BY session ORDER BY us ROWS UNBOUNDED PRECEDING) AS place FROM v)""",
    "path_length": f"WITH {EVENTS}, s AS (SELECT session, sqrt((value - lag(value) OVER w) ** 2 + (sin(id) - lag(sin(id)) OVER w) ** 2) AS d FROM ev WINDOW w AS (PARTITION BY session ORDER BY us)) SELECT session, count(*) AS n, {r('coalesce(sum(d), 0)')} AS length FROM s GROUP BY session",
    "voxel_equi_match": f"WITH {CLOUD}, {PLANES}, {keyed('k', '(SELECT * FROM cloud WHERE scan = 1)', SIZE)} SELECT scan, i, pk, sk, {_V}, p.n AS plane_n FROM k JOIN (SELECT {_V}, n FROM planes WHERE layer = 0) p USING ({_V})",
    "point_plane_match": f"WITH {MATCHED} SELECT scan, i, pk, sk, {_V}, node, {_r_list(['off', 'sigma'])} FROM matched",
    "normal_equations": f"WITH {MATCHED}, j AS (SELECT *, nx AS t0, ny AS t1, nz AS t2, nx * (x - qx) + ny * (y - qy) + nz * (z - qz) AS res, 1 / (0.0005 + sigma) AS w FROM matched) SELECT count(*) AS n, "
    + ", ".join([f"{r(f'sum(w * {_J[a]} * {_J[b]}) / count(*)')} AS h{a}{b}" for a in range(6) for b in range(a, 6)] + [f"{r(f'-sum(w * {_J[a]} * res) / count(*)')} AS g{a}" for a in range(6)]) + f", {r('sum(w * res * res) / count(*)')} AS cost FROM j",
    "degeneracy": f"WITH {MATCHED}, s AS (SELECT count(*) AS n, " + ", ".join(f"round(sum(n{s[0]} * n{s[1]}), 6) AS c{s}" for s in SYM) + f" FROM matched), {eigen('e', 's')} SELECT n, l0 >= 14 AS well_posed, {_r_list(['l0', 'l1', 'l2'])} FROM e",
    "bundle_residual": f"""WITH {CLOUD}, {keyed('k', 'cloud', SIZE)}, w AS (SELECT {_V}, cos(scan * 0.01) * x - sin(scan * 0.01) * y + scan * 0.02 AS x, sin(scan * 0.01) * x + cos(scan * 0.01) * y - scan * 0.01 AS y, z FROM k),
{moments('m', 'w', _V, None)}, {covariance('c', 'm', DIGITS)}, {eigen('e', 'c', None)} SELECT {_V}, n, {_r_list(['l0', 'l1', 'l2'])} FROM e""",
    "neighbour_join": f"""WITH {SMALL}, {keyed('k', 'small', 1.0)}, c AS (SELECT {_V}, avg(x) AS qx, avg(y) AS qy, avg(z) AS qz FROM k GROUP BY {_V}),
j AS (SELECT k.id, c.*, round(exp(-((k.x - qx) * (k.x - qx) + (k.y - qy) * (k.y - qy) + (k.z - qz) * (k.z - qz))) / sqrt(0.5), 9) AS score FROM k JOIN c ON abs(k.vx - c.vx) <= 1 AND abs(k.vy - c.vy) <= 1 AND abs(k.vz - c.vz) <= 1)
SELECT id, count(*) OVER (PARTITION BY id) AS n, {r('score')} AS score, {_V} FROM j QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, vx, vy, vz) = 1""",
    "normal_consistency": f"""WITH {CLOUD}, {PLANES}, {octree('nodes', '(SELECT x, y, z FROM cloud WHERE scan = 1)', SIZE, 0, THIN, RATIO, [20])}, {normals('sn', _GOOD.format(ratio=1.0))},
s AS (SELECT {', '.join(f'v{a} + 0.5 + round(m{a}, {DIGITS}) AS {a}, n{a} AS s{a}' for a in 'xyz')}, quality, sigma_n FROM sn WHERE quality > 0.5),
sk AS (SELECT *, {keys(SIZE, ('px', 'py', 'pz'))} FROM s),
j AS (SELECT px, py, pz, p.vx, p.vy, p.vz, round((x - qx) * (x - qx) + (y - qy) * (y - qy) + (z - qz) * (z - qz), 6) AS d2, round(abs(sx * nx + sy * ny + sz * nz), 6) AS cosine, 0.1 * quality / (sigma_n * sigma_n + 0.01) AS weight
  FROM sk JOIN (SELECT vx, vy, vz, nx, ny, nz, qx, qy, qz FROM planes WHERE layer = 0) p ON abs(px - p.vx) <= 1 AND abs(py - p.vy) <= 1 AND abs(pz - p.vz) <= 1)
SELECT px, py, pz, {_V}, {r('d2')} AS d2, {r('cosine')} AS cosine, {r('weight', 4)} AS weight FROM j WHERE cosine >= 0.7 QUALIFY row_number() OVER (PARTITION BY px, py, pz ORDER BY d2, vx, vy, vz) = 1""",
    "knn5": f"WITH {_KNN} SELECT id, near, {r('d2')} AS d2, rank FROM five",
    "knn5_plane": f"""WITH {_KNN}, f AS (SELECT five.id, s.x, s.y, s.z FROM five JOIN small s ON s.id = five.near),
m AS (SELECT id, {', '.join(f'sum({s[0]} * {s[1]}) AS {s}' for s in SYM)}, sum(x) AS a, sum(y) AS b, sum(z) AS c FROM f GROUP BY id),
v AS (SELECT *, xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz) AS det FROM m),
n AS (SELECT id, -(a * (yy * zz - yz * yz) + b * (xz * yz - xy * zz) + c * (xy * yz - xz * yy)) / det AS nx, -(a * (xz * yz - xy * zz) + b * (xx * zz - xz * xz) + c * (xy * xz - xx * yz)) / det AS ny, -(a * (xy * yz - xz * yy) + b * (xy * xz - xx * yz) + c * (xx * yy - xy * xy)) / det AS nz FROM v WHERE abs(det) > 1e-3)
SELECT id, {', '.join(f"{r(f'any_value({n})', 4)} AS {n}" for n in ('nx', 'ny', 'nz'))}, {r('round(max(abs(nx * x + ny * y + nz * z + 1)), 6)', 4)} AS worst FROM f JOIN n USING (id) GROUP BY id HAVING round(max(abs(nx * x + ny * y + nz * z + 1)), 6) <= 0.1""",
    "evict_some": f"""WITH {CLOUD}, s AS (SELECT {_V}, CAST(max(pk) AS DOUBLE) AS travelled FROM (SELECT pk, {keys(0.1)} FROM cloud) GROUP BY {_V}),
g AS (SELECT * FROM s WHERE (SELECT max(pk) FROM cloud) - travelled >= 100 ORDER BY travelled, {_V} LIMIT 1000) SELECT * FROM s EXCEPT SELECT * FROM g""",
    "path_revised": f"WITH {EVENTS}, m AS (SELECT *, CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END AS moved FROM ev) SELECT id, session, {r('value + 0.25 * moved')} AS x, {r('value / 7 - 0.5 * moved')} AS y, {r('1.0 * moved')} AS z FROM m",
    "session_epochs": f"WITH {EVENTS}, e AS (SELECT *, CAST(sum(CASE WHEN kind = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY us, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch FROM ev) SELECT session, epoch, count(*) AS n, {r('sum(value)')} AS total FROM e GROUP BY session, epoch",
    "late_scans": f"WITH {EVENTS}, s AS (SELECT *, us + CAST(trunc(value * 1e7) AS BIGINT) AS until FROM ev) SELECT session, id, coalesce(us < max(until) OVER (PARTITION BY session ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 10000, FALSE) AS late FROM s",
    "ttl_evict": f"WITH {CLOUD}, s AS (SELECT {_V}, CAST(max(pk) AS DOUBLE) AS travelled FROM (SELECT pk, {keys(0.1)} FROM cloud) GROUP BY {_V}) SELECT * FROM s WHERE (SELECT max(pk) FROM cloud) - travelled < 700",
    "plane_changelog": f"""WITH {CLOUD}, {octree('a', '(SELECT x, y, z FROM cloud WHERE scan = 1)', 0.5, 0, THIN, RATIO, [5])}, {octree('b', '(SELECT x, y, z FROM cloud WHERE scan = 2)', 0.5, 0, THIN, RATIO, [5])},
o AS (SELECT {_V}, n AS was FROM a WHERE is_plane), w AS (SELECT {_V}, n FROM b WHERE is_plane)
SELECT {_V}, CASE WHEN was IS NULL THEN 'ADD' WHEN n IS NULL THEN 'DELETE' ELSE 'MODIFY' END AS op, n FROM o FULL JOIN w USING ({_V}) WHERE was IS NULL OR n IS NULL OR n <> was""",
    "tum_export": f"WITH {EVENTS} SELECT id, printf('%.9f %.9f %.9f %.9f %.9f %.9f %.9f %.9f', (us - 1704067200000000) / 1e6, value, value / 7, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.6::DOUBLE, 0.8::DOUBLE) AS line FROM ev",
}

ORACLES["cost_breakdown"] = f"SELECT CASE WHEN l0 < {THIN} THEN 'thin' ELSE 'thick' END AS family, count(*) AS n, {r('sum(l0)')} AS cost FROM ({ORACLES['bundle_residual']}) GROUP BY family"
