"""Parameters that change results, with their defaults; one frozen object for a run."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    lidar_type: str = "livox"
    blind: float = 0.1
    point_filter_num: int = 3
    scan_cut: float = 0.11
    min_imu_rows: int = 5
    down_size: float = 0.1
    min_points: int = 2000
    range_error: float = 0.02
    beam_error: float = 0.05
    voxel_size: float = 1.0
    min_eigen_value: float = 0.0025
    plane_ratio: tuple[float, ...] = (1.0, 1.0, 1.0, 1.0)
    max_layer: int = 2
    min_layer_points: tuple[int, ...] = (20, 20, 15, 10)
    max_points: int = 100
    win_size: int = 10
    imu_coef: float = 1e-4
    evict_distance: float = 700.0
    gravity: float = 9.8

    @classmethod
    def of(cls, values: dict) -> Config:
        """From a nested mapping as YAML files hold it: leaf names are matched, unknown ones are ignored, `plane_eigen_value_thre` is inverted."""
        flat: dict = {}

        def walk(node: dict) -> None:
            for k, v in node.items():
                if isinstance(v, dict):
                    walk(v)
                else:
                    flat[k] = v

        walk(values)
        if "plane_eigen_value_thre" in flat:
            flat["plane_ratio"] = tuple(1.0 / v for v in flat.pop("plane_eigen_value_thre"))
        for theirs, ours in (("dept_err", "range_error"), ("beam_err", "beam_error")):
            if theirs in flat:
                flat[ours] = flat.pop(theirs)
        known = {f.name for f in fields(cls)}
        return replace(cls(), **{k: tuple(v) if isinstance(v, list) else v for k, v in flat.items() if k in known})
