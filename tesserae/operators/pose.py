"""Position and rotation of a tag from its homography and corners."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from tesserae.config import Camera
from tesserae.functions.algebra import Poly

FLIP = np.diag([1.0, -1.0, -1.0])
#: Half tangent parametrisation of a turn about y: (I + t A + t^2 B) / (1 + t^2).
_A = np.array([[0, 0, 2.0], [0, 0, 0], [-2.0, 0, 0]])
_B = np.diag([-1.0, 1.0, -1.0])


def pose_of_homography(h: np.ndarray, cam: Camera) -> tuple[np.ndarray, np.ndarray]:
    """Rotation (polar decomposition) and translation of the tag's plane, of one homography or a stack of them."""
    k = np.array([[-cam.fx, 0, cam.cx], [0, cam.fy, cam.cy], [0, 0, 1.0]])
    m = np.linalg.inv(k) @ h
    scale = 1 / np.sqrt(np.linalg.norm(m[..., 0], axis=-1) * np.linalg.norm(m[..., 1], axis=-1))
    m = m * np.where(m[..., 2, 2] > 0, -scale, scale)[..., None, None]  # in front of a camera that looks along -z
    u, _, vt = np.linalg.svd(np.stack([m[..., 0], m[..., 1], np.cross(m[..., 0], m[..., 1])], -1))
    half = cam.tagsize / 2
    return FLIP @ (u @ vt), m[..., 2] * np.array([half, -half, -half])


def model_view(h: np.ndarray, cam: Camera) -> np.ndarray:
    """4 x 4 matrix of the tag's pose for drawing."""
    r, t = pose_of_homography(h, cam)
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = r, t
    return out


def object_points(cam: Camera) -> np.ndarray:
    s = cam.tagsize / 2
    return np.array([(-s, s, 0), (s, s, 0), (s, -s, 0), (-s, -s, 0)])


def rays(corners: np.ndarray, cam: Camera) -> np.ndarray:
    return np.stack([(corners[..., 0] - cam.cx) / cam.fx, (corners[..., 1] - cam.cy) / cam.fy, np.ones(corners.shape[:-1])], -1)


def _projectors(v: np.ndarray) -> np.ndarray:
    return v[..., :, None] * v[..., None, :] / (v * v).sum(-1)[..., None, None]


def _turn(r: np.ndarray) -> np.ndarray:
    return np.swapaxes(r, -1, -2)


def iterate(v: np.ndarray, p: np.ndarray, r: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Orthogonal iteration of a stack: rotations, translations and object-space errors."""
    f, eye = _projectors(v), np.eye(3)
    to_t = np.linalg.inv(eye - f.mean(-3))
    # The best translation of a rotation is linear in its entries, and so is all that one step needs of the rotated points.
    pull = np.einsum("nij,nkjl,kb->nilb", to_t, f - eye, p) / len(p)
    centred = p - p.mean(0)
    about = np.einsum("nkij,kb,ka->niajb", f, p, centred)
    shift = np.einsum("nkij,ka->niaj", f, centred)
    for _ in range(steps):
        t = np.einsum("nilb,nlb->ni", pull, r)
        cov = np.einsum("niajb,njb->nia", about, r) + np.einsum("niaj,nj->nia", shift, t)
        u, _, wt = np.linalg.svd(cov)
        u[..., 2] *= np.linalg.det(u @ wt)[:, None]  # the points are coplanar: of the two signs, the rotation
        r = u @ wt
    rest = np.einsum("nkij,nkj->nki", eye - f, p @ _turn(r) + (t if steps else np.einsum("nilb,nlb->ni", pull, r))[:, None])
    return r, t, (rest * rest).sum((1, 2))


def second_minimum(v: np.ndarray, p: np.ndarray, t: np.ndarray, r: np.ndarray) -> list[np.ndarray | str]:
    """For each pose of a stack the rotation at the other local minimum of the error over the tilt, or why there is none.

    In a frame that looks along t the rotation is G . turn(beta) . Z'; with the half tangent of beta
    the error is a quartic over (1 + t^2)^2, whose stationary points are roots of a quartic.
    """
    n, eye = len(v), np.eye(3)
    axis = t / np.linalg.norm(t, axis=1)[:, None]
    first = np.array([1.0, 0, 0]) - axis[:, :1] * axis
    first /= np.linalg.norm(first, axis=1)[:, None]
    to = np.stack([first, np.cross(axis, first), axis], 1)
    turned = to @ r
    flat = np.hypot(turned[:, 2, 0], turned[:, 2, 1])
    none = flat < 1e-100
    safe = np.where(none, 1.0, flat)
    cz, sz = np.where(none, 1.0, turned[:, 2, 0] / safe), np.where(none, 0.0, turned[:, 2, 1] / safe)
    z = np.zeros((n, 3, 3))
    z[:, 0, 0], z[:, 0, 1], z[:, 1, 0], z[:, 1, 1], z[:, 2, 2] = cz, -sz, sz, cz, 1
    m = turned @ z
    g = np.zeros((n, 3, 3))
    g[:, 0, 0], g[:, 0, 1], g[:, 1, 0], g[:, 1, 1], g[:, 2, 2] = m[:, 1, 1], m[:, 0, 1], -m[:, 0, 1], m[:, 1, 1], 1
    known = np.arctan2(-m[:, 2, 0], m[:, 2, 2])
    points = p @ z
    f = _projectors(v @ _turn(to))
    solve = np.linalg.inv(eye - f.mean(1))
    parts = []
    for shape in (eye, _A, _B):
        q = points @ _turn(g @ shape)
        move = np.einsum("nij,nkjl,nkl->ni", solve, f - eye, q) / q.shape[1]
        parts.append(np.einsum("nkij,nkj->nki", eye - f, q + move[:, None]).reshape(n, -1))
    a = np.zeros((n, 5))
    for i in range(3):
        for j in range(3):
            a[:, i + j] += (parts[i] * parts[j]).sum(1)
    out: list[np.ndarray | str] = []
    for row, c in enumerate(a.tolist()):
        error, weight = Poly(c), lambda x: (1 + x * x) ** 2
        # Numerator of the derivative of error / (1 + t^2)^2, divided by (1 + t^2).
        slope = Poly([c[1], 2 * c[2] - 4 * c[0], 3 * c[3] - 3 * c[1], 4 * c[4] - 2 * c[2], -c[3]])
        found = []
        for root in slope.real_roots():
            step = 1e-4 * max(1.0, abs(root))
            here = error(root) / weight(root)
            if error(root - step) / weight(root - step) + error(root + step) / weight(root + step) - 2 * here >= 0 and abs(2 * np.arctan(root) - known[row]) > 0.1:
                found.append(root)
        if len(found) != 1:
            out.append("NoMinima" if not found else "MultipleMinima")
            continue
        x = found[0]
        out.append(to[row].T @ g[row] @ ((eye + x * _A + x * x * _B) / (1 + x * x)) @ z[row].T)
    return out


def solve_all(h: np.ndarray, corners: np.ndarray, cam: Camera, steps: int = 50) -> list[tuple[list[tuple[np.ndarray, np.ndarray, float]], str | None]]:
    """For each of a stack of homographies and corners one or two poses with their errors, and why there is no second."""
    if not len(h):
        return []
    v, p = rays(corners, cam), object_points(cam)
    r, t, error = iterate(v, p, pose_of_homography(h, cam)[0], steps)
    others = second_minimum(v, p, t, r)
    out = [([(r[i], t[i], float(error[i]))], o if isinstance(o, str) else None) for i, o in enumerate(others)]
    again = [i for i, o in enumerate(others) if not isinstance(o, str)]
    if again:
        for i, *second in zip(again, *iterate(v[again], p, np.stack([others[i] for i in again]), steps), strict=True):
            out[i][0].append((second[0], second[1], float(second[2])))
    return out


def solutions(h: np.ndarray, corners: np.ndarray, cam: Camera, steps: int = 50) -> tuple[list[tuple[np.ndarray, np.ndarray, float]], str | None]:
    """One or two poses of one tag."""
    return solve_all(h[None], corners[None], cam, steps)[0]


_POSE = [
    StructField("solution", IntegerType()), StructField("r", ArrayType(DoubleType())), StructField("t", ArrayType(DoubleType())),
    StructField("error", DoubleType()), StructField("ambiguity", StringType()),
]


def with_pose(detections: DataFrame, cam: Camera, steps: int = 50, best_only: bool = True, refine: bool = True) -> DataFrame:
    """Detections (h, corners) with their pose; ``best_only=False`` gives a row for each solution, ``refine=False`` the homography's pose."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType([*detections.schema.fields, *_POSE])
    target = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            out, rows = [], batch.to_pylist()
            h, corners = np.array([d["h"] for d in rows]).reshape(-1, 3, 3), np.array([d["corners"] for d in rows]).reshape(-1, 4, 2)
            if refine:
                solved = solve_all(h, corners, cam, steps)
            else:
                solved = [([(r, t, None)], None) for r, t in zip(*pose_of_homography(h, cam), strict=True)]
            for d, (found, why) in zip(rows, solved, strict=True):
                every = list(enumerate(found))
                if best_only and refine:
                    every = [min(every, key=lambda e: e[1][2])]
                out += [d | {"solution": i, "r": r.ravel().tolist(), "t": t.tolist(), "error": e, "ambiguity": why} for i, (r, t, e) in every]
            yield pa.RecordBatch.from_pylist(out, schema=target)

    return detections.mapInArrow(run, schema)
