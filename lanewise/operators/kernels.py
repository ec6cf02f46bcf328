"""Kinematics of one slice of one track as NumPy arrays.

A slice is bounded (an hour of a track and seconds around it), so a kernel holds
little; Spark partitions the slices. Formulas are those of ``timeseries``.
"""
import numpy as np
import pyarrow as pa

US = 1_000_000


def smooth(t: np.ndarray, values: list[np.ndarray], sigma: float) -> list[np.ndarray]:
    """Gaussian weights over +-3 sigma of the exact times ``t`` (ascending microseconds)."""
    reach = int(round(3 * sigma * US))
    i = np.arange(len(t))
    lo, hi = np.searchsorted(t, t - reach), np.searchsorted(t, t + reach, "right") - 1
    total, sums = np.zeros(len(t)), [np.zeros(len(t)) for _ in values]
    for off in range(int((lo - i).min()), int((hi - i).max()) + 1):
        j = np.clip(i + off, 0, len(t) - 1)
        d = (t[j] - t) / (US * sigma)
        g = np.where((i + off >= lo) & (i + off <= hi), np.exp(-0.5 * d * d), 0.0)
        total += g
        for s, v in zip(sums, values):
            s += g * v[j]
    return [s / total for s in sums]


def derivative(t: np.ndarray, x: np.ndarray, half: float) -> np.ndarray:
    """Central difference over +-half seconds, at least one neighbour wide on each side; 0 for a lone sample."""
    reach = int(round(half * US))
    i = np.arange(len(t))
    lo, hi = np.searchsorted(t, t - reach), np.searchsorted(t, t + reach, "right") - 1
    lo, hi = np.where(lo == i, np.maximum(i - 1, 0), lo), np.where(hi == i, np.minimum(i + 1, len(t) - 1), hi)
    dt = (t[hi] - t[lo]) / US
    return np.divide(x[hi] - x[lo], dt, out=np.zeros(len(t)), where=dt != 0)


def motion(rows: pa.Table, pos_sigma: float, vel_window: float) -> pa.Table:
    """Own rows of a slice in time order with dt_us, px, py, size, vx, vy, speed, accel and heading."""
    rows = rows.sort_by("t_us")
    t = rows.column("t_us").to_numpy()
    x1, y1, x2, y2 = (rows.column(c).to_numpy() for c in ("x1", "y1", "x2", "y2"))
    gx, gy = (x1 + x2).astype(float) / 2, y2.astype(float)
    size = np.sqrt(np.maximum(1.0, ((x2 - x1) * (y2 - y1)).astype(float)))
    many = rows.column("n_obs")[0].as_py() >= 3
    if many:
        gx, gy = smooth(t, [gx, gy], pos_sigma)
        size, = smooth(t, [size], 1.0)
    vx, vy = derivative(t, gx, vel_window), derivative(t, gy, vel_window)
    speed = np.sqrt(vx * vx + vy * vy) / size
    accel = derivative(t, smooth(t, [speed], 0.2)[0] if many else speed, 0.3)
    step = pa.array(np.diff(t, prepend=t[0]), pa.int64(), mask=np.arange(len(t)) == 0)
    heading = pa.array(np.arctan2(vy, vx), mask=~(speed >= 0.15))
    out = rows.append_column("dt_us", step)
    for name, v in (("px", gx), ("py", gy), ("size", size), ("vx", vx), ("vy", vy), ("speed", speed), ("accel", accel)):
        out = out.append_column(name, pa.array(v))
    return out.append_column("heading", heading).filter(rows.column("own")).drop_columns(["own", "slice"])


def covered_counts(rows: pa.Table, overlap: float, step: int = 500_000) -> pa.Table:
    """video_id, track_id, n and n_hit of the persons of some frames: samples, and those of which a box covers more than ``overlap``."""
    rows = rows.combine_chunks()
    col = {c: rows.column(c).to_numpy() for c in ("frame_idx", "track_id", "person", "x1", "y1", "x2", "y2")}
    who, by = np.nonzero(col["person"])[0], np.nonzero(~col["person"])[0]
    hit = np.zeros(len(rows), bool)
    if len(who) and len(by):
        # one line for all frames, which lie further apart than any box is wide
        base, top = min(col["x1"].min(), col["x2"].min()), max(col["x1"].max(), col["x2"].max())
        shift = (col["frame_idx"] - col["frame_idx"].min()) * (top - base + 1.0) - base
        x1, x2 = col["x1"] + shift, col["x2"] + shift
        for one, two in ((who, by), (by, who)):
            # boxes of ``two`` that begin within one of ``one``
            two = two[np.argsort(x1[two], kind="stable")]
            slack = 1e-9 * (np.abs(x2).max() + 1)
            lo, hi = np.searchsorted(x1[two], x1[one] - slack), np.searchsorted(x1[two], x2[one] + slack, "right")
            total = np.concatenate([[0], np.cumsum(np.maximum(hi - lo, 0))])
            at = 0
            while at < len(one):
                stop = max(at + 1, int(np.searchsorted(total, total[at] + step, "right")) - 1)
                w = np.maximum(hi[at:stop] - lo[at:stop], 0)
                a = np.repeat(one[at:stop], w)
                b = two[np.arange(len(a)) + np.repeat(lo[at:stop] - (total[at:stop] - total[at]), w)]
                if one is by:
                    a, b = b, a
                new = ~hit[a] & (col["frame_idx"][a] == col["frame_idx"][b])
                a, b = a[new], b[new]
                w = np.maximum(0.0, np.minimum(col["x2"][a], col["x2"][b]) - np.maximum(col["x1"][a], col["x1"][b]))
                h = np.maximum(0.0, np.minimum(col["y2"][a], col["y2"][b]) - np.maximum(col["y1"][a], col["y1"][b]))
                area = np.maximum(1e-6, (col["x2"][a] - col["x1"][a]) * (col["y2"][a] - col["y1"][a]))
                hit[a[w * h / area > overlap]] = True
                at = stop
    ids, run = np.unique(col["track_id"][who], return_inverse=True)
    n, found = np.bincount(run, minlength=len(ids)), np.bincount(run, hit[who], minlength=len(ids)).astype(np.int64)
    video = rows.column("video_id").slice(0, 1).take(pa.array(np.zeros(len(ids), np.int32)))
    return pa.table({"video_id": video, "track_id": pa.array(ids), "n": pa.array(n.astype(np.int64)), "n_hit": pa.array(found)})
