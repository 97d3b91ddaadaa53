"""Estimators on one image at a time. A frame is one row holding its pixels, so nothing here shuffles.

`data` is a row-major array of `width` columns. `settle` puts finished columns behind a generator, so that the
optimizer does not copy them into the lambdas that use them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.angles import wrap_deg, wrap_diff

from .skew import attach

c = F.col


def settle(df: DataFrame) -> DataFrame:
    return df.select(F.explode(F.array(F.struct("*"))).alias("_row")).select("_row.*")


def total(arr, f=lambda p: p) -> Column:
    a = c(arr) if isinstance(arr, str) else arr
    return F.aggregate(a, F.lit(0.0), lambda s, p: s + f(p))


def _halves(v: Column) -> tuple[Column, Column]:
    big = v * 134217729.0
    return big - (big - v), v - (big - (big - v))


def _weighted(s: Column) -> Column:
    """lo * (1 - d) + hi * d, where the first product is added unrounded, as DuckDB's quantile_cont does."""
    a, b, t = s["lo"], 1.0 - s["d"], s["hi"] * s["d"]
    (a1, a2), (b1, b2), p = _halves(a), _halves(b), a * b
    lost = ((a1 * b1 - p) + a1 * b2 + a2 * b1) + a2 * b2
    whole = p + t
    rounded = (p - (whole - (whole - p))) + (t - (whole - p))
    return F.nanvl(whole + (rounded + lost), whole)


def quantile(sorted_arr, p) -> Column:
    """Linear-interpolated quantile of an already sorted array, to the last bit of DuckDB's; NULL when empty."""
    a = c(sorted_arr) if isinstance(sorted_arr, str) else sorted_arr
    pos = (F.size(a) - 1) * (p if isinstance(p, Column) else F.lit(float(p)))
    lo, hi = F.get(a, F.floor(pos).cast("int")), F.get(a, F.ceil(pos).cast("int"))
    ends = F.struct(lo.alias("lo"), hi.alias("hi"), (pos - F.floor(pos)).alias("d"))
    return F.when(F.size(a) > 0, F.element_at(F.transform(F.array(ends), _weighted), 1))


def pixels_of(data, width: int) -> Column:
    return F.transform(data, lambda v, i: F.struct(
        F.floor(i / width).cast("double").alias("y"), (i % width).cast("double").alias("x"), v.alias("v")))


def dark_pixels(frames: DataFrame, width: int, percentiles: list[float], keys: list[str]) -> DataFrame:
    """One row per frame and percentile: `thr`, `mask` (pixels at or below it) and `vals` (sorted valid values)."""
    f = settle(frames.select(*keys, F.filter(pixels_of(c("data"), width), lambda p: p["v"] > 0).alias("px")))
    f = settle(f.withColumn("vals", F.array_sort(F.transform("px", lambda p: p["v"]))))
    f = f.withColumn("perc", F.explode(F.array(*[F.lit(float(p)) for p in percentiles])))
    f = settle(f.withColumn("thr", quantile("vals", c("perc") / 100.0)))
    return settle(f.withColumn("mask", F.filter("px", lambda p: p["v"] <= c("thr"))))


def weighted_centre(w) -> dict[str, Column]:
    s = F.nullif(total("mask", w), F.lit(0.0))
    return {"cx": total("mask", lambda p: w(p) * p["x"]) / s, "cy": total("mask", lambda p: w(p) * p["y"]) / s}


def map_lonlat(cx, cy, width: int, height: int, cm=0.0) -> dict[str, Column]:
    rel = F.least(F.greatest(-90.0 + cx / max(width - 1, 1) * 180.0, F.lit(-90.0)), F.lit(90.0))
    return {"lon": wrap_deg(F.lit(cm) + rel if not isinstance(cm, Column) else cm + rel),
            "lat": 90.0 - cy * (180.0 / max(height - 1, 1))}


def dark_barycentre(frames: DataFrame, width: int, percentiles, keys) -> DataFrame:
    d = dark_pixels(frames, width, percentiles, keys)
    ctr = weighted_centre(lambda p: c("thr") - p["v"] + 1e-6)
    return d.select(*keys, "perc", F.size("mask").alias("n"), ctr["cx"].alias("cx"), ctr["cy"].alias("cy"))


def otsu_barycentre(frames: DataFrame, width: int, keys, bins: int = 64) -> DataFrame:
    f = settle(frames.select(*keys, F.filter(pixels_of(c("data"), width), lambda p: p["v"] > 0).alias("px")))
    v = F.transform("px", lambda p: p["v"])
    f = settle(f.withColumns({"vmax": F.array_max(v), "vmin": F.array_min(v)}).withColumn("span", c("vmax") - c("vmin")))
    slot = lambda p: F.least(F.floor((c("vmax") - p["v"]) / F.nullif("span", F.lit(0.0)) * bins), F.lit(bins - 1)).cast("int")
    f = settle(f.withColumn("slots", F.transform("px", slot)))
    n = F.size("slots")
    f = settle(f.withColumn("slots", F.array_sort("slots")))
    # ends of the runs of equal slots: one pass over the pixels, then a short list
    last = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == n - 1) | (F.get("slots", i) != F.get("slots", i + 1)))
    f = settle(f.withColumn("_ends", F.when(n > 0, last).otherwise(F.array().cast("array<int>"))))
    upto = lambda k: F.coalesce(F.array_max(F.filter("_ends", lambda i: F.get("slots", i) <= k)) + 1, F.lit(0))
    share = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: (upto(k) - upto(k - 1)) / F.nullif(n, F.lit(0)))
    f = settle(f.withColumn("p", share))
    f = settle(f.withColumn("mu_t", F.aggregate(
        F.arrays_zip(c("p").alias("p"), F.sequence(F.lit(0), F.lit(bins - 1)).alias("k")), F.lit(0.0), lambda a, z: a + z["p"] * z["k"])))
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("m"), F.lit(0).alias("k"), F.lit(-1.0).alias("best"), F.lit(0).alias("at"))

    def step(a, p):
        w, m = a["w"] + p, a["m"] + p * a["k"]
        gap = c("mu_t") * w - m
        s = F.round(gap * gap / (w * (1.0 - w) + 1e-12), 10)
        return F.struct(
            w.alias("w"), m.alias("m"), (a["k"] + 1).alias("k"), F.greatest(a["best"], s).alias("best"),
            F.when(s > a["best"], a["k"]).otherwise(a["at"]).alias("at"))

    f = settle(f.withColumn("k", F.aggregate("p", zero, step, lambda a: a["at"])))
    f = settle(f.withColumn("thr", c("vmax") - c("k") * c("span") / bins))
    f = settle(f.withColumn("mask", F.filter("px", lambda p: p["v"] <= c("thr"))))
    ctr = weighted_centre(lambda p: c("thr") - p["v"] + 1e-6)
    return f.select(*keys, "k", "thr", F.size("mask").alias("n"), ctr["cx"].alias("cx"), ctr["cy"].alias("cy"))


def moments(frames: DataFrame, width: int, keys, perc: float = 15.0) -> DataFrame:
    """Weighted centre, second moments, lengths and the axes of the inertia ellipse of the dark mask."""
    d = dark_pixels(frames, width, [perc], keys)
    w = lambda p: c("thr") - p["v"] + 1e-6
    ctr = weighted_centre(w)
    d = settle(d.withColumns({**ctr, "sw": total("mask", w)}))
    m = lambda f: total("mask", lambda p: w(p) * f(p)) / c("sw")
    d = settle(d.withColumns({
        "cxx": m(lambda p: (p["x"] - c("cx")) * (p["x"] - c("cx"))), "cyy": m(lambda p: (p["y"] - c("cy")) * (p["y"] - c("cy"))),
        "cxy": m(lambda p: (p["x"] - c("cx")) * (p["y"] - c("cy"))),
    }))
    half, diff = (c("cxx") + c("cyy")) / 2.0, (c("cxx") - c("cyy")) / 2.0
    root = F.sqrt(diff * diff + c("cxy") * c("cxy"))
    return d.select(
        *keys, F.size("mask").alias("n"), "cx", "cy", (4.0 * F.sqrt(F.greatest("cxx", F.lit(1e-6)))).alias("length"),
        (4.0 * F.sqrt(F.greatest("cyy", F.lit(1e-6)))).alias("width"), F.greatest(half + root, F.lit(1e-9)).alias("axis_major"),
        F.greatest(half - root, F.lit(1e-9)).alias("axis_minor"))


def flux_powers(frames: DataFrame, width: int, keys, powers=(1.0, 2.0, 4.0), perc: float = 20.0) -> DataFrame:
    d = dark_pixels(frames, width, [perc], keys)
    d = d.withColumn("power", F.explode(F.array(*[F.lit(p) for p in powers])))
    ctr = weighted_centre(lambda p: F.pow(c("thr") - p["v"] + 1e-6, c("power")))
    return d.select(*keys, "power", ctr["cx"].alias("cx"), ctr["cy"].alias("cy"))


def isophote_ladder(frames: DataFrame, width: int, height: int, keys, levels=(8, 12, 16, 22, 28), least: int = 2) -> DataFrame:
    """Plain centroid per level; levels with fewer than `least` pixels are left out."""
    d = dark_pixels(frames, width, list(levels), keys).where(F.size("mask") >= least)
    one = weighted_centre(lambda p: F.lit(1.0))
    d = d.select(*keys, "perc", one["cx"].alias("cx"), one["cy"].alias("cy"))
    return d.withColumns(map_lonlat(c("cx"), c("cy"), width, height))


def percentile_ladder(frames: DataFrame, width: int, height: int, keys, levels=(5, 10, 15, 20, 25, 30, 35), least: int = 2):
    d = dark_pixels(frames, width, list(levels), keys).where(F.size("mask") >= least)
    d = settle(d.withColumn("_m", quantile(F.array_sort(F.transform("mask", lambda p: p["v"])), 0.5)))
    ctr = weighted_centre(lambda p: F.greatest(c("_m") - p["v"], F.lit(1e-6)))
    d = d.select(*keys, "perc", ctr["cx"].alias("cx"), ctr["cy"].alias("cy"))
    return d.withColumns(map_lonlat(c("cx"), c("cy"), width, height))


def column_means(width: int) -> Column:
    """Mean of valid pixels per column of `data`; NULL where none. Each column is walked by index, so all of them are one pass."""
    rows = F.floor(F.size("data") / width).cast("int")
    zero = F.struct(F.lit(0.0).alias("t"), F.lit(0).alias("n"))

    def one(x):
        def step(s, y):
            v = F.get(c("data"), y * width + x)
            return F.struct((s["t"] + F.when(v > 0, v).otherwise(F.lit(0.0))).alias("t"), (s["n"] + F.when(v > 0, 1).otherwise(F.lit(0))).alias("n"))

        return F.aggregate(F.sequence(F.lit(0), rows - 1), zero, step, lambda s: F.when(s["n"] > 0, s["t"] / s["n"]))

    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), one)


def smooth(name: str, width: int, k: int) -> Column:
    """Running mean of odd length with zeros beyond the ends."""
    h = k // 2
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: sum(
        (F.coalesce(F.get(c(name), i + j), F.lit(0.0)) for j in range(-h, h + 1)), F.lit(0.0)) / k)


def longitude_scan(frames: DataFrame, width: int, keys, k: int = 3) -> DataFrame:
    """Darkest column of the smoothed mean profile with a parabola, and the half-depth centre and width around it."""
    f = settle(frames.select(*keys, column_means(width).alias("_row")))
    med = quantile(F.array_sort(F.filter("_row", lambda v: v.isNotNull())), 0.5)
    f = settle(f.withColumn("_fill", med))
    f = settle(f.withColumn("row", F.transform("_row", lambda v: F.coalesce(v, c("_fill")))))
    f = settle(f.withColumn("sm", F.transform(smooth("row", width, k), lambda v: F.round(v, 9))))
    f = settle(f.withColumns({"i0": (F.array_position("sm", F.array_min("sm")) - 1).cast("int"), "_top": quantile(F.array_sort("sm"), 0.9)}))
    at = lambda j: F.get("sm", c("i0") + j)
    den = at(-1) - 2.0 * at(0) + at(1)
    fine = F.when((c("i0") > 0) & (c("i0") < width - 1) & (F.abs(den) > 1e-12), 0.5 * (at(-1) - at(1)) / den).otherwise(F.lit(0.0))
    f = settle(f.withColumns({"ix": c("i0") + fine, "_half": 0.5 * (c("_top") + at(0))}))
    idx = F.sequence(F.lit(0), F.lit(width - 1))
    stop = F.filter(idx, lambda i: F.get("sm", i) >= c("_half"))
    f = settle(f.withColumn("_stop", stop))
    left = F.coalesce(F.array_max(F.filter("_stop", lambda i: i <= c("i0"))), F.lit(0))
    right = F.coalesce(F.array_min(F.filter("_stop", lambda i: i >= c("i0"))), F.lit(width - 1))
    return f.select(*keys, "i0", "ix", ((left + right) / 2.0).alias("centre"), (right - left).alias("fwhm"))


def gaussian_profile(frames: DataFrame, width: int, keys, rounds: int = 3) -> DataFrame:
    """Centre and variance of the inverted mean profile, refined with a Gaussian window."""
    f = settle(frames.select(*keys, column_means(width).alias("_row")))
    f = settle(f.withColumn("_fill", quantile(F.array_sort(F.filter("_row", lambda v: v.isNotNull())), 0.5)))
    f = settle(f.withColumn("row", F.transform("_row", lambda v: F.coalesce(v, c("_fill")))))
    f = settle(f.withColumn("_mx", F.array_max("row")))
    f = settle(f.withColumn("_inv", F.transform("row", lambda v: c("_mx") - v)))
    f = settle(f.withColumn("_p40", quantile(F.array_sort("_inv"), 0.4)))
    f = settle(f.withColumn("w", F.transform(
        "_inv", lambda v, i: F.struct(i.cast("double").alias("x"), (F.greatest(v - c("_p40"), F.lit(0.0)) + 1e-12).alias("w")))))
    f = settle(f.withColumns({"_g": F.lit(1.0), "mu": total("w", lambda z: z["w"] * z["x"]) / total("w", lambda z: z["w"])}))
    spread = lambda g: total("w", lambda z: g(z) * z["w"] * (z["x"] - c("mu")) * (z["x"] - c("mu"))) / total("w", lambda z: g(z) * z["w"])
    f = settle(f.withColumn("var", spread(lambda z: F.lit(1.0))))
    for _ in range(rounds):
        old = settle(f.withColumns({"_mu0": c("mu"), "_v0": c("var")}))
        g = lambda z: F.exp(-0.5 * (z["x"] - c("_mu0")) * (z["x"] - c("_mu0")) / (c("_v0") + 1e-6))
        old = settle(old.withColumn("mu", total("w", lambda z: g(z) * z["w"] * z["x"]) / total("w", lambda z: g(z) * z["w"])))
        f = settle(old.withColumn("var", spread(g)).drop("_mu0", "_v0"))
    return f.select(*keys, "mu", "var")


def darkest(frames: DataFrame, width: int, height: int, keys) -> DataFrame:
    """Darkest pixel, the darkest pixel of the row nearest the feature latitude, and the bright-inverse centroid."""
    f = settle(frames.select(*keys, F.filter(pixels_of(c("data"), width), lambda p: p["v"] > 0).alias("px")))
    lowest = F.array_min(F.transform("px", lambda p: F.struct(p["v"].alias("v"), p["y"].alias("y"), p["x"].alias("x"))))
    lat = lambda p: 90.0 - p["y"] * (180.0 / (height - 1))
    per_row = F.array_min(F.transform("px", lambda p: F.struct(
        F.round(F.abs(lat(p) + 22.0), 9).alias("d"), p["v"].alias("v"), p["x"].alias("x"), p["y"].alias("y"))))
    f = settle(f.withColumns({"lo": lowest, "tr": per_row, "_med": quantile(F.array_sort(F.transform("px", lambda p: p["v"])), 0.5)}))
    f = settle(f.withColumn("_p70", quantile(F.array_sort(F.transform("px", lambda p: F.greatest(c("_med") - p["v"], F.lit(0.0)))), 0.7)))
    f = settle(f.withColumn("mask", F.filter("px", lambda p: F.greatest(c("_med") - p["v"], F.lit(0.0)) > c("_p70"))))
    one = weighted_centre(lambda p: F.lit(1.0))
    return f.select(
        *keys, c("lo.x").alias("min_x"), c("lo.y").alias("min_y"), c("tr.x").alias("track_x"), c("tr.y").alias("track_y"),
        one["cx"].alias("sym_x"), one["cy"].alias("sym_y"))


def extent(frames: DataFrame, width: int, height: int, keys, perc: float = 14.0) -> DataFrame:
    """West/east edges at the 95/5 percentiles of the relative longitude, midpoint, and the bounding box in latitude.

    The mask is the plain dark mask, without morphology.
    """
    d = dark_pixels(frames, width, [perc], keys)
    ctr = weighted_centre(lambda p: c("thr") - p["v"] + 1e-6)
    d = settle(d.withColumns(ctr))
    d = settle(d.withColumns(map_lonlat(c("cx"), c("cy"), width, height)))
    px_lon = lambda p: -90.0 + p["x"] / (width - 1) * 180.0
    d = settle(d.withColumn("_rel", F.array_sort(F.transform("mask", lambda p: F.round(wrap_diff(px_lon(p), c("lon")), 9)))))
    d = settle(d.withColumns({
        "west": F.round(wrap_deg(c("lon") + quantile("_rel", 0.95)), 9), "east": F.round(wrap_deg(c("lon") + quantile("_rel", 0.05)), 9)}))
    ys = F.transform("mask", lambda p: p["y"])
    lat = lambda y: 90.0 - y * (180.0 / (height - 1))
    return d.select(
        *keys, "west", "east", wrap_deg(c("east") + wrap_diff("west", "east") / 2.0).alias("mid"),
        lat(F.array_min(ys)).alias("north"), lat(F.array_max(ys)).alias("south"))


def moved_centre(px: Column, weight, steps: int, tolerance: float) -> Column:
    """Centre that is the weighted mean of the pixels under weights it sets itself, from their plain mean, for a fixed count of steps."""
    state = lambda x, y, done: F.struct(x.alias("x"), y.alias("y"), done.alias("done"))

    def mean(w) -> Column:
        zero = F.struct(*[F.lit(0.0).alias(k) for k in ("w", "x", "y")])
        add = lambda a, p: F.struct((a["w"] + w(p)).alias("w"), (a["x"] + w(p) * p["x"]).alias("x"), (a["y"] + w(p) * p["y"]).alias("y"))
        return F.aggregate(px, zero, add, lambda a: state(a["x"] / (a["w"] + 1e-12), a["y"] / (a["w"] + 1e-12), F.lit(False)))

    def step(s: Column, _: Column) -> Column:
        moved = lambda n: state(n["x"], n["y"], F.hypot(n["x"] - s["x"], n["y"] - s["y"]) < tolerance)
        new = F.element_at(F.transform(F.array(mean(lambda p: weight(p, s))), moved), 1)
        return F.when(s["done"], s).otherwise(new)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), mean(lambda p: F.lit(1.0)), step)


def two_means(px: Column, low: Column, high: Column, steps: int, part: int) -> Column:
    """Two means of x: their last values `a`, `b` and the ones `pa`, `pb` that dealt the pixels last."""
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("n", "x", "m", "z")])

    def step(s: Column, _: Column) -> Column:
        near = lambda p: F.abs(p["x"] - s["a"]) <= F.abs(p["x"] - s["b"])
        one, nil = F.lit(1.0), F.lit(0.0)
        sums = F.aggregate(px, zero, lambda t, p: F.struct(
            (t["n"] + F.when(near(p), one).otherwise(nil)).alias("n"), (t["x"] + F.when(near(p), p["x"]).otherwise(nil)).alias("x"),
            (t["m"] + F.when(near(p), nil).otherwise(one)).alias("m"), (t["z"] + F.when(near(p), nil).otherwise(p["x"])).alias("z")))
        state = lambda a, b, done: F.struct(a.alias("a"), b.alias("b"), s["a"].alias("pa"), s["b"].alias("pb"), done.alias("done"))
        new = F.element_at(F.transform(F.array(sums), lambda t: F.when(
            (t["n"] >= part) & (t["m"] >= part), state(t["x"] / t["n"], t["z"] / t["m"], F.lit(False))).otherwise(state(s["a"], s["b"], F.lit(True)))), 1)
        return F.when(s["done"], s).otherwise(new)

    start = F.struct(low.alias("a"), high.alias("b"), low.alias("pa"), high.alias("pb"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)


def iterated_centres(
    frames: DataFrame, width: int, keys, perc: float = 15.0, shift_perc: float = 16.0, least: tuple = (15, 20, 30), part: int = 5
) -> DataFrame:
    """Per image: geometric median (gx, gy; 40 steps), density mode (mx, my; 50), two means of x (k0, k1; 15) and the centre of the darker
    one (dx, dy). `n` pixels are dark, `n_shift` for the mode. A centre with fewer than its share of `least` is null and its ok is false.
    """
    d = dark_pixels(frames, width, [perc], keys)
    d = settle(d.withColumns({
        "wide": F.filter("px", lambda p: p["v"] <= quantile("vals", shift_perc / 100.0)), "xs": F.array_sort(F.transform("mask", lambda p: p["x"]))}))
    reach = max(4.0, 0.08 * width)
    away2 = lambda p, s: F.pow(p["x"] - s["x"], F.lit(2.0)) + F.pow(p["y"] - s["y"], F.lit(2.0))
    median = moved_centre(c("mask"), lambda p, s: 1.0 / F.greatest(F.sqrt(away2(p, s)), F.lit(1e-6)), 40, 1e-4)
    mode = moved_centre(c("wide"), lambda p, s: F.exp(-0.5 * away2(p, s) / (reach * reach)), 50, 1e-3)
    enough = [F.size("mask") >= least[0], F.size("wide") >= least[1], F.size("mask") >= least[2]]
    d = settle(d.withColumns({
        "g": F.when(enough[0], median), "m": F.when(enough[1], mode),
        "k": F.when(enough[2], two_means(c("mask"), quantile("xs", 0.3), quantile("xs", 0.7), 15, part))}))
    near = lambda p: F.abs(p["x"] - c("k.pa")) <= F.abs(p["x"] - c("k.pb"))
    d = settle(d.withColumns({"left": F.filter("mask", near), "right": F.filter("mask", lambda p: ~near(p))}))
    mean = lambda a, f: F.when(F.size(a) > 0, total(a, lambda p: p[f]) / F.size(a))
    first = F.coalesce(mean("left", "v") <= mean("right", "v"), F.size("left") > 0)
    d = settle(d.withColumn("dark", F.when(enough[2], F.when(first, c("left")).otherwise(c("right")))))
    return d.select(
        *keys, F.size("mask").alias("n"), F.size("wide").alias("n_shift"), c("g.x").alias("gx"), c("g.y").alias("gy"),
        c("m.x").alias("mx"), c("m.y").alias("my"), c("k.a").alias("k0"), c("k.b").alias("k1"), mean("dark", "x").alias("dx"), mean("dark", "y").alias("dy"),
        enough[0].alias("median_ok"), enough[1].alias("mode_ok"), enough[2].alias("split_ok"))


def histogram_mode(frames: DataFrame, width: int, keys, perc: float = 15.0, cell: int = 2) -> DataFrame:
    """Cell of the coarse grid with most dark pixels, neighbours counting half; first cell on ties. Each cell counts its own pixels by
    index, and the votes look up nine counts: linear in the pixels."""
    vals = F.array_sort(F.filter("data", lambda v: v > 0))
    d = settle(frames.select(*keys, "data", quantile(vals, perc / 100.0).alias("thr")))
    rows, across = F.floor(F.size("data") / width).cast("int"), -(-width // cell)
    down = F.ceil(rows / cell).cast("int")

    def dark(k):
        def one(s, j):
            y, x = F.floor(k / across).cast("int") * cell + F.floor(j / cell).cast("int"), (k % across) * cell + j % cell
            v = F.get(c("data"), y * width + x)
            return s + F.when((x < width) & (y < rows) & (v > 0) & (v <= c("thr")), 1.0).otherwise(F.lit(0.0))

        return F.aggregate(F.sequence(F.lit(0), F.lit(cell * cell - 1)), F.lit(0.0), one)

    cells = F.sequence(F.lit(0), down * across - 1)
    d = settle(d.select(*keys, down.alias("down"), F.transform(cells, dark).alias("n")))

    def votes(k):
        y, x = F.floor(k / across).cast("int"), k % across
        near = [
            F.when((y + dy >= 0) & (y + dy < c("down")) & (x + dx >= 0) & (x + dx < across), F.get("n", k + dy * across + dx)).otherwise(F.lit(0.0))
            for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx
        ]
        return F.get("n", k) + 0.5 * sum(near[1:], near[0])

    cells = F.sequence(F.lit(0), F.size("n") - 1)
    d = settle(d.withColumn("best", F.array_min(F.transform(cells, lambda k: F.struct((-votes(k)).alias("neg"), k.alias("k"))))))
    return d.select(
        *keys, (-c("best.neg")).alias("votes"), ((c("best.k") % across + 0.5) * cell - 0.5).alias("cx"),
        ((F.floor(c("best.k") / across) + 0.5) * cell - 0.5).alias("cy"))


def laplacian_variance(frames: DataFrame, width: int, height: int, keys, keep: float = 0.30, least: int = 16) -> DataFrame:
    """Variance of the five-point Laplacian over inner pixels among the brightest share."""
    f = settle(frames.withColumn("thr", quantile(F.array_sort("data"), int((1.0 - keep) * 100) / 100.0)))
    at = lambda i: F.get("data", i)
    inner = lambda i: (i % width > 0) & (i % width < width - 1)
    lap = F.transform(
        F.filter(F.sequence(F.lit(width), F.lit(max(width * (height - 1) - 1, width))), lambda i: inner(i) & (at(i) >= c("thr"))),
        lambda i: at(i + width) + at(i - width) + at(i + 1) + at(i - 1) - 4.0 * at(i))
    f = settle(f.select(*keys, lap.alias("lap")))
    n = F.size("lap")
    some = F.nullif(n, F.lit(0))
    f = settle(f.withColumn("_m", total("lap") / some))
    var = total("lap", lambda v: (v - c("_m")) * (v - c("_m"))) / some
    return f.select(*keys, n.alias("n"), F.when(n >= least, var).otherwise(F.lit(0.0)).alias("sharp"))


def frame_metrics(frames: DataFrame, width: int, keys) -> DataFrame:
    """Variance and maximum on bright pixels, mean gradient and contrast of the whole frame."""
    f = settle(frames.withColumns({"thr": quantile(F.array_sort("data"), 0.7), "mean": total("data") / F.size("data")}))
    bright = F.filter("data", lambda v: v >= c("thr"))
    f = settle(f.withColumn("b", bright))
    f = settle(f.withColumn("_bm", total("b") / F.size("b")))
    n = F.size("data")
    idx = F.sequence(F.lit(0), n - 1)
    gx = F.transform(F.filter(idx, lambda i: i % width < width - 1), lambda i: F.abs(F.get("data", i + 1) - F.get("data", i)))
    gy = F.transform(F.filter(idx, lambda i: i < n - width), lambda i: F.abs(F.get("data", i + width) - F.get("data", i)))
    sd = F.sqrt(total("data", lambda v: (v - c("mean")) * (v - c("mean"))) / n)
    return f.select(
        *keys, (total("b", lambda v: (v - c("_bm")) * (v - c("_bm"))) / F.size("b")).alias("variance"), F.array_max("b").alias("peak"),
        (total(gx) / F.size(gx) + total(gy) / F.size(gy)).alias("gradient"), (sd / (c("mean") + 1e-9)).alias("contrast"))


def stretch(frames: DataFrame, keys, lo: float = 0.1, hi: float = 99.9) -> DataFrame:
    f = settle(frames.withColumn("_s", F.array_sort("data")))
    f = settle(f.withColumns({"_a": quantile("_s", lo / 100.0), "_b": quantile("_s", hi / 100.0)}))
    f = settle(f.withColumn("_d", F.when(c("_b") <= c("_a"), F.lit(1.0)).otherwise(c("_b") - c("_a"))))
    return f.select(*keys, F.transform("data", lambda v: F.least(F.greatest((v - c("_a")) / c("_d"), F.lit(0.0)), F.lit(1.0))).alias("data"))


def hot_pixels(frames: DataFrame, keys, sigma: float = 5.0) -> DataFrame:
    """Boolean mask of pixels beyond sigma robust deviations."""
    f = settle(frames.withColumn("_m", quantile(F.array_sort("data"), 0.5)))
    f = settle(f.withColumn("_d", F.array_sort(F.transform("data", lambda v: F.abs(v - c("_m"))))))
    f = settle(f.withColumn("_s", quantile("_d", 0.5) + 1e-12))
    return f.select(*keys, "data", F.transform("data", lambda v: F.abs(v - c("_m")) > sigma * 1.4826 * c("_s")).alias("hot"))


def replace_hot(masked: DataFrame, width: int, height: int, keys) -> DataFrame:
    """Hot pixels become the sum of their neighbours over the number of neighbours that are not hot."""
    offs = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dy, dx) != (0, 0)]

    def one(v, i):
        y, x = F.floor(i / width).cast("int"), i % width
        near = F.filter(F.array(*[F.struct((y + dy).alias("y"), (x + dx).alias("x")) for dy, dx in offs]),
                        lambda q: q["y"].between(0, height - 1) & q["x"].between(0, width - 1))
        s = F.aggregate(near, F.lit(0.0), lambda a, q: a + F.get(c("data"), q["y"] * width + q["x"]))
        n = F.size(F.filter(near, lambda q: ~F.get(c("hot"), q["y"] * width + q["x"])))
        return F.when(F.get(c("hot"), i), F.when(n > 0, s / F.when(n > 0, n)).otherwise(F.lit(0.0))).otherwise(v)

    return masked.select(*keys, F.transform("data", one).alias("data"))


def cylindrical_map(frames: DataFrame, width: int, height: int, keys, nav: dict, map_w: int, map_h: int) -> DataFrame:
    """Bilinear samples of each image on a lon/lat grid; cells near or beyond the limb or the border are 0.

    The grid-to-pixel table depends on the geometry only, so it is a literal of the plan and each row reads its own array.
    """
    k = 1.0 - nav["flattening"]
    d, pa = math.radians(nav["sub_lat"]), math.radians(nav["north_pa"])
    cells = []
    for row in range(map_h):
        la = math.radians(90.0 - row * 180.0 / (map_h - 1))
        for col in range(map_w):
            lo = math.radians(-90.0 + col * 180.0 / (map_w - 1))
            r = 1.0 / math.sqrt(math.cos(la) ** 2 + (math.sin(la) / k) ** 2)
            bx, by, bz = r * math.cos(la) * math.sin(lo), r * math.sin(la), r * math.cos(la) * math.cos(lo)
            ty, tz = by * math.cos(d) - bz * math.sin(d), by * math.sin(d) + bz * math.cos(d)
            x = nav["xc"] + (bx * math.cos(pa) - ty * math.sin(pa)) * nav["a_eq_px"]
            y = nav["yc"] - (bx * math.sin(pa) + ty * math.cos(pa)) * nav["a_eq_px"]
            if tz > 0.02 and 0 <= math.floor(x) < width - 1 and 0 <= math.floor(y) < height - 1:
                cells.append((row, col, math.floor(y), math.floor(x), y - math.floor(y), x - math.floor(x)))
    spark = frames.sparkSession
    grid = spark.createDataFrame(
        [(map_w * map_h, cells)], "n int, cells array<struct<row:int,col:int,y:int,x:int,fy:double,fx:double>>")
    f = attach(frames, grid, [])  # one row of geometry
    f = f.select(*keys, "data", F.explode("cells").alias("g"))
    at = lambda dy, dx: F.get("data", (c("g.y") + dy) * width + c("g.x") + dx)
    fy, fx = c("g.fy"), c("g.fx")
    v = at(0, 0) * (1 - fx) * (1 - fy) + at(0, 1) * fx * (1 - fy) + at(1, 0) * (1 - fx) * fy + at(1, 1) * fx * fy
    return f.select(*keys, c("g.row").alias("row"), c("g.col").alias("col"), v.alias("v"))


def row_warp(frames: DataFrame, width: int, keys, shifts: list[float]) -> DataFrame:
    """Each row moved by its own shift with linear interpolation and edge values beyond the ends."""
    table = F.array(*[F.lit(float(s)) for s in shifts])

    def one(v, i):
        y, x = F.floor(i / width).cast("int"), i % width
        s = F.get(table, y)
        at = F.least(F.greatest(x - s, F.lit(0.0)), F.lit(float(width - 1)))
        lo = F.floor(at).cast("int")
        hi = F.least(lo + 1, F.lit(width - 1))
        a, b = F.get(c("data"), y * width + lo), F.get(c("data"), y * width + hi)
        return F.when(F.abs(s) < 0.02, v).otherwise(a + (b - a) * (at - lo))

    return frames.select(*keys, F.transform("data", one).alias("data"))


def border_plane(frames: DataFrame, width: int, height: int, keys) -> DataFrame:
    """Plane a + b x + c y through the border pixels by least squares."""
    return _border_fit(frames, width, height, keys, {"a": (0, 0), "b": (1, 0), "c": (0, 1)})


def border_quadratic(frames: DataFrame, width: int, height: int, keys) -> DataFrame:
    """Second-order border surface a + b x + c y + d x^2 + e x y + f y^2 by least squares; a term that is zero on all border pixels gets 0."""
    return _border_fit(frames, width, height, keys, {"a": (0, 0), "b": (1, 0), "c": (0, 1), "d": (2, 0), "e": (1, 1), "f": (0, 2)})


def solve_normal(df: DataFrame, s: str, r: str, n: int, out: list[str]) -> DataFrame:
    """Solution of S z = r by Cholesky steps in column arithmetic. `s` holds the lower triangle of S by rows, `r` the right side.

    An unknown whose pivot vanishes (beside its diagonal entry) adds nothing that the ones before it don't, and is 0.
    """
    at = lambda i, j: F.get(c(s), F.lit(i * (i + 1) // 2 + j))
    less = lambda v, terms: sum((-t for t in terms), v)
    low, y, z = (lambda i, j: c(f"_l{i}_{j}")), (lambda i: c(f"_y{i}")), (lambda i: c(f"_z{i}"))
    for j in range(n):
        pivot = less(at(j, j), (low(j, k) * low(j, k) for k in range(j)))
        df = df.withColumn(f"_l{j}_{j}", F.when(pivot > 1e-12 * at(j, j), F.sqrt(pivot)).otherwise(F.lit(0.0)))
        over = lambda v: F.when(low(j, j) > 0, v / low(j, j)).otherwise(F.lit(0.0))  # noqa: E731, B023
        df = df.withColumns({
            **{f"_l{i}_{j}": over(less(at(i, j), (low(i, k) * low(j, k) for k in range(j)))) for i in range(j + 1, n)},
            f"_y{j}": over(less(F.get(c(r), F.lit(j)), (low(j, k) * y(k) for k in range(j)))),
        })
    for j in reversed(range(n)):
        v = less(y(j), (low(k, j) * z(k) for k in range(j + 1, n)))
        df = df.withColumn(f"_z{j}", F.when(low(j, j) > 0, v / low(j, j)).otherwise(F.lit(0.0)))
    names = [f"_l{i}_{j}" for i in range(n) for j in range(i + 1)] + [f"_y{i}" for i in range(n)]
    return df.withColumns({name: z(i) for i, name in enumerate(out)}).drop(*names, *[f"_z{i}" for i in range(n)])


def _border_fit(frames, width, height, keys, powers: dict[str, tuple[int, int]]) -> DataFrame:
    """Moments of the valid border pixels of each frame by index arithmetic, then normal equations. x and y are scaled to at most 1."""
    sx, sy = 1.0 / max(width - 1, 1), 1.0 / max(height - 1, 1)
    names = list(powers)
    x, y = (lambda i: i % width), (lambda i: F.floor(i / width))
    border = lambda i: (y(i) < height * 0.05) | (y(i) > height * 0.95) | (x(i) < width * 0.05) | (x(i) > width * 0.95)
    v = lambda i: F.get(c("data"), i)
    valid = lambda i: v(i).isNotNull() & ~F.isnan(v(i))
    px = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(width * height - 1)), lambda i: border(i) & valid(i)),
        lambda i: F.struct((x(i) * sx).alias("x"), (y(i) * sy).alias("y"), v(i).alias("v")),
    )
    f = settle(frames.select(*keys, px.alias("_px")))

    def term(p, n, m):
        factors = [p["x"]] * n + [p["y"]] * m
        out = F.lit(1.0)
        for q in factors:
            out = out * q
        return out

    pairs = [(powers[a], powers[b]) for i, a in enumerate(names) for b in names[: i + 1]]
    sums = F.array(*[total("_px", lambda p, a=a, b=b: term(p, a[0] + b[0], a[1] + b[1])) for a, b in pairs])
    right = F.array(*[total("_px", lambda p, a=a: term(p, *a) * p["v"]) for a in powers.values()])
    f = settle(f.select(*keys, sums.alias("_s"), right.alias("_r")))
    f = solve_normal(f, "_s", "_r", len(names), names)
    return f.select(*keys, *[(c(k) * (sx**n * sy**m)).alias(k) for k, (n, m) in powers.items()])


def disk_median(vals_sorted) -> Column:
    """Median of the values at or above the 60th percentile of a sorted array."""
    return quantile(F.filter(vals_sorted, lambda v: v >= c("_p60")), 0.5)


def with_disk_median(frames: DataFrame, out: str = "disk_median") -> DataFrame:
    f = settle(frames.withColumn("_s", F.array_sort("data")))
    f = settle(f.withColumn("_p60", quantile("_s", 0.6)))
    return settle(f.withColumn(out, F.coalesce(disk_median(c("_s")), F.lit(1.0))).drop("_s", "_p60"))


def isophote_size(frames: DataFrame, width: int, keys, level: float = 0.45, least: int = 4, scale=(1.0, 1.0)) -> DataFrame:
    """Two-sigma ellipse of pixels darker than a share of the deepest one; default size when unusable."""
    f = settle(frames.select(*keys, F.filter(pixels_of(c("data"), width), lambda p: p["v"] > 0).alias("px")))
    f = settle(f.withColumn("_med", quantile(F.array_sort(F.transform("px", lambda p: p["v"])), 0.5)))
    f = settle(f.withColumn("inv", F.transform("px", lambda p: F.struct(
        p["y"].alias("y"), p["x"].alias("x"), F.greatest(c("_med") - p["v"], F.lit(0.0)).alias("w")))))
    f = settle(f.withColumn("_top", F.array_max(F.transform("inv", lambda p: p["w"]))))
    f = settle(f.withColumn("mask", F.filter("inv", lambda p: p["w"] >= level * c("_top"))))
    f = settle(f.withColumns(weighted_centre(lambda p: p["w"])).withColumn("sw", total("mask", lambda p: p["w"]) + 1e-12))
    m = lambda g: total("mask", lambda p: p["w"] * g(p)) / c("sw")
    f = settle(f.withColumns({
        "cxx": m(lambda p: (p["x"] - c("cx")) * (p["x"] - c("cx"))), "cyy": m(lambda p: (p["y"] - c("cy")) * (p["y"] - c("cy"))),
        "cxy": m(lambda p: (p["x"] - c("cx")) * (p["y"] - c("cy"))),
    }))
    half, diff = (c("cxx") + c("cyy")) / 2.0, (c("cxx") - c("cyy")) / 2.0
    root = F.sqrt(diff * diff + c("cxy") * c("cxy"))
    f = settle(f.withColumns({"_a": F.sqrt(F.greatest(half + root, F.lit(1e-9))), "_b": F.sqrt(F.greatest(half - root, F.lit(1e-9)))}))
    fit = lambda v, s, lo, hi: F.least(F.greatest(4.0 * c(v) * s, F.lit(lo)), F.lit(hi))
    f = settle(f.withColumns({"_l": fit("_a", scale[0], 5.0, 22.0), "_w": fit("_b", scale[1], 3.0, 14.0)}))
    bad = (F.size("mask") < least) | (c("_top") <= 0) | (c("_l") / c("_w") > 3.5) | (c("_w") / c("_l") > 2.0)
    return f.select(*keys, F.size("mask").alias("n"), F.when(bad, F.lit(12.0)).otherwise(c("_l")).alias("length"),
                    F.when(bad, F.lit(8.0)).otherwise(c("_w")).alias("width"))


def gain_match(frames: DataFrame, keys, floor: float) -> DataFrame:
    """Gains of R and B to G from medians of their brighter pixels on common coverage; columns r, g, b arrays."""
    both = F.filter(F.arrays_zip("r", "g", "b"), lambda p: (p["r"] > floor) & (p["g"] > floor) & (p["b"] > floor))
    f = settle(frames.withColumn("common", both))
    for ch in ("r", "g", "b"):
        f = settle(f.withColumn(f"_v{ch}", F.array_sort(F.transform("common", lambda p: p[ch]))))
        f = settle(f.withColumn("_p60", quantile(f"_v{ch}", 0.6)))
        f = settle(f.withColumn(f"_m{ch}", disk_median(c(f"_v{ch}"))))
    n = F.size("r")
    cov = lambda ch: (F.size(F.filter(ch, lambda v: v > floor)) / n)
    gain = lambda ch: F.when(F.abs(c(f"_m{ch}")) > 1e-12, c("_mg") / c(f"_m{ch}")).otherwise(F.lit(1.0))
    return f.select(
        *keys, gain("r").alias("gain_r"), gain("b").alias("gain_b"), cov("r").alias("cover_r"), cov("g").alias("cover_g"),
        cov("b").alias("cover_b"), (n - F.size("common")).alias("n_uncovered"))


def fringe(frames: DataFrame, width: int, height: int, keys) -> DataFrame:
    """Colour differences on the strongest fifth of green edges, over the green RMS; columns r, g, b arrays."""
    def grad(i, step, pos, last):
        at = lambda j: F.get(c("g"), j)
        return F.when(pos == 0, at(i + step) - at(i)).when(pos == last, at(i) - at(i - step)).otherwise((at(i + step) - at(i - step)) / 2.0)

    idx = F.sequence(F.lit(0), F.lit(width * height - 1))
    mag = F.transform(idx, lambda i: F.round(F.hypot(
        grad(i, width, F.floor(i / width), height - 1), grad(i, 1, i % width, width - 1)), 10))
    f = settle(frames.withColumn("_g", mag))
    f = settle(f.withColumn("_thr", quantile(F.array_sort("_g"), 0.8)))
    edge = F.filter(idx, lambda i: F.get(c("_g"), i) >= c("_thr"))
    diff = F.transform(edge, lambda i: F.abs(F.get(c("r"), i) - F.get(c("g"), i)) + F.abs(F.get(c("b"), i) - F.get(c("g"), i)))
    f = settle(f.withColumn("_d", F.array_sort(diff)))
    rms = F.sqrt(total("g", lambda v: v * v) / F.size("g")) + 1e-12
    return f.select(*keys, F.size("_d").alias("n_edges"), (quantile("_d", 0.5) / rms).alias("fringe"))


def colour_lock(px: DataFrame, keys, band: tuple[float, float], radius: float, ridge: float = 1.35, least: int = 4) -> DataFrame:
    """Arg-max of the colour score inside a latitude band and the centroid around it.

    `px` is an array of pixels with y, x, lat and score per image. A peak not above `ridge` times the median positive
    score of its rows is a belt, not an oval: `ok` is then false.
    """
    f = settle(px.select(*keys, F.filter("px", lambda p: (p["lat"] >= band[0]) & (p["lat"] <= band[1])).alias("s")))
    best = F.array_min(F.transform("s", lambda p: F.struct((-p["score"]).alias("n"), p["y"].alias("y"), p["x"].alias("x"))))
    f = settle(f.withColumn("pk", best))
    rows = F.filter("s", lambda p: (F.abs(p["y"] - c("pk.y")) <= 2) & (p["score"] > 0))
    f = settle(f.withColumn("_pos", F.array_sort(F.transform(rows, lambda p: p["score"]))))
    f = settle(f.withColumn("mask", F.filter("s", lambda p: (F.abs(p["y"] - c("pk.y")) <= radius) & (F.abs(p["x"] - c("pk.x")) <= radius))))
    w = lambda p: F.greatest(p["score"], F.lit(0.0))
    sw = total("mask", w)
    peak = -c("pk.n")
    belt = (F.size("_pos") >= least) & (peak < ridge * quantile("_pos", 0.5))
    return f.where(c("pk").isNotNull()).select(
        *keys, peak.alias("peak"), F.when(sw > 0, total("mask", lambda p: w(p) * p["y"]) / F.when(sw > 0, sw)).otherwise(c("pk.y")).alias("cy"),
        F.when(sw > 0, total("mask", lambda p: w(p) * p["x"]) / F.when(sw > 0, sw)).otherwise(c("pk.x")).alias("cx"),
        ((peak > 0) & ~belt).alias("ok"))


def disk_profile(px: DataFrame, keys, xc: float, yc: float, a: float, flattening: float, bins: int, lo: float, hi: float) -> DataFrame:
    """Fill and contrast of the disk ellipse and the 20-80 % limb width of the radial profile, in disk radii.

    Fill counts pixels above a quarter of the frame maximum, without morphology. Radial bins are few per frame.
    """
    from pyspark.sql import Window

    b = a * (1.0 - flattening)
    inside = (F.pow((c("x") - xc) / a, 2) + F.pow((c("y") - yc) / b, 2)) <= 1.0
    rr = F.sqrt(F.pow(c("x") - xc, 2) + F.pow(c("y") - yc, 2)) / (a + 1e-12)
    p = px.withColumns({"_in": inside, "_rr": rr})
    top = p.groupBy(*keys).agg(F.max("v").alias("_top"), F.avg(F.when(c("_in"), c("v"))).alias("_mi"),
                               F.avg(F.when(~c("_in"), c("v"))).alias("_mo"))
    r = p.join(top, keys)  # one row per frame on the right
    fill = r.groupBy(*keys).agg(
        F.avg(F.when(c("_in"), (c("v") >= 0.25 * c("_top")).cast("double"))).alias("fill"),
        F.first(c("_mi") - F.coalesce("_mo", F.lit(0.0))).alias("contrast"))
    k = F.floor((c("_rr") - lo) / ((hi - lo) / bins)).cast("int")
    prof = p.where((c("_rr") >= lo) & (c("_rr") < hi)).groupBy(*keys, k.alias("bin")).agg(F.avg("v").alias("m"))
    by = Window.partitionBy(*keys)
    mid = lo + (c("bin") + 0.5) * ((hi - lo) / bins)
    prof = prof.withColumn("r", mid)
    prof = prof.withColumns({"_i": F.median(F.when(c("r") < 0.85, c("m"))).over(by), "_o": F.median(F.when(c("r") > 1.15, c("m"))).over(by)})
    prof = prof.withColumn("n", (c("m") - c("_o")) / F.greatest(c("_i") - c("_o"), F.lit(1e-6)))
    w = by.orderBy("bin")
    prof = prof.withColumns({"_n2": F.lead("n").over(w), "_r2": F.lead("r").over(w), "_b2": F.lead("bin").over(w)})

    def cross(level):
        hit = (c("_b2") == c("bin") + 1) & (((c("n") >= level) & (c("_n2") < level)) | ((c("n") > level) & (c("_n2") <= level)))
        at = c("r") + (level - c("n")) / (c("_n2") - c("n") + 1e-12) * (c("_r2") - c("r"))
        return F.min_by(at, F.when(hit, c("bin")))

    soft = prof.groupBy(*keys).agg(((cross(0.2) - cross(0.8)) / 1.6832 * 2.3548).alias("softness"))
    return fill.join(soft, keys, "left")


def disk_gate(df: DataFrame, radius_px: Column) -> DataFrame:
    """Fill, contrast, radius and softness (arcsec) gates with reasons."""
    reasons = F.array_compact(F.array(
        F.when(c("fill") < 0.90, F.lit("fill")), F.when(c("contrast") < 0.25, F.lit("contrast")),
        F.when(radius_px < 25.0, F.lit("radius")), F.when(c("softness_arcsec") > 3.5, F.lit("soft_warn")),
        F.when(c("softness_arcsec") > 5.0, F.lit("soft_fail"))))
    df = df.withColumn("reasons", F.array_join(reasons, ","))
    present = ~((c("fill") < 0.90) | (c("contrast") < 0.25) | (radius_px < 25.0))
    return df.withColumns({
        "disk_present": present, "measurable": present & ~F.coalesce(c("softness_arcsec") > 5.0, F.lit(False))})
