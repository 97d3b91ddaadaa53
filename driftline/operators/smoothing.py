"""Position/rate Kalman filter with backward smoothing for series of any length, in column arithmetic.

The recursion is associative. Rows are dealt to (series, span) and there to leaves of at most `LEAF` rows. A leaf folds its rows to one element
of 14 numbers: the linear map from the state before it to the state after it, and what its measurements say about the former.
`prefixes` combines the elements of a series in blocks and the blocks in order (the depth is that of a tree), which gives every leaf the state before
it; the leaf then filters its rows. Backward smoothing does the same from the other end with 9 numbers. No Python, and no step that
passes through all rows of a series one by one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import Timeline, by_length, cut

c = F.col
LEAF = 64
BLOCK = 256
#: Leaves of one span at most (64 rows each).
SPAN_LEAVES = 1 << 20
#: A series of at most this many leaves is smoothed as one array.
WHOLE_LEAVES = 16


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate once, use often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pack(**fields: Column) -> Column:
    return F.struct(*[v.cast("double").alias(k) for k, v in fields.items()])


class Model:
    """Noise conventions: `sigma` takes sigmas and integrated white noise, `variance` takes variances and diagonal noise."""

    def __init__(self, kind: str, q_pos: float = 1e-6, q_vel: float = 1e-7):
        self.kind, self.q_pos, self.q_vel = kind, q_pos, q_vel
        self.jitter = 0.0 if kind == "sigma" else 1e-12

    def start(self, r: Column) -> Column:
        """Variance of the first position; that of the rate is 1."""
        return r * r + 0.1 if self.kind == "sigma" else r

    def noise(self, r: Column) -> Column:
        return F.pow(F.greatest(r, F.lit(1e-6)), 2) if self.kind == "sigma" else r

    def step(self, dt: Column) -> Column:
        return F.greatest(dt, F.lit(1e-9)) if self.kind == "sigma" else F.when(dt > 0, dt).otherwise(1e-6)

    def process(self, h: Column, r: Column) -> tuple[Column, Column, Column]:
        if self.kind == "variance":
            return self.q_pos * h, F.lit(0.0), self.q_vel * h
        q = self.q_pos * F.pow(F.greatest(r, F.lit(0.05)), 2)
        return q * h * h * h / 3, q * h * h / 2, q * h


def prefixes(parts: DataFrame, by: list[str], pos: str, el: str, join: Callable[[Column, Column], Column]) -> DataFrame:
    """by, pos, `before`: the combination of all elements of the key in front of each part (NULL for the first)."""
    joined = lambda a, x: F.when(a.isNull(), x).otherwise(join(a, x))

    def fold(of: Column) -> Column:
        return F.aggregate(F.slice(of, F.lit(2), F.greatest(F.size(of) - 1, F.lit(0))), F.get(of, F.lit(0))[el], lambda a, x: join(a, x[el]))

    def scan(of: Column, start: Column) -> Column:
        kind = F.filter(F.transform(of, lambda x: x[el]), lambda _: F.lit(False))
        step = lambda s, x: F.struct(joined(s["a"], x[el]).alias("a"), F.concat(s["all"], F.array(s["a"])).alias("all"))
        return F.aggregate(of, F.struct(start.alias("a"), kind.alias("all")), step, lambda s: s["all"])

    blocks = parts.groupBy(*by, F.floor(c(pos) / BLOCK).cast("bigint").alias("_blk")).agg(F.array_sort(F.collect_list(F.struct(pos, el))).alias("_of"))
    blocks = cut(blocks.withColumn(el, fold(c("_of"))))
    none = F.when(F.lit(False), F.get(F.transform("_of", lambda x: x[el]), F.lit(0)))
    keys = blocks.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_blk", el))).alias("_of"))
    into = keys.select(*by, F.explode(F.arrays_zip(F.transform("_of", lambda x: x["_blk"]).alias("_blk"), scan(c("_of"), none).alias("_b"))).alias("_p"))
    into = blocks.join(into.select(*by, "_p._blk", "_p._b"), [*by, "_blk"])
    out = into.select(*by, F.explode(F.arrays_zip(F.transform("_of", lambda x: x[pos]).alias(pos), scan(c("_of"), c("_b")).alias("before"))).alias("_p"))
    return out.select(*by, f"_p.{pos}", "_p.before")


def filter_step(m: Model, s: Column, row: Column) -> Column:
    """One row into an element: predict, then take the measurement. `s` is NULL in front of a leaf; a row without dt begins the series."""

    def measured(p: Column) -> Column:
        # p: predicted map a, mean b, covariance c, and what is known of the state before the leaf (e, j)
        def gained(g: Column) -> Column:
            return pack(
                a00=p["a00"] - g["k0"] * p["a00"], a01=p["a01"] - g["k0"] * p["a01"], a10=p["a10"] - g["k1"] * p["a00"], a11=p["a11"] - g["k1"] * p["a01"],
                b0=p["b0"] + g["k0"] * g["d"], b1=p["b1"] + g["k1"] * g["d"],
                c00=p["c00"] - g["k0"] * p["c00"], c01=p["c01"] - g["k0"] * p["c01"], c11=p["c11"] - g["k1"] * p["c01"],
                e0=p["e0"] + p["a00"] * g["d"] / g["s"], e1=p["e1"] + p["a01"] * g["d"] / g["s"],
                j00=p["j00"] + p["a00"] * p["a00"] / g["s"], j01=p["j01"] + p["a00"] * p["a01"] / g["s"], j11=p["j11"] + p["a01"] * p["a01"] / g["s"],
            )

        total = p["c00"] + m.noise(row["r"])
        return let(let(total, lambda s_: pack(s=s_, k0=p["c00"] / s_, k1=p["c01"] / s_, d=row["z"] - p["b0"])), gained)

    def ahead(q: Column) -> Column:
        h = m.step(row["dt"])
        n00, n01, n11 = m.process(h, row["r"])
        return pack(
            a00=q["a00"] + h * q["a10"], a01=q["a01"] + h * q["a11"], a10=q["a10"], a11=q["a11"], b0=q["b0"] + h * q["b1"], b1=q["b1"],
            c00=q["c00"] + 2 * h * q["c01"] + h * h * q["c11"] + n00, c01=q["c01"] + h * q["c11"] + n01, c11=q["c11"] + n11,
            e0=q["e0"], e1=q["e1"], j00=q["j00"], j01=q["j01"], j11=q["j11"],
        )

    zero, one = F.lit(0.0), F.lit(1.0)
    names = ["a00", "a01", "a10", "a11", "b0", "b1", "c00", "c01", "c11", "e0", "e1", "j00", "j01", "j11"]
    same = pack(**{n: one if n in ("a00", "a11") else zero for n in names})
    begin = pack(**{n: {"b0": row["z"], "c00": m.start(row["r"]), "c11": one}.get(n, zero) for n in names})
    return let(F.when(row["dt"].isNull(), begin).otherwise(let(F.coalesce(s, same), ahead)), measured)


def filter_join(x: Column, y: Column) -> Column:
    """Element x, then element y."""

    def with_d(d: Column) -> Column:
        # d = inverse of I + C1 J2; g = d A1; l = A2 d
        def result(w: Column) -> Column:
            v0, v1 = x["b0"] + x["c00"] * y["e0"] + x["c01"] * y["e1"], x["b1"] + x["c01"] * y["e0"] + x["c11"] * y["e1"]
            m00, m01 = w["l00"] * x["c00"] + w["l01"] * x["c01"], w["l00"] * x["c01"] + w["l01"] * x["c11"]
            m10, m11 = w["l10"] * x["c00"] + w["l11"] * x["c01"], w["l10"] * x["c01"] + w["l11"] * x["c11"]
            u0, u1 = y["e0"] - y["j00"] * x["b0"] - y["j01"] * x["b1"], y["e1"] - y["j01"] * x["b0"] - y["j11"] * x["b1"]
            h00, h01 = y["j00"] * x["a00"] + y["j01"] * x["a10"], y["j00"] * x["a01"] + y["j01"] * x["a11"]
            h10, h11 = y["j01"] * x["a00"] + y["j11"] * x["a10"], y["j01"] * x["a01"] + y["j11"] * x["a11"]
            return pack(
                a00=y["a00"] * w["g00"] + y["a01"] * w["g10"], a01=y["a00"] * w["g01"] + y["a01"] * w["g11"],
                a10=y["a10"] * w["g00"] + y["a11"] * w["g10"], a11=y["a10"] * w["g01"] + y["a11"] * w["g11"],
                b0=w["l00"] * v0 + w["l01"] * v1 + y["b0"], b1=w["l10"] * v0 + w["l11"] * v1 + y["b1"],
                c00=m00 * y["a00"] + m01 * y["a01"] + y["c00"], c01=m00 * y["a10"] + m01 * y["a11"] + y["c01"], c11=m10 * y["a10"] + m11 * y["a11"] + y["c11"],
                e0=w["g00"] * u0 + w["g10"] * u1 + x["e0"], e1=w["g01"] * u0 + w["g11"] * u1 + x["e1"],
                j00=w["g00"] * h00 + w["g10"] * h10 + x["j00"], j01=w["g00"] * h01 + w["g10"] * h11 + x["j01"], j11=w["g01"] * h01 + w["g11"] * h11 + x["j11"],
            )

        return let(pack(
            g00=d["d00"] * x["a00"] + d["d01"] * x["a10"], g01=d["d00"] * x["a01"] + d["d01"] * x["a11"],
            g10=d["d10"] * x["a00"] + d["d11"] * x["a10"], g11=d["d10"] * x["a01"] + d["d11"] * x["a11"],
            l00=y["a00"] * d["d00"] + y["a01"] * d["d10"], l01=y["a00"] * d["d01"] + y["a01"] * d["d11"],
            l10=y["a10"] * d["d00"] + y["a11"] * d["d10"], l11=y["a10"] * d["d01"] + y["a11"] * d["d11"],
        ), result)

    def inverse(n: Column) -> Column:
        det = n["n00"] * n["n11"] - n["n01"] * n["n10"]
        return let(det, lambda t: pack(d00=n["n11"] / t, d01=-n["n01"] / t, d10=-n["n10"] / t, d11=n["n00"] / t))

    n = pack(
        n00=1.0 + x["c00"] * y["j00"] + x["c01"] * y["j01"], n01=x["c00"] * y["j01"] + x["c01"] * y["j11"],
        n10=x["c01"] * y["j00"] + x["c11"] * y["j01"], n11=1.0 + x["c01"] * y["j01"] + x["c11"] * y["j11"],
    )
    return let(let(n, inverse), with_d)


def back_element(m: Model, row: Column) -> Column:
    """What a filtered row makes of the smoothed state after it: gain g, mean u, covariance v."""
    x0, x1, p00, p01, p11 = (row[n] for n in ("x0", "x1", "p00", "p01", "p11"))
    h = m.step(row["ndt"])
    n00, n01, n11 = m.process(h, row["nr"])

    def gain(a: Column) -> Column:
        det = (a["a00"] + m.jitter) * (a["a11"] + m.jitter) - a["a01"] * a["a01"]
        f00, f01, f10, f11 = p00 + h * p01, p01, p01 + h * p11, p11

        def result(g: Column) -> Column:
            w00, w01 = g["g00"] * a["a00"] + g["g01"] * a["a01"], g["g00"] * a["a01"] + g["g01"] * a["a11"]
            w10, w11 = g["g10"] * a["a00"] + g["g11"] * a["a01"], g["g10"] * a["a01"] + g["g11"] * a["a11"]
            return pack(
                g00=g["g00"], g01=g["g01"], g10=g["g10"], g11=g["g11"],
                u0=x0 - g["g00"] * (x0 + h * x1) - g["g01"] * x1, u1=x1 - g["g10"] * (x0 + h * x1) - g["g11"] * x1,
                v00=p00 - w00 * g["g00"] - w01 * g["g01"], v01=p01 - w00 * g["g10"] - w01 * g["g11"], v11=p11 - w10 * g["g10"] - w11 * g["g11"],
            )

        return let(let(det, lambda t: pack(
            g00=(f00 * (a["a11"] + m.jitter) - f01 * a["a01"]) / t, g01=(f01 * (a["a00"] + m.jitter) - f00 * a["a01"]) / t,
            g10=(f10 * (a["a11"] + m.jitter) - f11 * a["a01"]) / t, g11=(f11 * (a["a00"] + m.jitter) - f10 * a["a01"]) / t,
        )), result)

    ahead = pack(a00=p00 + 2 * h * p01 + h * h * p11 + n00, a01=p01 + h * p11 + n01, a11=p11 + n11)
    zero = F.lit(0.0)
    last = pack(g00=zero, g01=zero, g10=zero, g11=zero, u0=x0, u1=x1, v00=p00, v01=p01, v11=p11)
    return F.when(row["ndt"].isNull(), last).otherwise(let(ahead, gain))


def back_join(a: Column, b: Column) -> Column:
    """Element a of earlier rows with element b of the rows after them."""
    w00, w01 = a["g00"] * b["v00"] + a["g01"] * b["v01"], a["g00"] * b["v01"] + a["g01"] * b["v11"]
    w10, w11 = a["g10"] * b["v00"] + a["g11"] * b["v01"], a["g10"] * b["v01"] + a["g11"] * b["v11"]
    return pack(
        g00=a["g00"] * b["g00"] + a["g01"] * b["g10"], g01=a["g00"] * b["g01"] + a["g01"] * b["g11"],
        g10=a["g10"] * b["g00"] + a["g11"] * b["g10"], g11=a["g10"] * b["g01"] + a["g11"] * b["g11"],
        u0=a["g00"] * b["u0"] + a["g01"] * b["u1"] + a["u0"], u1=a["g10"] * b["u0"] + a["g11"] * b["u1"] + a["u1"],
        v00=w00 * a["g00"] + w01 * a["g01"] + a["v00"], v01=w00 * a["g10"] + w01 * a["g11"] + a["v01"], v11=w10 * a["g10"] + w11 * a["g11"] + a["v11"],
    )


def smooth_by_leaves(df: DataFrame, by: str, t: str, tie: str, z: str, r: str, model: Model, span) -> DataFrame:
    """`smooth` for series of any length."""
    rows = df.select(by, t, tie, c(z).cast("double").alias("z"), c(r).cast("double").alias("r"))
    line = Timeline(rows, [by], t, tie, span).neighbour({"_pt": t}).neighbour({"_nt": t, "nr": "r"}, offset=1).df
    day = 86400e6
    line = line.withColumns({"dt": (c(t) - c("_pt")) / day, "ndt": (c("_nt") - c(t)) / day, "_ch": F.floor(c(t) / F.lit(span)).cast("bigint")})
    place = F.row_number().over(Window.partitionBy(by, "_ch").orderBy(t, tie)) - 1
    line = line.withColumn("_pos", c("_ch") * SPAN_LEAVES + F.floor(place / LEAF).cast("bigint"))
    leaves = line.groupBy(by, "_ch", "_pos").agg(F.array_sort(F.collect_list(F.struct(t, tie, "z", "r", "dt", "ndt", "nr"))).alias("rows"))

    def folded(start: Column) -> Column:
        return F.aggregate("rows", start, lambda s, row: filter_step(model, s, row))

    nothing = F.when(F.lit(False), filter_step(model, F.lit(None).cast(ELEMENT), F.get("rows", F.lit(0))))
    leaves = cut(leaves.withColumn("el", folded(nothing)))
    before = prefixes(leaves.select(by, "_pos", "el"), [by], "_pos", "el", filter_join)
    kind = f"array<struct<{t}:{dict(df.dtypes)[t]},{tie}:{dict(df.dtypes)[tie]},ndt:double,nr:double,x0:double,x1:double,p00:double,p01:double,p11:double>>"

    def forward(s: Column, row: Column) -> Column:
        def with_state(e: Column) -> Column:
            done = F.struct(
                row[t].alias(t), row[tie].alias(tie), row["ndt"].alias("ndt"), row["nr"].alias("nr"),
                *[e[a].alias(b) for a, b in (("b0", "x0"), ("b1", "x1"), ("c00", "p00"), ("c01", "p01"), ("c11", "p11"))])
            return F.struct(e.alias("e"), F.concat(s["all"], F.array(done)).alias("all"))

        return let(filter_step(model, s["e"], row), with_state)

    start = F.struct(c("before").alias("e"), F.array().cast(kind).alias("all"))
    filtered = leaves.drop("el").join(before, [by, "_pos"]).select(by, "_pos", F.aggregate("rows", start, forward, lambda s: s["all"]).alias("rows"))
    back = F.reverse(F.transform("rows", lambda row: F.struct(row[t].alias(t), row[tie].alias(tie), back_element(model, row).alias("el"))))
    filtered = cut(filtered.select(by, (-c("_pos")).alias("_pos"), back.alias("rows")))
    whole = F.aggregate(F.slice("rows", F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0))), F.get("rows", F.lit(0))["el"], lambda a, x: back_join(x["el"], a))
    after = prefixes(filtered.select(by, "_pos", whole.alias("el")), [by], "_pos", "el", lambda a, x: back_join(x, a))
    kind = f"array<struct<{t}:{dict(df.dtypes)[t]},{tie}:{dict(df.dtypes)[tie]},smoothed:double,variance:double>>"

    def backward(s: Column, row: Column) -> Column:
        def with_state(e: Column) -> Column:
            done = F.struct(row[t].alias(t), row[tie].alias(tie), e["u0"].alias("smoothed"), e["v00"].alias("variance"))
            return F.struct(e.alias("e"), F.concat(s["all"], F.array(done)).alias("all"))

        return let(F.when(s["e"].isNull(), row["el"]).otherwise(back_join(row["el"], s["e"])), with_state)

    start = F.struct(c("before").alias("e"), F.array().cast(kind).alias("all"))
    out = filtered.join(after, [by, "_pos"]).select(by, F.explode(F.aggregate("rows", start, backward, lambda s: s["all"])).alias("_r"))
    return out.select(by, f"_r.{t}", f"_r.{tie}", "_r.smoothed", "_r.variance")


def forward_step(m: Model, s: Column, row: Column) -> Column:
    """State (position, rate and their covariance) after a row; the same arithmetic as `filter_step` from a known state."""

    def measured(p: Column) -> Column:
        gain = let(p["p00"] + m.noise(row["r"]), lambda v: pack(k0=p["p00"] / v, k1=p["p01"] / v, d=row["z"] - p["x0"]))
        return let(gain, lambda g: pack(
            x0=p["x0"] + g["k0"] * g["d"], x1=p["x1"] + g["k1"] * g["d"],
            p00=p["p00"] - g["k0"] * p["p00"], p01=p["p01"] - g["k0"] * p["p01"], p11=p["p11"] - g["k1"] * p["p01"],
        ))

    h = m.step(row["dt"])
    n00, n01, n11 = m.process(h, row["r"])
    ahead = pack(
        x0=s["x0"] + h * s["x1"], x1=s["x1"], p00=s["p00"] + 2 * h * s["p01"] + h * h * s["p11"] + n00, p01=s["p01"] + h * s["p11"] + n01, p11=s["p11"] + n11,
    )
    zero = F.lit(0.0)
    begin = pack(x0=row["z"], x1=zero, p00=m.start(row["r"]), p01=zero, p11=F.lit(1.0))
    return let(F.when(row["dt"].isNull(), begin).otherwise(ahead), measured)


def back_step(e: Column, s: Column) -> Column:
    """Smoothed state of a row from its `back_element` and the smoothed state of the row after it."""
    w00, w01 = e["g00"] * s["v00"] + e["g01"] * s["v01"], e["g00"] * s["v01"] + e["g01"] * s["v11"]
    w10, w11 = e["g10"] * s["v00"] + e["g11"] * s["v01"], e["g10"] * s["v01"] + e["g11"] * s["v11"]
    return pack(
        u0=e["g00"] * s["u0"] + e["g01"] * s["u1"] + e["u0"], u1=e["g10"] * s["u0"] + e["g11"] * s["u1"] + e["u1"],
        v00=w00 * e["g00"] + w01 * e["g01"] + e["v00"], v01=w00 * e["g10"] + w01 * e["g11"] + e["v01"], v11=w10 * e["g10"] + w11 * e["g11"] + e["v11"],
    )


def smooth_whole(df: DataFrame, by: str, t: str, tie: str, z: str, r: str, model: Model) -> DataFrame:
    """`smooth` for series of at most `WHOLE_LEAVES` leaves: the plain recursion on one array a series, with one shuffle."""
    order, kinds = Window.partitionBy(by).orderBy(t, tie), dict(df.dtypes)
    day = 86400e6
    rows = df.select(by, t, tie, c(z).cast("double").alias("z"), c(r).cast("double").alias("r"))
    rows = rows.withColumns({"dt": (c(t) - F.lag(t).over(order)) / day, "ndt": (F.lead(t).over(order) - c(t)) / day, "nr": F.lead("r").over(order)}).where(c(t).isNotNull())
    whole = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(t, tie, "z", "r", "dt", "ndt", "nr"))).alias("rows"))

    def scan(rows: Column, out: str, state: str, step: Callable[[Column, Column], Column], given: Callable[[Column, Column], Column]) -> Column:
        def grown(s: Column, row: Column) -> Column:
            return let(step(s["e"], row), lambda e: F.struct(e.alias("e"), F.concat(s["all"], F.array(given(row, e))).alias("all")))

        start = F.struct(F.lit(None).cast(state).alias("e"), F.array().cast(f"array<{out}>").alias("all"))
        return F.aggregate(rows, start, grown, lambda s: s["all"])

    place = f"{t}:{kinds[t]},{tie}:{kinds[tie]}"
    filtered = scan(
        c("rows"), f"struct<{place},ndt:double,nr:double,x0:double,x1:double,p00:double,p01:double,p11:double>", "struct<x0:double,x1:double,p00:double,p01:double,p11:double>",
        lambda e, row: forward_step(model, e, row),
        lambda row, e: F.struct(row[t].alias(t), row[tie].alias(tie), row["ndt"].alias("ndt"), row["nr"].alias("nr"), *[e[n].alias(n) for n in ("x0", "x1", "p00", "p01", "p11")]),
    )
    last = lambda el: pack(**{n: el[n] for n in ("u0", "u1", "v00", "v01", "v11")})
    smoothed = scan(
        F.reverse("rows"), f"struct<{place},smoothed:double,variance:double>", "struct<u0:double,u1:double,v00:double,v01:double,v11:double>",
        lambda e, row: let(back_element(model, row), lambda el: F.when(e.isNull(), last(el)).otherwise(back_step(el, e))),
        lambda row, e: F.struct(row[t].alias(t), row[tie].alias(tie), e["u0"].alias("smoothed"), e["v00"].alias("variance")),
    )
    out = whole.select(by, filtered.alias("rows")).select(by, F.explode(smoothed).alias("_r"))
    return out.select(by, f"_r.{t}", f"_r.{tie}", "_r.smoothed", "_r.variance")


def smooth(df: DataFrame, by: str, t: str, tie: str, z: str, r: str, model: Model, span, whole: int | None = None) -> DataFrame:
    """Rows (by, t, tie) with `smoothed` and `variance`; `t` is in microseconds, `span` the length of line that one task sorts.

    A series of at most `whole` rows (`WHOLE_LEAVES` leaves) is one array and one fold each way; longer ones are dealt to leaves. `df` is read
    twice, so let it be a checkpoint if it is costly.
    """
    short, long = by_length(df.where(c(by).isNotNull()), [by], WHOLE_LEAVES * LEAF if whole is None else whole)
    parts = [] if short is None else [smooth_whole(short, by, t, tie, z, r, model)]
    parts += [] if long is None else [smooth_by_leaves(long, by, t, tie, z, r, model, span)]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


ELEMENT = "struct<" + ",".join(f"{n}:double" for n in ("a00", "a01", "a10", "a11", "b0", "b1", "c00", "c01", "c11", "e0", "e1", "j00", "j01", "j11")) + ">"
