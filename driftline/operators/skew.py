"""Building blocks that stay balanced when one key holds a large share of the rows.

A plain window or `percentile` by key puts all rows of a key into one task. The helpers here shuffle on
(key, bucket) instead, where the bucket comes from the value or from time, and only bounded summaries meet per key.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

SALTS = 8
MANTISSA_BUCKETS = 16384.0
#: Summaries of at most this many rows (some 50 MB of a few numbers each) go to the rows as a broadcast.
BROADCAST_ROWS = 1_000_000
#: A key of at most this many rows may be sorted by one task (some 10 MB of a few numbers each).
IN_TASK = 100_000


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the session names; used between rounds of an iteration."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="driftline-cp-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def attach(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", salts: int = SALTS) -> DataFrame:
    """Join per-key summaries back to rows; the rows of one key spread over `salts` tasks.

    `small` has one row per key and is repeated once per salt. Without keys it is a single row and is broadcast.
    """
    if not keys:
        one = F.lit(1).alias("_one")
        return big.select("*", one).join(F.broadcast(small.select("*", one)), "_one", how).drop("_one")
    plain = [f.name for f in big.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def attach_small(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """`attach` for a summary that `cut` has made: it is counted, and up to `BROADCAST_ROWS` rows are broadcast, so the rows are not shuffled.

    Beyond that the rows meet it as in `attach`, and the result is a checkpoint, as the rounds of an iteration read it more than once.
    """
    if not keys or small.count() > BROADCAST_ROWS:
        return cut(attach(big, small, keys, how))
    return big.join(F.broadcast(small), keys, how)


def by_length(df: DataFrame, keys: list[str], most: int = IN_TASK) -> tuple[DataFrame | None, DataFrame | None]:
    """The rows of keys with at most `most` rows, and those of longer keys; None for a part that has no key."""
    seen = Observation()
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_len"))
    long = cut(sizes.observe(seen, F.count_if(F.col("_len") <= most).alias("short")).where(F.col("_len") > most))
    if long.isEmpty():
        return df, None
    if not seen.get["short"]:
        return None, df
    marked = attach_small(df, long, keys)
    return marked.where("_len IS NULL").drop("_len"), marked.where("_len IS NOT NULL").drop("_len")


def median_in_place(df: DataFrame, keys: list[str], value: Column, out: str) -> DataFrame:
    """Rows with the exact median `out` of their key; NULL and NaN values are ignored. Each key is sorted by one task, without a shuffle where
    the rows already lie by key."""
    whole = Window.partitionBy(*keys)
    ranked = df.withColumn("_v", F.when(~F.isnan(value), value + F.lit(0.0)))
    ranked = ranked.withColumn("_k", F.row_number().over(whole.orderBy(F.col("_v").asc_nulls_last())) - 1).withColumn("_n", F.count("_v").over(whole))
    pos = (F.col("_n") - 1) * F.lit(0.5)
    at = lambda r: F.max(F.when(F.col("_k") == r, F.col("_v"))).over(whole)
    met = ranked.withColumns({"_lo": at(F.floor(pos)), "_hi": at(F.ceil(pos))})
    return met.withColumn(out, F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (pos - F.floor(pos))).drop("_v", "_k", "_n", "_lo", "_hi")


def radix_bucket(v: Column, per_octave: int = int(MANTISSA_BUCKETS)) -> Column:
    """A bucket number that never decreases with the value: 16384 (or `per_octave`) buckets per power of two, either sign."""
    m = F.abs(v)
    e = F.greatest(F.floor(F.log2(F.greatest(m, F.lit(1e-300)))), F.lit(-990))
    step = F.floor((m / F.pow(F.lit(2.0), e.cast("double")) - 1.0) * float(per_octave))
    level = (e.cast("bigint") + 1000) * per_octave + step.cast("bigint")
    return F.when(m < 1e-290, F.lit(0).cast("bigint")).when(v < 0, -level).otherwise(level)


def order_statistics(df: DataFrame, keys: list[str], value, ranks: dict[str, Column]) -> DataFrame:
    """Exact values at 0-based ranks within each key, with `n` and `<name>_below` (rows strictly smaller).

    `ranks` are expressions of the column `n`. Rows are counted per value before anything else, with a map-side combine,
    so a repeated value is one row from there on. The running count per value bucket finds the bucket each rank falls
    in, and only the values of those buckets are ordered. NULL and NaN values are ignored.
    """
    gk = keys or ["_g"]
    v = F.col(value) if isinstance(value, str) else value
    # The explode of one element keeps a costly value expression from being copied into every use of it.
    base = df.select(*keys, F.explode(F.array(v.cast("double"))).alias("_v"))
    base = base.where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    if not keys:
        base = base.withColumn("_g", F.lit(1))
    base = base.withColumn("_v", F.col("_v") + F.lit(0.0))  # one zero, so that it is one value
    counts = base.groupBy(*gk, "_v").agg(F.count(F.lit(1)).alias("_c")).withColumn("_b", radix_bucket(F.col("_v")))
    hist = counts.groupBy(*gk, "_b").agg(F.sum("_c").alias("_c"))
    by_key = Window.partitionBy(*gk)
    upto = by_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    want = F.array(*[F.struct(F.lit(k).alias("k"), r.cast("bigint").alias("r")) for k, r in ranks.items()])
    targets = (
        hist.withColumn("_hi", F.sum("_c").over(upto))
        .withColumn("n", F.sum("_c").over(by_key))
        .withColumn("_lo", F.col("_hi") - F.col("_c"))
        .withColumn("_want", F.filter(want, lambda w: (w["r"] >= F.col("_lo")) & (w["r"] < F.col("_hi"))))
        .where(F.size("_want") > 0)
        .select(*gk, "_b", "_lo", "n", "_want")
    )
    inside = counts.join(targets, [*gk, "_b"])
    in_bucket = Window.partitionBy(*gk, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        inside.withColumn("_end", F.col("_lo") + F.sum("_c").over(in_bucket))
        .withColumn("_start", F.col("_end") - F.col("_c"))
        .withColumn(
            "_hit", F.explode(F.filter("_want", lambda w: (w["r"] >= F.col("_start")) & (w["r"] < F.col("_end"))))
        )
    )
    aggs = [F.max("n").alias("n")]
    for k in ranks:
        mine = F.col("_hit.k") == k
        aggs += [F.max(F.when(mine, F.col("_v"))).alias(k), F.max(F.when(mine, F.col("_start"))).alias(f"{k}_below")]
    out = placed.groupBy(*gk).agg(*aggs)
    return out if keys else out.drop("_g")


def small_or_cut(df: DataFrame) -> DataFrame:
    """A checkpoint, with a broadcast hint if it has at most `BROADCAST_ROWS` rows."""
    done = cut(df)
    return F.broadcast(done) if done.count() <= BROADCAST_ROWS else done


def counted_median(counts: DataFrame, keys: list[str], value: Column, weight: str, out: str, size: str | None = None) -> DataFrame:
    """Exact median per key of a value that stands for `weight` rows, and their number as `size`, as a checkpoint.

    `counts` is read twice (let it be a checkpoint) and not shuffled: only its bucket sums and the values of the buckets that hold the middle
    are. NULL and NaN values are ignored.
    """
    base = counts.select(*keys, weight, F.explode(F.array(value.cast("double"))).alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    base = base.withColumn("_v", F.col("_v") + F.lit(0.0)).withColumn("_b", radix_bucket(F.col("_v"), 1024))
    hist = base.groupBy(*keys, "_b").agg(F.sum(weight).alias("_c"))
    by_key = Window.partitionBy(*keys)
    upto = by_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    pos = (F.col("n") - 1) * F.lit(0.5)
    want = [F.floor(pos), F.ceil(pos)]
    hist = hist.withColumns({"_hi": F.sum("_c").over(upto), "n": F.sum("_c").over(by_key)}).withColumn("_before", F.col("_hi") - F.col("_c"))
    holds = lambda lo, hi: [(r >= lo) & (r < hi) for r in want]
    middle = hist.where(holds(F.col("_before"), F.col("_hi"))[0] | holds(F.col("_before"), F.col("_hi"))[1]).select(*keys, "_b", "_before", "n")
    inside = base.join(small_or_cut(middle), [*keys, "_b"]).groupBy(*keys, "_b", "_before", "n", "_v").agg(F.sum(weight).alias("_c"))
    in_bucket = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = inside.withColumn("_end", F.col("_before") + F.sum("_c").over(in_bucket)).withColumn("_start", F.col("_end") - F.col("_c"))
    lo, hi = [F.max(F.when(x, F.col("_v"))) for x in holds(F.col("_start"), F.col("_end"))]
    ends = placed.groupBy(*keys).agg(F.max("n").alias("n"), lo.alias("_lo"), hi.alias("_hi"))
    middle_value = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (pos - F.floor(pos))
    return cut(ends.select(*keys, middle_value.alias(out), *([F.col("n").alias(size)] if size else [])))


def group_quantiles(df: DataFrame, keys: list[str], value, probs: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles per key, with the count `n`."""
    ranks = {}
    for name, p in probs.items():
        pos = (F.col("n") - 1) * F.lit(float(p))
        ranks[f"{name}_lo"], ranks[f"{name}_hi"] = F.floor(pos), F.ceil(pos)
    stats = order_statistics(df, keys, value, ranks)
    cols = []
    for name, p in probs.items():
        pos = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"{name}_lo"), F.col(f"{name}_hi")
        cols.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(name))
    return stats.select(*keys, "n", *cols)


def group_median(df: DataFrame, keys: list[str], value, out: str) -> DataFrame:
    return group_quantiles(df, keys, value, {out: 0.5}).drop("n")


def group_mad(df: DataFrame, keys: list[str], value: str, centre: str, out: str, scale: float = 1.4826) -> DataFrame:
    """Rows with their group's median and scaled median absolute deviation."""
    rows = cut(attach(df, group_median(df, keys, value, centre), keys))
    mad = group_median(rows.withColumn("_dev", F.abs(F.col(value) - F.col(centre))), keys, "_dev", out)
    return attach(rows, mad.withColumn(out, F.col(out) * scale), keys)


def keep_largest(df: DataFrame, keys: list[str], value: str, tie: str, keep: Column) -> DataFrame:
    """All rows with a boolean `kept`: the `keep` (expression of n) largest by value, ties to the smallest `tie`.

    The rank-threshold value is found by `order_statistics`; only rows equal to it compete on the tie column, by the
    same method. No group is ever sorted in one task.
    """
    edge = order_statistics(
        df.withColumn("_neg", -F.col(value)), keys, "_neg", {"_thr": F.greatest(keep, F.lit(1)) - 1}
    ).select(*keys, (-F.col("_thr")).alias("_thr"), (F.greatest(keep, F.lit(1)) - F.col("_thr_below")).alias("_room"))
    rows = attach(df, edge, keys)
    equal = rows.where(F.col(value) == F.col("_thr"))
    gk = [*keys, "_room"]
    last = order_statistics(equal, gk, tie, {"_last": F.least(F.col("_room"), F.col("n")) - 1}).select(*keys, "_last")
    rows = attach(rows, last, keys)
    kept = (F.col(value) > F.col("_thr")) | ((F.col(value) == F.col("_thr")) & (F.col(tie) <= F.col("_last")))
    return rows.withColumn("kept", F.coalesce(kept, F.lit(False))).drop("_thr", "_room", "_last")


class Timeline:
    """Ordered operations per key on rows cut into fixed spans of the order column.

    Rows shuffle on (key, span). What crosses a span border (last row, running total, last known value) is one summary
    row per span, and only those summaries are ordered per key.
    """

    def __init__(self, df: DataFrame, by: list[str], t: str, tie: str, span):
        self.by, self.t, self.tie, self.span = by, t, tie, span
        self.df = df

    def _with(self, df: DataFrame) -> "Timeline":
        return Timeline(df, self.by, self.t, self.tie, self.span)

    def _cut_spans(self) -> DataFrame:
        return self.df.withColumn("_ch", F.floor(F.col(self.t) / F.lit(self.span)).cast("bigint"))

    @property
    def _order(self) -> Column:
        return F.struct(self.t, self.tie)

    def _rows(self):
        return Window.partitionBy(*self.by, "_ch").orderBy(self.t, self.tie)

    def _spans(self):
        return Window.partitionBy(*self.by).orderBy("_ch")

    def neighbour(self, cols: dict[str, str], offset: int = -1) -> "Timeline":
        """Columns of the previous (-1) or next (+1) row of the key, across span borders."""
        df = self._cut_spans()
        pack = F.struct(*[F.col(c).alias(o) for o, c in cols.items()])
        edge = F.max_by(pack, self._order) if offset < 0 else F.min_by(pack, self._order)
        shift = F.lag if offset < 0 else F.lead
        carry = df.groupBy(*self.by, "_ch").agg(edge.alias("_edge"))
        carry = carry.withColumn("_edge", shift("_edge", 1).over(self._spans()))
        out = df.join(carry, [*self.by, "_ch"]).withColumn(
            "_near", F.coalesce(shift(pack, 1).over(self._rows()), F.col("_edge"))
        )
        out = out.select(*self.df.columns, *[F.col(f"_near.{o}").alias(o) for o in cols])
        return self._with(out)

    def running_sum(self, cols: dict[str, str]) -> "Timeline":
        """Inclusive running sums; NULL counts as zero."""
        df = self._cut_spans()
        carry = df.groupBy(*self.by, "_ch").agg(
            *[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(f"_sum_{o}") for o, c in cols.items()]
        )
        before = self._spans().rowsBetween(Window.unboundedPreceding, -1)
        carry = carry.select(
            *self.by, "_ch", *[F.coalesce(F.sum(f"_sum_{o}").over(before), F.lit(0)).alias(f"_off_{o}") for o in cols]
        )
        upto = self._rows().rowsBetween(Window.unboundedPreceding, 0)
        out = df.join(carry, [*self.by, "_ch"]).select(
            *self.df.columns,
            *[
                (F.sum(F.coalesce(F.col(c), F.lit(0))).over(upto) + F.col(f"_off_{o}")).alias(o)
                for o, c in cols.items()
            ],
        )
        return self._with(out)

    def known(self, cols: dict[str, str], forward: bool = True) -> "Timeline":
        """Last non-NULL value at or before each row (forward), or first at or after it."""
        df = self._cut_spans()
        pick = F.max_by if forward else F.min_by
        aggs = [
            pick(F.col(c), F.when(F.col(c).isNotNull(), self._order)).alias(f"_e_{o}") for o, c in cols.items()
        ]
        carry = df.groupBy(*self.by, "_ch").agg(*aggs)
        if forward:
            spans = self._spans().rowsBetween(Window.unboundedPreceding, -1)
            rows = self._rows().rowsBetween(Window.unboundedPreceding, 0)
            edge = F.last
        else:
            spans = self._spans().rowsBetween(1, Window.unboundedFollowing)
            rows = self._rows().rowsBetween(0, Window.unboundedFollowing)
            edge = F.first
        carry = carry.select(
            *self.by, "_ch", *[edge(f"_e_{o}", ignorenulls=True).over(spans).alias(f"_k_{o}") for o in cols]
        )
        out = df.join(carry, [*self.by, "_ch"]).select(
            *self.df.columns,
            *[F.coalesce(edge(c, ignorenulls=True).over(rows), F.col(f"_k_{o}")).alias(o) for o, c in cols.items()],
        )
        return self._with(out)
