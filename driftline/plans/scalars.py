"""Scalar functions F1-F39 over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftline.functions import angles as A
from driftline.functions import navigation as N
from driftline.functions import optics as O
from driftline.functions import parsing as P
from driftline.functions import planets as PL
from driftline.functions import priors as PR
from driftline.functions import timebase as T

from .registry import D, R, W, query


def out(df, keys, digits=6, **cols):
    return df.select(*keys, *[F.round(c, digits).alias(n) for n, c in cols.items()])


K = 1.0 - A.FLATTENING
RAD = "pi()/180.0"
c = F.col


@query("f01_wrap_deg", f"SELECT event_id, {R(W('value*37.0-900.0'), 'lon')} FROM events")
def _(t):
    return out(t.events, ["event_id"], lon=A.wrap_deg(c("value") * 37.0 - 900.0))


@query("f02_wrap_diff", f"SELECT ord, {R(D('lon', '(lat*9.0)'), 'd')} FROM d_series")
def _(t):
    return out(t.series, ["ord"], d=A.wrap_diff("lon", c("lat") * 9.0))


_RAD_KM = f"71492.0e0/sqrt(cos(radians(lat))^2 + (sin(radians(lat))/({K}))^2)"


@query("f03_spheroid_radius_km", f"SELECT ord, {R(_RAD_KM, 'r')} FROM d_series")
def _(t):
    return out(t.series, ["ord"], r=A.spheroid_radius_km("lat"))


_KLON = f"(({_RAD_KM})*cos(radians(lat))*{RAD})"
_U = f"(cos(radians(lat))^2 + (sin(radians(lat))/({K}))^2)"
_DU = f"(sin(2*radians(lat))*({1 / (K * K) - 1}))"
_KLAT = f"(71492.0e0*sqrt(0.25*pow({_U},-3)*pow({_DU},2) + 1.0/{_U})*{RAD})"


@query("f04_km_per_deg", f"SELECT ord, {R(_KLON, 'lon_km')}, {R(_KLAT, 'lat_km')} FROM d_series")
def _(t):
    return out(t.series, ["ord"], lon_km=A.km_per_deg_lon("lat"), lat_km=A.km_per_deg_lat("lat"))


def sky_sql(dlon, dlat, lat, au):
    """On-sky arcseconds in SQL text."""
    kl = _KLON.replace("lat", lat)
    kt = _KLAT.replace("lat", lat)
    s = f"/(({au})*149597870.7e0)*206264.80624709636e0"
    return f"CASE WHEN ({au})>0 THEN sqrt(pow(abs({dlon})*{kl}{s},2)+pow(abs({dlat})*{kt}{s},2)) END"


@query(
    "f05_sky_error_arcsec",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
 {R(sky_sql('dlon', 'dlat', '(-19.8+dlat)', 'CASE WHEN NOT ok THEN -1.0 ELSE distance_au END'), 'sky')}
FROM d_campaign""",
)
def _(t):
    au = F.when(~c("ok"), F.lit(-1.0)).otherwise(c("distance_au"))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return out(t.campaign, keys, sky=A.sky_error_arcsec("dlon", "dlat", -19.8 + c("dlat"), au))


@query(
    "f06_latitude_kinds",
    f"SELECT ord, {R(f'degrees(atan(tan(radians(lat))/({K * K})))', 'graphic')}, "
    f"{R(f'degrees(atan(tan(radians(lat))*({K * K})))', 'centric')} FROM d_series",
)
def _(t):
    return out(t.series, ["ord"], graphic=A.centric_to_graphic("lat"), centric=A.graphic_to_centric("lat"))


@query(
    "f07_timing_sigma",
    f"SELECT event_id, {R('abs(value-50)/60.0e0*870.536e0/1440.0e0', 'by_rate', 9)}, "
    f"{R('abs(value-50)*360.0e0/35729.711e0', 'by_period', 9)} FROM events",
)
def _(t):
    v = c("value") - 50.0
    return out(t.events, ["event_id"], 9, by_rate=A.timing_sigma_by_rate(v), by_period=A.timing_sigma_by_period(v))


_TIME_TEXT_SQL = """CASE o_orderkey%6 WHEN 0 THEN strftime(ts,'%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts,'%Y-%m-%dT%H:%M:%SZ')
 WHEN 2 THEN strftime(ts,'%Y/%m/%d %H:%M') WHEN 3 THEN strftime(ts,'%Y-%m-%d') WHEN 4 THEN 'not a time'
 ELSE strftime(ts,'%Y-%m-%dT%H:%M:%S')||'+02:00' END"""


def order_times(t):
    """Orders with a time of day and the same instant as text in rotating formats."""
    ts = F.timestamp_add("SECOND", c("o_orderkey") % 86400, c("o_orderdate"))
    k = c("o_orderkey") % 6
    f = lambda p: F.date_format("ts", p)
    text = (
        F.when(k == 0, f("yyyy-MM-dd HH:mm:ss")).when(k == 1, f("yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(k == 2, f("yyyy/MM/dd HH:mm")).when(k == 3, f("yyyy-MM-dd")).when(k == 4, F.lit("not a time"))
        .otherwise(F.concat(f("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")))
    )
    return t.orders.withColumn("ts", ts).withColumn("text", text)


_ORD_TS = "SELECT *, o_orderdate + to_seconds(o_orderkey%86400) AS ts FROM orders"


@query(
    "f08_parse_time",
    f"""SELECT o_orderkey, CASE o_orderkey%6 WHEN 0 THEN epoch_us(ts) WHEN 1 THEN epoch_us(ts)
 WHEN 2 THEN epoch_us(date_trunc('minute',ts)) WHEN 3 THEN epoch_us(date_trunc('day',ts)::TIMESTAMP)
 WHEN 4 THEN NULL ELSE epoch_us(ts)-7200000000 END AS t_us FROM ({_ORD_TS})""",
)
def _(t):
    return order_times(t).select("o_orderkey", P.parse_instant_us("text").alias("t_us"))


def leap_sql(ts="ts"):
    rows = ",".join(f"(TIMESTAMP '{d} 00:00:00',{s})" for d, s in T.LEAP_SECONDS)
    return (
        f"coalesce((SELECT max(tai) FROM (VALUES {rows}) lt(since,tai) WHERE since<={ts}),10)"
    )


_TT_SQL = f"(epoch_us(ts)/86400e6+40587.0e0+({leap_sql()}+32.184e0)/86400.0e0)"
_ORD_J = f"SELECT *, {_TT_SQL}-51544.5e0 AS d FROM ({_ORD_TS})"


@query("j06_leap_seconds", f"SELECT o_orderkey, {leap_sql()}::DOUBLE AS tai_utc FROM ({_ORD_TS})")
def _(t):
    return order_times(t).select("o_orderkey", T.tai_minus_utc("ts").alias("tai_utc"))


@query(
    "f09_prime_meridian",
    f"SELECT o_orderkey, {R('d', 'd')}, {R('67.1e0+877.9e0*d', 'w1', 5)}, {R('43.3e0+870.27e0*d', 'w2', 5)}, "
    f"{R('284.95e0+870.536e0*d', 'w3', 5)} FROM ({_ORD_J})",
)
def _(t):
    df = order_times(t)
    df = out(df, ["o_orderkey", "ts"], d=T.j2000_days("ts"))
    w = {f"w{i}": F.round(T.prime_meridian_deg("ts", s), 5) for i, s in enumerate(("I", "II", "III"), 1)}
    return df.withColumns(w).drop("ts")


_O2, _O1 = "(-241.65e0-0.266e0*d)", "(-217.85e0+7.364e0*d)"


@query(
    "f10_system_conversion",
    f"""SELECT o_orderkey, {R(_O2, 'off2', 5)}, {R(_O1, 'off1', 5)}, {R(W('o_totalprice/100.0e0+' + _O2), 'lon_ii', 5)},
 {R(W('o_totalprice/100.0e0-' + _O2), 'lon_iii', 5)}, {R(W('o_custkey+' + _O2), 'cm_ii', 5)},
 {R(W('o_custkey+' + _O1), 'cm_i', 5)} FROM ({_ORD_J})""",
)
def _(t):
    lon, cm = c("o_totalprice") / 100.0, c("o_custkey").cast("double")
    off1, off2 = T.system_offset_deg("ts", "I"), T.system_offset_deg("ts", "II")
    return out(
        order_times(t), ["o_orderkey"], 5, off2=off2, off1=off1, lon_ii=T.iii_to_ii(lon, "ts"),
        lon_iii=T.ii_to_iii(lon, "ts"), cm_ii=T.iii_to_ii(cm, "ts"), cm_i=A.wrap_deg(cm + off1),
    )


_G = "radians(357.53e0+35999.05e0*((tt-51544.5e0)/36525.0e0))"
_TDB = f"(tt+(0.001657e0*sin({_G})+0.000022e0*sin(2*{_G}))/86400.0e0)"
_ORD_TT = f"SELECT *, {_TT_SQL} AS tt FROM ({_ORD_TS})"


@query("f11_time_scales", f"SELECT o_orderkey, {R('tt', 'tt', 6)}, {R(_TDB, 'tdb', 6)} FROM ({_ORD_TT})")
def _(t):
    return out(order_times(t), ["o_orderkey"], 6, tt=T.tt_mjd("ts"), tdb=T.tdb_mjd(T.tt_mjd("ts")))


@query(
    "f12_geometry",
    f"""SELECT o_orderkey, {R('au', 'distance_au')}, {R('lt', 'light_time_s')},
 {R('t2-360.0e0*floor(t2/360.0e0)', 'cm_iii', 3)}, {R('degrees(2*71492.0e0/(au*149597870.7e0))*3600', 'diameter_arcsec')},
 {R('3.0e0*sin(2*pi()*(tdb-51544.5e0)/(11.86e0*365.25e0))', 'sub_lat')}
FROM (SELECT *, 360.0e0*(tdb-lt/86400.0e0-51544.5e0)/(35729.711e0/86400.0e0) AS t2
 FROM (SELECT *, au*149597870.7e0/299792.458e0 AS lt
  FROM (SELECT *, 5.2e0+0.6e0*cos(2*pi()*(tdb-51544.5e0)/398.88e0) AS au FROM
   (SELECT *, CASE WHEN o_orderstatus<>'F' THEN {_TDB} END AS tdb FROM ({_ORD_TT})))))""",
)
def _(t):
    ts = F.when(c("o_orderstatus") != "F", c("ts"))
    g = T.geometry(ts)
    return order_times(t).select(
        "o_orderkey", *[F.round(v, 3 if k == "cm_iii" else 6).alias(k) for k, v in g.items()]
    )


_DM = "(350.5e0+0.31e0*((t_us-1673568000000000)/86400e6))"
_MM = "(360.0e0*(t_us/86400e6+40587.0e0-51544.5e0)/(35729.711e0/86400.0e0))"


@query(
    "f13_drift_model",
    f"SELECT ord, {R(W(_DM), 'lon')}, {R(D(_DM, _MM), 'rel', 4)} FROM d_series",
)
def _(t):
    df = out(t.series, ["ord", "t_us"], lon=T.drift_model_lon("t_us"))
    return df.select("ord", "lon", F.round(T.drift_model_relative("t_us"), 4).alias("rel"))


def wind_sql(la, planet="Jupiter"):
    rows = PL.planet_row(planet)[5]
    out_ = f"WHEN {la}>={rows[-1][0]} THEN {rows[-1][1]}e0 "
    for (a, u), (b, v) in zip(rows, rows[1:]):
        out_ += f"WHEN {la}<{b} THEN {u}e0+({v - u}e0)*({la}-{a}e0)/{b - a}e0 "
    return f"(CASE {out_} END)"


WIND = wind_sql("abs(ap_lat)")
_CL = "greatest(cos(radians(ap_lat)),0.05e0)"
_K2 = 66854.0 / 71492.0
RATE_SQL = f"(360.0e0/35729.711e0+degrees({WIND}*1e-3/71492.0e0)/{_CL})"
PAR_SQL = f"(cos(radians(ap_lat))/sqrt(cos(radians(ap_lat))^2+(sin(radians(ap_lat))/{_K2}e0)^2))"


def with_planet(t, df, name="Jupiter"):
    """Planet constants as literals next to each row."""
    return PL.with_constants(df, name)


@query("f14_zonal_wind", f"SELECT track_ord, ap_id, ap_lat, {R(WIND, 'u')} FROM d_tracks")
def _(t):
    return out(with_planet(t, t.tracks), ["track_ord", "ap_id", "ap_lat"], u=PL.wind_at("ap_lat"))


@query(
    "f15_cloud_rate",
    f"SELECT track_ord, ap_id, ap_lat, {R(RATE_SQL, 'rate', 9)}, round(360.0e0/35729.711e0,9) AS bulk FROM d_tracks",
)
def _(t):
    df = with_planet(t, t.tracks).withColumn("u", PL.wind_at("ap_lat"))
    return out(df, ["track_ord", "ap_id", "ap_lat"], 9, rate=PL.cloud_rate("ap_lat", "u"), bulk=PL.rotation_rate())


@query(
    "f16_scale_and_drift",
    f"""SELECT track_ord, ap_id, ap_lat, dt_s, {R(f'pi()/180.0*{PAR_SQL}*120.0e0', 'ppd')},
 {R(f'{PAR_SQL}*71492000.0e0', 'par_m', 3)}, {R(f'-{RATE_SQL}*dt_s*pi()/180.0*{PAR_SQL}*120.0e0', 'drift_px')}
FROM d_tracks""",
)
def _(t):
    df = with_planet(t, t.tracks).withColumn("u", PL.wind_at("ap_lat"))
    df = df.withColumn("par_m", F.round(PL.parallel_radius_m("ap_lat"), 3))
    return out(
        df, ["track_ord", "ap_id", "ap_lat", "dt_s", "par_m"], ppd=PL.px_per_deg_lon("ap_lat", 120.0),
        drift_px=PL.drift_px("ap_lat", "dt_s", 120.0, "u"),
    )


@query(
    "f17_smear_spans",
    f"""SELECT track_ord, ap_id, ap_lat, dt_s, {R(f'abs({RATE_SQL}*dt_s*pi()/180.0*{PAR_SQL}*120.0e0)', 'smear')},
 {R(f'1.0e0/({RATE_SQL}*pi()/180.0*{PAR_SQL}*120.0e0)', 'raw_s')},
 {R(f'1.0e0/(degrees(30.0e0/({PAR_SQL}*71492000.0e0))*pi()/180.0*{PAR_SQL}*120.0e0)', 'derot_s')} FROM d_tracks""",
)
def _(t):
    df = with_planet(t, t.tracks).withColumn("u", PL.wind_at("ap_lat"))
    return out(
        df, ["track_ord", "ap_id", "ap_lat", "dt_s"], smear=F.abs(PL.drift_px("ap_lat", "dt_s", 120.0, "u")),
        raw_s=PL.max_span_raw_s("ap_lat", 120.0, 1.0, "u"), derot_s=PL.max_span_derotated_s("ap_lat", 120.0, 1.0),
    )


def _air_sql(lam):
    s2 = f"pow(1.0/({lam}*1e-3),2)"
    dry = f"(8342.13e0+2406030.0e0/(130.0e0-{s2})+15997.0e0/(38.9e0-{s2}))*1e-8"
    sat = ("CASE WHEN tc>=0 THEN 6.1121e0*exp((18.678e0-tc/234.5e0)*(tc/(257.14e0+tc))) "
           "ELSE 6.1115e0*exp((23.036e0-tc/333.7e0)*(tc/(279.82e0+tc))) END")
    return (f"({dry}*(p*100.0e0/101325.0e0)*(288.15e0/(273.15e0+tc))*(1+0.54e0*150e-6)"
            f"-rh*({sat})*(3.802e0-0.0384e0/{s2})*1e-10)")


_DISP = f"(({_air_sql('450.0e0')})-({_air_sql('650.0e0')}))*tan(radians(least(z,89.9e0)))*180.0/pi()*3600"
_ATM = """(SELECT l_orderkey,l_linenumber,l_partkey,l_suppkey, (l_quantity*1.9)::DOUBLE AS z, (l_linenumber*8.0-20.0)::DOUBLE AS tc,
 (950.0+l_partkey%100)::DOUBLE AS p, (l_tax*10.0)::DOUBLE AS rh FROM lineitem)"""


@query(
    "f18_air_dispersion",
    f"""SELECT l_orderkey,l_linenumber,l_partkey,l_suppkey, {R(_air_sql('550.0e0'), 'n1', 12)}, {R(_DISP, 'arcsec')},
 {R(f'({_DISP})/(45.0e0/240.0e0+1e-12)', 'px')},
 {R('degrees(1e-8*(8342.54e0+2406147.0e0/(130.0e0-pow(1/0.55e0,2))+15998.0e0/(38.9e0-pow(1/0.55e0,2)))*(p/1013.25e0)*(288.15e0/(tc+273.15e0))*tan(radians(least(z,89.0e0))))*3600', 'refr')}
FROM {_ATM}""",
)
def _(t):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    df = t.lineitem.select(
        *keys, (c("l_quantity") * 1.9).alias("z"), (c("l_linenumber") * 8.0 - 20.0).alias("tc"),
        (950.0 + c("l_partkey") % 100).alias("p"), (c("l_tax") * 10.0).alias("rh"),
    )
    arc = O.dispersion_arcsec("z", 450.0, 650.0, "p", "tc", "rh")
    df = df.withColumn("n1", F.round(O.air_index(550.0, "p", "tc", "rh"), 12))
    return out(
        df, [*keys, "n1"], arcsec=arc, px=O.dispersion_px(arc, 120.0, 45.0),
        refr=O.simple_refraction_arcsec("z", "p", "tc", 0.55),
    )


@query(
    "f19_limb_law",
    f"SELECT event_id, {R('1-0.6e0*x-0.2e0*x*x', 'i')} FROM (SELECT event_id, 1-least(greatest(value/60.0e0,0),1) AS x FROM events)",
)
def _(t):
    return out(t.events, ["event_id"], i=O.limb_law(c("value") / 60.0))


_SEX = """(SELECT p_partkey, p_partkey%4 AS k, (p_partkey%24)::INTEGER AS h, (p_size%60)::INTEGER AS m, ((p_partkey*7)%60)::DOUBLE AS s FROM part)"""


@query(
    "f20_angle_text",
    f"""SELECT p_partkey, {R("CASE k WHEN 0 THEN (h+m/60.0e0+s/3600.0e0) WHEN 1 THEN -(h+m/60.0e0+s/3600.0e0) WHEN 2 THEN h+m/100.0e0 END", 'deg')},
 {R("CASE k WHEN 0 THEN 15*(h+m/60.0e0+s/3600.0e0) WHEN 1 THEN -15*(h+m/60.0e0+s/3600.0e0) WHEN 2 THEN h+m/100.0e0 END", 'ra_deg')} FROM {_SEX}""",
)
def _(t):
    h, m, s = c("p_partkey") % 24, c("p_size") % 60, (c("p_partkey") * 7) % 60
    k = c("p_partkey") % 4
    txt = (
        F.when(k == 0, F.format_string("%02d:%02d:%02d", h, m, s)).when(k == 1, F.format_string("-%d %d %d.0", h, m, s))
        .when(k == 2, F.format_string("'%d.%02d'", h, m)).otherwise(F.lit("n/a"))
    )
    return out(t.part.withColumn("txt", txt), ["p_partkey"], deg=P.angle_deg("txt"), ra_deg=P.angle_deg("txt", True))


@query(
    "f21_aperture",
    f"""SELECT p_partkey, {R('''CASE p_partkey%6 WHEN 0 THEN v/1000 WHEN 1 THEN v/100 WHEN 2 THEN v*0.0254e0 WHEN 3 THEN v*0.3048e0
 WHEN 4 THEN CASE WHEN v>40 THEN v/1000 ELSE v END END''', 'm')} FROM (SELECT p_partkey, (p_size*1.5)::DOUBLE AS v FROM part)""",
)
def _(t):
    unit = F.element_at(F.array(*[F.lit(u) for u in (" mm", "CM", " in", "ft", "", "-")]), (c("p_partkey") % 6 + 1).cast("int"))
    txt = F.when(c("p_partkey") % 6 == 5, F.lit("unknown")).otherwise(
        F.concat(F.replace(F.format_string("%.1f", c("p_size") * 1.5), F.lit("."), F.lit(",")), unit)
    )
    return out(t.part.withColumn("txt", txt), ["p_partkey"], m=P.aperture_m("txt"))


@query(
    "f22_plate_scale",
    f"""SELECT p_partkey, {R('CASE WHEN p>0.1 AND p<1000 AND f>1 AND f<100000 THEN 206264.80624709636e0*p/(f*1000) END', 's')}
FROM (SELECT p_partkey, (p_size*0.1-0.25)::DOUBLE AS p, (p_retailprice*2)::DOUBLE AS f FROM part)""",
)
def _(t):
    return out(t.part, ["p_partkey"], s=O.plate_scale(c("p_size") * 0.1 - 0.25, c("p_retailprice") * 2.0))


@query(
    "f23_ticks",
    """SELECT ord, CASE WHEN ord%50<>0 THEN t_us END AS t_us, t_us*10+621355968000000000 AS ticks FROM d_series""",
)
def _(t):
    ticks = F.when(c("ord") % 50 == 0, F.lit(0)).otherwise(T.us_to_ticks("t_us") + 3)
    return t.series.select("ord", T.ticks_to_us(ticks).alias("t_us"), T.us_to_ticks("t_us").alias("ticks"))


_NAMES = """(SELECT *, CASE o_orderkey%7 WHEN 0 THEN strftime(ts,'%Y-%m-%d-%H%M_x') WHEN 1 THEN strftime(ts,'%Y-%m-%d-%H-%M-%S_x')
 WHEN 2 THEN strftime(ts,'%Y-%m-%d-%H-%M_x') WHEN 3 THEN strftime(ts,'%Y%m%dT%H%M%S_x') WHEN 4 THEN strftime(ts,'%Y%m%d_%H%M_x')
 WHEN 5 THEN strftime(ts,'%Y_%m_%d_%H%M') ELSE 'stack_'||o_orderkey END AS name FROM (""" + _ORD_TS + "))"


@query(
    "f24_time_from_name",
    f"""SELECT o_orderkey, name, CASE WHEN year(ts)<2000 THEN NULL WHEN o_orderkey%7 IN (1,3) THEN epoch_us(ts) WHEN o_orderkey%7=6 THEN NULL
 ELSE epoch_us(date_trunc('minute',ts)) END AS t_us FROM {_NAMES}""",
)
def _(t):
    k = c("o_orderkey") % 7
    f = lambda p: F.date_format("ts", p)
    name = (
        F.when(k == 0, f("yyyy-MM-dd-HHmm'_x'")).when(k == 1, f("yyyy-MM-dd-HH-mm-ss'_x'"))
        .when(k == 2, f("yyyy-MM-dd-HH-mm'_x'")).when(k == 3, f("yyyyMMdd'T'HHmmss'_x'"))
        .when(k == 4, f("yyyyMMdd'_'HHmm'_x'")).when(k == 5, f("yyyy'_'MM'_'dd'_'HHmm"))
        .otherwise(F.concat(F.lit("stack_"), c("o_orderkey").cast("string")))
    )
    df = order_times(t).withColumn("name", name)
    return df.select("o_orderkey", "name", P.instant_from_name_us("name").alias("t_us"))


@query(
    "f25_filter_from_name",
    """SELECT p_partkey, CASE WHEN contains(n,'742') THEN 'IR742' WHEN contains(n,'685') THEN 'IR685'
 WHEN contains(n,'ch4') OR contains(n,'890') OR contains(n,'methane') THEN 'CH4'
 WHEN contains(n,'_r_') OR contains(n,'-r-') OR contains(n,'red') OR contains(n,'filter_r') THEN 'R'
 WHEN contains(n,'_g_') OR contains(n,'-g-') OR contains(n,'green') OR contains(n,'filter_g') THEN 'G'
 WHEN contains(n,'_b_') OR contains(n,'-b-') OR contains(n,'blue') OR contains(n,'filter_b') THEN 'B'
 WHEN contains(n,'rgb') OR contains(n,'colour') OR contains(n,'color') THEN 'RGB' ELSE 'UNKNOWN' END AS filter
FROM (SELECT p_partkey, lower(p_name||'_'||p_partkey) AS n FROM part)""",
)
def _(t):
    name = F.concat_ws("_", "p_name", c("p_partkey").cast("string"))
    return t.part.select("p_partkey", P.filter_from_name(name).alias("filter"))


@query(
    "f26_trusted_source",
    """SELECT event_id, s, CASE WHEN s IN ('analytical','unknown','spice_auto_distance_only') OR s IS NULL THEN false
 ELSE true END AS trusted FROM (SELECT event_id, CASE event_id%6 WHEN 0 THEN 'analytical' WHEN 1 THEN 'SPICE_kernel'
 WHEN 2 THEN 'jpl_horizons_v2' WHEN 3 THEN 'unknown' WHEN 4 THEN 'spice_auto_distance_only' END AS s FROM events)""",
)
def _(t):
    k = c("event_id") % 6
    s = (
        F.when(k == 0, F.lit("analytical")).when(k == 1, F.lit("SPICE_kernel")).when(k == 2, F.lit("jpl_horizons_v2"))
        .when(k == 3, F.lit("unknown")).when(k == 4, F.lit("spice_auto_distance_only"))
    )
    return t.events.select("event_id", s.alias("s")).withColumn("trusted", PR.trusted_source("s"))


# The given event types stand for families and methods here.
FAMILY_DEMO = {"click": 1.15, "view": 1.05, "error": 0.4}
METHOD_DEMO = {"click_0": 1.4, "view_1": 1.2, "signup_2": 0.5, "error_3": 0.15}


def demo_priors(t):
    return (
        PR.prior_table(t.spark, FAMILY_DEMO, "family", "family_prior"),
        PR.prior_table(t.spark, METHOD_DEMO, "method_id", "method_prior"),
    )


def prior_sql(families=None, methods=None):
    fam = " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in (families or FAMILY_DEMO).items())
    met = " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in (methods or METHOD_DEMO).items())
    return f"greatest(weight*(CASE family {fam} ELSE 0.9e0 END)*(CASE method_id {met} ELSE 1.0e0 END),1e-6)"


# Every hit gets a name of the real tables, or one that they don't have.
FAMILY_NAMES, METHOD_NAMES = [*PR.FAMILY_PRIOR, "other"], [*PR.METHOD_PRIOR, "OTHER"]
_NAMED = f"""(SELECT ord, weight, {FAMILY_NAMES}[ord%{len(FAMILY_NAMES)}+1] AS family, {METHOD_NAMES}[ord%{len(METHOD_NAMES)}+1] AS method_id FROM d_hits)"""
_REAL_PRIOR = prior_sql(PR.FAMILY_PRIOR, PR.METHOD_PRIOR)


def with_real_priors(t):
    name = lambda names: F.element_at(F.array(*[F.lit(x) for x in names]), (c("ord") % len(names) + 1).cast("int"))
    rows = t.hits.select("ord", "weight", name(FAMILY_NAMES).alias("family"), name(METHOD_NAMES).alias("method_id"))
    tables = PR.prior_table(t.spark, PR.FAMILY_PRIOR, "family", "family_prior"), PR.prior_table(t.spark, PR.METHOD_PRIOR, "method_id", "method_prior")
    return PR.with_prior_weight(rows, *tables, out="w")


@query("f27_prior_weight", f"SELECT ord, method_id, {R(_REAL_PRIOR, 'w')} FROM {_NAMED}")
def _(t):
    return out(with_real_priors(t), ["ord", "method_id"], w=c("w"))


@query(
    "j03_prior_join",
    f"""SELECT family, count(*) AS n, {R(f'sum({_REAL_PRIOR})', 'w_sum', 4)}, count(*) FILTER (WHERE method_id<>'OTHER') AS n_matched FROM {_NAMED} GROUP BY family""",
)
def _(t):
    return with_real_priors(t).groupBy("family").agg(
        F.count("*").alias("n"), F.round(F.sum("w"), 4).alias("w_sum"), F.count_if(c("method_id") != "OTHER").alias("n_matched"))


@query(
    "f28_centre_and_edge_rules",
    f"""SELECT event_id, NOT (m IN ('EDGE_W','MIN_PIX') OR (fam='edge' AND m NOT IN ('OVAL'))) AS centre,
 abs(abs({D('value*3.7', 'event_id%360')})-90)<2.5 AS edge_lock, abs({D('value*3.7', 'event_id%360')})<20 AS near
FROM (SELECT *, CASE event_id%5 WHEN 0 THEN 'EDGE_W' WHEN 1 THEN 'MIN_PIX' WHEN 2 THEN 'OVAL' WHEN 3 THEN 'OTSU' ELSE 'SOBEL_RING' END AS m,
 CASE WHEN event_id%2=0 THEN 'edge' ELSE 'map' END AS fam FROM events)""",
)
def _(t):
    names = F.array(*[F.lit(x) for x in ("EDGE_W", "MIN_PIX", "OVAL", "OTSU", "SOBEL_RING")])
    m = F.element_at(names, (c("event_id") % 5 + 1).cast("int"))
    fam = F.when(c("event_id") % 2 == 0, F.lit("edge")).otherwise(F.lit("map"))
    lon, cm = c("value") * 3.7, c("event_id") % 360
    df = t.events.withColumns({"m": m, "fam": fam})
    return df.select(
        "event_id", PR.centre_method("m", "fam").alias("centre"), PR.map_edge_lock(lon, cm).alias("edge_lock"),
        PR.near_pipeline(lon, cm).alias("near"),
    )


@query(
    "f29_map_to_lonlat",
    f"SELECT event_id, {R(W('event_id%360 + least(greatest(-90.0e0+(value*3)/359*180,-90),90)'), 'lon')}, "
    f"{R('90.0e0-(event_id%180)*180.0e0/179', 'lat')} FROM events",
)
def _(t):
    lon, lat = N.map_to_lonlat(c("value") * 3.0, c("event_id") % 180, 360, 180, c("event_id") % 360, 90.0, -90.0)
    return out(t.events, ["event_id"], lon=lon, lat=lat)


def p2l_sql(src, x, y, xc, yc, a, cm, sub, pa):
    """SQL stages of the pixel inversion; yields lon, lat, on_disk next to the source columns."""
    q = 1 / (K * K)
    return f"""(SELECT *, {W(f'{cm}+degrees(atan2(vx,bz))')} AS lon,
 degrees(asin(least(greatest(by_/(sqrt(vx*vx+by_*by_+bz*bz)+1e-15),-1),1))) AS lat FROM (
 SELECT *, vy*cd+dep*sd AS by_, -vy*sd+dep*cd AS bz FROM (
 SELECT *, (-b2+sqrt(greatest(b2*b2-4*qa*(vx*vx+vy*vy*(cd*cd*{q}e0+sd*sd)-1),0)))/(2*qa) AS dep FROM (
 SELECT *, 2*vy*sd*cd*({q}e0-1) AS b2 FROM (
 SELECT *, px*shr AS vx, py*shr AS vy FROM (
 SELECT *, CASE WHEN on_disk THEN 1.0e0 ELSE 0.999999e0/greatest(sqrt(px*px+py*py),1e-12) END AS shr FROM (
 SELECT *, pow(2*py*sd*cd*({q}e0-1),2)-4*qa*(px*px+py*py*(cd*cd*{q}e0+sd*sd)-1) >= 0 AS on_disk FROM (
 SELECT *, cd*cd+sd*sd*{q}e0 AS qa, ux*cos(radians({pa}))+uy*sin(radians({pa})) AS px,
  -ux*sin(radians({pa}))+uy*cos(radians({pa})) AS py FROM (
 SELECT *, ({x}-{xc})/({a}+1e-12) AS ux, ({yc}-{y})/({a}+1e-12) AS uy, cos(radians({sub})) AS cd, sin(radians({sub})) AS sd
 FROM {src})))))))))"""


@query(
    "f30_pixel_to_lonlat",
    f"""SELECT capture_id, frame_idx, y, x, on_disk, {R('lon', 'lon', 5)}, {R('lat', 'lat', 5)}
FROM {p2l_sql('d_pixels', 'x', 'y', '3.45e0', '3.55e0', '4.1e0', '(capture_id*30)', '(capture_id%7-3)', '(capture_id*2)')}""",
)
def _(t):
    cap = c("capture_id")
    lon, lat, on = N.pixel_to_lonlat("x", "y", 3.45, 3.55, 4.1, cap * 30, cap % 7 - 3, cap * 2)
    df = t.pixels.withColumn("on_disk", on)
    return out(df, ["capture_id", "frame_idx", "y", "x", "on_disk"], 5, lon=lon, lat=lat)


_RPHI = f"(1.0/sqrt(cos(radians(lat))^2+(sin(radians(lat))/({K}))^2))"
_XYZ = f"""(SELECT *, {_RPHI}*cos(radians(lat))*sin(radians(lon)) AS bx, {_RPHI}*sin(radians(lat)) AS by_,
 {_RPHI}*cos(radians(lat))*cos(radians(lon)) AS bz, radians((ord%7-3)::DOUBLE) AS d, radians((ord%40)::DOUBLE) AS pa FROM d_series)"""


@query(
    "f31_lonlat_to_pixel",
    f"""SELECT ord, {R('200+(bx*cos(pa)-ty*sin(pa))*150', 'x')}, {R('190-(bx*sin(pa)+ty*cos(pa))*150', 'y')}, {R('tz', 'z')}
FROM (SELECT *, by_*cos(d)-bz*sin(d) AS ty, by_*sin(d)+bz*cos(d) AS tz FROM {_XYZ})""",
)
def _(t):
    x, y, z = N.lonlat_to_pixel("lon", "lat", 200.0, 190.0, 150.0, c("ord") % 7 - 3, c("ord") % 40)
    return out(t.series, ["ord"], x=x, y=y, z=z)


@query(
    "f32_lock_confidence",
    f"SELECT event_id, {R('CASE WHEN value-10<=0 THEN 0 ELSE least(ln(1+value-10)/ln(21.0e0),1) END', 'q')} FROM events",
)
def _(t):
    return out(t.events, ["event_id"], q=O.lock_confidence(c("value") - 10.0))


@query("f33_structure_function", f"SELECT event_id, {R('6.88e0*pow(value/12.5e0,5.0e0/3)', 'd', 5)} FROM events")
def _(t):
    return out(t.events, ["event_id"], 5, d=O.structure_function("value", 12.5))


@query(
    "f34_diffraction_floor",
    f"SELECT p_partkey, {R('206265.0e0*(400+p_partkey%400)*1e-9/greatest(p_size*0.0137e0,0.05e0)', 'a', 4)} FROM part",
)
def _(t):
    return out(t.part, ["p_partkey"], 4, a=O.diffraction_floor_arcsec(400.0 + c("p_partkey") % 400, c("p_size") * 0.0137))


# A frame is a colour mosaic here: each 2 x 2 cell of the 8 x 8 values holds red, two greens (their mean counts) and blue.
RGB_SQL = """(SELECT capture_id, frame_idx, pos, data[k] AS r, (data[k+1]+data[k+8])/2 AS g, data[k+9] AS b FROM (
 SELECT capture_id, frame_idx, data, pos, 16*(pos//4)+2*(pos%4)+1 AS k FROM d_frames, (SELECT unnest(range(16)) AS pos)))"""


def mosaic_planes(data: str) -> dict:
    """Red, green and blue planes of 4 x 4 cells."""
    cells = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.floor(i / 4).cast("int") * 16 + i % 4 * 2 + 1)
    at = lambda k: F.element_at(c(data), k)
    return {
        "r": F.transform(cells, lambda k: at(k)),
        "g": F.transform(cells, lambda k: (at(k + 1) + at(k + 8)) / 2.0),
        "b": F.transform(cells, lambda k: at(k + 9)),
    }


def rgb_pixels(t):
    zipped = F.arrays_zip(*[p.alias(k) for k, p in mosaic_planes("data").items()])
    return t.frames.select("capture_id", "frame_idx", F.posexplode(zipped).alias("pos", "p")).select(
        "capture_id", "frame_idx", "pos", c("p.r").alias("r"), c("p.g").alias("g"), c("p.b").alias("b")
    )


@query(
    "f35_luma_and_colour",
    f"""SELECT capture_id, frame_idx, pos::INTEGER AS pos, {R('0.299e0*r+0.587e0*g+0.114e0*b', 'luma')}, {R('greatest(r-b,0)', 'rb')},
 {R('greatest(r-g,0)*greatest(r-b,0)', 'orange')},
 {R('greatest(r-g,0)*greatest(r-b,0)*(0.4e0+greatest(r-0.5e0*(g+b),0))', 'score')} FROM {RGB_SQL}""",
)
def _(t):
    return out(
        rgb_pixels(t), ["capture_id", "frame_idx", "pos"], luma=O.luma("r", "g", "b"), rb=O.red_excess("r", "b"),
        orange=O.orange_product("r", "g", "b"), score=O.orange_score("r", "g", "b"),
    )


@query(
    "f36_mid_exposure",
    f"""SELECT o_orderkey, CASE o_orderkey%5 WHEN 0 THEN epoch_us(ts) WHEN 1 THEN epoch_us(ts)+500000*(o_custkey%100)
 WHEN 2 THEN epoch_us(ts)+500000*(o_custkey%100) WHEN 3 THEN epoch_us(o_orderdate) END AS t_us FROM ({_ORD_TS})""",
)
def _(t):
    k = c("o_orderkey") % 5
    exp = (c("o_custkey") % 100).cast("string")
    f = lambda p: F.date_format("ts", p)
    s = lambda x: F.lit(x)
    mjd = F.datediff(c("o_orderdate").cast("date"), F.lit("1858-11-17").cast("date")).cast("string")
    header = (
        F.when(k == 0, F.create_map(s("DATE-AVG"), f("yyyy-MM-dd'T'HH:mm:ss"), s("EXPTIME"), exp))
        .when(k == 1, F.create_map(s("DATE-OBS"), f("yyyy-MM-dd HH:mm:ss"), s("EXPOSURE"), exp))
        .when(k == 2, F.create_map(s("DATE-OBS"), f("dd/MM/yyyy"), s("DATE"), f("yyyy-MM-dd HH:mm:ss"), s("TELAPSE"), exp))
        .when(k == 3, F.create_map(s("MJD-OBS"), mjd)).otherwise(F.create_map(s("OBJECT"), s("x")))
    )
    df = order_times(t).withColumn("h", header)
    return df.select("o_orderkey", P.mid_exposure_us("h").alias("t_us"))


@query(
    "f37_observation_time",
    f"""SELECT o_orderkey, CASE WHEN f IS NULL OR (u//86400000000=f//86400000000 AND abs(u-f)<=120000000) THEN u ELSE f END AS t_us,
 CASE WHEN coalesce(f,u) IS NULL THEN 'none' WHEN f IS NULL OR (u//86400000000=f//86400000000 AND abs(u-f)<=120000000) THEN 'user'
 ELSE 'file' END AS source
FROM (SELECT o_orderkey, CASE WHEN o_orderkey%5<>0 THEN epoch_us(ts) END AS f, CASE WHEN o_orderkey%7<>0 THEN
 epoch_us(ts)+1000000*((o_custkey*37)%400-200) END AS u FROM ({_ORD_TS}))""",
)
def _(t):
    base = T.epoch_us("ts")
    df = order_times(t).withColumns({
        "f": F.when(c("o_orderkey") % 5 != 0, base),
        "u": F.when(c("o_orderkey") % 7 != 0, base + 1000000 * ((c("o_custkey") * 37) % 400 - 200)),
    })
    return df.select(
        "o_orderkey", P.observation_time_us("u", "f").alias("t_us"), P.observation_time_source("u", "f").alias("source")
    )


@query(
    "f38_emission_cosine",
    f"""SELECT ord, {R(f'least(greatest((ny*sin(d)+bz*cos(d))/(sqrt(bx*bx+ny*ny+bz*bz)+1e-12),0),1)', 'mu')}
FROM (SELECT *, by_/({K * K}e0) AS ny FROM {_XYZ})""",
)
def _(t):
    return out(t.series, ["ord"], mu=N.emission_cosine("lon", "lat", c("ord") % 7 - 3))


@query(
    "f39_ycbcr",
    f"""SELECT capture_id, frame_idx, pos::INTEGER AS pos, {R('y', 'y')}, {R('cb', 'cb')}, {R('cr', 'cr')},
 {R('least(greatest(y+1.402e0*(cr-0.5e0),0),1)', 'r2')},
 {R('least(greatest(y-0.344136e0*(cb-0.5e0)-0.714136e0*(cr-0.5e0),0),1)', 'g2')},
 {R('least(greatest(y+1.772e0*(cb-0.5e0),0),1)', 'b2')} FROM (SELECT *, 0.299e0*r+0.587e0*g+0.114e0*b AS y,
 -0.168736e0*r-0.331264e0*g+0.5e0*b+0.5e0 AS cb, 0.5e0*r-0.418688e0*g-0.081312e0*b+0.5e0 AS cr FROM {RGB_SQL})""",
)
def _(t):
    y, cb, cr = O.to_ycbcr("r", "g", "b")
    df = rgb_pixels(t).withColumns({"y0": y, "cb0": cb, "cr0": cr})
    r2, g2, b2 = O.from_ycbcr("y0", "cb0", "cr0")
    return out(df, ["capture_id", "frame_idx", "pos"], y=c("y0"), cb=c("cb0"), cr=c("cr0"), r2=r2, g2=g2, b2=b2)
