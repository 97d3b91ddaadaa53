"""Every registered query has a stable schema; a spread of them equals its SQL twin on the smallest data."""

import math

import duckdb
import pytest

from driftline.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = [
    "f05_sky_error_arcsec", "f30_pixel_to_lonlat", "a05_ensembles", "a09_reject_outliers", "j07_pairwise_spread", "j01_interpolate_table",
    "w01_unwrap", "w09_visible_windows", "m04_differential_series", "a23_campaign_summary", "x04_trimmed_mean", "x15_otsu_barycentre",
    "g04_suite_quality", "j11_header_metadata", "t01_lucky_frames", "k01_measurement_rows", "r02_last_seen", "a12_cluster_scores",
]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-6) or (math.isnan(a) and math.isnan(b))
    return a == b


def order(row):
    row = sorted(row, key=lambda v: isinstance(v, float))
    return [(v is None, 0 if v is None else round(v, 3) if isinstance(v, float) else v) for v in row]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(r[x] for x in cols) for r in df.collect()), key=order)
    rel = db.sql(catalog.ORACLES[name])
    idx = [list(rel.columns).index(x) for x in cols]
    want = sorted((tuple(r[i] for i in idx) for r in rel.fetchall()), key=order)
    assert len(got) == len(want)
    assert all(same(x, y) for p, q in zip(got, want) for x, y in zip(p, q))


def test_registry_is_large_and_named_alike():
    assert len(catalog.QUERIES) > 220
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
