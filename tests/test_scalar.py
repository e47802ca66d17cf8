"""Scalar column helpers (F8s, F13s, F17s, F18s)."""

import math

from pyspark.sql import functions as F

from honorlens.functions.scalar import bubble_size, intensity_class, pct_label, sphere_xyz


def test_intensity_classes_and_bubble_size(spark):
    df = spark.createDataFrame([(0.6,), (0.5,), (0.21,), (0.2,), (0.06,), (0.05,), (0.0,)], "s double")
    got = [r[0] for r in df.select(intensity_class(F.col("s"))).collect()]
    assert got == ["high", "upper", "upper", "middle", "middle", "low", "low"]
    sizes = [r[0] for r in spark.createDataFrame([(0.0, 10.0), (5.0, 10.0), (10.0, 10.0)], "n double, m double")
             .select(bubble_size(F.col("n"), F.col("m"))).collect()]
    assert sizes == [6.0, 26.0, 46.0]


def test_sphere_coordinates_on_unit_sphere(spark):
    df = spark.createDataFrame([(0.0, 0.0), (90.0, 0.0), (45.0, -120.0)], "lat double, lon double")
    x, y, z = sphere_xyz(F.col("lat"), F.col("lon"))
    rows = df.select(x.alias("x"), y.alias("y"), z.alias("z")).collect()
    assert all(abs(math.sqrt(r.x ** 2 + r.y ** 2 + r.z ** 2) - 1) < 1e-12 for r in rows)
    assert abs(rows[0].x - 1) < 1e-12 and abs(rows[1].z - 1) < 1e-12


def test_pct_label_threshold(spark):
    df = spark.createDataFrame([(4.99,), (5.0,), (12.4,), (12.5,), (13.5,)], "v double")
    assert [r[0] for r in df.select(pct_label(F.col("v"))).collect()] == ["", "5%", "12%", "12%", "14%"]
