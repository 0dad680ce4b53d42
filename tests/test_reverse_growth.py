"""Reverse search where addresses are dense: few pairs, the same nearest."""

import math

from caminho.functions.geo import utm_inverse
from caminho.operators import spatial
from caminho.plans import reverse
from pyspark.sql import functions as F


def test_dense_and_far_addresses(spark, monkeypatch):
    """A grid of 40 by 40 addresses 20 m apart, one address 900 m off, points near each, a copy and one out of reach."""
    grid = [(f"a{i:02}{j:02}", 500_000.0 + 20 * i, 7_000_000.0 + 20 * j) for i in range(40) for j in range(40)] + [("far", 510_000.0, 7_000_000.0)]
    asked = [(k, 500_003.0 + 17.3 * k, 7_000_004.0 + 13.1 * k) for k in range(40)] * 2 + [(98, 510_900.0, 7_000_000.0), (99, 530_000.0, 7_000_000.0)]
    lat, lon = utm_inverse(F.col("x"), F.col("y"))
    degrees = lambda rows, kind: spark.createDataFrame(rows, kind).select("*", lat.alias("lat"), lon.alias("lon")).drop("x", "y")
    addresses = degrees(grid, "endereco_completo string, x double, y double")
    points = degrees(asked, "k int, x double, y double")
    made, within = [], spatial.within_radius
    monkeypatch.setattr(reverse, "within_radius", lambda *a: made.append(within(*a)) or made[-1])
    got = sorted((r.k, round(r.distancia, 3), r.endereco_completo) for r in reverse.reverse_geocode(points, addresses, 2000).collect())
    want = []
    for k, x, y in asked:
        d, a = min((round(math.hypot(x - p, y - q), 6), a) for a, p, q in grid)
        if d <= 2000:
            want.append((k, round(d, 3), a))
    assert [(k, a) for k, _, a in got] == [(k, a) for k, _, a in sorted(want)] and all(abs(g[1] - w[1]) < 0.01 for g, w in zip(got, sorted(want)))
    assert sum(m.count() for m in made) < 0.1 * 82 * len(grid)
