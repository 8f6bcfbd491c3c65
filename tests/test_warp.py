"""Warps against loops over cells: shifted, rotated into another zone, and of any ratio."""

import math

import numpy as np
import pytest

from tilewright.functions import geo
from tilewright.operators import warp

GRID = "tile_id string, epsg int, left double, top double, x_resolution double, y_resolution double, width int, height int"
PIXELS = "tile_id string, row int, col int, valid boolean, value double"


def slow_from_utm(x, y, epsg):
    """Latitude and longitude by Newton steps on the meridian arc and Redfearn's series, another way than the library's."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    m = (y - (0 if epsg < 32700 else 1e7)) / k0
    phi = m / (a * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256))

    def arc(p):
        steps = np.linspace(0, p, 401)
        w = a * (1 - e2) / (1 - e2 * np.sin(steps) ** 2) ** 1.5
        h = p / 400
        return h / 3 * (w[0] + w[-1] + 4 * w[1:-1:2].sum() + 2 * w[2:-2:2].sum())

    for _ in range(6):
        phi += (m - arc(phi)) / (a * (1 - e2) / (1 - e2 * math.sin(phi) ** 2) ** 1.5)
    ep2, t, c = e2 / (1 - e2), math.tan(phi) ** 2, e2 / (1 - e2) * math.cos(phi) ** 2
    n = a / math.sqrt(1 - e2 * math.sin(phi) ** 2)
    r = a * (1 - e2) / (1 - e2 * math.sin(phi) ** 2) ** 1.5
    d = (x - 500_000) / (n * k0)
    lat = phi - n * math.tan(phi) / r * (d**2 / 2 - (5 + 3 * t + 10 * c - 4 * c**2 - 9 * ep2) * d**4 / 24 + (61 + 90 * t + 298 * c + 45 * t**2 - 252 * ep2 - 3 * c**2) * d**6 / 720)
    lon = (d - (1 + 2 * t + c) * d**3 / 6 + (5 - 2 * c + 28 * t - 3 * c**2 + 8 * ep2 + 24 * t**2) * d**5 / 120) / math.cos(phi)
    return math.degrees(lat), math.degrees(lon) + epsg % 100 * 6 - 183


def test_projection_there_and_back_and_another_way(spark):
    """A published position, another series, and the way back to two millimetres."""
    # A worked example that a common conversion library publishes; another series for the rest.
    places = [(32632, 395201.3103811303, 5673135.241182375, 51.2, 7.5)]
    places += [(z, x, y, *slow_from_utm(x, y, z)) for z, x, y in ((32632, 340_000.0, 5_710_000.0), (32632, 300_000.0, 5_300_000.0), (32632, 780_000.0, 100.0), (32733, 512_345.6, 9_000_000.0), (32601, 410_000.0, 7_900_000.0))]
    df = spark.createDataFrame([(z, x, y) for z, x, y, _, _ in places], "epsg int, x double, y double")
    lat, lon = geo.utm_to_wgs84(df.x, df.y, df.epsg % 100, df.epsg < 32700)
    east, north = geo.wgs84_to_utm(lat, lon, df.epsg % 100, df.epsg < 32700)
    for r, (z, x, y, want_lat, want_lon) in zip(df.select(lat.alias("lat"), lon.alias("lon"), east.alias("e"), north.alias("n")).collect(), places, strict=True):
        assert (r.lat, r.lon) == (pytest.approx(want_lat, abs=3e-8), pytest.approx(want_lon, abs=3e-8))
        assert (r.e, r.n) == (pytest.approx(x, abs=2e-3), pytest.approx(y, abs=2e-3))


def slow_to_utm(lat, lon, epsg):
    """The inverse of the loop above, by steps."""
    x, y = 500_000.0, lat * 110_600 + (0 if epsg < 32700 else 1e7)
    for _ in range(15):
        a, b = slow_from_utm(x, y, epsg)
        x += (lon - b) * 111_320 * math.cos(math.radians(lat))
        y += (lat - a) * 110_600
    return x, y


def slow_warp(source, image, valid, target, method):
    """``[rows, columns]`` of value or None."""
    _, s_epsg, s_left, s_top, s_xr, s_yr, s_w, s_h = source
    _, epsg, left, top, xr, yr, w, h = target

    def on_source(down, across):
        x, y = left + across * xr, top - down * yr
        if epsg != s_epsg:
            lat, lon = (y, x) if epsg == 4326 else slow_from_utm(x, y, epsg)
            x, y = (lon, lat) if s_epsg == 4326 else slow_to_utm(lat, lon, s_epsg)
        return (s_top - y) / s_yr, (x - s_left) / s_xr

    out = [[None] * w for _ in range(h)]
    for r in range(h):
        for c in range(w):
            v, u = on_source(r + 0.5, c + 0.5)
            parts = {}
            if method != "average" and not (0 <= v < s_h and 0 <= u < s_w):
                continue
            if method == "nearest":
                parts[int(v), int(u)] = 1.0
            elif method == "bilinear":
                i, j = math.floor(v - 0.5), math.floor(u - 0.5)
                fv, fu = v - 0.5 - i, u - 0.5 - j
                parts = {(i + a, j + b): (fv if a else 1 - fv) * (fu if b else 1 - fu) for a in (0, 1) for b in (0, 1)}
            else:
                corners = [on_source(r + a, c + b) for a in (0, 1) for b in (0, 1)]
                v0, v1 = min(p[0] for p in corners), max(p[0] for p in corners)
                u0, u1 = min(p[1] for p in corners), max(p[1] for p in corners)
                for i in range(max(0, math.floor(v0)), min(s_h, math.ceil(v1))):
                    for j in range(max(0, math.floor(u0)), min(s_w, math.ceil(u1))):
                        parts[i, j] = (min(v1, i + 1) - max(v0, i)) * (min(u1, j + 1) - max(u0, j))
            known = [(p, q) for p, q in parts.items() if q > 0 and 0 <= p[0] < s_h and 0 <= p[1] < s_w and valid[p]]
            if known:
                out[r][c] = sum(image[p] * q for p, q in known) / sum(q for _, q in known)
    return out


@pytest.mark.parametrize("method", warp.METHODS)
def test_warps_against_loops(spark, method):
    r = np.random.default_rng(5)
    base = (32632, 500_000.0, 5_000_000.0)
    cases = {
        "shifted": ((*base, 10.0, 10.0, 9, 8), (32632, 500_003.7, 4_999_995.1, 10.0, 10.0, 9, 8)),
        "ratio": ((*base, 10.0, 12.5, 9, 8), (32632, 499_990.0, 5_000_010.0, 23.0, 17.0, 6, 8)),
        "finer": ((*base, 60.0, 60.0, 3, 4), (*base, 20.0, 20.0, 9, 12)),
        "zone": ((32632, 770_000.0, 5_000_000.0, 10.0, 10.0, 12, 12), (32633, 295_900.0, 5_002_500.0, 14.0, 14.0, 300, 8)),
        "degrees": ((4326, 9.0, 45.2, 0.0002, 0.0002, 10, 9), (32632, 500_005.0, 5_005_600.0, 15.0, 15.0, 10, 10)),
        "south": ((32733, 400_000.0, 9_000_000.0, 10.0, 10.0, 6, 6), (32733, 400_011.0, 8_999_977.0, 6.0, 6.0, 8, 8)),
    }
    # The neighbour's grid is placed over the source by its own loop.
    x, y = slow_to_utm(*slow_from_utm(770_030.0, 4_999_970.0, 32632), 32633)
    cases["zone"] = (cases["zone"][0], (32633, x - 40, y + 45, 14.0, 14.0, 8, 8))
    lat, lon = slow_from_utm(500_060.0, 5_005_500.0, 32632)
    cases["degrees"] = ((4326, lon - 0.001, lat + 0.001, 0.0002, 0.0002, 10, 9), cases["degrees"][1])
    images = {k: (r.normal(size=(s[6], s[5])), r.random((s[6], s[5])) < 0.85) for k, (s, _) in cases.items()}
    cells = [(k, i, j, bool(ok[i, j]), float(v[i, j])) for k, (v, ok) in images.items() for i in range(v.shape[0]) for j in range(v.shape[1])]
    got = warp.warped(
        spark.createDataFrame(cells, PIXELS).repartition(3), spark.createDataFrame([(k, *s) for k, (s, _) in cases.items()], GRID), spark.createDataFrame([(k, *t) for k, (_, t) in cases.items()], GRID), method
    ).collect()
    assert len(got) == sum(t[5] * t[6] for _, t in cases.values())
    want = {k: slow_warp((k, *s), *images[k], (k, *t), method) for k, (s, t) in cases.items()}
    some = {k: 0 for k in cases}
    for g in got:
        w = want[g.tile_id][g.row][g.col]
        assert g.valid == (w is not None) and g.value == pytest.approx(w or 0.0, abs=2e-3), (g, w)
        some[g.tile_id] += g.valid
    assert all(some.values())


def test_stack_of_bands_on_the_reference_grid(spark):
    """Ten, twenty and sixty metres on twenty: one value each, invalid where the finest band has no data."""
    target = [("t", 32628, 500_000.0, 1_000_000.0, 20.0, 20.0, 2, 2)]
    bands = {}
    for name, resolution, side in (("b02", 10.0, 4), ("b05", 20.0, 2), ("b09", 60.0, 1)):
        cells = [("t", r, c, not (name == "b02" and r < 2 and c < 2), float(len(bands) + 10)) for r in range(side) for c in range(side)]
        bands[name] = (spark.createDataFrame(cells, PIXELS), spark.createDataFrame([("t", 32628, 500_000.0, 1_000_000.0, resolution, resolution, side, side)], GRID))
    grid = spark.createDataFrame(target, GRID)
    got = {(r.row, r.col): r for r in warp.stacked(bands, grid, 20.0, scale=2.0).collect()}
    assert len(got) == 4 and not got[0, 0].valid and all(got[k].valid for k in got if k != (0, 0))
    assert (got[1, 1].b02, got[1, 1].b05, got[1, 1].b09) == (5.0, 5.5, 6.0) and got[0, 0].b02 == 0.0 and got[0, 0].b05 == 5.5
    for wrong, said in (((32628, 500_000.0, 1_000_000.0, 10.0, 10.0, 2, 2), "t has the resolution 10.0"), ((4326, 0.0, 0.0, 20.0, 20.0, 2, 2), "needs a projected system")):
        with pytest.raises(Exception, match=said):
            warp.stacked(bands, spark.createDataFrame([("t", *wrong)], GRID), 20.0).collect()
    odd = {"b": (bands["b05"][0], spark.createDataFrame([("t", 3857, 0.0, 0.0, 20.0, 20.0, 2, 2)], GRID))}
    with pytest.raises(Exception, match="no way from system 32628 to 3857"):
        warp.stacked(odd, grid, 20.0).collect()
    with pytest.raises(ValueError, match="method must be one of"):
        warp.warped(*odd["b"], grid, "cubic")
    assert warp.warped(bands["b05"][0].limit(0), bands["b05"][1], grid, "nearest").where("NOT valid AND value = 0").count() == 4
