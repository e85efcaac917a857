"""Surface, roads, matching and street field against brute force on small fixtures."""

from __future__ import annotations

import json
import math
import random
import unicodedata
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanepulse import joins
from lanepulse.functions import names
from lanepulse.functions.scales import (
    METRICS,
    STREET_OPACITY,
    SURFACE_OPACITY,
    metric_position,
    scale_position,
    support_opacity,
)
from lanepulse.operators import field, matching, numbering, roads, surface
from lanepulse.params import DEFAULTS as P
from lanepulse.plans.network import build_network, claimed_network
from lanepulse.sources.roads import read_ways

WAYS = "way_id long, name string, coords array<struct<lon:double,lat:double>>"
SITES = "site_id long, lat double, lon double, street string, speed double"
CHUNKS = """corridor_id long, name string, key string, way_id long, segment int, piece long,
lon0 double, lat0 double, lon1 double, lat1 double, mid_lon double, mid_lat double"""
KX, KY = P.km_per_deg_lon, P.km_per_deg_lat


def ways_df(spark, ways):
    return spark.createDataFrame(ways, WAYS)


def value_of(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


# --- names ---


def test_folding_equals_the_unicode_tables(spark):
    rng = random.Random(5)
    odd = "áÉîöñçßøłŒﬁ½²ªĲ…№㎏Å𝐀𝔟①ﷺЖ中😀́  ,.-'"
    texts = ["".join(rng.choice(odd + "abc XYZ 019") for _ in range(12)) for _ in range(300)]
    expected = [
        unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in texts
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", names.ascii_fold(F.col("t")).alias("v")).orderBy("i").collect()
    assert [r.v for r in got] == expected


@pytest.mark.parametrize(
    "name, key",
    [
        ("Bv. España", ["espana"]),
        ("Bulevar General Artigas", ["artigas"]),
        ("Camino del Las", ["camino", "del", "las"]),
        ("Rambla República Argentina", ["rambla", "republica", "argentina"]),
        ("18 de Julio", ["18", "julio"]),
        ("¡!", []),
    ],
)
def test_name_key(spark, name, key):
    assert value_of(spark, names.name_key(F.lit(name))) == key


def test_name_scores(spark):
    golden = {
        ("Rambla", "Rambla República Argentina"): 1.0,
        ("Rambla República Argentina", "Rambla"): 1 / 3,
        ("L A de Herrera", "Avenida Luis Alberto de Herrera"): 0.8,
        ("Bv. Artgias", "Bulevar General Artigas"): 0.9,
        ("Colonia", "Colorado"): 0.0,
        ("Ariel", "Camino Ariel"): 1.0,
        ("Av Italia Norte", "Avenida Italia"): 0.5,
        ("¡!", "Avenida Italia"): 0.0,
        ("Italia", "¡!"): 0.0,
        ("Arti", "Arta"): 0.0,  # too short for a near miss
    }
    pairs = spark.createDataFrame(list(golden), "street string, name string")
    got = {(r.street, r.name): r.score for r in matching.name_scores(pairs).collect()}
    assert got == pytest.approx(golden)


def test_similarity_keeps_its_argument_order(spark):
    def ratio(a, b):
        row = spark.createDataFrame([(a, b)], "a string, b string")
        return row.select(names.token_similarity(F.col("a"), F.col("b")).alias("v")).first().v

    assert ratio("artgias", "artigas") == pytest.approx(6 / 7)
    assert ratio("colonia", "colorado") == pytest.approx(2 / 3)
    assert ratio("tide", "diet") != ratio("diet", "tide")


# --- roads ---


def test_long_and_empty_segments(spark):
    lat = -34.9
    east = 0.150 / KX
    ways = [(1, "A", [(0.0, lat), (east, lat), (east, lat)]), (2, "B", [(0.0, lat)])]
    pieces = roads.split_ways(ways_df(spark, ways).where(F.size("coords") >= 2)).collect()
    assert sorted((r.way_id, r.segment, r.piece) for r in pieces) == [
        (1, 1, 0), (1, 1, 1), (1, 1, 2), (1, 2, 0)
    ]
    first = [r for r in pieces if r.segment == 1]
    assert sum(r.lon1 - r.lon0 for r in first) == pytest.approx(east)


def random_ways(n, seed):
    """Short polylines crowding a few places, some of them copies of each other."""
    rng = random.Random(seed)
    ways = []
    for i in range(n):
        lon, lat = -56.1 + rng.randrange(12) * 0.004, -34.9 + rng.randrange(4) * 0.004
        coords = [(lon, lat)]
        for _ in range(rng.randrange(0, 4)):
            lon, lat = lon + rng.uniform(-0.002, 0.002), lat + rng.uniform(-0.002, 0.002)
            coords.append((lon, lat))
        if ways and rng.random() < 0.2:
            coords = ways[-1][2]
        name = rng.choice(["Avenida Italia", "Av. Italia", "Calle Sur", "Rivera", "Ruta", "Álamo"])
        ways.append((i * 7 + 3, name, coords))
    return ways


def brute_corridors(ways, keys):
    """way_id -> (key, lowest connected way) by flooding cells."""
    cells = {
        w: {(math.floor(x * KX / 0.1), math.floor(y * KY / 0.1)) for x, y in coords}
        for w, _, coords in ways
    }
    label = {}
    for w, _, _ in ways:
        if w in label:
            continue
        label[w], queue = w, [w]
        while queue:
            here = queue.pop()
            for other, _, _ in ways:
                close = any(
                    abs(a - c) <= 1 and abs(b - d) <= 1
                    for a, b in cells[here] for c, d in cells[other]
                )
                if other not in label and keys[other] == keys[here] and close:
                    label[other] = w
                    queue.append(other)
    return {w: (keys[w], label[w]) for w in label}


def test_corridors_equal_flooding(spark):
    ways = [w for w in random_ways(150, 1) if len(w[2]) >= 2]
    df = ways_df(spark, ways)
    keys = {r.way_id: tuple(r.key) for r in roads.keyed_ways(df).collect()}
    expected = brute_corridors(ways, keys)
    order = {c: i for i, c in enumerate(sorted(set(expected.values())))}
    got = {r.way_id: r for r in roads.way_corridors(df).collect()}
    assert {w: r.corridor_id for w, r in got.items()} == {w: order[c] for w, c in expected.items()}
    spelled = defaultdict(list)
    for w, name, _ in ways:
        spelled[expected[w]].append(name)
    for w, corridor in expected.items():
        options = spelled[corridor]
        best = min(set(options), key=lambda n: (-options.count(n), n))
        assert (got[w].name, got[w].key) == (best, " ".join(corridor[0]))


def test_labels_of_chains_stars_and_rings(spark):
    chain = [(i + 1, i) for i in range(200)]
    star = [(1000 + i, 1000) for i in range(1, 120)]
    # A hub with the highest number, and a ring in shuffled order.
    hub = [(2999, 2000 + i) for i in range(90)]
    ring = [3000 + i for i in random.Random(2).sample(range(80), 80)]
    ring = [tuple(sorted((a, b), reverse=True)) for a, b in zip(ring, ring[1:] + ring[:1])]
    links = spark.createDataFrame(chain + star + hub + ring, "hi long, lo long")
    got = {r.node: r.label for r in roads.component_labels(links).collect()}
    for node, label in got.items():
        assert label == node // 1000 * 1000, (node, label)
    assert len(got) == 200 + 119 + 90 + 79


@pytest.mark.parametrize("each, most", [(100_000, 1), (100, 3)])
def test_a_round_of_labels_is_written_by_as_many_tasks_as_its_links_need(spark, monkeypatch, each, most):
    monkeypatch.setattr(roads, "LINKS_PER_FILE", each)
    links = spark.createDataFrame([(i, i // 30 * 30) for i in range(300) if i % 30], "hi long, lo long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        labels = roads.component_labels(links)
        assert len(labels.inputFiles()) <= most
        assert {r.node: r.label for r in labels.collect()} == {i: i // 30 * 30 for i in range(300) if i % 30}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_labels_of_nothing(spark):
    assert roads.component_labels(spark.createDataFrame([], "hi long, lo long")).count() == 0


def test_ways_from_documents(spark, tmp_path):
    def element(name, *points):
        return {"geometry": [{"lat": a, "lon": o} for a, o in points], "tags": {"name": name}}

    major = [element("A", (1.0, 2.0), (3.0, 4.0)), {"tags": {"name": "no geometry"}},
             {"geometry": [{"lat": 1.0, "lon": 1.0}]}, element("", (1.0, 1.0)), element("B", (5.0, 6.0))]
    minor = [element("C", (7.0, 8.0), (9.0, 1.0)), {"geometry": [], "tags": {"name": "D"}}]
    for name, elements in (("major", major), ("minor", minor)):
        document = {"version": 0.6, "elements": elements}
        (tmp_path / f"{name}.json").write_text(json.dumps(document, indent=1))
    ways = read_ways(spark, [str(tmp_path / "major.json"), str(tmp_path / "minor.json")])
    got = [(r.way_id, r.name, [(c.lon, c.lat) for c in r.coords]) for r in ways.orderBy("way_id").collect()]
    assert got == [
        (0, "A", [(2.0, 1.0), (4.0, 3.0)]), (1, "B", [(6.0, 5.0)]), (2, "C", [(8.0, 7.0), (1.0, 9.0)])
    ]


# --- matching and field ---


def random_sites(n, seed):
    rng = random.Random(seed)
    sites = []
    for i in range(n):
        lon = -56.1 + rng.randrange(12) * 0.004 + rng.uniform(-0.002, 0.002)
        lat = -34.9 + rng.randrange(4) * 0.004 + rng.uniform(-0.001, 0.001)
        if sites and rng.random() < 0.2:
            lat, lon = sites[-1][1:3]
        street = rng.choice(["Italia", "Av Sur", "Riveera", "Alamo", "Ruta", "Nowhere"])
        speed = None if rng.random() < 0.1 else float(rng.randrange(5, 60))
        sites.append((i + 1, lat, lon, street, speed))
    return sites


def point_to_segment(px, py, c):
    ax, ay, bx, by = c.lon0 * KX, c.lat0 * KY, c.lon1 * KX, c.lat1 * KY
    length = math.hypot(bx - ax, by - ay)
    if length < 1e-12:
        return math.hypot(px - ax, py - ay)
    t = ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / length**2
    t = min(max(t, 0.0), 1.0)
    return math.hypot(px - ax - t * (bx - ax), py - ay - t * (by - ay))


@pytest.fixture(scope="module")
def city(spark):
    """Chunks, sites and the brute-force distances between them."""
    chunks = roads.build_chunks(ways_df(spark, random_ways(150, 1))).persist()
    sites = spark.createDataFrame(random_sites(120, 3), SITES).persist()
    near = defaultdict(lambda: math.inf)
    for s in sites.collect():
        for c in chunks.collect():
            d = point_to_segment(s.lon * KX, s.lat * KY, c)
            near[s.site_id, c.corridor_id] = min(d, near[s.site_id, c.corridor_id])
    return chunks, sites, {k: d for k, d in near.items() if d <= 0.12}


@pytest.fixture(params=["broadcast", "crowded"])
def any_join(request, monkeypatch):
    """The same results whether the lookup is broadcast or cells are dealt out."""
    if request.param == "crowded":
        monkeypatch.setattr(joins, "BROADCAST_BYTES", -1)
        monkeypatch.setattr(joins, "ROWS_PER_PART", 3)


def test_near_corridors_equal_all_pairs(spark, city, any_join):
    chunks, sites, near = city
    found = sites.join(matching.near_corridors(sites, chunks), ["lat", "lon"])
    got = {(r.site_id, r.corridor_id): r.distance for r in found.collect()}
    assert len(near) > 100
    assert got == pytest.approx(near)


def test_corridor_choice_equals_all_pairs(spark, city, any_join):
    chunks, sites, near = city
    names_of = {r.corridor_id: r.name for r in chunks.select("corridor_id", "name").collect()}
    pairs = [(s.street, n) for s in sites.collect() for n in set(names_of.values())]
    scored = matching.name_scores(spark.createDataFrame(pairs, "street string, name string"))
    score = {(r.street, r.name): r.score for r in scored.collect()}
    expected = {}
    for s in sites.collect():
        options = [
            (-score[s.street, names_of[c]], d, c) for (i, c), d in near.items() if i == s.site_id
        ]
        best = min(options, default=(0,))
        expected[s.site_id] = best[2] if best[0] <= -0.6 else None
    assigned = matching.assign_corridors(sites, chunks)
    assert {r.site_id: r.corridor_id for r in assigned.collect()} == expected
    assert None in expected.values() and len(set(expected.values())) > 5

    lost = [s.street for s in sites.collect() if expected[s.site_id] is None]
    got = [(r.street, r.n) for r in matching.unmatched_names(sites, assigned).collect()]
    assert got == sorted(((n, lost.count(n)) for n in set(lost)), key=lambda p: (-p[1], p[0]))


def test_no_sites_or_no_roads(spark, city):
    chunks, sites, _ = city
    assert matching.assign_corridors(sites.limit(0), chunks).count() == 0
    none = matching.assign_corridors(sites, chunks.limit(0))
    assert none.count() == sites.count() and none.where("corridor_id IS NOT NULL").count() == 0
    fielded = field.street_field(
        chunks, sites.limit(0).withColumn("corridor_id", F.lit(1)), "speed"
    )
    assert fielded.count() == chunks.count() == fielded.where("support = 0").count()


@pytest.mark.parametrize("mode", field.REACH_MODELS)
def test_field_equals_all_pairs(spark, city, any_join, mode):
    chunks, sites, _ = city
    assigned = matching.assign_corridors(sites, chunks)
    placed = matching.with_corridor(sites, assigned)
    reach = P.street_stub_km if mode == field.STUB else P.street_cutoff_km
    by_corridor = defaultdict(list)
    for s in placed.orderBy("site_id").collect():
        if s.corridor_id is not None and s.speed is not None:
            by_corridor[s.corridor_id].append(s)
    expected = {}
    for c in chunks.collect():
        there = [
            (math.hypot((c.mid_lon - s.lon) * KX, (c.mid_lat - s.lat) * KY), s.site_id, s.speed)
            for s in by_corridor[c.corridor_id]
        ]
        there = [(math.exp(-((d / 0.4) ** 2)), d, i, v) for d, i, v in there if d <= reach]
        if mode != field.BLEND:
            there = sorted(there, key=lambda x: x[1:3])[:1]
        support = sum(w for w, *_ in there)
        value = sum(w * v for w, *_, v in there) / support if support else None
        expected[c.way_id, c.segment, c.piece] = (value, support)
    got = field.street_field(chunks, placed, "speed", mode=mode).collect()
    assert len(got) == len(expected)
    painted = 0
    for r in got:
        value, support = expected[r.way_id, r.segment, r.piece]
        assert r.support == pytest.approx(support)
        assert r.value == (None if value is None else pytest.approx(value))
        painted += value is not None
    assert 0 < painted < len(got)


def test_nearest_tie_goes_to_the_first_site(spark):
    chunk = [(0, "A", "a", 1, 1, 0, -56.1, -34.9, -56.1, -34.9, -56.1, -34.9)]
    chunks = spark.createDataFrame(chunk, CHUNKS)
    sites = [(9, -34.901, -56.1, 50.0, 0), (4, -34.901, -56.1, 20.0, 0), (6, -34.901, -56.1, 30.0, 0)]
    df = spark.createDataFrame(sites, "site_id long, lat double, lon double, speed double, corridor_id long")
    row = field.street_field(chunks, df, "speed", mode=field.NEAREST).first()
    assert row.value == 20.0 and row.support == pytest.approx(math.exp(-((0.111 / 0.4) ** 2)))


def test_unknown_reach_model(spark, city):
    chunks, sites, _ = city
    with pytest.raises(ValueError, match="'far' names no way"):
        field.street_field(chunks, sites, "speed", mode="far")


def test_claimed_network_is_renumbered(spark, city):
    chunks, _, _ = city
    assigned = spark.createDataFrame([(1, 7), (2, 2), (3, None), (4, 7)], "site_id long, corridor_id long")
    kept = claimed_network(chunks, assigned)
    assert {r.corridor_id for r in kept.collect()} == {0, 1}
    assert kept.count() == chunks.where("corridor_id IN (2, 7)").count()


def test_build_network(spark, tmp_path):
    lon, lat = -56.1, -34.9
    elements = [
        {"geometry": [{"lat": lat, "lon": lon - 0.001}, {"lat": lat, "lon": lon + 0.001}],
         "tags": {"name": "Avenida Italia"}},
        {"geometry": [{"lat": lat - 0.001, "lon": lon}, {"lat": lat + 0.001, "lon": lon}],
         "tags": {"name": "Calle Comercio"}},
    ]
    (tmp_path / "roads.json").write_text(json.dumps({"elements": elements}))
    columns = """site_id long, lat double, lon double, street string, n_zero long,
    n_readings long, n_missing long, mean_speed double, free_flow_speed double,
    day_speed double, night_speed double, streets_at_coord long, n_dead_lanes long"""
    figures = (0, 9, 0, 20.0, 50.0, 20.0, 40.0)
    detectors = spark.createDataFrame(
        [(1, lat + 0.0004, lon, "Italia", *figures, 1, 0), (2, lat, lon, "Túnel", *figures, 1, 0),
         (3, lat, lon, "Comercio", *figures, 5, 0)],  # no usable position
        columns,
    )
    built = build_network(spark, str(tmp_path / "roads.json"), detectors, str(tmp_path))
    summary = built["summary"].first()
    assert (summary.n_ways, summary.n_corridors, summary.n_matched, summary.n_mappable) == (2, 2, 1, 2)
    assert {(r.corridor_id, r.name) for r in built["streets"].collect()} == {(0, "Avenida Italia")}
    assert [(r.street, r.n) for r in built["unmatched_names"].collect()] == [("Túnel", 1)]


# --- surface ---


def dense_surface(sites):
    """(i, j) -> (value, support) from one distance matrix, and the axes."""
    sx, sy = np.array([s[2] for s in sites]) * KX, np.array([s[1] for s in sites]) * KY
    v = np.array([s[4] for s in sites])
    axes = [np.arange(a.min() - 1.2, a.max() + 1.2 + 0.2, 0.2) for a in (sx, sy)]
    d = np.hypot(axes[0][:, None, None] - sx, axes[1][None, :, None] - sy)
    w = np.where(d <= 1.2, np.exp(-((d / 0.5) ** 2)), 0.0)
    support = w.sum(axis=2)
    with np.errstate(invalid="ignore"):
        value = (w * v).sum(axis=2) / support
    return value, support, axes


def test_surface_equals_the_dense_grid(spark):
    sites = random_sites(60, 9)
    known = [s for s in sites if s[4] is not None]
    value, support, axes = dense_surface(known)
    df = spark.createDataFrame(sites, SITES)
    grid = surface.surface_grid(df, "speed").collect()
    assert len(grid) == value.size
    for r in grid:
        assert r.support == pytest.approx(support[r.i, r.j], abs=1e-12)
        if support[r.i, r.j] > 0:
            assert r.value == pytest.approx(value[r.i, r.j])
        else:
            assert r.value is None
    assert surface.surface_cells(df, "speed").count() == (support > 0).sum()
    bounds = surface.surface_bounds(df, "speed").first()
    assert (bounds.nx, bounds.ny) == value.shape
    edges = ((axes[0][0] - 0.1) / KX, (axes[1][0] - 0.1) / KY, (axes[0][-1] + 0.1) / KX, (axes[1][-1] + 0.1) / KY)
    assert (bounds.west, bounds.south, bounds.east, bounds.north) == pytest.approx(edges)


def test_copies_change_support_but_not_value(spark):
    sites = [s for s in random_sites(30, 4) if s[4] is not None]
    copies = sites + [(s[0] + 1000, *s[1:]) for s in sites]
    one = {(r.i, r.j): r for r in surface.surface_cells(spark.createDataFrame(sites, SITES), "speed").collect()}
    two = surface.surface_cells(spark.createDataFrame(copies, SITES), "speed").collect()
    assert len(one) == len(two)
    for r in two:
        assert r.value == pytest.approx(one[r.i, r.j].value)
        assert r.support == pytest.approx(2 * one[r.i, r.j].support)


def test_surface_of_nothing(spark):
    df = spark.createDataFrame([(1, -34.9, -56.1, "A", None)], SITES)
    assert surface.surface_cells(df, "speed").count() == 0
    assert surface.surface_grid(df, "speed").count() == 0
    assert surface.surface_bounds(df, "speed").count() == 0


@pytest.mark.parametrize("points_per_task", [20_000, 3])
def test_surfaces_by_key_equal_single_surfaces(spark, monkeypatch, points_per_task):
    monkeypatch.setattr(surface, "POINTS_PER_TASK", points_per_task)
    monkeypatch.setattr(surface, "BROADCAST_AXES", points_per_task - 10)
    groups = {"a": random_sites(20, 1), "b": random_sites(25, 2)}
    rows = [(g, *s) for g, sites in groups.items() for s in sites]
    both = surface.surface_cells(spark.createDataFrame(rows, f"g string, {SITES}"), "speed", by=["g"])
    for g, sites in groups.items():
        alone = surface.surface_cells(spark.createDataFrame(sites, SITES), "speed")
        got = both.where(F.col("g") == g).drop("g")
        rounded = [F.round(c, 9).alias(c) if c in ("value", "support") else F.col(c) for c in alone.columns]
        assert got.select(rounded).exceptAll(alone.select(rounded)).count() == 0
        assert got.count() == alone.count()


# --- scales ---


@pytest.mark.parametrize("support, alpha", [(1.0, 0.198), (3.0, 0.428), (10.0, 0.85), (0.0, 0.1)])
def test_surface_opacity(spark, support, alpha):
    assert value_of(spark, support_opacity(F.lit(support), SURFACE_OPACITY)) == pytest.approx(alpha, abs=5e-4)


def test_opacity_variants(spark):
    clear = support_opacity(F.lit(3.0), SURFACE_OPACITY, supported=F.lit(False))
    assert value_of(spark, clear) == 0.0
    assert value_of(spark, support_opacity(F.lit(99.0), SURFACE_OPACITY, boost=1.15)) == pytest.approx(0.9775)
    assert value_of(spark, support_opacity(F.lit(1.2), STREET_OPACITY)) == pytest.approx(0.95)


def test_metric_positions(spark):
    def at(name, value, **domain):
        value = F.lit(value).cast("double")
        return value_of(spark, metric_position(METRICS[name], value, **domain))

    assert at("congestion", 0.45) == pytest.approx(0.5)
    assert at("speed", 5.0) == 1.0 and at("speed", 99.0) == 0.0
    assert at("vs_typical", -12.0) == 0.0 and at("vs_typical", 0.0) == 0.5
    assert at("congestion", None) is None
    assert at("volume", 30.0, low=F.lit(10.0), high=F.lit(50.0)) == pytest.approx(0.5)
    assert value_of(spark, scale_position(F.lit(7.0), 7.0, 7.0)) == 0.0


# --- numbering over many ranges ---


@pytest.mark.parametrize("rows_per_slice", [7, 500_000])
def test_dense_ids_have_no_gaps(spark, rows_per_slice):
    values = [(x, y) for x in [*range(40), None] for y in "ab"]
    random.Random(1).shuffle(values)
    df = spark.createDataFrame(values, "x int, y string")
    numbered = numbering.dense_ids(df, ["x", "y"], "id", start=5, rows_per_slice=rows_per_slice)
    got = [(r.x, r.y) for r in numbered.orderBy("id").collect()]
    assert got == sorted(values, key=lambda v: (v[0] is None, v[0] or 0, v[1]))
    assert [r.id for r in numbered.orderBy("id").collect()] == list(range(5, 5 + len(values)))


def test_field_of_periods_is_one_field_each(spark, city):
    chunks, _, _ = city
    corridor, lon, lat = chunks.select("corridor_id", "mid_lon", "mid_lat").orderBy("corridor_id").first()
    rows = [("a", 1, corridor, lon, lat, "10"), ("b", 1, corridor, lon, lat, "50"), ("b", 2, corridor, lon, lat, "x")]
    sites = spark.createDataFrame(rows, "period string, site_id long, corridor_id long, lon double, lat double, speed string")
    for mode in ("blend", "nearest", "stub"):
        got = field.street_field(chunks, sites, "speed", mode=mode, by=["period"]).where("value is not null")
        alone = {
            k: field.street_field(chunks, sites.where(f"period = '{k}'"), "speed", mode=mode)
            .where("value is not null").select("mid_lon", "mid_lat", "value", "support").collect()
            for k in ("a", "b")
        }
        for k, want in alone.items():
            mine = got.where(f"period = '{k}'").select("mid_lon", "mid_lat", "value", "support").collect()
            assert want and sorted(mine) == sorted(want)
            assert {round(r["value"], 9) for r in mine} == {10.0 if k == "a" else 50.0}
    with pytest.raises(Exception, match="several readings"):
        field.street_field(chunks, sites, "speed").collect()


def test_text_that_is_no_number_is_no_value(spark):
    rows = spark.createDataFrame([(-56.2, -34.9, "7"), (-56.2, -34.9, "x")], "lon double, lat double, speed string")
    assert surface.surface_points(rows, "speed").select("v", "n").collect() == [(7.0, 1)]
