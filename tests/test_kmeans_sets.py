"""K-Means sets against plain Python; group medians by counts; village chunks; pages by key."""

import random
import statistics
from collections import defaultdict
from hashlib import md5
from math import log

import numpy as np

from kohort import config as C
from kohort.operators import kmeans, kmeans_sets, metrics, quantiles, stats
from kohort.sources import screening


def draw(i, r, step):
    return -log((int(md5(f"{i}|{r}|{step}".encode()).hexdigest()[:12], 16) + 0.5) / 2 ** 48)


def slow_fit(points, k, restarts, tol, most=300):
    """(cost, restart, centres) of the best restart; points: [(id, [x])]."""
    d = len(points[0][1])
    dist = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    var = [statistics.pvariance([x[j] for _, x in points]) for j in range(d)]
    best = None
    for r in range(restarts):
        chosen = []
        for step in range(k):
            race = [(draw(i, r, step) / (min(dist(x, c) for c in chosen) if chosen else 1.0), i, x) for i, x in points if not chosen or min(dist(x, c) for c in chosen) > 0]
            chosen.append(min(race)[2])
        centres = [list(c) for c in chosen]
        near = lambda x: min(range(k), key=lambda j: (round(dist(x, centres[j]), 9), j))
        for _ in range(most):
            mine = defaultdict(list)
            for _, x in points:
                mine[near(x)].append(x)
            new = [[round(sum(x[j] for x in mine[c]) / len(mine[c]), 9) for j in range(d)] if mine[c] else centres[c] for c in range(k)]
            moved = sum(dist(a, b) for a, b in zip(new, centres))
            centres = new
            if moved <= tol * sum(var) / d:
                break
        cost = round(sum(dist(x, centres[near(x)]) for _, x in points), 6)
        best = min(best or (cost, r, centres), (cost, r, centres))
    return best


def test_fits_of_several_k(spark):
    rnd = random.Random(3)
    points = [(i, [round(rnd.gauss(c, 0.6), 3) for c in rnd.choice([(0, 0, 5), (4, 1, 0), (9, 9, 9)])]) for i in range(150)]
    points += [(200 + i, [1.0, 2.0, 3.0]) for i in range(20)]      # equal points
    df = spark.createDataFrame([(i, *x) for i, x in points], "row_id long, a double, b double, c double")
    params = C.KMeansParams(restarts=4)
    for layout in (df.repartition(1), df.repartition(5)):
        fits = kmeans_sets.fit_sets(layout, ["a", "b", "c"], [2, 3, 5], params)
        for k, fit in fits.items():
            cost, r, centres = slow_fit(points, k, 4, params.tol)
            assert (fit.restart, abs(fit.cost - cost) < 1e-5) == (r, True) and np.allclose(fit.centres, centres, atol=1e-8)
    labels = {r.row_id: r.cluster for r in kmeans.with_label(df, ["a", "b", "c"], fits[3]).collect()}
    for i, x in points:
        assert labels[i] == min(range(3), key=lambda j: (round(sum((a - b) ** 2 for a, b in zip(x, fits[3].centres[j])), 9), j))


def test_fits_stop_at_the_distinct_points(spark):
    df = spark.createDataFrame([(i, float(i % 3)) for i in range(30)], "row_id long, a double")
    fits = kmeans_sets.fit_sets(df, ["a"], [2, 3, 4, 5], C.KMeansParams(restarts=2))
    assert sorted(fits) == [2, 3] and fits[3].cost == 0
    assert kmeans_sets.fit_sets(df.limit(0), ["a"], [2]) == {}
    assert [k for k, _ in kmeans.elbow(df, ["a"], 5, C.KMeansParams(restarts=2))] == [1, 2, 3]


def test_silhouette_of_many_blocks_and_unlabelled_points(spark):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(300, 3))
    lab = [None if i % 50 == 0 else int(i % 4) if i else 9 for i in range(300)]
    df = spark.createDataFrame([(i, lab[i], x[i].tolist()) for i in range(300)], "id long, k int, v array<double>")
    got = {r.id: r for r in metrics.silhouettes(df, metrics.as_vector(array_col="v"), "id", ["k"], block_rows=40).collect()}
    for i in (0, 1, 7, 50, 299):
        assert got[i].own == lab[i]
        if lab[i] is None:
            assert got[i].a is None and got[i].b is None and got[i].silhouette == 0
            continue
        far = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        mean = {c: np.mean([far[j] for j in range(300) if lab[j] == c and j != i]) for c in {0, 1, 2, 3}}
        a, b = mean[lab[i]], min(v for c, v in mean.items() if c != lab[i])
        assert abs(got[i].a - a) < 1e-9 and abs(got[i].b - b) < 1e-9 and abs(got[i].silhouette - (b - a) / max(a, b)) < 1e-9


def test_group_medians_by_counts(spark):
    rnd = random.Random(8)
    rows = [("hot", rnd.choice([rnd.gauss(0, 1), 5.0, rnd.randrange(-3, 9) + 0.0]), None) for _ in range(4000)]
    rows += [(f"g{i % 40}" if i % 9 else None, rnd.choice([None, rnd.random() * 100, 7.0]), float(i)) for i in range(8000)]
    rows += [("one", 3.5, None), ("two", 1.0, 2.0), ("two", 2.0, 2.0), ("none", None, None)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    want = {}
    for g in {r[0] for r in rows} - {None}:
        for i in (1, 2):
            values = [r[i] for r in rows if r[0] == g and r[i] is not None]
            if values:
                want[g, i - 1] = statistics.median(values)
    for fetch in (quantiles.FETCH, 100, 5, 1):
        got = {(r.g, r.i): r["median"] for r in quantiles.group_medians(df, "g", ["x", "y"], 200, fetch).collect()}
        assert got == want


def test_village_chunks(spark):
    rows = [("A", f"v{i:03}") for i in range(25)] * 2 + [("A", None), ("B", None), (None, "x"), (None, "y"), ("C", "z")]
    df = spark.createDataFrame(rows, "kecamatan string, desa string")
    got = {(r.kecamatan, r.chunk): (r.n_villages, r.villages) for r in stats.village_chunks(df, most=10).collect()}
    assert got == {("A", 0): (10, [f"v{i:03}" for i in range(10)]), ("A", 1): (10, [f"v{i:03}" for i in range(10, 20)]), ("A", 2): (6, [f"v{i:03}" for i in range(20, 25)]),
                   ("B", 0): (1, []), (None, 0): (2, ["x", "y"]), ("C", 0): (1, ["z"])}
    whole = {r.kecamatan: (r.n_villages, r.villages) for r in stats.villages_per_district(df).collect()}
    assert whole["A"] == (26, ", ".join(f"v{i:03}" for i in range(25))) and whole[None] == (2, "x, y")


def test_pages_by_place_and_by_key(spark):
    rows = [(i, None if i % 13 == 0 else f"n{i % 7}") for i in range(203)]
    df = spark.createDataFrame(rows, "row_id long, name string").repartition(6)
    for up in (True, False):
        order = sorted(rows, key=lambda r: ((r[1] is not None) if up else (r[1] is None), r[1] or "" if up else [-ord(c) for c in r[1] or ""], r[0]))
        pages, after = [], None
        for page in range(1, 10):
            got = [tuple(r) for r in screening.search_page(df, "", "name", up, page, 25).collect()]
            assert got == order[(page - 1) * 25:page * 25]
            if after and got:
                assert [tuple(r) for r in screening.next_page(df, after, "", "name", up, 25).collect()] == got
            after = (got[-1][1], got[-1][0]) if got else None
            pages += got
        assert pages == order
