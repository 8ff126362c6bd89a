import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factledger.llm import centroid_clustering as cc

ROWS = "vec_id long, embedding array<float>"


def brute(rows, dim, scale, k, rounds, seed):
    kept = []
    for i, x in rows:
        if x is None or len(x) != dim or any(c is None or not math.isfinite(c) for c in x):
            continue
        v = tuple(math.floor(float(np.float32(c)) * scale) for c in x)
        kept.append((i, v))
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(v) for _, v in order[:k]]
    square = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for turn in range(rounds + 1):
        near = [min((square(v, c), j) for j, c in enumerate(centres)) for _, v in kept]
        if turn == rounds:
            break
        for j in range(len(centres)):
            own = [v for (_, v), (_, c) in zip(kept, near, strict=True) if c == j]
            if own:
                centres[j] = [sum(p) // len(own) for p in zip(*own, strict=True)]
    return sorted(((i, j, d) for (i, _), (d, j) in zip(kept, near, strict=True)), key=repr), centres


def made(n, dim, seed, spread=0.3):
    rng = random.Random(seed)
    heads = [[rng.uniform(-1, 1) for _ in range(dim)] for _ in range(5)]
    return [(i, [h + rng.gauss(0, spread) for h in heads[rng.randrange(5)]]) for i in range(n)]


def run(spark, rows, dim, scale, k, rounds, seed="2:", parts=3):
    df = spark.createDataFrame(rows, ROWS).repartition(parts)
    return cc.cluster_vectors(cc.whole_vectors(df, dim, scale), dim, k, rounds, seed)


@pytest.mark.parametrize("seed,k,scale", [(1, 7, 256), (2, 12, 4), (3, 1, 256), (4, 3, 1)])
def test_matches_brute_force(spark, rows, seed, k, scale):
    data = made(400, 6, seed)
    data += [(900, data[0][1])] * 120 + [(901, None), (902, [1.0] * 5), (903, [None] * 6), (904, [float("nan")] * 6)]
    data += [(905, [float("inf")] + [0.0] * 5), (None, [0.5] * 6), (None, [0.25] * 6), (7, data[7][1])]
    found = run(spark, data, 6, scale, k, 4)
    want, centres = brute(data, 6, scale, k, 4, "2:")
    assert rows(found.assigned, "id", "cluster", "distance") == want
    assert found.centroids.tolist() == centres
    assert sum(found.inertia) == sum(d for *_, d in want)


def test_few_none_and_clashing_names(spark, rows):
    assert rows(run(spark, [], 4, 256, 5, 2).assigned) == []
    data = made(3, 4, 5)
    want, _ = brute(data, 4, 256, 5, 2, "2:")
    assert rows(run(spark, data, 4, 256, 5, 2).assigned, "id", "cluster", "distance") == want
    clash = spark.createDataFrame(data, ROWS).withColumns({c: F.lit("x") for c in ("v", "id", "cluster", "lower", "key")})
    found = cc.cluster_vectors(cc.whole_vectors(clash, 4, 256), 4, 5, 2, "2:")
    assert rows(found.assigned, "id", "cluster", "distance") == want


def test_large_components(spark, rows):
    data = [(i, [100000.0 * ((i * 7 + j) % 5) - 200000.0 for j in range(4)]) for i in range(40)]
    want, _ = brute(data, 4, 256, 6, 3, "2:")
    assert rows(run(spark, data, 4, 256, 6, 3).assigned, "id", "cluster", "distance") == want
    with pytest.raises(Exception, match="too large"):
        run(spark, [(1, [1e30] * 4)], 4, 256, 6, 3)


def test_loosening_covers_every_point_and_beats_the_drift():
    rng = np.random.default_rng(0)
    gained = 0
    for _ in range(200):
        dim, k = int(rng.integers(1, 6)), int(rng.integers(2, 6))
        old = rng.integers(-50, 50, (k, dim))
        new = old + rng.integers(-8, 9, (k, dim))
        radius = rng.uniform(0, 30, k)
        loosen = cc.loosening(old, new, radius)
        drift = np.sqrt(((new - old) ** 2).sum(1))
        for i in range(k):
            way = rng.normal(size=(300, dim))
            way *= (radius[i] * rng.uniform(0, 1, 300) ** 0.3 / np.sqrt((way**2).sum(1)))[:, None]
            x = old[i] + way
            for j in set(range(k)) - {i}:
                taken = np.sqrt(((x - old[j]) ** 2).sum(1)) - np.sqrt(((x - new[j]) ** 2).sum(1))
                assert taken.max() <= loosen[i] + 1e-6
            others = max(drift[j] for j in range(k) if j != i)
            assert loosen[i] <= others + 1e-9
            gained += loosen[i] < 0.9 * others
    assert gained > 100


def test_bounds_spare_most_scans(spark):
    data = made(2000, 8, 9, spread=0.05)
    found = run(spark, data, 8, 256, 5, 5)
    scans = found.assigned.agg(F.sum("scans")).first()[0]
    assert scans < 2000 * 6 / 2


def test_full_drift_scans_more(spark, monkeypatch):
    data = made(1500, 8, 11, spread=0.25)
    total = lambda: run(spark, data, 8, 256, 8, 5).assigned.agg(F.sum("scans")).first()[0]
    tight = total()
    drift = lambda old, new, radius: np.array(
        [max(np.sqrt(((new - old) ** 2).sum(1))[j] for j in range(len(old)) if j != i) for i in range(len(old))]
    )
    monkeypatch.setattr(cc, "loosening", drift)
    assert tight < total()
