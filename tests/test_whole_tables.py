"""Searches and regions over whole tables, against brute force."""

import numpy as np
from conftest import DATA

from plumbline.catalogue import QUERIES


def test_nearest_of_all_vectors(spark):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet").toPandas().sort_values("vec_id")
    v, ids, labels = np.stack(e.embedding).astype(np.float64), e.vec_id.to_numpy(), e.label.to_numpy()
    got = {r.vec_id: r for r in QUERIES["knn_embeddings"](spark, DATA).collect()}
    assert set(got) == set(ids.tolist()) and max(r.nearest for r in got.values()) >= 200
    for k, i in enumerate(ids.tolist()):
        d = ((v - v[k]) ** 2).sum(axis=1)
        d[k] = np.inf
        n = int(d.argmin())
        other = d[labels != labels[n]].min()
        assert (got[i].nearest, got[i].label_found) == (ids[n], labels[n])
        assert abs(got[i].d_nearest - d[n]) < 1e-4 and abs(got[i].d_other - other) < 1e-4


def test_cells_of_all_parts(spark):
    p = spark.read.parquet(f"{DATA}/part.parquet").toPandas()
    cells = set(zip(p.p_size.tolist(), (p.p_retailprice // 50).astype(int).tolist(), strict=True))
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    want, rest = {}, set(cells)
    while rest:
        seed = min(rest)
        region, front = {seed}, [seed]
        while front:
            x, y = front.pop()
            new = {(x + i, y + j) for i, j in steps} & cells - region
            region |= new
            front += new
        rest -= region
        want.update((c, seed[0] * 2**31 + seed[1]) for c in region)
    got = {(r.ix, r.iy): r.region for r in QUERIES["raster_label"](spark, DATA).collect()}
    assert got == want
    wide = {(x + i, y + j) for x, y in cells for i, j in steps}
    closed = {(x, y) for x, y in wide if all((x + i, y + j) in wide for i, j in steps)}
    assert {(r.ix, r.iy) for r in QUERIES["dilate_erode"](spark, DATA).collect()} == closed
    assert set(got) <= closed
