"""Vectors that are sent to few tasks."""

import numpy as np

from structlake.operators import similarity


def test_vectors_go_to_as_many_tasks_as_there_are_bundles(spark, monkeypatch):
    rng, held = np.random.default_rng(3), {}
    keep = similarity.kept
    monkeypatch.setattr(similarity, "LEAST_ROWS", 1)
    monkeypatch.setattr(similarity, "BUNDLES", 6)
    monkeypatch.setattr(similarity, "kept", lambda df, name: held.setdefault(name, keep(df, name)))
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[300:420] = x[300]
    docs = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<float>")
    got = {r.id for r in similarity.novel_vectors(docs, docs, "id", "v", 1.5, 20).collect()}
    d = np.sqrt(((x[:, None].astype(float) - x.astype(float)) ** 2).sum(axis=2))
    np.fill_diagonal(d, 9)
    assert got == set(np.flatnonzero(d.min(axis=1) >= 1.5).tolist()) and 0 < len(got) < 480
    # a task for each two bundles, whatever the blocks: before, one for each two of thirty blocks
    assert 6 < held["bundle-pairs"].count() <= 7 * 8 / 2
