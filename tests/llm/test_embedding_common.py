import numpy as np
import pytest

import winsyn.llm.embedding_dedup as m


@pytest.mark.parametrize("dim", [64, 128])
def test_recall_with_a_common_direction(spark, dim):
    """Pairs at cosine 0.98 to 0.99 among vectors whose mean has length 0.95."""
    rnd = np.random.Generator(np.random.PCG64(5))
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    mean = unit(rnd.normal(size=dim))
    away = lambda n: (lambda x: unit(x - np.outer(x @ mean, mean)))(rnd.normal(size=(n, dim)))
    x = 0.95 * mean + np.sqrt(1 - 0.95**2) * away(600)
    noise = rnd.normal(size=x.shape)
    noise = unit(noise - (noise * x).sum(axis=1, keepdims=True) * x)
    cos = rnd.uniform(0.98, 0.99, size=(600, 1))
    y = cos * x + np.sqrt(1 - cos**2) * noise
    v = np.concatenate([x, y])
    want = (v @ v.T >= 0.98).sum() - len(v)
    got = m.near_vectors(spark.createDataFrame([(i, 1, r.tolist()) for i, r in enumerate(v)], "vec_id long, label int, embedding array<double>"))
    found = sum(r.n_links for r in got.collect())
    print(dim, want, found, found / want)
    assert found >= 0.9 * want
