import tracemalloc

import numpy as np

import winsyn.llm.suffix_dedup as m


def test_memory_of_a_family():
    """Suffixes with one beginning lie in one shard: what a worker takes for them beyond themselves must stay small."""
    shape = m.Shape(m.LENGTH)
    rng = np.random.default_rng(5)
    n = 60_000
    raw = np.zeros((n, shape.width), np.uint8)
    raw[:, shape.k : shape.length] = rng.integers(97, 123, (n, shape.length - shape.k))
    raw[:, shape.length + 2 : -2] = rng.integers(97, 123, (n, shape.before))
    raw[:, shape.length + 1], raw[:, -1] = shape.length, shape.before
    runs = [np.sort(part.view(shape.kind).ravel()) for part in np.split(raw, 4)]
    del raw
    tracemalloc.start()
    family = m.Family(shape)
    for run in runs:
        family.add(run, np.zeros(len(run), bool))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(x.suffixes) for x in family.levels) == n
    assert peak < 3.3 * n * shape.width
    assert all((np.sort(x.suffixes) == x.suffixes).all() for x in family.levels)


def test_memory_of_a_shard():
    """A shard's arrays come in parts, and only its family keeps them."""
    import pyarrow as pa

    shape = m.Shape(m.LENGTH)
    rng = np.random.default_rng(6)
    size, parts = 10_000, 16

    def sent():
        for batch in range(parts):
            raw = np.zeros((size, shape.width), np.uint8)
            raw[:, shape.k : shape.length] = rng.integers(97, 123, (size, shape.length - shape.k), np.uint8)
            raw[:, shape.length + 2 : -2] = rng.integers(97, 123, (size, shape.before), np.uint8)
            raw[:, shape.length + 1], raw[:, -1] = shape.length, shape.before
            keys = np.sort(raw.view(shape.kind).ravel()).tobytes()
            yield pa.record_batch({"shard": [0], "batch": [batch], "keys": [keys], "several": [bytes(size // 8)]})

    tracemalloc.start()
    out = list(m._scan(shape)(sent()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(x.num_rows for x in out) == parts
    assert peak < 2.6 * size * parts * shape.width
