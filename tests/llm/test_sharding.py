from collections import Counter

import winsyn.llm.sharding as m


def run(spark, rows, path, shards):
    df = spark.createDataFrame(rows, "doc_id long, text string, slot string")
    m.shuffle_into_shards(df, path, shards)
    return spark.read.parquet(path).collect()


def test_laws(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(m, "BUCKET_BYTES", 600)
    rows = [(i, "t" * (i % 40) + "é", "x") for i in range(1500)] + [(None, None, "x"), (7, "twice", "x"), (7, "twice", "x"), (8, "", "x"), (9, "y" * 50_000, "x")]
    got = run(spark, rows, str(tmp_path / "a"), 24)
    assert Counter((r.doc_id, r.text) for r in got) == Counter(r[:2] for r in rows)
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert all(r.grown_shard in (r.shard, 24) for r in got) and any(r.grown_shard == 24 for r in got)
    assert all(r.size == len((r.text or "").encode()) + 8 for r in got)
    grown = {(r.doc_id, r.text): r.shard for r in run(spark, rows, str(tmp_path / "b"), 25)}
    assert all(grown[r.doc_id, r.text] == r.grown_shard for r in got)
    again = run(spark, rows[::-1], str(tmp_path / "c"), 24)
    key = lambda r: str((r.doc_id, r.text, r.shard, r.slot))
    assert sorted(map(key, again)) == sorted(map(key, got))
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot)) if r.shard == 0]
    assert order != sorted(order, key=lambda x: x or 0)
