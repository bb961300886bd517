"""What Python workers hold at once in the pipeline's first two stages: small slices of text, never whole shingle rows."""

import numpy as np
import pyarrow as pa

from basketlens.llm import common, jaccard_join, quality_bands

TEXTS = [" ".join(f"w{i}x{j}" for j in range(4000)) for i in range(200)]  # 6 MB


def batch(id_name, text_name):
    return pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS)), pa.int64()), pa.array(TEXTS)], names=[id_name, text_name])


def recorded(monkeypatch, module, name):
    sizes, inner = [], getattr(module, name)

    def call(texts, *args):
        sizes.append(sum(len(x.as_py()) for x in texts))
        return inner(texts, *args)

    monkeypatch.setattr(module, name, call)
    return sizes


def test_shingles_of_a_batch_are_made_in_small_slices(monkeypatch):
    sizes = recorded(monkeypatch, jaccard_join, "shingle_sets")
    out = [b for b in jaccard_join._digests(iter([batch("id", "t")]), 64) if b.column(0)[0].as_py() == 0]
    assert [i for b in out for i in b.column(1).to_pylist()] == list(range(len(TEXTS)))
    assert sum(sizes) == sum(map(len, TEXTS)) and max(sizes) <= 1 << 20


def test_quality_of_a_batch_is_measured_in_small_slices(monkeypatch):
    sizes = recorded(monkeypatch, quality_bands, "metrics")
    out = list(quality_bands.good_rows(iter([batch("doc_id", "text")]), 1, ["doc_id", "text"]))
    assert all(b.schema.names == ["doc_id", "text"] for b in out)
    assert sum(sizes) == sum(map(len, TEXTS)) and max(sizes) <= 1 << 20


def test_whole_rows_do_not_go_through_python(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-1 << 62, 1 << 62, 80)
    sets = {1: base, 2: np.r_[base[:70], 5, 6], 3: np.r_[base[:60], np.arange(40)], 4: base[:60], 5: base[:59]}
    rows = spark.createDataFrame([(k, [int(x) for x in sorted(v)]) for k, v in sets.items()], "sig long, row array<long>")
    pairs = [(a, b) for a in sets for b in sets if a < b]
    got = jaccard_join._verified(spark.createDataFrame(pairs, "a long, b long"), rows)
    overlap = {(a, b): len(set(sets[a]) & set(sets[b])) for a, b in pairs}
    want = [p for p, n in overlap.items() if 100 * n >= 75 * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    assert sorted(map(tuple, got.collect())) == want and (1, 4) in want and (1, 5) not in want
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()


def test_rows_are_picked_by_their_keys(spark):
    store = spark.createDataFrame([(i % 50, [i % 50, 100 + i % 50]) for i in range(200)], "sig long, row array<long>")
    table = jaccard_join._whole_rows(store, spark.createDataFrame([(7,), (30,)], "sig long"))
    assert sorted(map(tuple, spark.table(table).collect())) == [(7, [7, 107]), (30, [30, 130])]
    spark.sql(f"DROP TABLE {table}")


def test_texts_go_to_python_in_small_batches(spark, tmp_path):
    before = spark.conf.get(common.BATCH_ROWS)
    spark.range(3000, numPartitions=1).selectExpr("id", "string(id) as t").write.parquet(str(tmp_path / "rows"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    with common.batch_rows(spark, jaccard_join.TEXT_ROWS):
        got = spark.read.parquet(str(tmp_path / "rows")).mapInArrow(sizes, "n long").collect()
    assert [r.n for r in got] == [1000, 1000, 1000] and spark.conf.get(common.BATCH_ROWS) == before


def test_repeats_are_reported_across_batches():
    rows = [pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array(["a b c d e"])], names=["id", "t"]) for i in range(5)]
    out = [b for b in jaccard_join._digests(iter(rows), 64) if b.column(0)[0].as_py() == 1]
    assert [b.column(2).to_pylist() for b in out] == [[5]]
