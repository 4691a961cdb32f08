"""Stored corpora, npy files, sketches, observed tallies and stateful streams."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifmill import stages
from motifmill.operators import clean, encode, stats
from motifmill.sources import corpus, files, npy
from motifmill.streaming import state


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_stored_corpus_needs_no_exchange(spark):
    rows = [(f"t{k % 400}", k, f"g{k % 7}") for k in range(1000)] + [(None, 5, "x")]
    left = spark.createDataFrame(rows, "smarts string, ord int, reaction_group string")
    right = spark.createDataFrame([(f"t{k}", str(k % 5)) for k in range(0, 500, 2)], "smarts string, label string")
    stored = corpus.Corpus(spark, buckets=4)
    stored.store(left, "groups")
    stored.store(right, "labels")
    joined = stored.join("groups", "labels")
    assert sorted(map(tuple, joined.select("smarts", "ord", "label").collect())) == sorted(map(tuple, left.join(right, "smarts").select("smarts", "ord", "label").collect()))
    outer = stored.join("groups", "labels", "left")
    assert outer.count() == 1001 and outer.where("label is null").count() == left.join(right, "smarts", "left").where("label is null").count()
    first = stored.first("groups")
    assert sorted(map(str, first.collect())) == sorted(map(str, clean.keep_first(left, "smarts").collect()))
    for df in (joined, outer, first):
        assert "Exchange" not in _plan(df)
    stored.drop()


def test_npy_round_trip(spark, tmp_path):
    npy.register(spark)
    rng = np.random.default_rng(0)
    rows = [(f"k{k}" if k % 5 else None, rng.normal(size=6).astype(np.float32).tolist()) for k in range(1000)]
    df = spark.createDataFrame(rows, npy.SCHEMA).repartition(3)
    path = str(tmp_path / "m")
    df.write.format("npy").mode("append").option("file_bytes", 4000).save(path)
    names = [f for f in os.listdir(path) if f.endswith(".npy")]
    assert len(names) >= 6 and not any(f.startswith("_") for f in os.listdir(path))
    back = spark.read.format("npy").option("range_bytes", 2400).load(path)
    assert back.rdd.getNumPartitions() > len(names) / 2
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert sum(len(np.load(f"{path}/{f}")) for f in names) == 1000
    df.limit(10).write.format("npy").mode("overwrite").save(path)
    assert spark.read.format("npy").load(path).count() == 10
    df.limit(7).coalesce(1).write.format("npy").mode("append").save(path)
    assert spark.read.format("npy").load(path).count() == 17
    # One file of another program, in double precision and without keys.
    np.save(tmp_path / "own.npy", np.arange(12.0).reshape(4, 3))
    own = spark.read.format("npy").option("range_bytes", 48).load(str(tmp_path / "own.npy")).collect()
    assert [list(r["embedding"]) for r in own] == np.arange(12.0).reshape(4, 3).tolist() and own[0]["key"] is None
    empty = str(tmp_path / "empty")
    df.limit(0).write.format("npy").mode("append").save(empty)
    assert spark.read.format("npy").load(empty).count() == 0
    df.select("embedding").write.format("npy").mode("append").save(str(tmp_path / "bare"))
    assert spark.read.format("npy").load(str(tmp_path / "bare")).where("key is null").count() == 1000


def test_a_failed_npy_write_leaves_nothing(spark, tmp_path):
    npy.register(spark)
    path = str(tmp_path / "m")
    bad = spark.createDataFrame([("a", [1.0, 2.0])] * 50 + [("b", [1.0])], npy.SCHEMA).repartition(2)
    with pytest.raises(Exception, match="one length"):
        bad.write.format("npy").mode("append").option("file_bytes", 16).save(path)
    left = [f for _, _, names in os.walk(path) for f in names]
    assert left == []
    with pytest.raises(Exception, match="floats by rows"):
        np.save(tmp_path / "ints.npy", np.arange(4).reshape(2, 2))
        spark.read.format("npy").load(str(tmp_path / "ints.npy")).collect()


def test_sketches_of_parts_are_merged(spark):
    rng = random.Random(4)
    rows = [(rng.choice("abc"), int(rng.lognormvariate(5, 1))) for _ in range(30_000)]
    df = spark.createDataFrame(rows, "part string, n int").repartition(5)
    sketches = stats.length_sketches(df.where("part <> 'c'"), F.col("n"), "part")
    added = stats.length_sketches(df.where("part = 'c'"), F.col("n"), "part")
    whole = sketches.unionByName(added)
    assert {r["part"]: r["n"] for r in whole.collect()} == {p: sum(x[0] == p for x in rows) for p in "abc"}
    values = np.sort([x[1] for x in rows])
    for r in stats.sketched_quantiles(whole, [0.01, 0.1, 0.5, 0.9, 0.99]).collect():
        low, high = np.searchsorted(values, r["value"], "left") / len(values), np.searchsorted(values, r["value"], "right") / len(values)
        assert low - 0.01 <= r["rank"] <= high + 0.01, r
    few = spark.createDataFrame([("a", 5), ("a", None), ("b", 1), ("c", None)], "part string, n int")
    assert {r["rank"]: r["value"] for r in stats.sketched_quantiles(stats.length_sketches(few, F.col("n"), "part"), [0.0, 1.0]).collect()} == {0.0: 1, 1.0: 5}
    assert stats.sketched_quantiles(sketches.limit(0), [0.5]).count() == 0


def test_tally_is_counted_while_writing(spark, tmp_path):
    df = spark.createDataFrame([("C>>N",), ("C",), ("",), ("N>>C",)], "smarts string")
    out = str(tmp_path / "v")
    got = {r["valid"]: r["n"] for r in stages.tally_of(clean.validate(df), out).collect()}
    assert got == {True: 2, False: 2} and spark.read.parquet(out).count() == 4
    assert stages.tally_of(clean.validate(df.limit(0)), out).count() == 0


def test_hexagons_hold_every_point(spark):
    rng = random.Random(2)
    rows = [(rng.uniform(0, 10), rng.uniform(0, 5)) for _ in range(2000)] + [(None, 1.0)]
    got = {(r["lattice"], r["column"], r["row"]): r["n"] for r in stats.hexagons(spark.createDataFrame(rows, "x double, y double"), "x", "y", (0, 10, 0, 5), 20, 6).collect()}
    want = {}
    for x, y in rows[:-1]:
        u, v = x / 0.5, y / (5 / 6)
        centres = [(0, i, j, i, j) for i in range(22) for j in range(8)] + [(1, i, j, i + 0.5, j + 0.5) for i in range(22) for j in range(8)]
        best = min(centres, key=lambda c: (u - c[3]) ** 2 + 3 * (v - c[4]) ** 2)
        want[best[:3]] = want.get(best[:3], 0) + 1
    assert got == want


def test_quoted_line_feeds(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text('TEMPLATE_ID,TEMPLATE,VALID,REACTIONS\n1,"C>>\nN",True,"a;\nb"\n2,O,False,\n')
    rows = files.read_raw(spark, [str(path)], multi_line=True).orderBy("ord").collect()
    assert [(r["TEMPLATE"], r["REACTIONS"]) for r in rows] == [("C>>\nN", "a;\nb"), ("O", None)]


def test_dataset_from_files(spark, tmp_path):
    known = {"[PAD]": 0, "[UNK]": 1, "[BOS]": 2, "[EOS]": 3, "C": 4, ">>": 5}
    files.write_lines(spark.createDataFrame([("C>>C",), ("C>>N",)], "TEMPLATE string").coalesce(1), str(tmp_path / "lines"))
    import json

    (tmp_path / "v.json").write_text(json.dumps({"token_to_id": known}, indent=1))
    got = encode.dataset_from_files(spark, str(tmp_path / "v.json"), str(tmp_path / "lines"), 6, bos=True, eos=True).orderBy("ord").collect()
    assert [r["input_ids"] for r in got] == [[2, 4, 5, 4, 3, 0], [2, 4, 5, 1, 3, 0]]


def test_first_rows_and_counts_of_a_stream(spark, tmp_path):
    rng = random.Random(6)
    rows = [(f"t{rng.randint(0, 60)}", f"{k:05d}") for k in range(400)]
    for k in range(4):
        spark.createDataFrame(rows[k * 100 : (k + 1) * 100], "smarts string, ord string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "first")
    state.first_rows_of_files(spark, str(tmp_path / "in"), "smarts string, ord string", "smarts", "ord", out, partitions=2, files=1)
    got = spark.read.schema("smarts string, ord string, batch int").parquet(out).collect()
    want = {}
    for s, o in rows:
        want.setdefault(s, o)
    assert {r["smarts"]: r["ord"] for r in got} == want and len(got) == len(want) and len({r["batch"] for r in got}) > 1
    stream = spark.readStream.schema("smarts string, ord string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counts = state.running_counts(spark, stream, "smarts", str(tmp_path / "counts"), partitions=2)
    assert {r["smarts"]: r["freq"] for r in counts.collect()} == {s: sum(x[0] == s for x in rows) for s in want}
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_scratch_folders_of_a_step_are_removed(spark):
    from motifmill.scratch import removed_after, shared_folder, written

    before = written(spark.range(3), "kept")
    with removed_after(spark):
        inner = shared_folder(spark, "inner")
        spark.range(5).write.parquet(inner)
        assert spark.read.parquet(inner).count() == 5
    assert before.count() == 3
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(inner).count()


def test_first_rows_of_files_call_for_no_single_key(spark, tmp_path, monkeypatch):
    """Null keys too go out once; the keyed Python state, a call for each key and batch, is not used."""
    monkeypatch.setattr(state, "first_rows", None)
    parts = [[("a", "3"), ("a", "1"), (None, "2")], [("a", "0"), (None, "4"), ("b", "6"), ("b", "5")], [("b", "7"), ("c", "8")]]
    for part in parts:
        spark.createDataFrame(part, "smarts string, ord string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "first")
    state.first_rows_of_files(spark, str(tmp_path / "in"), "smarts string, ord string", "smarts", "ord", out, partitions=2, files=1)
    got = spark.read.schema("smarts string, ord string, batch int").parquet(out).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("a", "1", 0), (None, "2", 0), ("b", "5", 1), ("c", "8", 2)], key=str)
