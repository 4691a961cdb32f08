"""Labels, splits, masking, encoder, similarity, statistics, metrics, streams."""

import hashlib
import json

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from motifmill import cli
from motifmill.operators import classify, clean, encoder, labels, masking, metrics, similarity, splits, stats, subword, train
from motifmill.plans.catalog import QUERIES
from motifmill.streaming import templates as streams

KNOWN = {t: k for k, t in enumerate(["[PAD]", "[UNK]", "[BOS]", "[EOS]", "C", "N", "O", ">>", "(", ")", "=", "."])}


def _labelled(spark, sizes, per_group=1):
    rows = [(f"s{y}-{k}", y, f"g{y}-{k // per_group}") for y, n in sizes.items() for k in range(n)]
    return spark.createDataFrame(rows, "smarts string, label string, group string").repartition(4)


def test_labels_and_rare_classes(spark):
    raw = spark.createDataFrame([(k, f"t{k}", "TRUE", "1.1" if k < 15 else "2.1") for k in range(17)] + [(17, "t0", "TRUE", "9.9"), (18, "t20", "FALSE", "1.1")], "ord int, TEMPLATE string, VALID string, ECS string")
    validated = raw.select(F.col("TEMPLATE").alias("smarts"), F.lit(None).cast("string").alias("reaction_group")).distinct()
    rows, n = labels.load_labelled(raw, validated)
    assert n == 15 and {r["label"] for r in rows.collect()} == {"1"} and rows.where("`group` <> smarts").count() == 0
    few, n = labels.load_labelled(raw.where("ord < 15"), validated, n_samples=5)
    assert n == 15 and few.count() == 5
    assert labels.min_class_count(0, 5) == 10 and labels.min_class_count(100, 50) == 10 and labels.min_class_count(100, 500) == 52


def test_stratified_sample_is_the_same_for_any_partitioning(spark):
    df = _labelled(spark, {"a": 100, "b": 50, "c": 3})
    one = sorted(r["smarts"] for r in labels.stratified_sample(df, 30).collect())
    many = sorted(r["smarts"] for r in labels.stratified_sample(df.repartition(7), 30).collect())
    assert one == many and len(one) == 19 + 9 + 1


@pytest.mark.parametrize("split", [splits.group_holdout, splits.stratified_group_holdout])
def test_group_splits(spark, split):
    df = _labelled(spark, {"0": 140, "1": 40, "2": 20}, 2)
    out = split(df, 0.2, 42)
    assert out.count() == 200 and splits.leaking_groups(out).count() == 0
    assert 0.1 < out.where("split = 'test'").count() / 200 < 0.3
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, split(df.repartition(1), 0.2, 42).collect()))
    with pytest.raises(ValueError):
        split(df, 1.0)


def test_random_holdout_and_folds(spark):
    df = spark.range(50).toDF("k")
    assert splits.random_holdout(df, 0.1, 1, "k").where("split = 'val'").count() == 5
    assert splits.random_holdout(df, 0.001, 1, "k").where("split = 'val'").count() == 1
    folds = splits.group_folds(_labelled(spark, {"a": 60}, 3), 5)
    assert folds.groupBy("group").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    first = [r["k"] for r in splits.epoch_order(df, 1, 0, "k").collect()]
    assert first != [r["k"] for r in splits.epoch_order(df, 1, 1, "k").collect()] and sorted(first) == list(range(50))


def test_span_masks(spark):
    masker = masking.SpanMasker(KNOWN)
    assert masker.mask_id == 12 and masker.extended_size == 13
    assert masker.content_ids == {KNOWN[t] for t in "CNO="}
    ids, mask = [4, 5, 6, 7, 4, 5, 6, 10] * 2 + [0] * 4, [1] * 16 + [0] * 4
    df = spark.createDataFrame([(k, ids, mask) for k in range(200)], "k int, input_ids array<bigint>, attention_mask array<bigint>")
    rows = masking.span_mask(df, masker, "k").collect()
    again = masking.span_mask(df.repartition(5), masker, "k").collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    kinds = {"mask": 0, "other": 0, "same": 0}
    for r in rows:
        at = [p for p, x in enumerate(r["labels"]) if x != -100]
        assert len(at) == 4 and max(at) < 16 and all(r["labels"][p] == ids[p] for p in at)
        assert all(r["input_ids"][p] == ids[p] for p in range(20) if p not in at)
        for p in at:
            x = r["input_ids"][p]
            kinds["mask" if x == 12 else "same" if x == ids[p] else "other"] += 1
    assert 0.72 < kinds["mask"] / 800 < 0.88 and kinds["other"] and kinds["same"]
    every = masking.SpanMasker(KNOWN, share=1.0, mean_span=16, max_span=16)
    labels_ = np.array(masking.span_mask(df.limit(1), every, "k", 1).first()["labels"])
    assert (labels_[:16] != -100).all() and (labels_[16:] == -100).all()
    none = spark.createDataFrame([(1, ids, [0] * 20)], df.schema)
    row = masking.span_mask(none, masker, "k", 1).first()
    assert set(row["labels"]) == {-100} and row["input_ids"] == ids


def _embedder(pooling="mean"):
    config = encoder.EncoderConfig(len(KNOWN), 32, 4, 2, 64, max_seq_len=16)
    return encoder.Embedder(config, encoder.random_weights(config), KNOWN, pooling)


def test_embedding_does_not_depend_on_batches_or_padding(spark, tmp_path):
    texts = ["CC>>N", "C=O", "N", "C(N)O>>CN", "C?", ""]
    df = spark.createDataFrame([(t,) for t in texts], "smarts string")
    model = _embedder()
    got = {r["smarts"]: r["embedding"] for r in model.transform(df, batch_size=1).collect()}
    more = {r["smarts"]: r["embedding"] for r in model.transform(df.coalesce(1), batch_size=64).collect()}
    assert got["C?"] is None and got[""] is None
    for t in texts[:4]:
        assert np.allclose(got[t], more[t], atol=1e-5) and np.allclose(got[t], model.predict(t), atol=1e-5)
    assert model.predict(texts[:3]).shape == (3, 32) and model.predict([]).shape == (0, 32)
    assert not np.allclose(model.predict("CC>>N"), _embedder("cls").predict("CC>>N"))
    with pytest.raises(ValueError):
        _embedder("max")
    with pytest.raises(ValueError):
        model.predict("C", max_length=17)
    model.save(str(tmp_path / "encoder_1.npz"))
    (tmp_path / "vocab.json").write_text(json.dumps({"token_to_id": KNOWN}))
    assert np.allclose(encoder.Embedder.load(encoder.latest_checkpoint(str(tmp_path))[0]).predict("CN"), model.predict("CN"))
    with pytest.raises(FileNotFoundError):
        encoder.latest_checkpoint(str(tmp_path / "none"))


def test_parameter_counts():
    assert encoder.parameter_count(encoder.EncoderConfig(4466, 256, 8, 6, 1024, max_seq_len=256)) == 7_161_458
    assert encoder.parameter_count(encoder.EncoderConfig(4466, 512, 8, 8, 2048, max_seq_len=512)) == 30_322_546


def test_command_line(tmp_path, capsys):
    _embedder().save(str(tmp_path / "encoder_1.npz"))
    (tmp_path / "vocab.json").write_text(json.dumps({"token_to_id": KNOWN}))
    assert cli.main(["CN", "C=O", "--models", str(tmp_path)]) == 0
    assert [r["smarts"] for r in json.loads(capsys.readouterr().out)] == ["CN", "C=O"]
    (tmp_path / "in.txt").write_text("CN\n\n C=O \n")
    out = tmp_path / "deep" / "out.csv"
    assert cli.main(["-f", str(tmp_path / "in.txt"), "--models", str(tmp_path), "-o", str(out)]) == 0
    assert out.read_text().startswith("smarts,dim_0,") and len(out.read_text().splitlines()) == 3
    for bad in (["CN", "-f", "x"], ["CN", "--format", "npy"]):
        with pytest.raises(SystemExit):
            cli.main([*bad, "--models", str(tmp_path)])


def test_search(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 8))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(4)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = [int(k) for k in np.argsort(-(unit @ unit[3])) if k != 3]
    got = similarity.top_k(df, x[3].tolist(), 5, "vec_id", exclude=3).collect()
    assert [r["vec_id"] for r in got] == want[:5] and [r["rank"] for r in got] == [1, 2, 3, 4, 5]
    assert similarity.top_k(df, x[3].tolist(), 100, "vec_id").count() == 40
    many = similarity.search(df, df.where("vec_id < 10"), 3, block=4)
    assert [r["neighbour"] for r in many.where("query = 3").orderBy("rank").collect()] == want[:3] and many.count() == 30
    assert similarity.pairwise_cosine(df.limit(5)).count() == 10


def test_spearman_with_ties(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0), (2.0, 5.0), (4.0, 9.0)], "x double, y double")
    # Ranks 1, 2.5, 2.5, 4 and 1.5, 1.5, 3, 4.
    assert abs(similarity.spearman(df, "x", "y").first()[0] - np.corrcoef([1, 2.5, 2.5, 4], [1.5, 1.5, 3, 4])[0, 1]) < 1e-9


def test_statistics(spark):
    df = spark.createDataFrame([(v,) for v in range(1, 101)], "n int")
    r = stats.length_distribution(df, F.col("n"), (50,)).first()
    assert (r["min"], r["max"], r["median"], r["n_le_50"], r["pct_le_50"]) == (1, 100, 50.5, 50, 50.0)
    h = {x["bin"]: x["n"] for x in stats.histogram(df.select(F.col("n").cast("double").alias("v")), "v", 0.0, 100.0, 10).collect()}
    assert sum(h.values()) == 100 and h[9] == 11


def test_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "label string, predicted string")
    got = {r["label"]: r for r in metrics.class_metrics(df).collect()}
    assert got["a"]["precision"] == 1 and got["a"]["recall"] == 0.5 and got["c"]["f1"] == 0 and got["b"]["support"] == 1
    assert metrics.summary_metrics(df).first()["accuracy"] == 0.5
    rows = spark.createDataFrame([([-100, 4, 5], [[1, 2], [4, 9], [9, 5]])], "labels array<bigint>, guesses array<array<bigint>>")
    m = metrics.masked_accuracy(rows, {5}).first()
    assert (m["top1"], m["top5"], m["content_top1"], m["content_top5"]) == (0.5, 1.0, 0.0, 1.0)
    assert metrics.masked_accuracy(rows.limit(0), {5}).first()["top1"] == 0.0
    history = spark.createDataFrame([(1, 0.5), (2, 0.3), (3, 0.3)], "epoch int, val_loss double")
    assert metrics.best_epoch(history).first()["epoch"] == 2
    steps = [r["factor"] for r in metrics.schedule(spark, 20, 5).orderBy("step").collect()]
    assert np.allclose(steps[:6], [0, 0.2, 0.4, 0.6, 0.8, 1]) and np.allclose(steps[5:], (1 + np.cos(np.arange(15) / 15 * np.pi)) / 2)


def test_projection_and_classifier(spark):
    rng = np.random.default_rng(1)
    rows = [(k, (rng.normal(size=4) + 3 * (k % 2)).tolist(), str(k % 2)) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>, label string")
    out, explained = classify.pca(df)
    means = np.mean([r["projection"] for r in out.collect()], axis=0)
    assert np.allclose(means, 0, atol=1e-6) and explained[0] > explained[1]
    ready = classify.vectors(classify.label_index(df))
    got = classify.cross_validate(ready, 3, 42, "vec_id", scale=True)
    assert got.count() == 60 and got.where("label_id = predicted").count() > 55


def test_subwords(spark):
    public = pytest.importorskip("public_tokenizers")
    model = subword.Subwords(public.path("piece_bpe_32k.model"))
    df = spark.createDataFrame([("hello there",), (None,), ("",)], "s string")
    got = df.select("s", model.pieces(F.col("s")).alias("p"), model.ids(F.col("s"), bos=True).alias("i")).withColumn("t", model.text(F.col("i"))).collect()
    by = {r["s"]: r for r in got}
    assert by["hello there"]["t"] == "hello there" and by["hello there"]["i"][0] == 1 and by[None]["p"] is None and model.vocab_size == 32000


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("TEMPLATE_ID,TEMPLATE,VALID,REACTIONS\n1,C>>N,TRUE,r\n2,C=O,false,r\n3,C?,TRUE,r\n")
    rows = streams.encode_stream(streams.clean_stream(streams.template_stream(spark, str(tmp_path / "in"))), KNOWN, 4)
    q = rows.writeStream.format("memory").queryName("encoded").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["smarts"]: r["input_ids"] for r in spark.table("encoded").collect()}
    assert got == {"C>>N": [4, 7, 5, 0], "C?": [0, 0, 0, 0]}


def test_token_rate_by_window(spark, tmp_path):
    rows = [("2024-01-01 00:00:10", "C>>N"), ("2024-01-01 00:00:50", "C?"), ("2024-01-01 00:01:05", "CC")]
    df = spark.createDataFrame(rows, "at string, smarts string").select(F.to_timestamp("at").alias("at"), "smarts")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streams.token_rate(stream, "at", "smarts").writeStream.format("memory").queryName("rates").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = [(r["rows"], r["tokens"], r["failed"]) for r in spark.table("rates").orderBy("window").collect()]
    assert got == [(2, 3, 1), (1, 2, 0)]


def test_stratified_groups_are_dealt_as_by_one_window(spark):
    rows = [(f"g{k % 60}", str(k % 7 % 3)) for k in range(900)]
    df = spark.createDataFrame(rows, "group string, label string").repartition(6)
    got = {r["group"]: r["split"] for r in splits.stratified_group_holdout(df, 0.25, 3).distinct().collect()}
    by = {}
    for g, y in rows:
        by.setdefault(g, []).append(y)
    mains = {}
    for g, ys in by.items():
        mains.setdefault(max((ys.count(y), y) for y in set(ys))[1], []).append(g)
    want = {}
    for own in mains.values():
        own.sort(key=lambda g: (-len(by[g]), hashlib.md5(f"3:{g}".encode()).hexdigest(), g))
        for k, g in enumerate(own):
            want[g] = "test" if (k % 4 if k // 4 % 2 == 0 else 3 - k % 4) == 0 else "train"
    assert got == want


def test_holdout_is_exact_at_every_count(spark):
    df = spark.range(300).withColumnRenamed("id", "k").repartition(5)
    for share in (0.001, 0.1, 0.5, 0.999):
        got = splits.random_holdout(df, share, 1, "k")
        first = sorted(range(300), key=lambda k: hashlib.md5(f"1:{k}".encode()).hexdigest())[: max(1, int(300 * share))]
        assert {r["k"] for r in got.where("split = 'val'").collect()} == set(first)
    assert splits.group_holdout(df.limit(0), 0.2, 1, "k").count() == 0


def test_search_by_blocks_of_bytes(spark):
    df = spark.createDataFrame([(k, [float(k % 7), 1.0, float(k)]) for k in range(40)], "vec_id bigint, embedding array<double>").repartition(3)
    pairs = lambda out: sorted((r["query"], r["neighbour"], round(r["similarity"], 9)) for r in out.collect())
    whole = pairs(similarity.against(df, df.where("vec_id % 3 = 0")))
    assert whole == pairs(similarity.against(df, df.where("vec_id % 3 = 0"), block=2, block_bytes=100)) and len(whole) == 14 * 39
    assert similarity.against(df, df.limit(0)).count() == 0


def test_random_features_do_not_depend_on_partitions(spark):
    df = spark.range(2000).withColumnRenamed("id", "vec_id")
    a, b = (np.array([r["embedding"] for r in classify.random_features(x, 3).orderBy("vec_id").collect()]) for x in (df.repartition(2), df.repartition(7)))
    assert np.array_equal(a, b) and abs(a.mean()) < 0.05 and abs(a.std() - 1) < 0.05


def test_lookup_default(spark):
    df = spark.createDataFrame([("1",), ("2",), (None,)], "label string")
    assert [r["x"] for r in labels.lookup(df, {"1": "one"}, "label", "x", "?").collect()] == ["one", "?", "?"]
    assert [r["x"] for r in labels.lookup(df, {}, "label", "x").collect()] == ["", "", ""]


def _tiny():
    masker = masking.SpanMasker(KNOWN)
    config = encoder.EncoderConfig(masker.extended_size, d_model=8, nhead=2, num_encoder_layers=2, dim_feedforward=12, max_seq_len=8)
    return masker, config, {k: v.astype(np.float64) for k, v in encoder.random_weights(config, 3).items()}


def test_training_gradients_equal_differences():
    _, config, w = _tiny()
    rng = np.random.default_rng(0)
    ids, mask = rng.integers(1, 13, (3, 6)), np.ones((3, 6), np.int64)
    mask[1, 4:], ids[1, 4:] = 0, 0
    labels = np.where((rng.random((3, 6)) < 0.4) & (mask == 1), rng.integers(4, 12, (3, 6)), masking.IGNORE)
    labels[0, 0] = 5
    loss, scores, g = train.loss_and_gradients(config, w, ids, mask, labels)
    hidden = encoder.forward(config, w, ids, mask)[labels != masking.IGNORE]
    assert np.allclose(scores, encoder.head(w, hidden), atol=1e-4) and set(g) == set(w)
    for name in w:
        at = tuple(rng.integers(0, n) for n in w[name].shape) if name != "token" else (int(ids[0, 0]), 1)
        moved = [dict(w, **{name: w[name].copy()}) for _ in range(2)]
        for m, step in zip(moved, (1e-5, -1e-5)):
            m[name][at] += step
        plus, minus = (train.loss_and_gradients(config, m, ids, mask, labels)[0] for m in moved)
        assert abs((plus - minus) / 2e-5 - g[name][at]) < 1e-5, name


def test_trainer_learns_and_model_is_evaluated(spark):
    masker, config, w = _tiny()
    rows = [(f"{k}", (ids := [KNOWN[c] for c in ["C", "N", ">>", "O"][: 3 + k % 2]]) + [0] * (8 - len(ids)), [1] * len(ids) + [0] * (8 - len(ids))) for k in range(120)]
    runs = []
    for _ in range(2):
        trainer = train.Trainer(config, masker, epochs=8, batch=16, rate=5e-3)
        runs.append((trainer.fit(rows), trainer.history))
    (weights, history), (again, _) = runs
    assert all(np.array_equal(weights[k], again[k]) for k in weights)
    assert history[-1]["val_loss"] < 0.5 * history[0]["train_loss"] and history[-1]["top1"] > 0.7
    df = spark.createDataFrame(rows, "smarts string, input_ids array<bigint>, attention_mask array<bigint>").repartition(3)
    out = metrics.masked_accuracy(train.guesses(masking.span_mask(df, masker, "smarts"), config, weights), masker.content_ids).first()
    assert out["top1"] > 0.7 and out["top5"] >= out["top1"]
    assert train.train(df, train.Trainer(config, masker, epochs=1), max_rows=30).keys() == weights.keys()
    assert train.Trainer(config, masker, epochs=1).fit([])["token"].shape == w["token"].shape


def test_similarities_go_out_in_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(similarity, "PAIRS", 64)
    monkeypatch.setattr(similarity, "CELL_PAIRS", 400)
    rows = [(i, [float(i % 7) - 3, float(i % 5), 1.0]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    out = similarity.against(df, df.where("vec_id % 20 = 0"), block=16)
    assert out.rdd.getNumPartitions() == 5  # 10 queries on 200 rows, 400 to a cell
    got = {(r["query"], r["neighbour"]): r["similarity"] for r in out.collect()}
    m = np.array([v for _, v in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    assert len(got) == 10 * 199 and all(abs(s - m[a] @ m[b]) < 1e-12 for (a, b), s in got.items())
    best = {(r["query"], r["rank"]): r["neighbour"] for r in similarity.search(df, df.where("vec_id % 20 = 0"), 4, block=16).collect()}
    for a in range(0, 200, 20):
        order = sorted((i for i in range(200) if i != a), key=lambda i: (-got[a, i], i))[:4]
        assert [got[a, best[a, k + 1]] for k in range(4)] == [got[a, i] for i in order]


def test_contenders_keep_groups_and_labels(spark):
    """Few rows of a template are left; its first valid and first labelled row are among them, blanks, nulls and ties too."""
    kinds = ["C", " C", "N ", "N", "  ", None, "O"]
    rows = [((None if i == 5 else i // 3, i), kinds[i % 7], ["TRUE", "False", "true"][i % 3], [None, " ", f"R{i}"][i % 5 % 3], [None, " ;1.1", "1.2.3;4.5", f"{i % 6}.1"][i % 4 if i > 40 else 0]) for i in range(400)]
    raw = spark.createDataFrame(rows, "ord struct<o1: bigint, o2: bigint>, TEMPLATE string, VALID string, REACTIONS string, ECS string").repartition(3)
    few = labels.contenders(raw, "ord.o1")
    assert 0 < few.count() < 30
    for f in (clean.reaction_groups, labels.label_map):
        assert sorted(map(tuple, f(few).collect())) == sorted(map(tuple, f(raw).collect()))


def test_rounded_similarities_leave_sorted(spark, monkeypatch):
    monkeypatch.setattr(similarity, "PAIRS", 64)
    monkeypatch.setattr(similarity, "CACHED", 48)
    monkeypatch.setattr(similarity, "SORTED", 400)
    rows = [(i, [float(i % 7) - 3, float(i % 5) - 2, float(i % 3) - 1]) for i in range(1, 300)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    out = similarity.against(df, df.where("vec_id % 9 = 0"), digits=2, block_bytes=1200)
    got = {(r["query"], r["neighbour"]): r["similarity"] for r in out.collect()}
    exact = {(r["query"], r["neighbour"]): r["similarity"] for r in similarity.against(df, df.where("vec_id % 9 = 0")).collect()}
    assert out.count() == len(got) == 33 * 298 and got.keys() == exact.keys()
    assert all(abs(s - exact[p]) <= 0.005 + 1e-12 and s == round(s, 2) for p, s in got.items())
    assert similarity.against(df, df, digits=2, exclude_self=False).count() == 299**2
    assert similarity.against(df, df.limit(0), digits=2).count() == 0
    half = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0]), (1, [1.0] * 4), (2, [-1.0] * 4), (3, [-0.01, 1.0, 0.0, 0.0])], "vec_id bigint, embedding array<double>")
    assert {r["neighbour"]: str(r["similarity"]) for r in similarity.against(half, half.where("vec_id = 0"), digits=0).collect()} == {1: "1.0", 2: "-1.0", 3: "0.0"}
    with pytest.raises(ValueError):
        similarity.against(df, df, 3, digits=2)


def test_all_similarities_take_few_bytes_when_stored(spark, tmp_path):
    m = 1 + 0.6 * np.random.default_rng(0).standard_normal((16_384, 16))
    pq.write_table(pa.table({"vec_id": np.arange(len(m)), "embedding": list(m), "label": np.zeros(len(m), np.int32)}), tmp_path / "embeddings.parquet")
    QUERIES["cosine_against_all"](spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    out = pq.read_table(tmp_path / "out")
    assert out.num_rows == 328 * (len(m) - 1)
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 6.5 * out.num_rows
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    a, b, s = (out[c].to_numpy() for c in ("a", "b", "similarity"))
    assert len(np.unique(a * len(m) + b)) == len(a) and (a != b).all() and (a % 50 == 0).all()
    assert all(np.abs(s[a == q] - unit[b[a == q]] @ unit[q]).max() < 5.001e-7 for q in range(0, len(m), 2_000))
