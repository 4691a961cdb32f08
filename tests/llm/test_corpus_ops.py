"""Operators that compare documents, packing and the pipeline, against brute force."""

import hashlib
import importlib
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from motifmill.llm import common, license_scan, near_dedup, packing, substring_dedup
from motifmill.llm.components import components

VOCAB = [f"w{k}" for k in range(400)]


def _docs(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, n_words string, k1 int").repartition(3)


def _rows():
    """Clean texts, exact and near copies, shared passages, and the odd cases."""
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choices(VOCAB, k=rng.randint(1, 120)))) for k in range(60)]
    passage = " ".join(rng.choices(VOCAB, k=45))
    for k in range(60, 75):
        rows.append((k, " ".join(rng.choices(VOCAB, k=30)) + "\n" + passage + " " + " ".join(rng.choices(VOCAB, k=k - 55))))
    base = rng.choices(VOCAB, k=100)
    for k in range(75, 110):  # a chain and a cloud of near copies
        copy = list(base)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(100)] = rng.choice(VOCAB)
        rows.append((k, " ".join(copy)))
    for k in range(110, 118):
        base = base[4:] + rng.choices(VOCAB, k=4)
        rows.append((k, " ".join(base).upper() if k % 2 else " ".join(base)))
    rows += [(k, rows[3][1]) for k in range(120, 125)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "one"), (204, "ONE"), (205, "one two"), (206, "one two"), (206, "one two"), (207, "z " * 80)]
    return rows + [(None, "no id here"), (None, "no id here")]


# --- near duplicates ----------------------------------------------------------


def _groups(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set())
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            top[find(a)] = find(b)
    members = {}
    for k in range(len(rows)):
        members.setdefault(find(k), []).append(k)
    out = []
    for ks in members.values():
        ids = [rows[k][0] for k in ks if rows[k][0] is not None]
        out += [(rows[k][0], len(sets[k]), min(ids) if ids else None) for k in ks]
    return out


@pytest.mark.parametrize("block", [(256, 128), (3, 2)])
def test_near_duplicates_equal_all_pairs(spark, block):
    rows = _rows()
    out = near_dedup.near_duplicates(_docs(spark, rows), block=block).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((key((r["doc_id"], r["n_shingles"], r["component_id"])) for r in out)) == sorted(map(key, _groups(rows)))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_near_dedup_stage_keeps_one_row_of_each_group(spark):
    rng = random.Random(12)
    a, b, c, d, e = (rng.choices(VOCAB, k=90) for _ in range(5))
    near = lambda words: " ".join(["changed", *words[1:]])
    rows = [(1, " ".join(a))] * 3  # a repeated row
    rows += [(None, " ".join(b))] * 3  # the same without an id
    rows += [(2, " ".join(c)), (2, near(c))]  # near copies under one id
    rows += [(None, " ".join(d)), (None, near(d))]
    rows += [(4, " ".join(e)), (3, near(e)), (3, near(e)), (None, " ".join(e))]
    rows += [(3, " ".join(rng.choices(VOCAB, k=90))), (5, ""), (6, None), (None, "")]  # groups with the id of another, and no words
    docs = spark.createDataFrame([(i, t, f"s{k}", len(t or "")) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, source string, n_chars bigint").repartition(3)
    out = near_dedup.stage(spark, docs, "")
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    for words, ids in ((a, {1}), (b, {None}), (c, {2}), (d, {None}), (e, {3})):
        mine = {x: n for x, n in got.items() if x[1] in (" ".join(words), near(words))}
        assert sum(mine.values()) == 1 and {i for i, _ in mine} == ids
    assert got[rows[14]] == 1 and sum(got.values()) == 9 and {(5, ""), (6, None), (None, "")} <= set(got)
    # The next stage finds no copies and so drops no group whole.
    assert substring_dedup.stage(spark, out, "").count() == 9


def test_rows_sent_are_linear_in_a_large_group(spark, monkeypatch):
    """One text sent to a few blocks at most, also where a fifth of the group has no link in it."""
    sent = {}
    write = common.Scratch.write

    def counting(self, df, name):
        out = write(self, df, name)
        if name in ("asked", "blocks", "members"):
            sent[name] = out.count()
        return out

    monkeypatch.setattr(common.Scratch, "write", counting)
    rng = random.Random(5)
    base = rng.choices(VOCAB, k=150)
    for n in (150, 1800):
        rows = []
        for k in range(n):
            copy = list(base)
            for at in rng.sample(range(150), rng.randint(1, 24)):
                copy[at] = rng.choice(VOCAB)
            rows.append((k, " ".join(copy)))
        out = near_dedup.near_duplicates(_docs(spark, rows)).collect()
        assert sent["asked"] <= n and sent["blocks"] <= 6 * n, sent
        if n == 150:
            key = lambda r: tuple(-1 if x is None else x for x in r)
            assert sorted(key((r["doc_id"], r["n_shingles"], r["component_id"])) for r in out) == sorted(map(key, _groups(rows)))
            assert len({r["component_id"] for r in out}) > 15


def test_very_long_texts_are_compared_whole(spark):
    rng = random.Random(3)
    base = [f"v{rng.randrange(5000)}" for _ in range(30_000)]
    far = base[:20_000] + [f"u{rng.randrange(5000)}" for _ in range(10_000)]
    near = base[:29_000] + ["tail"] * 1000
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far)), (4, "short")]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(_docs(spark, rows)).collect()}
    assert got == {i: (n, c) for i, n, c in _groups(rows)} and got[2][1] == 1 and got[3][1] == 3


def test_intersections_are_exact():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 900, rng.integers(1, 300)).astype(np.uint64)) for _ in range(40)]
    block = near_dedup.Block(list(enumerate(sets)), 30)
    for own, a in enumerate(sets):
        both = near_dedup.intersections(a, block.shingles, block.owners, len(sets))
        assert both.tolist() == [len(np.intersect1d(a, b)) for b in sets]
        for x, y in block.ask(own, a):
            assert x == own != y and 100 * both[y] >= 30 * len(np.union1d(a, sets[y]))


def test_near_duplicates_of_an_empty_table(spark):
    assert near_dedup.near_duplicates(_docs(spark, _rows()).limit(0)).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    maker = near_dedup.MinMax()
    a = rng.integers(0, 1 << 62, 1000).astype(np.uint64)
    b = np.concatenate((a[:900], rng.integers(0, 1 << 62, 100).astype(np.uint64)))
    both = np.stack([maker.signature(a), maker.signature(b)])
    assert abs((both[0] == both[1]).mean() - 900 / 1100) < 0.08
    keys = near_dedup.band_keys(both)
    assert (keys[0] & 63).tolist() == list(range(48)) and (keys[0] == keys[1]).any()


def test_components(spark):
    rng = random.Random(0)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint"), common.Scratch(spark, "t"), "x").collect()}
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for n in sorted(near):
        todo = [n] if n not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = n
                todo += near[x]
    assert got == want


# --- substrings ---------------------------------------------------------------


def _cut(rows, n):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    count = Counter(tuple(w[k : k + n]) for w in words for k in range(len(w) - n + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = {p for k in range(len(w) - n + 1) if count[tuple(w[k : k + n])] > 1 for p in range(k, k + n)}
        out.append((-1 if i is None else i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out)


@pytest.mark.parametrize("n", [35, 8, 2])
def test_substring_dedup_equals_brute_force(spark, n):
    rows = _rows()
    out = substring_dedup.substring_dedup(_docs(spark, rows), n).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in out) == _cut(rows, n)


@pytest.mark.parametrize(("n", "want"), [(35, [9, 18, 35]), (140, [9, 18, 35, 70, 140]), (37, [10, 19, 37]), (18, [9, 18]), (10, [10]), (2, [2])])
def test_levels_double(spark, monkeypatch, n, want):
    assert substring_dedup.levels(n) == want
    written = []
    write = common.Scratch.write
    monkeypatch.setattr(common.Scratch, "write", lambda self, df, name: written.append(name) or write(self, df, name))
    rng = random.Random(n)
    passage = rng.choices(VOCAB, k=150)
    rows = [(k, " ".join(rng.choices(VOCAB, k=20) + passage + rng.choices(VOCAB, k=k))) for k in range(6)]
    rows.append((9, " ".join(passage[:139] + rng.choices(VOCAB, k=30))))  # survives all levels but the last of 140
    out = substring_dedup.substring_dedup(_docs(spark, rows), n).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in out) == _cut(rows, n)
    assert [x for x in written if x.startswith("level")] == [f"level{k}" for k in range(len(want) - 1)]
    # Without candidates the loop ends at once.
    written.clear()
    alone = [(k, " ".join(rng.choices([f"{v}{k}" for v in VOCAB], k=300))) for k in range(4)]
    assert all(r["n_removed"] == 0 for r in substring_dedup.substring_dedup(_docs(spark, alone), max(n, 16)).collect())
    assert sum(x.startswith("level") for x in written) <= 1


def test_substring_dedup_of_a_very_long_text(spark):
    rng = random.Random(2)
    words = rng.choices(VOCAB, k=60_000)
    rows = [(1, " ".join(words)), (2, " ".join(words[30_000:30_050])), (3, " ".join(words[100:140] + words[:34]))]
    out = substring_dedup.substring_dedup(_docs(spark, rows)).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in out) == _cut(rows, 35)


def test_substring_dedup_passes_columns_and_empty_tables(spark):
    df = _docs(spark, _rows())
    assert substring_dedup.substring_dedup(df, keep=("k1",)).columns == ["doc_id", "k1", "n_words", "n_removed", "kept_text"]
    assert substring_dedup.substring_dedup(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.substring_dedup(df, 1)


# --- license scans ------------------------------------------------------------


def _licenses(t, templates, percent=80):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    out = []
    for name, x in templates:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x.lower())
        own = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        size, stride = license_scan.window_sizes(len(own))
        if any(100 * len(own & set(grams[k : k + size])) >= percent * len(own) for k in range(0, len(grams), stride)):
            out.append(name)
    return sorted(out)


def test_license_scan_equals_all_windows(spark):
    known = license_scan.TEMPLATES
    rng = random.Random(6)
    rows = _rows()
    for k, (_, x) in enumerate(known):
        noise = " ".join(rng.choices(VOCAB, k=rng.randint(0, 90)))
        rows.append((300 + k, f"{noise}\n{x.upper()} {noise}"))
        w = x.split()
        w[len(w) // 2] = "changed"
        rows.append((320 + k, " ".join(w) + noise))
    rows.append((350, " ".join(x for _, x in known)))
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], [m["name"] for m in r["matches"]]) for r in license_scan.license_scan(_docs(spark, rows)).collect())
    assert got == sorted((-1 if i is None else i, _licenses(t, known)) for i, t in rows)
    # MinHash retrieves the same without the screen by exact shingles, also in a very long text.
    few = [r for r in rows if r[0] is not None and r[0] >= 300] + [(360, " ".join(rng.choices(VOCAB, k=20_000)) + " " + known[4][1])]
    alone = license_scan.license_scan(_docs(spark, few), screen=False).collect()
    assert sorted((r["doc_id"], [m["name"] for m in r["matches"]]) for r in alone) == sorted((i, _licenses(t, known)) for i, t in few)
    assert license_scan.license_scan(_docs(spark, rows).limit(0)).count() == 0
    with pytest.raises(ValueError):
        license_scan.license_scan(_docs(spark, rows), [("short", "only four words here")])


# --- packing ------------------------------------------------------------------


def _plain(lengths, costs, limit):
    """Best fit with a list of bins; of equal spaces the bin that was filled last."""
    bins = []
    for turn, n in enumerate(lengths):
        fits = [b for b in bins if b[0] - b[1] >= n]
        if fits:
            tight = min(b[0] - b[1] for b in fits)
            best = max((b for b in fits if b[0] - b[1] == tight), key=lambda b: b[2])
        else:
            able = [c for c in costs if n <= c <= max(limit, min(x for x in costs if x >= n))]
            best = [min(able, key=lambda c: (costs[c] / c, c)), 0, turn]
            bins.append(best)
        best[1] += n
        best[2] = turn
    return sorted(b[1] for b in bins)


def test_best_fit_equals_a_plain_one():
    rng = random.Random(0)
    costs = {8: 10.0, 16: 17.0, 40: 41.0}
    for _ in range(100):
        lengths = sorted((rng.randint(1, 40) for _ in range(rng.randint(0, 60))), reverse=True)
        plans = []
        for limit in costs:
            where, final, used = packing.best_fit(lengths, costs, limit)
            assert sorted(used) == _plain(lengths, costs, limit)
            assert Counter(where) == Counter({b: where.count(b) for b in range(len(used))}) and sum(used) == sum(lengths)
            assert all(f == min(c for c in costs if c >= u) for f, u in zip(final, used))
            plans.append(sum(costs[c] for c in final))
        assert sum(costs[c] for c in packing.pack(lengths, costs)[1]) == min(plans, default=0)


def test_packing_places_every_token_once(spark):
    rows = [(k, n) for k, n in enumerate([1, 5, 5, 16, 17, 39, 40, 41, 95, 3, 3, 3])] + [(5, 39), (None, 7), (None, 7)]
    items = spark.createDataFrame([(*r, 9) for r in rows], "doc_id bigint, n_tokens int, shard int")
    got = packing.pack_lengths(items, {8: 10.0, 16: 17.0, 40: 41.0}, shard_pieces=6).collect()
    total = Counter()
    for r in got:
        total[r["doc_id"]] += r["piece_length"]
    assert total == Counter({5: 78, None: 14} | {k: n for k, n in rows if k is not None and k != 5})
    bins = {}
    for r in got:
        bins.setdefault(r["bin_id"], []).append(r)
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r["bin_offset"]):
            assert r["bin_offset"] == at
            at += r["piece_length"]
        assert at == own[0]["bin_used"] <= own[0]["bin_capacity"]
    assert packing.pack_lengths(items.limit(0)).count() == 0
    texts = spark.createDataFrame([(1, None), (2, ""), (3, "a b\tc")], "doc_id int, text string")
    assert [r["n_tokens"] for r in packing.word_lengths(texts).orderBy("doc_id").collect()] == [1, 1, 4]


def test_packing_keeps_large_ids_beside_a_null_id(spark):
    ids = [9007199254740993, 9007199254740995, None, 9223372036854775807, -9007199254740993]
    items = spark.createDataFrame([(i, 10 + k) for k, i in enumerate(ids)], "doc_id bigint, n_tokens int")
    got = packing.pack_lengths(items, {64: 66.0}).collect()
    assert Counter((r["doc_id"], r["piece_length"]) for r in got) == Counter((i, 10 + k) for k, i in enumerate(ids))


def test_packing_spreads_one_id_over_shards(spark):
    one = spark.range(100_000).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit(300).alias("n_tokens"))
    none = spark.range(20_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(40).alias("n_tokens"))
    got = packing.pack_lengths(one.unionByName(none), {512: 544.0, 1024: 1056.0}, shard_pieces=4096)
    shards = got.groupBy(F.shiftright("bin_id", 32).alias("shard")).count().collect()
    assert sum(r["count"] for r in shards) == 120_000 and len(shards) == 30 and max(r["count"] for r in shards) < 2 * 4096
    bins = got.groupBy("bin_id").agg(F.sum("piece_length").alias("x"), F.first("bin_used").alias("u"), F.first("bin_capacity").alias("c"), F.count_distinct("bin_offset").alias("o"), F.count(F.lit(1)).alias("n"))
    assert bins.where("x <> u or u > c or o <> n").count() == 0


# --- pipeline -----------------------------------------------------------------


def _sf(tmp_path, spark):
    rng = random.Random(8)
    rows = [r for r in _rows() if r[0] is not None]
    rows += [(400 + k, " ".join(rng.choices(VOCAB, k=60)) if k % 2 else " ".join(x + "###" for x in rng.choices(VOCAB, k=60))) for k in range(160)]
    item = " ".join(rng.choices(VOCAB, k=12))
    rows.append((600, rows[5][1] + " " + item + " " + " ".join(rng.choices(VOCAB, k=60))))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(400 + k, k % 2, 0) for k in range(160)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_pipeline_stages_on_their_own_input(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    sf = _sf(tmp_path / "sf", spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        columns = docs.columns
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = docs.collect()
        if k < len(pipeline.STAGES) - 1:
            assert docs.columns == columns
            kept = Counter((r["doc_id"], r["text"]) for r in after)
        if name == "quality":
            bad = {400 + k for k in range(0, 160, 2)}
            assert not bad & {i for i, _ in kept} and {400 + k for k in range(1, 160, 2)} <= {i for i, _ in kept}
        elif name == "near_dedup":
            want = Counter((i, t) for (i, t), (_, _, c) in zip(before, _in_order(before)) if i == c)
            assert kept == want
        elif name == "substring_dedup":
            want = Counter((i, x if r else t) for (i, t), (x, r, n) in zip(before, _cut_in_order(before)) if not n or r < n)
            assert kept == want
            assert all(r["n_chars"] == len(r["text"] or "") for r in after)
        elif name == "decontaminate":
            assert 600 not in {i for i, _ in kept} and len(after) == len(before) - 1
        else:
            assert {r["doc_id"] for r in after} == {i for i, _ in before}
            assert sum(r["piece_length"] for r in after) == sum(len((t or "").split()) + 1 for _, t in before)
    assert pipeline.ORACLE_SQL is None and pipeline.run(spark, sf).count() == len(after)


def test_pipeline_with_nulls_repeated_rows_and_an_empty_table(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    sf = _sf(tmp_path / "sf", spark)
    rng = random.Random(1)
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id >= 400").withColumn("k1", F.lit("mine"))
    lone = " ".join(rng.choices(VOCAB, k=70))
    odd = spark.createDataFrame([(None, lone, "en", "s", 1, "x")] * 3 + [(7, None, "en", "s", 0, "x"), (8, "", "en", "s", 0, "x"), (None, None, None, None, None, "x")], docs.schema)
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs.unionByName(odd), sf)
        assert out.columns == docs.columns
        kept = [r["doc_id"] for r in out.collect() if r["text"] == lone]
        assert kept == ([None] if name == "near_dedup" else [] if name == "substring_dedup" else [None] * 3), name
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert pipeline.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0


CLASHES = "score n_words n_hit n_removed kept_text item_ids spans k1 k2 t t1 i leads n h g p row label passed_0 passed_3".split()


def test_stages_pass_columns_of_any_name(spark, tmp_path):
    pipeline = importlib.import_module("corpus_pipeline")
    sf = _sf(tmp_path / "sf", spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = docs.withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in CLASHES})
    for name, stage in pipeline.STAGES[:-1]:
        plain, out = stage(spark, docs, sf), stage(spark, more, sf)
        assert out.columns == more.columns, name
        rows = out.collect()
        assert all(r[c] == f"{c} of {r['doc_id']}" for r in rows for c in CLASHES), name
        assert sorted(map(str, plain.collect())) == sorted(str(r) for r in out.select(docs.columns).collect()), name
    assert pipeline.STAGES[-1][1](spark, more, sf).count() == pipeline.STAGES[-1][1](spark, docs, sf).count()


def _in_order(rows):
    left = Counter()
    by = {}
    for r in _groups(rows):
        by.setdefault(r[0], []).append(r)
    out = []
    for i, _ in rows:
        out.append(by[i][left[i]])
        left[i] += 1
    return out


def _cut_in_order(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    count = Counter(tuple(w[k : k + 35]) for w in words for k in range(len(w) - 34))
    out = []
    for w in words:
        gone = {p for k in range(len(w) - 34) if count[tuple(w[k : k + 35])] > 1 for p in range(k, k + 35)}
        out.append((" ".join(x for p, x in enumerate(w) if p not in gone), len(gone), len(w)))
    return out


def test_queries_and_sql_have_the_same_names(spark):
    from motifmill.llm import queries

    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) and len(queries.QUERIES) == 13
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit("").cast("binary"), 256)).first()[0]
