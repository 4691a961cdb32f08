"""Cleaning, tokenizer, structure, vocabulary and encoding."""

import json

import pytest
from pyspark.sql import functions as F

from motifmill.functions import tokenizer
from motifmill.functions.ec import primary_ec
from motifmill.operators import clean, encode, vocab
from motifmill.sources import files

# One string or more for each rule of the grammar.
ROUND_TRIP = [
    "[S;X2:7]#[B;D3:4].[P;v5]>>[S;X2:7]~[B;D3:4]",  # atoms in brackets, bonds, components
    "((I.[F;H0:12]))>>(I).(F)",  # parentheses
    "o1cc2sccc2n1>>O=P",  # ring digits, aromatic atoms
    "[$([N;!R]-[$(S(=O))]);+:3]>>N",  # brackets in brackets
    "BrBClCBr",  # two letters before one
    "N%23OS%07N",  # two-digit rings
    "N/C=C\\S",
    "O/?S\\?P",
    "P>S>N",  # agents between single arrows
    "[#6,!#7;r5]&N!S,P;O",
    "*:*@a~A",
    "",
    "[[[[[[[[[[[C]]]]]]]]]]]>>N",
]
BROKEN = ["[C;H1", "C?N", "not_a_smarts", "C]", "[[C]"]


def test_tokens_of_column_and_scanner_agree(spark):
    df = spark.createDataFrame([(t,) for t in ROUND_TRIP + BROKEN], "smarts string")
    got = {r["smarts"]: (r["tokens"], r["ok"]) for r in tokenizer.with_tokens(df, "smarts").collect()}
    for t in ROUND_TRIP:
        assert got[t] == (tokenizer.scan(t), True)
        assert "".join(got[t][0]) == t
    for t in BROKEN:
        assert got[t] == ([], False)
        with pytest.raises(ValueError):
            tokenizer.scan(t)
    assert got["O/?S\\?P"][0] == ["O", "/?", "S", "\\?", "P"] and got["[$([N;!R]-[$(S(=O))]);+:3]>>N"][0][0] == "[$([N;!R]-[$(S(=O))]);+:3]"


def _raw(spark, rows):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "ord int, TEMPLATE_ID string, TEMPLATE string, VALID string, REACTIONS string")
    return df.repartition(3)


def test_clean_keeps_the_first_valid_row_and_its_group(spark):
    raw = _raw(spark, [("1", "a", "False", "X"), ("2", "a", "true", "RHEA:1"), ("3", "\ta ", "TRUE", "RHEA:2"), ("4", "  ", "TRUE", "R"), ("5", None, "TRUE", "R"), ("6", "b", "True", " "), ("7", "c", None, "R")])
    assert sorted(r["TEMPLATE"] for r in clean.clean(raw).collect()) == ["a", "b"]
    groups = {r["smarts"]: r["reaction_group"] for r in clean.reaction_groups(raw).collect()}
    assert groups == {"a": "RHEA:1", "b": "b"}
    rows = spark.createDataFrame([("a",), ("z",), ("a",)], "smarts string")
    attached = sorted((r["smarts"], r["reaction_group"]) for r in clean.attach_groups(rows, clean.reaction_groups(raw)).collect())
    assert attached == [("a", "RHEA:1"), ("a", "RHEA:1"), ("z", "z")]
    assert clean.attach_groups(rows, None).where("reaction_group <> smarts").count() == 0


def test_validation_counts(spark):
    single, double = "[C;H2:5]=[N;H1:6]>>[C;H2:5]-[N;H1:6]", "([S;H1:1]-[C:2])>>[S:1].[C:2]"
    texts = [single, double, "not_a_smarts", "", "C>N>O", "C>>N>>O", "C1CC>>N", "(C>>N"]
    df = spark.createDataFrame([(t,) for t in texts], "smarts string")
    got = {r["smarts"]: r for r in clean.validate(df).collect()}
    one = got[single]
    assert one["valid"] and (one["n_reactant_templates"], one["n_product_templates"], one["n_atoms"], one["n_bonds"]) == (1, 1, 4, 2)
    assert got[double]["n_product_templates"] == 2 and got[double]["n_reactant_templates"] == 1
    assert got["C>N>O"]["valid"] and got["C>N>O"]["n_atoms"] == 2
    for bad in ("not_a_smarts", "", "C>>N>>O", "C1CC>>N", "(C>>N"):
        assert not got[bad]["valid"] and got[bad]["n_atoms"] is None and got[bad]["reactant_smarts"] is None


def test_vocabulary_order_ties_and_specials(spark):
    rows = [(k, "[C:1]>>[N:1]") for k in range(20)] + [(20, "[O:1]>>[S:1]"), (21, "C?N")]
    df = tokenizer.with_tokens(spark.createDataFrame(rows, "ord int, smarts string").repartition(5), "smarts")
    out = {r["token"]: (r["id"], r["freq"]) for r in vocab.build(df).collect()}
    assert [out[t][0] for t in vocab.SPECIALS] == [0, 1, 2, 3]
    assert out[">>"] == (4, 21) and out["[C:1]"] == (5, 20) and out["[N:1]"] == (6, 20) and out["[O:1]"] == (7, 1) and out["[S:1]"] == (8, 1)
    named = vocab.build(df.withColumn("tokens", F.array(F.lit("[UNK]"))))
    assert {r["token"]: (r["id"], r["freq"]) for r in named.collect()}["[UNK]"] == (1, 22)
    assert vocab.build(df.limit(0)).count() == 4


def test_encode_truncates_pads_and_marks_failures(spark):
    known = {"[PAD]": 0, "[UNK]": 1, "[BOS]": 2, "[EOS]": 3, "C": 4, ">>": 5}
    df = spark.createDataFrame([("C>>N",), ("CCCCCCCC",), ("C?",), ("",)], "smarts string")
    got = {r["smarts"]: r for r in encode.dataset(df, known, max_length=6, bos=True, eos=True).collect()}
    assert got["C>>N"]["input_ids"] == [2, 4, 5, 1, 3, 0] and got["C>>N"]["attention_mask"] == [1, 1, 1, 1, 1, 0]
    assert got["CCCCCCCC"]["input_ids"] == [2, 4, 4, 4, 4, 4]
    assert got["C?"]["input_ids"] == [0] * 6 and not got["C?"]["ok"]
    assert got[""]["input_ids"] == [2, 3, 0, 0, 0, 0]
    longest = encode.dataset(df, known)
    assert {len(r["input_ids"]) for r in longest.collect()} == {8}
    vocabulary = spark.createDataFrame([(t, i) for t, i in known.items()], "token string, id int")
    joined = encode.lookup_join(tokenizer.with_tokens(df, "smarts"), vocabulary, "smarts")
    assert {r["smarts"]: r["ids"] for r in joined.collect()}["C>>N"] == [4, 5, 1]


def test_primary_ec(spark):
    rows = [("1.14.13.39",), ("3.1.1.122;3.5.1.137",), ("",), ("  ",), (None,), (";1.1",), (" 2.7 ;1",)]
    df = spark.createDataFrame(rows, "e string")
    got = {r["e"]: (r["a"], r["b"], r["c"]) for r in df.select("e", *[primary_ec(F.col("e"), d).alias(n) for d, n in ((1, "a"), (2, "b"), (3, "c"))]).collect()}
    assert got["1.14.13.39"] == ("1", "1.14", "1.14.13") and got["3.1.1.122;3.5.1.137"][0] == "3"
    assert all(got[x] == (None, None, None) for x in ("", "  ", None, ";1.1")) and got[" 2.7 ;1"] == ("2", "2.7", "2.7")


def test_csv_sources_keep_order_and_missing_words(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_text('X,TEMPLATE_ID,TEMPLATE,VALID,REACTIONS\n0,1,"[c,n;H1]>>C",TRUE,NA\n0,2,C>>N,False,r\n')
    b.write_text("TEMPLATE_ID,TEMPLATE,VALID,REACTIONS\n3,C>>N,true,q\n4,C>>N,true,p\n")
    raw = files.read_raw(spark, [str(a), str(b)])
    assert [r["TEMPLATE_ID"] for r in raw.orderBy("ord").collect()] == ["1", "2", "3", "4"]
    groups = {r["smarts"]: r["reaction_group"] for r in clean.reaction_groups(raw).collect()}
    assert groups == {"[c,n;H1]>>C": "[c,n;H1]>>C", "C>>N": "q"}
    files.write_lines(clean.clean(raw), str(tmp_path / "clean"))
    assert sorted(r["smarts"] for r in files.read_lines(spark, str(tmp_path / "clean")).collect()) == ["C>>N", "[c,n;H1]>>C"]
    with pytest.raises(ValueError):
        files.read_raw_labels(spark, [str(b)])
    assert files.read_groups(spark, str(tmp_path / "none.csv")) is None


def test_vocabulary_json(spark, tmp_path):
    df = tokenizer.with_tokens(spark.createDataFrame([(0, "CCN")], "ord int, smarts string"), "smarts")
    out = files.write_vocabulary(vocab.build(df), str(tmp_path / "v" / "vocab.json"))
    assert out == json.loads((tmp_path / "v" / "vocab.json").read_text())
    assert out["size"] == 6 and out["frequencies"] == {"C": 2, "N": 1} and out["id_to_token"]["4"] == "C"
    assert files.read_vocabulary(str(tmp_path / "v" / "vocab.json"))["N"] == 5


def test_formats():
    assert files.infer_format("x.csv", "npy") == "npy" and files.infer_format("x.csv") == "csv"
    assert files.infer_format("x.CSV") == "json" and files.infer_format(None) == "json"


def test_stages_from_files_to_labels(spark, tmp_path):
    from motifmill import stages

    raw = tmp_path / "raw.csv"
    lines = ["TEMPLATE_ID,TEMPLATE,VALID,REACTIONS,ECS"]
    lines += [f"{k},[C;H{k % 4}:{k}]>>[N:1],TRUE,RHEA:{k // 2},{1 + k // 12}.1" for k in range(24)]
    lines += ['90,"[c,n;H1]>>C",TRUE,NA,3.1', "91,C?N,TRUE,r,1.1", "92,CC>>N,FALSE,r,1.1"]
    raw.write_text("\n".join(lines) + "\n")
    out = {n: str(tmp_path / n) for n in ("clean", "groups.csv", "validated", "vocab.json", "labelled")}
    stages.main(["clean", "--raw", str(raw), "-o", out["clean"], "--groups", out["groups.csv"]])
    tally = {r["valid"]: r["n"] for r in stages.validate_stage(spark, out["clean"], out["validated"], out["groups.csv"]).collect()}
    assert tally == {True: 25, False: 1}
    rows = {r["smarts"]: r["reaction_group"] for r in files.read_validated(spark, out["validated"]).collect()}
    assert rows["[c,n;H1]>>C"] == "[c,n;H1]>>C" and rows["[C;H3:3]>>[N:1]"] == "RHEA:1" and "C?N" not in rows
    known = stages.vocab_stage(spark, out["validated"], out["vocab.json"])
    assert known["token_to_id"][">>"] == 4 and known["size"] == 4 + 2 + 24 + 2
    assert stages.labels_stage(spark, [str(raw)], out["validated"], out["labelled"]) == 24
    assert spark.read.parquet(out["labelled"]).columns == ["smarts", "label", "group"]


def test_index_refuses_another_pooling(spark, tmp_path):
    df = spark.createDataFrame([("C", [1.0, 2.0])], "smarts string, embedding array<float>")
    files.write_index(df, str(tmp_path / "i"), "mean")
    assert files.read_index(spark, str(tmp_path / "i"), "mean").count() == 1
    with pytest.raises(ValueError):
        files.read_index(spark, str(tmp_path / "i"), "cls")


def test_prediction_sinks(spark, tmp_path):
    import numpy as np

    df = spark.createDataFrame([(1, "C", [1.0, 2.0]), (0, "N,O", [3.0, 4.0])], "ord int, smarts string, embedding array<float>")
    files.write_predictions(df, str(tmp_path / "a" / "x.npy"))
    assert np.load(tmp_path / "a" / "x.npy").tolist() == [[3.0, 4.0], [1.0, 2.0]]
    files.write_predictions(df, str(tmp_path / "b.csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "b.csv"))
    assert back.columns == ["smarts", "dim_0", "dim_1"] and {r["smarts"] for r in back.collect()} == {"C", "N,O"}
    files.write_predictions(df, str(tmp_path / "c"), "json")
    assert spark.read.json(str(tmp_path / "c")).count() == 2
    with pytest.raises(ValueError):
        files.write_predictions(df, str(tmp_path / "d"), "xml")


def test_csv_sink_keeps_white_space(spark, tmp_path):
    df = spark.createDataFrame([(" a ", "  "), ("b,c", 'say "x"')], "smarts string, reaction_group string")
    files.write_csv(df, str(tmp_path / "x"))
    assert sorted(map(tuple, files.read_groups(spark, str(tmp_path / "x")).collect())) == sorted(map(tuple, df.collect()))


def test_first_file_that_is_large_enough(tmp_path):
    small, large = tmp_path / "a", tmp_path / "b"
    small.write_text("x")
    large.write_text("x" * 100)
    assert files.resolve([None, str(tmp_path / "c"), str(small), str(large)], 50) == str(large)
    with pytest.raises(FileNotFoundError, match="1 bytes"):
        files.resolve([str(small)], 50)
    with pytest.raises(FileNotFoundError):
        files.resolve([])


def test_brackets_at_any_depth_in_columns(spark):
    mark = tokenizer.MARK
    texts = ["[" * 50 + "C" + "]" * 50 + "C", "C" + "[" * 9 + "N" + "]" * 9 + "=O", "[" * 12 + "]" * 11, "]" + "[" * 12 + "]" * 12, "[" * 10 + mark + "1" + mark + "]" * 10 + "C", "[" * 10 + "]" * 11 + "[", "[" * 10 + "]" * 10 + "?"]
    texts.append("".join("[a" if k % 2 else "b]" for k in range(600)))
    texts.append("[" * 40 + "".join("[$(C)]" for _ in range(4_000)) + "]" * 40 + ">>C")
    df = spark.createDataFrame([(t,) for t in texts] + [(None,), ("",)], "smarts string")
    plan = tokenizer.with_tokens(df, "smarts")
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
    for r in plan.collect():
        try:
            want = tokenizer.scan(r["smarts"]) if r["smarts"] is not None else None
        except ValueError:
            want = None
        assert (r["tokens"], r["ok"]) == ((want, True) if want is not None else ([], False)), r["smarts"][:40]
