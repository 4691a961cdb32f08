"""The driver contract, with and without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"


def test_every_sql_has_its_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not Path(SF).exists(), reason="no driver tables")
def test_flagship(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark)
    assert rows.columns == ["token", "id", "freq"] and rows.count() > 4


def test_imports_without_the_training_data_subpackage(tmp_path):
    import shutil

    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; assert not any(q.startswith('op') for q in e.queries()); assert 'pipeline' not in e.queries(); print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and int(out.stdout.split()[-1]) > 30, out.stderr


@pytest.mark.skipif(not Path(SF).exists(), reason="no driver tables")
@pytest.mark.parametrize("name", ["clean_templates", "encode_pad", "label_counts", "group_holdout", "cosine_topk", "class_metrics", "vocab"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in ("lineitem", "embeddings", "documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in columns]
    rows = sorted(str(tuple(r[k] for k in order)) for r in want.fetchall())
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == columns
    assert sorted(str(tuple(r)) for r in got.select(*columns).collect()) == rows


@pytest.mark.skipif(not Path(SF).exists(), reason="no driver tables")
@pytest.mark.parametrize("name", ["cosine_against_all", "tanimoto_against_all", "pearson_fit_1000", "spearman_1000", "encode_longest", "attention_mask_longest"])
def test_whole_table_queries_equal_their_sql(spark, name):
    test_queries_equal_their_sql(spark, name)


MORE = "stratified_group_holdout dropped_classes label_whitelist label_loader label_encoding labelled_vectors group_folds best_epoch encode_characters lookup_join masked_topk cosine_to_first csv_files text_lines group_file validated_file index_file prediction_files subword_round_trip tokenizer_comparison"


@pytest.mark.skipif(not Path(SF).exists(), reason="no driver tables")
@pytest.mark.parametrize("name", MORE.split())
def test_further_queries_equal_their_sql(spark, name):
    test_queries_equal_their_sql(spark, name)


@pytest.mark.skipif(not Path(SF).exists(), reason="no driver tables")
def test_whole_tables_enter(spark):
    import __spark_entry__ as entry

    q = entry.queries()
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert q["cosine_against_all"](spark, SF).select("b").distinct().count() == vectors
    assert q["tanimoto_against_all"](spark, SF).select("b").distinct().count() == q["tokenize"](spark, SF).where("ok").count()
    rows = [r["input_ids"].split() for r in q["encode_longest"](spark, SF).where("ok").collect()]
    assert len({len(r) for r in rows}) == 1 and all("3" in r for r in rows)  # none loses its end
    assert max(len(r) for r in rows) == q["seq_length_stats"](spark, SF).first()["max_length"]
