"""Queries over the driver tables and the SQL that checks them.

The template queries run on the synthetic template table of ``sources.tables``; the
vector queries on ``embeddings``; the length queries on ``documents``.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifmill import stages
from motifmill.functions import graph, text, tokenizer, vectors
from motifmill.functions.ec import primary_ec, top_level
from motifmill.functions.vectors import cosine
from motifmill.operators import classify, clean, encode, encoder, graphs, labels, masking, metrics, neighbours, set_join, similarity, splits, stats, subword, train, vector_index, vocab
from motifmill.operators import group_folds as group_folds_
from motifmill.scratch import shared_folder, written
from motifmill.sources import corpus, files, npy
from motifmill.sources.tables import TEMPLATE_COLUMNS, table, templates
from motifmill.streaming import state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- shared SQL ---------------------------------------------------------------

_T = f"WITH t AS (SELECT {TEMPLATE_COLUMNS} FROM lineitem)"
_BLANK = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_FIRST = f"""{_T}, f AS (SELECT * FROM (
  SELECT o1, o2, o3, o4, {_BLANK.format("TEMPLATE")} AS smarts, REACTIONS, ECS,
    row_number() OVER (PARTITION BY {_BLANK.format("TEMPLATE")} ORDER BY o1, o2, o3, o4) AS rn
  FROM t WHERE upper(VALID) = 'TRUE' AND TEMPLATE IS NOT NULL AND {_BLANK.format("TEMPLATE")} <> '') WHERE rn = 1)"""
_PATTERN = tokenizer.PATTERN.replace("'", "''")
_TOKENS = f"""{_FIRST}, k AS (SELECT *, length(smarts) = length(array_to_string(tokens, '')) AS ok
  FROM (SELECT *, regexp_extract_all(smarts, '{_PATTERN}', 0) AS tokens FROM f))"""
_EXPLODED = f"{_TOKENS}, e AS (SELECT o1, o2, o3, o4, unnest(tokens) AS token, unnest(range(1, len(tokens) + 1)) AS pos FROM k WHERE ok)"
_VOCAB = f"""{_EXPLODED}, c AS (SELECT token, count(*) AS freq, min((o1, o2, o3, o4, pos)) AS first FROM e GROUP BY token),
  v AS (SELECT token, CAST(3 + row_number() OVER (ORDER BY freq DESC, first) AS BIGINT) AS id, CAST(freq AS BIGINT) AS freq FROM c
    UNION ALL SELECT * FROM (VALUES ('[PAD]', 0, NULL), ('[UNK]', 1, NULL), ('[BOS]', 2, NULL), ('[EOS]', 3, NULL)) AS s(token, id, freq))"""
_EC = _BLANK.format("split_part(ECS, ';', 1)")


def _first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.filtered(templates(spark, sf_dir)).withColumnRenamed("TEMPLATE", "smarts")


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer.with_tokens(_first(spark, sf_dir).select("ord", "smarts"), "smarts")


def _vocabulary(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """A fixed vocabulary of common tokens, so that rarer ones are unknown."""
    return {t: k for k, t in enumerate(VOCABULARY)}


VOCABULARY = ("[PAD]", "[UNK]", "[BOS]", "[EOS]", ">>", "Cl", "-", "=", "#", "C", "%10", ".", "(", ")", "O", "N", "[$(C([OH]))]", "[C;H0:1]", "[C;H1:1]", "[C;H2:1]", "[C,N;H1:1]", "[C,N;H2:1]")
_LOOKUP = "CASE " + " ".join(f"WHEN x = '{t}' THEN {k}" for k, t in enumerate(VOCABULARY)) + " ELSE 1 END"

# --- templates ----------------------------------------------------------------


@query(f"{_FIRST} SELECT smarts FROM f")
def clean_templates(spark, sf_dir):
    return _first(spark, sf_dir).select("smarts")


@query(f"{_FIRST} SELECT smarts, CASE WHEN REACTIONS IS NOT NULL AND {_BLANK.format('REACTIONS')} <> '' THEN REACTIONS ELSE smarts END AS reaction_group FROM f")
def reaction_groups(spark, sf_dir):
    return clean.reaction_groups(templates(spark, sf_dir))


@query(f"""{_FIRST}, g AS (SELECT smarts, CASE WHEN REACTIONS IS NOT NULL AND {_BLANK.format('REACTIONS')} <> '' THEN REACTIONS ELSE smarts END AS grp FROM f)
SELECT TEMPLATE_ID AS template_id, TEMPLATE AS smarts, coalesce(grp, TEMPLATE) AS reaction_group FROM t LEFT JOIN g ON TEMPLATE = smarts""")
def attach_groups(spark, sf_dir):
    raw = templates(spark, sf_dir)
    rows = raw.select(F.col("TEMPLATE_ID").alias("template_id"), F.col("TEMPLATE").alias("smarts"))
    return clean.attach_groups(rows, clean.reaction_groups(raw)).select("template_id", "smarts", "reaction_group")


@query(f"{_T} SELECT upper(VALID) = 'TRUE' AS valid, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY 1")
def valid_tally(spark, sf_dir):
    from motifmill.functions.text import is_true

    return templates(spark, sf_dir).groupBy(is_true(F.col("VALID")).alias("valid")).agg(F.count(F.lit(1)).alias("n"))


@query(f"{_T} SELECT 'a' AS part, TEMPLATE_ID AS template_id, TEMPLATE AS smarts FROM t WHERE VALID = 'True' UNION ALL SELECT 'b', TEMPLATE_ID, TEMPLATE FROM t WHERE VALID = 'TRUE'")
def union_files(spark, sf_dir):
    raw = templates(spark, sf_dir)
    part = lambda name, v: raw.where(F.col("VALID") == v).select(F.lit(name).alias("part"), F.col("TEMPLATE_ID").alias("template_id"), F.col("TEMPLATE").alias("smarts"))
    return part("a", "True").unionByName(part("b", "TRUE"))


@query(f"{_TOKENS} SELECT smarts, CASE WHEN ok THEN array_to_string(tokens, ' ') ELSE '' END AS tokens, ok FROM k")
def tokenize(spark, sf_dir):
    return _tokens(spark, sf_dir).select("smarts", F.array_join("tokens", " ").alias("tokens"), "ok")


@query(f"{_TOKENS} SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (ok) AS BIGINT) AS n_ok, CAST(count(*) FILTER (ok AND array_to_string(tokens, '') = smarts) AS BIGINT) AS n_round_trip FROM k")
def token_roundtrip(spark, sf_dir):
    same = F.col("ok") & (F.array_join("tokens", "") == F.col("smarts"))
    return _tokens(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_ok"), F.count_if(same).alias("n_round_trip"))


@query(f"{_EXPLODED} SELECT token, CAST(count(*) AS BIGINT) AS freq FROM e GROUP BY token")
def token_frequencies(spark, sf_dir):
    return vocab.token_frequencies(_tokens(spark, sf_dir)).select("token", "freq")


# Special tokens never occur in these templates, so the SQL need not merge them.
@query(f"{_VOCAB} SELECT token, id, freq FROM v")
def vocabulary_sql(spark, sf_dir):
    return vocab.build(_tokens(spark, sf_dir)).select("token", F.col("id").cast("bigint").alias("id"), "freq")


QUERIES["vocab"] = QUERIES.pop("vocabulary_sql")
ORACLE_SQL["vocab"] = ORACLE_SQL.pop("vocabulary_sql")

_IDS = f"""{_TOKENS}, i AS (SELECT smarts, ok, CASE WHEN ok THEN list_concat([2], list_transform(tokens, lambda x: {_LOOKUP}), [3]) ELSE [] END AS ids FROM k),
  p AS (SELECT smarts, ok, list_slice(ids, 1, 6) AS ids FROM i)"""


@query(f"{_IDS} SELECT smarts, ok, array_to_string(list_resize(ids, 6, 0), ' ') AS input_ids FROM p")
def encode_pad(spark, sf_dir):
    rows = encode.dataset(_first(spark, sf_dir).select("smarts"), _vocabulary(spark, sf_dir), max_length=6, bos=True, eos=True)
    return rows.select("smarts", "ok", F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"))


@query(f"{_IDS} SELECT smarts, array_to_string(list_resize(list_transform(ids, lambda x: 1), 6, 0), ' ') AS attention_mask, CAST(len(ids) AS BIGINT) AS n_real FROM p")
def attention_mask(spark, sf_dir):
    rows = encode.dataset(_first(spark, sf_dir).select("smarts"), _vocabulary(spark, sf_dir), max_length=6, bos=True, eos=True)
    real = F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda s, x: s + x)
    return rows.select("smarts", F.array_join(F.col("attention_mask").cast("array<string>"), " ").alias("attention_mask"), real.alias("n_real"))


_LONGEST = f"{_IDS}, m AS (SELECT CAST(coalesce(max(len(ids)), 1) AS BIGINT) AS m FROM i)"


@query(f"{_LONGEST} SELECT smarts, ok, array_to_string(list_resize(ids, m, 0), ' ') AS input_ids FROM i, m")
def encode_longest(spark, sf_dir):
    rows = encode.dataset(_first(spark, sf_dir).select("smarts"), _vocabulary(spark, sf_dir), bos=True, eos=True)
    return rows.select("smarts", "ok", F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"))


@query(f"{_LONGEST} SELECT smarts, array_to_string(list_resize(list_transform(ids, lambda x: 1), m, 0), ' ') AS attention_mask, CAST(len(ids) AS BIGINT) AS n_real FROM i, m")
def attention_mask_longest(spark, sf_dir):
    rows = encode.dataset(_first(spark, sf_dir).select("smarts"), _vocabulary(spark, sf_dir), bos=True, eos=True)
    real = F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda s, x: s + x)
    return rows.select("smarts", F.array_join(F.col("attention_mask").cast("array<string>"), " ").alias("attention_mask"), real.alias("n_real"))


@query(f"{_IDS} SELECT CAST(coalesce(max(len(ids)), 1) AS BIGINT) AS max_length, round(avg(len(ids)), 6) AS mean_length FROM i")
def seq_length_stats(spark, sf_dir):
    rows = _tokens(spark, sf_dir)
    ids = F.when(F.col("ok"), encode.frame(encode.lookup(F.col("tokens"), _vocabulary(spark, sf_dir)), True, True)).otherwise(F.array().cast("array<bigint>"))
    most, mean = encode.sequence_lengths()
    return rows.withColumn("_ids", ids).agg(most, mean).select(F.col("max_length").cast("bigint").alias("max_length"), F.round("mean_length", 6).alias("mean_length"))


_STATS = "CAST(count({0}) AS BIGINT) AS n, CAST(min({0}) AS BIGINT) AS min, round(quantile_cont({0}, 0.5), 6) AS median, round(avg({0}), 6) AS mean, round(quantile_cont({0}, 0.75), 6) AS p75, round(quantile_cont({0}, 0.9), 6) AS p90, round(quantile_cont({0}, 0.95), 6) AS p95, round(quantile_cont({0}, 0.99), 6) AS p99, CAST(max({0}) AS BIGINT) AS max, CAST(count(*) FILTER ({0} <= 256) AS BIGINT) AS n_le_256, round(100.0 * avg(CASE WHEN {0} <= 256 THEN 1.0 ELSE 0.0 END), 6) AS pct_le_256, CAST(count(*) FILTER ({0} <= 512) AS BIGINT) AS n_le_512, round(100.0 * avg(CASE WHEN {0} <= 512 THEN 1.0 ELSE 0.0 END), 6) AS pct_le_512"


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"SELECT {_STATS.format('length(text)')} FROM documents")
def length_distribution(spark, sf_dir):
    return _rounded(stats.length_distribution(table(spark, sf_dir, "documents"), F.length("text")))


@query(f"{_TOKENS} SELECT {_STATS.format('len(tokens)')} FROM k WHERE ok")
def token_length_distribution(spark, sf_dir):
    return _rounded(stats.length_distribution(_tokens(spark, sf_dir).where("ok"), F.size("tokens")))


@query(f"""{_TOKENS}, x AS (SELECT *, CASE WHEN ok THEN len(tokens) END AS m FROM k)
SELECT CAST(count(*) AS BIGINT) AS n, round(avg(CASE WHEN ok THEN 0.0 ELSE 1.0 END), 6) AS error_rate, round(avg(m), 6) AS mean_tokens, round(quantile_cont(m, 0.5), 6) AS median_tokens,
  round(stddev_pop(m), 6) AS std_tokens, CAST(min(m) AS BIGINT) AS min_tokens, CAST(max(m) AS BIGINT) AS max_tokens, round(avg(m / length(smarts)), 6) AS fertility,
  round(avg(m) / avg(CASE WHEN ok THEN length(smarts) END), 6) AS fertility_of_means, round(avg(CASE WHEN ok THEN CASE WHEN array_to_string(tokens, '') = smarts THEN 1.0 ELSE 0.0 END END), 6) AS round_trip,
  CAST((SELECT count(DISTINCT u) FROM (SELECT unnest(tokens) AS u FROM k WHERE ok)) AS BIGINT) AS unique_tokens FROM x""")
def fertility(spark, sf_dir):
    return _rounded(stats.tokenizer_report(_tokens(spark, sf_dir), "smarts", "tokens"))


_COUNTS = f"""{_TOKENS}, a AS (SELECT *, list_position(tokens, '>>') AS cut, len(list_filter(tokens, lambda x: x = '>>')) AS arrows FROM k WHERE ok),
  s AS (SELECT smarts, tokens, arrows, list_slice(tokens, 1, cut - 1) AS l, list_slice(tokens, cut + 1, len(tokens)) AS r FROM a),
  n AS (SELECT smarts, l, r, {{0}} FROM s)"""
_ATOMS = "len(list_filter({0}, lambda x: regexp_full_match(x, '\\[.*|Cl|Br|[BCNOPSFIbcnopsAa*]')))"
_RINGS = "len(list_filter({0}, lambda x: regexp_full_match(x, '%[0-9][0-9]|[0-9]')))"
_DOTS = "len(list_filter({0}, lambda x: x = '.'))"


# Here the only dots inside parentheses are those of '(O.N)', whose side has one outer dot more.
@query(
    _COUNTS.replace("{0}", ", ".join(f"{_ATOMS.format(s)} AS {s}a, {_RINGS.format(s)} AS {s}g, {_DOTS.format(s)} AS {s}d" for s in "lr"))
    + " SELECT smarts, CAST(la + ra AS BIGINT) AS n_atoms, CAST(la - (ld + 1) + lg // 2 + ra - (rd + 1) + rg // 2 AS BIGINT) AS n_bonds,"
    " CAST(1 + ld AS BIGINT) AS n_reactant_templates, CAST(1 + rd - CASE WHEN smarts LIKE '%(O.N)' THEN 1 ELSE 0 END AS BIGINT) AS n_product_templates,"
    " array_to_string(l, '') AS reactant_smarts, array_to_string(r, '') AS product_smarts FROM n"
)
def structure_counts(spark, sf_dir):
    rows = clean.validate(_first(spark, sf_dir).select("smarts")).where("valid")
    counts = [F.col(c).cast("bigint").alias(c) for c in ("n_atoms", "n_bonds", "n_reactant_templates", "n_product_templates")]
    return rows.select("smarts", *counts, "reactant_smarts", "product_smarts")


# --- labels -------------------------------------------------------------------


@query(f"""{_T} SELECT TEMPLATE_ID AS template_id, {", ".join(f"array_to_string(list_slice(string_split(nullif({_EC}, ''), '.'), 1, {d}), '.') AS ec{d}" for d in (1, 2, 3))},
  split_part(split_part(ECS, ';', 1), '.', 1) AS top FROM t""")
def ec_label(spark, sf_dir):
    ecs = F.col("ECS")
    return templates(spark, sf_dir).select(F.col("TEMPLATE_ID").alias("template_id"), *[primary_ec(ecs, d).alias(f"ec{d}") for d in (1, 2, 3)], top_level(ecs).alias("top"))


_LABELS = f"""{_T}, x AS (SELECT *, array_to_string(list_slice(string_split(nullif({_EC}, ''), '.'), 1, 1), '.') AS label FROM t WHERE upper(VALID) = 'TRUE' AND TEMPLATE IS NOT NULL),
  m AS (SELECT TEMPLATE AS smarts, label FROM (SELECT *, row_number() OVER (PARTITION BY TEMPLATE ORDER BY o1, o2, o3, o4) AS rn FROM x WHERE label IS NOT NULL) WHERE rn = 1)"""
_LABELLED = f"""{_LABELS}, f AS (SELECT * FROM (SELECT TEMPLATE AS smarts, REACTIONS, row_number() OVER (PARTITION BY TEMPLATE ORDER BY o1, o2, o3, o4) AS rn FROM t
    WHERE upper(VALID) = 'TRUE' AND TEMPLATE IS NOT NULL AND {_BLANK.format("TEMPLATE")} <> '') WHERE rn = 1),
  l AS (SELECT f.smarts, m.label, CASE WHEN REACTIONS IS NOT NULL AND {_BLANK.format('REACTIONS')} <> '' THEN REACTIONS ELSE f.smarts END AS grp FROM f JOIN m USING (smarts))"""


def _contenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.contenders(templates(spark, sf_dir), "ord.o1")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _contenders(spark, sf_dir)
    return written(labels.join_labels(clean.reaction_groups(raw), labels.label_map(raw)), "labelled")


@query(f"{_LABELLED} SELECT smarts, label, grp AS group_id FROM l")
def labelled_join(spark, sf_dir):
    return _labelled(spark, sf_dir).select("smarts", "label", F.col("group").alias("group_id"))


@query(f"{_LABELLED} SELECT label, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY 1")
def label_counts(spark, sf_dir):
    return labels.class_counts(_labelled(spark, sf_dir))


@query(f"""{_LABELLED}, n AS (SELECT label FROM l GROUP BY 1 HAVING count(*) >= greatest(10, CAST(floor(500.0 / (SELECT count(*) FROM l) * 10) AS BIGINT) + 2))
SELECT smarts, label FROM l WHERE label IN (SELECT label FROM n)""")
def rare_class_filter(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    return labels.drop_rare(rows, labels.min_class_count(rows.count(), 500)).select("smarts", "label")


@query(f"""{_LABELLED}, c AS (SELECT label, count(*) AS n FROM l GROUP BY 1), q AS (SELECT label, least(n, greatest(1, floor(500 * n / (SELECT count(*) FROM l)))) AS quota FROM c)
SELECT smarts, l.label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || smarts), smarts) AS rn FROM l) l JOIN q ON l.label = q.label WHERE rn <= quota""")
def stratified_sample(spark, sf_dir):
    return labels.stratified_sample(_labelled(spark, sf_dir), 500, 42).select("smarts", "label")


_HOLDOUT = f"""{_LABELLED}, g AS (SELECT grp, row_number() OVER (ORDER BY md5('42:' || grp), grp) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT grp FROM l)),
  s AS (SELECT l.smarts, l.grp, CASE WHEN rn <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS split FROM l JOIN g ON l.grp = g.grp)"""


@query(f"{_HOLDOUT} SELECT smarts, split FROM s")
def group_holdout(spark, sf_dir):
    return splits.group_holdout(_labelled(spark, sf_dir), 0.2, 42).select("smarts", "split")


@query(f"{_HOLDOUT} SELECT grp AS group_id FROM s GROUP BY 1 HAVING count(DISTINCT split) > 1")
def group_leakage_check(spark, sf_dir):
    return splits.leaking_groups(splits.group_holdout(_labelled(spark, sf_dir), 0.2, 42)).select(F.col("group").alias("group_id"))


@query(f"""{_LABELLED}, c AS (SELECT grp, label, count(*) AS n FROM l GROUP BY ALL), g AS (SELECT grp, sum(n) AS size, arg_max(label, (n, label)) AS main FROM c GROUP BY 1),
  r AS (SELECT grp, row_number() OVER (PARTITION BY main ORDER BY size DESC, md5('42:' || grp), grp) - 1 AS rank FROM g),
  d AS (SELECT grp, CASE WHEN (CASE WHEN (rank // 5) % 2 = 0 THEN rank % 5 ELSE 4 - rank % 5 END) = 0 THEN 'test' ELSE 'train' END AS split FROM r)
SELECT smarts, label, l.grp AS "group", split FROM l JOIN d ON l.grp = d.grp""")
def stratified_group_holdout(spark, sf_dir):
    return splits.stratified_group_holdout(_labelled(spark, sf_dir), 0.2, 42).select("smarts", "label", "group", "split")


@query("SELECT doc_id, md5('7:' || CAST(doc_id AS VARCHAR)) AS draw FROM documents ORDER BY draw, doc_id LIMIT 100")
def uniform_sample(spark, sf_dir):
    rows = splits.uniform_sample(table(spark, sf_dir, "documents").select("doc_id"), 100, 7, "doc_id")
    return rows.select("doc_id", labels.draw(7, F.col("doc_id")).alias("draw"))


@query("""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('7:' || CAST(doc_id AS VARCHAR)), doc_id) <= greatest(1, CAST(floor(0.1 * count(*) OVER ()) AS BIGINT)) THEN 'val' ELSE 'train' END AS split FROM documents""")
def random_holdout(spark, sf_dir):
    return splits.random_holdout(table(spark, sf_dir, "documents").select("doc_id"), 0.1, 7, "doc_id")


@query("SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), 'unknown') AS label FROM documents d LEFT JOIN labels l USING (doc_id)")
def label_default(spark, sf_dir):
    docs, known = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.select("doc_id").join(known.select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("unknown")).alias("label"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def keep_first_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), "text", "doc_id")
    return clean.keep_first(docs, "text").select("doc_id")


# --- vectors ------------------------------------------------------------------

_V = "WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
_NORM = "sqrt(list_sum(list_transform(e, lambda x: x * x)))"
_QUERY_ROW = 0


@query(f"{_V} SELECT vec_id, round({_NORM}, 6) AS norm FROM v")
def l2_norms(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


@query(f"{_V} SELECT CAST(row_number() OVER (ORDER BY s DESC, vec_id) AS BIGINT) AS rank, round(s, 4) AS similarity, vec_id FROM (SELECT vec_id, list_cosine_similarity(e, (SELECT e FROM v WHERE vec_id = 0)) AS s FROM v WHERE vec_id <> 0) ORDER BY rank LIMIT 10")
def cosine_topk(spark, sf_dir):
    index = table(spark, sf_dir, "embeddings")
    probe = index.where(F.col("vec_id") == _QUERY_ROW).first()["embedding"]
    out = similarity.top_k(index, probe, 10, "vec_id", exclude=_QUERY_ROW)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


@query(f"""{_V}, q AS (SELECT vec_id AS a, e AS ea FROM v WHERE vec_id % 50 = 0),
s AS (SELECT a, vec_id AS b, list_cosine_similarity(e, ea) AS s FROM v, q WHERE vec_id <> a)
SELECT a AS query, b AS neighbour, round(s, 6) AS similarity, CAST(rn AS BIGINT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rn FROM s) WHERE rn <= 5""")
def batch_search(spark, sf_dir):
    index = table(spark, sf_dir, "embeddings")
    out = similarity.search(index, index.where("vec_id % 50 = 0"), 5)
    return out.select("query", "neighbour", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


@query(f"{_V}, p AS (SELECT * FROM v ORDER BY md5('42:' || CAST(vec_id AS VARCHAR)), vec_id LIMIT 60) SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM p a JOIN p b ON a.vec_id < b.vec_id")
def pairwise_cosine(spark, sf_dir):
    sample = splits.uniform_sample(table(spark, sf_dir, "embeddings"), 60, 42, "vec_id")
    return similarity.pairwise_cosine(sample).withColumn("similarity", F.round("similarity", 6))


@query(f"{_V}, q AS (SELECT vec_id AS a, e AS ea FROM v WHERE vec_id % 50 = 0) SELECT a, vec_id AS b, round(list_cosine_similarity(e, ea), 6) AS similarity FROM v, q WHERE vec_id <> a")
def cosine_against_all(spark, sf_dir):
    index = table(spark, sf_dir, "embeddings")
    out = similarity.against(index, index.where("vec_id % 50 = 0"), digits=6)
    return out.select(F.col("query").alias("a"), F.col("neighbour").alias("b"), "similarity")


_PAIRS = f"""{_TOKENS}, p AS (SELECT smarts, list_distinct(tokens) AS s FROM (SELECT * FROM k WHERE ok ORDER BY md5('42:' || smarts), smarts LIMIT 60)),
  w AS (SELECT a.smarts AS a, b.smarts AS b, len(list_intersect(a.s, b.s)) AS i, len(a.s) + len(b.s) AS u, length(a.smarts) AS la, length(b.smarts) AS lb FROM p a JOIN p b ON a.smarts < b.smarts),
  x AS (SELECT *, i * 1.0 / (u - i) AS similarity, abs(la - lb) * 1.0 AS distance FROM w)"""


def _tanimoto(spark: SparkSession, sf_dir: str, rows: int = 60) -> DataFrame:
    sample = splits.uniform_sample(_tokens(spark, sf_dir).where("ok").select("smarts", "tokens"), rows, 42, "smarts")
    return similarity.pairwise_tanimoto(sample, "smarts").withColumn("distance", F.abs(F.length("a") - F.length("b")).cast("double"))


@query(f"{_PAIRS} SELECT a, b, round(similarity, 6) AS similarity FROM x")
def tanimoto_pairs(spark, sf_dir):
    return _tanimoto(spark, sf_dir).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(f"{_PAIRS} SELECT round(corr(similarity, distance), 6) AS pearson, round(regr_slope(similarity, distance), 6) AS slope, round(regr_intercept(similarity, distance), 6) AS intercept, CAST(count(*) AS BIGINT) AS n FROM x")
def pearson_fit(spark, sf_dir):
    return _rounded(similarity.linear_fit(_tanimoto(spark, sf_dir), "distance", "similarity"))


@query(f"""{_PAIRS}, y AS (SELECT rank() OVER (ORDER BY distance) + (count(*) OVER (PARTITION BY distance) - 1) / 2.0 AS rx, rank() OVER (ORDER BY round(similarity, 9)) + (count(*) OVER (PARTITION BY round(similarity, 9)) - 1) / 2.0 AS ry FROM x)
SELECT round(corr(rx, ry), 6) AS spearman FROM y""")
def spearman(spark, sf_dir):
    rows = _tanimoto(spark, sf_dir).withColumn("similarity", F.round("similarity", 9))
    return _rounded(similarity.spearman(rows, "distance", "similarity"))


#: The reference correlates 1,000 rows; the queries above keep the 60 of their SQL.
_PAIRS_1000 = _PAIRS.replace("LIMIT 60", "LIMIT 1000")


@query(f"""{_TOKENS}, s AS (SELECT smarts, list_distinct(tokens) AS s FROM k WHERE ok), p AS (SELECT * FROM s ORDER BY md5('42:' || smarts), smarts LIMIT 60),
  w AS (SELECT p.smarts AS a, s.smarts AS b, len(list_intersect(p.s, s.s)) AS i, len(p.s) + len(s.s) AS u FROM p JOIN s ON p.smarts <> s.smarts)
SELECT a, b, round(i * 1.0 / (u - i), 6) AS similarity FROM w""")
def tanimoto_against_all(spark, sf_dir):
    rows = _tokens(spark, sf_dir).where("ok").select("smarts", "tokens")
    out = similarity.tanimoto_against(rows, splits.uniform_sample(rows, 60, 42, "smarts"), "smarts")
    return out.withColumn("similarity", F.round("similarity", 6))


@query(f"{_PAIRS_1000} SELECT round(corr(similarity, distance), 6) AS pearson, round(regr_slope(similarity, distance), 6) AS slope, round(regr_intercept(similarity, distance), 6) AS intercept, CAST(count(*) AS BIGINT) AS n FROM x")
def pearson_fit_1000(spark, sf_dir):
    return _rounded(similarity.linear_fit(_tanimoto(spark, sf_dir, 1000), "distance", "similarity"))


@query(f"""{_PAIRS_1000}, y AS (SELECT rank() OVER (ORDER BY distance) + (count(*) OVER (PARTITION BY distance) - 1) / 2.0 AS rx, rank() OVER (ORDER BY round(similarity, 9)) + (count(*) OVER (PARTITION BY round(similarity, 9)) - 1) / 2.0 AS ry FROM x)
SELECT round(corr(rx, ry), 6) AS spearman FROM y""")
def spearman_1000(spark, sf_dir):
    rows = _tanimoto(spark, sf_dir, 1000).withColumn("similarity", F.round("similarity", 9))
    return _rounded(similarity.spearman(rows, "distance", "similarity"))


@query(f"{_V} SELECT CAST(dim AS BIGINT) AS dim, round(var_pop(x), 9) AS variance FROM (SELECT unnest(e) AS x, unnest(range(0, len(e))) AS dim FROM v) GROUP BY 1")
def dim_variance(spark, sf_dir):
    out = stats.dimension_variance(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("dim").cast("bigint").alias("dim"), F.round("variance", 9).alias("variance"))


@query(f"{_V}, n AS (SELECT {_NORM} AS n FROM v) SELECT round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS std, round(min(n), 6) AS min, round(max(n), 6) AS max FROM n")
def norm_summary(spark, sf_dir):
    return _rounded(stats.norm_summary(table(spark, sf_dir, "embeddings")))


@query("SELECT least(greatest(CAST(floor((length(text) - 0.0) / (40000.0 / 80)) AS BIGINT), 0), 79) AS bin, CAST(count(*) AS BIGINT) AS n FROM documents GROUP BY 1")
def similarity_histogram(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.length("text").cast("double").alias("x"))
    return stats.histogram(rows, "x", 0.0, 40000.0, 80)


@query("""SELECT least(greatest(CAST(floor((l_quantity - 0.0) / (50.0 / 50)) AS BIGINT), 0), 49) AS x_bin, least(greatest(CAST(floor((l_extendedprice - 0.0) / (100000.0 / 50)) AS BIGINT), 0), 49) AS y_bin, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2""")
def histogram_2d(spark, sf_dir):
    return stats.histogram_2d(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", (0.0, 50.0, 0.0, 100000.0))


# --- metrics ------------------------------------------------------------------

_PREDICTED = "WITH p AS (SELECT CAST(label AS VARCHAR) AS y, CAST((label + CASE WHEN vec_id % 3 = 0 THEN 1 ELSE 0 END) % 10 AS VARCHAR) AS p FROM embeddings)"


def _predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    guess = (F.col("label") + F.when(F.col("vec_id") % 3 == 0, 1).otherwise(0)) % 10
    return rows.select(F.col("label").cast("string").alias("label"), guess.cast("string").alias("predicted"))


@query(f"{_PREDICTED} SELECT y AS label, p AS predicted, CAST(count(*) AS BIGINT) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY y), 6) AS share FROM p GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    return _rounded(metrics.confusion(_predictions(spark, sf_dir)))


_PER_CLASS = f"""{_PREDICTED}, c AS (SELECT y AS c FROM p UNION SELECT p FROM p),
  k AS (SELECT c, (SELECT count(*) FROM p WHERE y = c AND p = c) AS hit, (SELECT count(*) FROM p WHERE y = c) AS support, (SELECT count(*) FROM p WHERE p = c) AS chosen FROM c),
  r AS (SELECT c, support, coalesce(hit * 1.0 / nullif(chosen, 0), 0.0) AS precision, coalesce(hit * 1.0 / nullif(support, 0), 0.0) AS recall FROM k),
  s AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM r)"""


@query(f"{_PER_CLASS} SELECT c AS label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM s")
def class_metrics(spark, sf_dir):
    return _rounded(metrics.class_metrics(_predictions(spark, sf_dir)))


@query(f"{_PER_CLASS} SELECT round(avg(f1), 6) AS f1_macro, round(sum(f1 * support) / sum(support), 6) AS f1_weighted, round((SELECT avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END) FROM p), 6) AS accuracy FROM s")
def summary_metrics(spark, sf_dir):
    return _rounded(metrics.summary_metrics(_predictions(spark, sf_dir)))


@query(f"SELECT CAST(step AS BIGINT) AS step, round(CASE WHEN step < 100 THEN step / 100.0 ELSE greatest(0.0, 0.5 * (1 + cos({math.pi!r} * (step - 100) / 900.0))) END, 9) AS factor FROM range(1000) AS r(step)")
def lr_schedule(spark, sf_dir):
    return _rounded(metrics.schedule(spark, 1000, 100), 9)


# --- without SQL --------------------------------------------------------------


# Two draws of 32 bits choose a span's beginning and length, a third its kind; the digest is that of seed, epoch, row and turn.
_LONGER = ", ".join(str(b) for b in masking.SpanMasker({}).longer())
_HASHED = "CAST(CAST('0x' || substr({0}, {1}, 8) AS BIGINT) AS BIGINT)"
_RANDOM_IDS = [k for k, t in enumerate(VOCABULARY) if t not in masking.SPECIALS]


@query(f"""{_TOKENS.replace("WITH t AS", "WITH RECURSIVE t AS", 1)}, i AS (SELECT smarts, CASE WHEN ok THEN list_transform(tokens, lambda x: {_LOOKUP}) ELSE [] END AS ids FROM k),
  m AS (SELECT greatest(1, max(len(ids))) AS m FROM i),
  r AS (SELECT smarts, 1 AS turn, list_transform(range(m), lambda p: CASE WHEN p < len(ids) THEN 0 ELSE -1 END) AS kinds, CASE WHEN len(ids) > 0 THEN greatest(1, CAST(round_even(0.25 * len(ids), 0) AS BIGINT)) ELSE 0 END AS budget FROM i, m
    UNION ALL SELECT smarts, turn + 1, list_transform(kinds, lambda x, p: CASE WHEN list_contains(own, p - 1) THEN kind ELSE x END), budget - len(own) FROM (
      SELECT *, list_slice(list_filter(free, lambda p: p >= st AND p < st + span), 1, budget) AS own FROM (
        SELECT *, free[1 + {_HASHED.format("h", 1)} % len(free)] AS st, 1 + len(list_filter([{_LONGER}], lambda x: {_HASHED.format("h", 9)} < x)) AS span,
          CASE WHEN {_HASHED.format("h", 17)} < {int(2**32 * 0.8)} THEN 1 WHEN {_HASHED.format("h", 17)} < {int(2**32 * 0.9)} THEN 2 ELSE 3 END AS kind FROM (
          SELECT *, list_filter(range(len(kinds)), lambda p: kinds[p + 1] = 0) AS free, md5('42:0:' || smarts || ':' || CAST(turn - 1 AS VARCHAR)) AS h FROM r WHERE budget > 0) WHERE len(free) > 0))),
  z AS (SELECT smarts, arg_max(kinds, turn) AS kinds FROM r GROUP BY 1), y AS (SELECT i.smarts, list_resize(ids, m, 0) AS ids, kinds FROM i JOIN z ON i.smarts = z.smarts, m)
SELECT smarts, array_to_string(list_transform(ids, lambda x, p: CASE kinds[p] WHEN 1 THEN {len(VOCABULARY)} WHEN 2 THEN {_RANDOM_IDS}[1 + {_HASHED.format("md5('42:0:' || smarts || ':at:' || CAST(p - 1 AS VARCHAR))", 1)} % {len(_RANDOM_IDS)}] ELSE x END), ' ') AS input_ids,
  array_to_string(list_transform(ids, lambda x, p: CASE WHEN kinds[p] > 0 THEN x ELSE -100 END), ' ') AS labels FROM y""")
def span_mask(spark, sf_dir):
    known = _vocabulary(spark, sf_dir)
    rows = encode.dataset(_first(spark, sf_dir).select("smarts"), known).drop("ok")
    out = masking.span_mask(rows, masking.SpanMasker(known), "smarts")
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), " ").alias(c)
    return out.select("smarts", joined("input_ids"), joined("labels"))


# --- graphs ---------------------------------------------------------------------

_GRAPH = f"""{_TOKENS.replace("WITH t AS", "WITH RECURSIVE t AS", 1)}, c AS (SELECT smarts, tokens, list_position(tokens, '>>') AS cut FROM k WHERE ok AND list_contains(tokens, '>>')),
  sides AS (SELECT smarts, 0 AS side, list_slice(tokens, 1, cut - 1) AS toks FROM c UNION ALL SELECT smarts, 1, list_slice(tokens, cut + 1, len(tokens)) FROM c),
  d AS (SELECT DISTINCT toks FROM sides),
  g AS (SELECT toks, 0 AS pos, []::VARCHAR[] AS atoms, []::STRUCT(a INT, b INT, kind VARCHAR, ring BOOLEAN)[] AS bonds, -1 AS last, []::INT[] AS stack, []::STRUCT(label VARCHAR, atom INT, kind VARCHAR)[] AS rings, '' AS kind FROM d
    UNION ALL SELECT toks, pos + 1, CASE WHEN k = 'atom' THEN list_append(atoms, regexp_replace(x, ':[0-9]+\\]$', ']')) ELSE atoms END,
      CASE WHEN k = 'atom' AND last >= 0 THEN list_append(bonds, {{'a': last, 'b': CAST(len(atoms) AS INT), 'kind': kind, 'ring': false}}) WHEN k = 'ring' AND last >= 0 AND len(same) > 0 THEN list_append(bonds, {{'a': same[1].atom, 'b': last, 'kind': coalesce(nullif(kind, ''), same[1].kind), 'ring': true}}) ELSE bonds END,
      CASE WHEN k = 'atom' THEN CAST(len(atoms) AS INT) WHEN k = '.' THEN -1 WHEN k = ')' THEN coalesce(stack[len(stack)], -1) ELSE last END,
      CASE WHEN k = '(' THEN list_append(stack, last) WHEN k = ')' THEN list_slice(stack, 1, len(stack) - 1) ELSE stack END,
      CASE WHEN k = 'ring' AND last >= 0 AND len(same) = 0 THEN list_append(rings, {{'label': x, 'atom': last, 'kind': kind}}) WHEN k = 'ring' THEN list_filter(rings, lambda r: r.label <> x) ELSE rings END,
      CASE WHEN k = 'bond' THEN kind || x ELSE '' END
    FROM (SELECT *, toks[pos + 1] AS x, list_filter(rings, lambda r: r.label = toks[pos + 1]) AS same,
      CASE WHEN regexp_full_match(toks[pos + 1], '\\[.*|Cl|Br|[BCNOPSFIbcnopsAa*]') THEN 'atom' WHEN regexp_full_match(toks[pos + 1], '%[0-9][0-9]|[0-9]') THEN 'ring' WHEN toks[pos + 1] IN ('(', ')', '.') THEN toks[pos + 1] ELSE 'bond' END AS k FROM g WHERE pos < len(toks))),
  h AS (SELECT toks, atoms, bonds FROM g WHERE pos = len(toks))"""
_BOTH = "SELECT l.smarts, a.atoms AS la, a.bonds AS lb, b.atoms AS ra, b.bonds AS rb FROM sides l JOIN sides r ON l.smarts = r.smarts AND l.side = 0 AND r.side = 1 JOIN h a ON a.toks = l.toks JOIN h b ON b.toks = r.toks"
_BOND_TEXT = "array_to_string(list_transform({0}, lambda b: CAST(b.a AS VARCHAR) || CASE WHEN b.ring THEN 'o' ELSE '' END || coalesce(nullif(b.kind, ''), '_') || CAST(b.b AS VARCHAR)), ' ')"
_DEGREE_TEXT = "array_to_string(list_transform(range(len({0})), lambda i: len(list_filter({1}, lambda b: b.a = i OR b.b = i))), ' ')"


@query(f"""{_GRAPH}, x AS ({_BOTH}) SELECT smarts, {_BOND_TEXT.format("lb")} || ' > ' || {_BOND_TEXT.format("rb")} AS bonds, {_DEGREE_TEXT.format("la", "lb")} || ' > ' || {_DEGREE_TEXT.format("ra", "rb")} AS degrees,
  CAST(len(lb) + len(rb) AS BIGINT) AS n_bonds, CAST(len(list_filter(lb, lambda b: b.ring)) + len(list_filter(rb, lambda b: b.ring)) AS BIGINT) AS n_rings FROM x""")
def template_graph(spark, sf_dir):
    rows = graphs.template_graph(_first(spark, sf_dir).select("smarts"))
    bond = lambda b: F.concat(b["a"].cast("string"), F.when(b["ring"], "o").otherwise(""), F.coalesce(F.nullif(b["kind"], F.lit("")), F.lit("_")), b["b"].cast("string"))
    bonds = F.transform("sides", lambda g: F.array_join(F.transform(g["bonds"], bond), " "))
    places = F.transform("degrees", lambda d: F.array_join(d.cast("array<string>"), " "))
    return rows.select("smarts", F.array_join(bonds, " > ").alias("bonds"), F.array_join(places, " > ").alias("degrees"), *[F.col(c).cast("bigint").alias(c) for c in ("n_bonds", "n_rings")])


@query(f"""{_GRAPH}, e AS (SELECT toks, atoms, unnest(list_concat(list_transform(bonds, lambda b: [b.a, b.b]), list_transform(bonds, lambda b: [b.b, b.a]))) AS ab, unnest(list_concat(list_transform(bonds, lambda b: b.kind), list_transform(bonds, lambda b: b.kind))) AS kind FROM h),
  p AS (SELECT toks, [i]::BIGINT[] AS p, atoms[i + 1] AS f, atoms[i + 1] AS b FROM (SELECT toks, atoms, unnest(range(len(atoms))) AS i FROM h)
    UNION ALL SELECT p.toks, list_append(p.p, e.ab[2]), f || kind || atoms[e.ab[2] + 1], atoms[e.ab[2] + 1] || kind || b FROM p JOIN e ON p.toks = e.toks AND e.ab[1] = p.p[len(p.p)] WHERE NOT list_contains(p.p, e.ab[2]) AND len(p.p) <= 7),
  n AS (SELECT DISTINCT toks, least(f, b) AS name FROM p), q AS (SELECT DISTINCT smarts, {_HASHED.format("md5(CAST(side AS VARCHAR) || ':' || name)", 1)} % 4096 AS bit FROM sides JOIN n ON sides.toks = n.toks)
SELECT smarts, CAST(count(*) AS BIGINT) AS n_bits, string_agg(CAST(bit AS VARCHAR), ' ' ORDER BY bit) AS bits FROM q GROUP BY 1""")
def path_fingerprint(spark, sf_dir):
    rows = graphs.path_fingerprint(_first(spark, sf_dir).select("smarts"))
    bits = rows.select("smarts", graph.set_bits(F.col("fingerprint")).alias("bits"))
    return bits.select("smarts", F.size("bits").cast("bigint").alias("n_bits"), F.array_join(F.col("bits").cast("array<string>"), " ").alias("bits"))


def _embedder(pooling: str) -> encoder.Embedder:
    config = encoder.EncoderConfig(len(VOCABULARY), d_model=32, nhead=4, num_encoder_layers=2, dim_feedforward=64, max_seq_len=32)
    return encoder.Embedder(config, encoder.random_weights(config), {t: k for k, t in enumerate(VOCABULARY)}, pooling)


@query()
def embed_mean(spark, sf_dir):
    return _embedder("mean").transform(_first(spark, sf_dir).select("smarts"))


@query()
def embed_cls(spark, sf_dir):
    return _embedder("cls").transform(_first(spark, sf_dir).select("smarts"))


@query()
def masked_accuracy(spark, sf_dir):
    known = _vocabulary(spark, sf_dir)
    masker = masking.SpanMasker(known)
    rows = masking.span_mask(encode.dataset(_first(spark, sf_dir).select("smarts"), known).drop("ok"), masker, "smarts")
    guesses = F.transform("input_ids", lambda x: F.array(*[((x + k) % len(known)).cast("bigint") for k in range(5)]))
    return metrics.masked_accuracy(rows.withColumn("guesses", guesses), masker.content_ids)


@query()
def pca2(spark, sf_dir):
    return classify.pca(table(spark, sf_dir, "embeddings"))[0].select("vec_id", "projection")


@query()
def tfidf_lr(spark, sf_dir):
    rows = written(tokenizer.with_tokens(_labelled(spark, sf_dir), "smarts").where("ok"), "labelled_tokens")
    rows = classify.label_index(rows)
    rows = splits.group_holdout(classify.tfidf(rows, min_df=1), 0.2, 42)
    out = classify.linear_classifier(rows.where("split = 'train'"), rows.where("split = 'test'"), max_iter=30)
    return out.select("smarts", "label_id", "predicted")


@query()
def vector_classifier(spark, sf_dir):
    rows = classify.vectors(table(spark, sf_dir, "embeddings").withColumn("label_id", F.col("label").cast("double")))
    out = classify.cross_validate(rows, 3, 42, "vec_id", scale=True, max_iter=30)
    return out.select("vec_id", "label_id", "predicted", "fold")


# --- labels, splits and lookups, continued -------------------------------------

_EC3 = _LABELLED.replace(", 1, 1), '.') AS label FROM t", ", 1, 3), '.') AS label FROM t")


def _labelled3(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _contenders(spark, sf_dir)
    return written(labels.join_labels(clean.reaction_groups(raw), labels.label_map(raw, 3)), "labelled")


@query(f"{_EC3} SELECT label, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY 1 HAVING count(*) < 10")
def dropped_classes(spark, sf_dir):
    rows = _labelled3(spark, sf_dir)
    return labels.dropped_classes(rows, labels.drop_rare(rows, labels.min_class_count(0, None)))


@query(f"{_LABELLED} SELECT smarts, label FROM l WHERE label IN ('1', '3', '6')")
def label_whitelist(spark, sf_dir):
    return labels.whitelist(_labelled(spark, sf_dir), ("1", "3", "6")).select("smarts", "label")


@query(f"""{_LABELLED}, n AS (SELECT label FROM l GROUP BY 1 HAVING count(*) >= greatest(10, CAST(floor(500.0 / (SELECT count(*) FROM l) * 10) AS BIGINT) + 2)),
  k AS (SELECT * FROM l WHERE label IN (SELECT label FROM n)), c AS (SELECT label, count(*) AS n FROM k GROUP BY 1), q AS (SELECT label, least(n, greatest(1, floor(500 * n / (SELECT count(*) FROM k)))) AS quota FROM c)
SELECT smarts, k.label, grp AS group_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || smarts), smarts) AS rn FROM k) k JOIN q ON k.label = q.label
WHERE rn <= quota OR 500 >= (SELECT count(*) FROM k)""")
def label_loader(spark, sf_dir):
    raw = _contenders(spark, sf_dir)
    rows, _ = labels.load_labelled(raw, clean.reaction_groups(raw), n_samples=500)
    return rows.select("smarts", "label", F.col("group").alias("group_id"))


@query(f"""{_LABELLED}, b AS (SELECT smarts, label FROM l) SELECT smarts, label, smarts AS group_id FROM b""")
def labelled_without_groups(spark, sf_dir):
    raw = _contenders(spark, sf_dir)
    validated = clean.reaction_groups(raw).drop("reaction_group")
    return labels.join_labels(validated, labels.label_map(raw)).select("smarts", "label", F.col("group").alias("group_id"))


_NAMES = {"1": "oxidoreductase", "2": "transferase", "3": "hydrolase", "4": "lyase", "5": "isomerase"}


@query(f"{_LABELLED} SELECT smarts, label, CASE {' '.join(f"WHEN label = '{k}' THEN '{v}'" for k, v in _NAMES.items())} ELSE '' END AS display FROM l")
def display_names(spark, sf_dir):
    return labels.lookup(_labelled(spark, sf_dir), _NAMES, "label", "display").select("smarts", "label", "display")


@query(f"{_LABELLED} SELECT smarts, CAST(dense_rank() OVER (ORDER BY label) - 1 AS DOUBLE) AS label_id FROM l")
def label_encoding(spark, sf_dir):
    return classify.label_index(written(_labelled(spark, sf_dir).select("smarts", "label"), "labels")).select("smarts", "label_id")


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) SELECT doc_id, CAST(quality AS BIGINT) AS quality, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) AS norm
FROM labels JOIN v ON doc_id = vec_id WHERE quality IS NOT NULL""")
def labelled_vectors(spark, sf_dir):
    known = table(spark, sf_dir, "labels").where("quality is not null")
    rows = known.join(table(spark, sf_dir, "embeddings"), F.col("doc_id") == F.col("vec_id"))
    return rows.select("doc_id", F.col("quality").cast("bigint").alias("quality"), F.round(vectors.norm(F.col("embedding")), 6).alias("norm"))


@query(f"{_LABELLED} SELECT smarts, CAST(CAST('0x' || substr(md5('42:' || grp), 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold FROM l")
def group_folds(spark, sf_dir):
    return splits.group_folds(_labelled(spark, sf_dir), 5, 42).select("smarts", "fold")


@query("SELECT doc_id, md5('7:3:' || CAST(doc_id AS VARCHAR)) AS draw FROM documents ORDER BY draw, doc_id")
def epoch_order(spark, sf_dir):
    rows = splits.epoch_order(table(spark, sf_dir, "documents").select("doc_id"), 7, 3, "doc_id")
    return rows.select("doc_id", labels.draw(7, F.lit("3"), F.col("doc_id")).alias("draw"))


@query("""WITH h AS (SELECT CAST(l_linenumber AS BIGINT) AS epoch, round(avg(l_discount), 9) AS val_loss FROM lineitem GROUP BY 1) SELECT epoch, val_loss FROM h ORDER BY val_loss, epoch LIMIT 1""")
def best_epoch(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    history = rows.groupBy(F.col("l_linenumber").cast("bigint").alias("epoch")).agg(F.round(F.avg(F.col("l_discount").cast("double")), 9).alias("val_loss"))
    return metrics.best_epoch(history)


# --- encoding and masks, continued ---------------------------------------------


@query(f"{_FIRST}, i AS (SELECT smarts, list_transform(string_split(smarts, ''), lambda x: {_LOOKUP}) AS ids FROM f) SELECT smarts, array_to_string(list_resize(ids, 24, 0), ' ') AS input_ids, CAST(least(len(ids), 24) AS BIGINT) AS n_real FROM i")
def encode_characters(spark, sf_dir):
    characters = lambda c: F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))
    rows = encode.dataset(_first(spark, sf_dir).select("smarts"), _vocabulary(spark, sf_dir), max_length=24, tokenize=characters)
    real = F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda s, x: s + x)
    return rows.select("smarts", F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"), real.alias("n_real"))


@query(f"{_TOKENS} SELECT smarts, array_to_string(list_transform(tokens, lambda x: {_LOOKUP}), ' ') AS ids FROM k WHERE ok AND len(tokens) > 0")
def lookup_join(spark, sf_dir):
    known = spark.createDataFrame(list(_vocabulary(spark, sf_dir).items()), "token string, id int")
    rows = written(_tokens(spark, sf_dir).where("ok").select("smarts", "tokens"), "tokens")
    return encode.lookup_join(rows, known, "smarts").select("smarts", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query(f"{_TOKENS} SELECT CAST(count(*) AS BIGINT) AS n FROM k")
def dataset_length(spark, sf_dir):
    return encode.dataset(_first(spark, sf_dir).select("smarts"), _vocabulary(spark, sf_dir), max_length=8).agg(F.count(F.lit(1)).alias("n"))


# Labels and guesses by a rule that both engines can follow.
@query(f"""{_IDS}, x AS (SELECT unnest(ids) AS id, unnest(range(0, len(ids))) AS pos, len(ids) AS n FROM p),
  y AS (SELECT id, list_transform([0, 1, 2, 3, 4], lambda j: (id + j * (1 + pos % 2) * (pos % 3)) % {len(VOCABULARY)}) AS guesses FROM x WHERE (pos + n) % 3 = 0)
SELECT round(coalesce(avg(CASE WHEN guesses[2] = id THEN 1.0 ELSE 0.0 END), 0.0), 6) AS top1, round(coalesce(avg(CASE WHEN list_contains(list_slice(guesses, 2, 5), id) THEN 1.0 ELSE 0.0 END), 0.0), 6) AS top5,
  round(coalesce(avg(CASE WHEN guesses[2] = id THEN 1.0 ELSE 0.0 END) FILTER (id >= 9), 0.0), 6) AS content_top1,
  round(coalesce(avg(CASE WHEN list_contains(list_slice(guesses, 2, 5), id) THEN 1.0 ELSE 0.0 END) FILTER (id >= 9), 0.0), 6) AS content_top5 FROM y""")
def masked_topk(spark, sf_dir):
    rows = encode.dataset(_first(spark, sf_dir).select("smarts"), _vocabulary(spark, sf_dir), max_length=6, bos=True, eos=True)
    n = F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda s, x: s + x)
    guess = lambda x, i: F.array(*[(x + j * (1 + i % 2) * (i % 3)) % len(VOCABULARY) for j in range(1, 5)])
    chosen = F.transform("input_ids", lambda x, i: F.when(((i + F.col("n")) % 3 == 0) & (i < F.col("n")), x).otherwise(F.lit(-100)))
    rows = rows.withColumn("n", n).withColumn("labels", chosen).withColumn("guesses", F.transform("input_ids", guess))
    return _rounded(metrics.masked_accuracy(rows, set(range(9, len(VOCABULARY)))))


# --- vectors, continued --------------------------------------------------------


@query(f"{_V}, q AS (SELECT e AS x FROM v WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(e, x), 6) AS similarity FROM v, q")
def cosine_to_first(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    probe = F.array(*[F.lit(float(x)) for x in rows.where("vec_id = 0").first()["embedding"]])
    return rows.select("vec_id", F.round(cosine(F.col("embedding"), probe), 6).alias("similarity"))


# --- files: written to the shared folder and read back --------------------------


@query(f"{_T} SELECT TEMPLATE_ID AS template_id, TEMPLATE AS smarts, VALID AS valid, REACTIONS AS reactions FROM t")
def csv_files(spark, sf_dir):
    folder = shared_folder(spark, "csv")
    raw = templates(spark, sf_dir).drop("ord", "ECS")
    paths = [f"{folder}/{k}" for k in range(2)]
    for k, path in enumerate(paths):
        files.write_csv(raw.where(F.pmod(F.crc32("TEMPLATE_ID"), F.lit(2)) == k), path)
    back = files.read_raw(spark, paths)
    return back.select(F.col("TEMPLATE_ID").alias("template_id"), F.col("TEMPLATE").alias("smarts"), F.col("VALID").alias("valid"), F.col("REACTIONS").alias("reactions"))


@query(f"{_FIRST} SELECT smarts FROM f")
def text_lines(spark, sf_dir):
    path = shared_folder(spark, "lines")
    files.write_lines(clean.clean(templates(spark, sf_dir)), path)
    return files.read_lines(spark, path).select("smarts")


@query(f"{_FIRST} SELECT smarts, CASE WHEN REACTIONS IS NOT NULL AND {_BLANK.format('REACTIONS')} <> '' THEN REACTIONS ELSE smarts END AS reaction_group FROM f")
def group_file(spark, sf_dir):
    path = shared_folder(spark, "groups")
    files.write_csv(clean.reaction_groups(templates(spark, sf_dir)), path)
    return files.read_groups(spark, path).select("smarts", "reaction_group")


@query(f"{_TOKENS} SELECT smarts FROM k WHERE ok AND tokens <> [] AND list_contains(tokens, '>>')")
def validated_file(spark, sf_dir):
    path = shared_folder(spark, "validated_csv")
    files.write_csv(clean.validate(_first(spark, sf_dir).select("smarts")), path)
    return files.read_validated(spark, path).select("smarts")


@query("SELECT 'v' || CAST(vec_id AS VARCHAR) AS smarts, CAST(len(embedding) AS BIGINT) AS dims, round(CAST(embedding[1] AS DOUBLE), 5) AS first FROM embeddings")
def index_file(spark, sf_dir):
    path = shared_folder(spark, "index")
    rows = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("smarts"), "embedding")
    files.write_index(rows, path, "mean")
    back = files.read_index(spark, path, "mean")
    return back.select("smarts", F.size("embedding").cast("bigint").alias("dims"), F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("first"))


@query("SELECT 'v' || CAST(vec_id AS VARCHAR) AS smarts, round(CAST(embedding[1] AS DOUBLE), 5) AS first, round(CAST(embedding[len(embedding)] AS DOUBLE), 5) AS last FROM embeddings")
def prediction_files(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("smarts"), "embedding")
    path = shared_folder(spark, "predictions")
    files.write_predictions(rows, f"{path}/json", "json")
    back = spark.read.schema("smarts string, embedding array<float>").json(f"{path}/json")
    return back.select("smarts", F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("first"), F.round(F.element_at("embedding", -1).cast("double"), 5).alias("last"))


@query(f"{_FIRST} SELECT smarts, smarts AS decoded FROM f")
def subword_round_trip(spark, sf_dir):
    import public_tokenizers

    model = subword.Subwords(public_tokenizers.path("piece_bpe_32k.model"))
    rows = _first(spark, sf_dir).select("smarts").withColumn("ids", model.ids(F.col("smarts")))
    return rows.select("smarts", model.text(F.col("ids")).alias("decoded"))


_REPORT = """SELECT '{0}' AS tokenizer, CAST(count(*) AS BIGINT) AS n, round(avg(len(u)), 6) AS mean_tokens, round(avg(len(u) / length(smarts)), 6) AS fertility,
  CAST((SELECT count(DISTINCT t) FROM (SELECT unnest(u) AS t FROM {1})) AS BIGINT) AS unique_tokens, round((SELECT count(DISTINCT t) FROM (SELECT unnest(u) AS t FROM {1})) * 1.0 / {2}, 6) AS vocabulary_use FROM {1}"""


@query(f"""{_TOKENS}, a AS (SELECT smarts, tokens AS u FROM k WHERE ok), b AS (SELECT smarts, string_split(smarts, '') AS u FROM k)
{_REPORT.format("grammar", "a", 1000)} UNION ALL {_REPORT.format("characters", "b", 256)}""")
def tokenizer_comparison(spark, sf_dir):
    rows = written(_tokens(spark, sf_dir).select("smarts", "tokens", "ok"), "tokens")
    characters = rows.select("smarts", F.regexp_extract_all("smarts", F.lit("(?s)."), F.lit(0)).alias("tokens"), F.lit(True).alias("ok"))
    out = stats.compare_tokenizers({"grammar": (rows.where("ok"), 1000), "characters": (characters, 256)}, "smarts", "tokens")
    return _rounded(out.select("tokenizer", "n", "mean_tokens", "fertility", "unique_tokens", "vocabulary_use"))


# --- reports without SQL ---------------------------------------------------------


@query()
def subword_comparison(spark, sf_dir):
    """The report of the grammar beside that of a public subword model."""
    import public_tokenizers

    model = subword.Subwords(public_tokenizers.path("piece_bpe_32k.model"))
    rows = written(_tokens(spark, sf_dir).select("smarts", "tokens", "ok"), "tokens")
    pieces = rows.select("smarts", model.pieces(F.col("smarts")).alias("tokens"), F.lit(True).alias("ok"))
    return stats.compare_tokenizers({"grammar": (rows, rows.select(F.explode("tokens")).distinct().count()), "subword": (pieces, model.vocab_size)}, "smarts", "tokens")


@query()
def masked_evaluation(spark, sf_dir):
    """Hits of a small model, trained on a bounded sample, at the masked places of all templates."""
    known = _vocabulary(spark, sf_dir)
    masker = masking.SpanMasker(known)
    rows = written(encode.dataset(_first(spark, sf_dir).select("smarts"), known, max_length=16).where("ok").drop("ok"), "encoded")
    config = encoder.EncoderConfig(masker.extended_size, d_model=32, nhead=4, num_encoder_layers=2, dim_feedforward=64, max_seq_len=16)
    weights = train.train(rows, train.Trainer(config, masker, epochs=3), max_rows=1000)
    return metrics.masked_accuracy(train.guesses(masking.span_mask(rows, masker, "smarts", epoch=0), config, weights), masker.content_ids)


@query()
def holdout_report(spark, sf_dir):
    """Precision, recall and F1 of a classifier of vectors, fitted on the larger part of a random split."""
    rows = splits.random_holdout(table(spark, sf_dir, "embeddings"), 0.2, 42, "vec_id")
    rows = classify.vectors(rows.withColumn("label_id", F.col("label").cast("double")))
    out = classify.linear_classifier(rows.where("split = 'train'"), rows.where("split = 'val'"), scale=True, max_iter=30)
    return metrics.class_metrics(out.select(F.col("label_id").cast("int").cast("string").alias("label"), F.col("predicted").cast("int").cast("string").alias("predicted")))


# --- indexes, joins and folds ------------------------------------------------------

#: Tokens as bits of five numbers, so that DuckDB can count what two sets share.
_SETS = f"""{_TOKENS}, d AS (SELECT smarts, list_sort(list_distinct(tokens)) AS s FROM k WHERE ok AND tokens <> []), v AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i FROM (SELECT DISTINCT unnest(s) AS t FROM d)),
  c AS (SELECT s, min(smarts) AS class, count(*) AS size, len(s) AS n FROM d GROUP BY s), b AS (SELECT class, i FROM (SELECT class, unnest(s) AS t FROM c) JOIN v USING (t)),
  m AS (SELECT class, {", ".join(f"coalesce(sum(1::BIGINT << CAST(i % 60 AS INT)) FILTER (i // 60 = {j}), 0)::BIGINT AS m{j}" for j in range(5))} FROM b GROUP BY 1),
  e AS (SELECT c.class, size, n, {", ".join(f"m{j}" for j in range(5))} FROM c JOIN m USING (class)),
  w AS (SELECT x.class AS a, y.class AS b, x.size AS a_size, y.size AS b_size, x.n + y.n AS n2, {" + ".join(f"CAST(bit_count(x.m{j} & y.m{j}) AS INT)" for j in range(5))} AS i FROM e x JOIN e y ON x.class < y.class AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
  p AS (SELECT * FROM w WHERE 100 * i >= 80 * (n2 - i))"""


@query(f"{_SETS} SELECT a, b, round(i * 1.0 / (n2 - i), 6) AS similarity FROM p")
def tanimoto_join_pairs(spark, sf_dir):
    _, found = set_join.set_join(_tokens(spark, sf_dir).where("ok").select("smarts", "tokens"), "smarts")
    return found.select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(f"""{_SETS}, l AS (SELECT class, sum(m) AS m FROM (SELECT a AS class, b_size AS m FROM p UNION ALL SELECT b, a_size FROM p) GROUP BY 1)
SELECT d.smarts, c.class, CAST(c.size - 1 + coalesce(m, 0) AS BIGINT) AS n_links FROM d JOIN c ON d.s = c.s LEFT JOIN l ON l.class = c.class""")
def tanimoto_join(spark, sf_dir):
    return set_join.set_join(_tokens(spark, sf_dir).where("ok").select("smarts", "tokens"), "smarts")[0]


def _lists(n: int) -> int:
    """About the root of the rows: lists and the rows of a list grow alike."""
    return max(4, round(math.sqrt(n)))


def _index(spark: SparkSession, sf_dir: str) -> tuple[vector_index.VectorIndex, DataFrame]:
    rows = table(spark, sf_dir, "embeddings")
    return vector_index.VectorIndex.build(rows, min(4096, _lists(rows.count()))), rows.where("vec_id % 50 = 0")


@query(ORACLE_SQL["batch_search"])
def index_search_exact(spark, sf_dir):
    index, asked = _index(spark, sf_dir)
    return index.search(asked, 5).select("query", "neighbour", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


@query()
def index_search(spark, sf_dir):
    """The best 10 rows in as many lists as give a recall of 0.9 on a sample of the queries."""
    index, asked = _index(spark, sf_dir)
    return index.search(asked, 10, index.tuned(asked))


@query()
def index_recall(spark, sf_dir):
    """Recall at 10 over all queries, and the share of the table's rows in the lists that a query reads."""
    index, asked = _index(spark, sf_dir)
    probes = index.tuned(asked)
    recall = index.recall(asked, 10, probes)
    sizes = index.table(asked).groupBy("list").agg(F.count(F.lit(1)).alias("n"))
    read = index._nearest(asked.select("vec_id", "embedding"), probes).select("vec_id", F.explode("lists").alias("list")).join(sizes, "list").groupBy("vec_id").agg(F.sum("n").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    return read.agg(F.avg("n").alias("n")).crossJoin(total).select(F.lit(len(index.centres)).alias("lists"), F.lit(probes).alias("probes"), F.lit(recall).alias("recall"), (F.col("n") / F.col("total")).alias("share_read"))  # one row each


@query()
def stratified_group_folds(spark, sf_dir):
    return group_folds_.stratified_group_folds(_labelled(spark, sf_dir), 5, 42).select("smarts", "label", F.col("group").alias("group_id"), "fold")


@query("SELECT vec_id, label, CAST((row_number() OVER (ORDER BY '=' || CAST(label AS VARCHAR), md5('42:' || CAST(vec_id AS VARCHAR)), vec_id) - 1) % 5 AS INTEGER) AS fold FROM embeddings")
def stratified_folds(spark, sf_dir):
    return group_folds_.stratified_folds(table(spark, sf_dir, "embeddings").select("vec_id", "label"), 5, 42)


@query()
def baseline_report(spark, sf_dir):
    """Precision, recall and F1 of a classifier on a stratified fifth, from the vectors and from random ones."""
    rows = written(group_folds_.stratified_folds(table(spark, sf_dir, "embeddings"), 5, 42).withColumn("label_id", F.col("label").cast("double")), "folds")
    dims = rows.select(F.max(F.size("embedding"))).first()[0] or 1
    out = None
    for name, own in (("vectors", rows), ("random", classify.random_features(rows, dims))):
        own = classify.vectors(own)
        found = classify.linear_classifier(own.where("fold <> 0"), own.where("fold = 0"), scale=True, max_iter=30)
        part = metrics.class_metrics(found.select(F.col("label").cast("string").alias("label"), F.col("predicted").cast("int").cast("string").alias("predicted"))).select(F.lit(name).alias("features"), "*")
        out = part if out is None else out.unionByName(part)
    return _rounded(out)


# --- stored corpora, sketches, data sources and streams ------------------------------


@query(ORACLE_SQL["labelled_join"])
def stored_join(spark, sf_dir):
    """The labelled join of two tables that lie bucketed by template: no row moves for it."""
    raw = templates(spark, sf_dir)
    stored = corpus.Corpus(spark, buckets=16)
    stored.store(clean.reaction_groups(raw), "groups")
    stored.store(labels.label_map(raw), "labels")
    return stored.join("groups", "labels").select("smarts", "label", F.coalesce("reaction_group", "smarts").alias("group_id"))


@query(f"{_TOKENS} SELECT ok AND list_contains(tokens, '>>') AS valid, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY 1")
def observed_tally(spark, sf_dir):
    """Valid and other templates, counted while the validated table is written."""
    return stages.tally_of(clean.validate(_first(spark, sf_dir).select("smarts")), shared_folder(spark, "validated"))


@query()
def sketched_lengths(spark, sf_dir):
    """Quantiles of text lengths from stored sketches of each source."""
    docs = table(spark, sf_dir, "documents")
    sketches = written(stats.length_sketches(docs, F.length("text"), "source"), "sketches")
    return stats.sketched_quantiles(sketches, [k / 20 for k in range(21)])


@query(ORACLE_SQL["index_file"])
def npy_files(spark, sf_dir):
    npy.register(spark)
    path = shared_folder(spark, "npy")
    rows = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("key"), F.col("embedding").cast("array<float>").alias("embedding"))
    rows.write.format("npy").mode("append").save(path)
    back = spark.read.format("npy").load(path)
    return back.select(F.col("key").alias("smarts"), F.size("embedding").cast("bigint").alias("dims"), F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("first"))


@query(ORACLE_SQL["encode_longest"])
def dataset_from_files(spark, sf_dir):
    folder = shared_folder(spark, "dataset")
    files.write_lines(clean.clean(templates(spark, sf_dir)), f"{folder}/lines")
    known = json.dumps({"token_to_id": _vocabulary(spark, sf_dir)})
    spark.createDataFrame([(known,)], "value string").coalesce(1).write.text(f"{folder}/vocabulary")
    rows = encode.dataset_from_files(spark, f"{folder}/vocabulary", f"{folder}/lines", bos=True, eos=True)
    return rows.select("smarts", "ok", F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("input_ids"))


@query("""WITH p AS (SELECT l_quantity / (50.0::DOUBLE / 40) AS u, l_extendedprice / (100000.0::DOUBLE / 24) AS v FROM lineitem),
  q AS (SELECT u, v, floor(u + 0.5) AS a, floor(v + 0.5) AS b, floor(u) AS c, floor(v) AS d FROM p),
  r AS (SELECT *, (u - a) * (u - a) + 3 * (v - b) * (v - b) < (u - (c + 0.5)) * (u - (c + 0.5)) + 3 * (v - (d + 0.5)) * (v - (d + 0.5)) AS f FROM q)
SELECT CASE WHEN f THEN 0 ELSE 1 END AS lattice, CAST(CASE WHEN f THEN a ELSE c END AS BIGINT) AS "column", CAST(CASE WHEN f THEN b ELSE d END AS BIGINT) AS "row", CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1, 2, 3""")
def hexagon_counts(spark, sf_dir):
    return stats.hexagons(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", (0.0, 50.0, 0.0, 100000.0))


def _arrivals(spark: SparkSession, sf_dir: str, parts: int = 3) -> tuple[str, str]:
    """Folders of valid templates, written part after part in the order of their rows, and for the first row of each."""
    folder = shared_folder(spark, "arrivals")
    raw = templates(spark, sf_dir)
    rows = raw.where(text.is_true(F.col("VALID")) & text.not_blank(F.col("TEMPLATE")))
    order = F.format_string("%020d-%020d-%020d-%020d", *[F.col(f"ord.o{k}") for k in (1, 2, 3, 4)])
    rows = written(rows.select(text.strip(F.col("TEMPLATE")).alias("smarts"), order.alias("ord")), "valid")
    cuts = [r for r in rows.select(F.percentile_approx(F.substring("ord", 1, 20).cast("bigint"), [k / parts for k in range(1, parts)])).first()[0] or []]
    at = F.substring("ord", 1, 20).cast("bigint")
    for k, (low, high) in enumerate(zip([None, *cuts], [*cuts, None])):
        own = rows
        own = own if low is None else own.where(at > low)
        own = own if high is None else own.where(at <= high)
        own.write.mode("append").parquet(f"{folder}/in")
    return f"{folder}/in", f"{folder}/first"


@query(f"{_FIRST} SELECT smarts FROM f")
def keep_first_stream(spark, sf_dir):
    """The first row of each template of files that arrive one after the other."""
    arrived, path = _arrivals(spark, sf_dir)
    state.first_rows_of_files(spark, arrived, "smarts string, ord string", "smarts", "ord", path)
    return spark.read.schema("smarts string, ord string, batch int").parquet(path).select("smarts")


@query(ORACLE_SQL["token_frequencies"])
def vocabulary_stream(spark, sf_dir):
    """Running token counts over the first rows of a stream of files."""
    arrived, path = _arrivals(spark, sf_dir)
    state.first_rows_of_files(spark, arrived, "smarts string, ord string", "smarts", "ord", path)
    stream = spark.readStream.schema("smarts string, ord string, batch int").parquet(path)
    tokens = tokenizer.with_tokens(stream, "smarts").where("ok").select(F.explode("tokens").alias("token"))
    return state.running_counts(spark, tokens, "token", shared_folder(spark, "counts"))


@query()
def neighbour_graph(spark, sf_dir):
    """About the 15 nearest rows of every vector, by descent, as an undirected graph of fuzzy weights."""
    return neighbours.fuzzy_weights(neighbours.neighbours(table(spark, sf_dir, "embeddings"), 15), 15)
