"""The pipeline's stages, each against brute force on its own input, and the queries' columns."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stepweave.llm import decontaminate, language_id, ngram_join, queries
from tests.llm.test_operators import EDGES, brute_lines, check_bins, passage, plain_prediction


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """The rows after each stage, the input first."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(folder / name)
        stage(spark, tables[-1], sf_dir).write.parquet(path)
        tables.append(spark.read.parquet(path))
    return tables


def test_columns_stay(stages):
    for t in stages[1:-1]:
        assert t.columns == stages[0].columns and t.dtypes == stages[0].dtypes


def test_stages(spark, sf_dir, stages):
    rows = [{r["doc_id"]: r for r in t.collect()} for t in stages[:-1]]
    documents, language, lines, near, clean = rows
    profiles = language_id.fit_profiles(stages[0])
    floor = language_id.SIGMAS / language_id.DIMENSIONS**0.5
    letters = {i: sum(map(str.isalpha, r["text"] or "")) for i, r in documents.items()}
    assert set(language) == {i for i, r in documents.items() if letters[i] and (letters[i] < 100 or plain_prediction(r["text"], profiles)[1] >= floor)}
    want = brute_lines([(i, r["text"], r["source"]) for i, r in language.items()], 10)
    assert {i: r["text"] for i, r in lines.items()} == {i: t for i, (_, _, t) in want.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in lines.values() if want[r["doc_id"]][1])
    groups = ngram_join.brute_force([(i, r["text"]) for i, r in lines.items()])
    assert set(near) == {i for i, (head, _, n) in groups.items() if head == i}
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    gone = set(near) - set(clean)
    found = {r["doc_id"] for r in decontaminate.contaminated(stages[3], spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert gone == found
    short = [(i, r["text"]) for i, r in near.items() if len(r["text"] or "") < 800]
    assert {i for i, _ in decontaminate.brute_force(short, items)} == gone & {i for i, _ in short}
    packed = stages[5].collect()
    check_bins(packed, {i: r["source"] for i, r in clean.items()}, 2048)
    assert {r["doc_id"] for r in packed} == set(clean)


def test_run(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir)
    assert sorted((r["doc_id"], r["piece"], r["n_tokens"]) for r in got.collect()) == sorted((r["doc_id"], r["piece"], r["n_tokens"]) for r in stages[5].collect())


CONTRACT = {
    "op1_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op2_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op3_packing": ["doc_id"],
    "op4_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op5_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op6_decontamination": ["doc_id", "item_id"],
    "op7_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op8_line_dedup": ["doc_id", "n_lines", "n_removed", "kept_sha256"],
    "op9_ngram_join": ["doc_id", "class_id", "n_links"],
    "op10_media": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
}


@pytest.mark.parametrize("name", list(CONTRACT))
def test_query(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    assert df.columns[: len(CONTRACT[name])] == CONTRACT[name]
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    rows = df.collect()
    assert rows and (name in ("op3_packing", "op6_decontamination") or len(rows) == n)
    if name in queries.ORACLE_SQL:
        c = duckdb.connect()
        c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
        rel = c.sql(queries.ORACLE_SQL[name])
        at = [rel.columns.index(x) for x in df.columns]
        assert sorted(map(tuple, rows)) == sorted(tuple(r[i] for i in at) for r in rel.fetchall())


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_rejected_documents(spark, sf_dir):
    docs = spark.createDataFrame([(1, None, "en", "a", 0), (2, "12 34", "en", "a", 5), (3, "words", None, "a", 5)], SCHEMA)
    assert [r["doc_id"] for r in corpus_pipeline.language(spark, docs.unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").limit(50)), sf_dir).where("doc_id <= 3 and n_chars <= 5").collect()] == [3]
    assert language_id.UNKNOWN == "und"


@pytest.mark.parametrize("label", [None, "und"])
def test_documents_without_labels_stay(spark, sf_dir, label):
    docs = spark.createDataFrame([(i, passage(i, 60), label, "a", 1) for i in range(20)] + [(20, "3", label, "a", 1)], SCHEMA)
    assert sorted(r["doc_id"] for r in corpus_pipeline.language(spark, docs, sf_dir).collect()) == list(range(20))


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls, empty and very long texts, repeated rows, and columns with the names that operators use inside."""
    extra = ("its_id", "its_key", "again_id", "again_key", "gone", "__gone", "__text", "__id", "h1", "h2", "key", "score", "lang_pred", "n_lines", "class_id", "bucket", "block", "place")
    docs = spark.createDataFrame([(i, t, "en", f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(EDGES)], SCHEMA)
    docs = docs.withColumns({c: F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in extra})
    ids = lambda df: sorted((r["doc_id"] for r in df.collect()), key=str)
    every = sorted((i for i, _ in EDGES), key=str)
    lettered = sorted((i for i, t in EDGES if any(map(str.isalpha, t or ""))), key=str)
    for (name, stage), want in zip(corpus_pipeline.STAGES[:4], (lettered, every, sorted([1, 2, 3, 4, 5, 7, 8, 10], key=str), every)):
        out = stage(spark, docs, sf_dir)
        if name == "lines":
            assert set(out.columns) == set(docs.columns)
        else:
            assert out.columns == docs.columns
        assert ids(out) == want, name
        assert all(r["score"] == f"score {'none' if r['doc_id'] is None else r['doc_id']}" and r["__gone"].startswith("__gone ") for r in out.collect())
    assert set(ids(corpus_pipeline.packing(spark, docs, sf_dir))) == set(every)


def test_empty_input(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
