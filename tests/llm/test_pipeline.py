"""The pipeline on a small table: every stage against what it must do to its own input."""

import zlib

import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from vintagelake.llm import minhash, mixing, pii, rules
from vintagelake.llm import queries as q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Every stage's input and output, as rows."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF).cache()
        out.append((docs, made))
        docs = made
    return out


def test_columns(stages):
    for docs, made in stages[:-1]:
        assert made.columns == docs.columns and made.count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "personal data", "mixing", "token ids"]


def test_quality_stage(spark, stages):
    docs, made = stages[0]
    kept = {r.doc_id for r in rules.quality_rules(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("kept").collect()}
    assert {r.doc_id for r in made.collect()} == kept


def test_dedup_stage_against_all_pairs(stages):
    from tests.llm.test_minhash import brute

    docs, made = stages[1]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(r.doc_id for r in made.collect()) == sorted(set(brute(rows).values()))


def test_pii_stage(stages):
    docs, made = stages[2]
    before, after = ({r.doc_id: r for r in df.collect()} for df in (docs, made))
    assert before.keys() == after.keys()
    found = {r.doc_id: r.n_valid for r in pii.findings(docs).collect()}
    for i, r in after.items():
        assert (r.text == before[i].text) == (not found[i]), i
        assert r.n_chars == len(r.text or "")


def test_mixing_stage(spark, stages):
    docs, made = stages[3]
    rates = {r.doc_id: r.mix_rate for r in mixing.mixed(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    counts = {r.doc_id: r["count"] for r in made.groupBy("doc_id").count().collect()}
    assert all(int(x) <= counts.get(i, 0) <= int(x) + 1 for i, x in rates.items())


def test_token_stage(stages):
    docs, made = stages[4]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    got = sorted((r.doc_id, tuple(int.from_bytes(r.token_ids[i : i + 4], "little") for i in range(0, len(r.token_ids), 4))) for r in made.collect())
    assert got == want


def test_run_and_registered_queries(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    names = [n for n in q.queries() if n.startswith("op")]
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)] and "pipeline" in q.queries()


def test_stage_edge_cases(spark):
    """Nulls, empty texts, repeated rows and clashing columns go through every stage."""
    text = " ".join(f"word{k}" for k in range(80))
    rows = [(1, text, None, None, 1, "c"), (1, text, None, None, 1, "c"), (None, text + " more", "en", "s", None, "c"), (3, None, "en", "s", 0, "c"), (4, "", "en", "s", 0, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for _, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        assert made.count() <= docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).count() == 0 and stage(spark, docs, SF).columns == docs.columns


def test_hash_parts(spark):
    from vintagelake.llm.common import hash_part

    got = spark.range(50).select("id", hash_part("id", 5).alias("p")).collect()
    assert all(r.p == zlib.crc32(str(r.id).encode()) % 5 for r in got) and spark.createDataFrame([(None,)], "id long").select(hash_part("id", 4)).first()[0] == 0


def test_class_ids_of_a_sample_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = minhash.near_duplicates(docs)
    assert out.count() == docs.count() and out.where("class_id > doc_id").count() == 0 and out.groupBy("class_id").agg(F.count("*").alias("n"), F.max("class_size").alias("s")).where("n <> s").count() == 0
