"""Quality rules against a plain statement of each measure."""

import math
import re
from collections import Counter

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from vintagelake.llm import rules

LABELS = "doc_id long, quality int, toxic int"


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    held = {i + k for i, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if grams[g] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(held)


@given(st.text(alphabet="ab #|\n\t \u0085é\x1c", max_size=80))
def test_measures(text):
    words = text.encode().split()
    assert rules.base_measures(text, words) == plain(text)


def test_query_against_brute_force(spark):
    good = [f"the green field number {i} lies by the river where people walk and talk " * 1 + " ".join(f"good{i}x{k}" for k in range(60)) for i in range(6)]
    bad = ["buy now cheap " * 40, "short", "", None, "zz " * 80]
    rows = [(i, t, "lost") for i, t in enumerate(good + bad)] + [(None, good[0], "x"), (0, good[0], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(4)] + [(7, 0, 0), (None, 1, 0), (0, None, None)], LABELS)
    out = rules.quality_rules(docs, labels).collect()
    assert len(out) == len(rows)
    buckets = [rules.ngram_buckets((t or "").encode().split()).tolist() if t else [] for _, t, _ in rows]

    def ratio(k):
        """By counters over the other rows."""
        raw = Counter(b for j, x in enumerate(buckets) if j != k for b in x)
        trusted = Counter(b for j, x in enumerate(buckets) if j != k and rows[j][0] in range(4) for b in x)
        return np.mean([math.log((trusted[b] + rules.PRIOR) / (trusted.total() * raw[b] / raw.total() + rules.PRIOR)) for b in buckets[k]]) if buckets[k] else 0.0

    by = {(r.doc_id, r.n_words): r for r in out}
    for k, (i, t, _) in enumerate(rows):
        t = t or ""
        want = plain(t)
        r = by[i, want[0]]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        llr = ratio(k)
        assert r.base_failed == failed and math.isclose(r.llr, llr, abs_tol=1e-9) and r.kept == (not failed and llr >= rules.THRESHOLD)


def test_empty_tables(spark):
    none, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], LABELS)
    assert rules.quality_rules(none, labels).count() == 0
    one = rules.quality_rules(spark.createDataFrame([(1, "word " * 3)], "doc_id long, text string"), labels).first()
    assert one.llr == 0.0 and one.base_failed


def test_clean_documents_are_kept_alike_with_and_without_a_label(spark):
    """By the given tables: prose without junk marks is kept at every size, labelled or not; marked junk goes where the table is not tiny."""
    for sf, junk_kept in (("sf0.001", 1.0), ("sf0.01", 0.15)):
        docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
        texts = {r.doc_id: r.text for r in docs.collect()}
        labelled = {r.doc_id for r in labels.where("quality = 1").collect()}
        out = [r for r in rules.quality_rules(docs, labels).collect() if not r.base_failed]
        junk = {r.doc_id for r in out if r.n_symbols > 0.3 * r.n_words}
        for part in ([r for r in out if r.doc_id in labelled], [r for r in out if r.doc_id not in labelled and r.doc_id not in junk]):
            assert len(part) > 40 and sum(r.kept for r in part) >= 0.99 * len(part)
        assert sum(r.kept for r in out if r.doc_id in junk) <= junk_kept * len(junk) and texts


def test_long_text_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "word other " * 300_000, 5, "x"), (1, "word other " * 300_000, 5, "x")], "doc_id long, text string, llr int, trusted string")
    out = rules.quality_rules(docs, spark.createDataFrame([(1, 1, 0)], LABELS), keep=["doc_id", "llr", "trusted"])
    assert out.columns[:2] == ["doc_id", "trusted"] and out.columns.count("llr") == 1 and [r.n_words for r in out.collect()] == [600_000] * 2


def test_every_trusted_document_is_fitted_on(spark):
    labels = spark.range(45_000).selectExpr("id % 22500 as doc_id", "1 as quality", "0 as toxic").union(spark.createDataFrame([(None, 1, 0), (30_000, 0, 0)], LABELS))
    ids = rules.trusted_ids(labels)
    assert ids.count() == ids.select("doc_id").distinct().count() == 22_500


def test_trust_is_found_by_broadcast_and_by_shuffle(spark, monkeypatch):
    wanted = {-1, 0, 5, 1023, 1024, 1 << 40, -(1 << 40)}
    rows = spark.createDataFrame([(i,) for i in [*wanted, 1, 1025, -2, -1024, (1 << 40) + 1024, None, 5]], "doc_id long")
    ids = rules.trusted_ids(spark.createDataFrame([(i, 1, 0) for i in wanted], LABELS))
    for bound in (rules.BROADCAST_BYTES, 0):
        monkeypatch.setattr(rules, "BROADCAST_BYTES", bound)
        out = rules.with_trust(rows, ids).collect()
        assert len(out) == 14 and all(r.trusted == (r.doc_id in wanted) for r in out)
