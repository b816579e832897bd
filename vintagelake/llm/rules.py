"""Quality rules: base measures of a text, and a log-likelihood ratio of hashed n-grams between trusted and raw text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vintagelake.llm.common import let_go, steps

BUCKETS = 1 << 16
#: Mean log ratio a kept document reaches: e to this power is how much rarer its n-grams may be in trusted text.
THRESHOLD = -0.1
#: Bytes of packed ids of trusted documents that are broadcast at most.
BROADCAST_BYTES = 64 << 20
#: Occurrences, as likely in trusted as in raw text, that are added to each bucket: rare n-grams speak little.
PRIOR = 10.0
SYMBOLS = re.compile(r"[#*$%&|<>]")
SPACES = re.compile(r"[\x20\x09-\x0D]")


def ngram_buckets(words: list[bytes]) -> np.ndarray:
    """Buckets of a text's words and of its pairs of neighbouring words."""
    h = np.fromiter(map(crc32, words), np.uint64, len(words))
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    both = np.concatenate([h * np.uint64(0xD6E8FEB86659FD93), pairs])
    return ((both ^ (both >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64) % BUCKETS


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of three words found twice or more in the text, its first place included."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    k = len(seen)
    if k >= 2_000_000:  # three such numbers would not fit 64 bits
        _, pair = np.unique(ids[:-2] * k + ids[1:-1], return_inverse=True)
        code = pair * k + ids[2:]
    else:
        code = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line of the text."""
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(lines) - len(set(lines))


def base_measures(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    return len(words), len(text) - len(SPACES.findall(text)), len(SYMBOLS.findall(text)), duplicate_lines(text), repeated_words(words)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id, trusted) of the documents that the trusted multinomial is fitted on: all that labels mark good, once each."""
    return labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumn("trusted", F.lit(True))


def with_trust(rows: DataFrame, trusted: DataFrame) -> DataFrame:
    """rows with `trusted`: whether their doc_id is one of the trusted ones.

    Ids are packed by blocks of neighbouring ones, about two bytes each, so that a broadcast takes the place of a shuffle of
    all texts; where they need more than BROADCAST_BYTES, texts are shuffled. Both give the same rows.
    """
    block, place = F.shiftright("doc_id", 10), F.col("doc_id").bitwiseAND(F.lit(1023)).cast("smallint")
    packed = trusted.groupBy(block.alias("block")).agg(F.collect_set(place).alias("places"))
    size = packed.agg(F.sum(2 * F.size("places") + 64)).first()[0] or 0
    joined = rows.withColumn("block", block).join(F.broadcast(packed) if size <= BROADCAST_BYTES else packed, "block", "left")
    return joined.select(*rows.columns, F.coalesce(F.array_contains("places", place), F.lit(False)).alias("trusted"))


def ngram_counts(marked: DataFrame) -> DataFrame:
    """(bucket, raw, trusted): n-grams of all rows of (text, trusted), and of the trusted ones, summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for part, texts in steps(batches, "text"):
            for t, is_good in zip(texts, part.column("trusted").to_pylist(), strict=True):
                counts = np.bincount(ngram_buckets(t.encode().split()), minlength=BUCKETS) if t else 0
                raw += counts
                if is_good:
                    good += counts
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(good[used])], names=["bucket", "raw", "trusted"])

    return marked.select("text", "trusted").mapInArrow(run, "bucket bigint, raw bigint, trusted bigint").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted"))


def count_arrays(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Raw and trusted counts by bucket; at most BUCKETS rows reach the driver."""
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for row in counts.collect():
        raw[row.bucket], good[row.bucket] = row.raw, row.trusted
    return raw, good


def log_ratio(buckets: np.ndarray, trusted: bool, raw: np.ndarray, good: np.ndarray, raw_sum: float, good_sum: float) -> float:
    """Mean over a text's n-grams of log(trusted share / raw share), by counts that leave the text itself out.

    PRIOR occurrences are added to a bucket's trusted count and to what its raw share lets expect of it.
    """
    used, own = np.unique(buckets, return_counts=True)
    n = len(buckets)
    seen = good[used] - own * trusted
    total = good_sum - n * trusted
    if not n or total <= 0 or raw_sum <= n:  # nothing speaks against the text
        return 0.0
    expected = total * (raw[used] - own) / (raw_sum - n)
    return float((np.log((seen + PRIOR) / (expected + PRIOR)) * own).sum() / n)


def quality_rules(docs: DataFrame, labels: DataFrame, text: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """Rows with `keep` (default doc_id), the base measures, base_failed, llr and kept; no row is dropped.

    llr is the mean log ratio of a text's n-grams (0 without words) between the other trusted and the other raw texts.
    kept: not base_failed and llr >= threshold. A null text has no words. A null or repeated doc_id is judged as any row;
    where labels hold a document twice, its larger quality counts. Equal rows stay; empty tables give no rows; without a
    trusted document every llr is 0. Columns of docs that are named like the new ones give way.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept"]
    keep = [c for c in (keep or ["doc_id"]) if c not in names]
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col("doc_id"), F.col(f"`{text}`").alias("text"))
    marked = with_trust(packed, trusted_ids(labels)).select("row", "text", "trusted")
    raw, good = count_arrays(ngram_counts(marked))
    shared = docs.sparkSession.sparkContext.broadcast((raw, good))
    raw_sum, good_sum = float(raw.sum()), float(good.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(None)
        for part, texts in steps(batches, "text"):
            rows = []
            for t, trusted in zip(texts, part.column("trusted").to_pylist(), strict=True):
                words = t.encode().split()
                n, *measures = base_measures(t, words)
                failed = n < min_words or 100 * measures[-1] > max_repeat_percent * n
                llr = log_ratio(ngram_buckets(words), trusted, *shared.value, raw_sum, good_sum) if n else 0.0
                rows.append((n, *measures, failed, llr, not failed and llr >= threshold))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([part.column("row"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=["row", *names])

    made = StructType.fromDDL("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, llr double, kept boolean")
    return marked.mapInArrow(run, StructType([marked.schema["row"], *made.fields])).select(*(F.col(f"row.`{c}`") for c in keep), *names)
