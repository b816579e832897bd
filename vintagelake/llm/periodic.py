"""Periodic runs of words: repeated k-gram masking, then divide and conquer (Main and Lorentz) over what survives it.

A run of period q and length L has L - q words equal to the words q later, so each of its words lies in a k-gram that the text
repeats, where k is the least such overlap. Words outside repeated k-grams cannot join a run and cut the text into segments. A
run of three periods or more that crosses the middle of a segment holds a square (two equal neighbouring stretches) that ends,
begins or is centred there: hashes of prefixes find such squares for all periods at once, and words are compared to extend them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vintagelake.llm.common import let_go, steps

MIN_WORDS = 24
MIN_PERIODS = 3
#: An odd base of the prefix hashes, which are sums modulo 2 to the 64: equal stretches always agree, others are compared word by word.
BASE = np.uint64(0x9E3779B97F4A7C15)


def least_overlap(min_words: int, min_periods: int) -> int:
    """The fewest words of a run that are followed by an equal word one period later."""
    return min(max(min_words - q, (min_periods - 1) * q) for q in range(1, min_words + 1))


class Words:
    """A text's words as numbers, with what tells quickly whether two stretches may be equal."""

    def __init__(self, words: list[bytes]):
        seen: dict[bytes, int] = {}
        self.ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
        n = len(self.ids)
        mixed = (self.ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        self.power = np.ones(n + 1, np.uint64)
        np.cumprod(np.full(n, BASE), out=self.power[1:])
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed * self.power[:n], out=self.prefix[1:])

    def repeated(self, k: int) -> np.ndarray:
        """Which words lie in a stretch of k words that the text holds twice or more."""
        n = len(self.ids)
        held = np.zeros(n, bool)
        if n <= k:
            return held
        grams = (self.prefix[k:] - self.prefix[:-k]) * self.power[n - k :: -1]
        order = np.argsort(grams, kind="stable")
        same = grams[order[1:]] == grams[order[:-1]]
        twice = np.zeros(n - k + 1, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        steps_ = np.zeros(n + 1, np.int64)
        steps_[:-k][twice] += 1
        steps_[k:][twice] -= 1
        return np.cumsum(steps_[:-1]) > 0

    def squares(self, lo: int, mid: int, hi: int, min_periods: int) -> list[tuple[int, int]]:
        """(start, period) of what may be squares inside lo to hi that end, are centred or begin at mid, by rising period."""
        most = (hi - lo) // min_periods
        p, found = self.prefix, []
        for back in (2, 1, 0):
            q = min(most, (mid - lo) // back if back else most, (hi - mid) // (2 - back) if back < 2 else most)
            if q > 0:
                at = [slice(mid + k, mid + k * q + (1 if k > 0 else -1), k) if k else slice(mid, mid + 1) for k in (-back, 1 - back, 2 - back)]
                a, b, c = (p[self.window(s)] for s in at)
                hit = np.flatnonzero((b - a) * self.power[1 : q + 1] == c - b) + 1
                found += [(mid - back * x, x) for x in hit.tolist()]
        return sorted(found, key=lambda x: x[1])

    @staticmethod
    def window(s: slice) -> slice:
        return slice(s.start, None, s.step) if s.stop < 0 else s

    def extended(self, start: int, period: int) -> tuple[int, int]:
        """The widest stretch around `start` in which words `period` apart are equal."""
        w, n = self.ids, len(self.ids)
        right, step = start, 64
        while right + period < n:
            a, b = w[right : right + step], w[right + period : right + period + step]
            differ = np.flatnonzero(a[: len(b)] != b)
            if len(differ):
                right += int(differ[0])
                break
            right, step = right + len(b), step * 2
        left, step = start, 64
        while left > 0:
            a, b = w[max(0, left - step) : left], w[max(0, left - step) + period : left + period]
            differ = np.flatnonzero(a != b)
            if len(differ):
                left -= len(a) - 1 - int(differ[-1])
                break
            left, step = left - len(a), step * 2
        return left, right + period


def find_runs(words: list[bytes], min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and then period.

    A run is a stretch with smallest period q, at least min_words and min_periods * q long, that neither neighbouring word extends.
    """
    if min_periods < 3 or min_words < 2:
        raise ValueError("a run has three periods and two words at least")
    n, least = len(words), min_words
    if n < least:
        return []
    text = Words(words)
    masked = text.repeated(least_overlap(min_words, min_periods))
    edges = np.flatnonzero(np.diff(np.concatenate([[0], masked.view(np.int8), [0]])))
    runs: dict[tuple[int, int], int] = {}
    for lo, hi in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        # what is known: stretches of one period (those too short for runs as well) that reach into the part
        todo: list[tuple[int, int, list[tuple[int, int, int]]]] = [(lo, hi, [])]
        while todo:
            a, b, known = todo.pop()
            known = [k for k in known if k[0] < b and k[1] > a]
            # inside a stretch of period q another run is shorter than q and its own period, so it has a period under q / 2
            if b - a < least or any(s <= a and b <= e and 3 * q <= 2 * min_words for s, e, q in known):
                continue
            mid = (a + b) // 2
            found = text.squares(a, mid, b, min_periods)
            at = 0
            while at < len(found):
                start, period = found[at]
                at += 1
                if any(s <= start and start + 2 * period <= e and period % q == 0 for s, e, q in known):
                    continue
                s, e = text.extended(start, period)
                if e - s < 2 * period:  # hashes agreed by chance
                    continue
                known.append((s, e, period))
                if len(found) - at > 8:
                    found = found[:at] + [x for x in found[at:] if x[1] % period or x[0] < s or x[0] + 2 * x[1] > e]
                if e - s >= max(least, min_periods * period):
                    runs[s, e] = min(period, runs.get((s, e), period))
            todo += [(a, mid, known), (mid, b, known)]
    return sorted((s, e - s, q) for (s, e), q in runs.items())


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [w for w, gone in zip(words, np.cumsum(change[:-1]) > 0, strict=True) if not gone]


def planted(words: list[bytes], h: int) -> list[bytes]:
    """The words, of which those from a place on repeat with a period if h is a multiple of ten; place and period follow from h."""
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def periodic_runs(docs: DataFrame, text: str = "text", keep: list[str] | None = None, plant: Column | None = None, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """Rows with `keep` (default doc_id), n_words, runs (start, length, period) and collapsed, the kept words joined by a blank.

    Words are what white space (codes 32 and 9 to 13) leaves. plant: a number for each row by which `planted` makes its words
    periodic first (null: not). A null or empty text, or one without words, has no runs and an empty collapsed text. Repeated
    rows are treated alike; an empty table gives no rows. Whole texts are read; a text is the unit of work of one task.
    Columns of docs that are named like the new ones give way.
    """
    new = StructType.fromDDL("n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    keep = [c for c in dict.fromkeys(keep or ["doc_id"]) if c not in new.names]
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col(f"`{text}`").alias("text"), (F.lit(None) if plant is None else plant).cast("bigint").alias("plant"))
    kinds = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go(None)
        for part, texts in steps(batches, "text"):
            made: list[list] = [[], [], []]
            for t, h in zip(texts, part.column("plant").to_pylist(), strict=True):
                words = t.encode().split()
                words = words if h is None else planted(words, h)
                runs = find_runs(words, min_words, min_periods)
                made[0].append(len(words))
                made[1].append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                made[2].append(b" ".join(kept_words(words, runs) if runs else words).decode())
            yield pa.RecordBatch.from_arrays([part.column("row"), *(pa.array(x, k) for x, k in zip(made, kinds, strict=True))], names=["row", *new.names])

    return packed.mapInArrow(run, StructType([packed.schema["row"], *new.fields])).select(*(F.col(f"row.`{c}`") for c in keep), *new.names)


def run_digests(runs: DataFrame, keep: list[str]) -> DataFrame:
    """Rows of periodic_runs as their number, the strongest run and digests of all runs and of the collapsed text."""
    # runs are sorted by start, then period, so the first of equally strong ones stays
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    strongest = F.reduce("runs", none, lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    out = runs.withColumn("_top", strongest)
    return out.select(*keep, F.size("runs").cast("bigint").alias("n_runs"), "_top.start", "_top.length", "_top.period", F.expr("1000 * _top.length div _top.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def plant_number(doc_id: str = "doc_id") -> Column:
    """crc32 of a document's decimal id; null for a null id, whose text stays as it is."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))
