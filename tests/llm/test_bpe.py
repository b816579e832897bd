"""Encoding, decoding and counts against the tokenizers library itself."""

import hashlib
import random

import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vintagelake.llm import bpe

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
TEXTS = [
    "", " ", "\n\n  a", "Hello world's  it's", "ÀÉ naïve Σσς ΑΣ", "x" * 5000, "a b\tc\r\nd  ", "<|endoftext|> inside <|endoftext|>", "12345 3.14 ½ ٣", "日本語 テキスト 한국어", "\u0000\u001c\u0085   é",
    "don't we'll they've I'm he'd you're 's 'S", "!!!??... --- __ (a)[b]{c}", "\U0001f600\U0001f468‍\U0001f469", "  leading and trailing   ", "İI ı ſ", "aaaa" * 300 + "b",
]


@pytest.fixture(scope="module", params=NAMES)
def pair(request):
    path = public_tokenizers.path(request.param)
    return path, Tokenizer.from_file(path), bpe.Vocabulary(path)


def ids_of(blob):
    return [int.from_bytes(blob[i : i + 4], "little") for i in range(0, len(blob), 4)]


def test_encode_decode_count(pair):
    _, library, own = pair
    for t, blob, n in zip(TEXTS, own.encode(TEXTS), own.count(TEXTS), strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert ids_of(blob) == want, t[:40]
        assert n == len(want)
        if not own.marked:
            assert own.decode(blob) == library.decode(want, skip_special_tokens=False)


def test_decode_with_word_ends():
    """This file names no decoder, so the library shows raw tokens; ours is the text they stand for."""
    own = bpe.Vocabulary(public_tokenizers.path(NAMES[1]))
    assert own.decode(own.encode(["Hello don't É <|endoftext|> ab"])[0]) == "hello don 't é <|endoftext|>ab"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=4))
def test_any_text(texts):
    for name in NAMES:
        path = public_tokenizers.path(name)
        library, own = _library(path), _own(path)
        for t, blob in zip(texts, own.encode(texts), strict=True):
            assert ids_of(blob) == library.encode(t, add_special_tokens=False).ids


_KEPT = {}


def _library(path):
    return _KEPT.setdefault(("l", path), Tokenizer.from_file(path))


def _own(path):
    return _KEPT.setdefault(("o", path), bpe.Vocabulary(path))


def test_prefix_counts(pair):
    _, library, own = pair
    for t in TEXTS:
        t = t[:120]
        normal = "".join(own.normal(p) if i < 0 else p for i, p in own.cut(t))
        got = own.prefix_counts(t)
        assert len(got) == len(normal) + 1
        if not own.special_cut or not own.special_cut.search(t):
            assert got == [len(library.encode(normal[:i], add_special_tokens=False).ids) for i in range(len(normal) + 1)], t


@pytest.mark.parametrize("limit", [0, 1, 2, 3, 5, 9, 40])
def test_longest_prefix_within_a_limit(pair, limit):
    _, _, own = pair
    for t in [*TEXTS, "a <|endoftext|> b<|endoftext|>", "supercalifragilistic extra-ordinary   ", "  x"]:
        t = t[:200]
        assert bpe.longest_within(own, t, limit) == max(i for i, n in enumerate(own.prefix_counts(t)) if n <= limit), t[:30]


def test_counts_of_all_prefixes_are_made_once(pair, spark):
    """The query's counts are prefix counts: equal to those of each prefix alone, and enough for every budget."""
    path, _, own = pair
    texts = [*(t[:120] for t in TEXTS), "a <|endoftext|> b<|endoftext|>", "'lla 'v 've, d'\u2019 é'll ﬁ́x\u3000y \u1c89\U000187f8 z", "  x\t\u0085y \n"]
    made = own.prefix_arrays(texts)
    assert [c.tolist() for c in made] == [own.prefix_counts(t) for t in texts]
    assert [c.tolist() for c in own.prefix_arrays(texts)] == [c.tolist() for c in made]  # from the memo
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for limit in (0, 3, 40):
        for r in bpe.token_counts(docs, path, limit).collect():
            counts = own.prefix_counts(texts[r.doc_id])
            assert (r.n_tokens, r.over_limit, r.fit_chars) == (counts[-1], counts[-1] > limit, max(i for i, n in enumerate(counts) if n <= limit))


def test_prefix_arrays_of_random_texts():
    own, rng = _own(public_tokenizers.path(NAMES[1])), random.Random(1)
    for letters in ("'lvest dmré日\u0301 \n1!", [chr(c) for c in range(32, 0x2FFF)]):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(300)]
        assert [c.tolist() for c in own.prefix_arrays(texts)] == [own.prefix_counts(t) for t in texts]


def test_operators(spark):
    path = public_tokenizers.path(NAMES[0])
    library = _library(path)
    rows = [(1, "Hello there, world", 3), (1, "Hello there, world", 3), (None, None, 4), (2, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = bpe.round_trip_digests(docs, path).collect()
    assert len(out) == 4
    for r in out:
        t = "" if r.doc_id in (None, 2) else rows[0][1]
        ids = library.encode(t, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    encoded = bpe.bpe_encode(docs, path)
    assert sorted(r.decoded for r in bpe.bpe_decode(encoded, path).collect()) == ["", "", rows[0][1], rows[0][1]]
    assert bpe.bpe_encode(docs.limit(0), path).count() == 0


def test_counts_and_budgets(spark):
    path = public_tokenizers.path(NAMES[1])
    docs = spark.createDataFrame([(1, "a few words more than four"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.token_counts(docs, path, 4).collect()}
    assert (got[1].n_bytes, got[1].n_tokens, got[1].over_limit) == (26, 6, True) and (got[2].n_tokens, got[2].over_limit) == (0, False)
    assert len(_library(path).encode("a few words more than four"[: got[1].fit_chars], add_special_tokens=False).ids) <= 4
    cut = bpe.prefix_token_counts(docs, path).select("doc_id", bpe.cut_to_budget(F_col("prefix_tokens"), 4).alias("n"), bpe.fits_budget(F_col("prefix_tokens"), F_lit(5), 4).alias("ok"))
    row = cut.where("doc_id = 1").first()
    assert row.n == got[1].fit_chars and row.ok


def F_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def F_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x)


def test_kept_columns_give_way_and_long_texts(spark):
    path = public_tokenizers.path(NAMES[0])
    long = "word é other's 12345 " * 60_000
    docs = spark.createDataFrame([(1, long, "x"), (1, long, "x"), (None, None, "x")], "doc_id long, text string, decoded string")
    encoded = bpe.bpe_encode(docs, path, keep=["doc_id", "decoded"])
    out = bpe.bpe_decode(encoded, path, keep=["doc_id", "decoded"]).collect()
    assert sorted((r.decoded for r in out), key=len) == ["", long, long]
    library = _library(path)
    assert {r.n_tokens for r in encoded.collect()} == {0, len(library.encode(long, add_special_tokens=False).ids)}
    word = public_tokenizers.path(NAMES[1])
    got = bpe.token_counts(docs, word, 2048).collect()
    assert {(r.n_tokens, r.over_limit) for r in got} == {(0, False), (len(_library(word).encode(long, add_special_tokens=False).ids), True)}
