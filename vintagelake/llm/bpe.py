"""Byte-pair encoding by last tokens over a trie of distinct words, decoding, and exact token counts of every prefix.

The encoding of a string under ranked merges is fixed by its last token: the tokens before it are the encoding of
the rest. So one number for each prefix of a word, its last token, holds the encodings of all its prefixes. Distinct
words in sorted order are the depth-first walk of their trie; the stack of last tokens along the current path is cut
back to the prefix that two neighbours share, and each trie node is computed once.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from itertools import chain
from operator import sub

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from vintagelake.llm.common import held, map_texts

#: Fixed values of the two public vocabularies: how they cut a text into words, and the mark of a word's end.
BYTE_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MARKED_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END_MARK = "</w>"
#: White space as the Unicode property has it (Python's own \s also takes U+001C to U+001F).
SPACE = "\t-\r \x85\xa0  -     　"
#: Code points that newer Unicode versions call letters or digits and the vocabularies' library does not.
NEWER = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 "
    "1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 "
    "1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
NEWER_CHARS = re.compile("[" + "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in NEWER.split()) + "]")
#: Small letters of capitals that are newer than Python's own tables.
NEWER_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B}
NEWER_LOWER |= {c: c + 32 for c in range(0x10D50, 0x10D66)} | {c: c + 27 for c in range(0x16EA0, 0x16EB9)}
NEWER_CAPITALS = re.compile("[" + "".join(map(chr, NEWER_LOWER)) + "]")
#: Entries that a worker's memo of chunks or pairs may reach before it starts anew: bounds memory, not results.
MEMO = 400_000
#: Fewer of what is only needed for new chunks.
SMALL_MEMO = 100_000
NEVER = 1 << 40
#: Lengths of tokens of fewer bytes than a tail has.
SHORT = (3, 2, 1)


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones as they are, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def keep_only(memo: dict, wanted: set) -> None:
    """Drops what the texts at hand do not use; frequent words are in all texts and stay."""
    kept = {k: memo[k] for k in wanted if k in memo}
    memo.clear()
    memo.update(kept)


def sizes_by_tail(tokens: dict[bytes, int]) -> dict[bytes, tuple[int, ...]]:
    """For the last four bytes of tokens: the lengths that tokens with this tail have, and those shorter than it, longest first."""
    sizes: dict[bytes, set[int]] = {}
    for token in tokens:
        if len(token) > 3:
            sizes.setdefault(token[-4:], set(SHORT)).add(len(token))
    return {tail: tuple(sorted(found, reverse=True)) for tail, found in sizes.items()}


class Vocabulary:
    """A public tokenizer's vocabulary and ranked merges, with memos that live as long as the worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        letters = _byte_letters()
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.marked = model["end_of_word_suffix"] == END_MARK
        self.open: dict[bytes, int] = {}
        self.closed: dict[bytes, int] = {}
        self.bytes_of: dict[int, bytes] = {}
        for token, i in model["vocab"].items():
            ends = self.marked and token.endswith(END_MARK) and token != END_MARK
            part = as_bytes(token[: -len(END_MARK)] if ends else token)
            (self.closed if ends else self.open)[part] = i
            self.bytes_of[i] = part
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.lower = bool(file["normalizer"])
        # A token's rank is its merge's place; parts tells which two tokens it was made of.
        vocab = model["vocab"]
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            made = vocab[a + b]
            self.merge[vocab[a], vocab[b]] = r
            if made not in self.rank:
                self.rank[made], self.parts[made] = r, (vocab[a], vocab[b])
        self.longest = max(map(len, self.open))
        self.words = regex.compile((MARKED_WORDS if self.marked else BYTE_WORDS).replace(r"\s", f"[{SPACE}]" if r"[^\s" not in MARKED_WORDS else r"\s"))
        self.special_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.chunks = re.compile(f"[^{SPACE}]+" if self.marked else f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
        self.runs = re.compile(f"[{SPACE}]{{2,}}")
        self.fit: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, bytes] = {}
        self.word_memo: dict[str, bytes] = {}
        self.open_sizes, self.closed_sizes = (sizes_by_tail(x) if self.marked else {} for x in (self.open, self.closed))
        self.blanked = re.compile(f"[^{SPACE}]+ ?|[{SPACE}]")
        self.chunk_steps: dict[str, bytes] = {}
        self.word_steps: dict[str, bytes] = {}

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Where the words of a text begin and end."""
        if not text.isascii():
            text = NEWER_CHARS.sub("\ufffe", text)  # neither letter nor digit nor white space
        return [(m.start(), m.end()) for m in self.words.finditer(text)]

    def split(self, text: str) -> list[str]:
        return self.words.findall(text) if text.isascii() else [text[a:b] for a, b in self.spans(text)]

    def fits(self, a: int, b: int) -> bool:
        """Whether the two tokens stand side by side in an encoding: no merge across their border comes before both were made."""
        known = self.fit.get((a, b))
        if known is None:
            if len(self.fit) > (MEMO if self.marked else SMALL_MEMO):
                self.fit.clear()
            known = self.fit[a, b] = self._fits(a, b)
        return known

    def _fits(self, a: int, b: int) -> bool:
        # Down the right edge of a and the left edge of b, with the rank at which each piece is absorbed.
        left, right = [(a, NEVER)], [(b, NEVER)]
        for edge, side in ((left, 1), (right, 0)):
            while (token := edge[-1][0]) in self.parts:
                edge.append((self.parts[token][side], self.rank[token]))
        while True:
            (x, x_until), (y, y_until) = left[-1], right[-1]
            r = self.merge.get((x, y))
            if r is not None and r < x_until and r <= y_until:
                return False
            if x_until == y_until == NEVER:
                return True
            (left if x_until <= y_until else right).pop()

    def walk(self, words: list[bytes]):
        """Yields (word, last token of each open prefix, tokens in each open prefix), words sorted: the trie's depth-first walk."""
        get, longest, fits, fit = self.open.get, self.longest, self.fits, self.fit.get
        last, count, begin, before = [-1], [0], [0], b""
        for word in words:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], count[shared + 1 :], begin[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                # Often the last token of the prefix before grows by one byte.
                start = begin[end - 1]
                token = get(word[start:end])
                if token is None or (start and not ((ok := fit((last[start], token))) or ok is None and fits(last[start], token))):
                    for start in range(max(0, end - longest), end):  # noqa: B007
                        token = get(word[start:end])
                        if token is not None and (not start or (ok := fit((last[start], token))) or ok is None and fits(last[start], token)):
                            break
                last.append(token)
                count.append(count[start] + 1)
                begin.append(start)
            before = word
            yield word, last, count

    def _closing(self, word: bytes, end: int, last: list[int]) -> tuple[int, int]:
        """Start and id of the token that closes word[:end] with the end mark."""
        for start in range(max(0, end - self.longest), end):
            token = self.closed.get(word[start:end])
            if token is not None and (start == 0 or self.fits(last[start], token)):
                return start, token
        raise ValueError(word)

    def _spell(self, word: bytes, last: list[int], closing: tuple[int, int] | None) -> bytes:
        """Ids of a word, read back from its last tokens, as little-endian 32-bit integers."""
        ids, end = [], len(word)
        if closing:
            end, token = closing
            ids.append(token)
        while end:
            ids.append(last[end])
            end -= len(self.bytes_of[last[end]])
        return array("I", reversed(ids)).tobytes()

    def learn(self, words: set[str]) -> None:
        """Encodes distinct words that the memo lacks."""
        spelled = {w.encode(): w for w in words}
        for word, last, _ in self.walk(sorted(spelled)):
            closing = self._closing(word, len(word), last) if self.marked else None
            self.word_memo[spelled[word]] = self._spell(word, last, closing)

    def normal(self, text: str) -> str:
        """The vocabulary's own normal form: as it is, or NFC in lower case."""
        if not self.lower:
            return text
        # Each character alone, without the rule for a sigma at a word's end.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return text.translate(NEWER_LOWER) if not text.isascii() and NEWER_CAPITALS.search(text) else text

    def cut(self, text: str) -> list[tuple[int, str]]:
        """(special id or -1, piece): special strings inside the text stand alone."""
        if self.special_cut is None or not self.special_cut.search(text):
            return [(-1, text)]
        return [(self.special.get(p, -1), p) for p in self.special_cut.split(text) if p]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes. Chunks between white space are looked up; the words of new ones go through the trie."""
        pieces = [self.cut(t) for t in texts]
        chunked = [[(i, [] if i >= 0 else self.chunks.findall(self.normal(p))) for i, p in parts] for parts in pieces]
        memo = self.memo
        new = {c for parts in chunked for _, chunks in parts for c in chunks if c not in memo}
        if new:
            if len(memo) + len(new) > MEMO:
                keep_only(memo, {c for parts in chunked for _, chunks in parts for c in chunks})
            if len(self.word_memo) > SMALL_MEMO:
                self.word_memo.clear()
            split = {c: self.split(c) for c in new}
            known = self.word_memo
            self.learn({w for ws in split.values() for w in ws if w not in known})
            memo.update((c, b"".join(map(known.__getitem__, ws))) for c, ws in split.items())
        of = memo.__getitem__
        return [b"".join(chain.from_iterable([array("I", [i]).tobytes()] if i >= 0 else map(of, chunks) for i, chunks in parts)) for parts in chunked]

    def decode(self, ids: bytes) -> str:
        """The text of ids: their bytes joined, read as UTF-8 with replacement."""
        got = array("I")
        got.frombytes(ids)
        if self.marked:
            closing = set(self.closed.values())
            return "".join(self.bytes_of[i].decode("utf-8", "replace") + " " * (i in closing) for i in got).strip()
        return b"".join(map(self.bytes_of.__getitem__, got)).decode("utf-8", "replace")

    def prefix_counts(self, text: str) -> list[int]:
        """Tokens of normal(text)[:i] for i from 0 to its length, each as the library would count that prefix alone.

        Inside a special string the prefix holds only a part of it, which counts as plain text.
        """
        out, base = [0], 0
        for special, piece in self.cut(text):
            piece = self.normal(piece)
            if special >= 0:
                out += [base + n for n in self._plain_counts(piece)[1:-1]] + [base + 1]
            else:
                out += [base + n for n in self._plain_counts(piece)[1:]]
            base = out[-1]
        return out

    def _plain_counts(self, text: str) -> list[int]:
        found = self.spans(text)
        words = {text[a:b] for a, b in found}
        tails = {w: self._tail_counts(w) for w in words}
        out, total, at = [0], 0, 0
        for a, b in found:
            out += [total] * (a - at)
            inner = tails[text[a:b]]
            out += [total + n for n in inner]
            total, at = out[-1], b
        out += [total] * (len(text) - at)
        if not self.marked:
            # A prefix that ends inside a run of white space holds it as one word, however the full text cuts it.
            for m in self.runs.finditer(text):
                out[m.start() + 1 : m.end() + 1] = [out[m.start()] + n for n in self._tail_counts(m[0])]
        return out

    def _tail_counts(self, word: str) -> list[int]:
        """Tokens of word[:k] for k from 1, each prefix cut into words anew where the pattern would do so."""
        cut = self.split(word[:-1]) if len(word) > 1 else []
        if cut not in ([], [word[:-1]]):
            return [sum(self._tail_counts(w)[-1] for w in self.split(word[:k])) for k in range(1, len(word))] + [self._whole(word)]
        raw = word.encode()
        (_, last, count), out, end = next(iter(self.walk([raw]))), [], 0
        for c in word:
            end += len(c.encode())
            out.append(count[self._closing(raw, end, last)[0]] + 1 if self.marked else count[end])
        return out

    def _whole(self, word: str) -> int:
        raw = word.encode()
        _, last, count = next(iter(self.walk([raw])))
        return count[self._closing(raw, len(raw), last)[0]] + 1 if self.marked else count[-1]

    def _closing_counts(self, words: list[bytes]):
        """Yields (word, tokens of each byte prefix with its end mark, 0 inside a character), words sorted; each trie node once."""
        get, closing, fits, fit = self.open.get, self.closed.get, self.fits, self.fit.get
        open_sizes, closed_sizes = self.open_sizes.get, self.closed_sizes.get
        last, count, begin, counts, before = [-1], [0], [0], [0], b""
        for word in words:
            size, shared = len(word), 0
            most = min(size, len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], count[shared + 1 :], begin[shared + 1 :], counts[shared + 1 :]
            for end in range(shared + 1, size + 1):
                tail = word[end - 4 : end] if end > 4 else word[:end]
                start = begin[end - 1]
                token = get(word[start:end])
                if token is None or (start and not ((ok := fit((last[start], token))) or ok is None and fits(last[start], token))):
                    for n in open_sizes(tail, SHORT):
                        start = end - n
                        if start >= 0 and (token := get(word[start:end])) is not None and (not start or (ok := fit((last[start], token))) or ok is None and fits(last[start], token)):
                            break
                last.append(token)
                count.append(count[start] + 1)
                begin.append(start)
                made = 0
                if end == size or word[end] & 0xC0 != 0x80:
                    for n in closed_sizes(tail, SHORT):
                        start = end - n
                        if start >= 0 and (token := closing(word[start:end])) is not None and (not start or (ok := fit((last[start], token))) or ok is None and fits(last[start], token)):
                            made = count[start] + 1
                            break
                    else:
                        raise ValueError(word)
                counts.append(made)
            before = word
            yield word, counts

    def _learn_steps(self, words: set[str]) -> None:
        """What each further character adds to a word's prefix counts, as 16-bit integers, for words that the memo lacks."""
        known, plain = self.word_steps, {}
        for w in words:
            if len(w) > 1 and w[0] == "'":  # its prefixes may be cut into words anew
                tails = self._tail_counts(w)
                known[w] = array("h", [n - m for n, m in zip(tails, [0, *tails], strict=False)]).tobytes()
            else:
                plain[w.encode()] = w
        for word, counts in self._closing_counts(sorted(plain)):
            w = plain[word]
            tails = counts[1:] if len(w) == len(word) else [counts[i] for i in range(1, len(word) + 1) if i == len(word) or word[i] & 0xC0 != 0x80]
            known[w] = array("h", map(sub, tails, [0, *tails])).tobytes()

    def _chunk_steps(self, chunk: str, words: list[str]) -> bytes:
        left = len(chunk) - sum(map(len, words))
        if left == (chunk[-1] == " "):
            return b"".join(map(self.word_steps.__getitem__, words)) + bytes(2 * left)
        out, at = [], 0
        for a, b in self.spans(chunk):
            out += [bytes(2 * (a - at)), self.word_steps[chunk[a:b]]]
            at = b
        return b"".join([*out, bytes(2 * (len(chunk) - at))])

    def prefix_arrays(self, texts: list[str]) -> list[np.ndarray]:
        """prefix_counts of each text as an array.

        With word ends, white space ends every word, so a text's counts are the running sum of its chunks' steps. The
        steps of a chunk, with the blank after it, are kept in a memo.
        """
        if not self.marked:
            return [np.array(self.prefix_counts(t), np.int32) for t in texts]
        pieces = [self.cut(t) for t in texts]
        chunked = [[(i, [] if i >= 0 else self.blanked.findall(self.normal(p))) for i, p in parts] for parts in pieces]
        memo, known = self.chunk_steps, self.word_steps
        new = {c for parts in chunked for _, chunks in parts for c in chunks if c not in memo}
        if new:
            if len(memo) + len(new) > MEMO:
                keep_only(memo, {c for parts in chunked for _, chunks in parts for c in chunks})
            if len(known) > SMALL_MEMO:
                known.clear()
            split = {c: self.split(c) for c in new}
            self._learn_steps({w for ws in split.values() for w in ws if w not in known})
            memo.update((c, self._chunk_steps(c, ws)) for c, ws in split.items())
        of, out = memo.__getitem__, []
        for parts, cut in zip(chunked, pieces, strict=True):
            steps = b"".join(chain.from_iterable(map(of, chunks) if i < 0 else [self._special_steps(p)] for (i, chunks), (_, p) in zip(parts, cut, strict=True)))
            counts = np.zeros(len(steps) // 2 + 1, np.int32)
            np.cumsum(np.frombuffer(steps, np.int16), out=counts[1:])
            out.append(counts)
        return out

    def _special_steps(self, piece: str) -> bytes:
        inside = [*self._plain_counts(self.normal(piece))[1:-1], 1]
        return array("h", map(sub, inside, [0, *inside])).tobytes()

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each whole text: the last number of its prefix counts."""
        if not self.marked:
            return [len(x) // 4 for x in self.encode(texts)]
        return [int(counts[-1]) for counts in self.prefix_arrays(texts)]


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once in each worker. The path must be the same on all machines."""
    return held(path, lambda: Vocabulary(path))


def bpe_encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows with the columns `keep` (default doc_id), token_ids (binary: little-endian unsigned 32-bit ids) and n_tokens.

    Special strings inside a text become their own ids, as the library does by default. Null or empty texts have no
    tokens. Equal rows stay as they are; an empty table gives an empty one; a column of `keep` that is named like a new one
    gives way to it.
    """

    def run(texts: list[str]) -> dict:
        ids = vocabulary(path).encode(texts)
        return {"token_ids": ids, "n_tokens": [len(x) // 4 for x in ids]}

    return map_texts(docs, keep or ["doc_id"], run, "token_ids binary, n_tokens bigint", text, holds=path)


def bpe_decode(encoded: DataFrame, path: str, ids: str = "token_ids", keep: list[str] | None = None) -> DataFrame:
    """Rows with `keep` and decoded: the text of the ids, special tokens included. Null ids decode to an empty text.

    Equal rows stay, an empty table gives an empty one, and a column of `keep` named decoded gives way.
    """
    keep = [c for c in dict.fromkeys(keep or ["doc_id"]) if c != "decoded"]
    source = encoded.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*keep, ids])))
    full = StructType([*(source.schema[c] for c in keep), StructField("decoded", StringType())])

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            out = [v.decode(x or b"") for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.string())], names=[*keep, "decoded"])

    return source.mapInArrow(run, full)


def bpe_round_trip(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Encodes and decodes in one pass: `keep`, token_ids, n_tokens, decoded. Cases as in bpe_encode."""

    def run(texts: list[str]) -> dict:
        v = vocabulary(path)
        ids = v.encode(texts)
        return {"token_ids": ids, "n_tokens": [len(x) // 4 for x in ids], "decoded": [v.decode(x) for x in ids]}

    return map_texts(docs, keep or ["doc_id"], run, "token_ids binary, n_tokens bigint, decoded string", text, holds=path)


def round_trip_digests(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """bpe_round_trip with its outputs as digests made in the same task: `keep`, n_tokens, ids_sha256, decoded_sha256. Cases as in bpe_encode."""

    def run(texts: list[str]) -> dict:
        v = vocabulary(path)
        ids = v.encode(texts)
        return {
            "n_tokens": [len(x) // 4 for x in ids],
            "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
            "decoded_sha256": [hashlib.sha256(v.decode(x).encode()).hexdigest() for x in ids],
        }

    return map_texts(docs, keep or ["doc_id"], run, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", text, holds=path)


def prefix_token_counts(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows with `keep`, normal_text and prefix_tokens: element i is the token count of the first i code points of normal_text.

    normal_text is the text in the vocabulary's normal form (null: empty). With these counts, `fits_budget` and
    `cut_to_budget` answer truncation and budget questions by lookups.
    """

    def run(texts: list[str]) -> dict:
        v = vocabulary(path)
        return {"normal_text": ["".join(v.normal(p) if i < 0 else p for i, p in v.cut(t)) for t in texts], "prefix_tokens": [c.tolist() for c in v.prefix_arrays(texts)]}

    return map_texts(docs, keep or ["doc_id"], run, "normal_text string, prefix_tokens array<int>", text, holds=path)


def fits_budget(prefix_tokens: Column, chars: Column, budget: int) -> Column:
    """Whether the first `chars` code points hold at most `budget` tokens."""
    return F.element_at(prefix_tokens, chars + 1) <= budget


def cut_to_budget(prefix_tokens: Column, budget: int) -> Column:
    """Code points in the longest prefix with at most `budget` tokens."""
    return F.array_max(F.transform(prefix_tokens, lambda n, i: F.when(n <= budget, i))).cast("int")


def token_counts(docs: DataFrame, path: str, limit: int, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rows with `keep`, n_bytes, n_tokens, over_limit and fit_chars.

    Each text's prefix counts are made once; n_tokens (null: empty text), over_limit and fit_chars, how many code points
    of the text in normal form the limit admits, are read from them. Equal rows stay, an empty table gives an empty one,
    and a column of `keep` that is named like a new one gives way.
    """

    def run(texts: list[str]) -> dict:
        counts = vocabulary(path).prefix_arrays(texts)
        tokens = [int(c[-1]) for c in counts]
        return {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": tokens, "over_limit": [n > limit for n in tokens], "fit_chars": [fitting(c, limit) for c in counts]}

    return map_texts(docs, keep or ["doc_id"], run, "n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint", text, holds=path)


def fitting(counts: np.ndarray, limit: int) -> int:
    """The last i with at most `limit` tokens in the first i code points, by a text's prefix counts."""
    if counts[-1] <= limit:
        return len(counts) - 1
    within = np.flatnonzero(counts <= limit)
    return int(within[-1]) if len(within) else 0


def longest_within(v: Vocabulary, text: str, limit: int) -> int:
    return fitting(v.prefix_arrays([text])[0], limit)
