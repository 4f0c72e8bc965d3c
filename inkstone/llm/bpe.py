"""Byte-level BPE encoding and decoding by contiguous rank arrays.

A word's parts lie side by side in one row of a matrix, beside the ranks of adjacent pairs. The smallest rank is
found by a scan, its boundary deleted, and the two neighbouring ranks looked up anew, for all unknown words of a batch
at once. Words over SHORT bytes use a heap over linked parts, with the same merges in the same order.
"""

import gc
import heapq
import json
from collections.abc import Iterable
from functools import cached_property
from hashlib import sha256
from itertools import islice

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: How byte-level BPE splits text before merging (fixed value).
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of Unicode's property White_Space (fixed values).
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: Bytes of a word that the rank array takes; characters of a chunk that is kept; chunks that a worker keeps; the share of a
#: batch's chunks from which on being unknown shows that those kept are of other texts.
SHORT, KEPT_CHARS, KEPT, STALE = 32, 48, 400_000, 0.3
_NONE = np.int32(2**31 - 1)
_SLOT_BITS = 20
#: A letters' chunk that ends with one of these is two words.
_ENDS = frozenset(",.;:!?")
_SPACED = tuple(" " + c for c in WHITE)
#: What two characters of white space that meet, or one that is neither a space nor a line feed, hold.
_RUNS = ("\n\n", " \n", "\n ", "  ", *(c for c in WHITE + "\x1c\x1d\x1e\x1f" if c not in " \n"))


def _byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class _Known(dict):
    """Token ids of chunks; a chunk that is not known is noted in `new` and stands for itself."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> str:
        self.new.append(chunk)
        return chunk


class Codec:
    """Encodes and decodes as the tokenizers library does with the given byte-level BPE file's contents."""

    def __init__(self, vocabulary: bytes):
        spec = json.loads(vocabulary)
        letter = _byte_letters()
        ids = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(letter[c] for c in token) for token, i in ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: token.encode() for token, i in self.special.items()}
        self.id_of_byte = np.zeros(256, np.int32)
        for token, i in ids.items():
            if len(token) == 1:
                self.id_of_byte[letter[token]] = i
        self.width = 1 + max(self.bytes_of)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.pair = np.array([ids[a] * self.width + ids[b] for a, b in merges], np.int64)  # by rank
        self.merged = np.array([ids[a + b] for a, b in merges], np.int32)
        slot = self._slot(self.pair)
        self.at_slot = np.zeros(1 << _SLOT_BITS, np.int32)
        self.at_slot[slot[::-1]] = np.arange(len(slot), dtype=np.int32)[::-1]
        self.shared = np.bincount(slot, minlength=1 << _SLOT_BITS) > 1
        self.byte_ranks = self._pair_ranks(np.repeat(self.id_of_byte, 256), np.tile(self.id_of_byte, 256)).reshape(256, 256)
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in self.special) + ")") if self.special else None
        self.end_ids = dict(zip(_ENDS, self._merged([c.encode() for c in _ENDS]), strict=True))
        self.newline = (self._merged([b"\n"]), False)
        self.after_space, self.at_start = _Known(), _Known()

    @cached_property
    def ranks(self) -> dict[int, int]:
        return {k: r for r, k in enumerate(self.pair.tolist())}

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of token ids, by a table of hashes; few slots hold several pairs, which a dictionary tells apart."""
        key = left.astype(np.int64) * self.width + right
        slot = self._slot(key)
        found = self.at_slot[slot]
        hit = (self.pair[found] == key) & (left >= 0) & (right >= 0)
        out = np.where(hit, found, _NONE)
        for i in np.flatnonzero(~hit & self.shared[slot] & (left >= 0) & (right >= 0)).tolist():
            out[i] = self.ranks.get(int(key[i]), _NONE)
        return out

    def merge_short(self, words: list[bytes]) -> list[bytes]:
        """Token ids, four bytes each, of words of 1 to SHORT bytes."""
        out = [b""] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        for low, high in ((0, 6), (6, 10), (10, 16), (16, SHORT)):
            rows = np.flatnonzero((size > low) & (size <= high))
            for i in range(0, len(rows), 20_000):
                some = rows[i : i + 20_000].tolist()
                for k, ids in zip(some, self._merge_matrix([words[k] for k in some], size[some], high), strict=True):
                    out[k] = ids
        return out

    def _merge_matrix(self, words: list[bytes], sizes: np.ndarray, width: int) -> list[bytes]:
        raw = np.array(words, f"S{width}").view(np.uint8).reshape(len(words), width)
        columns = np.arange(width)
        filled = columns < sizes[:, None]
        parts = np.c_[np.where(filled, self.id_of_byte[raw], -1), np.full(len(words), -1)].astype(np.int32)
        ranks = np.full((len(words), width), _NONE, np.int32)
        ranks[:, :-1] = np.where(filled[:, 1:], self.byte_ranks[raw[:, :-1], raw[:, 1:]], _NONE)
        done, todo = parts.copy(), np.arange(len(words))
        while len(todo):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(todo)), at]
            go = best < _NONE
            if not go.all():
                done[todo[~go]] = parts[~go]
                todo, parts, ranks, at, best = todo[go], parts[go], ranks[go], at[go], best[go]
                if not len(todo):
                    break
            row = np.arange(len(todo))
            later = columns > at[:, None]
            parts[:, :-1] = np.where(later, parts[:, 1:], parts[:, :-1])
            ranks[:, :-1] = np.where(later[:, :-1], ranks[:, 1:], ranks[:, :-1])
            parts[:, -1] = -1
            ranks[:, -1] = _NONE
            new = self.merged[best]
            parts[row, at] = new
            ranks[row, at] = self._pair_ranks(new, parts[row, at + 1])
            before = at > 0
            ranks[row[before], at[before] - 1] = self._pair_ranks(parts[row[before], at[before] - 1], new[before])
        data, step = done.astype("<u4").tobytes(), 4 * (width + 1)
        ends = (4 * (done >= 0).sum(axis=1)).tolist()
        return [data[i * step : i * step + n] for i, n in enumerate(ends)]

    def merge_long(self, word: bytes) -> bytes:
        parts = self.id_of_byte[np.frombuffer(word, np.uint8)].tolist()
        n, rank = len(parts), self.ranks
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank.get(parts[i] * self.width + parts[i + 1])) is not None]
        heapq.heapify(heap)
        merged = self.merged
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] == a else -1
            if j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = int(merged[r]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := rank.get(parts[x] * self.width + parts[y])) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return np.array([p for p in parts if p >= 0], "<u4").tobytes()

    def _merged(self, words: list[bytes]) -> list[bytes]:
        """Token ids, four bytes each, of words of one byte or more."""
        out = self.merge_short(words)
        for i, word in enumerate(words):
            if len(word) > SHORT:
                out[i] = self.merge_long(word)
        return out

    def _learn(self, chunks: set[str], space: str, known: dict[str, bytes]) -> dict[str, bytes]:
        """Token ids of chunks, each of which no word crosses the border of."""
        plain, tailed, other = [], [], []
        for c in chunks:
            (plain if c.isalpha() else tailed if c[-1:] in _ENDS and c[:-1].isalpha() else other).append(c)
        plain += {c[:-1] for c in tailed}.difference(plain, known)
        out = dict(zip(plain, self._merged([(space + c).encode("utf-8", "surrogatepass") for c in plain]), strict=True))
        for c in tailed:
            stem = c[:-1]
            out[c] = (out[stem] if stem in out else known[stem]) + self.end_ids[c[-1]]
        split = self.split.findall
        spelled = [split(space + c) for c in other]
        words = list(set().union(*spelled))
        ids = dict(zip(words, self._merged([w.encode("utf-8", "surrogatepass") for w in words]), strict=True))
        out |= {c: b"".join(map(ids.__getitem__, found)) for c, found in zip(other, spelled, strict=True)}
        return out

    def _lines(self, text: str) -> list[list[str]]:
        """Chunks of each line, where every line end stands alone between other characters than white space, as it is a word of
        its own then; else those of the whole text."""
        if any(x in text for x in _RUNS) or text[-1] in " \n" or text[0] == "\n":
            return [self._chunks(text)]
        return [line.split(" ") for line in text.split("\n")]

    def _chunks(self, text: str) -> list[str]:
        """The text cut at each space that a character other than white space follows; the spaces are left out."""
        if any(x in text for x in _SPACED):
            return regex.split(r" (?=\S)", text)
        return text.split(" ") if not text.endswith(" ") else regex.split(r" (?=\S)", text)

    def encode_batch(self, texts: Iterable[str | None]) -> list[list[int]]:
        """Token ids of whole texts, without truncation; null counts as empty; special tokens in a text are found."""
        return [np.frombuffer(ids, "<u4").tolist() for ids in self.encode_bytes(texts)]

    def encode_bytes(self, texts: Iterable[str | None]) -> list[bytes]:
        """The same ids as little-endian unsigned 32-bit integers."""
        collecting = gc.isenabled()
        gc.disable()  # millions of new objects, none in a cycle
        try:
            return self._encode_bytes(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode_bytes(self, texts: Iterable[str | None]) -> list[bytes]:
        start, known = self.at_start, self.after_space
        rows, look_up = [], known.__getitem__
        for text in texts:
            row = []
            for piece in (self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]) if text else []:
                if piece in self.special:
                    row.append(([np.uint32(self.special[piece]).tobytes()], False))
                elif piece:
                    for k, chunks in enumerate(self._lines(piece)):
                        before, first = len(known.new), start[chunks[0]]
                        parts = [first, *map(look_up, islice(chunks, 1, None))]
                        row += [self.newline, (parts, first.__class__ is str or len(known.new) > before)][not k :]
            rows.append(row)
        learned = []
        for table, space in ((start, ""), (known, " ")):
            learned.append(self._learn(set(table.new), space, table))
            # A full table keeps what it has, the words that came first, which are the frequent ones, unless it serves no more.
            if len(table) > KEPT and len(table.new) > STALE * sum(len(parts) for row in rows for parts, _ in row):
                table.clear()
            if len(table) <= KEPT:
                table.update((c, ids) for c, ids in learned[-1].items() if len(c) <= KEPT_CHARS)
            table.new.clear()
        out = []
        for row in rows:
            told: list[bytes] = []
            for parts, unknown in row:
                if unknown:
                    if parts[0].__class__ is str:
                        parts[0] = learned[0][parts[0]]
                    now = learned[1]
                    parts = [x if x.__class__ is bytes else now[x] for x in parts]
                told += parts
            out.append(b"".join(told))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_codecs: dict[bytes, Codec] = {}


def codec_of(vocabulary: bytes) -> Codec:
    """One codec for each vocabulary and worker."""
    key = sha256(vocabulary).digest()
    if key not in _codecs:
        _codecs[key] = Codec(vocabulary)
    return _codecs[key]


def read_vocabulary(path: str) -> bytes:
    """The file's contents, read by the driver; executors get them by broadcast (a vocabulary has a fixed size)."""
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", into: str = "ids") -> DataFrame:
    """docs with a column of each whole text's token ids; null and empty texts get an empty array."""
    small_batches(docs.sparkSession)
    data = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series(codec_of(data.value).encode_batch(texts))

    return docs.withColumn(into, ids(F.col(text_col)))


def decode(rows: DataFrame, vocabulary: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """rows with a column of the text that the token ids stand for; null counts as no ids."""
    small_batches(rows.sparkSession)
    data = rows.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        return pd.Series([codec_of(data.value).decode(() if x is None else x) for x in ids], dtype=object)

    return rows.withColumn(into, text(F.col(ids_col)))


def digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row: whole texts encoded, and their ids decoded again. Null texts
    count as empty, with the digest of nothing; repeated rows get a row each, null ids are kept, an empty table gives none."""
    both = docs.select("doc_id", F.col("text"))
    small_batches(docs.sparkSession)
    data = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(texts: pd.Series) -> pd.DataFrame:
        codec = codec_of(data.value)
        names = _names(codec.width)
        rows = [
            (len(ids), sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest(), sha256(codec.decode(ids).encode()).hexdigest())
            for ids in codec.encode_batch(texts)
        ]
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return both.select("doc_id", digest("text").alias("d")).select("doc_id", "d.*")


_decimal: list[str] = []


def _names(n: int) -> list[str]:
    """Decimal spellings of the integers below n."""
    if len(_decimal) < n:
        _decimal[:] = map(str, range(n))
    return _decimal
