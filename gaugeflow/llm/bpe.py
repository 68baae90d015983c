"""Byte-level BPE encoding and decoding.

A text is split at added tokens, then into words by the byte-level pattern; the bytes of a
word are merged with a priority queue of merge ranks over a doubly linked symbol list, and
entries whose symbols have changed meanwhile are skipped when they come up. Words repeat, so
each worker keeps a bounded table of words already merged. Decoding concatenates vocabulary
strings. An empty table gives an empty result.

Null and empty texts encode to no token and decode to the empty text. Repeated rows give
repeated results; a column of any name may stand beside the text, as only the text column is read.
A word of any length is merged whole (O(n log n)); long texts are taken word batch by word batch.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
                      r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
KNOWN_WORDS = 200_000  # words kept merged per worker, in each of two generations (about 250 bytes a word)
FEW_WORDS = 40_000      # the same for jobs whose workers have little memory
FLUSH = 250_000         # token ids of a batch that leaves ``encode_rows``
SHIFT, SPOT = 20, 40    # bits of a token id and of a position in packed keys
LONG_WORD = 200         # bytes: longer words are merged each time, not kept
LONG_TEXT = 1 << 20     # characters: longer texts are split into words lazily
BATCH_WORDS = 100_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1
    characters stand for themselves, the other bytes take the letters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file (the JSON form with ranked merges)."""

    def __init__(self, file: bytes, words: int | None = None):
        spec = json.loads(file)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.byte_id = [0] * 256
        for letter, b in letters.items():
            self.byte_id[b] = vocab[letter]
        #: a pair of ids, packed, gives its merge rank; a rank gives the pair and what it merges to
        self.rank: dict[int, int] = {}
        self.merged: list[tuple[int, int, int]] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merged.append((vocab[a], vocab[b], vocab[a + b]))
            self.rank.setdefault(vocab[a] << SHIFT | vocab[b], rank)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        by_length = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("|".join(map(regex.escape, by_length))) if by_length else None
        self.strings: dict[int, bytes] = {}
        for token, i in [*vocab.items(), *self.added.items()]:
            if all(c in letters for c in token):
                self.strings[i] = bytes(letters[c] for c in token)
            else:
                self.strings[i] = token.encode()
        self.known = _Known(self, words or KNOWN_WORDS)

    def merge(self, word: bytes) -> list[int]:
        """Token ids of one word. Queue entries are packed (rank, position), so equal ranks go left to right."""
        rank, merged = self.rank.get, self.merged
        sym = [self.byte_id[b] for b in word]
        n = len(sym)
        queue = [r << SPOT | i for i in range(n - 1) if (r := rank(sym[i] << SHIFT | sym[i + 1])) is not None]
        if not queue:
            return sym
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heapq.heapify(queue)
        while queue:
            top = heapq.heappop(queue)
            i = top & (1 << SPOT) - 1
            a, b, new = merged[top >> SPOT]
            j = right[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue  # stale: one of the two symbols has been merged since
            sym[i], sym[j] = new, -1
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                if (r := rank(new << SHIFT | sym[k])) is not None:
                    heapq.heappush(queue, r << SPOT | i)
            h = left[i]
            if h >= 0 and (r := rank(sym[h] << SHIFT | new)) is not None:
                heapq.heappush(queue, r << SPOT | h)
        return [s for s in sym if s >= 0]

    def _plain(self, text: str) -> bytes:
        if len(text) <= LONG_TEXT:
            return b"".join(map(self.known.__getitem__, WORDS.findall(text)))
        words = (m.group() for m in WORDS.finditer(text))
        parts = []
        while batch := list(itertools.islice(words, BATCH_WORDS)):
            parts.append(b"".join(map(self.known.__getitem__, batch)))
        return b"".join(parts)

    def encode(self, text: str | None) -> np.ndarray:
        """Token ids (little-endian unsigned 32-bit) of a whole text."""
        if not text:
            return np.empty(0, "<u4")
        if self.cut is None or not self.cut.search(text):
            return np.frombuffer(self._plain(text), "<u4")
        parts, at = [], 0
        for m in self.cut.finditer(text):
            parts += [self._plain(text[at:m.start()]), np.array([self.added[m.group()]], "<u4").tobytes()]
            at = m.end()
        return np.frombuffer(b"".join([*parts, self._plain(text[at:])]), "<u4")

    def decode(self, ids) -> str:
        """The text of token ids: their vocabulary strings, concatenated."""
        return b"".join(map(self.strings.__getitem__, np.asarray(ids).tolist())).decode("utf-8", "replace")


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class _Known(dict):
    """Words merged so far, in two generations: when the young one is full, it becomes the old one."""

    def __init__(self, codec: Codec, most: int):
        super().__init__()
        self.codec, self.most, self.old = codec, most, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            data = word.encode()
            ids = _packed(self.codec.merge(data))
            if len(data) > LONG_WORD:
                return ids
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids


_loaded: dict[tuple[int, int], Codec] = {}


def _codec(shared, words: int | None = None) -> Codec:
    """One codec per worker process, for the last vocabulary and table size used."""
    key = (hash(shared.value), words or KNOWN_WORDS)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Codec(shared.value, words)
    return _loaded[key]


def load_vocabulary(spark: SparkSession, path: str):
    """Ship the vocabulary file (fixed size, 1.5 MB) to the executors."""
    with open(path, "rb") as fh:
        return spark.sparkContext.broadcast(fh.read())


def encode(text: Column, vocabulary) -> Column:
    """Token ids of ``text`` as array<int>."""
    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        codec = _codec(vocabulary)
        return pd.Series([codec.encode(t).astype(np.int32) for t in texts], index=texts.index, dtype=object)
    return ids(text)


def decode(ids: Column, vocabulary) -> Column:
    """Text of token ids (array<int>; null: empty)."""
    @F.pandas_udf("string")
    def texts(rows: pd.Series) -> pd.Series:
        codec = _codec(vocabulary)
        return rows.map(lambda r: "" if r is None else codec.decode(r))
    return texts(ids)


def round_trip(text: Column, vocabulary) -> Column:
    """Encode, decode and digest in one pass: struct<n_tokens, ids_sha256, decoded_sha256, same>.

    ``same`` tells whether the decoded text equals the source (null: empty)."""
    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean")
    def digest(texts: pd.Series) -> pd.DataFrame:
        codec, rows = _codec(vocabulary), []
        for t in texts:
            ids = codec.encode(t)
            back = codec.decode(ids)
            rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(),
                         hashlib.sha256(back.encode()).hexdigest(), back == (t or "")))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "same"])
    return digest(text)


def encode_rows(rows: DataFrame, vocabulary, text: str = "text", words: int = FEW_WORDS, flush: int = FLUSH) -> DataFrame:
    """``rows`` without their text, with n_tokens, ids (array<int>) and same: whether the ids, decoded again, give the
    text (null: empty).

    Texts are taken out of an Arrow batch one by one, and a batch leaves as soon as it holds ``flush`` ids, so a worker
    holds one batch of input, one text and a few MB of output, whatever the sizes of texts and batches."""
    keep = [f for f in rows.schema.fields if f.name != text]
    schema = T.StructType([*keep, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
                           T.StructField("same", T.BooleanType())])
    names = [f.name for f in schema.fields]

    def coded(batches):
        codec = _codec(vocabulary, words)
        for b in batches:
            texts, kept = b.column(len(keep)), [b.column(i) for i in range(len(keep))]
            start, held, ids, sizes, same = 0, 0, [], [], []
            for i in range(b.num_rows):
                t = texts[i].as_py()
                found = codec.encode(t)
                ids.append(found)
                sizes.append(len(found))
                held += len(found)
                same.append(codec.decode(found) == (t or ""))
                if held >= flush or i + 1 == b.num_rows:
                    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                    flat = pa.array(np.concatenate(ids).astype("<u4").view(np.int32))
                    lists = pa.ListArray.from_arrays(pa.array(ends), flat)
                    part = [c.slice(start, len(sizes)) for c in kept]
                    yield pa.RecordBatch.from_arrays([*part, pa.array(sizes, pa.int64()), lists, pa.array(same, pa.bool_())], names=names)
                    start, held, ids, sizes, same = i + 1, 0, [], [], []

    return rows.select(*[f.name for f in keep], text).mapInArrow(coded, schema)
