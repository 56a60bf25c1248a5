"""Byte-level BPE encoding and decoding.

A rank file (token bytes and ranks) becomes a ``tokenizers`` BPE model over the byte-to-character alphabet.  The merge that
makes a token is found by running the merges of lower rank over the token's bytes: two parts are left.  Inside one match of the
pattern, applying such merges in rank order gives what merging the adjacent pair of lowest joint rank gives.

Arrow batches of texts come in; ids, token counts and byte offsets go out.  Decoding maps ids to byte strings through the
reversed byte table, so a character split over tokens is whole again once its tokens are joined.

Defined results: null text counts as empty; the empty text has no ids, zero tokens and the hashes of no bytes; repeated rows
each give a row; an empty table gives no rows; texts of any length are encoded whole; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import codecs
import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strata.llm.common import blocks, columns, text_buffer
from strata.llm.segments import SegmentEncoder, library_encoder


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 characters stand for themselves, the other bytes, in order,
    for the characters from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + rest.index(b)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts that remain of a token's bytes under all merges of lower rank than its own."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        joint = [ranks.get(a + b, len(ranks)) for a, b in zip(parts, parts[1:])]
        k = min(range(len(joint)), key=joint.__getitem__)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return parts[0], parts[1]


def rank_tokenizer(path: str, pattern: str):
    """A ``tokenizers.Tokenizer`` without special tokens for a rank file."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, chars = read_ranks(path), byte_characters()
    shown = lambda token: "".join(chars[b] for b in token)
    merges = [tuple(map(shown, last_merge(t, ranks))) for t in sorted(ranks, key=ranks.__getitem__) if len(t) > 1]
    tokenizer = Tokenizer(models.BPE(vocab={shown(t): r for t, r in ranks.items()}, merges=merges))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), behavior="isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
    ])
    return tokenizer


class ByteDecoder:
    """Ids to bytes: the reversed byte table as one array of token bytes and its offsets."""

    def __init__(self, tokens: dict[int, bytes]):
        size = max(tokens) + 1
        self.length = np.zeros(size, np.int64)
        for i, t in tokens.items():
            self.length[i] = len(t)
        self.first = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(size)), np.uint8)

    @classmethod
    def of_tokenizer(cls, tokenizer) -> ByteDecoder:
        back = {c: b for b, c in enumerate(byte_characters())}
        return cls({i: bytes(back[c] for c in t) for t, i in tokenizer.get_vocab(with_added_tokens=False).items()})

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, and the n+1 byte offsets of the tokens."""
        length = self.length[ids]
        ends = np.cumsum(length)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[ids] - (ends - length), length)
        return self.data[at], np.append(0, ends)

    def stream(self, ids, errors: str = "replace"):
        """Text by token, as far as its characters are complete; what is left incomplete at the end follows ``errors``."""
        tail = codecs.getincrementaldecoder("utf-8")(errors)
        for i in ids:
            yield tail.decode(self.data[self.first[i] : self.first[i] + self.length[i]].tobytes())
        if rest := tail.decode(b"", final=True):
            yield rest


@functools.cache
def _coder(path: str, pattern: str) -> tuple[SegmentEncoder, ByteDecoder]:
    tokenizer = rank_tokenizer(path, pattern)
    return library_encoder(tokenizer), ByteDecoder.of_tokenizer(tokenizer)


def encode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids array<int>, byte_offsets array<int>): tokens of each text and where each begins in its UTF-8 bytes."""

    def run(batches):
        encoder, decoder = _coder(ranks, pattern)
        for batch in batches:
            keys, texts = columns(batch, key, text)
            data, offsets = text_buffer(texts)
            for a, b in blocks(offsets, 2 << 20):
                ids, places = encoder.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                starts = decoder.decode(ids)[1][:-1]
                starts -= np.repeat(offsets[a:b] - offsets[a], np.diff(places))
                at = pa.array(places, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(a, b - a), pa.ListArray.from_arrays(at, pa.array(ids.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(starts.astype(np.int32)))],
                    [key, "ids", "byte_offsets"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>, byte_offsets array<int>")


def decode(encoded: DataFrame, ranks: str, pattern: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """(key, data binary): the bytes of each row's ids; a null list gives no bytes."""

    def run(batches):
        decoder = _coder(ranks, pattern)[1]
        for batch in batches:
            keys, lists = columns(batch, key, ids)
            out = [b"" if x is None else decoder.decode(np.asarray(x, np.int64))[0].tobytes() for x in lists.to_pylist()]
            yield pa.RecordBatch.from_arrays([keys, pa.array(out, pa.binary())], [key, "data"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, ids).mapInArrow(run, f"`{key}` {kind}, data binary")


def round_trip(docs: DataFrame, ranks: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256, lossless): encodes each whole text, decodes its ids and digests both,
    batch by batch, so that ids never leave the worker."""

    def run(batches):
        encoder, decoder = _coder(ranks, pattern)
        for batch in batches:
            keys, texts = columns(batch, key, text)
            data, offsets = text_buffer(texts)
            for a, b in blocks(offsets, 2 << 20):
                part = data[offsets[a] : offsets[b]]
                ids, places = encoder.encode(part, offsets[a : b + 1] - offsets[a])
                decoded, starts = decoder.decode(ids)
                whole, raw, back = ids.astype("<u4", copy=False), part.tobytes(), decoded.tobytes()
                at, ends = places.tolist(), starts[places].tolist()
                rows = [[], [], []]
                for k in range(b - a):
                    rows[0].append(hashlib.sha256(whole[at[k] : at[k + 1]]).hexdigest())
                    rows[1].append(hashlib.sha256(mine := back[ends[k] : ends[k + 1]]).hexdigest())
                    rows[2].append(mine == raw[offsets[a + k] - offsets[a] : offsets[a + k + 1] - offsets[a]])
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(a, b - a), pa.array(np.diff(places)), *map(pa.array, rows)],
                    [key, "n_tokens", "ids_sha256", "decoded_sha256", "lossless"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, lossless boolean")
