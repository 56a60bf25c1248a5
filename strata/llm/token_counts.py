"""Token counts by overlap resynchronisation.

Texts up to ``chunk`` code points are encoded in one go.  A longer one is encoded in chunks that overlap: a chunk and the next
one, which starts ``overlap`` before the first ends, are spliced at a place where both have a token boundary by their offsets
and which is proven stable in the whole text.  If the overlap holds no such place, it is widened, twice at each try, in the end
to the rest of the text; so every count is exact.

A place p is stable if no special token spans it and
* a character that is no white space precedes it and a blank or line feed follows it, or
* a letter precedes it and an ASCII mark other than the apostrophe follows it.
No match of the pre-tokenisation pattern spans such a place, and its look-ahead only concerns white space that starts before it.

Defined results: null text counts as empty (0 bytes, 0 tokens); repeated rows each give a row; an empty table gives no
rows; texts of any length are counted whole; other columns are not read, whatever their names.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strata.llm.common import blocks, columns, text_buffer
from strata.llm.segments import BEFORE_BLANK, cuts_are_proven, library_encoder

#: Letters that no Unicode version disputes: Latin, Greek, Cyrillic, kana, common Han and Hangul.
_LETTERS = "A-Za-z" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x391, 0x3A1), (0x3B1, 0x3C9), (0x410, 0x44F), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)))
#: A stable place, but for special tokens.
_STABLE = re.compile(BEFORE_BLANK + rf"|(?<=[{_LETTERS}])(?=[!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{{|}}~])")


class ResyncCounter:
    """Counts tokens of long texts.  ``tokenizer``: a ``tokenizers.Tokenizer``."""

    def __init__(self, tokenizer, chunk: int = 32_768, overlap: int = 256):
        if not 0 < overlap < chunk:
            raise ValueError("0 < overlap < chunk")
        self.tokenizer, self.chunk, self.overlap = tokenizer, chunk, overlap
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.widened = 0

    def _encode(self, text: str, start: int, end: int) -> np.ndarray:
        """Starts of the chunk's tokens in the whole text."""
        found = self.tokenizer.encode(text[start:end], add_special_tokens=False).offsets
        return np.fromiter((a for a, _ in found), np.int64, len(found)) + start

    def _spanned(self, text: str, p: int) -> bool:
        return any(s in text[max(0, p - len(s) + 1) : p + len(s) - 1] for s in self.special)

    def splice(self, text: str, left: np.ndarray, right: np.ndarray, start: int, end: int) -> int | None:
        """The last stable place in (start, end) where tokens start in both encodings."""
        common = np.intersect1d(left[left > start], right, assume_unique=False)
        for m in reversed(list(_STABLE.finditer(text, start + 1, end))):
            p = m.start()
            k = int(np.searchsorted(common, p))
            if p < end and k < len(common) and common[k] == p and not self._spanned(text, p):
                return p
        return None

    def count(self, text: str) -> int:
        size = len(text)
        if size <= self.chunk:
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        total, start, end = 0, 0, self.chunk
        left = self._encode(text, 0, end)
        while end < size:
            overlap = self.overlap
            while True:
                at = max(start, end - overlap)
                stop = min(size, max(at, start) + self.chunk + overlap)
                if at == start:  # no place to splice at: one chunk from the last place to further on
                    self.widened += 1
                    left, end = self._encode(text, start, stop := min(size, start + 2 * (end - start))), stop
                    break
                right = self._encode(text, at, stop)
                p = self.splice(text, left, right, at, end)
                if p is not None:
                    total += int(np.searchsorted(left, p))
                    left, start, end = right[np.searchsorted(right, p) :], p, stop
                    break
                self.widened += 1
                overlap *= 2
        return total + len(left)


@functools.cache
def _counter(path: str, chunk: int, overlap: int):
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return None, None, lambda text: len(model.encode(text))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    if not cuts_are_proven(tokenizer):
        return None, None, lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
    return library_encoder(tokenizer), ResyncCounter(tokenizer, chunk, overlap).count, None


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, chunk: int = 32_768, overlap: int = 256, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit, chunked): ``chunked`` tells the texts longer than ``chunk`` code points, which
    overlapping chunks counted.  A sentencepiece model has no such boundaries,
    and for a pattern other than those of ``segments`` none is proven; then each text is encoded in one go."""

    def run(batches):
        encoder, resync, plain = _counter(tokenizer, chunk, overlap)
        for batch in batches:
            keys, texts = columns(batch, key, text)
            data, offsets = text_buffer(texts)
            sizes = np.diff(offsets)
            chunked = np.zeros(len(sizes), bool)
            if plain:
                counts = np.array([plain(x or "") for x in texts.to_pylist()], np.int64)
            else:
                counts = np.zeros(len(sizes), np.int64)
                short = np.flatnonzero(sizes <= chunk)
                picked = texts.take(pa.array(short)) if len(short) < len(sizes) else texts
                part, at = text_buffer(picked)
                for a, b in blocks(at, 2 << 20):
                    counts[short[a:b]] = np.diff(encoder.encode(part[at[a] : at[b]], at[a : b + 1] - at[a])[1])
                for k in np.flatnonzero(sizes > chunk).tolist():
                    whole = texts[k].as_py()
                    counts[k], chunked[k] = resync(whole), len(whole) > chunk
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(sizes), pa.array(counts), pa.array(counts > limit), pa.array(chunked)],
                [key, "n_bytes", "n_tokens", "over_limit", "chunked"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean, chunked boolean")
