"""Encoding through the ``tokenizers`` library, which is called once for each distinct text segment.

A text is cut only where every pre-tokenisation pattern in use provably ends a match:

* before ASCII white space that follows something else than white space, and
* between a letter and an ASCII mark other than the apostrophe (a match that holds a letter at its end stops there).

So the ids of a text are those of its segments, one after the other.  Texts that hold white space outside ASCII, control
separators, or the start of a special token are not cut by these rules but go to the library by way of ``_whole``.
Segments up to 24 bytes are looked up by their exact bytes in an open-addressing table, all of a block at once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np

SHORT, ALL = 24, np.uint64(0xFFFFFFFFFFFFFFFF)
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD)]


def _lut(members) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


_SPACE = _lut(b" \t\n\r\x0b\x0c")
_LETTER = _lut(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_MARK = _lut(b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~')
_ODD_START = _lut([0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3])
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_HIDDEN = "".join(map(chr, (0x85, 0x180E, *range(0x200B, 0x2010), 0x2060, 0xFEFF)))
#: Before a blank or line feed that follows a character which is certainly no white space.
BEFORE_BLANK = rf"(?<=[^\s\x1c-\x1f{_HIDDEN}])(?=[ \n])"
_SAFE = re.compile(BEFORE_BLANK)


class SegmentEncoder:
    """``encode_many``: texts to lists of ids by the library.  ``special``: bytes that begin special tokens, or None.  ``cut``: whether texts
    may be cut at all."""

    def __init__(self, encode_many: Callable[[list[str]], list[list[int]]], special: bytes | None = None, max_entries: int = 1_000_000, cut: bool = True):
        self.encode_many, self.special, self.max_entries, self.cut = encode_many, special, max_entries, cut
        self.slots = 1 << (2 * max_entries - 1).bit_length()
        self._clear()

    def _clear(self) -> None:
        self.table = np.full(self.slots, -1, np.int32)
        self.keys = np.zeros((3, 1024), np.uint64)
        self.lens = np.zeros(1024, np.uint8)
        self.first = np.zeros(1024, np.int64)
        self.count = np.zeros(1024, np.int64)
        self.n = 0
        self.pool, self.used = np.zeros(1 << 14, np.uint32), 0
        self.long: dict[bytes, int] = {}

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents (uint32, one after the other) and each document's n+1 places among them."""
        if self.n > self.max_entries or self.used > 16 * self.max_entries:
            self._clear()
        size = len(data)
        if not size:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        start = self._cuts(data, offsets)
        entry = self._entries(data, start, np.diff(np.append(start, size)))
        count = self.count[entry]
        ends = np.cumsum(count)
        at = np.arange(ends[-1]) + np.repeat(self.first[entry] - (ends - count), count)
        places = np.append(0, ends)[np.searchsorted(start, offsets)]
        return self.pool[at], places

    def _cuts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not self.cut:
            return offsets[:-1][np.diff(offsets) > 0]
        space = _SPACE[data]
        cut = np.zeros(len(data), bool)
        letter = _LETTER[data]
        letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)  # Latin-1 letters
        cut[1:] = (~space[:-1] & space[1:]) | (letter[:-1] & _MARK[data[1:]])
        for k in self._whole_documents(data, offsets):
            cut[offsets[k] : offsets[k + 1]] = False
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(cut)

    def _whole_documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(_ODD_START[data])
        a = data[at]
        b, c = (np.where(at + k < len(data), data[np.minimum(at + k, len(data) - 1)], 0) for k in (1, 2))
        odd = a < 0x20
        odd |= (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        odd |= (a == 0xE1) & (((b == 0x9A) & (c == 0x80)) | ((b == 0xA0) & (c == 0x8E)))
        odd |= (a == 0xE2) & (((b == 0x80) & ((c <= 0x8F) | ((c >= 0xA8) & (c <= 0xAF)))) | ((b == 0x81) & (c >= 0x9F)))
        odd |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
        found = at[odd]
        if self.special:
            raw, more, k = data.tobytes(), [], -1
            while (k := raw.find(self.special, k + 1)) >= 0:
                more.append(k)
            found = np.append(found, np.array(more, np.int64))
        return np.unique(np.searchsorted(offsets, found, side="right") - 1)

    def _entries(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        padded = np.append(data, np.zeros(32, np.uint8))
        words = np.ndarray((len(data) + 24,), "<u8", padded, strides=(1,))
        entry = np.full(len(start), -1, np.int64)
        short = np.flatnonzero(length <= SHORT)
        s, n = start[short], length[short]
        key = [words[s + 8 * k] & _MASKS[np.clip(n - 8 * k, 0, 8)] for k in range(3)]
        h = key[0] * _K[0] + key[1] * _K[1] + key[2] * _K[2] + n.astype(np.uint64) * _K[3]
        h ^= h >> np.uint64(32)
        h *= _K[4]
        h ^= h >> np.uint64(29)
        found = self._look_up(h, key, n)
        new = np.flatnonzero(found < 0)
        if len(new):
            _, one, which = np.unique(h[new], return_index=True, return_inverse=True)
            rep = new[one]
            base = self._add([self._text(data, s[i], n[i]) for i in rep.tolist()])
            self._store(base, h[rep], [k[rep] for k in key], n[rep])
            found[new] = base + which
            same = (n[new] == n[rep][which]) & np.logical_and.reduce([k[new] == k[rep][which] for k in key])
            for i in new[~same].tolist():  # other bytes under the same 64-bit hash
                found[i] = self._add([self._text(data, s[i], n[i])])
        entry[short] = found
        rest = np.flatnonzero(length > SHORT)
        if len(rest):
            entry[rest] = self._rest(data, start[rest], length[rest])
        return entry

    @staticmethod
    def _text(data: np.ndarray, s: int, n: int) -> str:
        return data[s : s + n].tobytes().decode("utf-8", "replace")

    def _rest(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> list[int]:
        raws = [data[s : s + n].tobytes() for s, n in zip(start.tolist(), length.tolist())]
        new = list(dict.fromkeys(r for r in raws if r not in self.long))
        small = [r for r in new if len(r) <= 2000]
        base = self._add([r.decode("utf-8", "replace") for r in small])
        at = {r: base + k for k, r in enumerate(small)}
        for r in new:
            if r not in at:
                at[r] = self._append([self._whole(r.decode("utf-8", "replace"))])
        out = [self.long[r] if r in self.long else at[r] for r in raws]
        self.long.update((r, k) for r, k in at.items() if len(r) <= 200)
        return out

    def _whole(self, text: str) -> list[int]:
        """A long text, cut before blanks that follow a visible character; special tokens hold no blanks."""
        parts, last = [], 0
        while self.cut and len(text) - last > 20_000:
            m = _SAFE.search(text, last + 16_000)
            if not m:
                break
            parts.append(text[last : m.start()])
            last = m.start()
        return [i for ids in self.encode_many([*parts, text[last:]]) for i in ids]

    def _add(self, texts: list[str]) -> int:
        return self._append(self.encode_many(texts)) if texts else self.n

    def _append(self, ids: list[list[int]]) -> int:
        """New entries for lists of ids; returns the first one's index."""
        base, m = self.n, len(ids)
        while self.n + m > len(self.lens):
            self.keys = np.concatenate([self.keys, np.zeros_like(self.keys)], axis=1)
            self.lens, self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.lens, self.first, self.count))
        count = np.fromiter(map(len, ids), np.int64, m)
        total = int(count.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + total] = np.fromiter((i for x in ids for i in x), np.uint32, total)
        self.first[base : base + m] = self.used + np.cumsum(count) - count
        self.count[base : base + m] = count
        self.used += total
        self.n += m
        return base

    def _look_up(self, h: np.ndarray, key: list[np.ndarray], n: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        slot = (h & np.uint64(self.slots - 1)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            e = self.table[slot]
            todo, slot, e = todo[e >= 0], slot[e >= 0], e[e >= 0]
            hit = self.lens[e] == n[todo]
            for k in range(3):
                hit &= self.keys[k][e] == key[k][todo]
            out[todo[hit]] = e[hit]
            todo, slot = todo[~hit], (slot[~hit] + 1) & (self.slots - 1)
        return out

    def _store(self, base: int, h: np.ndarray, key: list[np.ndarray], n: np.ndarray) -> None:
        m = len(h)
        for k in range(3):
            self.keys[k][base : base + m] = key[k]
        self.lens[base : base + m] = n
        if self.n > self.slots // 2:
            return  # the table is full enough; encode() clears it before the next block
        slot, idx = (h & np.uint64(self.slots - 1)).astype(np.int64), np.arange(base, base + m)
        while len(idx):
            free = self.table[slot] < 0
            self.table[slot[free]] = idx[free]
            placed = self.table[slot] == idx
            idx, slot = idx[~placed], (slot[~placed] + 1) & (self.slots - 1)


#: The patterns for which the cuts above are proven.
PATTERNS = (
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""",
    r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+""",
)


def cuts_are_proven(tokenizer) -> bool:
    """Whether a ``tokenizers.Tokenizer`` splits by one of ``PATTERNS`` and normalises nothing but case, composition and white space."""
    state = json.loads(tokenizer.to_str())
    pre, normal = state["pre_tokenizer"] or {}, state["normalizer"]
    steps = pre.get("pretokenizers", [pre])
    patterns = [x["pattern"].get("Regex") for x in steps if x.get("type") == "Split"] + [PATTERNS[0] for x in steps if x.get("type") == "ByteLevel" and x["use_regex"]]
    changes = [] if normal is None else normal.get("normalizers", [normal])
    return (all(x.get("type") == "ByteLevel" and not x["add_prefix_space"] or x.get("type") == "Split" for x in steps) and len(patterns) == 1 and patterns[0] in PATTERNS
            and all(x["type"] in ("NFC", "Lowercase") or x["type"] == "Replace" and (x["pattern"], x["content"]) == ({"Regex": "\\s+"}, " ") for x in changes))


def library_encoder(tokenizer, **limits) -> SegmentEncoder:
    """For a ``tokenizers.Tokenizer``: no added begin or end tokens, special strings in texts by its default.  Texts are cut only if the cuts
    are proven for its pattern and all its special tokens begin alike; else each is encoded whole."""
    starts = {t.content[:2].encode() for t in tokenizer.get_added_tokens_decoder().values()}
    special = starts.pop() if len(starts) == 1 else None  # what is left are starts that differ
    encode = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    return SegmentEncoder(encode, special, cut=not starts and cuts_are_proven(tokenizer), **limits)
