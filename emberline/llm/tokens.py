"""Tokenizing inside Spark tasks with the tokenizers library.

Byte-level and word BPE tokenizers treat the units of a text apart: a word with
the one space before it, or a word alone. So a worker encodes a unit once for as
long as its cache holds it, and gathers texts' ids from the units'. Units are found
and looked up, by 64-bit hashes of their bytes, in numpy on Arrow columns. White space
that units can't be told apart by stays inside one, and texts with special
tokens are encoded whole. Either way the ids are the library's own.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa

from emberline.llm.textkit import on_release, ragged, span_hashes, text_bytes

#: Bytes of a worker's cache, if the caller names none: half for a table of units by hash, half for their ids.
CACHE_BYTES = 40 << 20
#: Bytes that a unit takes in the table.
_ENTRY_BYTES = 16
#: Units that are encoded as one text, where their ids can be told apart again.
JOINED_UNITS = 1_000
#: Text bytes to encode at a time: units that come again in them are looked up once.
TEXT_BYTES = 2 << 20
_PUNCTUATION = frozenset(".,;:!?|")
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
#: White space beyond ASCII: of UTF-8 bytes before the last one, the last ones.
_WIDE_WHITE = {
    b"\xc2": [0x85, 0xA0],
    b"\xe1\x9a": [0x80],
    b"\xe2\x80": [*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF],
    b"\xe2\x81": [0x9F],
    b"\xe3\x80": [0x80],
}


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def _letters(normalised: bool) -> np.ndarray:
    """Whether a character up to U+FFFF is a letter; if normalised, also after NFC and lower-casing, beside any others (Hangul's parts compose)."""
    out = np.array([chr(c).isalpha() for c in range(1 << 16)])
    if normalised:
        for c in np.flatnonzero(out).tolist():
            out[c] = unicodedata.normalize("NFC", chr(c)).lower().isalpha()
        out[0x1100:0x1200] = False
    return out


def _letter_bytes(raw: np.ndarray, normalised: bool) -> np.ndarray:
    """Of UTF-8 text, which bytes are letters'."""
    table = _letters(normalised)
    if not len(raw) or raw.max() < 0x80:
        return table[raw]
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), dtype="<u4")
    known = table[np.minimum(points, 0xFFFF)] & (points <= 0xFFFF)
    return known[np.cumsum((raw & 0xC0) != 0x80) - 1]


class Encoder:
    """Texts to token ids, as unsigned 32-bit little-endian bytes."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        self.cache_bytes = cache_bytes
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        pre, norm = spec["pre_tokenizer"] or {}, spec["normalizer"]
        #: "spaced": a space belongs to the word after it; "dropped": white space only parts words; else whole texts
        self.mode = "whole"
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            self.mode = "spaced"
        elif pre.get("type") == "Sequence" and (first := pre["pretokenizers"][0]).get("behavior") == "Removed" and first.get("invert") and r"\s" in str(first["pattern"]):
            self.mode = "dropped"
        slots = 1 << max(4, (cache_bytes // 2 // _ENTRY_BYTES).bit_length() - 1)
        #: Of each slot: a unit's hash (0: none), and where its ids start in ``held`` and how many they are. A newer unit takes an older one's slot.
        self.keys, self.start, self.n = np.zeros(slots, dtype=np.uint64), np.zeros(slots, dtype=np.int32), np.zeros(slots, dtype=np.int32)
        self.held, self.used = np.empty(cache_bytes // 8, dtype=np.uint32), 0
        #: Of each byte that may end a word, its id; else -1
        self.marks = np.full(256, -1, dtype=np.int64)
        for mark, packed in zip(_PUNCTUATION, self.whole(list(_PUNCTUATION)), strict=True):
            if len(packed) == 4:
                self.marks[ord(mark)] = ids(packed)[0]
        newline = self.whole(["\n"])[0]
        self.newline = int(ids(newline)[0]) if len(newline) == 4 else -1
        tokens = self.tokenizer.get_vocab()
        #: ids that begin (spaced) or end (dropped) a unit of letters
        self.edge = np.zeros(max(tokens.values()) + 1, dtype=bool)
        suffix = spec["model"].get("end_of_word_suffix")
        for token, i in tokens.items():
            self.edge[i] = token.startswith("\u0120") if self.mode == "spaced" else bool(suffix) and token.endswith(suffix)

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, raw: np.ndarray, lo: np.ndarray, hi: np.ndarray, prefix: str) -> tuple[np.ndarray, np.ndarray]:
        """All ids of words of letters alone, each after the prefix, and how many are each word's; many are encoded as one text and told apart by edges."""
        between = "\n" if self.mode == "spaced" and not prefix else " "
        length = hi - lo + 1
        joined = raw[np.minimum(np.repeat(lo, length) + ragged(length), len(raw) - 1)]
        stop = np.cumsum(length)
        joined[stop - 1] = ord(between)
        first = np.r_[0, stop]
        bounds = [*range(0, len(lo), JOINED_UNITS), len(lo)]
        texts = [prefix + joined[first[a] : first[b] - 1].tobytes().decode() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        flat, sizes = [], []
        for a, b, text, packed in zip(bounds[:-1], bounds[1:], texts, self.whole(texts), strict=True):
            own = ids(packed)
            if between == "\n":  # the mark's own id stands between words
                edges = np.flatnonzero(own == self.newline)
                counts, own = np.diff(np.r_[-1, edges, len(own)]) - 1, np.delete(own, edges)
            elif self.mode == "spaced":
                counts = np.diff(np.r_[np.flatnonzero(self.edge[own]), len(own)])
            else:
                counts = np.diff(np.r_[-1, np.flatnonzero(self.edge[own])])
            if len(counts) != b - a or counts.sum() != len(own):  # a word that isn't one piece after normalisation
                apart = self.whole([prefix + w for w in text[len(prefix) :].split(between)])
                counts, own = np.array([len(x) // 4 for x in apart]), ids(b"".join(apart))
            flat.append(own)
            sizes.append(counts)
        return np.concatenate(flat), np.concatenate(sizes)

    def _hold(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Puts ids of units into ``held``; where each one's start."""
        if self.used + len(flat) > len(self.held):
            self.held = np.concatenate([self.held[: self.used], np.empty(len(flat), dtype=np.uint32)])
        self.held[self.used : self.used + len(flat)] = flat
        begin = (self.used + np.cumsum(sizes) - sizes).astype(np.int32)
        self.used += len(flat)
        return begin

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys & np.uint64(len(self.keys) - 1)).astype(np.int64)

    def _enter(self, keys: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> None:
        own = self._slots(keys)
        self.keys[own], self.start[own], self.n[own] = keys, begin, sizes

    def _learn(self, keys: np.ndarray, data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encodes units of these hashes, bytes and places; where their ids start, and how many they are.

        A word of letters alone is encoded once, also if it comes with different marks at its end, whose ids follow the word's.
        """
        length = hi - lo
        raw = data[np.repeat(lo, length) + ragged(length)]
        hi = np.cumsum(length)
        lo = hi - length
        begin, sizes = np.zeros(len(keys), dtype=np.int32), np.zeros(len(keys), dtype=np.int32)
        spaced = (raw[lo] == 0x20) & (self.mode == "spaced")
        mark = self.marks[raw[hi - 1]]
        mark[hi - 1 <= lo + spaced] = -1
        stop = hi - (mark >= 0)
        letters = np.r_[0, np.cumsum(_letter_bytes(raw, self.mode == "dropped"))]
        plain = (letters[stop] - letters[lo + spaced] == stop - lo - spaced) & (stop > lo + spaced)
        others = np.flatnonzero(~plain)
        for at in range(0, len(others), 20_000):
            part = others[at : at + 20_000]
            packed = self.whole([raw[a:b].tobytes().decode() for a, b in zip(lo[part].tolist(), hi[part].tolist(), strict=True)])
            sizes[part] = [len(p) // 4 for p in packed]
            begin[part] = self._hold(ids(b"".join(packed)), sizes[part])
        # Words without their marks: those that are known are looked up.
        own = np.flatnonzero(plain)
        words, first, back = np.unique(np.maximum(span_hashes(raw, lo[own], stop[own]), np.uint64(1)), return_index=True, return_inverse=True)
        at = self._slots(words)
        start, n = self.start[at], self.n[at]
        fresh = self.keys[at] != words
        for after in (False, True):
            new = np.flatnonzero(fresh & (spaced[own[first]] == after))
            if len(new):
                k = own[first[new]]
                flat, n[new] = self._words(raw, lo[k] + after, stop[k], " " if after else "")
                start[new] = self._hold(flat, n[new])
        self._enter(words[fresh], start[fresh], n[fresh])
        begin[own], sizes[own] = start[back], n[back]
        ended = np.flatnonzero(plain & (mark >= 0))
        n = sizes[ended] + 1
        flat = self.held[np.minimum(np.repeat(begin[ended], n) + ragged(n), len(self.held) - 1)]
        flat[np.cumsum(n) - 1] = mark[ended]
        begin[ended], sizes[ended] = self._hold(flat, n), n
        return begin, sizes

    def _units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where units start and end."""
        if self.mode == "dropped":
            inside = (data != 0x20) & (data != 0x0A)
            start, stop = inside.copy(), inside.copy()
            start[1:] &= ~inside[:-1]
            inner = offsets[1:-1]
            inner = inner[(inner < len(data)) & (inner > 0)]
            start[inner] = inside[inner]
            stop[:-1] &= ~inside[1:] | start[1:]
            return np.flatnonzero(start), np.flatnonzero(stop) + 1
        white = _WHITE[data]
        for head, lasts in _WIDE_WHITE.items():
            at = np.flatnonzero(data[: len(data) - len(head)] == head[0])
            for k in range(1, len(head)):
                at = at[data[at + k] == head[k]]
            at = at[np.isin(data[at + len(head)], lasts)]
            for k in range(len(head) + 1):
                white[at + k] = True
        # One space, or one line's end, between two characters of a text that are none.
        alone = np.zeros(len(data), dtype=bool)
        alone[1:-1] = (data[1:-1] == 0x20) | (data[1:-1] == 0x0A)
        alone[1:-1] &= ~white[:-2] & ~white[2:]
        own = np.flatnonzero(np.diff(offsets))
        alone[offsets[own]] = alone[offsets[own + 1] - 1] = False
        start = alone.copy()
        start[1:] |= alone[:-1] & (data[:-1] == 0x0A)
        start[offsets[own]] = True
        starts = np.flatnonzero(start)
        return starts, np.r_[starts[1:], len(data)]

    def _with_specials(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Texts that hold a special token, written out."""
        raw, found = data.tobytes(), []
        for special in map(str.encode, self.specials):
            at = raw.find(special)
            while at >= 0:
                row = int(np.searchsorted(offsets, at, "right")) - 1
                if at + len(special) <= offsets[row + 1]:
                    found.append(row)
                at = raw.find(special, at + 1)
        return np.unique(np.array(found, dtype=np.int64))

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column's texts (null: none), and where each text's start, and the end."""
        data, offsets = text_bytes(column)
        rows = np.arange(len(column)) if self.mode == "whole" else self._with_specials(data, offsets)
        if self.mode == "whole" or not len(data):
            flat, bounds = np.empty(0, dtype=np.uint32), np.zeros(len(column) + 1, dtype=np.int64)
        else:
            flat, bounds = self._gathered(data, offsets)
        if not len(rows):
            return flat, bounds
        parts = [flat[lo:hi] for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]
        for row, packed in zip(rows.tolist(), self.whole([data[offsets[r] : offsets[r + 1]].tobytes().decode() for r in rows]), strict=True):
            parts[row] = ids(packed)
        return np.concatenate(parts) if parts else flat, np.cumsum([0, *map(len, parts)])

    def _gathered(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends = self._units(data, offsets)
        if self.used > len(self.held) // 4 * 3:
            self.keys[:] = 0
            self.held, self.used = np.empty(self.cache_bytes // 8, dtype=np.uint32), 0
        keys = np.maximum(span_hashes(data, starts, ends), np.uint64(1))
        own = self._slots(keys)
        start, n = self.start[own], self.n[own]
        missing = np.flatnonzero(self.keys[own] != keys)
        if len(missing):
            new, first, back = np.unique(keys[missing], return_index=True, return_inverse=True)
            at = missing[first]
            begin, sizes = self._learn(new, data, starts[at], ends[at])
            start[missing], n[missing] = begin[back], sizes[back]
            self._enter(new, begin, sizes)
        flat = self.held[np.repeat(start, n) + ragged(n)]
        return flat, np.r_[0, np.cumsum(n)][np.searchsorted(starts, offsets)]

    def encode(self, texts: list[str]) -> list[bytes]:
        flat, bounds = self.encode_column(pa.array(texts, pa.string()))
        return [flat[lo:hi].tobytes() for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


@lru_cache(maxsize=1)
def encoder(path: str, cache_bytes: int = CACHE_BYTES) -> Encoder:
    """One per worker process, for the vocabulary file used last."""
    return Encoder(path, cache_bytes)


#: What tasks that encode keep from task to task.
forget = on_release(encoder.cache_clear)


def ids(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype="<u4")
