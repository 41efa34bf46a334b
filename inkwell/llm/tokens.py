"""Token ids of many texts at once, exactly those that the tokenizers library gives for each whole text.

Both vocabularies in use split a text at certain places whatever stands around them, so a text may be cut there into
pieces and each *distinct* piece encoded once: the ids of the text are those of its pieces, one after another.  Pieces
are told apart by 64-bit hashes of their bytes.

* byte level (``leading_space=True``): before a space that a non-space follows (the space belongs to the next token),
  and between a letter and the plain punctuation after it;
* word level (``leading_space=False``): at white space, which the vocabulary drops, and at such punctuation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from .common import span_hashes, text_bytes

#: Distinct pieces that a worker remembers between batches; beyond that it starts anew.  Bounds memory, not results.
REMEMBERED = 600_000

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[ord(c) for c in ",.;:!?*#$%&"]] = True
#: First bytes of a code point that is surely not white space: printable ASCII, and leads of blocks without any.
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_SOLID[0xC3:0xE0] = True
_SOLID[0xF0:0xF5] = True


class PieceEncoder:
    """One vocabulary with its memory of pieces; made once in each Python worker."""

    def __init__(self, path: str, leading_space: bool):
        self.tokenizer = Tokenizer.from_file(path)
        self.leading_space = leading_space
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)
        self.starts = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows (uint32), one row after another, and the number in each row; null counts as empty."""
        raw, offsets = text_bytes(column)
        rows = len(offsets) - 1
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        begin, end = self._pieces(raw, offsets)
        row = np.searchsorted(offsets, begin, side="right") - 1
        keys, first, which = np.unique(span_hashes(raw, begin, end), return_index=True, return_inverse=True)
        at = self._lookup(keys, raw, begin[first], end[first])[which]
        begins, sizes = self.starts[at], self.starts[at + 1] - self.starts[at]
        total = np.cumsum(sizes)
        index = np.arange(total[-1] if len(total) else 0) + np.repeat(begins - (total - sizes), sizes)
        per_row = np.bincount(row, weights=sizes, minlength=rows).astype(np.int64)
        return self.ids[index], per_row

    def _pieces(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = np.zeros(len(raw) + 1, bool)
        cut[offsets] = True
        # Between a letter and plain punctuation.  Latin-1 letters end in a byte after 0xC3 (but for two signs).
        letter = _LETTER[raw]
        latin = np.zeros(len(raw), bool)
        latin[1:] = (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
        letter |= latin
        cut[1:-1] |= letter[:-1] & _PUNCTUATION[raw[1:]]
        if self.leading_space:
            cut[:-2] |= (raw[:-1] == 0x20) & _SOLID[raw[1:]]
            # A lone line feed between printable characters is a token of its own.
            if len(raw) > 2:
                plain = (raw > 0x20) & (raw < 0x7F)
                lone = np.flatnonzero((raw[1:-1] == 10) & plain[:-2] & plain[2:]) + 1
                lone = lone[~cut[lone] & ~cut[lone + 1]]
                cut[lone] = cut[lone + 1] = True
            edges = np.flatnonzero(cut)
            return edges[:-1], edges[1:]
        space = (raw == 0x20) | ((raw >= 9) & (raw <= 13))
        cut[1:-1] |= space[1:] != space[:-1]
        edges = np.flatnonzero(cut)
        keep = ~space[edges[:-1]]
        return edges[:-1][keep], edges[1:][keep]

    def _lookup(self, keys: np.ndarray, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Places in the memory of the pieces with these sorted distinct hashes; new ones are encoded first."""
        if len(self.keys) + len(keys) > REMEMBERED:
            self._forget()
        near = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = near < len(self.keys)
        known[inside] = self.keys[near[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        if len(new):
            blob = raw.tobytes()
            texts = [blob[a:b].decode() for a, b in zip(begin[new].tolist(), end[new].tolist(), strict=True)]
            found: list[list[int]] = []
            for i in range(0, len(texts), 4_000):
                found += [e.ids for e in self.tokenizer.encode_batch_fast(texts[i : i + 4_000], add_special_tokens=False)]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter((x for ids in found for x in ids), np.uint32, int(sizes.sum()))
            place = len(self.starts) - 1 + np.arange(len(new))
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, flat])
            merged = np.concatenate([self.keys, keys[new]])
            order = np.argsort(merged, kind="stable")
            self.keys, self.place = merged[order], np.concatenate([self.place, place])[order]
            near = np.searchsorted(self.keys, keys)
        return self.place[near]


_ENCODERS: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, leading_space: bool) -> PieceEncoder:
    """This worker's encoder of a vocabulary file."""
    if (path, leading_space) not in _ENCODERS:
        _ENCODERS[path, leading_space] = PieceEncoder(path, leading_space)
    return _ENCODERS[path, leading_space]


def with_end(ids: np.ndarray, sizes: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end_id`` to the ids of each row; gives the new ids and the rows' offsets in them."""
    last = np.cumsum(sizes)
    return np.insert(ids, last, end_id).astype("<u4"), np.concatenate([[0], np.cumsum(sizes + 1)])
