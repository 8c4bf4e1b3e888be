"""Token ids by a public tokenizer, cached by word, and per-document digests of them."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterable
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer, normalizers, pre_tokenizers

#: Vocabulary file that the registered queries use.
WORD_BPE = "word_bpe_49k.json"
#: Words after which a worker's cache begins anew.
KEPT = 800_000
#: Rows encoded at once (texts' own sizes bound them too); repeated words are looked up once.
ROWS = 4096
#: Letters that the tokenizer lowers one by one and never joins with a neighbour, and marks that group by themselves and are in no special token.
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-įı-ǃ", "-.,!?;:#$%&*|\"()\\[\\]{}_/=+@~^`\\\\"
_PLAIN = re.compile(f"[{_LETTERS}0-9{_MARKS}]+")
_PIECES = re.compile(f"[{_LETTERS}]+|[0-9]|[{_MARKS}]+")
#: What Python and Arrow split at and the tokenizer doesn't.
_SEPARATORS = "[\x1c-\x1f]"
#: Stands between words that are encoded in one string; it is in no plain word.
_DIVIDER = "'"
_WORDS_AT_ONCE = 16


class Encoder:
    """Ids of whole texts, the same as ``Tokenizer.encode(text, add_special_tokens=False)``.

    With ``by_word`` (for vocabularies that drop white space, whose tokens never cross
    it) every distinct run without white space is encoded once and remembered. Runs of
    plain letters, digits and marks are cut into what the tokenizer takes apart anyway
    and are encoded many in one string. The cache is bounded and begins anew when full.
    """

    def __init__(self, path: str | None = None, by_word: bool = True, kept: int = KEPT) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        path = path or public_tokenizers.path(WORD_BPE)
        self.full, self.by_word, self.kept = Tokenizer.from_file(path), by_word, kept
        self.vocabulary = self.full.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2") if self.vocabulary <= 1 << 16 else np.dtype("<u4")
        if by_word:
            self.pieces = Tokenizer.from_file(path)
            self.pieces.normalizer = normalizers.Sequence([])
            self.pieces.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            (self.divider,) = self.full.encode(_DIVIDER, add_special_tokens=False).ids
            as_bytes, letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False), filter(_PLAIN.fullmatch, map(chr, range(128, 0x250)))
            self.as_bytes = {ord(c): as_bytes.pre_tokenize_str(c)[0][0] for c in map(str.lower, letters)}
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.starts = np.zeros(0, self.dtype), np.zeros(1, np.int64)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.full.encode_batch_fast(texts, add_special_tokens=False)]
        return self._joined(found), np.fromiter(map(len, found), np.int64, len(found))

    def _joined(self, found: Iterable[list[int]]) -> np.ndarray:
        return np.concatenate([np.zeros(0, self.dtype), *(np.array(ids, self.dtype) for ids in found)])

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of plain words, many to a string; dividers show where each ends."""
        apart = [w if w.isalpha() else " ".join(_PIECES.findall(w)) for w in words]
        strings = [f" {_DIVIDER} ".join([*apart[i : i + _WORDS_AT_ONCE], ""]).lower() for i in range(0, len(apart), _WORDS_AT_ONCE)]
        strings = [x if x.isascii() else x.translate(self.as_bytes) for x in strings]
        flat = self._joined(e.ids for e in self.pieces.encode_batch_fast(strings, add_special_tokens=False))
        ends = np.flatnonzero(flat == self.divider)
        return np.delete(flat, ends), np.diff(ends, prepend=-1) - 1

    def _learn(self, words: list[str]) -> None:
        plain = sorted((w for w in words if _PLAIN.fullmatch(w)), key=str.isascii)
        odd = [*set(words).difference(plain)] if len(plain) < len(words) else []
        parts = [self._plain(plain), self._whole(odd)]
        n = len(self.index)
        self.index.update(zip(plain + odd, range(n, n + len(words)), strict=True))
        self.flat = np.concatenate([self.flat, *(flat for flat, _ in parts)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate([sizes for _, sizes in parts]))])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and where each text's begin in it (and the last ends); null counts as empty."""
        texts = pc.fill_null(texts, "")
        if not self.by_word:
            flat, sizes = self._whole(texts.to_pylist())
            return flat, np.concatenate([[0], np.cumsum(sizes)])
        split = pc.utf8_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        # Splitting leaves empty words at the ends of a text; they have no ids.
        distinct, which = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy(zero_copy_only=False)
        if len(self.index) > self.kept:
            self._forget()
        if unseen := [w for w in distinct if w not in self.index]:
            self._learn(unseen)
        at = np.fromiter(map(self.index.__getitem__, distinct), np.int64, len(distinct))[which]
        first, sizes = self.starts[at], self.starts[at + 1] - self.starts[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        flat = self.flat[np.repeat(first - ends[:-1], sizes) + np.arange(ends[-1])]
        bounds = ends[split.offsets.to_numpy() - split.offsets[0].as_py()]
        apart = np.flatnonzero(pc.match_substring_regex(texts, _SEPARATORS).to_numpy(zero_copy_only=False))
        return self._replaced(flat, bounds, apart, texts) if len(apart) else (flat, bounds)

    def _replaced(self, flat: np.ndarray, bounds: np.ndarray, which: np.ndarray, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """With the ids of some texts taken from the tokenizer whole."""
        found = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for i in which:
            found[i] = self._whole([texts[int(i)].as_py()])[0]
        return np.concatenate(found), np.concatenate([[0], np.cumsum([len(x) for x in found])])


@cache
def encoder(path: str | None = None, by_word: bool = True, kept: int = KEPT) -> Encoder:
    """One encoder for each worker process, so that later tasks find its cache warm."""
    return Encoder(path, by_word, kept)


def with_end(flat: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of several texts, each followed by ``end_id``, as unsigned 32-bit integers, and their new bounds."""
    n = len(bounds) - 1
    return np.insert(flat.astype("<u4"), bounds[1:], end_id), bounds + np.arange(n + 1)


def crc32(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())
