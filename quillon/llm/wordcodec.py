"""Encoding by the tokenizers library with a bounded memory of words.

A text is cut where no merge can cross: before a space or newline that follows a visible character.
Each different word goes to the library once while it is remembered, so that corpora pay for their
vocabulary, not for their length. Texts with other white space, or with several white space
characters in a row, go to the library whole when white space is part of the tokens; so do texts that hold
one of the tokenizer's added tokens, which the library takes out of a text before it splits the rest.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .util import gather

#: Punctuation that forms a run of its own behind a letter in the pre-tokenisers used here.
TAIL = ",.;:!?|$%&*#"
#: White space whose handling may differ between libraries, runs of white space and our own marks.
ODD = r"[\x01-\x03\t\r\x0b\x0c\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]|[ \n][ \n]|^[ \n]|[ \n]$"
#: Words of a memory; beyond that a new one starts. Two are kept.
REMEMBERED = 350_000
#: Bytes encoded at once.
AT_ONCE = 2_000_000


class WordCodec:
    """spaced: white space belongs to tokens (byte-level BPE); else it only separates words and letters
    are lower-cased by the tokenizer."""

    def __init__(self, path: str, spaced: bool):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.spaced = spaced
        added = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.odd = "|".join(["(?i:" + "|".join(added) + ")"] * bool(added) + [ODD] * spaced)
        self.lead = "\u0120" if spaced else ""  # a space in the byte alphabet
        # bytes that print stand for themselves, the others for the characters from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.forget()
        self._age()

    def forget(self) -> None:
        self.known = {"": 0}
        self.flat = np.empty(1 << 20, dtype=np.uint32)
        self.off = np.zeros(1 << 18, dtype=np.int64)
        self.used = 0

    def _age(self) -> None:
        """Start a new memory and keep the last one, from which words still in use are taken over."""
        self.old = (self.known, self.flat[: self.used], self.off[: len(self.known) + 1])
        self.forget()

    def _direct(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _single(self, key: str) -> str | None:
        """The key in the byte alphabet of the model, if it is one pre-token of letters."""
        if not key.isalpha():
            return None
        if key.isascii():
            return self.lead + key
        if not self.spaced:
            key = self.tok.normalizer.normalize_str(key)
            if not key.isalpha():
                return None
        return self.lead + key.encode().decode("latin-1").translate(self.alphabet)

    def _learn(self, keys: list[str]) -> None:
        old, flat, off = self.old
        if kept := [k for k in keys if k in old]:
            ids, ends = gather(flat, off, np.fromiter(map(old.__getitem__, kept), np.int64, len(kept)))
            self._add(kept, ids, np.diff(ends))
            keys = [k for k in keys if k not in old]
        singles, rest = [], []
        encode, got = self.tok.model.tokenize, []
        for k in keys:
            if (said := self._single(k)) is None:
                rest.append(k)
            else:
                singles.append(k)
                got.append([t.id for t in encode(said)])
        if self.spaced:
            said = [k[1:] if k[:1] in ("\x02", "\x03") else "\n" + k[1:] if k[:1] == "\x01" else " " + k for k in rest]
        else:
            said = rest
        got += [e.ids for e in self.tok.encode_batch_fast(said, add_special_tokens=False)]
        lens = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
        self._add(singles + rest, np.fromiter(chain.from_iterable(got), np.uint32, int(lens.sum())), lens)

    def _add(self, keys: list[str], ids: np.ndarray, lens: np.ndarray) -> None:
        first, need = len(self.known), self.used + len(ids)
        if need > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty(max(need, len(self.flat)), np.uint32)))
        if first + len(keys) + 1 > len(self.off):
            self.off = np.concatenate((self.off, np.zeros(len(self.off) + len(keys), np.int64)))
        self.flat[self.used : need] = ids
        self.off[first + 1 : first + 1 + len(keys)] = self.used + np.cumsum(lens)
        self.used = need
        self.known.update(zip(keys, range(first, first + len(keys))))

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of each word of an array."""
        coded = words.dictionary_encode()
        whole = coded.dictionary
        base = pc.utf8_rtrim(whole, TAIL)
        cut = pc.and_(pc.less(pc.binary_length(base), pc.binary_length(whole)), pc.match_substring_regex(base, "[A-Za-z]$"))
        base = pc.if_else(cut, base, whole)
        if not self.spaced:
            base = pc.if_else(pc.string_is_ascii(base), pc.ascii_lower(base), base)
        base = base.dictionary_encode()
        tail = pc.filter(whole, cut)  # only these words have one behind a letter
        tail = pc.replace_substring_regex(tail, f"^(?s:.*)[A-Za-z]([{TAIL}]+)$", "\x03\\1" if self.spaced else "\\1").dictionary_encode()
        cuts = np.flatnonzero(cut.to_numpy(zero_copy_only=False))
        bases, tails = (x.dictionary.to_numpy(zero_copy_only=False).tolist() for x in (base, tail))  # faster than to_pylist()
        if len(self.known) > REMEMBERED:
            self._age()
        if new := list(dict.fromkeys([*bases, *tails]).keys() - self.known.keys()):
            self._learn(new)
        pairs = np.zeros(2 * len(whole), dtype=np.int64)  # word 0 is empty
        for at, x, keys in ((np.s_[::2], base, bases), (2 * cuts + 1, tail, tails)):
            pairs[at] = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))[x.indices.to_numpy(zero_copy_only=False)]
        ids, off = gather(self.flat, self.off, pairs)
        return gather(ids, off[::2], coded.indices.to_numpy(zero_copy_only=False))

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the offsets of the texts. Null texts count as empty. An Arrow column
        is read as it is, without Python strings."""
        col = texts if isinstance(texts, pa.Array) else pa.array(texts, type=pa.large_string())
        col = pc.fill_null(col.cast(pa.large_string()), "")
        ends = np.cumsum(pc.binary_length(col).to_numpy(zero_copy_only=False))
        parts, sizes, at = [], [], 0
        while at < len(col):
            before = int(ends[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + AT_ONCE, side="right")))
            ids, off = self._some(col.slice(at, end - at))
            parts.append(ids)
            sizes.append(np.diff(off))
            at = end
        flat = np.concatenate(parts) if parts else np.empty(0, np.uint32)
        lens = np.concatenate(sizes) if sizes else np.empty(0, np.int64)
        return flat, np.concatenate(([0], np.cumsum(lens))).astype(np.int64)

    def _some(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = np.flatnonzero(pc.match_substring_regex(col, self.odd).to_numpy(zero_copy_only=False)) if self.odd else []
        if not len(odd):
            return self._regular(col)
        out: list = [None] * len(col)
        for i, ids in zip(odd, self._direct(col.take(pa.array(odd)).to_pylist())):
            out[i] = ids
        rest = [i for i in range(len(col)) if out[i] is None]
        ids, off = self._regular(col.take(pa.array(rest, pa.int64())))
        for k, i in enumerate(rest):
            out[i] = ids[off[k] : off[k + 1]]
        lens = np.fromiter(map(len, out), np.int64, len(out))
        return np.concatenate(out), np.concatenate(([0], np.cumsum(lens)))

    def _regular(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.spaced:
            col = pc.binary_join_element_wise(pa.scalar("\x02", pa.large_string()), col, pa.scalar("", pa.large_string()))
        words = pc.split_pattern(pc.replace_substring(col, "\n", " \x01" if self.spaced else " "), " ")
        ids, off = self._words(words.flatten())
        return ids, off[words.offsets.to_numpy() - words.offsets[0].as_py()]


_codecs: dict[tuple, WordCodec] = {}


def codec(path: str, spaced: bool) -> WordCodec:
    """One codec per worker process and file."""
    if (path, spaced) not in _codecs:
        _codecs[path, spaced] = WordCodec(path, spaced)
    return _codecs[path, spaced]
