"""Token ids of whole texts by a public tokenizer file, each distinct word encoded once."""

from __future__ import annotations

import os
import re
from array import array
from codecs import charmap_decode
from functools import lru_cache
from operator import attrgetter
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from panelforge.llm.common import WordMemo

#: White space beside single blanks and line feeds between other characters, and the mark that pieces are cut at.
_ODD_SPACE = "[\t\x0b\x0c\r\x1c-\x1f\x00\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]|[ \n][ \n]|\\A[ \n]|[ \n]\\z"

#: Letters below U+0250 of which each has one small form.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"

_PLAIN = frozenset([*range(33, 127), *range(161, 173), *range(174, 256)])

#: How byte-level vocabularies write each byte: those that aren't printable from 256 onwards, in order.
_SHOWN = "".join(chr(b if b in _PLAIN else 256 + sum(x not in _PLAIN for x in range(b))) for b in range(256))


class Encoder:
    """Ids equal to Tokenizer.encode(text, add_special_tokens=False).ids for every text.

    A vocabulary with space_prefix splits a text before a single blank, and around a single
    line feed, between characters that aren't white space; one without drops white space. So
    pieces cut there have the ids that they have in the text. Other white space stays inside
    a piece.
    """

    def __init__(self, path: str, space_prefix: bool, limit: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.prefix = " " if space_prefix else ""
        self.size = max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0) + 1  # ids may have gaps
        self.dtype = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.letters = re.compile(f"{self.prefix}[{_LETTERS}]+").fullmatch
        self.code = "H" if self.dtype is np.uint16 else "I"
        self.memo = WordMemo(self._encode, limit)

    def _raw(self, pieces: list[str]) -> list[bytes]:
        out = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.array(x.ids, dtype=self.dtype).tobytes() for x in out]

    def _words(self, words: list[str]) -> list[bytes]:
        """Letters below U+0250 are one word to either pre-tokenizer; the model gets their bytes."""
        if not words:
            return []
        shown = charmap_decode("\n".join(words).encode(), "strict", _SHOWN)[0].split(_SHOWN[10])
        tokenize, number = self.tokenizer.model.tokenize, attrgetter("id")
        return [array(self.code, map(number, tokenize(w))).tobytes() for w in shown]

    def _encode(self, stems: list[str]) -> list[bytes]:
        """Either pre-tokenizer cuts a run of marks from the letters before it, so these have their own ids."""
        plain = [w for w in stems if self.letters(w)]
        ids = dict(zip(plain, self._words(plain), strict=True))
        others = [w for w in stems if w not in ids]
        heads = [w.rstrip(punctuation) for w in others]
        heads = [h if self.letters(h) else "" for h in heads]
        tails = [w[len(h) :] for w, h in zip(others, heads, strict=True)]
        heads = heads if self.prefix else [h.lower() for h in heads]
        words, rest = list(set(heads) - {""}), list(set(tails) - {""})
        before = dict(zip(words, self._words(words), strict=True)) | {"": b""}
        after = dict(zip(rest, self._raw(rest), strict=True)) | {"": b""}
        ids.update((w, before[h] + after[t]) for w, h, t in zip(others, heads, tails, strict=True))
        return [ids[w] for w in stems]

    def _tables(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Length of the ids of each of these words, and all of their ids."""
        ids = self.memo.values(words)
        return np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype().itemsize, np.frombuffer(b"".join(ids), self.dtype)

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As _tables, with a word of letters and the comma or stop after it looked up apart."""
        stem = pc.utf8_slice_codeunits(words, 0, -1)
        comma, stop = pc.ends_with(words, ","), pc.ends_with(words, ".")
        cut = pc.and_(pc.or_(comma, stop), pc.match_substring_regex(stem, f"\\A{self.prefix}[{_LETTERS}]+\\z"))
        stems = pc.if_else(cut, stem, words)
        if not self.prefix:  # this vocabulary has small letters only
            stems = pc.if_else(pc.match_substring_regex(stems, f"\\A[{_LETTERS}]+\\z"), pc.utf8_lower(stems), stems)
        coded = stems.dictionary_encode()
        known = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        lengths, flat = self._tables([*known, "", ",", "."])
        cut = cut.to_numpy(zero_copy_only=False)
        tail = len(known) + np.where(cut, np.where(comma.to_numpy(zero_copy_only=False), 1, 2), 0)
        parts = np.stack([coded.indices.to_numpy(), tail], axis=1).ravel()
        return lengths[parts].reshape(-1, 2).sum(axis=1), gather(parts, lengths, np.cumsum(lengths) - lengths, flat)

    def pieces(self, text: str) -> list[str]:
        """Pieces of a text with other white space, cut at single blanks only."""
        parts = text.split(" ")
        out, held = [], parts[0]
        for p in parts[1:]:
            if held and p and not held[-1].isspace() and not p[0].isspace():
                out.append(held)
                held = self.prefix + p
            else:
                held += " " + p
        out.append(held)
        return out

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text, null as empty."""
        texts = texts.fill_null("")
        if not self.prefix:
            split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        else:
            odd = pc.match_substring_regex(texts, _ODD_SPACE)
            plain = pc.replace_substring(pc.replace_substring(pc.if_else(odd, "", texts), " ", "\0 "), "\n", "\0\n\0")
            split = pc.split_pattern(plain, "\0")
        coded = split.flatten().dictionary_encode()
        lengths, flat = self._distinct(coded.dictionary)
        index = coded.indices.to_numpy()
        all_ids = gather(index, lengths, np.cumsum(lengths) - lengths, flat)
        ends = np.concatenate([[0], np.cumsum(lengths[index])])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        out = [all_ids[s:e] for s, e in zip(ends[:-1], ends[1:], strict=True)]
        if self.prefix:
            for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
                out[i] = self._tables(self.pieces(texts[int(i)].as_py()))[1]
        return out


def gather(symbols: np.ndarray, lengths: np.ndarray, places: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The stretches of flat that these symbols stand for, one after the other."""
    n = lengths.take(symbols)
    before = np.cumsum(n) - n
    at = np.repeat((places.take(symbols) - before).astype(np.int32), n)
    at += np.arange(len(at), dtype=np.int32)
    return flat.take(at)


@lru_cache(maxsize=1)
def encoder(path: str, space_prefix: bool, limit: int) -> Encoder:
    """One for each worker process, so that its words stay known from task to task."""
    return Encoder(path, space_prefix, limit)
