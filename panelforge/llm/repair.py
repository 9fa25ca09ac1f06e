"""Re-Pair grammar compression of token ids, in self-contained binary shards.

A shard holds the ids of consecutive documents. The most frequent neighbouring pairs inside
documents are replaced by new symbols (rules), round after round; rules, the length that each expands
to, and where each document starts let any document, or any range of one, be decoded alone.

Layout, little-endian: magic, then the counts of documents, rules and symbols and the first
nonterminal (4 x u32); document ids i64 and a null mask u8; tokens of each document u32;
first symbol of each document u32; rules' left, right and expansion length (3 x u32); the
symbols' low 16 bits u16, then their high 8 bits u8.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import cached_property

import numpy as np

from panelforge.llm.common import mix64
from panelforge.llm.tokenize import gather

MAGIC = b"RPG1"


@dataclass
class Shard:
    doc_ids: list
    tokens: np.ndarray  #: ids of each document
    starts: np.ndarray  #: first symbol of each document, and the end
    base: int  #: symbols from here on are rules
    left: np.ndarray
    right: np.ndarray
    lengths: np.ndarray  #: ids that each rule expands to
    symbols: np.ndarray

    def to_bytes(self) -> bytes:
        ids = np.array([0 if i is None else i for i in self.doc_ids], dtype="<i8")
        null = np.array([i is None for i in self.doc_ids], dtype="u1")
        head = MAGIC + struct.pack("<4I", len(ids), len(self.left), len(self.symbols), self.base)
        wide = [self.tokens, self.starts[:-1], self.left, self.right, self.lengths]
        return b"".join([head, ids.tobytes(), null.tobytes(), *[np.asarray(a, dtype="<u4").tobytes() for a in wide], (self.symbols & 0xFFFF).astype("<u2").tobytes(), (self.symbols >> 16).astype("u1").tobytes()])

    @classmethod
    def from_bytes(cls, blob: bytes) -> Shard:
        if blob[:4] != MAGIC:
            raise ValueError("not a grammar shard")
        n, r, m, base = struct.unpack_from("<4I", blob, 4)
        at = 20

        def take(dtype: str, count: int) -> np.ndarray:
            nonlocal at
            a = np.frombuffer(blob, dtype=dtype, count=count, offset=at)
            at += a.nbytes
            return a

        ids, null = take("<i8", n), take("u1", n)
        tokens, starts, left, right, lengths = (take("<u4", k) for k in (n, n, r, r, r))
        symbols = take("<u2", m).astype(np.uint32) | (take("u1", m).astype(np.uint32) << 16)
        return cls([None if z else int(i) for i, z in zip(ids, null, strict=True)], tokens, np.append(starts, m).astype(np.int64), base, left, right, lengths, symbols)

    @cached_property
    def expansions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each symbol its length and its place in the third array, which holds all expansions."""
        lengths = np.concatenate([np.ones(self.base, np.int64), self.lengths.astype(np.int64)])
        places = np.concatenate([np.arange(self.base), self.base + np.cumsum(self.lengths.astype(np.int64)) - self.lengths])
        flat = np.empty(self.base + int(self.lengths.sum()), np.uint32)
        flat[: self.base] = np.arange(self.base)
        done = self.base
        while done < len(lengths):  # all rules whose parts are known, at once
            ends = np.maximum(self.left[done - self.base :], self.right[done - self.base :]) >= done
            stop = done + (int(np.argmax(ends)) if ends.any() else len(ends))
            rules = slice(done - self.base, stop - self.base)
            pairs = np.stack([self.left[rules], self.right[rules]], axis=1).ravel()
            text = gather(pairs, lengths, places, flat)
            flat[places[done] : places[done] + len(text)] = text
            done = stop
        return lengths, places, flat

    def decode_all(self) -> np.ndarray:
        return gather(self.symbols, *self.expansions)

    def decode(self, doc: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop of one document: only symbols that reach into the range are expanded."""
        symbols = self.symbols[self.starts[doc] : self.starts[doc + 1]]
        lengths, places, flat = self.expansions
        stop = int(self.tokens[doc]) if stop is None else min(stop, int(self.tokens[doc]))
        if start == 0 and stop == int(self.tokens[doc]):
            return gather(symbols, lengths, places, flat)
        ends = np.cumsum(lengths[symbols])
        first, last = np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop)
        skipped = int(ends[first - 1]) if first else 0
        return gather(symbols[first : last + 1], lengths, places, flat)[start - skipped : max(stop, start) - skipped]


def build(doc_ids: list, docs: list[np.ndarray], base: int = 1 << 16, rounds: int | None = None, min_uses: int = 8, bits: int = 18, within: int = 8) -> Shard:
    """Rounds that each replace the most frequent pairs until no pair has min_uses uses.

    Pairs are counted exactly. A round takes the pairs with at least a within-th of the
    highest count, and of overlapping places the more frequent pair's (the first, third, ... of
    a run of one pair; of equal counts that of the smaller digest, so that a passage of ascending
    ids takes few rounds too); a pair that keeps too few places so waits for a later round, while the
    most frequent one always goes through. All places of a pair come about in one round, that of
    the younger of its symbols, and only go from then on. So each place is sorted once, when its
    pair comes about, counts are kept as places go, and a round reads the places of its own pairs
    only. Of many new places, slots of a table of 2**bits count first: what shares a slot with too
    few others isn't sorted.
    rounds, if given, is a bound. Ids must be below base, symbols below 2**24.
    """

    def slots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = a * np.uint32(2654435761)
        x += b * np.uint32(2246822519)
        x ^= x >> np.uint32(15)
        x &= np.uint32((1 << bits) - 1)
        return x.astype(np.intp)

    def ascending(at: np.ndarray) -> np.ndarray:
        """These places in order, each once: neighbours are looked up far faster so."""
        if len(at) << 4 > n:
            marked[at] = True
            out = np.flatnonzero(marked)
            marked[out] = False
            return out
        at = np.sort(at).astype(np.intp)
        return at.compress(np.append(True, at[1:] != at[:-1])[: len(at)])

    def enter(at: np.ndarray) -> None:
        """Numbers the pairs at these places, all new, that have enough uses."""
        nonlocal keys, uses, begins, spans, held
        a, b = seq.take(at), seq.take(after.take(at))
        if held and len(at) << 4 > 1 << bits:  # most pairs of ids have enough uses, few of new symbols do
            slot = slots(a, b)
            some = np.flatnonzero(np.bincount(slot, minlength=1 << bits).take(slot) >= min_uses)
            at, a, b = at.take(some), a.take(some), b.take(some)
        half, low = top.bit_length(), n.bit_length()
        key = a.astype(np.uint64) << np.uint64(half)
        key |= b
        if 2 * half + low > 64:
            order = np.lexsort((at, key))
            key, at = key.take(order), at.take(order)
        else:  # sorted with their places below them
            key <<= np.uint64(low)
            key |= at.astype(np.uint64)
            key.sort()
            at = (key & np.uint64((1 << low) - 1)).astype(np.intp)
            key >>= np.uint64(low)
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        count = np.diff(np.append(first, len(key)))
        enough = count >= min_uses
        at, key, count = at.compress(np.repeat(enough, count)), key.take(first.compress(enough)), count.compress(enough)
        pair[at] = np.repeat(np.arange(len(uses), len(uses) + len(key), dtype=np.int32), count)
        flat[held : held + len(at)] = at
        keys = np.append(keys, ((key >> np.uint64(half)) << np.uint64(32)) | (key & np.uint64((1 << half) - 1)))
        uses, spans, begins = np.append(uses, count), np.append(spans, count), np.append(begins, held + np.cumsum(count) - count)
        held += len(at)

    tokens = np.array([len(d) for d in docs], dtype=np.int64)
    none = np.int32(2**31 - 1)
    seq = np.concatenate([*docs, np.array([none], np.uint32)]).astype(np.uint32, copy=False)
    n = len(seq) - 1
    if n and int(seq[:-1].max()) >= base:
        raise ValueError(f"id {int(seq[:-1].max())} is not below {base}")
    ends = np.append(0, np.cumsum(tokens))
    last = np.zeros(n, bool)
    last[ends[1:][tokens > 0] - 1] = True
    # replaced pairs keep their first place; n, which has no pair, stands beyond both ends of a document
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    after[:-1][last] = n
    before[:1], before[1:][last] = n, n
    gone, marked = np.zeros(n, bool), np.zeros(n, bool)
    left, right, lengths = [], [], []
    size, top, r, least = np.ones(base, np.int64), base, 0, max(2, min_uses // 2)
    pair = np.full(n + 1, -1, np.int32)  #: number of the pair at a place, if that has enough uses
    keys, uses, begins, spans = np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3))  #: of each number the pair, its places now, and where
    flat, held = np.empty(3 * n, np.int32), 0  #: those it came about at are; each use of a rule makes two at most
    enter(np.flatnonzero(~last))
    while rounds is None or r < rounds:
        r += 1
        most = int(uses.max(initial=0))
        if most < min_uses:
            break
        hot = np.flatnonzero(uses >= max(min_uses, -(-most // within)))
        hot = hot[np.lexsort((mix64(keys[hot]), -uses[hot]))]
        rank = np.full(len(uses) + 1, none, np.int32)  # the last is that of no pair
        rank[hot] = np.arange(len(hot), dtype=np.int32)
        here = ascending(gather(hot, spans, begins, flat))
        mine = rank.take(pair.take(here))  # places whose pair went have another rank or none
        wins = mine != none
        wins &= mine <= rank.take(pair.take(before.take(here)))
        wins &= mine <= rank.take(pair.take(after.take(here)))
        wins, mine = here.compress(wins), mine.compress(wins)
        # neighbours both win only in a run of one pair
        run = after.take(wins[:-1]) == wins[1:]
        if run.any():
            start = np.maximum.accumulate(np.where(np.append(True, ~run), np.arange(len(wins)), 0))
            odd = (np.arange(len(wins)) - start) % 2 == 0
            wins, mine = wins.compress(odd), mine.compress(odd)
        used = np.bincount(mine, minlength=len(hot)) >= least
        if not used.any():  # runs of the most frequent pair are too short to use it often
            pair[here.compress(pair.take(here) == hot[0])] = -1
            uses[hot[0]] = 0
            continue
        if not used.all():
            some = used.take(mine)
            wins, mine = wins.compress(some), mine.compress(some)
        pairs, name = keys[hot[used]], (np.cumsum(used) - 1 + top).astype(np.uint32)
        lo, hi = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        left.append(lo)
        right.append(hi)
        lengths.append(size[lo] + size[hi])
        size = np.concatenate([size, lengths[-1]])
        seq[wins] = name.take(mine)
        second = after.take(wins).astype(np.intp)
        beyond = after.take(second).astype(np.intp)
        gone[second] = True
        after[wins], before[beyond] = beyond, wins
        # the pairs that the new symbols begin or end; a symbol may end one and begin another
        ahead = before.take(wins)
        ahead = ahead.compress(seq.take(ahead) < top).astype(np.intp)  # neither a new symbol nor n
        for old in (wins, second, ahead):
            uses -= np.bincount(pair.take(old) + 1, minlength=len(uses) + 1)[1:]
            pair[old] = -1
        top += len(pairs)
        if top > 1 << 24:
            raise ValueError("more symbols than 24 bits name")
        enter(np.concatenate([wins.compress(beyond < n), ahead]))
    kept = np.flatnonzero(~gone)
    join = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
    return Shard(doc_ids, tokens, np.searchsorted(kept, ends), base, join(left), join(right), join(lengths), seq.take(kept))
