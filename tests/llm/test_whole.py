"""Operators do their whole job: no bound on rounds, kinds or rows that the method doesn't have."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from panelforge.llm import pii
from panelforge.llm.repair import Shard, build


def most_uses(s: Shard) -> int:
    """Of the pairs inside documents, places of the most frequent one."""
    ends = np.zeros(len(s.symbols), bool)
    ends[s.starts[1:][s.starts[1:] > 0] - 1] = True
    keys = (s.symbols[:-1].astype(np.uint64) << np.uint64(32)) | s.symbols[1:]
    return int(max(np.unique(keys[~ends[:-1]], return_counts=True)[1], default=0))


def test_grammar_replaces_until_no_pair_is_frequent():
    rng = np.random.default_rng(5)
    passage = rng.integers(0, 50_000, 300).astype(np.uint16)
    docs = [passage] * 400
    s = Shard.from_bytes(build(list(range(400)), docs).to_bytes())
    assert len(s.symbols) == 400 and int(s.lengths.max()) == 300
    assert s.decode_all().tolist() == np.concatenate(docs).tolist()
    mixed = [(rng.zipf(1.3, 400) % 3000).astype(np.uint16) for _ in range(200)]
    for bits in (18, 8):  # slots that are taken only delay
        s = Shard.from_bytes(build(list(range(200)), mixed, bits=bits).to_bytes())
        assert most_uses(s) < 8 and s.decode_all().tolist() == np.concatenate(mixed).tolist()


def test_grammar_takes_few_rounds_on_ascending_ids():
    """Pairs of equal counts in ascending order went one a round, and each round read all places."""
    docs = [np.arange(3000, dtype=np.uint16)] * 8
    s = Shard.from_bytes(build(list(range(8)), docs, rounds=64).to_bytes())
    assert len(s.symbols) == 8 and int(s.lengths.max()) == 3000 and most_uses(s) < 8
    assert s.decode_all().tolist() == np.concatenate(docs).tolist() and s.decode(5, 7, 11).tolist() == [7, 8, 9, 10]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=80), max_size=6))
def test_grammar_ends_on_any_ids(docs):
    arrays = [np.array(d, np.uint16) for d in docs]
    for uses in (2, 4):
        s = Shard.from_bytes(build(list(range(len(docs))), arrays, min_uses=uses, bits=6).to_bytes())
        assert s.decode_all().tolist() == [x for d in docs for x in d]
        for i, d in enumerate(docs):
            assert s.decode(i).tolist() == d and s.decode(i, 2, 7).tolist() == d[2:7]


def trained_on_invented() -> pii.Tagger:
    rng = np.random.default_rng(1)
    words = lambda n: " ".join("".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(2, 9)))) for _ in range(n))
    return pii.fit([f"{words(20)} {pii.invented(pii.KINDS[i % 4], rng)} {words(20)}" for i in range(200)])


def test_tagger_adds_addresses_in_other_forms():
    assert pii.holds("ip", "192[.]168[.]0[.]1") and pii.holds("ip", "10 . 0 . 0 . 7") and pii.holds("ip", "10-0-0-7")
    assert not pii.holds("ip", "192[.]168[.]0[.]256") and not pii.holds("ip", "1 . 2 . 3") and not pii.holds("ip", "1-2 . 3-4")
    texts = ["the old server at 192[.]168[.]0[.]1 went down again", "ask the host on 172 . 16 . 254 . 3 for more of them"]
    found = pii.find_all(texts, trained_on_invented())
    assert [a for _, a in found] == [[("ip", 18, 35)], [("ip", 16, 34)]] and not any(b for b, _ in found)
