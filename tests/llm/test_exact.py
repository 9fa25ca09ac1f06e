"""Operators with one right answer, against brute force, on awkward rows too."""

import collections
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from panelforge.llm import mixing, packing
from panelforge.llm.compression_rules import compression_rules
from panelforge.llm.mixing import MixParams, fill_targets, mixed_documents, plan_mix, split_quotas
from panelforge.llm.near_dup import NearDupParams, near_duplicates
from panelforge.llm.ngram_lm import LmParams, score_documents
from panelforge.llm.repair import Shard, build
from panelforge.llm.token_output import token_output
from panelforge.llm.tokenize import Encoder
from panelforge.llm.topk import TopKParams, top_k

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size long"  # the last two clash with names of results


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "the", "ou", "er", "st", "ing", "é"]) for _ in range(rng.integers(1, 4))) for _ in range(n))


def corpus(spark, seed=0, n=60):
    """Prose of many lengths with copies, near copies, repeated rows, nulls, blanks and odd characters."""
    rng, rows = np.random.default_rng(seed), []
    for i in range(n):
        t = prose(rng, int(rng.integers(1, 200)))
        if i % 7 == 3:
            t = rows[i - 2][1] or ""
        if i % 7 == 5 and rows[i - 3][1]:
            w = rows[i - 3][1].split(" ")
            w[len(w) // 2] = "changed"
            t = " ".join(w)
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
    rows += [(n, None, None, None, None), (n + 1, "", None, "s1", 0), (n + 2, " \t\n ", "en", "", 4), (n + 3, "one", "en", "s1", 3), (n + 4, "a b İß 　 日本 語.\r\n\x0bx", "x", None, 5), (None, "no id at all here", "en", "s0", 1)]
    rows += [rows[1], rows[1], (n + 5, prose(rng, 6000), "en", "s0", 1)]
    return spark.createDataFrame([(*r, 0.5, 7) for r in rows], DOCS), rows


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 6).round(1)]) for i in range(300)]
    rows += [(7, rows[8][1]), (300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [math.nan] * 6), (350, [math.inf] * 6), (None, [1.0] * 6), (400, [0.5, 0.5]), (401, [0.5, 1.0]), (450, []), (451, [])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = [tuple(r) for r in top_k(df, TopKParams(shard_rows=64, leaf_rows=8)).orderBy("query_id", "rank").collect()]
    fit = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q, v in sorted((i, v) for i, v in fit if i % 50 == 0):
        c = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in fit if i != q and len(w) == len(v))[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(c)]
    assert got == want
    assert top_k(df.filter("false")).count() == 0


@pytest.mark.parametrize(("name", "prefix"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_encoder_equals_library(name, prefix):
    import pyarrow as pa

    e = Encoder(public_tokenizers.path(name), prefix, limit=50)
    t = Tokenizer.from_file(public_tokenizers.path(name))

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab ,.\n\t'éİßΣ9<|>　 "), st.characters(codec="utf-8")), max_size=30), max_size=4))
    def check(texts):
        got = [x.tolist() for x in e.encode(pa.array(texts, pa.string()))]
        assert got == [t.encode(x, add_special_tokens=False).ids for x in texts]

    check()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=60), max_size=6))
def test_grammar_round_trip(docs):
    arrays = [np.array(d, np.uint16) for d in docs]
    s = Shard.from_bytes(build(list(range(len(docs))), arrays, min_uses=2, rounds=4, bits=8).to_bytes())
    assert s.decode_all().tolist() == [x for d in docs for x in d]
    for i, d in enumerate(docs):
        assert s.decode(i).tolist() == d and s.decode(i, 2, 7).tolist() == d[2:7]


def test_token_output(spark):
    df, rows = corpus(spark)
    t, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for doc, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0)):  # repeated rows are equal
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = token_output(df, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_output(df.filter("false"), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_language_model(spark):
    df, rows = corpus(spark)
    tokens = [(r[0], WORD.findall(lower(r[1])) + ["\0"]) for r in rows]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    c = collections.Counter(w for d, ws in tokens if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(d), held(d), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for d, ws in tokens)
    scores = []
    for limit in (32, 0):  # the filter broadcast, and probed where it is built
        got = score_documents(df, LmParams(chunk_tokens=500, broadcast_mb=limit)).collect()
        assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
        scores.append(sorted((str(r["doc_id"]), round(r["score"], 9)) for r in got))
    assert scores[0] == scores[1]
    assert score_documents(df.filter("false")).count() == 0


def test_near_duplicates(spark):
    df, rows = corpus(spark, 4, 120)
    sets = {}
    for r in rows:
        w = WORD.findall(lower(r[1]))
        sets.setdefault(r[0], set()).update([tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else [])
    ids = [i for i in sets if i is not None]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a < b and x and y and 100 * len(x & y) >= 75 * len(x | y):
                root[max(find(a), find(b))] = min(find(a), find(b))
    for p in (NearDupParams(), NearDupParams(hubs=1, block=4)):
        got = near_duplicates(df, p).collect()
        assert len(got) == len(rows)
        for r in got:
            if r["doc_id"] is None:
                assert r["component_id"] is None and r["kept"]
            else:
                assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]), find(r["doc_id"]) == r["doc_id"])
    assert len({find(i) for i in ids}) < len(ids) - 20
    assert near_duplicates(df.filter("false")).count() == 0


def test_members_that_fail_against_their_hub_still_meet(spark):
    """A chain: neighbours link, ends don't, so no hub sees all."""
    rng = np.random.default_rng(3)
    words = prose(rng, 400).split(" ")
    texts = [" ".join(f"{w}{i if k // 12 < i and k % 12 == 0 and k // 12 >= i - 1 else ''}{'x' * (k // 12 < i and k % 12 == 0)}" for k, w in enumerate(words)) for i in range(12)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(df, NearDupParams(hubs=1)).collect()}
    sets = [{tuple(t.split(" ")[i : i + 5]) for i in range(396)} for t in texts]
    root = list(range(12))
    for a in range(12):
        for b in range(a + 1, 12):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                lo, hi = sorted((root[a], root[b]))
                root = [lo if r == hi else r for r in root]
    assert got == dict(enumerate(root))


def test_compression_rules(spark):
    df, rows = corpus(spark)
    rng = np.random.default_rng(0)
    more = [(900, "same words again and again. " * 60, None, None, 1), (901, "".join(map(chr, rng.integers(33, 127, 3000))) + " w" * 0 + " ".join([""] + [str(x) for x in rng.integers(0, 10**9, 40)]), None, None, 1), (902, "line one here\nline two\nline one here\n \n \n#a $b", None, None, 1)]
    got = {(r["doc_id"], i): r for i, r in enumerate(compression_rules(df.unionByName(spark.createDataFrame([(*r, 0.5, 7) for r in more], DOCS))).collect())}
    assert len(got) == len(rows) + len(more)
    by_text = {r[0]: r[1] for r in rows + more}
    for (doc, _), r in got.items():
        t = by_text[doc] or ""
        w = WORD.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        c = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        rep = len({j for i in range(len(w) - 7) if c[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)})
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, rep)
        assert r["base_failed"] == (len(w) < 20 or 100 * rep > 30 * len(w)) and not (r["base_failed"] and r["kept"])
    kept = {r["doc_id"]: r["kept"] for r in got.values()}
    assert not kept[900] and not kept[901] and kept[65]


def test_targets_and_tree():
    assert fill_targets([100, 100, 100], [5, 2, 1], 450, 2) == [200.0, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert fill_targets([1, 0, 1000], [5, 2, 1], 1501.5, 2) == [2.0, 0.0, 1499.5]
    parts = split_quotas([10, 0, 7, 100], 8, 1)
    assert parts.sum(axis=0).tolist() == [10, 0, 7, 100] and set(parts.sum(axis=1)) <= {14, 15}
    assert (split_quotas([10, 0, 7, 100], 8, 1) == parts).all() and split_quotas([], 4, 1).shape == (4, 0)


def test_mix(spark):
    df, rows = corpus(spark, 2)
    p = MixParams(block_words=300, shards=4)
    plan = lambda d, p: [{"doc_id": r["row"]["doc_id"], "source": r["row"]["source"], "text": r["row"]["text"], **r["mix"].asDict()} for r in plan_mix(d, p).collect()]
    got = plan(df, p)
    size = lambda t: len(WORD.findall(t or ""))
    by = collections.defaultdict(list)
    for r in rows:
        by[r[3]].append(size(r[1]))
    names = sorted(by, key=lambda s: (s is None, s or ""))
    targets = dict(zip(names, fill_targets([sum(by[s]) for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(map(sum, by.values())), 2), strict=True))
    assert len(got) == len(rows)
    for s in names:
        mine = [r for r in got if r["source"] == s]
        assert all(r["size"] == size(r["text"]) and r["source_size"] == sum(by[s]) and math.isclose(r["target"], targets[s]) for r in mine)
        assert abs(sum(r["taken"] for r in mine) - targets[s]) <= 0.5 and all(r["taken"] <= 2 * r["size"] for r in mine)
    mixed = mixed_documents(df, p)
    assert mixed.columns == df.columns
    assert sum(size(r["text"]) for r in mixed.collect()) == sum(r["taken"] for r in got)
    again = plan(df.repartition(7), MixParams(block_words=300, shards=4, broadcast_blocks=0))
    key = lambda rs: sorted((str(r["doc_id"]), r["taken"]) for r in rs)
    assert key(again) == key(got)
    assert plan_mix(df.filter("false"), p).count() == 0 and mixing.WEIGHTS == (5, 2, 1)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=25))
def test_packing_plan(counts):
    patterns = packing.plan(counts, 40)
    used = collections.Counter()
    for uses, times in patterns:
        assert sum(x * n for x, n in uses.items()) <= 40 and times > 0
        for x, n in uses.items():
            used[x] += n * times
    assert used == collections.Counter(counts)
    table, total = packing.slots(patterns), sum(x * n for x, n in counts.items())
    fill = collections.defaultdict(list)
    for x, n in counts.items():
        seq, off = packing.place(np.full(n, x), np.arange(n), table)
        for s, o in zip(seq, off, strict=True):
            fill[s].append((o, x))
    for parts in fill.values():
        end = 0
        for o, x in sorted(parts):
            assert o == end
            end += x
        assert end <= 40
    big = sum(n for x, n in counts.items() if x > 20)
    assert len(fill) <= max(2 * -(-total // 40), big) + 1


def test_packing(spark):
    df, rows = corpus(spark)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack_documents(df, public_tokenizers.path("byte_bpe_50k.json")).collect()
    want = []
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids + [0]
        first, start, piece = (len(ids) - 1) % 2048 + 1, 0, 0
        while start < len(ids):
            stop = first + 2048 * piece
            want.append((str(r[0]), piece, start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes())))
            start, piece = stop, piece + 1
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    fill = collections.defaultdict(list)
    for r in got:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in fill.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert packing.pack_documents(df.filter("false"), public_tokenizers.path("byte_bpe_50k.json")).count() == 0
