"""Results against plain versions: whole paths, scores, counts, products and links of awkward rows."""

import collections
import itertools
import math
import re

import numpy as np
import pytest

from panelforge.llm import packing, pii
from panelforge.llm.char_tagger import TAGS, Tagger, TaggerParams, classes, spans_of
from panelforge.llm.near_dup import NearDupParams, near_duplicates
from panelforge.llm.ngram_lm import LmParams, quantise, restored, score_documents
from panelforge.llm.topk import BallTree, TopKParams, top_k

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def some_tagger(seed: int, hidden: int = 4) -> Tagger:
    rng, t = np.random.default_rng(seed), Tagger(TaggerParams(width=3, hidden=hidden, decode_window=12, overlap=4))
    t.w["step"] = rng.normal(0, 1, (TAGS, TAGS)).astype(np.float32)
    t.w["start"] = rng.normal(0, 1, TAGS).astype(np.float32)
    t.w["out"] *= 3
    t.w["out_b"][0] += 2
    return t


def window_emissions(t: Tagger, x: np.ndarray) -> np.ndarray:
    """Of each character, from the window where it is farther from the edge."""
    n, half, step = t.p.decode_window, t.p.overlap // 2, t.p.decode_window - t.p.overlap
    out = np.empty((len(x), TAGS))
    for s in range(0, max(1, len(x) - 2 * half), step):
        w = np.zeros(n, np.uint8)
        w[: len(x[s : s + n])] = x[s : s + n]
        e = t.emissions(w[:, None])[:, 0]
        lo = s + half if s else 0
        out[lo : s + n] = e[lo - s : len(out) - s]
    return out


def test_best_path_over_whole_texts():
    rng = np.random.default_rng(0)
    for seed in range(12):
        t = some_tagger(seed)
        texts = ["".join(rng.choice(list("ab1@. ")) for _ in range(n)) for n in (0, 1, 3, 5, 12, 13, 60, 200)]
        got = t.decode([classes(x) for x in texts], rows=3)
        for text, spans in zip(texts, got, strict=True):
            e = window_emissions(t, classes(text)) if text else np.empty((0, TAGS))
            step, start, n = t.w["step"].astype(float), t.w["start"].astype(float), len(text)
            if 0 < n <= 5:  # every path
                best = max(itertools.product(range(TAGS), repeat=n), key=lambda y: start[y[0]] + sum(e[i, y[i]] for i in range(n)) + sum(step[y[i - 1], y[i]] for i in range(1, n)))
                assert spans == spans_of(np.array(best, np.uint8))
            if n:
                score, came = start + e[0], []
                for i in range(1, n):
                    all_ = score[:, None] + step
                    came.append(all_.argmax(axis=0))
                    score = all_.max(axis=0) + e[i]
                path = [int(score.argmax())]
                for c in came[::-1]:
                    path.append(int(c[path[-1]]))
                assert spans == spans_of(np.array(path[::-1], np.uint8))
            else:
                assert spans == []


def test_tagger_reads_far_from_digits():
    """A span of letters alone is tagged if the model says so: nothing of a text is left unread."""
    t = some_tagger(3)
    t.w["out_b"][:] = -5
    t.w["out_b"][3] = 5
    assert t.decode([classes("only letters here and nothing else")]) != [[]]


def test_top_k_of_large_components(spark):
    rows = [(0, [1.0, 1.0]), (1, [200000.0, 1.0]), (2, [150000.0, 1.0]), (3, [131072.0, 5.0])]
    got = [tuple(r) for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    assert [(r[1], r[2]) for r in sorted(got)] == [(1, 1), (2, 2), (3, 3)] and sorted(got)[0][3] == 13_107_265_536
    rng = np.random.default_rng(0)
    ints = [[int(x) for x in rng.integers(-(2**29), 2**29, 3)] for _ in range(120)]  # products need all bits of a long
    big = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(ints)], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in top_k(big, TopKParams(scale=1, leaf_rows=4, shard_rows=32)).collect()}
    for q in (0, 50, 100):
        want = sorted((-sum(a * b for a, b in zip(ints[q], v, strict=True)), i) for i, v in enumerate(ints) if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in want]
    beyond = spark.createDataFrame([(0, [1e15]), (1, [1e15])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="fits no long"):
        top_k(beyond).collect()


def test_every_row_with_a_query_id_is_a_query(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0]), (1, [2.0, 1.0]), (2, [1.0, 3.0])]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    v, want = [[256 * x for x in r[1]] for r in rows], []
    for q in range(3):
        found = sorted((-sum(a * b for a, b in zip(v[q], v[c], strict=True)), rows[c][0]) for c in range(5) if c != q)
        want += [(50, k + 1, i, int(-s)) for k, (s, i) in enumerate(found)]
    assert got == sorted(want)


def test_ball_tree_leaves_out_what_cannot_win():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1000, (64, 16))
    rows = np.floor(centres[rng.integers(0, 64, 4096)] + rng.normal(0, 10, (4096, 16))).astype(np.int64)
    tree = BallTree.from_bytes(BallTree.build(np.arange(4096), np.arange(4096), rows, 32).to_bytes())
    who, best, made = tree.search(np.arange(50) * 50, rows[np.arange(50) * 50], np.full(50, -np.inf), 5)
    for q in range(50):
        s = rows @ rows[q * 50]
        order = [i for i in np.lexsort((np.arange(4096), -s)).tolist() if i != q * 50][:5]
        assert who[q].tolist() == order and best[q].tolist() == s[order].tolist()
    assert made < 0.5 * 50 * 4096


def lm_corpus(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(list("abcdefgh"), int(rng.integers(0, 40))))) for i in range(80)] + [(80, None), (81, ""), (None, "a b"), (3, "a b c")]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


def test_language_model_scores(spark):
    """The score of every text from plain counts; the filter is so large that it has no false positives."""
    import zlib

    df, rows = lm_corpus(spark)
    p = LmParams(chunk_tokens=300, bits=80, probes=20)
    uni, bi, texts = collections.Counter(), collections.Counter(), 0
    tokens = [(d, [*WORD.findall(t or ""), "\0"]) for d, t in rows]
    for d, ws in tokens:
        if d is None or zlib.crc32(str(d).encode()) % 10:
            uni.update(ws)
            bi.update(zip(["\1", *ws], ws, strict=False))
            texts += 1
    n, v = sum(uni.values()), len(uni)
    base = lambda w: (uni[w] + p.smoothing) / (n + p.smoothing * (v + 1))
    level = lambda c: int(restored(quantise(np.array([c])).astype(float))[0]) if c else 0
    count = lambda u: texts if u == "\1" else uni[u]
    chance = lambda u, w: (level(bi[u, w]) + p.weight * base(w)) / (count(u) + p.weight)
    want = sorted((str(d), round(sum(math.log10(chance(u, w)) for u, w in zip(["\1", *ws], ws, strict=False)), 8)) for d, ws in tokens)
    assert sorted((str(r["doc_id"]), round(r["score"], 8)) for r in score_documents(df, p).collect()) == want
    for u in ["\1", *uni]:  # what follows a context, unknown words included, has at most all of the probability
        assert sum(chance(u, w) for w in uni) <= 1


def test_language_model_is_the_same_in_any_session(spark):
    df, _ = lm_corpus(spark)
    p, seen = LmParams(bucket_tokens=200, broadcast_mb=0), []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("2", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            seen.append(sorted((str(r["doc_id"]), round(r["score"], 9), r["base_score"]) for r in score_documents(df.repartition(int(parts) // 2), p).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]


def test_documents_with_several_texts_link_all_of_them(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (2, b), (9, a), (9, b), (4, c), (4, c), (9, ""), (5, c + " more")]
    got = collections.defaultdict(set)
    for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r["doc_id"], r["n_shingles"]].add((r["component_id"], r["kept"]))
    assert got == {(1, 36): {(1, True)}, (2, 36): {(1, False)}, (9, 36): {(1, False)}, (9, 0): {(9, True)}, (4, 36): {(4, True)}, (5, 37): {(4, False)}}


def test_large_components_meet_strays_in_blocks(spark):
    """Buckets with large components, small ones and strays: every link is found with blocks of any size."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(5000)]
    texts = []
    for family in range(4):
        seed = rng.choice(vocabulary, 120).tolist()
        for i in range(40):
            w = list(seed)
            for k in rng.integers(0, 120, int(rng.integers(0, 9))):
                w[k] = f"x{family}_{i}_{k}"
            texts.append(" ".join(w))
    shared = rng.choice(vocabulary, 90).tolist()  # a passage that many unlinked documents have
    texts += [" ".join([*shared, *rng.choice(vocabulary, 45).tolist()]) for _ in range(40)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a + 1, len(texts)):
            if root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                lo, hi = sorted((root[a], root[b]))
                root = [lo if r == hi else r for r in root]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for p in (NearDupParams(hubs=1, block=8), NearDupParams()):
        assert {r["doc_id"]: r["component_id"] for r in near_duplicates(df, p).collect()} == dict(enumerate(root))


def test_exact_fillings():
    stock = np.zeros(101, int)
    for x in (40, 35, 25, 20):
        stock[x] += 1
    assert packing.Complements(stock).filling(40, 60) == [35, 25]
    rng = np.random.default_rng(2)
    for _ in range(300):
        stock = np.zeros(31, int)
        for x in rng.integers(1, 30, int(rng.integers(1, 9))):
            stock[x] += 1
        first = int(rng.choice(np.flatnonzero(stock)))
        pieces = [x for x in np.repeat(np.arange(31), stock - (np.arange(31) == first)).tolist()]
        possible = any(sum(c) == 30 - first for n in (1, 2, 3) for c in itertools.combinations(pieces, n))
        got = packing.Complements(stock).filling(first, 30 - first)
        assert (got is not None) == possible
        if got:
            assert sum(got) == 30 - first and not collections.Counter(got) - collections.Counter(pieces)


def test_redaction_keeps_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, "mail me@here.org now", "mine", 3)], "doc_id long, text string, clean string, n_chars int")
    out = pii.redact_documents(rows).first()
    assert out["clean"] == "mine" and "me@here.org" not in out["text"] and out["n_chars"] == len(out["text"])


def test_mix_of_awkward_tables(spark):
    """Names of working columns, rows without an id, twins, many sources and many blocks."""
    from panelforge.llm.mixing import MixParams, fill_targets, mixed_documents, plan_mix

    rng = np.random.default_rng(4)
    names = ["size", "part", "extra", "draw", "shard", "block", "row", "mix", "hash", "rank", "order", "slice"]
    texts = [" ".join(["w"] * int(n)) for n in rng.integers(0, 60, 300)]
    rows = [(i if i % 3 else None, t, f"s{i % 5}" if i % 11 else None, *names) for i, t in enumerate(texts)] + [(7, "x y z", "s1", *names)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    for p in (MixParams(), MixParams(block_words=50, shards=3), MixParams(block_words=20, most_blocks=16, shard_words=100, most_shards=4)):
        got = plan_mix(df, p).collect()
        by = collections.defaultdict(list)
        for r in got:
            by[r["row"]["source"]].append(r["mix"])
        order = sorted(by, key=lambda s: (s is None, s or ""))
        sizes = [sum(len(r[1].split()) for r in rows if r[2] == s) for s in order]
        for s, size, target in zip(order, sizes, fill_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(order))], 1.5 * sum(sizes), 2), strict=True):
            assert all(m["source_size"] == size and math.isclose(m["target"], target) for m in by[s])
            assert abs(sum(m["taken"] for m in by[s]) - target) <= 0.5 + 5 and all(m["taken"] <= 2 * m["size"] for m in by[s])
        out = mixed_documents(df, p)
        mixed = out.collect()
        assert out.columns == df.columns and all(r["part"] == "part" and r["mix"] == "mix" for r in mixed)
        assert sum(len(r["text"].split()) for r in mixed) == sum(m["taken"] for ms in by.values() for m in ms)
        assert not out.filter("text is null").count()


def test_grammar_takes_the_most_frequent_pair_first():
    from panelforge.llm.repair import build

    docs = [np.array([1, 2], np.uint16)] * 1000 + [np.array([25661, 40006], np.uint16)]
    s = build(list(range(1001)), docs)
    assert len(s.symbols) == 1002 and (s.left.tolist(), s.right.tolist()) == ([1], [2])
    docs = [np.array([7, 8, 9], np.uint16)] * 20 + [np.array([8, 9], np.uint16)] * 30  # (8, 9) has 50 uses, (7, 8) 20
    s = build(list(range(50)), docs)
    assert (int(s.left[0]), int(s.right[0])) == (8, 9) and s.decode_all().tolist() == np.concatenate(docs).tolist()
    with pytest.raises(ValueError, match="not below"):
        build([0], [np.array([70_000], np.uint32)])
    wide = build([0], [np.array([70_000] * 64, np.uint32)], base=1 << 17)
    assert len(wide.symbols) <= 8 and wide.decode(0).tolist() == [70_000] * 64 and wide.decode(0, 5, 9).tolist() == [70_000] * 4


def test_quality_scores(spark):
    """Every score from a plain loop over the words and n-grams of the text, by the fitted vectors."""
    from panelforge.llm.quality_model import QualityParams, fit, score_quality, word_slots

    rng, p = np.random.default_rng(6), QualityParams(bits=10, width=4, steps=2000)
    text = lambda: " ".join(rng.choice(["good", "word", "is", "é", "bad", "bad", "xx"], int(rng.integers(0, 30))))
    texts = [text() for _ in range(60)] + ["", None, " \t\n", "one", "a  b\n\nb b"]
    model = fit([(t or "", int(i % 3 == 0)) for i, t in enumerate(texts)], p)
    got = {r["doc_id"]: r["score"] for r in score_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        words = WORD.findall(t or "")
        slots = [s for w in words for s in word_slots(w, p)] + [1 << p.bits for a, b in zip(words, words[1:], strict=False) if a == b]
        mean = model.vectors[slots].astype(float).mean(axis=0) if slots else np.zeros(p.width)
        z = mean @ model.out.astype(float) + model.bias
        assert math.isclose(got[i], np.exp(z[1]) / np.exp(z).sum(), rel_tol=1e-4, abs_tol=1e-6)
    assert len(set(word_slots("word", p))) > 5 and word_slots("", p) == []


def test_toxicity_scores(spark):
    """Scores and spans from a forward-backward pass over each chain in plain Python, low-scoring chains too."""
    import zlib

    from panelforge.llm.toxicity import Chain, ToxicModel, ToxicParams, features, score_toxicity

    rng, p, chain = np.random.default_rng(8), ToxicParams(bits=8, window=7), Chain(8)
    chain.weights = rng.normal(0, 2, 256).astype(np.float32)
    chain.bias, chain.step = -1.0, np.array([[0.5, -1.0], [-1.0, 3.0]])
    model = ToxicModel(chain, 1.3, -0.4)
    texts = [" ".join(rng.choice(["Foo,", "bar", "bazzy", "quxes!", "", "é\n"], int(rng.integers(0, 30)))) for _ in range(50)] + ["", None, "\t"]
    got = {r["doc_id"]: r["_toxicity"] for r in score_toxicity(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, p).collect()}
    for i, t in enumerate(texts):
        words, marginal = re.split("[\t-\r ]", t or ""), []
        s = [sum(float(chain.weights[zlib.crc32(f.encode()) & 255]) for f in features(w)) + chain.bias for w in words]
        for c in range(0, len(s), 7):
            x = s[c : c + 7]
            ahead, back = [(1.0, math.exp(x[0]))], [(1.0, 1.0)]
            step = np.exp(chain.step)
            for v in x[1:]:
                a = ahead[-1]
                ahead.append((a[0] * step[0, 0] + a[1] * step[1, 0], math.exp(v) * (a[0] * step[0, 1] + a[1] * step[1, 1])))
            for v in x[:0:-1]:
                b = back[0]
                back.insert(0, (step[0, 0] * b[0] + step[0, 1] * math.exp(v) * b[1], step[1, 0] * b[0] + step[1, 1] * math.exp(v) * b[1]))
            marginal += [a[1] * b[1] / (a[0] * b[0] + a[1] * b[1]) for a, b in zip(ahead, back, strict=True)]
        want = 1 / (1 + math.exp(-(1.3 * math.log(sum(m**4 for m in marginal) + 1e-2) - 0.4)))
        assert math.isclose(got[i]["score"], want, rel_tol=1e-6) and got[i]["predicted"] == (want >= 0.5)
        assert len(got[i]["spans"]) == sum(m >= 0.5 for m in marginal)


def test_compression_verdicts(spark):
    """The verdict from the bands of whole texts and of chunks that reach the end, one by one."""
    import zstandard

    from panelforge.llm.compression_rules import BandParams, compression_rules

    rng, p = np.random.default_rng(9), BandParams()
    words = [f"{a}{b}" for a in ("ta", "ko", "mi", "ru", "ne", "so") for b in ("lin", "gar", "pe", "dust", "om", "ay")]
    prose = lambda n: " ".join(rng.choice(words, n))
    noise = lambda n: " ".join(str(x) for x in rng.integers(10**15, 10**18, n))
    texts = [prose(30), prose(900), noise(30), noise(300), "same text here now. " * 200, prose(700) + noise(250), prose(800) + " a b" * 500, "", None, "x", *[prose(int(n)) for n in rng.integers(20, 2000, 20)]]
    ratio = lambda b: len(zstandard.ZstdCompressor(level=p.level).compress(b)) / len(b)
    for r in compression_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        fine = True
        for (low, lo, hi), high in zip(p.bands, [*[b[0] for b in p.bands[1:]], 1 << 60], strict=True):
            if low <= len(raw) < high:
                fine = lo <= ratio(raw) <= hi
        pieces = []
        while len(raw) >= 2048 and sum(map(len, pieces)) < len(raw):
            at = sum(map(len, pieces))
            pieces.append(raw[at : at + 2048] if at + 2048 <= len(raw) else raw[-2048:])
        bad = [not p.chunk_band[0] <= ratio(c) <= p.chunk_band[1] for c in pieces]
        assert r["kept"] == (not r["base_failed"] and fine and sum(bad) <= 0.25 * len(bad))
