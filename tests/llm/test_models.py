"""Trained operators: held-out accuracy, offsets, gradients, and rows that could trip them."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.llm import pii
from panelforge.llm.char_tagger import TAGS, Tagger, TaggerParams, spans_of
from panelforge.llm.quality_model import QualityParams, quality
from panelforge.llm.toxicity import Chain, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, spans string"


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "the", "ou", "er", "st", "ing", "on", "re"]) for _ in range(rng.integers(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rng, docs, labels = np.random.default_rng(2), [], []
    for i in range(800):
        w = prose(rng, int(rng.integers(30, 120))).split(" ")
        toxic, good = int(i % 5 == 0), int(i % 4 != 1)
        if toxic:
            for k in rng.integers(0, len(w), 4):
                w[k] = rng.choice(["zutidiot", "zutmoron", "blarghead", "Blargface"])
        if not good:
            w = [x + rng.choice(["$$$", "%%%", "***"]) for x in w]
        docs.append((i, " ".join(w), "en", "s", 1, 0.0, ""))
        labels.append((i, good, toxic))
    docs += [(900, None, None, None, None, None, None), (901, "", None, None, 0, 0.0, ""), (902, " \n\n ", None, None, 0, 0.0, ""), (None, "the an ou", None, None, 0, 0.0, ""), docs[0], (903, "zutidiot " + "the an " * 30_000, None, None, 0, 0.0, "")]
    labels += [(900, 1, 0), (901, None, None), (0, 1, 1), (None, 1, 1)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(labelled):
    docs, labels = labelled
    rows = toxicity(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 800]
    assert held and np.mean([(r["predicted"] == 1) == (r["doc_id"] % 5 == 0) for r in held]) > 0.98
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in held:
        for s in r["spans"]:
            assert re.fullmatch("(?i)(zut|blarg).*", texts[r["doc_id"]][s["start"] : s["end"]])
        assert bool(r["spans"]) == (r["doc_id"] % 5 == 0)
    assert [r["predicted"] for r in rows if r["doc_id"] in (900, 901, 902)] == [0, 0, 0]
    assert toxicity(docs.filter("false"), labels).count() == 0
    assert {r["predicted"] for r in toxicity(docs.limit(5), labels.filter("false")).collect()} == {0}


def test_chain_marginals_against_enumeration():
    c = Chain(4)
    c.step = np.array([[0.3, -0.7], [-0.2, 0.9]])
    s = np.array([[0.5, -1.0, 2.0, 0.1], [1.0, 0.2, 0.0, 0.0]])
    live = np.array([[True] * 4, [True, True, False, False]])
    p, steps = c.marginals(s, live)
    for row, n in ((0, 4), (1, 2)):
        total, on = 0.0, np.zeros(n)
        for code in range(2**n):
            y = [(code >> k) & 1 for k in range(n)]
            w = np.exp(sum(s[row, k] * y[k] for k in range(n)) + sum(c.step[y[k - 1], y[k]] for k in range(1, n)))
            total += w
            on += w * np.array(y)
        assert np.allclose(p[row, :n], on / total)
    assert np.isclose(steps.sum(), 4)


def test_quality(labelled):
    docs, labels = labelled
    rows = quality(docs, labels, QualityParams(steps=6000)).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 800]
    assert held and np.mean([(r["predicted"] == 1) == (r["doc_id"] % 4 != 1) for r in held]) > 0.98
    assert quality(docs.filter("false"), labels).count() == 0


def test_base_patterns_against_regular_expressions():
    import random

    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def brute(t):
        out = []
        for k, pattern in kinds.items():
            for m in re.finditer(pattern, t):
                d = re.sub("[^0-9]", "", m[0])
                if {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and pii.luhn(d), "phone": 10 <= len(d) <= 15}[k]:
                    out.append((k, m.start(), m.end()))
        return sorted(out, key=lambda s: (s[1], list(kinds).index(s[0])))

    rng = random.Random(5)
    for _ in range(20_000):
        t = "".join(rng.choice("0123456789..--  @@++ab()%\n255") for _ in range(rng.randint(0, 40)))
        assert pii.pattern_spans(t) == brute(t)
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")
    for long in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+1" * 100_000, "a@" * 100_000, "1 " * 100_000):
        pii.pattern_spans(long)  # in time that grows with the length alone


def test_tagger_gradients():
    t = Tagger(TaggerParams(width=3, hidden=4))
    for k in t.w:
        t.w[k] = t.w[k].astype(np.float64)
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 40, (6, 3)), rng.integers(0, TAGS, (6, 3))
    _, g = t.gradients(x, y)
    for k, i in (("embed", 37), ("xf", 5), ("ub", 9), ("cf", 3), ("out", 11), ("step", 7), ("start", 2)):
        flat = t.w[k].reshape(-1)
        i = int(np.argmax(np.abs(g[k]))) if k == "embed" else i
        old, h = flat[i], 1e-4
        losses = []
        for d in (h, -h):
            flat[i] = old + d
            losses.append(t.gradients(x, y)[0])
        flat[i] = old
        assert np.isclose((losses[0] - losses[1]) / (2 * h), g[k].reshape(-1)[i], rtol=2e-2, atol=2e-4)


def test_spans_of_tags():
    assert spans_of(np.array([0, 1, 2, 2, 1, 2, 0, 3, 4, 8], np.uint8)) == [(0, 1, 4), (0, 4, 6), (1, 7, 9), (3, 9, 10)]
    assert spans_of(np.zeros(0, np.uint8)) == []


def test_personal_data(spark):
    rng = np.random.default_rng(1)
    rows = [(i, f"{prose(rng, 20)} {pii.invented(pii.KINDS[i % 4], rng)} {prose(rng, 20)}", "en", "s", 1, 0.0, "") for i in range(200)]
    rows += [(300, None, None, None, None, None, None), (301, "", None, None, 0, 0.0, ""), (302, prose(rng, 50), None, None, 0, 0.0, ""), (303, f"call (743) 555-3824 {prose(rng, 9)}", None, None, 0, 0.0, ""), (None, "a@b.cd", None, None, 0, 0.0, ""), rows[0], (304, "12 " * 40_000 + "x@y.zz", None, None, 0, 0.0, "")]
    docs = spark.createDataFrame(rows, DOCS)
    got = pii.find_personal_data(docs).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[1] or "" for r in rows}
    for r in got:
        base = pii.pattern_spans(texts[r["doc_id"]])
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(s[0] == k for s in base) for k in pii.KINDS)
        assert set(pii.joined(base).split(",")) <= set(r["spans"].split(",")) | {""}
        if r["doc_id"] in (301, 302):
            assert r["spans"] == ""
    by = {r["doc_id"]: r for r in got}
    assert by[303]["spans"] == "phone:5:19"
    clean = pii.redact_documents(docs)
    assert clean.columns == docs.columns
    out = {r["doc_id"]: r for r in clean.collect()}
    assert out[300]["text"] is None and out[303]["text"].startswith("call [PHONE] ") and out[303]["n_chars"] == len(out[303]["text"])
    assert pii.find_personal_data(docs.filter("false")).count() == 0
    left = clean.filter(F.col("doc_id") < 200).collect()
    assert not any(pii.pattern_spans(r["text"]) for r in left)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    rng, docs, labels = np.random.default_rng(7), [], []
    for i in range(300):
        w = prose(rng, int(rng.integers(30, 90))).split(" ")
        if i % 6 == 0:
            for k in rng.integers(0, len(w), 4):
                w[k] = "zutidiot"
        docs.append((i, " ".join(w) + (" mail me@here.org now" if i % 6 == 1 else ""), "en", f"s{i % 4}", 5))
        labels.append((i, 1, int(i % 6 == 0)))
    docs += [(1000 + i, docs[6 * i + 2][1], "en", "s0", 5) for i in range(20)] + [docs[3]]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "near duplicates", "personal data", "mixing", "packing"]
    table, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for i, (_, stage) in enumerate(P.STAGES):
        stage(spark, table, str(tmp_path)).write.parquet(f"{tmp_path}/out{i}")
        table = spark.read.parquet(f"{tmp_path}/out{i}")
        seen.append(table.collect())
        if i < 4:
            assert table.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    marked = table.sparkSession.createDataFrame([(1, "the an ou", 5.0, "mine")], "doc_id long, text string, score double, spans string")
    assert P.drop_toxic(spark, marked, str(tmp_path)).first()["spans"] == "mine"
    assert {r["doc_id"] for r in seen[0]} == {d[0] for d in docs if d[0] % 6 or d[0] >= 300}
    ids = [r["doc_id"] for r in seen[1]]
    assert len(ids) == len(set(ids)) and set(ids) == {d[0] for d in docs if d[0] < 300 and d[0] % 6}
    assert len(seen[2]) == len(ids) and not any("@" in r["text"] for r in seen[2])
    words = sum(len(r["text"].split()) for r in seen[2])
    assert abs(sum(len(r["text"].split()) for r in seen[3]) - 1.5 * words) <= 4
    assert len(seen[4]) >= len(seen[3]) and P.run(spark, str(tmp_path)).count() == len(seen[4])


def test_pipeline_drops_equal_rows_only(spark, tmp_path):
    import corpus_pipeline as P

    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(1, a, "y", "r1"), (1, a, "x", "r2"), (1, b, "x", "r3"), (2, a, "x", "r4"), (None, a, "x", "r5"), (None, a, "x", "r6"), (3, "", "x", "r7"), (3, "", "x", "r8")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rest string, toxicity string")
    out = P.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, a, "x", "r2"), (1, b, "x", "r3"), (None, a, "x", "r5"), (None, a, "x", "r6"), (3, "", "x", "r7")], key=str)
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = P.drop_toxic(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.count() == len(rows)
