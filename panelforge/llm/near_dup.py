"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Shingles are hashed into [0, D); a first permutation scatters them and a second one, read
from a start that shifts by one for each coordinate, gives all coordinates: those of one
shingle are neighbours in the second permutation's table, so a signature is the minimum over
rows of a sliding window.

Steps, each a table in the shared folder:
 1. documents with equal sets are one class, named by its smallest doc_id; a doc_id with several
    texts links the classes of all of them;
 2. classes that share a band are compared with a few of the bucket's members (hubs) on full sets;
 3. where members of a bucket are still apart, all pairs across components are compared on full
    sets, in blocks that hold members of one large component or of many small ones: members of
    one component are not sent to meet each other, and a pair meets in the first band it shares;
 4. components by label propagation with pointer jumping.
No partner, bucket or candidate is capped. A link of similarity s is found if any of the
bands agrees: it is missed with probability (1 - s**rows) ** bands, 5e-6 at 0.75 by default.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import Scratch, WordMemo, arrow_map, bounded_batches, mix64, text_bytes


@dataclass(frozen=True)
class NearDupParams:
    words: int = 5
    similarity_pct: int = 75
    bands: int = 32
    rows: int = 4
    domain_bits: int = 20
    hubs: int = 3  #: members of a bucket, chosen by as many orders, that all are compared with
    block: int = 256  #: members of a bucket in a block, where all pairs are compared
    seed: int = 7


@lru_cache(maxsize=2)
def tables(bits: int, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and the windows of the second, which goes round."""
    rng = np.random.default_rng(seed)
    first = rng.permutation(1 << bits).astype(np.uint32)
    second = rng.permutation(1 << bits).astype(np.uint32)
    return first, np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[: width - 1]]), width)


def word_codes(memo_limit: int = 200_000) -> WordMemo:
    import xxhash

    return WordMemo(lambda words: [xxhash.xxh64_intdigest(w) for w in words], memo_limit)


def shingles(raw: bytes, memo: WordMemo, width: int) -> np.ndarray:
    """Sorted distinct 64-bit codes of the shingles; a shorter text is one shingle of its own length."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    table = memo.table(set(words))
    codes = np.fromiter(map(table.__getitem__, words), dtype=np.uint64, count=len(words))
    k = min(width, len(codes))
    out = np.full(len(codes) - k + 1, k, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[j : len(codes) - k + 1 + j]
        out ^= out >> np.uint64(29)
    return np.unique(mix64(out))


def signature(codes: np.ndarray, p: NearDupParams, chunk: int = 4096) -> np.ndarray:
    first, windows = tables(p.domain_bits, p.bands * p.rows, p.seed)
    start = first[codes >> np.uint64(64 - p.domain_bits)]
    parts = [windows[start[i : i + chunk]].min(axis=0) for i in range(0, len(start), chunk)]
    return np.minimum.reduce(parts)


def band_keys(sig: np.ndarray, p: NearDupParams) -> np.ndarray:
    code = np.zeros(p.bands, np.uint64)
    grid = sig.reshape(p.bands, p.rows).astype(np.uint64)
    for j in range(p.rows):
        code = mix64(code + grid[:, j] + np.uint64(0x9E3779B97F4A7C15))
    return mix64(code + np.arange(p.bands, dtype=np.uint64)).view(np.int64)


def linked(a: np.ndarray, b: np.ndarray, pct: int) -> bool:
    """Whether two sorted sets have 100 * common >= pct * union."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 100 * len(small) < pct * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    common = int((large[at] == small).sum())
    return 100 * common >= pct * (len(a) + len(b) - common)


def shingle_sets(docs: DataFrame, p: NearDupParams, with_members: bool) -> DataFrame:
    """doc_id, n_shingles, a 128-bit name of the set (null if empty), the signature, and the set and repeated if wanted."""
    bounded_batches(docs.sparkSession)
    ddl = "doc_id long, n_shingles long, set_name binary, sig binary" + ", members binary, repeated boolean" * with_members

    def sets(batches):
        import xxhash

        memo = word_codes()
        for batch in batches:
            rows = []
            for doc, raw in zip(batch["doc_id"], batch["raw"], strict=True):
                codes = shingles(raw, memo, p.words)
                rows.append((doc, len(codes), xxhash.xxh3_128_digest(codes.tobytes()), signature(codes, p).astype("<u4").tobytes(), codes.tobytes()) if len(codes) else (doc, 0, None, None, None))
            yield dict(zip(("doc_id", "n_shingles", "set_name", "sig", "members"), zip(*rows, strict=True), strict=True)) | ({"repeated": batch["repeated"]} if with_members else {})

    return arrow_map(docs.select("doc_id", text_bytes().alias("raw"), *["repeated"] * with_members), sets, ddl)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp): the smallest node reachable, by alternating min-label steps and jumps.

    Each round gives every node the smallest label of its neighbours, then the label of its
    label, so paths of length d need about log d rounds. Labels are tables in the shared folder.
    """
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y"))
    both = scratch.save(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "both")
    labels = scratch.save(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("comp")).withColumnRenamed("x", "node"), "labels0")
    step = 0
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "comp"), "y").groupBy(F.col("x").alias("node")).agg(F.min("comp").alias("near"))
        low = labels.join(near, "node").select("node", F.least("comp", "near").alias("low"), "comp")
        # a label's own label may be lower still, by what its members have seen
        lower = low.groupBy("comp").agg(F.min("low").alias("lowest"))
        moved = low.join(lower, "comp").select("node", F.least("low", "lowest").alias("new"), F.col("comp").alias("was"))
        step += 1
        moved = scratch.save(moved, f"moved{step}")
        changed = moved.filter("new <> was").limit(1).count()
        labels = moved.select("node", F.col("new").alias("comp"))
        if step > 1:
            scratch.drop(f"moved{step - 1}")
        if not changed:
            return labels


def full_sets(nodes: DataFrame, docs: DataFrame, scratch: Scratch, p: NearDupParams) -> DataFrame:
    """(node, members, sig) for each distinct set of the documents in nodes (node, repeated).

    Only documents whose id stands in several rows can have equal sets, and only these are
    shuffled to find them.
    """
    # the ids grow with the corpus: never broadcast, so that the plan is one at every size
    texts = docs.select("doc_id", "text").join(nodes.select(F.col("node").alias("doc_id"), "repeated").hint("merge"), "doc_id")
    made = scratch.save(shingle_sets(texts, p, True).filter("members is not null"), "made")
    some = made.filter("repeated").groupBy("doc_id", "set_name").agg(F.first("members").alias("members"), F.first("sig").alias("sig"))
    once = scratch.save(some.select(F.col("doc_id").alias("node"), "members", "sig"), "once")
    return made.filter("not repeated").select(F.col("doc_id").alias("node"), "members", "sig").unionByName(once)


def cells_of(tagged: DataFrame, p: NearDupParams) -> DataFrame:
    """(key, i, j, block, node, comp): which blocks of a bucket's members meet.

    tagged: key, node, comp. A component of more than half a block's members in a bucket has
    blocks of its own; all smaller ones share blocks, each whole in one. Blocks meet unless
    both belong to the same large component.
    """
    sizes = tagged.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    small = F.col("n") * 2 <= p.block
    buckets = sizes.groupBy("key").agg(
        F.count(F.lit(1)).alias("comps"),
        F.sum(F.when(small, F.col("n")).otherwise(0)).alias("small"),
        # a large component has over block / 2 members, so these are few beside the bucket
        F.sort_array(F.collect_list(F.when(~small, F.struct("comp", F.ceil(F.col("n") / p.block).cast("int").alias("blocks"))))).alias("large"),
    )
    buckets = buckets.filter("comps > 1").withColumn("shared", F.ceil(F.col("small") / p.block).cast("int"))
    # number of the first block of each large component; the shared ones come first
    ends = F.aggregate(F.col("large"), F.array(F.col("shared")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["blocks"])))
    buckets = buckets.withColumn("ends", ends).select("key", "shared", F.transform("large", lambda x: x["comp"]).alias("large"), "ends")
    rows = tagged.join(buckets, "key")
    at = F.array_position("large", F.col("comp")).cast("int")  # from 1; 0: a small one
    rows = rows.withColumn("at", at).withColumn("from", F.when(F.col("at") > 0, F.get("ends", F.col("at") - 1)).otherwise(0)).withColumn("to", F.when(F.col("at") > 0, F.get("ends", F.col("at"))).otherwise(F.col("shared")))
    block = F.col("from") + F.pmod(F.xxhash64(F.when(F.col("at") > 0, F.col("node")).otherwise(F.col("comp")), F.lit(-1)), F.col("to") - F.col("from")).cast("int")
    rows = rows.withColumn("block", block)
    others = F.filter(F.sequence(F.lit(0), F.element_at("ends", -1) - 1), lambda j: (F.col("at") == 0) | (j < F.col("from")) | (j >= F.col("to")))
    rows = rows.withColumn("other", F.explode(others))
    return rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "comp")


def common_counts(one: np.ndarray, many: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many elements of one sorted set each of n sets has, whose elements stand in many with their owner."""
    at = np.searchsorted(one, many)
    at[at == len(one)] = 0
    return np.bincount(owner[one[at] == many], minlength=n)


def compare_cell(key: int, node: np.ndarray, comp: np.ndarray, block: np.ndarray, one_block: bool, sigs: list, members: list, p: NearDupParams) -> list[tuple[int, int]]:
    """Links between members of different components, enough to connect what they connect."""
    keys = np.stack([band_keys(np.frombuffer(s, "<u4"), p) for s in sigs])
    sets = [np.frombuffer(m, np.uint64) for m in members]
    size, root, out = np.array([len(m) for m in sets]), {c: c for c in comp.tolist()}, []

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    for x in range(len(node)):
        y = np.arange(x + 1, len(node))
        y = y[(comp[y] != comp[x]) & (one_block | (block[y] != block[x])) & (100 * np.minimum(size[y], size[x]) >= p.similarity_pct * np.maximum(size[y], size[x]))]
        if len(y):  # the first band that both have is this bucket: in the others they don't meet again
            same = keys[y] == keys[x]
            y = y[keys[x][same.argmax(axis=1)] == key]
        y = y[[find(c) != find(comp[x]) for c in comp[y].tolist()]] if len(y) else y
        if not len(y):
            continue
        lengths = size[y]
        common = common_counts(sets[x], np.concatenate([sets[i] for i in y]), np.repeat(np.arange(len(y)), lengths), len(y))
        for z in y[100 * common >= p.similarity_pct * (lengths + size[x] - common)].tolist():
            lo, hi = sorted((find(int(comp[x])), find(int(comp[z]))))
            if lo != hi:
                root[hi] = lo
                out.append((int(node[x]), int(node[z])))
    return out


def find_links(sets: DataFrame, docs: DataFrame, scratch: Scratch, p: NearDupParams) -> DataFrame:
    """(a, b) links between documents, enough to connect every two that links connect.

    sets: node, n, sig, repeated; one row for each distinct set, named by a document that has it
    (repeated: in several rows of docs). Full sets are made again from docs, for the documents
    that share a band with another.
    """
    pct = p.similarity_pct

    def explode_bands(batches):
        for b in batches:
            keys = [band_keys(np.frombuffer(s, "<u4"), p) for s in b["sig"]]
            yield {"node": np.repeat(np.array(b["node"], np.int64), p.bands), "key": np.concatenate(keys), "n": np.repeat(np.array(b["n"], np.int64), p.bands)}

    bands = arrow_map(sets.select("node", "sig", "n"), explode_bands, "node long, key long, n long")
    # hubs by several orders of the members; buckets of one have nothing to compare
    order = lambda h: F.struct(F.xxhash64("node", F.lit(h)), F.col("node"), F.col("n"))
    hubs = bands.groupBy("key").agg(F.count(F.lit(1)).alias("size"), *[F.min(order(h)).alias(f"h{h}") for h in range(p.hubs)]).filter("size > 1")
    hubs = scratch.save(hubs.select("key", "size", F.array_distinct(F.array(*[F.struct(F.col(f"h{h}.node").alias("node"), F.col(f"h{h}.n").alias("n")) for h in range(p.hubs)])).alias("hubs")), "hubs")
    shared = scratch.save(bands.join(hubs.select("key"), "key", "left_semi"), "shared")

    pairs = shared.join(hubs.select("key", "hubs"), "key").select("node", "n", F.explode("hubs").alias("hub"))
    pairs = pairs.filter((F.col("node") != F.col("hub.node")) & (F.col("n") * 100 >= F.col("hub.n") * pct) & (F.col("hub.n") * 100 >= F.col("n") * pct))
    pairs = pairs.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()
    pairs = scratch.save(pairs, "pairs")
    nodes = shared.select("node").distinct().join(sets.filter("repeated").select("node", "repeated").distinct(), "node", "left")
    wanted = full_sets(nodes.select("node", F.coalesce("repeated", F.lit(False)).alias("repeated")), docs, scratch, p)
    withsets = pairs.join(wanted.select(F.col("node").alias("a"), F.col("members").alias("set_a")), "a")
    withsets = withsets.join(wanted.select(F.col("node").alias("b"), F.col("members").alias("set_b")), "b")

    def verify(batches):
        for b in batches:
            hit = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), pct) for x, y in zip(b["set_a"], b["set_b"], strict=True)]
            yield {k: [v for v, h in zip(b[k], hit, strict=True) if h] for k in ("a", "b")}

    stars = scratch.save(arrow_map(withsets, verify, "a long, b long"), "stars")
    comp = scratch.save(components(stars, scratch), "comp")

    # buckets whose members are in several components still: all pairs across
    tagged = shared.select("key", "node").distinct().join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    tagged = scratch.save(tagged, "tagged")
    cells = cells_of(tagged, p).join(wanted, "node")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        one = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        out = compare_cell(int(pdf["key"].iloc[0]), pdf["node"].to_numpy(), pdf["comp"].to_numpy(), pdf["block"].to_numpy(), one, pdf["sig"].to_list(), pdf["members"].to_list(), p)
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    more = scratch.save(cells.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long"), "more")
    return stars.unionByName(more)


def near_duplicates(docs: DataFrame, params: NearDupParams = NearDupParams()) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (smallest doc_id with the same set), kept.

    Null or empty texts have no shingles and stand alone, as do documents with a null
    doc_id (their component is null and they are kept). Rows with one doc_id are one
    document, linked by any of its texts; one of its rows without words stands alone all the same.
    Of a component the smallest doc_id is kept. Texts may be of any length; an empty table gives no rows.
    """
    p, scratch = params, Scratch(docs.sparkSession, "neardup")
    sets = scratch.save(shingle_sets(docs, p, False), "sets")
    named = sets.filter("set_name is not null and doc_id is not null")
    # a class for each distinct set, named by its smallest document, which carries its signature
    least = F.min(F.struct("doc_id", F.col("n_shingles").alias("n"), "sig")).alias("least")
    classes = scratch.save(named.groupBy("set_name").agg(least).select("set_name", F.col("least.doc_id").alias("class_id"), "least.n", "least.sig"), "classes")
    several = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min(F.xxhash64("set_name")).alias("x"), F.max(F.xxhash64("set_name")).alias("y")).filter("rows > 1")
    several = scratch.save(several.select("doc_id", (F.col("x") != F.col("y")).alias("differ")), "several")
    firsts = classes.select(F.col("class_id").alias("node"), "n", "sig")
    firsts = firsts.join(several.select(F.col("doc_id").alias("node"), F.lit(True).alias("repeated")), "node", "left").withColumn("repeated", F.coalesce("repeated", F.lit(False)))
    links = find_links(firsts, docs, scratch, p)
    # a document with several texts is in the class of each
    own = named.join(several.filter("differ").select("doc_id"), "doc_id", "left_semi").select("doc_id", "set_name").distinct()
    own = own.join(classes.select("set_name", "class_id"), "set_name").filter("doc_id <> class_id").select(F.col("class_id").alias("a"), F.col("doc_id").alias("b"))
    comp = scratch.save(components(links.unionByName(own), scratch), "components")
    found = classes.select("set_name", "class_id").join(comp, F.col("class_id") == F.col("node"), "left").select("set_name", "class_id", F.coalesce("comp", "class_id").alias("component_id"))
    rows = sets.select("doc_id", "n_shingles", "set_name").join(found, "set_name", "left")
    component = F.coalesce("component_id", "doc_id")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
