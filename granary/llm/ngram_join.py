"""Exact n-gram Jaccard self-join over whole documents, through token-combination prefixes.

**Filter.** Shingles are ordered rare class first, then the frequent class by rising frequency. A document
of n shingles may miss at most d = n - ceil(t n) of them in a partner, so its prefix is extended
until any d missing shingles still leave a signature. A rare shingle is a signature by itself. Frequent
shingles are hashed into sub-classes, and each 2-combination inside a sub-class is a signature, so a
sub-class with f shingles in the prefix stands f - 1 losses. Signatures carry the size class of the smaller partner,
so that documents of other sizes don't meet by chance. Any pair at or above the threshold shares a signature; the frequency
classes only decide how many other pairs do. They come from lossy counting over all documents: exact
counts of each block of shingles, summed, the ``FREQUENT`` largest kept.

**Pairs.** No group is ever turned into all its pairs. First each document is held against the smallest
document of each of its signatures; links found contract documents into components. Then only
signatures whose other documents still span two components are looked at again, and only pairs across components: signatures
with much the same documents are merged and parted by size. Small groups meet in a join. Large ones meet one more
document of theirs a round, which joins families of copies, and then in blocks of ``BLOCK`` documents, two at a
time; the documents of a group's largest component meet the others only. A block verifies its pairs itself and
gives the links that join components, fewer than it has documents. A size bound and parity bitmaps (documents
differ in at least as many shingles as bitmaps differ in bits) drop pairs before shingle sets are looked at; what
remains is verified exactly. A bitmap has about as many bits as the document has shingles, 256 at least; folded in
halves it is the bitmap of fewer bits.

Shingles are compared by 64-bit hashes. Nulls: a null text is an empty text; a row with a null id gets the
component of its copies, or null. Texts without words link with nothing. Rows with one id are one
node. Long texts are taken whole, in slices of a batch, and their blocks hold fewer documents. An empty table gives
no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, stored, table
from .tokens import slices

#: Shingles in the frequent class at most, and the count from which one is frequent.
FREQUENT, FREQUENT_FROM = 1 << 18, 16
#: Shingles counted exactly at a time, and the count in such a block from which one is passed on.
COUNT_BLOCK, COUNT_FROM = 4_000_000, 2
#: Classes of sizes below COMBINE_FROM use single shingles only; salt of combinations.
COMBINE_FROM, COMBINED = 32, 1 << 20
#: Documents of a group that meet in a join; more are cut into blocks of BLOCK documents, or of fewer with HELD shingles.
JOINED, BLOCK, HELD = 48, 512, 1 << 19
#: Times that a large group meets one of its documents before it is cut into blocks.
ROUNDS = 3
#: Ids up to which the list of documents to fetch is broadcast (8 MB).
BROADCAST_IDS = 1_000_000

#: Shingles up to which the short bitmap tells documents apart.
SHORT = 256

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
BITMAP = ["b0", "b1", "b2", "b3"]


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x + np.uint64(int(_A) * (salt + 1) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct 64-bit shingle hashes of a text; A-Z is lower-cased, ASCII white space separates."""

    def __init__(self, n: int):
        self._n = n

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode().lower().split() if text else []
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        width = min(self._n, len(words))
        if not width:
            return h
        out = np.full(len(h) - width + 1, width, np.uint64)
        for i in range(width):
            out = out * _B + h[i : i + len(out)]
        return np.unique(mixed(out))


def digest(h: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(mixed(h, 1).sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mixed(h, 2)).view(np.int64))


def bitmap(h: np.ndarray) -> np.ndarray:
    """Parities of shingle counts in as many cells as the next power of two, as 64-bit words."""
    cells = max(256, 1 << (len(h) - 1).bit_length()) if len(h) else 256
    bits = np.bincount((h >> np.uint64(7) & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.int64)


def folded(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_xor.reduce(bits.reshape(-1, 4), axis=0)


def needed(n: int, num: int, den: int) -> int:
    """Shingles that a document of n shares with any partner, at least."""
    return -(-num * n // den)


def size_class(n: int, num: int, den: int) -> int:
    """Sizes that differ by the square of the threshold at most fall into one class or two; a monotone function of the size alone."""
    return int(math.log(n) / class_width(num, den) + 1e-9)


def class_width(num: int, den: int) -> float:
    return 2 * math.log(den / num) if num < den else math.log(2)


def signatures(h: np.ndarray, rank: np.ndarray, num: int, den: int) -> np.ndarray:
    """Signature hashes of a set. rank: 0 for rare shingles, else the place in the frequent class plus one."""
    n = len(h)
    least = needed(n, num, den)
    losses = n - least
    order = np.argsort(rank, kind="stable")
    h, rare = h[order], int((rank == 0).sum())
    out = []
    for c in range(size_class(least, num, den), size_class(n, num, den) + 1):
        size = int(math.exp(c * class_width(num, den)))
        if rare > losses or size < COMBINE_FROM:
            out.append(mixed(h[: losses + 1], 8 + c))
            continue
        classes = np.uint64(max(1, size // 4))
        left, members, pairs = losses + 1 - rare, {}, []
        for x, k in zip(h[rare:].tolist(), (mixed(h[rare:], 3) % classes).tolist()):
            group = members.setdefault(k, [])
            pairs += [(x, y) if x < y else (y, x) for y in group]
            left -= bool(group)
            group.append(x)
            if left <= 0:
                break
        out.append(mixed(h[:rare], 8 + c))
        if pairs:
            p = np.array(pairs, np.uint64)
            out.append(mixed(mixed(p[:, 0], 4) * _B + p[:, 1], COMBINED + c))
    return np.concatenate(out)


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


class Sketch:
    """Per document: size, set digest and bitmap; and block counts of shingles (doc_id null, digest the shingle)."""

    schema = "kind int, doc_id long, n_shingles long, h1 long, h2 long, b0 long, b1 long, b2 long, b3 long, bits array<long>"

    def __init__(self, n: int):
        self.n = n

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, held, count = Shingler(self.n), [], 0
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch[0].to_pylist(), batch[1].to_pylist()):
                h = shingles(text)
                bits = bitmap(h)
                rows.append((0, doc_id, len(h), *digest(h), *folded(bits).tolist(), bits))
                held.append(h)
                count += len(h)
                if count >= COUNT_BLOCK:
                    yield self._counts(held)
                    held, count = [], 0
            if rows:
                *cols, bits = zip(*rows)
                yield self._batch([*(pa.array(x, pa.int64()) for x in cols), pa.array(bits, pa.list_(pa.int64()))])
        if held:
            yield self._counts(held)

    def _counts(self, held: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        h, n = h[n >= COUNT_FROM], n[n >= COUNT_FROM]
        none = pa.nulls(len(h), pa.int64())
        return self._batch([pa.array(np.ones(len(h), np.int64)), none, pa.array(n.astype(np.int64)), _longs(h), *[none] * 5, pa.nulls(len(h), pa.list_(pa.int64()))])

    def _batch(self, cols: list[pa.Array]) -> pa.RecordBatch:
        names = [x.split()[0] for x in self.schema.split(", ")]
        return pa.RecordBatch.from_arrays([cols[0].cast(pa.int32()), *cols[1:]], names)


class Signatures:
    """Signatures of each set, once for equal sets of a partition."""

    schema = "sig long, doc_id long"

    def __init__(self, n: int, num: int, den: int, frequent):  # noqa: ANN001
        self.n, self.num, self.den, self.frequent = n, num, den, frequent

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen = Shingler(self.n), set()
        known, place = self.frequent.value
        for batch in slices(batches):
            sigs, ids = [], []
            for doc_id, text in zip(batch[0].to_pylist(), batch[1].to_pylist()):
                h = shingles(text)
                if doc_id is None or not len(h) or (key := digest(h)) in seen:
                    continue
                seen.add(key)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    rank = np.where(known[at] == h, place[at], 0)
                else:
                    rank = np.zeros(len(h), np.int64)
                sigs.append(signatures(h, rank, self.num, self.den))
                ids.append(np.full(len(sigs[-1]), doc_id, np.int64))
            if sigs:
                yield pa.RecordBatch.from_arrays([_longs(np.concatenate(sigs)), pa.array(np.concatenate(ids))], ["sig", "doc_id"])


class Sets:
    schema = "doc_id long, shingles array<long>"

    def __init__(self, n: int):
        self.n = n

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(self.n)
        for part in slices(batches):
            held = [shingles(t) for t in part[1].to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(h) for h in held])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part[0], pa.ListArray.from_arrays(pa.array(ends), _longs(np.concatenate(held)))], ["doc_id", "shingles"])


def _sized(a: str, b: str, num: int, den: int) -> str:
    return f"{den} * least({a}.n_shingles, {b}.n_shingles) >= {num} * greatest({a}.n_shingles, {b}.n_shingles)"


def may_link(a: str, b: str, apart: str, num: int, den: int) -> Column:
    """Size bound, then bitmap bound; ``apart`` counts differing bits of a and b."""
    return F.expr(f"case when {_sized(a, b, num, den)} then {den + num} * ({apart}) <= {den - num} * ({a}.n_shingles + {b}.n_shingles) else false end")


def short_bits(a: str, b: str) -> str:
    return " + ".join(f"bit_count({a}.{x} ^ {b}.{x})" for x in BITMAP)


def half(x: str) -> str:
    """A bitmap folded in halves."""
    return f"zip_with(slice({x}, 1, size({x}) div 2), slice({x}, size({x}) div 2 + 1, size({x}) div 2), (p, q) -> p ^ q)"


def all_bits(a: str, b: str) -> str:
    """Sizes within the bound differ by one power of two at most, so the longer bitmap is folded once at most."""

    def fitted(x: str, other: str) -> str:
        return f"case when size({x}) > size({other}) then {half(x)} else {x} end"

    return f"aggregate(zip_with({fitted(f'{a}.bits', f'{b}.bits')}, {fitted(f'{b}.bits', f'{a}.bits')}, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + coalesce(v, 0))"


def block_links(num: int, den: int):  # noqa: ANN201
    """Links (a, b) of one block or of two that join components; at most one less than the components here.

    Candidates pass the size and bitmap bounds and lie in different components; each is verified by its shingles,
    unless links found before have joined its components. Two documents that are both here as neighbours from the
    step before (not ``late``) have met there; those of one block of two meet in a block of its own.
    """

    def links(pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        ids, n, block = (pdf[c].to_numpy(np.int64) for c in ("rep", "n_shingles", "block"))
        late, comp = pdf["late"].to_numpy(bool), np.unique(pdf["comp"].to_numpy(np.int64), return_inverse=True)[1]
        alone, sets = bool((block == block[0]).all()), [np.asarray(x, np.int64) for x in pdf["shingles"]]
        words = min(map(len, pdf["bits"]))
        bits = np.stack([np.bitwise_xor.reduce(np.asarray(x, np.int64).reshape(-1, words), axis=0) for x in pdf["bits"]]).view(np.uint64)
        out, rows = [], max(1, (1 << 21) // (len(ids) * words))
        for i in range(0, len(ids), rows):
            part = slice(i, i + rows)
            least, most = np.minimum(n[part, None], n[None]), np.maximum(n[part, None], n[None])
            ok = (late[part, None] | late[None]) & (ids[part, None] < ids[None]) & (comp[part, None] != comp[None]) & (den * least >= num * most)
            if not alone:
                ok &= block[part, None] != block[None]
            if not ok.any():
                continue
            apart = np.bitwise_count(bits[part, None, :] ^ bits[None, :, :]).sum(-1, dtype=np.int64)
            ok &= (den + num) * apart <= (den - num) * (least + most)
            for x, y in zip(*(k.tolist() for k in np.nonzero(ok))):
                x += i
                if comp[x] != comp[y]:
                    shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if den * shared >= num * (len(sets[x]) + len(sets[y]) - shared):
                        out.append((ids[x], ids[y]))
                        comp[comp == comp[y]] = comp[x]
        return pd.DataFrame(np.array(out, np.int64).reshape(-1, 2), columns=["a", "b"])

    return links


def connected(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """Smallest node reachable from each node of ``edges`` (a, b): node, label.

    Each round hooks every node to its smallest neighbour, follows two hooks, and contracts the edges;
    the rounds grow with the logarithm of the longest path, and no node's edges need one task.
    """
    spark = edges.sparkSession
    edges = stored(edges.where("a <> b").distinct(), folder, f"{name}-edges")
    labels = stored(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("label", F.col("node")), folder, f"{name}-labels")
    step = 0
    while edges.take(1):
        both = edges.union(edges.select("b", "a"))
        hooks = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")), folder, f"{name}-hooks-{step}")
        once = hooks.alias("x").join(hooks.alias("y"), F.col("x.to") == F.col("y.a")).select("x.a", F.col("y.to").alias("to"))
        hooks = stored(once.alias("x").join(hooks.alias("y"), F.col("x.to") == F.col("y.a")).select("x.a", F.col("y.to").alias("to")), folder, f"{name}-jumps-{step}")
        labels = stored(labels.join(hooks, labels["label"] == hooks["a"], "left").select("node", F.coalesce("to", "label").alias("label")), folder, f"{name}-labels-{step}")
        to_a, to_b = hooks.select("a", F.col("to").alias("ta")), hooks.select(F.col("a").alias("b"), F.col("to").alias("tb"))
        moved = edges.join(to_a, "a").join(to_b, "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
        edges = stored(moved.distinct(), folder, f"{name}-edges-{step}")
        step += 1
    return labels


def _verified(pairs: DataFrame, docs: DataFrame, n: int, num: int, den: int, folder: str, name: str) -> DataFrame:
    """The pairs (a, b) that reach the threshold. Shingle sets are made for their documents only."""
    wanted = stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), folder, f"{name}-wanted")
    near = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    sets = stored(docs.join(near, "doc_id", "left_semi").mapInArrow(Sets(n), Sets.schema), folder, f"{name}-sets")
    a, b = (sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    both = pairs.join(a, "a").join(b, "b").withColumn("shared", F.size(F.array_intersect("sa", "sb")))
    return both.where(F.expr(f"{den} * shared >= {num} * (size(sa) + size(sb) - shared)")).select("a", "b")


def _grouped(rows: DataFrame, folder: str) -> DataFrame:
    """(grp, rep) of members (sig, rep, m): signatures that mostly share their members become one group.

    The shingles of one common passage make many signatures with much the same documents; each document should
    meet the others once, not once a signature. A signature joins the one that most of its members have as
    their largest, if at least half do. Documents that share a signature always share a group.
    """
    largest = rows.groupBy("rep").agg(F.max(F.struct("m", "sig")).alias("top")).select("rep", F.col("top.sig").alias("to"))
    votes = rows.join(largest, "rep").groupBy("sig", "to").agg(F.count("*").alias("n"), F.max("m").alias("m"))
    best = votes.groupBy("sig").agg(F.max(F.struct("n", "to", "m")).alias("v"))
    group = best.select("sig", F.when(2 * F.col("v.n") >= F.col("v.m"), F.col("v.to")).otherwise(F.col("sig")).alias("grp"))
    return rows.join(stored(group, folder, "groups"), "sig").select("grp", "rep").distinct()


def _large_links(rows: DataFrame, nodes: DataFrame, docs: DataFrame, n: int, num: int, den: int, folder: str) -> DataFrame:
    """Links (a, b) that join the components of large groups (grp, step, late, rep, comp), as far as they can be joined.

    First, up to ``ROUNDS`` times, all of a group meet one document of it, as long as one meeting in 100 links; this
    contracts families of copies. What is left meets in blocks; those of a group's largest component meet the others only.
    """
    spark = docs.sparkSession
    wanted = stored(rows.select(F.col("rep").alias("doc_id")).distinct(), folder, "large-wanted")
    near = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
    sets = docs.join(near, "doc_id", "left_semi").mapInArrow(Sets(n), Sets.schema).dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "rep")
    sets = stored(sets.join(nodes.select("rep", "n_shingles", "bits"), "rep"), folder, "large-sets")
    at, rows = stored(rows.select("rep", "comp").distinct(), folder, "large-at"), rows.drop("comp")
    found = spark.createDataFrame([], "a long, b long")
    for k in range(ROUNDS):
        now = rows.join(at, "rep")
        pivots = now.groupBy("grp", "step").agg(F.max(F.struct(F.xxhash64("rep", F.lit(k)).alias("h"), "rep", "comp")).alias("p"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
        pivots = stored(pivots.where("c0 < c1").select("grp", "step", F.col("p.rep").alias("pivot"), F.col("p.comp").alias("to")), folder, f"large-pivots-{k}")
        pairs = now.join(pivots, ["grp", "step"]).where("comp <> to").select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b"), F.least("comp", "to").alias("ca"), F.greatest("comp", "to").alias("cb"))
        pairs = stored(pairs.distinct(), folder, f"large-pairs-{k}")
        x, y = (sets.select(F.col("rep").alias(i), F.struct("n_shingles", "bits", "shingles").alias(j)) for i, j in ("ax", "by"))
        met = pairs.join(x, "a").join(y, "b").where(may_link("x", "y", all_bits("x", "y"), num, den))
        met = met.withColumn("shared", F.size(F.array_intersect("x.shingles", "y.shingles"))).where(f"{den} * shared >= {num} * (x.n_shingles + y.n_shingles - shared)")
        links = stored(met.select("a", "b", "ca", "cb"), folder, f"large-links-{k}")
        if not (joining := links.count()):
            break
        found = found.union(links.select("a", "b"))
        to = connected(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")), folder, f"large-{k}")
        at = stored(at.join(to, at["comp"] == to["node"], "left").select("rep", F.coalesce("label", "comp").alias("comp")), folder, f"large-at-{k}")
        if 100 * joining < pairs.count():  # what is left seldom links: blocks are cheaper
            break
    sized = rows.join(at, "rep").join(sets.select("rep", "n_shingles"), "rep")
    tally = sized.groupBy("grp", "step", "comp").agg(F.count("*").alias("m"), F.max("n_shingles").alias("longest"))
    tops = tally.groupBy("grp", "step").agg(F.max(F.struct("m", "comp")).alias("top"), F.sum("m").alias("size"), F.max("longest").alias("longest")).where("top.m < size")
    per = F.greatest(F.lit(8), F.least(F.lit(BLOCK), F.floor(F.lit(HELD) / F.col("longest"))))
    tops = tops.select("grp", "step", F.col("top.comp").alias("main"), F.ceil((F.col("size") - F.col("top.m")) / per).alias("others"), F.ceil(F.col("top.m") / per).alias("mains"))
    left = sized.drop("n_shingles").join(stored(tops, folder, "large-tops"), ["grp", "step"])
    left = left.withColumn("block", F.expr("case when comp = main then others + pmod(xxhash64(rep), mains) else pmod(xxhash64(rep), others) end"))
    left = left.withColumn("meets", F.explode(F.expr("sequence(0L, others - 1 + case when comp = main then 0 else mains end)")))
    left = left.select("grp", "step", F.least("block", "meets").alias("i"), F.greatest("block", "meets").alias("j"), "block", "late", "rep", "comp")
    met = stored(left, folder, "large-meetings").join(sets, "rep").groupBy("grp", "step", "i", "j").applyInPandas(block_links(num, den), "a long, b long")
    return found.union(stored(met.distinct(), folder, "large-block-links"))


def similarity_components(df: DataFrame, folder: str, n: int = 5, num: int = 80, den: int = 100, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles and component_id of each row, where sets of n-word shingles link at num/den Jaccard.

    The threshold must lie above one half.
    """
    if not den < 2 * num <= 2 * den:
        raise ValueError("the threshold must lie above 1/2 and be 1 at most")
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketch = stored(docs.mapInArrow(Sketch(n), Sketch.schema), folder, "sketch")

    counts = sketch.where("kind = 1").groupBy("h1").agg(F.sum("n_shingles").alias("n")).where(F.col("n") >= FREQUENT_FROM)
    top = counts.orderBy(F.desc("n"), "h1").limit(FREQUENT).toPandas()
    h, place = top["h1"].to_numpy(np.int64).view(np.uint64), np.arange(len(top), 0, -1)
    order = np.argsort(h)
    frequent = spark.sparkContext.broadcast((h[order], place[order]))

    rows = sketch.where("kind = 0").drop("kind")
    # only sets that occur again; written, so that the join below deals its own exchange and a large group of copies can be split
    copies = rows.where("n_shingles > 0").groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m")).where("m > 1").drop("m")
    copies = stored(copies, folder, "copies")
    info = rows.join(copies, ["h1", "h2", "n_shingles"], "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"), *BITMAP, "bits")
    info = stored(info, folder, "info")
    nodes = info.where("doc_id = rep and n_shingles > 0").dropDuplicates(["doc_id"]).select("rep", "n_shingles", *BITMAP, "bits")
    rep_of = info.where("doc_id is not null").select("doc_id", "rep").distinct()

    sigs = stored(docs.mapInArrow(Signatures(n, num, den, frequent), Signatures.schema), folder, "signatures")
    # what joins a table back is written first, so that each side of the join has an exchange of its own and hot keys can be split
    pivots = sigs.groupBy("sig").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("other")).where("pivot < other").drop("other")
    live = stored(sigs.join(stored(pivots, folder, "pivots"), "sig"), folder, "live")

    def bounded(pairs: DataFrame) -> DataFrame:
        x, y = F.struct("n_shingles", "bits").alias("x"), F.struct("n_shingles", "bits").alias("y")
        met = pairs.join(nodes.select(F.col("rep").alias("a"), x), "a").join(nodes.select(F.col("rep").alias("b"), y), "b")
        return met.where(may_link("x", "y", all_bits("x", "y"), num, den)).select("a", "b")

    stars = live.where("doc_id <> pivot").select("doc_id", "pivot").distinct()
    stars = stars.join(rep_of, "doc_id").select(F.col("rep").alias("y"), F.col("pivot").alias("doc_id")).join(rep_of, "doc_id")
    stars = stars.where("y <> rep").select(F.least("y", "rep").alias("a"), F.greatest("y", "rep").alias("b")).distinct()
    links = _verified(stored(bounded(stars), folder, "stars"), docs, n, num, den, folder, "stars")
    first = connected(links, folder, "first")

    comp = rep_of.join(first, rep_of["rep"] == first["node"], "left").select("doc_id", "rep", F.coalesce("label", "rep").alias("comp"))
    # a signature's smallest document has met all others: what is left are pairs among these, none where two documents share it
    members = stored(live.where("doc_id <> pivot").select("sig", "doc_id").join(comp, "doc_id").select("sig", "rep", "comp").distinct(), folder, "members")
    split = members.groupBy("sig").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("m")).where("c0 < c1").select("sig", "m")
    open_rows = stored(members.join(stored(split, folder, "split"), "sig"), folder, "open")
    at = nodes.drop("bits").join(comp.where("doc_id = rep").select("rep", "comp"), "rep")

    # partners' sizes differ by one step of den/num at most: a document meets those of its step and of the two beside it
    step = F.floor(F.log("n_shingles") / float(np.log(den / num) if num < den else 1.0) + 1e-9)
    stepped = _grouped(open_rows.select("sig", "rep", "m"), folder).join(at, "rep").withColumn("own", step)
    met = stored(stepped.withColumn("step", F.explode(F.array("own", F.col("own") + 1))).withColumn("late", F.col("own") == F.col("step")), folder, "met")
    sizes = met.groupBy("grp", "step").agg(F.count("*").alias("size"), F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("grp", "step", "size")
    sized = stored(met.join(stored(sizes, folder, "sizes"), ["grp", "step"]), folder, "sized")
    # long documents need more than the short bitmap: half of theirs, or a quarter where few shingles may differ; compared inside the join, pairs that cannot link are never written
    enough = half(half("bits")) if 19 * (den - num) < 2 * den else half("bits")
    few = sized.where(F.col("size") <= JOINED).join(nodes.select("rep", F.when(F.col("n_shingles") > SHORT, F.expr(enough)).alias("bits")), "rep")
    wide = F.when(F.col("x.bits").isNotNull() & F.col("y.bits").isNotNull(), may_link("x", "y", all_bits("x", "y"), num, den)).otherwise(True)
    crossing = few.alias("x").join(few.alias("y"), (F.col("x.grp") == F.col("y.grp")) & (F.col("x.step") == F.col("y.step")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.comp") != F.col("y.comp")) & (F.col("x.late") | F.col("y.late")) & may_link("x", "y", short_bits("x", "y"), num, den) & wide)
    crossing = crossing.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    more = _verified(stored(crossing, folder, "crossing"), docs, n, num, den, folder, "crossing")
    large = sized.where(F.col("size") > JOINED).select("grp", "step", "late", "rep", "comp")
    if large.take(1):
        more = more.union(_large_links(large, nodes, docs, n, num, den, folder))
    to = comp.where("doc_id = rep").select("rep", "comp")
    over = more.join(to.toDF("a", "ca"), "a").join(to.toDF("b", "cb"), "b").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))
    second = connected(over, folder, "second")

    final = comp.where("doc_id = rep").join(second, F.col("comp") == second["node"], "left").select("rep", F.coalesce("label", "comp").alias("component_id"))
    return info.join(final, "rep", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "rep").alias("component_id"))


def one_of_each(df: DataFrame, folder: str, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``df`` (doc_id, text, ...) but for those whose component has a smaller doc_id."""
    found = stored(similarity_components(df, folder, n, num, den), folder, "components")
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return df.join(gone, "doc_id", "left_anti").select(*df.columns)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_components(table(spark, sf_dir, "documents"), shared_folder(spark), n=3, num=90, den=100)


#: The same components from all pairs that share a shingle.
SQL = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) >= 3 then list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as sh from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
r as (select doc_id as a, doc_id as b from documents union select r.a, l.b from r join l on r.b = l.a)
select doc_id, coalesce(n.n, 0) as n_shingles, m.c as component_id from (select a as doc_id, min(b) as c from r group by a) m left join n using (doc_id)
"""
