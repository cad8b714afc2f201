"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

1. Document frequencies of all shingles are counted into a fixed number of hash buckets.
2. Equal texts become one node with one sample vector, drawn by improved consistent weighted sampling.
3. Bands of the vector are buckets. Small buckets give all their pairs. Larger ones give, for each node, the pair
   with the bucket's leader and the pairs with its neighbours in the order of the rest of the vector.
4. Pairs whose vectors agree enough are verified by the weighted Jaccard similarity of the whole shingle sets.
5. Verified links are joined to classes by label propagation with pointer jumping.
6. All pairs of the larger buckets that are not yet in one class are compared, block by block, and what they link is joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, few_rows, removed, shared_dir, shingles, small_batches, written

WIDTH, THRESHOLD = 5, 0.8
BANDS, ROWS = 16, 4
SAMPLES = BANDS * ROWS
#: Bits of the hash buckets of document frequencies, and of the coordinates that are sampled.
DF_BITS, SAMPLE_BITS = 18, 15
#: Buckets of at most so many nodes give all their pairs.
SMALL = 32
#: Neighbours on either side that a node of a larger bucket is paired with, in each of its buckets.
NEIGHBOURS = 6
#: Nodes of either side of a block in which the open pairs of the larger buckets are compared.
BLOCK = 512
#: Rows of a bucket that meet the bucket's own row in one task.
SPREAD = 1024
#: Stands for a null id, so that ids can be compared and shuffled as plain numbers.
NO_ID = (1 << 63) - 1
#: Fewest agreeing samples of a pair that is verified: four standard deviations below the threshold's mean.
AGREE = int(SAMPLES * THRESHOLD - 4 * (SAMPLES * THRESHOLD * (1 - THRESHOLD)) ** 0.5)


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Weight of each hash bucket of shingles, from all texts of ``docs``.

    1 + log((n+1)/(df+1)) / log(number of buckets) / 2, between 1 and 1.5: a bucket's share of documents, and so
    its weight, tends to a limit as the corpus grows, and copies of a text that is in a large part of all documents
    stay near each other. The result has a fixed size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(1 << DF_BITS, dtype=np.int64), 0
        for batch in few_rows(batches):
            for text in batch.column(0).to_pylist():
                found[np.unique(shingles(text or "", WIDTH) >> np.uint64(64 - DF_BITS))] += 1
                n += 1
        if n:
            at = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(found[at], n))], names=["bucket", "n"])

    small_batches(docs.sparkSession)
    counts = docs.select(F.col("text").cast("string")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    table = counts.toPandas()  # at most 2^18 + 1 rows
    df = np.zeros(1 << DF_BITS)
    inside = table["bucket"].to_numpy() >= 0
    df[table["bucket"].to_numpy()[inside]] = table["n"].to_numpy()[inside]
    n = float(table["n"].to_numpy()[~inside].sum())
    return (1 + np.clip(np.log((n + 1) / (df + 1)) / np.log(1 << DF_BITS), 0, 1) / 2).astype(np.float32)


def counted_shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending, and their counts."""
    return np.unique(shingles(text, WIDTH), return_counts=True)


def short_shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The same with the upper 32 bits of the hashes, which is what pairs are verified with."""
    return np.unique((shingles(text, WIDTH) >> np.uint64(32)).astype(np.uint32), return_counts=True)


def weigh(hashes: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights of shingles, given by 64-bit hashes or their upper 32 bits."""
    return counts * idf[hashes >> hashes.dtype.type(8 * hashes.itemsize - DF_BITS)].astype(np.float64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of minima over sum of maxima of two weighted sets with ascending keys. Two empty sets: 1."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    high = a[1].sum() + b[1].sum() - low
    return float(low / high) if high else 1.0


class Sampler:
    """Improved consistent weighted sampling with the random tables of all coordinates drawn once."""

    def __init__(self, seed: int = 20):
        rng = np.random.default_rng(seed)
        shape = (1 << SAMPLE_BITS, SAMPLES)
        u = lambda: rng.random(shape, dtype=np.float32).clip(1e-7, 1 - 1e-7)
        self.r = -np.log(u() * u())
        self.log_c = np.log(-np.log(u() * u()))
        self.beta = u()
        self.inverse = 1 / self.r

    def sample(self, hashes: np.ndarray, weights: np.ndarray) -> bytes:
        """For each of SAMPLES functions the sampled coordinate and its level, as one 32-bit hash."""
        at, inverse = np.unique((hashes & np.uint64((1 << SAMPLE_BITS) - 1)).astype(np.int64), return_inverse=True)
        logs = np.log(np.bincount(inverse, weights=weights)).astype(np.float32)
        best = np.full(SAMPLES, np.inf, dtype=np.float32)
        coordinate, level = np.zeros(SAMPLES, dtype=np.int64), np.zeros(SAMPLES, dtype=np.float32)
        columns = np.arange(SAMPLES)
        for k in range(0, len(at), 1024):
            some = at[k : k + 1024]
            beta = self.beta[some]
            t = np.floor(logs[k : k + 1024, None] * self.inverse[some] + beta)
            a = self.log_c[some] - self.r[some] * (t - beta + 1)
            least = a.argmin(axis=0)
            value = a[least, columns]
            better = value < best
            best = np.where(better, value, best)
            coordinate = np.where(better, some[least], coordinate)
            level = np.where(better, t[least, columns], level)
        mixed = (coordinate.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ ((level.astype(np.int64) + (1 << 20)).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        return (mixed >> np.uint64(32)).astype("<u4").tobytes()


@lru_cache(maxsize=1)
def sampler() -> Sampler:
    return Sampler()


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id (null: NO_ID), text (null: empty) and key, which is equal for equal texts."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    return docs.select(doc_id.alias("doc_id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("key"))


def _nodes(rows: DataFrame, idf: Broadcast, folder: str) -> DataFrame:
    """nid, key, rep_id and samples: one node for each distinct text, with its least doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw, weights = sampler(), idf.value
        known: dict[bytes, bytes] = {}
        for batch in few_rows(batches):
            out = []
            for key, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if (found := known.get(key)) is None:
                    hashes, counts = counted_shingles(text)
                    found = draw.sample(hashes, weigh(hashes, counts, weights))
                    if len(known) >= 20_000:
                        known.clear()
                    known[key] = found
                out.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, type=pa.binary())], names=["doc_id", "key", "samples"])

    drawn = rows.select("doc_id", "key", "text").mapInArrow(run, "doc_id long, key binary, samples binary")
    one = drawn.groupBy("key").agg(F.min("doc_id").alias("rep_id"), F.max("samples").alias("samples"))
    return written(one.select(F.monotonically_increasing_id().alias("nid"), "key", "rep_id", "samples"), f"{folder}/nodes")


def _members(nodes: DataFrame, folder: str) -> DataFrame:
    """bucket, band, nid and n (nodes in the bucket) of all buckets of two or more nodes."""
    size = 4 * ROWS
    bands = F.array(*[F.xxhash64(F.lit(b), F.substring("samples", b * size + 1, size)) for b in range(BANDS)])
    rows = nodes.select("nid", F.posexplode(bands).alias("band", "bucket"))
    # Written, so that the join is one of two plain shuffles, of which a bucket's rows can be divided when it runs.
    counts = written(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), f"{folder}/counts")
    return written(rows.join(counts, "bucket"), f"{folder}/members")


def _with_bucket(rows: DataFrame, per: DataFrame) -> DataFrame:
    """``rows`` (bucket, nid, n) joined with ``per`` (bucket, n): rows of a bucket are dealt to parts of about SPREAD rows."""
    parts = F.ceil(F.col("n") / SPREAD).cast("int")
    copies = per.select("*", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")).drop("n")
    return rows.withColumn("part", F.pmod(F.xxhash64("nid"), parts).cast("int")).join(copies, ["bucket", "part"]).drop("part")


def _vectors(rows: DataFrame, nodes: DataFrame, members: DataFrame, folder: str) -> DataFrame:
    """nid, hashes and counts of the nodes that share a bucket, from their whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            found = [short_shingles(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([h.astype("<u4").tobytes() for h, _ in found], type=pa.binary()), pa.array([c.astype("<u4").tobytes() for _, c in found], type=pa.binary())], names=["nid", "hashes", "counts"])

    wanted = nodes.join(members.select("nid").distinct(), "nid", "left_semi").select("nid", "key", F.col("rep_id").alias("doc_id"))
    # Repeated rows repeat a node's text. They meet by the keys of the join, so this needs no further shuffle.
    texts = rows.join(wanted, ["key", "doc_id"]).dropDuplicates(["key", "doc_id"]).select("nid", "text")
    return written(texts.mapInArrow(run, "nid long, hashes binary, counts binary"), f"{folder}/vectors")


def _small_pairs(members: DataFrame) -> DataFrame:
    """a < b of all pairs of the buckets of at most SMALL nodes: at most SMALL / 2 pairs a member."""
    small = members.where(F.col("n") <= SMALL)
    return small.select("bucket", F.col("nid").alias("a")).join(small.select("bucket", F.col("nid").alias("b")), "bucket").where("a < b").select("a", "b")


def _leader_pairs(members: DataFrame) -> DataFrame:
    """a < b of the larger buckets' nodes with the leader: the node that shares buckets with the most others."""
    score = members.groupBy("nid").agg(F.sum("n").alias("score"))
    large = members.where(F.col("n") > SMALL).select("bucket", "nid", "n")
    leaders = large.join(score, "nid").groupBy("bucket", "n").agg(F.max(F.struct("score", (-F.col("nid")).alias("nid"))).alias("top")).select("bucket", "n", (-F.col("top.nid")).alias("leader"))
    return _with_bucket(large, leaders).where("nid <> leader").select(F.least("nid", "leader").alias("a"), F.greatest("nid", "leader").alias("b"))


def _neighbour_pairs(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """a < b of the larger buckets' nodes that are neighbours in the bucket and whose vectors agree enough.

    Within a bucket nodes are ordered by their vector, rotated to begin after the bucket's band, so nodes with a long
    common run of samples are next to each other, in another order for each band. Rows are ranged by bucket and
    vector, so a large bucket is spread over tasks, and every node gives at most NEIGHBOURS pairs a bucket. Neighbours
    on either side of a range's end don't meet here, so which pairs this gives depends on the number of partitions;
    classes don't, as all pairs that the first pass leaves in different components are compared in _open_blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in few_rows(batches):
            out = []
            for bucket, nid, samples in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = np.frombuffer(samples, dtype="<u4")
                if held and held[-1][0] != bucket:
                    held = []
                out += [(min(nid, other), max(nid, other)) for _, other, theirs in held if (own == theirs).sum() >= AGREE]
                held = [*held[-(NEIGHBOURS - 1) :], (bucket, nid, own)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in zip(*out)], names=["a", "b"])

    large = members.where(F.col("n") > SMALL).join(nodes.select("nid", "samples"), "nid")
    cut = (F.col("band") + 1) * (4 * ROWS)
    rotated = F.concat(F.col("samples").substr(cut + 1, F.lit(4 * SAMPLES)), F.col("samples").substr(F.lit(1), cut))
    ordered = large.select("bucket", "nid", rotated.alias("samples"))
    partitions = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ordered.repartitionByRange(partitions, "bucket", "samples").sortWithinPartitions("bucket", "samples", "nid").mapInArrow(run, "a long, b long")


def _agreeing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those pairs a, b whose sample vectors agree enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype="<u4").reshape(-1, SAMPLES) for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((x == y).sum(axis=1) >= AGREE))

    of = lambda side: nodes.select(F.col("nid").alias(side), F.col("samples").alias(f"samples_{side}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "samples_a", "samples_b").mapInArrow(run, "a long, b long")


def _verified(near: DataFrame, vectors: DataFrame, idf: Broadcast, threshold: float) -> DataFrame:
    """a, b and similarity of those pairs (a, b) that reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = idf.value
        for batch in few_rows(batches):
            sides = []
            for i in (2, 4):
                pairs_of = zip(batch.column(i).to_pylist(), batch.column(i + 1).to_pylist())
                sides.append([(h := np.frombuffer(x, dtype="<u4"), weigh(h, np.frombuffer(y, dtype="<u4"), weights)) for x, y in pairs_of])
            found = np.array([weighted_jaccard(p, q) for p, q in zip(*sides)])
            part = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, type=pa.float64())], names=["a", "b", "similarity"])
            yield part.filter(pa.array(found >= threshold))

    of = lambda side: vectors.select(F.col("nid").alias(side), F.col("hashes").alias(f"hashes_{side}"), F.col("counts").alias(f"counts_{side}"))
    both = near.join(of("a"), "a").join(of("b"), "b").select("a", "b", "hashes_a", "counts_a", "hashes_b", "counts_b")
    return both.mapInArrow(run, "a long, b long, similarity double")


def _open_blocks(members: DataFrame, nodes: DataFrame, labels: DataFrame, folder: str) -> DataFrame:
    """Rows of the blocks that cover every pair of a larger bucket's nodes whose labels differ.

    The members outside a bucket's most common label are one side, all its members the other; both are dealt by hash
    into blocks of about BLOCK nodes, so blocks grow with the product of the sides and rows with the nodes of a block.
    """
    large = members.where(F.col("n") > SMALL).join(labels, "nid", "left").select("bucket", "band", "nid", "n", F.coalesce("label", "nid").alias("label"))
    sizes = large.groupBy("bucket", "n", "label").agg(F.count("*").alias("size"))
    tops = sizes.groupBy("bucket", "n").agg(F.max(F.struct("size", "label")).alias("top")).select("bucket", "n", "top.size", F.col("top.label").alias("top"))
    rows = _with_bucket(large, tops.where("size < n")).join(nodes.select("nid", "samples"), "nid")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    deal = lambda n: F.pmod(F.xxhash64("nid"), n).cast("int")
    few, all_ = blocks(F.col("n") - F.col("size")), blocks(F.col("n"))
    rows = rows.select("bucket", "band", "nid", "label", (F.col("label") == F.col("top")).alias("in_top"), "samples", few.alias("few"), all_.alias("all"))
    kept = written(rows, f"{folder}/open")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = kept.where("not in_top").select("*", F.lit(True).alias("is_left"), deal(F.col("few")).alias("i"), each("all").alias("j"))
    right = kept.select("*", F.lit(False).alias("is_left"), each("few").alias("i"), deal(F.col("all")).alias("j"))
    return left.unionByName(right).select("bucket", "i", "j", "is_left", "band", "nid", "label", "in_top", "samples")


def _block_pairs(block: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the left and of the right side, and agreeing samples, of a block's pairs that are to be verified.

    A pair of nodes outside the most common label is met from either side and taken from the lesser node's; a pair
    that shares several buckets is taken in that of its first band.
    """
    nid, label = block["nid"].to_numpy(), block["label"].to_numpy()
    is_left, in_top = block["is_left"].to_numpy(), block["in_top"].to_numpy()
    band = block["band"][0].as_py()
    samples = np.frombuffer(b"".join(block["samples"].to_pylist()), dtype="<u4").reshape(-1, SAMPLES)
    lefts, rights = np.flatnonzero(is_left), np.flatnonzero(~is_left)
    low = samples.astype(np.uint8)
    theirs = low[rights]
    found = [(np.empty(0, dtype=np.int64),) * 3]
    for x in lefts.tolist():
        # Whole samples that agree have equal low bytes, so this leaves no pair out; a pair is one word of 64 bits.
        agree = np.bitwise_count(np.packbits((theirs == low[x]).ravel()).view(np.uint64))
        at = np.flatnonzero((agree >= AGREE) & (label[rights] != label[x]) & (in_top[rights] | (nid[rights] > nid[x])))
        same = samples[rights[at]] == samples[x]
        agree = same.sum(axis=1)
        keep = (agree >= AGREE) & (same.reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band)
        found.append((np.full(int(keep.sum()), x), rights[at[keep]], agree[keep]))
    a, b, agree = (np.concatenate(c) for c in zip(*found))
    return a, b, agree


def _open_links(blocks: DataFrame, vectors: DataFrame, idf: Broadcast, threshold: float, folder: str) -> DataFrame:
    """Links a, b, similarity with the labels x, y of their nodes, such that labels which any pair of the blocks links are joined.

    A block first gives the rows that have a pair, so vectors go only to those. Then its pairs are verified, the most
    alike first; a pair whose labels the block's links have joined already adds nothing and is passed over.
    """

    def needed(block: pa.Table) -> pa.Table:
        a, b, _ = _block_pairs(block)
        return block.take(pa.array(np.union1d(a, b).astype(np.int64)))

    def run(block: pa.Table) -> pa.Table:
        a, b, agree = _block_pairs(block)
        weights, nid, label = idf.value, block["nid"].to_pylist(), block["label"].to_pylist()
        hashes, counts = block["hashes"].to_pylist(), block["counts"].to_pylist()
        sets: dict[int, tuple] = {}
        up: dict[int, int] = {}

        def vector(k: int) -> tuple[np.ndarray, np.ndarray]:
            if k not in sets:
                h = np.frombuffer(hashes[k], dtype="<u4")
                sets[k] = (h, weigh(h, np.frombuffer(counts[k], dtype="<u4"), weights))
            return sets[k]

        def root(x: int) -> int:
            while (above := up.get(x, x)) != x:
                up[x] = x = up.get(above, above)
            return x

        out = []
        order = np.argsort(-agree, kind="stable")
        for p, q in zip(a[order].tolist(), b[order].tolist()):
            x, y = root(label[p]), root(label[q])
            if x != y and (similarity := weighted_jaccard(vector(p), vector(q))) >= threshold:
                up[x] = y
                out.append((min(nid[p], nid[q]), max(nid[p], nid[q]), similarity, label[p], label[q]))
        cols = list(zip(*out)) or [()] * 5
        types = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
        return pa.table({k: pa.array(c, type=t) for k, c, t in zip(("a", "b", "similarity", "x", "y"), cols, types)})

    by = ("bucket", "i", "j")
    some = written(blocks.groupBy(*by).applyInArrow(needed, blocks.schema), f"{folder}/blocks")
    return some.join(vectors, "nid").groupBy(*by).applyInArrow(run, "a long, b long, similarity double, x long, y long")


def _joined(labels: DataFrame, edges: DataFrame, folder: str) -> DataFrame:
    """nid and label after the labels of ``edges`` a, b are joined; a node without a label is its own."""
    roots = components(edges, folder)
    moved = labels.join(roots.select(F.col("nid").alias("label"), F.col("label").alias("root")), "label", "left")
    fresh = roots.join(labels, "nid", "left_anti").select("nid", "label")
    return written(moved.select("nid", F.coalesce("root", "label").alias("label")).unionByName(fresh), f"{folder}/joined")


def links(rows: DataFrame, threshold: float, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The nodes, links a, b, similarity between them, and nid, label of the linked nodes.

    A first pass takes all pairs of small buckets, and of larger ones those with the leader and with neighbours. A
    second one compares all pairs of the larger buckets that the first left in different components, so the
    components are those of all pairs that share a bucket.
    """
    idf = rows.sparkSession.sparkContext.broadcast(document_frequencies(rows))
    nodes = _nodes(rows, idf, folder)
    members = _members(nodes, folder)
    vectors = _vectors(rows, nodes, members, folder)
    pairs = _small_pairs(members).unionByName(_leader_pairs(members)).distinct()
    near = written(_agreeing(pairs, nodes).unionByName(_neighbour_pairs(members, nodes)).distinct(), f"{folder}/near")
    found = written(_verified(near, vectors, idf, threshold), f"{folder}/links")
    labels = components(found, folder)
    blocks = _open_blocks(members, nodes, labels, folder)
    more = written(_open_links(blocks, vectors, idf, threshold, folder), f"{folder}/more")
    if more.isEmpty():
        return nodes, found, labels
    labels = _joined(labels, more.select(F.col("x").alias("a"), F.col("y").alias("b")), f"{folder}/second")
    return nodes, found.unionByName(more.select("a", "b", "similarity")), labels


def components(edges: DataFrame, folder: str) -> DataFrame:
    """nid and label (the least nid of its component) of the nodes of edges a, b.

    Every node is hooked to its least neighbour if that is less, hooks are followed to their roots by pointer
    jumping, and edges are renamed to the roots; those within a root are gone, so edges shrink from round to round
    and the last round has none. Every table is written; the driver sees whether one is empty.
    """
    a, b = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    pairs = written(edges.select(a, b).where("a <> b").distinct(), f"{folder}/edges-0")
    labels, turn = None, 0
    while True:
        turn += 1
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), f"{folder}/hooks-{turn}")
        jump = 0
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("up"))
            further = hooks.join(up, "root").select("node", F.col("root").alias("was"), F.col("up").alias("root"))
            jump += 1
            hooks = written(further, f"{folder}/hooks-{turn}-{jump}")
            done = hooks.where("root < was").isEmpty()
            hooks = hooks.select("node", "root")
            if done:
                break
        if labels is None:
            labels = hooks.select(F.col("node").alias("nid"), F.col("root").alias("label"))
        else:
            moved = labels.join(hooks.withColumnRenamed("node", "label"), "label", "left")
            labels = written(moved.select("nid", F.coalesce("root", "label").alias("label")), f"{folder}/labels-{turn}")
        named = pairs.join(hooks.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").join(hooks.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        pairs = written(named.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{folder}/edges-{turn}")
        if pairs.isEmpty():
            return labels


@dataclass(frozen=True)
class Classes:
    #: nid, key, rep_id of every distinct text.
    nodes: DataFrame
    #: a, b, similarity of verified links.
    links: DataFrame
    #: nid, label of linked nodes.
    labels: DataFrame
    #: label, class_id and nid of the node that stands for the class.
    heads: DataFrame


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> Classes:
    """Near-duplicate classes of the texts of ``docs``.

    Texts are near duplicates if the weighted Jaccard similarity of their shingles of five words reaches the
    threshold; classes are the connected components of the found links. Candidates are found with a probability
    of over 0.999 at similarity 0.8. Null texts count as empty, equal texts are one node, and nodes without a
    partner are in no link. Pairs of one class need not all be compared; every other pair of a bucket is.
    Intermediate tables are written in the shared folder, so no stage depends on an executor that is lost; the large
    ones are deleted once classes are known. Rows that repeat both id and text meet in one task where a text is fetched.
    """
    small_batches(docs.sparkSession)
    folder = shared_dir(docs.sparkSession)
    nodes, found, labels = links(_rows(docs), threshold, folder)
    linked = labels.join(nodes.select("nid", "rep_id"), "nid")
    first = F.min(F.struct("rep_id", "nid")).alias("first")
    heads = linked.groupBy("label").agg(first).select("label", F.col("first.rep_id").alias("class_id"), F.col("first.nid").alias("head"))
    heads = written(heads, f"{folder}/heads")
    removed(docs.sparkSession, *[f"{folder}/{x}" for x in ("counts", "members", "vectors", "near", "open", "blocks")])
    return Classes(nodes, found, labels, heads)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the class's least doc_id) and is_head of every row of ``docs``.

    Equal texts are of one class; a text without near duplicates is a class of its own. Rows that repeat an id
    and text get the same answer. class_id is null only where all ids of the class are. Other columns aren't read.
    """
    found = classes(docs, threshold)
    of = found.labels.join(found.heads, "label").select("nid", F.col("class_id").alias("shared"), (F.col("nid") == F.col("head")).alias("is_first"))
    named = found.nodes.select("nid", "key", "rep_id").join(of, "nid", "left")
    rows = _rows(docs).select("doc_id", "key")
    known = lambda c: F.when(c != NO_ID, c)
    return rows.join(named, "key").select(
        known(F.col("doc_id")).alias("doc_id"),
        known(F.coalesce("shared", "rep_id")).alias("class_id"),
        (F.coalesce("is_first", F.lit(True)) & (F.col("doc_id") == F.col("rep_id"))).alias("is_head"),
    )


def keep_heads(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of ``docs`` of each near-duplicate class, with the same columns: the one of the least doc_id.

    A repeated row of that id and text is kept once. Texts are shuffled once.
    """
    found = classes(docs, threshold)
    dropped = found.labels.join(found.heads, "label").where("nid <> head").select("nid")
    kept = found.nodes.join(dropped, "nid", "left_anti").select(F.col("key").alias("kinlink_key"), F.col("rep_id").alias("kinlink_rep"))
    text, doc_id = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    rows = docs.withColumns({"kinlink_key": F.unhex(F.md5(text.cast("binary"))), "kinlink_rep": doc_id})
    stay = rows.join(kept, ["kinlink_key", "kinlink_rep"], "left_semi")
    return stay.dropDuplicates(["kinlink_key", "kinlink_rep"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return near_duplicates(documents(spark, sf_dir))
