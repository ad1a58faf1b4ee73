"""Near-duplicates by the exact Jaccard similarity of shingle sets: pairs of similarity 0.8 or more are linked, and no others.

A document is the set of its shingles, each as XXH64. Equal sets are one node before anything else. Links are proposed
twice, and each proposal becomes one only after both sets have been counted in full:

1. Covering tables over SimHash fingerprints of the distinct words (``simhash.links``) bring together all nodes whose fingerprints
   are within the radius. That's most edited copies, and it costs a few dozen short rows a node. Each node keeps the closest of its proposals.
2. No Hamming radius is certain to reach a given similarity of sets, so a prefix filter completes the links: in one
   order of all shingles, sets can only have that similarity if the first n // 5 + 1 of each share one (leaving out more than
   a fifth of either set is too much). Nodes that share a prefix shingle and are in different components are compared where
   they meet, by parity bits, and of those that can be that similar each node proposes the ``CLOSEST`` by every shingle it shares.

A link is lost only if, by each of the many shingles that two nodes share, both have ``CLOSEST`` others that parity bits
hold for closer and that turn out not to be similar, and nothing else links them. Without ``closest`` all are proposed; rows then
grow with the square of groups of documents that are just not similar.

Parity bits say for each of n to 2n classes of hashes whether a set has an odd number of them. Two sets differ in at least as many
shingles as their bits differ, and sets of similarity 0.8 or more in at most a ninth of their joint sizes: so what bits
rule out is certainly less similar, at a hundredth of the bytes.

The order is rarest first by a sample's counts, then by value: it decides what is compared, never what is found.

Defined results: documents without words are equal; null texts are empty; texts are read whole; shorter texts than a shingle are
one shingle; rows that share id and text are one, texts that share an id are documents of their own; rows with a null id all stay; an empty table
gives an empty table; other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.scans import numbered
from .common import forget, fresh, lean, one_row_per_id, slices, spread_join, stored, text_rows
from .components import components
from .simhash import _hashes, links, word_fingerprint

#: Documents whose shingles are counted for the order, and how many of the most frequent come last in it.
SAMPLE, FREQUENT = 20_000, 200_000
#: Words of parity bits that are compared at once.
WORDS = 4_000_000
#: Proposals of a node by each shingle that it shares.
CLOSEST = 3
#: Nodes, and shingles of their sets, in a block of a cluster.
BLOCK_NODES, BLOCK_SHINGLES = 1024, 500_000


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return np.unique(_hashes(words, shingle, 42)) if words else np.zeros(0, np.uint64)


def prefix(shingles: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """What a set shares some of with every set of similarity 0.8 or more. ``frequent`` is sorted; the rest comes before it."""
    if not len(shingles):
        return shingles
    at = np.searchsorted(frequent, shingles)
    known = np.zeros(len(shingles), bool)
    known[at < len(frequent)] = frequent[at[at < len(frequent)]] == shingles[at < len(frequent)]
    place = np.full(len(shingles), -1, np.int64)
    place[known] = rank[at[known]]
    return shingles[np.argsort(place, kind="stable")[: len(shingles) // 5 + 1]]


def parity(shingles: np.ndarray) -> bytes:
    """One bit for each class of hashes, by their lowest bits, of which there are n to 2n, at least 64."""
    classes = max(64, 1 << max(0, len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(classes - 1)).astype(np.int64), minlength=classes) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def folded(bits: np.ndarray) -> np.ndarray:
    """Rows of parity words for half as many classes."""
    half = bits.shape[1] // 2
    return bits[:, :half] ^ bits[:, half:]


def apart(a: bytes, b: bytes) -> int:
    """The least number of shingles that two sets of these parity bits differ in."""
    x, y = (np.frombuffer(z, "<u8")[None] for z in (a, b))
    while x.shape[1] != y.shape[1]:
        x, y = (folded(x), y) if x.shape[1] > y.shape[1] else (x, folded(y))
    return int(np.bitwise_count(x ^ y).sum())


def _arrays(ids, sets: list[np.ndarray]) -> list[pa.Array]:
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return [ids, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))]


def shingle_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, shingles) of rows (doc_id, text)."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(stream, most=2_000_000):
            sets = [shingle_set(t.as_py(), shingle) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(_arrays(batch.column("doc_id"), sets), ["doc_id", "shingles"])

    return rows.mapInArrow(lean(batches), "doc_id long, shingles array<long>")


def _order(rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The sample's most frequent shingles, and the place of each among them."""
    every = max(1, rows.count() // SAMPLE)
    sample = shingle_sets(rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0), shingle)
    counts = sample.select(F.explode("shingles").alias("h")).groupBy("h").count().filter("count > 2")
    most = counts.orderBy(F.desc("count"), "h").limit(FREQUENT).toArrow()
    h, n = np.asarray(most.column("h")).astype(np.int64).view(np.uint64), np.asarray(most.column("count")).astype(np.int64)
    place = np.argsort(h)
    return h[place], n[place]


def _prefixes(rows: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, digest: of the set, n: its size, fp: of the distinct words, bits: of parity, prefix)."""
    frequent, rank = _order(rows, shingle)

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(stream, most=2_000_000):
            texts = batch.column("text").to_pylist()
            sets = [shingle_set(t, shingle) for t in texts]
            ids, first = _arrays(batch.column("doc_id"), [prefix(s, frequent, rank) for s in sets])
            digests = pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
            prints = pa.array(np.array([word_fingerprint(t) for t in texts], np.uint64).view(np.int64))
            bits = pa.array([parity(s) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([ids, digests, pa.array([len(s) for s in sets], pa.int32()), prints, bits, first], ["doc_id", "digest", "n", "fp", "bits", "prefix"])

    return rows.mapInArrow(lean(batches), "doc_id long, digest binary, n int, fp long, bits binary, prefix array<long>")


def _similar(shingle: int):
    """Pairs whose texts' sets have similarity 0.8 or more."""

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        held = 0
        for batch in slices(slices(stream, "b", 4_000_000), "a", 4_000_000):
            near = []
            for u, v, a, b in zip(*(batch.column(c).to_pylist() for c in ("u", "v", "a", "b")), strict=True):
                for node, text in ((u, a), (v, b)):
                    if node not in known:
                        if held > 2_000_000:
                            known.clear()
                            held = 0
                        known[node] = shingle_set(text, shingle)
                        held += len(known[node])
                x, y = known.get(u), known.get(v)
                x = shingle_set(a, shingle) if x is None else x  # dropped for the other's sake
                common = len(np.intersect1d(x, y, assume_unique=True))
                near.append(5 * common >= 4 * (len(x) + len(y) - common))
            yield batch.select(["u", "v"]).filter(pa.array(near, pa.bool_()))

    return batches


def _links(pairs: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """Those of ``pairs`` (u, v) whose sets have similarity 0.8 or more."""
    pairs = stored(pairs.distinct(), "pairs")
    nodes = pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct()
    texts = stored(rows.join(nodes, "doc_id", "left_semi"), "texts")
    both = pairs.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("a")), "u").join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("b")), "v")
    return both.select("u", "v", "a", "b").mapInArrow(lean(_similar(shingle)), "u long, v long")


def _proposed(nodes: DataFrame, radius: int) -> DataFrame:
    """Pairs (u, v) that connect all nodes whose word fingerprints are equal or meet within ``radius``."""
    prints = stored(nodes.groupBy("fp").agg(F.min("node").alias("least")), "prints")
    same = nodes.join(prints, "fp").filter("node <> least").select(F.col("least").alias("u"), F.col("node").alias("v"))
    return same.unionAll(links(prints.select("fp", F.col("least").alias("node")), radius))


def _met(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by h those that another one has the h of."""
    last = None  # a row that may yet be met, as a batch of one; its h; whether it has been
    for batch in stream:
        if not len(batch):
            continue
        whole = batch if last is None else pa.concat_batches([last, batch])
        h = np.asarray(whole.column("h"))
        same = h[1:] == h[:-1]
        met = np.append(same, False) | np.append(last is not None and carried, same)
        carried = bool(met[-1])
        yield whole.slice(0, len(whole) - 1).filter(pa.array(met[:-1]))
        last = whole.slice(len(whole) - 1)
    if last is not None and carried:
        yield last


def _apart_batches(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([apart(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int64())


def _closest(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of pairs (u, v) that may be similar enough the one with the closest u for each v."""
    u, v = (nodes.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"b{k}")) for k in ("u", "v"))
    both = pairs.distinct().join(u, "u").join(v, "v").filter("5 * least(nu, nv) >= 4 * greatest(nu, nv)")
    told = both.withColumn("apart", F.arrow_udf(_apart_batches, "long")("bu", "bv")).filter("9 * apart <= nu + nv")
    return told.groupBy("v").agg(F.min(F.struct("apart", "u")).alias("least")).select("least.u", "v")


class _Group:
    """Rows of one shingle: nodes, sizes, components and parity bits by their number of words."""

    def __init__(self, node: np.ndarray, n: np.ndarray, component: np.ndarray, bits: list[bytes]):
        self.node, self.n, self.component = node, n, component
        self.cluster = np.arange(len(node))  # of each row the first one of its cluster
        size = np.array([len(x) // 8 for x in bits])
        self.rows = {w: np.flatnonzero(size == w) for w in np.unique(size).tolist()}
        self.bits = {w: np.frombuffer(b"".join(bits[k] for k in rows), "<u8").reshape(len(rows), w) for w, rows in self.rows.items()}

    def pairs(self, closest: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Those of different components that may be similar enough: of each node outside of the largest component all, or the closest."""
        values, counts = np.unique(self.component, return_counts=True)
        bulk = self.component == values[counts.argmax()]
        for w, rows in self.rows.items():
            own = rows[~bulk[rows]]
            for wide in (w // 2, w, 2 * w) if len(own) else ():
                if wide in self.rows:
                    x, y = self.bits[w][~bulk[rows]], self.bits[wide]
                    yield from self._compared(own, folded(x) if wide < w else x, self.rows[wide], folded(y) if wide > w else y, closest)

    def _compared(self, i: np.ndarray, x: np.ndarray, j: np.ndarray, y: np.ndarray, closest: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = max(1, WORDS // max(1, y.size))
        for k in range(0, len(i), step):
            a, p = i[k : k + step], x[k : k + step]
            least = np.zeros((len(a), len(j)), np.int32)
            for w in range(y.shape[1]):
                least += np.bitwise_count(p[:, None, w] ^ y[None, :, w])
            na, nb = self.n[a][:, None], self.n[j][None]
            far = (9 * least > na + nb) | (5 * np.minimum(na, nb) < 4 * np.maximum(na, nb)) | (self.component[a][:, None] == self.component[j][None])
            if closest is None or closest >= len(j):
                r, c = np.nonzero(~far)
            else:
                more = np.flatnonzero((~far).sum(axis=1) > closest)
                r, c = np.nonzero(~far[more])
                self._unite(a[more[r]], j[c])
                least[far] = np.iinfo(np.int32).max
                c = np.argpartition(least, closest - 1, axis=1)[:, :closest]
                r = np.repeat(np.arange(len(a)), closest)
                c = c.ravel()
                near = ~far[r, c]
                r, c = r[near], c[near]
            u, v = self.node[a[r]], self.node[j[c]]
            yield np.minimum(u, v), np.maximum(u, v)

    def _unite(self, x: np.ndarray, y: np.ndarray) -> None:
        """Put the clusters of rows ``x`` and ``y`` together."""
        x, y = self.cluster[x], self.cluster[y]
        x, y = np.unique(np.stack([x, y])[:, x != y], axis=1)
        least = np.arange(len(self.node))
        while (least[x] != least[y]).any():
            low = np.minimum(least[x], least[y])
            np.minimum.at(least, x, low)
            np.minimum.at(least, y, low)
            least = least[least]
        self.cluster = least[self.cluster]

    def rest(self) -> tuple[np.ndarray, np.ndarray]:
        """Spanning edges of the clusters, once ``pairs`` has gone through all rows."""
        moved = np.flatnonzero(self.cluster != np.arange(len(self.node)))
        return self.node[self.cluster[moved]], self.node[moved]


def _near(closest: int | None):
    """Pairs that may be similar enough, of rows sorted by shingle; and as ``rest`` the clusters of nodes that have more than the closest."""

    def solved(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(held)
        columns = (np.asarray(group.column(c)).astype(np.int64) for c in ("node", "n", "component"))
        own = _Group(*columns, group.column("bits").to_pylist())
        told = ((*pair, rest) for rest, found in ((False, own.pairs(closest)), (True, map(_Group.rest, [own]))) for pair in found)
        for u, v, rest in told:
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.full(len(u), rest))], ["u", "v", "rest"])

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in stream:
            h = np.asarray(batch.column("h"))
            cuts = [0, *(np.flatnonzero(h[1:] != h[:-1]) + 1).tolist(), len(h)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b == a:
                    continue
                if held and held[0].column("h")[0].as_py() != h[a]:
                    yield from solved(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield from solved(held)

    return batches


def _counted(group: pa.Table) -> pa.Table:
    """Links that connect the nodes of one pair of blocks (i, j) wherever sets have similarity 0.8 or more."""
    node, block = (np.asarray(group.column(c)).astype(np.int64) for c in ("node", "block"))
    label = np.unique(np.asarray(group.column("component")), return_inverse=True)[1]
    sets = group.column("shingles").combine_chunks()
    n = np.asarray(pc.list_value_length(sets)).astype(np.int64)
    code = np.unique(np.asarray(sets.flatten()), return_inverse=True)[1]
    own = np.split(code, np.cumsum(n)[:-1])
    bulk = label == np.bincount(label).argmax()
    first = block == group.column("i")[0].as_py()
    every, mark, links = np.ones(len(node), bool), np.zeros(len(code), np.uint8), []
    inside = group.column("i")[0].as_py() == group.column("j")[0].as_py()
    for rows, others in ((~bulk, every),) if inside else ((~bulk & first, ~first), (~bulk & ~first, bulk & first)):
        rows, others = np.flatnonzero(rows), np.flatnonzero(others)
        if not len(rows) or not len(others):
            continue
        codes, starts = np.concatenate([own[k] for k in others]), np.cumsum(n[others]) - n[others]
        for a in rows.tolist():
            open_ = (label[others] != label[a]) & (5 * np.minimum(n[a], n[others]) >= 4 * np.maximum(n[a], n[others]))
            if not open_.any():
                continue
            mark[own[a]] = 1
            common = np.add.reduceat(mark[codes], starts, dtype=np.int64)
            mark[own[a]] = 0
            for b in others[open_ & (5 * common >= 4 * (n[a] + n[others] - common))].tolist():
                if label[b] != label[a]:
                    links.append((node[a], node[b]))
                    label[label == label[b]] = label[a]
    u, v = np.array(links, np.int64).reshape(-1, 2).T
    return pa.table({"u": np.minimum(u, v), "v": np.maximum(u, v)})


def _settled(members: DataFrame, rows: DataFrame, shingle: int) -> DataFrame:
    """Links (u, v) that connect all nodes of a cluster whose sets have similarity 0.8 or more and that are in different components. ``members``: node, cluster, component."""
    several = members.groupBy("cluster").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    members = stored(members.join(several.select("cluster"), "cluster"), "members")
    texts = rows.join(members.select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    sets = stored(members.join(shingle_sets(texts, shingle).withColumnRenamed("doc_id", "node"), "node"), "sets", 2000)
    share = lambda amount, most: F.ceil(amount / F.lit(most))
    sizes = sets.groupBy("cluster").agg(F.greatest(share(F.count("*"), BLOCK_NODES), share(F.sum(F.size("shingles")), BLOCK_SHINGLES)).alias("blocks"))
    dealt = sets.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    copies = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = copies.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("blocks", "other")
    return pairs.groupBy("cluster", "i", "j").applyInArrow(_counted, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 5, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", closest: int | None = CLOSEST) -> DataFrame:
    """``doc_id, component_id`` of every document; component_id is the smallest id that links reach. Ids are unique or null."""
    rows = text_rows(docs, id_col, text_col).filter("doc_id IS NOT NULL")
    full = stored(_prefixes(rows, shingle), "prefixes", 2000)
    first = [F.first(c).alias(c) for c in ("n", "fp", "bits", "prefix")]
    nodes = stored(full.groupBy("digest").agg(F.min("doc_id").alias("node"), *first), "nodes")
    made = stored(full.select("doc_id", "digest"), "digests")
    forget(full)
    found = stored(_links(_closest(_proposed(nodes.select("fp", "node"), radius), nodes), rows, shingle), "links", 2000)
    reached = stored(components(found).withColumnRenamed("node", "k"), "reached")
    postings = nodes.select(F.explode("prefix").alias("h"), "node")
    shared = stored(postings.repartition("h").sortWithinPartitions("h").mapInArrow(lean(_met), "h long, node long"), "shared")
    now = shared.join(reached, F.col("node") == F.col("k"), "left").select("h", "node", F.coalesce("component", "node").alias("component"))
    groups = now.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    left = now.join(groups.select("h"), "h").join(nodes.select("node", "n", "bits"), "node")
    near = left.select("h", "node", "n", "component", "bits").repartition("h").sortWithinPartitions("h").mapInArrow(lean(_near(closest)), "u long, v long, rest boolean")
    near = stored(near.distinct(), "near")
    found = found.unionAll(stored(_links(near.filter("NOT rest").select("u", "v"), rows, shingle), "links", 2000))
    whole = stored(components(found), "whole")
    crowds = near.filter("rest").select("u", "v")
    if not crowds.isEmpty():
        clusters = stored(components(crowds), "clusters")
        members = clusters.select("node", F.col("component").alias("cluster")).union(clusters.select("component", "component").distinct())
        now = members.join(whole.withColumnRenamed("node", "k"), F.col("node") == F.col("k"), "left").select("node", "cluster", F.coalesce("component", "node").alias("component"))
        whole = stored(components(found.unionAll(stored(_settled(now, rows, shingle), "links", 2000))), "whole")
    labels = nodes.join(whole, "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    return spread_join(made, labels, "digest").select("doc_id", "component_id")


def without_duplicates(docs: DataFrame, shingle: int = 5, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of every component, the one with the smallest id; rows with a null id all stay.

    Rows are told apart by id and text: texts that share an id are documents of their own, of which a component keeps that with the smallest digest."""
    repeated = docs.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1")
    if repeated.isEmpty():
        extra = fresh(docs, "extra")
        gone = stored(near_duplicates(docs, shingle, radius, id_col, text_col).filter("doc_id <> component_id").select(F.col("doc_id").alias(extra)), "extra")
        return docs.join(gone.hint("shuffle_hash"), F.col(id_col) == F.col(extra), "left_anti")
    key, number = fresh(docs, "key"), fresh(docs, "number")
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)
    keyed = docs.withColumn(key, F.when(F.col(id_col).isNotNull(), F.concat(F.col(id_col).cast("string"), F.lit(":"), digest)))
    once = one_row_per_id(keyed, key, text_col)  # rows that share id and text are one
    numbers = stored(numbered(once.filter(F.col(key).isNotNull()).select(F.col(id_col).alias("of"), key), ["of", key], number).select(key, number), "numbers")
    rows = once.select(key, F.col(text_col).alias("text")).join(numbers, key).select(number, "text")
    found = near_duplicates(rows, shingle, radius, number, "text").filter("doc_id <> component_id").select(F.col("doc_id").alias("k"))
    extra = stored(numbers.join(found, F.col(number) == F.col("k"), "left_semi").select(F.col(key).alias(fresh(once, "extra"))), "extra")
    left = once.join(extra.hint("shuffle_hash"), F.col(key) == F.col(extra.columns[0]), "left_anti")
    return left.select(*(f"`{c}`" for c in docs.columns))
