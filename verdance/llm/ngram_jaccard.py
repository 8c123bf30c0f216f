"""N-gram Jaccard join: size-aware, heavy and light.

A document is the set of its distinct 5-word shingles; documents with equal
sets are one *node*.  Two nodes link when 100 * |A n B| >= 80 * |A u B|.

Light nodes (at most ``boundary`` shingles) list all their subsets of each size
that a link between two light sets must share, and meet where subsets agree.
Heavy nodes scan inverted lists of the shingles in their prefix: in one global
order, rare shingles first, two linked sets share one of the first
n - ceil(0.8 n) + 1.  Light nodes that a heavy one may link stand in the lists
too.  The boundary is where the estimated keys of both ways cost least, from
the sizes of all sets and how often shingles recur.  Shingles are counted over
all documents, by key; the most frequent (at most ``MOST_FREQUENT``, the least
count rises until they fit) are broadcast as hashes, ordered by their counts.
They only order the lists, and any order gives the same result.

A list never emits all its pairs:

1. Each entry meets its list's least node, and in long lists a few more by
   other orders (frequent shingles' lists are salted, and the salts' least
   nodes meet).  What may link by sizes, places and bitmaps is verified on the
   whole sets; components are formed.
2. Only lists that span two components stay open.  A node of theirs can link on
   only if it misses at most n - ceil(0.8 n) of its shingles elsewhere, so its
   shingles are held against those of all other open nodes: first one half of
   them, then the whole sets, against other components alone.  Nodes with too
   many shingles of their own go.  So documents that share a passage, but not
   four fifths of their text, leave without being paired.
3. The nodes left meet neighbours in a few random orders of their lists, and
   components grow.
4. Pairs across components that still may link, by sizes, places, shared
   shingles and a sketch, are taken from blocks of the lists; the pairs nearest
   to each component are verified first, then what still spans two components.

No link between two components is lost, and a group of near copies costs a star.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdance.llm import kernels as K
from verdance.llm import tables
from verdance.llm.components import components

MOST_FREQUENT = 250_000
SALTS = 16
#: Lists of at least LONG entries have CENTRES nodes that all others meet.
LONG, CENTRES = 12, 4
LARGEST_LIGHT = 16
#: Bits of the filter of ids: 16 for each id, within these powers of two; and of one of its blocks.
LEAST_FILTER, MOST_FILTER, FILTER_BLOCK = 16, 27, 16
#: Bits of a set's parity bitmap: the power of two from its size on, within these.
LEAST_BITS, MOST_BITS = 256, 1 << 14
#: Rounds of neighbours in random orders, and of nearest pairs: they spare pairs, and change no result.
ROUNDS, NEAREST = 1, 1
#: Longer lists are chained, and paired, in parts of about this many entries.
CHAIN, BLOCK = 4096, 2048
#: Buckets of packed entries for each partition: a task opens one after the other.
BUCKETS = 3
_FLUSH, _FOLD = 400_000, 1_500_000
_CUT = np.uint64(16)  # low bits that counts of shingles leave out


def need(a: int, b: int) -> int:
    """The least intersection of sets of sizes a and b that link: ceil(4 (a + b) / 9)."""
    return (4 * (a + b) + 8) // 9


def fits(a: int, b: int) -> bool:
    return 5 * min(a, b) >= 4 * max(a, b)


def prefix(n: int) -> int:
    return n - (4 * n + 4) // 5 + 1


@cache
def subset_sizes(n: int, boundary: int) -> tuple[int, ...]:
    return tuple(sorted({need(n, m) for m in range(1, boundary + 1) if fits(n, m)}))


@cache
def subsets(n: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(n), k)), np.int64).reshape(-1, k)


def chosen_boundary(sizes: dict[int, int], recurrence: float) -> int:
    """The boundary with the least keys and list entries to read.

    ``sizes`` counts sets by size, ``recurrence`` is the mean number of other
    sets on a shingle's list."""

    def cost(boundary: int) -> float:
        total = 0.0
        for n, count in sizes.items():
            heavy = prefix(n) * (1 + recurrence)
            light = sum(comb(n, k) for k in subset_sizes(n, boundary)) if n <= boundary else 0
            near = n > boundary or 5 * n >= 4 * (boundary + 1)
            total += count * (light + heavy * near)
        return total

    return min(range(1, LARGEST_LIGHT + 1), key=lambda x: (cost(x), x))


def names_of(s: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit names of a set; equal sets have equal names."""
    with np.errstate(over="ignore"):
        x = np.array([s.sum(), K.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(), len(s)], np.uint64)
        y = K.mix(x ^ K.mix(x[[1, 2, 0]]))
        return int(y.sum().view(np.int64)), int(K.mix(y).sum().view(np.int64))


def node_of(s: np.ndarray, clashing: frozenset[int] = frozenset()) -> int:
    """The first name, or the second where sets of different second names share it."""
    one, two = names_of(s)
    return two if one in clashing else one


def parity_bitmap(s: np.ndarray) -> bytes:
    """Whether each bit is the hash of an odd number of the set's shingles."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << max(0, len(s) - 1).bit_length()))
    at = (K.mix(s) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(bool), bitorder="little").tobytes()


def folded(bitmap: bytes, size: int) -> np.ndarray:
    return np.bitwise_xor.reduce(np.frombuffer(bitmap, np.uint8).reshape(-1, size))


def least_difference(x: bytes, y: bytes) -> int:
    """A lower bound of the shingles in one of two sets alone, from their bitmaps."""
    least = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, least) ^ folded(y, least)).sum())


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def _half(s: np.ndarray) -> np.ndarray:
    """One half of all shingles, the same for all sets."""
    return s[(s >> _CUT) & np.uint64(1) == 1]


def document_nodes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, half, node, twin, bitmap) of each row of (doc_id, text).

    ``half`` counts the shingles of ``_half``; ``twin`` is the second name."""

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in K.text_slices(batches):
            sets = list(K.shingle_sets(data, offsets))
            names = [names_of(s) for s in sets]
            columns = [[len(s) for s in sets], [len(_half(s)) for s in sets], [a for a, _ in names], [b for _, b in names]]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns), pa.array([parity_bitmap(s) for s in sets], pa.binary())],
                ["doc_id", "n_shingles", "half", "node", "twin", "bitmap"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, half long, node long, twin long, bitmap binary")


def clashing_names(nodes: DataFrame) -> frozenset[int]:
    """First names of sets with different second names: of N sets about N**2 / 2**65 are expected."""
    both = nodes.groupBy("node").agg(F.min("twin").alias("lo"), F.max("twin").alias("hi")).where("lo != hi")
    return frozenset(r["node"] for r in both.select("node").collect())


def _planes(x: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, width).T.reshape(-1)


def _unplaned(raw: np.ndarray, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).reshape(-1)


def counted_shingles(docs: DataFrame, buckets: int) -> DataFrame:
    """(shingle, n) of the shingles that stand in three documents or more.

    A shingle is named by its upper 48 bits here.  Tasks count what they hold
    of a few million at a time; the counts meet by key, packed."""

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            keys, n = np.unique(np.concatenate(held) >> _CUT, return_counts=True)
            held, size = [], 0
            bounds = np.searchsorted(keys, (np.arange(buckets + 1, dtype=np.uint64) << np.uint64(24)) // np.uint64(buckets) << np.uint64(24))
            used = np.flatnonzero(np.diff(bounds))
            bodies = [
                press.compress(np.concatenate([_planes(np.diff(keys[a:b], prepend=np.uint64(0)), 8), _planes(n[a:b].astype(np.uint32), 4)]).tobytes())
                for a, b in zip(bounds[used].tolist(), bounds[used + 1].tolist())
            ]
            return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(bodies, pa.binary())], ["bucket", "body"])

        for _, data, offsets in K.text_slices(batches):
            for s in K.shingle_sets(data, offsets):
                held.append(s)
                size += len(s)
            if size > _FOLD:
                yield flush()
        if size:
            yield flush()

    @K.tidy
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bodies in _by_bucket(batches):
            keys, counts = [], []
            for body in bodies:
                raw = _opened(body)
                n = len(raw) // 12
                keys.append(np.cumsum(_unplaned(raw[: 8 * n], np.uint64), dtype=np.uint64))
                counts.append(_unplaned(raw[8 * n :], np.uint32))
            key, n = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
            by = np.argsort(key, kind="stable")
            key, n = key[by], n[by]
            at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            n = np.add.reduceat(n, at)
            yield pa.RecordBatch.from_arrays([pa.array(K.signed(key[at][n > 2])), pa.array(n[n > 2])], ["shingle", "n"])

    packed = docs.mapInArrow(run, "bucket int, body binary").repartition(tables.partitions(docs.sparkSession), "bucket")
    return packed.mapInArrow(total, "shingle long, n long")


def frequent_shingles(docs: DataFrame, shingles: int) -> tuple[np.ndarray, float]:
    """Frequent shingles, rarest first, and the mean list length beyond one.

    ``shingles`` is the number of all of them, over all documents."""
    found = tables.written(counted_shingles(docs, tables.partitions(docs.sparkSession)), "frequent")
    steps = found.groupBy(F.least("n", F.lit(10_000)).alias("n")).count().collect()  # at most 10,000 rows
    least, size = 10_001, 0
    for r in sorted(steps, key=lambda r: -r["n"]):
        if size + r["count"] > MOST_FREQUENT:
            break
        least, size = r["n"], size + r["count"]
    often = found.where(F.col("n") >= least).select("shingle", "n").toArrow()
    tables.drop(found)
    key, n = often.column("shingle").to_numpy(), often.column("n").to_numpy()
    return key[np.lexsort((key, n))].view(np.uint64), float((n.astype(np.float64) ** 2).sum() / max(1, shingles))


def _found_in(often_sorted: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each shingle stands among the frequent ones, and whether it does."""
    if not len(often_sorted):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    short = key >> _CUT
    at = np.minimum(np.searchsorted(often_sorted, short), len(often_sorted) - 1)
    return at, often_sorted[at] == short


class Packer:
    """Entries (key, node, tag, place), sorted and compressed by bucket for the exchange.

    Keys are hashes, so their upper bits choose the bucket; ``by`` stands in for
    keys that are to be dealt otherwise."""

    def __init__(self, buckets: int):
        self.buckets, self.parts, self.held = buckets, [], 0

    def add(self, key: np.ndarray, node: int, tag: int, place: np.ndarray, by: np.ndarray | None = None) -> None:
        self.parts.append((key, node, tag, place, key if by is None else by))
        self.held += len(key)

    def flush(self) -> pa.RecordBatch:
        import zstandard

        sizes = [len(p[0]) for p in self.parts]
        key, place, by = (np.concatenate([p[i] for p in self.parts]) for i in (0, 3, 4))
        owner = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
        node, tag = (np.array([p[i] for p in self.parts], np.int64) for i in (1, 2))
        self.parts, self.held = [], 0
        order = np.argsort(by)
        key, place, owner, by = key[order], place[order], owner[order], by[order]
        edges = np.searchsorted(by >> np.uint64(32), -(-(np.arange(self.buckets + 1, dtype=np.int64) << 32) // self.buckets).astype(np.uint64))
        used = np.flatnonzero(np.diff(edges))
        press = zstandard.ZstdCompressor(level=1)
        here, code = np.zeros(len(sizes), bool), np.zeros(len(sizes), np.uint32)
        bodies = []
        for a, b in zip(edges[used].tolist(), edges[used + 1].tolist()):
            here[:] = False
            here[owner[a:b]] = True
            own = np.flatnonzero(here)
            code[own] = np.arange(len(own), dtype=np.uint32)
            gaps = np.diff(key[a:b], prepend=np.uint64(0))
            head = np.array([b - a, len(own)], np.uint32).view(np.uint8)
            raw = [head, _planes(gaps, 8), _planes(code[owner[a:b]], 4), _planes(place[a:b], 4), node[own].view(np.uint8), _planes(tag[own], 8)]
            bodies.append(press.compress(np.concatenate(raw)))
        return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(bodies, pa.binary())], ["bucket", "body"])


def _opened(body: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)


def _unpacked(bodies: list[bytes]) -> tuple[np.ndarray, ...]:
    """(key, node, tag, place) of the entries of one bucket."""
    out: list[list[np.ndarray]] = [[], [], [], []]
    for body in bodies:
        raw = _opened(body)
        n, d = raw[:8].view(np.uint32).tolist()
        ends = np.cumsum([8, 8 * n, 4 * n, 4 * n, 8 * d, 8 * d])
        gaps, code, place, node, tag = (raw[a:b] for a, b in zip(ends[:-1], ends[1:]))
        code = _unplaned(code, np.uint32)
        columns = (np.cumsum(_unplaned(gaps, np.uint64), dtype=np.uint64), node.copy().view(np.int64)[code], _unplaned(tag, np.int64)[code], _unplaned(place, np.int32))
        for held, column in zip(out, columns):
            held.append(column)
    return tuple(np.concatenate(x) for x in out)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The bodies of each bucket that was dealt to this task, one bucket after the other."""
    held: dict[int, list[bytes]] = {}
    for batch in batches:
        for b, body in zip(batch.column("bucket").to_pylist(), batch.column("body").to_pylist()):
            held.setdefault(b, []).append(body)
    while held:
        yield held.popitem()[1]


def _postings(docs: DataFrame, shared, boundary: int, buckets: int, clashing: frozenset[int]) -> DataFrame:
    """(bucket, body): packed list entries.

    An entry is a key of 64 bits, the node, its size, and the key's place in
    the node's prefix (-1 for a subset of a light set)."""

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often_sorted, rank = shared.value
        packer = Packer(buckets)

        for _, data, offsets in K.text_slices(batches):
            for s in K.shingle_sets(data, offsets):
                n = len(s)
                if not n:
                    continue
                node = node_of(s, clashing)
                if n > boundary or 5 * n >= 4 * (boundary + 1):
                    at, hot = _found_in(often_sorted, s)
                    p, first, by = prefix(n), s, None
                    if hot.any():
                        rare = s[~hot]
                        first = np.concatenate([rare, s[hot][np.argsort(rank[at[hot]], kind="stable")]])
                        by = first[:p].copy()
                        salt = K.mix(np.array([node], np.int64).view(np.uint64)) % np.uint64(SALTS)
                        by[len(rare) :] = K.mix(by[len(rare) :] + salt)
                    packer.add(first[:p], node, n, np.arange(p, dtype=np.int32), by)
                if n <= boundary:
                    mixed = K.mix(s)
                    for k in subset_sizes(n, boundary):
                        keys = K.mix(mixed[subsets(n, k)].sum(1, dtype=np.uint64) + np.uint64(k))
                        packer.add(keys, node, n, np.full(len(keys), -1, np.int32))
            if packer.held >= _FLUSH:
                yield packer.flush()
        if packer.held:
            yield packer.flush()

    return docs.mapInArrow(run, "bucket int, body binary")


_LIST_NAMES = ["key", "salt", "node", "n", "place", "p_node", "p_n", "p_place"]


def _stars(key: np.ndarray, node: np.ndarray, size: np.ndarray, place: np.ndarray, lengths: np.ndarray, k: int) -> pa.RecordBatch:
    """Entries of long lists with the list's least node by the k-th order; salt is -1 there."""
    group = np.repeat(np.arange(len(lengths)), lengths)
    by = np.lexsort((K.mix(node.view(np.uint64) + np.uint64(k)), group))
    centre = np.repeat(by[np.cumsum(lengths) - lengths], lengths)
    use = (np.repeat(lengths, lengths) >= LONG) & (np.arange(len(node)) != centre)
    at, to = np.flatnonzero(use), centre[use]
    columns = [key.view(np.int64)[at], np.full(len(at), -1, np.int64), node[at], size[at], place[at].astype(np.int64), node[to], size[to], place[to].astype(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], _LIST_NAMES)


def _lists(postings: DataFrame, shared) -> DataFrame:
    """Entries on lists of at least two nodes, each with its list's least node.

    Rows: key, salt, node, n, place, and p_node, p_n, p_place of the least node.
    Lists of frequent shingles keep lone entries, since their salts meet later."""

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often_sorted, _ = shared.value
        for bodies in _by_bucket(batches):
            key, node, size, place = _unpacked(bodies)
            light = place < 0
            hot = _found_in(often_sorted, key)[1] & ~light
            salt = np.where(hot, K.mix(node.view(np.uint64)) % np.uint64(SALTS), np.uint64(0))
            by = np.lexsort((node, salt, light, key))
            key, node, size, place, salt, hot, light = (x[by] for x in (key, node, size, place, salt, hot, light))
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1]) | (light[1:] != light[:-1])
            key, node, size, place, salt, hot, light = (x[new] for x in (key, node, size, place, salt, hot, light))
            start = np.ones(len(key), bool)
            start[1:] = (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]) | (light[1:] != light[:-1])
            at = np.flatnonzero(start)
            lengths = np.diff(np.append(at, len(key)))
            pivot = np.repeat(at, lengths)
            keep = (np.repeat(lengths, lengths) > 1) | hot
            for k in range(1, CENTRES):
                yield _stars(key, node, size, place, lengths, k)
            columns = [key.view(np.int64), np.where(hot, salt, 255).astype(np.int64), node, size, place.astype(np.int64), node[pivot], size[pivot], place[pivot].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], _LIST_NAMES)

    dealt = postings.repartition(tables.partitions(postings.sparkSession), "bucket")
    return dealt.mapInArrow(run, "key long, salt long, node long, n long, place long, p_node long, p_n long, p_place long")


def _possible(n: str, place: str, m: str, other: str, boundary: int) -> Column:
    """Whether two entries of a list may belong to a link, by sizes and places.

    Entries of subsets (place -1) meet only each other; a pair of light sets is
    left to them.  Enough shingles must follow, if this key is the first that
    both share."""
    a, b, p, q = F.col(n), F.col(m), F.col(place), F.col(other)
    subset = (p < 0) & (q < 0)
    lists = (p >= 0) & (q >= 0) & (F.greatest(a, b) > boundary)
    room = F.least(a - F.greatest(p, F.lit(0)), b - F.greatest(q, F.lit(0)))
    return (subset | lists) & (5 * F.least(a, b) >= 4 * F.greatest(a, b)) & (9 * room >= 4 * (a + b))


def id_filter(ids: DataFrame) -> tuple[int, np.ndarray]:
    """(log2 of its bits, bitmap) of the hashed ``doc_id`` of ``ids``.

    It lets all ``ids`` pass and about one in 16 others.  It has 16 MB at most;
    when ids outnumber that it lets more pass, and the exact join behind does
    more of the work.  Its blocks are made on the executors."""
    bits = min(MOST_FILTER, max(LEAST_FILTER, (16 * max(1, ids.count()) - 1).bit_length()))

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            block, at = batch.column("block").to_numpy(), batch.column("at").to_numpy()
            for b in np.unique(block).tolist():
                own = blocks.setdefault(b, np.zeros(1 << FILTER_BLOCK, bool))
                own[at[block == b]] = True
        if blocks:
            yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int64()), pa.array([np.packbits(x, bitorder="little").tobytes() for x in blocks.values()], pa.binary())], ["block", "body"])

    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - bits)
    dealt = ids.select(F.shiftright(place, FILTER_BLOCK).alias("block"), place.bitwiseAND((1 << FILTER_BLOCK) - 1).alias("at"))
    dealt = dealt.repartition(tables.partitions(ids.sparkSession), "block")
    found = np.zeros((1 << (bits - FILTER_BLOCK), 1 << (FILTER_BLOCK - 3)), np.uint8)
    for r in dealt.mapInArrow(run, "block long, body binary").collect():
        found[r["block"]] = np.frombuffer(r["body"], np.uint8)
    return bits, found.reshape(-1)


def _few(docs: DataFrame, bits: int) -> DataFrame:
    return docs.select("doc_id", "text", F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - bits).alias("bit"))


def _let_through(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the rows that pass an ``id_filter``."""
    for batch in batches:
        at = batch.column("bit").to_numpy()
        yield from K.text_slices(iter([batch.filter(pa.array((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))]))


def set_bodies(docs: DataFrame, ids: DataFrame, clashing: frozenset[int]) -> DataFrame:
    """(node, n, body) of the nodes in ``ids`` (node, doc_id), as a written table.

    Sets are made where the documents are read, behind a filter of bounded size,
    so the texts themselves are never shuffled."""
    bits, bitmap = id_filter(ids)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in _let_through(batches, shared.value):
            sets = list(K.shingle_sets(data, offsets))
            columns = [pa.array([node_of(s, clashing) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *columns], ["doc_id", "node", "n", "body"])

    made = _few(docs, bits).mapInArrow(run, "doc_id long, node long, n long, body binary")
    made = made.join(ids.select("doc_id", "node"), ["doc_id", "node"], "left_semi").dropDuplicates(["node"])
    bodies = tables.written(made.select("node", "n", "body"), "sets")
    shared.destroy()
    return bodies


def shared_halves(docs: DataFrame, ids: DataFrame, clashing: frozenset[int]) -> DataFrame:
    """(node, shared): how many shingles of its half each node of ``ids`` shares with another of them.

    Never too few: what else the filter of ids lets through only adds to it.
    Nodes that share nothing are left out."""
    bits, bitmap = id_filter(ids)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    buckets = BUCKETS * tables.partitions(docs.sparkSession)

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(buckets)
        for _, data, offsets in _let_through(batches, shared.value):
            for s in K.shingle_sets(data, offsets):
                node, half = node_of(s, clashing), _half(s) >> _CUT
                packer.add(half, node, node, np.zeros(len(half), np.int32), half << _CUT)
            if packer.held >= _FLUSH:
                yield packer.flush()
        if packer.held:
            yield packer.flush()

    found = tables.written(_shares(_few(docs, bits).mapInArrow(run, "bucket int, body binary")), "halves")
    shared.destroy()
    return found


def shared_wholes(sets: DataFrame) -> DataFrame:
    """(node, shared): how many shingles each node of ``sets`` shares with a node of another component."""
    buckets = BUCKETS * tables.partitions(sets.sparkSession)

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(buckets)
        for batch in batches:
            for node, component, body in zip(batch.column("node").to_pylist(), batch.column("component").to_pylist(), batch.column("body")):
                s = np.frombuffer(body.as_buffer(), np.uint64) >> _CUT
                packer.add(s, node, component, np.zeros(len(s), np.int32), s << _CUT)
                if packer.held >= _FLUSH:
                    yield packer.flush()
        if packer.held:
            yield packer.flush()

    return _shares(sets.select("node", "component", "body").mapInArrow(run, "bucket int, body binary"))


def _shares(packed: DataFrame) -> DataFrame:
    """(node, shared) of packed (shingle, node, tag): shingles that stand under two tags.

    What a task counts of its shingles goes on packed, too, and is summed by node."""
    n_parts = tables.partitions(packed.sparkSession)

    @K.tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        counts = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for bodies in _by_bucket(batches):
            key, node, tag, _ = _unpacked(bodies)
            by = np.lexsort((node, tag, key))
            key, node, tag = key[by], node[by], tag[by]
            new = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
            key, node, tag = key[new], node[new], tag[new]
            at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            lengths = np.diff(np.append(at, len(key)))
            two = np.repeat(tag[at] != tag[at + lengths - 1], lengths)
            counts = _summed(np.append(counts[0], node[two]), np.append(counts[1], np.ones(int(two.sum()), np.int64)))
        names, n = counts
        to = (K.mix(names.view(np.uint64)) % np.uint64(n_parts)).astype(np.int64)
        by = np.argsort(to, kind="stable")
        edges = np.searchsorted(to[by], np.arange(n_parts + 1))
        used = np.flatnonzero(np.diff(edges))
        press = zstandard.ZstdCompressor(level=1)
        bodies = [press.compress(np.concatenate([names[by[a:b]], n[by[a:b]]]).tobytes()) for a, b in zip(edges[used].tolist(), edges[used + 1].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(bodies, pa.binary())], ["bucket", "body"])

    @K.tidy
    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bodies in _by_bucket(batches):
            pairs = [_opened(x).view(np.int64).reshape(2, -1) for x in bodies]
            names, n = _summed(*(np.concatenate([x[k] for x in pairs]) for k in (0, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(n)], ["node", "shared"])

    counted = packed.repartition(n_parts, "bucket").mapInArrow(count, "bucket int, body binary")
    return counted.repartition(n_parts, "bucket").mapInArrow(total, "node long, shared long")


def _summed(names: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each name once, with the sum of its numbers."""
    by = np.argsort(names, kind="stable")
    names, n = names[by], n[by]
    at = np.flatnonzero(np.append(True, names[1:] != names[:-1])[: len(names)])
    return names[at], np.add.reduceat(n, at) if len(at) else n


def bounded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b) of the ``pairs`` that may link by their bitmaps, as a written table."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    maps = nodes.select("node", "n_shingles", "bitmap").join(wanted, "node", "left_semi").dropDuplicates(["node"])
    maps = tables.written(maps, "bitmaps")

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column("n").to_numpy() + batch.column("m").to_numpy()
            d = np.array([least_difference(x, y) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())], np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(total - d >= 2 * ((4 * total + 8) // 9)))

    joined = pairs.join(maps.select(F.col("node").alias("a"), F.col("n_shingles").alias("n"), F.col("bitmap").alias("x")), "a")
    joined = joined.join(maps.select(F.col("node").alias("b"), F.col("n_shingles").alias("m"), F.col("bitmap").alias("y")), "b")
    near = tables.written(joined.select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long"), "near")
    tables.drop(maps)
    return near


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` that link, by their whole ``sets``; as a written table."""

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= 80 * (len(s) + len(t) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("body").alias("x")), "a")
    joined = joined.join(sets.select(F.col("node").alias("b"), F.col("body").alias("y")), "b")
    return tables.written(joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")


def with_component(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with ``node``, and its component: the node itself where it has no link yet."""
    return rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def spanning(entries: DataFrame, found: DataFrame) -> DataFrame:
    """The ``entries`` of lists that hold two components, with these and the list's length."""
    entries = tables.written(with_component(entries, found), "entries")
    spans = entries.groupBy("key", "subset").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("length"))
    spans = tables.written(spans.where("lo < hi").select("key", "subset", "length"), "spans")
    open_ = tables.written(entries.join(spans, ["key", "subset"]), "open")
    tables.drop(entries, spans)
    return open_


def open_sets(entries: DataFrame, docs: DataFrame, nodes: DataFrame, clashing: frozenset[int]) -> DataFrame:
    """(node, n, body) of the nodes on open lists that share enough of their half.

    Of a link's sets each misses at most n - ceil(0.8 n) of its shingles in the other."""
    first = nodes.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n"), F.min("half").alias("half"))
    ids = tables.written(first.join(entries.select("node").distinct(), "node", "left_semi"), "open-ids")
    halves = shared_halves(docs, ids, clashing)
    kept = ids.join(halves, "node", "left").where("5 * (half - coalesce(shared, 0L)) <= n")
    kept = tables.written(kept.select("node", "doc_id"), "kept-ids")
    sets = set_bodies(docs, kept, clashing)
    tables.drop(ids, halves, kept)
    return sets


def still_open(sets: DataFrame, found: DataFrame) -> DataFrame:
    """(node, shared) of the ``sets`` that other components share enough of, as a written table.

    Twice over: what goes first may have been what another shared with."""
    table = tables.written(with_component(sets, found), "whole-sets")

    def enough(own: DataFrame) -> DataFrame:
        shares = own.select("node", "n").join(shared_wholes(own), "node")
        return tables.written(shares.where("5 * shared >= 4 * n").select("node", "shared"), "shares")

    first = enough(table)
    smaller = tables.written(table.join(first, "node", "left_semi"), "whole-sets")
    last = enough(smaller)
    tables.drop(table, first, smaller)
    return last


def chained(entries: DataFrame, boundary: int, turn: int) -> DataFrame:
    """(a, b) of entries of two components that are neighbours in the ``turn``-th order of their list."""
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("length") / CHAIN))
    order = Window.partitionBy("key", "subset", "part").orderBy(F.xxhash64("node", "key", F.lit(turn)), "node")
    after = F.lead(F.struct("node", "n", "place", "component", "shared")).over(order).alias("after")
    pairs = entries.withColumn("part", part).select("node", "n", "place", "component", "shared", after).where("after.component != component")
    pairs = pairs.select("node", "n", "place", "shared", F.col("after.node").alias("next"), F.col("after.n").alias("m"), F.col("after.place").alias("other"), F.col("after.shared").alias("shared2"))
    pairs = pairs.where(_possible("n", "place", "m", "other", boundary)).where("9 * least(shared, shared2) >= 4 * (n + m)")
    return pairs.select(F.least("node", "next").alias("a"), F.greatest("node", "next").alias("b")).distinct()


def _may_link(x: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, boundary: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of entries i and j of the same lists may link, and the shingles that differ at least."""
    a, b, p, q = x["n"][i], x["n"][j], x["place"][i], x["place"][j]
    need_ = (4 * (a + b) + 8) // 9
    may = (x["component"][i] != x["component"][j]) & (np.minimum(x["shared"][i], x["shared"][j]) >= need_)
    may &= (np.minimum(a - np.maximum(p, 0), b - np.maximum(q, 0)) >= need_) & (5 * np.minimum(a, b) >= 4 * np.maximum(a, b))
    may &= (p < 0) | (np.maximum(a, b) > boundary)
    may &= (x["u"][i] == x["v"][i]) | (x["block"][i] != x["block"][j])
    at = np.flatnonzero(may)
    apart = np.bitwise_count(x["sketch"][i[at]] ^ x["sketch"][j[at]]).sum(1, dtype=np.int64)
    near = a[at] + b[at] - apart >= 2 * need_[at]
    return at[near], apart[near]


def sketches(nodes: DataFrame) -> DataFrame:
    """(node, sketch): each node's bitmap, folded to ``LEAST_BITS``."""

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            small = [folded(x, LEAST_BITS // 8).tobytes() for x in batch.column("bitmap").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(small, pa.binary())], ["node", "sketch"])

    return nodes.select("node", "bitmap").mapInArrow(run, "node long, sketch binary").groupBy("node").agg(F.first("sketch").alias("sketch"))


def candidates(entries: DataFrame, boundary: int) -> DataFrame:
    """(a, b, apart) of pairs across components that may link, from blocks of the lists.

    ``entries`` has key, subset, node, n, place, component, length, shared and
    sketch.  A long list is cut into blocks by a hash of the node, and each pair
    of its blocks is a unit of its own; only what passes all bounds is given
    out, once for each task.  ``apart`` is the least share of shingles in one
    set alone, in millionths."""
    blocks = F.ceil(F.col("length") / BLOCK)
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    units = entries.withColumn("block", own).withColumn("with", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    units = units.select(
        F.xxhash64("key", "subset", F.least("block", "with"), F.greatest("block", "with")).alias("unit"), "key", F.col("subset").cast("int").alias("subset"),
        F.least("block", "with").alias("u"), F.greatest("block", "with").alias("v"), "block", "node", "n", "place", "component", "shared", "sketch",
    )
    unit = ["unit", "key", "subset", "u", "v"]
    dealt = units.repartition(tables.partitions(entries.sparkSession), "unit").sortWithinPartitions(*unit)

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], int] = {}

        def give() -> pa.RecordBatch:
            ends, apart = np.array(list(found), np.int64).reshape(-1, 2), np.array(list(found.values()), np.int64)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy()), pa.array(apart)], ["a", "b", "apart"])

        def marks(rows: pa.Table) -> np.ndarray:
            table = np.stack([rows.column(c).to_numpy() for c in unit], 1)
            return np.flatnonzero(np.append(True, (table[1:] != table[:-1]).any(1)))

        def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            """All pairs within units, about a million at a time, looked at and not kept."""
            start = marks(rows)
            x = {c: rows.column(c).to_numpy() for c in ("node", "n", "place", "component", "shared", "block", "u", "v")}
            x["sketch"] = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint64).reshape(len(x["node"]), -1)
            end = np.repeat(np.append(start[1:], len(x["node"])), np.diff(np.append(start, len(x["node"]))))
            later = end - np.arange(len(end)) - 1
            sums = np.append(0, np.cumsum(later))
            at = 0
            while at < len(later):
                stop = max(at + 1, int(np.searchsorted(sums, sums[at] + 1_000_000, "right")) - 1)
                i = np.repeat(np.arange(at, stop), later[at:stop])
                j = i + 1 + np.arange(len(i)) - np.repeat(sums[at:stop] - sums[at], later[at:stop])
                may, apart = _may_link(x, i, j, boundary)
                i, j, at = i[may], j[may], stop
                one, two = x["node"][i], x["node"][j]
                share = 1_000_000 * apart // (x["n"][i] + x["n"][j])
                found.update(zip(zip(np.minimum(one, two).tolist(), np.maximum(one, two).tolist()), share.tolist()))
                if len(found) >= 200_000:
                    yield give()

        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = (pa.concat_tables([held, rows]) if held is not None else rows).combine_chunks()
            last = int(marks(rows)[-1]) if rows.num_rows else 0
            if last:
                yield from pairs(rows.slice(0, last))
            held = rows.slice(last)
        if held is not None and held.num_rows:
            yield from pairs(held)
        if found:
            yield give()

    return dealt.mapInArrow(run, "a long, b long, apart long").groupBy("a", "b").agg(F.max("apart").alias("apart"))


def across(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The ``pairs`` of two components, with these as ca and cb."""
    ends = {side: found.select(F.col("node").alias(side), F.col("component").alias(f"c{side}")) for side in "ab"}
    both = pairs.join(ends["a"], "a", "left").join(ends["b"], "b", "left")
    both = both.withColumn("ca", F.coalesce("ca", "a")).withColumn("cb", F.coalesce("cb", "b"))
    return both.where("ca != cb").select(*pairs.columns, "ca", "cb")


def nearest(pairs: DataFrame) -> DataFrame:
    """The (a, b) nearest to each component's other side, ties by their names."""
    row = F.struct("apart", "a", "b").alias("p")
    ends = pairs.select(F.col("ca").alias("c"), row).unionByName(pairs.select(F.col("cb").alias("c"), row))
    return ends.groupBy("c").agg(F.min("p").alias("p")).select("p.a", "p.b").distinct()


def joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``found`` after more ``links``.  Both tables are dropped."""
    stars = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
    more = components(stars.unionByName(links.select("a", "b")))
    tables.drop(found, links)
    return more


def grown(pairs: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """Components after all links among the written ``pairs``, which is dropped.

    Rounds of each component's nearest pair come first; then what still spans
    two components is verified."""
    for _ in range(NEAREST):
        crossing = tables.written(across(pairs, found), "across")
        tried = tables.written(nearest(crossing), "nearest")
        found = joined(found, linked(tried, sets))
        rest = tables.written(crossing.select("a", "b", "apart").join(tried, ["a", "b"], "left_anti"), "pairs")
        tables.drop(pairs, crossing, tried)
        pairs = rest
    crossing = tables.written(across(pairs, found), "across")
    found = joined(found, linked(crossing, sets))
    tables.drop(pairs, crossing)
    return found


def first_components(lists: DataFrame, docs: DataFrame, nodes: DataFrame, boundary: int, clashing: frozenset[int]) -> DataFrame:
    """Components after each entry of the ``lists`` has met their centres."""
    star = lists.where("node != p_node").where(_possible("n", "place", "p_n", "p_place", boundary))
    star = star.select(F.least("p_node", "node").alias("a"), F.greatest("p_node", "node").alias("b"))
    heads = lists.where("salt BETWEEN 0 AND 254").select("key", F.struct("p_node", "p_n", "p_place").alias("p")).distinct()
    least = tables.written(heads.groupBy("key").agg(F.min("p").alias("q")), "heads")
    heads = heads.join(least, "key").select(
        F.col("p.p_node").alias("b"), F.col("p.p_n").alias("n"), F.col("p.p_place").alias("place"),
        F.col("q.p_node").alias("a"), F.col("q.p_n").alias("m"), F.col("q.p_place").alias("other"),
    )
    heads = heads.where("a != b").where(_possible("n", "place", "m", "other", boundary))
    heads = heads.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = tables.written(star.unionByName(heads).distinct(), "pairs")
    near = bounded(pairs, nodes)
    wanted = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
    ids = tables.written(nodes.groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(wanted, "node", "left_semi"), "wanted")
    sets = set_bodies(docs, ids, clashing)
    links = linked(near, sets)
    found = components(links)
    tables.drop(least, pairs, near, ids, sets, links)
    return found


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs``.

    ``component_id`` is the smallest id reachable by links, the own included.
    Null and empty texts, and texts of white space alone, have no shingles and
    link with nothing, not even each other.  Ids are integers; a row with a null
    id is left out.  Repeated ids link as separate texts do and share the
    smaller component.  An empty table gives an empty one.  Shingles are
    compared by 64-bit hashes, sets by 128 bits."""
    spark = docs.sparkSession
    docs = _named(docs, id_col, text_col).where("doc_id IS NOT NULL")
    nodes = tables.written(document_nodes(docs), "nodes")
    clashing = clashing_names(nodes)
    if clashing:
        nodes = nodes.withColumn("node", F.when(F.col("node").isin(*clashing), F.col("twin")).otherwise(F.col("node")))
    small = nodes.where(F.col("n_shingles").between(1, LARGEST_LIGHT + LARGEST_LIGHT // 4)).groupBy("n_shingles").count()
    sizes = {r["n_shingles"]: r["count"] for r in small.collect()}
    often, recurrence = frequent_shingles(docs, nodes.agg(F.sum("n_shingles")).first()[0] or 0)
    boundary = chosen_boundary(sizes, recurrence)
    order = np.argsort(often)
    shared = spark.sparkContext.broadcast((often[order], order))
    lists = tables.written(_lists(_postings(docs, shared, boundary, BUCKETS * tables.partitions(spark), clashing), shared), "lists")
    shared.destroy()
    found = first_components(lists, docs, nodes, boundary, clashing)

    entries = lists.where("salt >= 0").select("key", (F.col("place") < 0).alias("subset"), "node", "n", "place")
    first = spanning(entries, found)
    tables.drop(lists)
    sets = open_sets(first, docs, nodes, clashing)
    shares = still_open(sets, found)
    entries = tables.written(first.select("key", "subset", "node", "n", "place").join(shares, "node"), "left")
    tables.drop(first)
    for turn in range(ROUNDS):
        open_ = spanning(entries, found)
        tried = tables.written(chained(open_, boundary, turn), "chain")
        found = joined(found, linked(tried, sets))
        tables.drop(open_, tried)
    again = still_open(sets.join(shares, "node", "left_semi"), found)
    open_ = spanning(entries.drop("shared").join(again, "node"), found)
    small = sketches(nodes.join(again.select("node"), "node", "left_semi"))
    pairs = tables.written(candidates(open_.join(small, "node"), boundary), "pairs")
    tables.drop(entries, open_, shares, again)
    found = grown(pairs, found, sets)
    tables.drop(sets)
    return _labelled(nodes, found)


def _labelled(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Puts the smallest document id of each component on its documents."""
    named = tables.written(with_component(nodes.where("n_shingles > 0").select("doc_id", "n_shingles", "node"), found), "named")
    tables.drop(found)
    firsts = tables.written(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "firsts")
    linked_ = named.join(firsts, "component").select("doc_id", "n_shingles", "component_id")
    return linked_.unionByName(nodes.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: that of the smallest id.

    Rows with a null id stay.  Columns stay as they are, whatever their names."""
    groups = ngram_jaccard_join(docs, id_col, text_col)
    gone = tables.written(groups.where("doc_id != component_id").select("doc_id"), "gone")
    gone = gone.distinct().withColumnRenamed("doc_id", tables.free_name(docs, "_gone"))
    return docs.join(gone, F.col(f"`{id_col}`") == F.col(gone.columns[0]), "left_anti")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(tables.read(spark, sf_dir, "documents").select("doc_id", "text"))
