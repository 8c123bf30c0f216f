"""MinHash near-dedup with sequential Bayesian verification.

A document is the set of its distinct 3-word shingles; documents with equal sets
are one *node*.  Two nodes link when 100 * |A n B| >= 85 * |A u B|.

A node has 128 minimum hashes, of which 16 bits each stay as its *signature*.
Bands of 4 of them make 32 keys, and nodes that share a key are candidates: a
pair at the threshold shares none with probability (1 - 0.85**4)**32 < 1e-10.

Candidates are verified in sequence.  Signatures are compared 32 hashes at a
time; with a uniform prior the posterior of the similarity after s agreements in
m is Beta(s + 1, m - s + 1), and a pair goes as soon as the posterior leaves the
threshold a probability below ``MISS``.  (Hashes agree by chance once in 65536,
which the threshold on agreements counts in.)  Survivors are compared on their whole sets,
so every link is exact.

A bucket never emits all its pairs:

1. Each node meets, by a few orders of all nodes, the least node that shares a
   bucket with it.  Survivors are verified, components are formed.
2. Buckets that span two components stay open, and each of their nodes meets the
   least one of another component; components grow.
3. The nodes of what is still open get a parity bitmap of their whole sets: its
   bits that differ are a lower bound of the shingles in one of two sets alone.
   Buckets are cut into blocks, pairs of two components are compared inside the
   tasks, by batches of signatures and then by bitmaps, and only survivors leave
   them, each from the first band that its nodes share.  The nearest pairs of each
   component are verified first, then what still spans two.

No candidate pair of two components goes unseen, and a group of near copies
costs a star.  A bucket of many nodes of which no two link is compared in blocks
of ``BLOCK`` by ``BLOCK`` nodes: its time grows with the square of its nodes,
its memory does not, and what it emits are pairs that link or all but do.  Only
of sets with far more shingles than a bitmap has bits more pairs come through.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdance.llm import kernels as K
from verdance.llm import tables
from verdance.llm.components import components
from verdance.llm.ngram_jaccard import Packer, _by_bucket, _few, _labelled, _let_through, _named, _unpacked, across, clashing_names, id_filter, joined, names_of, nearest, node_of, with_component

WIDTH, PERCENT = 3, 85
#: Hashes of a node, of a band and of a batch, and bits of a parity bitmap.
HASHES, ROWS, BATCH, BITS = 128, 4, 32, 4096
BANDS = HASHES // ROWS
#: Probability that the posterior may leave the threshold when a pair goes.
MISS = 1e-8
#: Orders by which a node meets the least of its buckets, nodes of a block, and entries that a task packs at once.
ORDERS, BLOCK, FLUSH = 4, 1024, 400_000
#: Nodes that a task remembers, to send equal ones once.
SEEN = 200_000


def least_agreements(miss: float = MISS, percent: int = PERCENT) -> list[int]:
    """For each batch, after which m hashes are compared, the least agreements with which a pair stays.

    P(Beta(s + 1, m - s + 1) >= t) is P(Binomial(m + 1, t) <= s)."""
    t = percent / 100 + (1 - percent / 100) / 65536
    found = []
    for m in range(BATCH, HASHES + 1, BATCH):
        below, s = 0.0, -1
        while below < miss:
            s += 1
            below += exp(lgamma(m + 2) - lgamma(s + 1) - lgamma(m + 2 - s) + s * log(t) + (m + 1 - s) * log(1 - t))
        found.append(s)
    return found


LEAST = least_agreements()


def _factors() -> tuple[np.ndarray, np.ndarray]:
    x = K.mix(np.arange(1, 2 * HASHES + 1, dtype=np.uint64))
    return x[:HASHES] | np.uint64(1), x[HASHES:]


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, HASHES) of minimum hashes, 16 bits of each, of sets that are not empty."""
    x = np.concatenate(sets)
    at = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), HASHES), np.uint32)
    high, held = np.uint64(32), np.empty_like(x)
    for k, (a, b) in enumerate(zip(*_factors())):
        np.multiply(x, a, out=held)
        held += b
        held >>= high
        out[:, k] = np.minimum.reduceat(held.astype(np.uint32), at)
    return out.astype(np.uint16)


def band_keys(least: np.ndarray) -> np.ndarray:
    """(sets, BANDS) of 64-bit keys; equal rows of equal bands have equal keys."""
    bands = np.ascontiguousarray(least).view(np.uint64)
    return K.mix(K.mix(bands) + np.arange(1, BANDS + 1, dtype=np.uint64))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, node, twin, signature, keys) of each row of (doc_id, text).

    Signature and keys are null where the set is empty."""

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in K.text_slices(batches):
            sets = list(K.shingle_sets(data, offsets, WIDTH))
            names = [names_of(s) for s in sets]
            full = [k for k, s in enumerate(sets) if len(s)]
            marks: list[bytes | None] = [None] * len(sets)
            keys = list(marks)
            if full:
                least = minima([sets[k] for k in full])
                for k, mark, key in zip(full, least, band_keys(least)):
                    marks[k], keys[k] = mark.tobytes(), key.tobytes()
            columns = [[len(s) for s in sets], [a for a, _ in names], [b for _, b in names]]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns), pa.array(marks, pa.binary()), pa.array(keys, pa.binary())],
                ["doc_id", "n_shingles", "node", "twin", "signature", "keys"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, node long, twin long, signature binary, keys binary")


def _packed_keys(nodes: DataFrame, buckets: int) -> DataFrame:
    """Packed (key, node, size, band) of all bands; a node that a task has sent lately it sends not again."""

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, seen, bands = Packer(buckets), set(), np.arange(BANDS, dtype=np.int32)
        for batch in batches:
            for node, n, keys in zip(batch.column("node").to_pylist(), batch.column("n_shingles").to_pylist(), batch.column("keys").to_pylist()):
                if node in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                packer.add(np.frombuffer(keys, np.uint64), node, n, bands)
                if packer.held >= FLUSH:
                    yield packer.flush()
        if packer.held:
            yield packer.flush()

    return nodes.where("keys IS NOT NULL").select("node", "n_shingles", "keys").mapInArrow(run, "bucket int, body binary")


def _order(node: np.ndarray, k: int) -> np.ndarray:
    """Places of nodes in the k-th order of all of them."""
    return (K.mix(node.view(np.uint64) + np.uint64(k)) >> np.uint64(1)).astype(np.int64)


def bucket_entries(nodes: DataFrame) -> DataFrame:
    """(key, band, node, n, least) of the buckets of two nodes or more.

    ``least`` has, for each order, the place and the name of the bucket's least
    node; null where that is the own one, or of a size that cannot link."""
    parts = tables.partitions(nodes.sparkSession)

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bodies in _by_bucket(batches):
            key, node, n, band = _unpacked(bodies)
            by = np.lexsort((node, key))
            key, node, n, band = key[by], node[by], n[by], band[by]
            new = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
            key, node, n, band = key[new], node[new], n[new], band[new]
            lengths = np.diff(np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)))
            keep = np.repeat(lengths, lengths) > 1
            key, node, n, band, lengths = key[keep], node[keep], n[keep], band[keep], lengths[lengths > 1]
            if not len(key):
                continue
            begin, group = np.cumsum(lengths) - lengths, np.repeat(np.arange(len(lengths)), lengths)
            columns = []
            for k in range(ORDERS):
                place = _order(node, k)
                first = np.repeat(np.lexsort((place, group))[begin], lengths)
                may = (first != np.arange(len(node))) & (100 * np.minimum(n[first], n) >= PERCENT * np.maximum(n[first], n))
                columns.append(pa.StructArray.from_arrays([pa.array(place[first]), pa.array(node[first])], ["place", "node"], mask=pa.array(~may)))
            yield pa.RecordBatch.from_arrays([pa.array(K.signed(key)), pa.array(band.astype(np.int32)), pa.array(node), pa.array(n), *columns], ["key", "band", "node", "n", *(f"c{k}" for k in range(ORDERS))])

    dealt = _packed_keys(nodes, 3 * parts).repartition(parts, "bucket")
    return dealt.mapInArrow(run, "key long, band int, node long, n long, " + ", ".join(f"c{k} struct<place: long, node: long>" for k in range(ORDERS)))


def stars(entries: DataFrame) -> DataFrame:
    """(a, b): each node with the least of its buckets, by each order."""
    least = entries.groupBy("node").agg(*[F.min(f"c{k}").alias(f"c{k}") for k in range(ORDERS)])
    met = least.select("node", F.explode(F.array_compact(F.array(*[F.col(f"c{k}.node") for k in range(ORDERS)]))).alias("to"))
    return met.select(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b")).distinct()


def agreeing(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of two arrays of signatures stay to the end, and their agreements.

    Signatures are compared a batch at a time; pairs below ``LEAST`` go before the next."""
    alive, count = np.arange(len(x)), np.zeros(len(x), np.int64)
    for k, least in enumerate(LEAST):
        part = slice(k * BATCH, (k + 1) * BATCH)
        count = count + (x[alive, part] == y[alive, part]).sum(1)
        alive, count = alive[count >= least], count[count >= least]
    return alive, count


def _rows(column: pa.Array, kind: type = np.uint16) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def parity(s: np.ndarray) -> bytes:
    """Whether each of ``BITS`` bits is the hash of an odd number of the set's shingles."""
    return np.packbits((np.bincount((K.mix(s) & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1).astype(bool)).tobytes()


def parities(sets: DataFrame) -> DataFrame:
    """(node, parity) of (node, body)."""

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [parity(np.frombuffer(x.as_buffer(), np.uint64)) for x in batch.column("body")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(bits, pa.binary())], ["node", "parity"])

    return sets.mapInArrow(run, "node long, parity binary")


def surviving(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` that the posterior leaves, as a written table.

    ``marks`` has (node, signature), each node once."""

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alive, _ = agreeing(_rows(batch.column("x")), _rows(batch.column("y")))
            yield batch.select(["a", "b"]).take(pa.array(alive))

    both = pairs.select("a", "b").join(marks.select(F.col("node").alias("a"), F.col("signature").alias("x")), "a")
    both = both.join(marks.select(F.col("node").alias("b"), F.col("signature").alias("y")), "b")
    return tables.written(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "survivors")


def whole_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, clashing: frozenset[int]) -> DataFrame:
    """(node, body) of the nodes in ``wanted`` (node), as a written table.

    Sets are made where the documents are read, behind a filter of bounded size."""
    first = nodes.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    ids = tables.written(first.join(wanted, "node", "left_semi"), "wanted")
    bits, bitmap = id_filter(ids)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in _let_through(batches, shared.value):
            sets = list(K.shingle_sets(data, offsets, WIDTH))
            columns = [pa.array([node_of(s, clashing) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *columns], ["doc_id", "node", "body"])

    made = _few(docs, bits).mapInArrow(run, "doc_id long, node long, body binary").join(ids, ["doc_id", "node"], "left_semi")
    bodies = tables.written(made.dropDuplicates(["node"]).select("node", "body"), "sets")
    shared.destroy()
    tables.drop(ids)
    return bodies


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose whole sets link, as a written table."""

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(s) + len(t) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("body").alias("x")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("body").alias("y")), "b")
    return tables.written(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, marks: DataFrame, clashing: frozenset[int]) -> DataFrame:
    """The links among the written ``pairs``, which is dropped."""
    left = surviving(pairs, marks)
    sets = whole_sets(docs, nodes, ends(left), clashing)
    links = linked(left, sets)
    tables.drop(pairs, left, sets)
    return links


def grown(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more ``links``, which may be none.  Both tables are dropped where others replace them."""
    if links.isEmpty():
        tables.drop(links)
        return found
    return joined(found, links)


def open_entries(entries: DataFrame, found: DataFrame) -> DataFrame:
    """(key, band, node, n, component, length, lo, hi) of the buckets that span two components, as a written table."""
    own = tables.written(with_component(entries.select("key", "band", "node", "n"), found), "entries")
    spans = own.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("length"))
    spans = tables.written(spans.where("lo < hi"), "spans")
    open_ = tables.written(own.join(spans, "key"), "open")
    tables.drop(own, spans)
    return open_


def hooks(entries: DataFrame) -> DataFrame:
    """(a, b): each node of open buckets with the least one of another component that shares a bucket, by two orders.

    Of each bucket only the least node of its first and of its last component is looked at."""
    size = 100 * F.least("n", "m") >= PERCENT * F.greatest("n", "m")
    place = F.xxhash64("node", F.lit(1))
    heads = entries.where("component = lo OR component = hi").groupBy("key", "component").agg(F.min(F.struct(place.alias("place"), F.col("node").alias("to"), F.col("n").alias("m"))).alias("h"))
    met = entries.select("key", "node", "n", F.col("component").alias("own")).join(heads, "key").where("component != own")
    met = met.select("node", "n", "component", "own", F.col("h.place").alias("place"), F.col("h.to").alias("to"), F.col("h.m").alias("m")).where(size)
    least = met.groupBy("node").agg(F.min(F.struct("place", "to"))["to"].alias("one"), F.max(F.struct("place", "to"))["to"].alias("two"))
    both = least.select("node", F.explode(F.array("one", "two")).alias("to"))
    return both.select(F.least("node", "to").alias("a"), F.greatest("node", "to").alias("b")).distinct()


def block_pairs(entries: DataFrame) -> DataFrame:
    """(a, b, apart) of pairs of two components that share a bucket and survive.

    A long bucket is cut into blocks by a hash of the node; each pair of its
    blocks is a unit of its own, and pairs are compared there, a bounded number at
    a time.  A pair leaves from the first band on which its signatures agree, so
    once.  ``apart`` counts the hashes that disagree."""
    blocks = F.ceil(F.col("length") / BLOCK)
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    units = entries.withColumn("block", own).withColumn("with", F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))))
    units = units.select("key", F.least("block", "with").alias("u"), F.greatest("block", "with").alias("v"), "band", "block", "node", "n", "component", "signature", "parity")
    unit = ["key", "u", "v"]
    dealt = units.repartition(tables.partitions(entries.sparkSession), *unit).sortWithinPartitions(*unit)

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], int] = {}

        def give() -> pa.RecordBatch:
            pair = np.array(list(found), np.int64).reshape(-1, 2)
            apart = np.array(list(found.values()), np.int64)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), pa.array(apart)], ["a", "b", "apart"])

        def marks(rows: pa.Table) -> np.ndarray:
            table = np.stack([rows.column(c).to_numpy() for c in unit], 1)
            return np.flatnonzero(np.append(True, (table[1:] != table[:-1]).any(1)))

        def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            start = marks(rows)
            node, n, component, band, block, u, v = (rows.column(c).to_numpy() for c in ("node", "n", "component", "band", "block", "u", "v"))
            signature, bits = _rows(rows.column("signature")), _rows(rows.column("parity"), np.uint64)
            end = np.repeat(np.append(start[1:], len(node)), np.diff(np.append(start, len(node))))
            later = end - np.arange(len(end)) - 1
            sums = np.append(0, np.cumsum(later))
            at = 0
            while at < len(later):
                stop = max(at + 1, int(np.searchsorted(sums, sums[at] + 500_000, "right")) - 1)
                i = np.repeat(np.arange(at, stop), later[at:stop])
                j = i + 1 + np.arange(len(i)) - np.repeat(sums[at:stop] - sums[at], later[at:stop])
                may = (component[i] != component[j]) & (100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j]))
                may &= (u[i] == v[i]) | (block[i] != block[j])
                i, j, at = i[may], j[may], stop
                for k in range(0, len(i), 100_000):
                    one, two = i[k : k + 100_000], j[k : k + 100_000]
                    alive, count = agreeing(signature[one], signature[two])
                    one, two = one[alive], two[alive]
                    first = (signature[one] == signature[two]).reshape(-1, BANDS, ROWS).all(2).argmax(1)
                    one, two, count = (c[first == band[one]] for c in (one, two, count))
                    alone = np.bitwise_count(bits[one] ^ bits[two]).sum(1, dtype=np.int64)
                    near = (100 + PERCENT) * alone <= (100 - PERCENT) * (n[one] + n[two])
                    x, y, count = node[one[near]], node[two[near]], count[near]
                    found.update(zip(zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist()), (HASHES - count).tolist()))
                    if len(found) >= 200_000:
                        yield give()

        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = (pa.concat_tables([held, rows]) if held is not None else rows).combine_chunks()
            last = int(marks(rows)[-1])
            if last:
                yield from pairs(rows.slice(0, last))
            held = rows.slice(last)
        if held is not None:
            yield from pairs(held)
        if found:
            yield give()

    return dealt.mapInArrow(run, "a long, b long, apart long")


def minhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs``.

    ``component_id`` is the smallest id reachable by links, the own included, and
    ``kept`` says whether it is the own.  Words are runs without blanks, A-Z
    lower-cased; with one or two words the whole sequence is the one shingle.
    Null and empty texts, and texts of white space alone, have no shingles and
    link with nothing, not even each other.  Ids are integers; a row with a null
    id is left out.  Repeated ids link as separate texts do and share the smaller
    component.  Other columns are left out; an empty table gives an empty one.
    Shingles are compared by 64-bit hashes, sets by 128 bits."""
    docs = _named(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), "doc_id", "text").where("doc_id IS NOT NULL")
    nodes = tables.written(signatures(docs), "nodes")
    clashing = clashing_names(nodes)
    if clashing:
        nodes = nodes.withColumn("node", F.when(F.col("node").isin(*clashing), F.col("twin")).otherwise(F.col("node")))
    entries = tables.written(bucket_entries(nodes), "buckets")
    marks = nodes.select("node", "signature").join(entries.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("signature").alias("signature"))
    marks = tables.written(marks, "marks")
    found = components(verified(tables.written(stars(entries), "stars"), docs, nodes, marks, clashing))

    open_ = open_entries(entries, found)
    tables.drop(entries)
    found = grown(found, verified(tables.written(hooks(open_), "hooks"), docs, nodes, marks, clashing))

    still = open_entries(open_, found)
    tables.drop(open_)
    sets = whole_sets(docs, nodes, still.select("node").distinct(), clashing)
    bits = tables.written(marks.join(parities(sets), "node"), "bits")
    pairs = tables.written(block_pairs(still.join(bits, "node")), "pairs")
    crossing = tables.written(across(pairs, found), "across")
    tried = tables.written(nearest(crossing), "nearest")
    found = grown(found, linked(tried, sets))
    rest = tables.written(across(pairs.join(tried, ["a", "b"], "left_anti"), found), "rest")
    found = grown(found, linked(rest, sets))
    tables.drop(still, pairs, crossing, sets, tried, rest, marks, bits)
    return _labelled(nodes, found).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id.

    Rows with a null id stay, and all columns as they are."""
    gone = tables.written(minhash_dedup(docs, id_col, text_col).where("NOT kept").select("doc_id"), "gone").distinct()
    gone = gone.withColumnRenamed("doc_id", tables.free_name(docs, "_gone"))
    return docs.join(gone, F.col(f"`{id_col}`") == F.col(gone.columns[0]), "left_anti")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(tables.read(spark, sf_dir, "documents"))
