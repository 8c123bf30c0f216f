"""Suffix-array dedup of long repeated strings.

A byte goes when a string of ``length`` bytes that covers it also starts
earlier.  Sorting all suffixes would move about a hundred times the text, so
suffixes are sorted only where they can matter.  In each window of ``length``
bytes one position is the *anchor* (the least hash of ``GRAM`` bytes, leftmost
of equals), so equal windows have equal anchors.  Steps:

1. Anchors' hashes are exchanged; only those seen twice go on.  A task that
   sees a hash twice settles its own rows and sends one.
2. Suffixes at the remaining anchors, as far as their windows reach, followed
   by what stands before the anchor, reversed, are sorted in each task.  Equal
   suffixes of a task collapse to the earliest.  Sorted runs are front-coded
   (length of the prefix shared with the line before, and the rest), split by
   the anchor's hash and exchanged.
3. A loser tree merges the runs.  Each loser keeps the length of the prefix it
   shares with the winner that beat it, so only bytes beyond known prefixes are
   ever compared.  Equal suffixes meet; suffixes that share an anchor and not
   all their bytes are settled window by window.
4. The removed spans are joined back to the documents that have any.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdance.llm import kernels as K
from verdance.llm import tables

GRAM = 32
_LOW = np.uint64(0xFFFFFFFF)
_RUN_BYTES = 24 << 20


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(document, anchor, first and last window start, hash) of each anchor."""
    none = np.zeros(0, np.int64)
    n = len(data) - GRAM + 1
    width = length - GRAM + 1
    if len(data) < length:
        return none, none, none, none, np.zeros(0, np.uint64)
    up, down = K.powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    grams = K.mix((sums[GRAM:] - sums[:n]) * down[:n])
    best = (grams & ~_LOW) | np.arange(n, dtype=np.uint64)
    have = 1
    while 2 * have <= width:
        best = np.minimum(best[:-have], best[have:])
        have *= 2
    if have < width:
        gap = width - have
        best = np.minimum(best[:-gap], best[gap:])
    starts = np.arange(len(best), dtype=np.int64)
    doc = np.searchsorted(offsets, starts, "right") - 1
    inside = starts + length <= offsets[doc + 1]
    starts, doc = starts[inside], doc[inside]
    if not len(starts):
        return none, none, none, none, np.zeros(0, np.uint64)
    at = (best[inside] & _LOW).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return doc[first], at[first], starts[first], starts[last], grams[at[first]]


def _pack(hashes: np.ndarray, ids: np.ndarray, places: np.ndarray, known: np.ndarray) -> bytes:
    import zstandard

    gaps = np.diff(hashes, prepend=np.uint64(0))
    planes = [gaps.view(np.uint8).reshape(-1, 8).T, ids.view(np.uint8).reshape(-1, 8).T, places.astype(np.uint32).view(np.uint8).reshape(-1, 4).T, known.astype(np.uint8).reshape(1, -1)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(p).tobytes() for p in planes))


def _unpack(body: bytes) -> tuple[np.ndarray, ...]:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
    n = len(raw) // 21
    plane = lambda a, k: np.ascontiguousarray(raw[a * n : (a + k) * n].reshape(k, n).T)
    hashes = np.cumsum(plane(0, 8).view(np.uint64).reshape(-1), dtype=np.uint64)
    return hashes, plane(8, 8).view(np.int64).reshape(-1), plane(16, 4).view(np.uint32).reshape(-1), raw[20 * n :] > 0


def _by_document(ids: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(doc_id, body) rows: the values of each id, as little-endian 32-bit integers."""
    if not len(ids):
        return
    by = np.argsort(ids, kind="stable")
    ids, values = ids[by], values[by].astype(np.uint32)
    cuts = np.flatnonzero(np.diff(ids)) + 1
    starts, ends = [0, *cuts.tolist()], [*cuts.tolist(), len(ids)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(starts), -1, np.int32)), pa.array(ids[starts]), pa.array([values[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())],
        ["bucket", "doc_id", "body"],
    )


def _pass_or_gather(batches: Iterator[pa.RecordBatch], gathered: dict[int, list[bytes]]) -> Iterator[pa.RecordBatch]:
    """Rows that belong to documents pass through; the bodies of buckets are gathered."""
    for batch in batches:
        buckets = batch.column("bucket").to_numpy()
        mine = buckets < 0
        if mine.any():
            yield batch.filter(pa.array(mine)).select(["doc_id", "body"])
        for k in np.flatnonzero(~mine).tolist():
            gathered.setdefault(int(buckets[k]), []).append(batch.column("body")[k].as_py())


def repeated_anchors(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """(doc_id, body): places of anchors whose hash occurs twice or more anywhere."""

    @K.tidy
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            if not held:
                return
            ids, places, hashes = (np.concatenate([h[i] for h in held]) for i in range(3))
            held, size = [], 0
            bucket = (hashes % np.uint64(buckets)).astype(np.int32)
            by = np.lexsort((hashes, bucket))
            ids, places, hashes, bucket = ids[by], places[by], hashes[by], bucket[by]
            new = np.ones(len(hashes), bool)
            new[1:] = hashes[1:] != hashes[:-1]
            twice = np.zeros(len(hashes), bool)
            twice[1:] |= ~new[1:]
            twice[:-1] |= ~new[1:]
            yield from _by_document(ids[twice], places[twice])
            ids, places, hashes, bucket, twice = ids[new], places[new], hashes[new], bucket[new], twice[new]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            spans = list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(hashes)]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(bucket[a]) for a, _ in spans], pa.int32()), pa.nulls(len(spans), pa.int64()), pa.array([_pack(hashes[a:b], ids[a:b], places[a:b], twice[a:b]) for a, b in spans], pa.binary())],
                ["bucket", "doc_id", "body"],
            )

        for rows, data, offsets in K.text_slices(batches):
            doc, at, _, _, hashes = anchors(data, offsets, length)
            held.append((rows.column("doc_id").to_numpy()[doc], at - offsets[doc], hashes))
            size += len(doc)
            if size > 600_000:
                yield from flush()
        yield from flush()

    @K.tidy
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: dict[int, list[bytes]] = {}
        yield from _pass_or_gather(batches, gathered)
        while gathered:
            _, bodies = gathered.popitem()
            hashes, ids, places, known = (np.concatenate(x) for x in zip(*map(_unpack, bodies)))
            by = np.argsort(hashes, kind="stable")
            hashes, ids, places, known = hashes[by], ids[by], places[by], known[by]
            same = hashes[1:] == hashes[:-1]
            twice = np.zeros(len(hashes), bool)
            twice[1:] |= same
            twice[:-1] |= same
            twice &= ~known
            for rows in _by_document(ids[twice], places[twice]):
                yield rows.select(["doc_id", "body"])

    sent = docs.mapInArrow(send, "bucket int, doc_id long, body binary")
    n = tables.partitions(docs.sparkSession)
    return sent.repartition(n, F.coalesce(F.col("bucket"), F.lit(0)), F.when(F.col("bucket") < 0, F.col("doc_id"))).mapInArrow(settle, "doc_id long, body binary")


# A suffix's line: key, then id, anchor, bytes before and after it.
_MEMBER = struct.Struct("<qIHH")


def front_coded(lines: list[tuple[bytes, tuple[int, int, int, int]]]) -> bytes:
    """Sorted lines as (shared length, rest length, rest, member)."""
    out, before = [], b""
    for key, member in lines:
        shared = common_prefix(before, key, 0)
        rest = key[shared:]
        out.append(struct.pack("<HH", shared, len(rest)) + rest + _MEMBER.pack(*member))
        before = key
    return b"".join(out)


def decoded(run: bytes) -> Iterator[tuple[int, bytes, tuple[int, int, int, int]]]:
    """(prefix length shared with the line before, key, member) of each line."""
    at, key, end, member_size = 0, b"", len(run), _MEMBER.size
    while at < end:
        shared, size = struct.unpack_from("<HH", run, at)
        at += 4
        key = key[:shared] + run[at : at + size]
        at += size
        yield shared, key, _MEMBER.unpack_from(run, at)
        at += member_size


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """How many leading bytes a and b share, given that ``known`` are."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    difference = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return n - (difference.bit_length() + 7) // 8


def merged(runs: list[Iterator[tuple[int, bytes, tuple]]]) -> Iterator[tuple[int, bytes, tuple]]:
    """Merges sorted runs with a loser tree that knows shared prefixes.

    Each item is (length shared with the item before, key, member).  All
    lengths in the tree refer to the last item that came out, so of two
    contenders the one that shares more with it is smaller, and bytes are
    compared only where both share equally much, from there on."""
    size = 1
    while size < len(runs):
        size *= 2
    done = (-1, None, None)
    head = [next(r, done) for r in runs] + [done] * (size - len(runs))
    keys: list[bytes | None] = [h[1] for h in head]
    shared = [0 if k is not None else -1 for k in keys]
    loser = [0] * size

    def duel(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared length then refers to the winner."""
        sa, sb = shared[a], shared[b]
        if sa > sb:
            return a, b
        if sb > sa:
            return b, a
        if sa < 0:
            return a, b
        x, y = keys[a], keys[b]
        n = common_prefix(x, y, sa)
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    winners = list(range(size))
    level = size
    while level > 1:
        level //= 2
        winners_next = []
        for k in range(level):
            w, l = duel(winners[2 * k], winners[2 * k + 1])
            loser[level + k] = l
            winners_next.append(w)
        winners = winners_next
    top = winners[0]
    while keys[top] is not None:
        yield shared[top], keys[top], head[top][2]
        item = next(runs[top], done)
        head[top], keys[top], shared[top] = item, item[1], item[0]
        node = (size + top) // 2
        while node:
            other = loser[node]
            sa, sb = shared[top], shared[other]
            if sa < sb:
                loser[node], top = top, other
            elif sa == sb and sa >= 0:
                top, loser[node] = duel(top, other)
            node //= 2


def _line_of(text: bytes, at: int, lo: int, hi: int, length: int) -> bytes:
    """The suffix at the anchor as far as its windows reach, then what stands before it."""
    return text[at : hi + length] + text[lo:at][::-1] + bytes([hi + length - at])


def _settled(group: list[tuple[bytes, tuple[int, int, int, int]]], length: int) -> Iterator[tuple[int, int, int]]:
    """Removed spans among suffixes of one anchor that are not equal as wholes."""
    earliest: dict[bytes, tuple[int, int]] = {}
    seen = []
    for key, (doc, at, before, after) in group:
        text = key[after : after + before][::-1] + key[:after]
        for k in range(before + after - length + 1):
            window, start = text[k : k + length], (doc, at - before + k)
            seen.append((window, start))
            if window not in earliest or start < earliest[window]:
                earliest[window] = start
    for window, start in seen:
        if earliest[window] < start:
            yield start[0], start[1], start[1] + length


def removed_spans(candidates: DataFrame, length: int, buckets: int) -> DataFrame:
    """(doc_id, body): removed spans, from (doc_id, text, places)."""

    @K.tidy
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        lines: list[tuple[int, bytes, tuple[int, int, int, int]]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal lines, size
            lines.sort()
            spans: list[tuple[int, int, int]] = []
            bodies: dict[int, list[tuple[bytes, tuple[int, int, int, int]]]] = {}
            last_bucket, last_key = -1, None
            for bucket, key, member in lines:
                if bucket == last_bucket and key == last_key:
                    doc, at, before, after = member
                    spans.append((doc, at - before, at + after))
                    continue
                last_bucket, last_key = bucket, key
                bodies.setdefault(bucket, []).append((key, member))
            lines, size = [], 0
            yield from _span_rows(spans)
            press = zstandard.ZstdCompressor(level=1)
            packed = {b: press.compress(front_coded(own)) for b, own in bodies.items()}
            if packed:
                yield pa.RecordBatch.from_arrays([pa.array(list(packed), pa.int32()), pa.nulls(len(packed), pa.int64()), pa.array(list(packed.values()), pa.binary())], ["bucket", "doc_id", "body"])

        for rows, data, offsets in K.text_slices(batches):
            doc, at, lo, hi, hashes = anchors(data, offsets, length)
            raw = data.tobytes()
            ids = rows.column("doc_id").to_pylist()
            first = np.searchsorted(doc, np.arange(len(ids) + 1))
            bucket = (hashes % np.uint64(buckets)).astype(np.int64)
            for d in range(len(ids)):
                a, b, base = int(first[d]), int(first[d + 1]), int(offsets[d])
                places = np.frombuffer(rows.column("places")[d].as_py(), np.uint32)
                own = a + np.flatnonzero(np.isin(at[a:b] - base, places))
                text = raw[base : int(offsets[d + 1])]
                for x, l, h, n in zip((at[own] - base).tolist(), (lo[own] - base).tolist(), (hi[own] - base).tolist(), bucket[own].tolist()):
                    key = _line_of(text, x, l, h, length)
                    lines.append((n, key, (ids[d], x, x - l, h + length - x)))
                    size += len(key) + 200
            if size > _RUN_BYTES * 2:
                yield from flush()
        yield from flush()

    @K.tidy
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        gathered: dict[int, list[bytes]] = {}
        yield from _pass_or_gather(batches, gathered)
        expand = zstandard.ZstdDecompressor()
        while gathered:
            _, bodies = gathered.popitem()
            spans: list[tuple[int, int, int]] = []
            group: list[tuple[bytes, tuple[int, int, int, int]]] = []
            same: tuple[int, int, int, int] | None = None
            before: bytes | None = None
            for shared, key, member in merged([decoded(expand.decompress(b)) for b in bodies]):
                if before is not None and shared == len(key) == len(before):
                    doc, at, back, ahead = member
                    late = max(same, member)
                    same = min(same, member)
                    group[-1] = (key, same)
                    spans.append((late[0], late[1] - late[2], late[1] + late[3]))
                    continue
                if shared < GRAM:
                    if len(group) > 1:
                        spans.extend(_settled(group, length))
                    group = []
                group.append((key, member))
                before, same = key, member
                if len(spans) > 200_000:
                    for rows in _span_rows(spans):
                        yield rows.select(["doc_id", "body"])
                    spans = []
            if len(group) > 1:
                spans.extend(_settled(group, length))
            for rows in _span_rows(spans):
                yield rows.select(["doc_id", "body"])

    sent = candidates.mapInArrow(send, "bucket int, doc_id long, body binary")
    n = tables.partitions(candidates.sparkSession)
    return sent.repartition(n, F.coalesce(F.col("bucket"), F.lit(0)), F.when(F.col("bucket") < 0, F.col("doc_id"))).mapInArrow(settle, "doc_id long, body binary")


def _span_rows(spans: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
    """Spans of each document, joined where they touch, as pairs of 32-bit integers."""
    if not spans:
        return
    table = np.array(spans, np.int64)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    doc, start, end = table[:, 0], table[:, 1], table[:, 2]
    # Spans of one anchor and length come sorted; a running end joins them.
    shift = np.cumsum(np.concatenate([[0], (np.diff(doc) != 0)])) * (1 << 33)
    reach = np.maximum.accumulate(end + shift)
    new = np.ones(len(doc), bool)
    new[1:] = (start + shift)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    pairs = np.stack([start[first], (reach - shift)[last]], 1).astype(np.uint32)
    ids = doc[first]
    cuts = np.flatnonzero(np.diff(ids)) + 1
    starts, ends = [0, *cuts.tolist()], [*cuts.tolist(), len(ids)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(starts), -1, np.int32)), pa.array(ids[starts]), pa.array([pairs[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())],
        ["bucket", "doc_id", "body"],
    )


def numbered(docs: DataFrame) -> tuple[DataFrame, int]:
    """``docs`` with an id for each row, in the order of the ids, and what these are multiplied by.

    Where ids are unique, that is 1.  Else it is the number of rows of the most
    frequent id, and rows that share one follow each other by their texts."""
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1")
    repeated = tables.written(repeated, "repeated-ids")
    most = repeated.agg(F.max("count")).first()[0]
    if most is None:
        return docs, 1
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if max(-low, high) >= (1 << 63) // (most + 1):
        raise ValueError(f"ids are too large to tell {most} rows of one id apart")
    ids = repeated.select(F.col("doc_id").alias("again"))
    own = F.row_number().over(Window.partitionBy("doc_id").orderBy("text")) - 1
    many = docs.join(ids, F.col("doc_id") == F.col("again"), "left_semi").withColumn("doc_id", F.col("doc_id") * most + own)
    one = docs.join(ids, F.col("doc_id") == F.col("again"), "left_anti").withColumn("doc_id", F.col("doc_id") * most)
    return tables.written(one.unionByName(many), "numbered"), most


def suffix_dedup(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) for each row of ``docs``.

    ``kept`` is the remaining bytes, null where nothing went (the text is whole).
    Null and empty texts have no bytes.  Ids are integers; a row with a null id
    is kept whole and matches nothing.  Rows that share an id are documents of
    their own, one after the other in the order of their texts.  ``length`` lies
    between 33 and 200.  Extra columns are left out."""
    if not GRAM < length <= 200:
        raise ValueError("length must lie between 33 and 200")
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    docs, rows_of_one = numbered(docs)
    usable = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
    buckets = 4 * tables.partitions(spark)
    places = repeated_anchors(usable, length, buckets)
    places = places.groupBy("doc_id").agg(F.array_join(F.transform(F.collect_list("body"), F.hex), "").alias("places"))
    places = tables.written(places.select("doc_id", F.unhex("places").alias("places")), "places")
    candidates = tables.written(usable.join(places, "doc_id"), "candidates")
    spans = removed_spans(candidates, length, buckets)
    spans = spans.groupBy("doc_id").agg(F.unhex(F.array_join(F.transform(F.collect_list("body"), F.hex), "")).alias("spans"))
    spans = tables.written(spans, "spans")

    @K.tidy
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in K.text_slices(batches):
            columns: list[list] = [[] for _ in range(6)]
            for d in range(rows.num_rows):
                own = data[offsets[d] : offsets[d + 1]]
                pairs = np.frombuffer(rows.column("spans")[d].as_py(), np.uint32).reshape(-1, 2).astype(np.int64)
                edge = np.zeros(len(own) + 1, np.int64)
                np.add.at(edge, np.minimum(pairs[:, 0], len(own)), 1)
                np.add.at(edge, np.minimum(pairs[:, 1], len(own)), -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = own[~gone].tobytes()
                n_spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                for c, v in zip(columns, (rows.column("doc_id")[d].as_py(), len(own), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest(), kept)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    touched = candidates.select("doc_id", "text").join(spans, "doc_id")
    touched = touched.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    whole = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("whole"))
    whole = whole.join(spans.select("doc_id", F.lit(True).alias("hit")), "doc_id", "left")
    untouched = whole.where("hit IS NULL").select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("whole").alias("kept_sha256"), F.lit(None).cast("binary").alias("kept"))
    out = untouched.unionByName(touched)
    return out.withColumn("doc_id", F.expr(f"(doc_id - pmod(doc_id, {rows_of_one}L)) div {rows_of_one}L")) if rows_of_one > 1 else out


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup(docs).drop("kept")
