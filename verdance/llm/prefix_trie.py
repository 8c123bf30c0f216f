"""Conversation prefix trie: Patricia construction over sorted conversations.

A conversation is the sequence of its turns' fingerprints, 16 bytes a turn, as
one binary key; equal conversations become one row with their number, least id
and the digest of their ids.  The rows are range-partitioned and sorted by key,
and each task builds the compressed tree of its range from the common prefixes
of neighbours: points stand only where paths branch or conversations end, and
edges between them hold the lengths of several turns.  Leaves, members and saved
lengths are added up on the points; then unary nodes come out of their edges by
suffix sums of the lengths.

A range shares with its neighbours only prefixes of its first and of its last
key.  What hangs off these two *spines* is final; of the spines themselves a
task hands on the key and the sums at each point, and one last task builds the
tree of all spines, two to a range, in the same way.  So a first turn that a
third of all conversations share is split over the ranges like any other keys.
A node's parent is only known by its least member once all its children are, so
the tops of edges are joined to their parents' points by a fingerprint.

A task holds one path at a time.  Texts leave the first scan as fingerprints and
lengths; a conversation's fingerprints must fit in a task, 16 bytes a turn.  The
digest of a node's ids is one hash over all of them, so the ids of equal
conversations stream through one task in order and are never gathered.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdance.llm import kernels as K
from verdance.llm import tables

WIDTH = 16
NONE = hashlib.sha256(b"").hexdigest()
#: Bytes of a key that choose its range: 256 turns.  Longer common prefixes only make a range larger.
RANGE_BYTES = 256 * WIDTH
FLUSH = 20_000

NODE = "conv_id long, depth long, point binary, parent binary, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
SPINE = "key binary, lens array<int>, at array<long>, n array<long>, least array<long>, kids array<long>, leaves array<long>, saved array<long>, ends array<string>"


def _arrow(schema: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return [(name, kinds[kind]) for name, kind in (x.rsplit(" ", 1) for x in schema.split(", "))]


NODE_FIELDS, SPINE_FIELDS = _arrow(NODE), _arrow(SPINE)
FIELDS = NODE_FIELDS + SPINE_FIELDS


def fingerprint(key: bytes) -> bytes:
    return hashlib.sha256(key).digest()[:WIDTH]


def common_turns(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n // WIDTH
    return int(np.argmax(np.frombuffer(x, np.uint8, n) != np.frombuffer(y, np.uint8, n))) // WIDTH


class Point:
    """A branch or an end on the current path, and the sums of what hangs below it."""

    __slots__ = ("depth", "n", "least", "kids", "leaves", "saved", "ends")

    def __init__(self, depth: int, n: int = 0, least: int | None = None, kids: int = 0, leaves: int = 0, saved: int = 0, ends: str | None = None):
        self.depth, self.n, self.least, self.kids, self.leaves, self.saved, self.ends = depth, n, least, kids, leaves, saved, ends

    def add(self, n: int, least: int | None, kids: int, leaves: int, saved: int, ends: str | None) -> None:
        self.n, self.kids, self.leaves, self.saved = self.n + n, self.kids + kids, self.leaves + leaves, self.saved + saved
        if least is not None and (self.least is None or least < self.least):
            self.least = least
        self.ends = ends or self.ends


class Patricia:
    """The compressed tree of sorted keys, one path at a time.

    With ``spines`` the prefixes of the first and the last key are handed on, not
    finished.  ``rows`` gathers finished nodes by column."""

    def __init__(self, spines: bool):
        self.spines, self.path, self.key, self.lens = spines, [], None, None
        self.first: tuple[bytes, list[int]] | None = None
        self.first_points: list[Point] = []
        self.shared = -1  # depth up to which the path is a prefix of the first key
        self.rows: dict[str, list] = {name: [] for name, _ in NODE_FIELDS}

    def at(self, depth: int) -> Point:
        """The point of the path at this depth, set there if there is none."""
        k = bisect_left(self.path, depth, key=lambda p: p.depth)
        if k == len(self.path) or self.path[k].depth != depth:
            self.path.insert(k, Point(depth))
        return self.path[k]

    def push(self, key: bytes, lens: list[int], points: list[tuple]) -> None:
        """The next key, with (depth, n, least, kids, leaves, saved, ends) of points on its path."""
        if self.key is None:
            if self.spines:
                self.first, self.shared = (key, lens), len(lens)
        else:
            self.cut(common_turns(self.key, key))
        self.key, self.lens = key, lens
        for depth, *sums in points:
            self.at(depth).add(*sums)

    def cut(self, depth: int) -> None:
        """Finishes the path below ``depth``, which becomes a branch."""
        if self.path and self.path[-1].depth > depth >= 0:
            self.at(depth)
        while self.path and self.path[-1].depth > depth:
            point = self.path.pop()
            if point.depth <= self.shared:
                self.first_points.append(point)
            else:
                self.finish(point, self.path[-1] if self.path else None)
        self.shared = min(self.shared, depth)

    def finish(self, point: Point, parent: Point | None) -> None:
        top = parent.depth + 1 if parent else 0
        count = point.depth - top + 1
        # the lengths from each node of the edge down to its point; the root has no text
        lens = np.array(self.lens[max(top, 1) - 1 : point.depth], np.int64)
        below = np.cumsum(lens[::-1])[::-1] * (point.n - 1) + point.saved
        if not top:
            below = np.append(below[:1] if len(below) else point.saved, below)
        leaves = point.leaves if point.kids else 1
        rows, inner = self.rows, [None] * (count - 1)
        rows["conv_id"] += [point.least] * count
        rows["depth"] += range(top, point.depth + 1)
        rows["point"] += [*inner, fingerprint(self.key[: WIDTH * point.depth])]
        rows["parent"] += [fingerprint(self.key[: WIDTH * parent.depth]) if parent else None, *inner]
        rows["parent_conv_id"] += [None] + [point.least] * (count - 1)
        rows["n_convs"] += [point.n] * count
        rows["n_children"] += [1] * (count - 1) + [point.kids]
        rows["n_leaves"] += [leaves] * count
        rows["saved_tokens"] += below.tolist()
        rows["ends_sha256"] += [NONE] * (count - 1) + [point.ends or NONE]
        if parent:
            parent.add(point.n, point.least, 1, leaves, int(below[0]), None)

    def ended(self) -> list[dict]:
        """The spines: (key, lens, points) of the first key and of the last."""
        if self.key is None:
            return []
        if not self.spines:
            self.cut(-1)
            return []
        found = [(*self.first, self.first_points)] if self.first_points else []
        return [
            {"key": key, "lens": lens, "at": [p.depth for p in points], **{c: [getattr(p, c) for p in points] for c in ("n", "least", "kids", "leaves", "saved", "ends")}}
            for key, lens, points in [*found, (self.key, self.lens, self.path)]
        ]

    def batch(self) -> pa.RecordBatch:
        n = len(self.rows["depth"])
        columns = [pa.array(self.rows[name], kind) for name, kind in NODE_FIELDS] + [pa.nulls(n, kind) for _, kind in SPINE_FIELDS]
        self.rows = {name: [] for name, _ in NODE_FIELDS}
        return pa.RecordBatch.from_arrays(columns, [name for name, _ in FIELDS])


def _built(keys: Iterator[tuple[bytes, list[int], list[tuple]]], spines: bool) -> Iterator[pa.RecordBatch]:
    tree = Patricia(spines)
    for key, lens, points in keys:
        tree.push(key, lens, points)
        if len(tree.rows["depth"]) >= FLUSH:
            yield tree.batch()
    left = tree.ended()
    yield tree.batch()
    if left:
        columns = [pa.nulls(len(left), kind) for _, kind in NODE_FIELDS] + [pa.array([x[name] for x in left], kind) for name, kind in SPINE_FIELDS]
        yield pa.RecordBatch.from_arrays(columns, [name for name, _ in FIELDS])


def range_nodes(sorted_: DataFrame) -> DataFrame:
    """Finished nodes and spines of each partition of sorted (key, lens, n, conv_id, ends)."""

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keys() -> Iterator[tuple[bytes, list[int], list[tuple]]]:
            for b in batches:
                for key, lens, n, least, ends in zip(*(b.column(c).to_pylist() for c in ("key", "lens", "n", "conv_id", "ends"))):
                    yield key, lens, [(len(lens), n, least, 0, 0, 0, ends)]

        yield from _built(keys(), True)

    return sorted_.mapInArrow(run, f"{NODE}, {SPINE}")


def spine_nodes(spines: DataFrame) -> DataFrame:
    """The nodes of all spines, at most two for each range, in one task."""

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keys() -> Iterator[tuple[bytes, list[int], list[tuple]]]:
            for b in batches:
                names = [name for name, _ in SPINE_FIELDS]
                for key, lens, *points in zip(*(b.column(c).to_pylist() for c in names)):
                    yield key, lens, list(zip(*points))

        for batch in _built(keys(), False):
            yield batch.select([name for name, _ in NODE_FIELDS])

    return spines.select([name for name, _ in SPINE_FIELDS]).repartition(1).sortWithinPartitions("key").mapInArrow(run, NODE)


def end_digests(members: DataFrame) -> DataFrame:
    """(name, ends): the SHA-256 of the comma-joined ids of each name, ascending; ids stream by."""

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest = None, None
        done: tuple[list, list] = ([], [])
        for b in batches:
            names, ids = b.column("name").to_pylist(), b.column("conv_id").to_pylist()
            start = 0
            while start < len(names):
                stop = start
                while stop < len(names) and names[stop] == names[start]:
                    stop += 1
                text = ",".join(map(str, ids[start:stop])).encode()
                if names[start] == name:
                    digest.update(b"," + text)
                else:
                    if name is not None:
                        done[0].append(name)
                        done[1].append(digest.hexdigest())
                    name, digest = names[start], hashlib.sha256(text)
                start = stop
            if len(done[0]) >= FLUSH:
                yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.binary()), pa.array(done[1], pa.string())], ["name", "ends"])
                done = ([], [])
        if name is not None:
            done[0].append(name)
            done[1].append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array(done[0], pa.binary()), pa.array(done[1], pa.string())], ["name", "ends"])

    dealt = members.select("name", "conv_id").repartition(tables.partitions(members.sparkSession), "name").sortWithinPartitions("name", "conv_id")
    return dealt.mapInArrow(run, "name binary, ends string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of ``conversations``: (conv_id long, turns array<struct<h string, len int>>).

    ``h`` is the fingerprint of a turn as 32 hex digits, ``len`` its length.  Ids
    are unique and not null; null or empty ``turns`` end at the root.  One row
    per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.  No conversation gives no node, not even a root.
    Sequences are told apart by 128 bits a turn."""
    spark = conversations.sparkSession
    turns = F.coalesce("turns", F.array().cast("array<struct<h:string,len:int>>"))
    keyed = conversations.select("conv_id", F.unhex(F.array_join(F.transform(turns, lambda t: t["h"]), "")).alias("key"), F.transform(turns, lambda t: t["len"]).alias("lens"))
    keyed = tables.written(keyed.withColumn("name", F.unhex(F.substring(F.sha2("key", 256), 1, 2 * WIDTH))), "keyed")
    same = keyed.groupBy("name").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"))
    same = tables.written(same, "same")
    several = keyed.join(same.where("n > 1").select("name"), "name", "left_semi")
    own = F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)
    distinct = keyed.drop("name").join(same, "conv_id").join(end_digests(several), "name", "left")
    distinct = tables.written(distinct.select("key", "lens", "n", "conv_id", F.coalesce("ends", own).alias("ends")), "distinct")
    dealt = distinct.repartitionByRange(tables.partitions(spark), F.substring("key", 1, RANGE_BYTES)).sortWithinPartitions("key")
    local = tables.written(range_nodes(dealt), "local-nodes")
    names = [name for name, _ in NODE_FIELDS]
    nodes = local.where("key IS NULL").select(names).unionByName(spine_nodes(local.where("key IS NOT NULL")))
    nodes = tables.written(nodes, "nodes")
    tables.drop(keyed, same, distinct, local)
    parents = nodes.where("point IS NOT NULL AND n_children > 0").select(F.col("point").alias("parent"), F.col("conv_id").alias("above"))
    tops = nodes.where("parent IS NOT NULL").join(parents, "parent").withColumn("parent_conv_id", F.col("above"))
    found = nodes.where("parent IS NULL").unionByName(tops.select(names))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def turn_arrays(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns) in the order of the turns, null turns first.

    Null roles and texts are read as empty.  Ties go by the SHA-256 of the role's
    length, a colon, role and text; repeated rows are turns of their own.  Rows
    without an id are left out; other columns are, too."""
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col))
    h = F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * WIDTH)
    rows = turns.where(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("conv_id"), F.struct(F.col(f"`{turn_col}`").alias("turn"), h.alias("h"), F.char_length(text).alias("len")).alias("t")
    )
    return rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t"), _by_turn), lambda t: F.struct(t["h"].alias("h"), t["len"].alias("len"))).alias("turns"))


def _by_turn(a: Column, b: Column) -> Column:
    """Null turns first, then by turn, then by fingerprint."""
    return (
        F.when(a["turn"].isNull() & b["turn"].isNotNull(), -1).when(a["turn"].isNotNull() & b["turn"].isNull(), 1)
        .when(a["turn"] < b["turn"], -1).when(a["turn"] > b["turn"], 1).when(a["h"] < b["h"], -1).when(a["h"] > b["h"], 1).otherwise(0)
    )


def rebuilt(own: DataFrame) -> DataFrame:
    """Each conversation after the first turns of the one its hundred begins with.

    Of h = crc32(id) % 6 turns; the own turns after the first h follow."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    own = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).withColumn("h", h)
    first = own.where("conv_id = base").select("base", F.slice("turns", 1, 5).alias("first"))
    both = own.join(first, "base", "left").withColumn("first", F.coalesce("first", F.array().cast("array<struct<h:string,len:int>>")))
    turns = F.concat(F.slice("first", F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0))))
    return both.select("conv_id", turns.alias("turns"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = tables.written(turn_arrays(tables.read(spark, sf_dir, "conversations")), "conversations")
    return prefix_trie(rebuilt(own))


#: CRC-32 of a decimal number in SQL: each byte is xored in, then eight bits go by.
_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(
           string_split(CAST(conv_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
         lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END))"""

OP12_SQL = f"""
WITH turns AS (
  SELECT conv_id, h, len, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, h) AS pos
  FROM (SELECT conv_id, turn, length(coalesce(text, '')) AS len,
               sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))[:32] AS h
        FROM conversations WHERE conv_id IS NOT NULL)),
crc AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC} % 6 AS h FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)),
had AS (SELECT c.conv_id, c.base, c.h, least(c.h, (SELECT count(*) FROM turns t WHERE t.conv_id = c.base)) AS had FROM crc c),
path AS (
  SELECT c.conv_id, t.pos AS depth, t.h, t.len FROM had c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, t.pos - c.h + c.had, t.h, t.len FROM had c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h
  UNION ALL SELECT conv_id, 0, '', 0 FROM had),
named AS (
  SELECT conv_id, depth, len, max(depth) OVER (PARTITION BY conv_id) AS last,
         sha256(string_agg(h, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS name FROM path),
nodes AS (
  SELECT name, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(len) AS len,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = last), '')) AS ends
  FROM named GROUP BY name, depth),
above AS (
  SELECT n.name, n.depth, p.name AS parent, p.depth AS up FROM nodes n JOIN named p ON p.conv_id = n.conv_id AND p.depth <= n.depth),
kids AS (SELECT parent AS name, count(*) AS n FROM above WHERE up = depth - 1 GROUP BY parent),
sums AS (
  SELECT a.parent AS name, count(*) FILTER (WHERE k.n IS NULL) AS leaves, sum((n.n_convs - 1) * n.len) AS saved
  FROM above a JOIN nodes n ON n.name = a.name LEFT JOIN kids k ON k.name = a.name GROUP BY a.parent)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children,
       s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN sums s ON s.name = n.name LEFT JOIN kids k ON k.name = n.name
LEFT JOIN above a ON a.name = n.name AND a.up = n.depth - 1 LEFT JOIN nodes p ON p.name = a.parent
"""
