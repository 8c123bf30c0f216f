"""Source divergence audit: how far the sources of a language differ in their words.

Sort-based streaming.  Tasks count the terms of what they hold; these partial
runs are dealt by (lang, term), sorted by (lang, term, source, document) and
scanned once: the run lengths of a term give its document frequency, its count
in each source and in the language.  Kept runs meet the totals of their group,
are dealt and sorted the same way again, and a second scan emits, for each run,
the values of its terms and partial sums for pairs of sources.

A pair sums over all kept terms, also those that one or both sources lack.  With
f(c, d) the value of counts c and d, a run adds for two sources that both hold
its term

    f(c, d) - f(c, 0) - f(0, d) + f(0, 0)

and the rest follows from how many terms each source holds how often, so that a
run costs the square of the sources that hold its term, and never the square
of all sources.
A scan holds one run's sources and the sums of the pairs it has met; these are
handed on when they grow beyond ``PAIRS``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdance.llm import kernels as K
from verdance.llm import tables

#: Bytes that end a term: all of ASCII but its letters.
BREAK = np.ones(256, dtype=bool)
BREAK[65:91] = BREAK[97:123] = BREAK[128:] = False

UNIT = 1_000_000_000
#: Partial runs that a task holds before it adds them up, pairs that a scan holds, and pairs worked out at once.
HELD, PAIRS, CHUNK = 600_000, 500_000, 500_000


def _term_counts(rows: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.Table | None:
    """(lang, term, source, doc, docs, n) of a slice of documents."""
    low = K.LOWER[data]
    starts, ends, first = K.word_bounds(low, offsets, BREAK)
    if not len(starts):
        return None
    where = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=where[1:])
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(where), pa.py_buffer(low[~BREAK[low]])).dictionary_encode()
    numbers: dict[tuple[str, str], int] = {}
    group = np.array([numbers.setdefault(x, len(numbers)) for x in zip(rows.column("lang").to_pylist(), rows.column("source").to_pylist())])
    doc = np.repeat(np.arange(rows.num_rows), np.diff(first))
    # one entry for each document and term, then one for each group and term
    held, n = np.unique(words.indices.to_numpy().astype(np.int64) * rows.num_rows + doc, return_counts=True)
    code, doc = np.divmod(held, rows.num_rows)
    key = code * len(numbers) + group[doc]
    by = np.argsort(key, kind="stable")
    key, n, doc = key[by], n[by], doc[by]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    code, own = np.divmod(key[at], len(numbers))
    none = np.iinfo(np.int64).max
    ids = pc.fill_null(rows.column("doc_id"), none).to_numpy()
    least = np.minimum.reduceat(ids[doc], at)
    names = list(numbers)
    return pa.table(
        {
            "lang": pa.array([x for x, _ in names], pa.string()).take(pa.array(own)),
            "term": words.dictionary.take(pa.array(code)),
            "source": pa.array([x for _, x in names], pa.string()).take(pa.array(own)),
            "doc": pa.array(least, mask=least == none),
            "docs": pa.array(np.diff(np.append(at, len(key)))),
            "n": pa.array(np.add.reduceat(n, at).astype(np.int64)),
        }
    )


def partial_runs(docs: DataFrame) -> DataFrame:
    """(lang, term, source, doc, docs, n): what each task counts of (doc_id, text, lang, source)."""

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for slice_ in K.text_slices(batches):
            table = _term_counts(*slice_)
            if table is None:
                continue
            held.append(table)
            size += table.num_rows
            if size > HELD:
                held = [_added(held)]
                size = held[0].num_rows
                if 2 * size > HELD:
                    yield from held[0].to_batches(max_chunksize=50_000)
                    held, size = [], 0
        if held:
            yield from _added(held).to_batches(max_chunksize=50_000)

    return docs.mapInArrow(run, "lang string, term string, source string, doc long, docs long, n long")


def _added(held: list[pa.Table]) -> pa.Table:
    sums = pa.concat_tables(held).group_by(["lang", "term", "source"]).aggregate([("doc", "min"), ("docs", "sum"), ("n", "sum")])
    return sums.select(["lang", "term", "source", "doc_min", "docs_sum", "n_sum"]).rename_columns(["lang", "term", "source", "doc", "docs", "n"])


def _changes(rows: pa.Table, columns: list[str]) -> np.ndarray:
    """Whether each row differs from the one before in any of the columns."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for c in columns:
        x = rows.column(c).combine_chunks()
        new[1:] |= pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)).to_numpy(zero_copy_only=False)
    return new


def _whole_terms(batches: Iterator[pa.RecordBatch], merge) -> Iterator[pa.Table]:
    """The rows of whole (lang, term) runs; ``merge`` shortens what is held of a run that goes on."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = merge(pa.concat_tables([held, rows]).combine_chunks() if held is not None else rows)
        last = int(np.flatnonzero(_changes(rows, ["lang", "term"]))[-1])
        if last:
            yield rows.slice(0, last)
        held = rows.slice(last)
    if held is not None:
        yield held


def _by_source(rows: pa.Table) -> pa.Table:
    """One row for each (lang, term, source) run."""
    at = np.flatnonzero(_changes(rows, ["lang", "term", "source"]))
    sums = {c: pa.array(np.add.reduceat(rows.column(c).to_numpy(), at)) for c in ("docs", "n")}
    heads = rows.take(pa.array(at))
    return pa.table({c: sums.get(c, heads.column(c)) for c in rows.column_names})


def term_runs(docs: DataFrame, min_docs: int = 3) -> DataFrame:
    """(lang, term, source, doc, docs, n, df, total, head) of the kept terms.

    ``doc`` is the least id that holds the term in that source, ``docs`` and
    ``n`` the documents and occurrences there, ``df`` and ``total`` those of the
    language; ``head`` is 1 on the first row of a term and 0 on the others."""

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_terms(batches, _by_source):
            head = _changes(rows, ["lang", "term"])
            at = np.flatnonzero(head)
            lengths = np.diff(np.append(at, rows.num_rows))
            df, total = (np.repeat(np.add.reduceat(rows.column(c).to_numpy(), at), lengths) for c in ("docs", "n"))
            for name, values in (("df", df), ("total", total), ("head", head.astype(np.int64))):
                rows = rows.append_column(name, pa.array(values))
            yield from rows.filter(pa.array(df >= min_docs)).to_batches()

    dealt = partial_runs(docs).repartition(tables.partitions(docs.sparkSession), "lang", "term")
    dealt = dealt.sortWithinPartitions("lang", "term", "source", "doc")
    return dealt.mapInArrow(run, "lang string, term string, source string, doc long, docs long, n long, df long, total long, head long")


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * (count + 1) / total), by long division to the base 1000: exact below totals of 9 * 10**15."""
    found, rest = np.zeros_like(total), count + 1
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        found = found * 1000 + digit
    return found + 1


def share_column(count: Column, total: Column) -> Column:
    """``share`` as a column."""
    found, rest = F.lit(0).cast("long"), count + 1
    for _ in range(3):
        found = found * 1000 + F.call_function("div", rest * 1000, total)
        rest = (rest * 1000) % total
    return found + 1


def apart(p, q):
    return (p - q) * (p - q) // q


def apart_column(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q).cast("decimal(20,0)")


def run_values(runs: DataFrame) -> DataFrame:
    """(part, lang, source, item, value): values of terms, and partial sums of pairs.

    ``runs`` has lang, term, source, n, total, group_n, lang_n and terms."""

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: dict[tuple[str, str, str], int] = defaultdict(int)

        def handed_on() -> pa.RecordBatch:
            keys, values = list(pairs), list(pairs.values())
            pairs.clear()
            columns = [["pair"] * len(keys), *([k[i] for k in keys] for i in range(3))]
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array(values, pa.int64())], ["part", "lang", "source", "item", "value"])

        for rows in _whole_terms(batches, lambda x: x):
            n, total, group_n, lang_n, terms = (rows.column(c).to_numpy() for c in ("n", "total", "group_n", "lang_n", "terms"))
            p, q, zero = share(n, group_n + terms), share(total, lang_n + terms), share(np.zeros_like(n), group_n + terms)
            up = np.flatnonzero(p > q)
            if len(up):
                some = rows.take(pa.array(up))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(["term"] * len(up), pa.string()), *(some.column(c).combine_chunks() for c in ("lang", "source", "term")), pa.array(apart(p[up], q[up]))],
                    ["part", "lang", "source", "item", "value"],
                )
            at = np.flatnonzero(_changes(rows, ["lang", "term"]))
            lengths = np.diff(np.append(at, len(n)))
            of, begin = np.repeat(lengths, lengths), np.repeat(at, lengths)
            numbers: dict[tuple[str, str], int] = {}
            group = np.array([numbers.setdefault(x, len(numbers)) for x in zip(rows.column("lang").to_pylist(), rows.column("source").to_pylist())], np.int64)
            names = list(numbers)
            sums = np.append(0, np.cumsum(of))
            start = 0
            while start < len(n):
                stop = max(start + 1, int(np.searchsorted(sums, sums[start] + CHUNK, "right")) - 1)
                i = np.repeat(np.arange(start, stop), of[start:stop])
                j = begin[i] + np.arange(len(i)) - np.repeat(sums[start:stop] - sums[start], of[start:stop])
                i, j, start = i[i != j], j[i != j], stop
                value = apart(p[i], p[j]) - apart(p[i], zero[j]) - apart(zero[i], p[j]) + apart(zero[i], zero[j])
                key = group[i] * len(names) + group[j]
                by = np.argsort(key, kind="stable")
                key, value = key[by], value[by]
                marks = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
                for k, v in zip(key[marks].tolist(), np.add.reduceat(value, marks).tolist() if len(marks) else ()):
                    (lang, source), (_, other) = names[k // len(names)], names[k % len(names)]
                    pairs[lang, source, other] += v
                if len(pairs) > PAIRS:
                    yield handed_on()
        if pairs:
            yield handed_on()

    dealt = runs.repartition(tables.partitions(runs.sparkSession), "lang", "term").sortWithinPartitions("lang", "term", "source")
    return dealt.mapInArrow(run, "part string, lang string, source string, item string, value long")


def pair_values(runs: DataFrame, groups: DataFrame, values: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every source and each other source of its language."""
    a = groups.select("lang", "source", F.col("group_n").alias("n"), "terms", F.col("held").alias("held_a"))
    b = groups.select("lang", F.col("source").alias("item"), F.col("group_n").alias("m"), F.col("held").alias("held_b"))
    pairs = a.join(b, "lang").where("source != item")
    zero = F.lit(0).cast("long")

    def p(count: Column, total: str) -> Column:
        # where no term is kept nothing is summed; 1 only keeps the division defined
        return share_column(count, F.greatest(F.col(total) + F.col("terms"), F.lit(1)))

    often = runs.groupBy("lang", "source", "n").agg(F.count("*").alias("times")).withColumnRenamed("n", "count")
    often = tables.written(often, "often")
    times = F.col("times").cast("decimal(18,0)")
    one = pairs.join(often, ["lang", "source"]).select("lang", "source", "item", (times * apart_column(p(F.col("count"), "n"), p(zero, "m"))).alias("value"))
    two = pairs.join(often.withColumnRenamed("source", "item"), ["lang", "item"])
    two = two.select("lang", "source", "item", (times * apart_column(p(zero, "n"), p(F.col("count"), "m"))).alias("value"))
    none = (F.col("terms") - F.col("held_a") - F.col("held_b")).cast("decimal(18,0)") * apart_column(p(zero, "n"), p(zero, "m"))
    none = pairs.select("lang", "source", "item", none.alias("value"))
    met = values.where("part = 'pair'").select("lang", "source", "item", F.col("value").cast("decimal(20,0)").alias("value"))
    parts = [x.withColumn("value", F.col("value").cast("decimal(38,0)")) for x in (one, two, none, met)]
    summed = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return summed.select("lang", "source", "item", F.col("value").cast("long").alias("value"))


def source_divergence(
    docs: DataFrame, min_docs: int = 3, top: int = 200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source"
) -> DataFrame:
    """(lang, source, part, item, value, rank) of each source of each language.

    Terms are runs of ASCII letters and of code points from 128 on, with A-Z
    lower-cased.  A language keeps the terms that stand in at least ``min_docs``
    of its rows; each row is a document of its own, whatever its id.  Part
    ``pair`` has every other source of the language, part ``term`` the ``top``
    terms that the source uses more than its language does.

    Null text, lang and source are read as empty; such rows form groups like any
    other.  A language with one source has no pairs, one without kept terms has
    pairs of value 0 and no terms.  Ties go by the UTF-8 bytes of the item.  An
    empty table gives an empty one.  Other columns are left out, whatever their
    names; ids are only carried along, and may be null or repeated."""

    def named(c: str) -> Column:
        return F.coalesce(F.col(f"`{c}`"), F.lit(""))

    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), named(text_col).alias("text"), named(lang_col).alias("lang"), named(source_col).alias("source"))
    runs = tables.written(term_runs(docs, min_docs), "runs")
    by_group = runs.groupBy("lang", "source").agg(F.sum("n").alias("group_n"), F.count("*").alias("held"))
    by_lang = runs.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("head").alias("terms"))
    groups = docs.select("lang", "source").distinct().join(by_group, ["lang", "source"], "left").join(by_lang, "lang", "left")
    groups = tables.written(groups.na.fill(0, ["group_n", "held", "lang_n", "terms"]), "groups")
    full = runs.select("lang", "term", "source", "n", "total").join(groups.drop("held"), ["lang", "source"])
    values = tables.written(run_values(full), "values")
    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    terms = values.where("part = 'term'").select("lang", "source", "item", "value").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    pairs = pair_values(runs, groups, values).withColumn("rank", F.row_number().over(best))
    both = pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term")))
    return both.select("lang", "source", "part", "item", "value", "rank")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(tables.read(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept k ON k.lang = t.lang AND k.term = t.term GROUP BY t.lang, t.source, t.term),
gn AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c ON c.lang = g.lang AND c.source = g.source GROUP BY g.lang, g.source),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
p AS (
  SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (gn.n + v.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 1)) // (v.n + v.v) AS q
  FROM gn JOIN v ON v.lang = gn.lang JOIN kept k ON k.lang = gn.lang
  LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
items AS (
  SELECT * FROM pairs UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM items)
WHERE part = 'pair' OR rank <= 200
"""
