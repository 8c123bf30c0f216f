"""Quality rules as a short-circuit cascade.

Each rule is a vectorised test over the documents of a slice.  On a bounded
sample the operator measures what a rule costs per document and which share of
documents it rejects, and orders the rules by rejection per cost.  A rule then
runs only on documents that no earlier rule rejected.  Order changes the time
and never the verdict: a document is kept when no rule rejects it.

What is measured on a slice is worked out once: rules share it, and columns
that the caller wants of all documents are measured first, so that their rules
cost next to nothing and come early, and only what is optional is saved.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdance.llm import kernels as K
from verdance.llm import tables

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_ALPHA = np.zeros(256, dtype=bool)
_ALPHA[np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)] = True
_ALPHA[0x80:] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True


class Slice:
    """Some whole documents with what rules measure on them, worked out once.

    A part of a slice takes over what its whole has measured already."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, whole: Slice | None = None, docs: np.ndarray | None = None):
        self.data, self.offsets, self._whole, self._docs = data, offsets, whole, docs
        self._known: dict[str, np.ndarray] = {}
        self._words: tuple[np.ndarray, ...] | None = None

    def measure(self, name: str) -> np.ndarray:
        """One of the measures below, for each document."""
        if name not in self._known:
            taken = self._whole._known.get(name) if self._whole is not None else None
            self._known[name] = getattr(self, f"_{name}")() if taken is None else taken[self._docs]
        return self._known[name]

    def words(self) -> tuple[np.ndarray, ...]:
        """Start and end of each word, and the index of each document's first."""
        if self._words is None:
            self._words = K.word_bounds(self.data, self.offsets)
        return self._words

    def _n_words(self) -> np.ndarray:
        return np.diff(self.words()[2])

    def _n_lines(self) -> np.ndarray:
        return self.per_doc(self.data == 10) + 1

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each document are flagged."""
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def _word_chars(self) -> np.ndarray:
        return self.per_doc(~K.SPACE[self.data] & ((self.data & 0xC0) != 0x80))

    def _n_symbols(self) -> np.ndarray:
        return self.per_doc(_SYMBOL[self.data])

    def _n_dup_lines(self) -> np.ndarray:
        out = np.zeros(len(self.offsets) - 1, np.int64)
        raw = self.data.tobytes()
        for d, (a, b) in enumerate(zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist())):
            lines = raw[a:b].split(b"\n")
            if len(lines) > 1:
                lines = [x for x in lines if x.strip(b" \t\n\x0b\x0c\r")]
                out[d] = len(lines) - len(set(lines))
        return out

    def _n_repeat_words(self, width: int = 8) -> np.ndarray:
        starts, ends, first = self.words()
        hashes = K.word_hashes(self.data, starts, ends, lower=False)
        runs = K.windows(hashes, width)
        out = np.zeros(len(first) - 1, np.int64)
        for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            n = b - a - width + 1
            if n < 2:
                continue
            own = runs[a : a + n]
            order = np.argsort(own, kind="stable")
            same = own[order[1:]] == own[order[:-1]]
            if same.any():
                twice = np.zeros(n, bool)
                twice[order[1:][same]] = True
                twice[order[:-1][same]] = True
                cover = np.zeros(n + width, np.int64)
                at = np.flatnonzero(twice)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + width, -1)
                out[d] = (np.cumsum(cover) > 0).sum()
        return out

    def _alpha_words(self) -> np.ndarray:
        """Words with at least one letter (any byte over 0x7F counts as one)."""
        sums = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(_ALPHA[self.data], out=sums[1:])
        starts, ends, first = self.words()
        has = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(sums[ends] > sums[starts], out=has[1:])
        return has[first[1:]] - has[first[:-1]]

    def _n_upper(self) -> np.ndarray:
        return self.per_doc(_UPPER[self.data])

    def _n_letters(self) -> np.ndarray:
        return self.per_doc(_LETTER[self.data])

    def only(self, docs: np.ndarray) -> Slice:
        """The slice of some of its documents."""
        lengths = np.diff(self.offsets)
        mask = np.repeat(np.isin(np.arange(len(lengths)), docs), lengths)
        offsets = np.zeros(len(docs) + 1, np.int64)
        np.cumsum(lengths[docs], out=offsets[1:])
        return Slice(self.data[mask], offsets, self, docs)


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Slice], np.ndarray]


def _shouting(s: Slice) -> np.ndarray:
    letters = s.measure("n_letters")
    return (letters > 0) & (100 * s.measure("n_upper") > 60 * letters)


def _word_length(s: Slice) -> np.ndarray:
    chars, n = s.measure("word_chars"), s.measure("n_words")
    return (chars < 2 * n) | (chars > 12 * n)


#: What op6 applies.  All comparisons are between integers.
RULES = (
    Rule("too_few_words", lambda s: s.measure("n_words") < 20),
    Rule("repeated_windows", lambda s: 100 * s.measure("n_repeat_words") > 30 * s.measure("n_words")),
    Rule("symbols_per_word", lambda s: 100 * s.measure("n_symbols") > 10 * s.measure("n_words")),
    Rule("word_length", _word_length),
    Rule("duplicate_lines", lambda s: 100 * s.measure("n_dup_lines") > 30 * s.measure("n_lines")),
    Rule("words_with_letters", lambda s: 100 * s.measure("alpha_words") < 80 * s.measure("n_words")),
    Rule("upper_case", _shouting),
)

#: Measures that the contract's columns need of every document.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: A part is cut out of a slice once this share of its documents is gone.
CUT_SHARE = 0.25


def sampled_texts(docs: DataFrame, id_col: str, text_col: str, rows: int, most_bytes: int) -> pa.Table:
    """Whole texts of at most ``rows`` rows from all over the table, ``most_bytes`` together at most.

    Rows come in the order of a hash of id and text, as long as their bytes fit
    (the first is always taken); equal rows count once."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    marked = docs.select(F.xxhash64(F.col(f"`{id_col}`"), text, F.lit(17)).alias("h"), text.alias("text"))
    chosen = marked.select("h", F.octet_length("text").alias("n")).orderBy("h").limit(rows).collect()
    keep, held = [], 0
    for r in sorted({tuple(r) for r in chosen}):
        if not keep or held + r[1] <= most_bytes:
            keep.append(r[0])
            held += r[1]
    if not keep:
        return pa.table({"text": pa.array([], pa.string())})
    return marked.where(F.col("h").isin(keep)).groupBy("h").agg(F.min("text").alias("text")).orderBy("h").select("text").toArrow()


def measured_order(
    docs: DataFrame, rules: tuple[Rule, ...], sample_rows: int, id_col: str, text_col: str, first: tuple[str, ...] = (), most_bytes: int = 4 << 20
) -> tuple[list[int], dict[str, tuple[float, float]]]:
    """Rule indexes by rejection per cost, and (seconds per row, share rejected).

    The sample, bounded by ``sample_rows`` and ``most_bytes``, sets the order
    and no verdict.  ``first`` names measures that are there before any rule
    runs.  Costs count in powers of two, and ties keep the rules' own order, so
    that runs mostly agree."""
    table = sampled_texts(docs, id_col, text_col, sample_rows, most_bytes)
    cost, hit, seen = np.zeros(len(rules)), np.zeros(len(rules)), 0
    for _, data, offsets in K.text_slices(iter(table.to_batches())):
        seen += len(offsets) - 1
        whole = Slice(data, offsets)
        for name in first:
            whole.measure(name)
        every = np.arange(len(offsets) - 1)
        for i, rule in enumerate(rules):
            base = Slice(data, offsets, whole, every)
            began = time.perf_counter()
            hit[i] += rule.rejects(base).sum()
            cost[i] += time.perf_counter() - began
    seen = max(1, seen)
    steps = np.round(np.log2(np.maximum(cost / seen, 1e-8)))
    gain = np.log2((hit + 0.5) / seen) - steps
    order = sorted(range(len(rules)), key=lambda i: (-gain[i], i))
    return order, {r.name: (cost[i] / seen, hit[i] / seen) for i, r in enumerate(rules)}


def cascade(base: Slice, rules: list[Rule]) -> np.ndarray:
    """The index in ``rules`` of the first that rejects each document, else -1."""
    verdict = np.full(len(base.offsets) - 1, -1, np.int64)
    own, now = np.arange(len(verdict)), base  # documents of ``now``
    alive = np.ones(len(verdict), bool)  # of them, those not rejected
    for i, rule in enumerate(rules):
        if alive.sum() <= (1 - CUT_SHARE) * len(own):
            if not alive.any():
                break
            own, alive = own[alive], np.ones(int(alive.sum()), bool)
            now = base.only(own)
        bad = rule.rejects(now) & alive
        verdict[own[bad]] = i
        alive &= ~bad
    return verdict


def quality_rules(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    with_base: bool = False,
    sample_rows: int = 500,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, n_words, kept, rejected_by[, base columns]) for each row of ``docs``.

    ``rejected_by`` is the rule that rejected first in the measured order, which
    may differ between runs; ``kept`` never does.  Null and empty texts have no
    words and are rejected by any rule that wants some.  Null ids and repeated
    rows pass through as they are; an empty table gives an empty table."""
    first = BASE if with_base else ("n_words",)
    order, _ = measured_order(docs, rules, sample_rows, id_col, text_col, first)
    ordered = [rules[i] for i in order]
    kinds = dict(docs.dtypes)
    base = list(BASE[1:]) if with_base else []
    schema = f"_id {kinds[id_col]}, n_words long, kept boolean, rejected_by string" + "".join(f", {c} long" for c in base)

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in K.text_slices(batches):
            own = Slice(data, offsets)
            for name in first:
                own.measure(name)
            verdict = cascade(own, ordered)
            names = [ordered[i].name if i >= 0 else None for i in verdict.tolist()]
            columns = [rows.column("_id"), pa.array(own.measure("n_words").astype(np.int64)), pa.array(verdict < 0), pa.array(names, pa.string())]
            columns += [pa.array(own.measure(c).astype(np.int64)) for c in base]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "n_words", "kept", "rejected_by", *base])

    picked = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return quality_rules(docs, with_base=True).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), "kept",
    )


_SPACES = r"[\x20\x09-\x0D]"
OP6_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[i:i+7], ' ')) AS c
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
        FROM r, (SELECT unnest(range(0, 8)) AS k) WHERE c > 1 GROUP BY doc_id),
m AS (SELECT w.doc_id, t, ls, ws, len(ws)::BIGINT AS n_words,
             list_sum(list_transform(ws, lambda x: length(x)))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             len(string_split(t, chr(10))) AS n_lines,
             len(list_filter(ws, lambda x: regexp_matches(x, '[A-Za-z]') OR strlen(x) > length(x))) AS n_alpha,
             length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
             length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS n_letters
      FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 10 * n_words OR coalesce(word_chars, 0) < 2 * n_words
            OR coalesce(word_chars, 0) > 12 * n_words OR 100 * n_dup_lines > 30 * n_lines
            OR 100 * n_alpha < 80 * n_words OR (n_letters > 0 AND 100 * n_upper > 60 * n_letters)) AS kept
FROM b
"""
