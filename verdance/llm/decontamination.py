"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

The score of an item and a document is their best local alignment, word by
word, over that of the item with itself: changed, added and left-out words cost
a little each and do not hide a copy.  Seeds only spare alignments that cannot
reach the threshold; the result is that of aligning every item with every
document.

An alignment of a matches and e edits scores at most a - e/2.  To reach t times
the m words of the item it has e <= 2(1-t)m edits, and, as e edits leave e + 1
runs of matches at most, a - e - 1 >= (2t-1)m - 1 pairs of neighbouring words in
common with the item.  So an item's *grams* are its word pairs, of which so many
must stand in a document within so many diagonals.  Where that demands no pair
(few words or a low threshold), single words take their place: a >= tm of them.
In how many documents each gram occurs is counted over the whole corpus; the
commonest of an item are no seeds, and each lowers the demand by one.  Passages
that meet it are aligned in batches, and those that reach the threshold once
more for the place.

Documents are only scanned, twice, and never shuffled.  The items are taken in
blocks of bounded size, each broadcast, so the table of items may be of any
size; a block costs one more scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdance.llm import kernels as K
from verdance.llm import tables
from verdance.llm.toxicity import _BREAK

MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
BLOCK_CHARS = 8 << 20
BATCH_CELLS = 1 << 14
#: Letters of scripts without spaces between words (Thai to Burmese, Khmer, kana, Chinese): each is a word of its own.
UNSPACED = re.compile("([\u0e00-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff])")


@dataclass
class Items:
    """A block of items: word hashes of each, and their n-grams in sorted order."""

    ids: np.ndarray
    words: list[np.ndarray]
    width: np.ndarray  # of each item's n-grams
    need: np.ndarray  # how many of them every good alignment holds
    threshold: np.ndarray  # of each item's score
    gram: np.ndarray  # sorted, distinct
    first: np.ndarray  # of each gram's places; one more than grams
    item: np.ndarray
    place: np.ndarray


def _folded(text: str) -> str:
    return UNSPACED.sub(r" \1 ", text.casefold())


def folded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slice with the case of its non-ASCII texts folded as Unicode says, and ``UNSPACED`` letters apart; bytes that are no UTF-8 stay."""
    whole = data.tobytes()
    if whole.isascii():
        return data, offsets
    parts = [whole[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    parts = [t if t.isascii() else _folded(t.decode("utf-8", "surrogateescape")).encode("utf-8", "surrogateescape") for t in parts]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)], dtype=np.int64)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the case-folded runs of letters and digits, and each document's first."""
    data, offsets = folded(data, offsets)
    starts, ends, first = K.word_bounds(data, offsets, _BREAK)
    return K.word_hashes(data, starts, ends), first


def edits(m: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    """The most edits that a good alignment with an item of ``m`` words has."""
    return np.maximum(0, np.floor(2 * (1 - threshold) * m + 1e-9)).astype(np.int64)


def _demand(m: np.ndarray, threshold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(width, need): the n-grams to take of an item, and how many a good alignment holds."""
    pairs = np.ceil((2 * threshold - 1) * m - 1 - 1e-9).astype(np.int64)
    singles = np.ceil(threshold * m - 1e-9).astype(np.int64)
    return np.where(pairs > 0, 2, 1), np.maximum(1, np.where(pairs > 0, pairs, singles))


def block(ids: list[int], texts: list[str], threshold: float, least_words: int) -> Items:
    words: list[np.ndarray] = []
    for _, data, offsets in K.text_slices(iter([pa.record_batch({"text": pa.array(texts, pa.large_string())})])):
        hashes, first = words_of(data, offsets)
        words += [hashes[a:b] for a, b in zip(first[:-1], first[1:])]
    sizes = np.array([len(w) for w in words], np.int64)
    least = np.where(sizes < least_words, 1.0, threshold)  # short items count only as they are
    width, need = _demand(sizes, least)
    grams = [K.windows(w, k) for w, k in zip(words, width.tolist())]
    flat = np.concatenate([*grams, np.zeros(0, np.uint64)])
    item = np.repeat(np.arange(len(words)), [len(g) for g in grams])
    place = np.concatenate([*[np.arange(len(g)) for g in grams], np.zeros(0, np.int64)])
    by = np.argsort(flat, kind="stable")
    gram, first = np.unique(flat[by], return_index=True)
    return Items(np.array(ids, np.int64), words, width, need, least, gram, np.append(first, len(flat)), item[by], place[by].astype(np.int64))


def _hits(items: Items, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word, gram index) wherever an n-gram of the block stands in the slice."""
    found = []
    for width in np.unique(items.width).tolist():
        runs = K.windows(words, width)
        if not len(runs) or not len(items.gram):
            continue
        at = np.minimum(np.searchsorted(items.gram, runs), len(items.gram) - 1)
        place = np.flatnonzero(items.gram[at] == runs)
        doc = np.searchsorted(first, place, "right") - 1
        inside = place + width <= first[doc + 1]
        found.append((doc[inside], place[inside], at[place[inside]]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found))


def document_counts(docs: DataFrame, items: Items) -> np.ndarray:
    """In how many documents each n-gram of the block occurs; one row a gram reaches the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        counts = np.zeros(len(own.gram), np.int64)
        for _, data, offsets in K.text_slices(batches):
            doc, _, gram = _hits(own, *words_of(data, offsets))
            pairs = np.unique(doc * max(1, len(own.gram)) + gram)
            counts += np.bincount(pairs % max(1, len(own.gram)), minlength=len(counts))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], ["gram", "n"])

    rows = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(items.gram), np.int64)
    out[rows["gram"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def rare_seeds(items: Items, counts: np.ndarray) -> Items:
    """The block without the commonest grams of each item, and what is left of its demand.

    Of d grams that a good alignment holds, it still holds d - k when k are
    left out, so this loses nothing as long as one is still demanded."""
    gram_of = np.repeat(np.arange(len(items.gram)), np.diff(items.first))
    spare = items.need // 2
    by = np.lexsort((items.place, -counts[gram_of], items.item))
    start = np.searchsorted(items.item[by], np.arange(len(items.words)))
    keep = np.zeros(len(gram_of), bool)
    keep[by] = np.arange(len(by)) - start[items.item[by]] >= spare[items.item[by]]
    keep &= counts[gram_of] > 0
    gram, first = np.unique(gram_of[keep], return_index=True)
    return Items(items.ids, items.words, items.width, items.need - spare, items.threshold, items.gram[gram], np.append(first, keep.sum()), items.item[keep], items.place[keep])


def passages(items: Items, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, start, end) of the passages that hold all good alignments whole."""
    doc, place, gram = _hits(items, words, first)
    repeat = items.first[gram + 1] - items.first[gram]
    entry = np.repeat(items.first[gram], repeat) + np.arange(repeat.sum()) - np.repeat(np.cumsum(repeat) - repeat, repeat)
    doc, item, begin = np.repeat(doc, repeat), items.item[entry], np.repeat(place, repeat) - items.place[entry]
    sizes = np.array([len(w) for w in items.words], np.int64)
    most = edits(sizes, items.threshold)
    pair = doc * len(sizes) + item
    by = np.lexsort((begin, pair))
    pair, begin = pair[by], begin[by]
    # as many seeds as the item demands, on diagonals no further apart than edits can shift them
    item = pair % len(sizes)
    last = np.arange(len(pair)) + items.need[item] - 1
    at = np.minimum(last, max(0, len(pair) - 1))
    enough = np.flatnonzero((last < len(pair)) & (pair[at] == pair) & (begin[at] - begin <= most[item]))
    inside = np.zeros(len(pair) + 1, np.int64)
    np.add.at(inside, enough, 1)
    np.add.at(inside, last[enough] + 1, -1)
    use = np.cumsum(inside[:-1]) > 0
    pair, begin, item = pair[use], begin[use], item[use]
    doc = pair // len(sizes)
    lo = np.maximum(begin - most[item], first[doc])
    hi = np.minimum(begin + sizes[item] + most[item], first[doc + 1])
    new = np.ones(len(pair), bool)
    new[1:] = (pair[1:] != pair[:-1]) | (lo[1:] > hi[:-1])
    starts = np.flatnonzero(new)
    return doc[starts], item[starts], lo[starts], hi[np.append(starts[1:], len(pair))[: len(starts)] - 1]


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[float, int]:
    """(score, end in the passage) of the best local alignment.

    One numpy row for each word of the item; gaps along a row are a running
    maximum, since a gap costs the same for each word."""
    n = len(passage)
    row = np.zeros(n + 1)
    slope = -GAP * np.arange(n + 1)
    best, end = 0.0, 0
    for word in item:
        new = np.maximum(row + GAP, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(passage == word, MATCH, MISMATCH))
        row = np.maximum.accumulate(new + slope) - slope
        top = int(row.argmax())
        if row[top] > best:
            best, end = float(row[top]), top
    return best, end


def best_scores(items: list[np.ndarray], passages: list[np.ndarray]) -> np.ndarray:
    """The score of each pair as ``smith_waterman`` gives it, all pairs at once.

    Scores are held doubled, as whole numbers.  Cells of one anti-diagonal do
    not depend on each other; ids that are negative match nothing."""
    m, n, c = max(map(len, items)), max(map(len, passages)), len(items)
    kind = np.int16 if m < 1 << 13 else np.int32
    word = np.full((m, c), -1, np.int32)
    text = np.full((n + 2 * m, c), -2, np.int32)  # with m words of nothing on both sides
    for k, (a, b) in enumerate(zip(items, passages)):
        word[: len(a), k] = a
        text[m : m + len(b), k] = b
    before, last, now = (np.zeros((m + 1, c), kind) for _ in range(3))
    best, match = np.zeros((m, c), kind), np.empty((m, c), kind)
    hit, one, three = np.empty((m, c), bool), kind(1), kind(3)
    for d in range(m + n - 1):
        np.equal(word, text[d + 1 : d + m + 1][::-1], out=hit)
        np.multiply(hit, three, out=match)
        match += before[:-1]
        cell = now[1:]
        np.maximum(last[:-1], last[1:], out=cell)
        np.maximum(cell, match, out=cell)
        cell -= one
        np.maximum(cell, kind(0), out=cell)
        np.maximum(best, cell, out=best)
        before, last, now = last, now, before
    return best.max(axis=0) / 2


def _batches(m: np.ndarray, n: np.ndarray) -> Iterator[np.ndarray]:
    """Pairs of items and passages of like lengths, ``BATCH_CELLS`` of an anti-diagonal at once."""
    if not len(m):
        return
    long, tall = np.frexp(n.astype(float))[1], np.frexp(m.astype(float))[1]
    by = np.lexsort((n, tall, long))
    edge = np.flatnonzero((np.diff(long[by]) != 0) | (np.diff(tall[by]) != 0)) + 1
    for like in np.split(by, edge):
        step = max(1, BATCH_CELLS // int(m[like].max()))
        for k in range(0, len(like), step):
            yield like[k : k + step]


def alignments(docs: DataFrame, items: Items) -> DataFrame:
    """(doc_id, item_id, score, end_word) of each document and item that align well enough."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        sizes = np.array([len(w) for w in own.words], np.int64)
        known = np.unique(np.concatenate(own.words))
        item_words = [np.searchsorted(known, w).astype(np.int32) for w in own.words]
        for rows, data, offsets in K.text_slices(batches):
            words, first = words_of(data, offsets)
            doc, item, lo, hi = passages(own, words, first)
            at = np.minimum(np.searchsorted(known, words), len(known) - 1)
            ids = np.where(known[at] == words, at, -2).astype(np.int32)
            good = []
            for part in _batches(sizes[item], hi - lo):
                scores = best_scores([item_words[i] for i in item[part]], [ids[a:b] for a, b in zip(lo[part], hi[part])])
                good.append(part[scores / (MATCH * sizes[item[part]]) >= own.threshold[item[part]]])
            best: dict[tuple[int, int], tuple[float, int]] = {}
            for k in np.sort(np.concatenate([*good, np.zeros(0, np.int64)])).tolist():
                d, i = int(doc[k]), int(item[k])
                score, end = smith_waterman(own.words[i], words[lo[k] : hi[k]])
                score /= MATCH * int(sizes[i])
                if score > best.get((d, i), (0.0, 0))[0]:
                    best[d, i] = (score, int(lo[k] - first[d]) + end)
            keys = list(best)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id").take(pa.array([d for d, _ in keys], pa.int64())),
                    pa.array(own.ids[[i for _, i in keys]], pa.int64()),
                    pa.array([best[k][0] for k in keys], pa.float64()),
                    pa.array([best[k][1] for k in keys], pa.int64()),
                ],
                ["doc_id", "item_id", "score", "end_word"],
            )

    return docs.mapInArrow(run, "doc_id long, item_id long, score double, end_word long")


def blocks(items: DataFrame, item_id: str, item_text: str, threshold: float, least_words: int) -> Iterator[Items]:
    """The items in blocks of at most ``BLOCK_CHARS`` characters (or one item)."""
    picked = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    ids: list[int] = []
    texts: list[str] = []
    held = 0
    for row in picked.orderBy("item_id", "text").toLocalIterator():
        if ids and held + len(row["text"]) > BLOCK_CHARS:
            yield block(ids, texts, threshold, least_words)
            ids, texts, held = [], [], 0
        held += len(row["text"])
        ids.append(row["item_id"])
        texts.append(row["text"])
    if ids:
        yield block(ids, texts, threshold, least_words)


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = 0.6,
    least_words: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, score, end_word): documents that hold a test item or an edited copy.

    ``score`` is 1 for a whole verbatim copy; ``end_word`` is where the best
    alignment ends, in words of the document.  Items of fewer than
    ``least_words`` words match word for word only.  Null and empty texts hold
    nothing and match nothing.  A row with a null id is left out.  Repeated rows give repeated
    results.  Empty tables give no rows."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    out = None
    for own in blocks(items, item_id, item_text, threshold, least_words):
        if not len(own.gram):
            continue
        part = alignments(docs, rare_seeds(own, document_counts(docs, own)))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, end_word long")
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those that hold a test item; columns stay as they are, whatever their names."""
    found = contaminated(docs, items, id_col=id_col, text_col=text_col)
    leak = tables.free_name(docs, "_leak")
    found = tables.written(found.select(F.col("doc_id").alias(leak)).distinct(), "leaks")
    return docs.join(found, F.col(f"`{id_col}`").cast("long") == F.col(leak), "left_anti")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(tables.read(spark, sf_dir, "documents").select("doc_id", "text"), tables.read(spark, sf_dir, "benchmark"))
