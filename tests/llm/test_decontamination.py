"""Decontamination against the alignment of every item with every document."""

import numpy as np
import pytest

from verdance.llm import decontamination


def edited(rng, words, vocabulary, rate, kinds):
    """``words`` after about ``rate`` x their number of edits, at random places."""
    words = list(words)
    for k in sorted(rng.choice(len(words), round(rate * len(words)), replace=False).tolist(), reverse=True):
        kind = rng.choice(kinds)
        words[k : k + 1] = {"change": [rng.choice(vocabulary)], "add": [words[k], rng.choice(vocabulary)], "leave out": []}[str(kind)]
    return words


def everything(docs, items, threshold):
    """(document, item) -> (score, end) of the whole tables, without seeds."""
    texts, tests = (decontamination.block([i for i, _ in x], [t for _, t in x], threshold, 8).words for x in (docs, items))
    out = {}
    for (d, _), text in zip(docs, texts):
        for (i, _), test in zip(items, tests):
            score, end = decontamination.smith_waterman(test, text)
            if score / len(test) >= threshold:
                out[d, i] = score / len(test), end
    return out


@pytest.mark.parametrize("threshold", [0.6, 0.45])
def test_equals_the_alignment_of_everything(spark, threshold):
    rng = np.random.default_rng(11)
    vocabulary = [f"w{k}" for k in range(400)]
    common = 1 / np.arange(1, 401)
    say = lambda n: rng.choice(vocabulary, n, p=common / common.sum()).tolist()
    tests = [say(int(n)) for n in rng.integers(8, 60, 24)]
    docs = []
    for test in tests:
        for rate, kinds in ((0.15, ["change"]), (0.26, ["change"]), (0.3, ["leave out"]), (0.5, ["add"]), (0.7, ["add"]), (0.3, ["change", "add", "leave out"])):
            docs.append(say(int(rng.integers(0, 120))) + edited(rng, test, ["new"], rate, kinds) + say(int(rng.integers(0, 120))))
    docs = [(k, " ".join(x)) for k, x in enumerate(docs)]
    items = [(k, " ".join(x)) for k, x in enumerate(tests)]
    rows = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), threshold).collect()
    want = everything(docs, items, threshold)
    assert len(want) > 60 and {(r["doc_id"], r["item_id"]): (r["score"], r["end_word"]) for r in rows} == want


def test_only_copy_with_most_grams_broken(spark):
    """Every third word of the only copy is another, but for one run: most n-grams occur nowhere."""
    item = [f"word{k}" for k in range(30)]
    copy = [w if k % 4 != 1 or k > 26 else f"other{k}" for k, w in enumerate(item)]
    docs = spark.createDataFrame([(1, " ".join(copy))], "doc_id long, text string")
    items = spark.createDataFrame([(2, " ".join(item))], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, items).collect()] == [(1, 2)]


def test_batched_scores_equal_single_ones():
    rng = np.random.default_rng(12)
    a = [rng.integers(0, 5, n).astype(np.int32) for n in rng.integers(1, 20, 80)]
    b = [rng.integers(-1, 5, n).astype(np.int32) for n in rng.integers(1, 40, 80)]
    b = [np.where(x < 0, -2, x).astype(np.int32) for x in b]
    assert decontamination.best_scores(a, b).tolist() == [decontamination.smith_waterman(x, y)[0] for x, y in zip(a, b)]


def test_case_folds_beyond_ascii(spark):
    item = "Él añadió después: über große Straßen führen früh schöne Übungen, où l'été était déjà très près"
    docs = spark.createDataFrame([(1, "before " + item.upper() + " after"), (2, item.lower()), (3, None), (4, "")], "doc_id long, text string")
    items = spark.createDataFrame([(5, item), (6, item.upper())], "item_id long, text string")
    rows = decontamination.contaminated(docs, items).collect()
    assert {(r["doc_id"], r["item_id"], r["score"]) for r in rows} == {(1, 5, 1), (1, 6, 1), (2, 5, 1), (2, 6, 1)}


def test_bytes_that_are_no_text_stay():
    data = np.frombuffer(b"\xff\xc3 \xc3\x89t\xc3\xa9" + b"A b" + b"\xe9", np.uint8)
    data, offsets = decontamination.folded(data, np.array([0, 8, 11, 12]))
    assert data.tobytes() == b"\xff\xc3 \xc3\xa9t\xc3\xa9" + b"A b" + b"\xe9" and offsets.tolist() == [0, 8, 11, 12]


def test_short_items_match_word_for_word(spark):
    docs = [(1, "so The answer, is 42! so"), (2, "the answer is not 42"), (3, "他说北京是中国的首都，对吗"), (4, "北京是一座城市"), (5, "Paris"), (6, "parish")]
    items = [(10, "the answer is 42"), (11, "北京是中国的首都"), (12, "paris"), (13, "..."), (14, "中国的首都")]
    rows = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"], r["score"]) for r in rows} == {(1, 10, 1), (3, 11, 1), (3, 14, 1), (5, 12, 1)}
