"""Each operator against a brute-force version, and on awkward rows."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from verdance.llm import (
    decontamination,
    kernels,
    line_dedup,
    ngram_jaccard,
    packing,
    quality_classifier,
    quality_rules,
    suffix_dedup,
    token_ids,
    token_output,
    toxicity,
    url_filter,
)

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{k % 700}" for k in range(30_000))
REPEATED = "this sentence of more than one hundred bytes stands in several documents, word for word and byte for byte. "
ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (5, "one two three"), (6, LONG), (7, LONG), (8, "é ü\nline of text that is long enough\n" + REPEATED),
    (9, "Line of TEXT that is long enough \nother " + REPEATED), (10, "line of text that is long enough\n" + REPEATED + REPEATED), (None, "a row without id " + REPEATED), (12, "x <|endoftext|>  y"), (4, "one two three"),
]
SCHEMA = "doc_id long, text string, n long, _id string, key string, node string, score double"


@pytest.fixture(scope="module")
def odd(spark):
    """Awkward rows, with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, 7, "a", "b", "c", 0.5) for i, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def texts():
    return pd.read_parquet(f"{SF}/documents.parquet", columns=["doc_id", "text"])


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return sorted((i, len(s), find(i)) for i, s in sets)


def test_jaccard_join(spark, odd, empty, texts):
    got = sorted(map(tuple, ngram_jaccard.ngram_jaccard_join(odd).collect()))
    assert got == brute_components(ROWS)
    assert ngram_jaccard.ngram_jaccard_join(empty).count() == 0


def test_jaccard_join_on_a_table(spark, texts):
    got = sorted(map(tuple, ngram_jaccard.op1(spark, SF).collect()))
    assert got == brute_components(list(texts.itertuples(index=False, name=None)))


def test_light_sets_share_the_subsets_they_must():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = set(rng.choice(14, rng.integers(1, 11), replace=False).tolist())
        b = set(rng.choice(14, rng.integers(1, 11), replace=False).tolist())
        keys = [{(k, s) for k in ngram_jaccard.subset_sizes(len(x), 12) for s in map(tuple, np.array(sorted(x))[ngram_jaccard.subsets(len(x), k)].tolist())} for x in (a, b)]
        if 100 * len(a & b) >= 80 * len(a | b):
            assert keys[0] & keys[1]


def test_boundary_follows_cost():
    assert ngram_jaccard.chosen_boundary({3: 1000}, 5.0) >= 3
    assert ngram_jaccard.chosen_boundary({16: 1000}, 0.0) < 16


def brute_suffix(rows, length=100):
    seen, out = {}, []
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            if raw[k : k + length] in seen:
                gone[k : k + length] = True
            seen[raw[k : k + length]] = 1
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix_dedup(spark, odd, empty):
    rows = [r for r in dict(ROWS).items() if r[0] != 7]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.suffix_dedup(df).where("doc_id IS NOT NULL").drop("kept")
    assert sorted(map(tuple, got.collect())) == brute_suffix(rows)
    assert suffix_dedup.suffix_dedup(odd).count() == len(ROWS)
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_loser_tree_merges_front_coded_runs():
    rng = np.random.default_rng(2)
    keys = [bytes(rng.choice([97, 98], rng.integers(0, 9)).tolist()) for _ in range(400)]
    runs = [sorted((k, (n, 0, 0, 0)) for n, k in enumerate(keys) if n % 7 == r) for r in range(7)]
    out = list(suffix_dedup.merged([suffix_dedup.decoded(suffix_dedup.front_coded(r)) for r in runs]))
    assert [k for _, k, _ in out] == sorted(keys)
    before = b""
    for shared, key, _ in out:
        assert shared == suffix_dedup.common_prefix(before, key, 0)
        before = key


def test_line_dedup(spark, odd, empty):
    out = line_dedup.line_dedup(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_dropped"] and out.count() == len(ROWS)
    by_id = {r["doc_id"]: r for r in out.collect()}
    assert (by_id[8]["n_dropped"], by_id[9]["n_dropped"], by_id[10]["n_dropped"]) == (1, 1, 0)
    assert by_id[8]["text"] == "é ü\n" + REPEATED and by_id[1]["n_lines"] == 1 and by_id[1]["text"] == ""
    assert line_dedup.line_dedup(empty).count() == 0


@pytest.mark.parametrize("op,sql", [(line_dedup.op8, line_dedup.OP8_SQL), (quality_rules.op6, quality_rules.OP6_SQL)])
def test_same_rows_as_sql(spark, op, sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    ours, theirs = op(spark, SF).toPandas(), con.execute(sql).df()[op(spark, SF).columns]
    assert ours.sort_values("doc_id").values.tolist() == theirs.sort_values("doc_id").values.tolist()


def test_native_operators_run_no_python(spark):
    for df in (line_dedup.op8(spark, SF), url_filter.op2(spark, SF)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_url_rules(spark):
    urls = ["http://a.net/x", "http://example.net/en/1?q", "http://EXAMPLE.net/de/", "https://m.example.com/de/x", "x://b.org/fr/", "b.org/fr/", None, "http://notexample.com/de/", "http://a.org/fr"]
    df = spark.createDataFrame([(k, u, "z") for k, u in enumerate(urls)], "page_id long, url string, score string")
    got = {r["page_id"]: r for r in url_filter.url_filter(df).collect()}
    assert [got[k]["rule"] for k in range(9)] == ["net/", "example.net/en/", "net/", "example.com/de/", "org/fr/", None, None, None, None]
    assert got[2]["host"] == "example.net" and got[1]["path"] == "/en/1" and (got[5]["host"], got[6]["path"]) == ("", "")
    assert {r["verdict"] for r in got.values()} <= {"allow", "block"} and "score" in got[0].asDict()


def test_url_models_tell_the_rules_addresses_apart(spark):
    out = url_filter.url_filter(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").drop("html"))
    assert {r["verdict"] for r in out.where("rule IS NULL").collect()} == {"allow", "block"}


def ids_of(text, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_ids.default_vocabulary())
    return np.append(np.array(t.encode(text or "", add_special_tokens=False).ids, "<u4"), end).astype("<u4")


def test_encoder_equals_whole_texts():
    rng = np.random.default_rng(4)
    parts = [" ", "  ", "\n", "\n\n", "\t", "a", "é", "1", "'s", "!", ".", ",", "\r", "\u3000", "\x1c", "\x85", "Word", "\0", "<|endoftext|>"]
    own = token_ids.encoder(token_ids.default_vocabulary())
    many = ["".join(rng.choice(parts, 14)) for _ in range(3000)]
    assert own.encode_many(many) == own.whole(many)


def test_encoder_on_words_of_many_scripts():
    rng = np.random.default_rng(5)
    words = ["été", "Ça,", "слово.", "ßtraße!", "语言", "e\u0301a", "x" * 70, "é" * 70 + ",", "don't", "12", "٣", "ªº", "ǅ", "İ", "\u0530", "Ա", "-a", "a\u00ad"]
    own = token_ids.Encoder(token_ids.default_vocabulary())
    many = ["".join(w + s for w, s in zip(rng.choice(words, 9), rng.choice([" ", "\n", " ", "", "\n\n"], 9))) for _ in range(2000)]
    assert own.encode_many(many) == own.whole(many)
    assert own.encode_many([]) == [] and own.encode_many(["", "a"]) == own.whole(["", "a"])
    assert not any(len(w) > 64 for w in own.cache)


def test_packing(spark, odd, empty):
    rows = packing.pack(odd).toPandas()
    fill = rows.groupby("sequence_id")["length"].sum()
    assert all(n == 2048 or n & (n - 1) == 0 for n in fill)
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert (own["offset"].to_numpy() == np.r_[0, np.cumsum(own["length"])[:-1]]).all()
    want = ids_of(LONG, 1)
    own = rows[rows.doc_id == 6].sort_values("start")
    assert own["length"].sum() == len(want) == own["doc_tokens"].iloc[0]
    assert all(zlib.crc32(want[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own.itertuples())
    assert packing.pack(empty).count() == 0


def test_sum_of_squares_levels():
    levels = packing.Levels(8)
    assert levels.place((0, 0, 5)) is None and levels.place((1, 0, 3)) == [(0, 0, 5), (1, 0, 3)]
    for k in range(5):
        levels.place((k, 0, 6))
    assert all(sum(p[2] for p in own) in (8, 4, 2, 1) for own in levels.flush())


def test_bit_planes_round_trip():
    ids = np.random.default_rng(5).integers(0, 50257, 20_011).astype("<u4")
    assert (token_output.decode_chunk(len(ids), *token_output.encode_chunk(ids)) == ids).all()


def test_token_output(spark, odd, empty):
    got = token_output.read_ids(token_output.write_ids(odd)).toPandas().sort_values("start")
    want = [ids_of(t, 0) for _, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))]
    assert got["n_tokens"].tolist() == [len(w) for w in want]
    assert got["ids_crc32"].tolist() == [zlib.crc32(w.tobytes()) for w in want]
    assert got["start"].tolist() == np.r_[0, np.cumsum([len(w) for w in want])[:-1]].tolist()
    assert token_output.read_ids(token_output.write_ids(empty)).count() == 0


def test_decontamination(spark, odd, empty):
    item = "the quick brown fox jumps over the lazy dog while seven wizards brew a fine green potion"
    edited = item.replace("brown", "red").replace("lazy ", "")
    docs = spark.createDataFrame([(1, "before it. " + item.upper() + " after"), (2, "so " + edited + " so"), (3, "the quick brown cat sleeps all day long and dreams"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(5, item), (6, None), (7, "too short")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decontamination.contaminated(docs, items).collect()}
    assert set(got) == {(1, 5), (2, 5)} and got[1, 5] == 1 and got[2, 5] < 1
    assert decontamination.contaminated(odd, items).count() == 0 and decontamination.contaminated(empty, items).count() == 0
    assert decontamination.contaminated(docs, items.where("item_id = 0")).count() == 0
    assert {r["doc_id"] for r in decontamination.drop_contaminated(docs, items).collect()} == {3, 4}


def test_decontamination_finds_verbatim_items(spark, texts):
    items = pd.read_parquet(f"{SF}/benchmark.parquet")
    want = {(int(d), int(i)) for d, t in texts.itertuples(index=False) for i, x in items[["item_id", "text"]].itertuples(index=False) if x in (t or "")}
    assert want <= {(r["doc_id"], r["item_id"]) for r in decontamination.op4(spark, SF).collect()}


def test_alignment_equals_the_table():
    rng = np.random.default_rng(6)
    for _ in range(50):
        a, b = rng.integers(0, 4, 12).astype(np.uint64), rng.integers(0, 4, 15).astype(np.uint64)
        h = np.zeros((13, 16))
        for i in range(12):
            for j in range(15):
                h[i + 1, j + 1] = max(0, h[i, j] + (1 if a[i] == b[j] else -0.5), h[i, j + 1] - 0.5, h[i + 1, j] - 0.5)
        assert decontamination.smith_waterman(a, b)[0] == pytest.approx(h.max())


def test_cascade_order_changes_no_verdict(odd, empty):
    got = [{(r["doc_id"], r["n_words"], r["kept"]) for r in quality_rules.quality_rules(odd, rules).collect()} for rules in (quality_rules.RULES, quality_rules.RULES[::-1])]
    assert got[0] == got[1] and quality_rules.quality_rules(empty).count() == 0


@pytest.mark.parametrize("module,label,least", [(toxicity, "toxic", 0.93), (quality_classifier, "quality", 0.85)])
def test_held_out_accuracy(spark, odd, empty, module, label, least):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    model = module.train_from(docs, labels)
    out = module.score(docs, model).join(labels, "doc_id").toPandas()
    held = out[[zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]]
    assert (held["predicted"] == held[label]).mean() >= least
    rows = module.score(odd, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert module.score(empty, model).count() == 0


def test_windows_of_bytes_do_not_depend_on_neighbours():
    model = quality_classifier._fit([np.frombuffer(b"some text here", np.uint8)], np.array([1]), 1, np.random.default_rng(0))
    a, b = np.frombuffer(LONG.encode(), np.uint8), np.frombuffer(b"other", np.uint8)
    both = quality_classifier.logits(model, np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    alone = [quality_classifier.logits(model, x, np.array([0, len(x)]))[0] for x in (a, b)]
    assert np.allclose(both, alone, rtol=1e-4, atol=1e-4)


def test_slices_hold_whole_documents():
    import pyarrow as pa

    batch = pa.record_batch({"text": pa.array(["a" * 50, None, "b" * 500, ""], pa.string())})
    parts = list(kernels.text_slices(iter([batch]), limit=100))
    assert sum(p[0].num_rows for p in parts) == 4 and b"".join(p[1].tobytes() for p in parts) == b"a" * 50 + b"b" * 500


def test_bitmaps_never_bound_above_the_difference():
    rng = np.random.default_rng(7)
    for n, m, both in [(1, 1, 0), (5, 4, 4), (64, 80, 60), (700, 650, 600), (3000, 2500, 2400), (40_000, 33_000, 32_000)]:
        pool = np.unique(rng.integers(0, 2**63, n + m, dtype=np.uint64))
        s, t = pool[:n], np.concatenate([pool[:both], pool[n : n + m - both]])
        d = ngram_jaccard.least_difference(ngram_jaccard.parity_bitmap(s), ngram_jaccard.parity_bitmap(t))
        assert d <= n + m - 2 * both
    assert ngram_jaccard.parity_bitmap(pool[:0]) == bytes(ngram_jaccard.LEAST_BITS // 8)


CLASHING = "doc_id long, text string, _leak string, _gone string, n_lines string, n_dropped string, _id string, _row string, _y string, lang string"


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(i, t, *"abcdefgh") for i, t in ROWS]
    return spark.createDataFrame(rows, CLASHING)


def test_columns_named_like_inner_ones(spark, clashing):
    items = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    kept = decontamination.drop_contaminated(clashing, items)
    assert kept.columns == clashing.columns and {r["doc_id"] for r in kept.collect()}.isdisjoint({4, 5})
    one = ngram_jaccard.one_of_each(clashing)
    assert one.columns == clashing.columns and {5, 7}.isdisjoint({r["doc_id"] for r in one.collect()})
    lines = line_dedup.line_dedup(clashing)
    assert lines.columns == [c for c in clashing.columns if c not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"] and lines.count() == len(ROWS)


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality_classifier, "quality")])
@pytest.mark.parametrize("kinds", [[], [0], [1]])
def test_labels_of_one_kind_or_none(spark, clashing, module, label, kinds):
    labels = spark.createDataFrame([(i, k) for i in (1, 4, 5, 6, 8, 9) for k in kinds], f"doc_id long, {label} int")
    model = module.train_from(clashing, labels)
    rows = module.score(clashing, model).collect()
    assert len(rows) == len(ROWS) and all(r["score"] < 1e-9 and r["predicted"] == 0 for r in rows)
    if module is toxicity:
        assert toxicity.drop_toxic(clashing, model).count() == len(ROWS)


def test_training_makes_the_toxicity_scores(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (pd.read_parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.merge(labels, on="doc_id")
    rows["text"], rows["y"] = rows["text"].fillna(""), rows["toxic"]
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id])
    caught = []
    for epochs in (0, None):
        model = toxicity.train(rows[~held], epochs)
        import pyarrow as pa

        batch = pa.record_batch({"text": pa.array(rows["text"].tolist(), pa.large_string())})
        p = np.concatenate([toxicity.scores(model, data, offsets) for _, data, offsets in kernels.text_slices(iter([batch]))])
        caught.append(((p >= 0.5) & (rows["toxic"] == 1)).sum() / (rows["toxic"] == 1).sum())
        if epochs is None:
            assert ((p >= 0.5) & (rows["toxic"] == 0)).sum() <= 4
    assert caught[0] < 0.5 and caught[1] >= 0.85


def test_rows_that_share_an_id_keep_what_repeats_nowhere(spark):
    alone = " ".join(f"only{k}" for k in range(60))
    rows = [(1, REPEATED * 2), (2, "x" + REPEATED), (2, alone), (-3, REPEATED)]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(i, n) for i, n, *_ in [(1, 0), (2, 0), (2, 0), (-3, 0)]]
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in want)
    by_size = {r["n_bytes"]: r["n_removed"] for r in got}
    assert by_size[len(alone)] == 0 and by_size[len(REPEATED)] == 0 and by_size[len(REPEATED) + 1] == len(REPEATED)
    assert by_size[2 * len(REPEATED)] == 2 * len(REPEATED)


def test_small_cache_gives_the_same_ids():
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{k}x" for k in rng.integers(0, 3000, 40)) for _ in range(200)]
    small = token_ids.Encoder(token_ids.default_vocabulary(), most_bytes=100_000)
    assert [x for k in range(0, 200, 20) for x in small.encode_many(texts[k : k + 20])] == small.whole(texts)
    assert len(small.cache) + len(small.older) < 1500


def test_common_passage_does_not_hide_links(spark):
    """A passage in half of all documents, near copies of both kinds, against brute force."""
    rng = np.random.default_rng(9)
    say = lambda n: [f"w{k}" for k in rng.integers(0, 5000, n)]
    passage, rows, near = say(50), [], say(80)
    for k in range(160):
        kind = k % 4
        if kind == 0:
            text = say(int(rng.integers(2, 9))) + passage
        elif kind == 1:
            text = say(3) + passage + say(int(rng.integers(2, 14)))
        elif kind == 2:
            text = list(near)
            for at in rng.choice(80, rng.integers(0, 4), replace=False):
                text[at] = f"e{k}"
        else:
            text = say(int(rng.integers(1, 30)))
        rows.append((k, " ".join(text)))
    got = sorted(map(tuple, ngram_jaccard.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute_components(rows)


def test_names_that_clash_are_told_apart():
    s, t = np.arange(5, dtype=np.uint64), np.arange(1, 6, dtype=np.uint64)
    a, b = ngram_jaccard.names_of(s), ngram_jaccard.names_of(t)
    assert len({*a, *b}) == 4 and ngram_jaccard.node_of(s) == a[0] and ngram_jaccard.node_of(s, frozenset([a[0]])) == a[1]


def test_cut_of_the_url_scores(spark):
    rows = [(-9.0, "block", 5), (-8.5, "block", 1), (3.0, "allow", 2), (40.0, "allow", 7), (1.0, None, 50)]
    df = spark.createDataFrame(rows, "score double, label string, n long")
    assert -8.5 < url_filter.calibrated_cut(df) <= 3.0
    assert url_filter.calibrated_cut(df.where("label = 'allow'")) == float("-inf")


def test_url_model_against_brute_force(spark):
    """Scores of the interpolated models, worked out one character at a time."""
    urls = [("http://a.net/xyz", "block"), ("http://a.net/xxy", "block"), ("http://b.org/fr/q", "allow"), ("http://b.org/fr/zz", "allow"), ("http://c.com/xy", None), ("x", None)]
    order = 3
    grams = {l: {} for l in ("allow", "block")}
    pad = lambda u: "\x02" * order + u + "\x02"
    for u, l in urls:
        for i in range(len(u) + 1) if l else ():
            for k in range(order + 1):
                g = pad(u)[i + order - k : i + order + 1]
                grams[l][g] = grams[l].get(g, 0) + 1

    def p(l, w):
        out = 1 / 256
        for k in range(order + 1):
            g = w[order - k :]
            after = {x: n for x, n in grams[l].items() if len(x) == k + 1 and x[:k] == g[:k]}
            if after:
                out = (after.get(g, 0) + len(after) * out) / (sum(after.values()) + len(after))
        return out

    want = {u: np.mean([np.log(p("allow", pad(u)[i : i + order + 1])) - np.log(p("block", pad(u)[i : i + order + 1])) for i in range(len(u) + 1)]) for u, _ in urls}
    got = url_filter.language_model_scores(spark.createDataFrame([(u, l, 1) for u, l in urls], "url string, label string, n long"), order)
    assert {r["url"]: pytest.approx(want[r["url"]]) for r in got.collect()} == {r["url"]: r["score"] for r in got.collect()}


def test_packing_of_a_whole_table(spark, texts):
    rows = packing.op3(spark, SF).toPandas()
    for doc, own in rows.sort_values("start").groupby("doc_id"):
        want = ids_of(texts.text[texts.doc_id == doc].iloc[0], 1)
        assert own["start"].tolist() == np.r_[0, np.cumsum(own["length"])[:-1]].tolist() and own["length"].sum() == len(want) == own["doc_tokens"].iloc[0]
        assert own["ids_crc32"].tolist() == [zlib.crc32(want[a : a + n].tobytes()) for a, n in zip(own["start"], own["length"])]
    assert set(rows.doc_id) == set(texts.doc_id)


def test_suffix_dedup_of_a_whole_table(spark, texts):
    got = sorted(map(tuple, suffix_dedup.op5(spark, SF).collect()))
    assert got == brute_suffix(list(texts.itertuples(index=False, name=None)))


def test_cascade_measures_once_and_equals_every_rule():
    calls = []

    class Counting(quality_rules.Slice):
        def _n_repeat_words(self):
            calls.append(len(self.offsets) - 1)
            return super()._n_repeat_words()

    texts = [t or "" for _, t in ROWS] * 5
    raw = [t.encode() for t in texts]
    base = Counting(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    base.measure("n_repeat_words")
    verdict = quality_rules.cascade(base, list(quality_rules.RULES))
    every = np.stack([r.rejects(base) for r in quality_rules.RULES])
    assert ((verdict < 0) == ~every.any(0)).all() and calls == [len(texts)]


def test_packing_keeps_few_words():
    """However many different words there are, a worker keeps about as many as it may, or those of one step."""
    own = token_ids.encoder(token_ids.default_vocabulary(), packing.CACHE)
    words = ["".join(chr(97 + (k // 26**j * 7 + j) % 26) for j in range(5)) + "abcdefg" for k in range(500_000)]
    texts = [" ".join(words[k : k + 100]) for k in range(0, len(words), 100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["_id", "text"])
    ids = [bytes(x) for _, x in token_ids.encoded_rows(own, batch, packing.STEP)]
    step = packing.STEP // len("wordabcdefg ")
    assert len(own.cache) + len(own.older) <= packing.CACHE // token_ids._ENTRY + 2 * step < len(words)
    assert ids[::1000] == own.whole(texts[::1000])
