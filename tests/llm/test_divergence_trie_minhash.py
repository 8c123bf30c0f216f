"""Source divergence, the prefix trie and MinHash dedup against brute force, on awkward rows too."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from math import comb

import duckdb
import numpy as np
import pandas as pd
import pytest

from verdance.llm import minhash_dedup, prefix_trie, source_divergence

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_sql(sql):
    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return Counter(con.execute(sql).fetchall())


def sql_order(df, columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


# Source divergence


def divergence(rows, min_docs=3, top=200):
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        counts[lang, source].update(terms)
        df[lang].update(set(terms))
    out = []
    for lang, source in groups:
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        sources = [s for x, s in groups if x == lang]

        def shares(own):
            total = sum(own[t] for t in kept) + len(kept)
            return [1 + 10**9 * (own[t] + 1) // total for t in kept]

        def f(p, q):
            return (p - q) ** 2 // q

        p = shares(counts[lang, source])
        pairs = [(sum(map(f, p, shares(counts[lang, s]))), s) for s in sources if s != source]
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        terms = [(f(a, b), t) for a, b, t in zip(p, q, kept) if counts[lang, source][t] and a > b]
        for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
            ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
            out += [(lang, source, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return Counter(out)


COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def test_divergence_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["The", "the", "été", "É", "naïve", "a", "Bb", "x-ray", "n0t", "中文", "zz", "_q_", "ﬁ"]
    rows = [
        (" ".join(rng.choices(vocabulary, k=rng.choice((0, 1, 3, 30, 400)))) or None, rng.choice(("en", "en", "de", "", None)), rng.choice(("s1", "s2", "s3", "", None)))
        for _ in range(120)
    ]
    rows += [("the the the", "en", "s1")] * 40 + [(None, "xx", "alone"), ("only once", "xx", "alone"), ("123 +", "yy", "a"), ("", "yy", "b")]
    rows.append((" ".join(rng.choices(vocabulary, k=40_000)), "de", "s1"))
    data = [(None if k % 7 == 0 else k % 50, *r, 1, "x") for k, r in enumerate(rows)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n long, term string").repartition(5)
    got = source_divergence.source_divergence(docs)
    assert sql_order(got, COLUMNS) == divergence(rows)
    assert sql_order(source_divergence.source_divergence(docs, 30, 2), COLUMNS) == divergence(rows, 30, 2)
    assert source_divergence.source_divergence(docs.limit(0)).count() == 0


def test_divergence_equals_its_sql(spark):
    assert sql_order(source_divergence.op11(spark, SF), COLUMNS) == by_sql(source_divergence.OP11_SQL)


def test_divergence_holds_little(spark, monkeypatch):
    """Partial runs and pairs are handed on in parts, with the same sums."""
    rows = [(f"w{chr(97 + k % 26)} the of", "en", f"s{k % 9}") for k in range(300)]
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string")
    for name, few in (("HELD", 10), ("PAIRS", 3), ("CHUNK", 7)):
        monkeypatch.setattr(source_divergence, name, few)
    assert sql_order(source_divergence.source_divergence(docs), COLUMNS) == divergence(rows)


def test_shares_are_exact():
    rng = np.random.default_rng(1)
    total = rng.integers(1, 9 * 10**15, 2000)
    count = (total * rng.random(2000)).astype(np.int64)
    expected = [1 + 10**9 * (c + 1) // t for c, t in zip(count.tolist(), total.tolist())]
    assert source_divergence.share(count, total).tolist() == expected


# Prefix trie


def trie(paths):
    """Node rows of {conv_id: [(turn, length), ...]}."""
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * p[-1][1] if p else 0
    return Counter(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p],
         hashlib.sha256(",".join(str(c) for c in sorted(m) if len(paths[c]) == len(p)).encode()).hexdigest())
        for p, m in members.items()
    )


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn(k):
    return hashlib.sha256(str(k).encode()).hexdigest()[:32], k + 1


@pytest.mark.parametrize("seed", range(4))
def test_ranges_share_spines(spark, seed):
    """More ranges than branches at the root: first turns, and whole paths, span ranges."""
    rng = random.Random(seed)
    paths = {}
    for c in rng.sample(range(10_000), 400):
        length = rng.choice((0, 1, 2, 5, 9, 30))
        hot = [turn(0), turn(1), turn(2)][: rng.randint(0, 3)] if rng.random() < 0.6 else []
        paths[c] = hot + [turn(rng.randrange(3 if seed % 2 else 40)) for _ in range(length)]
    paths |= {20_000 + k: [turn(7)] * 200 for k in range(30)} | {30_000: [turn(7)] * 3}
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        df = spark.createDataFrame(list(paths.items()), "conv_id long, turns array<struct<h string, len int>>")
        assert sql_order(prefix_trie.prefix_trie(df), NODE) == trie(paths)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def rebuilt(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            h = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own[c].append((t is not None, t or 0, h, len(text)))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    paths = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = turns.get(c - c % 100, [])[:h] + turns[c][h:]
    return paths


def test_trie_of_awkward_rows(spark):
    rows = [(c, t, "user" if t % 2 else "assistant", f"text {c % 7} {t}") for c in (0, 1, 2, 5, 99, 100, 101, 250, 333) for t in range(c % 9)]
    rows += [(None, 1, "user", "no id"), (1, None, None, None), (1, 3, "user", "tie"), (1, 3, "user", "tie"), (1, 3, "a", "another"), (700, 0, "user", "é" * 50_000)]
    rows += [(800, t, "user", "same") for t in range(300)] + [(801, t, "user", "same") for t in range(300)]
    table = spark.createDataFrame([(*r, "x", 3) for r in rows], "conv_id long, turn long, role string, text string, key string, depth long")
    got = prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.turn_arrays(table)))
    assert sql_order(got, NODE) == trie(rebuilt(rows))
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(prefix_trie.turn_arrays(table.limit(0)))).count() == 0


def test_trie_equals_its_sql(spark):
    assert sql_order(prefix_trie.op12(spark, SF), NODE) == by_sql(prefix_trie.OP12_SQL)


# MinHash dedup


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())


def components(rows):
    """The expected (doc_id, n_shingles, component_id, kept) of each row."""
    rows = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    lists, first = defaultdict(list), {}
    for k, (i, s) in enumerate(rows):
        met = Counter(j for x in s for j in lists[x])
        for j, n in met.items():
            if 100 * n >= 85 * (len(s) + len(rows[j][1]) - n):
                parent[root(k)] = root(j)
        for x in s:
            lists[x].append(k)
    for k, (i, _) in enumerate(rows):
        first[root(k)] = min(i, first.get(root(k), i))
    return Counter((i, len(s), first[root(k)], first[root(k)] == i) for k, (i, s) in enumerate(rows))


@pytest.fixture(scope="module")
def made():
    """Real texts, odd ones, copies, and families of edits on both sides of the threshold."""
    rng = random.Random(3)
    docs = pd.read_parquet(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    rows = list(docs.itertuples(index=False, name=None))
    rows += [(10**6 + k, t) for k, t in enumerate([None, "", " \t\n", "One two", "one TWO", "one", "É é", "é é", "x " * 5000, "x " * 7000])]
    rows += [(None, "a row without id"), (10**6, "one two"), (5, "one two three")]
    for f in range(6):
        base = [f"w{f}x{rng.randrange(5000)}" for _ in range(rng.choice((40, 300, 3000)))]
        for k in range(30):
            words = list(base)
            for _ in range(rng.randrange(1 + len(base) // 15)):
                words[rng.randrange(len(base))] = f"e{rng.randrange(10**9)}"
            rows.append((2 * 10**6 + 100 * f + k, " ".join(words)))
    rows += [(3 * 10**6 + k, "exact copy of a text with some words") for k in range(300)]
    return rows


def test_dedup_equals_brute_force(spark, made):
    table = spark.createDataFrame([(i, t, "b", 1) for i, t in made], "doc_id long, text string, node string, keys long").repartition(6)
    got = minhash_dedup.minhash_dedup(table)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "kept").collect()) == components(made)


def test_dedup_of_no_rows(spark):
    table = spark.createDataFrame([], "doc_id long, text string")
    assert minhash_dedup.minhash_dedup(table).count() == 0


def test_a_block_of_near_misses_is_seen_whole(spark, monkeypatch):
    """Buckets of all bands, in blocks of four nodes: every pair of two components that shares one and that
    signatures and bitmaps let through, once; all that link are among them."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 900).astype(np.uint64)
    sets = []
    for k in range(40):
        changed = rng.choice(900, rng.integers(0, 160), replace=False)
        own = base.copy()
        own[changed] = rng.integers(0, 2**63, len(changed)).astype(np.uint64)
        sets.append(np.unique(own[: 900 - 10 * (k % 5)]))
    marks = minhash_dedup.minima(sets)
    bits = [np.unpackbits(np.frombuffer(minhash_dedup.parity(s), np.uint8)) for s in sets]
    keys = minhash_dedup.band_keys(marks).view(np.int64)
    lengths = Counter(keys.reshape(-1).tolist())
    rows = [(int(keys[k, b]), b, k, len(sets[k]), k // 3, lengths[int(keys[k, b])], bytearray(marks[k].tobytes()), bytearray(minhash_dedup.parity(sets[k]))) for k in range(40) for b in range(32)]
    monkeypatch.setattr(minhash_dedup, "BLOCK", 4)
    table = spark.createDataFrame(rows, "key long, band int, node long, n long, component long, length long, signature binary, parity binary").where("length > 1")
    got = [(r.a, r.b, r.apart) for r in minhash_dedup.block_pairs(table).collect()]
    expected, links = [], 0
    for i in range(40):
        for j in range(i + 1, 40):
            a, b, same = len(sets[i]), len(sets[j]), marks[i] == marks[j]
            agree = same.reshape(-1, 32).sum(1).cumsum()
            stays = (agree >= minhash_dedup.LEAST).all() and 185 * int((bits[i] != bits[j]).sum()) <= 15 * (a + b) and 100 * min(a, b) >= 85 * max(a, b)
            if i // 3 != j // 3 and stays and same.reshape(32, 4).all(1).any():
                expected.append((i, j, int(128 - agree[-1])))
            if i // 3 != j // 3 and 100 * len(np.intersect1d(sets[i], sets[j])) >= 85 * len(np.union1d(sets[i], sets[j])):
                links += 1
                assert expected[-1][:2] == (i, j)
    assert sorted(got) == expected and 20 < links <= len(expected) < 500


def test_bounds_are_the_posterior():
    """The least agreements are where the posterior first leaves the threshold MISS or more."""
    t = Fraction(85, 100) + Fraction(15, 6553600)
    for k, least in enumerate(minhash_dedup.LEAST):
        m = 32 * (k + 1)
        tail = [sum(comb(m + 1, x) * t**x * (1 - t) ** (m + 1 - x) for x in range(s + 1)) for s in (least - 1, least)]
        assert tail[0] < minhash_dedup.MISS <= tail[1]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for share in (0.5, 0.85, 0.95):
        both = int(2000 * 2 * share / (1 + share))
        a, b = x[:2000], np.append(x[:both], x[2000 : 4000 - both])
        agree = []
        for k in range(30):
            one, two = minhash_dedup.minima([a ^ np.uint64(k * 7919), b ^ np.uint64(k * 7919)])
            agree.append((one == two).mean())
        assert abs(np.mean(agree) - both / (4000 - both)) < 0.02
