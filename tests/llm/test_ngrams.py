from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa

from umbra.llm import ngrams
from umbra.llm.components import components


def brute(rows):
    """{row: (size, component)} by comparing all pairs."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (id_, _) in enumerate(rows):
        least[root(i)] = min((x for x in (least.get(root(i)), id_) if x is not None), default=None)
    return sorted(((id_, len(sets[i]), least[root(i)]) for i, (id_, _) in enumerate(rows)), key=str)


def corpus(seed: int, n: int = 260):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows, texts = [], []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.15:
            text = rng.choice(texts)
        elif texts and kind < 0.6:
            words = rng.choice(texts).split()
            for _ in range(rng.choice([1, 1, 2, 3, max(1, len(words) // 40), max(1, len(words) // 25)])):
                at = rng.randrange(len(words)) if words else 0
                words[at : at + rng.choice([0, 1])] = [rng.choice(vocabulary)]
            text = " ".join(words)
        else:
            words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 3, 5, 6, 8, 12, 20, 40, 90, 200, 500]))]
            if rng.random() < 0.4:
                words[len(words) // 2 : len(words) // 2] = passage
            text = " ".join(words)
        texts.append(text)
        rows.append((i * 3 + 1, text))
    rng.shuffle(rows)
    return rows


def clustered(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngrams.cluster(df, **more).collect()), key=str)


def test_against_all_pairs(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        assert clustered(spark, rows) == brute(rows)


def test_without_first_candidates(spark, monkeypatch):
    """Small blocks: the comparison across components in parts."""
    monkeypatch.setattr(ngrams, "BLOCK", 4)
    rows = corpus(3, 150)
    assert clustered(spark, rows) == brute(rows)


def test_large_groups_by_rarer_words(spark, monkeypatch):
    """Groups of more than a few nodes are not compared; their nodes emit other words."""
    monkeypatch.setattr(ngrams, "HOT", 3)
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(80)]
    rows = corpus(4, 120)
    for i in range(60):  # a long passage and a little of their own: unlinked, but with words in common
        own = [f"o{i}x{k}" for k in range(rng.choice([30, 40, 60]))]
        rows.append((1000 + i, " ".join(passage + own)))
        if i % 3 == 0:
            rows.append((2000 + i, " ".join(passage + own[:-1] + ["z"])))
    assert clustered(spark, rows) == brute(rows)


def test_chain_of_edits(spark):
    words = [f"v{i}" for i in range(300)]
    rows = []
    for i in range(25):
        rows.append((100 - i, " ".join(words)))
        words[i * 10] = f"new{i}"
    assert clustered(spark, rows) == brute(rows)


def test_null_and_repeated_ids(spark):
    """Chains through null ids; a third of the ids null; ids that stand for several texts; rows that repeat as they are."""
    rng = random.Random(9)
    rows = [(None if rng.random() < 0.35 else rng.randint(1, 60), t) for _, t in corpus(5, 180)]
    rows += [(None, rows[0][1])] * 5 + [rows[3]] * 4
    assert clustered(spark, rows) == brute(rows)
    words = [f"v{i}" for i in range(120)]
    chain = []
    for i, id_ in enumerate((5, None, 9, None, None, 2)):
        chain.append((id_, " ".join(words)))
        words[i * 20 : i * 20 + 2] = [f"n{i}", f"m{i}"]
    assert clustered(spark, chain) == brute(chain) and {c for _, _, c in brute(chain)} == {2}


def test_names_that_clash(spark):
    rows = corpus(6, 120)
    assert clustered(spark, rows, name_bits=5) == brute(rows)


def test_one_row_of_each_group_stays(spark):
    text = " ".join(f"a{i}" for i in range(60))
    rows = [(1, text), (7, text + " x"), (7, "another text altogether with words of its own"), (8, ""), (9, None), (9, None), (None, text + " y"), (3, "short"), (3, "short"), (None, "only here null"), (2, text), (None, "only here null")]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, __a int, __b int").repartition(3)
    kept = sorted(map(str, (tuple(r) for r in ngrams.keep_one(df).collect())))
    want = [(1, text), (7, rows[2][1]), (8, ""), (9, None), (3, "short"), (None, "only here null")]
    assert kept == sorted(str((i, t, 1, 2)) for i, t in want)
    rows = corpus(8, 150)
    groups = {}
    for (id_, n, c) in brute(rows):
        groups.setdefault((c, None) if n else (c, id_), []).append(id_)
    left = sorted(r.doc_id for r in ngrams.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert left == sorted(min(g) for g in groups.values())


def test_case_and_white_space(spark):
    rows = [(1, "One two\tTHREE four five six"), (2, "one  two three\nfour FIVE six"), (3, "É t"), (4, "é t"), (5, "a\xa0b"), (6, "a b")]
    assert clustered(spark, rows) == brute(rows)


def test_every_linked_pair_shares_a_signature():
    rng = np.random.default_rng(4)
    for n in (4, 5, 9, 14, 30, 75, 160, 333, 700, 2500):
        for _ in range(20):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            most = int(ngrams.most_different(np.int64(n), np.int64(n)))
            swaps = int(rng.integers(0, most // 2 + 1))
            b = np.concatenate([a[swaps:], rng.integers(0, 2**63, swaps).astype(np.uint64)])
            if rng.random() < 0.5:
                b = a[: max(1, -(-n * 4 // 5))]
            sets = [np.sort(a), np.sort(b)]
            if 5 * len(np.intersect1d(a, b)) < 4 * len(np.union1d(a, b)):
                continue
            sizes = np.array([len(s) for s in sets])
            keys = {0: set(), 1: set()}
            for k, name in ngrams.signatures(np.concatenate(sets), sizes, np.array([0, 1])):
                for x, y in zip(k.tolist(), name.tolist(), strict=True):
                    keys[y].add(x)
            assert keys[0] & keys[1] or np.array_equal(*sets), n
            one, other = ngrams.bit_sketches(np.concatenate(sets), sizes)
            assert ngrams.may_link(*sizes.tolist(), one, other)


def test_groups_over_batches():
    keys = np.array([1, 1, 2, 3, 3, 3, 3, 4, 5, 5, 5, 5])
    nodes = np.array([7, 7, 1, 2, 4, 4, 9, 3, 1, 2, 3, 4])
    want = sorted({(3, 2), (3, 4), (3, 9), (5, 1), (5, 2), (5, 3), (5, 4)})
    for size in (1, 2, 3, 5, 12):
        batches = [pa.RecordBatch.from_arrays([pa.array(keys[a : a + size]), pa.array(nodes[a : a + size])], ["key", "node"]) for a in range(0, 12, size)]
        got = [tuple(r.values()) for b in ngrams._groups(batches) for r in b.to_pylist()]
        assert sorted(got) == want, size


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (102, 101), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd, empty):
    got = {(r.doc_id, r.n_shingles): r.component_id for r in ngrams.cluster(odd).collect()}
    assert got[1, 0] == 1 and got[2, 0] == 2 and got[3, 0] == 3
    assert got[4, 1] == 4 and got[8, 1] == 4
    assert ngrams.cluster(odd).count() == odd.count()
    assert ngrams.cluster(empty).count() == 0
