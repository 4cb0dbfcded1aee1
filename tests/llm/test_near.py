"""Near duplicates: exact mode, large groups of near copies, templated texts, and the work that they make."""

import random

import numpy as np
import pytest
from llm import brute

from rangelake.llm import minhash

WORDS = [f"w{k}" for k in range(3000)]



def components(df, **options):
    return {r.doc_id: r.component_id for r in minhash.near_duplicates(df, **options).collect()}


def plain(rows, width, percent):
    return {i: c for i, _, c in brute.near(rows, width, percent)}


def near_copies(n, other):
    """Copies of one text with one to three words of 60 changed: some linked, some not."""
    rng = random.Random(1)
    base, rows = [rng.choice(WORDS) for _ in range(60)], []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(60)] = rng.choice(WORDS)
        rows.append((k, " ".join(w)))
    return rows + [(n + k, " ".join(rng.choice(WORDS) for _ in range(60))) for k in range(other)]


def templated(n):
    """Texts with eight words in common and six of their own, and a linked one for every tenth."""
    rng = random.Random(2)
    rows = [(k, " ".join([f"t{j}" for j in range(8)] + [f"v{rng.randrange(10**6)}" for _ in range(6)])) for k in range(n)]
    return rows + [(n + k, rows[10 * k][1] + " x") for k in range(n // 10)]


@pytest.mark.parametrize("make, exact", [(lambda: near_copies(200, 30), False), (lambda: templated(300), True)])
def test_large_clusters_are_whole(spark, monkeypatch, make, exact):
    """With small blocks and short lists, so that every path is taken."""
    monkeypatch.setattr(minhash, "BLOCK", 3000)
    monkeypatch.setattr(minhash, "ROWS", 50)
    monkeypatch.setattr(minhash, "LIST_PAIRS", 200)
    rows = make()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert components(df, width=5, percent=80, exact=exact) == plain(rows, 5, 80)


def test_exact_mode_on_awkward_rows(odd, nothing):
    got = minhash.near_duplicates(odd, width=3, percent=85, exact=True).collect()
    want = brute.near([(r.doc_id, r.text) for r in odd.collect()], 3, 85)
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted((str(i), n, str(c)) for i, n, c in want)
    assert minhash.near_duplicates(nothing, exact=True).count() == 0


def test_pairs_of_a_large_group_stay_few(spark, monkeypatch):
    made, plain_alike = [], minhash._alike

    def alike(pairs, *more):
        made.append(pairs.count())
        return plain_alike(pairs, *more)

    monkeypatch.setattr(minhash, "_alike", alike)
    n = 600
    df = spark.createDataFrame(near_copies(n, n), "doc_id long, text string").repartition(4)
    assert minhash.near_duplicates(df, width=5, percent=80).count() == 2 * n
    assert sum(made) < 25 * n


def test_templates_make_no_pairs(spark, monkeypatch):
    """Alike enough for one cluster, and not linked: what is checked on full sets stays near the links."""
    checked, plain_links = [], minhash._links

    def links(pairs, *more):
        checked.append(pairs.count())
        return plain_links(pairs, *more)

    monkeypatch.setattr(minhash, "_links", links)
    rows = templated(3000)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = components(df, width=5, percent=80)
    assert sum(checked) < 4 * len(rows)
    assert all(got[3000 + k] == 10 * k for k in range(300)) and len(set(got.values())) == 3000


@pytest.mark.parametrize("sparse", [False, True])
def test_both_ways_to_count_shared_hashes(sparse):
    rng = np.random.default_rng(1)
    top = 10**7 if sparse else 300
    shared = np.unique(rng.integers(0, top, 40))
    sets = [np.unique(np.concatenate([shared, rng.integers(0, top, rng.integers(1, 30))])) for _ in range(60)]
    hit = minhash.linked(sets[:25], sets[25:], 60)
    for i, a in enumerate(sets[:25]):
        for j, b in enumerate(sets[25:]):
            n = len(np.intersect1d(a, b))
            assert hit[i, j] == (100 * n >= 60 * (len(a) + len(b) - n))
