"""Near copies of the pipeline's second stage against all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.brute import WORDS, components
from tests.llm.test_near_duplicates import table, texts
from vectide.llm import simhash

pytestmark = pytest.mark.seconds(150)


def shingles(text, n=5):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode())
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def all_pairs(docs):
    sets = {i: shingles(t) for i, t in docs}
    close = [(a, b) for a, b in combinations(sets, 2) if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0]
    return sets, components(sets, close)


def planted():
    """Per original a copy of similarity 0.8 to 0.95, and one well below 0.8; a passage common to all; a large group."""
    rng = random.Random(8)
    fresh = lambda k: [f"w{rng.randrange(10**9)}" for _ in range(k)]
    passage, out = fresh(60), []
    for o in range(150):
        words = fresh(rng.randint(60, 400)) + passage
        n = len(words) - 4
        keep = rng.uniform(0.8, 0.95)
        tail = int(n * (1 / keep - 1) / (1 + 1 / keep))  # so many words replaced at the end leave about that similarity
        out += [" ".join(words), " ".join(words[: len(words) - tail] + fresh(tail)), " ".join(words[: len(words) // 2] + fresh(len(words) // 2))]
    hub = fresh(300)
    out += [" ".join(hub[:i] + fresh(3) + hub[i + 3 :]) for i in rng.choices(range(290), k=130)]
    return list(enumerate(out, 1000))


def test_near_copies_at_0_8(spark):
    docs = texts() + planted()
    sets, root = all_pairs(docs)
    kept = corpus_pipeline.drop_near_duplicates(spark, table(spark, docs), "")
    assert kept.columns == table(spark, docs[:1]).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root.values()))


def test_bitmaps_never_rule_out_a_pair():
    rng = np.random.default_rng(3)
    for _ in range(300):
        pool = rng.integers(0, 1 << 63, 600).astype(np.uint64)
        a, b = np.unique(pool[: rng.integers(0, 400)]), np.unique(pool[rng.integers(0, 100) : rng.integers(100, 600)])
        assert simhash.fewest_differences(simhash.parity_bits(a), simhash.parity_bits(b)) <= len(np.setxor1d(a, b))


def test_hubs_lose_no_link(spark):
    """A large group of which no node alone is similar to all: hubs of two, and all pairs by brute force."""
    docs = texts(40) + planted()
    sets, root = all_pairs(docs)
    got = simhash.similar_groups(table(spark, docs), hub=2).collect()
    assert {r.doc_id: r.component_id for r in got} == root


def test_no_table(spark):
    assert corpus_pipeline.drop_near_duplicates(spark, table(spark, []), "").count() == 0
