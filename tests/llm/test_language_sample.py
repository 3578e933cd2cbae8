"""The sample of a language that is mostly copies."""

import random

import pytest

from vectide.llm import langid

pytestmark = pytest.mark.seconds(120)


def test_language_of_many_copies(spark):
    """A language that is mostly one text still has all its other texts in the sample, and so its centroid."""
    rng = random.Random(1)
    for seed in range(3):
        copies = spark.range(20_000).selectExpr(f"'hello there my friend {seed}' as text", "'xx' as lang")
        rare = [("".join(rng.choices("abcdefgh ", k=40)), "xx") for _ in range(9)]
        more = [("".join(rng.choices("stuvwxyz ", k=40)), "yy") for _ in range(30)]
        docs = copies.union(spark.createDataFrame(rare + more, "text string, lang string"))
        model = langid.train(docs, per_language=10, clusters=10)
        assert model.languages.count("xx") == model.languages.count("yy") == 10
