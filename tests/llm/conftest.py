import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tests_llm import clash, words  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empties, blanks, repeats, ties and one long text."""
    rng = random.Random(5)
    long = words(rng, 30_000)
    pairs = [(1, None), (2, ""), (None, "alpha beta"), (None, None), (5, "  \n\t "), (6, long), (7, long), (8, "a"), (8, "a"),
             (8, "b"), (9, "Ünï çødé 日本 😀 text"), (10, "x" * 50_000), (11, "a")]
    return clash(spark, pairs), pairs


@pytest.fixture(scope="session")
def none(spark):
    return clash(spark, [])
