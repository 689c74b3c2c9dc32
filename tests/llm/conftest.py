import random

import pytest


@pytest.fixture
def words():
    """A function that makes a text of n words from a seed."""
    def make(n, seed, vocabulary=5000):
        r = random.Random(seed)
        return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))
    return make
