"""Token counts over long runs of signs that hold apostrophes."""

import random

from tieledger.llm import tokencount
from tieledger.llm.tokens import TokenIds


def test_runs_of_apostrophes_have_cuts():
    ids = TokenIds(None)
    count = tokencount.Counter(ids)
    text = "'" * 80_000
    tree = tokencount.Tree.over(text, count)
    assert tree.root.leaves > 100 and tree.n_tokens == len(ids.encode(text))
    new, encoded = tree.edit(text, 40_000, 0, "x", count)
    assert encoded < 2_000 and tree.n_tokens == len(ids.encode(new))


def test_contractions_beside_cuts():
    ids = TokenIds(None)
    count, draw = tokencount.Counter(ids), random.Random(5)
    for signs in ["'", "'!", "'s", "''''s", "'!-s t", "é'漢", "'re l", "''''''''''''''''s1"] * 6:
        text = "".join(draw.choice(signs) for _ in range(draw.randrange(3000)))
        tree = tokencount.Tree.over(text, count)
        for _ in range(6):
            new = "".join(draw.choice(signs + "s'") for _ in range(draw.randrange(4)))
            text, _ = tree.edit(text, draw.randrange(len(text) + 1), draw.choice([0, 1, 2, 300, 700]), new, count)
            assert tree.n_tokens == len(ids.encode(text))
