"""Recall of long benchmark items at the limit of word edits."""

import random

import pytest
from test_decontaminate import edited

from ledgerloom.llm import decontaminate


@pytest.mark.parametrize("size", [60, 100, 200, 400, 800, 1600, 2000])
def test_recall_of_long_items(size):
    rng = random.Random(size)
    count = 100 if size <= 400 else 40
    block = decontaminate.Items([(i, " ".join(f"w{rng.randrange(4000)}" for _ in range(size))) for i in range(count)])
    others = [0, 0, *block.vocabulary.values()]
    met = 0
    for i, words in enumerate(block.words):
        around = [[rng.choice(others) for _ in range(40)] for _ in range(2)]
        text = around[0] + edited(rng, words, block.edits[i], others) + around[1]
        for _, item, edits, a, b in block.search([text]):
            assert edits <= block.edits[item]
            met += item == i
    assert met >= 0.99 * count


def test_short_items_stay_whole_and_long_ones_keep_their_place():
    item = [f"w{i}" for i in range(300)]
    block = decontaminate.Items([("short", " ".join(item[:59])), ("long", " ".join(item))])
    assert [len(p[2]) for p in block.pieces if p[0] == 0] == [59] and all(len(p[2]) <= 59 for p in block.pieces)
    numbers = decontaminate.Numbers(block.vocabulary)
    text = [0] * 500 + [numbers[w] for w in item] + [0] * 500
    assert block.search([text]) == [(0, 0, 0, 500, 559), (0, 1, 0, 500, 800)]
    # all edits in one half: the other half's pieces find the item
    assert block.search([[0] * 30 + [0] * 60 + [numbers[w] for w in item[60:]]])[0][1:3] == (1, 60)
    assert block.search([[0] * 30 + [0] * 61 + [numbers[w] for w in item[61:]]]) == []
