"""Pieces are looked up only where one can end."""

import random

from shelflight.llm.token_counts import PrefixTrie


class Counted(dict):
    asked = 0

    def get(self, key, default=None):
        self.asked += 1
        return super().get(key, default)


def _best(word, scores, unknown):
    path = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        ways = [(path[b][0] + scores[word[b:end]], path[b][1] - 1) for b in range(end) if word[b:end] in scores]
        if word[end - 1] not in scores:
            ways.append((path[end - 1][0] + unknown, path[end - 1][1] - len(word[end - 1].encode())))
        path.append(max(ways))
    return -path[-1][1]


def test_search_ends_where_no_piece_can_end():
    trie = PrefixTrie({"x": -1.0, "xy": -1.5, "q" * 30: -2.0})
    trie.ends = Counted(trie.ends)
    trie.count("ab" * 20)
    assert trie.ends.asked <= 41


def test_counts_are_those_of_all_segmentations():
    draw = random.Random(4)
    scores = {"".join(draw.choices("▁abcé", k=draw.randint(1, 5))): draw.uniform(-9, 1) for _ in range(120)}
    trie = PrefixTrie(scores, nodes=300)
    for _ in range(2_000):
        word = "".join(draw.choices("abcdé", k=draw.randint(1, 90)))
        assert trie.count(word) == _best("▁" + word, scores, trie.unknown)
