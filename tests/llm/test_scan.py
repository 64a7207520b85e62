"""The scan of sorted words and the rule that leaves ranges out."""

import random

import pytest

from spokeworks.llm import spelling


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_near(words):
    """Near words by the keys that leave out one letter: pairs that share one are compared."""
    groups = {}
    for word in words:
        for key in {word, *(word[:i] + word[i + 1 :] for i in range(min(len(word), 200))), word[:-1]}:
            groups.setdefault(key, []).append(word)
    near = {word: set() for word in words}
    for members in groups.values():
        for a in members:
            near[a].update(b for b in members if one_edit(a, b))
    return near


@pytest.mark.parametrize("seed", range(12))
def test_scan_finds_all_near_words_once(seed):
    rng = random.Random(seed)
    letters = "abcÿ"[: 2 + seed % 3]
    words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(300)})
    want, got = brute_near(words), {w: [] for w in words}
    for backward in (False, True):
        candidates = sorted(w[::-1] if backward else w for w in words)
        keys = [w[::-1] if backward else w for w in words]
        q, c = spelling.scan(candidates, keys, [len(w) - len(w) // 2 if backward else len(w) // 2 for w in words])
        for i, j in zip(q.tolist(), c.tolist()):
            other = candidates[j][::-1] if backward else candidates[j]
            if not (backward and other.startswith(words[i][: len(words[i]) // 2])):
                got[words[i]].append(other)
    assert {w: sorted(x) for w, x in got.items()} == {w: sorted(x) for w, x in want.items()}


def test_range_rule_is_exact():
    rng = random.Random(2)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for _ in range(5_000):
        prefix, word = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(2))
        assert spelling._within_one(prefix, word) == any(distance(prefix, word[:i]) <= 1 for i in range(len(word) + 1))


def test_adjacent_lcps():
    words = spelling.Words.of(["a", "ab", "abc", "abd", "b"])
    assert spelling.adjacent_lcps(words).tolist() == [-1, 1, 2, 2, 0]
