import random

import numpy as np
import pytest

from loomline.llm.leakage import cover, leaked_items
from loomline.llm.words import passage_words

DOC, ITEM = "doc_id bigint, text string, pos int, id string", "item_id bigint, text string, shingle int"


def leaks(spark, docs, items):
    found = leaked_items(spark.createDataFrame([(*d, 1, "x") for d in docs], DOC), spark.createDataFrame([(*i, 1) for i in items], ITEM))
    return {(r["doc_id"], r["item_id"]) for r in found.collect()}


def test_words_without_layout():
    text = "00:01.000 --> 00:02.500\nThe riv-\ner​ runs;\n> BELOW\xa0the stur¬\ndy bridge"
    assert passage_words(text) == ["the", "river", "runs", "below", "the", "sturdy", "bridge"]


def brute(doc, item, width=5, slack=2.0):
    """Most item words in order, in whole runs of five, in any window of the item's size, by search over runs."""
    d, t = passage_words(doc), passage_words(item)
    runs = []
    for i in range(len(d)):
        for j in range(len(t)):
            if i and j and d[i - 1] == t[j - 1]:
                continue
            n = 0
            while i + n < len(d) and j + n < len(t) and d[i + n] == t[j + n]:
                n += 1
            if n >= width:
                runs.append((i, j, n))
    window = int(len(t) * slack) + width
    best = 0

    def extend(at, to_d, to_t, start, total):
        nonlocal best
        best = max(best, total)
        for k in range(at, len(runs)):
            i, j, n = runs[k]
            lost = max(0, to_d - i, to_t - j)
            if n - lost >= width and i + n - start <= window:
                extend(k + 1, i + n, j + n, start, total + n - lost)

    runs.sort()
    for k, (i, j, n) in enumerate(runs):
        extend(k + 1, i + n, j + n, i, n)
    return best * 2 >= len(t)


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(8, 30)))) for k in range(25)]
    docs = []
    for k in range(120):
        words = [rng.choice(vocabulary) for _ in range(40)]
        for _, text in rng.sample(items, 2):
            t = text.split()
            a = rng.randrange(len(t))
            piece = t[a : a + rng.randrange(3, 30)]
            for _ in range(rng.randrange(3)):
                piece.insert(rng.randrange(len(piece) + 1), "zzz")
            at = rng.randrange(len(words))
            words[at:at] = piece
        docs.append((k, " ".join(words)))
    want = {(d, i) for d, dt in docs for i, it in items if brute(dt, it)}
    assert want and leaks(spark, docs, items) == want


def test_scattered_pieces_are_no_passage():
    width, n = 5, 20
    first, second = np.arange(6), np.arange(10, 16)
    near = np.concatenate([first, second + 2]), np.concatenate([first, second])
    far = np.concatenate([first, second + 500]), np.concatenate([first, second])
    assert cover(*near, n, width, 45)[0] == 20 and cover(*far, n, width, 45)[0] == 10


def places(runs, width=5):
    shingles = [(d + k, i + k) for d, i, n in runs for k in range(n - width + 1)]
    return np.array([s[0] for s in shingles]), np.array([s[1] for s in shingles])


def test_an_earlier_fragment_never_lowers_the_cover():
    runs = [(0, 0, 8), (50, 10, 10), (75, 20, 12)]
    # the fragment and ten words of the last run fit in one window as well
    assert cover(*places(runs), 40, 5, 85) == (28, 0, 84)
    assert cover(*places([(0, 0, 5), *runs[1:]]), 40, 5, 79) == (22, 50, 86)
    assert cover(*places(runs[1:]), 40, 5, 85) == (22, 50, 86)
    # a run may be cut at the window's end, and where it overlaps the next
    assert cover(*places([(0, 0, 10), (78, 10, 10)]), 40, 5, 85)[0] == 17
    assert cover(*places([(0, 0, 20), (17, 18, 6)]), 40, 5, 85)[0] == 23


def test_a_quoted_opening_before_the_passage_is_a_leak(spark):
    item = [f"w{k}" for k in range(40)]
    stray = lambda n: [f"s{k}" for k in range(n)]
    doc = item[:8] + stray(42) + item[10:20] + stray(15) + item[20:32]
    assert leaks(spark, [(1, " ".join(doc)), (2, " ".join(doc[8:]))], [(7, " ".join(item))]) == {(1, 7), (2, 7)}


@pytest.mark.parametrize("seed", range(40))
def test_cover_against_brute_force(seed):
    """Every window, every chain of shingles."""
    rng = random.Random(seed)
    item = [rng.choice("abcd") for _ in range(rng.randrange(6, 16))]
    doc = [rng.choice("abcd") for _ in range(10)]
    for _ in range(3):
        a = rng.randrange(len(item))
        at = rng.randrange(len(doc))
        doc[at:at] = item[a : a + rng.randrange(3, 9)]
    width, window = 3, rng.randrange(8, 40)
    shared = [(x, y) for x in range(len(doc) - width + 1) for y in range(len(item) - width + 1) if doc[x : x + width] == item[y : y + width]]
    if not shared:
        return
    want = 0
    for start in range(len(doc)):
        best = {}
        for x, y in shared:
            if start <= x and x + width <= start + window:
                best[x, y] = max([width, best.get((x - 1, y - 1), -1) + 1] + [n + width for (u, v), n in best.items() if u + width <= x and v + width <= y])
        want = max([want, *best.values()])
    got = cover(np.array([s[0] for s in shared]), np.array([s[1] for s in shared]), len(item), width, window)
    assert got[0] == want and got[2] - got[1] < window


def test_odd_rows(spark):
    item = "one two three four five six seven eight nine ten"
    docs = [(1, item.upper().replace(" ", ",\n")), (1, item.upper().replace(" ", ",\n")), (2, None), (3, ""), (4, "one two"), (None, item), (5, "x " * 20_000 + item), (6, "one two three four x five six seven eight")]
    items = [(1, item), (1, item), (2, item), (3, None), (4, "one two"), (5, "")]
    assert leaks(spark, docs, items) == {(1, 1), (1, 2), (5, 1), (5, 2)}
    assert leaks(spark, docs, []) == set() and leaks(spark, [], items) == set()


def test_both_ways_of_the_items_shingles(spark, monkeypatch):
    """Sent to the executors or joined by shuffle, the items' shingles give the same leaks."""
    from loomline.llm import leakage

    rng = random.Random(12)
    words = [f"w{i}" for i in range(80)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(5, 30)))) for i in range(12)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(20)) + " " + " ".join(items[i % 12][1].split()[: rng.randrange(3, 30)])) for i in range(40)]
    want = leaks(spark, docs, items)
    monkeypatch.setattr(leakage, "BROADCAST_SHINGLES", 0)
    assert want and leaks(spark, docs, items) == want
