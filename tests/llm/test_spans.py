import random
from itertools import combinations

import numpy as np
import pytest

from loomline.llm import spans

DOC = "doc_id bigint, text string, seed int, class_id string"


def longest(x, y):
    best = 0
    prev = [0] * (len(y) + 1)
    for a in x:
        row = [0] * (len(y) + 1)
        for j, b in enumerate(y, 1):
            if a == b:
                row[j] = prev[j - 1] + 1
                best = max(best, row[j])
        prev = row
    return best


def test_minimizers_are_the_windows_smallest():
    rng = np.random.default_rng(1)
    for n, w in ((50, 7), (30, 30), (64, 16), (40, 1)):
        h = rng.integers(0, 20, n).astype(np.uint64)
        assert spans.window_smallest(h, w).tolist() == [i + int(np.argmin(h[i : i + w])) for i in range(n - w + 1)]


def test_texts_scanned_together_or_alone():
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc") for _ in range(rng.choice([0, 5, 19, 20, 21, 90]))) for _ in range(40)]
    codes = lambda t: np.frombuffer(t.encode("utf-32-le"), np.uint32)
    size = np.array([len(t) for t in texts])
    got = set(zip(*(x.tolist() for x in spans.minimizers(codes("".join(texts)), np.cumsum(size) - size, size, 6, 20))))
    want = set()
    for i, t in enumerate(texts):
        h = spans.kmer_hashes(codes(t), 6)
        for a in range(len(t) - 20 + 1):
            at = a + int(np.argmin(h[a : a + 15]))
            want.add((i, at, int(h[at])))
    assert got == want


def test_hash_depends_on_content_alone():
    codes = np.frombuffer("xxabcabcabcyyabc".encode("utf-32-le"), np.uint32)
    h = spans.kmer_hashes(codes, 3)
    assert h[2] == h[5] == h[8] == h[13] and len(set(h.tolist())) == len({"xxabcabcabcyyabc"[i : i + 3] for i in range(14)})


@pytest.mark.parametrize("seed", range(10))
def test_chain_is_optimal(seed):
    rng = random.Random(seed)
    points = [(rng.randrange(60), rng.randrange(60)) for _ in range(14)]
    a, b = [p[0] for p in points], [p[1] for p in points]
    k, gap = 10, 0.2
    chains = spans.chain(a, b, k, gap)
    assert sorted(i for c in chains for i in c) == list(range(14))

    def score(c):
        return k * len(c) - gap * sum(a[j] - a[i] + b[j] - b[i] for i, j in zip(c, c[1:]))

    order = sorted(range(14), key=lambda i: (a[i], b[i]))
    best = {}
    for i in order:
        best[i] = max([k] + [best[j] + k - gap * (a[i] - a[j] + b[i] - b[j]) for j in best if a[j] < a[i] and b[j] < b[i]])
    assert max(score(c) for c in chains) == pytest.approx(max(best.values()))


def pairs(spark, docs, **kw):
    return {tuple(r) for r in spans.found_pairs(spark.createDataFrame([(*d, 1, "x") for d in docs], DOC), **kw).collect()}


def test_against_brute_force(spark):
    rng = random.Random(5)
    letters = "abcdefgh "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(20, 200))) for _ in range(30)]
    for _ in range(25):
        i, j = rng.sample(range(30), 2)
        size = rng.randrange(20, 60)
        at = rng.randrange(max(1, len(texts[i]) - size))
        cut = rng.randrange(len(texts[j]))
        texts[j] = texts[j][:cut] + texts[i][at : at + size] + texts[j][cut:]
    texts += [texts[0], texts[0], "ab" * 80, "x" + "ab" * 70, "ab" * 20, "नमस्ते दुनिया " * 6, "कहा नमस्ते दुनिया नमस्ते दुनिया नमस्ते दुनिया अब"]
    docs = list(enumerate(texts))
    want = {(i, j) for (i, x), (j, y) in combinations(docs, 2) if longest(x, y) >= 40}
    assert want and pairs(spark, docs, span=40, k=12) == want


def test_paged_boilerplate_against_brute_force(spark):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    texts = []
    for _ in range(20):
        # pages of 46 characters with the same 34 in the middle: only the middle page is equal as a whole
        boiler = word(34)
        same = word(6) + boiler + word(6)
        texts += [word(6) + boiler + word(6) + same + word(6) + boiler + word(6) for _ in range(2)]
    docs = list(enumerate(texts))
    want = {(i, j) for (i, x), (j, y) in combinations(docs, 2) if longest(x, y) >= 40}
    assert len(want) == 20 and pairs(spark, docs, span=40, k=12) == want


def test_share_and_odd_rows(spark):
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefghijkl ") for _ in range(n))
    common = word(60)
    docs = [(1, word(30) + common), (2, common + word(50)), (3, word(80)), (4, None), (5, ""), (6, common[:30]), (2, None), (None, common)]
    docs = [d for d in docs if d != (2, None)] + [(7, word(10))]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs + docs[:1]], DOC)
    got = {r["doc_id"]: (r["n_links"], r["shared_chars"]) for r in spans.shared_share(frame, span=40, k=12).collect()}
    assert got[1][0] == got[2][0] == 1 and 60 <= got[1][1] <= 62 and got[3] == (0, 0) and got[6] == (0, 0)
    assert pairs(spark, []) == set() and pairs(spark, [(1, "short")]) == set()


def seeds_of(text, k, span):
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    out = {}
    for _, at, h in zip(*(x.tolist() for x in spans.minimizers(codes, np.array([0]), np.array([len(text)]), k, span))):
        out.setdefault(h, []).append(at)
    return out


def maximal(x, y, span):
    """All maximal exact matches by growing every diagonal."""
    out = set()
    for d in range(-len(y) + 1, len(x)):
        run = 0
        for i in range(max(0, d), min(len(x), len(y) + d) + 1):
            if i < len(x) and i - d < len(y) and x[i] == y[i - d]:
                run += 1
            else:
                if run >= span:
                    out.add((i - run, i - run - d, run))
                run = 0
    return out


@pytest.mark.parametrize("seed", range(60))
def test_changed_periodic_texts_against_brute_force(seed, monkeypatch):
    """Texts that repeat themselves, with changed characters in some of their repeats: no maximal match is lost."""
    rng = random.Random(seed)
    if seed % 2:
        monkeypatch.setattr(spans, "PLACE_PAIRS", 3)
    period = "".join(rng.choice("abcd ") for _ in range(rng.choice([1, 3, 10, 17, 33])))
    texts = []
    for _ in range(2):
        t = list((period * 60)[: rng.randrange(60, 220)])
        for _ in range(rng.randrange(0, 6)):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        texts.append("".join(t))
    x, y = texts
    k, span = 12, 36
    got = {m for c in spans.chained_matches(x, y, seeds_of(x, k, span), seeds_of(y, k, span), k, 0.1) for m in c if m[2] >= span}
    assert got == maximal(x, y, span)


@pytest.mark.parametrize("seed", range(20))
def test_common_characters_against_dynamic_programming(seed):
    rng = random.Random(seed)
    x, y = ("".join(rng.choice("abc") for _ in range(rng.randrange(0, 40))) for _ in range(2))
    row = [0] * (len(y) + 1)
    for ch in x:
        row = _step(row, ch, y)
    assert spans.common_characters(x, y) == row[-1]


def _step(row, ch, y):
    out = [0]
    for j, other in enumerate(y, 1):
        out.append(row[j - 1] + 1 if ch == other else max(row[j], out[-1]))
    return out


def test_fuzzy_passages_and_members(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefghijkl ") for _ in range(n))
    left, right = word(60), word(50)
    docs = [(1, word(20) + left + "QRS" + right + word(9)), (2, word(7) + left + "QxxS" + right), (3, "ZZ" + left + word(15)), (4, word(90))]
    docs.append((5, docs[0][1]))
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], DOC)
    got = {(r["doc_a"], r["doc_b"]): r for r in spans.fuzzy_passages(frame, span=40, k=12).collect()}
    assert set(got) == {(1, 2), (1, 3)}
    r = got[1, 2]
    assert (r["a_start"], r["a_end"], r["b_start"], r["b_end"], r["common"], r["n_spans"]) == (20, 133, 7, 121, 112, 2)
    members = {}
    for r in spans.passage_members(frame, span=40, k=12).collect():
        members.setdefault(r["passage"], set()).add(r["doc_id"])
    assert sorted(map(sorted, members.values())) == [[1, 2, 3, 5], [1, 2, 5]]
    assert spans.fuzzy_passages(frame.limit(0), span=40, k=12).count() == 0


def test_a_passage_of_many_texts_is_compared_with_one(spark):
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcdefghijkl ") for _ in range(n))
    common = word(50)
    docs = [(i, word(30) + chr(0x4E00 + i) + common + chr(0x5E00 + i) + word(30)) for i in range(40)]
    found, holders, _ = spans.compared(spark.createDataFrame([(*d, 1, "x") for d in docs], DOC), span=40, k=12)
    assert {r["doc_a"] for r in found.collect()} == {0} and found.select("doc_b").distinct().count() == 39
    assert pairs(spark, docs, span=40, k=12) == set(combinations(range(40), 2))
