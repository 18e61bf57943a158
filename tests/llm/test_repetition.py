import random

import numpy as np
import pytest

from loomline.llm import repetition as R


def brute(words, run=4):
    n = len(words)
    covered = [False] * n
    for i in range(n - run + 1):
        if any(words[j : j + run] == words[i : i + run] for j in range(i)):
            for k in range(i, i + run):
                covered[k] = True
    return sum(covered) / n if n >= run else 0.0


@pytest.mark.parametrize("seed", range(30))
def test_share_against_brute_force(seed):
    rng = random.Random(seed)
    words = [rng.choice("abcd") for _ in range(rng.randrange(0, 60))]
    assert R.repeated_share(words) == pytest.approx(brute(words) if words else 0.0)


def test_long_text_path_agrees():
    rng = random.Random(1)
    words = [f"w{rng.randrange(900)}" for _ in range(4000)]
    words = words + words[100:1200] + [f"x{i}" for i in range(500)]
    assert len(words) > 5000
    seen, covered = set(), np.zeros(len(words), bool)
    for i in range(len(words) - 3):
        gram = tuple(words[i : i + 4])
        if gram in seen:
            covered[i : i + 4] = True
        seen.add(gram)
    assert R.repeated_share(words) == pytest.approx(covered.mean())


def test_distance_is_a_distance():
    p, q = np.array([0.5, 0.5, 0.0]), np.array([0.0, 0.0, 1.0])
    assert R.js_distance(p, p) == 0 and R.js_distance(p, q) == pytest.approx(1.0)
    ref = R.Reference([("a", 6), ("b", 3)], 10)
    dense = np.array([0.5, 0.0, 0.5])
    assert ref.distance(["a", "z"]) == pytest.approx(R.js_distance(dense, ref.shares))


def test_gate_keeps_stuck_texts_and_turns_away_fresh_ones():
    rng = random.Random(2)
    words = [f"w{int(600 * rng.random() ** 2)}" for _ in range(20_000)]
    counts = sorted(((words.count(w), w) for w in set(words)), reverse=True)
    ref = R.Reference([(w, n) for n, w in counts[:3000]], len(words))
    turned = 0
    for k in range(40):
        fresh = [words[rng.randrange(len(words))] for _ in range(300)]
        turned += ref.distance(fresh) < ref.gate(300)
        stuck = fresh[:40] * 8
        assert ref.distance(stuck) >= ref.gate(len(stuck))
    assert turned > 20


def test_operator_on_odd_rows(spark):
    said = "the quick brown fox jumps over it "
    t = spark.createDataFrame([(1, said * 5, 7), (1, said * 5, 7), (2, None, 7), (3, "", 7), (4, "one two three four five six seven eight nine", 7), (None, said * 5, 7)], "transcript_id bigint, text string, item_id int")
    s = spark.createDataFrame([(10, "We SAY it again, we say it again; we say it again 3.", 1), (11, "a b c d a b c", 1), (12, "1 2 3 4 5 6 7 8 1 2 3 4", 1)], "segment_id bigint, text string, n_words int")
    assert {tuple(r) for r in R.stuck_texts(t, s).collect()} == {("transcript", 1), ("segment", 10)}
    every = {(r["item_kind"], r["item_id"]): r for r in R.repetition(t, s, gated=False).collect()}
    assert every["transcript", 3]["repeated_share"] == 0 and ("transcript", 2) not in every
    assert R.stuck_texts(t.limit(0), s.limit(0)).count() == 0


def test_stuck_text_that_makes_up_its_own_reference(spark):
    rng = random.Random(3)
    fresh = [" ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(150)) for _ in range(20)]
    stuck = " ".join(("".join(rng.choice("klmnopq") for _ in range(4)) for _ in range(33))) + " "
    tamil = " ".join("".join(rng.choice("கசடதபறமநல") for _ in range(4)) for _ in range(30)) + " "
    texts = fresh + [stuck * 5] * 10 + [tamil * 4]  # a third of all rows are one stuck text; another is alone in its script
    t = spark.createDataFrame(list(enumerate(texts)), "transcript_id bigint, text string")
    s = spark.createDataFrame([], "segment_id bigint, text string")
    assert {r["item_id"] for r in R.stuck_texts(t, s).collect()} == set(range(20, 31))


@pytest.mark.parametrize("seed", range(20))
def test_no_stuck_text_is_under_the_bound(seed):
    """Whatever the reference, even one learnt from the stuck text itself, a text half of which is repeated isn't ruled out."""
    rng = random.Random(seed)
    said = [f"w{int(40 * rng.random() ** 2)}" for _ in range(rng.randrange(8, 60))]
    words = said * rng.choice([2, 3, 5]) + [f"w{rng.randrange(60)}" for _ in range(rng.randrange(0, 8))]
    while R.repeated_share(words) < 0.5:
        words += said
    learnt_from = words if seed % 2 else words + [f"w{rng.randrange(500)}" for _ in range(400)]
    counts = {w: learnt_from.count(w) for w in set(learnt_from)}
    ref = R.Reference(sorted(counts.items(), key=lambda x: -x[1])[:50], len(learnt_from))
    assert ref.distance(words) >= ref.bound(len(words))


def test_bound_is_the_least_distance():
    rng = np.random.default_rng(3)
    ref = R.Reference([("a", 40), ("b", 30), ("c", 20)], 100)
    least = ref.bound(4)
    for _ in range(300):
        p = np.zeros(4)
        p[rng.choice(4, 2, replace=False)] = rng.dirichlet([1, 1])
        assert R.js_distance(p, ref.shares) >= least - 1e-9
    top = np.array([40 / 70, 30 / 70, 0, 0])
    assert R.js_distance(top, ref.shares) == pytest.approx(least, abs=1e-5)


def test_scripts_and_languages_of_whole_texts():
    assert R.script_of("7" * 500 + " नमस्ते") == "DEVANAGARI" and R.script_of("hello " * 70 + "नमस्ते दुनिया " * 5000) == "DEVANAGARI" and R.script_of("12 3") == "NONE"
    owners = {"the": "en", "und": "de"}
    assert R.language_key("", ["the", "und", "und"], owners) == "de" and R.language_key("abc", ["abc"], owners) == "LATIN"
