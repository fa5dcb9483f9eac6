"""Near pairs against all pairs, nearest templates against all templates."""

import random
import time

import pytest

from tidewire.operators import conformance, edits, signals


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


def edited(rng, text, k, letters):
    for _ in range(k):
        at = rng.randrange(len(text) + 1)
        text = rng.choice([text[:at] + rng.choice(letters) + text[at:], text[:at] + text[at + 1 :], text[:at] + rng.choice(letters) + text[at + 1 :]])
    return text


@pytest.mark.parametrize(("least", "letters", "size"), [(0.85, "ABCDE", 40), (0.7, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", 30), (0.6, "AB", 7), (1.0, "AB", 4)])
@pytest.mark.parametrize("within", [True, False])
def test_near_pairs_are_those_of_all_pairs(spark, least, letters, size, within):
    rng = random.Random(size)
    heads = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, size))) for _ in range(25)]
    rows = list({(rng.choice("xy"), edited(rng, h, rng.randrange(0, 6), letters)) for h in heads for _ in range(5)} | {("x", ""), ("y", "")})
    got = {(r.label_a, r.text_a, r.label_b, r.text_b): round(r.similarity, 9) for r in edits.near_pairs(spark.createDataFrame(rows, "label string, text string"), least, within).collect()}
    want = {}
    for la, a in rows:
        for lb, b in rows:
            if a and b and ((la == lb and a < b) if within else la < lb) and 1 - distance(a, b) / max(len(a), len(b)) >= least:
                want[la, a, lb, b] = round(1 - distance(a, b) / max(len(a), len(b)), 9)
    assert got == want and (want or not within or least == 1.0)


def test_few_pairs_are_compared(spark):
    """Of texts of 26 letters at 0.7, less than a tenth of all pairs meet in a piece."""
    rng = random.Random(1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rows = [("x", "".join(rng.choice(letters) for _ in range(60))) for _ in range(400)]
    rows += [("x", edited(rng, rows[i][1], 12, letters)) for i in range(40)]
    pairs = edits.near_pairs(spark.createDataFrame(rows, "label string, text string"), 0.7)
    found = pairs.collect()
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert len(found) >= 40 and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    near = edits.edit_similarity
    try:
        edits.edit_similarity = lambda a, b: near(a, b) * 0 + 1  # all that met
        met = edits.near_pairs(spark.createDataFrame(rows, "label string, text string"), 0.7).count()
    finally:
        edits.edit_similarity = near
    assert len(found) <= met < 0.1 * len(rows) * (len(rows) - 1) / 2


def test_pairs_with_a_bound_keep_equal_texts(spark):
    rows = [("1", "a", "WALK"), ("2", "a", "WALK"), ("3", "a", "WALKS"), ("4", "b", "WALK"), ("5", "b", "")]
    df = spark.createDataFrame(rows, "sample string, label string, text string")
    for within in (True, False):
        far = {(r.sample_a, r.sample_b) for r in signals.text_pairs(df, within).where("similarity >= 0.8").collect()}
        assert far == {(r.sample_a, r.sample_b) for r in signals.text_pairs(df, within, 0.8).collect()}


def test_trie_gives_the_nearest_templates(spark, monkeypatch):
    rng = random.Random(4)
    templates = [(i, "".join(rng.choice("abcd") for _ in range(rng.randrange(0, 9)))) for i in range(200)]
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randrange(0, 10))) for _ in range(60)] + ["zzzzzzzzzzzzzzz", ""]
    want = {t: sorted((distance(t, x), distance(t, x) / max(len(t), len(x), 1), i) for i, x in templates)[:3] for t in texts}
    trie = edits.Trie(templates)
    assert all(trie.nearest(t, 3) == want[t] for t in texts)
    assert edits.Trie([]).nearest("abc", 3) == []
    sequences = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "seq_id string, text string")
    model = spark.createDataFrame(templates, "template_id long, text string")
    for most in (1000, 70, 200):
        monkeypatch.setattr(conformance, "HELD", most)
        for top in (1, 3):
            got = {}
            for r in conformance.rank_templates(sequences, model, top).orderBy("rank").collect():
                got.setdefault(r.seq_id, []).append((r.distance, pytest.approx(r.ratio), r.template_id))
            assert {texts[int(k)]: v for k, v in got.items()} == {t: want[t][:top] for t in texts}


def test_a_large_set_of_templates_is_walked_quickly():
    rng = random.Random(6)
    templates = [(i, "".join(rng.choice("abcdefgh") for _ in range(8))) for i in range(100_000)]
    trie = edits.Trie(templates)
    texts = [edited(rng, templates[rng.randrange(100_000)][1], 1, "abcdefgh") for _ in range(30)]
    began = time.perf_counter()
    found = [trie.nearest(t, 1)[0][0] for t in texts]
    took = time.perf_counter() - began
    began = time.perf_counter()
    assert [min(distance(t, x) for _, x in templates[:1000]) for t in texts[:3]] >= found[:3]
    assert took / 30 < 0.5 * (time.perf_counter() - began) / 3 * 100
