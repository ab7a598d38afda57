"""Changes between versions, scores of whole corpora and roll-ups."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import changes, costs, quality

VERSION = "document_id string, seq int, source_hash string"


def plain_lcs(a, b):
    best = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
    return best[-1, -1]


def test_common_in_order_is_longest(monkeypatch):
    dice = random.Random(2)
    for full in (4_000_000, 0):
        monkeypatch.setattr(changes, "FULL", full)
        for _ in range(200):
            a, b = ([dice.choice("abcd") for _ in range(dice.randrange(12))] for _ in range(2))
            pairs = changes.common_in_order(a, b)
            assert all(a[i] == b[j] for i, j in pairs)
            assert all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:], strict=False))
            assert not full or len(pairs) == plain_lcs(a, b)


def edited(dice, old):
    new = list(old)
    for _ in range(dice.randrange(4)):
        at = dice.randrange(len(new) + 1)
        turn = dice.randrange(4)
        if turn == 0:
            new.insert(at, f"new{dice.randrange(99)}")
        elif turn == 1 and at < len(new):
            del new[at]
        elif turn == 2 and at < len(new):
            new[at] = f"edit{dice.randrange(99)}"
        elif new:
            new.insert(at, new.pop(dice.randrange(len(new))))
    return new


def test_changes_of_random_edits(spark):
    dice, before, after, plain = random.Random(3), [], [], {}
    for d in range(40):
        old = [dice.choice([f"u{i}", f"u{i}", "rule", "", "line"]) for i in range(dice.randrange(30))]
        new = edited(dice, old)
        plain[str(d)] = (old, new)
        before += [(str(d), i, x) for i, x in enumerate(old)]
        after += [(str(d), 3 * i, x) for i, x in enumerate(new)]
    got = changes.block_changes(
        spark.createDataFrame(before, VERSION), spark.createDataFrame(after, VERSION)).collect()
    for d, (old, new) in plain.items():
        rows = [r for r in got if r.document_id == d]
        # Every block of either version is told once.
        assert sorted(r.old_seq for r in rows if r.old_seq is not None) == list(range(len(old)))
        assert sorted(r.new_seq for r in rows if r.new_seq is not None) == [
            3 * i for i in range(len(new))]
        same = [r for r in rows if r.change in ("kept", "moved")]
        assert all(old[r.old_seq] == new[r.new_seq // 3] for r in same)
        assert sum((Counter(old) & Counter(new)).values()) == len(same)
        kept = sorted((r.old_seq, r.new_seq) for r in rows if r.change == "kept")
        assert all(a[1] < b[1] for a, b in zip(kept, kept[1:], strict=False))
        assert len(kept) <= plain_lcs(old, new)
        if len(set(old)) == len(old) and len(set(new)) == len(new):
            assert len(kept) == plain_lcs(old, new)
        for r in rows:
            if r.change == "edited":  # between the same kept neighbours
                assert [k for k in kept if k[0] < r.old_seq] == [k for k in kept if k[1] < r.new_seq]


def test_changes_of_one_edit_each(spark):
    old = spark.createDataFrame([("d", i, f"h{i}") for i in range(6)], VERSION)
    new = spark.createDataFrame([("d", i, h) for i, h in enumerate(
        ["h0", "h2", "h1", "x", "h4", "h5", "y"])], VERSION)
    summary = changes.change_summary(changes.block_changes(old, new)).collect()[0]
    assert (summary.kept, summary.moved, summary.edited, summary.added, summary.deleted) == (
        4, 1, 1, 1, 0)
    gone = changes.change_summary(changes.block_changes(old, new.where("false"))).collect()[0]
    assert (gone.deleted, gone.kept) == (6, 0)
    assert changes.block_changes(old.where("false"), new.where("false")).count() == 0


# ---- scores of whole corpora

def plain_corpus(pairs, weights):
    rates = []
    for order in range(1, 7):
        matched = have = want = 0
        for (_, candidate, reference), n in zip(pairs, weights, strict=True):
            c, r = ("".join((t or "").split()) for t in (candidate, reference))
            a, b = (Counter(t[i:i + order] for i in range(len(t) - order + 1)) for t in (c, r))
            matched += n * sum((a & b).values())
            have, want = have + n * sum(a.values()), want + n * sum(b.values())
        if have and want:
            rates.append((matched / have, matched / want))
    p, q = np.mean(rates, axis=0) if rates else (0, 0)
    return 500 * p * q / (4 * p + q) if p + q else 0.0


def test_corpus_scores_and_resamples(spark):
    dice = random.Random(5)
    texts = ["".join(dice.choice("abc de") for _ in range(dice.randrange(25))) for _ in range(60)]
    good = [(f"p{i}", t.replace("a", "b", 1), t) for i, t in enumerate(texts)] + [("n", None, "x")]
    bad = [(i, (t or "").replace("a", "e"), r) for i, t, r in good]
    rows = [("good", *p) for p in good] + [("bad", *p) for p in bad] + [(None, "z", "a", "a")]
    table = spark.createDataFrame(
        rows, "model string, pair_id string, candidate string, reference string").repartition(5)
    scores = {(r.model, r.resample): r.chrf for r in quality.corpus_chrf(
        table, resamples=20).collect()}
    assert len(scores) == 42
    hashes = {r.pair_id: r.h for r in table.select(
        "pair_id", F.xxhash64("pair_id").alias("h")).distinct().collect()}
    drawn = quality.resample_weights(np.array([hashes[p[0]] for p in good]), 20)
    assert 0.8 < drawn.mean() < 1.2 and 0.7 < drawn.var() < 1.3
    for name, pairs in (("good", good), ("bad", bad)):
        assert scores[name, 0] == pytest.approx(plain_corpus(pairs, [1] * len(pairs)))
        for r in range(20):
            assert scores[name, r + 1] == pytest.approx(plain_corpus(pairs, drawn[:, r]))
    found = quality.chrf_difference(table, "good", "bad", resamples=20, level=0.8).first()
    differences = sorted(scores["good", r] - scores["bad", r] for r in range(1, 21))
    assert found.low == pytest.approx(differences[1]) and found.high == pytest.approx(
        differences[17])
    assert found.difference == pytest.approx(scores["good", 0] - scores["bad", 0])
    assert found.better_share == pytest.approx(np.mean([d > 0 for d in differences]))


def test_rollup_tells_its_own_nulls_apart(spark):
    jobs = spark.createDataFrame(
        [("a", "x", 1.0), ("a", None, 2.0), (None, None, 4.0)], "model string, s string, c double")
    rolled = costs.usage_rollup(jobs, ("model", "s"), ("c",))
    assert rolled._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted((r.level, str(r.model), str(r.s), r.jobs, r.c) for r in rolled.collect()) == [
        (0, "None", "None", 3, 7.0), (1, "None", "None", 1, 4.0), (1, "a", "None", 2, 3.0),
        (2, "None", "None", 1, 4.0), (2, "a", "None", 1, 2.0), (2, "a", "x", 1, 1.0)]
