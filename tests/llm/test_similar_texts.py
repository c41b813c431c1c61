"""Groups of similar texts where fingerprints, sketches and large keys could lose a link."""

import random

from test_operators import DOCS, brute_close, brute_similarity, words

from sluicework.llm import simhash


def groups(spark, texts):
    table = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], DOCS)
    return {r["doc_id"]: r["component_id"] for r in simhash.similar_text_groups(table).collect()}


def test_repeats_do_not_part_texts(spark):
    rng = random.Random(3)
    texts = []
    for _ in range(20):
        line, rest = words(rng, 6, 10_000), words(rng, 200, 10_000)
        texts += [f"{line} {line} {rest}", " ".join([line] * 60) + f" {rest}"]
    got = groups(spark, texts)
    assert all(got[i] == i - i % 2 for i in range(len(texts)))


def test_long_texts_are_measured_exactly(spark):
    """Pairs just above and just below the mark, of more shingles than a sketch has cells."""
    rng = random.Random(5)
    texts = []
    for pair in range(40):
        base = [f"x{rng.randrange(10**9)}" for _ in range(4_000)]
        # Replacing the last m of 3,996 shingles leaves (3996 - m) / (3996 + m) in common.
        m = 440 if pair % 2 else 450
        texts += [" ".join(base), " ".join(base[:-m] + [f"y{rng.randrange(10**9)}" for _ in range(m)])]
    got = groups(spark, texts)
    for i in range(0, len(texts), 2):
        assert (got[i] == got[i + 1]) == (i // 2 % 2 == 1), i


def test_large_keys_are_compared_whole(spark, monkeypatch):
    """Drifting copies, in groups of more than four parts, whose roots differ more than others."""
    monkeypatch.setattr(simhash, "RUN_LIMIT", 3)
    rng = random.Random(11)
    texts = []
    for _ in range(40):
        group = [words(rng, 200, 10**9).split()]
        for _ in range(13):
            made = list(rng.choice(group))
            m = rng.randrange(10, 18)
            at = rng.randrange(4, 196 - m)
            made[at : at + m] = words(rng, m, 10**9).split()
            group.append(made)
        texts += map(" ".join, group)
    shares = brute_similarity(texts)
    assert groups(spark, texts) == brute_close({pair for pair, s in shares.items() if s >= 0.8}, range(len(texts)))
