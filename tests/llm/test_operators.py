"""The training-data operators against brute force, exact round trips and edge cases."""

import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from sluicework.llm import chat, decontaminate, kneser_ney, langid, line_dedup, mtree, packing, shards, simhash, token_store, toxicity
from sluicework.llm.components import connected_components
from sluicework.llm.queries import tokenizer_path
from sluicework.llm.token_ids import ChunkEncoder

DOCS = "doc_id long, text string, lang string"


def words(rng, n, vocabulary=200):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def docs(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang) for i, t in enumerate(texts)], DOCS)


ODD = [None, "", " \n\t ", "one", "two words", "É é Été", "x" * 20_000, "a b " * 30_000, "12 34 ½", "\x00\x1c", "a\n\nb\n", "same", "same", "日本語 テキスト", "𝔘𝔫𝔦"]


# --- near duplicates ---------------------------------------------------------------------

def brute_fingerprint(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius=3):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ids)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= radius:
                x, y = find(ids[a]), find(ids[b])
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_groups(spark):
    rng = random.Random(1)
    base = [words(rng, 150) for _ in range(25)]
    texts = list(base)
    for t in base:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts += [" ".join(w), t.upper()]
    texts += ODD
    got = {r["doc_id"]: r for r in simhash.near_duplicate_groups(docs(spark, texts).withColumnRenamed("lang", "fp")).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [got[i]["fingerprint"] for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(list(range(len(texts))), fps)


def test_simhash_links_keep_all_connections(spark):
    rng = random.Random(2)
    fps = []
    for _ in range(12):
        f = rng.getrandbits(64)
        for _ in range(25):
            g = f
            for _ in range(rng.randrange(5)):
                g ^= 1 << rng.randrange(64)
            fps.append(g)
            f = g if rng.random() < 0.5 else f
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = brute_components(signed, fps)
    table = spark.createDataFrame([(s,) for s in signed], "fp long")
    # Whole runs; keys of more than 3 fingerprints parted; nearly all the way without runs.
    for limit in (simhash.FOREST_LIMIT, 3, 1):
        got = simhash.fingerprint_links(table, limit).collect()
        assert all(bin((r["a"] ^ r["b"]) & (1 << 64) - 1).count("1") <= 3 for r in got)
        assert brute_close({(r["a"], r["b"]) for r in got}, signed) == brute_close({(a, c) for a, c in want.items()}, signed)


def brute_close(links, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def brute_similarity(texts, k=5):
    """{(i, j): share of distinct word shingles}, texts without words being alike."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset())
    return {(i, j): len(a & b) / len(a | b) if a | b else 1.0 for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a & b or not a | b}


def check_similar(ids, texts, component, slack=0.03):
    """All that is surely similar is together; all that is together is at least nearly so."""
    shares = brute_similarity(texts)
    sure, most = (brute_close({(ids[i], ids[j]) for (i, j), s in shares.items() if s >= 0.8 + x}, ids) for x in (slack, -slack))
    for groups, finer in ((sure, True), (most, False)):
        for i in ids:
            assert component[i] == component[groups[i]] if finer else most[i] == most[component[i]], i
    assert all(component[c] == c <= i for i, c in component.items())


@pytest.mark.parametrize("limit", [simhash.RUN_LIMIT, 3])
def test_similar_texts(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "RUN_LIMIT", limit)
    rng = random.Random(7)
    texts = []
    for n in (40, 150, 1200, 4000):
        for _ in range(6):
            base = words(rng, n, 2000).split()
            texts += [" ".join(base), "  ".join(base).upper(), " ".join(base)]
            for share in (0.005, 0.01, 0.08):
                w = list(base)
                for _ in range(max(1, int(n * share))):
                    w[rng.randrange(n)] = "changed"
                texts.append(" ".join(w))
            texts.append(" ".join(base[: n // 2] + words(rng, n // 2, 2000).split()))
    texts += ODD
    table = docs(spark, texts).selectExpr("*", "'x' AS fp", "1 AS content", "2 AS component_id")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_text_groups(table).collect()}
    assert len(got) == len(texts)
    check_similar(list(range(len(texts))), texts, got)


def test_similar_texts_with_odd_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(7, a, "en"), (3, b, None), (7, b, "en"), (9, a, "en"), (None, a, "en"), (5, None, "en"), (6, "", "en"), (3, b, None)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_text_groups(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {3: 3, 7: 3, 9: 3, 5: 5, 6: 5}
    assert simhash.similar_text_groups(spark.createDataFrame([], DOCS)).collect() == []


def test_ring_filter_keeps_all_within_its_radius():
    rng = np.random.default_rng(4)
    bits = rng.random((4000, 64)) < rng.random((4000, 1)) * 0.6
    differences = np.packbits(bits, axis=1).view(np.uint64)[:, 0]
    assert (simhash.ring_viable(differences, simhash.TEXT_RADIUS) == (bits.sum(axis=1) <= simhash.TEXT_RADIUS)).all()


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(139, 60)] + [(500, 500), (None, 3)]
    pairs += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    nodes = {x for p in pairs for x in p if x is not None}
    want = brute_close({p for p in pairs if None not in p}, nodes)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {n: got.get(n, n) for n in nodes} == want


# --- chat --------------------------------------------------------------------------------

def test_chat_escapes_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "<\\s>", "\\\\n", "<s><s>", "[[INST]]", "a\nb", "", "é𝔘", "</s", "<", "[/INST", "\\</s>"]
    rows = [(7, i, "assistant" if i % 2 else "<s>user\\", t) for i, t in enumerate(texts)] + [(8, 0, None, None), (None, 0, "user", "x")]
    made = chat.format_reply_trees(chat.linear_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    from pyspark.sql import functions as F

    got = {r["tree"]: r for r in made.select("*", chat.read_turns(F.col("formatted")).alias("back"), chat.read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert [(t["role"], t["text"]) for t in got[7]["back"]] == [(r[2], r[3]) for r in rows if r[0] == 7]
    assert got[7]["loss"] == "".join(t for i, t in enumerate(texts) if i % 2)
    assert [(t["role"], t["text"]) for t in got[8]["back"]] == [("", "")] and got[None]["n_turns"] == 1


def test_reply_trees(spark):
    #  1 -> 2 -> 4, 1 -> 3, 3 -> 5, 9 is an orphan, 20 <-> 21 is a cycle
    rows = [(1, 1, None, 1.0), (1, 2, 1, 5.0), (1, 3, 1, 2.0), (1, 4, 2, None), (1, 5, 3, 1.0), (1, 9, 77, 0.5), (1, 20, 21, 9.0), (1, 21, 20, 9.0), (1, 22, 21, 9.0), (2, 1, None, 0.0)]
    rows += [(3, i, i - 1 if i else None, 0.1) for i in range(100)]
    nodes = spark.createDataFrame(rows, "tree long, node long, parent long, score double")
    paths = {}
    for r in chat.root_paths(nodes).collect():
        paths.setdefault((r["tree"], r["branch_rank"]), []).append((r["pos"], r["node"]))
    paths = {k: [n for _, n in sorted(v)] for k, v in paths.items()}
    assert paths == {(1, 1): [1, 2, 4], (1, 2): [1, 3, 5], (1, 3): [9], (2, 1): [1], (3, 1): list(range(100))}
    assert chat.root_paths(nodes, 1).select("tree", "leaf").distinct().count() == 3
    assert chat.root_paths(nodes.limit(0)).count() == 0


# --- language ----------------------------------------------------------------------------

def brute_languages(rows, max_n=4):
    """The predictor of (text, lang) rows by plain counting."""
    langs = sorted({lang for text, lang in rows if text is not None and lang is not None and langid.words_of(text)})
    known, grams = {k: Counter() for k in langs}, {k: Counter() for k in langs}
    for text, lang in rows:
        if lang in known:
            known[lang].update(langid.words_of(text or ""))
    for k in langs:
        for w, n in known[k].items():
            m = f"^{w}$"
            for size in range(1, max_n + 1):
                for i in range(len(m) - size + 1):
                    if m[i : i + size] not in ("^", "$"):
                        grams[k][m[i : i + size]] += n
    all_words, all_grams = set().union(*known.values()), set().union(*grams.values())
    totals = {k: sum(known[k].values()) for k in langs}
    sizes = {(k, n): sum(c for g, c in grams[k].items() if len(g) == n) for k in langs for n in range(1, max_n + 1)}

    def score(word):
        if word in all_words:
            return [np.log((known[k][word] + 0.5) / (totals[k] + 0.5 * len(all_words))) for k in langs]
        m = f"^{word}$"
        for n in range(max_n, 0, -1):
            found = [g for g in ([m[i : i + n] for i in range(len(m) - n + 1)] if n > 1 else word) if g in all_grams]
            if found:
                return [np.mean([np.log((grams[k][g] + 0.5) / (sizes[k, n] + 0.5 * len(all_grams))) for g in found]) for k in langs]
        return [0.0] * len(langs)

    def predict(text):
        w = langid.words_of(text or "")
        if not w or not langs:
            return "und", 0.0
        total = np.sum([score(x) for x in w], axis=0)
        best = int(np.argmax(total))
        return langs[best], float(1 / np.exp(total - total[best]).sum())

    return predict


@pytest.mark.parametrize("held", [shards.HELD_ROWS, 40])
def test_language(spark, monkeypatch, held):
    """Whole models and models of many shards, of which a worker holds one, against plain counting."""
    if held == 40:
        monkeypatch.setattr(shards, "SHARD_ROWS", 25)
    rng = random.Random(4)
    make = lambda syll, n: " ".join("".join(rng.choice(syll) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    kinds = {"aa": ["the", "ing", "er"], "bb": ["éau", "oi", "ç"], "cc": ["sch", "ü", "ein"]}
    rows = [(make(s, 60), k) for k, s in kinds.items() for _ in range(10)] + [("мало слов shared", "small"), ("мало слов shared", "small"), (None, "aa"), ("x", None), ("", "aa"), ("12", "empty")]
    table = spark.createDataFrame(rows, "text string, lang string")
    model = langid.train(table, held_rows=held)
    predict = brute_languages(rows)
    probes = [make(s, 30) for s in kinds.values()] + ["слово", "thq zzz", "Ω ω"] + ODD
    got = {r["doc_id"]: r for r in langid.identify(docs(spark, probes).withColumnsRenamed({"lang": "score"}), model).collect()}
    for i, t in enumerate(probes):
        lang, share = predict(t)
        assert (got[i]["lang_pred"], round(got[i]["score"], 6)) == (lang, round(share, 6)), t
    assert [got[i]["lang_pred"] for i in range(4)] == ["aa", "bb", "cc", "small"]
    empty = langid.identify(docs(spark, ["text"]), langid.train(table.limit(0))).first()
    assert (empty["lang_pred"], empty["score"]) == ("und", 0.0)


def test_language_sample_is_bounded(spark):
    rows = [(f"word{i} same", "ab"[i % 2]) for i in range(4000)]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"), max_rows=400)
    assert 600 < sum(model.totals) < 1000


# --- tokens ------------------------------------------------------------------------------

def test_chunks_encode_like_whole_texts():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    mine = ChunkEncoder(tokenizer_path(), most_chunks=50)
    rng = random.Random(5)
    letters = ["a", "B", "é", "É", "́", "̌", "J", "Σ", "σ", "İ", ".", ",", "..", "!", "'s", "'", "1", "½", " ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "日", "𝔘", "»", "don't", "ǰ"]
    texts = [t or "" for t in ODD] + ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(600)]
    made = mine.encode([t.encode() for t in texts], 1)
    for t, ids in zip(texts, made):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids + [1], repr(t)


def brute_ids(texts, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [np.array(t.encode(x or "", add_special_tokens=False).ids + [end], "<u4").tobytes() for x in texts]


@pytest.mark.parametrize("texts", [ODD, [], ["a"], [words(random.Random(6), n) for n in (5000, 3, 900, 900, 70, 1)] * 5])
def test_packing(spark, texts):
    ids = brute_ids(texts, 2)
    placed = packing.pack_documents(docs(spark, texts), tokenizer_path(), 2, keep_ids=True)
    rows = placed.collect()
    for i, raw in enumerate(ids):
        mine = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], bytes(r["ids"])) for r in rows if r["doc_id"] == i)
        assert b"".join(m[4] for m in mine) == raw
        assert all(zlib.crc32(m[4]) == m[2] and len(m[4]) == 4 * m[1] and m[3] == len(raw) // 4 and m[0] == sum(x[1] for x in mine[:k]) for k, m in enumerate(mine))
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert sorted(by) == list(range(len(by)))
    packed = {r["sequence_id"]: r for r in packing.sequences(placed).collect()}
    assert sum(len(r["ids"]) for r in packed.values()) == sum(map(len, ids))


def test_plan_uses_all_and_wastes_little():
    rng = random.Random(7)
    histogram = Counter(min(256, int(rng.lognormvariate(3.3, 1)) + 1) for _ in range(20_000))
    made = packing.plan(dict(histogram), 256)
    used = Counter()
    for combo, times in made:
        assert sum(combo) <= 256 and times > 0
        for b in combo:
            used[b] += times
    assert used == histogram
    total = sum(b * n for b, n in histogram.items())
    assert sum(t for _, t in made) <= 1.02 * total / 256 + 2


def test_nnls_against_conditions():
    rng = np.random.default_rng(8)
    a = rng.random((12, 40))
    b = a @ np.maximum(rng.normal(size=40), 0)
    x = packing.nnls(a, b)
    assert (x >= 0).all() and np.linalg.norm(a @ x - b) < 1e-6 * np.linalg.norm(b)


@pytest.mark.parametrize("texts", [ODD, [], ["a"]])
def test_token_store(spark, texts):
    ids = brute_ids(texts, 1)
    folder = token_store.new_folder(spark)
    table = docs(spark, texts)
    manifest = token_store.write_store(table, folder, tokenizer_path(), 1, shard_ids=2000)
    rows = {r["doc_id"]: r for r in token_store.read_store(manifest, folder).collect()}
    at = 0
    for i, raw in enumerate(ids):
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (at, len(raw) // 4, zlib.crc32(raw))
        assert token_store.lookup(folder, i) == raw
        at += len(raw) // 4
    assert token_store.lookup(folder, 10**9) is None


def test_token_store_without_and_with_repeated_keys(spark):
    rows = [(None, "b", "x"), (None, "a", "x"), (5, "c d e", "x"), (5, "f", "x"), (2, None, "x")]
    folder = token_store.new_folder(spark)
    got = token_store.read_store(token_store.write_store(spark.createDataFrame(rows, DOCS), folder, tokenizer_path(), 1), folder).collect()
    want = sorted(zlib.crc32(x) for x in brute_ids([r[1] for r in rows], 1))
    assert sorted(r["ids_crc32"] for r in got) == want and sorted(r["start"] for r in got) == list(np.cumsum([0, *(r["n_tokens"] for r in sorted(got, key=lambda r: r["start"]))])[:-1])


def test_perfect_hash():
    rng = np.random.default_rng(9)
    for n in (0, 1, 2, 1000, 20_000):
        keys = np.unique(rng.integers(-(2**62), 2**62, n))
        assert sorted(token_store.PerfectHash.build(keys).slots(keys).tolist()) == list(range(len(keys)))
    shard = token_store.Shard.of_bytes(token_store.shard_bytes(list(range(100)), [b"\x01\0\0\0"] * 100))
    absent = np.arange(1000, 60_000)
    assert (shard.locate(absent)[0] >= 0).mean() < 0.001


# --- lines -------------------------------------------------------------------------------

def brute_lines(texts, least):
    space = " \t\n\x0b\x0c\r"
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(space))
    split = [(t or "").split("\n") for t in texts]
    seen = Counter(k for lines in split for k in {key(x) for x in lines} if k)
    return [[x for x in lines if not (key(x) and seen[key(x)] >= least)] for lines in split], split


def test_line_dedup(spark):
    rng = random.Random(10)
    pool = ["Common É", " common É\t", "COMMON É", "common é", "rare", "", "  ", "x\ry", "日本"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(8))) for _ in range(40)] + ODD
    table = docs(spark, texts)
    maps = line_dedup.keep_bitmaps(table, min_docs=5)
    kept, split = brute_lines(texts, 5)
    got = {r["doc_id"]: r for r in line_dedup.apply_bitmaps(table, maps).collect()}
    for i, (k, lines) in enumerate(zip(kept, split)):
        assert ((got[i]["text"] or "").split("\n") if k else [""]) == (k or [""])
        assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["lang"]) == (len(lines), len(lines) - len(k), "en")
    first = line_dedup.apply_bitmaps(table, line_dedup.keep_bitmaps(table, min_docs=2, keep_first=True))
    lines = [x.strip().lower() for r in first.collect() for x in (r["text"] or "").split("\n")]
    assert lines.count("rare") == 1 and lines.count("same") == 1
    assert line_dedup.keep_bitmaps(table.limit(0)).count() == 0


# --- search ------------------------------------------------------------------------------

@pytest.mark.parametrize("crowd", [False, True])
def test_top_k(spark, monkeypatch, crowd):
    rng = np.random.default_rng(11)
    vectors = rng.normal(size=(700, 8)).tolist()
    if crowd:
        vectors[100:500] = [vectors[0]] * 400
    rows = [(i, v) for i, v in enumerate(vectors)] + [(700, None), (701, [None, 1.0]), (702, [float("nan")]), (703, [1.0, 2.0]), (704, []), (None, [1.0])]
    monkeypatch.setattr(mtree, "TREE_VECTORS", 200)
    monkeypatch.setattr(mtree, "QUERY_VECTORS", 10)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in mtree.top_k(table, table.filter("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = {i: np.floor(64 * np.pad(np.array(v, float), (0, 8 - len(v)))) for i, v in rows if i is not None and v is not None and i not in (701, 702)}
    for q in (i for i in good if i % 20 == 0):
        want = sorted(((-int(good[q] @ v), i) for i, v in good.items() if i != q))[:20]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert mtree.top_k(table.limit(0), table.limit(0)).count() == 0


def test_top_k_of_large_components(spark, monkeypatch):
    monkeypatch.setattr(mtree, "TREE_VECTORS", 3)
    big = [2.0**k for k in (16, 25, 40, 56, 60)]
    rows = [(0, [1.0, 1.0]), (1, [70_000.0, 1.0]), (2, [2.0, 2.0]), (3, [70_000.0, 1.0]), (20, [-1.0, 3.0])] + [(100 + i, [b, float(i)]) for i, b in enumerate(big)] + [(40, [2.0**40, -1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in mtree.top_k(table, table.filter("vec_id % 20 = 0"), 4).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ends = lambda n: max(-(2**63), min(2**63 - 1, n))
    whole = {i: [ends(int(np.floor(64 * x))) for x in v] for i, v in rows}
    for q in (0, 20, 40, 100):
        want = sorted((-ends(sum(a * b for a, b in zip(whole[q], v))), i) for i, v in whole.items() if i != q)[:4]
        assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]


def test_bounds_save_distances():
    rng = np.random.default_rng(12)
    centers = rng.normal(size=(20, 3)) * 1000
    tree = mtree.MTree(np.arange(4000), np.floor(centers[rng.integers(0, 20, 4000)] + rng.normal(size=(4000, 3))))
    for q in range(20):
        want = sorted((-int(tree.vectors[i] @ tree.vectors[q]), i) for i in range(4000))[:5]
        _, ids, scores = tree.search(tree.vectors[q : q + 1], 5, np.array([-1])).found()
        assert [(-s, i) for s, i in zip(scores.tolist(), ids.tolist())] == want
    assert tree.computed < 20 * 4000 / 2
    # Floors that another tree set keep all that reaches them.
    _, ids, scores = tree.search(tree.vectors[:1], 5, np.array([-1]), np.array([float(-want[2][0])])).found()
    assert (scores >= -want[2][0]).all() or len(scores) == 0


# --- toxicity ----------------------------------------------------------------------------

def test_grammar():
    g = toxicity.Grammar({"fool": 2.0}, {"blor": 2.0})
    plain, aimed, denied, told = (g.evidence(t) for t in ("The fool.", "You fool.", "Not a fool.", "They said fool."))
    assert aimed > plain > told > 0 and denied < plain
    assert g.evidence("not one two three four fool") == plain  # out of scope
    assert g.evidence("said it. fool") == plain  # another clause
    assert g.evidence("blorxyz") == 2.0 and g.evidence("a kill b") == 0 and g.evidence("kill you all") == 0
    assert all(g.evidence(t) > 0 for t in ("you kill", "he kills them", "er tötet", "il frappera"))
    assert g.evidence("") == 0 and all(0 <= g.score(t or "") <= 1 for t in ODD)


def test_toxicity_learns(spark):
    rng = random.Random(13)
    rows = []
    for i in range(600):
        toxic = i % 5 == 0
        w = words(rng, 40).split()
        if toxic:
            w[3], w[20] = "blorgs", "zork" + rng.choice("abc") + "ing"
        rows.append((i, " ".join(w), int(toxic)))
    g = toxicity.train(spark.createDataFrame(rows + [(1000, None, 1), (1001, "x", None)], "doc_id long, text string, toxic int"))
    assert g.score("w1 blorgs w2 zorkzing") >= 0.7 > 0.2 > g.score("w1 w2 w3")
    empty = toxicity.train(spark.createDataFrame([], "doc_id long, text string, toxic int"))
    assert 0 <= empty.score("anything") < 0.7
    table = docs(spark, ODD).withColumnRenamed("lang", "extra")
    assert toxicity.with_scores(table, g).count() == len(ODD)


# --- contamination -----------------------------------------------------------------------

def brute_matches(items, text):
    shingles = lambda w: Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
    found = {}
    dw = decontaminate.normal_words(text or "")
    for i, t in items:
        w = decontaminate.normal_words(t or "")
        if not w or not dw:
            continue
        # Windows that share no shingle with the item have similarity 0.
        if len(dw) >= len(w) >= 5 and not shingles(dw).keys() & shingles(w).keys():
            continue
        for at in range(max(1, len(dw) - len(w) + 1)):
            a, b = shingles(dw[at : at + len(w)]), shingles(w)
            shared = sum((a & b).values())
            s = shared / (sum(a.values()) + sum(b.values()) - shared)
            if s >= 0.8:
                found[i] = max(s, found.get(i, 0))
    return found


def test_contamination(spark):
    rng = random.Random(14)
    items = [(i, words(rng, n, 500)) for i, n in enumerate([3, 1, 5, 12, 30, 31, 60, 60])] + [(50, None), (51, "..."), (52, "w1 " * 40)]
    texts = list(ODD) + ["w1 " * 100]
    for _, t in items[:8]:
        w = t.split()
        texts += [words(rng, 50, 500) + ", " + t.upper().replace(" ", ",  ") + ". " + words(rng, 20, 500), t, " ".join([*w[:-1], "zzz"]), " ".join(w[: len(w) // 2])]
        if len(w) > 20:
            texts.append(words(rng, 9, 500) + " " + " ".join(w[:-2] + ["other", "end"]))
    index = decontaminate.ItemIndex(items)
    for t in texts:
        got = {i: s for i, _, s in index.find(t or "")}
        want = brute_matches(items, t)
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in got)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(docs(spark, texts), bench)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(d, i) for d, t in enumerate(texts) for i in brute_matches(items, t)}
    assert decontaminate.contaminated(docs(spark, texts), bench.limit(0)).count() == 0


def test_multi_index_is_complete_and_selects():
    rng = np.random.default_rng(15)
    prints = rng.integers(0, 2**64, (3000, 2), np.uint64)
    sizes = rng.integers(9, 11, 3000)
    index = decontaminate.MultiIndex(sizes, prints)
    probes = []
    for f in prints[:40]:
        for n in (0, 1, 20, 31, 32):
            flip = np.zeros(128, np.uint8)
            flip[rng.choice(128, n, replace=False)] = 1
            probes.append(f ^ np.packbits(flip).view(np.uint64))
    probes = np.array(probes)
    for size in (9, 10):
        near = (np.bitwise_count(probes[:, None] ^ prints[None, :]).sum(axis=2) <= decontaminate.RADIUS) & (sizes == size)
        assert set(zip(*(c.tolist() for c in index.candidates(size, probes)))) == set(zip(*(c.tolist() for c in np.nonzero(near))))
    strangers = rng.integers(0, 2**64, (200, 2), np.uint64)
    met = {pair for row, item in index.pairs(9, strangers) for pair in zip(row.tolist(), item.tolist())}
    assert len(met) < 0.1 * 200 * (sizes == 9).sum()


@pytest.mark.parametrize("n", [9, 18, 27, 60, 100])
def test_recall_at_the_least_similarity(n):
    """Windows that share just eight ninths of an item's shingles, the hardest case."""
    rng = np.random.default_rng(n)
    shared, caught, total = decontaminate.least_shared(n), 0, 600
    for _ in range(total):
        item = rng.integers(0, 2**64, n, np.uint64)
        window = np.concatenate([item[:shared], rng.integers(0, 2**64, n - shared, np.uint64)])
        a, b = (decontaminate.window_fingerprints(x, n)[0] for x in (item, window))
        caught += int(np.bitwise_count(a ^ b).sum()) <= decontaminate.RADIUS
    assert caught >= 0.99 * total


def test_many_items_in_passes(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 400)
    rng = random.Random(19)
    items = [(i, words(rng, 12, 10_000)) for i in range(40)]
    texts = [f"{words(rng, 5)} {t} {words(rng, 5)}" for _, t in items[::2]] + [None, ""]
    table = docs(spark, texts).withColumnRenamed("lang", "matches")
    got = decontaminate.with_matches(table, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r["doc_id"]: [m["item_id"] for m in r["matches"]] for r in got} == {i: [2 * i] if t else [] for i, t in enumerate(texts)}


# --- quality -----------------------------------------------------------------------------

def brute_kneser_ney(texts):
    n = kneser_ney.ORDER
    counts = {n: Counter()}
    for t in texts:
        line = "\x02" * (n - 1) + t
        counts[n].update(line[i : i + n] for i in range(len(t)))
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    d = {k: kneser_ney.discounts(Counter(c for c in counts[k].values() if c <= 4)) for k in counts}
    size = len(counts[1]) + 1

    def p(gram):
        k = len(gram)
        low = p(gram[1:]) if k > 1 else 1 / size
        mine = {g: c for g, c in counts[k].items() if g[:-1] == gram[:-1]}
        if not mine:
            return low
        cut = lambda c: d[k][min(c, 3) - 1]
        total = sum(mine.values())
        return (max(mine[gram] - cut(mine[gram]), 0) / total if gram in mine else 0) + sum(map(cut, mine.values())) / total * low

    return p


@pytest.mark.parametrize("held", [shards.HELD_ROWS, 60])
def test_kneser_ney(spark, monkeypatch, held):
    """One shard an order, and many of which a worker holds a few."""
    if held == 60:
        monkeypatch.setattr(shards, "SHARD_ROWS", 30)
    rng = random.Random(16)
    good = ["".join(rng.choice("abcab ") for _ in range(60)) for _ in range(12)]
    model = kneser_ney.train(spark.createDataFrame([(t,) for t in [*good, None, ""]], "text string"))
    p = brute_kneser_ney(good)
    probes = [good[0], "abz", "", None, "zzz é", "ab " * 50]
    got = {r["doc_id"]: r for r in kneser_ney.with_log_likelihood(docs(spark, probes), model, held_rows=held).collect()}
    for i, t in enumerate(probes):
        line = "\x02" * 3 + (t or "")
        want = sum(np.log(p(line[k : k + 4])) for k in range(len(t or "")))
        assert abs(got[i]["loglik"] - want) < 1e-6 and got[i]["n_symbols"] == len(t or "")
    assert abs(sum(p("\x02\x02\x02" + c) for c in "abc ") + p("\x02\x02\x02z") - 1) < 1e-9


def test_quality_decisions(spark):
    rng = random.Random(17)
    good = [words(rng, 40) for _ in range(300)]
    table = docs(spark, good + ODD + ["$%&§ " * 30])
    out = {r["doc_id"]: r for r in kneser_ney.quality(table, table.filter("doc_id < 280")).collect()}
    assert sum(out[i]["keep"] for i in range(280, 300)) >= 18 and not out[len(good) + len(ODD)]["keep"]
    assert out[300]["perplexity"] is None and not out[300]["keep"]
    assert kneser_ney.quality(table, table.limit(0)).filter("keep").count() == 0
    one_half = kneser_ney.quality(table, table.filter("doc_id < 280 and pmod(xxhash64(doc_id), 2) = 1")).collect()
    assert len(one_half) == len(out) and not any(r["keep"] for r in one_half) and any(r["perplexity"] for r in one_half)


def test_token_workers_hand_back_what_they_freed():
    """An idle worker counts with all it holds; after a group of texts nothing large is left to be handed back."""
    import subprocess
    import sys

    code = """
import random
from sluicework.llm import _shared, token_ids
from sluicework.llm.queries import tokenizer_path

def held():
    with open("/proc/self/status") as f:
        return next(int(line.split()[1]) for line in f if line.startswith("VmRSS")) / 1024

draw = random.Random(7)
texts = (" ".join("".join(draw.choices("abcdefghijklmnop", k=5)) for _ in range(300)).encode() for _ in range(4000))
tokens = sum(len(ids) for ids in token_ids.encoded_groups(texts, 2, tokenizer_path())) // token_ids.ID_BYTES
before = held()
_shared.pa.default_memory_pool().release_unused()
__import__("ctypes").CDLL(None).malloc_trim(0)
print(tokens, before - held())
"""
    made = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))})
    tokens, left = made.stdout.split()
    assert int(tokens) > 1_000_000 and float(left) < 20, made.stdout + made.stderr
