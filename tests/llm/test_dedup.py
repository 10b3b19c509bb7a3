"""SimHash, decontamination and substring dedup against brute force, and on odd inputs."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from paperloom.llm import decontam, simhash, substring

DOCS = "doc_id long, text string, row string, fp string, key string"
CLASH = ("r", "f", "k")


def docs_of(spark, texts, ids=None):
    return spark.createDataFrame([(i, t, *CLASH) for i, t in zip(ids or range(len(texts)), texts, strict=True)], DOCS)


def slow_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(shingles))


def slow_components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def words(rng, n, vocab=400):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def test_simhash_is_brute_force(spark):
    rng = random.Random(3)
    texts = [words(rng, rng.randrange(0, 90)) for _ in range(60)]
    for t in texts[:25]:
        w = t.split()
        if w:
            w[rng.randrange(len(w))] = "x"
        texts.append(" ".join(w))
    texts += texts[:5] + [None, "", " \t\n", "ÀB İ", "one", "ONE", "a b c", "a b"] + ["long " + words(rng, 300)] * 3
    fps = [slow_fingerprint(t) for t in texts]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs_of(spark, texts)).collect()}
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{x:016x}" for x in fps]
    assert [got[i].component_id for i in range(len(texts))] == slow_components(fps)


def test_links_of_all_distances(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for b in base:
        for k in (1, 2, 3, 4, 5):
            x = b
            for bit in rng.sample(range(64), k):
                x ^= 1 << bit
            fps.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    want = {tuple(sorted((signed(a), signed(b)))) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 3}
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long")).collect()}
    assert got == want


def test_simhash_odd_tables(spark):
    assert simhash.near_duplicates(docs_of(spark, [])).count() == 0
    rows = simhash.near_duplicates(docs_of(spark, ["a b c", "a b c", "a b c"], [7, 7, None])).collect()
    assert len(rows) == 3 and {r.component_id for r in rows} == {7}


def test_similar_groups(spark):
    rng = random.Random(5)
    base = words(rng, 200)
    near = base.split()
    near[100] = "other"
    texts = [words(rng, 50), base, " ".join(near), base, words(rng, 200), None, "", "two words", "two words"]
    groups = simhash.similar_groups(docs_of(spark, texts))
    assert {r.doc_id: r.component_id for r in groups.collect()} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7, 8: 7}
    kept = simhash.keep_one(docs_of(spark, texts), groups)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 4, 5, 7] and kept.columns == docs_of(spark, []).columns
    twice = docs_of(spark, ["x y z", "x y z", "p q r", "p q r s t u v"], [3, 3, None, None])
    kept = simhash.keep_one(twice, simhash.similar_groups(twice))
    assert sorted(r.text for r in kept.collect()) == ["p q r", "p q r s t u v", "x y z"]  # null ids are no group
    assert simhash.similar_groups(docs_of(spark, [])).count() == 0


def slow_similar(texts, shingle=5, similarity=0.8):
    def grams(t):
        w = t.split()
        return {hash(tuple(w[i : i + shingle])) for i in range(len(w) - shingle + 1)}

    sets, root = [grams(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if (both := len(sets[i] & sets[j])) >= similarity * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("block", [1 << 20, 1 << 15])
def test_star_of_variants_is_one_group(spark, monkeypatch, block):
    """Each variant is near its original and to no other variant."""
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", block)
    rng = random.Random(11)
    original = words(rng, 1000, 10**6).split()
    texts = []
    for v in range(300):
        w = list(original)
        for i in rng.sample(range(1000), 17):
            w[i] = f"v{v}i{i}"
        texts.append(" ".join(w))
    texts.insert(150, " ".join(original))
    texts += [words(rng, 1000, 10**6) for _ in range(5)]
    want = slow_similar(texts)
    assert want.count(0) == 301 and slow_similar(texts[:150]) == list(range(150))
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


def slow_hits(texts, items):
    import hashlib
    import re

    tok = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    out = []
    for t in texts:
        w, hit, found = tok(t), set(), set()
        for k, item in items:
            v = tok(item)
            n = min(8, len(v))
            for i in range(len(v) - n + 1) if v and k is not None else ():
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == v[i : i + n]:
                        hit.update(range(j, j + n))
                        found.add(str(k))
        out.append((len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return out


@pytest.mark.parametrize("vocab", [4, 300])
def test_decontamination_is_brute_force(spark, vocab):
    rng = random.Random(vocab)
    items = [(i, words(rng, rng.randrange(1, 30), vocab)) for i in range(12)] + [(20, None), (21, ""), (22, "w1"), (22, "w2 w3"), (None, "w1 w2"), (3, "Été w9"), (9, "x " * 9)]
    texts = [words(rng, rng.randrange(0, 60), vocab) for _ in range(25)]
    texts += [f"{words(rng, 9, vocab)}. {t}, {words(rng, 5, vocab)}" for _, t in items if t] + [None, "", "...", "ÉTÉ été W9", "x-x x" * 10, "y" * 5000 + " w1 " + "z" * 70000]
    bench = spark.createDataFrame([(k, t, *CLASH) for k, t in items], "item_id long, text string, n string, key string, off string")
    got = {r.doc_id: tuple(r)[1:] for r in decontam.decontaminate(docs_of(spark, texts), bench).collect()}
    assert [got[i] for i in range(len(texts))] == slow_hits(texts, items)


def test_decontamination_odd_tables(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(docs_of(spark, []), bench).count() == 0
    got = decontam.decontaminate(docs_of(spark, ["a b", "a b"], [None, None]), bench).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in got] == [(2, 0, False)] * 2


@pytest.mark.parametrize("window,anchor,hot", [(20, 8, 4096), (5, 3, 4096), (5, 3, 1)])
def test_substrings_are_brute_force(spark, monkeypatch, window, anchor, hot):
    monkeypatch.setattr(substring, "HOT", hot)  # 1: every repeated anchor is dealt out by window
    rng = random.Random(window)
    texts = [words(rng, rng.randrange(0, 80), 3 if i % 3 else 500) for i in range(30)]
    shared = words(rng, 60, 900)
    texts += [f"{words(rng, 7)} {shared}", f"{shared} {words(rng, 30)} {shared}", " ".join(shared.split()[10:45]), "same " * 90, "same " * 70, None, "", "  a b", shared.upper()]
    rng.shuffle(texts)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring.digests(substring.remove_repeats(docs_of(spark, texts), window, anchor)).collect()}
    assert got == substring.brute_force(list(enumerate(texts)), window)


def test_substring_spans_and_odd_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    other = " ".join(f"v{i}" for i in range(40))
    got = substring.remove_repeats(docs_of(spark, [text, text, f"x {text}", other, f"{other} {text}"], [4, 4, None, None, 4])).collect()
    by = {r.n_words: r for r in got}
    assert by[31].doc_id is None and by[31].n_removed == 0  # a null id comes first
    assert by[40].n_removed == 0 and by[70].n_removed == 70  # rows with one id, or without one, are documents of their own
    assert all(r.n_removed == 30 for r in got if r.n_words == 30)
    span = next(r for r in got if r.n_words == 30).spans
    assert [(s.start, s.words, s.ref_start) for s in span] == [(0, 30, 1)]
    assert substring.remove_repeats(docs_of(spark, [])).count() == 0


def test_inputs_stay_whole(spark):
    df = docs_of(spark, ["a", "b"])
    assert simhash.fingerprints(df).count() == df.where(F.lit(True)).count() == 2
