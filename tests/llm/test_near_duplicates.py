"""SimHash groups against fingerprints and components computed directly."""

import random
import re

import pytest
import xxhash

from tracewell.llm import simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    grams = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def jaccard(a, b, size=5):
    sets = []
    for text in (a, b):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append({" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if any(sets) else 1.0


def groups(rows, size, radius):
    prints = [fingerprint(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[top(i)] = top(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        mine = [d for k, (d, _) in enumerate(rows) if top(k) == top(i) and d is not None]
        out.append((doc, f"{prints[i]:016x}", min(mine, default=None)))
    return out


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdéÉXYZ") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 400))] for _ in range(12)]
    texts = [None, "", " \n ", "one", "One", "two words", "é É", "a b\x0bc"]
    for words in base:
        for _ in range(4):
            copy = list(words)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(rng.choice([" ", "\n", "  ", "\t "]).join(copy))
    return texts


@pytest.mark.parametrize("size,radius", [(3, 2), (5, 2), (3, 1), (3, 3)])
def test_like_comparing_all_pairs(spark, size, radius):
    rows = [(i * 7 % 101, t) for i, t in enumerate(corpus(size + radius))]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, root int")
    if radius == 3:
        rows, docs = rows[:8], docs.where("doc_id in (0, 7, 14, 21, 28, 35, 42, 49)")
    got = simhash.near_duplicates(docs, size=size, radius=radius).collect()
    assert sorted(map(tuple, got), key=str) == sorted(groups(rows, size, radius), key=str)


def test_long_texts_pass_the_byte_counters(spark):
    rng = random.Random(3)
    text = " ".join(rng.choice("abc") * rng.randint(1, 3) for _ in range(3000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert simhash.near_duplicates(docs).first().fingerprint == f"{fingerprint(text, 3):016x}"


def test_one_of_each_group_stays(spark):
    texts = [(5, "same words here again"), (3, "Same words here again"), (3, "Same words here again"), (None, "same words  here again"),
             (None, None), (None, ""), (9, "quite other words in this one"), (9, "something else with the same id")]
    docs = spark.createDataFrame([(*r, "k") for r in texts], "doc_id long, text string, first string")
    got = [(r.doc_id, r.text or "", r.first) for r in simhash.one_of_each(docs).collect()]
    assert sorted(got, key=str) == sorted([(3, "Same words here again", "k"), (None, "", "k"),
                                          (9, "quite other words in this one", "k"), (9, "something else with the same id", "k")], key=str)
    assert simhash.one_of_each(docs.limit(0)).count() == 0


def test_long_chains_are_one_group(spark):
    from tracewell.llm.components import components

    edges = [(i, i + 1) for i in range(300)] + [(1000, k) for k in range(1001, 1400)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in found} == {**{i: 0 for i in range(301)}, **{k: 1000 for k in range(1000, 1400)}}


def edited(rng, words, rate):
    return [w if rng.random() > rate else rng.choice(words) for w in words]


def test_similar_texts_are_one_group(spark):
    rng = random.Random(9)
    rows, families = [], []
    for k in range(40):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(40, 400))]
        family = [words] + [edited(rng, words, 0.012) for _ in range(rng.randint(0, 4))]
        families.append([len(rows) + i for i in range(len(family))])
        rows += [(len(rows) + i, " ".join(w)) for i, w in enumerate(family)]
    shared = " ".join(rng.choice("xyz") * rng.randint(1, 5) for _ in range(60))
    rows += [(1000 + i, shared + " " + " ".join(rng.choice("klmnop") * rng.randint(1, 6) + str(i) for _ in range(200))) for i in range(60)]
    rows += [(2000, None), (2001, ""), (2002, rows[0][1].upper()), (None, rows[3][1]), (2003, "x" * 30_000), (2004, "y " * 9_000), (2004, "y " * 9_000)]
    docs = spark.createDataFrame([(*r, "b") for r in rows], "doc_id long, text string, form string")
    got = [r.doc_id for r in simhash.one_of_similar(docs).collect()]
    assert len(got) == len(set(got)) and None not in got
    # texts that only share a passage all stay
    assert {1000 + i for i in range(60)} <= set(got) and {2000, 2003, 2004} <= set(got) and not {2001, 2002} & set(got)
    links = [(i, j) for f in families for i in f for j in f if i < j and jaccard(rows[i][1], rows[j][1]) >= 0.8]
    parent = {i: i for i in range(len(rows))}
    for i, j in links:
        old, new = max(parent[i], parent[j]), min(parent[i], parent[j])
        parent = {k: new if p == old else p for k, p in parent.items()}
    gone = {i for f in families for i in f if parent[i] != i}
    assert len(gone) > 30 and not {i for f in families for i in f if parent[i] == i} - set(got)
    assert len(gone - set(got)) >= 0.9 * len(gone)
    assert simhash.one_of_similar(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [64, 4])
def test_similar_texts_as_by_all_pairs_on_a_hot_passage(spark, bucket):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(120)]
    texts = []
    for k in range(150):
        own = [word() for _ in range(rng.choice([3, 8, 14, 20, 30, 60]))]
        words = passage[: rng.choice([60, 120])] + own if k % 2 else own + passage
        texts += [words, edited(rng, words, rng.choice([0.01, 0.02, 0.03]))][: 1 + (k % 3 == 0)]
    for k in range(40):
        words = [word() for _ in range(rng.randint(5, 150))]
        texts += [words, edited(rng, words, 0.02), words + [word() for _ in range(len(words) // 5)]]
    rng.shuffle(texts)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in simhash.one_of_similar(docs, bucket=bucket).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common >= 0.8 * (len(sets[i]) + len(sets[j]) - common) and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    assert got == set(root) and 40 < len(got) < len(texts) - 40
