"""The near-duplicate stage against a plain comparison of all pairs."""

import random
from itertools import combinations

import pytest

import corpus_pipeline
from fieldpulse.llm import near, simhash

SCHEMA = "doc_id bigint, text string, lang string"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i: i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def likeness(s, t):
    return len(s & t) / len(s | t) if s | t else 1.0


def expected(rows):
    """Smallest id of each group; ids are distinct."""
    sets = {d: shingles(t) for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sets, 2):
        if likeness(sets[a], sets[b]) >= 0.8:
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    return {find(d) for d in sets}


def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows = []
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.randint(60, 300))
        rows.append(base)
        for _ in range(rng.randint(1, 12)):  # edits that leave likenesses on both sides of 0.8
            words = list(base)
            for _ in range(rng.randint(1, 1 + len(words) // 25)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append(words)
    texts = [" ".join(w) for w in rows] + [None, "", " \n", "one two", "ONE  two", "one", "two one"]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_stage_drops_every_pair_of_four_fifths(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "en") for d, t in rows], SCHEMA)
    far = [(s, t) for (_, s), (_, t) in combinations(rows, 2) if likeness(shingles(s), shingles(t)) >= 0.8
           and (simhash.fingerprint(s) ^ simhash.fingerprint(t)).bit_count() > simhash.MAX_BITS]
    assert len(far) > 20  # pairs that the fingerprints of op4 do not link
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == expected(rows)
    assert near.keep_first(docs.limit(0)).count() == 0


def test_rows_of_one_key_are_judged_one_by_one(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, a, "en"), (2, a, "en"), (2, b, "en"), (3, b, "de"), (3, b, "de"), (None, a, "en"), (4, None, "en"), (4, "x", "en"),
            (5, "x", "en"), (5, "y", "en"), (5, "y", "en")]
    for keep in (near.keep_first, simhash.keep_first):
        kept = keep(spark.createDataFrame(rows, SCHEMA)).collect()
        assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, [
            (1, a, "en"), (2, b, "en"), (None, a, "en"), (4, None, "en"), (4, "x", "en"), (5, "y", "en")]))


def family(rng, base, vocabulary, kind):
    """A family around one text: random edits, deletions, insertions, or copies of copies."""
    out = [list(base)]
    for _ in range(60):
        words = list(rng.choice(out) if kind == "chain" else base)
        for _ in range(rng.randint(0, max(1, len(base) // 30))):
            at = rng.randrange(len(words))
            if kind == "delete":
                del words[at: at + rng.randint(1, 6)]
            elif kind == "insert":
                words[at:at] = rng.choices(vocabulary, k=rng.randint(1, 6))
            else:
                words[at] = rng.choice(vocabulary)
        out.append(words)
    return out


@pytest.mark.parametrize("core_members, block", [(near.CORE_MEMBERS, near.BLOCK), (1, 7), (5, 16)])
def test_families_equal_all_pairs(spark, monkeypatch, core_members, block):
    """Whatever the core is, links within families are those of all pairs."""
    monkeypatch.setattr(near, "CORE_MEMBERS", core_members)
    monkeypatch.setattr(near, "BLOCK", block)
    rng = random.Random(core_members)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for kind in ("edit", "delete", "insert", "chain", "chain"):
        texts += family(rng, rng.choices(vocabulary, k=rng.randint(80, 250)), vocabulary, kind)
    shared = rng.choices(vocabulary, k=150)  # a passage that joins families that are not alike
    texts += [shared + rng.choices(vocabulary, k=rng.randint(10, 60)) for _ in range(40)]
    rows = list(enumerate(" ".join(w) for w in texts))
    docs = spark.createDataFrame([(d, t, "en") for d, t in rows], SCHEMA)
    ids = [r.doc_id for r in near.keep_first(docs).collect()]
    assert len(ids) == len(set(ids)) and set(ids) == expected(rows)


def test_any_other_columns(spark):
    names = ["copy", "node", "row", "hit", "key", "root", "stays", "piece", "bits", "at", "family", "_copy", "_hit", "_piece", "n", "x"]
    texts = ["a b c d e f g", "a b c d e f g", "h i j k l m n", None, ""]
    docs = spark.createDataFrame([(i, t, *range(len(names))) for i, t in enumerate(texts)],
                                 "doc_id int, text string, " + ", ".join(f"{n} int" for n in names))
    kept = near.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]


def test_marks_lose_no_row(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en") for i in range(2000)], SCHEMA)
    rows = docs.where("doc_id % 3 = 0").selectExpr("doc_id as key", "xxhash64(text) as copy")
    got = {r.key for r in near.marked(docs, rows, "doc_id", "text").where("hit").collect()}
    assert set(range(0, 2000, 3)) <= got and len(got) < 700
