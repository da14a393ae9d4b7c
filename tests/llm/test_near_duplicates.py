import numpy as np
import pytest

from assayer.llm import itq
from assayer.llm import ngram_join as J
from assayer.llm._common import Store, word_hashes
from assayer.llm.components import components


def closure(ids, linked):
    """Smallest id reachable, by plain union."""
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text, n):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) or frozenset([tuple(words)])


def brute(rows, n, percent):
    sets = [(i, shingles(t, n)) for i, t in rows]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x and y and 100 * len(x & y) >= percent * len(x | y)]
    return closure({i for i, _ in sets}, links), {(i, len(s)) for i, s in sets}


def corpus(seed=5):
    """Copies with edits, chains, shared passages, short and empty texts."""
    rng = np.random.default_rng(seed)
    words = np.array([f"w{k}" for k in range(60)])
    fresh = lambda m: rng.choice(words, m).tolist()
    texts = [None, "", "  \n", "one", "ONE", "one two", "one two three", "a b c d e f g h i j k l"]
    passage = fresh(40)
    for _ in range(8):
        base = fresh(int(rng.integers(40, 120)))
        texts.append(" ".join(base))
        for _ in range(6):
            copy = list(base)
            for _ in range(int(rng.integers(0, 4))):
                copy[int(rng.integers(len(copy)))] = "x" + str(rng.integers(1000))
            texts.append(" ".join(copy).upper())
            base = copy if rng.random() < 0.5 else base
        texts.append(" ".join(fresh(30) + passage))
    return texts


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
def test_join_matches_brute_force(documents, n, percent):
    texts = corpus()
    docs = documents(texts)
    got = J.jaccard_components(docs, n, percent).collect()
    parents, sizes = brute(list(enumerate(texts)), n, percent)
    assert {r["doc_id"]: r["component_id"] for r in got} == parents and {(r["doc_id"], r["n_shingles"]) for r in got} == sizes and len(got) == len(texts)


def test_repeated_null_and_empty(documents):
    t = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    other = "one two three four five six seven eight"
    docs = documents([t, t, other, t, None, "solo"], ids=[7, 7, 7, 3, None, None])
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["component_id"]) for r in J.jaccard_components(docs, 3, 90).collect())
    assert got == [(-1, None), (-1, None), (3, 3), (7, 3), (7, 3), (7, 3)]
    assert J.jaccard_components(docs.limit(0), 3, 90).count() == 0


def test_one_of_each_group_stays(documents):
    t = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    docs = documents([t, t + " extra", "something else entirely written here now", "something else entirely written here now"], ids=[4, 2, 9, 9])
    kept = J.keep_one_of_each_group(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 9]


def test_light_order_does_not_matter(documents, monkeypatch):
    """With every repeated token frequent, and with many matches asked for, the links are the same."""
    texts = corpus(9)
    monkeypatch.setattr(J, "LIGHT", 1)
    monkeypatch.setattr(J, "CLUSTER", 2)
    monkeypatch.setattr(J, "BLOCK", 3)
    got = {r["doc_id"]: r["component_id"] for r in J.jaccard_components(documents(texts), 3, 90).collect()}
    assert got == brute(list(enumerate(texts)), 3, 90)[0]


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(k, k + 1) for k in range(200, 260)] + [(5, 5), (None, 3)]
    got = {r["v"]: r["c"] for r in components(spark.createDataFrame(links, "x long, y long"), Store(spark)).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == closure({i for p in real for i in p}, real)


def test_word_hashes_of_long_texts():
    text = "Alpha beta\tGAMMA\x0b" * 60_000
    a, b, c = word_hashes([text, None, "alpha BETA gamma"], lower=True)
    assert len(a) == 180_000 and len(b) == 0 and (a[:3] == c).all() and len(np.unique(a)) == 3
    assert len(word_hashes(["x" * 2_000_000 + " y"])[0]) == 2


def vectors(seed=3):
    rng = np.random.default_rng(seed)
    rows = [rng.standard_normal(32) for _ in range(150)]
    for _ in range(4):
        centre = rng.standard_normal(32)
        rows += [centre + rng.standard_normal(32) * s for s in rng.uniform(0.02, 0.35, 40)]
    rows += [rows[0], rows[0] * 2, np.zeros(32), rows[1] * 1e-170, rows[2] * 1e170]
    return [r.tolist() for r in rows] + [None, [], [float("nan")] * 32, [None] * 32, [1.0, 2.0], [2.0, 4.0]]


def test_embeddings_match_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame([(i, r, 1, "x") for i, r in enumerate(rows)] + [(None, rows[0], 1, "x")], "vec_id long, embedding array<double>, n_links int, key string")
    got = {r["vec_id"]: r for r in itq.near_duplicates(df).collect()}
    unit = {i: np.array(r) / np.abs(r).max() for i, r in enumerate(rows) if r and None not in r and np.isfinite(r).all() and np.any(r)}
    unit = {i: x / np.linalg.norm(x) for i, x in unit.items()}
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95]
    found = sum(r["n_links"] for r in got.values()) / 2
    assert found >= 0.98 * len(links) and len(links) > 1000
    parents = closure(range(len(rows)), links)
    assert sum(got[i]["component_id"] == parents[i] for i in parents) >= 0.97 * len(parents)
    degree = np.zeros(len(rows))
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    assert all(got[i]["n_links"] <= degree[i] for i in range(len(rows)))
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got.values()) and got[None]["component_id"] is None


def test_blocks_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(itq, "BLOCK", 16)
    rng = np.random.default_rng(0)
    x = rng.standard_normal(16) + rng.standard_normal((100, 16)) * 0.01
    got = itq.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()
    assert {r["n_links"] for r in got} == {99} and {r["component_id"] for r in got} == {0}
    assert itq.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
