"""Fill-in-middle, ranked search and order-preserving packing: against brute force, with odd texts and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayer.llm import middle, wavelet, windows

# -- fill in the middle -------------------------------------------------------------------------------


def by_hand(doc_id, text):
    """doc_id, n, form, prefix_chars, middle_chars, output by regular expression and slices of lists."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    if doc_id is None or not text or re.search("<[PSM]>", text):
        return doc_id, len(lines), "plain", None, None, text
    digest = hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    form = "spm" if h[3] % 100 < 50 else "psm"
    return doc_id, len(lines), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def odd_texts():
    r = random.Random(5)
    made = ["".join(r.choice(["a", "bé", "\n", "<", "P>", "漢", " ", "S", "\r\n"]) for _ in range(n)) for n in (1, 2, 5, 17, 60, 400, 3000) for _ in range(6)]
    return [None, "", "\n", "\n\n\n", "x", "x\n", "a<P>b\n", "<S", "<", "a\nb<M>", "é" * 40 + "\n" + "<P" * 30, "line\n" * 900, "word " * 2000, *made]


@pytest.mark.parametrize("giant", [middle.GIANT, 40])
def test_middle_equals_slices_of_lines(spark, giant):
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(None, "a\nb\n"), (3, "\n\n\n"), (3, "\n\n\n")]
    docs = spark.createDataFrame([(i, t, 0, "x", 1, "y") for i, t in rows], "doc_id long, text string, n long, form string, key long, output string").repartition(3)
    found = middle.fill_in_middle(docs, giant=giant, slice_bytes=16)
    back = found.select("*", middle.restored(F.col("form"), F.col("output")).alias("text")).collect()
    assert sorted(map(repr, (tuple(x)[:6] for x in back))) == sorted(map(repr, (by_hand(*x) for x in rows)))
    assert sorted(x["text"] for x in back) == sorted(t or "" for _, t in rows)
    assert {x["form"] for x in back} == {"plain", "psm", "spm"}


def test_middle_of_no_documents(spark, documents):
    assert middle.fill_in_middle(documents(["x"]).limit(0)).count() == 0


def test_functions_compose_to_the_lines_of_a_regular_expression(monkeypatch):
    auto, r = middle.line_automaton(), random.Random(1)
    for trial in range(60):
        monkeypatch.setattr(middle, "CHUNK", r.choice([1, 3, 7, 64]))
        texts = ["".join(r.choice("ab\n<PSM>é \n") for _ in range(r.choice([0, 1, 3, 50, 4000 if trial % 20 == 0 else 30]))) for _ in range(6)]
        lines = [re.findall(r"[^\n]*\n|[^\n]+", t) for t in texts]
        cuts = [sorted((r.randint(0, len(x)), r.randint(0, len(x)))) for x in lines]

        def choose(i, n, marked, lines=lines, texts=texts, cuts=cuts):
            assert n == len(lines[i]) and marked == bool(re.search("<[PSM]>", texts[i]))
            return "psm", *cuts[i]

        data = np.frombuffer("".join(texts).encode(), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
        got = [(a, b) for _, _, a, b in middle.cut_bytes(auto, data, at, choose)]
        assert got == [tuple(len("".join(x[:c]).encode()) for c in own) for x, own in zip(lines, cuts, strict=True)]


# -- ranked search ------------------------------------------------------------------------------------


def ranked(docs, queries, k=10):
    """The contract's formula over all documents, one by one."""
    term = lambda t: re.findall(wavelet.TERM, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    counts = [(i, Counter(term(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in queries:
        found = []
        for doc_id, c, n in held:
            m = 25 + (75 * n * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in term(text) if t in c)
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        found.sort(key=lambda x: x[:3])
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(found[:k])]
    return sorted(map(repr, out))


@pytest.mark.parametrize("shard_pairs", [wavelet.SHARD_PAIRS, 60])
def test_search_equals_all_scores(spark, shard_pairs):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ünder", "naïve", "X9", "漢字"]
    draw = lambda n: " ".join(vocabulary[min(int(r.expovariate(0.08)), 63)] for _ in range(n))
    docs = [(i, draw(r.choice([0, 1, 5, 30, 200]))) for i in range(90)] + [(7, "w1, w1;w2"), (7, "w1, w1;w2"), (None, "w1 w1 w2"), (200, None), (201, "?!"), (202, "W1-w2 " * 9)] + [(300 + i, "twin w40 text") for i in range(25)]
    queries = [(i, draw(r.choice([1, 4, 12, 40]))) for i in range(20)] + [(5, "w1 W1 w1"), (5, "w1 W1 w1"), (None, "twin"), (90, None), (91, "--"), (92, "unheard of"), (93, "TWIN w40")]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, terms string, score long").repartition(3)
    index = wavelet.build(frame, shard_pairs)
    if shard_pairs < 100:
        assert index.shards.count() > 6
    items = spark.createDataFrame([(i, t, 0) for i, t in queries], "item_id long, text string, rank int")
    for more in ({}, {"block_rows": 8}):
        got = index.search(items, **more)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(repr(tuple(x)) for x in got.collect()) == ranked(docs, queries)
    assert sorted(repr(tuple(x)) for x in index.search(items, k=3).collect()) == ranked(docs, queries, 3)


def test_search_in_nothing(spark, documents):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert wavelet.build(documents(["a"]).limit(0)).search(items).count() == 0
    index = wavelet.build(documents(["a", "b"]))
    assert index.search(items.limit(0)).count() == 0
    assert [tuple(x) for x in index.search(items).collect()] == [(1, 1, 0, 693 * (10**9 // 1800))]


def test_ranges_of_a_list_fall_by_impact():
    r = random.Random(4)
    own = wavelet.Builder(40, 900)
    for i in range(40):
        own.add(i, Counter(f"t{min(int(r.expovariate(0.3)), 9)}".encode() for _ in range(r.randint(1, 60))))
    row = own.shard().to_pylist()[0]
    shard = wavelet.Shard(row)
    value = np.frombuffer(row["impacts"], np.int32)
    assert all((np.diff(value[a:b]) <= 0).all() for a, b in zip(shard.starts[:-1], shard.starts[1:], strict=True))
    assert sorted(shard.exact) == sorted(value) and shard.height == 6
    long = wavelet.counted(("Ab1 " * 400_000).encode())
    assert long == Counter({b"ab1": 400_000})


# -- packing in order ---------------------------------------------------------------------------------


def cheapest(at, cost, capacity):
    best = [0] + [math.inf] * (len(at) - 1)
    for j in range(1, len(at)):
        for i in range(j):
            n = at[j] - at[i]
            if n <= capacity:
                best[j] = min(best[j], best[i] + cost[j] + (0 if n & (n - 1) == 0 else capacity - n))
    return best[-1]


def test_cuts_are_the_cheapest():
    r = random.Random(2)
    for _ in range(200):
        capacity, at = r.choice([8, 16, 13]), [0]
        while len(at) < r.randint(2, 50):
            at.append(at[-1] + r.randint(1, capacity - 1))
        cost = [0] + [r.choice([0, 1, 5]) for _ in at[1:]]
        paid = before = 0
        for j in windows.cut(np.array(at), np.array(cost), capacity):
            n = at[j] - before
            assert 0 < n <= capacity
            paid, before = paid + cost[j] + (0 if n & (n - 1) == 0 else capacity - n), at[j]
        assert before == at[-1] and paid == cheapest(at, cost, capacity)


def test_packing_in_order(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    r = random.Random(6)
    sentence = lambda: " ".join(r.choice(["tide", "ebb", "Moon-light", "été", "x9"]) for _ in range(r.randint(3, 12))) + r.choice([". ", "! ", "?\n"])
    texts = [None, "", " \n", "one", "no stop " * 900, *("".join(sentence() for _ in range(r.choice([1, 3, 20, 300]))) for _ in range(40))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a null id."), (3, "one")]
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id long, text string, start long, length long").coalesce(1)
    pieces = windows.order_preserving_packing(docs).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    at, taken = 0, {}
    for doc_id, text in rows:  # pieces come in the documents' order
        ids, done = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], 0
        while done < len(ids):
            p = pieces[at]
            assert (p["doc_id"], p["start"], p["doc_tokens"], p["offset"]) == (doc_id, done, len(ids), taken.get(p["sequence_id"], 0))
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[done : done + p["length"]], "<u4").tobytes())
            taken[p["sequence_id"]] = p["offset"] + p["length"]
            done, at = done + p["length"], at + 1
        assert done == len(ids)
    assert at == len(pieces) and max(taken.values()) <= windows.CAPACITY
    row = windows.padding(windows.order_preserving_packing(docs)).first()
    assert (row["sequences"], row["tokens"]) == (len(taken), sum(taken.values())) and row["padding"] <= 0.05 * row["tokens"]
    assert windows.order_preserving_packing(docs.limit(0)).count() == 0


def test_runs_leave_no_trace():
    """Windows that are made run by run lose no token and pad hardly more than those of one run."""
    closing = np.array([False, True])
    r = random.Random(8)
    docs = [(i, np.array([r.random() < 0.1 for _ in range(r.randint(1, 400))], "<u4").tobytes()) for i in range(300)]

    def packed(every):
        stream, out = windows.Stream(closing, 64, 0), []
        for i, buf in docs:
            stream.add(i, buf)
            if stream.tokens >= every:
                out.append(stream.windows())
        out.append(stream.windows(0))
        return [x for b in out for x in b.to_pylist()]

    def pad(found):
        sizes = Counter()
        for x in found:
            sizes[x["sequence_id"]] += x["length"]
        assert max(sizes.values()) <= 64
        return sum(0 if n & (n - 1) == 0 else 64 - n for n in sizes.values()), len({x["sequence_id"] for x in found})

    whole, runs = packed(1 << 30), packed(3000)
    for found in (whole, runs):
        for i, buf in docs:
            own = [x for x in found if x["doc_id"] == i]
            assert [x["start"] for x in own] == np.cumsum([0, *(x["length"] for x in own)])[:-1].tolist() and sum(x["length"] for x in own) == len(buf) // 4
    assert pad(runs)[0] <= pad(whole)[0] + 200


def test_long_texts_are_split_at_spaces():
    r = random.Random(9)
    text = "".join(r.choice(["ab", " ", "c\n"]) for _ in range(5000))
    parts = list(windows.slices(text.encode(), 100))
    assert b"".join(parts).decode() == text and len(parts) > 50 and all(p[0] in b" \n\t\r" for p in parts[1:])
