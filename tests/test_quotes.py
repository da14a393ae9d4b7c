"""Near quotes: against the whole table of edit distances."""

import random
import re

from assayer.operators import quotes as Q


def split(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def best(q, t):
    """(distance, first, end): least distance, then earliest begin, then earliest end, over all passages."""
    row = [(i, 0) for i in range(len(q) + 1)]
    found = (*row[-1], 0)
    for j, w in enumerate(t, 1):
        new = [(0, j)]
        for i, x in enumerate(q, 1):
            new.append(min((row[i - 1][0] + (x != w), row[i - 1][1]), (row[i][0] + 1, row[i][1]), (new[-1][0] + 1, new[-1][1])))
        row = new
        found = min(found, (*row[-1], j))
    return found


def test_best_passages_equal_the_whole_table(spark):
    r = random.Random(12)
    vocabulary = [f"w{i}" for i in range(30)] + ["the"] * 12
    texts = {f"raw/{i}.md": " ".join(r.choice(vocabulary) for _ in range(n)) for i, n in enumerate((0, 2, 40, 150, 300))}
    texts["raw/odd.md"] = "The  Tide, rose -- THE tide fell; the tide rose."
    rows = []
    for name, text in texts.items():
        own = text.split()
        for _ in range(14):
            at, n = r.randrange(max(len(own), 1)), r.choice([1, 3, 6, 9, 20])
            q = own[at : at + n] or ["w1"]
            for _ in range(r.randint(0, 4)):
                i = r.randrange(len(q) + 1)
                q = r.choice([q[:i] + q[i + 1 :], [*q[:i], "new", *q[i:]], [*q[:i], "other", *q[i + 1 :]]])
            rows.append((name, " ".join(q)))
    rows += [("raw/odd.md", "the tide rose the tide fell"), ("raw/odd.md", "THE tide fell;"), ("raw/none.md", "the tide rose"), ("raw/odd.md", None), ("raw/odd.md", ""), (None, "a b c")]
    quotes = spark.createDataFrame([(i, *x, "clash") for i, x in enumerate(rows)], "quote_id int, raw string, quote string, text string")
    dossiers = spark.createDataFrame([*texts.items(), ("raw/null.md", None)], "raw string, text string")
    got = {x["quote_id"]: x for x in Q.near_quotes(quotes, dossiers).collect()}
    assert len(got) == len(rows)
    near = 0
    for i, (name, quote) in enumerate(rows):
        q, t = split(quote), split(texts.get(name))
        k, (distance, first, end) = len(q) // 3 - 1, best(q, t)
        expected = (distance, first, end - first, " ".join(t[first:end])) if 0 <= k and distance <= k and q else (None,) * 4
        x = got[i]
        assert (x["distance"], x["first_word"], x["n_words"], x["passage"]) == expected, (quote, texts.get(name))
        assert x["verbatim"] == (quote is not None and name in texts and quote in texts[name])
        near += expected[0] is not None and expected[0] > 0
    assert near > 5
    assert Q.near_quotes(quotes.limit(0), dossiers).count() == 0


def test_words_of_dossiers_are_not_shuffled(spark):
    """Below the join only the quotes' words are made."""
    quotes = spark.createDataFrame([(1, "r", "one two three four")], "quote_id long, raw string, quote string")
    found = Q.near_quotes(quotes, spark.createDataFrame([("r", "Zero, one two three four.")], "raw string, text string"))
    below = found._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter")[1]
    assert below.count("Generate") == 1
    assert found.select("verbatim", "distance", "first_word", "n_words").first() == (True, 0, 1, 4)
