import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from assayer.llm import langid, masked_lm, packing, quality, sentencepiece_codec, transcripts
from assayer.llm._common import word_hashes

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "word another  word\n" * 5_000


def prose(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 8))) for _ in range(n))


# -- quality ------------------------------------------------------------------------------------


def base(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = text.split("\n")
    doubled = sum(bool(WORDS.search(x)) and x in lines[:k] for k, x in enumerate(lines))
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), doubled, len(hit)


def test_base_statistics():
    rng = random.Random(2)
    texts = [None, "", " \n\n", "a\na\n a\n\nb", "é ü #$% <|> x y", "x" * 9, "a b c d e f g h " * 3, "a b c d e f g h", "x y z  w\n" * 4]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    assert [quality.base_statistics(t, h) for t, h in zip(texts, word_hashes(texts), strict=True)] == list(map(base, texts))


def test_quality_keeps_clean_documents(spark, documents):
    rng = random.Random(3)
    clean = [prose(rng, "etaoinshr", 60) for _ in range(120)]
    junk = [" ".join(f"{w}###" for w in prose(rng, "etaoinshr", 60).split()) for _ in range(30)]
    docs = documents([*clean, *junk, None, "short", LONG])
    trusted = spark.createDataFrame([(i,) for i in range(60)], "doc_id long")
    rows = {r["doc_id"]: r for r in quality.quality_rules(docs, trusted).collect()}
    assert all(rows[i]["kept"] for i in range(120)) and not any(rows[i]["kept"] for i in range(120, 153))
    assert rows[150]["base_failed"] and rows[152]["n_repeat_words"] == 15_000
    kept = quality.keep_good_documents(docs, trusted)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(120))
    assert quality.quality_rules(docs.limit(0), trusted).count() == 0
    assert quality.quality_rules(docs, trusted.limit(0)).where("kept").count() == 150


# -- language ID --------------------------------------------------------------------------------


def test_language_id(documents):
    rng = random.Random(4)
    made = [(prose(rng, letters, 40), lang) for lang, letters in (("aa", "etaoin"), ("bb", "éèçuxo"), ("cc", "кирилц")) for _ in range(80)]
    rng.shuffle(made)
    texts = [t for t, _ in made] + [None, "12 34 !!", "", LONG]
    docs = documents(texts, [x for _, x in made] + [None] * 4)
    rows = sorted(langid.language_id(docs).collect(), key=lambda r: r["doc_id"])
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(len(texts))]
    assert [r["held_out"] for r in rows] == held
    right = [r["lang_pred"] == made[r["doc_id"]][1] for r in rows[:240] if r["held_out"]]
    assert len(right) > 30 and all(right)
    assert [(r["lang_pred"], r["score"]) for r in rows[240:243]] == [("und", 0.0)] * 3 and all(0 <= r["score"] <= 1 for r in rows)
    kept = langid.keep_known_languages(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= set(range(240)) and kept.where("doc_id BETWEEN 240 AND 242").count() == 0
    assert langid.language_id(docs.where("lang IS NULL")).where("lang_pred <> 'und'").count() == 0
    assert langid.language_id(docs.limit(0)).count() == 0


# -- packing ------------------------------------------------------------------------------------


def test_plan_is_best_fit_decreasing():
    rng = random.Random(5)
    for _ in range(200):
        cap = rng.choice([7, 16, 64])
        items = [rng.randint(1, cap) for _ in range(rng.randint(0, 80))]
        bins = []
        for x in sorted(items, reverse=True):
            fit = [k for k, room in enumerate(bins) if room >= x]
            if fit:
                bins[min(fit, key=bins.__getitem__)] -= x
            else:
                bins.append(cap - x)
        counts = {x: items.count(x) for x in set(items)}
        used, spans = {}, {}
        for length, first, n, per, seq, at in packing.plan(counts, cap):
            for r in range(n):
                used.setdefault(length, set()).add(first + r)
                spans.setdefault(seq + r // per, []).append((at + r % per * length, length))
        assert {x: set(range(n)) for x, n in counts.items()} == used and len(spans) == len(bins)
        for own in spans.values():
            own.sort()
            assert [a for a, _ in own] == [sum(x for _, x in own[:k]) for k in range(len(own))] and sum(x for _, x in own) <= cap


def test_packing_of_texts(documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = [None, "", "don't STOP. we're", "<|endoftext|> a<|startoftext|>", "é ΣΑΣ. ½ x́ d", LONG, "日本語 12345", "same", "same", "x" * 3000]
    rows = packing.best_fit_packing(documents(texts, ids=[0, 1, 2, 3, 4, 5, 6, 7, 7, 8]), capacity=64).collect()
    pieces = sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    expected = []
    for i, text in zip([0, 1, 2, 3, 4, 5, 6, 7, 7, 8], texts, strict=True):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        expected += [(i, k // 64, k, len(ids[k : k + 64]), zlib.crc32(ids[k : k + 64].tobytes())) for k in range(0, len(ids), 64)]
    assert pieces == sorted(expected)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        own.sort()
        assert [a for a, _ in own] == [sum(x for _, x in own[:k]) for k in range(len(own))] and sum(x for _, x in own) <= 64
    assert packing.best_fit_packing(documents(texts).limit(0)).count() == 0


# -- SentencePiece ------------------------------------------------------------------------------


def test_codec_equals_the_library():
    import sentencepiece

    path = sentencepiece_codec.model_path()
    own, library = sentencepiece_codec.Codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEéèñß 0123456789 .,;:'\"-_()/\n\t  ▁日本"
    texts = [None, "", " ", "a ", "   x  ", "\n\nx\n", "▁a▁ b", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "CCCCC ggggg", "😀\x00 x́", LONG]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(600)]
    got = [np.frombuffer(x, "<i4").tolist() for x in own.encode(texts)]
    expected = [library.encode(t or "") for t in texts]
    assert got == expected
    assert [own.decode(np.array(x, np.int64)) for x in expected] == [library.decode(x) for x in expected]


def test_codec_on_tables(documents):
    docs = documents([None, "", "Hello  world\n日本", "same", "same", LONG])
    rows = sentencepiece_codec.encode_documents(docs)
    assert rows.where("round_trip").count() == 6 and rows.where("n_ids = 0").count() == 2
    back = sentencepiece_codec.decode_documents(rows)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert sentencepiece_codec.encode_documents(docs.limit(0)).count() == 0


# -- language model -----------------------------------------------------------------------------


def test_model_beats_counts_and_prefers_order(documents):
    rng = random.Random(7)
    cycle = "the cat sat on a mat and ran off to see it".split()
    ordered = [" ".join(cycle[(k + j) % len(cycle)] for j in range(200)) for k in range(300)]
    shuffled = [" ".join(rng.sample(x.split(), 200)) for x in ordered[:20]]
    docs = documents([*ordered, *shuffled, None, "", "one"])
    rows = {r["doc_id"]: r for r in masked_lm.pseudo_likelihood(docs).collect()}
    good = np.mean([rows[i]["per_word"] for i in range(300)])
    assert good > -np.log(len(cycle)) and good > np.mean([rows[i]["per_word"] for i in range(300, 320)]) + 0.3
    assert [rows[i]["log_likelihood"] for i in (320, 321)] == [0, 0] and rows[322]["n_words"] == 1
    assert masked_lm.pseudo_likelihood(docs.limit(0)).count() == 0


def test_every_position_is_a_training_target(monkeypatch):
    texts = [" ".join(f"w{i}x{k}" for k in range(i % 9)) for i in range(40)] + ["one two three " * 50, None]
    seen = []
    monkeypatch.setattr(masked_lm.Network, "train", lambda self, ids, context, rate, visits: seen.append(ids.copy()))
    net = masked_lm.Network(np.ones(masked_lm.WORDS))
    for turn in range(masked_lm.ROUNDS):
        list(masked_lm._train(net, turn)(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])])))
    assert sorted(np.concatenate(seen)) == sorted(masked_lm.leaves(np.concatenate(word_hashes(texts, lower=True))))


def odd_network(seed, skew=1.0):
    rng = np.random.default_rng(seed)
    net = masked_lm.Network(np.floor(rng.pareto(skew, masked_lm.WORDS)))
    net.v[:] = rng.standard_normal(net.v.shape)
    net.s[1:] = rng.standard_normal(net.s[1:].shape)
    return net, rng


def path_log_probability(net, word, around):
    """The product of choices, one by one."""
    x = np.concatenate([net.e[c] for c in around]).astype(float)
    h = np.tanh(x @ net.w + net.b)
    total = 0.0
    for level in range(net.depth[word]):
        node = int(net.nodes[level, word])
        z = (h * net.s[node]) @ net.v[level] + net.a[node]
        total += z[net.children[level, word]] - np.log(np.exp(z).sum())
    return total


def test_choices_on_a_path_and_their_sum():
    net, rng = odd_network(5, 0.7)
    paths = {(tuple(net.nodes[:d, w]), tuple(net.children[:d, w])) for w, d in enumerate(net.depth)}
    assert len(paths) == masked_lm.WORDS
    around = rng.integers(0, masked_lm.WORDS + 1, (40, 2 * masked_lm.SIDE)).astype(np.int32)
    ids = rng.integers(0, masked_lm.WORDS, 40).astype(np.int32)
    assert np.allclose(net.log_probabilities(ids, around), [path_log_probability(net, w, c) for w, c in zip(ids, around, strict=True)], atol=1e-3)
    every = np.arange(masked_lm.WORDS, dtype=np.int32)
    assert abs(np.exp(net.log_probabilities(every, np.repeat(around[:1], masked_lm.WORDS, 0)).astype(float)).sum() - 1) < 1e-3


def test_context_tells_words_of_a_node_apart():
    net, rng = odd_network(6)
    deep = np.flatnonzero(net.depth == net.depth.max())
    x, y = (int(w) for w in deep[:2])
    around = rng.integers(0, masked_lm.WORDS, (2, 2 * masked_lm.SIDE)).astype(np.int32)
    which = rng.integers(0, 2, 1024)
    for _ in range(60):
        net.train(np.array([x, y], np.int32)[which], around[which], 1.0)
    p = [net.log_probabilities(np.array([x, y], np.int32), around[[k, k]]) for k in (0, 1)]
    assert p[0][0] > p[0][1] + 1 and p[1][1] > p[1][0] + 1


def test_step_follows_the_gradient():
    net, rng = odd_network(7)
    ids, context = rng.integers(0, masked_lm.WORDS, 2048).astype(np.int32), rng.integers(0, masked_lm.WORDS, (2048, 2 * masked_lm.SIDE)).astype(np.int32)
    loss = lambda n: -float(n.log_probabilities(ids, context).sum(dtype=float))
    new = net.copy()
    new.train(ids, context, 1e-3)
    for name in ("w", "b", "v"):
        step = getattr(new, name).astype(float) - getattr(net, name)
        one = net.copy()
        scale = 0.02 / np.abs(step).max()
        getattr(one, name)[...] += step * scale
        assert abs((loss(one) - loss(net)) / len(ids) / (-(step**2).sum() / 1e-3 * scale) - 1) < 0.3
    for name in ("e", "s", "a"):  # their steps are scaled by row: downhill is what matters
        one = net.copy()
        step = getattr(new, name) - getattr(net, name)
        getattr(one, name)[...] += step * np.float32(0.02 / np.abs(step).max())
        assert loss(one) < loss(net)


def test_scores_are_sums_over_the_whole_text(monkeypatch):
    net, rng = odd_network(8)
    words = [f"w{rng.integers(0, 200)}" for _ in range(300)]
    texts = [" ".join(words), " ".join(words[:7]), "", words[0], " ".join(words[20:90])]
    documents = word_hashes(texts)
    bits = 20
    cells = np.zeros(1 << bits, np.uint8)
    cell = lambda h: (h >> np.uint64(64 - bits)).astype(int)
    for h in documents:
        np.add.at(cells, cell(h), 1)
    net.counts = cells.reshape(masked_lm.WORDS, -1).sum(1).astype(float)
    expected = []
    for h in documents:
        ids, total = masked_lm.leaves(h), 0.0
        around = masked_lm.contexts(ids)
        for k, c in enumerate(cell(h)):
            own = int((cell(h) == c).sum())
            count, rest = int(cells[c]) - own, net.counts[ids[k]] - own
            total += path_log_probability(net, ids[k], around[k]) + np.log((count + masked_lm.UNSEEN) / (rest + masked_lm.UNSEEN * (1 << bits - masked_lm.WORD_BITS)))
        expected.append(total)
    assert np.allclose(masked_lm.Model(net, cells).scores(documents), expected, atol=0.05)
    monkeypatch.setattr(masked_lm, "BATCH", 64)
    assert np.allclose(masked_lm.Model(net, cells).scores(documents), expected, atol=0.05)
    assert (masked_lm.coded(np.arange(33)) == np.arange(33)).all() and abs(masked_lm.COUNTS[masked_lm.coded(np.array([10**6]))[0]] / 10**6 - 1) < 0.1


def test_counts_are_those_of_all_words(spark, documents):
    rng = random.Random(12)
    texts = [prose(rng, "abcde", rng.randint(0, 60)) for _ in range(200)] + [None, "", LONG]
    model = masked_lm.fit(documents(texts))
    h = np.concatenate(word_hashes(texts, lower=True))
    assert (model.net.counts == np.bincount(masked_lm.leaves(h), minlength=masked_lm.WORDS)).all()
    assert (model.cells == masked_lm.coded(np.bincount((h >> np.uint64(64 - model.bits)).astype(int), minlength=1 << model.bits))).all()


def test_a_text_that_occurs_twice_scores_higher(documents):
    rng = random.Random(13)
    texts = [prose(rng, "etaoinshrdlu", 80) for _ in range(120)]
    rows = [r["per_word"] for r in masked_lm.pseudo_likelihood(documents([*texts, *texts[:20]])).orderBy("doc_id").collect()]
    assert np.mean(np.array(rows[:20])[:, None] > np.array(rows[20:120])[None]) > 0.95


def test_all_trusted_documents_count(spark, documents, monkeypatch):
    from pyspark.sql import functions as F

    ids = spark.range(60_000).select(F.col("id").alias("doc_id"))
    last = [r[0] for r in ids.orderBy(F.xxhash64("doc_id").desc()).limit(5).collect()]
    docs = documents(["abc abd " * 9] * 5 + ["xyz xyw " * 9] * 5, ids=[*last, *range(70_000, 70_005)])
    few = quality.log_ratios(docs, ids.where(F.col("doc_id").isin(last)))
    assert few.any() and (quality.log_ratios(docs, ids) == few).all()
    monkeypatch.setattr(quality, "BROADCAST_IDS", 10, raising=False)
    assert (quality.log_ratios(docs, ids) == few).all()


# -- chats --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def conversations(spark):
    rng = random.Random(9)
    rows = []
    for c in range(120):
        roles = (["system"] if c % 5 == 0 else []) + ["user", "assistant"] * (1 + c % 4)
        rows += [(c, k, r, "\n".join(prose(rng, "etaoinshr", 12).capitalize() + "." for _ in range(1 + (k + c) % 3)), "x") for k, r in enumerate(roles)]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, chat string")


def turns_of(conversations):
    given = {}
    for r in conversations.orderBy("conv_id", "turn").collect():
        given.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    return given


def line_roles(turns):
    return [role for role, text in turns for _ in text.split("\n")]


def by_marker_alone(lines):
    """Roles from the words of markers; a line without one goes on in the role before."""
    out = []
    for line in lines:
        m = transcripts._MARKER.match(line)
        out.append(transcripts._ROLE_OF.get(m[2].lower(), out[-1] if out else "user") if m else out[-1] if out else "user")
    return out


def test_model_beats_markers_on_styles_it_has_not_seen(conversations):
    model = transcripts.fit(conversations, (0, 1, 2))
    right = plain = n = 0
    for turns in turns_of(conversations).values():
        for style in (3, 4, 5):
            text, states = transcripts.written(turns, style)
            lines, roles = text.split("\n"), [transcripts.STATES[s][0] for s in states]
            right += sum(transcripts.STATES[s][0] == r for s, r in zip(model.viterbi(lines), roles, strict=True))
            plain += sum(a == r for a, r in zip(by_marker_alone(lines), roles, strict=True))
            n += len(lines)
    assert right > 0.85 * n and n - right < 0.7 * (n - plain)


def test_roles_are_recovered(conversations):
    model = transcripts.fit(conversations)
    rows = transcripts.format_chats(transcripts.as_transcripts(conversations), model).collect()
    given = turns_of(conversations)
    assert {r["conv_id"] for r in rows} == set(given) and not any(r["continued"] for r in rows)
    assert sum([*zip(r["roles"], r["texts"], strict=True)] == given[r["conv_id"]] for r in rows) >= 0.5 * len(given)
    assert rows[0]["chat"].startswith("<|") and rows[0]["chat"].count("<|end|>") == rows[0]["n_turns"]


def test_path_is_the_best_of_all(conversations):
    import itertools

    model = transcripts.fit(conversations)
    lines = ["User: hello", "and more", "Asistant: yes.", "", "what? no"]
    emitted = model.emitted(lines, True)

    def weight(path):
        return sum(model.move[a, b] + e[b] for a, b, e in zip((transcripts.START, *path), path, emitted, strict=False))

    best = max(itertools.product(range(len(transcripts.STATES)), repeat=len(lines)), key=weight)
    assert tuple(model.viterbi(lines)) == best
    matrix = model.matrix(lines, True)
    assert abs(matrix[transcripts.START].max() - weight(best)) < 1e-9
    assert np.allclose(transcripts.product(model.matrix(lines[:2], True), model.matrix(lines[2:], False)), matrix)


def test_cut_transcripts_are_decoded_as_a_whole(spark, monkeypatch):
    rng = random.Random(10)
    rows = [(c, k, "user" if k % 2 == 0 else "assistant", "\n".join(prose(rng, "etaoin", 8) for _ in range(1 + k % 3))) for c, n in ((1, 700), (2, 5), (3, 40)) for k in range(n)]
    rows += [(4, None, "user", f"n{k}") for k in range(150)] + [(4, 3, "user", "same")] * 140 + [(4, 9, "assistant", "last")]
    conversations = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(transcripts, "SEGMENT", 8)
    monkeypatch.setattr(transcripts, "WIDTH", 4)
    model = transcripts.fit(conversations)
    cut = transcripts.as_transcripts(conversations)
    parts = {}
    for r in cut.orderBy("conv_id", "segment", "part").collect():
        parts.setdefault(r["conv_id"], []).append(r["transcript"])
    assert len(parts[1]) > 80 and len(parts[4]) > 4
    found = {}
    for r in transcripts.format_chats(cut, model).orderBy("conv_id", "segment", "part").collect():
        turns = found.setdefault(r["conv_id"], [])
        own = [*zip(r["roles"], r["texts"], strict=True)]
        if r["continued"]:
            turns[-1] = (turns[-1][0], turns[-1][1] + "\n" + own[0][1])
            own = own[1:]
        turns += own
    for c, texts in parts.items():
        whole = model.parse("\n".join(texts))[0]
        assert found[c] == whole or c == 4 and [t for _, t in found[c]] == [t for _, t in whole]  # equal lines: paths tie


def test_odd_transcripts(spark, conversations):
    model = transcripts.fit(conversations)
    odd = spark.createDataFrame([(1, 0, None, None), (1, 1, "user", "a <|end|> b"), (None, None, "user", ""), (2, 5, "robot", "x"), (3, 70, "user", "late"), (3, 1, "user", "early"), (1, 1, "user", "a <|end|> b")], "conv_id long, turn long, role string, text string")
    rows = transcripts.format_chats(transcripts.as_transcripts(odd), model).collect()
    assert len(rows) == 5 and all("<|end|> b" not in r["chat"] for r in rows)
    assert model.parse(None) == ([], False) and model.parse("") == ([], False)
    alone = spark.createDataFrame([(None, None, "user", "x")] * 200, "conv_id long, turn long, role string, text string")
    assert transcripts.as_transcripts(alone).count() == 200 and transcripts.format_chats(transcripts.as_transcripts(alone), model).count() == 200
    long = spark.createDataFrame([(1, 0, "user", LONG), (1, 1, "assistant", "yes")], "conv_id long, turn long, role string, text string")
    assert transcripts.format_chats(transcripts.as_transcripts(long), model).first()["chat"].count("another") == 5_000
    assert transcripts.format_chats(transcripts.as_transcripts(conversations.limit(0)), transcripts.fit(conversations.limit(0))).count() == 0
