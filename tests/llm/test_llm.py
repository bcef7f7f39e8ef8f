"""Training-data operators against brute force, and on null, empty, repeated, tied and oddly named rows."""

import collections
import hashlib
import json
import random
import re
import time
import zlib

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lamina.llm import additive, balltree, bpe, entries, licenses, merkle, near, packing, quality, secrets, tokens, toxicity
from lamina.llm.fst import Transducer, lexicon
from lamina.llm.links import components

TEXTS = ["", None, "a", "Hello  world\n\n x", "  lead", "trail \n", "ΑΣ İstanbul ǅ ﬁ éẛ̣ x\x1cy", "日本語 テキスト　x", "don't we'LL I'M 1234 ½ ²", "\x00 a\x00b\n\nc", "aaaaaaa aaaa aa bbbbbb" * 3, "a\r\nb\tc", "🙂🙂 ë́", "a <|endoftext|>b  <|endoftext|>\n c", "<|startoftext|> Hello <|ENDOFTEXT|>", "word " * 3000, "x" * 5000, "the idiot said\nmoron", "the idiot said\nmoron"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, repeated rows, and columns named like the operators' own."""
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 2}", i, "n", 0.5) for i, t in enumerate(TEXTS)]
    rows += [rows[3], rows[3], (None, "null key", "en", "s", None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, node string, score double")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


# -- BPE ---------------------------------------------------------------------------------------------------


def reference(name):
    t = Tokenizer.from_file(P.path(name))
    t.no_padding()
    t.no_truncation()
    return t


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_library(documents, name):
    texts = TEXTS + [r.text for r in documents.limit(120).collect()]
    want = [x.ids for x in reference(name).encode_batch([t or "" for t in texts], add_special_tokens=False)]
    rng = random.Random(4)
    signs = ["ab", "A", ".", ",", ", ", ". ", ",\n", ".\n", "'s ", " ", "\n", "\t", "é", "Σ", "1", "\x00", "\x02", "!", '"', "\u0301", "\r\n"]
    odd_ones = ["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(1500)]
    want += [x.ids for x in reference(name).encode_batch(odd_ones, add_special_tokens=False)]
    texts += odd_ones
    for limit in (1_500_000, 500):  # also with a cache that starts anew all the time
        enc = bpe.Encoder(P.path(name), limit)
        got = [r for a, b in bpe.portions(texts, 3000) for r in enc.encode_batch(texts[a:b])]
        assert [g.tolist() for g in got] == want


def test_merges_leftmost_only_when_symbols_have_several_merges():
    v = bpe.Vocabulary(P.path("byte_bpe_50k.json"))
    words = [w.encode() for w in ("aaaaaaa", "banana", "mississippi", "x", "é" * 9, "thethethe")]
    all_at_once = v.encode_words(words)
    v.at_once = False
    one_by_one = v.encode_words(words)
    assert all((a == b).all() for a, b in zip(all_at_once, one_by_one, strict=True))


def test_encode_query(odd, empty):
    out = tokens.encode(odd, P.path("byte_bpe_50k.json"), outputs=("n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"))
    lib = reference("byte_bpe_50k.json")
    source = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=repr)
    want = []
    for k, t in source:
        ids = lib.encode(t, add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        assert back == t
        want.append((k, len(ids), ids, back, hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted(want, key=repr)
    assert tokens.encode(empty, P.path("byte_bpe_50k.json")).count() == 0


# -- packing -----------------------------------------------------------------------------------------------


def test_tournament_tree_is_first_fit():
    rng = random.Random(1)
    tree, room = packing.TournamentTree(40, 50), [50] * 40
    for _ in range(60):
        n = rng.randint(1, 25)
        want = next(i for i, r in enumerate(room) if r >= n)
        room[want] -= n
        assert tree.first_fit(n) == want


def test_pack_group_covers_everything_with_little_padding():
    rng = random.Random(3)
    for _ in range(60):
        lengths = [rng.choice([1, 2, rng.randint(1, 300), rng.randint(1, 9000)]) for _ in range(rng.randint(0, 200))]
        seen, pad = collections.defaultdict(list), 0
        for pieces in packing.pack_group(lengths):
            n = sum(p[2] for p in pieces)
            assert 0 < n <= 4096
            pad += 0 if n & (n - 1) == 0 else 4096 - n
            for d, start, k in pieces:
                seen[d].append((start, k))
        for d, n in enumerate(lengths):
            end = 0
            for start, k in sorted(seen[d]):
                assert start == end and k > 0
                end += k
            assert end == n
        assert pad <= 0.01 * sum(lengths)


def test_pack_query(odd, empty):
    got = packing.pack(odd, P.path("word_bpe_49k.json"), partitions=3).toPandas()
    lib = reference("word_bpe_49k.json")
    want = collections.Counter((r.doc_id, len(lib.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in odd.collect())
    total = collections.Counter()
    for r in got.itertuples():
        total[None if r.doc_id != r.doc_id else int(r.doc_id), int(r.doc_tokens)] += int(r.length)
    assert total == collections.Counter({k: k[1] * n for k, n in want.items()})
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset.to_numpy() == np.r_[0, np.cumsum(s.length)[:-1]]).all() and s.length.sum() <= 4096
    one = got[got.doc_id == 17].sort_values("start")
    ids = np.array([*lib.encode(TEXTS[17], add_special_tokens=False).ids, 2], "<u4")
    assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(one.start, one.length, strict=True)] == one.ids_crc32.tolist()
    assert packing.pack(empty, P.path("word_bpe_49k.json")).count() == 0


def test_packing_of_whole_table(spark, sf, documents):
    """Every id of every document in exactly one piece, each piece's checksum that of the library's ids, and twice the same sequences."""
    got = entries.op9_packing(spark, sf).toPandas()
    again = entries.op9_packing(spark, sf).toPandas()
    order = ["sequence_id", "offset"]
    assert got.sort_values(order).to_numpy().tolist() == again.sort_values(order).to_numpy().tolist()
    lib = reference("word_bpe_49k.json")
    for r in documents.collect():
        ids = np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        mine = got[got.doc_id == r.doc_id].sort_values("start")
        assert mine.doc_tokens.tolist() == [len(ids)] * len(mine)
        assert mine.start.tolist() == np.r_[0, np.cumsum(mine.length)[:-1]].tolist() and mine.length.sum() == len(ids)
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(mine.start, mine.length, strict=True)] == mine.ids_crc32.tolist()
    total = got.groupby("sequence_id").length.sum()
    assert all(n <= 4096 for n in total)
    padding = sum(4096 - n for n in total if n & (n - 1))
    assert padding <= 0.01 * total.sum()


# -- toxicity and quality ----------------------------------------------------------------------------------


def test_composition_equals_running_one_after_the_other():
    a = Transducer(({"x": ("y", 1, 1.0), "*": ("*", 0, 0.0)}, {"*": ("*", 0, 0.5)}))
    b = Transducer(({"y": ("z", 0, 2.0), "*": ("*", 0, 0.0)},))
    both, rng = a.compose(b, "xyo"), random.Random(2)
    for _ in range(50):
        word = [rng.choice("xyo") for _ in range(8)]
        first = a.run(word)
        second = b.run([s for s, _ in first])
        assert both.run(word) == [(s, w1 + w2) for (_, w1), (s, w2) in zip(first, second, strict=True)]


def test_grammar():
    s = toxicity.Scorer(toxicity.seed_model())
    plain, targeted = s.clause("what an idiot"), s.clause("you are an idiot")
    assert targeted["I"] > plain["I"] and "i" in s.clause("he is not an idiot") and "q" in s.clause("they called him idiot")
    assert s.score("a fine day") == s.score("") == s.score(None) < 0.5
    assert s.features("not here. idiot there") == s.features("here not. idiot there")


def test_grammar_against_plain_rules():
    """Every sequence of classes by an interpreter that looks at each match's surroundings."""
    s = toxicity.Scorer(toxicity.seed_model())
    words = {"I": ("idiot", 2.0), "H": ("kill", 1.0), "T": ("you", 0), "N": ("not", 0), "R": ("said", 0), "O": ("tree", 0)}
    rng = random.Random(8)
    for _ in range(500):
        classes = rng.choices("IHTNRO", k=rng.randint(1, 9))
        want = {}
        for i, c in enumerate(classes):
            if c in "IH":
                kind = c.lower() if "N" in classes[max(0, i - 3) : i] else "q" if "R" in classes[:i] else c
                extra = {"I": 0.25, "H": 0.75}.get(kind, 0) if "T" in classes else 0
                want[kind] = want.get(kind, 0) + words[c][1] * (toxicity.FACTOR[kind] + extra)
        assert s.clause(" ".join(words[c][0] for c in classes)) == pytest.approx(want)


def test_lexicons_are_chained():
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abc", k=rng.randint(1, 5)))
    first, second = ({word() + rng.choice(("", "$")): rng.random() for _ in range(12)} for _ in "ab")
    chain = lexicon(first, "I").chained(lexicon(second, "H"))
    for w in (word() for _ in range(500)):
        hit = [[v for e, v in x.items() if (w == e[:-1] if e.endswith("$") else w.startswith(e))] for x in (first, second)]
        want = ("I", max(hit[0])) if hit[0] else ("H", max(hit[1])) if hit[1] else ("$", 0.0)
        steps = chain.run(w + "$")
        assert (steps[-1][0], pytest.approx(sum(x for _, x in steps))) == want


def test_samples_do_not_hang_on_the_partitioning(documents, labels):
    """The models are the same however the rows lie, also where the characters' bound cuts the sample."""
    for module, chars in ((toxicity, 60_000), (quality, 60_000)):
        models = [module.fit(documents.repartition(n), labels, train_chars=chars) for n in (1, 5)]
        assert models[0] == models[1]


@pytest.mark.parametrize("name", ["op1_toxicity", "op7_quality"])
def test_scores_against_plain_python(spark, sf, documents, labels, name):
    """The whole table scored row by row without Spark."""
    module = toxicity if name.startswith("op1") else quality
    model = module.fit(documents, labels)
    got = {r.doc_id: r for r in entries.queries()[name](spark, sf).collect()}
    rows = documents.collect()
    assert len(got) == len(rows)
    for r in rows:
        want = model.compiled().score(r.text) if module is toxicity else model.scores([r.text], [r.lang], [r.source])[0]
        assert got[r.doc_id].score == pytest.approx(want) and got[r.doc_id].predicted == int(want >= 0.5) and got[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_classifiers_on_very_long_texts(spark):
    rows = [(1, "the idiot said. " * 200_000, "en", "s"), (2, "x" * 3_000_000, None, None), (3, "calm words " * 5, "en", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert toxicity.score(df, toxicity.seed_model()).count() == quality.score(df, quality.Model()).count() == 3
    assert {r.doc_id for r in toxicity.keep_clean(df, toxicity.seed_model()).collect()} == {2, 3}


def test_toxicity_on_held_out_labels(documents, labels):
    model = toxicity.fit(documents, labels)
    got = toxicity.score(documents, model).join(labels, "doc_id").collect()
    assert {r.held_out for r in got} == {True, False} and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert np.mean([r.predicted == r.toxic for r in got]) > 0.9


def test_learned_lexicon_finds_new_forms():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    texts, y = [], []
    for i in range(200):
        bad = i % 4 == 0
        words = [word() for _ in range(60)] + [f"zorgu{word()}" for _ in range(3 if bad else 0)]
        rng.shuffle(words)
        texts.append(" ".join(words))
        y.append(int(bad))
    model = toxicity.train(texts, y)
    s = model.compiled()
    assert s.score("abc zorgulike fgh zorgunew") > 0.5 > s.score("abc abd fgh")


def test_classifiers_on_odd_rows(spark, odd, empty, labels):
    none = labels.where("false")
    for module, keep in ((toxicity, toxicity.keep_clean), (quality, quality.keep_good)):
        model = module.fit(odd, none)
        out = module.score(odd, model).collect()
        assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
        same = {r.score for r in out if r.doc_id == 3}
        assert len(same) == 1
        assert keep(odd, model).columns == odd.columns and module.score(empty, model).count() == keep(empty, model).count() == 0
        module.fit(empty, labels)


def test_quality_on_held_out_labels(spark, labels):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = quality.fit(docs, known)
    got = [r for r in quality.score(docs, model).join(known, "doc_id").collect() if r.held_out]
    assert np.mean([r.predicted == r.quality for r in got]) > 0.9


def test_co_training_uses_the_pool():
    rng = np.random.default_rng(0)
    y = (rng.random(400) < 0.7).astype(float)
    view = lambda: y[:, None] * 2 + rng.normal(size=(400, 3))
    c, m = view(), view()
    model = quality.co_train(c[:60], m[:60], y[:60], c[60:], m[60:])
    assert ((model.combine(c[60:], m[60:]) >= 0.5) == y[60:]).mean() > 0.9


def test_pool_as_table_equals_pool_in_memory(spark):
    """Each round counts all rows of the pool, and hands over the same ones however they lie."""
    rng = np.random.default_rng(3)
    y = (rng.random(900) < 0.6).astype(float)
    c, m = (np.concatenate([y[:, None] * 3 + rng.normal(size=(900, 2)), rng.normal(size=(900, n - 2))], 1).astype(np.float32).astype(float) for n in (quality.CONTENT, quality.METADATA))
    rows = [(bytearray(v), i) for i, v in enumerate(quality.packed(list(zip(c[100:], m[100:], strict=True))))]
    table = spark.createDataFrame(rows, "v binary, h long")
    held = quality.Held(c[100:], m[100:])
    (wc, bc), (wm, bm) = (quality.fit_logistic(v[:100], y[:100], 3.0) for v in (c, m))
    step = quality.Step((np.array(wc), np.array(wm)), (bc, bm))
    for n in (1, 7):
        spread = quality.Spread(table.repartition(n), 1000)
        assert (spread.counts([], step) == held.counts([], step)).all() and held.counts([], step).sum() == 1600
    step.limit(held.counts([], step), 0.1, y.mean())
    key = lambda p: (p[2], p[3], p[0].tolist())
    want = sorted(map(key, held.picks([step], 0.5)))
    assert sorted(map(key, spread.picks([step], 0.5))) == want and len(want) > 50
    assert held.counts([step], step)[0].sum() == 800 - len(want)
    few = quality.Spread(table, 10).picks([step], 0.5)
    assert len(few) == sum(min(5, sum(w[:2] == g for w in want)) for g in {w[:2] for w in want})


def test_copies_in_the_pool_are_handed_over_once(spark):
    v = quality.packed([(np.full(quality.CONTENT, 9.0), np.full(quality.METADATA, 9.0))])[0]
    table = spark.createDataFrame([(bytearray(v), 1)] * 50, "v binary, h long")
    step = quality.Step((np.ones(quality.CONTENT), np.ones(quality.METADATA)), (0.0, 0.0))
    pool = quality.Spread(table, 100)
    step.limit(pool.counts([], step), 0.1, 0.5)
    assert pool.counts([], step).sum() == 100 and len(pool.picks([step], 0.5)) == 1


# -- secrets -----------------------------------------------------------------------------------------------

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24])


def all_spans(t, window):
    base = base_spans(t)
    weak = [(m.start(), k, m.end()) for k, p in ((3, secrets.KEY), (4, secrets.ACCOUNT), (5, secrets.ENDPOINT)) for m in re.finditer(p, t, re.A)]
    ends = [m.start() for m in re.finditer(secrets.SCOPE_END, t)]
    scope = lambda p: sum(e <= p for e in ends)
    needs = {3: (1, 4, 5), 4: (0, 2, 3), 5: (0, 2, 3)}
    free = [x for x in weak if not any(y[0] < x[2] and x[0] < y[2] for y in base)]
    return sorted(base + [x for x in free if any(y[1] in needs[x[1]] and scope(y[0]) == scope(x[0]) and max(y[0] - x[2], x[0] - y[2]) <= window for y in base + weak)])


def test_secrets_against_plain_python(spark):
    rng = random.Random(1)
    bits = ["token=", "token:", 'SECRET = "', "abc", "abcdef123", " ", "\n", "\n\n", "AKIA", "ABCDEFGH12345678", "Z9", "🙂é", "0123456789abcdef0123456789", "user=bob77 ", "https://h.example/x ", "aB3" * 13 + "x", "x y", "password='", "'", 'api_key="q1w2e3r4"', "==", "word " * 20]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(600)] + [None, "", "x " * 50_000 + "token=abcdef1 user=bob"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    listed = lambda s: ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in s)
    for window in (400, 30):
        for r in secrets.scan(df, window=window).collect():
            t = texts[r.doc_id] or ""
            b = base_spans(t)
            assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in b) for k in range(3))
            assert r.base_sha256 == hashlib.sha256(listed(b).encode()).hexdigest() and r.spans == listed(all_spans(t, window))


def test_weak_parts_need_company(spark):
    texts = ["see https://h.example/x and user=bob77", "user=bob77 password: hunter22", "user=bob77\n\npassword: hunter22"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [len(r.findings) for r in secrets.scan(df).orderBy("doc_id").collect()] == [0, 2, 1]


def test_redact(odd, empty):
    df = odd.where("doc_id = 2").withColumn("text", F.lit("é token=abcdef1 then 🙂 token: 0123456789abcdef0123456789 end"))
    assert secrets.redact(df).first().text == "é [SECRET] then 🙂 [SECRET] end"
    assert sorted(map(repr, secrets.redact(odd).collect())) == sorted(map(repr, odd.collect()))
    assert secrets.scan(empty).count() == 0 and secrets.scan(odd).count() == odd.count()


def test_redact_keeps_columns_of_any_name(spark):
    rows = [(1, "token=abcdef1", "own", "a", "b"), (2, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __text string, __ALL string, __a string")
    assert sorted(map(tuple, secrets.redact(df).collect())) == [(1, "[SECRET]", "own", "a", "b"), rows[1]]


def test_redact_against_plain_python(spark):
    rng = random.Random(6)
    bits = ["token=abcdef1", "x", " ", "é🙂", "0123456789abcdef01234567", "\n", "word " * 300, "'", "AKIA" + "A" * 16, "y" * 1024]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(150)]

    def plain(t):
        out, at = [], 0
        for a, _, b in all_spans(t, 400):
            if a >= at:
                out += [t[at:a], "[SECRET]"]
            at = max(at, b)
        return "".join(out) + t[at:]

    got = {r.doc_id: r.text for r in secrets.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_secrets_in_very_long_texts(spark):
    """A hundred thousand findings in one text of megabytes; the time grows little faster than the text."""
    df = spark.createDataFrame([(1, "token=abcdef1 user=bob77 and some more of the text " * 100_000)], "doc_id long, text string")
    began = time.time()
    r = secrets.scan(df).first()
    assert r.n_assign == 100_000 and len(r.findings) == 200_000
    assert secrets.redact(df).first().text == "[SECRET] [SECRET] and some more of the text " * 100_000
    assert time.time() - began < 60


# -- licences ----------------------------------------------------------------------------------------------


def test_licences(spark, odd, empty):
    model = licenses.train()
    texts = [t for f in licenses.FAMILIES for t in licenses.TEMPLATES[f]] + ["RELEASED!! UNDER!! THE!! MIT!! LICENSE!!", "x\nLicensed under CC BY-NC 3.0.\ny"]
    want = [f for f in licenses.FAMILIES for _ in licenses.TEMPLATES[f]] + ["mit", "cc-by-nc"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.families for r in licenses.scan(df, model).orderBy("doc_id").collect()]
    assert np.mean([a == b for a, b in zip(got, want, strict=True)]) >= 0.95
    clean = spark.createDataFrame(list(enumerate(licenses.OTHERWISE)), "doc_id long, text string")
    assert all(r.families == "" for r in licenses.scan(clean, model).collect())
    assert licenses.scan(odd, model).count() == odd.count() and licenses.scan(empty, model).count() == 0


def test_licence_scores_equal_numpy(spark):
    model = licenses.train()
    texts = ["Released under the MIT License.", "All rights reserved. Apache License"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    frame, at = licenses.paragraphs(df, model)
    for r in frame.collect():
        z = np.array(model.bias)
        for g in licenses.grams(licenses.tokens(texts[r.doc_id])):
            z = z + np.array(model.weights.get(g, [0.0] * len(z)))
        p = np.exp((z - z.max()) / model.temperature)
        p = p / p.sum()
        for found in r[at]:
            assert found.chance == pytest.approx(p.max(), abs=1e-5) and found.family == licenses.FAMILIES[int(p.argmax())]


def in_order(words, form):
    at = n = 0
    for w in words:
        if w in form[at : at + licenses.LOOK]:
            at += form[at : at + licenses.LOOK].index(w) + 1
            n += 1
    return n


def plain_licences(text, model, overlap=0.6):
    """(paragraph, family, confirmed) of one text."""
    out = []
    if not re.search(licenses.CUE, text or ""):
        return out
    for i, line in enumerate(re.sub(licenses.WRAP, " ", text).split("\n")):
        if not re.search(licenses.CUE, line):
            continue
        w = licenses.tokens(line)
        z = np.array(model.bias)
        for g in licenses.grams(w):
            z = z + np.array(model.weights.get(g, [0.0] * len(z)))
        p = np.exp((z - z.max()) / model.temperature)
        p = p / p.sum()
        k = int(z.argmax())
        if k < len(licenses.FAMILIES) and p[k] >= model.least:
            f = licenses.FAMILIES[k]
            sure = any(in_order(w, licenses.tokens(t)) >= overlap * min(len(w), len(licenses.tokens(t))) and (not own or set(w) & set(own)) for t, own in zip(licenses.TEMPLATES[f], licenses.own_words()[k], strict=True))
            sure = sure and not any(re.search(rf"\b{o}\b", " ".join(w)) for o in licenses.OTHER.get(f, ()))
            out.append((i, f, sure))
    return out


def test_licences_of_whole_table_against_plain_python(spark, sf, documents):
    model = licenses.train()
    got = {r.doc_id: r for r in entries.op4_licenses(spark, sf).collect()}
    rows = documents.collect()
    assert len(got) == len(rows) and any(r.families for r in got.values())
    for r in rows:
        want = plain_licences(r.text, model)
        assert [(x["paragraph"], x["family"], x["confirmed"]) for x in json.loads(got[r.doc_id].findings)] == want
        assert got[r.doc_id].n_findings == len(want) and got[r.doc_id].families == ",".join(sorted({f for _, f, sure in want if sure}))


def test_licences_outside_the_list_are_unknown(spark):
    """Notices that neither training nor the bar has seen."""
    texts = ["Licensed under the CeCILL License, version 2.1.", "Common Public License Version 1.0", "Licensed under the Q Public License.", "Released under the Sleepycat License.", "Lizenziert unter der Deutschen Freien Software Lizenz.", "Sous licence Art Libre 1.3.", "Licenciado bajo la licencia CeCILL-B.", "This data is made available under the Open Data Commons Attribution License", "Covered by the NASA Open Source Agreement 1.3", "Licensed under the Open Public License v1.0."]
    assert not {*texts} & {*licenses.LEFT_OUT, *licenses.OUTSIDE}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.families for r in licenses.scan(df).collect()} == {""}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Licensed under CC BY-ND 4.0.", ""), ("Licensed under CC BY-NC-ND 4.0.", ""), ("Licensed under CC BY-NC-SA 4.0.", ""), ("Available under the terms of the MIT-0 license", ""), ("Licensed under the Apache License, Version 1.1.", ""), ("Some rights reserved.", ""), ("Licensed under the Mozilla Public License 1.1", ""),
        ("Licensed under CC BY 3.0.", "cc-by"), ("Available under the terms of the MIT license", "mit"), ("Sous licence MIT.", "mit"), ("Der Code ist lizenziert unter der GNU GPL.", "gpl"), ("Dieses Programm steht unter der GNU General Public License, Version 2.", "gpl"), ("Le code est sous licence Apache, version 2.0.", "apache"),
        ("El código está licenciado bajo la licencia MIT.", "mit"), ("Alle Rechte vorbehalten.", "reserved"), ("Tous droits réservés.", "reserved"), ("Todos los derechos reservados.", "reserved"), ("Er ging mit seinen Rechten sorglos um.", ""), ("license MIT the under words other many are there but Released", ""),
    ],
)
def test_licences_by_their_words(spark, text, want):
    model = licenses.train()
    assert ",".join(sorted({f for _, f, sure in plain_licences(text, model) if sure})) == want
    assert licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first().families == want


def test_wrapped_and_very_long_licences(spark):
    grant = "Permission is hereby granted, free of charge, to any person obtaining\na copy of this software and associated\ndocumentation files"
    long = "plain words here. " * 200_000 + "\nReleased under the MIT License.\n" + "x" * 1_000_000
    df = spark.createDataFrame([(1, grant, "a", "b"), (2, long, None, None)], "doc_id long, text string, __found string, __WORDS string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert got[1].families == got[2].families == "mit" and got[1].n_findings == 1
    frame, at = licenses.paragraphs(df, licenses.train())
    assert frame.columns == [*df.columns, at] and {(r["__found"], r["__WORDS"]) for r in frame.collect()} == {("a", "b"), (None, None)}


# -- near copies -------------------------------------------------------------------------------------------


def brute(rows, words=5, threshold=0.8):
    """Counter of (key, class, links)."""
    found = [re.findall(r"\w+", (t or "").lower()) for _, t in rows]
    sets = [frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset() for w in found]
    n, up, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (rows[i][1] or "") == (rows[j][1] or "") or both and both >= threshold * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[find(i)] = min(rows[i][0], least.get(find(i), rows[i][0]))
    return collections.Counter((rows[i][0], least.get(find(i)), links[i]) for i in range(n)), len({find(i) for i in range(n)})


def near_rows(seed=2, copies=90):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    base = [[word() for _ in range(rng.randint(1, 150))] for _ in range(60)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for i in range(copies):
        w = list(base[50 + i % 3])
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = word()
        rows.append((100 + i, " ".join(w)))
    return rows + [(1000, None), (1001, ""), (1002, "one two"), (1003, "One, two"), (None, "one two"), (1003, "One, two"), (1004, "..."), (None, None)]


@pytest.mark.parametrize("block", [256, 20])
def test_near_copies_against_brute_force(spark, block):
    rows = near_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1))
    want, classes = brute(rows)
    got = near.join(df, block=block).toPandas()
    f = lambda x: None if x != x else int(x)
    assert collections.Counter((f(a), f(b), int(c)) for a, b, c in zip(got.doc_id, got.class_id, got.links, strict=True)) == want
    kept = near.keep_one(df, block=block)
    assert kept.columns == df.columns and kept.count() == classes


def test_forest_knows_the_depth_for_a_similarity():
    f = near.Forest(24, 8, 0.8, 0.999)
    assert f.shortest == 6 and f.found(0.8, 6) >= 0.999 > f.found(0.8, 7) and f.needed(0.95) == 8
    assert near.Forest(200, 8).shortest == 8


@pytest.mark.parametrize("changes, depth", [((1, 2), 8), ((3, 4), 6)])
def test_prefixes_are_shortened_as_the_data_ask(spark, changes, depth):
    """Copies that are all very close are found at the full depth; those near the threshold need shorter prefixes."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    rows = []
    for i in range(40):
        w = [word() for _ in range(200)]
        rows.append((2 * i, " ".join(w)))
        for k in range(rng.choice(changes)):
            w[20 + 40 * k] = word()
        rows.append((2 * i + 1, " ".join(w)))
    docs, forest = spark.createDataFrame(rows, "doc_id long, text string"), near.Forest()
    sketch = near.sketched(docs, "doc_id", "text", 5, forest)
    nodes = sketch.groupBy("node").agg(F.count("*").alias("n"), F.min("k").alias("k"), F.max("chars").alias("chars"), F.first("labels").alias("labels"))
    found, at = near.links_found(docs, nodes, "doc_id", "text", 5, 0.8, forest, 1024, 2_000_000)
    assert at == depth and found.where("links = 1").count() == 80


def test_walk_ties_what_shares_a_prefix(spark):
    """Over any number of partitions the edges connect the same texts, by depth, as all pairs do."""
    rng, forest = random.Random(5), near.Forest(trees=3)
    labels = {f"{i:03}".encode(): [int.from_bytes(bytes(rng.choice((0, 255)) if d > 2 else rng.choice((1, 200)) for d in range(8)), "big", signed=True) for _ in range(3)] for i in range(150)}
    nodes = spark.createDataFrame([(bytearray(k), v) for k, v in labels.items()], "node binary, labels array<long>")
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            edges = [(bytes(r.a), bytes(r.b), r.level) for r in near.tries(nodes, forest).collect()]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        names = sorted(labels)
        for depth in (6, 7, 8):
            prefix = {n: [(v >> (64 - 8 * depth)) for v in labels[n]] for n in names}
            want = near.roots(len(names), np.array([(i, j) for i in range(150) for j in range(i) if any(a == b for a, b in zip(prefix[names[i]], prefix[names[j]], strict=True))]))
            assert near.roots(len(names), np.array([(names.index(a), names.index(b)) for a, b, level in edges if level >= depth])) == want


def test_copies_with_odd_columns(spark):
    rows = [(1, "a b c d e f", "x", "y"), (2, "a b c d e f", "x", "y"), (3, "other words here", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __node string, __NAME string")
    kept = near.keep_one(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect()), key=str) == [rows[0], rows[2]]


def test_very_long_copies(spark):
    rng = random.Random(3)
    w = [f"w{rng.randrange(5000)}" for _ in range(400_000)]
    rows = [(1, " ".join(w)), (2, " ".join(["new", *w])), (3, " ".join(w[::-1])), (4, "short")]
    got = near.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1), (2, 1, 1), (3, 3, 0), (4, 4, 0)]


def test_overlaps_in_slices():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 5000, 3000)).astype(np.uint64) for _ in range(12)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert near.overlaps(sets).tolist() == want and near.overlaps(sets[:4], sets[4:]).tolist() == [r[4:] for r in want[:4]]


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randint(0, 30), 100 + rng.randint(0, 30)) for _ in range(25)]
    up = {}
    for a, b in edges:
        if a != b:
            up.setdefault(a, a)
            up.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            if a != b:
                up[a] = up[b] = min(up[a], up[b])
    got = {r.v: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == up
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_of_nothing(empty):
    assert near.join(empty).count() == 0 and near.keep_one(empty).count() == 0


# -- vectors -----------------------------------------------------------------------------------------------


def vector_rows(n=400, d=8, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[50:150] = x[50] + rng.normal(size=(100, d)) * 0.01
    x[200:230] = x[200]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    return rows, rows + [(900, None), (901, []), (902, [float("nan")] * d), (903, [float("inf")] * d), (904, [None] + [0.0] * (d - 1)), (None, [1.0] * d), (905, [0.0] * d), (40, rows[40][1])]


def ranked_by(x, k, i, top, score):
    s = score(x, x[i])
    return [(int(k[j]), s[j]) for j in np.lexsort((k, -s)) if k[j] != k[i]][:top]


def test_ball_tree_against_brute_force(spark):
    _, rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("k", F.lit(1)).withColumn("score", F.lit("x"))
    good = [(k, v) for k, v in rows if k is not None and v and len(v) == 8 and all(c is not None and np.isfinite(c) for c in v)]
    x, k = np.floor(np.array([v for _, v in good]) * 1024), np.array([i for i, _ in good])
    want = set()
    for i in {int(q): j for j, q in enumerate(k) if q % 20 == 0}.values():
        want |= {(int(k[i]), r + 1, a, int(s)) for r, (a, s) in enumerate(ranked_by(x, k, i, 10, lambda x, q: x @ q))}
    for shard, leaf in ((16384, 256), (64, 4)):
        got = balltree.top_k(df, F.col("k") % 20 == 0, shard_rows=shard, leaf=leaf).collect()
        assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want and len(got) == len(want)


def test_ball_tree_prunes_and_fits_64_bits():
    rng = np.random.default_rng(0)
    x = np.floor(np.r_[rng.normal(size=(500, 4)) + 50, rng.normal(size=(500, 4)) - 50] * 1024)
    tree = balltree.BallTree.build(x, np.arange(1000), 16)
    assert sum(tree.hi[i] - tree.lo[i] for i in tree.leaves()) == 1000
    found = balltree.search(tree, x[:3], np.arange(3), 5, np.full(3, -np.inf))
    assert [found.key[i].tolist() for i in range(3)] == [[j for j in np.lexsort((np.arange(1000), -(x @ x[i]))) if j != i][:5] for i in range(3)]
    assert balltree.products(np.array([[2.0**30, 1.0]]), np.array([[2.0**30, 1.0]])).tolist() == [[2**60 + 1]]
    assert balltree.products(np.array([[2.0**40, 1.0]]), np.array([[2.0**40, 0.0], [-(2.0**40), 0.0], [0.0, 5.0]])).tolist() == [[2**63 - 1, -(2**63), 5]]
    large = balltree.BallTree.build(np.array([[2.0**30, k] for k in range(20)]), np.arange(20), 4)
    found = balltree.search(large, np.array([[2.0**30, 1.0]]), np.array([-1]), 3, np.array([-np.inf]))
    assert [int(x) for x in found.score[0]] == [2**60 + 19, 2**60 + 18, 2**60 + 17]


def test_very_large_components(spark):
    df = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 0.0]), (2, [-1e30, 0.0]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    got = {(r["rank"], r.vec_id, r.score) for r in balltree.top_k(df, F.col("k") == 0).collect()}
    assert got == {(1, 1, 2**63 - 1), (2, 3, 1024 * 2048), (3, 2, -(2**63))}


def test_vectors_of_other_lengths_are_found_too(spark):
    _, rows = vector_rows(300, 8)
    odd = [(2000 + i, [float(i), 1.0, -float(i % 3)]) for i in range(60)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = additive.nearest(df, F.col("k") % 20 == 0, shard_rows=100).toPandas()
    x, k = np.array([v for _, v in odd]), np.array([i for i, _ in odd])
    for i in range(0, 60, 20):
        mine = got[got.query_id == 2000 + i].sort_values("rank")
        assert list(zip(mine.vec_id, mine.score, strict=True)) == ranked_by(x, k, i, 20, lambda x, q: np.einsum("ij,j->i", x, q))


def test_few_rows_are_scored_exactly():
    """Also without any structure in 64 dimensions, the hardest case, few rows are reranked."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    model = additive.AdditiveQuantiser.fit(x[:2000], 24, 64)
    shard = additive.Shard.build(pd.DataFrame({"k": np.arange(4000), "v": list(x)}), model)
    found, n = shard.search(model, np.arange(0, 4000, 200), x[::200], np.full(20, -np.inf), 20, 2.5)
    best = {(i, int(j)) for i in range(0, 4000, 200) for j in np.argsort(-np.where(np.arange(4000) == i, -9, x @ x[i]))[:20]}
    assert len({(q, k) for q, k, _ in found} & best) >= 0.97 * len(best) and n <= 0.12 * 20 * 4000


def test_additive_quantiser_recall(spark):
    _, rows = vector_rows(1200, 16)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("k", F.lit(1))
    good = [(k, v) for k, v in rows if k is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v) and len(v) == 16]
    x, k = np.array([v for _, v in good]), np.array([i for i, _ in good])
    got = additive.nearest(df, F.col("k") % 20 == 0, shard_rows=500).toPandas()
    hit = n = 0
    for i in {int(q): j for j, q in enumerate(k) if q % 20 == 0}.values():
        want = ranked_by(x, k, i, 20, lambda x, q: np.einsum("ij,j->i", x, q))
        mine = got[got.query_id == k[i]].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21)) and (np.diff(mine.score) <= 0).all()
        hit += len({a for a, _ in want} & set(mine.vec_id))
        n += 20
    assert hit / n >= 0.95
    few = df.where("vec_id < 5")
    assert additive.nearest(few, F.col("k") == 0).count() == 4
    assert additive.nearest(df.where("false"), F.col("k") == 0).count() == balltree.top_k(df.where("false"), F.col("k") == 0).count() == 0


def test_additive_quantiser_misses_none_of_rows_in_few_dimensions(spark):
    """Rows that fill 60 of 400 dimensions: what the codes leave out is far larger along them than in a direction drawn at random."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 60)) @ rng.normal(size=(60, 400))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = additive.nearest(df, F.col("k") % 100 == 0, shard_rows=800, sample_rows=700, books=6).collect()
    mine = {i: [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == i] for i in range(0, 1500, 100)}
    assert mine == {i: ranked_by(x, np.arange(1500), i, 20, lambda x, q: np.einsum("ij,j->i", x, q)) for i in mine}


def test_no_row_is_ruled_out_that_is_nearest():
    """Whatever the scale of the rows, above what single precision holds too, and with copies at the edge."""
    rng = np.random.default_rng(7)
    for x in (rng.normal(size=(900, 32)) * 1e30, rng.integers(-1, 2, size=(900, 32)) + 0.0, rng.normal(size=(900, 32)) * np.exp(2 * rng.normal(size=(900, 1))) * 1e-9, np.repeat(rng.normal(size=(30, 32)), 30, axis=0)):
        keys = rng.permutation(900)
        model = additive.AdditiveQuantiser.fit(x[:300], 6, 16)
        shard = additive.Shard.build(pd.DataFrame({"k": keys, "v": list(x)}), model)
        found, n = shard.search(model, keys[:30], x[:30], np.full(30, -np.inf), 10, np.inf)
        for i in range(30):
            want = ranked_by(x, keys, i, 10, lambda x, q: np.einsum("ij,j->i", x, q))
            assert [(k, s) for a, k, s in found if a == keys[i]] == want
        assert n <= 30 * 900


def test_beam_search_is_no_worse_than_greedy():
    x = np.random.default_rng(1).normal(size=(600, 12))
    model = additive.AdditiveQuantiser.fit(x, 4, 16)
    err = [((x - model.decode(model.encode(x, b))) ** 2).sum() for b in (1, 8)]
    assert err[1] <= err[0]
    q = np.random.default_rng(2).normal(size=(3, 12))
    codes = model.encode(x)
    assert np.allclose(sum(model.tables(q)[b][codes[:, b]] for b in range(4)), model.decode(codes) @ q.T)


# -- fixity ------------------------------------------------------------------------------------------------


def pages(spark, change=lambda i, h: h, rows=range(300)):
    return spark.createDataFrame([(i, f"http://x/{i}", change(i, f"<p>{i}</p>" * (i % 5))) for i in rows] + [(None, None, None)], "page_id long, url string, html string").withColumn("at", F.lit(1))


def test_merkle_finds_each_kind_of_damage(spark):
    a = merkle.manifest(pages(spark), per_archive=64)
    same = merkle.audit(a, merkle.manifest(pages(spark), per_archive=64))
    assert same.count() == 0
    changed = merkle.manifest(pages(spark, lambda i, h: "X" + h[1:] if i in (7, 201) and h else h), per_archive=64)
    assert {(r.state, r.archive * 64 + r.seq) for r in merkle.audit(a, changed).collect()} == {("corrupt", 7), ("corrupt", 201)}
    cut = merkle.manifest(pages(spark, lambda i, h: h[:-1] if i == 66 else h), per_archive=64)
    got = merkle.audit(a, cut).collect()
    assert {r.state for r in got} == {"corrupt", "shifted"} and {r.archive for r in got} == {1}
    short = merkle.manifest(pages(spark, rows=range(299)), per_archive=64)
    assert [r.state for r in merkle.audit(a, short).collect()] == ["missing"] and [r.state for r in merkle.audit(short, a).collect()] == ["extra"]
    assert merkle.report(a, changed).where("state = 'ok'").count() == 299


def test_records_missing_or_extra_in_the_middle(spark):
    """What follows has moved; nothing else seems damaged."""
    a = merkle.manifest(pages(spark, rows=range(200)), per_archive=64)
    gap = merkle.manifest(pages(spark, rows=[i for i in range(200) if i not in (70, 100)]), per_archive=64)
    for x, y, lone in ((a, gap, "missing"), (gap, a, "extra")):
        got = collections.Counter((r.state, r.archive) for r in merkle.audit(x, y).collect())
        assert got == {(lone, 1): 2, ("shifted", 1): 127 - 70 - 1}
    both = merkle.manifest(pages(spark, lambda i, h: "Y" + h[1:] if i == 90 else h, rows=[i for i in range(200) if i != 70]), per_archive=64)
    assert {(r.state, r.page_id) for r in merkle.audit(a, both).collect() if r.state != "shifted"} == {("missing", 70), ("corrupt", 90)}


def test_null_ids_in_any_partitioning(spark):
    """Very many rows without an id, some of them equal: the same archive however they are dealt out, and a count of copies off by one is one record."""
    rows = [(None, "u", f"<p>{i % 1500}</p>") for i in range(3000)] + [(None, "u", "same")] * 2000
    make = lambda rows, n: spark.createDataFrame(rows, "page_id long, url string, html string").repartition(n)
    a, b = (merkle.manifest(make(rows, n), per_archive=64) for n in (3, 5))
    assert a.select("part").distinct().count() > 8 and merkle.audit(a, b).count() == 0
    assert merkle.audit(a, merkle.read_archives(merkle.archives(make(rows, 4), per_archive=64))).count() == 0
    fewer = merkle.manifest(make(rows[:-1], 2), per_archive=64)
    got = collections.Counter(r.state for r in merkle.audit(a, fewer).collect())
    assert got["missing"] == 1 and got["corrupt"] == got["extra"] == 0
    assert merkle.report(a, fewer).count() == 5000


def test_archives_read_back(spark):
    wide = pages(spark, lambda i, h: h + "\r\n\r\né", rows=range(150))
    a, blobs = merkle.manifest(wide, per_archive=64), merkle.archives(wide, per_archive=64)
    assert merkle.audit(a, merkle.read_archives(blobs)).count() == 0
    # one byte of one archive flipped at rest
    at = a.where("page_id = 70").first()
    broken = blobs.withColumn("bytes", F.when(F.col("archive") == 1, F.expr(f"concat(substring(bytes, 1, {at.offset + at.length - 6}), X'00', substring(bytes, {at.offset + at.length - 4}))")).otherwise(F.col("bytes")))
    assert [(r.state, r.archive, r.seq) for r in merkle.audit(a, merkle.read_archives(broken)).collect()] == [("corrupt", 1, at.seq)]
    torn = blobs.withColumn("bytes", F.when(F.col("archive") == 1, F.expr("substring(bytes, 1, 100)")).otherwise(F.col("bytes")))
    assert {r.archive for r in merkle.audit(a, merkle.read_archives(torn)).collect()} == {1}


def test_merkle_roots_follow_the_bytes(spark):
    rows = [r for r in merkle.manifest(pages(spark), per_archive=64).collect()]
    assert all(r.sha256 == hashlib.sha256((f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: http://x/{r.page_id}\r\nWARC-Record-ID: <urn:page:{r.page_id}>\r\nContent-Type: text/html\r\nContent-Length: {len(f'<p>{r.page_id}</p>' * (r.page_id % 5))}\r\n\r\n" + f"<p>{r.page_id}</p>" * (r.page_id % 5) + "\r\n\r\n").encode()).hexdigest() for r in rows if r.page_id >= 0)
    hot = pages(spark, rows=[3] * 900)
    parts = merkle.manifest(hot, per_archive=64)
    assert merkle.records(parts).count() == 901 and parts.where("page_id = 3").select("part").distinct().count() > 1
    assert merkle.manifest(pages(spark).where("false")).count() == 0


def test_large_archives_are_split_by_bytes(spark):
    """With a small bound an archive comes in parts, and the audit finds the same states."""
    damaged = pages(spark, lambda i, h: "X" + h[1:] if i in (7, 201) and h else h)
    small = {"per_archive": 64, "archive_bytes": 3000}
    a = merkle.manifest(pages(spark), **small)
    assert a.where("part > 0").count() > 0 and merkle.archives(pages(spark), **small).agg(F.max(F.length("bytes"))).first()[0] < 3 * 3000
    got, want = ({(r.page_id, r.sha256, r.state) for r in merkle.report(m, merkle.read_archives(merkle.archives(damaged, **how))).collect() if r.state != "shifted"} for m, how in ((a, small), (merkle.manifest(pages(spark), per_archive=64), {"per_archive": 64})))
    assert {x for x in got if x[2] != "ok"} == {x for x in want if x[2] != "ok"} and len(got) >= 2


# -- the whole ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_query_against_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = entries.queries()[name](spark, sf)
    found = con.execute(entries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    cols = sorted(got.columns)
    assert sorted(names) == cols
    want = sorted(tuple(r[names.index(c)] for c in cols) for r in found.fetchall())
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == want


@pytest.mark.parametrize(("text", "other"), [("tu es idiot", "espèce d'idiot"), ("il parle, idiot", "l\u2019idiot parle"), ("you are an idiot", "you\u2019re an idiot")])
def test_elided_articles_hide_no_insult(text, other):
    scorer = toxicity.seed_model().compiled()
    assert scorer.features(text)[0] > 0 and scorer.features(other)[0] > 0


def test_both_apostrophes_are_alike():
    scorer = toxicity.seed_model().compiled()
    plain = scorer.features("he isn't an idiot")
    assert plain == scorer.features("he isn\u2019t an idiot") and plain[3] > 0  # negated
    assert toxicity.WORD.findall("d'idiot isn't don't l'ami n't can'tx") == ["d", "idiot", "isn't", "don't", "l", "ami", "n", "t", "can", "tx"]


def test_packing_of_a_shuffled_input(spark, documents):
    """Rows that come in another order within the same partitions, some of them equal, are dealt alike."""
    rows = documents.select("doc_id", "text").limit(60).collect()
    rows += rows[:20] * 3
    made = []
    for turn in (1, -1):
        parts = spark.sparkContext.parallelize([rows[i::3][::turn] for i in range(3)], 3).flatMap(lambda x: x)
        made.append(sorted(tuple(r) for r in packing.pack(spark.createDataFrame(parts, "doc_id long, text string"), P.path("word_bpe_49k.json"), partitions=4).collect()))
    assert made[0] == made[1] and len({r[5] >> 40 for r in made[0]}) > 1


def test_what_a_view_hands_over_is_limited_in_each_task(spark):
    from lamina.llm.links import cut

    rng = np.random.default_rng(1)
    c, m = rng.normal(size=(400, quality.CONTENT)), rng.normal(size=(400, quality.METADATA))
    pool = cut(spark.createDataFrame([(bytearray(v),) for v in quality.packed(list(zip(c, m, strict=True)))], "v binary").select("v", F.xxhash64("v").alias("h")))
    step = quality.Step((rng.normal(size=quality.CONTENT), rng.normal(size=quality.METADATA)), (0.0, 0.0))
    step.low, step.high = [quality.REACH * quality.BINS - 100] * 2, [quality.REACH * quality.BINS + 100] * 2
    got = quality.Spread(pool, 20).picks([step], 0.75)
    every = quality.Held(*quality.unpacked([r.v for r in pool.collect()])).picks([step], 0.75)
    there = collections.Counter((by, label) for _, _, by, label in every)
    assert collections.Counter((by, label) for _, _, by, label in got) == {k: min(n, 15 if k[1] else 5) for k, n in there.items()} and len(there) == 4
    assert {(x.tobytes(), by, label) for x, _, by, label in got} <= {(x.tobytes(), by, label) for x, _, by, label in every}


def test_every_operator_is_registered():
    names = list(entries.queries())
    assert [n for n in range(1, 14) if not any(x.startswith(f"op{n}_") for x in names)] == []


def test_pipeline_against_plain_python(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    texts = [" ".join(word() for _ in range(40)) + ".\n" + " ".join(word() for _ in range(30)) + "." for _ in range(60)]
    texts[5] = texts[4].replace("a", "a", 1) + " extra"
    texts[6] = texts[4]
    texts[7] += " token = \"0123456789abcdef0123456789\""
    texts[8] = "idiot moron trash scum. " * 5 + texts[8]
    rows = [(i, t, "en", "s0", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()

    scorer, model = toxicity.seed_model().compiled(), quality.Model()
    left = [r for r in rows if scorer.score(r[1]) < 0.5]
    left = [r for r, s in zip(left, model.scores([r[1] for r in left], ["en"] * len(left), ["s0"] * len(left)), strict=True) if s >= corpus_pipeline.LEAST_QUALITY]
    heads = {k for _, k, _ in brute([(r[0], r[1]) for r in left])[0]}
    lib = reference("word_bpe_49k.json")
    want = {}
    for k, t, *_ in left:
        if k in heads:
            at, out = 0, ""
            for a, _, b in all_spans(t, 400):
                if b > at:
                    out += t[at:a] + "[SECRET]"
                    at = b
            want[k] = len(lib.encode(out + t[at:], add_special_tokens=False).ids) + 1
    assert {int(k): int(n) for k, n in got.groupby("doc_id").length.sum().items()} == want
    assert 8 not in want and 5 not in want and 6 not in want and 4 in want


def test_recall_of_links_near_the_threshold(spark):
    """Pairs of similarities from 0.80 to 0.95, half of them under 0.85, none above, so that the forest isn't told by others how far to shorten: links found of those there are."""
    rng = random.Random(12)
    rows, want = [], {}
    for i in range(500):
        words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(60)]
        other = list(words)
        for at in rng.sample(range(60), 1 if i % 2 else rng.choice((1, 1, 2))):
            other[at if i % 2 == 0 else rng.choice((0, 1, 2, 57, 58, 59))] = "".join(rng.choices("qrstuvwxyz", k=6))
        a, b = ({tuple(w[k : k + 5]) for k in range(56)} for w in (words, other))
        want[i] = len(a & b) / len(a | b)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    linked = {i for i, s in want.items() if s >= 0.8}
    assert 200 < len(linked) and sum(want[i] < 0.85 for i in linked) > 0.2 * len(linked)
    got = {r.doc_id // 2 for r in near.join(spark.createDataFrame(rows, "doc_id long, text string")).where("links > 0").collect()}
    assert got <= linked and len(got) >= 0.995 * len(linked), (len(got), len(linked))


def test_pipeline_with_trained_models_against_plain_python(spark, sf):
    """The whole run on a labelled table against its stages one by one in plain Python, with models fitted on what each stage is given."""
    import corpus_pipeline

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = [tuple(r) for r in docs.collect()]
    scorer = toxicity.fit(docs, labels).compiled()
    assert scorer.model != toxicity.seed_model()
    left = [r for r in rows if scorer.score(r[1]) < 0.5]
    model = quality.fit(spark.createDataFrame(left, docs.schema), labels)
    assert model.content and len(left) < len(rows)
    left = [r for r, s in zip(left, model.scores(*[[r[i] for r in left] for i in (1, 2, 3)]), strict=True) if s >= corpus_pipeline.LEAST_QUALITY]
    heads = {k for _, k, _ in brute([(r[0], r[1]) for r in left])[0]}
    lib, want = reference("word_bpe_49k.json"), {}
    for k, t, *_ in left:
        if k in heads:
            at, out = 0, ""
            for a, _, b in all_spans(t, 400):
                if b > at:
                    out += t[at:a] + "[SECRET]"
                    at = b
            want[k] = len(lib.encode(out + t[at:], add_special_tokens=False).ids) + 1
    got = corpus_pipeline.run(spark, sf).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == want and 0 < len(want) < len(left)


def test_stages_keep_the_columns(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_copies", "secrets", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()


def test_samples_take_one_row_of_a_hot_key(spark):
    docs = spark.createDataFrame([(1, f"text {i}", "en", "s") for i in range(500)] + [(k, f"t {k}", "en", "s") for k in range(2, 40)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(1, 1, 1)] * 20 + [(k, k % 2, k % 2) for k in range(2, 40)], "doc_id long, quality int, toxic int")
    got = toxicity.labelled_sample(docs, labels, "toxic", "doc_id", 1000, t=F.col("text")).collect()
    assert len(got) == sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(1, 40)) and sum(r.t.startswith("text") for r in got) == (zlib.crc32(b"1") % 5 != 0)
    assert len(toxicity.labelled_sample(docs, labels, "toxic", "doc_id", 7, t=F.col("text")).collect()) <= 7
    quality.fit(docs, labels)
