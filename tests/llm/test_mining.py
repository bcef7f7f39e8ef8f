"""Phrases, annulus clusters and language against brute force, and on null, empty, repeated, tied and oddly named rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import annulus, langid, phrases
from lamina.llm.annulus import Rings


# -- phrases -----------------------------------------------------------------------------------------------


def mined(rows, least=10, longest=3, share=50, top=2000):
    """The contract in plain Python: {(lang, rank): (phrase, a, l, r, n, score)}."""
    f = collections.defaultdict(collections.Counter)
    for lang, text in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = {}
    for lang, count in f.items():
        n = sum(v for k, v in count.items() if len(k) == 1)
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= share * a for q, b in found.items()):
                continue
            score, _, l, r = min((1000000 * a * a // (count[p[:k]] * count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1):
            out[lang, i] = (p.decode(), -a, l, r, n, -s)
    return out


def as_dict(df):
    return {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(5)
    words = ["the", "The", "a", "Ä", "é", "new york", "city", "\x1c", "x y", "of", "hall", "日本"]
    ends = [" ", " ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "!?", "\x0b"]
    texts = ["".join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randrange(0, 60))) for _ in range(120)]
    rows = [(i % 7, t, rng.choice(["en", "de", None])) for i, t in enumerate(texts)]
    return rows + [(1, None, "en"), (None, "", None), (2, ". ,, !", "fr"), (3, "alone", "fr")] + rows[:5] * 3


@pytest.mark.parametrize(("longest", "shard_words"), [(3, 2_000_000), (3, 300), (2, 300), (5, 1000)])
def test_phrases_against_plain_python(spark, talk, longest, shard_words):
    docs = spark.createDataFrame(talk, "doc_id long, text string, lang string").withColumn("phrase", F.lit("p")).withColumn("n", F.lit(1)).withColumn("shard", F.lit(2)).repartition(5)
    want = mined([(g, t) for _, t, g in talk], longest=longest)
    assert want and as_dict(phrases.mine(docs, longest=longest, shard_words=shard_words)) == want


def test_few_phrases_are_kept_of_many_and_empty_tables_give_none(spark, talk):
    docs = spark.createDataFrame(talk, "doc_id long, text string, lang string")
    assert as_dict(phrases.mine(docs, least=2, top=3)) == mined([(g, t) for _, t, g in talk], least=2, top=3)
    assert phrases.mine(docs.where("false")).collect() == [] and phrases.mine(docs.where("text is null")).collect() == []


def test_scores_are_exact_beyond_64_bits(spark):
    a, l, r = 123456789012345, 987654321098765, 123456789012347
    known = spark.createDataFrame([("en", "x y", 2, a), ("en", "x", 1, l), ("en", "y", 1, r)], "lang string, phrase string, k int, n long")
    assert phrases.scored(known, 10, 3).collect()[0].score == 1000000 * a * a // (l * r)


def test_long_texts_are_read_in_portions():
    rng = random.Random(1)
    text = " ".join(rng.choice(["a", "bb", "ccc.", "d, e"]) for _ in range(5000)).encode()
    whole = [w for part, _ in phrases.parted(text) for w in part]
    assert [w for part, _ in phrases.parted(text, 100) for w in part] == whole
    bare = b" ".join([b"word"] * 5000)  # no piece ends: parted at blanks, which ends no shard
    parts = list(phrases.parted(bare, 100))
    assert sum(len(p) for p, _ in parts) == 5000 and not any(w for _, w in parts[:-1])


def test_bitmaps_count_what_a_scan_counts():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 6, 4000).astype(np.int32)
    s = phrases.Shard.read(phrases.Shard.of([bytes([97 + i]) for i in range(6)], [""] * 6, ids).stored())
    got = collections.Counter()
    for table, _, n in s.phrases(4):
        for row, c in zip(table.tolist(), n.tolist(), strict=True):
            got[tuple(row)] += c
    want = collections.Counter(tuple(ids[i : i + k].tolist()) for k in (2, 3, 4) for i in range(len(ids) - k + 1) if ids[i : i + k].all())
    assert got == want


# -- clusters ----------------------------------------------------------------------------------------------


def clustered(rows, k=16, rounds=3, dims=64):
    x = [(key, [int(np.floor(64 * float(np.float32(v)))) for v in e]) for key, e in rows if e is not None and len(e) == dims and all(v is not None and np.isfinite(v) for v in e)]
    centroids = [v for _, v in sorted((hashlib.sha256(f"1:{key}".encode()).hexdigest(), v) for key, v in x if key is not None)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in x]
        for c in set(own):
            mine = [v for (_, v), o in zip(x, own, strict=True) if o == c]
            centroids[c] = [sum(d) // len(mine) for d in zip(*mine, strict=True)]
    ends = [near(v) for _, v in x]
    inertia = collections.Counter()
    for d, c in ends:
        inertia[c] += d
    return sorted((str(key), c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for (key, _), (d, c) in zip(x, ends, strict=True))


def found_clusters(df):
    return sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def test_clusters_against_plain_python(spark):
    rng = np.random.default_rng(3)
    # few values, so that distances tie
    rows = [(i, (rng.integers(-2, 3, 64) / 64.0).tolist(), i) for i in range(90)] + [(100 + i, rng.normal(size=64).tolist(), 1) for i in range(40)]
    rows += [(5, rows[5][1], 0), (5, rows[6][1], 0), (None, rows[7][1], 0), (200, [0.0] * 64, 0), (201, None, 0), (202, [1.0] * 63, 0), (203, [None] + [1.0] * 63, 0), (204, [float("nan")] * 64, 0), (205, [float("inf")] * 64, 0), (206, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster int").withColumn("distance", F.lit("d"))
    assert found_clusters(annulus.clusters(df)) == clustered([r[:2] for r in rows])
    few = df.where("vec_id in (5, 100, 101)")
    assert found_clusters(annulus.clusters(few)) == clustered([r[:2] for r in rows if r[0] in (5, 100, 101)])
    assert annulus.clusters(df.where("false")).collect() == []


def test_rings_find_the_nearest_and_compare_few():
    rng = np.random.default_rng(4)
    centroids = (rng.normal(size=(200, 8)) * rng.uniform(1, 4000, (200, 1))).astype(np.int64)
    centroids[7] = centroids[3]
    x = np.r_[(rng.normal(size=(500, 8)) * rng.uniform(1, 4000, (500, 1))).astype(np.int64), centroids, np.zeros((1, 8), np.int64)]
    number, d, compared = Rings(centroids).nearest(x, most=3000)
    whole = ((x[:, None] - centroids[None]) ** 2).sum(2)
    assert (d == whole.min(1)).all() and (number == whole.argmin(1)).all()
    assert compared < 0.6 * whole.size  # no structure, so rings are wide
    one = Rings(centroids[:1]).nearest(x)
    assert (one[0] == 0).all() and (one[1] == whole[:, 0]).all()


def test_too_large_components_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="too large"):
        annulus.clusters(df).collect()


# -- language ----------------------------------------------------------------------------------------------


def test_held_out_languages_are_predicted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict(docs, langid.fit(docs)).join(docs, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.98 * len(held) and all(0 <= r.score <= 1 for r in got)
    sure = [r for r in held if r.accepted]
    assert len(sure) > 0.5 * len(held) and sum(r.lang_pred == r.lang for r in sure) >= 0.99 * len(sure)


def test_scores_against_a_plain_version():
    """The table's rows summed subword by subword, with a subword's hash worked out letter by letter."""

    def bucket(run, bits):
        h = 0
        for n, c in enumerate(run, 1):
            h = (c * 0x9E3779B1 + 1) & 0xFFFFFFFF if n == 1 else (((h ^ (h >> 15)) * 0x85EBCA77) + c * 0xC2B2AE3D + n) & 0xFFFFFFFF
        return (((h ^ (h >> 13)) * 0x27D4EB2F) & 0xFFFFFFFF) >> (32 - bits)

    text = "Ein Bär, 2 über-Ñandúes  x; \n'quoted' don't ½² étude"
    framed = [[0, *map(ord, w), 0] for w in re.findall("[^\\W\\d_²½́][́\\w]*", text.lower().replace("½", " ").replace("²", " ")) if not w.isdigit()]
    want = sorted(bucket(w[i : i + n], 12) for w in framed for n in (1, 2, 3, 4) for i in range(len(w) - n + 1) if n > 1 or w[i])
    # edges of neighbouring words are one letter, so runs that only hold it at both ends are the same
    assert sorted(langid.subwords(text, 12).tolist()) == want
    table = np.random.default_rng(0).normal(size=(1 << 12, 3)).astype(np.float32)
    model = langid.Model(["a", "b", "c"], table, np.array([0.1, 0.2, 0.3]), 0.7, 0.5)
    z = (table[want].sum(0, dtype=float) / len(want) + model.bias) / 0.7
    p = np.exp(z) / np.exp(z).sum()
    lang, score, accepted = langid.Reader(model).predict(text)
    assert lang == "abc"[p.argmax()] and abs(score - p.max()) < 1e-9 and accepted == (p.max() >= 0.5)


def test_language_of_odd_rows(spark):
    en, de = "the cat and the dog are here with the other one", "der hund und die katze sind mit dem anderen hier"
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices((en if i % 2 else de).split(), k=12)), "en" if i % 2 else "de") for i in range(60)]
    odd = [(100, None, "en"), (101, "", None), (102, "123 ½² !?", "en"), (103, en, None), (None, de, "de"), (None, None, None), (104, "x" * 300_000, "en"), (105, "日本語", None), (106, "́́", "en"), (103, en, None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("s")).withColumn("key", F.lit(0))
    got = langid.predict(docs, langid.fit(docs)).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append((r.lang_pred, r.score, r.accepted))
    assert len(got) == len(rows + odd)
    assert all(by[k] == [("und", 0.0, False)] for k in (100, 101, 102, 106)) and ("und", 0.0, False) in by[None]
    assert by[103][0] == by[103][1] and by[103][0][0] == "en" and {"de", "und"} == {x[0] for x in by[None]}
    assert by[105][0][0] in ("en", "de") and by[105][0][1] < by[103][0][1]
    assert langid.predict(docs.where("false"), langid.fit(docs)).collect() == []
    none = langid.predict(docs, langid.fit(docs.where("lang is null"))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    one = langid.predict(docs, langid.fit(docs.where("lang = 'en'"))).collect()
    assert {r.lang_pred for r in one} == {"en", "und"}


def test_labels_of_held_out_rows_change_nothing(spark):
    rows = [(i, "the cat and the dog" if i % 2 else "der hund und die katze", "en" if i % 2 else "de") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit("xx")).otherwise(F.col("lang")))
    a, b = langid.fit(docs), langid.fit(other)
    assert a.langs == b.langs and (a.table == b.table).all() and a.temperature == b.temperature and a.bar == b.bar
