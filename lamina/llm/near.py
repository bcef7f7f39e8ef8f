"""Operator 5: n-gram Jaccard join through a MinHash LSH forest, verified exactly.

Each text is a set of hashes of ``words`` consecutive words (lower case, letters and digits). Its signature has
``trees`` labels of ``depth`` levels, a byte of one minimum each, so a label is one long. The labels of a tree, sorted,
are a prefix trie: texts that share the first d levels stand next to each other. Each partition of
the sorted labels is walked once and gives, for each text, an edge to the first text with which it shares its longest
matched prefix, and that prefix's depth; the partitions' ends are tied to their neighbours likewise. The edges of depth d
or more thus connect what shares d levels in some tree, and there is at most one for each text and tree.

Matching starts at the full depth. The groups so found are verified exactly, and from the least similar link found
follows how short prefixes have to be for links that similar (less ``margin``) to be found with probability ``recall``;
if they have to be shorter, the edges of those levels are added and the groups that have grown are verified anew. Data
whose copies are all very close stay at deep prefixes, where few other texts match; at the threshold itself the
depth is ``Forest.shortest``.

Within a group, pairs that share a prefix are verified exactly on whole texts: one by one where they are few among all
pairs, else by a product of incidence matrices. Groups of more than ``block`` texts or ``block_chars`` characters are cut into blocks,
and each pair of blocks is a task of its own. Equal texts are one node with a count, so
thousands of copies cost as much as one, and links are counted through these counts without writing pairs.

Result: for each row its class (the smallest key among documents connected by links) and its number of
links: other rows whose set has Jaccard similarity of at least ``threshold`` with its own.

Defined cases: null text counts as empty; equal texts link whatever they hold; other texts without a word link
with nothing; texts of fewer words than ``words`` have one shingle of all of them; repeated rows count
as copies; null keys are smaller than none, so a class of null keys only has a null id; ties go to
the smaller key; an empty table gives no rows; very long texts are handled whole; other columns are ignored by
``join`` and kept by ``keep_one``, whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.bpe import portions
from lamina.llm.links import components, cut, discard, fresh, swept
from lamina.llm.memory import give_back, tidy

WORD = re.compile(r"\w+")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn(n: int, salt: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    return mixed((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt << 32)) * np.uint64(0x9E3779B97F4A7C15))


POWERS = np.cumprod(np.r_[np.uint64(1), np.full(4095, 0x100000001B3, np.uint64)], dtype=np.uint64)


def word_hashes(words: list[str]) -> np.ndarray:
    raw = [w.encode("utf-8", "replace") for w in words]
    lens = np.array([len(w) for w in raw], np.int64)
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64) + np.uint64(1)
    starts = np.cumsum(lens) - lens
    place = np.arange(len(flat)) - np.repeat(starts, lens)
    # beyond the table the powers repeat with a turn, so that any length works
    flat = flat * POWERS[place % len(POWERS)] + (place // len(POWERS)).astype(np.uint64)
    return mixed(np.add.reduceat(flat, starts) ^ (lens.astype(np.uint64) << np.uint64(48))) if len(lens) else np.zeros(0, np.uint64)


def shingles(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in one array, repeats included, and how many each text has."""
    found = [WORD.findall((t or "").lower()) for t in texts]
    h = word_hashes([w for f in found for w in f])
    n = np.array([len(f) for f in found], np.int64)
    turns = drawn(words, 3)
    padded = np.concatenate([h, np.zeros(words, np.uint64)])
    left = np.repeat(np.cumsum(n), n) - np.arange(len(h))  # words from here to the text's end
    total = np.zeros(len(h), np.uint64)
    for i in range(words):
        total += np.where(i < left, padded[i : i + len(h)] * turns[i], np.uint64(0))
    full = left >= words
    full[(np.cumsum(n) - n)[n > 0]] = True  # short texts: all their words
    return mixed(total[full]), np.where(n == 0, 0, np.maximum(1, n - words + 1))


class Forest:
    """Seeds of the labels, and the depths that recall asks for."""

    def __init__(self, trees: int = 24, depth: int = 8, threshold: float = 0.8, recall: float = 0.999, margin: float = 0.04):
        if not 1 <= depth <= 8:
            raise ValueError("a label has up to eight levels")
        self.trees, self.depth, self.threshold, self.recall, self.margin = trees, depth, threshold, recall, margin
        #: Deep enough for links at the threshold; shorter prefixes are never needed.
        self.shortest = self.needed(threshold)
        self.turns = (drawn(trees * depth, 5) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        self.shifts = (drawn(trees * depth, 6) >> np.uint64(32)).astype(np.uint32)

    def found(self, similarity: float, depth: int) -> float:
        """Probability that two texts share a prefix of this depth in some tree."""
        return 1 - (1 - similarity**depth) ** self.trees

    def needed(self, similarity: float) -> int:
        """The longest prefix at which links of this similarity are found with the target recall."""
        return next((d for d in range(self.depth, 1, -1) if self.found(similarity, d) >= self.recall), 1)

    def labels(self, flat: np.ndarray, n: np.ndarray) -> np.ndarray:
        """(texts with shingles, trees): labels, the first level in the highest byte."""
        starts = (np.cumsum(n) - n)[n > 0]
        out = np.zeros((len(starts), self.trees), np.uint64)
        if not len(starts):
            return out
        x = (flat >> np.uint64(32)).astype(np.uint32)
        turned = np.empty_like(x)
        for t in range(self.trees):
            for level in range(self.depth):
                i = t * self.depth + level
                np.multiply(x, self.turns[i], out=turned)
                turned += self.shifts[i]
                least = mixed(np.minimum.reduceat(turned, starts).astype(np.uint64) + np.uint64(1))
                out[:, t] |= (least & np.uint64(255)) << np.uint64(8 * (7 - level))
        return out


def node(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))


def named(key: str) -> Column:
    """A key as a string that is never null, to join by."""
    return F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("null")).alias("name")


def sketched(docs: DataFrame, key: str, text: str, words: int, forest: Forest) -> DataFrame:
    """(k, node, chars, labels) of every row; texts without a word have no labels."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = b.column(2).to_pylist()
            for lo, hi in portions(texts, 1_000_000):
                flat, n = shingles(texts[lo:hi], words)
                labels = forest.labels(flat, n).view(np.int64)
                ends = np.r_[0, np.cumsum(np.where(n > 0, forest.trees, 0))].astype(np.int32)
                rows = pa.ListArray.from_arrays(pa.array(ends), pa.array(labels.reshape(-1)))
                chars = pa.array([len(t or "") for t in texts[lo:hi]], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), chars, rows], names=["k", "node", "chars", "labels"])

    base = docs.select(F.col(key).alias("k"), node(text).alias("node"), F.col(text).cast("string").alias("t"))
    return base.mapInArrow(tidy(run), f"k {kind}, node binary, chars long, labels array<long>")


def common(a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """How many leading bytes, up to ``depth``, two arrays of labels share."""
    apart = a ^ b
    return sum((apart >> np.uint64(64 - 8 * d) == 0).astype(np.int64) for d in range(1, depth + 1))


def walk(batches, shortest: int, depth: int):
    """Sorted (tree, label, node) to edges (a, b, level); the first and the last row of the partition come as rows of their own, with ``part``."""
    part, before, heads, first, last = TaskContext.get().partitionId(), None, None, None, None
    names = ["a", "b", "level", "part", "tree", "label"]
    for batch in batches:
        m = batch.num_rows
        if not m:
            continue
        tree, label, nodes = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2)
        shared = np.zeros(m, np.int64)
        shared[1:] = np.where(tree[1:] == tree[:-1], common(label[1:], label[:-1], depth), 0)
        if before is None:
            first = (nodes[0].as_py(), int(tree[0]), int(label.view(np.int64)[0]))
            heads = pa.array([None] * (depth + 1 - shortest), nodes.type)
        elif tree[0] == before[0]:
            shared[0] = common(label[:1], np.array([before[1]], np.uint64), depth)[0]
        # the first row of the run that a row stands in, by depth; runs that began earlier keep their head from the batch before
        pool, at = pa.concat_arrays([heads, nodes]), []
        for d in range(shortest, depth + 1):
            head = np.maximum.accumulate(np.where(shared < d, np.arange(m), -1))
            at.append(np.where(head < 0, d - shortest, head + len(heads)))
        tied = np.flatnonzero(shared >= shortest)
        to = np.array(at)[shared[tied] - shortest, tied]
        none = pa.nulls(len(tied), pa.int64())
        yield pa.RecordBatch.from_arrays([nodes.take(pa.array(tied)), pool.take(pa.array(to)), pa.array(shared[tied].astype(np.int32)), none.cast(pa.int32()), none.cast(pa.int32()), none], names=names)
        heads = pool.take(pa.array([x[-1] for x in at]))
        before = (tree[-1], label[-1])
        last = (nodes[m - 1].as_py(), int(tree[-1]), int(label.view(np.int64)[-1]))
    if first is not None:
        rows = [(x[0], None, end, part, x[1], x[2]) for end, x in enumerate((first, last))]
        types = [pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)
    give_back()


def tries(nodes: DataFrame, forest: Forest) -> DataFrame:
    """(a, b, level): the edges of all tries down to the shortest useful prefix."""
    rows = nodes.select(F.posexplode("labels").alias("tree", "label"), "node")
    rows = rows.repartitionByRange("tree", "label", "node").sortWithinPartitions("tree", "label", "node")
    shortest, depth = forest.shortest, forest.depth
    walked = cut(rows.mapInArrow(lambda batches: walk(batches, shortest, depth), "a binary, b binary, level int, part int, tree int, label long"))
    # two rows a partition, in order: where the last one's prefix goes on in the next partition
    w = Window.orderBy("part", "level")
    ends = walked.where("part IS NOT NULL").select("part", "level", "tree", "label", "a", *[F.lag(c).over(w).alias(f"old_{c}") for c in ("tree", "label", "a")])
    apart = F.col("label").bitwiseXOR(F.col("old_label"))
    shared = sum((F.shiftrightunsigned(apart, 64 - 8 * d) == 0).cast("int") for d in range(1, depth + 1))
    over = ends.where("level = 0 AND tree = old_tree").select("a", F.col("old_a").alias("b"), shared.alias("level"))
    inner = walked.where("part IS NULL").select("a", "b", "level")
    out = cut(inner.unionByName(over.where(F.col("level") >= shortest)).where("a != b"))
    discard(walked)
    return out


def candidates(edges: DataFrame, depth: int) -> DataFrame:
    """(v, comp): texts connected by shared prefixes of ``depth`` levels or more."""
    heads = edges.where(F.col("level") >= depth).groupBy("a").agg(F.min("b").alias("b"), F.collect_set("b").alias("heads"))
    # a text is tied to one of its heads only, and its other heads to that one: heads are few
    heads = cut(heads, 2)
    among = heads.where(F.size("heads") > 1).select(F.col("b").alias("a"), F.explode("heads").alias("b")).where("a != b").distinct()
    out = components(heads.select("a", "b").unionByName(among), smallest=False)
    discard(heads)
    return out


def overlaps(a: list[np.ndarray], b: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of all sets of ``a`` with all of ``b`` (or of ``a``); sets are sorted arrays."""
    sets = a + (b or [])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, ids, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    new = np.cumsum(shared) - 1
    keep = shared[ids]
    cols, owner = new[ids[keep]], owner[keep]
    order = np.argsort(cols, kind="stable")
    cols, owner = cols[order], owner[order]
    n, width = int(shared.sum()), max(64, 8_000_000 // max(1, len(sets)))
    out = np.zeros((len(a), len(b) if b else len(a)), np.float32)
    for at in range(0, n, width):
        lo, hi = np.searchsorted(cols, [at, at + width])
        m = np.zeros((len(sets), min(width, n - at)), np.float32)
        m[owner[lo:hi], cols[lo:hi] - at] = 1
        out += m[: len(a)] @ (m[len(a) :] if b else m).T
    if b is None:  # elements of one set only were left out above
        np.fill_diagonal(out, [len(s) for s in a])
    return out


def similarities(a: list[np.ndarray], b: list[np.ndarray] | None, la: np.ndarray, lb: np.ndarray | None, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, similarities) of the pairs that share a prefix; of all pairs if most do. Without ``b`` pairs within ``a``, each once."""
    labels, first = (la if lb is None else np.concatenate([la, lb])) >> np.uint64(64 - 8 * depth), len(a)
    sets, n = a + (b or []), len(a) + len(b or [])
    whole = first * (first - 1) // 2 if b is None else first * (n - first)
    codes, many = [], 0
    for tree in labels.T:
        order = np.argsort(tree, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(tree[order]) != 0])
        runs = np.diff(np.r_[starts, n])
        many += int((runs * (runs - 1) // 2).sum())
        if 4 * many > whole and n > 2:
            break
        for at, size in zip(starts[runs > 1].tolist(), runs[runs > 1].tolist(), strict=True):
            run = np.sort(order[at : at + size])
            i, j = np.triu_indices(size, 1)
            codes.append(run[i] * n + run[j])
    else:
        i, j = np.divmod(np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64), n)
        if b is not None:
            between = (i < first) & (j >= first)
            i, j = i[between], j[between]
        both = np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)], float)
        size = np.array([len(x) for x in sets], float)
        return i, j - (first if b is not None else 0), both / (size[i] + size[j] - both)
    both = overlaps(a, b)
    na, nb = (np.array([len(x) for x in y], float) for y in (a, b if b else a))
    share = both / (na[:, None] + nb[None, :] - both)
    i, j = np.triu_indices(first, 1) if b is None else (x.ravel() for x in np.indices(share.shape))
    return i, j, share[i, j]


def roots(n: int, pairs: np.ndarray) -> list[int]:
    """Smallest index connected with each index."""
    up = list(range(n))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j in pairs.tolist():
        i, j = find(i), find(j)
        up[max(i, j)] = min(i, j)
    return [find(i) for i in range(n)]


def verified(pdf: pd.DataFrame, words: int, threshold: float, depth: int) -> pd.DataFrame:
    """(comp, node, links, root, least) for the groups or the pair of blocks in ``pdf``; links count copies, ``least`` is the least similar link's."""
    pdf = pdf.drop_duplicates(["comp", "node", "side"]).sort_values(["comp", "side", "node"]).reset_index(drop=True)
    sets: list[np.ndarray] = []
    texts = pdf.pop("t").tolist()
    for lo, hi in portions(texts, 1_000_000):
        flat, n = shingles(texts[lo:hi], words)
        sets += [np.unique(x) for x in np.split(flat, np.cumsum(n)[:-1])]
    texts.clear()
    labels = np.array([np.asarray(x) for x in pdf.pop("labels")], np.int64).view(np.uint64)
    counts, names, side, out = pdf["n"].to_numpy(np.int64), pdf["node"].tolist(), pdf["side"].to_numpy(), []
    for at in pdf.groupby("comp", sort=False).indices.values():
        left, right = at[side[at] == 0], at[side[at] == 1]
        i, j, share = similarities([sets[x] for x in left], [sets[x] for x in right] if len(right) else None, labels[left], labels[right] if len(right) else None, depth)
        hit = share >= threshold - 1e-9
        if not hit.any():
            continue
        i, j, share = i[hit], j[hit] + (len(left) if len(right) else 0), share[hit]
        rows = np.concatenate([left, right])
        links = np.bincount(i, counts[rows[j]], len(rows)) + np.bincount(j, counts[rows[i]], len(rows))
        low = np.ones(len(rows))
        np.minimum.at(low, i, share)
        np.minimum.at(low, j, share)
        order = sorted(range(len(rows)), key=lambda x: names[rows[x]])
        back = np.argsort(order)
        root = roots(len(rows), np.c_[back[i], back[j]])
        comp = pdf["comp"].iat[at[0]]
        out += [(comp, names[rows[order[x]]], int(links[order[x]]), names[rows[order[root[x]]]], float(low[order[x]])) for x in range(len(rows)) if links[order[x]]]
    give_back()
    return pd.DataFrame(out, columns=["comp", "node", "links", "root", "least"]).astype({"links": "int64", "least": "float64"})


def checked(groups: DataFrame, nodes: DataFrame, texts: DataFrame, words: int, threshold: float, depth: int, block: int, block_chars: int) -> DataFrame:
    """``verified`` over all groups (v, comp)."""
    members = groups.select(F.col("v").alias("node"), "comp").join(nodes, "node")
    sizes = cut(members.groupBy("comp").agg(F.count("*").alias("size"), F.sum("chars").alias("all")), 2)
    parts = F.greatest(F.ceil(F.col("size") / block), F.ceil(F.col("all") / block_chars)).cast("int")
    total = sizes.agg(F.sum("all")).first()[0] or 0
    # one text of each member: its first key's row; further rows of that key and text are equal, and fall out when verified
    told = texts.join(members.join(sizes, "comp").select("node", named("k"), "comp", "n", "labels", parts.alias("parts")), ["node", "name"])
    columns = ["comp", "node", "n", "labels", "t"]
    none = F.lit(-1)
    small = told.where("parts = 1").select(*columns, F.lit(0).alias("side"), F.pmod(F.xxhash64("comp"), F.lit(1 + total // block_chars)).alias("g"), none.alias("i"), none.alias("j"))
    # a block meets itself and every other block once
    large = told.where("parts > 1").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    large = large.select(*columns, (F.col("own") > F.col("other")).cast("int").alias("side"), F.xxhash64("comp").alias("g"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    check = small.unionByName(large).groupBy("g", "i", "j").applyInPandas(lambda pdf: verified(pdf, words, threshold, depth), "comp binary, node binary, links long, root binary, least double")
    return cut(check)


def links_found(docs: DataFrame, nodes: DataFrame, key: str, text: str, words: int, threshold: float, forest: Forest, block: int, block_chars: int) -> tuple[DataFrame, int]:
    """(comp, node, links, root) of the texts that have links, a row for each pair of blocks, and the depth at which the target recall was met."""
    texts = docs.select(node(text).alias("node"), named(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))

    def told(groups: DataFrame) -> DataFrame:
        return groups.groupBy("comp").agg(F.count("*").alias("size"), F.sum(F.xxhash64("v").cast("decimal(38,0)")).alias("sum"))

    edges = tries(nodes, forest)
    swept(docs.sparkSession)
    depth, found, old = forest.depth, None, None
    while True:
        groups = candidates(edges, depth)
        if found is None:
            found = checked(groups, nodes, texts, words, threshold, depth, block, block_chars)
        else:
            # groups with the same members as before stay as they are
            same = cut(told(groups).join(told(old).withColumnRenamed("comp", "before"), ["size", "sum"]).select("comp", "before"), 2)
            grown = groups.join(same, "comp", "left_anti")
            found = found.join(same.select(F.col("before").alias("comp")), "comp", "left_semi").unionByName(checked(grown, nodes, texts, words, threshold, depth, block, block_chars))
        least = found.agg(F.min("least")).first()[0]
        shorter = depth if least is None else max(forest.shortest, forest.needed(max(forest.threshold, least - forest.margin)))
        if shorter >= depth:
            discard(edges)
            return found, depth
        old, depth = groups, shorter


def classes(docs: DataFrame, key: str, text: str, words: int, threshold: float, forest: Forest, block: int, block_chars: int) -> tuple[DataFrame, DataFrame]:
    """(k, node) of every row; and of every node: n copies, links to other nodes' rows, class key and class node."""
    kind = docs.schema[key].dataType.simpleString()
    rows = cut(sketched(docs, key, text, words, forest))
    nodes = cut(rows.groupBy("node").agg(F.count("*").alias("n"), F.min("k").alias("k"), F.max("chars").alias("chars"), F.first("labels").alias("labels")))
    found, _ = links_found(docs, nodes, key, text, words, threshold, forest, block, block_chars)
    # blocks of one group may name different roots
    joined = components(found.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")), smallest=False).select(F.col("v").alias("node"), F.col("comp").alias("class"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    full = nodes.drop("labels").join(links, "node", "left").join(joined, "node", "left").select("node", "n", "k", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("class", "node").alias("class"))
    full = cut(full)
    # the class goes by its smallest key, then by that key's smallest node
    heads = full.groupBy("class").agg(F.min(F.struct(F.col("k").isNull().alias("none"), "k", "node")).alias("head"))
    full = full.join(heads, "class").select("node", "n", "links", F.col("head.k").cast(kind).alias("class_key"), F.col("head.node").alias("class_node"))
    return rows.select("k", "node"), full


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, threshold: float = 0.8, forest: Forest | None = None, block: int = 1024, block_chars: int = 2_000_000) -> DataFrame:
    """(key, class_id, links) of every row."""
    rows, full = classes(docs, key, text, words, threshold, forest or Forest(threshold=threshold), block, block_chars)
    return rows.join(full, "node").select(F.col("k").alias(key), F.col("class_key").alias("class_id"), (F.col("links") + F.col("n") - 1).alias("links"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, threshold: float = 0.8, forest: Forest | None = None, block: int = 1024, block_chars: int = 2_000_000) -> DataFrame:
    """``docs``, all columns, with one row of each class: that of its smallest key."""
    _, full = classes(docs, key, text, words, threshold, forest or Forest(threshold=threshold), block, block_chars)
    mine, name = fresh(docs.columns, "node", "name")
    heads = full.where(F.col("node") == F.col("class_node")).select(F.col("node").alias(mine), named("class_key").alias(name))
    # joined by text and key, so that very many equal texts don't meet in one task
    kept = docs.withColumns({mine: node(text), name: named(key)}).join(heads, [mine, name])
    return kept.dropDuplicates([mine, name]).select(*[F.col(f"`{c}`") for c in docs.columns])
