"""Operator 6: fixity audit of WARC replicas by Merkle trees.

Pages become WARC response records. Records lie in archives in order; each has a byte range and a
SHA-256. A leaf hashes a range and its record's hash, inner nodes hash their children in order, ``fanout`` at a time, as many
levels as the largest archive asks for. A tree is built in one aggregate for each part of an archive. An audit compares the
replicas' roots and, level by level, expands only the nodes that differ. The records under differing leaves are then
matched by id and content, wherever they stand, so one that is missing makes no other seem damaged.

An archive holds the records of ``per_archive`` consecutive page ids. One that repeated ids make larger than four times
that, or pages larger than ``archive_bytes``, is split into a power of two of parts by a hash of id and content. Equal records stand next to each other and are one
leaf with a count (``copies``); those of a split archive are dealt out evenly over its parts. So an archive is the same in whatever
order its rows come, and no id or content gathers in one task.

Defined cases: null url and html count as empty, null ids as -1; repeated rows are records of their own, ordered by
hash. A record whose id is there with other content is corrupt; one that is in one replica only is missing or extra; one
with the same content elsewhere is shifted. Empty tables give no rows and no roots; very long pages are handled whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.llm.links import cut
from lamina.llm.memory import tidy

LENGTH = re.compile(rb"\r\nContent-Length: (\d+)", re.I)
#: Bytes beyond which an archive is split, far under the 2 GB that one value may have: parts are dealt by hash, so some are larger than others.
ARCHIVE_BYTES = 256_000_000
RECORD_ID = re.compile(rb"\r\nWARC-Record-ID: <urn:page:(-?\d+)>", re.I)


def record(key: str, url: str, body: str) -> Column:
    """One WARC/1.1 response record."""
    text = F.coalesce(F.col(body).cast("string"), F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(F.col(url).cast("string"), F.lit("")),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col(key).cast("string"), F.lit("-1")),
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(text).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, text, F.lit("\r\n\r\n"))


def hashed(pages: DataFrame, key: str, url: str, body: str, per_archive: int, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(k, archive, parts, r, length, sha256); parts: into how many the archive is split."""
    k = F.coalesce(F.col(key).cast("long"), F.lit(-1))
    archive = F.expr(f"(k - pmod(k, {per_archive})) div {per_archive}")
    most = 4 * per_archive
    parts = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n")))).cast("int").alias("parts")
    size = F.octet_length(record(key, url, body)).cast("long")
    n = F.greatest(F.when(F.count("*") > most, F.count("*") / most), F.when(F.sum("b") > archive_bytes, F.sum("b") / archive_bytes)).alias("n")
    large = pages.select(k.alias("k"), size.alias("b")).groupBy(archive.alias("archive")).agg(n).where(F.col("n") > 1).select("archive", parts)
    rec = pages.select(k.alias("k"), record(key, url, body).alias("r")).withColumn("archive", archive)
    rec = rec.select("k", "archive", "r", F.octet_length("r").cast("long").alias("length"), F.sha2("r", 256).alias("sha256"))
    large = cut(large, 1)
    # where no archive is split, which ids without repeats make sure of, no join moves the records
    return rec.withColumn("parts", F.lit(None).cast("int")) if large.isEmpty() else rec.join(large, "archive", "left")


def dealt(rows: DataFrame, *more: Column) -> DataFrame:
    """Equal records as one row with ``copies``, those of split archives over their parts."""
    one = rows.groupBy("archive", "parts", "k", "length", "sha256").agg(F.count("*").alias("n"), *more)
    parts = F.coalesce("parts", F.lit(1))
    one = one.withColumn("i", F.explode(F.sequence(F.lit(0), F.least(F.col("n"), parts.cast("long")).cast("int") - 1)))
    part = F.pmod(F.xxhash64("k", "sha256") + F.col("i"), parts).cast("int").alias("part")
    copies = (F.floor(F.col("n") / parts) + (F.col("i") < F.col("n") % parts).cast("long")).alias("copies")
    return one.select("archive", part, "k", "length", "sha256", copies, *[c for c in one.columns if c not in ("archive", "parts", "k", "length", "sha256", "n", "i")])


def manifest(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", per_archive: int = 1024, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(key, archive, part, at, seq, offset, length, sha256, copies) of each leaf: its place among the leaves, the number and offset of its first record. Page bytes are not shuffled."""
    w = Window.partitionBy("archive", "part").orderBy("k", "sha256", "length")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt(hashed(pages, key, url, body, per_archive, archive_bytes).drop("r")).withColumn("at", F.row_number().over(w).cast("long") - 1)
    rows = rows.withColumn("seq", F.coalesce(F.sum("copies").over(before), F.lit(0))).withColumn("offset", F.coalesce(F.sum(F.col("copies") * F.col("length")).over(before), F.lit(0)))
    return rows.select(F.col("k").alias(key), "archive", "part", "at", "seq", "offset", "length", "sha256", "copies")


def archives(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", per_archive: int = 1024, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, part, bytes): each archive's records one after another, ready to be written as files."""
    rows = hashed(pages, key, url, body, per_archive, archive_bytes)
    order = ["archive", "part", "k", "sha256", "length", "copies", "r"]
    usual = rows.where("parts IS NULL").select("archive", F.lit(0).alias("part"), "k", "sha256", "length", F.lit(1).cast("long").alias("copies"), "r")
    rows = usual.unionByName(dealt(rows.where("parts IS NOT NULL"), F.first("r").alias("r")).select(*order))  # empty where no archive is split
    inside = F.array_sort(F.collect_list(F.struct(*order[2:])))
    return rows.groupBy("archive", "part").agg(F.array_join(F.transform(inside, lambda x: F.repeat(x.r, x.copies.cast("int"))), "").cast("binary").alias("bytes"))


def read_archives(blobs: DataFrame, key: str = "page_id") -> DataFrame:
    """The manifest of stored archives (archive, part, bytes), record by record; bytes that start no record end an archive's scan with a record of their own."""

    def leaves(blob: bytes):
        """[id, seq, offset, length, sha256, copies] in order; equal neighbours are one."""
        at, seq, last = 0, 0, None
        while at < len(blob):
            name, end = -1, len(blob)
            head = blob.find(b"\r\n\r\n", at)
            length = LENGTH.search(blob, at, head) if head >= 0 and blob.startswith(b"WARC/", at) else None
            if length:
                end = min(end, head + 4 + int(length[1]) + 4)
                name = int(found[1]) if (found := RECORD_ID.search(blob, at, head)) else -1
            digest = hashlib.sha256(memoryview(blob)[at:end]).hexdigest()
            if last and (last[0], last[3], last[4]) == (name, end - at, digest):
                last[5] += 1
            else:
                if last:
                    yield last
                last = [name, seq, at, end - at, digest, 1]
            at, seq = end, seq + 1
        if last:
            yield last

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                archive, part, blob = (c[i].as_py() for c in b.columns)
                rows = [(name, archive, part, at, seq, offset, length, digest, copies) for at, (name, seq, offset, length, digest, copies) in enumerate(leaves(blob))]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], names=names)

    names = [key, "archive", "part", "at", "seq", "offset", "length", "sha256", "copies"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
    return blobs.select("archive", "part", "bytes").mapInArrow(tidy(run), f"{key} long, archive long, part int, at long, seq long, offset long, length long, sha256 string, copies long")


def trees(leaves: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(archive, part, l0, l1, ...): the hashes of each level in order; the last level has the root alone."""
    leaf = F.sha2(F.concat_ws(":", "offset", "length", "sha256", "copies"), 256)
    rows = leaves.groupBy("archive", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", leaf.alias("hash")))), lambda x: x.hash).alias("l0"))
    for n in range(1, levels + 1):
        below = f"l{n - 1}"
        rows = rows.withColumn(f"l{n}", F.expr(f"transform(sequence(0, (size({below}) - 1) div {fanout}), i -> sha2(array_join(slice({below}, CAST(i * {fanout} + 1 AS INT), {fanout}), ''), 256))"))
    return rows


def differing(a: DataFrame, b: DataFrame, fanout: int) -> DataFrame:
    """(archive, part, at) of the leaves that differ: from the roots down, only into nodes that differ."""
    most = max([0, *(r[0] for df in (a, b) if (r := df.agg(F.max("at")).first())[0] is not None)])
    levels = 1
    while fanout**levels <= most:
        levels += 1
    ours, theirs = trees(a, fanout, levels), trees(b, fanout, levels)
    theirs = theirs.toDF("archive", "part", *[f"their_l{n}" for n in range(levels + 1)])
    both = ours.join(theirs, ["archive", "part"], "full_outer").withColumn("node", F.array(F.lit(0).cast("long")))
    for n in range(levels, -1, -1):
        # of the nodes at hand those whose hashes differ; then their children
        both = both.withColumn("node", F.expr(f"filter(node, i -> NOT (get(l{n}, CAST(i AS INT)) <=> get(their_l{n}, CAST(i AS INT))))")).where(F.size("node") > 0)
        if n:
            both = both.withColumn("node", F.expr(f"flatten(transform(node, i -> sequence(i * {fanout}, i * {fanout} + {fanout - 1})))"))
    return both.select("archive", "part", F.explode("node").alias("at"))


THEIRS = ("part", "seq", "offset", "length", "sha256")


def audit(a: DataFrame, b: DataFrame, key: str = "page_id", fanout: int = 16) -> DataFrame:
    """(key, archive, part, seq, state, offset, length, sha256, their_...) of each record that isn't at its place unharmed; ``a`` and ``b``: manifests."""
    bad = cut(differing(a, b, fanout))
    same = Window.partitionBy("archive", "k", "sha256", "length").orderBy("part", "seq")
    at = ["archive", "part", "at"]
    ours, theirs = (df.withColumnRenamed(key, "k").join(bad, at).withColumn("occurrence", F.row_number().over(same)) for df in (a, b))
    theirs = theirs.select("archive", "k", "occurrence", *[F.col(c).alias(f"their_{c}") for c in (*THEIRS, "copies")])
    content = [ours[c] == theirs[c] for c in ("archive", "k", "occurrence")] + [ours[c] == theirs[f"their_{c}"] for c in ("sha256", "length")]
    met = ours.join(theirs, content, "full_outer").select(
        *[F.coalesce(ours[c], theirs[c]).alias(c) for c in ("archive", "k")], "part", "seq", "offset", "length", "sha256", *[f"their_{c}" for c in THEIRS],
        F.coalesce("copies", F.lit(0)).alias("n"), F.coalesce("their_copies", F.lit(0)).alias("m"),
    )
    met = cut(met)
    kept = ["archive", "k", "part", "seq", "offset", "length", "sha256", *[f"their_{c}" for c in THEIRS]]
    both = F.least("n", "m")

    def record(side: str, i: str) -> list[Column]:
        """A leaf's columns for its record number ``i``."""
        return [(F.col(f"{side}seq") + F.col(i)).alias(f"{side}seq"), (F.col(f"{side}offset") + F.col(i) * F.col(f"{side}length")).alias(f"{side}offset"), *[F.col(f"{side}{c}") for c in ("part", "length", "sha256")]]

    # the same content on both sides
    moved = met.where((both > 0) & ~((F.col("part") == F.col("their_part")) & (F.col("offset") == F.col("their_offset"))))
    moved = moved.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), both - 1))).select("archive", "k", *record("", "i"), *record("their_", "i")).select(*kept, F.lit("shifted").alias("state"))
    # what is left over on either side, record by record: with the same id it is corrupt
    number = Window.partitionBy("archive", "k").orderBy("part", "seq")
    lone = met.where(F.col("n") > F.col("m")).withColumn("i", F.explode(F.sequence(F.col("m"), F.col("n") - 1))).select("archive", "k", *record("", "i"))
    lone = lone.withColumn("number", F.row_number().over(number))
    other = met.where(F.col("m") > F.col("n")).withColumn("i", F.explode(F.sequence(F.col("n"), F.col("m") - 1))).select("archive", "k", *record("their_", "i"))
    other = other.withColumn("number", F.row_number().over(Window.partitionBy("archive", "k").orderBy("their_part", "their_seq")))
    state = F.when(F.col("their_sha256").isNull(), "missing").when(F.col("sha256").isNull(), "extra").otherwise("corrupt").alias("state")
    harmed = lone.join(other, ["archive", "k", "number"], "full_outer").select(*kept, state)
    return moved.unionByName(harmed).withColumnRenamed("k", key)


def records(a: DataFrame) -> DataFrame:
    """A manifest record by record."""
    rows = a.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return rows.withColumns({"seq": F.col("seq") + F.col("i"), "offset": F.col("offset") + F.col("i") * F.col("length")}).drop("i", "at", "copies")


def report(a: DataFrame, b: DataFrame, key: str = "page_id", fanout: int = 16) -> DataFrame:
    """Every record of ``a`` with its state in replica ``b``: ok, corrupt, shifted or missing."""
    a, b = cut(a), cut(b)
    bad = audit(a, b, key, fanout).where("seq IS NOT NULL").select("archive", "part", "seq", "state")
    return records(a).join(bad, ["archive", "part", "seq"], "left").select(key, "archive", "part", "seq", "offset", "length", "sha256", F.coalesce("state", F.lit("ok")).alias("state"))
