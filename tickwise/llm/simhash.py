"""SimHash near-duplicates linked through pivot distance tables.

A fingerprint is the majority vote, bit by bit, over the XXH64 values (seed 42)
of the text's word shingles.  Fingerprints within ``max_bits`` differing bits
are linked; components of links are groups of near copies.

Pivot tables.  Hamming distances to ``N_PIVOTS`` reference fingerprints are
computed once per distinct fingerprint, for each of ``BLOCKS`` blocks of bits.
By the triangle inequality two fingerprints within ``max_bits`` differ by at
most ``max_bits`` in every coordinate; and as ``max_bits`` flipped bits touch
at most ``max_bits`` blocks, the coordinate difference is zero on at least
``BLOCKS - max_bits`` blocks.  So pairs are first discarded by an equi-join on
zero coordinate difference over each choice of that many blocks (20 choices of
3 of 6), then by the maximum coordinate difference over the whole fingerprint,
and the survivors are verified bit by bit.  No link can be lost.

Within a bucket links are found by a breadth-first sweep that emits a spanning
forest, not all pairs; a bucket of more than ``CHUNK`` fingerprints is cut into
chunks and every pair of chunks becomes a task of its own (bounded memory,
nothing dropped).
"""

from __future__ import annotations

import random
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key, written
from .graph import connected_components

SHINGLE = 3          # words per shingle
MAX_BITS = 3         # differing bits that still link
BLOCKS = 6           # blocks of bits with a pivot table each
N_PIVOTS = 16        # reference fingerprints
CHUNK = 20_000       # fingerprints of a bucket that one task compares
HOT = 1000           # a key with more than one in HOT of all rows is hot: there are fewer than HOT such keys
SALTS = 64           # parts that the rows of a hot key are dealt into
_SLICE = 1 << 16     # hashes whose bits are counted at once

PIVOTS = [random.Random(2024 + i).getrandbits(64) for i in range(N_PIVOTS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def text_fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Unsigned SimHash of a UTF-8 text; null and wordless texts give zero."""
    words = (text or b"").lower().split()  # bytes: A-Z only, split at ASCII white space
    if not words:
        return 0
    if len(words) < shingle:
        pieces = iter([b" ".join(words)])
        n = 1
    else:
        pieces = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
        n = len(words) - shingle + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(42)), dtype="<u8", count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _SLICE):
        part = hashes[at:at + _SLICE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, key: Column | None = None) -> DataFrame:
    """(doc_id, key, fp): one row per row of ``docs``, whole texts, fp as a signed long; key is the one given, or null."""
    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            fps = [_signed(text_fingerprint(t, shingle)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(fps, pa.int64())], ["doc_id", "key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       (F.lit(None) if key is None else key).cast("string").alias("key"))
    return rows.mapInArrow(run, "doc_id long, key string, fp long")


def _block_masks(blocks: int) -> list[int]:
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def _block_table(fp: Column, mask: int) -> Column:
    """Distances of one block to all pivots, packed four bits each (a block has at most 15 bits)."""
    packed = F.lit(0).cast("long")
    for i, pivot in enumerate(PIVOTS):
        distance = F.bit_count(fp.bitwiseXOR(F.lit(_signed(pivot))).bitwiseAND(F.lit(_signed(mask)))).cast("long")
        packed = packed.bitwiseOR(F.shiftleft(distance, 4 * i))
    return packed


def pivot_buckets(fps: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS) -> DataFrame:
    """(bucket, fp): one row per choice of blocks on which all coordinate differences must be zero."""
    if not 5 <= blocks <= 64 or max_bits >= blocks:
        raise ValueError("blocks must be 5 to 64 and more than max_bits")
    masks = _block_masks(blocks)
    tables = fps.select("fp", *[_block_table(F.col("fp"), m).alias(f"t{i}") for i, m in enumerate(masks)])
    choices = [F.xxhash64(F.lit(n), *[F.col(f"t{i}") for i in c])
               for n, c in enumerate(combinations(range(blocks), blocks - max_bits))]
    return tables.select("fp", F.explode(F.array(*choices)).alias("bucket"))


def _forest(f: np.ndarray, coords: np.ndarray, max_bits: int, out: list) -> None:
    """Spanning forest of the links among the fingerprints ``f`` (all distinct)."""
    rest = np.arange(len(f))
    while rest.size > 1:
        front, rest = [rest[0]], rest[1:]
        while front and rest.size:
            x = front.pop()
            near = np.abs(coords[rest] - coords[x]).max(axis=1) <= max_bits      # pivot filter
            at = np.flatnonzero(near)
            at = at[np.bitwise_count(f[rest[at]] ^ f[x]) <= max_bits]            # verification
            if at.size:
                found = rest[at]
                out.append(np.stack([np.full(found.size, f[x]), f[found]]))
                rest = np.delete(rest, at)
                front.extend(found.tolist())


def _links(batches, max_bits: int):
    pivots = np.array(PIVOTS, dtype=np.uint64)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def linked(key: np.ndarray, f: np.ndarray):
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends = np.r_[starts[1:], len(key)]
        size = ends - starts
        out: list[np.ndarray] = []
        two = starts[size == 2]
        if two.size:
            x, y = f[two], f[two + 1]
            far = np.abs(np.bitwise_count(x[:, None] ^ pivots).astype(np.int8)
                         - np.bitwise_count(y[:, None] ^ pivots).astype(np.int8)).max(axis=1)
            keep = (far <= max_bits) & (np.bitwise_count(x ^ y) <= max_bits) & (x != y)
            out.append(np.stack([x[keep], y[keep]]))
        for s, e in zip(starts[size > 2], ends[size > 2], strict=False):
            part = np.unique(f[s:e])
            _forest(part, np.bitwise_count(part[:, None] ^ pivots).astype(np.int8), max_bits, out)
        if out:
            both = np.concatenate(out, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], schema=schema)

    held_key, held_fp = np.empty(0, np.int64), np.empty(0, np.uint64)
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.concatenate([held_key, batch.column("bucket").to_numpy(zero_copy_only=False)])
        f = np.concatenate([held_fp, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
        last = np.searchsorted(key, key[-1])  # the last run may go on in the next batch
        yield from linked(key[:last], f[:last]) if last else ()
        held_key, held_fp = key[last:], f[last:]
    if held_key.size > 1:
        yield from linked(held_key, held_fp)


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links whose components are those of all pairs within ``max_bits``.

    ``fps``: distinct fingerprints (column ``fp``).  Repeats of a link may occur.
    """
    rows = pivot_buckets(fps, max_bits, blocks)
    large = rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > chunk)
    chunks = F.ceil(F.coalesce("n", F.lit(1)) / chunk).cast("int")
    part = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    rows = (rows.join(large, "bucket", "left").select("bucket", "fp", chunks.alias("chunks"))
            .withColumn("part", part)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .select(F.when(F.col("chunks") == 1, F.col("bucket"))
                    .otherwise(F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other")))
                    .alias("bucket"), "fp"))
    return (rows.repartition("bucket").sortWithinPartitions("bucket")
            .mapInArrow(lambda it: _links(it, max_bits), "a long, b long"))


def _labelled(per_doc: DataFrame, max_bits: int, least: Column) -> DataFrame:
    """(fp, n, least, label): one row per fingerprint, its rows and ``least`` of them summed up before any join; label names the component."""
    fps = written(per_doc.groupBy("fp").agg(F.count("*").alias("n"), least.alias("least")), "simhash-fps")
    groups = connected_components(fingerprint_links(fps.select("fp"), max_bits)).withColumnRenamed("node", "fp")
    labels = fps.join(groups, "fp", "left").select("fp", "n", "least", F.coalesce("component", "fp").alias("label"))
    return written(labels, "simhash-labels")


def _spread_join(rows: DataFrame, small: DataFrame, key: str, hot: DataFrame, by: str) -> DataFrame:
    """``rows`` with the one row of ``small`` for their key; the keys in ``hot`` (at most HOT) are dealt over SALTS joins by ``by``."""
    salted = F.broadcast(hot.select(key).withColumn("_hot", F.lit(True)))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    copies = F.sequence(F.lit(0), F.when(F.col("_hot"), F.lit(SALTS - 1)).otherwise(F.lit(0)))
    many = rows.join(salted, key, "left").withColumn("_salt", salt).drop("_hot")
    few = small.join(salted, key, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return many.join(few, [key, "_salt"]).drop("_salt")


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of ``docs``.

    Null and wordless texts have fingerprint zero and link like any other;
    component_id is the smallest non-null doc_id of the component (null only if
    it has none); repeated rows come back as often as they occur; an empty table
    gives an empty result; further columns are ignored.
    """
    per_doc = written(fingerprints(docs, shingle), "simhash-docs")
    labels = _labelled(per_doc, max_bits, F.min("doc_id"))
    components = written(labels.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("fps")), "simhash-components")
    hot = components.where(F.col("fps") * HOT > labels.count())
    per_fp = _spread_join(labels.select("fp", "label"), components.select("label", "component_id"), "label", hot, "fp")
    hot = labels.where(F.col("n") * HOT > per_doc.count())
    found = _spread_join(per_doc.select("doc_id", "fp"), per_fp.select("fp", "component_id"), "fp", hot, "doc_id")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest doc_id.

    A null doc_id counts as larger than any other; of rows that share that id
    the one with the smaller key of all its columns stays, whatever the
    partitioning; of rows that are equal in all columns one stays.
    """
    per_doc = written(fingerprints(docs, shingle, row_key(docs)), "simhash-docs")
    labels = _labelled(per_doc, max_bits, F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")))
    kept = written(labels.groupBy("label").agg(F.min("least").alias("least")).select(F.col("least.key").alias("_key")), "simhash-kept")
    names = [F.col(f"`{c}`") for c in docs.columns]
    return docs.withColumn("_key", row_key(docs)).join(kept, "_key").dropDuplicates(["_key"]).select(*names)
