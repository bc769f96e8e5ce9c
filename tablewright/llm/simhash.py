"""SimHash near-dedup with Golay-code fuzzy hashing.

Fingerprint. 64 bits from the XXH64 values (seed 42) of a text's 3-word shingles, repeats included.

Links. Two fingerprints link at `RADIUS` (3) or fewer differing bits. A fingerprint is cut into three segments of
22, 21 and 21 bits, each padded to a 23-bit word of the perfect binary Golay code, which decodes every word to
one of 4096 codewords. Pigeonhole: three errors leave at least two segments with at most one error each. For
each of the three pairs of segments, the index side of a join holds one key, the two codeword numbers; the
probe side holds the numbers of all words at distance 0 or 1 (one or six for each segment). A linked pair
therefore meets, and the exact distance verifies it.

Groups. Equal fingerprints are one node. Before the join, nodes at distance 2 or less are contracted without
pairs: each node names the 65 words within one bit, and all nodes that name the same word, which are within
two bits of each other, link to its smallest. The join then only looks for links between different contracted
groups: index rows of a group that has `DENSE` or more of them at a key are set aside, and only probes of other groups that come
to that key are held against them. So a dense group of near copies is not compared with itself.

Scale. A key has 24 bits, so nodes that share nothing meet by chance, and comparisons of two numbers inside the join grow with
the square of the nodes (README has counts at two sizes); only pairs at distance 3 or less leave it.

Cases. Null or blank text has fingerprint zero, linked like any other. Fewer than three words: one shingle. Repeated
rows share a node and are all returned. Null doc_id: such a row is kept; it names a component only if no other
row does. A long text's shingles are hashed whole, its bits counted in blocks. An empty table gives an empty result. Extra columns,
whatever their names, are ignored by `near_duplicates` and kept by `first_of_each_group`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import boxed, each_text, materialize, text_key, unboxed, worker_cache
from tablewright.llm.components import connected_components
from tablewright.sources.scratch import discard

WORDS = 3
SEED = 42
RADIUS = 3
#: Index rows of one group at one key that are set aside.
DENSE = 16
#: (lowest bit, bits) of each segment.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
#: Generator polynomial of the [23,12] Golay code: x^11+x^10+x^6+x^5+x^4+x^2+1.
GENERATOR = 0b110001110101


def fingerprint(text: bytes, width: int = WORDS) -> int:
    """Unsigned 64-bit fingerprint: a bit is 1 if set in over half the shingle hashes."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    hashes = np.array([xxhash.xxh64_intdigest(x, SEED) for x in shingles], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[i : i + 65536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator."""
    out = words.copy()
    for bit in range(22, 10, -1):
        out ^= ((out >> bit) & 1) * (GENERATOR << (bit - 11))
    return out


@lru_cache
def codewords() -> np.ndarray:
    """The number (upper 12 bits) of the nearest codeword of each of the 2^23 words' 12 + 11 bits, by syndrome."""
    errors = [0] + [1 << i for i in range(23)]
    errors += [1 << i | 1 << j for i in range(23) for j in range(i)]
    errors += [1 << i | 1 << j | 1 << k for i in range(23) for j in range(i) for k in range(j)]
    errors = np.array(errors, np.int64)
    table = np.full(2048, -1, np.int64)
    table[syndromes(errors)] = errors
    return table


def decode(words: np.ndarray) -> np.ndarray:
    """Codeword numbers, 0 to 4095, of 23-bit words."""
    return (words ^ codewords()[syndromes(words)]) >> 11


def probe_keys(words: np.ndarray, bits: int) -> np.ndarray:
    """Distinct codeword numbers of the words within one bit; rows padded with -1."""
    near = words[:, None] ^ np.array([0] + [1 << i for i in range(bits)], np.int64)
    found = np.sort(decode(near), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    found = -np.sort(-found, axis=1)
    return found[:, : max(1, int((found >= 0).sum(axis=1).max(initial=1)))]


def _pairs() -> list[tuple[int, int]]:
    return [(0, 1), (0, 2), (1, 2)]


def golay_keys(fps: np.ndarray, probe: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row number, key) of fingerprints (signed 64 bits): 3 index keys a row, or up to 108 probe keys."""
    bits = fps.view(np.uint64)
    parts = [((bits >> np.uint64(low)) & np.uint64((1 << n) - 1)).astype(np.int64) for low, n in SEGMENTS]
    sides = [probe_keys(x, n) if probe else decode(x)[:, None] for x, (_, n) in zip(parts, SEGMENTS)]
    rows, keys = [], []
    for k, (i, j) in enumerate(_pairs()):
        a, b = sides[i][:, :, None], sides[j][:, None, :]
        key = np.where((a >= 0) & (b >= 0), (k << 24) | (a << 12) | b, -1).reshape(len(fps), -1)
        row, at = np.nonzero(key >= 0)
        rows.append(row)
        keys.append(key[row, at])
    return np.concatenate(rows), np.concatenate(keys)


def _print_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_cache()
    for batch in batches:
        fps = [fingerprint(x) for x in each_text(batch.column("text"))]
        narrow = batch.drop_columns(["text"])
        yield narrow.append_column("fp", pa.array(np.array(fps, np.uint64).view(np.int64)))


def fingerprints(docs: DataFrame, **keys: Column) -> DataFrame:
    """doc_id, the BIGINT columns `keys`, and fp."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *(v.alias(k) for k, v in keys.items()),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return rows.mapInArrow(_print_batches, ", ".join(f"{x} BIGINT" for x in ("doc_id", *keys, "fp")))


def _keys_of(probe: bool):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            fps, groups = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("fp", "group"))
            for i in range(0, len(fps), 4096):
                row, key = golay_keys(fps[i : i + 4096], probe)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fps[i : i + 4096][row]), pa.array(groups[i : i + 4096][row])], ["key", "fp", "group"])

    return batches


def _spread(nodes: DataFrame) -> DataFrame:
    """A row here becomes dozens: as many tasks as a shuffle has, though the stored table is small."""
    return nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")


def close_stars(nodes: DataFrame) -> DataFrame:
    """Edges that connect whatever lies at distance 2 or less: 65 words a node, each word's nodes to its least."""
    word = F.explode(F.transform(F.sequence(F.lit(-1), F.lit(63)), lambda i: F.when(i < 0, F.col("fp")).otherwise(
        F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))))
    named = _spread(nodes).select(word.alias("word"), "fp")
    met = named.groupBy("word").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("word", "b")
    met = materialize(met, "simhash-met", nodes.count())
    return named.join(met, "word").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct()


def group_fingerprints(nodes: DataFrame) -> DataFrame:
    """(node, component) of the stored table `nodes` (fp, distinct) by links of 3 bits or fewer; singles are left out."""
    n = nodes.count()
    stars = materialize(close_stars(nodes), "simhash-stars", n)
    near = materialize(connected_components(stars), "simhash-near", n)
    grouped = materialize(
        nodes.join(near, nodes["fp"] == near["node"], "left").select("fp", F.coalesce("component", "fp").alias("group")), "simhash-grouped", n
    )
    schema = "key BIGINT, fp BIGINT, group BIGINT"
    index = materialize(grouped.mapInArrow(_keys_of(False), schema), "simhash-index", 3 * n)
    dense = index.groupBy("key", "group").agg(F.count("*").alias("n")).where(F.col("n") >= DENSE).select("key", "group")
    dense = materialize(dense, "simhash-dense", 3 * n)
    marked = index.join(dense, ["key", "group"], "left_anti").withColumn("mark", F.lit(False))
    marked = marked.unionByName(dense.select("key", F.lit(0).cast("long").alias("fp"), "group", F.lit(True).alias("mark")))
    probe = _spread(grouped).mapInArrow(_keys_of(True), schema).toDF("key", "fp2", "group2")
    linked = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= RADIUS
    apart = F.when(F.col("mark"), F.col("group") != F.col("group2")).otherwise((F.col("group") < F.col("group2")) & linked)
    meetings = materialize(marked.join(probe.hint("merge"), "key").where(apart), "simhash-met-keys")
    heavy = index.join(dense, ["key", "group"], "left_semi")
    others = meetings.where("mark").select("key", "group", "fp2", "group2").join(heavy.hint("merge"), ["key", "group"]).where(linked)
    met = meetings.where("NOT mark").select("group", "group2").unionByName(others.select("group", "group2"))
    links = materialize(met.select(F.col("group").alias("a"), F.col("group2").alias("b")).distinct(), "simhash-links", n)
    inner = near.select(F.col("node").alias("a"), F.col("component").alias("b"))
    found = materialize(connected_components(inner.unionByName(links)), "simhash-components", n)
    discard(stars, near, grouped, index, dense, meetings, links)
    return found


def _name_groups(rows: DataFrame, least: Column) -> DataFrame:
    """(fp, least, group) of the stored table `rows`: `least` over the rows of each fingerprint, and its group."""
    n = rows.count()
    nodes = materialize(rows.groupBy("fp").agg(least.alias("least")), "simhash-nodes", n)
    groups = group_fingerprints(nodes.select("fp"))
    named = nodes.join(groups, nodes["fp"] == groups["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("group"))
    return materialize(named, "simhash-named", n)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each document: its fingerprint and the smallest doc_id that links reach."""
    rows = materialize(fingerprints(docs), "simhash-fingerprints")
    named = _name_groups(rows, F.min("doc_id"))
    first = named.groupBy("group").agg(F.min("least").alias("component_id"))
    ids = materialize(named.join(first, "group").select("fp", "component_id"), "simhash-ids", named.count())
    return rows.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each_group(docs: DataFrame) -> DataFrame:
    """One document of each group: that with the smallest doc_id, a null one only if there is no other.

    A row is known by doc_id and text: texts that share a doc_id stay or go each with its own group, and of rows
    that repeat both, one stays.
    """
    k1, k2 = text_key(F.col("text").cast("string"))
    rows = materialize(fingerprints(docs, k1=k1, k2=k2), "simhash-fingerprints")
    least = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")
    named = _name_groups(rows, F.min(least))
    # plain keys for join and dedup alike, so that texts are shuffled once
    plain = lambda col: F.coalesce(col, F.lit(-(1 << 63)))
    keep = named.groupBy("group").agg(F.min("least").alias("least"))
    keep = keep.select(plain(F.col("least.doc_id")).alias("id"), F.col("least.k1").alias("k1"), F.col("least.k2").alias("k2"))
    keyed = boxed(docs, id=plain(F.col("doc_id").cast("long")), k1=k1, k2=k2)
    kept = keyed.join(materialize(keep, "simhash-keep", named.count()).hint("merge"), keep.columns, "left_semi")
    return unboxed(kept.dropDuplicates(keep.columns), docs)
