"""Near-dedup by similarity, the SimHash operator's form for stages: five-word shingles, Jaccard similarity of 0.8 or more.

Why another form. `simhash` links fingerprints of 64 bits at three differing bits, as its query's contract says; most texts of
similarity 0.8 differ in more. Here fingerprints are longer, and a link is decided by the shingles themselves.

Fingerprint. A text's distinct shingles are hashed to 1104 bits; each bit's margin is how many more shingles set it than
not. The bits fall into 48 segments of 23, words of the Golay code of `simhash`.

Keys. A segment is decoded to nearby codewords: its word, and the words that differ in the `FLIPS` bits of least margin,
each go to their nearest codeword; the `NEAR` of them that cost the least margin stay. Three segments make a group; its
`KEYS` cheapest triples of codeword numbers are 36-bit keys. Pigeonhole: the errors between two fingerprints are spread over
16 groups, and one with few errors is enough to meet. Two texts of similarity s share a key with probability 0.98 at 0.8,
0.999 at 0.85 (measured, README); this is the only place where a pair can be missed. Texts that are not similar meet
by chance once in 2^36 / `KEYS`, so keys do not fill up as the corpus grows.

Links. Texts that meet are held against `SIMILARITY` by the hashes of all their shingles. At a key with few texts, all pairs are.
At a key with many, each is held against one of them, that which meets the most others; links are contracted. Where more
than one group is left at such a key, no pair within a group is compared, and the others are found by what they hold
beyond a centre text c of the key's largest group: if x is not similar to c and y is similar to x, then x and y share a
shingle outside c, or what y has of c is enough for both, which bounds y's size (`_beyond`). Shingles outside c are ordered by how many
texts at c hold them, rarest first, so that passages which many texts share come last. x meets only texts with which
it shares one of its first shingles, at places that leave both enough others to share (`_sharing`), or that are of such a
size; that is exact and keeps dense groups from becoming all their pairs.

Cases. Texts whose words are equal but for A-Z are one node, known by 64 bits. Fewer than five words: one shingle. Texts without
words, null ones too, are one node. A row is known by doc_id and text; of rows that repeat both, one stays. Null doc_ids
come after all others. Very long texts are hashed in blocks. An empty table gives an empty result. Extra columns, whatever
their names, are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import boxed, each_text, materialize, text_key, unboxed, worker_cache
from tablewright.llm.components import connected_components
from tablewright.llm.simhash import codewords, syndromes
from tablewright.sources.scratch import discard

WORDS = 5
#: Least similarity of a link, as a fraction.
SIMILARITY = (4, 5)
#: Groups of segments, and segments in each.
GROUPS, SEGMENTS = 16, 3
BITS = 23
#: Bits of least margin that are flipped, codewords kept for a segment, keys kept for a group.
FLIPS, NEAR, KEYS = 5, 6, 8
#: Texts at a key of which all pairs are compared.
FEW = 8
#: Texts whose keys are made together.
SLICE = 64

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_LANES = -(-GROUPS * SEGMENTS * BITS // 64)
_SPREAD = np.random.default_rng(42).integers(0, 1 << 63, _LANES, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
_PATTERNS = (np.arange(1 << FLIPS)[:, None] >> np.arange(FLIPS)) & 1


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.array([xxhash.xxh3_64_intdigest(x) for x in words], np.uint64)
    width = min(WORDS, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out = out * _FACTOR + hashes[i : i + len(out)]
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(29)))


def margins(found: np.ndarray) -> np.ndarray:
    """(segments, 23): how many more of the shingles set a bit than not."""
    ones = np.zeros(64 * _LANES, np.int64)
    for i in range(0, len(found), 255):  # as many as a byte can count
        bits = found[i : i + 255, None] * _SPREAD
        bits ^= bits >> np.uint64(32)
        bits *= np.uint64(0xBF58476D1CE4E5B9)
        bits ^= bits >> np.uint64(29)
        ones += np.unpackbits(bits.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return (2 * ones - len(found))[: GROUPS * SEGMENTS * BITS].reshape(-1, BITS)


def near_codewords(margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The `NEAR` codeword numbers of least cost for each row of 23 margins, and their costs: the margins they go against."""
    weight = np.abs(margin).astype(np.float32)
    word = (margin > 0) @ _PLACE
    weak = np.argsort(weight, axis=1, kind="stable")[:, :FLIPS]
    tried = word[:, None] ^ (_PLACE[weak] @ _PATTERNS.T)
    number = np.sort((tried ^ codewords()[syndromes(tried)]) >> 11, axis=1)
    against = ((number << 11) | syndromes(number << 11)) ^ word[:, None]
    cost = np.zeros(against.shape, np.float32)
    for i in range(BITS):
        cost += ((against >> (BITS - 1 - i)) & 1) * weight[:, i : i + 1]
    cost[:, 1:][number[:, 1:] == number[:, :-1]] = np.inf
    best = np.argsort(cost, axis=1, kind="stable")[:, :NEAR]
    return np.take_along_axis(number, best, 1), np.take_along_axis(cost, best, 1)


def golay_keys(margin: np.ndarray) -> list[list[int]]:
    """The distinct keys of each of the texts whose margins (texts, segments, 23) are given."""
    n = len(margin)
    number, cost = near_codewords(margin.reshape(-1, BITS))
    number, cost = (x.reshape(n, GROUPS, SEGMENTS, NEAR) for x in (number, cost))
    key = np.broadcast_to(np.arange(GROUPS, dtype=np.int64)[None, :, None], (n, GROUPS, 1))
    total = np.zeros((n, GROUPS, 1), np.float32)
    for k in range(SEGMENTS):
        key = ((key[..., None] << 12) | number[:, :, k, None, :]).reshape(n, GROUPS, -1)
        total = (total[..., None] + cost[:, :, k, None, :]).reshape(n, GROUPS, -1)
    best = np.argsort(total, axis=2, kind="stable")[:, :, :KEYS]
    real = np.isfinite(np.take_along_axis(total, best, 2))
    key = np.take_along_axis(key, best, 2)
    return [np.unique(key[i][real[i]]).tolist() for i in range(n)]


def similar(both: int | Column, a: int | Column, b: int | Column) -> bool | Column:
    """Whether sets of sizes `a` and `b` with `both` members in common are as similar as `SIMILARITY`."""
    return both * SIMILARITY[1] >= (a + b - both) * SIMILARITY[0]


def _node_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_cache()
    for batch in batches:
        nodes, sizes, keys = [], [], []
        for i in range(0, batch.num_rows, SLICE):
            waiting = []
            for text in each_text(batch.column("text").slice(i, SLICE)):
                words = text.lower().split()
                found = shingles(words)
                nodes.append(xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63))
                sizes.append(len(found))
                waiting.append(margins(found))
            made = golay_keys(np.stack(waiting))
            keys += [x if size else [] for x, size in zip(made, sizes[i:])]
        narrow = batch.drop_columns(["text"])
        out = [*narrow.columns, pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(out, [*narrow.schema.names, "node", "size", "keys"])


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_cache()
    for batch in batches:
        found = [shingles(x.lower().split()).tobytes() for x in each_text(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], ["node", "found"])


def _both(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def _set(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_py(), np.uint64)


def _linked(a: pa.Array, b: pa.Array) -> pa.Array:
    sets = ((_set(x), _set(y)) for x, y in zip(a, b))
    return pa.array([similar(_both(x, y), len(x), len(y)) for x, y in sets], pa.bool_())


_BEYOND = "struct<both: bigint, beyond: array<bigint>>"


def _beyond(a: pa.Array, b: pa.Array) -> pa.Array:
    """How much of set `a` lies in `b`, and what does not.

    Let x and y be similar, so that each holds at least 4/5 of the other's size in common. If they share a shingle outside c,
    the first that they share, in any order of all shingles, is among the first fifth of the size, and one more, of what x
    has beyond c, and of what y has, too: a set in common of at least 4/5 of x, less what lies in c, leaves no more
    out. If they share none, all that they share lies in c.
    """
    rows = []
    for x, c in zip(a, b):
        x = _set(x)
        more = np.setdiff1d(x, _set(c), assume_unique=True)
        rows.append({"both": len(x) - len(more), "beyond": more.view(np.int64).tolist()})
    return pa.array(rows, pa.struct([("both", pa.int64()), ("beyond", pa.list_(pa.int64()))]))


def _close(a: str | Column, b: str | Column) -> Column:
    """Sets of these sizes can be similar enough."""
    return F.least(a, b) * SIMILARITY[1] >= F.greatest(a, b) * SIMILARITY[0]


def _plain(col: Column) -> Column:
    """A key for join and dedup alike, so that texts are shuffled once."""
    return F.coalesce(col, F.lit(-(1 << 63)))


_KEY = ["near_id", "near_k1", "near_k2"]


def _row_key(doc_id: Column, text: Column) -> dict[str, Column]:
    return dict(zip(_KEY, (_plain(doc_id.cast("long")), *text_key(text.cast("string")))))


def _place(least: str = "least") -> list[Column]:
    return [_plain(F.col(f"{least}.doc_id")).alias("near_id"), F.col(f"{least}.k1").alias("near_k1"), F.col(f"{least}.k2").alias("near_k2")]


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, found) of the `wanted` nodes: all shingles, read anew from one text of each."""
    wanted = materialize(nodes.join(wanted.hint("merge"), "node", "left_semi").select("node", *_place()), "near-wanted")
    keys = _row_key(F.col("doc_id"), F.col("text"))
    texts = docs.select(*(v.alias(k) for k, v in keys.items()), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.join(wanted.hint("merge"), _KEY).select("node", "text").dropDuplicates(["node"])
    return materialize(texts.mapInArrow(_set_batches, "node BIGINT, found BINARY"), "near-sets")


def _with_sets(pairs: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, ...) and both sets, and a table to discard then. The many pairs of one text meet stored sets: such a key is split.

    Sort-merge joins are written by all tasks of their shuffle: fewer would hold the memory of many sorts at once.
    """
    of = lambda x: sets.select(F.col("node").alias(x), F.col("found").alias(f"set_{x}"))
    half = materialize(pairs.join(of("b").hint("merge"), "b"), "near-half")
    return half.join(of("a").hint("merge"), "a"), half


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar, by all their shingles."""
    rows, half = _with_sets(pairs, sets)
    links = materialize(rows.where(F.arrow_udf(_linked, "boolean")("set_a", "set_b")).select("a", "b"), "near-links")
    discard(half)
    return links


def _groups(links: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, group) of all `nodes`."""
    found = connected_components(links).withColumnRenamed("node", "of")
    named = nodes.join(found, nodes["node"] == found["of"], "left").select("node", F.coalesce("component", "node").alias("group"))
    return materialize(named, "near-groups", n)


def _first_pairs(members: DataFrame, weights: DataFrame) -> DataFrame:
    """(a, b): all pairs at keys with few nodes, and each node with the heaviest at keys with many."""
    few = members.where(F.col("n") <= FEW).select("key", "node", "size")
    other = few.toDF("key", "other", "size_b")
    pairs = few.join(other.hint("merge"), "key").where((F.col("node") > F.col("other")) & _close("size", "size_b"))
    many = members.where(F.col("n") > FEW)
    heaviest = many.join(weights.hint("merge"), "node").groupBy("key").agg(F.max(F.struct("weight", "node", "size")).alias("h"))
    heaviest = materialize(heaviest.select("key", F.col("h.node").alias("other"), F.col("h.size").alias("size_b")), "near-heaviest")
    stars = many.join(heaviest.hint("merge"), "key").where((F.col("node") != F.col("other")) & _close("size", "size_b"))
    both = pairs.select("node", "other").unionByName(stars.select("node", "other"))
    return materialize(both.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct(), "near-pairs")


def _class(size: Column) -> Column:
    """Sizes in steps of a twentieth."""
    return F.floor(F.log(size.cast("double")) / F.log(F.lit(1.05))).cast("int")


def _more_pairs(members: DataFrame, weights: DataFrame, groups: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links to centres, and the pairs (a, b) of different groups that can still be similar, at keys with many nodes."""
    placed = materialize(members.where(F.col("n") > FEW).join(groups.hint("merge"), "node").select("key", "node", "size", "group"), "near-placed")
    top = placed.groupBy("key", "group").agg(F.count("*").alias("n")).groupBy("key").agg(
        F.max(F.struct("n", "group"))["group"].alias("top"), F.count("*").alias("groups"))
    top = top.where("groups > 1").select(F.col("key").alias("at"), "top")
    apart = placed.join(top.hint("merge"), (F.col("key") == F.col("at")) & (F.col("group") != F.col("top")))
    apart = materialize(apart.select("node", "size", "group", "top").distinct(), "near-apart")
    own = placed.select("node", "size", "group").distinct().join(apart.select(F.col("top").alias("group")).distinct().hint("merge"), "group")
    centre = weights.join(groups.hint("merge"), "node").groupBy(F.col("group").alias("top")).agg(F.max(F.struct("weight", "node"))["node"].alias("b"))
    open_ = apart.unionByName(own.select("node", "size", "group", F.col("group").alias("top"))).withColumnRenamed("node", "a")
    open_ = materialize(open_.join(centre.hint("merge"), "top").where("a <> b"), "near-open")
    held, half = _with_sets(open_, sets)
    held = held.withColumn("f", F.arrow_udf(_beyond, _BEYOND).asNondeterministic()("set_a", "set_b"))
    held = held.select("a", "b", "size", "group", "top", (F.octet_length("set_b") / 8).cast("long").alias("size_b"), "f.both", "f.beyond")
    linked = similar(F.col("both"), F.col("size"), F.col("size_b"))
    held = materialize(held.withColumn("odd", (F.col("group") != F.col("top")) & ~linked), "near-beyond")
    discard(placed, apart, open_, half)
    links = held.where((F.col("group") != F.col("top")) & ~F.col("odd")).select("a", "b")
    return links, _sharing(held)


def _sharing(held: DataFrame) -> DataFrame:
    """The pairs (a, b) of an odd text and a text of another group that can be similar, by what they share beyond a centre.

    `held` (a, size, group, top, size_b, both, beyond, odd): texts at the centre of the group `top`, which has `size_b` shingles;
    `both` of a text's shingles lie in it, `beyond` do not. Where a pair's first common shingle has places i and j among
    `rest` and `rest_y`, it shares no more than 1 + min(rest - i, rest_y - j) beyond the centre: pairs whose sizes
    ask for more do not leave the join.
    """
    # a size s that shares with x nothing beyond the centre: 4/9 (size + s) <= both
    all_, odd = SIMILARITY[0] + SIMILARITY[1], F.col("odd")
    least = F.greatest(F.lit(1), F.ceil(F.col("size") * SIMILARITY[0] / SIMILARITY[1]))
    most = F.floor(F.col("both") * all_ / SIMILARITY[0] - F.col("size"))
    none = F.array().cast("array<int>")
    asked = F.when(odd & (most >= least), F.sequence(_class(least), _class(F.greatest(most, least)))).otherwise(none)
    fits = (F.col("both") * SIMILARITY[1] >= F.col("size") * SIMILARITY[0]) & (F.col("size") < F.col("size_b"))
    own = F.when(fits, F.array(_class(F.col("size")))).otherwise(none)
    token = lambda kind, x: F.xxhash64(F.lit(kind), "top", x)
    named = ["a", "size", "group", "both", "rest", "odd"]
    held = held.withColumn("rest", F.col("size") - F.col("both"))
    each = held.select(*named, "top", F.explode("beyond").alias("shingle")).withColumn("token", token("shingle", F.col("shingle"))).drop("shingle")
    each = materialize(each, "near-each")
    often = materialize(each.groupBy("token").agg(F.count("*").alias("n")), "near-often")
    place = F.row_number().over(Window.partitionBy("a", "top").orderBy("n", "token"))
    first = each.join(often.hint("merge"), "token").withColumn("place", place)
    first = first.where((F.col("n") > 1) & (F.col("place") <= F.floor(F.col("size") * (SIMILARITY[1] - SIMILARITY[0]) / SIMILARITY[1]) + 1))
    first = materialize(first.select(*named, "token", "place"), "near-first")
    sized = lambda found: held.select(*named, F.explode(found).alias("class"), "top").select(*named, token("size", F.col("class")).alias("token"), (F.col("rest") + 1).alias("place"))
    x = materialize(first.unionByName(sized(asked)).where(odd), "near-asked")
    y = materialize(first.unionByName(sized(own)), "near-has")
    y = y.select(F.col("a").alias("b"), *(F.col(c).alias(f"{c}_y") for c in ("size", "group", "both", "rest", "place")), "token")
    most = F.least("both", "both_y") + 1 + F.least(F.col("rest") - F.col("place"), F.col("rest_y") - F.col("place_y"))
    enough = most * all_ >= (F.col("size") + F.col("size_y")) * SIMILARITY[0]
    pairs = x.join(y.hint("merge"), "token").where((F.col("group") != F.col("group_y")) & _close("size", "size_y") & enough)
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    discard(each, often, first)
    return pairs


def group_nodes(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, group) of the stored table `nodes` (node, size, keys, least); `least` is the place of its text in `docs`."""
    n = nodes.count()
    held = nodes.select("node", "size", F.explode("keys").alias("key"))
    met = materialize(held.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "near-met")
    members = materialize(held.join(met.hint("merge"), "key"), "near-members")
    weights = materialize(members.groupBy("node").agg(F.sum("n").alias("weight")), "near-weights")
    sets = _sets(docs, nodes, weights.select("node"))
    pairs = _first_pairs(members, weights)
    links = _links(pairs, sets)
    groups = _groups(links, weights.select("node"), n)
    centred, more = _more_pairs(members, weights, groups, sets)
    more = materialize(more.join(pairs.hint("merge"), ["a", "b"], "left_anti"), "near-more")
    links = links.unionByName(centred).unionByName(_links(more, sets))
    found = _groups(materialize(links, "near-edges", n), nodes, n)
    discard(met, members, weights, sets, pairs, more, groups, links)
    return found


def first_of_each_group(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id, a null one only if there is no other."""
    k1, k2 = text_key(F.col("text").cast("string"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.mapInArrow(_node_batches, "doc_id BIGINT, k1 BIGINT, k2 BIGINT, node BIGINT, size BIGINT, keys ARRAY<BIGINT>")
    rows = materialize(rows, "near-rows")
    least = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")
    nodes = rows.groupBy("node").agg(F.first("size").alias("size"), F.first("keys").alias("keys"), F.min(least).alias("least"))
    nodes = materialize(nodes, "near-nodes")
    groups = group_nodes(docs, nodes)
    keep = nodes.select("node", "least").join(groups, "node").groupBy("group").agg(F.min("least").alias("least")).select(*_place())
    kept = boxed(docs, **_row_key(F.col("doc_id"), F.col("text")))
    kept = kept.join(materialize(keep, "near-keep", nodes.count()).hint("merge"), _KEY, "left_semi")
    return unboxed(kept.dropDuplicates(_KEY), docs)
