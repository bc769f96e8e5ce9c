"""Dense, sparse and fused retrieval, and what is built from the hits."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.sources.scratch import store

K1, B = 1.2, 0.75
#: Vectors of a block on either side; a pair of blocks is scored at once.
QUERY_BLOCK, VECTOR_BLOCK = 512, 4096
#: Texts of a block, and about how many bytes.
TEXT_BLOCK, TEXT_BLOCK_BYTES = 2048, 1 << 19
#: Bytes of texts that are scored together, which bounds a worker's arrays.
SCORED_BYTES = 1 << 16


def normal_query(text: Column) -> Column:
    """Lower case, anything but letters and digits as one blank."""
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def expanded(text: Column, synonyms: dict[str, str]) -> Column:
    """Words that have a synonym are followed by it."""
    table = F.create_map(*(F.lit(x) for pair in synonyms.items() for x in pair))
    both = F.transform(F.split(text, " "), lambda w: F.concat_ws(" ", w, F.try_element_at(table, w)))
    return F.array_join(both, " ")


def _top(rows: DataFrame, k: int, by: list[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*by))
    return rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def _blocks(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Rows (key, vector) as blocks of `size` at most: ids and unit vectors as bytes."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                ids = np.array(part.column(0).to_pylist(), np.int64)
                vectors = np.array(part.column(1).to_pylist(), np.float64)
                vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([vectors.tobytes()], pa.binary())], ["ids", "vectors"])

    return rows.select(F.col(key).cast("long").alias("id"), "vector").where("id IS NOT NULL AND vector IS NOT NULL").mapInArrow(batches, "ids BINARY, vectors BINARY")


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = 5, skip_self: bool = True) -> DataFrame:
    """(query_id, id, score, rank): exact cosine top-k of a stated query set against all vectors; `skip_self`: but for its own id.

    Both sides are packed into stored blocks; a pair of blocks is one matrix product and sends k rows for each query to the
    shuffle at most. Nothing comes to the driver; Spark broadcasts a side only if its size is below its threshold.
    """
    left = store(_blocks(queries, "query_id", QUERY_BLOCK), "query-blocks").toDF("q_ids", "q_vectors")
    right = store(_blocks(vectors, "id", VECTOR_BLOCK), "vector-blocks")
    found = right.crossJoin(left).mapInArrow(_scorer(k, skip_self), "query_id BIGINT, id BIGINT, score DOUBLE")
    return _top(found, k, [F.desc("score"), F.asc("id")])


def _scorer(k: int, skip_self: bool):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for row in range(batch.num_rows):
                ids, right, names, left = (np.frombuffer(batch.column(c)[row].as_py(), t) for c, t in (("ids", np.int64), ("vectors", np.float64), ("q_ids", np.int64), ("q_vectors", np.float64)))
                scores = np.round(left.reshape(len(names), -1) @ right.reshape(len(ids), -1).T, 6)
                if skip_self:
                    scores[names[:, None] == ids[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
                q, s = np.repeat(names, order.shape[1]), np.take_along_axis(scores, order, 1).ravel()
                real = s > -np.inf
                yield pa.RecordBatch.from_arrays([pa.array(q[real]), pa.array(ids[order].ravel()[real]), pa.array(s[real])], ["query_id", "id", "score"])

    return batches


def terms(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term) for each word of letters."""
    found = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z]+"), lambda t: t != "")
    return rows.select(key, F.explode(found).alias("term"))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z]+"), "")


def _merged(docs: DataFrame) -> DataFrame:
    """(id, text, copies): rows that share an id as one text, their words side by side; rows without an id stay apart.

    Only ids are shuffled, and the texts of repeated ones.
    """
    docs = docs.select("id", F.lower(F.coalesce(F.col("text"), F.lit(""))).alias("text"))
    single = docs.withColumn("copies", F.lit(1).cast("long"))
    again = store(docs.where("id IS NOT NULL").groupBy("id").count().where("count > 1").select("id"), "repeated-ids")
    if again.isEmpty():
        return single
    joined = docs.join(again, "id").groupBy("id").agg(F.array_join(F.collect_list("text"), " ").alias("text"), F.count("*").alias("copies"))
    return single.join(again, "id", "left_anti").unionByName(joined)


def bm25_topk(queries: DataFrame, docs: DataFrame, k: int = 5, k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, id, score, rank). `queries` (query_id, text), `docs` (id, text); rows that share an id are one document.

    Two scans of the texts. The first counts the documents of each query term in its tasks. The second scores blocks of
    texts against stored blocks of queries, and a task sends k rows for each query to the shuffle at most: neither postings nor
    scores of other documents leave it. Documents without an id count, but are no hits.
    """
    asked = store(terms(queries, "query_id", "text").distinct(), "asked")
    wanted = store(asked.select("term").distinct().union(asked.sparkSession.createDataFrame([("",)], "term STRING")), "asked-terms")
    docs = _merged(docs)
    words = docs.select("id", "copies", _words(F.col("text")).alias("words"))
    spread = words.select("id", "copies", F.size("words").alias("dl"), F.explode(F.array_append(F.array_distinct("words"), F.lit(""))).alias("term"))
    df = F.count("id") + F.max(F.col("id").isNull().cast("long"))
    counts = spread.join(wanted, "term").groupBy("term").agg(df.alias("df"), F.sum("copies").alias("n"), F.sum("dl").alias("total"))
    counts = store(counts, "term-counts")
    corpus = counts.where("term = ''").select("n", F.try_divide("total", "n").alias("mean"))  # one row; of all documents
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = asked.join(counts.select("term", "df"), "term").crossJoin(F.broadcast(corpus)).select("query_id", "term", idf.alias("idf"), "mean")
    block = F.pmod(F.xxhash64("query_id"), F.lit(asked.select("query_id").distinct().count() // QUERY_BLOCK + 1)).alias("block")
    asked = asked.groupBy(block).agg(F.collect_list(F.struct("query_id", "term", "idf")).alias("asked"), F.first("mean").alias("mean"))
    asked = store(asked, "asked-blocks")
    kind, name = docs.schema["id"].dataType, queries.schema["query_id"].dataType
    texts = docs.where("id IS NOT NULL").select("id", "text").mapInArrow(_text_blocks, f"ids ARRAY<{kind.simpleString()}>, texts ARRAY<STRING>")
    found = texts.crossJoin(asked).mapInArrow(_term_scorer(k, k1, b), f"query_id {name.simpleString()}, id {kind.simpleString()}, score DOUBLE")
    return _top(found, k, [F.desc("score"), F.asc("id")])


def _text_blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) as blocks of some thousand, or of some hundred thousand bytes."""
    for batch in parts:
        ids, texts = (batch.column(c) for c in ("id", "text"))
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            full = np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXT_BLOCK_BYTES)
            to = int(min(max(full, at + 1), at + TEXT_BLOCK, batch.num_rows))
            lists = [pa.ListArray.from_arrays(pa.array([0, to - at], pa.int32()), x.slice(at, to - at)) for x in (ids, texts)]
            yield pa.RecordBatch.from_arrays(lists, ["ids", "texts"])
            at = to


class _Asked:
    """A block of queries: the terms' queries and weights as flat arrays, and the k best hits so far."""

    def __init__(self, rows: pa.Scalar, mean: float) -> None:
        query, term, self.idf = (rows.values.field(c) for c in ("query_id", "term", "idf"))
        query, term = query.dictionary_encode(null_encoding="encode"), term.dictionary_encode()
        self.names, self.mean = query.dictionary, mean
        order = np.argsort(term.indices.to_numpy(), kind="stable")
        self.query, self.idf = query.indices.to_numpy()[order].astype(np.int64), self.idf.to_numpy()[order]
        self.many = np.bincount(term.indices.to_numpy(), minlength=len(term.dictionary))
        self.start = np.cumsum(self.many) - self.many
        self.place = {w: i for i, w in enumerate(term.dictionary.cast(pa.binary()).to_pylist())}
        self.least = np.full(len(self.names), 0.0)  # a score must reach it
        self.hits: tuple[np.ndarray, ...] | None = None

    def add(self, ids: np.ndarray, texts: list[bytes], k: int, k1: float, b: float) -> None:
        length, known, get = np.zeros(len(texts), np.int64), [], self.place.get
        for i, text in enumerate(texts):
            found = re.findall(rb"[a-z]+", text)
            length[i] = len(found)
            known.append([x for x in map(get, found) if x is not None])
        doc = np.repeat(np.arange(len(texts)), [len(x) for x in known])
        term = np.fromiter((x for row in known for x in row), np.int64, len(doc))
        posting, tf = np.unique(doc * len(self.many) + term, return_counts=True)
        doc, term = posting // len(self.many), posting % len(self.many)
        part = tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[doc] / self.mean))
        many = self.many[term]
        at = np.repeat(self.start[term] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        cell = np.repeat(doc * len(self.names), many) + self.query[at]
        raw = np.bincount(cell, np.repeat(part, many) * self.idf[at], len(texts) * len(self.names)).reshape(len(texts), -1)
        score = np.where(raw > 0, np.round(raw, 6), -1.0)
        if self.hits is None and len(texts) > k:
            self.least = np.maximum(self.least, np.partition(score, -k, axis=0)[-k])
        row, query = np.nonzero(score >= self.least)
        if not len(row):
            return
        new = query, score[row, query], ids[row]
        query, score, ids = new if self.hits is None else (np.concatenate(x) for x in zip(self.hits, new))
        order = np.lexsort((ids, -score, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        kept = order[rank < k]
        self.hits = query[rank < k], score[kept], ids[kept]
        last = rank == k - 1
        self.least[query[last]] = score[order[last]]


def _term_scorer(k: int, k1: float, b: float):
    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, _Asked] = {}
        kind = None
        for batch in rows:
            for row in range(batch.num_rows):
                ids, texts, block, asked, mean = (batch.column(c)[row] for c in ("ids", "texts", "block", "asked", "mean"))
                if block.as_py() not in blocks:
                    blocks[block.as_py()] = _Asked(asked, mean.as_py())
                kind = ids.values.type
                names, found = np.array(ids.as_py()), texts.values.cast(pa.binary()).to_pylist()
                part = np.cumsum([len(x) for x in found]) // SCORED_BYTES
                cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(found)]
                for at, to in zip(cuts, cuts[1:]):
                    blocks[block.as_py()].add(names[at:to], found[at:to], k, k1, b)
        for x in blocks.values():
            if x.hits is not None:
                query, score, ids = x.hits
                yield pa.RecordBatch.from_arrays([x.names.take(pa.array(query)), pa.array(ids.tolist(), kind), pa.array(score)], ["query_id", "id", "score"])

    return batches


def fused(dense: DataFrame, sparse: DataFrame, weight: float = 0.5, k: int = 5) -> DataFrame:
    """Min-max scaled scores of both lists of a query, weighted and added; a missing score is zero."""
    by = Window.partitionBy("query_id")

    def scaled(rows: DataFrame, name: str) -> DataFrame:
        low, high = F.min("score").over(by), F.max("score").over(by)
        return rows.select("query_id", "id", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.lit(1.0)).alias(name))

    both = scaled(dense, "d").join(scaled(sparse, "s"), ["query_id", "id"], "full_outer")
    score = weight * F.coalesce("d", F.lit(0.0)) + (1 - weight) * F.coalesce("s", F.lit(0.0))
    return _top(both.select("query_id", "id", F.round(score, 6).alias("score")), k, [F.desc("score"), F.asc("id")])


def context(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, context): hits in rank order, whole, each with its citation. Stored hits have a known size, so texts are shuffled only for very many."""
    rows = store(hits, "hits").join(docs, "id").select("query_id", "rank", F.concat(F.lit("["), "id", F.lit("] "), "text").alias("c"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "c"))), lambda x: x["c"])
    return rows.groupBy("query_id").agg(F.array_join(ordered, "\n").alias("context"))


def prompt(system: str, history: Column, passages: Column, question: Column) -> Column:
    return F.concat(F.lit(f"System: {system}\nHistory: "), history, F.lit("\nContext: "), passages, F.lit("\nQuestion: "), question)


def grounded(answer: Column, source: Column, limit: float, fallback: str) -> tuple[Column, Column]:
    """Share of the answer's distinct words that the source holds, and the answer, or the fallback below the limit."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z]+"), lambda t: t != ""))
    share = F.coalesce(F.try_divide(F.size(F.array_intersect(words(answer), words(source))), F.size(words(answer))), F.lit(0.0))
    return share, F.when(share < limit, F.lit(fallback)).otherwise(answer)


#: Words that stand for something named before.
PRONOUNS = ("it", "its", "that", "this", "they", "them")


def clarified(question: Column, before: Column, topic: Column | None = None) -> tuple[Column, Column]:
    """A follow-up question with its pronouns resolved, and whether to ask back first.

    A question that holds a pronoun gets the topic of the turn before behind it, by default that turn's longest word (the
    first of equals); without such a turn it is ambiguous.
    """
    words = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z]+"), lambda t: t != "")
    vague = F.arrays_overlap(words(question), F.array(*map(F.lit, PRONOUNS)))
    if topic is None:
        longest = F.array_max(F.transform(words(before), lambda w, i: F.struct(F.length(w), -i, w.alias("w"))))
        topic = F.coalesce(longest["w"], F.lit(""))
    known = topic != ""
    return F.when(vague & known, F.concat(question, F.lit(" ("), topic, F.lit(")"))).otherwise(question), vague & ~known
