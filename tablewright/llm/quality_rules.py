"""Quality rules: per-document base measures, then lines that too many documents of a host share.

Method. Lines are normalised (A-Z lower-cased, blanks collapsed) and hashed. For every host (`source`) the
distinct documents that hold a line are counted; exact copies of a text count as one document, so that
copying alone makes no boilerplate. A line is over the limit if more than `min_docs` documents hold it and more
than `max_share` of the host's or `max_docs`, whichever is less: the bar follows a small host's size and stands
still in a large one. Such lines are removed; a document is rejected as depleted if it lost lines and under
`min_left` of its words are left. The report and the filter have the same limits.

Cases. Null text counts as empty: no words, so the base rules reject it. Null source is a host of its own.
Repeated rows (same host and text) form one class and share its verdict; every input row is returned. An empty
table gives an empty result. Very long texts are measured whole, a slice of a batch at a time. Extra columns, whatever
their names, are ignored by `quality_rules` and kept by `filter_documents`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import BLANKS, boxed, each_text, materialize, unboxed, worker_cache
from tablewright.sources.scratch import discard

MIN_WORDS = 50
MIN_DOCS = 3
MAX_SHARE = 0.03
MAX_DOCS = 200
MIN_LEFT = 0.5
SYMBOLS = "#*$%&|<>"

_BLANK_BYTES = BLANKS.encode()


def repeated_words(words: list) -> int:
    """Words that lie in 3-word windows found twice or more in the text, the first place included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    n = end = 0
    for i, window in enumerate(windows):
        if seen[window] > 1:
            n += i + 3 - max(end, i)
            end = i + 3
    return n


def normal_line(line: bytes) -> bytes:
    return b" ".join(line.lower().split())


def line_hash(line: bytes) -> int:
    return xxhash.xxh3_64_intdigest(line) - (1 << 63)


def text_bits(text: bytes) -> tuple[int, int]:
    """128 bits of a text as two signed numbers."""
    key = xxhash.xxh3_128_intdigest(text)
    return (key >> 64) - (1 << 63), (key & ((1 << 64) - 1)) - (1 << 63)


def measure(text: bytes) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """n_words, blank characters, n_symbols, n_dup_lines, n_repeat_words, then hash and words of each line."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip(_BLANK_BYTES)]
    counts: dict[bytes, int] = {}
    for line in lines:
        normal = normal_line(line)
        counts[normal] = counts.get(normal, 0) + normal.count(b" ") + 1
    hashes = [line_hash(x) for x in counts]
    return (
        len(words),
        sum(text.count(x) for x in _BLANK_BYTES),
        sum(text.count(x) for x in SYMBOLS.encode()),
        len(lines) - len(set(lines)),
        repeated_words(words),
        hashes,
        list(counts.values()),
    )


_MEASURED = pa.schema(
    [(x, pa.int64()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("lines", pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())])))]
)
_MEASURED_DDL = (
    "doc_id BIGINT, host STRING, k1 BIGINT, k2 BIGINT, n_words BIGINT, word_chars BIGINT, n_symbols BIGINT, "
    "n_dup_lines BIGINT, n_repeat_words BIGINT, lines ARRAY<STRUCT<line: BIGINT, words: BIGINT>>"
)


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_cache()
    for batch in batches:
        texts = batch.column("text")
        chars = pc.utf8_length(texts).to_pylist()
        keys, rows = [], []
        for text, n_chars in zip(each_text(texts), chars):
            n_words, blanks, *rest, hashes, words = measure(text)
            keys.append(text_bits(text))
            rows.append((n_words, n_chars - blanks, *rest, [{"line": h, "words": w} for h, w in zip(hashes, words)]))
        out = [batch.column("doc_id"), batch.column("host")]
        out += [pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1)]
        out += [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_MEASURED)]
        yield pa.RecordBatch.from_arrays(out, ["doc_id", "host", "k1", "k2", *_MEASURED.names])


def _host() -> Column:
    """The source; null is a host of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))


def measured(docs: DataFrame) -> DataFrame:
    """A narrow row for each document: base measures, 128 bits of its text, and its distinct lines as hashes."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        _host().alias("host"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    return materialize(rows.mapInArrow(_measure_batches, _MEASURED_DDL), "quality-measured")


def lines_lost(rows: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, max_docs: int = MAX_DOCS) -> DataFrame:
    """Classes (host, text) that hold lines over the limit, with these lines and their words.

    One row stands for each class, so a text that a third of all rows repeat is one row here. Line counts
    are summed before the shuffle; a line that every document holds is one row of each task.
    """
    classes = materialize(rows.groupBy("host", "k1", "k2").agg(F.first("lines").alias("lines")), "quality-classes")
    sizes = classes.groupBy("host").agg(F.count("*").alias("docs"))
    held = classes.select("host", "k1", "k2", F.inline("lines"))
    bar = F.least(F.col("docs") * max_share, F.lit(float(max_docs)))
    over = (
        held.groupBy("host", "line")
        .agg(F.count("*").alias("holders"))
        .where(F.col("holders") > min_docs)
        .join(sizes, "host")
        .where(F.col("holders") > bar)
        .select("host", "line")
    )
    n = classes.count()
    over = materialize(over, "quality-over", n)
    lost = held.join(over, ["host", "line"])
    lost = lost.groupBy("host", "k1", "k2").agg(F.sum("words").alias("lost_words"), F.collect_set("line").alias("gone"))
    lost = materialize(lost, "quality-lost", n)
    discard(classes, over)
    return lost


def _base_failed(n_words: Column, n_repeat: Column, min_words: int) -> Column:
    return (n_words < min_words) | (100 * n_repeat > 50 * n_words)


def _depleted(n_words: Column, lost_words: Column, min_left: float) -> Column:
    return n_words - lost_words < n_words * min_left


def quality_rules(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    min_docs: int = MIN_DOCS,
    max_share: float = MAX_SHARE,
    max_docs: int = MAX_DOCS,
    min_left: float = MIN_LEFT,
) -> DataFrame:
    """One row for each document: measures, `base_failed`, lines and words lost, `kept`."""
    rows = measured(docs)
    lost = lines_lost(rows, min_docs, max_share, max_docs)
    lost_words = F.coalesce("lost_words", F.lit(0))
    failed = _base_failed(F.col("n_words"), F.col("n_repeat_words"), min_words)
    return rows.drop("lines").join(lost, ["host", "k1", "k2"], "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & ~_depleted(F.col("n_words"), lost_words, min_left)).alias("kept"),
        F.coalesce(F.when(F.col("gone").isNotNull(), F.size("gone")), F.lit(0)).cast("long").alias("frequent_lines"),
        lost_words.cast("long").alias("frequent_words"),
    )


def _row_facts(texts: pa.Array) -> pa.Array:
    rows = []
    for text in each_text(texts):
        words = text.split()
        rows.append((*text_bits(text), len(words), repeated_words(words)))
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], ["k1", "k2", "words", "repeat"])


def _without_lines(texts: pa.Array, gone: pa.Array) -> pa.Array:
    out = []
    for text, hashes in zip(each_text(texts), gone.to_pylist()):
        drop = set(hashes or ())
        lines = text.split(b"\n") if drop else [text]
        out.append(b"\n".join(x for x in lines if not drop or line_hash(normal_line(x)) not in drop).decode())
    return pa.array(out, pa.string())


def filter_documents(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    min_docs: int = MIN_DOCS,
    max_share: float = MAX_SHARE,
    max_docs: int = MAX_DOCS,
    min_left: float = MIN_LEFT,
) -> DataFrame:
    """The documents that the rules keep, without the lines over the limit; the columns of `docs` stay."""
    measures = measured(docs)
    lost = lines_lost(measures, min_docs, max_share, max_docs)
    discard(measures)
    facts = F.arrow_udf(_row_facts, "struct<k1: bigint, k2: bigint, words: bigint, repeat: bigint>").asNondeterministic()  # evaluated once
    rows = boxed(docs, host=_host(), facts=facts(F.coalesce("text", F.lit(""))))
    rows = rows.where(~_base_failed(F.col("facts.words"), F.col("facts.repeat"), min_words))
    lost = lost.withColumnRenamed("host", "lost_host")
    same = (F.col("host") == F.col("lost_host")) & (F.col("facts.k1") == F.col("k1")) & (F.col("facts.k2") == F.col("k2"))
    rows = rows.join(lost.hint("merge"), same, "left")  # it grows with the corpus: no candidate for a broadcast
    rows = rows.where(~_depleted(F.col("facts.words"), F.coalesce("lost_words", F.lit(0)), min_left))
    text = F.col("row")["text"]
    clean = F.arrow_udf(_without_lines, "string")(text, F.col("gone"))
    rows = rows.select("row", F.when(F.col("gone").isNull(), text).otherwise(clean).alias("left"))
    return unboxed(rows, docs, F.col("left"))
