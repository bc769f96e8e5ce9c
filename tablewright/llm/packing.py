"""Best-fit packing with large-item matching.

Method. Documents become token pieces of at most `capacity`. Only how many pieces have each length matters for
the plan, so the plan is made on the driver from at most `capacity` counts, for any number of pieces: pieces
above a third of the capacity meet at most twice in a sequence (three cannot fit) and are matched greedily, the
longest with the longest that fits beside it; the others go, longest first, into the tightest gap that takes
them, and open new sequences when no gap does. Equal steps are done as one, so the plan is a list of runs of
equal sequences whose length depends on the capacity only; it is broadcast.

Placement. Every piece gets its rank among the pieces of its length: rank in a bucket of that length by a window, plus the
sizes of the buckets before it. The rank tells run, sequence and offset. A length has one bucket for each
`BUCKET_ROWS` pieces that it has, so no window grows with the data; sizes of buckets are summed by Spark and
never come to the driver. What does, and is broadcast, is bounded by the capacity: one count for each length, and the plan.

Cases. Null text counts as empty: one piece that holds the end token only. Repeated rows are pieces of their own. Pieces of
equal length may change places; ties are ordered by doc_id, piece, start and checksum. A long text is tokenized whole. An
empty table gives an empty result. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import materialize, worker_cache

CAPACITY = 1024
END_ID = 2
#: Pieces of one window.
BUCKET_ROWS = 20_000
#: Parts of texts whose ids a Python worker keeps, and again as many from before; at about 160 bytes each.
KEPT_WORDS = 750_000
#: Texts that are taken together.
SLICE = 200
#: Marks that often end a word; none starts a contraction.
ENDS = ".,;:!?"
#: The cut mark, and white space other than single blanks and line breaks between two other characters.
ODD_BLANKS = ["\0", "  ", " \n", "\n ", "\n\n", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Known(dict):
    """Ids of parts; a part that is not there is learned."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, part: str) -> bytes:
        self[part] = ids = self.learn(part)
        return ids


class TokenIds:
    """Little-endian ids of texts by a byte-level BPE file of `tokenizers`.

    Such a tokenizer cuts a text before every single blank between two other characters and on both sides of
    every single line break between two others, and merges inside each part alone. So a text that has no other
    white space is cut there, and ids of its parts are kept and joined; any other text, and one that holds a
    special token's string, takes the tokenizer's own way.
    """

    def __init__(self, path: str, kept_words: int = KEPT_WORDS):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.kept_words = kept_words
        self.tokenizer = Tokenizer.from_file(path)
        self.uncut = [*ODD_BLANKS, *(x.content for x in self.tokenizer.get_added_tokens_decoder().values())]
        self.merge = self.tokenizer.model.tokenize
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}  # bytes that a byte-level vocabulary shows as themselves
        self.shown = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - plain))}
        #: Ids of parts met since the last turn, and in the turn before it.
        self.known, self.older = _Known(self._learn), {}

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        """Ids of letters after one blank at most: one part to the tokenizer, so its model reads them directly."""
        shown = "\u0120" + word[1:] if word[0] == " " and word.isascii() else word.encode().decode("latin-1").translate(self.shown)
        return array("I", [x.id for x in self.merge(shown)]).tobytes()

    def _learn(self, part: str) -> bytes:
        """Letters and a mark behind them are parts of their own to the tokenizer, so ids of the letters serve both."""
        if (ids := self.older.get(part)) is not None:
            return ids
        if part[-1] in ENDS and part[1:-1].isalpha():
            return self.known[part[:-1]] + self.known[part[-1]]
        if (part[1:] if part[0] == " " else part).isalpha():
            return self._word(part)
        return self._plain([part])[0]

    def many(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.kept_words:
            self.known, self.older = _Known(self._learn), dict(self.known)
        ids_of, out = self.known.__getitem__, []
        for text in texts:
            if not text or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in self.uncut):
                out.append(self._plain([text])[0])
            else:
                out.append(b"".join(map(ids_of, text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0"))))
        return out


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; all but the first are full."""
    first = n - (n - 1) // capacity * capacity if n else 0
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


_PIECES = "doc_id BIGINT, piece INT, start BIGINT, length BIGINT, ids_crc32 BIGINT"


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, kept_words: int = KEPT_WORDS) -> DataFrame:
    """Narrow rows, one for each piece; one pass without a shuffle."""
    path = tokenizer or default_tokenizer()
    end = np.array([END_ID], "<u4").tobytes()

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = worker_cache(("ids", path, kept_words), lambda: TokenIds(path, kept_words))
        for batch in rows:
            out: list[tuple] = []
            texts = batch.column("text")
            found = chain.from_iterable(ids_of.many(texts.slice(i, SLICE).to_pylist()) for i in range(0, len(texts), SLICE))
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), found):
                ids += end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    out.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(batches, _PIECES)


def plan_runs(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Runs of equal sequences: (how many, ((length, pieces of it), ...)). `counts`: pieces by length."""
    left = {k: v for k, v in counts.items() if v}
    if any(not 0 < k <= capacity for k in left):
        raise ValueError("lengths must be from 1 to the capacity")
    large = sorted((x for x in left if 3 * x > capacity), reverse=True)
    gaps: dict[int, list[tuple[int, tuple]]] = {}
    for x in large:
        for mate in (y for y in large if y <= x and x + y <= capacity):
            n = left[x] // 2 if mate == x else min(left[x], left[mate])
            if n:
                left[x] -= n
                left[mate] -= n
                gaps.setdefault(capacity - x - mate, []).append((n, ((x, 2),) if mate == x else ((x, 1), (mate, 1))))
            if not left[x]:
                break
        if left[x]:
            gaps.setdefault(capacity - x, []).append((left[x], ((x, 1),)))
            left[x] = 0
    for x in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        todo = left[x]
        for gap in sorted(g for g in gaps if g >= x):
            fits, runs = gap // x, gaps.pop(gap)
            while runs and todo:
                n, held = runs.pop()
                full = min(n, todo // fits)
                todo -= full * fits
                if full:
                    gaps.setdefault(gap - fits * x, []).append((full, (*held, (x, fits))))
                n -= full
                if n and todo:  # fewer than fill one sequence
                    gaps.setdefault(gap - todo * x, []).append((1, (*held, (x, todo))))
                    todo, n = 0, n - 1
                if n:
                    runs.append((n, held))
            if runs:
                gaps[gap] = gaps.get(gap, []) + runs
            if not todo:
                break
        fits = capacity // x
        if todo // fits:
            gaps.setdefault(capacity - fits * x, []).append((todo // fits, ((x, fits),)))
        if todo % fits:
            gaps.setdefault(capacity - todo % fits * x, []).append((1, ((x, todo % fits),)))
    return [run for gap in sorted(gaps) for run in gaps[gap]]


def plan_rows(runs: list[tuple[int, tuple[tuple[int, int], ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end of ranks, first sequence, pieces in each sequence, offset in it)."""
    rows, used, sequence = [], {}, 0
    for n, held in runs:
        offset = 0
        for length, each in held:
            first = used.get(length, 0)
            used[length] = first + n * each
            rows.append((length, first, used[length], sequence, each, offset))
            offset += length * each
        sequence += n
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """`pieces` (`token_pieces`) with `sequence_id` and `offset`. `pieces` is read three times and must be a stored table."""
    spark = pieces.sparkSession
    counts = dict(pieces.groupBy("length").agg(F.count("*")).collect())  # `capacity` rows at most
    plan = plan_rows(plan_runs(counts, capacity))
    plan_df = spark.createDataFrame(plan, "_length LONG, _first LONG, _end LONG, _sequence LONG, _each LONG, _offset LONG")
    dealing = spark.createDataFrame([(k, n // bucket_rows + 1) for k, n in counts.items()], "_long LONG, _buckets LONG")
    hashed = F.xxhash64("doc_id", "piece", "start", "ids_crc32")
    dealt = pieces.join(F.broadcast(dealing), F.col("length") == F.col("_long")).withColumn("_bucket", F.pmod(hashed, "_buckets")).drop("_long", "_buckets")
    sizes = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    by = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = materialize(sizes.select("length", "_bucket", F.coalesce(F.sum("_n").over(by), F.lit(0)).alias("_before")), "pack-buckets")
    order = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("_in", F.row_number().over(order) - 1).join(before, ["length", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_in"))
    here = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_end"))
    at = F.col("_rank") - F.col("_first")
    return ranked.join(F.broadcast(plan_df), here).select(
        *pieces.columns,
        (F.col("_sequence") + F.floor(at / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_offset") + at % F.col("_each") * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, kept_words: int = KEPT_WORDS) -> DataFrame:
    """One row for each piece of each document, with its sequence and its place there.

    `kept_words` trades workers' memory for time; results do not depend on it.
    """
    return pack(materialize(token_pieces(docs, tokenizer, capacity, kept_words), "pack-pieces"), capacity)
