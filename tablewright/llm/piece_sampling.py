"""SentencePiece encoding by sampling, and lossless decoding.

Model. Pieces come from a SentencePiece file. A segmentation has a probability in proportion to the product of
its pieces' weights, (rank + 1)^-alpha by merge rank: the higher alpha, the more often few frequent pieces win.
Characters that no piece holds, and the blank's mark itself, are spelled in byte pieces.

Sampling. Forward filtering sums the weights of all ways to each place of the lattice; backward sampling walks
from the end, choosing each piece by its share. Choices are numbers hashed from (seed, row key, chunk of the
text, step), so a row's sample depends on nothing but its key, its text and the seed, whatever the
partitions. Where no piece holds two neighbouring characters side by side, every segmentation is cut; a text's
lattice falls into chunks there, which are sampled exactly alone. The distinct chunks of a slice of texts are
filtered once and together; each occurrence is sampled for itself.

Lossless. A leading blank mark is added, as by the library, and taken off on decoding; decoding gives the text
back, byte for byte.

Cases. Null text counts as empty and has no ids. Null doc_id is a key of its own. Repeated rows give equal
samples. A text of more than `SLICE` characters is cut between chunks, so its lattice is made piece by piece with the same
result. A chunk may be of any length. An empty table gives an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import worker_cache

ALPHA = 1.0
SEED = 7
MARK = "\u2581"
#: Stands for the mark character of a text inside this module; no text can hold it.
ESCAPE = "\ud800"
NULL_KEY = 0x6E756C6C
#: Log weight of a character spelled in bytes; it is its only reading.
SPELLED = -20.0
#: Characters of text that are sampled together.
SLICE = 6_000_000


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Numbered(dict):
    """Numbers keys as they come."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Sampler:
    """The pieces as a trie over character classes, and what is done with it."""

    def __init__(self, path: str, alpha: float = ALPHA):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        pieces = {model.id_to_piece(i): (i, -alpha * np.log(rank + 1.0)) for rank, i in enumerate(plain)}
        self.raw = {i: bytes([b]) for b, i in self.bytes.items()} | {v[0]: x.replace(MARK, " ").encode() for x, v in pieces.items()}
        # class 0: characters that are no piece of their own; they are spelled
        chars = sorted(x for x in pieces if len(x) == 1)
        self.n_classes = len(chars) + 1
        self.class_of = np.zeros(0x110000, np.int16)
        self.class_of[[ord(c) for c in chars]] = np.arange(1, self.n_classes)
        #: Whether a piece holds two classes side by side; elsewhere every segmentation is cut.
        self.beside = np.zeros((self.n_classes, self.n_classes), bool)
        nodes, edges = {"": 0}, {}
        for piece in pieces:
            classes = self.class_of[[ord(c) for c in piece]].tolist()
            if 0 in classes:
                raise ValueError(f"a character of piece {piece!r} is no piece")
            self.beside[classes[:-1], classes[1:]] = True
            for k, c in enumerate(classes):
                node = nodes.setdefault(piece[: k + 1], len(nodes))
                edges[nodes[piece[:k]] * self.n_classes + c] = node
        self.longest = max(map(len, pieces))
        self.edge = np.array(sorted(edges), np.int64)
        self.target = np.array([edges[k] for k in self.edge.tolist()], np.int32)
        self.piece_at = np.full(len(nodes), -1, np.int32)
        self.weight_at = np.zeros(len(nodes))
        for piece, (i, weight) in pieces.items():
            self.piece_at[nodes[piece]], self.weight_at[nodes[piece]] = i, weight

    def _ends(self, marked: str) -> np.ndarray:
        """Where each chunk ends but for the last."""
        classes = self.class_of[np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32)]
        return np.flatnonzero(~self.beside[classes[:-1], classes[1:]]) + 1

    def pieces(self, text: str, limit: int) -> Iterator[tuple[str, int]]:
        """A text with its marks, cut between chunks into pieces of at most `limit` characters, or of one chunk; the number of each one's first chunk."""
        marked = MARK + text.replace(MARK, ESCAPE).replace(" ", MARK) if text else ""
        if len(marked) <= limit:
            yield marked, 0
            return
        borders = np.append(self._ends(marked), len(marked))
        start = first = 0
        while start < len(marked):
            last = max(int(np.searchsorted(borders, start + limit, "right")) - 1, first)
            yield marked[start : borders[last]], first
            start, first = int(borders[last]), last + 1

    def chunks(self, pieces: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Distinct chunks, the chunk numbers of all pieces one after another, and how many each has."""
        numbers, own, counts = _Numbered(), [], []
        for marked in pieces:
            found: list[int] = []
            if marked:
                ends = self._ends(marked).tolist()
                found = [numbers[marked[i:j]] for i, j in zip([0, *ends], [*ends, len(marked)])]
            own.append(np.array(found, np.int32))
            counts.append(len(found))
        return list(numbers), np.concatenate(own) if own else np.zeros(0, np.int32), np.array(counts, np.int64)

    def lattice(self, chunks: list[str]) -> tuple[np.ndarray, ...]:
        """Forward filtering over all chunks at once.

        Returns the last place of each chunk, and, by place, its first way; by way (longest first, those of a place
        side by side) cumulated share, piece id (negative: -1 minus a character to spell) and the place before, -1
        at the chunk's start.
        """
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        stops = np.cumsum(lengths)
        codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = self.class_of[codes].astype(np.int64)
        begin, stop = np.repeat(stops - lengths, lengths), np.repeat(stops, lengths)
        at, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        spelled = np.flatnonzero(classes == 0)
        starts, ends, ids, weights = [spelled], [spelled], [-1 - codes[spelled].astype(np.int64)], [np.full(len(spelled), SPELLED)]
        for k in range(self.longest):
            live = at + k < stop[at]
            at, node = at[live], node[live]
            key = node * self.n_classes + classes[at + k]
            found = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
            hit = self.edge[found] == key
            at, node = at[hit], self.target[found[hit]].astype(np.int64)
            if not len(at):
                break
            whole = self.piece_at[node] >= 0
            starts.append(at[whole])
            ends.append(at[whole] + k)
            ids.append(self.piece_at[node[whole]].astype(np.int64))
            weights.append(self.weight_at[node[whole]])
        start, end, ids, weight = map(np.concatenate, (starts, ends, ids, weights))
        depth = end - begin[end]
        order = np.lexsort((start, end, depth))
        start, end, ids, weight, depth = start[order], end[order], ids[order], weight[order], depth[order]
        head = np.flatnonzero(np.concatenate(([True], end[1:] != end[:-1])))
        group = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(end))))
        first = np.zeros(len(codes), np.int64)
        first[end[head]] = head
        ways, share = np.zeros(len(codes)), np.empty(len(end))  # log of all ways to a place
        inside = start > begin[start]
        bounds = np.searchsorted(depth, np.arange(depth[-1] + 2)) if len(depth) else [0]
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            value = weight[lo:hi] + np.where(inside[lo:hi], ways[start[lo:hi] - 1], 0.0)
            heads = head[np.searchsorted(head, lo) : np.searchsorted(head, hi)] - lo
            own = group[lo:hi] - group[lo]
            top = np.maximum.reduceat(value, heads)
            value = np.exp(value - top[own])
            total = np.add.reduceat(value, heads)
            ways[end[lo:hi][heads]] = top + np.log(total)
            share[lo:hi] = value / total[own]
        nth = np.arange(len(end)) - head[group]
        for k in range(1, int(nth.max(initial=0)) + 1):
            here = np.flatnonzero(nth == k)
            share[here] += share[here - 1]
        share[np.append(head[1:], len(end)) - 1] = 2.0
        back = np.where(inside, start - 1, -1)
        return stops - 1, first, share, ids, back

    def sample(self, texts: list[str], keys: list[int], seed: int = SEED, limit: int = SLICE) -> list[np.ndarray]:
        """Ids of each text."""
        if all(len(x) < limit for x in texts):
            return self._sample([next(self.pieces(x, limit))[0] for x in texts], keys, [0] * len(texts), seed)
        return [np.concatenate([self._sample([piece], [k], [first], seed)[0] for piece, first in self.pieces(x, limit)]) for x, k in zip(texts, keys)]

    def _sample(self, texts: list[str], keys: list[int], firsts: list[int], seed: int) -> list[np.ndarray]:
        """Backward sampling: ids of each piece of a text; `firsts` are the numbers of their first chunks."""
        chunks, number, counts = self.chunks(texts)
        if not len(number):
            return [np.zeros(0, np.int32) for _ in texts]
        last, first, share, ids, back = self.lattice(chunks)
        at = last[number]
        own = np.repeat(np.arange(len(texts), dtype=np.int32), counts)
        nth = (np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts - np.array(firsts), counts)).astype(np.uint64)
        gold = np.uint64(0x9E3779B97F4A7C15)
        with np.errstate(over="ignore"):
            state = _mix(np.array([k % (1 << 64) for k in keys], np.uint64) ^ _mix(np.uint64(seed) + np.zeros(1, np.uint64)))
            state = _mix(state[own] + (nth + np.uint64(1)) * gold)
            live, steps = np.arange(len(at), dtype=np.int32), []
            while len(live):
                state = _mix(state + gold)
                chance = (state >> np.uint64(32)).astype(np.float64) / 2.0**32
                way = first[at]
                open_ = np.flatnonzero(chance >= share[way])
                while len(open_):
                    way[open_] += 1
                    open_ = open_[chance[open_] >= share[way[open_]]]
                steps.append((live, ids[way].astype(np.int32)))
                at = back[way]
                more = at >= 0
                live, at, state = live[more], at[more], state[more]
        sizes = np.zeros(len(number), np.int64)
        for occurrence, _ in steps:
            sizes[occurrence] += 1
        ends = np.cumsum(sizes)
        drawn = np.empty(int(ends[-1]), np.int32)
        for k, (occurrence, found) in enumerate(steps):
            drawn[ends[occurrence] - 1 - k] = found
        totals = np.bincount(own, weights=sizes, minlength=len(texts)).astype(np.int64)
        if (spelled := np.flatnonzero(drawn < 0)).size:
            spelling = [[self.bytes[b] for b in (MARK if c == ord(ESCAPE) else chr(c)).encode()] for c in (-1 - drawn[spelled]).tolist()]
            width = np.ones(len(drawn), np.int64)
            width[spelled] = [len(x) for x in spelling]
            text_ends = np.append(0, np.cumsum(width))[np.cumsum(totals)]
            drawn = np.repeat(drawn, width)
            drawn[drawn < 0] = [i for x in spelling for i in x]
        else:
            text_ends = np.cumsum(totals)
        return np.split(drawn, text_ends[:-1])

    def decode(self, ids: list[int]) -> str:
        """The text that `ids` were sampled from."""
        return b"".join(map(self.raw.__getitem__, ids))[1:].decode()


def sampler(path: str | None = None, alpha: float = ALPHA) -> Sampler:
    return worker_cache(("pieces", path or default_model(), alpha), lambda: Sampler(path or default_model(), alpha))


def encode_sampled(docs: DataFrame, model: str | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """(doc_id, ids, n_pieces, text_crc32, decoded_crc32): sampled ids, and CRC-32 of the text and of their decoding.

    One pass without a shuffle; texts are taken in slices, so memory does not follow the batch.
    """
    schema = "doc_id BIGINT, ids ARRAY<INT>, n_pieces BIGINT, text_crc32 BIGINT, decoded_crc32 BIGINT"

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = sampler(model, alpha)
        for batch in rows:
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            at = 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars + len(texts[to]) <= SLICE):
                    chars += len(texts[to])
                    to += 1
                found = by.sample(texts[at:to], [NULL_KEY if k is None else k for k in keys[at:to]], seed)
                sizes = [len(x) for x in found]
                ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(np.concatenate(found), pa.int32()))
                text_crc = [zlib.crc32(x.encode()) for x in texts[at:to]]
                decoded = [zlib.crc32(by.decode(x.tolist()).encode()) for x in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[at:to], pa.int64()), ids, *(pa.array(x, pa.int64()) for x in (sizes, text_crc, decoded))],
                    ["doc_id", "ids", "n_pieces", "text_crc32", "decoded_crc32"],
                )
                at = to

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(batches, schema)


def decode_ids(rows: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = sampler(model)
        for batch in parts:
            texts = [by.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(batches, "doc_id BIGINT, text STRING")
