"""Cleaning and chunking of texts."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements whose content is no page text.
BOILERPLATE = ("script", "style", "nav", "header", "footer", "aside")


def clean_html(html: Column) -> Column:
    """Page text: boilerplate elements, comments and tags out, blanks collapsed. One pass of patterns, no parser."""
    text = F.coalesce(html, F.lit(""))
    for name in BOILERPLATE:
        text = F.regexp_replace(text, f"(?is)<{name}[^>]*>.*?</{name}>", " ")
    text = F.regexp_replace(text, "(?s)<!--.*?-->", " ")
    text = F.regexp_replace(text, "<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.btrim(F.regexp_replace(text, r"[ \t\n\r]+", " "))


def sections(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, section, title, body): the parts of a page from one heading to the next; before the first: no title."""
    parts = F.split(F.coalesce(F.col(html), F.lit("")), "(?i)(?=<h[1-6][ >])")
    rows = pages.select(key, F.posexplode(parts).alias("section", "_part"))
    title = clean_html(F.regexp_extract("_part", "(?is)^<h[1-6][^>]*>(.*?)</h[1-6]>", 1))
    body = clean_html(F.regexp_replace("_part", "(?is)^<h[1-6][^>]*>.*?</h[1-6]>", " "))
    return rows.select(key, "section", title.alias("title"), body.alias("body"))


def fixed_chunks(docs: DataFrame, key: str, text: str, size: int = 100, overlap: int = 20) -> DataFrame:
    """(key, chunk_index, chunk): `size` characters every `size - overlap`; the last may be shorter.

    A text is cut into steps in one pass, and a chunk is put together from the steps that it spans, so the work
    grows with the text and not with its square.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be from 0 to below the size")
    step = size - overlap
    value = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        key, F.greatest(F.lit(1), F.ceil((F.length(value) - overlap) / F.lit(step))).cast("int").alias("_n"),
        F.regexp_extract_all(value, F.lit(f"(?s).{{1,{step}}}"), F.lit(0)).alias("_steps"),
    )
    span = -(-size // step)
    piece = lambda i: F.substring(F.array_join(F.slice("_steps", i + 1, F.lit(span)), ""), 1, size)
    return rows.select(key, F.posexplode(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), piece)).alias("chunk_index", "chunk"))


def sentences(text: Column) -> Column:
    """Texts that end in . ! or ? before blanks; blanks between them go."""
    return F.filter(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"([.!?])[ \t\n\r]+", "$1\u0001"), "\u0001"), lambda x: x != "")


def sentence_chunks(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.posexplode(sentences(F.col(text))).alias("chunk_index", "chunk"))


SEPARATORS = ("\n\n", "\n", " ", "")


def split_recursively(text: str, size: int = 150, overlap: int = 20, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Own rule: split by the first separator that occurs, split longer parts by the next ones, then merge neighbours.

    Merging fills a chunk up to `size`; the next chunk starts with the last parts of it that fit into `overlap`.
    """
    sep = next((s for s in separators if s == "" or s in text), "")
    parts = list(text) if sep == "" else text.split(sep)
    finer = separators[separators.index(sep) + 1 :] if sep else ()
    out: list[str] = []
    held: list[str] = []
    width = 0

    def close() -> None:
        chunk = sep.join(held).strip()
        if chunk:
            out.append(chunk)

    for part in parts:
        if len(part) > size and finer:
            close()
            held, width = [], 0
            out.extend(split_recursively(part, size, overlap, finer))
            continue
        if held and width + len(sep) + len(part) > size:
            close()
            while held and (width > overlap or width + len(sep) + len(part) > size):
                width -= len(held.pop(0)) + (len(sep) if held else 0)
        width += len(part) + (len(sep) if held else 0)
        held.append(part)
    close()
    return out


def recursive_chunks(docs: DataFrame, key: str, text: str, size: int = 150, overlap: int = 20) -> DataFrame:
    """Greedy merging is sequential in a document, so Arrow batches go through Python; no shuffle."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = [split_recursively(x or "", size, overlap) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], [key, "chunks"])

    rows = docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(batches, f"{key} BIGINT, chunks ARRAY<STRING>")
    return rows.select(key, F.posexplode("chunks").alias("chunk_index", "chunk"))


def _letters(texts: pa.Array) -> pa.Array:
    rows = np.zeros((len(texts), 26))
    for i, text in enumerate(pc.utf8_lower(texts).cast(pa.binary())):
        rows[i] = np.bincount(np.frombuffer(text.as_buffer(), np.uint8), minlength=256)[97:123]
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * 26, pa.int32()), pa.array(rows.ravel()))


def letter_vector(text: Column) -> Column:
    """How often each letter a to z occurs: a stand-in vector where no embedding model is at hand."""
    return F.arrow_udf(_letters, "array<double>")(F.coalesce(text, F.lit("")))


def join_alike(parts: list[str], percentile: float = 0.9, dims: int = 64) -> list[str]:
    """Neighbours joined until the distance to the next is above the `percentile` of all distances, linearly interpolated.

    A part's vector counts its hashed words; the distance of a part without words is 1.
    """
    if len(parts) < 2:
        return list(parts)
    vectors = np.zeros((len(parts), dims))
    for i, part in enumerate(parts):
        for word in re.findall("[a-z0-9]+", part.lower()):
            vectors[i, zlib.crc32(word.encode()) % dims] += 1
    norms = np.sqrt((vectors * vectors).sum(axis=1))
    dots, both = (vectors[:-1] * vectors[1:]).sum(axis=1), norms[:-1] * norms[1:]
    apart = 1 - np.divide(dots, both, out=np.zeros(len(dots)), where=both > 0)
    breaks = apart > np.quantile(apart, percentile)
    out, held = [], [parts[0]]
    for part, new in zip(parts[1:], breaks):
        if new:
            out.append(" ".join(held))
            held = []
        held.append(part)
    return [*out, " ".join(held)]


def semantic_chunks(docs: DataFrame, key: str, text: str, percentile: float = 0.9) -> DataFrame:
    """(key, chunk_index, chunk): sentences joined by `join_alike`, row by row, in one Arrow pass without a shuffle."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = [join_alike(x.as_py(), percentile) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], [key, "chunks"])

    rows = docs.select(F.col(key).cast("long").alias(key), sentences(F.col(text)).alias("parts"))
    return rows.mapInArrow(batches, f"{key} BIGINT, chunks ARRAY<STRING>").select(key, F.posexplode("chunks").alias("chunk_index", "chunk"))


def parent_chunks(docs: DataFrame, key: str, text: str, parent: int = 800, child: int = 200) -> DataFrame:
    """(key, parent_index, chunk_index, chunk): children know the larger chunk that they are cut from."""
    big = fixed_chunks(docs, key, text, parent, 0).withColumnRenamed("chunk_index", "parent_index").withColumnRenamed("chunk", "_parent")
    n = F.greatest(F.lit(1), F.ceil(F.length("_parent") / F.lit(child))).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("_parent"), i * child + 1, F.lit(child)))
    return big.select(key, "parent_index", F.posexplode(parts).alias("chunk_index", "chunk"))


def fenced_parts(text: str, size: int = 400) -> list[str]:
    """Lines gathered up to `size` characters; a table, lines that start with a bar, is never parted, and keeps the line before it.

    A longer line that is no table is cut at sentence ends, and where there is none, at `size`.
    """
    units: list[list[str]] = []
    for line in text.split("\n"):
        table = line.lstrip().startswith("|")
        if table and units and (units[-1][-1].lstrip().startswith("|") or units[-1][-1].strip()):
            units[-1].append(line)
        elif table or len(line) <= size:
            units.append([line])
        else:
            for sentence in re.split(r"(?<=[.!?])[ \t]+", line):
                units += [[sentence[i : i + size]] for i in range(0, len(sentence), size)]
    out: list[str] = []
    held = ""
    for unit in units:
        part = "\n".join(unit)
        if held and len(held) + 1 + len(part) > size:
            out.append(held)
            held = ""
        held = f"{held}\n{part}" if held else part
    return [x for x in [*out, held] if x.strip()]


def table_chunks(docs: DataFrame, key: str, text: str, size: int = 400) -> DataFrame:
    """(key, chunk_index, chunk): `fenced_parts` of each text, in one Arrow pass."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = [fenced_parts(x.as_py() or "", size) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], [key, "chunks"])

    rows = docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(batches, f"{key} BIGINT, chunks ARRAY<STRING>")
    return rows.select(key, F.posexplode("chunks").alias("chunk_index", "chunk"))
