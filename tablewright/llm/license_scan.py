"""License scans: phrase places, and template markup compiled into token automata.

Method. A template (`licenses`) is a whole licence text, its notice, or a statement that names it, in which
`<<beginOptional>>...<<endOptional>>` marks what may be missing and `<<var;max=N>>` what may be replaced by one to N words. It
compiles into an automaton over words; a place of a text is accepted if the automaton, started there, reads words up to
its end, that is if the mandatory wording stands there exactly and whole: a grant that goes on in other words is not
the licence. An automaton is only started where the text holds the template's longest mandatory run of words, which
no accepted place can lack.

Cases. A long text is scanned whole; its words are split once, and only if a template's longest run is in it. Null text counts as empty: no words, null places, empty labels, score 0. Repeated rows are scored one by
one. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import each_text
from tablewright.llm.licenses import TEMPLATES

#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: A-Z to a-z; every other ASCII character that no word holds to a blank.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _joined(text: bytes) -> tuple[bytes, int]:
    """The words with a blank before, between and after them, and their number."""
    words = text.translate(_FOLD).split()
    return b" " + b" ".join(words) + b" ", len(words)


@dataclass
class Automaton:
    """Word automaton without empty moves. State 0 starts, `final` states accept."""

    label: str
    moves: list[dict[bytes, set[int]]] = field(default_factory=lambda: [{}])
    free: list[set[int]] = field(default_factory=lambda: [set()])
    final: set[int] = field(default_factory=set)
    #: Longest mandatory run, with blanks around it, and the most words that may stand before it.
    anchor: bytes = b""
    lead: int = 0

    def new(self) -> int:
        self.moves.append({})
        self.free.append(set())
        return len(self.moves) - 1

    def read(self, words: list[bytes], at: int) -> int:
        """The end of the longest accepted run that starts at word `at`; -1 if there is none."""
        states, end = {0}, -1
        while True:
            if states & self.final:
                end = at
            if not states or at >= len(words):
                return end
            states = set().union(*(self.moves[s].get(words[at], ()) for s in states), *(self.free[s] for s in states))
            at += 1


_MARKS = re.compile(r"<<(beginOptional|endOptional|var;(?:min=0;)?max=\d+)>>")


def compile_template(label: str, markup: str) -> Automaton:
    """An optional region leaves its entry states live after it; a replaceable one adds one to N free words, or none to N."""
    auto, ends, entries = Automaton(label), {0}, []
    before = 0
    run, run_before = [], 0

    def close() -> None:
        nonlocal run
        if run and len(b" ".join(run)) > len(auto.anchor.strip()):
            auto.anchor, auto.lead = b" " + b" ".join(run) + b" ", run_before
        run = []

    for i, part in enumerate(_MARKS.split(markup)):
        if i % 2 == 0:
            for word in part.encode().translate(_FOLD).split():
                state = auto.new()
                for s in ends:
                    auto.moves[s].setdefault(word, set()).add(state)
                ends = {state}
                if not entries:
                    run_before = before if not run else run_before
                    run.append(word)
                before += 1
        elif part == "beginOptional":
            close()
            entries.append(ends)
        elif part == "endOptional":
            close()
            ends = ends | entries.pop()
        else:
            close()
            skip = ends if "min=0" in part else set()
            last, reached = ends, set()
            for _ in range(int(part.rpartition("=")[2])):
                state = auto.new()
                for s in last:
                    auto.free[s].add(state)
                last = {state}
                reached.add(state)
                before += 1
            ends = skip | reached
    close()
    if entries:
        raise ValueError(f"{label}: an optional region has no end")
    if not auto.anchor or 0 in ends:
        raise ValueError(f"{label}: a template needs mandatory wording")
    auto.final = ends
    return auto


@lru_cache
def automata(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> list[Automaton]:
    return [compile_template(*x) for x in templates]


def _places(joined: bytes, run: bytes) -> list[int]:
    """Word numbers at which `run`, given with blanks around it, stands; places may overlap."""
    found, at, words, counted = [], joined.find(run), 0, 0
    while at >= 0:
        words += joined.count(b" ", counted, at)
        counted = at
        found.append(words)
        at = joined.find(run, at + 1)
    return found


def scan(text: bytes, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score."""
    joined, n = _joined(text)
    n_base, base, labels, spans = 0, set(), set(), []
    first = last = None
    for phrase, label in PHRASES.items():
        if places := _places(joined, b" " + phrase.encode() + b" "):
            n_base += len(places)
            base.add(label)
            first = places[0] if first is None else min(first, places[0])
            last = places[-1] if last is None else max(last, places[-1])
            spans += [(p, p + phrase.count(" ") + 1) for p in places]
    words: list[bytes] = []
    for auto in automata(templates):
        if auto.anchor not in joined:
            continue
        words = words or joined.split()
        for start in sorted({s for p in _places(joined, auto.anchor) for s in range(max(0, p - auto.lead), p + 1)}):
            if (end := auto.read(words, start)) >= 0:
                labels.add(auto.label)
                spans.append((start, end))
    covered = reach = 0
    for start, end in sorted(spans):
        covered += max(0, end - max(start, reach))
        reach = max(reach, end)
    return n, n_base, first, last, ",".join(sorted(base)), ",".join(sorted(base | labels)), covered / n if n else 0.0


_DDL = (
    "doc_id BIGINT, n_words BIGINT, n_base BIGINT, first_word BIGINT, last_word BIGINT, base_labels STRING, "
    "labels STRING, score DOUBLE"
)


def license_scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """One row for each document: places of the base phrases, labels, and the share of words that matched.

    One pass without a shuffle; a task holds one Arrow batch of texts.
    """
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _DDL.split(", ")]
        for batch in rows:
            found = [scan(x, templates) for x in each_text(batch.column("text"))]
            out = [batch.column("doc_id")] + [pa.array([f[i] for f in found], k) for i, k in enumerate(kinds[1:])]
            yield pa.RecordBatch.from_arrays(out, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(batches, _DDL)
