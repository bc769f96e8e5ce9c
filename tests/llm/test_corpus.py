"""The corpus operators against brute force, on planted fixtures and on the smallest tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from tablewright.llm import (
    components,
    exact_dedup,
    license_scan,
    line_dedup,
    near_dedup,
    packing,
    piece_sampling,
    quality_classifier,
    quality_rules,
    sharding,
    simhash,
    warc,
)

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Nulls, blanks, odd characters, ties, repeated rows, long texts; columns named like internals and results.
SCHEMA = (
    "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, kept STRING, lines STRING, score STRING, "
    "fingerprint STRING, length STRING, label STRING, h STRING, slot STRING, component_id STRING, sequence_id STRING"
)


def odd_rows():
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = "\n".join(prose(20) for _ in range(4))
    texts = [
        None, "", " \t\n\x0b", "One two", "one TWO", "Ünï çödé\x85x y", "a\r\nb\r\n\r\n\r\nc", "lone", "▁mark ￼\x00",
        prose(60) + "\n" + passage, passage + "\n" + prose(60), passage, "same line\n" * 6, prose(60_000), "z" * 30_000, "#$%& <|> **",
        "Licensed under CC BY-NC 4.0.", "tail space ", "  lead", "<|endoftext|> in text", "don't won't I'll", "CAPS!! CAPS!! " * 40,
    ]
    base = prose(200)
    texts += [base, base, base.upper(), base + " more", "x " + base]
    texts += [f"common boilerplate line of the host here\n{prose(70)}" for _ in range(30)]
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, 5) for i, t in enumerate(texts)]
    rows += [rows[9], rows[9], (None, prose(80), None, None, None), (None, prose(80), None, None, None), (9, prose(90), "en", "s0", 1), (-4, base, "en", "s1", 0)]
    return [(*r, *("x" * 10)) for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def key(rows):
    return sorted(map(repr, rows))


# op1


def quality_brute(rows, min_docs=quality_rules.MIN_DOCS, share=quality_rules.MAX_SHARE, max_docs=quality_rules.MAX_DOCS):
    hosts, holders = defaultdict(set), defaultdict(set)
    norm = lambda x: " ".join(WORDS.findall(x.translate(LOWER)))
    for _, text, host in rows:
        text = text or ""
        hosts[host].add(text)
        for line in text.split("\n"):
            if norm(line):
                holders[host, norm(line)].add(text)
    out = []
    for doc, text, host in rows:
        text = text or ""
        words = WORDS.findall(text)
        windows = list(zip(words, words[1:], words[2:]))
        seen = Counter(windows)
        repeat = len({j for i, w in enumerate(windows) if seen[w] > 1 for j in range(i, i + 3)})
        lines = [x for x in text.split("\n") if norm(x)]
        gone = [norm(x) for x in lines if len(holders[host, norm(x)]) > max(min_docs, min(share * len(hosts[host]), max_docs))]
        lost = sum(x.count(" ") + 1 for x in gone)
        failed = len(words) < 50 or 100 * repeat > 50 * len(words)
        left = len(words) - lost
        kept = not failed and left >= len(words) * 0.5
        out.append((doc, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeat, failed, kept, len(set(gone)), lost))
    return out


@pytest.mark.parametrize("limits", [(3, 0.05, 4), (20, 0.08, 10**9), (3, 0.03, 200)])
def test_quality_rules(odd, empty, docs, limits):
    for df in (odd, empty, docs):
        rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
        got = quality_rules.quality_rules(df, min_docs=limits[0], max_share=limits[1], max_docs=limits[2]).collect()
        assert key(map(tuple, got)) == key(quality_brute(rows, *limits))


def test_quality_filter_acts_as_the_rules_say(odd, empty):
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    kept = Counter(repr(v[0]) for v in quality_brute(rows) if v[7])
    out = quality_rules.filter_documents(odd)
    assert out.columns == odd.columns
    got = out.collect()
    assert Counter(repr(r.doc_id) for r in got) == kept
    assert all(r.n_chars == len(r.text) for r in got)
    assert quality_rules.filter_documents(empty).count() == 0


def test_quality_removes_frequent_lines(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "Shared  footer LINE\n" + " ".join(map(str, rng.integers(0, 10**6, 80))), "en", "h", 1) for i in range(60)]
    notice = " ".join(f"notice{j}" for j in range(60))
    rows += [(100 + i, f"{notice}\n{i} tiny " + " ".join(map(str, rng.integers(0, 10**6, 20))), "en", "h", 1) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG")
    got = {r.doc_id: r.text for r in quality_rules.filter_documents(df).collect()}
    assert set(got) == set(range(60)) and all("footer" not in t.lower() for t in got.values())


def test_quality_stage_removes_footers_at_any_rate_and_host_size(spark):
    rng = np.random.default_rng(2)
    rows = []
    for host, size, rate in (("a", 40, 0.15), ("b", 50, 0.1), ("c", 400, 0.04), ("d", 400, 0.1), ("e", 10_000, 0.03), ("f", 10_000, 0.06)):
        for i, n in enumerate(rng.integers(0, 10**6, (size, 60))):
            foot = f"Footer of {host}\n" if i < size * rate else ""
            rows.append((len(rows), foot + "\n".join(f"{host} {i} {j} {x}" for j, x in enumerate(n)), "en", host, 1))
    df = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG")
    got = quality_rules.filter_documents(df).collect()
    assert len(got) == len(rows) and not {r.source for r in got if "Footer" in r.text}
    assert all(r.text.count("\n") == 59 for r in got)
    report = {r.doc_id: r for r in quality_rules.quality_rules(df).collect()}
    assert all(report[r[0]].kept and report[r[0]].frequent_lines == r[1].startswith("Footer") for r in rows)


# op2


def license_brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    places = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None), ",".join(sorted({x for _, x in places})), words


def template_regex(markup):
    parts = re.split(r"<<(beginOptional|endOptional|var;(?:min=0;)?max=\d+)>>", markup)
    out = ""
    for i, part in enumerate(parts):
        if i % 2 == 0:
            out += "".join(f"{re.escape(w)} " for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", part.translate(LOWER)))
        else:
            out += {"beginOptional": "(?:", "endOptional": ")?"}.get(part) or f"(?:\\S+ ){{{0 if 'min=0' in part else 1},{part.rpartition('=')[2]}}}"
    return re.compile(f"(?<!\\S){out}")


def test_license_scan(spark, odd, empty, docs):
    planted = [
        "Foo. Released under the MIT License. Bar", "under the terms of the mit license", "under the terms MIT license",
        "Copyright (c) 2020 Some One, Inc. All rights reserved. all rights reserved", "Neither the name of the Foo Bar Project nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "GNU general public license version 3", "This is licensed under the GNU General Public License, version 3.", "CC BY CC BY-SA 4.0", "Licensed under the Apache License, Version 2.0", "licensed under the apache license 2.0", "mit", "You may not use this very fine file except in compliance with the License",
        "you may not use this one two three four five except in compliance with the license",
    ]
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(planted)], "doc_id LONG, text STRING")
    patterns = [(label, template_regex(m)) for label, m in license_scan.TEMPLATES]
    for df in (odd.select("doc_id", "text").union(extra), empty, docs):
        got = defaultdict(list)
        for r in license_scan.license_scan(df).collect():
            got[r.doc_id].append(tuple(r)[1:7])
            assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
        for doc, text in texts_of(df):
            *base, words = license_brute(text)
            joined = " ".join(words) + " "
            labels = set(filter(None, base[4].split(","))) | {x for x, p in patterns if p.search(joined)}
            assert (*base, ",".join(sorted(labels))) in got[doc]


def readings(markup):
    """A short text of a template, every replaceable region one word, and the longest, as (word, is it mandatory)."""
    parts = re.split(r"<<(beginOptional|endOptional|var;(?:min=0;)?max=\d+)>>", markup)
    short, long, depth = [], [], 0
    for i, part in enumerate(parts):
        if i % 2 == 0:
            words = [(w, True) for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", part.translate(LOWER))]
            long += [(w, not depth) for w, _ in words]
            short += [] if depth else words
        elif part.startswith("var"):
            long += [(f"free{k}", False) for k in range(int(part.rpartition("=")[2]))]
            short += [("free", False)] if not depth else []
        else:
            depth += 1 if part == "beginOptional" else -1
    return short, long


@pytest.mark.parametrize("template", license_scan.TEMPLATES, ids=lambda t: f"{t[0]}-{len(t[1])}")
def test_altered_mandatory_wording_is_rejected(template):
    def found(words):
        return template[0] in license_scan.scan(" ".join(["before", *words, "after"]).encode(), (template,))[5].split(",")

    for text in readings(template[1]):
        words = [w for w, _ in text]
        assert found(words)
        for i, (_, mandatory) in enumerate(text):
            if mandatory:
                assert not found([*words[:i], "zzz", *words[i + 1 :]])
                assert not found(words[:i] + words[i + 1 :])
                if i + 1 < len(text) and text[i + 1][1]:
                    assert not found([*words[: i + 1], "zzz", *words[i + 1 :]])
    assert sum(m for _, m in readings(template[1])[0]) >= 3


def test_a_grant_that_goes_on_in_other_words_is_no_licence():
    mit = " ".join(w for w, _ in readings(license_scan.TEMPLATES[0][1])[1])
    assert "mit" in license_scan.scan(mit.encode())[5].split(",")
    grant = mit[: mit.index("and to permit persons")]
    altered = grant + "provided that the licensee pays a yearly fee and gives up every right"
    assert "mit" not in license_scan.scan(altered.encode())[5].split(",")


def test_replaceable_regions_hold_one_word_at_least():
    auto = license_scan.compile_template("x", "a b <<var;max=2>> c <<var;min=0;max=1>> d")
    read = lambda t: auto.read(t.encode().split(), 0) == len(t.split())
    assert [read(x) for x in ("a b c d", "a b x c d", "a b x y c d", "a b x y z c d", "a b x c y d", "a b x c y z d")] == [False, True, True, False, True, False]


def test_templates_need_wording():
    for bad in ("<<beginOptional>>a<<endOptional>>", "<<beginOptional>>a b", "<<var;max=3>>"):
        with pytest.raises(ValueError):
            license_scan.compile_template("x", bad)


# op3


def check_packing(rows, texts, capacity=1024):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    wanted = defaultdict(list)
    for doc, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            wanted[doc].append((k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in wanted.items()}
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(x[2] for v in wanted.values() for x in v)


def test_packing(odd, empty, docs):
    for df in (odd, docs):
        n, tokens = check_packing(packing.pack_documents(df).collect(), texts_of(df))
        assert n <= -(-tokens // 1024) * 1.03 + 1
    assert packing.pack_documents(empty).collect() == []


def test_places_do_not_depend_on_buckets(spark, docs):
    from tablewright.llm.common import materialize

    pieces = materialize(packing.token_pieces(docs), "test-pieces")
    texts = texts_of(docs)
    found = []
    for rows in (1, 7, 20_000):
        out = packing.pack(pieces, bucket_rows=rows).collect()
        check_packing(out, texts)
        found.append(len({r.sequence_id for r in out}))
    assert len(set(found)) == 1


def test_plan_packs_all_and_pairs_large_items():
    rng = np.random.default_rng(5)
    for capacity in (10, 64, 1024):
        for _ in range(30):
            counts = Counter(rng.integers(1, capacity + 1, rng.integers(1, 3000)).tolist())
            runs = packing.plan_runs(counts, capacity)
            used = Counter()
            for n, held in runs:
                assert n > 0 and sum(a * b for a, b in held) <= capacity and sum(b for a, b in held if 3 * a > capacity) <= 2
                for a, b in held:
                    used[a] += n * b
            assert used == counts
            bins, least = sum(n for n, _ in runs), -(-sum(a * b for a, b in counts.items()) // capacity)
            assert bins <= least * 11 / 9 + 2 + sum(v for k, v in counts.items() if 2 * k > capacity)
            ranges = defaultdict(list)
            for length, first, end, *_ in packing.plan_rows(runs):
                ranges[length].append((first, end))
            for length, found in ranges.items():
                found.sort()
                assert found[0][0] == 0 and found[-1][1] == counts[length] and all(a[1] == b[0] for a, b in zip(found, found[1:]))
    assert packing.plan_runs({}) == []


def test_ids_equal_the_tokenizers_own():
    own = packing.TokenIds(packing.default_tokenizer())
    rng = np.random.default_rng(2)
    parts = [" ", "  ", "\n", "a", "Bc", "é", "'s", "'", ".", "1", "²", "\t", "\x85", "\x1c", "一", "\r", "x ", "y.\n", "don't", "!!", "ß", "\0", "Word", " word,", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 12))) for _ in range(5000)]
    assert own.many(texts) == own._plain(texts)


# op4


def pages_table(spark):
    big, other = "<p>" + "y" * 1200, "ö" * 500
    rows = [(1, "http://a", big), (2, "http://b", big), (2, "http://b", big), (3, None, None), (4, "u\r\nX: y", ""), (5, "http://c", "small"), (6, "http://d", "small")]
    rows += [(7, "http://e", other), (8, "http://f", other), (None, "http://g", big), (None, "n", "q" * 2000), (9, "http://h", "WARC/1.1\r\n\r\nin payload")]
    return spark.createDataFrame([(*r, "x", b"y") for r in rows], "page_id LONG, url STRING, html STRING, digest STRING, header BINARY")


def warc_brute(rows):
    keep = {}
    for page, html in rows:
        if page is not None:
            keep[html] = max(keep.get(html, page), page)
    out = []
    for page, html in rows:
        data = (html or "").encode()
        best = keep.get(html)
        revisit = len(data) >= 1000 and best is not None and page != best
        out.append((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", best if revisit else None))
    return out


def test_warc(spark, small):
    pages = pages_table(spark)
    for df in (pages, spark.read.parquet(f"{small}/pages.parquet"), pages.limit(0)):
        got = warc.archive_pages(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
        assert key(map(tuple, got)) == key(warc_brute([(r.page_id, r.html) for r in df.collect()]))


def test_warc_records_come_back_byte_for_byte(spark):
    headers, payloads = warc.write_archive(pages_table(spark))
    assert payloads.count() == payloads.select("digest").distinct().count() == 6
    records = [bytes(r.record) for r in warc.reconstruct_records(headers, payloads).collect()]
    assert len(records) == 12
    for record in records:
        fields, block = warc.parse_record(record)
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and "X" not in fields
        if fields["WARC-Type"] == "response":
            assert fields["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(block).hexdigest()
        else:
            assert block == b"" and fields["WARC-Refers-To"].startswith("<urn:page:") and fields["WARC-Profile"] == warc.PROFILE


def test_warc_finds_damage(spark):
    headers, payloads = warc.write_archive(pages_table(spark))
    other = zstandard.ZstdCompressor().compress(b"other bytes")
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_index(headers, payloads.withColumn("frame", F.lit(other))).collect()
    bad = payloads.withColumn("digest", F.unhex(F.sha2(F.col("frame"), 256)))
    with pytest.raises(Exception, match="no verified payload"):
        warc.read_index(headers, bad).collect()
    with pytest.raises(Exception, match="no verified payload"):
        warc.read_index(headers, payloads.limit(1)).collect()


# op5


def print_of(text):
    words = WORDS.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    ones = [sum(h >> b & 1 for h in map(lambda s: xxhash.xxh64_intdigest(s, 42), shingles)) for b in range(64)] if shingles else [0] * 64
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def near_groups(rows, radius=3):
    """(doc_id, fingerprint, number of the group) of each row."""
    prints = [print_of(t) for _, t in rows]
    bits, group = np.array(prints, np.uint64), list(range(len(rows)))

    def root(x):
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(bits[i + 1 :] ^ bits[i]) <= radius) + i + 1:
            group[root(int(j))] = root(i)
    return [(doc, f"{prints[i]:016x}", root(i)) for i, (doc, _) in enumerate(rows)]


def near_brute(rows):
    found, least = near_groups(rows), {}
    for doc, _, group in found:
        if doc is not None:
            least[group] = min(doc, least.get(group, doc))
    return [(doc, fp, least.get(group)) for doc, fp, group in found]


def test_near_duplicates(odd, empty, docs):
    for df in (odd, docs, empty):
        rows = [(d, t if t is None or len(t) < 100_000 else t) for d, t in texts_of(df)]
        assert key(map(tuple, simhash.near_duplicates(df).collect())) == key(near_brute(rows))


def test_links_of_every_error_pattern(spark):
    rng = np.random.default_rng(8)
    base = [int(x) for x in rng.integers(0, 2**63, 40)]
    prints, wanted = set(), []
    for i, fp in enumerate(base):
        for bits in ([63, 50, 45], [63, 30, 2], [22, 21, 20], [5, 4, 3], [42, 41, 0], [7], [40, 1]):
            wanted.append((fp, fp ^ sum(1 << b for b in bits)))
    dense = [base[0] ^ sum(1 << b for b in range(10) if n >> b & 1) for n in range(1024)]
    prints = {x for pair in wanted for x in pair} | set(dense)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    nodes = spark.createDataFrame([(signed(x),) for x in prints], "fp LONG")
    groups = {r.node: r.component for r in simhash.group_fingerprints(nodes).collect()}
    assert all(groups[signed(a)] == groups[signed(b)] for a, b in wanted)
    assert len({groups[signed(x)] for x in dense}) == 1


def test_links_between_dense_groups(spark):
    """Two clouds of near copies that share keys, and strays near one of them: as all pairs."""
    rng = np.random.default_rng(5)
    base = int(rng.integers(0, 2**62))
    near = lambda x, n: x ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False))
    prints = {near(base, rng.integers(0, 7)) for _ in range(250)} | {near(near(base, 9), rng.integers(0, 5)) for _ in range(150)} | {near(base, 12) for _ in range(40)}
    prints = sorted(prints)
    bits, group = np.array(prints, np.uint64), list(range(len(prints)))
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(bits ^ bits[i]) <= 3).tolist():
            if group[i] != group[j]:
                group = [group[i] if g == group[j] else g for g in group]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = {r.node: r.component for r in simhash.group_fingerprints(spark.createDataFrame([(signed(x),) for x in prints], "fp LONG")).collect()}
    of = [got.get(signed(x), signed(x)) for x in prints]
    assert len(set(group)) > 30 and len({*zip(group, of)}) == len(set(group)) == len(set(of))


def test_golay_code_is_perfect_and_keys_meet():
    rng = np.random.default_rng(4)
    words = rng.integers(0, 1 << 23, 2000)
    table = simhash.codewords()
    assert (table >= 0).all() and max(int(x).bit_count() for x in table) == 3
    close = words ^ (1 << rng.integers(0, 23, 2000))
    probes = simhash.probe_keys(words, 23)
    assert ((probes == simhash.decode(close)[:, None]).any(axis=1)).all() and probes.shape[1] <= 6


def test_first_of_each_group(spark, odd, empty):
    texts = texts_of(odd)
    members = defaultdict(set)
    for (doc, text), (*_, group) in zip(texts, near_groups(texts)):
        members[group].add((doc is None, doc or 0, text))
    got = simhash.first_of_each_group(odd)
    assert got.columns == odd.columns
    found = Counter(next(g for g, m in members.items() if (r.doc_id is None, r.doc_id or 0, r.text) in m) for r in got.collect())
    assert found == Counter(list(members))
    assert all((r.doc_id is None, r.doc_id or 0) in {min(x[:2] for x in m) for m in members.values()} for r in got.collect())
    assert simhash.first_of_each_group(empty).count() == 0


def jaccard_groups(texts):
    """The group number of each text: links of 5-word Jaccard similarity 0.8 or more, by all pairs."""
    words = [WORDS.findall((t or "").translate(LOWER)) for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if group[i] != group[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    return group


def test_near_dedup_stage_links_by_five_word_similarity(spark, odd, empty, docs):
    import corpus_pipeline as pipeline

    rng = np.random.default_rng(6)
    rows = []
    for family in range(12):
        base = [f"w{x}" for x in rng.integers(0, 10**6, 220)]
        for edits in (0, 2, 3, 4, 12):
            words = list(base)
            for at in rng.choice(len(words), edits, replace=False):
                words[at] = f"e{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join(words)))
    # chains: neighbours are near, the others are not
    for family in range(8):
        chain = [f"c{x}" for x in rng.integers(0, 10**6, 240)]
        rows += [(1000 + 10 * family + i, " ".join(chain[15 * i : 15 * i + 180])) for i in range(5)]
    planted = spark.createDataFrame(rows, "doc_id LONG, text STRING")
    far = 0
    for df in (planted, odd, empty, docs):
        texts = texts_of(df)
        groups = jaccard_groups([t for _, t in texts])
        least, members = {}, defaultdict(set)
        for (doc, text), g in zip(texts, groups):
            at = (doc is None, doc or 0)
            least[g] = min(at, least.get(g, at))
            members[at, text].add(g)
        out = pipeline.apply_near_dedup(spark, df, "")
        assert out.columns == df.columns
        got = [((r.doc_id is None, r.doc_id or 0), r.text) for r in out.collect()]
        found = Counter(next(iter(members[x])) for x in got)
        assert found == Counter(list(least)) and all(x[0] == least[next(iter(members[x]))] for x in got)
        if df is planted:
            prints = [print_of(t) for _, t in texts]
            far = sum(groups[i] == groups[j] and (prints[i] ^ prints[j]).bit_count() > 3 for i in range(len(texts)) for j in range(i))
    assert far > 10


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (300, 200), (200, 300)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a LONG, b LONG")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 300: 200}
    assert components.connected_components(spark.createDataFrame([], "a LONG, b LONG")).collect() == []


# op6


def lines_brute(rows):
    order = lambda d: -(2**70) if d is None else d
    first, held = {}, []
    for doc, text in rows:
        lines = [] if text is None else text.split("\n")
        places = [i for i, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
        windows = [(tuple(lines[j].strip(" \t\n\x0b\x0c\r") for j in places[k : k + 3]), places[k : k + 3]) for k in range(len(places) - 2)]
        held.append((doc, text, lines, windows))
        for w, at in windows:
            first[w] = min(first.get(w, (order(doc), at[0], hash(text))), (order(doc), at[0], hash(text)))
    out = []
    for doc, text, lines, windows in held:
        gone = {j for w, at in windows if first[w] != (order(doc), at[0], hash(text)) for j in at}
        out.append((doc, len(lines), len(gone), text if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return out


def test_line_dedup(odd, empty, docs):
    for df in (odd.where("doc_id <> 9 OR doc_id IS NULL"), docs, empty):
        assert key(map(tuple, line_dedup.line_dedup_report(df).collect())) == key(lines_brute(texts_of(df)))


def test_line_dedup_keeps_rows_and_columns(odd):
    out = line_dedup.dedup_lines(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert all(r.n_chars == len(r.text) for r in out.collect() if r.text is not None)


def test_line_dedup_is_native(odd):
    plan = line_dedup.line_dedup_report(odd)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# op7


def table_brute(shards, slots):
    order = []
    for s in shards:
        offset, skip = sharding._number(f"offset/{s}") % slots, sharding._number(f"skip/{s}") % (slots - 1) + 1
        order.append([(offset + k * skip) % slots for k in range(slots)])
    table = [None] * slots
    while True:
        for i in range(len(shards)):
            slot = next(x for x in order[i] if table[x] is None)
            table[slot] = i
            if None not in table:
                return table


def test_lookup_table():
    names = sharding.default_shards(7)
    assert sharding.lookup_table(names, 211).tolist() == table_brute(names, 211)
    sizes = np.bincount(sharding.lookup_table(sharding.default_shards(64)))
    assert sizes.max() - sizes.min() <= 1 and sizes.sum() == sharding.SLOTS
    a, b = sharding.lookup_table(names, 65_537), sharding.lookup_table(names[:-1], 65_537)
    stayed = a != 6
    assert (a[stayed] == b[stayed]).mean() > 0.75
    for bad in (([], 11), (["a", "a"], 11), (names, 12), (names, 5)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_sharding(odd, empty, docs):
    table = sharding.lookup_table(sharding.default_shards())
    for df in (odd, docs, empty):
        got = sharding.shard_documents(df).collect()
        assert sorted(repr(r.doc_id) for r in got) == sorted(repr(d) for d, _ in texts_of(df))
        for r in got:
            text = "\x00null" if r.doc_id is None else str(r.doc_id)
            slot = (lambda h: (h - (1 << 64) if h >> 63 else h) % sharding.SLOTS)(xxhash.xxh64_intdigest(text, 42))
            assert r.slot == slot and r.shard == f"shard-{table[slot]:03d}"


# op8


def test_sampled_segmentations_are_lossless_and_reproducible(odd, empty, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_sampling.default_model())
    for df in (odd, docs):
        encoded = piece_sampling.encode_sampled(df)
        again = piece_sampling.encode_sampled(df.repartition(7)).collect()
        rows = encoded.collect()
        assert key((r.doc_id, r.ids) for r in rows) == key((r.doc_id, r.ids) for r in again)
        wanted = Counter((repr(d), t or "") for d, t in texts_of(df))
        assert Counter((repr(r.doc_id), r.text) for r in piece_sampling.decode_ids(encoded).collect()) == wanted
        assert all(r.text_crc32 == r.decoded_crc32 and r.n_pieces == len(r.ids) for r in rows)
        plain = Counter((repr(r.doc_id), model.decode(r.ids)) for r in rows)
        assert sum((plain & wanted).values()) >= len(rows) - 3  # the library has no text for the mark and some odd characters
    assert piece_sampling.encode_sampled(empty).collect() == []


def test_long_texts_are_sampled_piece_by_piece(docs):
    own = piece_sampling.Sampler(piece_sampling.default_model())
    texts = [t or "" for _, t in texts_of(docs)[:60]] + ["", "a", " ", "\u2581 x", "zz" * 500]
    keys = list(range(len(texts)))
    whole = own.sample(texts, keys)
    for limit in (1, 40, 333):
        assert all("".join(p for p, _ in own.pieces(t, limit)) == "".join(p for p, _ in own.pieces(t, 10**9)) for t in texts)
        cut = own.sample(texts, keys, limit=limit)
        assert all(a.tolist() == b.tolist() for a, b in zip(whole, cut))
    assert max(len(p) for t in texts for p, _ in own.pieces(t, 333)) <= max(333, max(map(len, own.chunks([next(own.pieces(t, 10**9))[0] for t in texts])[0])))


def test_samples_follow_the_lattice():
    own = piece_sampling.Sampler(piece_sampling.default_model())
    weight = {x.decode().replace(" ", piece_sampling.MARK): i for i, x in own.raw.items() if i not in own.bytes.values()}
    plain = sorted(weight.values())
    rank = {i: k for k, i in enumerate(plain)}

    def ways(text):
        if not text:
            yield (), 1.0
        for n in range(1, len(text) + 1):
            if text[:n] in weight:
                for rest, p in ways(text[n:]):
                    yield (weight[text[:n]], *rest), p / (rank[weight[text[:n]]] + 1)

    wanted = dict(ways(piece_sampling.MARK + "there"))
    total, n = sum(wanted.values()), 40_000
    got = Counter(tuple(x.tolist()) for x in own.sample(["there"] * n, list(range(n))))
    assert set(got) <= set(wanted)
    for way, p in wanted.items():
        p /= total
        assert abs(got[way] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-4


# op9


def test_classifier_learns_and_scores_text_alone(spark, small, odd, empty):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in quality_classifier.classify(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d in got)
    assert np.mean([got[d].predicted == truth[d] for d in held]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality_classifier.classify(docs, flipped).collect()}
    assert all(abs(again[d] - got[d].score) < 1e-9 for d in got)
    rows = quality_classifier.classify(odd, labels).collect()
    assert len(rows) == odd.count() and all(r.score is not None for r in rows)
    assert quality_classifier.classify(empty, labels).collect() == []
    assert {r.score for r in quality_classifier.classify(odd, labels.limit(0)).collect()} == {0.5}
    strange = labels.select("doc_id", "quality").union(spark.createDataFrame([(None, 1), (3, None), (5, 7), (1, 1), (1, 0)], "doc_id LONG, quality INT"))
    assert len(quality_classifier.classify(docs, strange).collect()) == 1000


def test_score_equals_plain_sums(spark):
    model = quality_classifier.Model(np.random.default_rng(0).normal(size=quality_classifier.BUCKETS).astype(np.float32), 0.3)
    text = "Some words words, ÄÖ |x| words words".encode()
    words = text.split()
    found = [b for w in words for b in quality_classifier.word_buckets(w)]
    found += quality_classifier.bigram_buckets(np.array([zlib.crc32(w) for w in words], np.uint64)).tolist()
    assert quality_classifier.SAME in found
    wanted = 1 / (1 + np.exp(-(0.3 + model.table[found].astype(float).mean())))
    assert quality_classifier.Words(model.table).scores([text, b""], 0.3) == pytest.approx([wanted, 1 / (1 + np.exp(-0.3))], abs=1e-6)


# op10


def exact_brute(rows):
    groups = defaultdict(list)
    norm = lambda t: (t or "").translate(LOWER)
    for doc, text in rows:
        groups[norm(text)].append(doc)
    out = []
    for doc, text in rows:
        own = groups[norm(text)]
        keep = max((d for d in own if d is not None), default=None)
        out.append((doc, keep, len(own), doc == keep, hashlib.sha256(norm(text).encode()).hexdigest()))
    return out


def test_exact_duplicates(odd, empty, docs):
    for df in (odd, docs, empty):
        assert key(map(tuple, exact_dedup.exact_duplicates(df).collect())) == key(exact_brute(texts_of(df)))


def test_drop_duplicate_texts(odd, docs):
    for df in (odd, docs):
        out = exact_dedup.drop_duplicate_texts(df)
        kept = [d for d, keep, _, stays, _ in exact_brute(texts_of(df)) if stays]
        assert out.columns == df.columns and sorted(repr(r.doc_id) for r in out.collect()) == sorted(map(repr, kept))


# pipeline


def test_pipeline_stages_against_brute_force(spark, small):
    import corpus_pipeline as pipeline

    from tablewright.llm.common import materialize

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, held = docs.columns, {}
    for name, stage in pipeline.STAGES:
        held[name] = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
        docs = materialize(stage(spark, docs, small), f"test-{name}")
        if name != "best_fit_packing":
            assert docs.columns == columns
    kept = {v[0] for v in quality_brute(held["quality_rules"]) if v[7]}
    assert {d for d, *_ in held["quality_classifier"]} == kept
    rows = [r[:2] for r in held["line_dedup"]]
    assert {d for d, _ in rows} <= kept
    assert key((d, t) for d, _, _, t in lines_brute(rows)) == key(r[:2] for r in held["simhash_near_dedup"])
    # the stage's rule is the job's for stages on word shingles: five words, similarity of 0.8 or more
    near = [r[:2] for r in held["simhash_near_dedup"]]
    firsts = {}
    for (doc, _), group in zip(near, jaccard_groups([t for _, t in near])):
        firsts[group] = min(doc, firsts.get(group, doc))
    assert {r[0] for r in held["best_fit_packing"]} == set(firsts.values())
    check_packing(docs.collect(), [r[:2] for r in held["best_fit_packing"]])
    assert key(map(tuple, pipeline.run(spark, small).collect())) == key(map(tuple, docs.collect()))


def test_pipeline_takes_odd_rows(spark, small, odd, empty):
    """Nulls, blanks, ties, repeated rows, long texts: each stage against brute force, an empty table stays empty."""
    import corpus_pipeline as pipeline

    from tablewright.llm.common import materialize

    held, docs = {}, odd
    for name, stage in pipeline.STAGES:
        held[name] = [(r.doc_id, r.text) for r in docs.collect()]
        docs = materialize(stage(spark, docs, small), f"odd-{name}")
    after = list(held.values())
    verdicts = quality_brute([(r.doc_id, r.text, r.source) for r in odd.select("doc_id", "text", "source").collect()], 20, 0.08)
    assert Counter(repr(d) for d, _ in after[1]) == Counter(repr(v[0]) for v in verdicts if v[7])
    assert Counter(map(repr, after[2])) <= Counter(map(repr, after[1]))
    assert key((d, t) for d, _, _, t in lines_brute(after[2])) == key(after[3])
    least = {}
    for (doc, _), group in zip(after[3], jaccard_groups([t for _, t in after[3]])):
        least[group] = min((doc is None, doc or 0), least.get(group, (True, 0)))
    assert sorted((d is None, d or 0) for d, _ in after[4]) == sorted(least.values())
    assert docs.count() >= len(after[4]) > 20
    docs = empty
    for name, stage in pipeline.STAGES:
        docs = materialize(stage(spark, docs, small), f"odd-{name}")
        assert docs.count() == 0


#: Every name that the operators give to columns of their own, now or before.
INNER = (
    "row host facts gone left lost_host lost_words k1 k2 id t1 t2 lines covered doc w1 w2 first last near_id near_k1 near_k2 node size keys key least "
    "group a b score lost sha prefix keep_id slot shard _host _facts _lost_host _lost_gone _covered _doc_id _t1 _t2 _k1 _k2 _near_id _near_k1 _score _lost "
    "_lost_k1 no_id n buckets label length piece start ids_crc32 _bucket _length _first _end sequence_id offset"
).split()


def test_users_columns_come_back_whatever_their_names(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    wide = docs.withColumns({x: F.concat(F.lit(f"{x}-"), "doc_id") for x in INNER} | {"with.dot": F.lit("d"), "with`tick": F.lit("t")})
    labels = spark.read.parquet(f"{small}/labels.parquet")
    stages = {
        "rules": quality_rules.filter_documents,
        "classifier": lambda d: quality_classifier.keep_good(d, labels),
        "lines": line_dedup.dedup_lines,
        "near": near_dedup.first_of_each_group,
        "simhash": simhash.first_of_each_group,
        "exact": exact_dedup.drop_duplicate_texts,
    }
    for name, stage in stages.items():
        out = stage(wide)
        assert out.columns == wide.columns, name
        rows, plain = out.collect(), stage(docs).collect()
        assert all(r[x] == f"{x}-{r.doc_id}" for r in rows for x in INNER) and {r["with`tick"] for r in rows} == {"t"}, name
        assert key((r.doc_id, r.text, r.n_chars) for r in rows) == key((r.doc_id, r.text, r.n_chars) for r in plain), name
    placed = sharding.place(wide, "doc_id", sharding.default_shards(5), 101)
    assert placed.columns == [*wide.columns, "slot_", "shard_"]
    assert all(r.slot == f"slot-{r.doc_id}" and 0 <= r.slot_ < 101 for r in placed.collect())
    by_slot = sharding.place(docs.withColumnRenamed("doc_id", "slot"), "slot", sharding.default_shards(5), 101)
    assert key((r.slot, r.slot_, r.shard) for r in by_slot.collect()) == key((r.doc_id, r.slot_, r.shard_) for r in placed.collect())


def test_counts_of_nothing_are_zero_in_either_dialect(spark, odd):
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        lines = line_dedup.line_dedup_report(odd).collect()
        rules = quality_rules.quality_rules(odd).collect()
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")
    assert min(min(r.n_lines, r.n_removed) for r in lines) == 0 and min(r.frequent_lines for r in rules) == 0


def variants(base, n, edits, rng):
    for _ in range(n):
        words = list(base)
        for at in rng.choice(len(words), rng.integers(*edits), replace=False):
            words[at] = f"e{rng.integers(0, 300)}"
        yield " ".join(words)


def test_dense_groups_and_their_outskirts(spark):
    """Hundreds of copies of one text with few and with many edits: the groups of all pairs, from far fewer comparisons."""
    rng = np.random.default_rng(12)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 160)]
    texts = list(dict.fromkeys([*variants(base, 250, (1, 9), rng), *variants(base, 60, (6, 30), rng)]))
    second = texts[280].split()
    texts += [x for x in variants(second, 60, (0, 5), rng) if x not in texts]
    texts += [" ".join(base[:n]) for n in (100, 118, 122, 126, 130, 134, 138)] + [" ".join(base + base[:n]) for n in (20, 45, 60)]
    rows = [(i, t) for i, t in enumerate(dict.fromkeys(texts))]
    groups = jaccard_groups([t for _, t in rows])
    firsts = {}
    for (doc, _), g in zip(rows, groups):
        firsts.setdefault(g, doc)
    got = {r.doc_id for r in near_dedup.first_of_each_group(spark.createDataFrame(rows, "doc_id LONG, text STRING")).collect()}
    assert len(firsts) > 20
    assert got == set(firsts.values())


def test_long_prints_meet_by_similarity():
    """Shares of pairs that share a key, by similarity; the recall that README states."""
    rng = np.random.default_rng(2)

    def met(size, similarity, n=150):
        both = round(2 * similarity / (1 + similarity) * size)
        found = 0
        for _ in range(n):
            h = rng.integers(0, 1 << 63, 2 * size - both, np.uint64) * np.uint64(2) + rng.integers(0, 2, 2 * size - both).astype(np.uint64)
            two = [near_dedup.margins(np.sort(x)) for x in (h[:size], np.concatenate([h[:both], h[size:]]))]
            a, b = near_dedup.golay_keys(np.stack(two))
            found += bool(set(a) & set(b))
        return found / n

    assert met(60, 0.9) == met(400, 0.9) == 1.0
    assert met(200, 0.8) >= 0.94 and met(200, 0.85) >= 0.98
    assert met(200, 0.3) <= 0.02
    one = near_dedup.golay_keys(near_dedup.margins(np.array([5], np.uint64))[None])
    assert len(one[0]) == near_dedup.GROUPS * near_dedup.KEYS and max(one[0]) < near_dedup.GROUPS << 36


def test_what_lies_beyond_a_centre_finds_every_similar_pair():
    """The rule of `_beyond` on random sets: similar pairs share an early shingle outside the centre, or fit into it."""
    import pyarrow as pa

    rng = np.random.default_rng(9)
    checked = 0
    for _ in range(4000):
        universe = np.sort(rng.choice(1 << 20, rng.integers(8, 60), replace=False)).astype(np.uint64)
        draw = lambda share: universe[rng.random(len(universe)) < share]
        c, x = draw(0.8), draw(0.85)
        y = np.unique(np.concatenate([x[rng.random(len(x)) < 0.95], draw(0.05)]))
        if not len(x) or not len(y) or not len(c):
            continue
        both = lambda a, b: len(np.intersect1d(a, b))
        if not near_dedup.similar(both(x, y), len(x), len(y)) or near_dedup.similar(both(x, c), len(x), len(c)):
            continue
        sets = pa.array([x.tobytes(), y.tobytes()], pa.binary())
        fx, fy = near_dedup._beyond(sets, pa.array([c.tobytes()] * 2, pa.binary())).to_pylist()
        fits = 4 * (len(x) + len(y)) <= 9 * fx["both"] and 5 * fy["both"] >= 4 * len(y) and len(y) < len(c)
        assert set(fx["beyond"]) & set(fy["beyond"]) or fits
        checked += 1
    assert checked > 300


def test_texts_that_share_passages_do_not_become_all_pairs(spark):
    """Texts at one key that share passages: every similar pair of different groups is met, and few of the others."""
    rng = np.random.default_rng(21)
    passages = [rng.integers(0, 1 << 62, 20) for _ in range(9)]
    sets = [rng.integers(0, 1 << 62, 180)]  # the largest group's centre, its copies and one that is not quite one
    sets += [np.concatenate([sets[0][2 * i + 2 :], rng.integers(0, 1 << 62, 2 * i + 2)]) for i in range(12)]
    for _ in range(150):
        chosen = [passages[i] for i in rng.choice(9, 7, replace=False)]
        sets.append(np.concatenate([*chosen, rng.integers(0, 1 << 62, 40)]))
    for x in sets[20:40]:  # near copies, some in part
        sets += [np.concatenate([x[8:], rng.integers(0, 1 << 62, 5)]), x[: int(len(x) * rng.uniform(0.7, 0.99))]]
    sets = [np.unique(x.astype(np.uint64)) for x in sets]
    both = lambda i, j: len(np.intersect1d(sets[i], sets[j]))
    group = [0 if near_dedup.similar(both(0, i), len(sets[0]), len(s)) else i for i, s in enumerate(sets)]
    rows = [(i, len(s), g, bytearray(s.tobytes())) for i, (s, g) in enumerate(zip(sets, group))]
    held = near_dedup.materialize(spark.createDataFrame(rows, "node LONG, size LONG, group LONG, found BINARY"), "test-held")
    members = held.select(F.lit(1).cast("long").alias("key"), "node", "size", F.lit(len(rows)).cast("long").alias("n"))
    weights = held.select("node", (F.lit(1000) - F.col("node")).alias("weight"))
    links, pairs = near_dedup._more_pairs(members, weights, held.select("node", "group"), held.select("node", "found"))
    met = {(r.a, r.b) for r in pairs.collect()} | {(max(r.a, r.b), min(r.a, r.b)) for r in links.collect()}
    wanted = {(i, j) for i in range(len(sets)) for j in range(i) if group[i] != group[j] and near_dedup.similar(both(i, j), len(sets[i]), len(sets[j]))}
    assert len(wanted) >= 20 and wanted <= met
    assert len(met) < 1000  # of 20,503 pairs
