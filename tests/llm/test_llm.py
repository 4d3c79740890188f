"""The corpus operators against brute force, on small tables with odd rows."""

import re
import sys
import zlib
from collections import Counter
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from conftest import same_rows  # noqa: E402

from rasterloom.llm import bin_plan, embeddings, golay, language, licenses, mixing, near_text, packing, quality, registry, simhash, tokens, toxicity, url_filters, warc  # noqa: E402

WORD = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, __mix string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(9000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "a"), (2, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "a"),
    (3, None, None, None), (4, "", "en", "b"), (5, " \t\n ", None, "b"), (6, LONG, "en", "a"), (7, "x " * 400, "en", None), (8, "Released Under the MIT License.\nsame line\nsame line\n", "en", "c"),
    (9, "é ß 日本語 Ünder the mit license under the mit license", "de", "c"), (9, "é ß 日本語 Ünder the mit license under the mit license", "de", "c"), (None, "lost id but some words here", "en", "d"), (10, "#$% a|b <c> a|b", "es", "d"),
    (11, "an id <|endoftext|> in letters and<|endoftext|>", "en", "d"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, s, 1, 7, "clash") for i, t, lang, s in ROWS], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_duckdb(name, spark, sf_dir, duck):
    same_rows(registry.queries()[name](spark, sf_dir), duck, registry.oracle_sql()[name])


def words(t):
    return re.findall(WORD, t or "")


def test_quality_statistics(docs, empty):
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(docs, quality.DecisionList()).collect())
    want = []
    for i, t, *_ in ROWS:
        w = words(t)
        lines = [x for x in (t or "").split("\n") if words(x)]
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        hit = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
        want.append((str(i), len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)))
    assert got == sorted(want)
    assert quality.judge(empty, quality.DecisionList()).count() == 0


def test_decision_list_learns_a_conjunction_and_emits_it(docs):
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(1500):
        f = {n: float(rng.uniform(0, 1)) for n in quality.features()}
        rows.append((f, f["symbol_share"] > 0.7 and f["variety"] <= 0.5))
    rules = quality.learn(rows)
    assert rules.rules and np.mean([rules.keeps(f) != bad for f, bad in rows]) > 0.97
    assert quality.learn([]).rules == () and quality.learn([(rows[0][0], False)] * 9).rules == ()
    kept = quality.keep_good(docs, rules)
    assert kept.columns == docs.columns and kept.filter("doc_id = 1").count() == 1 and kept.filter("doc_id = 7").count() == 0


def test_warc_round_trip_and_damage(spark, tmp_path):
    rows = [(3, "http://a/é\r\n", "same"), (1, None, "same"), (2, "u", None), (5, "u", ""), (None, "u", "other"), (7, "u", "x" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives = warc.write(warc.with_revisits(pages), b"some words that repeat " * 20, archive_bytes=2000).cache()
    got = {r.record_id: r for r in warc.read(archives).collect()}
    assert len(got) == 6 and {k: v.record_type for k, v in got.items()} == {"urn:page:1": "response", "urn:page:3": "revisit", "urn:page:2": "response", "urn:page:5": "revisit", "urn:page:null": "response", "urn:page:7": "response"}
    assert bytes(got["urn:page:7"].payload) == b"x" * 300_000 and got["urn:page:3"].payload_bytes == 4 and got["urn:page:3"].refers_to_id == "urn:page:1"
    assert got["urn:page:3"].payload_digest == warc.digest(b"same")
    assert warc.export_files(archives, f"file://{tmp_path}/w") == archives.count()
    assert warc.read_files(spark, str(tmp_path / "w")).count() == 6
    whole = bytes(archives.first().content)
    spoilt = spark.createDataFrame([("cut", bytearray(whole[:-5])), ("junk", bytearray(whole + b"12345678"))], warc.ARCHIVES)
    assert warc.read(spoilt, errors="report").filter("error IS NOT NULL").count() == 2
    assert warc.write(warc.with_revisits(pages.limit(0))).count() == 0
    for bad in (b"", b"WARC/1.1\r\nWARC-Type: response\r\n\r\n", warc.record("response", "urn:x", None, b"p").replace(b"Content-Length: ", b"Content-Length: 9", 1)):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)


def test_language(docs, empty):
    rng = np.random.default_rng(2)
    vocabulary = {"aa": ["the", "thing", "and", "with"], "bb": ["der", "und", "nicht", "schön"]}
    text = lambda k, n: " ".join(rng.choice(vocabulary[k], n))
    rows = [(text(k, 40), k) for k in ("aa", "bb") for _ in range(60)]
    model = language.train([t for t, _ in rows], [k for _, k in rows])
    switched = text("aa", 20) + " " + text("bb", 30) + " " + text("aa", 20)
    got, p = language.predict(model, [text("aa", 9), text("bb", 9), "", "123 !", switched])
    assert got == ["aa", "bb", "und", "und", "aa"] and p[2] == p[3] == 0 and (p[:2] > 0.5).all()
    found = {str(r.doc_id): (r.lang_pred, r.score) for r in language.identify(docs, model).collect()}
    assert found["3"] == found["4"] == found["5"] == ("und", 0.0) and len(found) == 12
    assert language.identify(empty, model).count() == 0 and language.predict(language.train([], []), ["abc"])[0] == ["und"]


def test_marginals_against_all_paths():
    rng = np.random.default_rng(4)
    model = language.Model.empty(["a", "b", "c"])
    model.transition, model.start = rng.normal(size=(3, 3)), rng.normal(size=3)
    scores, counts = rng.normal(size=(7, 3)), np.array([4, 0, 3])
    got, _ = language.marginals(model, scores, counts, pairs=True)
    at = 0
    for n in counts:
        want = np.zeros((n, 3))
        for path in np.ndindex(*[3] * n) if n else ():
            value = np.exp(model.start[path[0]] + sum(scores[at + t, k] for t, k in enumerate(path)) + sum(model.transition[a, b] for a, b in zip(path, path[1:])))  # noqa: B905
            for t, k in enumerate(path):
                want[t, k] += value
        assert np.allclose(got[at : at + n], want / want.sum(1, keepdims=True) if n else want)
        at += n


def test_url_rules(spark):
    urls = ["http://A.Example.com/en/71?x", "https://example.com/en/8", "ftp://xcom/en/", "http://com/en/#t", "http://b.net/de", None, "no scheme", "x://y.example.net/de/8/z", "http://o.org/es/"]
    rows = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0]), (None, urls[1])], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(rows, url_filters.rule_table(spark, url_filters.RULES)).collect()}
    assert got[0] == ("a.example.com", "/en/71", "example.com/en/7", "allow") and got[1][2:] == ("com/en/", "block") and got[2][2:] == (None, "allow")
    assert got[3][2:] == ("com/en/", "block") and got[4][2] is None and got[5] == got[6] == ("", "", None, "allow") and got[7][2] == "example.net/de/8" and got[8][3] == "block"
    assert url_filters.judge(rows.limit(0), url_filters.rule_table(spark, url_filters.RULES)).count() == 0


def best(items, capacity):
    n = len(items)
    table = [(1, 0)] + [(99, 0)] * ((1 << n) - 1)
    for s in range(1, 1 << n):
        for i in range(n):
            if s >> i & 1:
                k, used = table[s ^ 1 << i]
                table[s] = min(table[s], (k, used + items[i]) if used + items[i] <= capacity else (k + 1, items[i]))
    return table[-1][0]


def test_reduction_keeps_a_best_packing():
    rng = np.random.default_rng(5)
    for _ in range(150):
        capacity = int(rng.choice([10, 20, 30]))
        items = rng.integers(1, capacity + 1, rng.integers(1, 10)).tolist()
        pool = bin_plan.Pool(Counter(items))
        fixed = bin_plan.reduce(pool, capacity)
        rest = [w for w, c in pool.n.items() for _ in range(c)]
        assert sum(m for _, m in fixed) + (best(rest, capacity) if rest else 0) == best(items, capacity)
        placed = Counter()
        for sizes, m in bin_plan.plan(Counter(items), capacity):
            assert sum(sizes) <= capacity
            placed.update({w: c * m for w, c in Counter(sizes).items()})
        assert placed == Counter(items)


def test_packing_round_trip(docs, empty):
    path = registry.byte_bpe()
    got = packing.pack_documents(docs, path, capacity=64, keep_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(str(r.doc_id), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    encoder = Tokenizer.from_file(path)
    for i, t, *_ in ROWS:
        if i != 9:
            ids = [x for r in sorted(by_doc[str(i)], key=lambda r: r.piece) for x in r.ids]
            assert ids == [*encoder.encode(t or "", add_special_tokens=False).ids, 0]
    assert len(by_doc["9"]) % 2 == 0 and packing.pack_documents(empty, path).count() == 0


def test_chunks_do_not_change_ids():
    c = tokens.ChunkEncoder(registry.byte_bpe())
    for t in [" a b", "a  b", "a\n b", "a \nb", "a\n\nb c", "it's 12 3", "", "  ", "x ", "é ü\t z", "a <|endoftext|> b", "日本 語 x", "a\0b c", "\0", "a\u00a0 b\u2003c  d", LONG]:
        assert np.frombuffer(c.encode([t])[0], "<u4").tolist() == Tokenizer.from_file(registry.byte_bpe()).encode(t, add_special_tokens=False).ids


def test_encoder_equals_the_tokenizer_on_mixed_batches(monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_CHARS", 60)
    monkeypatch.setattr(tokens, "JOINT_WORDS", 7)
    parts = [" ", "  ", "\t", "\n", " ", "a", "Bc", "é", "1", "!", "\0", "<|endoftext|>", "'s", "漢", "\r\n", "\x1c", "\u0085", "\u3000"]
    texts = ["".join(parts[int(k)] for k in np.random.default_rng(i).integers(0, len(parts), i % 13)) for i in range(4000)]
    c = tokens.ChunkEncoder(registry.byte_bpe(), 200)
    plain = Tokenizer.from_file(registry.byte_bpe())
    got = [np.frombuffer(x, "<u4").tolist() for i in range(0, len(texts), 97) for x in c.encode(texts[i : i + 97])]
    assert got == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert np.frombuffer(c.encode(["a <|endoftext|> b"])[0], "<u4").tolist() == plain.encode("a <|endoftext|> b", add_special_tokens=False).ids
    assert c.encode([]) == []


def test_golay_indices_meet_within_two_bits():
    every = np.arange(1 << 11)  # a word of each coset, since a codeword added to both words changes nothing
    moves = [0] + [1 << a for a in range(23)] + [1 << a | 1 << b for a, b in combinations(range(23), 2)]
    x, nx = golay.indices(every)
    for move in moves:
        y, ny = golay.indices(every ^ move)
        same = (x[:, :, None] == y[:, None, :]) & (np.arange(6) < nx[:, None])[:, :, None] & (np.arange(6) < ny[:, None])[:, None, :]
        assert same.any((1, 2)).all()


def test_simhash_links_are_complete(spark, docs, empty):
    rng = np.random.default_rng(6)
    base = rng.integers(-(1 << 62), 1 << 62, 60)
    fps = list(base)
    for _ in range(500):
        v = int(rng.choice(fps))
        for b in rng.choice(62, rng.integers(1, 6), replace=False):
            v ^= 1 << int(b)
        fps.append(v)
    marked = spark.createDataFrame([(i, int(v)) for i, v in enumerate(fps)], "doc_id long, fp long")
    part = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if int(fps[i] ^ fps[j]).bit_count() <= 4 or bin((int(fps[i]) ^ int(fps[j])) & (1 << 64) - 1).count("1") <= 4:
                a, b = part[i], part[j]
                if a != b:
                    part = [min(a, b) if p in (a, b) else p for p in part]
    got = {r.doc_id: r.component_id for r in simhash.components(marked).collect()}
    assert got == dict(enumerate(part))
    heavy = simhash.link(marked.select("fp").distinct(), key_rows=64)  # keys are split into chunks
    assert {(r.node, r.root) for r in simhash.connected(heavy).collect()} == {(r.node, r.root) for r in simhash.connected(simhash.link(marked.select("fp").distinct())).collect()}
    found = {str(r.doc_id): r for r in simhash.near_duplicates(docs).collect()}
    assert found["1"].component_id == found["2"].component_id == 1 and found["5"].component_id == 3 and found["3"].fingerprint == "0" * 16 and len(found) == 12
    assert simhash.near_duplicates(empty).count() == 0


def test_fingerprint_bits():
    t = "A b C d e F"
    shingles = ["a b c d", "b c d e", "c d e f"]
    want = sum(1 << k for k in range(64) if 2 * sum(xxhash.xxh64_intdigest(s, 42) >> k & 1 for s in shingles) > 3)
    assert simhash.fingerprint(t.encode()) & (1 << 64) - 1 == want and simhash.fingerprint(b"\x0b ") == 0


def test_near_text_finds_similar_texts_and_leaves_others(spark, empty, docs):
    rng = np.random.default_rng(7)
    text = lambda n: [f"w{k}" for k in rng.integers(0, 5000, n)]
    rows, groups = [], []
    passage = text(50)
    for _ in range(25):
        base = text(200)
        group = [" ".join(base)]
        for _ in range(3):
            copy = list(base)
            copy[int(rng.integers(200))] = "changed"
            group.append(" ".join(copy))
        start = len(rows)
        rows += [(start + k, t) for k, t in enumerate(group)]
        groups.append(set(range(start, start + 4)))
    alone = {len(rows) + k for k in range(25)}
    rows += [(i, " ".join(text(100) + passage + text(80))) for i in sorted(alone)]
    kept = {r.doc_id for r in near_text.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == alone | {min(g) for g in groups}
    left = near_text.keep_one(docs)
    ids = sorted(str(r.doc_id) for r in left.collect())
    assert ids == sorted(["1", "3", "6", "7", "8", "9", "None", "10", "11"]) and left.columns == docs.columns
    assert near_text.keep_one(empty).count() == 0


def graded(rng, n, families=3):
    """Texts of which each is a base text with a share of its words changed, so that many pairs lie about 0.8."""
    out = []
    for f in range(families):
        base = [f"f{f}w{k}" for k in rng.integers(0, 5000, 300)]
        for _ in range(n):
            copy = list(base)
            for at in rng.integers(0, 300, int(rng.integers(3, 12))):
                copy[at] = f"c{rng.integers(1 << 40)}"
            out.append(" ".join(copy))
    return out


def brute_groups(texts):
    """The kept rows where every two texts are compared, and how similar they are."""
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return {i for i in range(len(texts)) if top(i) == i}


def test_near_text_large_groups_against_brute_force(spark):
    """Over 16 graded variants in a group: a candidate that is rejected must not hide one that is not."""
    texts = graded(np.random.default_rng(31), 60)
    kept = {r.doc_id for r in near_text.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert kept == brute_groups(texts)


def test_near_text_takes_nothing_below_the_similarity(spark):
    """Pairs a little below and a little above 0.8, each of its own words, of which signatures alone take some wrongly."""
    rows, want = [], set()
    for k in range(1500):
        base = [f"p{k}w{i}" for i in range(104)]
        changed = 12 if k % 2 else 11  # of 100 shingles: 88 / 112 = 0.786, 89 / 111 = 0.802
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base[: 104 - changed] + [f"q{k}w{i}" for i in range(changed)]))]
        want |= {2 * k} | ({2 * k + 1} if k % 2 else set())
    kept = {r.doc_id for r in near_text.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == want


def test_family_chunks_meet(spark):
    texts = graded(np.random.default_rng(32), 40)
    df = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    members = df.selectExpr("node", "node div 40 AS family")
    for chunk, proxies in ((12_000, 8), (12_000, 1), (2_000_000, 8)):  # families of several chunks, with few texts that stand for a component, and of one
        linked = near_text.connected(near_text.family_links(members, df, chunk=chunk, proxies=proxies))
        assert set(range(len(texts))) - {r.node for r in linked.collect()} == brute_groups(texts)


def test_licenses(docs, empty):
    got = {str(r.doc_id): r for r in licenses.scan(docs).collect()}
    assert got["8"].base_labels == "mit" and got["8"].n_base == 1 and got["8"].first_word == 1 and got["8"].score == 1
    assert got["9"].n_base == 1 and got["9"].first_word == got["9"].last_word == 7 and got["3"].n_words == 0 and got["3"].first_word is None
    assert licenses.places("a b a b a".encode().split(), "a b a") == [0, 2]
    assert licenses.scan(empty).count() == 0


NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "apache-2": "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\n\nUnless required by applicable law or agreed to in writing,",
    "gpl-2": "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.",
    "cc-by-sa": "Licensed under\nCC BY-SA 4.0",
    "lgpl-3": "This work is licensed under the\nGNU Lesser General Public License, version 3",
}


@pytest.mark.parametrize("prefix", ["", "# ", " * ", "// "])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_wrapped_license_notices(prefix, end):
    index = licenses.Index(licenses.templates({}))
    found = lambda lines: {m.template.label for m in licenses.settle(index.matches(licenses.words_of(end.join(lines).encode())))}
    for label, notice in NOTICES.items():
        lines = [prefix + x for x in ("Copyright (c) 2020 A. Person", "", *notice.split("\n"), "", "More words.")]
        assert found(lines) == {label}
        first = lines[2].split()
        half = len(first) // 2
        assert found([" ".join(first[:half]), prefix, " ".join(first[half:]), *lines[3:]]) == {label}
        assert found([" ".join(notice.split()[:4])]) == set()


def test_whole_licenses_match_themselves_alone():
    index = licenses.Index(licenses.templates({}))
    for label, text in licenses.TEMPLATES:
        words = licenses.words_of(("before it " * 40 + text + " and after " * 40).encode())
        assert {m.template.label for m in licenses.settle(index.matches(words))} == {label}


def test_license_join_is_exact():
    """Every window of every text against every template, by counting."""
    rng = np.random.default_rng(8)
    given = [(f"l{k}", " ".join(f"t{i}" for i in rng.choice(30, int(rng.integers(1, 12))))) for k in range(20)]
    index = licenses.Index(licenses.templates({f"t{i}".encode(): int(rng.integers(99)) for i in range(30)}, given, 0.6))
    for n in rng.integers(0, 80, 400):
        words = [f"t{i}".encode() for i in rng.choice(60, n)]
        want = {}
        for t in index.templates:
            shares = [len(set(words[i : i + t.window]) & set(t.words)) for i in range(len(words))]
            if max(shares, default=0) >= 0.6 * len(t.words):
                want[t] = max(shares)
        got = {}
        for m in index.matches(words):
            assert len(set(words[m.first : m.last + 1]) & set(m.template.words)) == m.common >= m.template.needed and m.last - m.first < m.template.window
            got[m.template] = max(got.get(m.template, 0), m.common)
        assert got == want


def test_license_scan_against_brute_force(spark):
    rng = np.random.default_rng(12)
    parts = ["under the MIT license", "CC-BY\nNC", "apache License, version 2", "cc by nc by nc", "word", "Ünder", "the", "MIT", "licence\x00license", "é", "-", "under"]
    texts = [" ".join(parts[k] for k in rng.integers(0, len(parts), n)) for n in rng.integers(0, 30, 200)] + [None, ""]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = [(k, label) for phrase, label in licenses.PHRASES for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in at})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_mixing(docs, empty):
    rows = mixing.mix_report(docs).collect()
    total = sum(r.size for r in rows)
    targets = {(r.source_size, r.target) for r in rows}
    assert abs(sum(t for _, t in targets) - total) < 1e-6 and all(t <= 3 * s for s, t in targets) and all(r.taken <= 3 * r.size for r in rows)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    taken = Counter()
    for r in rows:
        taken[str(r.doc_id)] += r.taken
    sizes = Counter()
    for r in mixed.collect():
        sizes[str(r.doc_id)] += len(words(r.text))
    assert +taken == +sizes and mixing.mix(empty).count() == 0


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = []
    for label in (0, 1):
        centres = rng.normal(size=(40, 16))
        for i in range(300):
            rows.append((centres[i % 40] + rng.normal(size=16) * 0.05 * (i % 5)).tolist() if i % 3 else rng.normal(size=16).tolist())
    rows = [(i, v, i // 300) for i, v in enumerate(rows)]
    rows += [(600, rows[0][1], 0), (601, [0.0] * 16, 0), (602, None, 0), (603, [float("nan")] + [1.0] * 15, 0), (604, rows[0][1], None), (605, [None] + [1.0] * 15, 1), (606, [1.0, 2.0], 0), (607, [2.0, 4.0], 0), (608, [3.0] * 16, 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), chunk_rows=32).collect()}
    good = {i: np.array(v, np.float32).astype(float) for i, v, label in rows if label is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    label = {i: x for i, _, x in rows}
    links, part = Counter(), {i: i for i, *_ in rows}
    for i, j in combinations(sorted(good), 2):
        a, b = good[i], good[j]
        if label[i] == label[j] and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
            links[i] += 1
            links[j] += 1
            x, y = part[i], part[j]
            if x != y:
                part = {k: min(x, y) if p in (x, y) else p for k, p in part.items()}
    assert got == {i: (links[i], part[i], part[i] == i) for i in part}
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_embedding_recall(spark):
    """20,000 vectors about 5,000 centres: links at the cosine's edge, all compared."""
    rng = np.random.default_rng(13)
    centres = rng.normal(size=(5000, 64))
    x = (centres[rng.integers(5000, size=20_000)] + rng.normal(size=(20_000, 64)) * rng.uniform(0.05, 0.2, (20_000, 1))).astype(np.float32)
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int")
    got = dict(embeddings.near_duplicates(df).select("vec_id", "n_links").collect())
    unit = embeddings.unit(x.astype(float))
    want = np.concatenate([(unit[at : at + 1000] @ unit.T >= 0.98).sum(1) - 1 for at in range(0, len(unit), 1000)])
    assert want.sum() > 10_000 and all(got[i] <= n for i, n in enumerate(want)) and sum(got.values()) >= 0.99 * want.sum()


def test_toxicity(docs, empty):
    rng = np.random.default_rng(10)
    clean = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma"], 40))
    toxic = [clean() + " nastyword " + clean() for _ in range(120)]
    model = toxicity.train(toxic[:80], [clean() for _ in range(270)] + toxic[80:110], 0.1)
    s = toxicity.score(model, [clean(), clean() + " nastyword", clean() * 30 + " nastyword", ""])
    assert s[0] < 0.5 and s[1] > 0.5 and s[2] > 0.5 and s[3] < 0.5
    assert toxicity.scored(docs, model).count() == 13 and toxicity.scored(empty, model).count() == 0
    assert toxicity.keep_clean(docs, model).columns == docs.columns and (toxicity.score(toxicity.Model.empty(), ["a"]) == 0).all()


def test_risk_steps_against_the_formula():
    """The slope that a step follows is that of the risk, or of the unlabelled part alone, up, where that is below zero."""
    rng = np.random.default_rng(14)
    for prior in (0.05, 0.6):
        toxic = np.arange(30) < 10
        z = rng.normal(size=30)
        loss = lambda x, y: toxicity.sigmoid(-y * x)
        inner = lambda x: loss(x[~toxic], -1).mean() - prior * loss(x[toxic], -1).mean()
        risk = lambda x: prior * loss(x[toxic], 1).mean() + inner(x) if inner(x) >= 0 else -inner(x)
        want = [(risk(z + 1e-6 * (np.arange(30) == i)) - risk(z - 1e-6 * (np.arange(30) == i))) / 2e-6 for i in range(30)]
        assert np.allclose(toxicity.risk_slopes(z, toxic, prior), want, atol=1e-7)


def test_toxicity_on_held_out_rows(spark, sf_dir):
    """On sf0.1 some labels follow no word; training by the risk must do better than the weights that it starts from."""
    d = sf_dir.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    y = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect() if r.doc_id in y}
    ids = sorted(texts)
    truth = np.array([y[i] for i in ids])
    right = {}
    for steps in (0, toxicity.STEPS):
        found = toxicity.score(toxicity.learn(docs, labels, steps=steps), [texts[i] for i in ids]) >= 0.5
        right[steps] = (found[truth == 1].mean(), found[truth == 0].mean(), (found == (truth == 1)).mean())
    assert right[toxicity.STEPS][0] >= 0.82 and right[toxicity.STEPS][1] <= 0.02 and right[toxicity.STEPS][2] > right[0][2], right


def test_learning_from_odd_labels(spark, docs, empty):
    """No labels, null ones, one kind only, ids that repeat in documents."""
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = spark.createDataFrame([(1, None, None), (2, 1, 0), (9, 0, 1), (9, 0, 1), (None, 1, 1)], none.schema)
    for labels in (none, odd):
        for table in (docs, empty):
            assert toxicity.evaluate(table, labels).count() == table.count()
            assert quality.judge(table, quality.learn(quality.labelled_rows(table, labels))).count() == table.count()
    assert len(quality.labelled_rows(docs, odd)) == 3 and len(quality.labelled_rows(docs, odd, most=2)) == 2
    assert language.evaluate(empty).count() == 0
    nulls = spark.createDataFrame([(i, t, None, None, 1, 7, "clash") for i, t, *_ in ROWS], DOCS)
    assert {r.lang_pred for r in language.evaluate(nulls).collect()} == {"und"}


def test_language_sample_is_shared_out(spark):
    rows = [(i, "word " * 2000 if i % 7 == 0 else f"text {i}", "rare" if i % 100 == 1 else "common") for i in range(2000)]
    got = language.training_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string"), most=60, chars=100)
    n = Counter(x for _, x in got)
    assert language.quotas({"a": 5, "b": 100, "c": 100}, 60) == {"a": 5, "b": 27, "c": 28}
    assert n["rare"] == sum(i % 100 == 1 and zlib.crc32(str(i).encode()) % 4 != 2 for i in range(2000)) and n["common"] == 60 - n["rare"] and max(len(t) for t, _ in got) == 101


def test_held_out_accuracy(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.01")
    got = {r.doc_id: r for r in registry.queries()["op3_language"](spark, d).collect()}
    rows = [(got[r.doc_id], r.lang) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect() if r.lang]
    held = [g.lang_pred == lang for g, lang in rows if g.held_out]
    assert len(held) > 100 and np.mean(held) > 0.9
    assert all(g.held_out == (zlib.crc32(str(g.doc_id).encode()) % 4 == 2) for g, _ in rows)


def test_pipeline_stages_work_on_what_is_left(spark, sf_dir):
    import corpus_pipeline

    before = None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir).cache()
        if k < 4:
            assert docs.columns == columns
        if k < 3:
            now = {r.doc_id for r in docs.select("doc_id").collect()}
            assert before is None or now <= before
            before = now
    assert {r.doc_id for r in docs.select("doc_id").collect()} <= before
