"""Near-duplicate classes, paragraph removals and repeated strings against brute force."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np

from cases import ascii_lower, messy, nothing, rows, words_of  # noqa: F401
from tailgauge.llm import bagminhash, paragraph_dedup, run_length_dedup
from tailgauge.llm.components import connected_components
from tailgauge.llm.words import mixed


def bag_of(words):
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else None


def jaccard(a, b):
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


def classes(bags: dict, similarity=0.8) -> dict:
    parent = {k: k for k in bags}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(bags, 2):
        if jaccard(bags[a], bags[b]) >= similarity:
            parent[find(a)] = find(b)
    return {k: find(k) for k in bags}


def expected_classes(rows):
    nodes = defaultdict(list)
    for row in rows:
        nodes[tuple(ascii_lower(x) for x in words_of(row[1]))].append(row[0])
    nodes.pop((), None)
    found = classes({k: bag_of(list(k)) for k in nodes})
    members = defaultdict(list)
    for node, name in found.items():
        members[name] += nodes[node]
    out = []
    for ids in members.values():
        known = [i for i in ids if i is not None]
        out += [(i, min(known) if known else None, len(ids)) for i in ids]
    out += [(r[0], r[0], 1) for r in rows if not words_of(r[1])]
    return sorted(out, key=str)


def test_near_duplicates_equal_brute_force(messy, rows):
    got = [tuple(r) for r in bagminhash.near_duplicates(messy).collect()]
    assert sorted(got, key=str) == expected_classes(rows)


def test_crowded_bands_lose_no_link(spark):
    base = [f"w{i}" for i in range(60)]
    variants = []
    for i in range(60):
        words = list(base)
        for k in range(3):
            words[(7 * i + 19 * k) % 60] = f"v{i}x{k}"
        variants.append((i, " ".join(words)))
    docs = spark.createDataFrame(variants, "doc_id long, text string")
    got = [tuple(r) for r in bagminhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == expected_classes(variants)


def test_one_of_each_class_is_kept(messy, rows, nothing):
    kept = bagminhash.keep_one(messy)
    assert kept.columns == messy.columns
    want = {(i, c) for i, c, _ in expected_classes(rows)}
    assert Counter(r.doc_id for r in kept.collect() if r.doc_id is not None) == Counter({i for i, c in want if i == c and i is not None})
    assert bagminhash.keep_one(nothing).count() == 0


def test_rows_of_one_id_are_kept_by_their_texts(spark):
    x, y = "one two three four five six seven eight", "other words that nobody else has written here today"
    rows = [(1, x, "a"), (5, x, "b"), (5, y, "c"), (5, y, "c"), (7, y, "d"), (None, x, "e"), (9, None, "f"), (9, None, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone_id string")
    kept = Counter(tuple(r) for r in bagminhash.keep_one(docs).collect())
    assert kept == Counter([rows[0], rows[2], rows[5], rows[6], rows[7]])


def test_signatures_are_unbiased():
    rng = np.random.default_rng(3)
    a = {int(k): int(rng.integers(1, 30)) for k in rng.integers(0, 10**9, 50)}
    b = {k: max(1, v + int(rng.integers(-4, 5))) for k, v in a.items()}
    rows = [(d, k, w) for d, bag in enumerate((a, b)) for k, w in bag.items()]
    document, shingle, weight = (np.array(x) for x in zip(*rows))
    points = bagminhash.signatures(document, mixed(shingle.astype(np.uint64)) >> np.uint64(16), weight, 2, 2048)
    want = sum(min(a[k], b[k]) for k in a) / sum(max(a[k], b[k]) for k in a)
    assert abs((points[0] == points[1]).mean() - want) < 0.05


def test_components(spark):
    edges = [(f"{i:04d}", f"{i + 1:04d}") for i in range(300) if i % 50] + [("hub", f"s{i}") for i in range(200)] + [("z", "z"), (None, "z")]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got["hub"] == got["s7"] == "hub" and got["0003"] == got["0050"] == "0001" and got["0051"] == "0051"
    assert "z" not in got
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def removed_by_brute_force(rows, length):
    seen = Counter()
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    for _, b in texts:
        seen.update(b[i : i + length] for i in range(len(b) - length + 1))
    out = []
    for doc_id, b in texts:
        gone, last = bytearray(len(b)), 0
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[max(i, last) : i + length] = b"\1" * (i + length - max(i, last))
                last = i + length
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        left = bytes(x for x, g in zip(b, gone) if not g)
        out.append((doc_id, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def test_repeated_strings_equal_brute_force(messy, rows, nothing):
    want = removed_by_brute_force(rows, 200)
    for windows in (run_length_dedup.Windows(), run_length_dedup.Windows(most_pieces=1)):
        got = [tuple(r) for r in run_length_dedup.removal_report(messy, windows).collect()]
        assert sorted(got, key=str) == want
    assert run_length_dedup.removal_report(nothing).count() == 0


def test_cut_documents_keep_rows_and_columns(messy, rows):
    left = run_length_dedup.without_repeats(messy)
    assert left.columns == messy.columns and left.count() == len(rows)
    assert all(r.text is None or r.n_chars == len(r.text) for r in left.collect())


def test_run_length_index_gives_matching_statistics():
    rng = np.random.default_rng(5)
    for _ in range(20):
        strings = [bytes(rng.choice(list(b"ab"), rng.integers(1, 25)).tolist()) for _ in range(rng.integers(1, 9))]
        index = run_length_dedup.RunLengthIndex(strings)
        got = index.statistics()
        for i, s in enumerate(strings):
            for p in range(len(s)):
                others = [t[q:] for j, t in enumerate(strings) for q in range(len(t)) if (i, p) != (j, q)]
                best = max((next((k for k in range(min(len(x), len(s) - p)) if x[k] != s[p + k]), min(len(x), len(s) - p)) for x in others), default=0)
                assert got[index.starts[i] + p] == best


def test_paragraphs_equal_brute_force(messy, rows, nothing):
    lines = set()
    for row in rows:
        for i, line in enumerate((row[1] or "").split("\n")):
            words = tuple(ascii_lower(x) for x in words_of(line))
            if words:
                lines.add((row[0], row[1], i, words))
    named = classes({w: bag_of(list(w)) for w in {x[3] for x in lines} if len(w) >= 5})
    groups = defaultdict(list)
    for doc_id, text, i, words in lines:
        groups[named.get(words, words)].append((doc_id is not None, doc_id or 0, i, text))
    gone = Counter()
    for found in groups.values():
        for known, doc_id, i, text in sorted(found)[1:]:
            gone[doc_id if known else None, text] += 1
    got = paragraph_dedup.removal_report(messy).collect()
    assert sum(r.n_removed for r in got) == sum(gone.values())
    assert {r.doc_id: r.n_removed for r in got if r.doc_id is not None} == {
        r[0]: gone[r[0], r[1]] for r in rows if r[0] is not None
    }
    assert paragraph_dedup.without_paragraphs(messy).columns == messy.columns
    assert paragraph_dedup.removal_report(nothing).count() == 0


def test_paragraphs_with_repeated_phrases_are_compared_as_multisets(spark):
    made, near, far = [], [], []
    for i in range(20):
        phrase = " ".join(f"w{i}x{k}" for k in range(5))
        tails = [" ".join(f"t{i}{side}{k}" for k in range(10)) for side in "ab"]
        a, b = (f"{phrase} " * 40 + tail for tail in tails)
        assert jaccard(bag_of(a.split()), bag_of(b.split())) > 0.87
        near.append(2 * i + 1)
        made += [(2 * i, a), (2 * i + 1, b)]
        phrase = " ".join(f"v{i}x{k}" for k in range(5))
        far.append(1000 + 2 * i + 1)
        made += [(1000 + 2 * i, (f"{phrase} " * 40).strip()), (1000 + 2 * i + 1, (f"{phrase} " * 20).strip())]
    got = paragraph_dedup.removal_report(spark.createDataFrame(made, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got if r.n_removed) == near


def test_occurrences_are_numbered_within_their_document():
    document = np.array([0, 0, 0, 1, 1])
    shingle = np.array([7, 8, 7, 7, 7], np.uint64)
    got = paragraph_dedup.numbered(document, shingle)
    assert sorted(got[[0, 2]].tolist()) == sorted(got[[3, 4]].tolist()) and len(set(got.tolist())) == 3
    assert len(paragraph_dedup.numbered(document[:0], shingle[:0])) == 0


def test_passages_inside_lines_go_and_short_lines_stay(spark):
    import random

    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    made, planted = [], []
    for i in range(40):
        passage = words(55)
        for k in range(2):
            # in the middle of a line, or across line ends
            text = words(40 + 7 * k) + passage + words(30)
            made.append((2 * i + k, " ".join(text) if i % 2 else " ".join(x + "\n" * (j % 23 == 5 * k) for j, x in enumerate(text))))
        planted.append(2 * i + 1)
    made += [(1000 + i, "a short line\n" + " ".join(words(60)) + "\nand one more") for i in range(40)]
    made += [(2000, None), (2001, ""), (2002, "one"), (2003, made[0][1]), (2003, made[0][1])]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    got = paragraph_dedup.removal_report(docs, paragraph_dedup.PASSAGES).collect()
    assert len(got) == len(made) - 1
    removed = {r.doc_id for r in got if r.n_removed}
    assert removed <= {*planted, 2003} and 2003 in removed and len(removed) >= 39
    for r in got:
        assert r.passage_words <= (55 if r.doc_id != 2003 else r.n_words) and r.n_removed >= r.n_passages


def test_pieces_are_cut_within_their_text_alone():
    rng = np.random.default_rng(2)
    counts = np.array([0, 1, 30, 2, 0, 200, 13])
    hashes = mixed(rng.integers(0, 50, counts.sum()).astype(np.uint64))
    whole = paragraph_dedup.piece_starts(hashes, counts, 6)
    want, before = [], 0
    for n in counts.tolist():
        one = hashes[before : before + n]
        pairs = [int(mixed(mixed(one[i : i + 1]) * np.uint64(0x9E3779B97F4A7C15) + one[i + 1 : i + 2])[0]) for i in range(n - 1)]
        want += [before + i for i in range(n) if i == 0 or i < n - 1 and pairs[i] == min(pairs[max(0, i - 6) : i + 7])]
        before += n
    assert whole.tolist() == want


def test_crowded_squares_return_no_circles(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [(f"{i:03d}".encode(), " ".join([*words[:50], f"x{i}"])) for i in range(40)]
    nodes = spark.createDataFrame(texts, "node binary, text string")
    members = nodes.selectExpr("node", "1L AS band")
    labels = spark.createDataFrame([], "node binary, component binary")
    links = bagminhash.crowded_links(members, nodes, labels, bagminhash.Bands())
    assert links.count() < len(texts)
    found = {r.component for r in connected_components(links).collect()}
    assert found == {b"000"} and connected_components(links).count() == len(texts)
