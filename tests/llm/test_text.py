"""Decontamination, encoding, language ID, quality, licenses, scoring and sharding against plain versions."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from cases import ascii_lower, messy, nothing, prose, rows, words_of  # noqa: F401

from tailgauge.llm import (
    bpe_tree,
    context_mixing,
    histogram_sort,
    license_scan,
    ppm_language,
    suffix_automaton,
    suffix_repetition,
)
from tailgauge.llm.queries import vocabulary


def by_id(found):
    return {r.doc_id: r for r in found if r.doc_id is not None}


@pytest.fixture(scope="module")
def items(spark, rows):
    long = rows[2][1].split()
    out = [(1, " ".join(long[10:40])), (2, " ".join(long[20:60]).upper()), (3, "12 34"), (4, ""), (5, None), (6, "and again"), (1, " ".join(long[10:40]))]
    return spark.createDataFrame([(*x, 1) for x in out], "item_id long, text string, n_words long")


def contamination(text, items):
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    words = pattern.findall(ascii_lower(text or ""))
    hit, found = set(), set()
    for name, item in items:
        w = pattern.findall(ascii_lower(item or ""))
        n = min(13, len(w))
        windows = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for i in range(len(words) - n + 1) if n else ():
            if tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(name))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


@pytest.mark.parametrize("block_bytes", [8 << 20, 100])
def test_contamination_equals_brute_force(messy, rows, items, block_bytes):
    known = [(r.item_id, r.text) for r in items.collect()]
    got = suffix_automaton.contamination_report(messy, items, block_bytes=block_bytes).collect()
    assert len(got) == len(rows)
    want = Counter((r[0], *contamination(r[1], known)) for r in rows)
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got) == want
    assert all(r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in got)
    clean = suffix_automaton.keep_clean(messy, items, block_bytes=block_bytes)
    assert clean.columns == messy.columns and clean.count() == sum(not r.contaminated for r in got)


def test_no_items_and_no_documents(messy, items, nothing):
    assert suffix_automaton.contamination_report(messy, items.where("false")).where("n_hit > 0").count() == 0
    assert suffix_automaton.contamination_report(nothing, items).count() == 0


def test_tokens_equal_the_library_and_decode(messy, rows, nothing):
    import tiktoken

    path, pattern = vocabulary()
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe_tree.read_ranks(path), special_tokens={})
    want = Counter()
    for r in rows:
        ids = own.encode_ordinary(r[1] or "")
        text = hashlib.sha256((r[1] or "").encode()).hexdigest()
        want[r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), text] += 1
    got = bpe_tree.encoded(messy, path, pattern)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == want
    assert bpe_tree.encoded(nothing, path, pattern).count() == 0


def test_tree_joins_long_runs_and_odd_characters():
    import tiktoken

    path, pattern = vocabulary()
    own = bpe_tree.Tokenizer(path, pattern)
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe_tree.read_ranks(path), special_tokens={})
    odd = ["a" * 997, "ab" * 500 + "c", "é" * 333, "\x1c\x1d \x85 x", "  two  spaces \n\n x", "don't'll've", "中文字" * 100, "\r\n \t x  "]
    for text in odd:
        assert own.ids(text) == library.encode_ordinary(text)
        assert own.encoder.decode(own.ids(text)) == text.encode()


def test_language_is_learned_and_held_out_rows_are_recognised(spark, messy, nothing):
    import random

    rng = random.Random(11)
    made = [(i, prose(rng, "en" if i % 2 else "de", 30), "en" if i % 2 else "de") for i in range(300)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string")
    got = by_id(ppm_language.language_id(docs, sample_docs=40).collect())
    held = [i for i, _, _ in made if got[i].held_out]
    assert set(held) == {i for i, _, _ in made if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(got[i].lang_pred == made[i][2] for i in held) >= 0.97 * len(held)
    odd = ppm_language.language_id(messy).collect()
    assert len(odd) == messy.count() and all(0 <= r.score <= 1 for r in odd)
    texts = {r.doc_id: r.text for r in messy.collect()}
    letters = {i: bool(re.search(r"[^\W\d_]", x or "")) for i, x in texts.items()}
    assert all((r.lang_pred == "und") == (not letters[r.doc_id]) for r in odd if r.doc_id is not None)
    kept = ppm_language.keep_known(messy)
    assert kept.columns == messy.columns and all(letters[r.doc_id] for r in kept.collect() if r.doc_id is not None)
    assert ppm_language.language_id(nothing).count() == 0
    assert ppm_language.keep_known(nothing).count() == 0


def test_a_language_of_long_texts_only_is_learned(spark):
    import random

    rng = random.Random(2)
    short = [(i, prose(rng, "de", 40), "de") for i in range(30)]
    long = [(100 + i, prose(rng, "en", 2500), "en") for i in range(30)]
    docs = spark.createDataFrame(short + long, "doc_id long, text string, lang string")
    for _ in range(2):
        found = {r.doc_id: r.lang_pred for r in ppm_language.language_id(docs).collect()}
        assert all(found[i] == lang for i, _, lang in short + long)


def test_context_trees_are_distributions():
    import numpy as np

    rng = np.random.default_rng(2)
    grams = np.unique(np.column_stack([rng.integers(0, 2, 400), rng.integers(97, 103, (400, 4))]), axis=0)
    trees = ppm_language.ContextTrees.build(["a", "b"], grams, rng.integers(1, 9, len(grams)).astype(float), 50)
    symbols = round(len(trees.row) ** (1 / 3))
    assert np.allclose(np.exp2(-trees.bits.reshape(-1, symbols, 2)).sum(1), 1, atol=1e-4)


def repetition(text, shortest):
    w = words_of(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    windows = defaultdict(list)
    for i in range(len(w) - 2):
        windows[tuple(w[i : i + 3])].append(i)
    repeat = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    by_start, covered, longest = defaultdict(list), set(), 0
    for i in range(len(w) - shortest + 1):
        by_start[tuple(w[i : i + shortest])].append(i)
    for at in by_start.values():
        for i in at if len(at) > 1 else ():
            for j in at:
                k = 0
                while i != j and i + k < len(w) and j + k < len(w) and w[i + k] == w[j + k]:
                    k += 1
                longest = max(longest, k)
                covered |= set(range(i, i + k))
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, dup, len(repeat), len(covered), longest


def test_repetition_equals_brute_force(messy, rows, nothing):
    short = [r for r in rows if len(r[1] or "") < 20_000]
    got = defaultdict(set)
    for r in suffix_repetition.quality(messy).collect():
        got[r.doc_id].add((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.covered_words, r.longest_repeat))
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    for r in short:
        assert repetition(r[1], 6) in got[r[0]]
    assert suffix_repetition.quality(nothing).count() == 0


def test_licenses_are_found_whole_and_edited(spark, messy, nothing):
    text = license_scan.TEMPLATES[2][1]
    words = text.split()
    edited = " ".join(words[:30] + ["other"] + words[31:])
    made = [
        (1, f"x y z {text} and more"), (2, f"{'filler ' * 50}{edited}"), (3, " ".join(words[:15])),
        (4, "Licensed under the Apache License, Version 2.0."), (4, "Licensed under the Apache License, Version 2.0."),
        (5, "licensed under the apache"), (6, None), (7, ""), (8, "This is no license text of any kind at all"),
    ]
    docs = spark.createDataFrame([(*x, "t", 0.0) for x in made], "doc_id long, text string, template string, containment double")
    got = {(r.doc_id, r.template): r for r in license_scan.license_matches(docs).collect()}
    assert set(got) == {(1, 2), (2, 2), (4, 3)}
    assert got[1, 2].containment == 1 and got[1, 2].start == 3 and 0.8 <= got[2, 2].containment < 1
    assert license_scan.license_matches(messy).count() == 0 and license_scan.license_matches(nothing).count() == 0


@pytest.mark.parametrize("frequent", [1 << 17, 20])
def test_scores_and_base(messy, rows, nothing, frequent):
    model = context_mixing.Mixing(slot_bits=16, frequent=frequent)
    got = context_mixing.language_model_scores(messy, m=model).collect()
    assert len(got) == len(rows) and all(r.score < 0 for r in got)
    tokens = lambda x: [ascii_lower(w) for w in words_of(x)] + [None]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts = Counter(t for r in rows if not out(r[0]) for t in tokens(r[1]))
    total, kinds = sum(counts.values()), len(counts)
    want = Counter()
    for r in rows:
        base = sum(math.log10((counts[t] + 1) / (total + kinds + 1)) for t in tokens(r[1]))
        want[r[0], out(r[0]), len(tokens(r[1])), sum(counts[t] > 0 for t in tokens(r[1])), total, round(base, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert context_mixing.language_model_scores(nothing, m=model).count() == 0


def check_shards(got, shards, tolerance):
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r)
    total = sum(r.size for r in got)
    largest = max(r.size for r in got)
    for found in by_shard.values():
        assert sorted(r.slot for r in found) == list(range(len(found)))
        ordered = [(r.text_crc32, -(1 << 63) if r.doc_id is None else r.doc_id) for r in sorted(found, key=lambda r: r.slot)]
        assert ordered == sorted(ordered)
        assert abs(sum(r.size for r in found) - total / shards) <= 2 * (largest + tolerance * total / shards)


def test_shards_are_even_ordered_and_gapless(spark, messy, rows, nothing):
    got = histogram_sort.shard_documents(messy, 3).collect()
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    check_shards(got, 3, 0.002)
    assert histogram_sort.shard_documents(nothing).count() == 0


def test_one_text_of_most_rows_is_divided_by_id(spark):
    made = [(i * 10**15 - (1 << 62), "the same") for i in range(500)] + [(i, f"other {i}") for i in range(100)]
    got = histogram_sort.shard_documents(spark.createDataFrame(made, "doc_id long, text string")).collect()
    check_shards(got, 8, 0.002)
    assert len({r.shard for r in got if r.size == 9}) > 4


def test_mixing_codes_a_text_as_one_and_knows_short_contexts():
    import numpy as np

    m = context_mixing.Mixing()
    assert set(m.orders) == {1, 2, 3, 4, context_mixing.WORD}
    rng = np.random.default_rng(3)
    sizes = np.array([700, 3000, 1, 2500])
    inputs = [rng.normal(0, 2, (50, 8)).astype(np.float32) for _ in range(2)]
    pairs = [rng.integers(0, 50, sizes.sum()) for _ in range(2)]
    starts = np.cumsum(sizes) - sizes
    want = []
    for begin, size in zip(starts, sizes):
        weights, bits = np.full((2, 8), m.weight), 0.0
        for t in range(begin, begin + size):
            x = np.array([a[p[t]] for a, p in zip(inputs, pairs)], float)
            odds = np.clip((x * weights).sum(0), -12, 12)
            bits += np.log1p(np.exp(-odds)).sum()
            weights += m.rate * x / (1 + np.exp(odds))
        want.append(bits)
    assert np.allclose(context_mixing.code_lengths(inputs, pairs, starts, sizes, m), want, rtol=1e-3)


def test_bits_per_byte_are_the_whole_code_length(messy):
    got = context_mixing.language_model_scores(messy).collect()
    sizes = {r.doc_id: len((r.text or "").encode()) + 1 for r in messy.collect()}
    for r in got:
        if r.doc_id is not None:
            assert math.isclose(r.bits_per_byte * sizes[r.doc_id], -r.score * math.log2(10), rel_tol=1e-9)


def test_counts_of_contexts_are_whole_and_grow_with_the_texts(spark):
    import random

    m = context_mixing.Mixing(orders=(2, 4, context_mixing.WORD), slot_bits=4)
    rng = random.Random(4)
    texts = ["".join(chr(rng.randrange(97, 123)) for _ in range(300)) + f" Aé {i}" for i in range(60)]
    got = context_mixing.gather(spark.createDataFrame([(x,) for x in texts], "text string"), m).where("kind > 0")
    want = {1: Counter(), 2: Counter()}
    for x in texts:
        coded = b"\0" * 4 + x.encode() + b"\0"
        for i in range(4, len(coded)):
            for kind, order in ((1, 2), (2, 4)):
                want[kind][int.from_bytes(coded[i - order : i][::-1]), coded[i]] += 1
    found = got.collect()
    for kind in want:
        assert Counter({(r.key, r.byte): r.n for r in found if r.kind == kind}) == want[kind]
    assert len(want[2]) > 1 << 12
    words = Counter((ascii_lower(x[: i]).split(" ")[-1], c) for y in texts for x in [y] for i, c in enumerate(x + "\0") if ord(c) < 128 and "é" not in x[:i])
    assert sum(r.n for r in found if r.kind == 3) == sum(want[1].values()) and len({r.key for r in found if r.kind == 3}) >= len({w for w, _ in words})


def test_followers_give_the_odds_of_every_node():
    import numpy as np

    m = context_mixing.Mixing()
    counts = {5: {97: 3, 98: 1, 0: 2}, 0: {255: 4}}
    lists = np.array([n * 256 + b for x in counts.values() for b, n in x.items()])
    followers = context_mixing.Followers.of(np.array(list(counts)), lists, np.array([0, 3, 4]))
    number, byte = np.array([5, 5, 0, 7]), np.array([97, 200, 255, 97])
    got = followers.odds(number, byte, m)
    for i, (a, b) in enumerate(zip(number, byte)):
        for k in range(8):
            same = [n for c, n in counts.get(a, {}).items() if c >> (8 - k) == b >> (8 - k) and (c ^ b) >> (7 - k) == 0]
            other = [n for c, n in counts.get(a, {}).items() if (c ^ b) >> (7 - k) == 1]
            assert math.isclose(got[i, k], math.log((sum(same) + m.smoothing) / (sum(other) + m.smoothing)), abs_tol=1e-5)


def test_scores_do_not_depend_on_the_batches(messy):
    one, many = (
        sorted((str(r.doc_id), r.score) for r in context_mixing.language_model_scores(messy, m=context_mixing.Mixing(batch=x)).collect())
        for x in (8 << 20, 500)
    )
    assert [x[0] for x in one] == [x[0] for x in many]
    assert all(math.isclose(a[1], b[1], rel_tol=1e-5) for a, b in zip(one, many))


def test_whole_documents_are_sharded(spark, messy, nothing):
    got = histogram_sort.shard_documents(messy, 3)
    assert set(messy.columns) <= set(got.columns)
    assert Counter(map(tuple, got.select(messy.columns).collect())) == Counter(map(tuple, messy.collect()))
    for r in got.collect():
        assert r.size == len((r.text or "").encode()) + 1 and r.text_crc32 == zlib.crc32((r.text or "").encode())
    folders = {f.rsplit("/", 2)[1] for f in got.inputFiles()}
    assert {"shard=0", "shard=1", "shard=2"} <= folders
    assert histogram_sort.shard_report(nothing).count() == 0
    clash = messy.selectExpr("doc_id", "text", "1 AS shard", "'x' AS size", "2 AS place", "3 AS id")
    check_shards(histogram_sort.shard_documents(clash, 3).collect(), 3, 0.002)


@pytest.mark.parametrize("size", [4, 8])
def test_shared_halves_give_the_bands_of_whole_windows(spark, size):
    from pyspark.sql import functions as F

    scan = license_scan.Scan()
    texts = [(i, " ".join(f"w{(i * k) % 11}" for k in range(i))) for i in range(0, 60, 3)]
    hashes = spark.createDataFrame(texts, "n int, text string").select("n", license_scan.shingle_hashes(F.col("text"), scan).alias("h"))
    shared = hashes.select("n", F.explode(license_scan.window_bands(F.col("h"), size, size // 2, scan)).alias("w"))
    single = hashes.select("n", F.explode(license_scan.window_bands(F.col("h"), size, 1, scan)).alias("w"))
    last = F.greatest(F.size("h") - size, F.lit(0))
    wanted = single.join(hashes, "n").where((F.col("w.start") % (size // 2) == 0) | (F.col("w.start") == last)).select("n", "w")
    assert Counter(tuple(r) for r in shared.select("n", "w.*").collect()) == Counter(tuple(r) for r in wanted.select("n", "w.*").collect())
    assert shared.count() > 100


def test_neighbouring_tokens_agree_without_merging_them_again(monkeypatch):
    import itertools
    import random

    letters = [bytes([b]) for b in range(256)]
    draw = random.Random(3)
    longer = {b"".join(draw.choice((b"a", b"b", b"c")) for _ in range(n)) for n in (2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 5) for _ in range(3)}
    for _ in range(20):
        # by length, so that most ranks grow from merge to merge, and in any order
        some = sorted(longer, key=len)
        if draw.random() < 0.5:
            draw.shuffle(some)
        encoder = bpe_tree.TreeEncoder({token: rank for rank, token in enumerate(letters + some)})
        for a, b in itertools.product([b"a", b"b", b"c", *some], repeat=2):
            first, second = encoder.ranks[a], encoder.ranks[b]
            if encoder.merge(a) == [first] and encoder.merge(b) == [second]:
                assert encoder.agree(first, second) == (encoder.merge(a + b) == [first, second])
        for n in range(1, 7):
            for piece in map(bytes, itertools.product(b"abc", repeat=n)):
                assert encoder.leaf_tokens(piece) == encoder.merge(piece)
    encoder = bpe_tree.TreeEncoder(bpe_tree.read_ranks(vocabulary()[0]))
    merged, merge = [], encoder.merge
    monkeypatch.setattr(encoder, "merge", lambda piece: merged.append(piece) or merge(piece))
    for word in ("therhean", "dieentzäsch", "cióntaosla", "xqzjkvw"):
        encoder.leaf_tokens(word.encode())
    assert not merged


def test_mixing_stores_no_contexts_and_shuffles_texts_once(messy, rows, monkeypatch):
    stored = []
    write = context_mixing.materialize
    monkeypatch.setattr(context_mixing, "materialize", lambda df, label: stored.append(write(df, label)) or stored[-1])
    m = context_mixing.Mixing(batch=4000)
    got = context_mixing.language_model_scores(messy, m=m).collect()
    assert len(got) == len(rows)
    # what is stored besides the texts' scores are the numbers of each bucket
    assert all("text" not in df.columns and df.count() < 2 * len(rows) for df in stored)
