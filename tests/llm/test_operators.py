"""Each operator against brute force, and on nulls, empties, very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import random
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from stepweave.llm import decontaminate, language_id, line_dedup, media, ngram_join, packing, secrets, sharding, substring_dedup, token_files

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(rows)], SCHEMA)


def passage(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))


EDGES = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (4, "one"), (5, LONG), (6, LONG), (7, "é ü\x0b漢 字"), (None, passage(1, 40)), (None, passage(1, 40)), (8, passage(1, 40)), (9, passage(1, 40) + " end"), (10, passage(2, 30) + "\n" + passage(1, 40))]


@pytest.fixture(scope="module")
def edges(spark):
    """With extra columns whose names the operators use inside."""
    extra = {c: F.lit("clash") for c in ("key", "size", "part", "score", "lang_pred", "n_lines", "media", "block", "bucket", "tree", "value_hash", "start", "h1", "its_id", "its_key", "gone", "_gone", "gone_id", "gone_key", "again_id", "__gone", "__text", "__id", "__key", "body", "class", "cluster", "n", "copy", "words", "numbers", "text_key", "label")}
    return docs_of(spark, EDGES).withColumns(extra).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r["doc_id"]: r for r in documents.collect()}


# 1 secrets


def test_secrets_brute_force(spark, documents, texts):
    rows = secrets.scan_secrets(documents).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert [(s["kind"], s["start"], s["end"]) for s in sorted(r["base"], key=lambda s: (s["start"], secrets.KINDS.index(s["kind"])))] == secrets.brute_force(texts[r["doc_id"]]["text"])


def test_secrets_patterns(spark):
    text = "password: secret = abcdefghijklmnop\nPASSWD='Abcdefgh1234' é token=short api-key: zzzzzzzzzzzzzz AKIAABCDEFGHIJKLMN AKIASHORT 0123456789abcdef0 0123456789abcde"
    df = docs_of(spark, [(1, text)])
    (r,) = secrets.scan_secrets(df).collect()
    assert [(s["kind"], s["start"], s["end"]) for s in sorted(r["base"], key=lambda s: (s["start"], secrets.KINDS.index(s["kind"])))] == secrets.brute_force(text)
    assert {s["kind"] for s in r["base"]} == {"assign", "access", "hex"}


def test_secrets_ownership(spark):
    live, copied, shared, spread = "aZ9kQ2mX7pL4vB8n", "bY8jR3nW6qK5uC7m", "cX7iS4oV5rJ6tD6l", "dW6hT5pU4sI7sE5k"
    rows = [(1, f"token={live}", "a"), (2, f"token={live}", "a"), (3, f"token={copied}", "a"), (4, f"token={copied}", "b"), (5, f"token={copied}", "c"), (6, f"token={shared}", "a"), (7, f"token={shared}", "b"), (8, "token=exampleexample1", "a"), (9, "nothing", None)]
    # many repositories of one owner: widely copied all the same
    rows += [(20 + k, f"token={spread}", "a") for k in range(10)] + [(40 + k, "token=qV5gS4oT3rH6wF4j", "a") for k in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: ([(s["kind"], s["start"], s["end"]) for s in r["added"]], r["max_repositories"], r["max_owners"]) for r in secrets.scan_secrets(df).collect()}
    span = lambda kind, *n: ([(kind, 6, 22)], *n)
    want = {1: span("live", 2, 1), 2: span("live", 2, 1), 3: span("example", 3, 3), 4: span("example", 3, 3), 5: span("example", 3, 3), 6: span("shared", 2, 2), 7: span("shared", 2, 2), 8: ([], 1, 1), 9: ([], 0, 0)}
    assert got == want | {20 + k: span("example", 10, 1) for k in range(10)} | {40 + k: span("live", 9, 1) for k in range(9)}


def test_secrets_stand_ins(spark):
    values = {"your-secret-value-123": False, "exampleexample1": False, "test_aZ9kQ2mX7pL4": False, "aZ9kQ2testX7pL4vB8n": True, "aZ9kQ2mX7pL4vB8n": True, "aaaaaaaaaaaa1": False, "abcdefghijklmnop": False}
    df = spark.createDataFrame([(i, f"token={v}", "a") for i, v in enumerate(values)], "doc_id long, text string, source string")
    got = {r["doc_id"]: [s["kind"] for s in r["added"]] for r in secrets.scan_secrets(df).collect()}
    assert got == {i: ["live"] * x for i, x in enumerate(values.values())}


def test_secrets_many_in_one_text(spark):
    text = "\n".join(f"{i:016x} é" for i in range(100_000))
    df = docs_of(spark, [(1, text), (2, "0" * 16)])
    rows = {r["doc_id"]: r for r in secrets.scan_secrets(df).collect()}
    assert [(s["start"], s["end"]) for s in sorted(rows[1]["base"], key=lambda s: s["start"])] == [(19 * i, 19 * i + 16) for i in range(100_000)]
    assert rows[1]["max_repositories"] == 2 and len(rows[2]["base"]) == 1


def test_secrets_join_of_a_large_side(spark, documents, monkeypatch):
    key = lambda rows: sorted((r["doc_id"], sorted((s["rank"], s["start"], s["end"]) for s in r["base"] + r["added"])) for r in rows)
    whole = key(secrets.scan_secrets(documents).collect())
    monkeypatch.setattr(secrets._base, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(secrets._base, "PARTS", 20)
    assert key(secrets.scan_secrets(documents).collect()) == whole


def test_secrets_edges(edges, empty):
    rows = secrets.scan_secrets(edges).collect()
    assert sorted((r["doc_id"] for r in rows), key=str) == sorted((i for i, _ in EDGES), key=str)
    assert secrets.scan_secrets(empty).count() == 0


def test_secrets_repeated_rows(spark):
    text = "token=aZ9kQ2mX7pL4vB8n"
    df = spark.createDataFrame([(1, text, "a"), (1, text, "b"), (1, "other", "a"), (None, text, "a"), (None, text, None), (2, None, "a")], "doc_id long, text string, source string")
    got = sorted(((r["doc_id"], len(r["base"]), [s["kind"] for s in r["added"]]) for r in secrets.scan_secrets(df).collect()), key=str)
    assert got == sorted([(1, 1, ["shared"]), (1, 1, ["shared"]), (1, 0, []), (None, 1, ["shared"]), (None, 1, ["shared"]), (2, 0, [])], key=str)


# 2 language


def test_language_held_out_accuracy(documents):
    docs = documents.withColumn("held_out", language_id.held_out(F.col("doc_id").cast("string")))
    profiles = language_id.fit_profiles(docs.where("not held_out"))
    rows = language_id.identify_language(docs, profiles).where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    again = language_id.fit_profiles(docs.where("not held_out").repartition(7))
    assert np.array_equal(profiles.prototypes, again.prototypes)


def test_language_bundles_are_sums_over_trigrams():
    v = language_id._letter_vectors
    a, b, s = (v(np.array([p]), 64)[0].astype(int) for p in (ord("a"), ord("b"), language_id._BOUNDARY))
    r = lambda x, k: np.roll(x, k)
    want = s * r(a, 1) * r(b, 2) + a * r(b, 1) * r(s, 2)
    assert np.array_equal(language_id.bundle(["Ab! 12"], 64)[0], want)
    many = ["", "a", "Ab", "漢字 x", passage(3, 50), "12 3"]
    one = np.concatenate([language_id.bundle([t], 64) for t in many])
    assert np.array_equal(language_id.bundle(many, 64), one)
    assert not one[0].any() and not one[5].any() and one[1].any()


def plain_prediction(text, profiles):
    """Trigram by trigram."""
    marked, after = ["\n"], False
    for c in text.lower():
        if c.isalpha() or after:
            marked.append(c if c.isalpha() else "\n")
        after = c.isalpha()
    marked += ["\n"] if after else []
    points = [ord(c) if c != "\n" else language_id._BOUNDARY for c in marked]
    kinds = Counter(zip(points, points[1:], points[2:]))
    d = profiles.prototypes.shape[1]
    v = {p: language_id._letter_vectors(np.array([p]), d)[0].astype(int) for p in set(points)}
    total = sum((n * v[a] * np.roll(v[b], 1) * np.roll(v[c], 2) for (a, b, c), n in kinds.items()), np.zeros(d))
    if not any(c.isalpha() for c in text):
        return "und", 0.0
    cosine = profiles.prototypes @ total / np.linalg.norm(total)
    return profiles.languages[int(cosine.argmax())], float(np.clip(cosine.max(), 0, 1))


def test_language_predictions(spark, sf_dir, documents, texts):
    """The query's rows against a plain loop over whole texts."""
    docs = documents.withColumn("held_out", language_id.held_out(F.col("doc_id").cast("string")))
    profiles = language_id.fit_profiles(docs.where("not held_out"))
    for r in language_id.op2_language_id(spark, sf_dir).collect():
        text = texts[r["doc_id"]]["text"] or ""
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        if len(text) < 5000:
            name, score = plain_prediction(text, profiles)
            assert abs(r["score"] - score) < 1e-5 and (r["lang_pred"] == name or score - 1e-5 < r["score"])


def test_language_slices_and_pieces(monkeypatch):
    """Many letters and very long texts: the same sums in slices of trigrams and pieces of text."""
    r = random.Random(3)
    wide = "".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(3000))
    many = [wide, "a", "", "12", passage(4, 400), "Σας ΑΣ\nx1y  z", wide[:50] + " " + wide[20:90]]
    whole = language_id.bundle(many, 64)
    monkeypatch.setattr(language_id, "KINDS_AT_ONCE", 100)
    assert np.array_equal(language_id.bundle(many, 64), whole)
    for chars in (1, 2, 7, 100):
        monkeypatch.setattr(language_id, "CHUNK_CHARS", chars)
        assert np.array_equal(language_id._bundles(many, 64), whole)
    monkeypatch.setattr(language_id, "LETTERS_KEPT", 10)
    assert np.array_equal(language_id.bundle(many, 64), whole)


def test_language_small_beside_large(spark):
    rows = [(i, passage(i, 20), "xx") for i in range(300)] + [(1000 + i, passage(i, 20).translate(str.maketrans("abcdefgh", "stuvwxyz")), "yy") for i in range(3)] + [(2000, "words", "und"), (2001, None, "zz"), (2002, "12", "ww")]
    profiles = language_id.fit_profiles(spark.createDataFrame(rows, "doc_id long, text string, lang string"), train_rows=20)
    assert profiles.languages == ("xx", "yy")


def test_language_rejections(spark, edges, empty):
    rows = [(i, passage(i, 60), "xx") for i in range(60)]
    profiles = language_id.fit_profiles(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    foreign = " ".join("".join(chr(0x410 + (7 * i + j * j) % 32) for j in range(5)) for i in range(60))
    texts = [None, "", "12 %", "ab", passage(777, 60), foreign, foreign[:50]]
    assert profiles.resembles(texts).tolist() == [False, False, False, True, True, False, True]
    nothing = language_id.fit_profiles(empty)
    assert nothing.resembles(texts).tolist() == [False, False, False, True, True, True, True]
    left = language_id.keep_known(edges, nothing)
    assert left.columns == edges.columns and sorted((r["doc_id"] for r in left.collect()), key=str) == sorted((i for i, t in EDGES if any(map(str.isalpha, t or ""))), key=str)
    assert language_id.keep_known(empty, profiles).count() == 0


def test_language_edges(edges, empty):
    profiles = language_id.fit_profiles(edges)
    rows = language_id.identify_language(edges, profiles).collect()
    assert len(rows) == len(EDGES)
    for r in rows:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) and r["key"] == "clash"
    nothing = language_id.fit_profiles(empty)
    assert nothing.languages == () and {r["lang_pred"] for r in language_id.identify_language(edges, nothing).collect()} == {"und"}
    assert language_id.identify_language(empty, profiles).count() == 0


# 3 packing


def brute_pack(pieces, capacity):
    bins, out = [], {}
    for i in sorted(range(len(pieces)), key=lambda i: -pieces[i][0]):
        n, s, c = pieces[i]
        fits = [(b["room"], k) for k, b in enumerate(bins) if b["room"] >= n and not b["s"] & s and not b["c"] & c]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append({"room": capacity, "s": 0, "c": 0})
        out[i] = k, capacity - bins[k]["room"]
        bins[k]["room"] -= n
        bins[k]["s"] |= s
        bins[k]["c"] |= c
    return [out[i] for i in range(len(pieces))]


def test_packing_brute_force():
    rng = random.Random(4)
    for _ in range(30):
        pieces = [(rng.randint(1, 100), 1 << rng.choice([0, 0, 0, 1, 2, 3]) if rng.random() < 0.8 else 0, 1 << rng.randrange(9) if rng.random() < 0.4 else 0) for _ in range(rng.randrange(80))]
        assert packing.pack_block(pieces, 100) == brute_pack(pieces, 100)


def check_bins(rows, source, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["bin"], []).append(r)
    for held in bins.values():
        held.sort(key=lambda r: r["start"])
        assert held[0]["start"] == 0 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(held, held[1:]))
        assert held[-1]["start"] + held[-1]["n_tokens"] <= capacity
        named = [source[r["doc_id"]] for r in held if r["doc_id"] is not None]
        assert len(named) == len(set(named))


def test_packing(documents, texts):
    rows = packing.pack(documents, capacity=512, docs_per_block=64).collect()
    check_bins(rows, {i: r["source"] for i, r in texts.items()}, 512)
    total = {}
    for r in rows:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
    assert total == {i: len((r["text"] or "").split()) + 1 for i, r in texts.items()}


def test_packing_whatever_the_layout(spark, documents):
    bins = [sorted(map(tuple, packing.pack(df, docs_per_block=20).collect())) for df in (documents, documents.repartition(7, "source"))]
    assert bins[0] == bins[1]
    named = documents.select(F.concat(F.lit("d"), F.col("doc_id")).alias("doc_id"), "text", "source")
    assert {r["doc_id"] for r in packing.pack(named).collect()} == {f"d{r['doc_id']}" for r in documents.collect()}
    alike = spark.createDataFrame([(1, "a b", None)] * 50 + [(1, None, "s"), (1, "c", "s"), (1, "c d", None)], "doc_id long, text string, source string")
    rows = packing.pack(alike).collect()
    assert len(rows) == 53 and len({r["bin"] for r in rows if r["n_tokens"] == 3}) >= 50


def test_packing_keeps_near_copies_apart(spark, tmp_path):
    rows = []
    for k in range(20):
        words = passage(300 + k, 60).split()
        rows += [(3 * k, " ".join(words)), (3 * k + 1, " ".join([*words[:-1], "edited"])), (3 * k + 2, " ".join(words))]
    rows += [(100, None), (101, ""), (102, ""), (103, "  \n")]
    df = spark.createDataFrame([(i, t, "en", f"s{i}", len(t or "")) for i, t in rows], SCHEMA)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    packed = packing.op3_packing(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in packed) == sorted(i for i, _ in rows)
    check_bins(packed, {i: i for i, _ in rows}, 2048)
    bin_of = {r["doc_id"]: r["bin"] for r in packed}
    assert all(len({bin_of[3 * k + j] for j in range(3)}) == 3 for k in range(20))
    # clusters of one bind nothing
    assert len({bin_of[i] for i in (100, 101, 102, 103)}) == 1


def test_packing_edges(edges, empty):
    rows = packing.pack(edges).collect()
    assert sum(r["doc_id"] is None for r in rows) == 2 and sum(r["doc_id"] == 4 for r in rows) == 2
    assert sum(r["n_tokens"] for r in rows if r["doc_id"] == 5) == 30_001 and max(r["piece"] for r in rows) == 30_001 // 2048
    assert sum(r["n_tokens"] for r in rows if r["doc_id"] in (1, 2, 3)) == 3
    assert packing.pack(empty).count() == 0


# 4 shards


def test_shards(documents, texts):
    rows = sharding.shard_by_bytes(documents, 8).collect()
    size = {i: len((r["text"] or "").encode()) + 1 for i, r in texts.items()}
    assert {r["doc_id"]: r["size"] for r in rows} == size
    assert all(r["text_crc32"] == zlib.crc32((texts[r["doc_id"]]["text"] or "").encode()) for r in rows)
    rows.sort(key=lambda r: r["doc_id"])
    assert [r["shard"] for r in rows] == sorted(r["shard"] for r in rows)
    target, largest = sum(size.values()) / 8, max(size.values())
    for k in range(8):
        own = [r for r in rows if r["shard"] == k]
        assert [r["slot"] for r in own] == list(range(len(own))) and abs(sum(r["size"] for r in own) - target) <= largest


def test_shards_edges(edges, empty):
    rows = sharding.shard_by_bytes(edges, 3).collect()
    assert len(rows) == len(EDGES) and {r["size"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    for k in range(3):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))
    assert sharding.shard_by_bytes(empty).count() == 0


# 5 substrings


@pytest.mark.parametrize("budget", [substring_dedup.WINDOWS_PER_TREE, 300])
def test_substrings_brute_force(documents, budget):
    """A small budget makes prefixes longer, down to whole windows, and trees many."""
    want = substring_dedup.brute_force([(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()])
    rows = substring_dedup.substring_dedup(documents, windows_per_tree=budget).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in rows} == want


def test_prefixes_of_variable_length():
    counts = np.zeros((substring_dedup.GRAM, substring_dedup.CELLS), np.int64)
    counts[0, :4] = 10, 1000, 20, 30
    counts[1, :3] = 90, 800, 60
    counts[2, :2] = 500, 40
    trees, n = substring_dedup.plan_trees(counts, 100, 1)
    assert trees[0, 1] == -1 and trees[1, 1] == -1 and trees[2, 0] == -1
    assert trees[0, 0] == trees[0, 2] and trees[2, 1] >= 0 and n > trees.max() - 1


def subtree_rows(rows, window, trees, n):
    """What one process makes of the leaves of all rows."""
    leaves = substring_dedup.Suffixes([t.encode() for _, t in rows], window)
    ids = np.array([i for i, _ in rows])
    tree = leaves.deal(trees, n)
    held = {}
    for k in range(n):
        mine = np.flatnonzero(tree == k)
        if len(mine):
            held[k] = substring_dedup.Subtree(window)
            place = leaves.a - leaves.first[leaves.owner]
            held[k].add(substring_dedup._numbers(ids[leaves.owner][mine], np.zeros(len(mine)), place[mine], leaves.n[mine]), zstandard.compress(b"\n".join(leaves.contexts()[i] for i in mine)))
            held[k].sort()
    return held


@pytest.mark.parametrize("weak", [False, True])
def test_subtrees_compare_words_and_not_hashes(monkeypatch, weak):
    """With hashes of two values everything collides, and the repeats stay those of equal words."""
    if weak:
        monkeypatch.setattr(substring_dedup._words, "mix", lambda x: x.astype(np.uint64) % np.uint64(2) << np.uint64(63))
    r = random.Random(12)
    rows = [(i, " ".join(r.choice("abc") for _ in range(r.randrange(60)))) for i in range(40)] + [(i, passage(i % 7, 30)) for i in range(40, 60)] + [(70, "a " * 50), (71, "a " * 90)]
    want = {}
    first = {}
    for i, t in rows:
        for k in range(len(t.split()) - 5):
            w = tuple(t.split()[k : k + 6])
            if first.setdefault(w, i) < i:
                want.setdefault(i, set()).add(k)
    for budget in (10_000, 20):
        counts = np.zeros((5, substring_dedup.CELLS), np.int64)
        leaves = substring_dedup.Suffixes([t.encode() for _, t in rows], 6)
        for level, cells in enumerate(leaves.cells()):
            counts[level] += np.bincount(cells, leaves.n, substring_dedup.CELLS).astype(np.int64)
        got = {}
        for tree in subtree_rows(rows, 6, *substring_dedup.plan_trees(counts, budget, 1)).values():
            suffixes = [[tree.words[x] for x in tree.sequence[a : a + 6]] for a in tree.at.tolist()]
            assert suffixes == sorted(suffixes)
            for x, y, n in zip(suffixes, suffixes[1:], tree.common[1:].tolist()):
                assert x[:n] == y[:n] and x[n : n + 1] != y[n : n + 1] or n == 6
            for i, _, a, b in zip(*(x.tolist() for x in tree.repeats())):
                assert b == a + 6 and a not in got.get(i, ())
                got.setdefault(i, set()).add(a)
        assert got == want


@pytest.mark.parametrize("bits", [2, 5, 13, 32, 63])
def test_windows_in_order(bits):
    """As tuples of words and document, however few words 64 bits hold."""
    rng = np.random.default_rng(bits)
    codes = rng.integers(0, 3, 3000).astype(np.uint32)
    codes[1000:1400] = codes[:400]
    codes[2000:2100] = 1
    at, ids = rng.permutation(len(codes) - 12), rng.integers(-5, 5, len(codes) - 12)
    order = substring_dedup._in_order(codes, at, ids, 13, bits)
    found = [(*codes[at[i] : at[i] + 13].tolist(), int(ids[i])) for i in order]
    assert sorted(order.tolist()) == list(range(len(at))) and found == sorted(found)
    assert len(substring_dedup._in_order(codes, at[:0], ids[:0], 13, bits)) == 0


def test_words_numbered_in_several_parts(monkeypatch):
    monkeypatch.setattr(substring_dedup, "CODED_AT_ONCE", 100)
    rows = [(i, passage(i % 9, 30) + f" \x01{i % 4} é\x00 \x00") for i in range(40)]
    many = substring_dedup.Subtree(13)
    texts = [t.split(" ") for _, t in rows]
    for (i, t), words in zip(rows, texts):
        many.add(substring_dedup._numbers(np.array([i]), np.array([0]), np.array([0]), np.array([len(words) - 12])), zstandard.compress(t.encode()))
    assert len(many.codes) > 10
    many.sort()
    assert many.words == sorted({w.encode() for t in texts for w in t})
    assert [many.words[c].decode() for c in many.sequence.tolist()] == [w for t in texts for w in t]
    got = sorted(zip(*(x.tolist() for x in many.repeats())))
    first = {}
    want = [(i, 0, k, k + 13) for (i, _), t in zip(rows, texts) for k in range(len(t) - 12) if first.setdefault(tuple(t[k : k + 13]), i) < i]
    assert got == want


def test_subtrees_cost_less_than_a_lookup_for_each_word():
    """CPU time of a subtree of two million words and 380,000 windows beside that of splitting them and looking each up in a dict."""
    rng = np.random.default_rng(5)
    known = np.array([passage(i, 1) + str(i) for i in range(100_000)], object)
    words = known[rng.integers(0, len(known), (100_000, 20))]
    text = "\n".join(" ".join(x) for x in words.tolist()).encode()
    n = np.arange(100_000)
    numbers, packed = substring_dedup._numbers(n, 0 * n, 0 * n, 0 * n + 8), zstandard.compress(text)

    def plain():
        vocabulary = defaultdict(itertools.count().__next__)
        return np.fromiter(map(vocabulary.__getitem__, text.split()), np.uint32), sorted(vocabulary)

    def tree():
        held = substring_dedup.Subtree(13)
        held.add(numbers, packed)
        held.sort()

    def seconds(f):
        began = time.process_time()
        f()
        return time.process_time() - began

    assert min(seconds(tree) for _ in range(3)) < min(seconds(plain) for _ in range(3))


def test_substrings_with_weak_hashes(spark, monkeypatch, tmp_path):
    """The whole operator, on executors whose hashes collide."""
    rows = [(i, passage(i % 5, 20) + " " + passage(i, 30)) for i in range(30)]

    def spoiled(df, f, schema):
        def run(batches):
            import numpy as np

            from stepweave.llm import _words

            whole = _words.mix
            _words.mix = lambda x: x.astype(np.uint64) % np.uint64(2) << np.uint64(63)
            try:
                yield from f(batches)
            finally:  # the process serves other tests too
                _words.mix = whole

        return plain(df, run, schema)

    plain = type(docs_of(spark, rows)).mapInArrow
    monkeypatch.setattr(type(docs_of(spark, rows)), "mapInArrow", spoiled)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in substring_dedup.substring_dedup(docs_of(spark, rows)).collect()}
    assert got == substring_dedup.brute_force(rows)


def test_known_repeats_stay_out_of_subtrees(spark):
    """A passage in every row goes to its subtree once for each task, at any number of rows."""
    most = []
    for n in (300, 1200):
        df = spark.createDataFrame([(i, 0, f"{passage(i, 3)} {passage(999, 60)}") for i in range(n)], "doc_id long, text_key long, text string").coalesce(1)
        trees, count = substring_dedup.plan_trees(substring_dedup._prefix_counts(df, 13), 100, 1)
        sent = [r for r in substring_dedup._leaves(df, 13, trees, count).collect() if not r["known"]]
        shared = passage(999, 60).split()
        inner = " ".join(shared[20:40])
        most.append(sum(zstandard.decompress(bytes(r["words"])).decode().count(inner[:60]) for r in sent))
    assert most[0] == most[1]


def test_known_repeats_of_all_tasks_are_dealt_evenly(spark):
    """Each task's first chunk has known repeats; they don't meet in one subtree."""
    df = spark.createDataFrame([(i, 0, f"{passage(i, 3)} {passage(999, 60)}") for i in range(480)], "doc_id long, text_key long, text string").repartition(24)
    trees, count = substring_dedup.plan_trees(substring_dedup._prefix_counts(df, 13), 100, 1)
    known = Counter(r["tree"] for r in substring_dedup._leaves(df, 13, trees, count).collect() if r["known"])
    assert count >= 30 and sum(known.values()) == 24 and max(known.values()) <= 6 and all(0 <= k < count for k in known)


def test_substrings_edges(edges, empty):
    rows = substring_dedup.substring_dedup(edges).collect()
    assert len(rows) == len(EDGES)
    got = {(r["doc_id"], r["n_words"]): (r["n_removed"], r["kept"]) for r in rows}
    assert got[1, 0] == got[2, 0] == got[3, 0] == (0, "") and got[4, 1] == (0, "one")
    assert got[5, 30_000][0] == 0 or got[5, 30_000][1] != ""
    assert got[6, 30_000] == (30_000, "") and got[7, 3] == (0, "é ü 漢 字") if (7, 3) in got else got[7, 4] == (0, "é ü 漢 字")
    assert got[None, 40] == (0, passage(1, 40)) and got[8, 40][0] == 0
    assert got[9, 41] == (40, "end") and got[10, 70] == (40, passage(2, 30))
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_substrings_of_one_doc_id(spark):
    """Rows of one doc_id keep apart, and never make each other lose words."""
    one, two = passage(1, 20), passage(2, 20)
    rows = [(1, one), (2, f"x y {one}"), (2, f"{one} {two}"), (2, two), (3, two)]
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.substring_dedup(docs_of(spark, rows)).collect())
    assert got == sorted([(1, 20, 0, one), (2, 22, 20, "x y"), (2, 40, 20, two), (2, 20, 0, two), (3, 20, 20, "")])


def test_maximal_repeats(spark):
    df = docs_of(spark, [(1, passage(1, 20)), (2, "x " + passage(1, 20)), (3, passage(5, 20))])
    nodes = {(r["words"], r["first_doc"], r["n"]) for r in substring_dedup.repeat_nodes(df).collect()}
    assert nodes == {(" ".join(passage(1, 20).split()[k : k + 13]), 1, 2) for k in range(8)}
    spans = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in substring_dedup.substring_dedup(df).collect()}
    assert spans == {1: [], 2: [(1, 21)], 3: []}


# 6 benchmark


ITEMS = "item_id long, text string"


def test_decontamination_brute_force(spark, sf_dir, texts):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    some = [(i, r["text"]) for i, r in texts.items() if len(r["text"] or "") < 1000]
    want = decontaminate.brute_force(some, [tuple(r) for r in items.select("item_id", "text").collect()])
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(spark.createDataFrame(some, "doc_id long, text string"), items).collect()}
    assert got == want and got


def test_substitutions(spark):
    item = passage(9, 30).split()
    items = spark.createDataFrame([(1, " ".join(item)), (2, "alpha beta gamma delta epsilon"), (3, "too short"), (4, None), (5, ""), (6, "?!"), (7, "Solo")], ITEMS)
    changed = lambda *at: " ".join("zzz" if i in at else w for i, w in enumerate(item))
    rows = {
        1: "before " + changed() + " after",
        2: changed(3, 7, 14, 20, 27),
        3: changed(*range(0, 30, 2)),
        4: " ".join(item[8:21]).upper().replace(" ", ", "),
        5: " ".join(item[8:19]),
        6: "x Alpha, beta gamma; delta epsilon y",
        7: "too short",
        8: None,
        9: "",
        10: "not too long or short",
        11: "han solo",
    }
    df = docs_of(spark, list(rows.items()))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(df, items).collect()}
    assert got == {(1, 1), (2, 1), (4, 1), (6, 2), (7, 3), (11, 7)}
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(df, items).collect()) == [3, 5, 8, 9, 10]


def test_every_placement_of_substitutions():
    """For items of each length, alone and in other text: all that are allowed, and some with one more."""
    allowed = {1: 0, 2: 0, 3: 0, 4: 0, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1, 10: 2, 11: 2, 12: 2, 13: 2}
    items = [(n, passage(100 + n, n)) for n in allowed]
    docs, want = [], set()
    for n, text in items:
        for differ in (allowed[n], allowed[n] + 1):
            for at in list(itertools.combinations(range(n), differ))[: None if differ == allowed[n] else 20]:
                words = " ".join("zzz" if i in at else w for i, w in enumerate(text.split()))
                for t in (words, f"one two {words} three"):
                    want |= {(len(docs), n)} if differ == allowed[n] else set()
                    docs.append((len(docs), t))
    assert decontaminate.brute_force(docs, items) == want
    assert decontaminate.overlaps(items, [t for _, t in docs]) == want


@pytest.mark.parametrize("overlap,identity", [(13, 0.8), (20, 0.8), (8, 0.5), (31, 0.9), (9, 1.0), (5, 0.2)])
def test_masks_for_other_passages(overlap, identity):
    r = random.Random(overlap)
    items = [(i, passage(200 + i, 45)) for i in range(4)]
    docs = []
    for k in range(200):
        words = items[k % 4][1].split()
        begin = r.randrange(45 - overlap + 1)
        at = set(r.sample(range(overlap), decontaminate.substitutions(overlap, identity)))
        docs.append((k, "one two " + " ".join("zzz" if i in at else w for i, w in enumerate(words[begin : begin + overlap])) + " three"))
    want = decontaminate.brute_force(docs, items, overlap, identity)
    assert len(want) >= 200
    assert decontaminate.overlaps(items, [t for _, t in docs], overlap, identity) == want


def test_large_benchmark(spark, sf_dir, documents, monkeypatch):
    """The same where seeds are shuffled, and where the filter lets everything through."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    whole = sorted(map(tuple, decontaminate.contaminated(documents, items).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 10)
    monkeypatch.setattr(decontaminate, "MOST_BITS", 8)
    some = documents.where("length(text) < 2000")
    kept = {r[0] for r in some.select("doc_id").collect()}
    assert sorted(map(tuple, decontaminate.contaminated(some, items).collect())) == [r for r in whole if r[0] in kept]
    monkeypatch.undo()
    left = {r[0] for r in decontaminate.decontaminate(documents, items).select("doc_id").collect()}
    assert left == {r[0] for r in documents.select("doc_id").collect()} - {r[0] for r in whole}


def test_decontamination_edges(spark, edges, empty):
    items = spark.createDataFrame([(1, passage(1, 40)), (1, passage(1, 40))], ITEMS)
    none = spark.createDataFrame([], ITEMS)
    rows = decontaminate.contaminated(edges, items).collect()
    assert len(rows) == 2 * 5
    assert decontaminate.decontaminate(edges, items).count() == len(EDGES) - 5
    assert decontaminate.decontaminate(edges, none).count() == len(EDGES) and decontaminate.contaminated(edges, none).count() == 0
    assert decontaminate.decontaminate(empty, items).count() == 0 and decontaminate.contaminated(empty, items).count() == 0


# 7 token files


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(token_files.VOCABULARY)
    return path, Tokenizer.from_file(path)


def test_blocks_round_trip():
    rng = np.random.default_rng(8)
    for ids in (np.zeros(0), np.array([7]), np.full(300, 5), rng.integers(0, 49_408, 5000), np.where(rng.random(1000) < 0.05, 2**32 - 1, rng.integers(0, 50, 1000)), np.r_[np.arange(128), 2**31]):
        ids = ids.astype(np.int64)
        data = token_files.encode_file(np.array([3, 9]), np.array([len(ids), 0]), ids)
        doc_ids, counts, back, unnamed = token_files.decode_file(data)
        assert unnamed == 0 and doc_ids.tolist() == [3, 9] and counts.tolist() == [len(ids), 0] and back.tolist() == ids.tolist()
    few = np.where(np.arange(12_800) % 128 == 5, 40_000, 3)
    assert len(token_files.encode_file(np.array([1]), np.array([12_800]), few)) < 100 * (8 + 5 + 4) + 100


def test_encoder_is_the_library(tokenizer, texts):
    path, whole = tokenizer
    odd = ["", "a", "<|endoftext|> x", "  two\tthree\nx", "It's DON'T 12ab $$$ ### naïve ÀÉß ﬁ 漢字 é İstanbul ́ x \x1cq ΑΣ \x7f\x85y", "x <| y", LONG]
    many = odd + [r["text"] or "" for r in texts.values()]
    ids, counts = token_files.Encoder(path).encode([t.encode() for t in many], 2)
    at = 0
    for t, n in zip(many, counts):
        assert ids[at : at + n].tolist() == [*whole.encode(t, add_special_tokens=False).ids, 2]
        at += n
    assert at == len(ids)


def test_words_of_plain_bytes_are_cut_together(tokenizer, monkeypatch):
    """No word of ASCII letters, digits and marks is looked at by itself, and each part goes to the model once."""
    path, whole = tokenizer
    calls = Counter()
    one, part = token_files.Encoder._word, token_files.Encoder._unit
    monkeypatch.setattr(token_files.Encoder, "_word", lambda self, raw: calls.update(["word"]) or one(self, raw))
    monkeypatch.setattr(token_files.Encoder, "_unit", lambda self, raw: calls.update([raw]) or part(self, raw))
    words = [passage(i, 1) for i in range(200)]
    many = [" ".join(f"{w}{mark} {w.title()}{mark}" for w in words) for mark in ("", ",", ".", "...", "!?", "7", "42)", '"')]
    ids, counts = token_files.Encoder(path).encode([t.encode() for t in many], 2)
    assert ids.tolist() == [x for t in many for x in [*whole.encode(t, add_special_tokens=False).ids, 2]] and counts.sum() == len(ids)
    assert not calls["word"] and set(calls.values()) == {1}
    assert len(calls) == len(set(words) | {",", ".", "...", "!?", "7", "4", "2", ")", '"'})


def test_encoder_on_odd_characters(tokenizer):
    path, whole = tokenizer
    rng = random.Random(17)
    kinds = ["abcdefgzABCstmdrvl", "0123456789", "!\"#$%&()*+,-./:;=?@[]^_`{}~", "'<|>", " \t\n\x0b\x0c\r", "éÀßñ×÷", "漢ﬁİΣς\u0301\u0307", "\x00\x1c\x1f\x7f\x85\xa0"]
    for weights in ((6, 1, 1, 0, 2, 0, 0, 0), (4, 2, 3, 1, 2, 0, 0, 0), (6, 1, 2, 1, 3, 2, 0, 0), (4, 1, 1, 1, 2, 1, 1, 1)):
        many = ["".join(rng.choice(k) for k in rng.choices(kinds, weights, k=rng.randrange(60))) for _ in range(800)] + ["a<|endoftext|>b c", "I'll don'T x's' 's", "", " "]
        ids, counts = token_files.Encoder(path).encode([t.encode() for t in many], 2)
        at = 0
        for t, n in zip(many, counts):
            assert ids[at : at + n].tolist() == [*whole.encode(t, add_special_tokens=False).ids, 2], t
            at += n
        assert at == len(ids)


def test_bytes_are_plain_only_where_neighbours_decide():
    import regex

    plain = lambda pattern, special=(): int((token_files._kinds(regex.compile(pattern).findall, list(special))[0] % token_files._ODD != 0).sum())
    assert plain(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+") == 93
    assert plain(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+", ["<|x|>"]) == 90
    assert plain(r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+", ["PAD"]) == 0
    assert plain(r"\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]+") == 0
    assert plain(r"[^\s\p{L}\p{N}]?\p{L}+|\p{N}|[^\s\p{L}\p{N}]+") == 0


def test_encoder_with_weak_hashes(tokenizer, monkeypatch):
    path, whole = tokenizer
    monkeypatch.setattr(token_files._words, "mix", lambda x: x.astype(np.uint64) % np.uint64(2))
    many = ["ab cd  ef ab", "gh cd", ""]
    ids, counts = token_files.Encoder(path).encode([t.encode() for t in many], 2)
    assert ids.tolist() == [x for t in many for x in [*whole.encode(t, add_special_tokens=False).ids, 2]] and counts.sum() == len(ids)


def test_other_vocabularies_are_encoded_whole(tokenizer, texts):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    path, _ = tokenizer
    assert token_files.Encoder(path).by_word
    other = public_tokenizers.path("byte_bpe_50k.json")
    encoder, whole = token_files.Encoder(other), Tokenizer.from_file(other)
    assert not encoder.by_word
    many = ["", "a b  c\n d", "It's"] + [r["text"] or "" for r in texts.values()][:30]
    ids, counts = encoder.encode([t.encode() for t in many], 2)
    assert ids.tolist() == [x for t in many for x in [*whole.encode(t, add_special_tokens=False).ids, 2]] and len(counts) == len(many)
    rules = json.load(open(path, encoding="utf-8"))
    assert token_files.splits_at_space(rules)
    for wrong in ({"pre_tokenizer": None}, {"normalizer": {"type": "Prepend", "prepend": "_"}}, {"truncation": {"max_length": 4}}):
        assert not token_files.splits_at_space(rules | wrong)
    rules["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r" ?\p{L}+|\S"
    assert not token_files.splits_at_space(rules)


def test_token_files_smallest_id(spark, tokenizer, tmp_path):
    path, _ = tokenizer
    token_files.write_token_files(docs_of(spark, [(-(2**63), "a"), (None, "b"), (0, "c")]), path, str(tmp_path / "s"))
    rows = sorted(token_files.read_token_files(spark, str(tmp_path / "s")).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, -(2**63), 0]


def test_token_files(spark, documents, texts, tokenizer, tmp_path):
    path, whole = tokenizer
    token_files.write_token_files(documents, path, str(tmp_path / "t"), bytes_per_file=20_000)
    rows = {r["doc_id"]: r for r in token_files.read_token_files(spark, str(tmp_path / "t")).collect()}
    start = 0
    for i in sorted(texts):
        ids = [*whole.encode(texts[i]["text"] or "", add_special_tokens=False).ids, 2]
        raw = np.array(ids, "<u4").tobytes()
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"], bytes(rows[i]["ids"])) == (start, len(ids), zlib.crc32(raw), raw)
        start += len(ids)


def test_token_files_edges(spark, edges, empty, tokenizer, tmp_path):
    path, _ = tokenizer
    token_files.write_token_files(edges, path, str(tmp_path / "e"))
    rows = token_files.read_token_files(spark, str(tmp_path / "e")).collect()
    rows.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, None, 1, 2, 3, 4, 4, 5, 6, 7, 8, 9, 10]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:])) and rows[2]["n_tokens"] == 1
    token_files.write_token_files(empty, path, str(tmp_path / "n"))
    assert token_files.read_token_files(spark, str(tmp_path / "n")).count() == 0


# 8 lines


def brute_lines(rows, min_sites):
    sites, first = {}, {}
    for i, t, s in sorted(rows):
        for k, line in enumerate((t or "").split("\n") if t is not None else []):
            if line.strip(" "):
                sites.setdefault(line, set()).add(s)
                first.setdefault(line, (i, k))
    out = {}
    for i, t, _ in rows:
        lines = t.split("\n") if t is not None else []
        gone = [k for k, x in enumerate(lines) if x.strip(" ") and len(sites[x]) >= min_sites and first[x] != (i, k)]
        out[i] = len(lines), len(gone), None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_lines_brute_force(documents):
    for least in (2, line_dedup.MIN_SITES):
        rows = line_dedup.line_dedup(documents, min_sites=least).collect()
        want = brute_lines([(r["doc_id"], r["text"], r["source"]) for r in documents.collect()], least)
        assert {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in rows} == want
        assert least > 2 or sum(r["n_removed"] for r in rows)


def test_near_threshold_lines_are_counted_exactly(spark):
    rows = [(i * 100 + k, f"line {i}\nown {i} {k}", f"site{k}") for i in range(95, 106) for k in range(i)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    # a sketch of 16 registers is far off; the exact counts decide
    got = line_dedup.line_dedup(df, min_sites=100, lg_k=4).groupBy().agg(F.sum("n_removed")).first()[0]
    assert got == sum(i - 1 for i in range(100, 106))


def test_lines_edges(spark, edges, empty):
    rows = line_dedup.line_dedup(edges.drop("source").withColumn("source", F.lit(None).cast("string")), min_sites=1).collect()
    assert len(rows) == len(EDGES) and not sum(r["n_removed"] for r in rows)
    text = "menu\n\nmenu\n  \nbody"
    df = spark.createDataFrame([(2, text, "a"), (1, text, "b"), (1, text, "b"), (3, None, "c"), (4, "menu", "c"), (5, "", "c"), (None, "menu", "d")], "doc_id long, text string, source string")
    got = sorted(((r["doc_id"], r["n_lines"], r["n_removed"], r["text"]) for r in line_dedup.line_dedup(df, min_sites=3).collect()), key=str)
    assert got == sorted([(1, 5, 1, "menu\n\n  \nbody"), (1, 5, 1, "menu\n\n  \nbody"), (2, 5, 2, "\n  \nbody"), (3, 0, 0, None), (4, 1, 1, ""), (5, 1, 0, ""), (None, 1, 1, "")], key=str)
    assert line_dedup.line_dedup(empty).count() == 0


# 9 n-gram join


def test_bands_reach_the_recall():
    for s, recall in ((0.8, 0.9999), (0.5, 0.95), (0.9, 0.999)):
        bands, rows = ngram_join.choose_bands(s, recall)
        assert bands * rows <= ngram_join.MAX_HASHES and 1 - (1 - s**rows) ** bands >= recall
    with pytest.raises(ValueError):
        ngram_join.choose_bands(0.01, 0.9999, 8)


def near_group(n, words=60):
    base = passage(21, words).split()
    rows = []
    for i in range(n):
        w = list(base)
        w[i % words] = f"edit{i}"
        rows.append((1000 + i, " ".join(w)))
    return rows


def test_ngram_join_brute_force(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()] + near_group(40) + [(5000, near_group(1)[0][1])]
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in ngram_join.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == ngram_join.brute_force(rows)


def chain(n, words=60, step=3):
    """Texts of which only neighbours are alike."""
    long = passage(33, words + step * n).split()
    return [(3000 + i, " ".join(long[step * i : step * i + words])) for i in range(n)]


@pytest.mark.parametrize("classes", [7, 512])
def test_large_components(spark, monkeypatch, classes):
    """Whole, in blocks, and by band."""
    rows = near_group(60) + chain(60) + [(i, passage(i, 30)) for i in range(20)]
    want = ngram_join.brute_force(rows)
    monkeypatch.setattr(ngram_join, "UNIT_CLASSES", classes)
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in ngram_join.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == want and max(x[1] for x in got.values()) > 10


def test_chains_are_verified_by_band(spark, monkeypatch):
    """A unit of a chain holds what meets in a band; a pair is compared once."""
    monkeypatch.setattr(ngram_join, "UNIT_CLASSES", 7)
    rows = chain(400)
    bands, n = ngram_join.choose_bands()
    signed = ngram_join._signatures(docs_of(spark, rows), 5, bands, n)
    classes = signed.groupBy("key").agg(ngram_join._first(), F.count("*").alias("n_copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"))
    units = ngram_join._units(classes, classes.select("key", F.lit(b"root").alias("root"))).collect()
    assert all(r["j"] >= 0 for r in units) and len(units) < 400 * 400 / 7
    meet = [b for b in {(r["key"], tuple(r["bands"])) for r in units}]
    pairs = sum(len(ngram_join._shared(np.array([b for _, b in meet]), np.zeros(len(meet)), False, j)[0]) for j in range(bands))
    assert pairs == len(ngram_join._shared(np.array([b for _, b in meet]), np.zeros(len(meet)), False)[0]) > 0


def test_joins_with_large_sides(spark, documents, monkeypatch):
    """The same rows where no side is small enough to be broadcast whole."""
    rows = near_group(30) + [(i, passage(i % 9, 30)) for i in range(60)]
    monkeypatch.setattr(ngram_join._base, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(ngram_join._base, "PARTS", 10)
    got = {r["doc_id"]: (r["class_id"], r["n_links"], r["n_copies"]) for r in ngram_join.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == ngram_join.brute_force(rows)
    want = brute_lines([(r["doc_id"], r["text"], r["source"]) for r in documents.collect()], 2)
    assert {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in line_dedup.line_dedup(documents, min_sites=2).collect()} == want


def test_intersections_both_ways():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, 40)).astype(np.uint64) for _ in range(30)]
    first = np.cumsum([0] + [len(s) for s in sets])
    x, y = np.nonzero(np.triu(np.ones((30, 30)), 1))
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(x, y)]
    assert ngram_join._intersections(np.concatenate(sets), first, x, y).tolist() == want
    few = np.array([0, 5]), np.array([9, 7])
    wide = [np.unique(rng.integers(0, 10**6, 2000)).astype(np.uint64) for _ in range(30)]
    first = np.cumsum([0] + [len(s) for s in wide])
    assert ngram_join._intersections(np.concatenate(wide), first, *few).tolist() == [len(np.intersect1d(wide[a], wide[b])) for a, b in zip(*few)]


def test_ngram_join_edges(edges, empty):
    rows = ngram_join.near_duplicates(edges).collect()
    assert len(rows) == len(EDGES)
    for r in rows:
        if r["doc_id"] in (1, 2, 3):
            assert (r["class_id"], r["n_links"], r["n_copies"], r["is_first"]) == (r["doc_id"], 0, 0, True)
        if r["doc_id"] in (None, 8, 9):
            assert (r["class_id"], r["n_links"]) == (8, 3)
        if r["doc_id"] == 4:
            assert (r["class_id"], r["n_links"], r["n_copies"]) == (4, 1, 2)
    left = ngram_join.keep_one_of_each(edges)
    assert left.columns == edges.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [1, 2, 3, 4, 5, 7, 8, 10]
    assert ngram_join.near_duplicates(empty).count() == 0 and ngram_join.keep_one_of_each(empty).count() == 0


# 10 media


def test_media_round_trip():
    for payload in (b"", b"x", bytes(range(256)) * 30, b" " * 192 * 33, b"q" * (192 * 64 + 1)):
        data = media.write_media(payload)
        (t,) = media.probe_media(data)
        assert t.payload(data) == payload and t.codec == "raw " and t.duration == len(payload) and t.timescale == 8000
        assert [data[a : a + n] for a, n in zip(t.offsets, t.sizes)] == [payload[i : i + 192] for i in range(0, len(payload), 192)]
        assert t.keyframes.tolist() == list(range(0, len(t.sizes), 8))


def test_media_boxes():
    data = media.write_media(b"a" * 384)
    names = [k for k, _, _ in media.boxes(data)]
    assert names == [b"ftyp", b"moov", b"mdat"]
    wide = data[: data.index(b"mdat") - 4] + b"\0\0\0\1mdat" + (384 + 16).to_bytes(8, "big") + b"a" * 384
    assert [(k, b - a) for k, a, b in media.boxes(wide)][2] == (b"mdat", 384)
    rest = data[: data.index(b"mdat") - 4] + b"\0\0\0\0mdat" + b"a" * 384
    assert media.probe_media(rest)[0].payload(rest) == b"a" * 384
    for broken in (data[:-1], data[:30], b"junk", data.replace(b"stsz", b"xxxx"), b"", data[:-384]):
        with pytest.raises(media.MediaError):
            media.probe_media(broken)


def test_probe_column(spark):
    good = media.write_media(b"a" * 400)
    df = spark.createDataFrame([(1, good), (2, None), (3, b"junk")], "doc_id long, media binary").withColumn("codec", F.lit("clash"))
    rows = {r["doc_id"]: r for r in media.with_probe(df).collect()}
    assert rows[1]["codec"] == "raw " and rows[1]["duration"] == 400 and rows[1]["n_samples"] == 3 and rows[1]["media_error"] is None
    assert [(k["size"]) for k in rows[1]["keyframes"]] == [192] and [(t["handler"], t["n_samples"]) for t in rows[1]["tracks"]] == [("soun", 3)]
    assert rows[2]["codec"] is None and rows[2]["media_error"] is None and rows[3]["codec"] is None and rows[3]["media_error"]
    assert media.with_probe(df.limit(0)).count() == 0


def inside(data, kind):
    a, b = next((a, b) for path, a, b in media._tree(data, *next((a, b) for k, a, b in media.boxes(data) if k == b"moov")) if path[-1] == kind)
    return data[a:b]


def two_tracks():
    """A file whose second track is a video one, in fragments of its own."""
    plain = media.write_media(b"")
    trak = inside(plain, b"trak")
    video = trak.replace(b"soun", b"vide").replace(b"raw ", b"avc1")
    at = video.index(b"tkhd") + 4 + 12
    video = video[:at] + (7).to_bytes(4, "big") + video[at + 4 :]
    trex = media._full(b"trex", struct.pack(">5I", 7, 1, 10, 3, 0x10000))
    moov = media._box(b"moov", inside(plain, b"mvhd") and media._box(b"mvhd", inside(plain, b"mvhd")), media._box(b"trak", trak), media._box(b"trak", video), media._box(b"mvex", trex))

    def moof(shift):
        first = media._box(b"trun", struct.pack(">I", 1 | 4), struct.pack(">Ii", 2, shift), struct.pack(">I", 0))
        second = media._box(b"trun", struct.pack(">I", 0x100 | 0x200 | 0x400), struct.pack(">I", 2), struct.pack(">6I", 20, 5, 0, 30, 1, 0x10000))
        return media._box(b"moof", media._box(b"traf", media._full(b"tfhd", struct.pack(">I", 7)), first, second))

    payload = b"aaabbbcccccd"
    return media._box(b"ftyp", b"isom\0\0\0\0") + moov + moof(len(moof(0)) + 8) + media._box(b"mdat", payload), payload


def test_all_tracks_and_fragments(spark):
    data, payload = two_tracks()
    audio, video = media.probe_media(data)
    assert (audio.track_id, audio.handler, len(audio.sizes)) == (1, "soun", 0)
    assert (video.track_id, video.handler, video.codec, video.duration) == (7, "vide", "avc1", 70)
    assert video.sizes.tolist() == [3, 3, 5, 1] and video.payload(data) == payload and video.keyframes.tolist() == [0, 2]
    with pytest.raises(media.MediaError):
        media.probe_media(data[:-1] if data[:-1] != data else b"")
    (r,) = media.with_probe(spark.createDataFrame([(bytearray(data),)], "media binary")).collect()
    assert [t["codec"] for t in r["tracks"]] == ["raw ", "avc1"] and [k["size"] for k in r["tracks"][1]["keyframes"]] == [3, 5]


def test_compact_sample_sizes():
    data = media.write_media(bytes(range(7)) * 3, sample_bytes=5)
    (want,) = media.probe_media(data)
    a = data.index(b"stsz") - 4
    size = int.from_bytes(data[a : a + 4], "big")
    for width, sizes in ((4, bytes([0x55, 0x55, 0x10])), (8, bytes([5, 5, 5, 5, 1])), (16, bytes([0, 5, 0, 5, 0, 5, 0, 5, 0, 1]))):
        box = media._full(b"stz2", struct.pack(">II", width, 5), sizes)
        box += media._box(b"free", b"\0" * (size - len(box) - 8))
        assert len(box) == size
        (got,) = media.probe_media(data[:a] + box + data[a + size :])
        assert got.sizes.tolist() == want.sizes.tolist() == [5, 5, 5, 5, 1]


def test_malformed_media():
    """Any bytes give tracks or MediaError, fast and in little memory."""
    deep = b""
    for _ in range(1500):
        deep = media._box(b"trak", deep)
    good = media.write_media(b"x" * 1000)
    assert media.boxes(deep)
    cut = media._box(b"moov", media._box(b"trak", *[media._box(k, b"") for k in (b"hdlr", b"stsd", b"stts", b"stsc", b"stco", b"stsz", b"mdhd")]))
    sized = good[: good.index(b"stsz") + 8] + struct.pack(">II", 1, 200_000_000) + good[good.index(b"stsz") + 16 :]
    for data in (media._box(b"moov", deep), cut, sized):
        with pytest.raises(media.MediaError):
            media.probe_media(data)
    r = random.Random(5)
    for source in (good, two_tracks()[0]):
        for _ in range(3000):
            data = bytearray(source)
            for _ in range(r.randrange(1, 4)):
                data[r.randrange(len(data) - 12 if len(source) > 900 else len(data))] = r.choice([0, 1, 255, r.randrange(256)])
            try:
                media.probe_media(bytes(data[: r.choice([len(data), r.randrange(len(data))])]))
            except media.MediaError:
                pass


def test_media_query(spark, sf_dir, texts):
    """Each digest by hashlib and zlib over the whole texts."""
    for r in media.op10_media(spark, sf_dir).collect():
        raw = (texts[r["doc_id"]]["text"] or "").encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        stored = media.write_media(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest()) and payload in stored
        assert [stored[k["start"] : k["start"] + k["size"]] for k in r["keyframes"]] == [payload[i : i + 192] for i in range(0, len(payload), 192 * 8)]


def test_media_of_texts(spark, edges, empty):
    rows = media.media_of_texts(edges).collect()
    assert len(rows) == len(EDGES)
    for r in rows:
        payload = media.probe_media(bytes(r["media"]))[0].payload(bytes(r["media"]))
        assert payload.startswith(dict(EDGES)[r["doc_id"]].encode() if dict(EDGES)[r["doc_id"]] else b"")
        assert len(payload) % 192 == 0 and len(payload) >= 192 and not payload[r["n_bytes"] :].strip(b" ")
    assert media.media_of_texts(empty).count() == 0


def test_verification_in_the_jvm_is_that_of_arrays(spark):
    """Equal, other and outside tokens in any place, for all lengths of passages."""
    for width, identity in ((25, 0.8), (25, 0.0), (9, 1.0), (1, 0.5)):
        random = np.random.default_rng(width)
        item = random.integers(0, 3, (400, width)).astype(np.uint64) << np.uint64(40) | np.uint64(2)
        document = np.where(random.random((400, width)) < 0.85, item, item ^ np.uint64(4))
        place = np.arange(width)
        item[place < random.integers(-width, width, 400)[:, None]] = 0
        document[place >= random.integers(0, 3 * width, 400)[:, None]] = 1
        passage = random.integers(1, (width + 1) // 2 + 1, 400)
        want = decontaminate.verify(item, document, passage, identity)
        rows = [(i, item[i].tobytes(), document[i].tobytes(), int(passage[i])) for i in range(400)]
        met = spark.createDataFrame(rows, "place long, item_tokens binary, tokens binary, passage long")
        found = {r["place"]: r["equal"] for r in decontaminate.verified(met, ["place", "passage"], width, identity).collect()}
        assert found == {i: int(n) for i, n in enumerate(want) if n > 0}
        assert found
