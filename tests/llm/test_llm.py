import hashlib
import random
import re
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrazzo.llm import bpe, common, decontaminate, exact_dedup, hosts, jaccard_join, language, quality, substring_dedup, suffix_dedup, toxicity
from terrazzo.operators import components
from terrazzo.llm.queries import op9_exact_dedup, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, row long, part int, node int, score int"
WORDS = "the of and with river stone apple green walk under blue seven house light paper cloud metal north sound little".split()


def frame(spark, rows):
    """A documents table with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, None, None, None, "x", 1, 2, 3, 4) for i, t in rows], SCHEMA)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + (rng.choice(WORDS) if rng.random() < 0.6 else "") for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    docs = [(k, prose(rng, rng.randint(0, 140))) for k in range(60)]
    base = prose(rng, 120)
    docs.append((60, base))
    for k in range(61, 75):  # near copies
        w = base.split()
        for _ in range(k - 60):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        docs.append((k, " ".join(w)))
    docs += [(75, base), (76, base.upper()), (77, base.replace(" ", "\n\t ")), (78, None), (79, ""), (80, " \n"), (81, "a"), (82, "a"), (83, "é ñ 😀 " * 40), (84, "x " * 300), (85, "x" * 5000), (86, prose(rng, 4000)), (-5, prose(rng, 30) + " " + base)]
    return docs


def by_id(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_windows_against_brute_force(spark, corpus):
    docs = frame(spark, corpus).repartition(5)
    assert by_id(substring_dedup.remove_repeated_windows(docs)) == brute.word_windows(corpus)
    assert by_id(suffix_dedup.remove_repeated_strings(docs)) == brute.byte_strings(corpus)


def test_small_flushes_give_the_same(spark, corpus, monkeypatch):
    from terrazzo.llm import segments

    monkeypatch.setattr(segments, "PIECE", 2000)
    docs = frame(spark, corpus).repartition(2)
    assert by_id(substring_dedup.remove_repeated_windows(docs)) == brute.word_windows(corpus)


def test_hash_collisions_are_told_apart(monkeypatch):
    text = np.frombuffer(b" ".join(b"w%d" % k for k in range(60)) + b" " + b" ".join(b"w%d" % k for k in range(60)), np.uint8)
    offsets = np.array([0, len(text)])
    windows = np.array([120 - substring_dedup.WINDOW + 1])
    right = substring_dedup._same(text, offsets, windows)
    monkeypatch.setattr(substring_dedup, "word_hashes", lambda d, s, e: np.zeros(len(s), np.uint64))
    forced = substring_dedup._same(text, offsets, windows)
    pairs = lambda g: {(i, j) for i in range(len(g)) for j in range(i) if g[i] == g[j] and g[i] >= 0}
    assert pairs(right) == pairs(forced) and len(pairs(right)) == 41


def test_phrases_make_the_order_of_all_windows():
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 2, 300), rng.integers(97, 99, 400), np.zeros(200, int), np.full(130, 7), rng.integers(0, 256, 90), rng.integers(97, 123, 50), np.tile(rng.integers(0, 3, 61), 5)]
    texts[1][200:330] = texts[1][20:150]
    texts += [np.concatenate([rng.integers(0, 3, k), texts[k % 7][5:120], rng.integers(0, 3, 9)]) for k in range(40)]
    data = np.concatenate(texts).astype(np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    buffer, at, start, count, begin, end, mini = suffix_dedup._cut(data, offsets)
    numbers, seen = {}, 0
    for bucket in range(3):  # segments of one trigger stay together
        own = np.flatnonzero(mini % np.uint64(3) == bucket)
        parts = [buffer[a:b] for a, b in zip(begin[own], end[own])]
        group = suffix_dedup._same(np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in parts])]), count[own])
        w = 0
        for part, n in zip(parts, count[own]):
            for k in range(n):
                numbers.setdefault(part[k : k + 50], set()).add((bucket, int(group[w])) if group[w] >= 0 else ("alone", seen))
                seen += 1
                w += 1
    raw = [t.astype(np.uint8).tobytes() for t in texts]
    times = {}
    for t in raw:
        for k in range(len(t) - 49):
            times[t[k : k + 50]] = times.get(t[k : k + 50], 0) + 1
    assert seen == sum(times.values()) and {w: 1 for w in times} == {w: len(x) for w, x in numbers.items()}
    named = [x for g in numbers.values() for x in g if x[0] != "alone"]
    assert len(named) == len(set(named)) == sum(n > 1 for n in times.values())


def test_sorted_strings():
    rng = np.random.default_rng(3)
    rows = sorted(rng.integers(0, 2, (60, 24)).astype(np.uint8).tobytes() for _ in range(1))[0]
    rows = [rows[k : k + 24] for k in range(0, len(rows), 24)] * 2
    buffer = np.frombuffer(b"".join(rows), np.uint8)
    begin, size = np.arange(0, len(buffer), 24), np.full(len(rows), 24)
    for back in (False, True):
        order, common = suffix_dedup.sorted_strings(suffix_dedup._strings(buffer, begin, size, 3, back))
        strings = [rows[k][::-1] if back else rows[k] for k in order]
        assert strings == sorted(strings)
        assert common.tolist() == [-1] + [next((k for k in range(24) if a[k] != b[k]), 24) for a, b in zip(strings, strings[1:])]


def test_repeated_ids(spark):
    rng = random.Random(9)
    one, two = prose(rng, 40), prose(rng, 45)
    docs = frame(spark, [(1, one), (1, two), (2, one), (2, one), (None, two), (None, None)])
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.remove_repeated_windows(docs).collect())
    assert got == [(False, 0, 0, 0), (False, 0, 45, 0), (True, 1, 40, 0), (True, 1, 45, 45), (True, 2, 40, 40), (True, 2, 40, 40)]
    found = exact_dedup.exact_duplicates(docs).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept, r.n_rows) for r in found} == {(1, 2, 3, False, 1), (2, 2, 3, True, 2), (1, 1, 2, True, 1), (None, 1, 2, False, 1), (None, None, 1, True, 1)}
    kept = exact_dedup.drop_exact_duplicates(docs).select("doc_id", "text").collect()
    assert sorted(((r.doc_id or 0), r.text or "") for r in kept) == sorted([(2, one), (1, two), (0, "")])
    assert len(jaccard_join.near_duplicates(docs).collect()) == 6


def test_jaccard_against_brute_force(spark, corpus):
    assert by_id(jaccard_join.near_duplicates(frame(spark, corpus).repartition(4))) == brute.jaccard_components(corpus)


def test_jaccard_group_of_unlike_near_copies(spark):
    rng = random.Random(31)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    docs = []
    for k in range(160):  # some linked to many, some to few, some to none, and of several sizes
        words = [w if rng.random() > (k % 8) * 0.01 else f"v{rng.randrange(10**6)}" for w in base[: 120 - k % 5 * 6]]
        docs.append((k, " ".join(words)))
    want = brute.jaccard_components(docs)
    assert 8 < len({c for _, c in want.values()}) < 120
    assert by_id(jaccard_join.near_duplicates(frame(spark, docs).repartition(5))) == want


def test_bitmaps_never_overstate():
    rng = np.random.default_rng(4)
    sets = []
    for n in (1, 5, 21, 22, 100, 130, 170, 900, 1700):
        base = rng.integers(0, 1 << 63, 4 * n).astype(np.uint64)
        sets += [np.unique(rng.choice(base, m, replace=False)) for m in (n, n, -(-3 * n // 4))]
    bits = jaccard_join.Bitmaps(jaccard_join.bitmaps(np.concatenate(sets), np.array([len(x) for x in sets])))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if 4 * min(len(a), len(b)) >= 3 * max(len(a), len(b)):
                assert bits.differing(np.array([i]), np.array([j]))[0] <= len(np.setxor1d(a, b))


def test_jaccard_many_pairs_of_one_hub(spark, corpus, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PER_HUB", 2)
    monkeypatch.setattr(jaccard_join, "SENT_ROWS", 0)
    assert by_id(jaccard_join.near_duplicates(frame(spark, corpus))) == brute.jaccard_components(corpus)


def test_jaccard_counts_all_links(spark, corpus):
    docs = corpus + [(200 + k, corpus[60][1]) for k in range(3)]
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := common_words(t)) else set() for i, t in docs}
    links = {i: sum(1 for j, b in sets.items() if j != i and a and 100 * len(a & b) >= 75 * len(a | b)) for i, a in sets.items()}
    got = by_id(jaccard_join.near_duplicates(frame(spark, docs).repartition(4), count_links=True))
    assert {i: r[:2] for i, r in got.items()} == brute.jaccard_components(docs)
    assert {i: r[2] for i, r in got.items()} == links and max(links.values()) > 8


def common_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 130)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def test_digest_index_persists(spark):
    index = exact_dedup.DigestIndex(spark, "digest_test", 3)
    assert {(r.doc_id, r.kept, r.known) for _ in range(2) for r in index.add(frame(spark, [(7, "z"), (8, "z"), (None, "y")]), "named").collect()} == {(7, False, False), (8, True, False), (None, True, False)}
    assert index.rows().count() == 2 and {(r.keep_id, r.kept) for r in index.add(frame(spark, [(9, "z")])).collect()} == {(8, False)}
    first = frame(spark, [(1, "a"), (2, "b"), (3, "a")])
    assert {(r.doc_id, r.keep_id, r.kept) for r in index.add(first).collect()} == {(1, 3, False), (3, 3, True), (2, 2, True)}
    again = {(r.doc_id, r.keep_id, r.kept, r.known) for r in index.add(frame(spark, [(9, "a"), (8, "c")])).collect()}
    assert again == {(9, 3, False, True), (8, 8, True, False)}
    assert index.rows().count() == 5
    about = {r.col_name: r.data_type for r in spark.sql("DESCRIBE EXTENDED digest_test").collect()}
    assert about["Num Buckets"] == "3" and "digest" in about["Bucket Columns"] and "digest" in about["Sort Columns"]
    batch = index.rows().groupBy("digest").count().repartition(3, "digest")
    plan = batch.join(index.rows().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "SortMergeJoin" in plan
    index.drop()


def test_exact_dedup_is_native(spark):
    index = exact_dedup.DigestIndex(spark, "native_test", 2)
    plan = index.add(frame(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    index.drop()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_bpe_round_trip(spark, corpus, library):
    rng = random.Random(3)
    odd = ["a", "ing", " ", "  ", "\n", "<|endoftext|>", "é", "😀", "ß", "12", "½", "!", "'s", "''", "aaaa", "==", "\t", "\x1c", " ", "中文", "́"]
    rows = corpus + [(1000 + k, "".join(rng.choice(odd) for _ in range(rng.randint(0, 40)))) for k in range(300)]
    got = by_id(bpe.encode_digests(frame(spark, rows), tokenizer_path()))
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert got[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()), repr(text)
    whole = {r.doc_id: r for r in bpe.encode(frame(spark, corpus), tokenizer_path()).collect()}
    assert all(whole[i].decoded == (t or "") for i, t in corpus)


def test_bpe_merges(library):
    own = bpe.encoder(open(tokenizer_path(), encoding="utf-8").read())
    rng = random.Random(5)
    for _ in range(300):
        piece = "".join(rng.choice("aeinorst") for _ in range(rng.randint(1, 25)))
        assert own.encode_piece(piece.encode()) == own.merged(piece.encode())


def test_language(spark):
    rng = random.Random(1)
    kinds = {"aa": "abcdefg", "zz": "tuvwxyz"}
    rows = [(k, y, " ".join("".join(rng.choice(kinds[y]) for _ in range(5)) for _ in range(30))) for k in range(120) for y in [rng.choice(["aa", "zz"])]]
    docs = spark.createDataFrame([(k, t, y, "s") for k, y, t in rows] + [(900, None, "aa", "s"), (901, "12 !", "aa", "s"), (902, "", None, None)], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    assert len(got) == 123 and all(0 <= r.score <= 1 for r in got.values())
    assert {got[k].lang_pred for k in (900, 901, 902)} == {"und"}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    assert np.mean([got[k].lang_pred == y for k, y, _ in rows]) > 0.97
    empty = docs.where("false")
    assert language.identify(empty).count() == 0


def test_network_gradient():
    rng = np.random.default_rng(0)
    net = language.Network(["a", "b", "c"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    text, label, live = rng.integers(0, 256, (6, 5)).astype(np.intp), rng.integers(0, 3, 5), rng.random((6, 5)) < 0.8
    _, slope = net.gradient(text, label, live)
    for name in net.p:
        where = (text[2, 3], 4) if "E" in name else tuple(rng.integers(0, s) for s in net.p[name].shape)
        kept = net.p[name][where]
        losses = []
        for step in (1e-3, -1e-3):
            net.p[name][where] = kept + step
            losses.append(net.gradient(text, label, live)[0])
        net.p[name][where] = kept
        assert abs((losses[0] - losses[1]) / 2e-3 - slope[name][where]) < 1e-4


def labelled(spark, rng, n):
    docs, labels = [], []
    for k in range(n):
        toxic, poor = k % 4 == 0, k % 5 == 0
        words_ = prose(rng, 40).split()
        if toxic:
            words_[rng.randrange(40)] = "vile"
        if poor:
            words_ = [w + "###" for w in words_]
        docs.append((k, " ".join(words_)))
        labels.append((k, int(not poor), int(toxic)))
    return frame(spark, docs), spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int"), labels


def test_toxicity_and_quality(spark):
    docs, labels, known = labelled(spark, random.Random(8), 400)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels).collect()}
    held = [k for k in known if got[k[0]].held_out]
    assert len(held) > 40 and np.mean([got[k].predicted == t for k, _, t in held]) > 0.95
    assert all(r.predicted == int(r.score >= 0.5) for r in got.values())
    rated = {r.doc_id: r for r in quality.rate_quality(docs, quality.grades_of(labels)).collect()}
    assert np.mean([rated[k].selected == bool(q) for k, q, _ in held]) > 0.95
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score_toxicity(docs, none).collect()} == {0.5}
    assert quality.rate_quality(docs, quality.grades_of(none)).count() == 400
    assert toxicity.score_toxicity(docs.where("false"), labels).count() == 0


def test_ftrl_against_plain_loops():
    """Per-coordinate FTRL-proximal as published, one feature at a time."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 9))).encode() + (b" vile" if k % 3 == 0 else b"") for k in range(60)]
    labels = [int(k % 3 == 0) for k in range(60)]
    got = toxicity.train(texts, labels)
    rows = [[(int(i), float(x)) for i, x in zip(*r)] for t in texts for r in toxicity.counts(np.frombuffer(t, np.uint8), np.array([0, len(t)]))]
    n, z, bias = {}, {}, toxicity.FEATURES

    def weight(i):
        strength = 0.0 if i == bias else toxicity.L1
        if abs(z.get(i, 0.0)) <= strength:
            return 0.0
        return ((1 if z[i] > 0 else -1) * strength - z[i]) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    draw = np.random.default_rng(3)
    for _ in range(toxicity.PASSES):
        for k in draw.permutation(len(rows)):
            x = [*rows[k], (bias, 1.0)]
            own = {i: weight(i) for i, _ in x}
            p = 1 / (1 + np.exp(-sum(own[i] * v for i, v in x)))
            for i, v in x:
                g = (p - labels[k]) * v
                step = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / toxicity.ALPHA
                z[i] = z.get(i, 0.0) + g - step * own[i]
                n[i] = n.get(i, 0.0) + g * g
    want = {i: weight(i) for i in n if i != bias and weight(i)}
    assert want and dict(zip(got.numbers.tolist(), got.values)) == pytest.approx(want) and got.bias == pytest.approx(weight(bias))
    # Scores from the sparse weights equal a plain sum over the features of a text.
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    plain = [1 / (1 + np.exp(-(got.bias + sum(want.get(i, 0.0) * v for i, v in r)))) for r in rows]
    assert toxicity.scores(got.dense(), got.bias, data, offsets) == pytest.approx(plain)


def test_ordinal_against_plain_loops():
    rng = random.Random(6)
    texts = [prose(rng, rng.randint(0, 30)).encode() for _ in range(40)] + [b"", b"a", b"ab ab ab"]
    model = quality.Ordinal([0, 1, 3], np.random.default_rng(1).normal(size=quality.FEATURES + 1), np.array([-0.3, 0.8]))
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = model.scores(data, offsets)
    for k, t in enumerate(texts):
        numbers, sizes = quality.trigrams(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert len(numbers) == max(0, len(t) - 2) == sizes[0]
        w = t.split()
        again = sum(x == y for x, y in zip(w, w[1:])) / max(1, len(w))
        plain = quality.SCALE * (sum(model.weights[i] for i in numbers) / max(1, len(numbers)) + model.weights[-1] * again)
        assert got[k] == pytest.approx(plain)
    low = 1 / (1 + np.exp(-(model.thresholds - got[0])))
    assert model.at_most(got[:1])[0] == pytest.approx(low)


def test_network_against_plain_loops():
    """Gates of one unit after the other, byte by byte, and the mean over the positions of a text longer than a segment."""
    net = language.Network(["a", "b", "c"], seed=1)
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (1, 5, 64, 65, 200)] + ["é ñ".encode(), b""]
    soft = lambda v: v / (1 + np.abs(v))

    def states(d, part):
        h, out = np.zeros(language.UNITS), {}
        for t in range(len(part)) if d == "f" else range(language.SEGMENT - 1, -1, -1):
            b = part[t] if t < len(part) else 0
            z = (soft(h @ net.p[f"{d}Uz"] + net.p[f"{d}Ez"][b]) + 1) / 2
            r = (soft(h @ net.p[f"{d}Ur"] + net.p[f"{d}Er"][b]) + 1) / 2
            c = soft((r * h) @ net.p[f"{d}Uc"] + net.p[f"{d}Ec"][b])
            h = h + z * (c - h)
            out[t] = h
        return out

    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = language.document_probabilities(net, data, offsets)
    for k, text in enumerate(texts):
        total = np.zeros(3)
        for s in range(0, len(text), language.SEGMENT):
            part = text[s : s + language.SEGMENT]
            f, b = states("f", part), states("b", part)
            for t in range(len(part)):
                e = np.exp(f[t] @ net.p["fV"] + b[t] @ net.p["bV"] + net.p["bias"])
                total += e / e.sum()
        assert got[k] == pytest.approx(total / max(1, len(text)), abs=1e-4)


def test_repeated_and_long_rows_are_judged_alike(spark, corpus):
    """Rows that repeat get the same answer, and a text longer than a worker's piece the same as in one piece."""
    rng = random.Random(12)
    docs, labels, _ = labelled(spark, rng, 120)
    long = prose(rng, 280_000)
    assert len(long) > 2 << 20
    more = frame(spark, [(1000, long), (1000, long), (1001, None), (1001, None), (1002, "vile"), (1002, "vile"), (None, ""), (None, "")])
    for found in (
        toxicity.score_toxicity(docs.unionByName(more), labels),
        quality.rate_quality(docs.unionByName(more), quality.grades_of(labels)),
        language.identify(docs.unionByName(more).withColumn("lang", F.lit("aa"))),
        bpe.encode_digests(more, tokenizer_path()),
        decontaminate.contamination(more, spark.createDataFrame([(1, long[100_000:100_300]), (1, long[100_000:100_300]), (2, None), (None, "x y z a b c")], "item_id long, text string")),
    ):
        rows = [tuple(r) for r in found.where("doc_id >= 1000 OR doc_id IS NULL").collect()]
        assert len(rows) == 8 and len(set(rows)) == 4, found.columns
        if "contaminated" in found.columns:
            assert {r[0] for r in rows if r[1]} == {1000}


def test_long_texts_in_pieces(spark):
    """One text of several pieces beside short ones that share its passages, against brute force."""
    rng = random.Random(14)
    long = prose(rng, 130_000)
    w = long.split()
    docs = [(1, " ".join(w[70_000:70_060])), (2, long), (3, " ".join(w[100:160]) + " end"), (4, " ".join(w[-40:]))]
    assert len(long) > 1 << 20
    assert by_id(substring_dedup.remove_repeated_windows(frame(spark, docs))) == brute.word_windows(docs)
    assert by_id(suffix_dedup.remove_repeated_strings(frame(spark, docs))) == brute.byte_strings(docs)
    near = [*docs, (5, long + " more")]
    assert by_id(jaccard_join.near_duplicates(frame(spark, near))) == brute.jaccard_components(near)


def test_ordinal_thresholds_stay_in_order():
    rng = random.Random(2)
    texts = [("a" * k + "b" * (40 - k)).encode() for k in range(41)] * 6
    grades = [min(3, t.count(b"a") // 11) for t in texts]
    model = quality.train(texts, grades)
    assert (np.diff(model.thresholds) > 0).all() and len(model.thresholds) == 3
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    expected = (1 - model.at_most(model.scores(data, offsets))).sum(axis=1)
    assert np.corrcoef(expected, grades)[0, 1] > 0.95 and rng


def test_hosts(spark):
    urls = ["http://A.B.net/x?q", "https://a.example.net/en/1#t", "https://example.com/de/9", "x.example.com", None, "http://h.org/fr/", "http://net", "http://net/", "ftp://good.example.org/en/2", "http://bad.example.org/en/7.html"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    outcomes = spark.createDataFrame([("bad.example.org", 1)] * 40 + [("good.example.org", 0)] * 40 + [("new.example.org", None)], "host string, bad int")
    got = {r.page_id: tuple(r)[1:] for r in hosts.judge(pages, outcomes, hosts.RULES).collect()}
    assert got == {
        0: ("a.b.net", "/x", "net/", "block"),
        1: ("a.example.net", "/en/1", "example.net/en/", "allow"),
        2: ("example.com", "/de/9", "example.com/de/", "block"),
        3: ("", "", None, "allow"),
        4: ("", "", None, "allow"),
        5: ("h.org", "/fr/", "org/fr/", "allow"),
        6: ("net", "", None, "allow"),
        7: ("net", "/", "net/", "block"),
        8: ("good.example.org", "/en/2", None, "allow"),
        9: ("bad.example.org", "/en/7.html", None, "block"),
    }
    rates = {r.host: r for r in hosts.reputation(outcomes).collect()}
    assert 0.5 < rates["bad.example.org"].lower < rates["bad.example.org"].rate < 1 and set(rates) == {"bad.example.org", "good.example.org"}
    assert hosts.judge(pages, outcomes.where("false"), hosts.RULES).where("verdict = 'block'").count() == 3


def test_reputation_against_brute_force(spark):
    """Each level's counts shrunk to the level above, in plain Python."""
    rng = random.Random(17)
    names = [f"h{k}.d{k % 7}.{('org', 'net', 'co.uk')[k % 3]}" for k in range(40)]
    rows = [(h, int(rng.random() < (0.9 if k % 7 == 3 else 0.2))) for k, h in enumerate(names) for _ in range(1 + k % 9)]
    got = {r.host: r for r in hosts.reputation(spark.createDataFrame(rows + [(None, 1), ("x.org", None)], "host string, bad int"), spark.createDataFrame([("new.d3.org",), ("a.b.nowhere",)], "host string")).collect()}
    suffix = lambda h: "co.uk" if h.endswith(".co.uk") else h.split(".")[-1]
    domain = lambda h: ".".join(h.split(".")[-(suffix(h).count(".") + 2) :])

    def sums(key):
        out = {}
        for h, bad in rows:
            n, b = out.get(key(h), (0, 0))
            out[key(h)] = (n + 1, b + bad)
        return out

    def strength(level, above):
        n, k = sum(x for x, _ in level.values()), len(level)
        s = sum(x * (b / x - above(h)) ** 2 for h, (x, b) in level.items())
        v = sum(x * above(h) * (1 - above(h)) for h, (x, _) in level.items())
        each = n / k
        rho = (s / v * each - 1) / max(each - 1, 1e-9)
        return min(1000.0, max(2.0, 1 / rho - 1)) if rho > 0 else 1000.0

    tops, level, own = sums(suffix), sums(domain), sums(lambda h: h)
    mean = sum(b for _, b in rows) / len(rows)
    s1 = strength(tops, lambda _: mean)
    of_top = {h: (b + s1 * mean) / (n + s1) for h, (n, b) in tops.items()}
    s2 = strength(level, lambda h: of_top[suffix(h)])
    of_level = {h: (b + s2 * of_top[suffix(h)]) / (n + s2) for h, (n, b) in level.items()}
    s3 = strength(own, lambda h: of_level[domain(h)])
    for h in [*names, "new.d3.org", "a.b.nowhere"]:
        n, b = own.get(h, (0, 0))
        known, top = domain(h) in of_level, suffix(h) in of_top
        w, above = (s3, of_level[domain(h)]) if known else (min(s3, s2), of_top[suffix(h)]) if top else (min(s1, s2, s3), mean)
        x, y = b + w * above, n - b + w * (1 - above)
        rate = x / (x + y)
        assert abs(got[h].rate - rate) < 1e-9 and abs(got[h].lower - (rate - 1.64 * (rate * (1 - rate) / (x + y + 1)) ** 0.5)) < 1e-9, h
    assert set(got) == {*names, "new.d3.org", "a.b.nowhere"}


def test_suffix_rules(spark):
    rows = spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("uk",), ("x.example.com",), ("",), ("a.b.city.kobe.jp",)], "h string")
    got = {r.h: (r.s, r.d) for r in rows.select("h", hosts.suffix_of(F.col("h"), [*hosts.SUFFIXES, "city.kobe.jp"]).alias("s"), hosts.domain_of(F.col("h"), [*hosts.SUFFIXES, "city.kobe.jp"]).alias("d")).collect()}
    assert got == {"a.b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", "co.uk"), "uk": ("uk", "uk"), "x.example.com": ("com", "example.com"), "": ("", ""), "a.b.city.kobe.jp": ("city.kobe.jp", "b.city.kobe.jp")}


def test_hosts_without_labels_fall_back(spark):
    urls = ["http://new.spam.com/a", "http://new.fine.com/a", "http://new.spam.co.uk/a", "http://new.fine.co.uk/a", "http://other.test/a", "nothing"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    outcomes = [(f"{k}.{name}.{end}", bad) for k in range(4) for name, bad in (("spam", 1), ("fine", 0)) for end in ("com", "co.uk") for _ in range(20)]
    outcomes = spark.createDataFrame([*outcomes, *[("x.bad.zip", 1)] * 90], "host string, bad int")
    assert [r.verdict for r in hosts.judge(pages, outcomes, {}).orderBy("page_id").collect()] == ["block", "allow", "block", "allow", "allow", "allow"]
    rates = {r.host: r for r in hosts.reputation(outcomes, spark.createDataFrame([("b.fine.co.uk",), ("y.new.zip",), ("0.spam.com",)], "host string")).collect()}
    assert rates["b.fine.co.uk"].n == 0 and rates["b.fine.co.uk"].rate < 0.1 and rates["y.new.zip"].rate > 0.9 and rates["0.spam.com"].n == 20


def test_decontamination(spark):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(600)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.randint(14, 45)).capitalize() + ".") for k in range(30)] + [(98, "too short"), (99, None)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = [(k, text(200)) for k in range(200)]
    for k in range(30):  # whole, and with a fifth of the words changed
        docs.append((1000 + k, f"{text(rng.randint(0, 90))} {items[k][1]} {text(50)}"))
        w = items[k][1].split()
        for j in range(2, len(w) - 6, 5):
            w[j] = rng.choice(vocabulary)
        docs.append((2000 + k, f"{text(70)} {' '.join(w)} {text(20)}"))
    docs += [(3000, None), (3001, ""), (3002, "x " * 3000)]
    got = {r.doc_id: r for r in decontaminate.contamination(frame(spark, docs), benchmark).collect()}
    assert len(got) == len(docs)
    assert all(got[1000 + k].contaminated and got[1000 + k].item_id == k and got[1000 + k].share == 1 for k in range(30))
    assert sum(got[2000 + k].contaminated for k in range(30)) >= 27
    assert not any(r.contaminated for i, r in got.items() if i < 1000 or i >= 3000)
    assert decontaminate.drop_contaminated(frame(spark, docs), benchmark).where("doc_id BETWEEN 1000 AND 1999").count() == 0
    assert decontaminate.contamination(frame(spark, docs[:5]), benchmark.where("false")).where("contaminated").count() == 0


def test_short_items_in_any_place_are_found(spark):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(150)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.randint(6, 20))) for k in range(25)]
    docs = [(k * 100 + j, f"{text(40 + j)} {w} {text(60)}") for k, (_, w) in enumerate(items) for j in range(16)]
    docs += [(5000 + k, " ".join(x if rng.random() < 0.8 else rng.choice(vocabulary) for x in f"{text(33)} {w} {text(50)}".split())) for k, w in items for _ in range(4)]
    words = [decontaminate.cut_words(w) for _, w in items]
    want = sorted((i, sum(decontaminate._best_share(w, decontaminate.cut_words(t)) > 0 for w in words)) for i, t in docs)
    got = decontaminate.contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_items) for r in got) == want
    assert all(n for i, n in want if i < 5000) and any(not n for i, n in want)


def test_items_of_a_few_words_and_with_other_blanks(spark):
    rng = random.Random(30)
    wide = [(k, "".join(w + rng.choice([" ", "\u00a0", "\u00a0 ", "\u2003", "\x1c"]) for w in prose(rng, rng.randint(12, 30)).split())) for k in range(8)]
    items = [*wide, (50, "Too short!"), (51, "too short"), (52, "one"), (53, "..."), (54, ""), (55, "a b c d")]
    docs = [(k, f"{prose(rng, 60)} {w} {prose(rng, 30)}") for k, w in wide]
    docs += [(100, "too SHORT"), (101, "it is too short"), (102, "One."), (103, "..."), (104, ""), (105, None), (106, "a b c d e"), (107, "a-b-c\td"), (107, "a-b-c\td"), (108, prose(rng, 90))]
    got = decontaminate.contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = {**{k: (1, k) for k, _ in wide}, 100: (2, 50), 102: (1, 52), 107: (1, 55)}
    assert sorted((r.doc_id, r.n_items, r.item_id or 0, r.share) for r in got) == sorted((i, *want.get(i, (0, 0)), float(i in want)) for i, _ in docs)
    few = spark.createDataFrame(items[8:], "item_id long, text string")  # no item for the latent space
    assert sorted(r.doc_id for r in decontaminate.contamination(frame(spark, docs), few).where("contaminated").collect()) == [100, 102, 107, 107]


def test_latent_space_is_fitted_on_every_passage(spark, monkeypatch):
    rng = random.Random(33)
    items = [prose(rng, 20) for _ in range(6)]
    vocabulary = sorted({w for t in items for w in decontaminate.cut_words(t)})
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 90 if k % 50 == 0 else 9))) for k in range(400)] + ["", "of no item"]
    times = 800  # more passages than there were in a sample
    docs = frame(spark, list(enumerate(texts))).crossJoin(spark.range(times)).select(F.expr("doc_id + 1000 * id").alias("doc_id"), "text")
    summed = []
    monkeypatch.setattr(decontaminate.Space, "solve", lambda self, total: summed.append(total))
    space = decontaminate.fit(docs, decontaminate.Space(list(range(6)), items))
    passages = [w[a : a + 32] for w in map(decontaminate.cut_words, texts) for a in range(0, len(w), 32)]
    assert len(passages) * times > 1 << 18
    at = {h: c for h, c in zip(space.vocabulary.tolist(), space.column.tolist())}
    data, offsets = common.utf8(pa.array(vocabulary))
    column = dict(zip(vocabulary, (at[h] for h in decontaminate.terms(data, offsets)[2].tolist())))
    counts = np.zeros((len(passages), space.size))
    for k, p in enumerate(passages):
        for w in p:
            counts[k, column.get(w, 0)] += w in column
    idf = np.log1p((1 + times * len(passages)) / (1 + times * counts.sum(axis=0)))
    weighted = counts * idf
    np.testing.assert_allclose(space.idf, idf)
    np.testing.assert_allclose(summed[0], times * weighted.T @ (weighted @ space.random), rtol=1e-3, atol=1e-4 * np.abs(summed[0]).max())


def test_row_sums():
    rng = np.random.default_rng(34)
    for high in (1, 3, 40, 5000):
        sizes = rng.integers(0, high, size=30)
        rows = np.concatenate([rng.normal(size=(50, 4)), np.zeros((1, 4))])
        index = rng.integers(0, 50, size=int(sizes.sum()))
        want = np.array([rows[own].sum(axis=0) for own in np.split(index, np.cumsum(sizes)[:-1])])
        np.testing.assert_allclose(decontaminate.row_sums(rows, index, sizes), want, atol=1e-9)
    assert decontaminate.row_sums(rows, index[:0], sizes[:0]).shape == (0, 4)


def test_bad_rows_leave_clean_rows_of_their_id(spark):
    rng = random.Random(21)
    one, two, three, item = prose(rng, 60), prose(rng, 50), prose(rng, 40), prose(rng, 20)
    texts = lambda d: sorted((r.doc_id or 0, r.text) for r in d.select("doc_id", "text").collect())
    near = frame(spark, [(1, one), (None, one + " again"), (None, two), (5, one + " more"), (5, three)])
    assert texts(jaccard_join.drop_near_duplicates(near)) == sorted([(1, one), (0, two), (5, three)])
    leaky = frame(spark, [(None, item + " x"), (None, two), (5, "y " + item), (5, three), (6, None)])
    kept = decontaminate.drop_contaminated(leaky, spark.createDataFrame([(1, item), *((k, prose(rng, 40)) for k in range(2, 6))], "item_id long, text string"))
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(0, two), (5, three), (6, "")])


def test_null_id_is_never_the_smallest(spark):
    one = prose(random.Random(22), 60)
    docs = frame(spark, [(3, one), (4, one.upper()), (None, one.replace(" ", "  ")), (9, one + " more")])
    assert {r.component_id for r in jaccard_join.near_duplicates(docs).collect()} == {3}
    assert [r.doc_id for r in jaccard_join.drop_near_duplicates(docs).collect()] == [3]


def test_exact_query_gives_each_row(spark, tmp_path):
    rows = [(1, "a")] * 5000 + [(2, "a"), (3, "b"), (3, "b"), (None, None)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = op9_exact_dedup(spark, str(tmp_path)).groupBy("doc_id", "keep_id", "group_size", "kept").count().collect()
    assert {tuple(r) for r in got} == {(1, 2, 5001, False, 5000), (2, 2, 5001, True, 1), (3, 3, 2, True, 2), (None, None, 1, True, 1)}


def test_many_texts_of_one_id_are_told_apart(spark):
    rng = random.Random(23)
    shared = prose(rng, 30)
    texts = [f"{prose(rng, 5)} {k} {shared} {k}" for k in range(300)]
    # Rows of one id and unlike texts don't repeat each other within op10: only those after another id do.
    got = substring_dedup.remove_repeated_windows(frame(spark, [(None, t) for t in texts]).repartition(3)).collect()
    assert len(got) == 300 and {r.n_removed for r in got} == {0}
    got = substring_dedup.remove_repeated_windows(frame(spark, [(1, texts[0])] + [(2, t) for t in texts[1:]])).collect()
    assert sorted(r.n_removed for r in got) == [0] + [30] * 299


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(1, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.common_subsequence(a, b)[0] == t[-1][-1]


@pytest.mark.parametrize(
    "run",
    [
        lambda d: substring_dedup.remove_repeated_windows(d),
        lambda d: suffix_dedup.remove_repeated_strings(d),
        lambda d: jaccard_join.near_duplicates(d),
        lambda d: exact_dedup.exact_duplicates(d),
        lambda d: bpe.encode_digests(d, tokenizer_path()),
    ],
)
def test_empty_tables(spark, run):
    assert run(frame(spark, [])).count() == 0


def test_words():
    import pyarrow as pa

    rows = ["a b", "", None, "\tcc\x0bd \n", "e", "f"]
    data, offsets = common.utf8(pa.array(rows))
    starts, ends, per_row = common.words(data, offsets)
    assert [data[a:b].tobytes().decode() for a, b in zip(starts, ends)] == ["a", "b", "cc", "d", "e", "f"] and per_row.tolist() == [2, 0, 0, 2, 1, 1]
