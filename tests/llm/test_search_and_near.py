import math
import random

import numpy as np

from granary.llm.anisotropic import Quantiser, nearest
from granary.llm.components import connected
from granary.llm.order_minhash import Shingler, aligned, alignment, bucket_keys, keep_one_of_each, links_among, near_duplicates, sketches
from granary.llm.pseudo_likelihood import Hashes, Vocabulary, WindowNetwork, _averaged, _scores, count_words, fit_network, score_corpus, with_hashes, with_pseudo_likelihood


def test_search_meets_recall_and_leaves_out_what_is_no_vector(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 24))
    x[700:760] = x[20]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    odd = [(2000, None), (2020, [0.0] * 24), (2040, [None] + [1.0] * 23), (2060, [math.nan] * 24), (2080, [math.inf] * 24), (2100, [1.0] * 3), (None, x[0].tolist()), (5, x[5].tolist())]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(4)
    got = nearest(df, "vec_id", "embedding", "vec_id % 20 = 0", candidate_block=400, query_block=40, rerank=60).collect()
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(by) == set(range(0, 1500, 20))
    hit = 0
    for q, found in by.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and q not in {f[1] for f in found}
        exact = x @ x[q]
        exact[q] = -np.inf
        assert np.allclose([f[2] for f in found], [x[f[1]] @ x[q] for f in found])
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        hit += len({f[1] for f in found} & set(np.lexsort([np.arange(1500), -exact])[:20]))
    assert hit / (20 * len(by)) >= 0.9
    assert [f[1] for f in sorted(by[20])][:20] == list(range(700, 720))
    assert nearest(df.limit(0), "vec_id", "embedding", "vec_id % 20 = 0").collect() == []
    lone = nearest(df.unionByName(spark.createDataFrame([(7000, [2.0, 1.0]), (7001, [3.0, -1.0]), (7020, [1.0, 1.0])], df.schema)), "vec_id", "embedding", "vec_id >= 7000", rerank=60).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in lone if r.query_id == 7020) == [(7020, 1, 7000, 3.0), (7020, 2, 7001, 2.0)]
    few = nearest(df.filter("vec_id < 3"), "vec_id", "embedding", "vec_id % 20 = 0").collect()
    assert [r["rank"] for r in few] == [1, 2]


def test_parallel_error_costs_more_under_the_anisotropic_loss():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8))
    q = Quantiser.fit(x, threshold=0.7)
    spaces = np.arange(q.books.shape[0])
    def parallel(codes):
        r = (x.reshape(400, 4, 2) - q.books[spaces, codes]).reshape(400, 8)
        return np.mean(((r * x).sum(axis=1) / np.linalg.norm(x, axis=1)) ** 2)
    assert parallel(q.encode(x)) < parallel(q._nearest(q._parts(x, 4, 2), q.books))
    estimate = [sum(t[j][c] for j, c in enumerate(q.packed(q.encode(x[:1]))[:, 0])) for t in q.tables(x[:3])]
    assert np.allclose(estimate, x[:3] @ q.books[spaces, q.encode(x[:1])[0]].reshape(-1), atol=1e-4)


def near_texts(seed=2, groups=6):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    texts = []
    passage = [word() for _ in range(60)]
    for _ in range(groups):
        base = [word() for _ in range(rnd.randint(60, 200))]
        texts.append(base)
        for _ in range(8):
            copy = list(base)
            for _ in range(rnd.randint(1, 4)):
                copy[rnd.randrange(len(copy))] = word()
            texts.append(copy)
    texts += [passage + [word() for _ in range(60)] for _ in range(25)]
    texts += [[word() for _ in range(80)] for _ in range(10)]
    return [" ".join(t) for t in texts]


def brute_classes(texts):
    s = Shingler()
    x = [s.labelled(s.words(t or "")) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            same = s.words(texts[i] or "") == s.words(texts[j] or "") if len(x[i]) else (texts[i] or "") == (texts[j] or "")
            if same or alignment(x[i], x[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(texts))]


def test_near_classes_match_brute_force(spark):
    texts = near_texts() + ["one two three", "One, two three!", "one two", "", None, "...", "...", "!!", "again and again and again " * 30] + ["copy of a text with more than five words"] * 5
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, class_id int").repartition(3).cache()
    want = brute_classes(texts)
    for how in ({}, {"block_rows": 5, "block_kmers": 700}):
        got = {r.doc_id: r.class_id for r in near_duplicates(df, **how).collect()}
        assert [got[k] for k in range(len(texts))] == want, how
    kept = keep_one_of_each(df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want)) and kept.columns == df.columns
    assert near_duplicates(df.limit(0)).collect() == [] and keep_one_of_each(df.limit(0)).collect() == []


def short_pairs(seed=4):
    """Texts of 8 to 20 words with a copy that has a word more or less at an end, and of 9 to 60 with one changed at an end."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    texts = []
    for size in list(range(8, 21)) * 4:
        base = [word() for _ in range(size)]
        texts += [base, base + [word()]] if size % 2 else [base, [word(), *base]]
    for size in range(9, 73, 3):
        base = [word() for _ in range(size)]
        texts += [base, [word(), *base[1:]], base[: size - 2 * (size // 24)]]
    return [" ".join(t) for t in texts]


def test_short_near_pairs_match_brute_force(spark):
    texts = short_pairs()
    want = brute_classes(texts)
    assert sum(w != k for k, w in enumerate(want)) > 60
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).cache()
    got = {r.doc_id: r.class_id for r in near_duplicates(df).collect()}
    assert [got[k] for k in range(len(texts))] == want


def test_near_pairs_of_all_sizes_share_a_bucket():
    rng = np.random.default_rng(5)
    for n in range(4, 80):
        x = rng.integers(0, 2**63, n + n // 4).astype(np.uint64)
        for a, b in ((x, x[n // 4 :]), (x[:n], x[:-1][n // 8 : n + n // 8])):
            if alignment(a, b):
                assert len(np.intersect1d(bucket_keys(a, 34, 6), bucket_keys(b, 34, 6))), (len(a), len(b))


def test_repeated_ids_and_null_ids_keep_one_row(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (2, "h i j k l m n")], "doc_id long, text string")
    assert sorted(r.doc_id for r in keep_one_of_each(df).collect()) == [1, 2]


def test_classes_of_null_or_repeated_ids_each_keep_a_row(spark):
    same = ["a b c d e f g", "h i j k l m n", "o p q r s t u", "v w x y z a b"]
    rows = [(None, same[0])] * 2 + [(None, same[1])] * 2 + [(5, same[2]), (6, same[2]), (5, same[3]), (7, same[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    kept = keep_one_of_each(df).collect()
    assert sorted(r.text for r in kept) == sorted(same)
    assert sorted(str(r.doc_id) for r in kept) == ["5", "5", "None", "None"]
    assert len({r._class for r in near_duplicates(df).collect()}) == 4


def test_alignment_counts_equal_kmers_in_order():
    a = np.array([1, 2, 3, 4, 5, 6], np.uint64)
    assert aligned(a, a) == 6 and aligned(a, a[::-1]) == 1 and aligned(a, a[[0, 2, 1, 3, 4, 5]]) == 5
    assert aligned(a, a, band=0) == 6 and aligned(a, a[1:], band=0) == 0
    s = Shingler(k=2)
    x = s.labelled("a b a b a b".split())
    assert len(set(x.tolist())) == len(x) and set(s.labelled("a b a b".split()).tolist()) <= set(x.tolist())


def test_sketches_are_sensitive_to_order():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, 200).astype(np.uint64)
    same = sum(int(u == v) for u, v in zip(sketches(x, 40, 4), sketches(x[::-1].copy(), 40, 4), strict=True))
    assert same == 0 and (sketches(x, 40, 4) == sketches(np.append(x, x[:0]), 40, 4)).all()


def test_links_among_joins_all_components():
    rows = [np.arange(0, 100, dtype=np.uint64), np.arange(2, 102, dtype=np.uint64), np.arange(4, 104, dtype=np.uint64), np.arange(500, 600, dtype=np.uint64)]
    assert links_among(np.arange(4), rows, np.zeros(4, int)) == [(0, 1), (0, 2)]
    assert links_among(np.array([0, 0, 0, 3]), rows, np.zeros(4, int)) == []


def test_components_of_a_long_path_and_a_star(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 150)] + [(7, 7)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 150)}
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []


def slow_log_p(net, context, target):
    """log P of one target, by a softmax over all tokens of the group and one over all groups."""
    p = {k: x.astype(np.float64) for k, x in net.p.items()}
    h = np.tanh(sum(p["context"][k][c] for k, c in enumerate(context)) + p["bias"])
    log_softmax = lambda z: z - z.max() - np.log(np.exp(z - z.max()).sum())
    g, w = divmod(target, net.per_group)
    return log_softmax(h @ p["group"] + p["group_bias"])[g] + log_softmax(h @ p["word"][g] + p["word_bias"][g])[w]


def test_network_is_a_distribution_and_its_gradients_are_right():
    v = Vocabulary(np.array([7], np.uint32), np.arange(1.0, 13.0), 3, 4)
    net = WindowNetwork(v, hidden=6)
    rng = np.random.default_rng(2)
    for k in ("group", "word"):
        net.p[k] = rng.normal(0, 0.5, net.p[k].shape).astype(np.float32)
    context, target = np.array([[0, 12], [1, 12], [2, 4], [3, 5]]), np.array([7, 2])
    total = sum(np.exp(net.log_likelihood(context, np.full(2, t))) for t in range(12))
    assert np.allclose(total, 1, atol=1e-4)
    before = {k: x.copy() for k, x in net.p.items()}
    loss = lambda: -np.mean([slow_log_p(net, c, t) for c, t in zip(context.T, target, strict=True)])
    assert abs(loss() + net.log_likelihood(context, target).mean()) < 1e-4
    slopes = {}
    for name, index in (("context", (0, 0, 2)), ("context", (1, 12, 1)), ("context", (3, 5, 0)), ("bias", (3,)), ("group", (1, 2)), ("group_bias", (1,)), ("word", (1, 2, 3)), ("word_bias", (0, 2))):
        net.p = {k: x.astype(np.float64) for k, x in before.items()}
        net.p[name][index] += 1e-4
        up = loss()
        net.p[name][index] -= 2e-4
        slopes[name, index] = (up - loss()) / 2e-4
    net.p = {k: x.copy() for k, x in before.items()}
    seen = {k: np.zeros_like(x) for k, x in net.p.items()}
    net.step(context, target, 0.1, seen)
    for (name, index), slope in slopes.items():
        assert abs(np.sqrt(seen[name][index]) - abs(slope)) < 1e-3, name
        assert abs(slope) < 1e-3 or np.sign(before[name][index] - net.p[name][index]) == np.sign(slope), name


def test_scores_equal_brute_force_cover_whole_texts_and_learn_order(spark):
    rnd = random.Random(9)
    text = lambda n=60: " ".join(rnd.choice(["red fox runs fast", "blue bird sings loud", "old tree stands still"]) for _ in range(n))
    df = spark.createDataFrame([(k, text(), 3) for k in range(150)] + [(900, None, 1), (901, "", 1), (902, "12 ..", 1), (903, text(9000), 1), (904, "same words", 1), (904, "same words", 1)], "doc_id long, text string, pll int").repartition(3).cache()
    hashed = with_hashes(df)
    v = count_words(hashed, groups=4, per_group=16, bins=16)
    net = fit_network(hashed, v, batch=64, rounds=2, per_copy=20_000, fan_in=2)
    scored = with_pseudo_likelihood(df, net, v).collect()
    rows = {r.doc_id: r for r in scored}
    assert len(scored) == 156 and rows[0].n_tokens == 240 and (rows[900].n_tokens, rows[900].pll, rows[901].pll_per_token, rows[902].n_tokens) == (0, 0.0, 0.0, 0)
    assert rows[903].n_tokens == 36_000 and len({r.pll for r in scored if r.doc_id == 904}) == 1
    hashes = Hashes(most=3)
    for r in (rows[0], rows[77], rows[904]):
        row = [v.padding] * 2 + v.tokens(hashes.of(r.text)).tolist() + [v.padding] * 2
        want = sum(slow_log_p(net, [row[i - 2], row[i - 1], row[i + 1], row[i + 2]], row[i]) for i in range(2, len(row) - 2))
        assert abs(want - r.pll) < 1e-4 * r.n_tokens
    from_hashes = {r.doc_id: r.pll for r in with_pseudo_likelihood(hashed, net, v, hashes_col="hashes").collect()}
    assert all(abs(from_hashes[k] - rows[k].pll) < 1e-4 * max(1, rows[k].n_tokens) for k in rows)
    words = rows[0].text.split()
    rnd.shuffle(words)
    own, mixed = _scores(net, v, [hashes.of(t).tobytes() for t in (rows[0].text, " ".join(words))])
    assert own[1] > mixed[1] + 50
    assert with_pseudo_likelihood(df.limit(0), net, v).collect() == []
    assert len(count_words(hashed.limit(0), groups=2, per_group=8, bins=8).hashes) == 0 and score_corpus(df.limit(0)).collect() == []


def test_trained_on_all_tokens_it_beats_the_unigram_of_the_same_tokens(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    v = count_words(with_hashes(docs))
    rows = score_corpus(docs).agg({"pll": "sum", "n_tokens": "sum"}).first()
    n = rows["sum(n_tokens)"]
    assert n == v.counts.sum()
    used = v.counts[v.counts > 0]
    assert rows["sum(pll)"] / n > (used * np.log(used / n)).sum() / n + 0.3


def test_bins_start_at_the_counts_of_the_words_in_them(spark):
    texts = ["aa bb " * 50 + " ".join(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" * (1 + k % 3) for k in range(500)), "aa É é É", None]
    v = count_words(with_hashes(spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)), groups=2, per_group=8, bins=14)
    hashes, want = Hashes(), np.zeros(16)
    assert v.hashes.tolist() == hashes.of("aa bb").tolist()
    np.add.at(want, np.concatenate([v.tokens(hashes.of(t)) for t in texts]), 1)
    assert v.counts.tolist() == want.tolist() and v.counts[2:].sum() == 503


def test_all_tokens_train_whatever_stands_between_them(spark):
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    texts = [[rnd.choice(words) for _ in range(400)] for _ in range(10)]
    by = {sep: spark.createDataFrame([(sep.join(t),) for t in texts], "text string").coalesce(1) for sep in " \t\n"}
    v = count_words(with_hashes(by[" "]), groups=8, per_group=48, bins=16)
    nets = {sep: fit_network(with_hashes(df), v, batch=256) for sep, df in by.items()}
    known = len(v.hashes)
    changed = nets[" "].p["context"] != WindowNetwork(v).p["context"]
    assert known >= 290 and changed[:, :known].any(axis=2).all()
    assert all(np.array_equal(nets[" "].p[k], nets[sep].p[k]) for sep in "\t\n" for k in nets[" "].p)


def test_copies_are_averaged_as_a_tree_by_what_each_has_seen(spark):
    v = Vocabulary(np.array([7], np.uint32), np.arange(1.0, 13.0), 3, 4)
    rng = np.random.default_rng(4)
    width, rows, head = sum(x.size for x in WindowNetwork(v, hidden=2).p.values()), 13, 4 * 13 * 2
    copies = [(n, rng.integers(0, 9, rows).astype(np.float32), rng.normal(size=width).astype(np.float32)) for n in (5, 1, 7, 3)]
    pack = lambda c: (c[0], c[1].tobytes(), c[2].tobytes())
    n, counts, flat = _averaged(map(pack, copies), rows, width, head, 4)
    flat = np.frombuffer(flat, np.float32)
    assert n == 16 and np.allclose(flat[head:], sum(c[0] * c[2][head:] for c in copies) / 16, atol=1e-5)
    weight = np.stack([c[1] + 1e-3 for c in copies])
    want = sum((c[2][:head].reshape(4, rows, 2) * w[None, :, None]) for c, w in zip(copies, weight, strict=True)) / weight.sum(axis=0)[None, :, None]
    assert np.allclose(flat[:head], want.reshape(-1), atol=1e-4)
    halves = [_averaged(map(pack, part), rows, width, head, 4) for part in (copies[:2], copies[2:])]
    assert np.allclose(np.frombuffer(_averaged(halves, rows, width, head, 4)[2], np.float32), flat, atol=2e-3)
