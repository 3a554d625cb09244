import collections
import hashlib
import random
import zlib

import models
import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnweave.llm import common, decontaminate, jaccard_join, lm_scoring, packing, pii, quality, sharding, suffix_dedup, suffix_hash, token_output, url_filters


@pytest.fixture(scope="module")
def rows():
    return models.corner_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return models.frame(spark, rows).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return models.frame(spark, [])


# ---- n-gram Jaccard join


@pytest.mark.parametrize("more", [{}, {"bucket": 3, "block_sets": 2}, {"bucket": 2, "block_sets": 7}])
def test_jaccard_links(docs, rows, more):
    expect = models.near_classes(rows)
    got = jaccard_join.jaccard_classes(docs, **more).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.class_id, r.n_links, r.n_copies) for r in got} == {(i, *expect[i]) for i, _ in rows}


@pytest.mark.parametrize("edits", [3, 9])
def test_jaccard_groups_of_near_copies(spark, edits):
    """Families around a base, tight and wide, beside texts that share a passage, in crowded buckets and blocks."""
    rnd = random.Random(edits)
    base = [f"w{i}" for i in range(160)]
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(rnd.randrange(edits)):
            w[rnd.randrange(160)] = f"e{rnd.randrange(40)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join([*base[:90], *(f"u{i}x{j}" for j in range(60))])) for i in range(80)]
    expect = models.near_classes(rows)
    got = jaccard_join.jaccard_classes(models.frame(spark, rows), bucket=16, block_sets=24).collect()
    assert {(r.doc_id, r.class_id, r.n_links, r.n_copies) for r in got} == {(i, *expect[i]) for i, _ in rows}


def test_recall_of_the_whole_join(spark):
    """Pairs of similarity 0.8 to 0.83, of 30 to 700 words: all but a few in ten thousand are found."""
    rnd = random.Random(3)
    rows, expect = [], {}
    while len(rows) < 1600:
        n = rnd.choice((30, 60, 120, 250, 700))
        k = len(rows)
        w = [f"{k}w{j}" for j in range(n)]
        v = list(w)
        gone: set[int] = set()
        while True:  # as many changed words as the threshold allows
            at = rnd.randrange(n)
            more = gone | {x for x in range(at - 4, at + 1) if 0 <= x <= n - 5}
            m = n - 4
            if (m - len(more)) * 1.8 < 0.8 * 2 * m:
                break
            gone, v[at] = more, f"{k}v{at}"
        if gone:
            rows += [(k, " ".join(w)), (k + 1, " ".join(v))]
    got = jaccard_join.jaccard_classes(models.frame(spark, rows)).where("n_links = 1").count()
    assert got >= len(rows) - 4


def test_jaccard_keeps_one(docs, rows, empty):
    kept = jaccard_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    expect = models.near_classes(rows)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({i for i, _ in rows if expect[i][0] == i})
    assert jaccard_join.keep_one_of_each(empty).count() == 0


def test_jaccard_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(30))
    got = jaccard_join.jaccard_classes(models.frame(spark, [(None, text), (5, text), (6, text + " more")])).collect()
    assert sorted(r.n_links for r in got) == [1, 1, 1] and sum(r.n_copies for r in got) == 2


def test_runs_follow_from_recall():
    assert jaccard_join.runs_for(0.9999) == 15
    assert 0 < jaccard_join.meeting(3) < jaccard_join.meeting(2) < jaccard_join.meeting(1) < 1


def test_recall_of_chosen_paths():
    """Pairs at the threshold share a leaf in nearly all of many draws."""
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(150):
        pool = rng.integers(0, 2**63, 110, dtype=np.uint64)
        a, b = np.sort(pool[:100]), np.sort(pool[10:110])  # 90 of 110 shared: 0.82
        missed += not len(np.intersect1d(jaccard_join.leaves(a, 15, 0.8), jaccard_join.leaves(b, 15, 0.8)))
    assert missed <= 1


def test_sketches_miss_no_link_of_small_sets():
    rng = np.random.default_rng(2)
    for n in (5, 9, 22, 46, 90, 200, 500):
        both = -(-2 * n * 4 // 9)  # the least that two sets of n must share at 0.8
        for _ in range(400):
            pool = rng.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
            a, b = np.sort(pool[:n]), np.sort(pool[n - both :])
            bits = np.stack([np.frombuffer(jaccard_join.sketch(s), np.uint64) for s in (a, b)])
            assert jaccard_join.similar_sketches(bits, np.array([n, n]), 0.8)[0, 1], n


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (9, 8), (4, 3), (5, 5), (None, 1)], "a long, b long")
    assert {r.node: r.root for r in common.components(edges, "a", "b").collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.root for r in common.components(chain, "a", "b").collect()} == {0}


# ---- token output


def test_packed_rows_round_trip(docs, rows, empty):
    got = token_output.packed_rows(docs, row=256, group=5_000).collect()
    code = token_output.ByteEncoder(token_output.byte_vocabulary_path())
    matrix = token_output.matrix(got, 256)
    parts = collections.defaultdict(list)
    for r, ids in zip(got, matrix, strict=True):
        assert r.cu_seqlens[-1] == r.n_tokens <= 256 and r.position_resets == r.cu_seqlens[:-1]
        assert (ids[r.n_tokens :] == code.end_id).all()
        pos = token_output.position_ids(r.cu_seqlens, 256)
        assert all(pos[a] == 0 for a in r.position_resets)
        for d, s, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            parts[d].append((s, ids[a:b].tolist()))
    plain = collections.Counter((i, t or "") for i, t in rows)
    for d in {i for i, _ in rows} - {900}:
        ids = [x for _, p in sorted(parts[d]) for x in p]
        assert ids[-1] == code.end_id and plain[d, code.encoding.decode(ids[:-1])] == 1
    assert token_output.packed_rows(empty).count() == 0


def test_best_fit_decreasing_is_best_fit():
    rnd = random.Random(4)
    for _ in range(50):
        sizes = [rnd.randrange(1, 65) for _ in range(rnd.randrange(0, 80))]
        rows, spaces = [], []
        for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            fits = [s for s in spaces if s >= sizes[i]]
            if fits:
                spaces[spaces.index(min(fits))] -= sizes[i]
            else:
                spaces.append(64 - sizes[i])
        rows = token_output.best_fit_decreasing(sizes, 64)
        assert sorted(i for r in rows for i in r) == list(range(len(sizes)))
        assert sorted(64 - sum(sizes[i] for i in r) for r in rows) == sorted(spaces)


def test_long_runs_of_blanks():
    code = token_output.ByteEncoder(token_output.byte_vocabulary_path())
    for text in ("a" + " " * 5000 + "b", "\n" * 3000, "ab cd " * 60_000):
        assert code.encoding.decode(code.encode(text)[:-1].tolist()) == text


# ---- suffix dedup


@pytest.mark.parametrize("more", [{}, {"gram": 20, "hot": 2}])
def test_repeats(spark, more):
    rnd = random.Random(7)
    base = ["".join(rnd.choice("ab \n") for _ in range(400)) for _ in range(5)]
    rows = [(0, None), (1, ""), (2, "é" * 120), (3, "a" * 400), (4, "a" * 99), (5, base[0]), (5, base[0])]
    for _ in range(120):
        x, a = rnd.choice(base), rnd.randrange(300)
        y, z = x[a : a + rnd.randrange(20, 300)], rnd.choice(base)[rnd.randrange(200) :][: rnd.randrange(200)]
        rows.append((rnd.randrange(6, 200), rnd.choice([y + z, z + y + z, y, x, "é" * rnd.randrange(90) + y])))
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(models.frame(spark, rows), **more)).collect()
    assert sorted(map(tuple, got)) == models.repeats(rows)


def test_repeats_beyond_a_chunk(spark):
    """Texts longer than what is hashed at a time, with repeats across the borders, in several blocks."""
    rng = np.random.default_rng(3)
    long = rng.integers(97, 123, suffix_hash.CHUNK * 2 + 777, dtype=np.uint8).tobytes().decode()
    cut = suffix_hash.CHUNK
    rows = [(1, long), (2, long[cut - 300 : cut + 300]), (3, "x" + long[2 * cut - 60 : 2 * cut + 90] + "y"), (4, long[5:] + long[:200])]
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(models.frame(spark, rows))).collect()
    assert sorted(map(tuple, got)) == models.repeats(rows)


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_repeats_of_strings_that_collide_by_structure(spark):
    """Thue-Morse strings collide modulo 2^64 whatever the base."""
    a = thue_morse(4096)
    b = a.translate(str.maketrans("ab", "ba"))
    data = np.frombuffer((a + b).encode(), np.uint8)
    ends = np.array([0]), np.array([2048])
    there = np.array([4096]), np.array([4096 + 2048])
    assert suffix_hash.PrefixHash(data).of(*ends) == suffix_hash.PrefixHash(data).of(*there)
    assert suffix_hash.PrimeHash(data, 0).of(*ends) != suffix_hash.PrimeHash(data, 0).of(*there)
    rows = [(1, a[:1500]), (2, b[:1500]), (3, a[64:192] + b[64:192]), (4, b[1024:1300])]
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(models.frame(spark, rows))).collect()
    assert sorted(map(tuple, got)) == models.repeats(rows)


def test_clash_means_another_attempt():
    """Runs of one hash but different bytes are noticed within a block, between blocks and in the sort."""
    rng = np.random.default_rng(5)
    a, b = (bytes(rng.integers(97, 123, 900, dtype=np.uint8)) for _ in range(2))
    block = suffix_dedup.Block(common.put_arrays(np.array([1, 2]), np.array([900, 900]), a + a), 100, 32)
    assert not block.clash(100) and (block.later() == (block.doc_id == 2)).all()
    block = suffix_dedup.Block(common.put_arrays(np.array([1, 2]), np.array([900, 900]), a + b), 100, 32)
    block.run_of[:], block.head = 0, block.head[:1]
    assert block.clash(100)

    def verdicts(x, y):
        send = lambda n, code, text: (n, suffix_dedup.BYTES, 3, 0, common.put_arrays(np.array([7], np.uint64), np.array([0]), np.array([5]), np.array([code]), text))
        return [r["kind"] for batch in suffix_dedup._compare(iter([suffix_dedup._batch([send(0, 1, x), send(1, 2, y)])])) for r in batch.to_pylist()]

    assert verdicts(a[:104], a[:104]) == [] and verdicts(a[:104], b[:104]) == [suffix_dedup.CLASH]


@pytest.mark.parametrize("share", [1, 2])
def test_hot_runs_and_windows(spark, monkeypatch, share):
    """One string in very many surroundings, over many blocks and parts."""
    monkeypatch.setattr(suffix_dedup, "SHARE", share)
    rnd = random.Random(12)
    say = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    hot, whole = say(120), say(300)
    rows = [(rnd.randrange(300), say(rnd.randrange(90)) + hot + say(rnd.randrange(60)) + whole * rnd.randrange(2) + (hot if rnd.random() < 0.2 else "")) for _ in range(300)]
    rows = list(dict(rows).items())
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(models.frame(spark, rows, 40), hot=5)).collect()
    assert sorted(map(tuple, got)) == models.repeats(rows)


def test_repeats_keep_spans_and_bytes(docs, rows, empty):
    found = suffix_dedup.remove_repeats(docs)
    texts = collections.defaultdict(set)
    for i, t in rows:
        texts[i].add((t or "").encode())
    for r in found.collect():
        assert r.n_removed == sum(s.end - s.start for s in r.spans) == r.n_bytes - len(r.kept)
        (raw,) = texts[r.doc_id]
        cut = b"".join(raw[a:b] for a, b in zip([0, *(s.end for s in r.spans)], [*(s.start for s in r.spans), len(raw)], strict=True))
        assert cut == bytes(r.kept)
    assert sorted(map(tuple, suffix_dedup.digest(found).collect())) == models.repeats(rows)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_sort_matches_plain_sort():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 600, dtype=np.uint8)
    at = np.sort(rng.choice(560, 200, replace=False))
    groups = np.sort(rng.integers(0, 5, 200))
    order = suffix_hash.suffix_sort(data, suffix_hash.PrefixHash(data), at, groups, 40)
    raw = data.tobytes()
    assert order.tolist() == sorted(range(200), key=lambda i: (groups[i], raw[at[i] : at[i] + 40], i))


# ---- best-fit packing


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(packing.vocabulary_path())
    got = packing.pack_documents(docs, capacity=128, open_bins=4, with_ids=True).collect()
    expect = collections.Counter()
    for i, t in rows:
        ids = np.array([*coder.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        expect.update((i, k, s, len(ids[s : s + 128]), zlib.crc32(ids[s : s + 128].tobytes())) for k, s in enumerate(range(0, len(ids), 128)))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expect
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 128
    assert len(bins) <= 1.05 * -(-sum(r.length for r in got) // 128) + 1
    assert packing.pack_documents(empty).count() == 0


# ---- sharding


def test_minimax_is_smallest():
    rnd = random.Random(5)
    for _ in range(60):
        sizes = [rnd.randrange(1, 50) for _ in range(rnd.randrange(1, 40))]
        n = rnd.randrange(1, 8)
        atoms = [sharding.Atom(i, i, s, s, 1) for i, s in enumerate(sizes)]
        capacity, cuts, inside = sharding.smallest_capacity(atoms, n)
        best = [[0] * (n + 1) for _ in range(len(sizes) + 1)]
        for k in range(1, len(sizes) + 1):
            best[k][0] = 10**9
            for m in range(1, n + 1):
                best[k][m] = min(max(best[j][m - 1], sum(sizes[j:k])) for j in range(k))
        assert capacity == best[-1][n] and not any(inside) and len(cuts) < n


@pytest.mark.parametrize("bits", [14, 2])
def test_sharding(docs, rows, empty, monkeypatch, bits):
    monkeypatch.setattr(sharding, "SUMMARY_BITS", bits)
    monkeypatch.setattr(sharding, "NEIGHBOURS", 1)
    got = sharding.shard_minimax(docs, 5).collect()
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    where = collections.defaultdict(set)
    sizes, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        where[r.group_hash].add(r.shard)
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 5
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = collections.Counter()
    for r in got:
        groups[r.group_hash] += r.size
    atoms = [sharding.Atom(h, h, s, s, 1) for h, s in sorted(groups.items())]
    assert max(sizes.values()) <= sharding.smallest_capacity(atoms, 5)[0]
    assert sharding.shard_minimax(empty, 5).count() == 0


# ---- language-model scoring


def test_lm_scores(spark, rows, empty):
    plain = list({i: (i, t) for i, t in rows}.values())
    got = lm_scoring.score_documents(models.frame(spark, plain)).collect()
    expect = models.language_model(plain)
    assert len(got) == len(plain)
    for r in got:
        held, n, known, total, base, score = expect[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-3)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)
    assert lm_scoring.score_documents(empty).count() == 0


def test_lm_probabilities_sum_to_one():
    """After every context, seen or not, the known tokens and one unknown share all of the mass."""
    rnd = np.random.default_rng(4)
    kinds, lens = 30, np.array([40] * 25)
    vocab = np.append(rnd.integers(1, 2**63, kinds - 1, dtype=np.uint64), lm_scoring._END)
    index = rnd.integers(0, kinds - 3, int(lens.sum())).astype(np.int32)
    index[np.cumsum(lens) - 1] = kinds - 1
    train = lm_scoring.Block(np.arange(25), np.zeros(25, bool), lens, vocab, index)
    uni, bi = (dict(zip(k.tolist(), c.tolist(), strict=True)) for k, c in zip((train.unigrams, train.bigrams), train.counts(), strict=True))
    weights = np.array(lm_scoring.mixture([(0, 50, 30.0, 0.0), (3, 90, 100.0, 250.0), (6, 500, 900.0, 4000.0)]))
    assert np.allclose(weights.sum(axis=1), 1) and weights[0, 2] == 0 and (weights[1:] > 0).all()
    tokens, known = len(index), len(set(index.tolist()))
    for context in range(kinds):  # the last but two never occur
        pair = np.array([[context, w] for w in range(kinds)], np.int32)
        asked = lm_scoring.Block(np.arange(kinds), np.zeros(kinds, bool), np.full(kinds, 2), vocab, pair.ravel())
        b, p0, p1, p2 = lm_scoring.estimates(asked, np.array([uni.get(k, 0) for k in asked.unigrams.tolist()]), np.array([bi.get(k, 0) for k in asked.bigrams.tolist()]), tokens, known)
        w = weights[b]
        each = (w[:, 0] * p0 + w[:, 1] * p1 + w[:, 2] * p2)[1::2]
        unseen = kinds - known  # types outside the training tokens share the unknown token's place
        assert each.sum() - (unseen - 1) * (w[1, 0] * p0[0]) == pytest.approx(1)


def test_lm_texts_of_several_slices(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 3_000)
    rows = list({i: (i, t) for i, t in models.corner_rows(9, 40)}.values())
    expect = models.language_model(rows)
    for r in lm_scoring.score_documents(models.frame(spark, rows)).collect():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == expect[r.doc_id][:4] and r.score == pytest.approx(expect[r.doc_id][5], rel=1e-3)


def test_lm_nulls_and_repeats(spark):
    got = lm_scoring.score_documents(models.frame(spark, [(None, "a b"), (7, None), (7, None), (8, "a")])).collect()
    assert sorted(r.n_tokens for r in got) == [1, 1, 2, 3] and {r.train_tokens for r in got} <= {4, 5, 6, 7}


# ---- URL filters


def test_url_verdicts(spark):
    urls = [None, "no scheme", "http://A.Example.COM/en/7x?q#f", "http://example.com/en/8", "x://a.net/de/1", "x://example.net/de/8", "x://notnet/de/1", "x://a.org/es/", "x://www.spam-farm.example.org/fr/", "http://h.com", "http://h.com?x/en/", "x://u.org/fr\n/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.filter_urls(df).collect()}
    assert got[0] == got[1] == ("", "", None, "allow")
    assert got[2] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert got[3][2:] == ("com/en/", "block") and got[4][2:] == ("net/de/", "allow") and got[5][2:] == ("example.net/de/8", "block")
    assert got[6][2:] == (None, "allow") and got[7][2:] == ("org/es/", "block") and got[8][2:] == (None, "block")
    assert got[9][:2] == ("h.com", "") and got[10][:2] == ("h.com", "") and got[11][1] == "/fr\n/"
    assert url_filters.filter_urls(df.limit(0)).count() == 0


@pytest.mark.parametrize(("share", "most", "once"), [(0, 1 << 25, 1 << 27), (2, 1 << 25, 1 << 27), (7, 1 << 25, 1 << 27), (2, 512, 1 << 27), (2, 512, 2048)])
def test_cascades_are_exact(spark, monkeypatch, share, most, once):
    """Of one part and of several, in one projection and in passes, with several levels."""
    monkeypatch.setattr(url_filters, "MAX_BITS", most)
    monkeypatch.setattr(url_filters, "PASS_BITS", once)
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key")).unionByName(spark.createDataFrame([(None,), ("k1",)], "key string"))
    listed = F.expr(f"pmod(xxhash64(key), 10) < {share}")
    cascades = url_filters.build_cascades(universe, universe.where(listed).unionByName(spark.createDataFrame([("absent",)], "key string")), bits_per_key=2)
    found = url_filters.with_listed(universe, "key", cascades)
    assert found.where("listed").count() == universe.where("key is not null").where(listed).count()
    assert found.where("key is not null").where(F.col("listed") != listed).count() == 0
    assert all(max(c.bits, default=0) <= most for c in cascades) and (len(cascades) > 1) == (most == 512)
    assert not share or max(len(c.bits) for c in cascades) > 1


def test_lists_are_tables(spark):
    df = spark.createDataFrame([(1, "x://bad.fr/"), (2, "x://good.fr/"), (3, "x://bad.fr/" + "p" * 50_000)], "page_id long, url string")
    got = url_filters.filter_urls(df, spark.createDataFrame([("bad.fr",), ("bad.fr",), (None,)], "key string")).collect()
    assert {r.page_id: r.verdict for r in got} == {1: "block", 2: "allow", 3: "block"}


# ---- decontamination


@pytest.mark.parametrize("words", [400_000, 10])
def test_decontamination(spark, rows, words, monkeypatch):
    monkeypatch.setattr(decontaminate, "PASS_WORDS", words)
    text = dict(rows)
    items = [(1, text[20]), (2, "Gamma! the,of"), (2, "Gamma! the,of"), (3, None), (4, " .. "), (None, text[21]), (5, "one"), (6, text[902][:3000]), (7, "the of")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("_hits", F.lit(1))
    plain = list({i: (i, t) for i, t in rows}.values())
    docs = models.frame(spark, plain)
    expect = models.leaks(plain, items)
    got = decontaminate.contamination(docs, bench).collect()
    assert len(got) == len(plain)
    for r in got:
        n, hit, found = expect[r.doc_id]
        assert (r.n_words, r.n_hit, list(r.items), r.contaminated) == (n, hit, found, hit > 0 and 20 * hit >= n)
    row = decontaminate.digest(decontaminate.contamination(docs, bench)).where("doc_id = 902").first()
    assert row.items_sha256 == hashlib.sha256(",".join(expect[902][2]).encode()).hexdigest()
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {d for d, (n, h, _) in expect.items() if not (h and 20 * h >= n)}
    assert decontaminate.contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


# ---- quality rules


def test_quality_ledger(docs, rows, empty):
    got = quality.apply_policy(quality.ledger(docs)).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == collections.Counter((i, *models.quality(t)) for i, t in rows)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)
    kept = quality.keep_documents(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.kept)
    assert quality.ledger(empty).count() == 0 and quality.keep_documents(empty).count() == 0


def test_quality_random_windows(spark):
    rnd = random.Random(8)
    rows = [(i, "".join(rnd.choice(["a", "b", " ", "  ", "\n", "#", "é "]) for _ in range(rnd.randrange(200)))) for i in range(300)]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.ledger(models.frame(spark, rows)).collect()}
    assert got == {i: models.quality(t) for i, t in rows}


def test_ablation_and_policies(docs):
    ledger = quality.ledger(docs).cache()
    rows = {r.rule: r for r in quality.ablation(ledger).collect()}
    bits = [r.rule_bits for r in ledger.collect()]
    assert set(rows) == {r.name for r in quality.RULES}
    for rule in quality.RULES:
        one = 1 << rule.bit
        assert rows[rule.name].n_failed == sum(b & one > 0 for b in bits) and rows[rule.name].n_only == sum(b == one for b in bits)
        assert rows[rule.name].kept_without == sum(b & ~one == 0 for b in bits)
    loose = quality.apply_policy(ledger, quality.POLICIES[1]).where("kept").count()
    assert loose >= quality.apply_policy(ledger).where("kept").count()


# ---- personal data


def personal_rows():
    rnd = random.Random(9)
    bits = ["a.b@c.de", "x@y", "_d@e.f", "a@b.c_d@e.f", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "007.0.0.255", "4111 1111 1111 1111", "4111111111111112", "+1 (017) 555-7713", "+12", "+1 (826) 555-4081 190.", "é", " ", "-", "12", "call (555) 123-4567 now", "joe[at]site[dot]com", "http://h/1.2.3.4"]
    return [(0, None), (1, ""), (2, "1" * 30_000), (3, "a" * 30_000), (4, "x@y.z " * 500)] + [(i, "".join(rnd.choice(bits) + rnd.choice(["", " ", "\n"]) for _ in range(rnd.randrange(1, 12)))) for i in range(10, 250)]


def test_pii(spark, empty):
    rows = personal_rows()
    found = pii.find_pii(models.frame(spark, rows))
    got = {r.doc_id: r for r in pii.digest(found).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        base = models.personal(t)
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        n = collections.Counter(k for k, _, _ in base)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest(), t
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(n[k] for k in pii.KINDS)
        assert set(filter(None, text.split(","))) <= set(got[i].spans.split(","))
    assert pii.find_pii(empty).count() == 0


def test_all_spans_against_a_model(spark):
    """Candidates, votes, EM and classifier against a plain model; of each kind loose spans are taken and refused."""
    rows = dict(personal_rows())
    say = "lorem ipsum dolor".split()
    rnd = random.Random(10)
    good = {
        "email": ["joe[at]site[dot]com", "ann.b (at) mail.org", "kim at host dot net"],
        "ip": ["10[.]2[.]3[.]4", "81 . 2 . 69 . 160", "93(dot)184(dot)216(dot)34"],
        "card": ["4111.1111.1111.1111", "5500_0000_0000_0004", "4012/8888/8888/1881"],
        "phone": ["(555) 223-4567", "0044 20 7946 0958", "212-555-0187"],
    }
    bad = {
        "email": ["look at a dot 9", "meet at b dot 77"],
        "ip": ["300[.]400[.]1[.]1", "999 . 2 . 3 . 4"],
        "card": ["4111.1111.1111.1112", "9999 1111 2222 3333"],
        "phone": ["000-111-2222", "111-011-3333"],
    }
    planted: dict[int, list] = {}
    for i in range(1000, 1400):
        kind = rnd.choice(pii.KINDS)
        true = rnd.random() < 0.5
        head = " ".join(rnd.choice(say) for _ in range(rnd.randrange(1, 6))) + (" order " if not true else " ")
        span = rnd.choice((good if true else bad)[kind])
        rows[i] = head + span + " " + rnd.choice(say)
        planted[i] = [kind, len(head), len(head) + len(span), true]
    rows = list(rows.items())
    got = {r.doc_id: {(pii.KINDS[x.kind], x.start, x.end) for x in r.spans} for r in pii.find_pii(models.frame(spark, rows)).collect()}
    assert got == models.personal_spans(rows, pii)
    for i, (kind, a, b, true) in planted.items():
        assert ((kind, a, b) in got[i]) == true, dict(rows)[i]


def test_redaction(spark):
    rows = [(0, None), (1, "mail a.b@c.de or +1 (017) 555-7713."), (2, "nothing é"), (3, "1.2.3.4@x.yz")]
    docs = models.frame(spark, rows)
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    assert {r.doc_id: r.text for r in clean.collect()} == {0: None, 1: "mail <email> or <phone>.", 2: "nothing é", 3: "<email>"}


def test_em_learns_reliability():
    """A labeler that agrees with confirmed spans ends up more reliable than one that contradicts them."""
    counts = [(3, 1, 1, -1, 2, True, 900), (3, 1, 0, -1, 2, True, 100), (3, -1, 1, -1, 2, False, 50), (3, -1, 0, -1, 2, False, 50)]
    model = pii.fit(counts)
    assert model.reliability[3, "known"] > 0.8 and model.odds[3, "known", 1] > model.odds[3, "known", 0]
