"""Hard negatives, centroid clustering and SentencePiece against brute force, on random and awkward rows."""

import hashlib
import math

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from reelspan.llm import centroids, hard_negatives, jaccard_join, pieces
from reelspan.llm.common import workspace
from reelspan.llm.integer_vectors import countable, integers

VECTORS = "vec_id long, embedding array<float>, label int, score int, rank int, v int"


def awkward_vectors(spark, size=64):
    """Ties, copies, repeated rows and ids, nulls, non-finite and huge components, other lengths, clashing columns."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 0.2, size).round(1).tolist(), int(rng.integers(0, 4))) for i in range(90)]
    rows += [(100 + i, rows[3][1], 1) for i in range(60)]  # one vector, many times
    rows += [rows[3], rows[4], (4, rows[7][1], 2), (4, rows[4][1], 2)]
    bad = [None, [], [0.5] * (size - 1), [math.nan] + [0.0] * (size - 1), [math.inf] + [0.0] * (size - 1), [None] + [0.0] * (size - 1), [3e9] + [0.0] * (size - 1)]
    rows += [(200 + i, v, 1) for i, v in enumerate(bad)]
    rows += [(300, rows[0][1], None), (None, rows[0][1], 1), (400, [0.0] * size, 1), (None, None, None), (500, [-x for x in rows[3][1]], 0)]
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], VECTORS)


def whole(v, size=None):
    return v is not None and (size is None or len(v) == size) and all(x is not None and math.isfinite(x) and abs(x) * 256 < 1 << 27 for x in v)


def brute_negatives(rows, every=100):
    rows = [(i, (c + 1) % 10 if i % 7 == 0 else c, [math.floor(256 * x) for x in v]) for i, v, c in rows if i is not None and c is not None and whole(v)]
    out = []
    for i, c, v in sorted({(i, c, tuple(v)) for i, c, v in rows if i % every == 0}):
        score = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, d) for j, d, w in rows if len(w) == len(v)]
        for p, j, _ in sorted(s for s in score if s[2] == c and s[1] != i)[:5]:
            band = sorted(s for s in score if s[2] != c and -30 * p <= -100 * s[0] <= -90 * p)[:10]
            out += [(i, j, r + 1, k, -p, -n) for r, (n, k, _) in enumerate(band)]
    return sorted(out)


@pytest.mark.parametrize("every", [4, 100])
def test_hard_negatives_match_brute_force(spark, every):
    df = awkward_vectors(spark)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    known = df.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & countable(F.col("embedding")))
    rows = known.select("vec_id", label.alias("label"), integers(F.col("embedding")).alias("v"))
    found = hard_negatives.hard_negatives(rows, F.col("vec_id") % every == 0, workspace(spark, "t"))
    assert sorted(map(tuple, found.collect())) == brute_negatives([(r.vec_id, r.embedding, r.label) for r in df.collect()], every)


def test_hard_negatives_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 16)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 5)
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(0, 3)), rng.integers(-40, 40, 12).tolist()) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, label int, v array<int>")
    found = hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, workspace(spark, "t"))
    expected = []
    for i, c, v in rows[::10]:
        score = [(-int(np.dot(v, w)), j, d) for j, d, w in rows]
        for p, j, _ in sorted(s for s in score if s[2] == c and s[1] != i)[:5]:
            band = sorted(s for s in score if s[2] != c and -30 * p <= -100 * s[0] <= -90 * p)[:10]
            expected += [(i, j, r + 1, k, -p, -n) for r, (n, k, _) in enumerate(band)]
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    assert hard_negatives.hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0, workspace(spark, "t")).count() == 0


def test_norm_index_loses_nothing_and_prunes():
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(400, 20)) * np.linspace(0.1, 5, 20) * rng.choice([0.1, 1, 3], (400, 1)) * 100).round()
    x[37] = 0
    q = x[:30]
    scores = q @ x.T
    for share in (0.9, 0.5, 0.1):
        least = np.quantile(scores, share, axis=1)
        index = hard_negatives.NormIndex(x, (least / np.maximum(np.sqrt((q * q).sum(1)), 1)).min())
        i, j, added = index.reaching(q, least)
        assert {*zip(*np.nonzero(scores >= least[:, None]), strict=True)} <= {*zip(i, j, strict=True)}
        if share == 0.9:
            assert index.first.max() > 0 and added < 0.8 * 30 * x.size and len(i) < 0.5 * scores.size


def brute_clusters(rows, k, rounds):
    rows = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and whole(v, 64)]
    centres = [v for _, _, v in sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v, v) for i, v in rows)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in rows:
            groups.setdefault(nearest(v)[1], []).append(v)
        centres = [[sum(x) // len(x) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(centres)]
    return sorted((i, nearest(v)[1], nearest(v)[0]) for i, v in rows), centres


@pytest.mark.parametrize("k", [3, 40, 500])
def test_clusters_match_brute_force(spark, k):
    df = awkward_vectors(spark)
    start = F.sha2(F.concat(F.lit("2:"), F.col("vec_id").cast("string")), 256)
    found, centres = centroids.cluster_vectors(df, start, workspace(spark, "t"), k, 2)
    expected = brute_clusters([(r.vec_id, r.embedding) for r in df.collect()], k, 2)
    assert (sorted(map(tuple, found.collect())), centres) == expected
    assert centroids.cluster_vectors(df.limit(0), start, workspace(spark, "t"), k, 2)[0].count() == 0


def test_tree_equals_a_scan_and_prunes():
    rng = np.random.default_rng(3)
    middles = rng.integers(-4000, 4000, (8, 6))
    centres = np.repeat(middles, 6, 0) + rng.integers(-9, 9, (48, 6))
    centres[10] = centres[30]  # a tie for every vector
    x = np.concatenate([middles[rng.integers(0, 8, 500)] + rng.integers(-50, 50, (500, 6)), (centres[:20] + centres[1:21]) // 2, centres])
    for leaf in (1, 3, 100):
        cluster, distance, taken = centroids.VantageTree(centres, leaf).nearest(x)
        among = centroids.squared(x, centres)
        assert (cluster == among.argmin(1)).all() and (distance == among.min(1)).all()
        assert leaf == 100 or taken < 0.6 * among.size


TEXTS = [None, "", " ", "  ", "a", " a", "a ", "a  b   c ", "▁", "a▁b ▁▁ c", "\n\n", "x\ny z\n", "\t", "a\x00b", "ＡＢ ﬁ é 𝄞 中文字", "<s> </s> <unk> <0x41>", "�", "word " * 3000, "q" * 20_000, "the same the same"]


def test_pieces_equal_the_library(spark, sf):
    model = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    assert pieces.words_of(model).apart
    rng = np.random.default_rng(4)
    letters = list("ab cd▁\n\té中 .,  ") + ["the", "  ", " ▁", "ing", "𝄞"]
    texts = TEXTS + ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(800)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(3, "again", 1), (None, "no id", 1)]
    own = spark.createDataFrame(rows, "doc_id long, text string, words int")
    for docs, block in ((own, 1 << 20), (own.repartition(7), 20_000), (spark.read.parquet(f"{sf}/documents.parquet"), 1 << 16)):
        out = pieces.encode(docs, workspace(spark, "t"), model, block=block, part=block)
        found = out.select("doc_id", "piece_ids", pieces.decode(F.col("piece_ids"), model).alias("text")).collect()
        expected = [(r.doc_id, ids := sp.encode(r.text or "", add_bos=True, add_eos=True), sp.decode(ids)) for r in docs.select("doc_id", "text").collect()]
        assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    assert pieces.encode(own.limit(0), workspace(spark, "t"), model).count() == 0


def test_pieces_across_markers_take_whole_texts(spark):
    model = public_tokenizers.path("piece_bpe_32k.model")
    words, book = pieces.Words(pieces.processor(model)), pieces.Numbered()
    words.apart = False
    assert list(words.code("a b", book)) == [0] and words.segment(list(book)) == [words.sp.encode("a b")]


def test_words_are_cut_between_groups_only():
    assert sorted(map(sorted, pieces.groups(["abc", "xy", "zz", "q", "bd"]))) == [["a", "b", "c", "d"], ["x", "y"], ["z"]]
    words, book = pieces.words_of(public_tokenizers.path("piece_bpe_32k.model")), pieces.Numbered()
    words.code("one  two,three.\nx ", book)
    assert list(book) == ["▁one", "▁▁two", ",", "three", ".", "\n", "x", "▁"]


def test_queries_give_the_contract(spark, sf):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in pieces.op13_sentencepiece(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").collect():
        ids = model.encode(r.text or "", add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()
    rows = centroids.op12_centroid_clustering(spark, sf).collect()
    assert {r.inertia for r in rows} == {sum(r.distance for r in rows)}


@pytest.mark.parametrize("told", [1, jaccard_join.TOLD])
def test_long_texts_just_under_the_threshold(spark, monkeypatch, told):
    """Many shared open names a pair: rows carry a few of them, and components stay those of brute force."""
    monkeypatch.setattr(jaccard_join, "TOLD", told)
    base, texts = [f"w{i}" for i in range(1500)], []
    for n in range(24):
        own = list(base)
        for i in range(62 * n % 1400, 62 * n % 1400 + (110 if n % 5 else 20)):
            own[i] = f"x{n}-{i}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [set(jaccard_join.shingle_set(t.encode(), 4).tolist()) for t in texts]
    label = list(range(24))
    for _ in range(24):
        for a in range(24):
            for b in range(24):
                if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    found = jaccard_join.jaccard_components(docs, workspace(spark, "t")).collect()
    assert {r.doc_id: r.component_id for r in found} == dict(enumerate(label)) and 1 < len(set(label)) < 24
