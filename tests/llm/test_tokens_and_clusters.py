"""Vocabularies, alignment, packing and clustering against brute force."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sessionlake.llm import alignment, clustering, packing, queries, vocabularies
from sessionlake.llm.textarrays import chunks

WORDS, BYTES, PIECES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = ["a", "B", "é", "É", "ß", " ", "  ", "\n", "\t", "'s", "'", "'T", "|", "<|endoftext|>", "<|", "1", "23", ".", "$$", "__", "́", "̈", " ", " ", "\u0085", "\x1c", "\x00", "▁", "中文", "ﬁ", "İ", "Σ", "ς", "😀", "　", "-", "don't", "the", "The", "tion", "ö", "×", "µ", "\r\n", "٣", "½", "﻿", "~", "`"]


def odd_texts(n: int, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def whole():
    """Whole-text encoders of the files: word ends, bytes (specials are text), sentence pieces."""
    import sentencepiece
    from tokenizers import Tokenizer

    words, by_bytes, pieces = Tokenizer.from_file(WORDS), Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    by_bytes.encode_special_tokens = True
    return lambda t: words.encode(t, add_special_tokens=False).ids, lambda t: by_bytes.encode(t, add_special_tokens=False).ids, pieces.encode


def by_pieces(encode, cut, texts: list[str], normal=lambda x: x) -> list[list[int]]:
    (chunk,) = chunks(pa.array(texts), 1 << 40)
    places = cut(chunk.data, chunk.starts)
    index, found = vocabularies.distinct(normal(vocabularies.pieces_at(chunk.data, places)))
    ids, sizes = encode(found)
    own = vocabularies.ragged(ids, (np.cumsum(sizes) - sizes)[index], sizes[index])
    ends = np.concatenate([[0], np.cumsum(sizes[index])])[np.searchsorted(places, chunk.starts)]
    return [own[a:b].tolist() for a, b in itertools.pairwise(ends)]


def test_ids_by_pieces_are_those_of_whole_texts(whole):
    texts = odd_texts(4000) + ["the quick brown Fox's " * 40]
    assert by_pieces(vocabularies.word_end_bpe(WORDS), vocabularies.cut_at_words, texts, vocabularies.plain_words) == [whole[0](t) for t in texts]
    spaced = [f" {t}" for t in texts]
    assert by_pieces(vocabularies.byte_level_bpe(BYTES), vocabularies.cut_at_spaces, spaced) == [whole[1](t) for t in spaced]
    known = [t for t in texts if t and "▁" not in t]  # U+2581 reads as a space, so such texts never match
    assert by_pieces(vocabularies.sentence_pieces(PIECES), vocabularies.cut_at_spaces, [f" {t}" for t in known]) == [whole[2](t) for t in known]


def test_every_token_of_the_files_is_what_its_merges_give():
    from tokenizers import Tokenizer

    for path, end in ((WORDS, "</w>"), (BYTES, "")):
        found = Tokenizer.from_file(path)
        for token, i in list(found.get_vocab().items())[::7]:
            if token.endswith(end) and not token.startswith("<|"):
                assert [t.id for t in found.model.tokenize(token.removesuffix(end))] == [i]


# -- alignment ---------------------------------------------------------------


def brute_alignment(texts: list[str | None], whole) -> list[tuple]:
    a_bytes, b_bytes = vocabularies.byte_level_bytes(BYTES), vocabularies.sentence_piece_bytes(PIECES)
    docs, counts = [], collections.Counter()
    for t in texts:
        a, b = (whole[1](f" {t}"), whole[2](t)) if t else ([], [])
        want = f" {t}".encode()
        if b"".join(a_bytes[i] for i in a) != want or b"".join(b_bytes[i] for i in b) != want:
            a, b = [], []

        def spans(ids, table):
            ends = list(itertools.accumulate(len(table[i]) for i in ids))
            return [*zip([0, *ends], ends)]

        sa, sb = spans(a, a_bytes), spans(b, b_bytes)
        links = [(a[i], b[j]) for i, x in enumerate(sa) for j, y in enumerate(sb) if x[0] < y[1] and y[0] < x[1]]
        cuts = sorted({x[1] for x in sa} & {y[1] for y in sb})
        groups = [(",".join(str(i) for i, s in zip(a, sa) if lo < s[1] <= hi), ",".join(str(i) for i, s in zip(b, sb) if lo < s[1] <= hi)) for lo, hi in zip([0, *cuts], cuts)]
        docs.append((len(a), len(b), len(groups), links, ";".join(f"{x}|{y}" for x, y in groups)))
        counts.update(set(links))
    best = collections.Counter()
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return [(na, nb, ng, len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "") for na, nb, ng, links, g in docs]


def test_merge_is_the_same_for_every_piece_size():
    rng = np.random.default_rng(3)
    for _ in range(60):
        last = int(rng.integers(1, 60))
        a, b = (np.unique(np.append(rng.integers(1, last + 1, rng.integers(0, 30)), last)) for _ in range(2))
        union = np.unique(np.concatenate([a, b]))
        want = [np.searchsorted(a, union).tolist(), np.searchsorted(b, union).tolist(), (np.flatnonzero(np.isin(a, b)) + 1).tolist(), (np.flatnonzero(np.isin(b, a)) + 1).tolist()]
        for piece in (1, 2, 3, 7, 128):
            assert [x.tolist() for x in alignment.merge(a, b, piece)] == want
    assert [len(x) for x in alignment.merge(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0] * 4


def test_alignment_is_brute_force(spark, whole):
    texts = odd_texts(300, 5) + [None, "", "the same text", "the same text", "a▁b", "Ein längerer Satz, 1234 Wörter und <|endoftext|>.\n\nNeu"]
    docs = spark.createDataFrame([(i if i % 50 else None, t, "x", 5) for i, t in enumerate(texts)], "doc_id bigint, text string, pair string, n_a int")
    got = alignment.alignment_counts(docs.repartition(5), BYTES, PIECES).collect()
    want = brute_alignment(texts, whole)
    assert collections.Counter(tuple(r) for r in got) == collections.Counter((i if i % 50 else None, *w) for i, w in enumerate(want))
    shown = {r.doc_id: r.groups for r in alignment.align(docs, BYTES, PIECES).collect() if r.doc_id}
    assert all(hashlib.sha256(shown[i].encode()).hexdigest() == want[i][-1] or not want[i][-1] and not shown[i] for i in shown)
    assert alignment.alignment_counts(docs.limit(0), BYTES, PIECES).count() == 0


# -- packing -----------------------------------------------------------------


def test_fullest_combination_is_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        room = rng.randint(1, 40)
        counts = np.zeros(61, np.int64)
        for _ in range(rng.randint(0, 5)):
            counts[rng.randint(1, 60)] = rng.randint(1, 4)
        lengths = [int(n) for n in np.flatnonzero(counts)]
        sums = {sum(n * k for n, k in zip(lengths, ks)) for ks in itertools.product(*[range(int(counts[n]) + 1) for n in lengths])}
        found = packing.fullest(counts, room)
        assert sum(n * k for n, k in found) == max(s for s in sums if s <= room) and all(k <= counts[n] for n, k in found)


def check_packing(rows, documents: dict, capacity: int):
    """Every piece of every document once, with its ids, and no overlap or gap in a sequence."""
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == collections.Counter(
        (i, p, p * capacity, len(part), zlib.crc32(np.array(part, "<u4").tobytes())) for i, ids in documents for p, part in enumerate(ids[k : k + capacity] for k in range(0, len(ids), capacity))
    )
    sequences = collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(parts)) and sum(parts[-1]) <= capacity
    return len(sequences)


def test_packing_of_documents(spark, whole):
    texts = odd_texts(300, 9) + [None, "", "word " * 5000, "alike"] + ["alike"] * 200
    docs = spark.createDataFrame([(i if i % 60 else None, t, 1, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, part int, number string")
    wanted = [(i if i % 60 else None, [*whole[0](t or ""), 0]) for i, t in enumerate(texts)]
    for capacity in (2048, 64):
        rows = packing.pack(docs.repartition(6), WORDS, capacity).collect()
        least = -(-sum(len(w) for _, w in wanted) // capacity)
        assert least <= check_packing(rows, wanted, capacity) <= least + 1
    joined = packing.sequences(docs, WORDS, 64).collect()
    assert sum(r.length for r in joined) == sum(len(w) for _, w in wanted) and all(len(r.ids) == 4 * r.length for r in joined)
    assert sorted(i for r in joined for i in np.frombuffer(r.ids, "<u4").tolist()) == sorted(i for _, w in wanted for i in w)
    assert packing.pack(docs.limit(0), WORDS).count() == 0


def test_plans_fill_bins_and_their_steps_do_not_grow_with_the_corpus():
    rng = np.random.default_rng(4)
    for n in (1_000, 1_000_000):
        lengths = np.minimum(2048, rng.lognormal(6, 1, n).astype(int) + 1)
        lengths[: n // 3] = 700
        values, counts = np.unique(lengths, return_counts=True)
        found = packing.plan(dict(zip(values.tolist(), counts.tolist())))
        assert found.n_bins <= -(-int(lengths.sum()) // 2048) * 1.02 + 1 and len(found.length) < 40_000


# -- clustering --------------------------------------------------------------


def brute_clusters(rows: list[tuple], k: int, rounds: int):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    centroids = [v for _, _, v in sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v, v) for i, v in kept if i is not None)[:k]]

    def nearest():
        return [min((sum((x - y) ** 2 for x, y in zip(v, m)), c) for c, m in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        found = nearest()
        for c in range(len(centroids)):
            own = [v for (_, v), (_, of) in zip(kept, found) if of == c]
            if own:
                centroids[c] = [sum(x) // len(own) for x in zip(*own)]
    return [(i, c, d) for (i, _), (d, c) in zip(kept, nearest())], centroids


def vectors(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, [m + rng.gauss(0, 0.4) for m in rng.choice(middles)]) for i in range(n)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)] + [(None, rows[4][1]), (None, rows[4][1]), rows[5], rows[5]]  # copies, no ids, repeats
    return rows + [(2000, None), (2001, [1.0] * 63), (2002, [1.0] * 63 + [None]), (2003, [float("nan")] * 64), (2004, [float("inf")] * 64), (2005, [])]


SCHEMA = "vec_id bigint, embedding array<float>, cluster string, v int"


def run_clusters(spark, rows, k, rounds):
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA).repartition(5)
    return clustering.cluster(clustering.whole_vectors(table), k, rounds)


@pytest.mark.parametrize("n,k,rounds", [(300, 16, 3), (200, 7, 6), (9, 16, 2), (120, 1, 2)])
def test_clusters_are_brute_force(spark, n, k, rounds):
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in vectors(n, n)]
    found = run_clusters(spark, rows, k, rounds)
    want, centroids = brute_clusters(rows, k, rounds)
    assert found.centroids.tolist() == centroids
    assert collections.Counter((r.vec_id, r.cluster, r.distance) for r in found.rows.collect()) == collections.Counter(want)
    table = clustering.with_inertia(found).collect()
    by = collections.Counter()
    for _, c, d in want:
        by[c] += d
    assert all((r.cluster_inertia, r.inertia, r.centroid_sha256) == (by[r.cluster], sum(by.values()), hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()) for r in table)


def test_ties_go_to_the_smaller_number_and_equal_vectors_share_a_cluster(spark):
    rows = [(i, [float(i % 3)] * 64) for i in range(60)]
    want, centroids = brute_clusters(rows, 16, 3)
    found = run_clusters(spark, rows, 16, 3)
    assert found.centroids.tolist() == centroids and sorted((r.vec_id, r.cluster, r.distance) for r in found.rows.collect()) == sorted(want)


def test_settled_vectors_are_not_measured_again(spark):
    rng = random.Random(8)
    rows = [(i, [float(20 * (i % 4) + rng.gauss(0, 0.2))] * 64) for i in range(400)]
    vecs = clustering.written(clustering.whole_vectors(spark.createDataFrame([(i, v, "", 0) for i, v in rows], SCHEMA)))
    centroids, drift = np.array([[1280 * c] * 64 for c in range(4)]), np.zeros(4)
    heap = clustering._heap(clustering._measured(vecs.withColumn("before", F.lit(-1)), centroids, drift, "bigint"), 0)
    later = clustering._heap(clustering._measured(heap.rows.limit(0), centroids, drift, "bigint"), 1)
    assert clustering.popped([heap, later], drift, drift + 100).count() == 0
    shown = clustering.popped([heap, later], drift, drift + 100)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(due," in shown and "GreaterThan(due," in shown.split("PushedFilters")[1]
    assert clustering.popped([heap, later], drift, drift + 1e9).count() == 400


def test_clusters_of_nothing(spark):
    assert run_clusters(spark, [], 16, 3).rows.count() == 0
    assert clustering.with_inertia(run_clusters(spark, [(1, None)], 16, 3)).count() == 0


def test_queries_run_over_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    for name, table, key in (("op12_alignment", "documents", "doc_id"), ("op13_packing", "documents", "doc_id"), ("op11_clustering", "embeddings", "vec_id")):
        found = queries.QUERIES[name](spark, sf).select(key).distinct().count()
        assert found == spark.read.parquet(f"{sf}/{table}.parquet").select(key).distinct().count(), name
