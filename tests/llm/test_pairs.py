"""Decontamination, line dedup, SimHash and mixing against brute force, and on odd inputs."""

from __future__ import annotations

import itertools
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from sessionlake.llm import decontamination, line_dedup, mixing, simhash
from sessionlake.llm.components import connected_components
from sessionlake.llm.textarrays import chunks

ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, h1 string, removed int, row string, key int, seed int, component_id int, fp int"
VOCAB = [a + b for a in ("ka", "lo", "mi", "tu", "re", "so") for b in ("na", "te", "ri", "vo", "du", "pe", "xa")]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def odd(spark, texts, first=0):
    rows = [(first + i, t, "en", None if i % 3 == 0 else f"s{i % 3}", len(t or ""), "x", 1, "y", 2, 3, 4, 5) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, ODD)


def brute_components(n, near):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i, j in near:
            low = min(label[i], label[j])
            changed |= label[i] != low or label[j] != low
            label[i] = label[j] = low
    return label


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


ODD_TEXTS = [None, "", "   \n\t ", "one", "One two", "É à ñ ü", "w " * 700, "same text here now", "same text here now", "x" * 6000, "a\nb\n\nc"]


def test_fingerprints_match_brute_force():
    rng = random.Random(1)
    texts = [*ODD_TEXTS, *(prose(rng, rng.randint(1, 400)) for _ in range(40))]
    got = np.concatenate([simhash.chunk_fingerprints(c) for c in chunks(pa.array(texts), 4000)])
    assert got.tolist() == [brute_fingerprint(t) for t in texts]


def test_simhash_components_match_brute_force(spark):
    rng = random.Random(2)
    base = [prose(rng, 120) for _ in range(25)]
    texts = list(ODD_TEXTS)
    for b in base:
        texts.append(b)
        for _ in range(rng.randint(0, 4)):
            w = b.split()
            w[rng.randrange(len(w))] = rng.choice(VOCAB)
            texts.append(" ".join(w))
    got = {r.doc_id: r for r in simhash.simhash_components(odd(spark, texts)).collect()}
    fp = [brute_fingerprint(t) for t in texts]
    near = [(i, j) for i in range(len(fp)) for j in range(i) if bin(fp[i] ^ fp[j]).count("1") <= 4]
    assert [got[i].component_id for i in range(len(texts))] == brute_components(len(texts), near)
    assert [got[i].fp & (2**64 - 1) for i in range(len(texts))] == fp
    kept = simhash.keep_one_of_each(odd(spark, texts))
    assert kept.columns == odd(spark, texts).columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(set(brute_components(len(texts), near)))


def test_ball_hashing_links_random_fingerprints_at_every_distance():
    rng = random.Random(3)
    fp = [rng.getrandbits(64) for _ in range(60)]
    for i in range(40):
        f = fp[i]
        for b in rng.sample(range(64), i % 7):
            f ^= 1 << b
        fp.append(f)
    fp = list(dict.fromkeys(fp))
    rep = np.arange(len(fp))
    for classes in (6, 9):
        masks, flips = simhash._class_masks(classes), simhash._flips(classes)
        assert sum(map(len, flips.values())) == 1 + 64 + 64 * 63 // 2
        code = [sum((bin(f & m).count("1") & 1) << c for c, m in enumerate(masks)) for f in fp]
        links = []
        for bucket in range(1 << classes):
            rows = [(i, d) for i in range(len(fp)) for d in flips if code[i] ^ d == bucket]
            if rows:
                own = np.array([i for i, _ in rows])
                a, b = simhash._spanning_links(np.array([fp[i] for i in own], np.uint64), rep[own], np.array([d for _, d in rows]), flips)
                links += list(zip(a.tolist(), b.tolist(), strict=True))
        near = [(i, j) for i in range(len(fp)) for j in range(i) if bin(fp[i] ^ fp[j]).count("1") <= 4]
        assert brute_components(len(fp), links) == brute_components(len(fp), near)


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200), (300, 301), (301, 300), (None, 5)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 300: 300, 301: 300}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_decontamination_catches_substitutions_and_leaves_others(spark):
    rng = random.Random(4)
    items = [prose(rng, rng.randint(14, 40)) for _ in range(20)]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(90, items[0]), (91, "too short"), (92, None)], "item_id bigint, text string")
    texts, leak = list(ODD_TEXTS), {}
    for i, item in enumerate(items):
        w = item.split()
        for k in range(i % 3):  # up to two substitutions, apart
            w[3 + 6 * k] = "zzz"
        leak[len(texts)] = i
        texts.append(f"{prose(rng, 50)} {' '.join(w).upper() if i % 2 else ' , '.join(w)}. {prose(rng, 30)}")
    texts += [prose(rng, 300) for _ in range(20)]
    docs = odd(spark, texts)
    got = {r.doc_id: r for r in decontamination.contamination(docs, bench).collect()}
    assert len(got) == len(texts)
    assert {d: r["items"] for d, r in got.items() if r.contaminated} == {d: [i] for d, i in leak.items()}
    kept = decontamination.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(texts) - len(leak)
    none = bench.limit(0)
    assert decontamination.contamination(docs, none).where("contaminated").count() == 0
    assert decontamination.contamination(docs.limit(0), bench).count() == 0


def test_every_single_substitution_is_found(spark):
    rng = random.Random(5)
    item = prose(rng, 16).split()
    texts = [" ".join([*item[:i], "qqq", *item[i + 1 :]]) for i in range(16)]
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")
    assert decontamination.contamination(odd(spark, texts), bench).where("contaminated").count() == 16


def test_masks_meet_every_overlap():
    for width in range(1, decontamination.WINDOW + 1):
        lost = width - -(-width * 11 // 13)
        token, row = np.arange(1, width + 1, dtype=np.uint64), np.zeros(width, np.int64)
        own = [set(zip(s.tolist(), h.tolist(), strict=True)) for s, h in decontamination.seed_hashes(token, row, width)]
        for gone in itertools.combinations(range(width), lost):
            other = token.copy()
            other[list(gone)] += np.uint64(1000)
            assert any(a & set(zip(s.tolist(), h.tolist(), strict=True)) for a, (s, h) in zip(own, decontamination.seed_hashes(other, row, width), strict=True)), (width, gone)


def test_dense_substitutions_and_short_items_are_found(spark):
    rng = random.Random(12)
    long = [f"w{i}" for i in range(30)]
    short = [[f"s{n}x{i}" for i in range(n)] for n in range(1, 13)]
    han = "春眠不觉晓处处闻啼鸟夜来风雨声花落知多少"
    bench = [(0, " ".join(long)), (50, han), (51, "ราตรีสวัสดิ์")] + [(len(w), " ".join(w)) for w in short]
    texts, want = [], {}
    for phase in range(5):  # every fifth token replaced
        want[len(texts)] = [0]
        texts.append(f"{prose(rng, 20)} {' '.join('zz' if i % 5 == phase else w for i, w in enumerate(long))} {prose(rng, 9)}")
    for w in short:
        for gone in [None, *range(len(w))]:
            found = gone is None or len(w) >= 7
            want[len(texts)] = [len(w)] if found else []
            texts.append(f"{prose(rng, 20)} {' '.join('zz' if i == gone else x for i, x in enumerate(w))} {prose(rng, 9)}")
    for text, items in ((f"他说{han[:5]}，{han[5:10]}。{han[10:15]}、{han[15:]}好", [50]), (f"x{han[2:7]}人{han[8:13]}山{han[14:16]}", [50]), (han[:9], []), ("คืนนี้ราตรีสวัสดิ์นะ", [51])):
        want[len(texts)] = items
        texts.append(text)
    got = decontamination.contamination(odd(spark, texts), spark.createDataFrame(bench, "item_id bigint, text string")).collect()
    assert {r.doc_id: r["items"] for r in got} == want


def brute_overlaps(texts, items):
    """{doc: items}: some 13 aligned tokens with 11 equal ones, by trying every diagonal."""
    out = {}
    split = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    for d, text in enumerate(texts):
        a, found = split(text), []
        for k, item in items:
            b = split(item)
            width = min(len(b), 13)
            best = -1
            for shift in range(-len(b), len(a) + 1):
                eq = [x == a[i + shift] for i, x in enumerate(b) if 0 <= i + shift < len(a)]
                best = max([best] + [sum(eq[i : i + width]) for i in range(len(eq) - width + 1)])
            if width and best >= -(-width * 11 // 13):
                found.append(k)
        out[d] = found
    return out


def test_decontamination_matches_all_pairs_on_texts_of_few_words(spark):
    rng = random.Random(31)
    few = ["ka", "lo", "mi"]
    texts = [None, "", *(" ".join(rng.choice(few) for _ in range(rng.randint(1, 60))) for _ in range(220))]
    texts += [prose(rng, rng.randint(1, 80)) for _ in range(60)]
    items = [(i, " ".join(rng.choice(few) for _ in range(n))) for i, n in enumerate((9, 11, 12, 13, 13, 14, 15, 18, 20, 25))]
    items += [(100 + i, prose(rng, n)) for i, n in enumerate((13, 17, 30))]
    items += [(110 + i, " ".join(texts[230 + i].split()[:20] + ["qq"] + texts[231 + i].split()[:20])) for i in range(6)]
    got = decontamination.contamination(odd(spark, texts), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {r.doc_id: sorted(r["items"]) for r in got} == brute_overlaps(texts, items)


def test_a_passage_of_many_items_and_documents_is_compared_once(spark):
    rng = random.Random(32)
    passage = prose(rng, 40)
    broken = " ".join("zz" if i % 6 == 5 else w for i, w in enumerate(passage.split()))
    took = {}
    for n in (20, 100, 300):
        items = spark.createDataFrame([(i, f"{prose(rng, 12)} {passage} {prose(rng, 12)}") for i in range(n)], "item_id bigint, text string")
        docs = odd(spark, [f"{prose(rng, 20)} {broken if i % 50 == 7 else passage} {prose(rng, 20)}" for i in range(n)])
        began = time.perf_counter()
        exact, near, members, _ = decontamination.verified_hits(docs, items)
        assert exact.select("doc_id").union(near.select("doc_id")).distinct().count() == n
        took[n] = time.perf_counter() - began
        if n == 100:
            assert decontamination.overlaps(docs, items).where("not common").count() == n * n
    assert took[300] < 4 * took[100] + 2


def test_common_short_items_are_reported_apart(spark):
    texts = ["the answer is yes", "yes", *["yes and no"] * 25, "a rare zebra here", "nothing"]
    bench = spark.createDataFrame([(1, "yes"), (2, "rare zebra")], "item_id bigint, text string")
    got = decontamination.contamination(odd(spark, texts), bench).orderBy("doc_id").collect()
    assert [r.doc_id for r in got if r.contaminated] == [27] and got[27]["items"] == [2]
    assert [r.doc_id for r in got if r.common_items == [1]] == list(range(27))
    assert decontamination.decontaminate(odd(spark, texts), bench).count() == len(texts) - 1


def levenshtein(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def norm(line):
    line = re.sub(r"[\x09\x0B-\x0D]+|\x20{2,}", " ", line).lower()
    return re.sub("[1-9]", "0", line).strip(" ")


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        p, o = rng.randrange(len(s) + 1), rng.random()
        if p == len(s) or o >= 0.7:
            s.insert(p, rng.choice("abcé"))
        elif o < 0.4:
            s[p] = rng.choice("abcé")
        else:
            del s[p]
    return "".join(s)


def test_line_dedup_matches_brute_force(spark):
    rng = random.Random(6)
    base = [prose(rng, rng.randint(5, 12)) for _ in range(40)]
    docs_lines = []
    for _ in range(50):
        docs_lines.append([edited(rng, rng.choice(base), rng.randint(0, 4)) if rng.random() < 0.6 else prose(rng, 8) for _ in range(rng.randint(1, 6))])
    docs_lines[3] = ["short", "short", ""]
    texts = ["\n".join(x) for x in docs_lines] + [None, "", base[0] + "  \n" + base[0].upper(), "Page 1 of the very long report\nPage 27 of the very long report"]
    first, seen, want = {}, [], {}
    for d, t in enumerate(texts):
        gone, links = [], 0
        for i, line in enumerate((t or "").split("\n") if t is not None else []):
            n = norm(line)
            if len(n) < line_dedup.LEAST_CHARS:
                continue
            if n in first:
                gone.append(i)
            else:
                first[n] = (d, i)
                if any(abs(len(n) - len(m)) <= 2 and levenshtein(n, m) <= 2 for m in seen):
                    gone.append(i)
                seen.append(n)
        want[d] = gone
    docs = odd(spark, texts)
    got = {r.doc_id: r for r in line_dedup.repeated_lines(docs).collect()}
    assert {d: r.removed for d, r in got.items()} == want
    pairs = sum(1 for i, n in enumerate(seen) for m in seen[:i] if abs(len(n) - len(m)) <= 2 and levenshtein(n, m) <= 2)
    assert sum(r.n_links for r in got.values()) == 2 * pairs and pairs > 10
    kept = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(docs).collect()}
    for d, t in enumerate(texts):
        left = [x for i, x in enumerate(t.split("\n")) if i not in want[d]] if t is not None else []
        if t is None or not want[d]:
            assert kept[d] == t
        elif any(x.strip() for x in left):
            assert kept[d] == "\n".join(left)
        else:
            assert d not in kept
    assert line_dedup.without_repeated_lines(docs).schema == docs.schema
    assert line_dedup.repeated_lines(docs.limit(0)).count() == 0


def test_line_classes_and_links_of_every_holder(spark):
    a, b, c = "the first line that is long enough", "the first lime that is long enough", "the furst lime that is long enouph"
    other = "something else that nobody wrote twice"
    docs = spark.createDataFrame([(1, a), (2, f"{a}\n{other}"), (3, b), (4, f"{c}\n{b}"), (5, None)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in line_dedup.repeated_lines(docs).collect()}
    assert {d: r.n_held_links for d, r in got.items()} == {1: 1, 2: 1, 3: 2, 4: 3, 5: 0}
    line = {(d, x["line_no"]): x["class"] for d, r in got.items() for x in r.classes}
    assert len({line[k] for k in ((1, 0), (2, 0), (3, 0), (4, 0), (4, 1))}) == 1
    assert len(line) == 6 and line[2, 1] != line[1, 0]


def test_short_exact_repeats_are_found(spark):
    docs = spark.createDataFrame([(1, "Read more\n\n春眠不觉晓\nyes"), (2, "read  MORE\n\n春眠不觉晓\nyet"), (3, "yes")], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_checked, r.n_short, r.removed, r.short_repeats) for r in line_dedup.repeated_lines(docs).collect()}
    assert got == {1: (0, 3, [], []), 2: (0, 3, [], [0, 2]), 3: (0, 1, [], [0])}
    kept = {r.doc_id: r.text for r in line_dedup.without_repeated_lines(docs, short=True).collect()}
    assert kept == {1: "Read more\n\n春眠不觉晓\nyes", 2: "\nyet"}


def test_crowded_segments_in_any_script_end_in_bounded_time(spark):
    rng = random.Random(9)
    beginning = "в начале каждой строки стоят одни и те же слова, а потом "
    family = list({beginning + "".join(rng.choice("абвгдежзиклмнопрстуфхцчшэюя") for _ in range(12)) for _ in range(5000)})
    han = ["每一行的开头都是同样的二十四个以上的汉字所以它们共享一个片段" + "".join(chr(rng.randrange(0x4E00, 0x9FA0)) for _ in range(10)) for _ in range(300)]
    near = [x[:-3] + "ъ" + x[-2:] for x in family[:20]] + [x[:5] + "兩" + x[5:] for x in han[:10]]
    rows = list(enumerate(family + han + near))
    started = time.monotonic()
    got = line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).where("n_links > 0 or size(removed) > 0").collect()
    assert time.monotonic() - started < 120
    n = len(family) + len(han)
    assert {r.doc_id: (r.n_links, r.removed) for r in got} == {**{i: (1, []) for i in range(20)}, **{n + i: (1, [0]) for i in range(30)}, **{len(family) + i: (1, []) for i in range(10)}}


def test_parity_blocks_keep_two_after_every_edit(spark):
    masks = [1 << i | 1 << j | 1 << k | 1 << m for i, j, k, m in ((0, 11, 22, 33), (0, 1, 2, 3), (10, 21, 42, 63), (31, 32, 53, 54))]
    rows = [(x, x ^ m if x ^ m < 1 << 63 else (x ^ m) - (1 << 64)) for x in (0, 12345678901234567) for m in masks]
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    same = [(p == q).cast("int") for p, q in zip(line_dedup.parity_blocks(F.col("a")), line_dedup.parity_blocks(F.col("b")), strict=True)]
    assert df.select(sum(same).alias("n")).where("n = 0").count() == 0


def test_lines_of_text_ids_hot_lines_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_LEAST", 3)
    monkeypatch.setattr(line_dedup, "HOT_SHARE", 1)
    hot, other = "this line stands in every document of the corpus", "and this line stands in one document only, with x"
    rows = [(f"d{i}", hot + ("\n" + other.replace("x", "yz"[i]) if i < 2 else "") + "\nshort", 1, 2) for i in range(9)] + [(None, hot, 1, 2), ("e", None, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, h1 int, n int")
    got = {r.doc_id: (r.removed, r.n_links, r.short_repeats) for r in line_dedup.repeated_lines(docs).collect()}
    want = {f"d{i}": ([0] if i else [], 0, [1] if i else []) for i in range(9)} | {None: ([], 0, []), "e": ([], 0, [])}
    want |= {"d0": ([], 1, []), "d1": ([0, 1], 1, [2])}
    assert got == want
    kept = line_dedup.without_repeated_lines(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 'd0'").count() == 1


def test_edit_distance_and_letter_counts(spark):
    rng = random.Random(7)
    rows = []
    for _ in range(1500):
        a = "".join(rng.choice("abcé") for _ in range(rng.randint(1, 14)))
        b = edited(rng, a, rng.randint(0, 3)) if a else "a"
        a, b = sorted((a, b), key=len)
        if len(b) - len(a) <= 2:
            rows.append((a, b, levenshtein(a, b)))
    df = spark.createDataFrame(rows, "x string, y string, d int").withColumn("g", line_dedup.edit_distance("x", "y"))
    df = df.withColumn("cx", line_dedup.letter_counts(F.col("x"))).withColumn("cy", line_dedup.letter_counts(F.col("y")))
    assert df.where("(d <= 2) <> (g <= 2) or (d <= 2 and d <> g)").count() == 0
    assert df.where(line_dedup.counts_apart("cx", "cy") > 2 * F.col("d")).count() == 0
    x, y = (line_dedup.signatures(df.select("d", F.monotonically_increasing_id().alias("i"), F.col(c).alias("norm"))) for c in "xy")
    both = x.select("d", "i", *[F.col(c).alias(f"x_{c}") for c in ("counts", "p0", "p1")]).join(y.select("i", *[F.col(c).alias(f"y_{c}") for c in ("counts", "p0", "p1")]), "i")
    for n in range(4):
        assert both.where((F.col("d") <= n) & ~line_dedup.may_be_near(edits=n)).count() == 0


def test_repeated_document_rows_are_one_document(spark):
    text = "this very line is long enough to count"
    docs = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.removed) for r in line_dedup.repeated_lines(docs).collect())
    assert got == [(1, []), (1, []), (2, [0])]


def water(size, weight, share=1.5):
    total, open_, out = share * sum(size), set(range(len(size))), {}
    while True:
        level = (total - sum(2 * size[i] for i in out)) / sum(weight[i] for i in open_)
        over = {i for i in open_ if level * weight[i] > 2 * size[i]}
        if not over:
            return [2 * size[i] if i in out else level * weight[i] for i in range(len(size))]
        out |= {i: 1 for i in over}
        open_ -= over


def test_mixing_meets_targets(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randint(1, 300)) if i % 11 else None, None if i % 17 == 0 else f"s{(i * i) % 5}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("target", F.lit("clash")).withColumn("row", F.lit(1))
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    size = {i: len((t or "").split()) for i, t, _ in rows}
    names = sorted({s for _, _, s in rows if s}) + [None]
    totals = [sum(size[i] for i, _, s in rows if s == n) for n in names]
    want = water(totals, [(5, 2, 1)[k % 3] for k in range(len(names))])
    for n, w in zip(names, want, strict=True):
        own = [i for i, _, s in rows if s == n]
        assert got[own[0]].target == pytest.approx(w)
        assert abs(sum(got[i].taken for i in own) - w) <= 1
    assert all(r.size == size[i] and r.taken <= 2 * r.size for i, r in got.items())
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(3)).collect()}
    assert again == {i: r.taken for i, r in got.items()}
    assert mixing.mix(docs.limit(0)).count() == 0


def test_schedule_keeps_proportions_everywhere(spark):
    targets = spark.createDataFrame([(1, 64_000, 64_000.0), (2, 32_000, 16_000.0), (3, 10_000, 20_000.0)], "source_id bigint, source_size bigint, target double")
    slots = sorted((r.slot, r.source_id, r["rank"], r.block, r.lap) for r in mixing.schedule(spark, targets, 64).collect())
    for s, n in ((1, 1000), (2, 250), (3, 313)):
        ranks = [r[2] for r in slots if r[1] == s]
        assert ranks == list(range(len(ranks))) and abs(len(ranks) - n) <= 2
    for lo in range(0, 1500, 250):  # low discrepancy in every stretch
        part = [r[1] for r in slots[lo : lo + 250]]
        if len(part) == 250 and lo + 250 <= 1400:
            assert abs(part.count(1) - 160) <= 6
    assert max(r[4] for r in slots if r[1] == 3) == 1


def test_tiny_sources_beside_a_large_one_reach_their_targets(spark):
    sizes = {"large": [2000] * 100, "b": [10], "c": [65], "d": [7, 3], "e": [100], "f": [300], None: [1]}
    rows = [(f"{s}-{i}", "w " * n, s) for s, own in sizes.items() for i, n in enumerate(own)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id string, text string, source string")).collect()
    for s, own in sizes.items():
        part = [r for r in got if r.doc_id.startswith(f"{s}-")]
        assert sum(r.taken for r in part) == round(part[0].target), s
    targets = spark.createDataFrame([(0, 10_000_000, 10_000_000.0)] + [(i, 65, 130.0) for i in range(1, 60)], "source_id bigint, source_size bigint, target double")
    slots = mixing.schedule(spark, targets, 64).collect()
    assert len({r.slot for r in slots}) == len(slots)
    for i in range(1, 60):
        assert sorted((r["rank"], r.block, r.lap) for r in slots if r.source_id == i) == [(0, 0, 0), (1, 1, 0), (2, 0, 1), (3, 1, 1)]


def test_mix_takes_the_same_words_for_every_block(spark):
    rng = random.Random(17)
    rows = [(None if i % 9 == 0 else i % 60, prose(rng, rng.randint(0, 90)), f"s{i % 4}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    taken = [sorted((str(r.doc_id), r.size, r.taken) for r in mixing.mix(docs, block).collect()) for block in (1, 64, 5000)]
    assert taken[0] == taken[1] == taken[2]
    nulls = spark.createDataFrame([(None, None, None)] * 5, docs.schema)
    assert [(r.size, r.taken) for r in mixing.mix(nulls).collect()] == [(0, 0)] * 5


def test_running_sums_match_one_window(spark):
    rng = random.Random(18)
    rows = [(f"k{rng.randint(0, 10**6):06d}" if i else None, rng.randint(0, 50)) for i in range(300)]
    got = {r.k: (r.nth, r.v_before) for r in mixing.running(spark.createDataFrame(rows, "k string, v bigint"), [F.col("k").asc_nulls_last()], ["v"]).collect()}
    before, want = 0, {}
    for n, (k, v) in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or "")), 1):
        want[k], before = (n, before), before + v
    assert got == want


def test_source_targets_with_many_sources_at_cap(spark):
    sized = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 5), ("d", 7), (None, 100)], "source string, size bigint")
    got = {r.source: r.target for r in mixing.source_targets(sized).collect()}
    want = water([10, 1000, 5, 7, 100], [5, 2, 1, 5, 2])
    assert [got[k] for k in ("a", "b", "c", "d", None)] == pytest.approx(want)
