"""Decontamination, suffix dedup and SimHash against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wordloom.llm import decontamination, simhash, suffix_dedup


def frame(spark, rows, name="doc_id"):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], f"{name} long, text string, contamination string")


# -- decontamination --------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def contamination(docs, items):
    windows = {}
    for i, text in items:
        w = words_of(text)
        n = min(13, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(i)
    out = []
    for i, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in {len(g) for g in windows}:
            for s in range(len(w) - n + 1):
                if own := windows.get(tuple(w[s : s + n])):
                    hit.update(range(s, s + n))
                    found |= own
        ids = ",".join(sorted("null" if x is None else str(x) for x in found))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
def test_decontamination_equals_brute_force(spark, block_bytes):
    rng = random.Random(3)
    vocabulary = ["a", "b", "É", "Zz", "9", "漢字"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 5, 12, 13, 14, 40]))) for i in range(25)]
    items += [(None, "q w e r t"), (90, None), (91, "..."), (92, items[3][1]), (3, items[3][1]), (93, "same " * 40)]
    docs = [(i, text(rng.randrange(1, 60))) for i in range(60)]
    docs += [(100 + i, f"p{i} " * 20 + t + " s" * 30) for i, (_, t) in enumerate(items) if t]
    docs += [(200, None), (201, ""), (202, "same " * 3000), (0, docs[0][1]), (203, "q w e r t"), (None, "q w e r t"),
             (204, items[0][1] + " " + "z " * 30_000)]
    table = frame(spark, docs)
    marked = decontamination.mark_contaminated(table, frame(spark, items, "item_id"), block_bytes=block_bytes)
    got = decontamination.summary(marked, "doc_id")
    assert sorted(map(tuple, got.collect()), key=repr) == contamination(docs, items)
    kept = decontamination.decontaminated(table, frame(spark, items, "item_id"), block_bytes=block_bytes)
    assert kept.columns == table.columns
    clean = [i for i, *_, bad in contamination(docs, items) if not bad]
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted(clean, key=repr)


def test_a_benchmark_of_many_blocks(spark):
    items = [(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(200)]
    docs = [(i, "before " + items[i * 7][1] + " after") for i in range(20)] + [(50, "clean " * 40), (51, None)]
    docs += [(60 + k, docs[0][1]) for k in range(200)]
    got = decontamination.mark_contaminated(
        frame(spark, docs), frame(spark, items, "item_id"), block_bytes=sum(len(t) for _, t in items) // 10)
    # The blocks were met one after the other: what is left is one pass that counts words, and a join.
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(tuple, decontamination.summary(got, "doc_id").collect()), key=repr) == contamination(docs, items)


def test_repeated_words_take_linear_time(spark):
    import time

    items = [(i, "same " * (1000 + i)) for i in range(50)]
    began = time.time()
    got = decontamination.mark_contaminated(frame(spark, [(1, "same " * 1_000_000)]), frame(spark, items, "item_id"))
    row = decontamination.summary(got, "doc_id").first()
    assert (row["n_words"], row["n_hit"], row["n_items"]) == (1_000_000, 1_000_000, 50)
    assert time.time() - began < 30


def test_decontamination_keeps_other_columns(spark):
    docs = spark.createDataFrame([(1, "q w e r t", "k", {"m": 1})], "doc_id long, text string, key__ string, spans map<string,int>")
    items = frame(spark, [(1, "q w e r t"), (2, "other words")], "item_id")
    for block_bytes in (1 << 20, 8):
        kept = decontamination.mark_contaminated(docs, items, block_bytes=block_bytes)
        assert kept.columns == [*docs.columns, "contamination"]
        assert kept.first()["key__"] == "k" and kept.first()["contamination"]["items"] == [1]


def test_decontamination_of_nothing(spark):
    one, none = frame(spark, [(1, "a b")]), frame(spark, [(1, "a b")]).limit(0)
    items = none.withColumnRenamed("doc_id", "item_id")
    assert decontamination.summary(decontamination.mark_contaminated(one, items)).first()["n_hit"] == 0
    assert decontamination.mark_contaminated(none, frame(spark, [(1, "a")], "item_id")).count() == 0
    with pytest.raises(ValueError, match="window"):
        decontamination.mark_contaminated(one, items, gram=10, width=10)


@given(st.lists(st.integers(0, 3), min_size=13, max_size=60), st.integers(0, 40))
@settings(max_examples=60, deadline=None)
def test_winnowing_guarantee(span, before):
    words = decontamination.mix(np.array(span, np.uint64) + np.uint64(1))
    longer = np.concatenate([decontamination.mix(np.arange(100, 100 + before, dtype=np.uint64)), words])
    own = set(decontamination.winnow(words, np.array([0, len(words)]))[1].tolist())
    other = set(decontamination.winnow(longer, np.array([0, len(longer)]))[1].tolist())
    assert own and own & other


# -- suffix dedup -----------------------------------------------------------------


def removed(rows, length):
    seen, out = set(), []
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if t[p : p + length] in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(t[p : p + length])
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=120), st.integers(1, 9))
def test_suffix_array_and_prefixes(symbols, times):
    s = np.array(symbols * times + [0], np.int64)
    array = suffix_dedup.suffix_array(s, 4)
    assert array.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
    _, common = suffix_dedup.permuted_common_prefixes(s, array)
    for x, y in zip(array[1:].tolist(), array[:-1].tolist(), strict=True):
        n = 0
        while s[x + n] == s[y + n]:
            n += 1
        assert common[x] == n


def test_suffix_array_of_bytes():
    rng = np.random.default_rng(5)
    s = np.concatenate([rng.integers(1, 257, 6000), np.tile(rng.integers(1, 257, 900), 3), np.full(300, 7), [0]])
    array = suffix_dedup.suffix_array(s, 257)
    body = s.astype(np.uint16).byteswap().tobytes()
    assert array.tolist() == sorted(range(len(s)), key=lambda i: body[2 * i :])


@pytest.mark.parametrize("hot, shard_bytes", [(10_000, 1 << 20), (3, 2000)])
def test_suffix_dedup_equals_brute_force(spark, hot, shard_bytes):
    rng = random.Random(hot)
    noise = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage, texts = noise(260), []
    for _ in range(60):
        texts.append(noise(rng.randrange(60)) + passage[rng.randrange(60) : 150 + rng.randrange(110)] + noise(rng.randrange(90)))
    texts += [texts[0], "", "x" * 1500, "ab" * 900, "y" * 99, "z" * 100, "z" * 101, noise(40_000) + passage, passage * 3]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = suffix_dedup.dedup_strings(frame(spark, [*rows, (500, None)]), hot=hot, shard_bytes=shard_bytes)
    want = removed([*((i, t.encode()) for i, t in rows), (500, b"")], 100)
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_suffix_dedup_of_odd_ids(spark):
    rng = random.Random(8)
    body = "".join(rng.choice("abcdefghij") for _ in range(130))
    rows = [(None, body), (1, body), (1, body), (2, body), (1, body + "tail")]
    got = suffix_dedup.dedup_strings(frame(spark, rows)).collect()
    left = {(r["doc_id"], r["n_bytes"]): r["n_bytes"] - r["n_removed"] for r in got}
    assert len(got) == 5 and left == {(None, 130): 130, (1, 130): 0, (2, 130): 0, (1, 134): 4}
    assert suffix_dedup.dedup_strings(frame(spark, rows).limit(0)).count() == 0


def test_suffix_dedup_of_repeated_rows(spark):
    rng = random.Random(9)
    body, other = ("".join(rng.choice("abcdefghij") for _ in range(130)) for _ in range(2))
    rows = [(1, body), (1, body), (None, other), (None, other), (2, body + "tail"), (3, other), (3, other)]
    got = suffix_dedup.dedup_strings(frame(spark, rows)).collect()
    left = sorted((r["doc_id"] or 0, r["n_bytes"] - r["n_removed"], r["n_spans"]) for r in got)
    assert left == [(0, 130, 0), (0, 130, 0), (1, 130, 0), (1, 130, 0), (2, 4, 1), (3, 0, 1), (3, 0, 1)]


# -- SimHash ----------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fps, bits=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_fingerprints(spark):
    texts = [None, "", " \t", "One", "a b c", "a b c d", "A b\x0bC  d e", "É é ÀB c d e f", "x " * 5000, "漢 字 か な 。"]
    got = simhash.fingerprints(frame(spark, list(enumerate(texts))))
    assert {r["doc_id"]: r["fp"] % 2**64 for r in got.collect()} == {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    first = got.select(simhash.hex_digits(F.col("fp"))).where("doc_id = 3").first()[0]
    assert first == f"{plain_fingerprint('one'):016x}"


def fingerprint_sample(seed):
    rng = random.Random(seed)
    out = {0, 2**64 - 1}
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 80])):
            at ^= sum(1 << b for b in {rng.randrange(64) for _ in range(rng.randrange(7))})
            out.add(at)
    return sorted(out)


@pytest.mark.parametrize("seed, cell_rows", [(1, 20_000), (2, 5)])
def test_links_equal_brute_force(spark, seed, cell_rows):
    fps = fingerprint_sample(seed)
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), cell_rows=cell_rows).collect()
    want, at = groups(fps), {f: i for i, f in enumerate(fps)}
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        i, j = at[u % 2**64], at[v % 2**64]
        assert bin(fps[i] ^ fps[j]).count("1") <= 4
        root[find(i)] = find(j)
    mine = [find(i) for i in range(len(fps))]
    assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))


def test_large_cells_are_grown():
    fps = np.array(fingerprint_sample(9), np.uint64)
    cells = np.zeros(len(fps), np.int64)
    grown, paired = (simhash.forest(cells, fps, small=s) for s in (1, 10_000))
    assert len(grown) == len(paired) == len(fps) - len(set(groups([int(f) for f in fps])))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4))
def test_grids_lose_no_link(a, flips):
    b = a ^ sum(1 << k for k in flips)
    x, y = (simhash.embed(np.array([v], np.uint64)) for v in (a, b))
    assert simhash.manhattan(x, y)[0] <= len(flips)
    assert any(int(x[0]) & m == int(y[0]) & m for m in simhash.grids())


def test_near_duplicates(spark):
    base = [f"w{i}" for i in range(300)]
    rows = [(10, " ".join(base)), (3, " ".join(base)), (7, " ".join(base[:299])), (8, "other words are here now"), (9, None),
            (4, ""), (None, " ".join(base)), (8, "other words are here now"), (11, "long " * 40_000)]
    got = sorted(map(tuple, simhash.near_duplicates(frame(spark, rows)).select("doc_id", "component_id").collect()), key=repr)
    fps = [plain_fingerprint(t) for _, t in rows]
    parts = groups(fps)
    want = [(i, min(x for (x, _), q in zip(rows, parts, strict=True) if q == p and x is not None))
            for (i, _), p in zip(rows, parts, strict=True)]
    assert got == sorted(want, key=repr)
    kept = sorted((r["doc_id"] for r in simhash.one_of_each(frame(spark, rows)).collect()), key=repr)
    assert kept == sorted((i for i, c in want if i is None or i == c), key=repr)
    assert simhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_one_row_of_each_group_stays(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(200)) for x in "abcd")
    rows = [(1, a), (1, a), (None, a), (4, a + " more"), (None, b), (None, b), (None, b + " more"), (3, c), (7, c), (7, d), (9, d)]
    got = sorted(map(tuple, simhash.one_row_of_each(frame(spark, rows)).collect()), key=repr)
    assert len(got) == 4 and [r for r in got if r[0] is not None] == [(1, a, "x"), (3, c, "x"), (7, d, "x")]
    assert [r[1].startswith(b) for r in got if r[0] is None] == [True]
    odd = spark.createDataFrame([(1, None, "x"), (1, "x", None), (1, "x", None)], "doc_id long, text string, other string")
    assert sorted(map(tuple, simhash.one_row_of_each(odd).collect()), key=repr) == [(1, "x", None), (1, None, "x")]
    assert simhash.one_row_of_each(frame(spark, rows).limit(0)).count() == 0


def test_the_pipeline_keeps_one_of_repeated_rows(spark):
    import corpus_pipeline

    a = " ".join(f"w{i}" for i in range(200))
    got = corpus_pipeline.keep_one_of_each(spark, frame(spark, [(1, a), (1, a), (None, a)]), "")
    assert [tuple(r) for r in got.collect()] == [(1, a, "x")]
