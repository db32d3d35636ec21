"""Centroid clustering, exact top-k search and token alignment against brute force."""

import hashlib
import math
import random

import numpy as np
import pytest

from wordloom.llm import centroids, token_alignment, topk_search
from wordloom.llm.tables import table

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, cluster string, row int, score double"


def make(spark, vectors, ids=None, parts=3):
    ids = range(len(vectors)) if ids is None else ids
    data = [(i, v, "x", 1, 0.5) for i, v in zip(ids, vectors, strict=True)]
    return spark.createDataFrame(data, SCHEMA).repartition(parts)


def noise(n, dims, seed=1, size=0.3):
    rng = np.random.default_rng(seed)
    return [list(map(float, np.float32(rng.normal(0, size, dims)))) for _ in range(n)]


def whole(vector):
    return [math.floor(64 * float(np.float32(x))) for x in vector]


# -- centroid clustering -------------------------------------------------------------


def plain_clusters(rows, k, rounds):
    """Rows of (id, whole numbers), by the definition."""

    def square(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def nearest(v):
        return min(range(len(centres)), key=lambda c: (square(v, centres[c]), c))

    hashed = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in rows if i is not None)
    centres = [v for _, v in hashed[:k]]
    for _ in range(rounds):
        held = [nearest(v) for _, v in rows]
        for c in range(len(centres)):
            own = [v for (_, v), h in zip(rows, held, strict=True) if h == c]
            if own:
                centres[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    held = [nearest(v) for _, v in rows]
    far = [square(v, centres[h]) for (_, v), h in zip(rows, held, strict=True)]
    return [
        (i, h, d, sum(x for x, y in zip(far, held, strict=True) if y == h), sum(far),
         hashlib.sha256(",".join(map(str, centres[h])).encode()).hexdigest())
        for (i, _), h, d in zip(rows, held, far, strict=True)
    ]


def found_clusters(df, **how):
    got = centroids.cluster(df, **how).drop("centroid")
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize("k", [1, 4, 9])
def test_clusters_equal_plain_rounds(spark, k):
    vectors = noise(120, 8) + noise(1, 8, 5) * 60  # a third of the rows are copies
    rows = list(enumerate(map(whole, vectors)))
    assert found_clusters(make(spark, vectors), k=k, dims=8) == sorted(plain_clusters(rows, k, 3), key=repr)


def test_clusters_of_odd_rows(spark):
    good = noise(20, 4)
    nan, inf = float("nan"), float("inf")
    vectors = good + [None, [], [1.0, 2.0], [1.0, None, 0.0, 0.0], [nan, 0.0, 0.0, 0.0], [0.0, inf, 0.0, 0.0], good[3], good[3]]
    ids = [*range(20), 50, 51, 52, 53, 54, 55, 3, None]
    rows = [(i, whole(v)) for i, v in zip(ids, vectors, strict=True) if v and len(v) == 4 and None not in v and np.isfinite(v).all()]
    assert len(rows) == 22
    assert found_clusters(make(spark, vectors, ids), k=5, dims=4) == sorted(plain_clusters(rows, 5, 3), key=repr)


def test_fewer_vectors_than_centroids_ties_and_no_rows(spark):
    same = [[0.5, 0.25]] * 3
    got = found_clusters(make(spark, same), k=16, dims=2)
    assert [r[1:5] for r in got] == [(0, 0, 0, 0)] * 3  # all centroids are equal: the smallest number holds all
    assert found_clusters(make(spark, [None, [1.0]]), dims=2) == []
    assert found_clusters(make(spark, []), dims=2) == []
    assert found_clusters(make(spark, same, [None] * 3), dims=2) == []


def test_tournament_prefers_the_smaller_number():
    centres = np.array([[0, 0], [2, 0], [2, 0], [-2, 0]])
    normals, thresholds = centroids.bisectors(centres)
    v = np.array([[1, 7], [2, 0], [-1, 3], [-2, 0], [0, 0]])
    assert centroids.tournament(v, normals, thresholds).tolist() == [0, 1, 0, 3, 0]


def test_components_beyond_64_bit_distances_end_the_job(spark):
    with pytest.raises(Exception, match="no exact 64-bit result"):
        centroids.cluster(make(spark, [[1e30, 0.0]]), dims=2).collect()


# -- exact top-k -----------------------------------------------------------------------


def plain_top(rows, k, every=20):
    out = []
    for at, (i, q) in enumerate(rows):
        if i is None or i % every:
            continue
        others = [(-sum(a * b for a, b in zip(q, x, strict=False)), j is None, j) for n, (j, x) in enumerate(rows) if n != at]
        others.sort(key=lambda o: (o[0], o[1], o[2] or 0))
        out += [(i, rank, j, -s) for rank, (s, _, j) in enumerate(others[:k], 1)]
    return sorted(out, key=repr)


def found_top(df, **how):
    got = topk_search.top_k(df, **how)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    return sorted(map(tuple, got.collect()), key=repr)


SMALL = {"node_rows": 40, "page_rows": 9, "block_rows": 3, "directory_rows": 4, "unit_blocks": 2}


@pytest.mark.parametrize("size, scale", [(0.3, 64), (200.0, 64), (30.0, 1 << 22)])
def test_top_k_equals_brute_force_over_many_nodes(spark, size, scale):
    rng = random.Random(3)
    spread = noise(150, 6, 2, size) + [[x + rng.random() * size / 50 for x in v] for v in noise(5, 6, 4, 3 * size) for _ in range(30)]
    vectors = [list(map(float, np.float32(v))) for v in spread] + noise(1, 6, 9, size) * 100
    rows = [(i, [math.floor(scale * x) for x in v]) for i, v in enumerate(vectors)]
    assert found_top(make(spark, vectors), k=7, scale=scale, **SMALL) == plain_top(rows, 7)


def test_top_k_of_odd_rows(spark):
    base = noise(30, 5)
    vectors = base + [None, [float("nan")] * 5, [1.0, None, 1.0, 1.0, 1.0], [], base[0], base[0], base[20], base[2][:3], base[1]]
    ids = [*range(30), 40, 60, 80, 100, 0, 0, None, 120, -20]
    usable = [
        (i, whole(v)) for i, v in zip(ids, vectors, strict=True)
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    rows = [(i, v + [0] * (5 - len(v))) for i, v in usable]
    assert found_top(make(spark, vectors, ids), k=20, **SMALL) == plain_top(rows, 20)


def test_fewer_candidates_than_k_and_no_rows(spark):
    vectors = noise(4, 3)
    rows = list(enumerate(map(whole, vectors)))
    assert found_top(make(spark, vectors)) == plain_top(rows, 20)
    assert len(found_top(make(spark, vectors))) == 3
    assert found_top(make(spark, vectors, [1, 2, 3, 4])) == []
    assert found_top(make(spark, [None], [0])) == []
    assert found_top(make(spark, [])) == []


def test_bounds_spare_inner_products():
    """Far groups of vectors are neither visited nor multiplied."""
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 400, (8, 16))
    v = np.concatenate([c + rng.normal(0, 4, (200, 16)) for c in centres]).astype(np.int64)
    norm2 = (v * v).sum(axis=1)
    space = topk_search.Space(16, int(norm2.max()))
    order, ends, mids, far = topk_search.leaf_pages(v, norm2, space, 100)
    route = v[:1]
    to_route = space.between(v.astype(space.exact) @ route.T.astype(space.exact), norm2, norm2[:1])[:, 0]
    node = {
        "route": 0, **topk_search._packed(np.arange(1600)[order], np.ones(1600), np.arange(1600)[order], v[order], norm2[order]),
        "page_ends": ends.tobytes(), "page_v": v[mids].astype("<i4").tobytes(), "page_parent": to_route[mids].tobytes(),
        "page_radius": far[ends - 1].tobytes(), "entry_far": far.tobytes(),
    }
    asked = np.arange(0, 1600, 200)
    block = topk_search.Block(topk_search._packed(asked, np.ones(8), asked, v[asked], norm2[asked]), space, 10)
    done = topk_search.search(block, topk_search.Node(node, space, route), space)
    assert done < 0.5 * 8 * 1600
    scores = v[asked] @ v.T
    for n, row in enumerate(asked):
        scores[n, row] = -(1 << 60)
        assert sorted(block.hits[1][block.hits[0] == n]) == sorted(np.sort(scores[n])[-10:])


# -- token alignment -------------------------------------------------------------------

TEXTS = [
    "The quick brown fox jumps over the lazy dog.", "Élan vital, naïve façade; ¿qué?", "日本語のテキスト と emoji 🙂🙃",
    "<|endoftext|> </s>[INST] <0x41> <unk>", "  two  spaces\n\n\ttabs \r\n", " ", "\n", "a", "▁ literal", "", None,
    "The quick brown fox", "The quick brown fox", "\x00\x01 control", "word " * 3000, "x" * 5000,
    "a" + " " * 3000 + "b", "\n" * 1500 + "'s 'll it's",
]


def plain_alignment(texts):
    """Tokens, links and groups by the definition; corpus counts over all texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_coder = Tokenizer.from_file(f"{token_alignment.FOLDER}/{token_alignment.A_FILE}")
    a_coder.encode_special_tokens = True
    b_coder = sentencepiece.SentencePieceProcessor(model_file=f"{token_alignment.FOLDER}/{token_alignment.B_FILE}")
    to_byte = {c: b for b, c in enumerate_letters().items()}
    every, links = [], {}
    for text in texts:
        if not text:
            every.append(None)
            continue
        want = b" " + text.encode()
        a = a_coder.encode(" " + text, add_special_tokens=False)
        a_ids = a.ids
        a_bytes = [bytes(to_byte[c] for c in t) for t in a.tokens]
        b_ids = b_coder.encode(text)
        b_bytes = []
        for i in b_ids:
            piece = b_coder.id_to_piece(i)
            b_bytes.append(bytes([int(piece[3:5], 16)]) if b_coder.is_byte(i) else piece.replace("▁", " ").encode())
        if b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            every.append(None)
            continue

        def spans(pieces):
            at, out = 0, []
            for p in pieces:
                out.append((at, at + len(p)))
                at += len(p)
            return out

        sa, sb = spans(a_bytes), spans(b_bytes)
        own = []
        first = 0
        for x, (s, e) in enumerate(sa):
            while sb[first][1] <= s:
                first += 1
            y = first
            while y < len(sb) and sb[y][0] < e:
                own.append((a_ids[x], b_ids[y]))
                y += 1
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, low = [], 0
        for cut in cuts:
            part = ["".join("," + str(i) for i, (_, e) in zip(ids, ss, strict=True) if low < e <= cut)[1:]
                    for ids, ss in ((a_ids, sa), (b_ids, sb))]
            groups.append("|".join(part))
            low = cut
        for pair in own:
            links[pair] = links.get(pair, 0) + 1
        every.append((len(a_ids), len(b_ids), groups, own))
    best = {}
    for (_, b), n in links.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for found in every:
        if found is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, own = found
        out.append((n_a, n_b, len(groups), len(own), sum(links[p] == best[p[1]] for p in own), sum(links[p] for p in own),
                    hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def enumerate_letters():
    """The byte-level letters as published: printing characters stand for themselves, the rest follow from 256."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + n) for n, b in enumerate(rest)}


@pytest.mark.parametrize("block_pairs", [1 << 21, 200])
def test_alignment_equals_the_definition(spark, block_pairs):
    data = [(n if n % 5 else None, t, "x", 1) for n, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(data, "doc_id long, text string, a string, n_a int").repartition(3)
    got = token_alignment.summary(docs, block_pairs=block_pairs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = [(i, *x) for (i, *_), x in zip(data, plain_alignment(TEXTS), strict=True)]
    assert sum(w[1] > 0 for w in want) >= 12 and sum(w[1] == 0 for w in want) >= 3
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_alignment_query_equals_the_definition(spark):
    from wordloom.llm.queries import queries

    docs = table(spark, FOLDER, "documents").select("doc_id", "text").collect()
    want = [(r["doc_id"], *x) for r, x in zip(docs, plain_alignment([r["text"] for r in docs]), strict=True)]
    got = queries()["op13_cross_tokenizer_alignment"](spark, FOLDER)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_alignment_of_no_rows_and_string_ids(spark):
    kind = "doc_id string, text string"
    assert token_alignment.summary(spark.createDataFrame([], kind)).collect() == []
    got = token_alignment.summary(spark.createDataFrame([("k", "one two")], kind)).collect()
    assert [r["doc_id"] for r in got] == ["k"] and got[0]["n_a"] == 2


def test_groups_of_each_token(spark):
    docs = spark.createDataFrame([(1, "unbelievable façade"), (2, "The end")], "doc_id long, text string")
    for r in token_alignment.align(token_alignment.encode(docs)).collect():
        assert len(r["a"]) == len(r["a_group"]) and len(r["b"]) == len(r["b_group"])
        assert sorted(set(r["a_group"])) == sorted(set(r["b_group"])) == list(range(r["n_groups"]))
        written = ";".join(
            ",".join(str(i) for i, g in zip(r["a"], r["a_group"], strict=True) if g == n) + "|"
            + ",".join(str(i) for i, g in zip(r["b"], r["b_group"], strict=True) if g == n)
            for n in range(r["n_groups"]))
        assert hashlib.sha256(written.encode()).hexdigest() == r["groups_sha256"]


def test_pointer_jumping_joins_chains_of_overlaps():
    a, b = np.array([2, 4, 6, 9, 10]), np.array([1, 3, 5, 6, 10])
    of_a, of_b = token_alignment.components(a, b)
    assert of_a.tolist() == [0, 0, 0, 1, 1] and of_b.tolist() == [0, 0, 0, 0, 1]
    n = 4000  # one component of staggered tokens
    a, b = np.append(np.arange(2, 2 * n, 2), 2 * n), np.append(np.arange(1, 2 * n, 2), 2 * n)
    of_a, of_b = token_alignment.components(a, b)
    assert set(of_a) == set(of_b) == {0}


def test_a_frequent_word_is_encoded_once_with_the_ids_of_whole_texts():
    import pyarrow as pa

    files = tuple(f"{token_alignment.FOLDER}/{f}" for f in (token_alignment.A_FILE, token_alignment.B_FILE))
    assert token_alignment.encodes_by_stretch(files)
    coders = token_alignment.byte_level(files[0]), token_alignment.pieces(files[1])
    tables, asked = [token_alignment._table(of) for _, of in coders], []

    def counted(code):
        return lambda texts: asked.extend(texts) or code(texts)

    counting = [(counted(code), of) for code, of in coders]

    def ids(texts, by, cut):
        found = token_alignment._encoded(pa.array(texts, pa.large_string()), by, tables, cut)
        return [(flat.tolist(), many.tolist()) for flat, many in found]

    odd = list("  \n\t\x0b\x1c\x85\xa0 　​aB9'.é日́▁") + ["'s", "'ll", " the", "</s>", "\n\n ", "😀"]
    draw = random.Random(5)
    texts = ["".join(draw.choices(odd[: -7 if n % 3 else None], k=n % 40)) for n in range(600)] + ["a\n" + "\n" * 1500 + " b c"]
    whole_a, whole_b = ids(texts, coders, False)
    assert ids(texts, coders, True) == [whole_a, whole_b] and 100 < sum(n > 0 for n in whole_a[1]) < 600
    same = ["all of these words are the same\n"] * 200
    assert ids(same, counting, True) == ids(same, coders, False)
    assert sum(map(len, asked)) < 2 * len(same[0]) + 10
