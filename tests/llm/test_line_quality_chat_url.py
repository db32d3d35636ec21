"""Line dedup, quality rules, chat formatting and URL filters on small inputs."""

import hashlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wordloom.llm import chat_format, line_dedup, quality_rules, url_filters
from wordloom.llm.graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, Kept string"


def docs(spark, *rows):
    """Rows of (doc_id, text, lang, source); the other columns clash with names the operators use."""
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], DOCS)


# -- line dedup -------------------------------------------------------------------


def cleaned(rows, ratio, least):
    pages, held = Counter(s for _, _, _, s in rows), Counter()
    for _, text, _, source in rows:
        for line in {x.strip(" ") for x in (text or "").split("\n")} - {""}:
            held[source, line] += 1
    bad = {k for k, n in held.items() if n >= least and n > ratio * pages[k[0]]}
    out = []
    for i, text, _, source in rows:
        lines = None if text is None else text.split("\n")
        kept = lines and [x for x in lines if (source, x.strip(" ")) not in bad]
        n = len(lines or [])
        same = lines is None or len(kept) == n
        out.append((i, text if same else "\n".join(kept), n, n - len(kept or [])))
    return sorted(out, key=repr)


def test_line_dedup_equals_brute_force(spark):
    rows = [(i, f"Menu\n own {i} \n  Menu  \n\nend", "en", "a") for i in range(30)]
    rows += [(100 + i, "Menu\nrare" if i < 4 else "other", "en", "b") for i in range(8)]
    rows += [(None, None, None, None), (200, "", "en", "a"), (201, "Menu", "en", None), (5, "Menu\nMenu", "en", "a")]
    rows += [(300, "long\n" * 50_000 + "Menu", "en", "a"), (0, rows[0][1], "en", "a")]
    got = line_dedup.drop_boilerplate(docs(spark, *rows))
    want = cleaned(rows, line_dedup.RATIO, line_dedup.MIN_PAGES)
    found = sorted(map(tuple, got.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=repr)
    assert found == want
    assert {"Kept", "lang", "n_lines"} <= set(got.columns)
    assert any(n for _, _, _, n in want)


def test_line_dedup_of_nothing(spark):
    assert line_dedup.drop_boilerplate(docs(spark).limit(0)).count() == 0


def test_line_dedup_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr("wordloom.llm.tables.BROADCAST_BYTES", 0)
    rows = [(i, f"Menu\n{i}", "en", "a") for i in range(20)]
    monkeypatch.setattr(line_dedup, "broadcast_if_small", lambda df: df)
    got = line_dedup.drop_boilerplate(docs(spark, *rows))
    assert sorted(r["text"] for r in got.collect()) == sorted(str(i) for i in range(20))


def test_copies_of_a_page_do_not_make_its_lines_boilerplate(spark):
    copied = "first own line\nsecond own line\nMenu"
    rows = [(i, copied, "en", "a") for i in range(10)]
    rows += [(100 + i, f"own {i}\nMenu", "en", "a") for i in range(20)] + [(200 + i, None, "en", "a") for i in range(9)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_boilerplate(docs(spark, *rows)).collect()}
    want = {i: "first own line\nsecond own line" for i in range(10)} | {100 + i: f"own {i}" for i in range(20)}
    assert got == want | {200 + i: None for i in range(9)}
    rows_count = line_dedup.drop_boilerplate(docs(spark, *rows), each_row=True)
    assert rows_count.where("doc_id = 0").first()["text"] == ""


# -- quality rules ----------------------------------------------------------------


def counted(text):
    text = text or ""
    words = text.split() if text.isascii() else [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(hit))


TEXTS = [
    None, "", " \t\r\n", "one", "a b c", "a a a a", "a b c a b c x", "x\n x\nx\n\n \nx", "# * $%&|<> é 漢字　b",
    "the cat sat " * 400, "w " * 20_000 + "end", "\x0ba\x0cb\rc\td e f a b c", "a b a b a b",
]


def test_base_counts(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate(TEXTS)]
    got = quality_rules.base_counts(docs(spark, *rows), "doc_id")
    found = {r["doc_id"]: tuple(r)[1:6] for r in got.collect()}
    assert found == {i: counted(t) for i, t in enumerate(TEXTS)}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab cd#\n"), max_size=80).map("".join), min_size=1, max_size=30))
def test_base_counts_of_any_text(spark, texts):
    got = quality_rules.base_counts(docs(spark, *[(i, t, "en", "s") for i, t in enumerate(texts)]), "doc_id")
    assert {r["doc_id"]: tuple(r)[1:6] for r in got.collect()} == {i: counted(t) for i, t in enumerate(texts)}


def test_fences_follow_their_group(spark):
    plain = " ".join(f"word{i}" for i in range(120))
    noisy = " ".join(f"#w{i}*" for i in range(120))
    rows = [(i, plain + f" {i}", "en", "clean") for i in range(40)]
    rows += [(100 + i, noisy + f" {i}", "en", "code") for i in range(40)]
    rows += [(900, noisy, "en", "clean"), (901, plain, None, None), (902, None, "en", "clean"), (903, "few", "en", "clean")]
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(docs(spark, *rows)).collect()}
    assert all(got[i]["kept"] for i in range(40)) and all(got[100 + i]["kept"] for i in range(40))
    assert not got[900]["kept"] and "symbol_rate" in got[900]["reasons"]
    assert got[901]["kept"] and got[902]["base_failed"] and got[903]["base_failed"]
    assert quality_rules.apply_rules(docs(spark).limit(0)).count() == 0


def test_buckets_keep_order_and_precision(spark):
    values = [*range(0, 5000, 7), 10**6, 10**12, 2**60]
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality_rules.bucket(F.col("v")).alias("b"))
    pairs = sorted(map(tuple, got.collect()))
    assert all(b <= v < b + max(1, v / 64) + 1 for v, b in pairs)
    assert [b for _, b in pairs] == sorted(b for _, b in pairs)


# -- chat -------------------------------------------------------------------------

PIECES = ["<s>", "</s>", "[INST]", "[/INST]", "<|turn|>", "<|body|>", "\\", "<\\|", "<", "[", "x", "\n", "漢", "<|", "\\\\"]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|turn|>", ""]),
                          st.lists(st.sampled_from(PIECES), max_size=12).map("".join)), min_size=1, max_size=12))
def test_chat_round_trip(spark, turns):
    rows = spark.createDataFrame([(7, i, r, t) for i, (r, t) in enumerate(turns)],
                                 "conv_id long, turn long, role string, text string")
    chat = chat_format.format_chats(rows.withColumn("parts", chat_format.text_parts(F.col("text")))).first()
    assert chat_format.parse_chat(chat["formatted"]) == turns
    spans = [(s["start"], s["length"]) for s in chat["loss_spans"]]
    assert chat_format.loss_text(chat["formatted"], spans) == [t for r, t in turns if r == "assistant"]


def test_chat_parts_and_edges(spark):
    part = lambda kind, text=None, ref=None, units=None: (kind, text, ref, units)
    data = [
        (1, 0, "user", [part("text", "see "), part("image", None, "i.png", 2), part("odd one"), part("text", "?")]),
        (1, 1, "assistant", [part("audio", None, "a.wav", 3), part("text", "<|image|>")]),
        (2, 0, "user", None), (2, None, None, [part("text", None)]), (None, 0, "user", [part("text", "x")]),
        (3, 0, "user", [part("text", "same")]), (3, 0, "user", [part("text", "same")]),
        (4, 0, "assistant", [part("text", "y" * 300_000)]),
    ]
    df = spark.createDataFrame(data, f"conv_id long, turn long, role string, parts {chat_format.PARTS}")
    got = {r["conv_id"]: r for r in chat_format.format_chats(df).collect()}
    assert got[1]["formatted"] == (
        "<|turn|>user<|body|>see <|image|><|odd_one|>?</s><|turn|>assistant<|body|><|audio|><\\|image|></s>")
    assert [(a["turn"], a["kind"], a["ref"], a["tokens"]) for a in got[1]["attachments"]] == [
        (1, "image", "i.png", 512), (1, "odd one", None, 0), (2, "audio", "a.wav", 75)]
    assert got[1]["n_tokens"] == 1 + 512 + 1 + 75 + 1
    assert chat_format.parse_chat(got[2]["formatted"]) == [("", ""), ("user", "")]
    assert len(chat_format.parse_chat(got[3]["formatted"])) == 2 and None in got
    digest = {r["conv_id"]: r for r in chat_format.digests(chat_format.format_chats(df)).collect()}
    assert digest[4]["loss_chars"] == 300_000
    assert digest[4]["loss_sha256"] == hashlib.sha256(b"y" * 300_000).hexdigest()
    assert digest[3]["loss_chars"] == 0 and digest[None]["n_turns"] == 1
    assert chat_format.digests(chat_format.format_chats(df.limit(0))).count() == 0


# -- urls -------------------------------------------------------------------------

RULES = [("net", "/", "block"), ("good.net", "/", "allow"), ("bad.com", "/x/", "block"), ("bad.com", "/x/y", "allow")]


def pages(spark, *rows):
    return spark.createDataFrame([(i, u, h, "r") for i, (u, h) in enumerate(rows)],
                                 "page_id long, url string, html string, rule string")


def link(to):
    return f'<html><LINK href="{to}" rel=canonical></html>'


def judged(spark, *rows, rules=RULES):
    table = spark.createDataFrame(rules, "host string, path string, verdict string")
    return {r["page_id"]: r for r in url_filters.judge(pages(spark, *rows), table).collect()}


def test_rules(spark):
    got = judged(
        spark, ("HTTP://A.B.NET/p?q#f", None), ("http://xnet/p", ""), ("http://sub.good.net/", ""), ("net/x", ""), (None, None),
        ("http://bad.com/x/yz", ""), ("http://bad.com/x/z", ""), ("http://bad.com/X/z", ""), ("http://net", ""),
        ("http://net/?x", ""), ("", "<" * 100_000), ("http://net/" + "p" * 100_000, "<link " * 100_000),
    )
    assert [got[i]["verdict"] for i in range(12)] == [
        "block", "allow", "allow", "allow", "allow", "allow", "block", "allow", "allow", "block", "allow", "block"]
    assert (got[0]["host"], got[0]["path"], got[0]["rule"]) == ("a.b.net", "/p", "net/")
    assert (got[3]["host"], got[3]["path"], got[3]["rule"]) == ("", "", None)
    assert got[5]["rule"] == "bad.com/x/y"


def test_blocks_reach_aliases(spark):
    chain = [(f"http://c.org/{i}", link(f"/{i + 1}")) for i in range(12)] + [("http://c.org/12#t", link("http://Z.net/"))]
    got = judged(
        spark, *chain, ("http://good.net/a", link("//z.net/")), ("http://d.org/dir/p", link("q?x")),
        ("http://d.org/dir/q?x", ""), ("http://e.org", '<meta http-equiv="refresh" content="0; url=http://bad.com/x/">'),
        ("http://e.org", ""), ("http://e.org#z", ""), ("http://e.org/", ""), ("http://c.org/3?a", ""),
    )
    assert all(got[i]["verdict"] == "block" for i in range(13))
    assert got[13]["verdict"] == "allow" and got[13]["blocked_alias"]  # its own rule stands
    assert [got[i]["verdict"] for i in range(14, 21)] == ["allow", "allow", "block", "block", "block", "allow", "allow"]


def test_no_rules_no_pages(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert url_filters.judge(pages(spark, ("http://a.net/", None)), none).first()["verdict"] == "allow"
    rules = spark.createDataFrame(RULES, none.schema)
    assert url_filters.judge(pages(spark, ("http://a.net/", None)).limit(0), rules).count() == 0


@pytest.mark.parametrize("n, extra", [(40, 0), (60, 30)])
def test_components(spark, n, extra):
    import random

    rng = random.Random(n)
    edges = [(i, i + 1) for i in range(n) if i % 10] + [(rng.randrange(200), rng.randrange(200)) for _ in range(extra)]
    edges += [(7, 7), (500, 500), (None, 3), edges[0]]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    got = components(spark.createDataFrame(edges, "u long, v long"))
    assert {r["node"]: r["component"] for r in got.collect()} == {x: find(x) for x in list(root)}
