"""Token rows from sentences: spaced text, unspaced text with a lexicon, or a plugged-in analyser."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.functions import morph
from wordloom.functions.text import WHITE_SPACE, is_blank
from wordloom.operators.layout import broadcast_if_small, is_small
from wordloom.schemas import MORPHEME

#: A word, a number, or one other character that is not white space.
SPACED_TOKEN = rf"[\p{{L}}\p{{M}}]+|\p{{N}}+|[^\p{{L}}\p{{M}}\p{{N}}{WHITE_SPACE}]"
STARTS_AS_WORD = r"\A[\p{L}\p{M}]"
STARTS_AS_NUMBER = r"\A\p{N}"
#: Text that is in no lexicon is cut where the script changes; white space is left out.
SCRIPT_RUN = (
    r"[\p{IsHan}々]+|\p{IsHiragana}+|[\p{IsKatakana}ー]+|\p{N}+"
    r"|[\p{L}\p{M}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}々ー]]+"
    rf"|[^{WHITE_SPACE}]"
)
#: Largest lexicon, as JSON text, that each Python worker keeps; a larger one is joined.
LEXICON_BYTES = 16 << 20
#: Characters that a task matches at a time; a longer sentence is matched by itself.
PIECE_LETTERS = 1 << 18
#: Characters of a sentence that one row stands for before they meet a large lexicon.
CHUNK = 512
#: Parts of speech given by script alone.
WORD_POS, NUMBER_POS, SYMBOL_POS = ("名詞", "一般"), ("名詞", "数"), ("記号", "一般")


def tokenize_spaced(sentences: DataFrame) -> DataFrame:
    """Tokens of text that is written with spaces; the base form is the lower-case surface."""
    surface = F.col("surface")

    def by_script(at: int) -> Column:
        return (
            F.when(surface.rlike(STARTS_AS_WORD), WORD_POS[at])
            .when(surface.rlike(STARTS_AS_NUMBER), NUMBER_POS[at])
            .otherwise(SYMBOL_POS[at])
        )

    # An array of scalar choices, not a choice of arrays: the optimizer sees through it and
    # turns the part-of-speech filters into the script tests they come from.
    pos = F.array(by_script(0), by_script(1))
    found = F.regexp_extract_all(F.col("sentence"), F.lit(SPACED_TOKEN), F.lit(0))
    rest = [c for c in sentences.columns if c != "sentence"]
    return (
        sentences.select(*rest, F.posexplode(found).alias("pos_in_sentence", "surface"))
        .select(
            *rest,
            F.col("pos_in_sentence").cast("bigint").alias("token_idx"),
            "surface",
            F.lower(surface).alias("base_form"),
            F.lit("").alias("reading"),
            pos.alias("pos"),
        )
        .withColumn("primary_pos", morph.primary_pos(F.col("pos")))
    )


def project_features(morphemes: DataFrame) -> DataFrame:
    """Replace ``features`` by base form, reading, parts of speech; white-space tokens go."""
    features = F.col("features")
    rest = [c for c in morphemes.columns if c != "features"]
    return morphemes.where(~is_blank(F.col("surface"))).select(
        *rest,
        morph.base_form(F.col("surface"), features).alias("base_form"),
        morph.reading(features).alias("reading"),
        F.coalesce(features, F.array().cast("array<string>")).alias("pos"),
        morph.primary_pos(features).alias("primary_pos"),
    )


def analyser_udf(analyse: Callable[[pd.Series], pd.Series]) -> Callable[[Column], Column]:
    """An analyser as a column function, with the tokens of some sentences at a time as Python objects.

    An Arrow batch has up to 10,000 rows, whose tokens as dictionaries would fill gigabytes; each
    piece of them becomes Arrow before the next is analysed. Travels by value, like the analyser.
    """
    kind = pa.list_(pa.struct([("surface", pa.string()), ("features", pa.list_(pa.string()))]))
    limit = PIECE_LETTERS

    def pieces(texts: pa.Array) -> Iterator[list[str | None]]:
        rows, letters = [], 0
        for text in texts:
            rows.append(text.as_py())
            letters += len(rows[-1] or "")
            if letters > limit:
                yield rows
                rows, letters = [], 0
        if rows:
            yield rows

    def run(texts: pa.Array) -> pa.Array:
        found = [pa.array(list(analyse(pd.Series(rows, dtype=object))), kind) for rows in pieces(texts)]
        return pa.concat_arrays(found) if found else pa.array([], kind)

    return F.arrow_udf(run, T.ArrayType(MORPHEME))


def tokenize_with(
    sentences: DataFrame, analyse: Callable[[pd.Series], pd.Series]
) -> DataFrame:
    """Tokens from an analyser of the user's own.

    ``analyse`` gets a batch of sentences and returns, for each, a list of
    ``{"surface": ..., "features": [...]}``.
    """
    analyser = analyser_udf(analyse)
    rest = [c for c in sentences.columns if c != "sentence"]
    found = sentences.withColumn("found", analyser(F.col("sentence")))
    tokens = found.select(*rest, F.posexplode("found").alias("at", "m")).select(
        *rest, F.col("at").cast("bigint").alias("token_idx"), "m.surface", "m.features"
    )
    return project_features(tokens)


def tokenize_lexicon(sentences: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Longest-match tokens of unspaced text, whatever characters the terms hold.

    ``lexicon`` has ``term`` and ``features`` (array of strings, may be NULL). From
    left to right the longest term that starts at a position is taken; text between
    terms becomes tokens of its own, cut where the script changes, with
    ``in_lexicon`` false. Blank terms are left out. Sentences must differ in their
    other columns.

    There is no cap on the length of terms. A lexicon measured to be small goes to the
    tasks as a trie (some 12 bytes a character of its terms) and texts stay where they lie;
    else the spans of the text are joined to it, where a position only tries the lengths of the
    terms that begin with its two characters, and one character if that is a term.
    """
    terms = (
        lexicon.where(~is_blank(F.col("term")))
        .groupBy("term")
        .agg(F.min("features").alias("features"))
    )
    known = terms.select("term")
    if is_small(known, LEXICON_BYTES):
        cut = sentences.withColumn("pieces", _matcher(known)(F.col("sentence")))
    else:
        cut = _with_hits(sentences, known)
        cut = cut.withColumn("pieces", _hit_taker()(F.col("sentence"), F.col("hits")))

    def piece(text: Column, in_lexicon: bool) -> Column:
        return F.struct(text.alias("surface"), F.lit(in_lexicon).alias("in_lexicon"))

    def own(text: Column, at: Column) -> Column:
        unknown = F.regexp_extract_all(text, F.lit(SCRIPT_RUN), F.lit(0))
        return F.when(at % 2 == 1, F.array(piece(text, True))).otherwise(
            F.transform(unknown, lambda x: piece(x, False))
        )

    keys = [c for c in sentences.columns if c != "sentence"]
    tokens = cut.select(
        *keys, F.posexplode(F.flatten(F.transform("pieces", own))).alias("at", "t")
    ).select(*keys, F.col("at").cast("bigint").alias("token_idx"), "t.surface", "t.in_lexicon")
    # No term starts within unknown text, so a token that is no term finds no features.
    features = broadcast_if_small(terms.where(F.col("features").isNotNull()))
    found = tokens.join(features, F.col("surface") == F.col("term"), "left").drop("term")
    return project_features(found)


def _walker() -> Callable[[str, Callable[[int], int]], list[str]]:
    """Made here, like the analysers of ``tokenize_with``, so that it travels by value."""

    def walk(text: str, length_at: Callable[[int], int]) -> list[str]:
        """Unknown text and terms by turns, beginning and ending with unknown text."""
        out, done, at = [], 0, 0
        while at < len(text):
            length = length_at(at)
            if length:
                out += [text[done:at], text[at : at + length]]
                done = at = at + length
            else:
                at += 1
        return [*out, text[done:]]

    return walk


def trie_of(terms: list[str]) -> dict[str, np.ndarray]:
    """A trie as arrays: edges sorted by (state, character), the state each leads to, and which states end a term.

    Built level by level over all terms at once. State 0 is the root; ``first`` is its edge for every character.
    """
    size = np.array([len(t) for t in terms], np.int64)
    letters = np.frombuffer("".join(terms).encode("utf-32-le"), np.uint32).astype(np.int64)
    start = np.cumsum(size) - size
    state = np.zeros(len(terms), np.int64)
    keys, states = [], 1
    for depth in range(int(size.max()) if len(size) else 0):
        own = np.flatnonzero(size > depth)
        edges, place = np.unique(state[own] << 21 | letters[start[own] + depth], return_inverse=True)
        state[own] = states + place
        keys.append(edges)
        states += len(edges)
    key = np.concatenate([np.zeros(0, np.int64), *keys])
    order = np.argsort(key)
    ends = np.zeros(states, bool)
    ends[state[size > 0]] = True
    first = np.zeros(0x110001, np.int32)
    if keys:
        first[keys[0]] = 1 + np.arange(len(keys[0]))
    return {"key": key[order], "to": (order + 1).astype(np.int32), "ends": ends, "first": first}


def _matcher(known: DataFrame) -> Callable[[Column], Column]:
    """Pieces of a sentence by a small lexicon, which every worker holds as a trie.

    All sentences of a batch are one buffer of characters with a mark between them. All positions go down the trie
    together, a level at a time, until none has an edge; that leaves the longest term at each position.
    From the left, the next term is the first that starts behind the last one taken. Pieces are cut
    out of the buffer by their offsets.
    """
    shared = known.sparkSession.sparkContext.broadcast(trie_of(known.toArrow().column(0).to_pylist()))

    def longest(codes: np.ndarray) -> np.ndarray:
        trie = shared.value
        state = trie["first"][codes]
        at = np.flatnonzero(state)
        state, size = state[at].astype(np.int64), np.zeros(len(codes), np.int64)
        depth = 1
        while len(at):
            size[at[trie["ends"][state]]] = depth
            inside = at + depth < len(codes)
            at, state = at[inside], state[inside]
            wanted = state << 21 | codes[at + depth]
            edge = np.minimum(np.searchsorted(trie["key"], wanted), len(trie["key"]) - 1)
            hit = trie["key"][edge] == wanted
            at, state, depth = at[hit], trie["to"][edge[hit]].astype(np.int64), depth + 1
        return size

    def cut(texts: list[str]) -> pa.Array:
        codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le"), np.uint32).astype(np.int64)
        ends = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64)) - 1
        codes[ends] = 0x110000  # a character that no term holds
        size = longest(codes)
        starts = np.flatnonzero(size)
        behind = np.searchsorted(starts, starts + size[starts]).tolist()
        taken, k = [], 0
        while k < len(behind):
            taken.append(k)
            k = behind[k]
        begun = starts[np.array(taken, np.int64)]
        width = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
        width[ends] = 0
        offset = np.concatenate([[0], np.cumsum(width)])
        # A piece ends where a term starts or ends, and where a sentence does.
        cuts = np.sort(np.concatenate([begun, begun + size[begun], ends]))
        text = "".join(texts).encode()
        offsets = pa.py_buffer(np.concatenate([[0], offset[cuts]]).astype(np.int32))
        values = pa.StringArray.from_buffers(len(cuts), offsets, pa.py_buffer(text))
        counts = 1 + 2 * np.diff(np.concatenate([[0], np.searchsorted(begun, ends)]))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)

    def match(texts: pa.Array) -> pa.Array:
        parts, rows, letters = [], [], 0
        for text in texts.to_pylist():
            rows.append(text or "")
            letters += len(rows[-1])
            if letters > PIECE_LETTERS:
                parts.append(cut(rows))
                rows, letters = [], 0
        return pa.concat_arrays([*parts, cut(rows)] if rows or not parts else parts)

    return F.arrow_udf(match, T.ArrayType(T.StringType()))


def _hit_taker() -> Callable[[Column, Column], Column]:
    """Pieces of a sentence by its hits: position times 2^32 plus length."""
    walk = _walker()

    def take(texts: pd.Series, hits: pd.Series) -> pd.Series:
        def pieces(text: str, own: list[int]) -> list[str]:
            longest = {hit >> 32: hit & 0xFFFFFFFF for hit in sorted(own)}
            return walk(text, lambda at: longest.get(at, 0))

        both = zip(texts, hits, strict=True)
        return pd.Series([pieces(t or "", h.tolist()) for t, h in both], dtype=object)

    return F.pandas_udf(take, T.ArrayType(T.StringType()))


def _with_hits(sentences: DataFrame, known: DataFrame) -> DataFrame:
    """Add ``hits`` by joining the spans of the text that a term could cover.

    A sentence is cut into chunks, each with the text that a term may reach into, so that
    finding a span costs no more than its chunk however long the sentence is.
    """
    keys = [c for c in sentences.columns if c != "sentence"]
    longest = known.agg(F.max(F.length("term"))).first()[0] or 1
    heads = known.groupBy(F.substring("term", 1, 2).alias("head")).agg(
        F.collect_set(F.length("term")).alias("lens")
    )
    chunk = rf"(?s)(?=(.{{1,{CHUNK + longest - 1}}})).{{1,{CHUNK}}}"
    chunks = sentences.select(
        *keys,
        F.posexplode(F.regexp_extract_all("sentence", F.lit(chunk), F.lit(1))).alias("no", "chunk"),
    )
    start = F.explode(F.sequence(F.lit(1), F.least(F.length("chunk"), F.lit(CHUNK))))
    ahead = F.substring(F.col("chunk"), F.col("start"), F.lit(longest))
    spots = chunks.select(*keys, "no", "chunk", start.alias("start")).select(
        *keys,
        (F.col("no").cast("bigint") * CHUNK + F.col("start") - 1).alias("spot"),
        ahead.alias("ahead"),
    )
    begins = F.array_distinct(F.array(F.substring("ahead", 1, 1), F.substring("ahead", 1, 2)))
    spans = (
        spots.select(*keys, "spot", "ahead", F.explode(begins).alias("head"))
        .join(broadcast_if_small(heads), "head")
        .select(*keys, "spot", "ahead", F.explode("lens").alias("len"))
        .where(F.length("ahead") >= F.col("len"))
        .withColumn("term", F.substring(F.col("ahead"), F.lit(1), F.col("len")))
        .join(broadcast_if_small(known), "term", "left_semi")
    )
    hits = spans.select(
        *keys,
        F.lit(None).cast("string").alias("sentence"),
        (F.shiftleft("spot", 32) + F.col("len")).alias("hit"),
    )
    whole = sentences.select(*keys, "sentence", F.lit(None).cast("bigint").alias("hit"))
    return whole.unionAll(hits).groupBy(*keys).agg(
        F.max("sentence").alias("sentence"), F.collect_list("hit").alias("hits")
    )
