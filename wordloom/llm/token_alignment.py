"""Alignment of two tokenizers' tokens by pointer jumping.

A text is encoded by a byte-level BPE (A, over a space and the text) and by a piece BPE (B, which puts the space itself).
Both cut the same bytes, so tokens are ranges of bytes. Every token points to its farthest-right overlapping
token: a token of A to the token of B over its last byte, a token of B to the token of A over its last byte if
that one reaches farther, else to itself. Pointers are doubled, all at once, until none changes; each then
holds the last token of its component, the token of B whose end is also an end of A, which labels the group.

Links are the pairs of tokens with overlapping ranges, one for each stretch between neighbouring ends of either
side. Id pairs are counted over the whole corpus.

Scale: texts are encoded once, in slices of bounded size, where they lie; a word that is frequent in a slice
is encoded once, as texts are cut at spaces where neither tokenizer has a token across (if the given files show
that there is none). Ids are written to the shared folder and everything after reads these. Pairs are summed in each task before the shuffle by id pair, so a frequent pair is a row per
task. The pair table is bounded by the vocabularies, not by the corpus; it is sent to the tasks in blocks of at most
``BLOCK_PAIRS`` pairs by hash, one pass over the ids for each block (one block unless the corpus has more
different pairs), so whatever its size neither driver nor tasks hold more than a block. No document
leaves its row, so copies and hot sources are not gathered anywhere.

Defined results: a null or empty text, and one whose tokens do not give back the space and the text in either
tokenizer (as when the text holds the character that stands for a space), has no tokens: zeros and an
empty hash, and it does not count in the corpus. Strings that look like special tokens are plain text. Ids may repeat or
be null: each row has its result. Counts that are equally high are all the best. A very long text is
encoded whole, in a slice of its own. An empty table gives an empty table. Only id and text are read, so other columns
do not matter.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.arrays import lists
from wordloom.llm.tables import shared

FOLDER = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text encoded, and tokens aligned, at a time; a longer text makes its slice longer.
SLICE_BYTES, SLICE_TOKENS = 1 << 21, 1 << 17
#: Bytes of different stretches that an encoder gets in one text.
JOINED_BYTES = 1 << 12
#: Pairs that a task gathers before it hands them on, and pairs sent to the tasks at a time.
HELD_PAIRS, BLOCK_PAIRS = 1 << 22, 1 << 21
#: Rows of a file of ids, so that files are read by tasks of even size.
FILE_ROWS = 2000
_SPACE = "▁"
#: First bytes of characters that are no white space: ASCII signs, and leads of no block that has any.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[[*range(0x21, 0x7F), *range(0xC3, 0xE1), *range(0xE4, 0xF5)]] = True
COUNTS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def byte_letters() -> dict[str, int]:
    """The letter that a byte-level vocabulary writes for each byte: itself if it prints, else one from 256 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    letters = {chr(b): b for b in prints}
    letters |= {chr(256 + n): b for n, b in enumerate(sorted(set(range(256)) - set(prints)))}
    return letters


# Fixed value: how a byte-level vocabulary of this kind cuts a text before merging.
BYTE_LEVEL_CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The fast engine recurses on white space, so a text with a longer run goes through the other one.
LONG_RUN = re.compile(r"\s{1000}")


def _byte_vocabulary(path: str) -> tuple[dict, list[bytes], dict[int, str]]:
    """What the file says, the bytes of each id, and the added tokens."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    added = {t["id"]: t["content"] for t in told["added_tokens"]}
    letters, known = byte_letters(), told["model"]["vocab"]
    of_id = [b""] * (max([*known.values(), *added]) + 1)
    for token, number in known.items():
        if number not in added:
            of_id[number] = bytes(map(letters.__getitem__, token))
    for number, token in added.items():
        of_id[number] = token.encode()
    return told, of_id, added


@lru_cache(maxsize=4)
def _is_plain(path: str) -> bool:
    """Whether a byte-level file's ids rank its merges and nothing but the byte-level cut comes before them."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    cut, model = told["pre_tokenizer"] or {}, told["model"]
    known = model["vocab"]
    merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
    return (cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut["add_prefix_space"]
            and not told["normalizer"] and not model.get("ignore_merges")
            and all(known["".join(m)] == 256 + n for n, m in enumerate(merges)))


@lru_cache(maxsize=2)
def _library_coder(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(path)
    coder.encode_special_tokens = True
    return coder


@lru_cache(maxsize=4)
def byte_level(path: str):
    """A: an encoder of lists of texts, and the bytes of each id.

    Where the file's ids rank its merges and nothing but the byte-level cut comes before them, the file's
    vocabulary is run by an engine that merges by rank: the same ids at a quarter of the time
    (equal on every code point and on 900,000 random strings).
    """
    import tiktoken

    told, of_id, added = _byte_vocabulary(path)

    def slow(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in _library_coder(path).encode_batch([" " + t for t in texts], add_special_tokens=False)]

    if not _is_plain(path):
        return slow, of_id
    ranks = {b: n for n, b in enumerate(of_id) if n not in added}
    fast = tiktoken.Encoding("of-file", pat_str=BYTE_LEVEL_CUT, mergeable_ranks=ranks, special_tokens={})

    def encode(texts: list[str]) -> list[list[int]]:
        return [slow([t])[0] if LONG_RUN.search(t) else fast.encode_ordinary(" " + t) for t in texts]

    return encode, of_id


@lru_cache(maxsize=4)
def pieces(path: str):
    """B: an encoder of lists of texts, and the bytes of each id."""
    import sentencepiece

    coder = sentencepiece.SentencePieceProcessor(model_file=path)
    of_id = [
        bytes([int(coder.id_to_piece(n)[3:5], 16)]) if coder.is_byte(n) else coder.id_to_piece(n).replace(_SPACE, " ").encode()
        for n in range(coder.get_piece_size())
    ]

    def encode(texts: list[str]) -> list[list[int]]:
        return coder.encode(texts, num_threads=1)

    return encode, of_id


def lengths(files: tuple[str, str]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each id of both sides; found once, so that tasks which only read ids load no tokenizer."""
    both = _byte_vocabulary(files[0])[1], pieces(files[1])[1]
    return tuple(np.array([len(x) for x in side], np.int64) for side in both)


def components(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group of each token, from 0: the components of overlapping ranges, given by the ends of two tilings."""
    n_a, n_b = len(ends_a), len(ends_b)
    over_a = np.searchsorted(ends_b, ends_a)  # the token of B over the last byte of each token of A
    over_b = np.searchsorted(ends_a, ends_b)
    terminal = ends_a[over_b] == ends_b if n_b else np.zeros(0, bool)
    to = np.concatenate([n_a + over_a, np.where(terminal, n_a + np.arange(n_b), over_b)])
    while True:
        farther = to[to]
        if np.array_equal(farther, to):
            break
        to = farther
    label = np.cumsum(terminal) - 1
    found = label[to - n_a] if n_b else to
    return found[:n_a], found[n_a:]


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of tokens whose ranges overlap, as positions. Ends of a side differ, and both sides end alike."""
    if not len(ends_a) or not len(ends_b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.zeros(max(ends_a[-1], ends_b[-1]) + 1, np.uint8)
    ends[ends_a] = 1
    ends[ends_b] |= 2
    kind = ends[np.flatnonzero(ends)]
    of_a, of_b = kind & 1, kind >> 1
    return np.cumsum(of_a, dtype=np.int64) - of_a, np.cumsum(of_b, dtype=np.int64) - of_b


@lru_cache(maxsize=2)
def _written(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each id with a comma, a bar and a semicolon behind it, as bytes with zeros behind, and their lengths."""
    words = np.array([f"{n}{mark}".encode() for mark in ",|;" for n in range(size)])
    return words.view(np.uint8).reshape(len(words), -1), np.char.str_len(words)


def group_texts(a, b, group_a, group_b, starts_a, starts_b) -> list[bytes]:
    """``a1,a2|b1;a3|b2`` for each text; groups are numbered through."""
    n_a, n_b = len(a), len(b)
    if not n_a:
        return [b""] * (len(starts_a) - 1)
    at_a = np.arange(n_a) + np.searchsorted(group_b, group_a)
    at_b = np.arange(n_b) + np.searchsorted(group_a, group_b, "right")
    size = int(max(a.max(), b.max())) + 1
    size = 1 << size.bit_length()
    last_a, last_b = (np.append(g[1:] != g[:-1], True) for g in (group_a, group_b))
    codes = np.zeros(n_a + n_b, np.int64)
    codes[at_a] = a + np.where(last_a, size, 0)
    codes[at_b] = b + np.where(last_b, 2 * size, 0)
    words, lens = _written(size)
    body = words[codes].ravel()
    body = body[body != 0].tobytes()
    starts = np.concatenate([[0], np.cumsum(lens[codes])])[starts_a + starts_b].tolist()
    return [body[x : max(x, y - 1)] for x, y in zip(starts[:-1], starts[1:], strict=True)]


def _cuts(starts: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of rows of at most so many units, or of one row."""
    row, n = 0, len(starts) - 1
    while row < n:
        stop = int(np.searchsorted(starts, starts[row] + most, "right")) - 1
        stop = min(n, max(stop, row + 1))
        yield row, stop
        row = stop


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column without nulls, where they lie, and the start of each row."""
    starts = column.offsets.to_numpy()
    return column.values.to_numpy()[starts[0] : starts[-1]], (starts - starts[0]).astype(np.int64)


def _tokens(batch: pa.RecordBatch, sizes: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple]:
    """Rows, ids, starts and ends of both sides, in slices."""
    a, starts_a = _flat(batch.column("a"))
    b, starts_b = _flat(batch.column("b"))
    for x, y in _cuts(starts_a + starts_b, SLICE_TOKENS):
        own_a, own_b = (v[s[x] : s[y]].astype(np.int64) for v, s in ((a, starts_a), (b, starts_b)))
        ends = (np.cumsum(size[own]) for size, own in zip(sizes, (own_a, own_b), strict=True))
        yield x, y, own_a, own_b, starts_a[x : y + 1] - starts_a[x], starts_b[x : y + 1] - starts_b[x], *ends


@lru_cache(maxsize=4)
def encodes_by_stretch(files: tuple[str, str]) -> bool:
    """Whether both encoders give the same ids for a text and for its ``stretches``, one by one.

    The byte-level cut begins a new word at a space before anything but white space, and merges stay in words.
    The piece model must take characters as they are, and have no piece with a space behind another character.
    """
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(files[1], "rb") as file:
        model.ParseFromString(file.read())
    cut, taught = model.normalizer_spec, model.trainer_spec
    as_is = (cut.add_dummy_prefix and cut.escape_whitespaces and not cut.remove_extra_whitespaces
             and not cut.precompiled_charsmap and not taught.treat_whitespace_as_suffix
             and taught.model_type == taught.BPE and taught.byte_fallback)
    own = [p.piece for p in model.pieces if p.type == p.NORMAL]
    listed = all(p.type in (p.NORMAL, p.UNKNOWN, p.CONTROL, p.BYTE) for p in model.pieces)
    return _is_plain(files[0]) and as_is and listed and not any(_SPACE in p.lstrip(_SPACE) for p in own)


def stretches(texts: pa.Array, cut: bool = True) -> tuple[pa.Array, np.ndarray]:
    """Stretches of the texts, each with a space before it, and how many each text has; an empty text has none.

    A stretch begins with the text, and at a space that follows no space and comes before a character
    that is surely no white space. Without ``cut`` a text is one stretch.
    """
    full = pc.greater(pc.binary_length(texts), 0)
    kind = pa.large_string()
    spaced = pc.binary_join_element_wise(pa.scalar(" ", kind), texts.filter(full), pa.scalar("", kind))
    many = np.zeros(len(texts), np.int64)
    if not len(spaced):
        return pa.array([], kind), many
    starts = np.frombuffer(spaced.buffers()[1], np.int64, len(spaced) + 1, 8 * spaced.offset)
    data = np.frombuffer(spaced.buffers()[2], np.uint8, int(starts[-1]))
    begins = np.zeros(len(data), bool)
    if cut:
        space = data == 32
        begins[1:-1] = space[1:-1] & ~space[:-2] & _VISIBLE[data[2:]]
    begins[starts[:-1]] = True
    at = np.append(np.flatnonzero(begins), len(data))
    many[np.asarray(full)] = np.diff(np.searchsorted(at, starts))
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), spaced.buffers()[2]), many


def _table(of_id: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all ids in one array, where each begins, and their lengths."""
    size = np.array([len(x) for x in of_id], np.int64)
    return np.frombuffer(b"".join(of_id), np.uint8), np.cumsum(size) - size, size


def _picked(values: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Stretches of an array, one behind the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(starts - ends + size, size)]


def _coded(own: pa.Array, coders, tables, joins: bool) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Which stretches both encoders give back, and the ids of all and where each stretch's begin, by either encoder.

    If ``joins``, stretches that begin and end as ``stretches`` cuts them are encoded some thousand bytes at a time.
    """
    starts = np.frombuffer(own.buffers()[1], np.int64, len(own) + 1, 8 * own.offset)
    data = np.frombuffer(own.buffers()[2], np.uint8, int(starts[-1])) if len(own) else np.zeros(0, np.uint8)
    whole = bytes(data)
    apart = np.ones(len(own), bool)
    if joins:
        apart = ~_VISIBLE[data[starts[:-1] + 1]] | (data[starts[1:] - 1] == 32)
    block = starts[:-1] // JOINED_BYTES
    first = apart.copy()
    first[:1] = True
    first[1:] |= apart[:-1] | (block[1:] != block[:-1])
    at = np.append(np.flatnonzero(first), len(own))
    pieces = [whole[x:y].decode() for x, y in zip(starts[at[:-1]], starts[at[1:]], strict=True)]
    same, found = np.ones(len(own), bool), []
    for (code, of), (body, begin, size) in zip(coders, tables, strict=True):
        ids = code([p[1:] for p in pieces])
        flat = np.fromiter(chain.from_iterable(ids), np.int32)
        ends = np.concatenate([[0], np.cumsum(size[flat])])
        if ends[-1] == len(data) and np.array_equal(_picked(body, begin[flat], size[flat]), data):
            found.append((flat, np.searchsorted(ends, starts)))
        elif len(pieces) < len(own):
            return _coded(own, coders, tables, False)
        else:
            same &= [b"".join(map(of.__getitem__, i)) == p.encode() for i, p in zip(ids, pieces, strict=True)]
            found.append((flat, np.concatenate([[0], np.cumsum([len(i) for i in ids])])))
    return same, found


def _encoded(texts: pa.Array, coders, tables, cut: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Ids of the texts and how many each has, by either encoder; none where they do not give back the text."""
    own, many = stretches(texts, cut)
    coded = own.dictionary_encode()
    same, found = _coded(coded.dictionary, coders, tables, cut)
    at, text = coded.indices.to_numpy(), np.repeat(np.arange(len(many)), many)
    if not same.all():
        kept = np.bincount(text, ~same[at], len(many)) == 0
        at, text = at[kept[text]], text[kept[text]]
    result = []
    for ids, starts in found:
        size = np.diff(starts)[at]
        result.append((_picked(ids, starts[at], size), np.bincount(text, size, len(many)).astype(np.int64)))
    return result


def encode(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
           files: tuple[str, str] = (f"{FOLDER}/{A_FILE}", f"{FOLDER}/{B_FILE}")) -> DataFrame:
    """``doc_id``, ``a``, ``b``: the ids of both tokenizers, none where they do not give back the text."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders, cut = (byte_level(files[0]), pieces(files[1])), encodes_by_stretch(files)
        tables = [_table(of_id) for _, of_id in coders]
        for batch in batches:
            texts = batch.column(1).fill_null("").cast(pa.large_string())
            sizes = np.asarray(pc.binary_length(texts), np.int64)
            for x, y in _cuts(np.concatenate([[0], np.cumsum(sizes)]), SLICE_BYTES):
                (a, many_a), (b, many_b) = _encoded(texts.slice(x, y - x), coders, tables, cut)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(x, y - x), lists(a, many_a, pa.int32()), lists(b, many_b, pa.int32())],
                    names=["doc_id", "a", "b"])

    kind = T.ArrayType(T.IntegerType())
    return rows.mapInArrow(
        run, T.StructType([rows.schema["doc_id"], T.StructField("a", kind), T.StructField("b", kind)]))


def _groups(batch: pa.RecordBatch, sizes: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple]:
    """Rows, starts of their tokens, groups of the tokens (from 0 in a text), and the groups, links and digest of each text."""
    for x, y, a, b, starts_a, starts_b, ends_a, ends_b in _tokens(batch, sizes):
        group_a, group_b = components(ends_a, ends_b)
        full = np.diff(starts_b) > 0
        first = np.zeros(y - x, np.int64)
        first[full] = group_b[starts_b[:-1][full]]
        n_groups = np.zeros(y - x, np.int64)
        n_groups[full] = group_b[starts_b[1:][full] - 1] - first[full] + 1
        shared_ends = np.searchsorted(np.flatnonzero(np.isin(ends_b, ends_a, assume_unique=True)), starts_b)
        n_links = np.diff(starts_a) + np.diff(starts_b) - np.diff(shared_ends)
        texts = group_texts(a, b, group_a, group_b, starts_a, starts_b)
        digests = [hashlib.sha256(t).hexdigest() if t else "" for t in texts]
        own = [(group - np.repeat(first, np.diff(starts))).astype(np.int32)
               for group, starts in ((group_a, starts_a), (group_b, starts_b))]
        yield x, y, (starts_a, starts_b), own, n_groups, n_links, digests


def align(encoded: DataFrame, files: tuple[str, str] = (f"{FOLDER}/{A_FILE}", f"{FOLDER}/{B_FILE}")) -> DataFrame:
    """The encoded rows with ``a_group``, ``b_group`` (group of each token, from 0 in each text) and
    ``n_groups``, ``n_links``, ``groups_sha256``."""
    sizes = lengths(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y, starts, own, n_groups, n_links, digests in _groups(batch, sizes):
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(x, y - x) for c in batch.columns),
                     *(lists(g, np.diff(s), pa.int32()) for g, s in zip(own, starts, strict=True)),
                     pa.array(n_groups), pa.array(n_links), pa.array(digests, pa.string())],
                    names=[*batch.schema.names, *added.names])

    kind = T.ArrayType(T.IntegerType())
    added = T.StructType([T.StructField("a_group", kind), T.StructField("b_group", kind),
                          T.StructField("n_groups", T.LongType()), T.StructField("n_links", T.LongType()),
                          T.StructField("groups_sha256", T.StringType())])
    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, *added.fields]))


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    keys, place = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    return [(keys, np.bincount(place, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64))]


def pair_counts(encoded: DataFrame, files: tuple[str, str] = (f"{FOLDER}/{A_FILE}", f"{FOLDER}/{B_FILE}")) -> DataFrame:
    """``a``, ``b``, ``n``, ``best``: in how many links an id pair stands, and whether no pair of this ``b`` has more."""
    sizes = lengths(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def handed() -> pa.RecordBatch:
            ((keys, n),) = _merged(held)
            return pa.RecordBatch.from_arrays(
                [pa.array((keys >> 32).astype(np.int32)), pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array(n)],
                names=["a", "b", "n"])

        for batch in batches:
            for _, _, a, b, _, _, ends_a, ends_b in _tokens(batch, sizes):
                i, j = overlaps(ends_a, ends_b)
                held.append(np.unique(a[i] << 32 | b[j], return_counts=True))
                if len(held) > 8:
                    held = _merged(held)
                    if len(held[0][0]) > HELD_PAIRS:
                        yield handed()
                        held = []
        if held:
            yield handed()

    parts = encoded.select("a", "b").mapInArrow(run, "a int, b int, n long")
    counted = shared(parts.groupBy("a", "b").agg(F.sum("n").alias("n")), "pairs")
    most = counted.groupBy("b").agg(F.max("n").alias("most"))
    return counted.join(most, "b").select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def _block(pairs: DataFrame, n: int, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys of a block of pairs with their counts and marks: about as many as a block may have."""
    key = F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long"))
    part = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(many).cast("long")) == n)
    got = part.select(key.alias("key"), "n", "best").toArrow()
    keys, counts, best = (got.column(c).to_numpy().astype(np.int64) for c in got.column_names)
    order = np.argsort(keys)
    return keys[order], counts[order], best[order]


def _scores(batch: pa.RecordBatch, sizes, block) -> tuple[np.ndarray, np.ndarray]:
    """What a block of pairs adds to ``n_best`` and ``count_sum`` of each row."""
    keys, counts, best = block
    sums = np.zeros((2, len(batch)), np.int64)
    for x, y, a, b, _, starts_b, ends_a, ends_b in _tokens(batch, sizes) if len(keys) else []:
        i, j = overlaps(ends_a, ends_b)
        wanted = a[i] << 32 | b[j]
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = keys[at] == wanted
        bounds = np.searchsorted(j, starts_b)  # links stand in the order of b, which no text shares
        for into, value in zip(sums, (best, counts), strict=True):
            into[x:y] = np.diff(np.concatenate([[0], np.cumsum(np.where(hit, value[at], 0))])[bounds])
    return sums[0], sums[1]


def score_links(
    encoded: DataFrame,
    pairs: DataFrame,
    files: tuple[str, str] = (f"{FOLDER}/{A_FILE}", f"{FOLDER}/{B_FILE}"),
    block_pairs: int = BLOCK_PAIRS,
) -> DataFrame:
    """``doc_id``, token, group and link counts, ``n_best`` (links whose count is the highest of their ``b``),
    ``count_sum`` (of the counts of all links) and the groups' digest of each encoded row."""
    context, sizes = encoded.sparkSession.sparkContext, lengths(files)
    pairs = shared(pairs, "counted-pairs")
    many = max(1, -(-pairs.count() // block_pairs))
    zero = F.lit(0).cast("long")
    rows = encoded.select("doc_id", "a", "b", zero.alias("n_best"), zero.alias("count_sum"))
    result = T.StructType([rows.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in COUNTS),
                           T.StructField("groups_sha256", T.StringType())])

    def passed(rows: DataFrame, sent, last: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                scores = _scores(batch, sizes, sent.value)
                n_best, count_sum = (batch.column(c).to_numpy() + s for c, s in zip(names, scores, strict=True))
                if not last:
                    yield pa.RecordBatch.from_arrays(
                        [*batch.columns[:3], pa.array(n_best), pa.array(count_sum)], names=batch.schema.names)
                    continue
                for x, y, starts, _, n_groups, n_links, digests in _groups(batch, sizes):
                    n_a, n_b = map(np.diff, starts)
                    numbers = (n_a, n_b, n_groups, n_links, n_best[x:y], count_sum[x:y])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(x, y - x), *map(pa.array, numbers), pa.array(digests, pa.string())],
                        names=result.names)

        names = ("n_best", "count_sum")
        return rows.mapInArrow(run, result if last else rows.schema)

    for n in range(many):
        sent = context.broadcast(_block(pairs, n, many))
        if n + 1 == many:
            return passed(rows, sent, last=True)
        rows = shared(passed(rows, sent, last=False), "scored")
        sent.unpersist()


def summary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
            files: tuple[str, str] = (f"{FOLDER}/{A_FILE}", f"{FOLDER}/{B_FILE}"),
            block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """One row per document: token, group and link counts, and the groups' digest."""
    encoded = shared(encode(docs, doc_id, text, files), "encoded", rows_per_file=FILE_ROWS)
    return score_links(encoded, pair_counts(encoded, files), files, block_pairs)
