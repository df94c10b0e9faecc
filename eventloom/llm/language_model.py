"""An n-gram language model in Elias-Fano tries, trained on part of the documents and scoring all of them.

The model is dealt over shards by context, each a trie of three compact levels: the contexts (hashes, Elias-Fano coded),
monotone pointers from a context to its successors, and the successors, each written as (place of its context, word) so
that the whole level is one increasing sequence. A word is found by searching for the successor of that pair between the
context's pointers. Beside them lie quantised logarithms: of a word's share after its context, and of the weight that
the context leaves to the shorter one. Shards are written to a file and memory-mapped while they are queried.

Smoothing interpolates all orders: p(w | c) = n(c, w) / (n(c) + m) + m / (n(c) + m) · p(w | shorter c), down to
(n(w) + 0.5) / (N + 0.5 (V + 1)).

Texts are read once, into blocks of documents with a vocabulary of their own. For each order a block sends to each shard
the distinct n-grams it holds, with its training counts; the shard adds up the blocks' counts, builds its trie, and answers with two
codes for each n-gram asked for. So what moves are distinct n-grams per block, however often they occur, and nothing
grows with the corpus on the driver or in a task. Contexts with a large share of all tokens, of any number of words, are split by
word. They are known from the order below, where each was an n-gram: its key follows from that n-gram's context and word, and its total is the
n-gram's count.
"""

from __future__ import annotations

import mmap
import os
import re
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import stage
from .common import code_points, fold, lower_ascii, mix64, pack, powers, read, word_bounds, word_hashes
from .elias_fano import EliasFano

BLOCK_TOKENS = 1_000_000
SHARD_GRAMS = 2_000_000
MASS = 100.0  # m above
HEAVY_CONTEXTS = 4096
CONTEXT_BITS = 48
STEP = 1 / 31.0  # of a quantised decimal logarithm; code 0 is "not there", 1 is 0, 255 is about -8.2
END, START = np.uint64(0x1B873593CC9E2D51), np.uint64(0x52DCE729DA3ED2B5)
_U64 = np.uint64
PIECE = 1 << 18  # code points hashed at a time
BLANK = re.compile(r"[\x20\x09-\x0D]")


def quantise(logs: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-logs / STEP) + 1, 1, 255).astype(np.uint8)


def restore(codes: np.ndarray) -> np.ndarray:
    """The numbers whose logarithms were quantised; 0 where the code says that there is none."""
    table = np.concatenate(([0.0], 10 ** (-STEP * np.arange(255))))
    return table[codes]


# ---- blocks of documents

_BLOCK = T.StructType(
    [T.StructField("block", T.LongType()), T.StructField("doc_ids", T.ArrayType(T.LongType()))]
    + [T.StructField(n, T.BinaryType()) for n in ("held", "lengths", "tokens", "vocabulary", "counts")]
)


def tokens_of(text: str | None) -> np.ndarray:
    """Hashes of the words of a whole text, A-Z in lower case, and of the end."""
    text, parts, at = lower_ascii(text or ""), [], 0
    while at < len(text):  # a long text in pieces, cut before blanks
        cut = BLANK.search(text, at + PIECE)
        points = code_points(text[at : cut.start() if cut else len(text)])
        parts.append(word_hashes(points, *word_bounds(points)))
        at += len(points)
    return np.concatenate([*parts, np.array([END])])


def _blocks(docs: DataFrame, size: int) -> DataFrame:
    def pack_block(ids, held, texts, number) -> pa.RecordBatch:
        lengths = np.array([len(t) for t in texts], np.int32)
        vocabulary, tokens = np.unique(np.concatenate(texts), return_inverse=True)
        counts = np.bincount(tokens[~np.repeat(np.array(held, bool), lengths)], minlength=len(vocabulary))
        # frequent words get small numbers, whose upper bytes are mostly zero and compress
        order = np.argsort(-np.bincount(tokens, minlength=len(vocabulary)), kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        planes = place[tokens].astype("<u4").view(np.uint8).reshape(-1, 4).T
        columns = [[number], [ids], [pack(np.array(held, np.uint8))], [pack(lengths)], [pack(planes)]]
        columns += [[pack(vocabulary[order])], [pack(counts[order].astype(np.uint32))]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    schema = to_arrow_schema(_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, held, texts, n = TaskContext.get().partitionId() << 24, [], [], [], 0
        for batch in batches:
            for doc_id, out, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "held", "text"))):
                ids.append(doc_id), held.append(out), texts.append(tokens_of(text))
                n += len(texts[-1])
                if n >= size:
                    yield pack_block(ids, held, texts, number)
                    number, ids, held, texts, n = number + 1, [], [], [], 0
        if ids:
            yield pack_block(ids, held, texts, number)

    return docs.mapInArrow(run, _BLOCK)


#: Contexts that are split, each with its total and its number of parts.
Heavy = dict[int, tuple[int, int]]


class Block:
    def __init__(self, row: dict):
        self.ids = row["doc_ids"]
        self.held = np.frombuffer(row["held"], np.uint8).astype(bool)
        self.lengths = np.frombuffer(row["lengths"], np.int32).astype(np.int64)
        planes = np.frombuffer(row["tokens"], np.uint8).reshape(4, -1)
        self.tokens = np.ascontiguousarray(planes.T).view("<u4").ravel()
        self.vocabulary = np.frombuffer(row["vocabulary"], _U64)
        self.counts = np.frombuffer(row["counts"], np.uint32)

    def grams(self, n: int, heavy: Heavy):
        """Distinct n-grams by context and word: contexts, successors of each, words, training counts, and each token's n-gram.

        The last two results are each token's place among contexts and among n-grams.
        """
        context = context_of(self._before(k) for k in range(n - 1, 0, -1))
        keys_of_words = word_key(self.vocabulary)
        if heavy:
            keys = np.fromiter(heavy, _U64, len(heavy))
            keys.sort()
            parts = np.array([heavy[int(k)][1] for k in keys], _U64)
            found = np.minimum(np.searchsorted(keys, context), len(keys) - 1)
            split = np.flatnonzero(keys[found] == context)
            context[split] = part_key(context[split], keys_of_words[self.tokens[split]] % parts[found[split]])
            del found
        contexts, c = _distinct(context)
        del context
        words, rank = np.unique(keys_of_words, return_inverse=True)  # by rank, a gram and its place fit into one number
        bits = _U64(len(words).bit_length())
        short = c.astype(_U64)
        short <<= bits
        short |= rank.astype(np.uint32)[self.tokens]
        grams, g = _distinct(short)
        del short
        at, words = (grams >> bits).astype(np.uint32), words[grams & ((_U64(1) << bits) - _U64(1))].astype(np.uint32)
        del grams
        counts = np.bincount(g[~np.repeat(self.held, self.lengths)], minlength=len(words)).astype(np.uint32)
        successors = np.bincount(at, minlength=len(contexts)).astype(np.uint32)
        return contexts, successors, words, counts, c, g

    def _before(self, k: int) -> np.ndarray:
        """The hash of the word ``k`` places before each token, START before the start of its text."""
        words = np.empty(len(self.tokens), _U64)
        words[k:] = self.vocabulary[self.tokens[: len(words) - k]]
        starts = np.cumsum(self.lengths) - self.lengths
        for j in range(k):
            words[starts[self.lengths > j] + j] = START
        return words


def _order(values: np.ndarray) -> np.ndarray:
    """Places of ``values`` in ascending order: numbers that hold a value's upper bits and its place are sorted, which is faster than places are.

    Where lower bits had no room and matter, places are sorted after all.
    """
    bits = max(len(values) - 1, 0).bit_length()
    over = max(0, (int(values.max()).bit_length() if len(values) else 0) + bits - 64)
    packed = values >> _U64(over)
    packed <<= _U64(bits)
    packed |= np.arange(len(values), dtype=np.uint32)
    packed.sort()
    packed &= _U64((1 << bits) - 1)
    order = packed.astype(np.uint32)
    if over:
        found = values[order]
        if (found[1:] < found[:-1]).any():
            return np.argsort(values).astype(np.uint32)
    return order


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and each value's place among them, in 32 bits."""
    order = _order(values)
    values = values[order]
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    place = np.empty(len(values), np.uint32)
    place[order] = np.cumsum(fresh, dtype=np.uint32) - np.uint32(1)
    return values[fresh], place


def _sorted_distinct(values: np.ndarray) -> np.ndarray:
    """Distinct values in order; ``values`` are sorted in place."""
    values.sort()
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[1:] != values[:-1]
    return values[fresh]


def context_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix64(context * _U64(0xC2B2AE3D27D4EB4F) + word)


def context_of(words: Iterable[np.ndarray]) -> np.ndarray:
    """Keys of contexts, given by their words from the first to the last."""
    context = None
    for w in words:
        first = lambda w: context_key(np.full(len(w), 2, _U64), w) & _U64((1 << CONTEXT_BITS) - 1)
        context = first(w) if context is None else longer(context, word_key(w))
    return context


def longer(context: np.ndarray, short: np.ndarray) -> np.ndarray:
    """Keys of the contexts that are a context and its successor."""
    return context_key(context, short.astype(_U64)) & _U64((1 << CONTEXT_BITS) - 1)


def word_key(words: np.ndarray) -> np.ndarray:
    return mix64(words + _U64(0x9E3779B9)) >> _U64(32)


def part_key(context: np.ndarray, part: np.ndarray) -> np.ndarray:
    return mix64(context * _U64(0x2545F4914F6CDD1D) + part + _U64(1)) & _U64((1 << CONTEXT_BITS) - 1)


# ---- messages between blocks and shards; a shard is a range of keys, so the shards' parts of a sorted list are slices of it

_REQUEST = T.StructType(
    [T.StructField("shard", T.LongType()), T.StructField("block", T.LongType())]
    + [T.StructField(n, T.BinaryType()) for n in ("keys", "successors", "words", "counts")]
)
_ANSWER = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("level", "shard", "block")]
    + [T.StructField(n, T.BinaryType()) for n in ("codes", "rest")]
    + [T.StructField(n, T.LongType()) for n in ("key", "n")]  # of a heavy n-gram as a context, or the number of known words
)


def _cuts(keys: np.ndarray, key_bits: int, shard_bits: int) -> np.ndarray:
    """Where the slices of the shards start in sorted keys."""
    if not shard_bits:
        return np.array([0, len(keys)])
    bounds = np.arange(1, 1 << shard_bits, dtype=np.uint64) << _U64(key_bits - shard_bits)
    return np.concatenate(([0], np.searchsorted(keys, bounds), [len(keys)]))


def _requests(blocks: DataFrame, level: int, shard_bits: int, heavy: Heavy) -> DataFrame:
    schema = to_arrow_schema(_REQUEST)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):  # a block at a time
                row = batch.slice(at, 1).to_pylist()[0]
                block = Block(row)
                if level == 1:
                    order = np.argsort(block.vocabulary)
                    keys, counts = block.vocabulary[order], block.counts[order]
                    successors = words = None
                    bits = 64
                else:
                    keys, successors, words, counts, _, _ = block.grams(level, heavy)
                    ends = np.concatenate(([0], np.cumsum(successors, dtype=np.int64)))
                    bits = CONTEXT_BITS
                cuts, out = _cuts(keys, bits, shard_bits), []
                for s in np.flatnonzero(np.diff(cuts)).tolist():
                    a, b = cuts[s], cuts[s + 1]
                    base = _U64(s << (bits - shard_bits)) if shard_bits else _U64(0)
                    u, v = (a, b) if level == 1 else (ends[a], ends[b])
                    coded = EliasFano.of(keys[a:b] - base).to_bytes()
                    out.append((s, row["block"], coded, None if level == 1 else pack(successors[a:b]), None if level == 1 else pack(words[u:v]), pack(counts[u:v])))
                    if len(out) == 64:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return blocks.mapInArrow(run, _REQUEST)


def _answers(rows: list[tuple]) -> pa.Table:
    schema = to_arrow_schema(_ANSWER)
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def _count_words(table: pa.Table, heavy_from: int) -> pa.Table:
    """Level 1: the counts of a shard's words, for each block that asks; the number of known words; frequent ones as contexts."""
    rows = table.to_pylist()
    keys = [EliasFano.from_buffer(r["keys"])[0].all() for r in rows]
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    counts = np.bincount(place, np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in rows]), len(every)).astype(np.int64)
    shard, out, at = rows[0]["shard"], [], 0
    for r, k in zip(rows, keys):
        out.append((1, shard, r["block"], pack(counts[place[at : at + len(k)]]), None, None, None))
        at += len(k)
    out.append((1, shard, None, None, None, None, int((counts > 0).sum())))
    # a word alone is the context of level 2; its hash is kept relative to the shard
    out += [(1, shard, None, None, None, int(every[i].view(np.int64)), int(counts[i])) for i in np.flatnonzero(counts >= heavy_from)]
    return _answers(out)


class Trie:
    """One shard: contexts, pointers and successors in Elias-Fano sequences, and two arrays of codes."""

    def __init__(self, contexts, pointers, successors, shares, rest):
        self.contexts, self.pointers, self.successors, self.shares, self.rest = contexts, pointers, successors, shares, rest

    @classmethod
    def build(cls, context: np.ndarray, word: np.ndarray, count: np.ndarray, totals: dict[int, int], mass: float) -> Trie:
        """From distinct (context, word) in order with counts above 0; ``totals`` of contexts that are split over shards."""
        first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(context) else np.zeros(0, np.int64)
        contexts = context[first]
        sums = np.add.reduceat(count, first) if len(first) else np.zeros(0)
        if totals and len(contexts):
            keys = np.array(sorted(totals), _U64)
            at = np.minimum(np.searchsorted(keys, contexts), len(keys) - 1)
            known = np.array([totals[int(k)] for k in keys], float)
            sums = np.where(keys[at] == contexts, known[at], sums)
        index = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(context))))
        shares = quantise(np.log10(count / (sums[index] + mass)))
        rest = quantise(np.log10(mass / (sums + mass)))
        pairs = index.astype(_U64) << _U64(32) | word.astype(_U64)
        return cls(EliasFano.of(contexts), EliasFano.of(np.append(first, len(context))), EliasFano.of(pairs), shares, rest)

    def to_bytes(self) -> bytes:
        parts = [x.to_bytes() for x in (self.contexts, self.pointers, self.successors)]
        return b"".join([*parts, self.shares.tobytes(), self.rest.tobytes()])

    @classmethod
    def from_buffer(cls, data) -> Trie:
        levels, at = [], 0
        for _ in range(3):
            level, at = EliasFano.from_buffer(data, at)
            levels.append(level)
        n, m = levels[2].n, levels[0].n
        return cls(*levels, np.frombuffer(data, np.uint8, n, at), np.frombuffer(data, np.uint8, m, at + n))

    def look_up(self, contexts: np.ndarray, successors: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the words asked for, ``successors`` many after each context, and of the contexts; 0 where there is none."""
        place, known = self.contexts.successor(contexts)
        rest = np.zeros(len(contexts), np.uint8)
        rest[known] = self.rest[place[known]]
        asked = np.repeat(known, successors)
        at = np.repeat(place, successors)[asked]
        low, high = self.pointers.access(at).astype(np.int64), self.pointers.access(at + 1).astype(np.int64)
        found, equal = self.successors.successor(at.astype(_U64) << _U64(32) | words[asked].astype(_U64), low, high)
        codes = np.zeros(len(words), np.uint8)
        spots = np.flatnonzero(asked)[equal]
        codes[spots] = self.shares[found[equal]]
        return codes, rest


def mapped(data: bytes):
    """``data`` as a memory-mapped file of its own, which goes when the mapping does."""
    with tempfile.TemporaryFile() as file:
        file.write(data)
        file.flush()
        return mmap.mmap(file.fileno(), os.fstat(file.fileno()).st_size, access=mmap.ACCESS_READ)


def _build_and_answer(table: pa.Table, level: int, shard_bits: int, heavy: Heavy, mass: float, heavy_from: int | None) -> pa.Table:
    binary = ("keys", "successors", "words", "counts")  # read where they are: messages are the most that a task holds
    rows = [{"block": b, **{c: table.column(c)[i].as_buffer() for c in binary}} for i, b in enumerate(table.column("block").to_pylist())]
    shard = table.column("shard")[0].as_py()
    base = _U64(shard << (CONTEXT_BITS - shard_bits)) if shard_bits else _U64(0)
    contexts = [EliasFano.from_buffer(r["keys"])[0].all() + base for r in rows]
    successors = [np.frombuffer(r["successors"], np.uint32).astype(np.int64) for r in rows]
    words = [np.frombuffer(r["words"], np.uint32) for r in rows]
    counts = [np.frombuffer(r["counts"], np.uint32) for r in rows]
    every = _sorted_distinct(np.concatenate(contexts))
    ends = np.cumsum([0] + [np.count_nonzero(k) for k in counts])
    pairs = np.empty(ends[-1], _U64)  # of all blocks, each block's distinct and in order: (place of the context, word)
    for a, b, c, s, w, k in zip(ends[:-1], ends[1:], contexts, successors, words, counts):
        pairs[a:b] = (np.repeat(np.searchsorted(every, c).astype(_U64) << _U64(32), s) | w)[k > 0]
    distinct = _sorted_distinct(pairs.copy())
    count = np.zeros(len(distinct))
    for a, b, k in zip(ends[:-1], ends[1:], counts):
        count[np.searchsorted(distinct, pairs[a:b])] += k[k > 0]
    del pairs
    context, word = every[distinct >> _U64(32)], (distinct & _U64(0xFFFFFFFF)).astype(np.uint32)
    del distinct, every
    whole = {int(p): k for k, (_, m) in heavy.items() for p in part_key(np.full(m, k, _U64), np.arange(m, dtype=_U64))}
    file = mapped(Trie.build(context, word, count, {p: heavy[k][0] for p, k in whole.items()}, mass).to_bytes())
    trie = Trie.from_buffer(file)
    out = []
    for r, c, s, w in zip(rows, contexts, successors, words):
        codes, rest = trie.look_up(c, s, w)
        out.append((level, shard, r["block"], pack(codes), pack(rest), None, None))
    often = np.flatnonzero(count >= heavy_from) if heavy_from is not None else np.zeros(0, np.int64)
    if len(often):
        unsplit = np.array([whole.get(int(c), int(c)) for c in context[often]], _U64)
        out += [(level, shard, None, None, None, int(key), int(m)) for key, m in zip(longer(unsplit, word[often]), count[often])]
    return _answers(out)


def _answering(level: int, shard_bits: int, heavy: Heavy, mass: float, heavy_from: int | None):
    return lambda table: _build_and_answer(table, level, shard_bits, heavy, mass, heavy_from)


# ---- the model as a whole


def score_documents(
    docs: DataFrame,
    held: str = "held",
    *,
    order: int = 3,
    mass: float = MASS,
    block_tokens: int = BLOCK_TOKENS,
    shard_grams: int = SHARD_GRAMS,
) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text, ``held``), scored by a model of the rows that are not held.

    doc_id, held_out, n_tokens (words and the end), n_known (tokens seen in training), train_tokens, base_score (the unigram
    score) and score, both decimal logarithms of the probability of the text. Null, empty and blank texts are the end alone.
    Repeated rows count each time; null ids pass through. Without training rows nothing is known and every token gets the same
    score. Words are told apart by 64-bit hashes and successors of one context by 32 bits of them. Contexts with more than
    ``shard_grams`` tokens are split.
    """
    docs = docs.select("doc_id", F.col(held).alias("held"), "text")
    blocks = stage(_blocks(docs, block_tokens), "lm-blocks")
    sums = blocks.select("counts", "held").mapInArrow(_block_sums, "n long, starts long").agg(F.sum("n"), F.sum("starts")).first()
    n, starts = (int(x or 0) for x in sums)
    shard_bits = max(0, (n // shard_grams).bit_length())
    heavy_from = max(shard_grams, n // HEAVY_CONTEXTS)
    parts = lambda total: 16 + 4 * total // shard_grams
    counted = stage(_requests(blocks, 1, shard_bits, {}).groupBy("shard").applyInArrow(lambda t: _count_words(t, heavy_from), _ANSWER), "lm-level-1")
    notes = counted.filter("block IS NULL").select("key", "n").collect()  # a row for each shard, and HEAVY_CONTEXTS at most
    known = sum(r["n"] for r in notes if r["key"] is None)
    frequent = {_context_of([_U64(r["key"] & (2**64 - 1))]): r["n"] for r in notes if r["key"] is not None}
    heavies: list[Heavy] = [{}]  # of each level
    every = counted.filter("block IS NOT NULL")
    for level in range(2, order + 1):
        if starts >= heavy_from:
            frequent[_context_of([START] * (level - 1))] = starts
        heavies.append({key: (total, parts(total)) for key, total in frequent.items()})
        asked = _requests(blocks, level, shard_bits, heavies[-1]).groupBy("shard")
        answering = _answering(level, shard_bits, heavies[-1], mass, heavy_from if level < order else None)
        answers = stage(asked.applyInArrow(answering, _ANSWER), f"lm-level-{level}")
        every = every.union(answers.filter("block IS NOT NULL"))
        if level < order:
            frequent = {r["key"]: r["n"] for r in answers.filter("block IS NULL").select("key", "n").collect()}  # HEAVY_CONTEXTS at most
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    joined = blocks.groupBy("block").cogroup(every.groupBy("block"))
    return joined.applyInArrow(lambda left, right: _score_block(left, right, order, heavies, n, known), schema)


def _context_of(words: list) -> int:
    return int(context_of([np.array([w], _U64) for w in words])[0])


def _block_sums(batches):
    for batch in batches:
        rows = batch.to_pylist()
        tokens = [int(np.frombuffer(r["counts"], np.uint32).sum(dtype=np.int64)) for r in rows]
        starts = [int((np.frombuffer(r["held"], np.uint8) == 0).sum()) for r in rows]
        yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array(starts, pa.int64())], names=["n", "starts"])


def _score_block(left: pa.Table, right: pa.Table, order: int, heavies: list[Heavy], n: int, known: int) -> pa.Table:
    rows = left.to_pylist()
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    if not rows:
        return pa.table([pa.array([], k) for k in kinds], names=list(names))
    block = Block(rows[0])
    level, shard = right.column("level").to_numpy(), right.column("shard").to_numpy()
    by = np.lexsort((shard, level))

    def gather(column: str, of: int, kind) -> np.ndarray:
        return np.frombuffer(b"".join(right.column(column)[int(i)].as_py() for i in by if level[i] == of), kind)

    vocabulary_counts = np.empty(len(block.vocabulary), np.int64)
    vocabulary_counts[np.argsort(block.vocabulary)] = gather("codes", 1, np.int64)
    count = vocabulary_counts[block.tokens]
    p = (count + 0.5) / (n + 0.5 * (known + 1))
    base = np.log10(p)
    for k in range(2, order + 1):
        contexts, successors, words, counts, c, g = block.grams(k, heavies[k - 1])
        share, rest = restore(gather("codes", k, np.uint8)), restore(gather("rest", k, np.uint8))
        rest = np.where(rest > 0, rest, 1.0)
        p = share[g] + rest[c] * p
    starts = np.cumsum(block.lengths) - block.lengths
    add = lambda x: np.add.reduceat(x, starts)  # noqa: E731  every document has its end, so none is empty
    values = [block.ids, block.held, block.lengths, add((count > 0).astype(np.int64)), np.full(len(starts), n), add(base), add(np.log10(p))]
    return pa.table([pa.array(v, k) for v, k in zip(values, kinds)], names=list(names))


def op5_lm_score(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False))
    return score_documents(docs.withColumn("held", held))


QUERIES = {"op5_lm_score": (op5_lm_score, None)}
