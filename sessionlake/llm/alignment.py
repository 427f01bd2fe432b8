"""Cross-tokenizer alignment by merge paths.

The ends of a text's A tokens and of its B tokens are two sorted lists of byte
offsets. Merging them gives the links (each stretch between neighbouring ends
lies in one A and one B token) and the cuts (offsets where both end). The merge
of many texts is one long path; diagonals at equal distances cut it into pieces
of equal work, wherever texts begin, and a binary search along each diagonal
finds where the path crosses it. Pieces are merged independently, all in step;
what they emit is stitched: a group runs from the last cut of an earlier piece.

A pair of ids counts the documents that hold it linked, over the whole corpus.
Texts are taken in blocks; a block keeps its distinct pairs once, with their
documents, and each document only refers to them, so pairs are shuffled per
block, not per document, and a pair that is everywhere comes once a block.

Rows: null and empty texts, and texts that either tokenizer does not reproduce
byte by byte, have no tokens and zeros. Null ids and repeated rows are documents
of their own. Empty tables give empty results; other columns do not matter. A
text is one piece of work: memory follows the longest text, which is held whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionlake.llm.scratch import written
from sessionlake.llm.textarrays import Chunk, chunks, text_column
from sessionlake.llm.vocabularies import Encode, byte_level_bpe, byte_level_bytes, cut_at_spaces, distinct, pieces_at, ragged, sentence_piece_bytes, sentence_pieces

#: Ends that a piece of the merge path takes.
PATH_PIECE = 128
#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 2 << 20
_MOST = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Tokenizers:
    """Two tokenizers of space + text: their ids of pieces and the bytes of their ids."""

    a: Encode
    b: Encode
    a_bytes: tuple[bytes, ...]
    b_bytes: tuple[bytes, ...]


def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    """A byte-level BPE file and a `sentencepiece` model."""
    return Tokenizers(byte_level_bpe(a_path), sentence_pieces(b_path), byte_level_bytes(a_path), sentence_piece_bytes(b_path))


# -- merging -----------------------------------------------------------------


def crossings(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many of the first d merged ends are of `a`, for each d of `diagonals`; of equal ends a's comes first."""
    low, high = np.maximum(diagonals - len(b), 0), np.minimum(diagonals, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        ahead = np.zeros(len(mid), bool)
        ahead[open_] = a[mid[open_]] <= b[diagonals[open_] - 1 - mid[open_]]
        low, high = np.where(open_ & ahead, mid + 1, low), np.where(open_ & ~ahead, mid, high)
    return low


def merge(a: np.ndarray, b: np.ndarray, piece: int = PATH_PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(link_a, link_b, cut_a, cut_b) of two increasing lists of ends whose last is the same.

    Token link_a[k] of A and link_b[k] of B share bytes, each such pair once;
    cut_a[k] tokens of A and cut_b[k] of B end where the k-th group ends.
    """
    total = len(a) + len(b)
    if total == 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    start = np.arange(0, total, piece)
    i = crossings(a, b, start)
    j = start - i
    a, b = np.append(a, _MOST), np.append(b, _MOST)
    shape = (piece, len(start))
    at_a, at_b, is_cut = np.empty(shape, np.int32), np.empty(shape, np.int32), np.zeros(shape, bool)
    for step in range(piece):
        end_a, end_b = a[i], b[j]
        first = end_a <= end_b
        # b's end comes after an equal one of a: both tokens end here
        is_cut[step] = ~first & (i > 0) & (a[i - 1] == end_b)
        at_a[step], at_b[step] = i, j
        past = (end_a == _MOST) & (end_b == _MOST)  # only in the last piece
        i = i + (first & ~past)
        j = j + (~first & ~past)
    # stitched: pieces one after another, without the steps after the end
    at_a, at_b, is_cut = (x.T.reshape(-1)[:total] for x in (at_a, at_b, is_cut))
    return at_a[~is_cut], at_b[~is_cut], at_a[is_cut], at_b[is_cut] + 1


def _decimal(values: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends): numbers in decimal, each with a byte after it."""
    digits = np.searchsorted(10 ** np.arange(1, 10), values, "right") + 1
    ends = np.cumsum(digits + 1)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    out[ends - 1] = after
    place, rest, left = ends - 2, values, digits
    while len(place):
        out[place] = 48 + rest % 10
        more = left > 1
        place, rest, left = place[more] - 1, rest[more] // 10, left[more] - 1
    return out, ends


@dataclass
class Aligned:
    """Texts of a chunk: ids of both sides one text after another, links and cuts by their numbers in these, and where each text starts in all of them."""

    a: np.ndarray
    b: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray
    text_a: np.ndarray
    text_b: np.ndarray
    text_link: np.ndarray
    text_cut: np.ndarray

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, where each text starts in them) of `a1,a2|b1;a3|b2,b3;`: the ids of A and B group by group."""
        group_a, group_b = (np.repeat(np.arange(len(c)), np.diff(c, prepend=0)) for c in (self.cut_a, self.cut_b))
        before_b = np.concatenate([[0], self.cut_b])
        ids, after = np.empty(len(self.a) + len(self.b), np.int64), np.full(len(self.a) + len(self.b), ord(","), np.uint8)
        ids[np.arange(len(self.a)) + before_b[group_a]] = self.a
        ids[np.arange(len(self.b)) + self.cut_a[group_b]] = self.b
        after[self.cut_a + before_b[:-1] - 1] = ord("|")
        after[self.cut_a + self.cut_b - 1] = ord(";")
        out, ends = _decimal(ids, after)
        return out, np.concatenate([[0], ends])[self.text_a + self.text_b]

    def notations(self) -> Iterator[memoryview]:
        out, at = self.groups()
        whole = memoryview(out)
        return (whole[s : max(s, e - 1)] for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, times), sorted: distinct pairs of ids that each text links; a pair is A's id times 2^32 plus B's."""
        wide = int(self.b.max(initial=0)) + 1
        span = (int(self.a.max(initial=0)) + 1) * wide
        text = np.repeat(np.arange(len(self.text_link) - 1), np.diff(self.text_link))
        key = np.sort(text * span + self.a[self.link_a].astype(np.int64) * wide + self.b[self.link_b])
        first = np.flatnonzero(np.diff(key, prepend=-1))
        text, rest = np.divmod(key[first], span)
        a, b = np.divmod(rest, wide)
        return text, (a << 32) | b, np.diff(np.append(first, len(key)))


def _same_bytes(pieces: pa.Array, ids: np.ndarray, sizes: np.ndarray, token_bytes: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether the tokens of each piece are its bytes."""
    flat, at = token_bytes
    length = np.diff(at)[ids]
    ends = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(sizes)])]
    offsets = np.frombuffer(pieces.buffers()[1], np.int64 if pa.types.is_large_string(pieces.type) else np.int32, len(pieces) + 1).astype(np.int64)
    data = np.frombuffer(pieces.buffers()[2], np.uint8) if len(pieces) else np.zeros(0, np.uint8)
    same = np.diff(ends) == np.diff(offsets)
    joined = ragged(flat, at[ids], length)
    n = np.diff(offsets)[same]
    equal = ragged(joined, ends[:-1][same], n) == ragged(data, offsets[:-1][same], n)
    wrong = np.repeat(np.flatnonzero(same), n)[~equal]
    same[wrong] = False
    return same


def _flat(tokens: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tokens])])


def aligned(chunk: Chunk, both: Tokenizers, flat_a: tuple, flat_b: tuple) -> Aligned:
    n = len(chunk)
    data = np.insert(chunk.data, chunk.starts[:-1], 32)
    starts = chunk.starts + np.arange(n + 1)
    places = cut_at_spaces(data, starts)
    index, pieces = distinct(pieces_at(data, places))
    text = np.searchsorted(starts, places[:-1], "right") - 1
    (ids_a, size_a), (ids_b, size_b) = both.a(pieces), both.b(pieces)
    good = np.diff(chunk.starts) > 0
    same = _same_bytes(pieces, ids_a, size_a, flat_a) & _same_bytes(pieces, ids_b, size_b, flat_b)
    good[text[~same[index]]] = False
    index = index[good[text]]
    text = text[good[text]]

    def side(ids: np.ndarray, sizes: np.ndarray, flat: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        each = sizes[index]
        own = ragged(ids, (np.cumsum(sizes) - sizes)[index], each)
        per_text = np.bincount(text, each, n).astype(np.int64)
        return own, np.cumsum(np.diff(flat[1])[own]), np.concatenate([[0], np.cumsum(per_text)])

    a, end_a, text_a = side(ids_a, size_a, flat_a)
    b, end_b, text_b = side(ids_b, size_b, flat_b)
    link_a, link_b, cut_a, cut_b = merge(end_a, end_b)
    return Aligned(a, b, link_a, link_b, cut_a, cut_b, text_a, text_b, np.searchsorted(link_a, text_a), np.searchsorted(cut_a, text_a, "right"))


# -- tables ------------------------------------------------------------------

ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string"
_BLOCK = "block string, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, groups_sha256 array<string>, n_pairs array<int>, place array<int>, times array<int>, pairs array<bigint>, docs array<int>"
_COUNTED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _in_chunks(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str) -> Iterator[tuple[pa.Array, Aligned]]:
    both = tokenizers(a_path, b_path)
    flat_a, flat_b = _flat(both.a_bytes), _flat(both.b_bytes)
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("doc_id"))
        for chunk in chunks(text_column(batch), BLOCK_BYTES):
            yield ids.slice(chunk.first, len(chunk)), aligned(chunk, both, flat_a, flat_b)


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups): each text's tokens and how they meet; groups is `a1,a2|b1;a3|b2,b3`, the ids in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _in_chunks(batches, a_path, b_path):
            numbers = [np.diff(c) for c in (x.text_a, x.text_b, x.text_cut, x.text_link)]
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, numbers), pa.array([bytes(g).decode() for g in x.notations()], pa.string())], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups"])

    return _texts(docs).mapInArrow(run, ALIGNED)


def link_blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Blocks of documents with their numbers, the digest of their groups, and the distinct pairs of ids that they link.

    A row is a block: arrays by document, the places in `pairs` and times of
    each document's pairs in a row (n_pairs of each), and the block's distinct
    pairs with how many of its documents link each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, (ids, x) in enumerate(_in_chunks(batches, a_path, b_path)):
            text, pair, times = x.pairs()
            pairs, place = np.unique(pair, return_inverse=True)
            digests = [hashlib.sha256(g).hexdigest() if len(g) else "" for g in x.notations()]
            lists = [ids, *(np.diff(c) for c in (x.text_a, x.text_b, x.text_cut, x.text_link)), digests]
            lists += [np.bincount(text, minlength=len(ids)).astype(np.int32), place.astype(np.int32), times.astype(np.int32), pairs, np.bincount(place, minlength=len(pairs)).astype(np.int32)]
            kinds = [pa.int64()] * 5 + [pa.string()] + [pa.int32()] * 3 + [pa.int64(), pa.int32()]
            columns = [pa.ListArray.from_arrays([0, len(v)], v if isinstance(v, pa.Array) else pa.array(v, t)) for v, t in zip(lists, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([f"{task}-{k}"]), *columns], names=[c.split()[0] for c in _BLOCK.split(", ")])

    return _texts(docs).mapInArrow(run, _BLOCK)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, count, best): documents that hold each pair linked, and whether that is the most of its A id."""
    each = blocks.select(F.explode(F.arrays_zip("pairs", "docs")).alias("p"))
    counts = written(each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.docs").alias("count")))
    a = F.shiftright("pair", 32)
    most = counts.groupBy(a.alias("a")).agg(F.max("count").alias("most"))
    return counts.withColumn("a", a).join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def alignment_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256): each document against the counts of the whole corpus.

    n_best: its links whose pair's count is the highest of the A id; count_sum:
    the counts of all its links. Blocks meet the counts of their pairs by two
    equi-joins, each pair once a block.
    """
    blocks = written(link_blocks(docs, a_path, b_path))
    asked = blocks.select(F.col("block").alias("of"), F.posexplode("pairs").alias("at", "pair"))
    found = asked.join(pair_counts(blocks), "pair").select("of", "at", "count", "best")

    def score(own: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        for row in range(own.num_rows):
            column = {c: own.column(c)[row].values for c in own.column_names if c != "block"}
            n = len(column["pairs"])
            count, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
            at = found.column("at").to_numpy()
            count[at], best[at] = found.column("count").to_numpy(), found.column("best").to_numpy().astype(np.int64)
            place, times = column["place"].to_numpy(), column["times"].to_numpy().astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(column["n_pairs"].to_numpy())])
            sums = [np.diff(np.concatenate([[0], np.cumsum(times * v[place])])[ends]) for v in (best, count)]
            out.append(pa.table([*(column[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), *map(pa.array, sums), column["groups_sha256"]], names=[c.split()[0] for c in _COUNTED.split(", ")]))
        return pa.concat_tables(out)

    return blocks.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(score, _COUNTED)
