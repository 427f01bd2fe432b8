"""Packing of documents into sequences by minimum bin slack.

A document is its token ids and an end mark; only a document longer than a
sequence is cut. Lengths are counted over the whole corpus: a table of at most
`capacity` rows whatever the corpus holds, and all that the plan needs. A bin is
opened with the longest length that is left (and one that is left in great
number, HOT_SHARE), and a subset-sum over the lengths
that are left, one bit for each reachable sum, finds the fullest combination for
the rest of it. The same combination is the fullest again until one of its
lengths runs short, so it is taken that many times at once: each such step at
least halves the count of a length, which bounds the steps by
capacity * (1 + log2 of the largest count), not by the corpus.

Pieces of a length are numbered (within a part of the written table, and parts
before it by running sums over their counts), and a piece's number among those
of its length says which bin of which step it goes to. No task holds the pieces
of a length, so one that a third of all documents have is no matter.

Rows: a null text is an empty one, and both are a document of one end mark. Null
ids and repeated rows are documents of their own. Empty tables give empty
results; other columns do not matter. A text is encoded whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.llm.scratch import written
from sessionlake.llm.textarrays import chunks, text_column
from sessionlake.llm.vocabularies import cut_at_words, distinct, pieces_at, plain_words, ragged, word_end_bpe

CAPACITY = 2048
END_MARK = 0
#: A length with more than this share of the tokens left is taken into every bin that it fits, else it is left when what could fill up its bins is gone.
HOT_SHARE = 0.1
CHUNK_BYTES = 4 << 20
_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids binary"
#: Rows of one Arrow batch of pieces.
_ROWS = 2_000


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids) of every document: its ids and the end mark, cut every `capacity`; ids are little-endian 32-bit numbers.

    `tokenizer` names a BPE file with word ends that lower-cases and drops white space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_end_bpe(tokenizer)
        for batch in batches:
            doc_ids = batch.column(batch.schema.get_field_index("doc_id"))
            for chunk in chunks(text_column(batch), CHUNK_BYTES):
                places = cut_at_words(chunk.data, chunk.starts)
                index, words = distinct(plain_words(pieces_at(chunk.data, places)))
                ids, sizes = encode(words)
                text = np.searchsorted(chunk.starts, places[:-1], "right") - 1
                own = ragged(ids, (np.cumsum(sizes) - sizes)[index], sizes[index])
                per_text = np.bincount(text, sizes[index], len(chunk)).astype(np.int64)
                # the end mark goes after each document's last id
                own = np.insert(own, np.cumsum(per_text), END_MARK).astype("<u4")
                total = per_text + 1
                n = -(-total // capacity)
                doc = np.repeat(np.arange(len(chunk)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(total[doc] - start, capacity)
                ends = pa.array(np.concatenate([[0], np.cumsum(length)]) * 4, pa.int64())
                data = pa.Array.from_buffers(pa.large_binary(), len(doc), [None, ends.buffers()[1], pa.py_buffer(own.tobytes())])
                columns = [doc_ids.slice(chunk.first, len(chunk)).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), data]
                whole = pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids"])
                for at in range(0, len(doc), _ROWS):
                    some = whole.slice(at, _ROWS)
                    yield some.set_column(4, "ids", some.column(4).cast(pa.binary()))

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _PIECES)


# -- the plan ----------------------------------------------------------------


def fullest(counts: np.ndarray, room: int) -> list[tuple[int, int]]:
    """(length, copies) of the combination of at most counts[length] copies of each length with the largest sum up to `room`.

    Bit s of `sums` says that s can be reached. Copies come in powers of two;
    longer lengths come first, so that they are taken where there is a choice.
    """
    full, mask = 1 << room, (1 << room + 1) - 1
    sums, steps = 1, []
    for length in np.flatnonzero(counts[1 : room + 1])[::-1].tolist():
        length += 1
        left, copies = min(int(counts[length]), room // length), 1
        while left > 0 and not sums & full:
            copies = min(copies, left)
            steps.append((length, copies, sums))
            sums |= (sums << length * copies) & mask
            left, copies = left - copies, copies * 2
        if sums & full:
            break
    target, taken = sums.bit_length() - 1, {}
    for length, copies, before in reversed(steps):
        if not before >> target & 1:
            target -= length * copies
            taken[length] = taken.get(length, 0) + copies
    return sorted(taken.items(), reverse=True)


@dataclass(frozen=True)
class Plan:
    """Runs of pieces of one length, sorted by length and number: where a run starts, its first bin, copies in each bin and the place of the first.

    `n_bins` is the number of sequences.
    """

    length: np.ndarray
    number: np.ndarray
    bin: np.ndarray
    copies: np.ndarray
    place: np.ndarray
    n_bins: int

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces with these numbers among those of their lengths."""
        key = lambda a, b: (a.astype(np.int64) << 44) | b  # noqa: E731  numbers stay under 2^44
        run = np.searchsorted(key(self.length, self.number), key(length, number), "right") - 1
        nth, copy = np.divmod(number - self.number[run], self.copies[run])
        return self.bin[run] + nth, self.place[run] + copy * length


def plan(lengths: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Minimum-bin-slack plan for so many pieces of each length."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in lengths.items():
        counts[length] = n
    used, bins, runs = np.zeros_like(counts), 0, []
    while counts.any():
        tokens = counts * np.arange(capacity + 1)
        openers = [int(np.flatnonzero(counts)[-1])]
        counts[openers[0]] -= 1
        fits = np.where(counts > 0, tokens, 0)[: capacity - openers[0] + 1]
        if fits.max() > HOT_SHARE * tokens.sum():
            openers.append(int(fits.argmax()))
            counts[openers[1]] -= 1
        chosen = dict.fromkeys(openers, 0) | dict(fullest(counts, capacity - sum(openers)))
        for length in openers:
            counts[length] += 1
            chosen[length] += 1
        times, place = min(int(counts[n]) // k for n, k in chosen.items()), 0
        for length, copies in chosen.items():
            runs.append((length, int(used[length]), bins, copies, place))
            place += length * copies
            used[length] += copies * times
            counts[length] -= copies * times
        bins += times
    columns = np.array(sorted(runs), np.int64).reshape(-1, 5).T
    return Plan(*columns, n_bins=bins)


# -- placing -----------------------------------------------------------------


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces` (length and other columns, without part) with sequence_id and offset; each sequence is gapless from 0 and at most `capacity` long.

    They are written once; a piece's part is the task that wrote it.
    """
    pieces = written(pieces.withColumn("part", F.spark_partition_id()))
    columns = [c for c in pieces.columns if c != "part"]
    counts = written(pieces.groupBy("length", "part").agg(F.count("*").alias("n")))
    found = plan({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("length", "part").orderBy(*[c for c, kind in pieces.select(columns).dtypes if c != "length" and kind != "binary"])
    numbered = pieces.withColumn("nth", F.row_number().over(within) - 1).join(earlier, ["length", "part"])
    numbered = numbered.select(*columns, (F.col("nth") + F.col("earlier")).cast("bigint").alias("number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                length, number = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "number"))
                sequence, offset = found.find(length, number)
                own = [batch.column(batch.schema.get_field_index(c)) for c in columns]
                yield pa.RecordBatch.from_arrays([*own, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{n}` {t}" for n, t in pieces.select(columns).dtypes)
    return numbered.mapInArrow(run, f"{schema}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """token_pieces with ids_crc32, sequence_id and offset instead of the ids."""
    pieces = token_pieces(docs, tokenizer, capacity)
    return place(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity)


def sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences, ids of their pieces in a row as little-endian 32-bit numbers."""
    placed = place(token_pieces(docs, tokenizer, capacity), capacity)
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(ordered, F.lit(b""), lambda ids, x: F.concat(ids, x["ids"]))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))
