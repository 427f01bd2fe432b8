"""Token ids of many texts by public tokenizers, piece by piece.

Texts are cut where no token of the tokenizer reaches across and none depends on
what lies beyond, so the ids of a text are those of its pieces in a row. Of the
pieces of many texts each distinct one is encoded once. Byte-pair files are run
by their merges as ranks, all plain pieces in one call; what is not plain enough
for that goes piece by piece. Tests hold both against whole texts.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Ends a word in the ranks of a vocabulary with word ends; pieces that hold it are not plain.
_END = "\0"

_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Last bytes of the white space of Unicode beyond ASCII. Other characters share them; no cut is made after those either.
_MAY_BE_BLANK = np.zeros(256, bool)
_MAY_BE_BLANK[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Signs before which a letter's word ends: not ' (contractions) nor | (inside the special tokens' strings).
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in '!"#$%&()*+,-./:;<=>?@[\\]^_`{}~']] = True
_PLAIN_WORD = r"^(?:[A-Za-zÀ-ÖØ-öø-ÿ]+|[!-&(-/:-@\[-`{}~]+)$"

#: Pieces to (ids one after another, number of ids of each piece).
Encode = Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]


def cut_at_spaces(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pieces start in `data` (bytes of texts that start at `starts`, the end last), and the end: before a space that follows a visible character."""
    cut = np.zeros(len(data) + 1, bool)
    cut[starts] = True
    if len(data) > 1:
        cut[1:-1] |= (data[1:] == 32) & ~(_BLANK | _MAY_BE_BLANK)[data[:-1]]
    return np.flatnonzero(cut)


def cut_at_words(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """As cut_at_spaces, before any blank and any sign that follows a letter: for tokenizers that drop white space and keep letters from signs."""
    cut = np.zeros(len(data) + 1, bool)
    cut[starts] = True
    if len(data) > 1:
        before, here = data[:-1], data[1:]
        letter = _LETTER[before]
        letter[1:] |= (data[:-2] == 0xC3) & (before[1:] != 0x97) & (before[1:] != 0xB7)
        cut[1:-1] |= (_BLANK[here] & ~_BLANK[before]) | (_SIGN[here] & letter)
    return np.flatnonzero(cut)


def pieces_at(data: np.ndarray, places: np.ndarray) -> pa.Array:
    kind, width = (pa.large_string(), np.int64) if len(data) >= 1 << 31 else (pa.string(), np.int32)
    offsets = pa.py_buffer(np.ascontiguousarray(places.astype(width)))
    return pa.Array.from_buffers(kind, len(places) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(data))])


def distinct(pieces: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(index of each piece among the distinct ones, distinct pieces)."""
    coded = pieces.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def plain_words(pieces: pa.Array) -> pa.Array:
    """Pieces without the white space around them, words of Latin letters in lower case."""
    bare = pc.ascii_trim_whitespace(pieces)
    return pc.if_else(pc.match_substring_regex(bare, _PLAIN_WORD), pc.utf8_lower(bare), bare)


def ragged(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs values[starts[i] : starts[i] + sizes[i]] one after another."""
    total = int(sizes.sum())
    if total == 0:
        return values[:0]
    return values[np.arange(total) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)]


def _joined(lists) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((i for ids in lists for i in ids), np.int32, int(sizes.sum())), sizes


def _in_a_row(pieces: pa.Array, end: str) -> str:
    """The pieces as one string, `end` after each."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(pieces)], pieces.cast(pa.string())), end)[0].as_py() + end if len(pieces) else ""


def _two_ways(pieces: pa.Array, plain: pa.Array, fast: Encode, slow: Encode) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pieces, those marked plain by `fast`, the others by `slow`."""
    mark = plain.to_numpy(zero_copy_only=False)
    parts = [fast(pieces.filter(plain)), slow(pieces.filter(pc.invert(plain)))]
    ids, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
    at = np.empty(len(pieces), np.int64)
    at[np.concatenate([np.flatnonzero(mark), np.flatnonzero(~mark)])] = np.arange(len(pieces))
    return ragged(ids, (np.cumsum(sizes) - sizes)[at], sizes[at]), sizes[at]


def _visible_bytes() -> dict[str, int]:
    """How byte-level files write bytes: a printable one of Latin-1 as itself, the others in order as characters from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


def _token_bytes(token: str, end: str | None, byte: dict[str, int]) -> bytes:
    tail = b""
    if end and token.endswith(end):
        token, tail = token[: -len(end)], _END.encode()
    return bytes(byte[c] for c in token) + tail


@cache
def merge_ranks(path: str) -> tuple[dict[bytes, int], np.ndarray]:
    """(ranks of token bytes, id of each rank) of a byte-level BPE file: bytes at word ends, bytes, then tokens in the order of their merges.

    Ranks stand for merges because every token comes from one merge of tokens
    that come before it; a file for which that is not so is refused.
    """
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end, byte, vocab = model["end_of_word_suffix"], _visible_bytes(), model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    tokens = [*(c + end for c in byte if end), *byte, *(a + b for a, b in pairs)]
    place = {t: k for k, t in enumerate(tokens)}
    if len(place) != len(tokens) or any(max(place[a], place[b]) >= place[a + b] for a, b in pairs):
        raise ValueError(f"the merges of {path} are not in the order of its tokens")
    return {_token_bytes(t, end, byte): k for t, k in place.items()}, np.array([vocab[t] for t in tokens], np.int32)


@cache
def word_end_bpe(path: str) -> Encode:
    """A BPE file with word ends that lower-cases and drops white space, over plain_words of cut_at_words; special tokens' strings are special tokens."""
    import tiktoken
    from tokenizers import Tokenizer

    ranks, ids = merge_ranks(path)
    merged = tiktoken.Encoding("merges", pat_str=rf"[^{_END}]+{_END}", mergeable_ranks=ranks, special_tokens={})
    ends = np.zeros(len(ids), bool)
    ends[[k for b, k in ranks.items() if b.endswith(_END.encode()) and len(b) > 1]] = True
    whole = Tokenizer.from_file(path)

    def fast(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = np.array(merged.encode_ordinary(_in_a_row(words, _END)), np.int64)
        return ids[found], np.diff(np.flatnonzero(np.concatenate([[True], ends[found]])))

    def slow(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return _joined([e.ids for e in whole.encode_batch(words.to_pylist(), add_special_tokens=False)])

    return lambda words: _two_ways(words, pc.match_substring_regex(words, _PLAIN_WORD), fast, slow)


@cache
def byte_level_bpe(path: str) -> Encode:
    """A byte-level BPE file over pieces of cut_at_spaces; special tokens' strings are plain text."""
    import public_tokenizers
    import tiktoken

    ranks, ids = merge_ranks(path)
    merged = tiktoken.Encoding("merges", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    length = np.zeros(len(ids), np.int64)
    for b, k in ranks.items():
        length[k] = len(b)

    def fast(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = np.array(merged.encode_ordinary(_in_a_row(pieces, "")), np.int64)
        at = np.cumsum(pc.binary_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64))
        return ids[found], np.diff(np.searchsorted(np.cumsum(length[found]), at, "right"), prepend=0)

    def slow(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found, sizes = _joined([merged.encode_ordinary(p) for p in pieces.to_pylist()])
        return ids[found], sizes

    # such pieces are cut where they meet in a row, as they are in a text
    return lambda pieces: _two_ways(pieces, pc.match_substring_regex(pieces, r"^ [!-~]$|^ [!-~\x{a1}-\x{24f}](?s:.)*[!-~]$"), fast, slow)


@cache
def sentence_pieces(path: str) -> Encode:
    """A `sentencepiece` model over pieces of cut_at_spaces that begin with a space, which the model adds itself."""
    import sentencepiece

    found = sentencepiece.SentencePieceProcessor(model_file=path)
    if any("▁" in found.id_to_piece(i).lstrip("▁") for i in range(found.get_piece_size())):
        raise ValueError(f"{path} has tokens that reach over a space, so texts cannot be encoded by pieces")
    alone = [found.piece_to_id("▁")]

    def encode(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        bare = pc.utf8_slice_codeunits(pieces, 1).to_pylist()
        return _joined([ids if t else alone for t, ids in zip(bare, found.encode(bare, num_threads=1), strict=True)])

    return encode


@cache
def byte_level_bytes(path: str) -> tuple[bytes, ...]:
    """The bytes of every id of a byte-level BPE file."""
    ranks, ids = merge_ranks(path)
    out = [b""] * (int(ids.max()) + 1)
    for b, k in ranks.items():
        out[ids[k]] = b
    return tuple(out)


@cache
def sentence_piece_bytes(path: str) -> tuple[bytes, ...]:
    """The bytes of every id of a `sentencepiece` model: byte pieces as bytes, the others in UTF-8 with U+2581 as a space."""
    import sentencepiece

    found = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(found.get_piece_size())
    return tuple(bytes([int(found.id_to_piece(i)[3:5], 16)]) if found.is_byte(i) else found.id_to_piece(i).replace("▁", " ").encode() for i in every)
