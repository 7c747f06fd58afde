"""Whole-text encoding with a public tokenizer, which sees each distinct piece of text once.

Both supported kinds of tokenizer cut a text at spaces before they merge anything, so the ids of a
text are those of its pieces in a row. Pieces repeat a lot: a slice of texts is cut, and its distinct
pieces looked up in a bounded table, by Arrow kernels. New pieces go to the library many at a time
as one run of text, whose ids are split where a token begins (or ends) a piece; to byte-level BPE a
space and letters are one word, which goes to the library's model as it is. Ids are put together by
numpy. No Python object is made for a piece that is known.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Most pieces kept at once by a Python worker, and the longest piece (in bytes) that is kept.
MOST_PIECES, LONGEST_PIECE = 300_000, 64
#: Marks the piece at the start of a text. A text that has it itself is one piece.
START = "\ue000"
#: Signs that may end a piece without being part of its last word.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters that stay one letter when a tokenizer composes or lower-cases them, so signs after them are cut off.
LETTERS = r"[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{17F}\x{400}-\x{45F}]"
LETTER = LETTERS + "$"
#: Pieces after which a text must be cut otherwise: none at all, or white space but for one line end.
ODD = r"^$|^[^\S\n]|^[\x{85}\x{1C}-\x{1F}\p{Z}]|^\n$|^\n[\s\x{85}\x{1C}-\x{1F}\p{Z}]"
#: Bytes of text encoded at once: the more, the fewer pieces are looked up twice.
TEXT_BYTES = 4 << 20
#: Pieces in one call of the library, and in one run of text.
AT_ONCE = 2000
#: How the vocabularies write a space and a line end, and the end of a word.
SPACE, LINE, WORD_END = "\u0120", "\u010a", "</w>"
#: How they write the bytes of letters, where not as the character of that number.
BYTES = {b: 0x100 + b - 94 for b in range(127, 161)} | {173: 0x143}


class Table:
    """Ids of some strings: where those of each begin in `flat`, and how many they are."""

    def __init__(self, starts: np.ndarray, sizes: np.ndarray, flat: np.ndarray):
        self.starts, self.sizes, self.flat = starts, sizes, flat

    def take(self, at: np.ndarray) -> np.ndarray:
        """The ids of the strings at these places, in a row."""
        return self.flat[_places(self.starts[at], self.sizes[at])]


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], ... (sizes[0] of them), starts[1], ..."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(total)


class PieceEncoder:
    """Encodes texts as little-endian unsigned 32-bit ids.

    spaces: "joined" if a space belongs to the word after it (byte-level BPE), "dropped" if white
    space only separates. Strings of special tokens in a text are ordinary text. When `most` pieces
    are kept, the half of them that most slices of texts had stays.
    """

    def __init__(self, path: str, spaces: str, most: int = MOST_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task per core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.joined, self.most = spaces == "joined", most
        cutter = self.tokenizer.pre_tokenizer
        whole = self.joined and self.tokenizer.normalizer is None and isinstance(cutter, pre_tokenizers.ByteLevel) and cutter.use_regex
        self.model = self.tokenizer.model if whole else None
        vocabulary = self.tokenizer.get_vocab()
        names = np.full(max(vocabulary.values()) + 1, "", dtype=object)
        names[list(vocabulary.values())] = list(vocabulary)
        self.after_space, self.after_line, self.last = (np.array([f(x) for x in names]) for f in (lambda x: x.startswith(SPACE), lambda x: x.startswith(LINE), lambda x: x.endswith(WORD_END)))
        self.known, self.seen = pa.array([], pa.string()), np.zeros(0, np.int32)
        self.table = Table(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4"))

    def _forget(self, room: int) -> None:
        """Keep the known pieces looked up most, `room` at most and half of what may be kept; what they were looked up counts half from now on."""
        stays = np.sort(np.argsort(-self.seen, kind="stable")[: max(0, min(room, self.most // 2))])
        sizes = self.table.sizes[stays]
        self.table = Table(np.cumsum(sizes) - sizes, sizes, self.table.flat[_places(self.table.starts[stays], sizes)])
        self.known, self.seen = self.known.take(pa.array(stays)), self.seen[stays] // 2

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text; null is empty."""
        texts = pc.fill_null(texts, "")
        if self.joined:
            # A piece stands for itself after a space, but for one that starts with a line end or the mark of a text's start.
            cut = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(START, texts, ""), "\n", " \n"), " ")
        else:
            cut = pc.split_pattern(pc.replace_substring(pc.ascii_lower(texts), "\n", " "), " ")
        pieces, codes = _distinct(cut.flatten())
        table = self._pieces(pieces)
        ends = np.concatenate([[0], np.cumsum(table.sizes[codes])])
        out = table.take(codes).tobytes()
        offsets = cut.offsets.to_numpy(zero_copy_only=False)
        offsets = offsets - offsets[0]
        at = (4 * ends[offsets]).tolist()
        found = [out[x:y] for x, y in zip(at, at[1:])]

        if self.joined:
            # With other runs of white space, a text is only cut at spaces before something visible.
            odd = pc.match_substring_regex(pieces, ODD).to_numpy(zero_copy_only=False)
            has = np.concatenate([[0], np.cumsum(odd[codes])])[offsets]
            marked = pc.match_substring(texts, START).to_numpy(zero_copy_only=False)
            for i in np.flatnonzero((np.diff(has) > 0) | marked).tolist():
                text = texts[i].as_py()
                own = [START + text] if marked[i] else re.split(r" (?=\S)", START + text)
                pieces, codes = _distinct(pa.array(own, pa.string()))
                found[i] = self._pieces(pieces).take(codes).tobytes()
        return found

    def _pieces(self, pieces: pa.Array) -> Table:
        """The ids of distinct pieces.

        Signs after a letter are cut off by both tokenizers, and what stands before them is often known.
        """
        core = pc.utf8_rtrim(pieces, SIGNS)
        cut = pc.and_(pc.match_substring_regex(core, LETTER), pc.less(pc.binary_length(core), pc.binary_length(pieces)))
        core = pc.if_else(cut, core, pieces)
        names, at = _distinct(core)
        signs, of = _distinct(_rest(pieces, core))
        words, ends = self._words(names), self._encoded(signs, lead="")
        starts = np.column_stack([words.starts[at], len(words.flat) + ends.starts[of]]).reshape(-1)
        sizes = np.column_stack([words.sizes[at], ends.sizes[of]]).reshape(-1)
        flat = np.concatenate([words.flat, ends.flat])[_places(starts, sizes)]
        sizes = sizes.reshape(-1, 2).sum(axis=1)
        return Table(np.cumsum(sizes) - sizes, sizes, flat)

    def _words(self, words: pa.Array) -> Table:
        """The ids of distinct words, through the table of known ones."""
        place = pc.index_in(words, value_set=self.known)
        self.seen[place.drop_null().to_numpy()] += 1
        if len(self.known) + place.null_count > self.most:
            self._forget(self.most - place.null_count)
            place = pc.index_in(words, value_set=self.known)
        new = words.filter(pc.is_null(place))
        fresh = self._encoded(new)
        flat = np.concatenate([self.table.flat, fresh.flat])
        starts = np.concatenate([self.table.starts, len(self.table.flat) + fresh.starts])
        sizes = np.concatenate([self.table.sizes, fresh.sizes])
        at = pc.fill_null(place, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        at[at < 0] = len(self.known) + np.arange(len(new))
        found = Table(starts[at], sizes[at], flat)
        short = pc.less_equal(pc.binary_length(new), LONGEST_PIECE)
        stays = np.concatenate([np.ones(len(self.known), bool), short.to_numpy(zero_copy_only=False).astype(bool)])
        self.known = pa.concat_arrays([self.known, new.filter(short)])
        self.seen = np.concatenate([self.seen, np.ones(len(self.known) - len(self.seen), np.int32)])
        self.table = Table(starts[stays], sizes[stays], flat) if stays.all() else Table(np.cumsum(sizes[stays]) - sizes[stays], sizes[stays], flat[_places(starts[stays], sizes[stays])])
        return found

    def _encoded(self, pieces: pa.Array, lead: str | None = None) -> Table:
        """The ids of pieces by the library; with a lead, of texts as they are."""
        texts = pieces.to_pylist()
        groups: list[tuple[np.ndarray, np.ndarray | str | None]] = []  # places, and where a run is split; None: texts apart; SPACE: words of letters
        if lead is not None:
            groups = [(np.arange(len(texts)), None)]
        elif self.joined:
            first, line = (pc.starts_with(pieces, x).to_numpy(zero_copy_only=False).astype(bool) for x in (START, "\n"))
            word = pc.match_substring_regex(pieces, f"^{LETTERS}+$").to_numpy(zero_copy_only=False).astype(bool) & (self.model is not None)
            groups = [(np.flatnonzero(word), SPACE), (np.flatnonzero(~first & ~line & ~word), self.after_space), (np.flatnonzero(line), self.after_line), (np.flatnonzero(first), None)]
        else:
            plain = pc.match_substring_regex(pieces, r"^\p{L}+$").to_numpy(zero_copy_only=False).astype(bool)
            groups = [(np.flatnonzero(plain), self.last), (np.flatnonzero(~plain), None)]
        starts, sizes, flat, total = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), [np.zeros(0, "<u4")], 0
        for places, marks in groups:
            for i in range(0, len(places), AT_ONCE):
                at = places[i : i + AT_ONCE]
                n, ids = self._run([texts[x] for x in at.tolist()], marks, lead)
                sizes[at], starts[at] = n, total + np.cumsum(n) - n
                flat.append(ids)
                total += len(ids)
        return Table(starts, sizes, np.concatenate(flat))

    def _run(self, pieces: list[str], marks: np.ndarray | str | None, lead: str | None) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece has, and the ids in a row."""
        if isinstance(marks, str):
            tokenize = self.model.tokenize
            words = [tokenize(marks + (x if x.isascii() else x.encode().decode("latin-1").translate(BYTES))) for x in pieces]
            n = np.fromiter(map(len, words), np.int64, len(words))
            return n, np.fromiter((t.id for x in words for t in x), "<u4", int(n.sum()))
        if marks is not None:
            text = "".join(pieces) if marks is self.after_line else " " + " ".join(pieces)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            # Every piece has a mark at least, so as many marks as pieces are one each.
            at = np.flatnonzero(marks[ids]) + (0 if self.joined else 1)
            bounds = np.append(at, len(ids)) if self.joined else np.append(0, at)
            if len(at) == len(pieces) and bounds[0] == 0 and bounds[-1] == len(ids):
                return np.diff(bounds), ids
        texts = pieces if lead is not None or not self.joined else [_text(x) for x in pieces]
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        return n, np.fromiter((i for x in found for i in x), "<u4", int(n.sum()))


def _distinct(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct values, and the place of each value among them."""
    coded = pc.dictionary_encode(values)
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)


def _rest(whole: pa.Array, part: pa.Array) -> pa.Array:
    """What stands after part, which each string of whole starts with."""
    data, offsets = np.frombuffer(whole.buffers()[2] or b"", np.uint8), np.frombuffer(whole.buffers()[1], np.int32)[whole.offset : whole.offset + len(whole) + 1]
    sizes = np.diff(offsets) - pc.binary_length(part).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(whole), pa.py_buffer(ends.tobytes()), pa.py_buffer(data[_places(offsets[1:] - sizes, sizes)].tobytes()))


def pack(ids: Sequence[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _text(piece: str) -> str:
    if piece.startswith(START):
        return piece[1:]
    return piece if piece.startswith("\n") else " " + piece


_ENCODERS: dict[tuple[str, str], PieceEncoder] = {}


def encoder(path: str, spaces: str) -> PieceEncoder:
    """The encoder of this Python worker."""
    if (path, spaces) not in _ENCODERS:
        _ENCODERS[path, spaces] = PieceEncoder(path, spaces)
    return _ENCODERS[path, spaces]
