"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

The words of many texts are merged at once: their symbols lie in one flat numpy array, each round finds the best
pair of every word with a segmented minimum of pair ranks, merges it at its leftmost places at the same time,
and closes the gaps, until no word has a pair left. Results equal the sentencepiece library's.
"""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textmill.llm.common import slices

SPACE = "▁"
#: Piece types of the model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_SPLIT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_NONE = np.int64(1 << 40)
#: Encoded words that a worker remembers.
CACHE_WORDS = 250_000
#: Characters of the texts that are encoded together.
TOGETHER = 500_000


def _varint(data: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[i]
        i += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, i


def _fields(data: bytes):
    """Number and value of each field of a protocol buffer message."""
    i = 0
    while i < len(data):
        tag, i = _varint(data, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(data, i)
        elif kind == 2:
            size, i = _varint(data, i)
            value, i = data[i : i + size], i + size
        else:
            size = 8 if kind == 1 else 4
            value, i = data[i : i + size], i + size
        yield tag >> 3, value


class PieceModel:
    """A BPE model with byte fallback, identity normalisation and a space put before the text."""

    def __init__(self, data: bytes):
        pieces, kinds, scores = [], [], []
        trainer, normaliser = {}, {}
        for number, value in _fields(data):
            if number == 1:
                piece = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL} | dict(_fields(value))
                pieces.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0])
                kinds.append(piece[3])
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        if trainer.get(3) != 2 or not trainer.get(35) or normaliser.get(1) != b"identity" or normaliser.get(4, 1) or not normaliser.get(3, 1):
            raise ValueError("only BPE models with byte fallback, identity normalisation and kept white space are supported")
        if {USER_DEFINED, UNUSED} & set(kinds):
            raise ValueError("models with user-defined or unused pieces are not supported")
        self.pieces, self.kinds = pieces, kinds
        self.unk_surface = trainer.get(44, " ⁇ ".encode())
        normal = {p: i for i, p in enumerate(pieces) if kinds[i] == NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in normal) or {c for p in normal for c in p} - set(normal):
            raise ValueError("a piece spans two words, or has a character that is no piece")
        self.chars = {p: i for p, i in normal.items() if len(p) == 1}
        self.bytes = np.zeros(256, np.int64)
        for i, kind in enumerate(kinds):
            if kind == BYTE:
                self.bytes[int(pieces[i][3:5], 16)] = i
        # Characters that are no piece are symbols after the last id and never merge.
        self.first_other = len(pieces)
        self.width = self.first_other + 0x110000
        self.symbols = np.arange(0x110000, dtype=np.int64) + self.first_other
        self.symbols[[ord(c) for c in self.chars]] = list(self.chars.values())
        order = np.unique(-np.array([scores[i] for i in normal.values()]), return_inverse=True)[1]
        rank_of = dict(zip(normal.values(), order.tolist(), strict=True))
        pairs = sorted(
            (normal[p[:k]] * self.width + normal[p[k:]], rank_of[i], i)
            for p, i in normal.items() if len(p) > 1
            for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal
        )
        self.keys, self.ranks, self.merged = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.surface = [
            bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else self.unk_surface if k == UNKNOWN else p.replace(SPACE, " ").encode()
            for p, k in zip(pieces, kinds, strict=True)
        ]

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of each pair of symbols; rank _NONE where they don't merge."""
        keys = left * self.width + right
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == keys
        return np.where(hit, self.ranks[at], _NONE), np.where(hit, self.merged[at], -1)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all words after the last round, and the word that each belongs to."""
        done = []
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.symbols[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        word = np.repeat(np.arange(len(words)), sizes)
        rank = np.full(len(sym), _NONE)
        into = np.full(len(sym), -1, np.int64)
        touched = np.arange(len(sym))
        while len(sym):
            # Pairs begin where the next symbol is in the same word.
            touched = touched[touched < len(sym) - 1]
            inside = word[touched] == word[touched + 1]
            rank[touched], into[touched] = _NONE, -1
            touched = touched[inside]
            rank[touched], into[touched] = self._pairs(sym[touched], sym[touched + 1])
            rank[-1], into[-1] = _NONE, -1
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lengths = np.diff(np.append(starts, len(sym)))
            best = np.minimum.reduceat(rank, starts)
            live = best < _NONE
            if not live.all():  # finished words leave
                gone = np.repeat(~live, lengths)
                done.append((sym[gone], word[gone]))
                sym, word, rank, into = (x[~gone] for x in (sym, word, rank, into))
                lengths, best = lengths[live], best[live]
                if not len(sym):
                    break
            take = np.flatnonzero(rank == np.repeat(best, lengths))
            # In a run of overlapping places every other one counts, from the left.
            fresh = np.concatenate([[True], np.diff(take) != 1])
            run = np.arange(len(take)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            take = take[run % 2 == 0]
            take = self._in_order(take, sym, word, rank, into)
            sym[take] = into[take]
            keep = np.ones(len(sym), bool)
            keep[take + 1] = False
            moved = np.cumsum(keep) - 1
            sym, word, rank, into = (x[keep] for x in (sym, word, rank, into))
            touched = moved[take]
            changed = np.zeros(len(sym) + 1, bool)
            changed[touched] = True
            changed[touched - 1] = True  # before the first one: the spare place at the end
            touched = np.flatnonzero(changed[:-1])
        if not done:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sym, word = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]

    def _in_order(self, take, sym, word, rank, into) -> np.ndarray:
        """The places that may merge at the same time: where a merge makes a pair that is as good or better, which
        would come before the word's next place, only the word's first place counts."""
        several = np.zeros(len(take), bool)
        same = word[take[1:]] == word[take[:-1]]
        several[1:] |= same
        several[:-1] |= same
        if not several.any():
            return take
        at = take[several]
        now, made, size = rank[at], into[at], len(sym)
        after = np.minimum(at + 2, size - 1)
        right = np.where((at + 2 < size) & (word[after] == word[at]), self._pairs(made, sym[after])[0], _NONE)
        chosen = np.zeros(size, bool)
        chosen[take] = True
        two = np.maximum(at - 2, 0)
        before = np.where((at >= 2) & chosen[two], into[two], sym[np.maximum(at - 1, 0)])
        left = np.where((at >= 1) & (word[np.maximum(at - 1, 0)] == word[at]), self._pairs(before, made)[0], _NONE)
        broken = np.unique(word[at[(right <= now) | (left <= now)]])
        if not len(broken):
            return take
        first = np.concatenate([[True], ~same])
        return take[first | ~np.isin(word[take], broken)]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word."""
        sym, word = self.merge(words)
        if (sym >= self.first_other).any():  # other characters become the bytes of their UTF-8 form
            parts = [[s] if s < self.first_other else self.bytes[list(chr(s - self.first_other).encode())].tolist() for s in sym.tolist()]
            word = np.repeat(word, list(map(len, parts)))
            ids = [i for part in parts for i in part]
        else:
            ids = sym.tolist()
        ends = np.searchsorted(word, np.arange(len(words)), side="right").tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    @staticmethod
    def split(text: str) -> list[str]:
        """The words of a text, spaces as U+2581 before them; no piece spans two words."""
        return _SPLIT.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, texts: list[str]) -> list[list[int]]:
        words = [self.split(t) for t in texts]
        known = list(dict.fromkeys(w for ws in words for w in ws))
        ids = dict(zip(known, self.encode_words(known), strict=True))
        return [[i for w in ws for i in ids[w]] for ws in words]

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join([self.surface[i] for i in ids])

    def decode(self, ids: list[int]) -> str:
        """The text of any ids: the space before the text goes, bytes that are no UTF-8 become U+FFFD each."""
        out, run, start = [], bytearray(), True
        for i in ids:
            kind = self.kinds[i]
            if kind == BYTE:
                run += self.surface[i]
                start = False
                continue
            if run:
                out.append(_lenient(bytes(run)))
                run.clear()
            piece = self.surface[i].decode()
            if start and kind != CONTROL:
                piece = piece[1:] if kind == NORMAL and piece.startswith(" ") else piece
                start = False
            out.append(piece)
        if run:
            out.append(_lenient(bytes(run)))
        return "".join(out)


def _lenient(data: bytes) -> str:
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(data):
            first = data[i]
            size = 1 if first < 0x80 else 2 if 0xC2 <= first < 0xE0 else 3 if 0xE0 <= first < 0xF0 else 4 if 0xF0 <= first < 0xF5 else 1
            try:
                out.append(data[i : i + size].decode())
                i += size
            except UnicodeDecodeError:
                out.append("�")
                i += 1
        return "".join(out)


def sentencepiece(docs: DataFrame, model_path: str, keep_ids: bool = True, keep_text: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded, decoded_sha256 of each row of docs, and its columns named in carry.

    model_path: the model file, read once on the driver and sent to the executors (under 1 MB). ids holds the
    ids without begin or end; ids_sha256 is the digest of the decimal ids joined by commas; decoded is decode(ids).
    keep_ids, keep_text: leave ids or decoded out if false. A null text counts as empty and has no ids. Rows are
    independent: repeats give repeated results, columns not in carry are ignored, an empty table gives an empty result,
    and long texts are encoded whole.
    """
    with open(model_path, "rb") as file:
        data = file.read()
    rows = docs.select("doc_id", "text", *carry)
    optional = [("ids", "array<int>", keep_ids), ("decoded", "string", keep_text)]
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + "".join(
        f", {name} {kind}" for name, kind, wanted in optional if wanted
    ) + "".join(f", {name} {rows.schema[name].dataType.simpleString()}" for name in carry)
    model_file = rows.sparkSession.sparkContext.broadcast(data)

    def run(batches):
        model = PieceModel(model_file.value)
        known: dict[str, tuple] = {}
        for batch in batches:
            doc_ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for start, stop in slices(texts, TOGETHER):
                words = [model.split(t) for t in texts[start:stop]]
                if len(known) > CACHE_WORDS:
                    known.clear()
                new = list({w for ws in words for w in ws}.difference(known))
                for w, ids in zip(new, model.encode_words(new), strict=True):
                    known[w] = (",".join(map(str, ids)).encode(), len(ids), model.decode_bytes(ids), np.array(ids, np.int32).tobytes() if keep_ids else None)
                out: list[list] = [[], [], [], [], []]
                for ws in words:
                    entries = [known[w] for w in ws]
                    joined = b",".join([e[0] for e in entries])
                    decoded = b"".join([e[2] for e in entries])[1:]  # the space before the text
                    out[0].append(sum([e[1] for e in entries]))
                    out[1].append(hashlib.sha256(joined).hexdigest())
                    out[2].append(hashlib.sha256(decoded).hexdigest())
                    if keep_ids:
                        out[3].append(np.frombuffer(b"".join([e[3] for e in entries]), np.int32))
                    if keep_text:
                        out[4].append(decoded.decode())
                arrays = [doc_ids.slice(start, stop - start), pa.array(out[0], pa.int64()), pa.array(out[1]), pa.array(out[2])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    arrays.append(pa.array(out[3], pa.list_(pa.int32())))
                    names.append("ids")
                if keep_text:
                    arrays.append(pa.array(out[4], pa.string()))
                    names.append("decoded")
                arrays += [batch.column(2 + i).slice(start, stop - start) for i in range(len(carry))]
                yield pa.RecordBatch.from_arrays(arrays, [*names, *carry])

    return rows.mapInArrow(run, schema)
