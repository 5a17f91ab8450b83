"""SentencePiece encoding and decoding with an Aho-Corasick automaton and one pass over each text.

The model is of the BPE kind, for which a Viterbi pass over piece scores gives other ids than the library: BPE merges
by rank and doesn't maximise a sum. The pass is therefore kept as dealt (one automaton over all pieces; at each
position the output links give all pieces that end there, and the best one is kept), but a piece is relaxed only if BPE
leaves it and the piece before it apart. In terms of scores, the step between two pieces counts 0 where BPE leaves them
apart and minus infinity elsewhere, and a position's best score is relaxed by the first step of 0; for BPE exactly one
piece at each position has one, and the path through these pieces is BPE's own result, so ids equal the library's.

A merge never crosses from another character to U+2581 (no piece has it after another character), so words are
encoded once and remembered. Characters without a piece become their UTF-8 bytes' pieces.

Defined results: null is empty text; empty text has no ids. Decoding gives the text back, but for U+2581, which the
model itself can't tell from a space. Repeated rows count each. Very long texts are encoded whole. Other columns are not
read, whatever their names. Ties of merge scores go to the leftmost. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

MARK = "▁"
REMEMBERED = 400_000
NEVER = float("-inf")
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces(dict):
    """Encodes and decodes; as a dictionary it remembers the ids of words that follow one space."""

    def __init__(self, proto: bytes):
        super().__init__()
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        every = range(sp.get_piece_size())
        self.bytes_of = [b""] * len(every)
        self.rank: dict[str, tuple[float, int]] = {}
        self.byte_id = [0] * 256
        self.automaton = ahocorasick.Automaton()
        for i in every:
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                self.bytes_of[i] = bytes([int(piece[1:-1], 16)])
            elif not sp.is_control(i) and not sp.is_unknown(i) and not sp.is_unused(i):
                self.rank[piece] = (sp.get_score(i), i)
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
                self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.text_of = [sp.id_to_piece(i) for i in every]
        self.steps: dict[int, list[tuple[float, str, str]]] = {}
        self.apart: dict[int, bool] = {}

    def edges(self, i: int) -> list[tuple[float, str, str]]:
        """BPE of one piece alone, step by step: the score of each merge, then the piece's first and last symbol."""
        if (known := self.steps.get(i)) is None:
            symbols, known = list(self.text_of[i]), []
            known.append((0.0, symbols[0], symbols[-1]))
            while len(symbols) > 1:
                score, at = max((self.rank[a + b][0], -k) for k, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in self.rank)
                symbols[-at : 2 - at] = [symbols[-at] + symbols[1 - at]]
                known.append((score, symbols[0], symbols[-1]))
            self.steps[i] = known
        return known

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether BPE of the two pieces' text ends with these two pieces: no merge across comes before the merges
        inside them, taken best score first and, of equal scores, leftmost first."""
        a, b, rank, i, j = self.edges(left), self.edges(right), self.rank, 1, 1
        while True:
            across = rank.get(a[i - 1][2] + b[j - 1][1])
            inner_a = a[i][0] if i < len(a) else NEVER
            inner_b = b[j][0] if j < len(b) else NEVER
            if across is not None and across[0] > inner_a and across[0] >= inner_b:
                return False
            if inner_a >= inner_b:
                if inner_a == NEVER:
                    return True
                i += 1
            else:
                j += 1

    def word(self, s: str) -> list[int]:
        """The single pass. Of s[:e], start[e] and piece[e] say how the result's last piece lies; -1 stands for bytes."""
        start, piece, apart, reached = [0] * (len(s) + 1), [-1] * (len(s) + 1), self.apart, 0
        for end, (length, i) in self.automaton.iter(s):  # at each end, the longest piece first
            if reached > end:
                continue
            while reached < end:  # no piece ends at the position between
                reached += 1
                start[reached] = reached - 1
            at = end + 1 - length
            if at and (left := piece[at]) >= 0:
                key = left << 32 | i
                if (fits := apart.get(key)) is None:
                    if len(apart) > REMEMBERED:
                        apart.clear()
                    apart[key] = fits = self.stay_apart(left, i)
                if not fits:
                    continue
            reached = end + 1
            start[reached], piece[reached] = at, i
        while reached < len(s):
            reached += 1
            start[reached] = reached - 1
        out, e = [], len(s)
        while e:
            if piece[e] < 0:
                out.extend(self.byte_id[b] for b in reversed(s[start[e] : e].encode("utf-8", "replace")))
            else:
                out.append(piece[e])
            e = start[e]
        return out[::-1]

    def __missing__(self, part: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        self[part] = found = np.array(self.word(MARK + part), "<u4").tobytes()
        return found

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        parts = text.split(" ")
        if "" not in parts and MARK not in text:
            return b"".join(map(self.__getitem__, parts))
        words = _WORD.findall(MARK + text.replace(" ", MARK))
        return b"".join(self[w[1:]] if w[0] == MARK and w[1:] and w[1] != MARK else np.array(self.word(w), "<u4").tobytes() for w in words)

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every document."""
    proto = docs.sparkSession.sparkContext.broadcast(Path(model or model_file()).read_bytes())

    def run(batches):
        p = Pieces(proto.value)
        for b in batches:
            raw = [p.encode(t) for t in b.column("text").to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(raw), "<u4").astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(ids: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of every row of ids."""
    proto = ids.sparkSession.sparkContext.broadcast(Path(model or model_file()).read_bytes())

    def run(batches):
        p = Pieces(proto.value)
        for b in batches:
            texts = [p.decode(np.array(x or [], "<u4").tobytes()) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return ids.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str | None = None) -> DataFrame:
    """For every document: number and CRC-32 of its ids, and the SHA-256 of what they decode to."""
    proto = docs.sparkSession.sparkContext.broadcast(Path(model or model_file()).read_bytes())

    def run(batches):
        p = Pieces(proto.value)
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                ids = p.encode(text)
                back = p.decode(ids)
                rows.append((len(ids) // 4, zlib.crc32(ids), hashlib.sha256(back.encode()).hexdigest(), back == (text or "")))
            n, crc, sha, same = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(sha, pa.string()), pa.array(same, pa.bool_())],
                ["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
