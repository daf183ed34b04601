"""SentencePiece encoding and decoding with a table of prefixes.

For merge-type vocabularies the encoding of a prefix ends in exactly one token, and a row of tokens is an encoding if
each pair of neighbours is compatible: encoding the two joined gives the two again. So the last token of each prefix
is the one match ending there that is compatible with the last token of the prefix before it; the ids are then read
backwards. The table takes time linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saleslake.llm.common import pieces_of, text_bytes

SPACE = "▁"
# Chunks a task remembers; beyond that it starts anew.
REMEMBERED = 600_000


class PieceTable:
    """Encodes chunks of text with the pieces of one model."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = (model.is_unknown, model.is_control, model.is_unused, model.is_byte)
        self.id = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not any(f(i) for f in special)}
        self.score = {piece: model.get_score(i) for piece, i in self.id.items()}
        self.byte_id = {i: model.piece_to_id(f"<0x{i:02X}>") for i in range(256)}
        self.unknown = model.unk_id()
        self.has_bytes = model.is_byte(self.byte_id[0])
        letters = set("".join(self.id))
        if not letters <= set(self.id):
            raise ValueError("every character of a piece must be a piece")
        self.split = {piece: self._last_merge(piece) for piece in self.id if len(piece) > 1}
        reachable = {piece for piece in self.id if len(piece) == 1 or self.split[piece]}
        for piece, parts in self.split.items():
            if parts and max(len(parts[0]), len(parts[1])) > 1 and self.score[piece] > min(self.score[x] for x in parts if len(x) > 1):
                raise ValueError(f"{piece!r} is merged before its parts")
        self.right = {piece: self._spine(piece, 1) for piece in reachable}
        self.left = {piece: self._spine(piece, 0) for piece in reachable}
        self.matches = ahocorasick.Automaton()
        for piece in reachable:
            self.matches.add_word(piece, piece)
        self.matches.make_automaton()
        self.fits: dict[tuple[str, str], bool] = {}
        # No piece has a space after another character, so texts can be cut before each run of spaces,
        # and around characters that are in no piece.
        if any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece in self.id):
            raise ValueError("a piece goes on after a space")
        line_ends = "" if "\n" in letters else "\n"
        self.chunks = re.compile(f"{SPACE}*[^{SPACE}{line_ends}]+|{SPACE}+|[{line_ends or SPACE}]").findall
        self.known: dict[str, tuple[str, int, str]] = {}

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two parts the piece is merged from when it is encoded alone; None if it is never made."""
        parts = list(piece)
        while len(parts) > 2:
            found = [(-self.score[joined], i) for i in range(len(parts) - 1) if (joined := parts[i] + parts[i + 1]) in self.score]
            if not found:
                return None
            at = min(found)[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def _spine(self, piece: str, side: int) -> list[str]:
        """The parts at one end of the piece, in the order in which they are merged: a character first, the piece last."""
        spine = [piece]
        while len(spine[-1]) > 1:
            spine.append(self.split[spine[-1]][side])
        return spine[::-1]

    def compatible(self, first: str, second: str) -> bool:
        """Whether no merge goes across the border of the two pieces while each is merged."""
        known = self.fits.get((first, second))
        if known is not None:
            return known
        score, never = self.score, float("-inf")
        right, left, i, j = self.right[first], self.left[second], 0, 0
        while True:
            across = score.get(right[i] + left[j], never)
            inside = score[right[i + 1]] if i + 1 < len(right) else never
            beyond = score[left[j + 1]] if j + 1 < len(left) else never
            # Of equal scores the leftmost merge goes first.
            if across > inside and across >= beyond and across != never:
                fits = False
                break
            if inside == never and beyond == never:
                fits = True
                break
            if inside >= beyond:
                i += 1
            else:
                j += 1
        if len(self.fits) > 4 * REMEMBERED:
            self.fits.clear()
        self.fits[first, second] = fits
        return fits

    def tokens(self, chunk: str) -> list[str]:
        """The pieces of a chunk, characters without a piece as themselves."""
        last: list[str] = [""] * (len(chunk) + 1)
        for end, piece in self.matches.iter(chunk):
            end += 1
            start = end - len(piece)
            if last[end]:
                continue
            if not start:
                last[end] = piece
                continue
            before = last[start] or chunk[start - 1]
            if before not in self.right or self.compatible(before, piece):
                last[end] = piece
        found, end = [], len(chunk)
        while end:
            piece = last[end] or chunk[end - 1]
            found.append(piece)
            end -= len(piece)
        return found[::-1]

    def ids(self, chunk: str) -> list[int]:
        found: list[int] = []
        for piece in self.tokens(chunk):
            known = self.id.get(piece)
            if known is not None:
                found.append(known)
            elif self.has_bytes:
                found += [self.byte_id[b] for b in piece.encode()]
            else:
                found.append(self.unknown)
        return found

    def decode(self, ids: list[int]) -> str:
        """The text of a chunk's ids, with a space for each space mark."""
        names, of_byte = self.names, self.of_byte
        text = b"".join(bytes((of_byte[i],)) if i in of_byte else names.get(i, " ⁇ ").encode() for i in ids)
        return text.decode(errors="replace")

    @property
    def names(self) -> dict[int, str]:
        if not hasattr(self, "_names"):
            self._names = {i: piece.replace(SPACE, " ") for piece, i in self.id.items()}
        return self._names

    @property
    def of_byte(self) -> dict[int, int]:
        if not hasattr(self, "_of_byte"):
            self._of_byte = {i: b for b, i in self.byte_id.items()} if self.has_bytes else {}
        return self._of_byte

    def coded(self, text: str) -> list[tuple[str, int, str]]:
        """For each chunk of the text: its ids joined by commas, their number, and the text decoded from them."""
        chunks = self.chunks(SPACE + text.replace(" ", SPACE)) if text else []
        known = self.known
        try:
            return [known[chunk] for chunk in chunks]
        except KeyError:
            pass
        if len(known) > REMEMBERED:
            known.clear()
        for chunk in chunks:
            if chunk not in known:
                ids = self.ids(chunk)
                known[chunk] = (",".join(map(str, ids)), len(ids), self.decode(ids))
        return [known[chunk] for chunk in chunks]

    def encode(self, text: str) -> list[int]:
        return [int(i) for code, _, _ in self.coded(text) for i in code.split(",")]


@lru_cache(maxsize=1)
def piece_table(path: str) -> PieceTable:
    return PieceTable(path)


def digests(table: PieceTable, text: str) -> tuple[int, str, str]:
    codes = table.coded(text)
    ids, counts, texts = zip(*codes, strict=True) if codes else ((), (), ())
    decoded = "".join(texts)[1:]  # without the space put before the text
    return sum(counts), hashlib.sha256(",".join(ids).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document: doc_id, ids (array of int) and the text decoded from them. A null or empty text has no ids."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_table(model_path)
        for batch in pieces_of(batches, 64):
            coded = [pieces.coded(text.as_py().decode()) for text in batch.column(1)]
            ids = [[int(i) for code, _, _ in codes for i in code.split(",")] for codes in coded]
            decoded = ["".join(text for _, _, text in codes)[1:] for codes in coded]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(
        code, "doc_id long, ids array<int>, decoded string"
    )


def coded_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, over whole texts.

    Ids are those of the sentencepiece library without begin or end ids. A null text counts as empty: no ids. A null
    doc_id stays null, repeated rows give repeated rows, an empty table no rows; further columns are ignored.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_table(model_path)
        for batch in pieces_of(batches):
            found = [digests(pieces, text.as_py().decode()) for text in batch.column(1)]
            counts, ids, texts = zip(*found, strict=True)
            yield pa.record_batch(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(
        code, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
