"""SentencePiece encoding and decoding: exact merge-type encoding by backtracking, without a merge queue over the text."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

#: The sign that stands for a space in pieces (fixed by the format).
SPACE = "▁"


class Codec:
    """Encoder and decoder of one BPE model file with byte fallback.

    A sequence of pieces is the encoding of a text exactly if every two neighbours are the encoding of their own
    concatenation. So the encoder walks through the text, at every place takes the longest piece that
    Aho-Corasick found there, goes to shorter ones where the piece before does not bear it, and steps back where none does;
    a place from which nothing went on is marked in a bit field and never tried again, because only one
    encoding of the text before can lead to it. Whether two pieces bear each other is found by merging their
    characters anew, the better score first and the left one among equals.

    A character without a piece is a token of its own and becomes its UTF-8 bytes. Spaces can only
    stand first in a piece of the supported models; a text is then cut before every run of spaces, and the ids of short
    stretches are remembered (``remember`` of them at most).
    """

    def __init__(self, model_file: str, remember: int = 250_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        if model.normalize(" Ａ  b ") != f"{SPACE}{SPACE}Ａ{SPACE}{SPACE}b{SPACE}":
            raise ValueError("only models that keep characters and put one space before a text are supported")
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids, self.surface = [0] * 256, []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.surface.append(bytes([value]))
            elif model.is_control(i):
                self.surface.append(b"")
            elif model.is_unknown(i):
                self.surface.append(model.decode([i]).encode())
            elif model.is_unused(i):
                raise ValueError("models with unused pieces are not supported")
            else:
                self.ids[piece], self.score[piece] = i, model.get_score(i)
                self.surface.append(piece.replace(SPACE, " ").encode())
        self.find = ahocorasick.Automaton()
        for piece in self.ids:
            if len(piece) > 1 and self._merge(piece) == [piece]:  # a piece that merging never makes is no candidate
                self.find.add_word(piece, (len(piece) - 1, piece))
        self.find.make_automaton()
        self.inner = any(SPACE in piece.lstrip(SPACE) for piece in self.ids)
        self.stretch = re.compile(f"{SPACE}+[^{SPACE}]*")
        self.remember = remember
        self.known: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}
        self.bears: dict[tuple[str, str], bool] = {}
        self.next_shorter: dict[str, str | None] = {}

    def _merge(self, text: str) -> list[str]:
        """Pieces of a short string by its merges, one after the other."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, left: str, right: str) -> bool:
        pair = (left, right)
        fits = self.bears.get(pair)
        if fits is None:
            if len(self.bears) >= self.remember:
                self.bears.clear()
            fits = self.bears[pair] = self._merge(left + right) == [left, right]
        return fits

    def _shorter(self, piece: str) -> str | None:
        """The longest candidate that is a proper prefix of the piece; a first character always is one."""
        if piece not in self.next_shorter:
            if len(self.next_shorter) >= self.remember:
                self.next_shorter.clear()
            self.next_shorter[piece] = next((piece[:n] for n in range(len(piece) - 1, 0, -1) if n == 1 or piece[:n] in self.find), None)
        return self.next_shorter[piece]

    def _pieces(self, text: str) -> list[str]:
        """Pieces of a stretch by backtracking."""
        size = len(text)
        longest = list(text)
        for end, (before, piece) in self.find.iter(text):  # ends ascend, so the last match of a place is its longest
            longest[end - before] = piece
        piece = longest[0]
        at = end = len(piece)
        out, last, bears, failed = [piece], piece, self.bears, None
        while at < size:
            if end == at:
                piece = longest[at]
            while piece is not None:
                end = at + len(piece)
                if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                    fits = last is None or bears.get((last, piece))
                    if fits or (fits is None and self._fits(last, piece)):
                        break
                piece = self._shorter(piece)
            if piece is None:
                if failed is None:
                    failed = bytearray(size // 8 + 1)
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                last = out[-1] if out else None
                end = -1
                at -= len(piece)
                continue
            out.append(piece)
            last, at = piece, end
        return out

    def _stretch_ids(self, rest: str) -> list[int]:
        """Ids of a space and ``rest``, which has no spaces but at its start."""
        found = self.known.get(rest)
        if found is not None:
            return found
        found = self.older.get(rest)
        if found is None:
            found = []
            for piece in self._pieces(SPACE + rest):
                i = self.ids.get(piece)
                if i is None:
                    found.extend(self.byte_ids[b] for b in piece.encode())
                else:
                    found.append(i)
        if len(rest) <= 64:
            if len(self.known) >= self.remember:
                self.known, self.older = {}, self.known
            self.known[rest] = found
        return found

    def _stretches(self, text: str) -> Iterator[str]:
        """The text with a space before it, cut before every run of spaces; the first space of each stretch is left out."""
        if self.inner:
            yield text.replace(" ", SPACE)
        elif SPACE in text:
            for stretch in self.stretch.finditer(SPACE + text.replace(" ", SPACE)):
                yield stretch.group()[1:]
        else:
            more = 0
            for word in text.split(" "):
                if word:
                    yield SPACE * more + word if more else word
                    more = 0
                else:
                    more += 1
            if more:
                yield SPACE * (more - 1)

    def blocks(self, text: str, size: int = 1 << 14) -> Iterator[list[int]]:
        """Ids of a text in lists of about ``size``, cut at stretches."""
        block: list[int] = []
        if text:
            for rest in self._stretches(text):
                block += self.known.get(rest) or self._stretch_ids(rest)
                if len(block) >= size:
                    yield block
                    block = []
        if block:
            yield block

    def encode(self, text: str | None) -> list[int]:
        """All ids of a text; none for null or empty."""
        return [i for block in self.blocks(text or "") for i in block]

    def decode_bytes(self, ids: list[int], first: bool = True) -> bytes:
        """UTF-8 bytes of the text that the ids stand for; ``first`` drops the space that encoding put before it."""
        data = b"".join(map(self.surface.__getitem__, ids))
        if first and ids and data[:1] == b" " and ids[0] != self.byte_ids[32]:
            data = data[1:]
        try:
            data.decode()
        except UnicodeDecodeError as error:  # a byte that belongs to no character
            good, bad = data[:error.start], data[error.start + 1:]
            data = good + "�".encode() + self._repair(bad)
        return data

    @staticmethod
    def _repair(data: bytes) -> bytes:
        out = []
        while data:
            try:
                data.decode()
                break
            except UnicodeDecodeError as error:
                out += [data[:error.start], "�".encode()]
                data = data[error.start + 1:]
        return b"".join([*out, data])

    def decode(self, ids: list[int]) -> str:
        """The text of any ids."""
        return self.decode_bytes(ids).decode()


_CODECS: dict[str, Codec] = {}


def codec(model_file: str) -> Codec:
    """The codec of a model file, built once in a process."""
    if model_file not in _CODECS:
        _CODECS[model_file] = Codec(model_file)
    return _CODECS[model_file]


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """``docs`` with the column ``ids``: the pieces of every whole text, without begin and end ids.

    Null texts have no ids, like empty ones. A column of that name is replaced.
    """
    kept = [c for c in docs.columns if c != "ids"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model_file)
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                ids = pa.array([coder.encode(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*kept, "ids"])

    return docs.select(*kept).mapInArrow(run, f"{schema}, ids array<int>")


def round_trip(docs: DataFrame, model_file: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``, one row per document.

    Every whole text is encoded and its ids are decoded again; the digests are of the decimal ids joined by commas and of the
    decoded text's UTF-8 bytes, fed in blocks, so that a very long text needs no memory for its ids. Null texts
    are empty ones: no ids, digests of nothing. Repeated rows are rows of their own; other columns are
    ignored; an empty table gives no rows. Python works on batches of the scan: no shuffle.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model_file)
        words = [str(i) for i in range(len(coder.surface))]
        for batch in batches:
            counts, codes, texts = [], [], []
            for text in batch.column("text"):
                n, code, back = 0, hashlib.sha256(), hashlib.sha256()
                for ids in coder.blocks(text.as_py() or ""):
                    code.update((("," if n else "") + ",".join(map(words.__getitem__, ids))).encode())
                    back.update(coder.decode_bytes(ids, first=n == 0))
                    n += len(ids)
                counts.append(n)
                codes.append(code.hexdigest())
                texts.append(back.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(codes), pa.array(texts)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
