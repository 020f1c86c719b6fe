"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies by a table of each prefix's last piece."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Units (words) up to so many characters are remembered by a worker, so many at a time.
UNIT_CHARS, UNITS = 32, 1 << 18
#: Output leaves a task in batches of about so many bytes.
FLUSH = 8 << 20
_NEVER = 1 << 60

_tables: dict[str, PieceTable] = {}


class PieceTable:
    """A vocabulary as an automaton over its pieces and the merge that makes each of them.

    Merging takes, of all neighbours whose text together is a piece, the pair with the best score, the leftmost of equals. `rank` is a score's place in that order; single
    characters come first, with rank -1. `left` and `right` are the two pieces that a piece's own text is merged from last.
    """

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        self.processor = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        size = sp.vocab_size()
        self.bytes = {}
        plain = []
        for i in range(size):
            if sp.is_byte(i):
                self.bytes[int(sp.id_to_piece(i)[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                plain.append((-sp.get_score(i), i, sp.id_to_piece(i)))
        if len(self.bytes) < 256:
            raise ValueError("the vocabulary has no byte pieces to fall back to")
        merged = sorted((x for x in plain if len(x[2]) > 1), key=lambda x: (x[0], len(x[2])))
        place = {s: r for r, s in enumerate(sorted({s for s, *_ in merged}))}
        single = {p: i for _, i, p in plain if len(p) == 1}
        chars = sorted(set(single) | {c for *_, p in merged for c in p})
        self.text = [*chars, *(p for *_, p in merged)]
        self.rank = [-1] * len(chars) + [place[s] for s, *_ in merged]
        self.node = {p: k for k, p in enumerate(self.text)}
        self.left, self.right = list(range(len(self.text))), list(range(len(self.text)))
        self._joins: dict[tuple[int, int], bool] = {}
        made = [True] * len(chars) + [False] * len(merged)
        for k in range(len(chars), len(self.text)):
            p = self.text[k]
            for at in range(1, len(p)):
                a, b = self.node.get(p[:at]), self.node.get(p[at:])
                if a is not None and b is not None and a < k and b < k and made[a] and made[b] and self._apart(a, b, self.rank[k]):
                    self.left[k], self.right[k], made[k] = a, b, True
                    break
            if not made[k] and len(self._merge(p)) == 1:
                raise ValueError(f"piece {p!r} is merged from pieces with worse scores; the table needs a merge-type vocabulary")
        self.automaton = ahocorasick.Automaton()
        for k, p in enumerate(self.text):
            if made[k]:
                self.automaton.add_word(p, k)
        self.automaton.make_automaton()
        number = {**single, **{p: i for _, i, p in merged}}
        self.ids = [self._packed([number[p]]) if p in number else self._fallback(p) for p in self.text]
        self.length = [len(p) for p in self.text]
        # a space mark that follows another character starts a new unit where no piece spans that place; so does a line end that no piece has
        cut = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.text)
        lone = "\n" if "\n" not in chars else ""
        self._unit = re.compile(f"{SPACE}*[^{SPACE}{lone}]+|{SPACE}+" + (f"|{lone}" if lone else "")) if cut else re.compile("(?s:.+)")
        self._known: dict[str, bytes] = {}
        self._surface = [b""] * size
        for i in range(size):
            self._surface[i] = b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else sp.id_to_piece(i).replace(SPACE, " ").encode()
        for b, i in self.bytes.items():
            self._surface[i] = bytes([b])
        self._control = {i for i in range(size) if sp.is_control(i)}
        self._spaced = {i for i in range(size) if sp.id_to_piece(i).startswith(SPACE)}
        self._byte_ids = {i: b for b, i in self.bytes.items()}
        # whether the model puts a space mark before a text, which decoding takes away again
        self._prefix = sp.normalize("a").startswith(SPACE)

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return np.array(ids, dtype="<u4").tobytes()

    def _fallback(self, text: str) -> bytes:
        return self._packed([self.bytes[b] for b in text.encode()])

    def _merge(self, text: str) -> list[str]:
        """Pieces of a short text by the merges themselves; only to prove a vocabulary's kind."""
        parts = list(text)
        while True:
            found = min(((self.rank[k], i) for i in range(len(parts) - 1) if (k := self.node.get(parts[i] + parts[i + 1])) is not None), default=None)
            if found is None:
                return parts
            parts[found[1] : found[1] + 2] = [parts[found[1]] + parts[found[1] + 1]]

    def _apart(self, a: int, b: int, limit: int = _NEVER) -> bool:
        """Whether no merge crosses the border of neighbours a and b before one of rank `limit` does.

        Goes back through the merges that made a and b, the latest first, and asks at each step whether the two pieces that then met at the border would have been merged before the next step was due.
        At equal rank the left of two merges is first: a makes all its merges of a rank before b does, and a crossing pair loses to a merge on its left and wins over one on its right.
        """
        rank, left, right = self.rank, self.left, self.right
        while True:
            k = self.node.get(self.text[a] + self.text[b])
            if k is not None and rank[k] < limit:
                return False
            if rank[a] < 0 and rank[b] < 0:
                return True
            if rank[a] > rank[b]:
                limit = rank[a]
                a = right[a]
            else:
                limit = rank[b] + 1
                b = left[b]

    def _follows(self, a: int, b: int) -> bool:
        found = self._joins.get((a, b))
        if found is None:
            if len(self._joins) >= 1 << 20:
                self._joins.clear()
            found = self._joins[a, b] = self._apart(a, b)
        return found

    def unit(self, text: str) -> bytes:
        """Ids of normalised text: the last piece of every prefix from left to right, then the pieces backwards. Time grows with the text's length, not its square."""
        last, length = [-1] * len(text), self.length
        for end, k in self.automaton.iter(text):
            if last[end] < 0:
                before = end - length[k]
                if before < 0 or last[before] < 0 or self._follows(last[before], k):
                    last[end] = k
        out, at = [], len(text) - 1
        while at >= 0:
            k = last[at]
            out.append(self._fallback(text[at]) if k < 0 else self.ids[k])
            at -= 1 if k < 0 else length[k]
        return b"".join(reversed(out))

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, without begin and end."""
        known, out = self._known, []
        for u in self._unit.findall(self.processor.normalize(text)) if text else ():
            ids = known.get(u)
            if ids is None:
                ids = self.unit(u)
                if len(u) <= UNIT_CHARS:
                    if len(known) >= UNITS:
                        known.clear()
                    known[u] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes that are no UTF-8 give one U+FFFD each. Control ids give nothing; a number outside the vocabulary is an IndexError."""
        first, last = 0, len(ids)
        while first < last and ids[first] in self._control:
            first += 1
        while last > first and ids[last - 1] in self._control:
            last -= 1
        ids = ids[first:last]
        parts = [self._surface[i] for i in ids]
        whole = b"" not in parts  # a control id inside ends a run of bytes
        if parts and self._prefix and ids[0] in self._spaced:
            parts[0] = parts[0][1:]
        if whole:
            try:
                return b"".join(parts).decode()
            except UnicodeDecodeError:
                pass
        out, run = [], b""
        for i, part in zip([*ids, None], [*parts, b""]):
            if i in self._byte_ids:
                run += part
            else:
                out += [_lenient(run), part.decode()]
                run = b""
        return "".join(out)


def _lenient(raw: bytes) -> str:
    out = ""
    while raw:
        try:
            return out + raw.decode()
        except UnicodeDecodeError as e:
            out += raw[: e.start].decode() + "�"
            raw = raw[e.start + 1 :]
    return out


def table_of(model_file: str) -> PieceTable:
    """The model's table, built once a process."""
    if model_file not in _tables:
        _tables[model_file] = PieceTable(model_file)
    return _tables[model_file]


def _flushed(rows: Iterator[tuple[tuple, int]], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n + 64
        if size >= FLUSH:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", ends: bool = True) -> DataFrame:
    """Rows (id, ids) for every row of docs: `ids` is binary, little-endian unsigned 32-bit piece numbers, with the model's begin and end numbers when `ends`. See `numbers` for arrays.

    Equal to the sentencepiece library without sampling, for merge-type vocabularies with byte pieces; others are a ValueError when the table is built. Null text counts as empty and gives begin and end only; null and
    repeated ids stay as they are; other columns are ignored. No rows give no rows. `model_file` must be on every executor; its table is of the vocabulary's size and built once a worker process.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(model_file)
        head, tail = (table._packed([table.begin]), table._packed([table.end])) if ends else (b"", b"")

        def rows() -> Iterator[tuple[tuple, int]]:
            for b in batches:
                for i, text in zip(b.column(0).to_pylist(), b.column(1)):
                    ids = head + table.encode(text.as_py() or "") + tail
                    yield (i, ids), len(ids)

        yield from _flushed(rows(), ["id", "ids"], [pa.int64(), pa.binary()])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, ids binary")


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """encoded(id, ids) with `decoded`, the text that the ids stand for, as the library's decode gives it. Null ids give null. Control ids give no text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(model_file)

        def rows() -> Iterator[tuple[tuple, int]]:
            for b in batches:
                for i, ids in zip(b.column(0).to_pylist(), b.column(1)):
                    raw = ids.as_py()
                    text = None if raw is None else table.decode(np.frombuffer(raw, "<u4").tolist())
                    yield (i, raw, text), len(raw or b"") + len(text or "")

        yield from _flushed(rows(), ["id", "ids", "decoded"], [pa.int64(), pa.binary(), pa.string()])

    return encoded.select("id", "ids").mapInArrow(run, "id long, ids binary, decoded string")


def numbers(ids: Column) -> Column:
    """Binary ids as array<long>."""
    pair = lambda i, k: F.substring(F.hex(ids), i * 8 + 7 - 2 * k, 2)
    at = F.sequence(F.lit(0), (F.octet_length(ids) / 4 - 1).cast("int"))
    found = F.transform(at, lambda i: F.conv(F.concat(*(pair(i, k) for k in range(4))), 16, 10).cast("long"))
    return F.when(F.octet_length(ids) > 0, found).when(ids.isNotNull(), F.array().cast("array<long>"))
