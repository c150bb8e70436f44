"""Byte-level BPE: exact merges in linear time by backtracking over an Aho-Corasick automaton.

``encode(docs, ...)`` adds the token ids of every text, ``decode`` turns ids back into bytes. Bytes are mapped to the
256 Latin-1 characters so that pyahocorasick can hold the vocabulary. A piece is covered from the left with the
longest token that starts at the place reached; a token that could not stand beside the one before it is exchanged
for its next shorter prefix, and when there is none the last token is taken back. Whether two tokens can be neighbours
(no merge would cross the border between them) is found from the merges of the vocabulary and remembered.

Defined results: a NULL text counts as empty and gives no ids; special tokens do not exist; repeated rows give equal
ids; texts of any length are taken whole; other columns of the input, whatever their names, are kept (a column named
like the output is replaced); an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from textlake.llm import bytetext as bt
from textlake.workers import tidy

BREAK = "Ā"  # outside Latin-1, so no token crosses it
REMEMBERED = 300_000  # pieces of the newer of two generations kept in a worker's memory; only speed depends on it
REMEMBERED_CHARS = 16 << 20  # and their length together
PIECE = 1 << 20  # bytes of text whose ids a task of ``recoded`` holds at once; a longer text is taken alone


def last_merge(word: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that the merges of ``word`` join last; None if they never make it whole."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 2:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 and word in ranks else None


class Tokenizer:
    """A rank file and a pattern; the tables are built at first use, once per Python worker.

    Every single byte must be in the vocabulary, as in any byte-level one.
    """

    def __init__(self, rank_file: bytes, pattern: str):
        self.rank_file, self.pattern, self.ready = rank_file, pattern, False

    def __getstate__(self):
        return {"rank_file": self.rank_file, "pattern": self.pattern, "ready": False}

    def build(self) -> Tokenizer:
        if self.ready:
            return self
        import ahocorasick

        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in self.rank_file.splitlines() if line.strip())}
        self.bytes_of = {i: w for w, i in self.ranks.items()}
        self.split: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.tree = ahocorasick.Automaton()
        for word, i in self.ranks.items():
            if len(word) == 1:
                self.split[i] = (i, i)
            elif (parts := last_merge(word, self.ranks)) is not None:
                self.split[i] = (self.ranks[parts[0]], self.ranks[parts[1]])
                self.merged[self.split[i]] = i
            else:
                continue  # no merges lead to it: it can only be a whole piece
            self.tree.add_word(word.decode("latin-1"), (len(word) - 1, i))
        self.tree.make_automaton()
        self.shorter = {i: self._prefix(self.bytes_of[i]) for i in self.split}
        self.length = {i: len(word) for i, word in self.bytes_of.items()}
        self.packed = {i: i.to_bytes(4, "little") for i in self.bytes_of}
        self.forget()
        self.find = regex.compile(self.pattern).findall
        self.ready = True
        return self

    def forget(self) -> None:
        """Start without remembered pieces and neighbours; the tables stay."""
        self.fits: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.chars = 0

    def _prefix(self, word: bytes) -> int:
        """The longest proper prefix that is a token; -1 if there is none."""
        for n in range(len(word) - 1, 0, -1):
            i = self.ranks.get(word[:n])
            if i is not None and i in self.split:
                return i
        return -1

    def neighbours(self, a: int, b: int) -> bool:
        """Whether the merges leave ``a`` and ``b`` side by side: undo them from the latest on, looking for an earlier one across."""
        key = a << 32 | b
        split, merged, before = self.split, self.merged, 1 << 62
        fits = True
        while True:
            across = merged.get((a, b))
            if across is not None and across < before:
                fits = False
                break
            undo_left, undo_right = split[a][0] != a, split[b][0] != b
            # the later merge of the two is undone first; of equal ones the right one, as merges run from the left
            if undo_left and (a > b or not undo_right):
                before, a = a, split[a][1]
            elif undo_right:
                before, b = b + 1, split[b][0]
            else:
                break
        if len(self.fits) > 4 * REMEMBERED:
            self.fits.clear()
        self.fits[key] = fits
        return fits

    def _cover(self, size: int, longest: list[int]) -> list[int]:
        length, shorter, fits = self.length, self.shorter, self.fits
        dead: set[int] = set()  # places from which no cover reaches the end
        out: list[int] = []
        at, last, token = 0, -1, longest[0]
        while True:
            while token >= 0:
                end = at + length[token]
                if end not in dead:
                    if last < 0:
                        break
                    fit = fits.get(last << 32 | token)
                    if fit is None:
                        fit = self.neighbours(last, token)
                    if fit:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                if end == size:
                    return out
                at, last, token = end, token, longest[end]
            else:
                dead.add(at)
                token = out.pop()
                at -= length[token]
                token = shorter[token]
                last = out[-1] if out else -1

    def learn(self, pieces: list[str]) -> None:
        """Encode new pieces and remember them; one pass of the automaton over all of them."""
        chars = sum(map(len, pieces))
        if len(self.known) + len(pieces) > REMEMBERED or self.chars + chars > REMEMBERED_CHARS:
            self.older, self.known, self.chars = self.known, {}, 0
        self.chars += chars
        known, older, packed, rest = self.known, self.older, self.packed, []
        for piece in pieces:
            if (ids := older.get(piece)) is not None:
                known[piece] = ids
                continue
            word = piece.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(word)
            if whole is not None:
                known[piece] = packed[whole]
            else:
                rest.append((piece, word.decode("latin-1")))
        for first in range(0, len(rest), 4096):
            block = rest[first : first + 4096]
            joined = BREAK.join([word for _, word in block])
            longest = [-1] * len(joined)
            for end, (back, token) in self.tree.iter(joined):
                longest[end - back] = token  # matches come by their end, so the longest comes last
            at = 0
            for piece, word in block:
                n = len(word)
                known[piece] = b"".join([packed[i] for i in self._cover(n, longest[at : at + n])])
                at += n + 1

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        pieces = self.find(text)
        try:
            return b"".join(map(self.known.__getitem__, pieces))
        except KeyError:
            pass
        out = []
        for first in range(0, len(pieces), 100_000):
            part = pieces[first : first + 100_000]
            self.learn([p for p in dict.fromkeys(part) if p not in self.known])
            known, older = self.known, self.older
            out += [known[p] if p in known else older[p] for p in part]
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        words = self.bytes_of
        return b"".join([words[i] for i in np.frombuffer(ids, "<u4").tolist()])


def load(spark: SparkSession, path: str, pattern: str):
    """Broadcast a tokenizer: the rank file (about 1 MB, its size does not depend on the data) and the pattern."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(Tokenizer(f.read(), pattern))


@contextlib.contextmanager
def opened(tokenizer) -> Iterator[Tokenizer]:
    """The built tokenizer for one task; a worker that waits or does other work afterwards does not hold what it remembered."""
    t = tokenizer.value.build()
    with tidy():
        try:
            yield t
        finally:
            t.forget()


def ids_column(tokenizer, text: Column) -> Column:
    """The ids of a text, as binary: little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = tokenizer.value.build()
        for texts in batches:
            yield pa.array((t.encode(x.as_py()) for x in texts), pa.binary())

    return F.arrow_udf(run, "binary")(text)


def encode(docs: DataFrame, tokenizer, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """Add ``ids_col`` (array of int) with the ids of every text."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = tokenizer.value.build()
        for texts in batches:
            found = [t.encode(x.as_py()) for x in texts]
            ends = np.cumsum([0] + [len(x) // 4 for x in found]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<u4").astype(np.int32)))

    return docs.withColumn(ids_col, F.arrow_udf(run, "array<int>")(F.col(text_col)))


def decode(docs: DataFrame, tokenizer, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """Add ``out_col`` (binary): the bytes that the ids stand for. NULL ids give NULL; an unknown id is an error."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = tokenizer.value.build()
        for rows in batches:
            yield pa.array((None if x is None else t.decode(np.array(x, "<u4").tobytes()) for x in rows.to_pylist()), pa.binary())

    return docs.withColumn(out_col, F.arrow_udf(run, "binary")(F.col(ids_col)))


def recoded(docs: DataFrame, tokenizer, text_col: str = "text", ids_col: str = "token_ids") -> DataFrame:
    """Encode every text, and put what its ids decode to in its place; one pass. A NULL text becomes an empty one.

    Ids that do not decode to valid UTF-8 are an error: whole texts always do. Rows leave a task in pieces of about 1 MB of text,
    so a task holds the ids of a piece and no more, and what it remembered of pieces is dropped at its end, as other stages
    follow in the same workers.
    """
    kept = docs.drop(ids_col)
    schema = T.StructType([*kept.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with opened(tokenizer) as t:
            for batch in batches:
                for first, texts in bt.slices(batch.column(at), PIECE):
                    found = [t.encode(x.as_py()) for x in texts]
                    ends = np.cumsum([0] + [len(x) // 4 for x in found]).astype(np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), "<i4")))
                    columns = batch.slice(first, len(texts)).columns
                    columns[at] = pa.array([t.decode(x).decode() for x in found], columns[at].type)
                    yield pa.RecordBatch.from_arrays([*columns, ids], schema.names)

    return kept.mapInArrow(run, schema)


def digests(docs: DataFrame, tokenizer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text in one pass: id, n_tokens, ids_sha256, decoded_sha256; ids themselves are not kept."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        t = tokenizer.value.build()
        for texts in batches:
            n, ids_hash, back_hash = [], [], []
            for x in texts:
                ids = t.encode(x.as_py())
                n.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                back_hash.append(hashlib.sha256(t.decode(ids)).hexdigest())
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(back_hash, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    made = F.arrow_udf(run, "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")(F.col(text_col))
    return docs.select(F.col(id_col), made.alias("made")).select(id_col, "made.n_tokens", "made.ids_sha256", "made.decoded_sha256")
