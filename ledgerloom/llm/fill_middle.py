"""Fill-in-the-middle transformation on piece tables.

A document is a list of descriptors (buffer, start, end) over two buffers that are never written: its text in UTF-8 and
the sentinels. Cutting splits a descriptor in two, an arrangement permutes the pieces and puts sentinel descriptors
between them, and the inverse permutation puts them back. Hashes stream the descriptors' bytes, so neither an output nor
a restored text is built unless it is asked for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import byte_lengths, ids_and_texts, steps

SENTINELS = {"P": b"<P>", "S": b"<S>", "M": b"<M>"}
#: What follows which sentinel in each form: the parts of the text by the letter of their sentinel.
ARRANGEMENTS = {"psm": "PSM", "spm": "SPM"}
TEXT, MARKS = 0, 1
#: The buffer of sentinels, and where each stands in it.
_MARKS = b"".join(SENTINELS.values())
_MARK = {k: (MARKS, _MARKS.index(v), _MARKS.index(v) + len(v)) for k, v in SENTINELS.items()}

Piece = tuple[int, int, int]


class PieceTable:
    """Descriptors over an immutable text buffer and the buffer of sentinels; every change gives a new table."""

    def __init__(self, text: bytes | memoryview, pieces: list[Piece] | None = None):
        self.buffers = (memoryview(text), memoryview(_MARKS))
        self.pieces = [(TEXT, 0, len(text))] if pieces is None else pieces

    def with_pieces(self, pieces: list[Piece]) -> PieceTable:
        return PieceTable(self.buffers[TEXT], pieces)

    def cut(self, at: int) -> PieceTable:
        """The descriptor that holds the ``at``-th byte of the sequence, split in two there; one of them may be empty."""
        pieces: list[Piece] = []
        for buffer, start, end in self.pieces:
            if 0 <= at <= end - start:
                pieces += [(buffer, start, start + at), (buffer, start + at, end)]
                at = -1
            else:
                pieces.append((buffer, start, end))
                at = at - (end - start) if at >= 0 else at
        return self.with_pieces(pieces)

    def arranged(self, form: str) -> PieceTable:
        """Prefix, middle and suffix, each behind its sentinel, in the order of ``form``; plain is the table itself."""
        if form == "plain":
            return self
        part = dict(zip("PMS", self.pieces, strict=True))
        return self.with_pieces([p for k in ARRANGEMENTS[form] for p in (_MARK[k], part[k])])

    def restored(self, form: str) -> PieceTable:
        """The inverse permutation of an arranged table: the text's pieces in their first order, without sentinels."""
        if form == "plain":
            return self
        part = dict(zip(ARRANGEMENTS[form], self.pieces[1::2], strict=True))
        return self.with_pieces([part[k] for k in "PMS"])

    def chunks(self) -> Iterator[memoryview]:
        return (self.buffers[b][start:end] for b, start, end in self.pieces if end > start)

    def sha256(self) -> str:
        h = hashlib.sha256()
        for chunk in self.chunks():
            h.update(chunk)
        return h.hexdigest()

    def to_bytes(self) -> bytes:
        return b"".join(self.chunks())


def parsed(output: bytes, form: str) -> PieceTable:
    """The arranged table of an output, found from its bytes and form alone.

    Sentinels stand at their first place behind one another: the text holds none, and as none ends as it begins, none can
    arise where two pieces meet.
    """
    table = PieceTable(output)
    if form == "plain":
        return table
    first, *others = (SENTINELS[k] for k in ARRANGEMENTS[form])
    if not output.startswith(first):
        raise ValueError(f"no {form} output: it begins with {output[:8]!r}")
    pieces: list[Piece] = [(TEXT, 0, len(first))]
    start = len(first)
    for mark in others:
        at = output.find(mark, start)
        if at < 0:
            raise ValueError(f"no {form} output: {mark!r} is missing")
        pieces += [(TEXT, start, at), (TEXT, at, at + len(mark))]
        start = at + len(mark)
    return table.with_pieces([*pieces, (TEXT, start, len(output))])


def byte_places(text: bytes, *places: int) -> list[int]:
    """Where the code points numbered ``places`` begin in UTF-8; the number after the last one is the text's end."""
    if text.isascii():
        return list(places)
    starts = np.flatnonzero((np.frombuffer(text, np.int8) >= -64))
    return [int(starts[p]) if p < len(starts) else len(text) for p in places]


def planned(docs: DataFrame, seed: str = "1", plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """doc_id, text (null: empty), n, form, cut1 and cut2 (code points) of every document: all from ``seed`` and the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring("_digest", 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    text: Column = F.coalesce("text", F.lit(""))
    rows = ids_and_texts(docs).select("doc_id", text.alias("text"), F.length(text).cast("long").alias("n"), digest.alias("_digest"))
    marked = F.lit(False)
    for mark in SENTINELS.values():
        marked = marked | F.contains("text", F.lit(mark.decode()))
    plain = (F.col("n") == 0) | marked | (h[2] % 100 >= plain_from)
    form = F.when(plain, "plain").when(h[3] % 100 < spm_below, "spm").otherwise("psm")
    ends = [h[i] % (F.col("n") + 1) for i in range(2)]
    return rows.select("doc_id", "text", "n", form.alias("form"), F.least(*ends).alias("cut1"), F.greatest(*ends).alias("cut2"))


def transform(docs: DataFrame, outputs: bool = False, seed: str = "1", plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of every row of ``docs`` (doc_id, text).

    With ``outputs`` also output, the transformed text. The restored text is rebuilt from the output's bytes and the form
    alone. Null and empty texts are plain, as are texts that hold a sentinel; parts of plain texts are null. A null doc_id
    has an empty number behind the seed. Repeated rows give equal rows, an empty table gives none. No shuffle; a task
    holds the text and the output of one document at a time beside its Arrow batch.
    """
    extra = ", output string" if outputs else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in steps(byte_lengths(batch.column(1))):
                ids, texts, n, forms, cut1, cut2 = (batch.column(i).slice(a, b - a) for i in range(6))
                hashes, back, made = [], [], []
                for i, form in enumerate(forms.to_pylist()):
                    text = texts[i].as_buffer().to_pybytes()
                    table = PieceTable(text)
                    if form != "plain":
                        first, second = byte_places(text, cut1[i].as_py(), cut2[i].as_py())
                        table = table.cut(second).cut(first)
                    table = table.arranged(form)
                    output = table.to_bytes()
                    hashes.append(table.sha256())
                    back.append(parsed(output, form).restored(form).sha256())
                    if outputs:
                        made.append(output.decode("utf-8", "surrogatepass"))
                arrays = [ids, n, forms, cut1, cut2, pa.array(hashes, pa.string()), pa.array(back, pa.string())]
                names = ["doc_id", "n", "form", "cut1", "cut2", "output_sha256", "restored_sha256"]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(made, pa.string())] * outputs, names=names + ["output"] * outputs)

    schema = f"doc_id long, n long, form string, cut1 long, cut2 long, output_sha256 string, restored_sha256 string{extra}"
    rows = planned(docs, seed, plain_from, spm_below).mapInArrow(run, schema)
    cut = F.col("form") != "plain"
    parts = [F.when(cut, F.col("cut1")).alias("prefix_chars"), F.when(cut, F.col("cut2") - F.col("cut1")).alias("middle_chars")]
    return rows.select("doc_id", "n", "form", *parts, "output_sha256", "restored_sha256", *(["output"] * outputs))
