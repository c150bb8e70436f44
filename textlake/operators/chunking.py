"""Splitting documents into chunks and assembling the text to embed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

SEPARATORS = ("\n\n", "\n", " ", "")  # fixed values, coarse to fine


def _pieces(text: str, sep: str) -> list[str]:
    """Split before each separator, so that joining the pieces gives the text back."""
    if not sep:
        return list(text)
    head, *rest = text.split(sep)
    return [p for p in [head, *(sep + r for r in rest)] if p]


def _pack(pieces: list[str], size: int, overlap: int):
    """Join consecutive pieces into chunks of at most ``size``, repeating up to ``overlap`` characters."""
    held, length = [], 0
    for piece in pieces:
        if held and length + len(piece) > size:
            yield "".join(held)
            while held and (length > overlap or length + len(piece) > size):
                length -= len(held.pop(0))
        held.append(piece)
        length += len(piece)
    if held:
        yield "".join(held)


def split_text(text: str, size: int = 1000, overlap: int = 0, separators=SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the coarsest separator that works."""
    level = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    finer = separators[level + 1 :]
    out, run = [], []
    for piece in _pieces(text, separators[level]):
        if len(piece) < size or not finer:
            run.append(piece)
            continue
        out.extend(_pack(run, size, overlap))
        run = []
        out.extend(split_text(piece, size, overlap, finer))
    out.extend(_pack(run, size, overlap))
    return [c for c in (chunk.strip() for chunk in out) if c]


def chunk_documents(
    df: DataFrame, id_col: str, text_col: str, size: int = 1000, overlap: int = 0, keep=()
) -> DataFrame:
    """``(id, chunk_no, chunk)`` plus the ``keep`` columns, which every chunk repeats."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be below size")
    carried = [id_col, *keep]
    schema = T.StructType(
        [df.schema[c] for c in carried]
        + [T.StructField("chunk_no", T.IntegerType()), T.StructField("chunk", T.StringType())]
    )

    def run(batches):
        for batch in batches:
            chunks = batch[text_col].map(lambda t: split_text(t, size, overlap) if t else [])
            out = batch[carried].assign(chunk=chunks, chunk_no=chunks.map(lambda c: list(range(len(c)))))
            out = out[chunks.map(len) > 0].explode(["chunk_no", "chunk"], ignore_index=True)
            if len(out):
                yield out[[*carried, "chunk_no", "chunk"]].astype({"chunk_no": "int32"})

    return df.select(*carried, text_col).mapInPandas(run, schema)


def page_content(cols: list[str]) -> Column:
    """``name: value`` lines of the given columns, NULL ones as the word None."""
    return F.concat_ws(
        "\n", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("None"))) for c in cols]
    )
