"""Fill-in-the-middle transformation: prefix, middle and suffix of a text change places around sentinels.

A text is cut at the ends of two of its lines. The cuts are scanned for in the bytes, the sentinels are inserted in a
bytearray, and neighbouring segments are exchanged in that array by rotation: reverse both, then their whole. The inverse
finds the sentinels, which occur once each in an output, rotates back and deletes them, so that the text comes back exactly.

Where a document is cut, and in which order its segments go, are fixed by the SHA-256 of its id. A null text is empty; an
empty text, or one that holds a sentinel itself, stays as it is (``plain``). A null id counts as empty text in the hash.
Repeated rows give repeated results, an empty table gives no rows, other columns are not read. Memory follows one slice of
texts, or one longer text.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from placewise.llm import common as C

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"  # fixed by the task
SALT = "7:"
FIM_PERCENT = 100  # of the texts that can be transformed
SPM_PERCENT = 50  # of those: suffix first; the others put the prefix first

SCHEMA = ("doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, "
          "restored_sha256 string")


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fim_percent: int = FIM_PERCENT,
                   spm_percent: int = SPM_PERCENT) -> DataFrame:
    """Per document: its id, ``n`` lines, ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` and the ``output``."""
    def run(batch):
        rows = [transform(text, draws(name), fim_percent, spm_percent)
                for text, name in zip(C.raw_texts(batch.column("text")), batch.column("name").to_pylist())]
        return {"doc_id": batch.column("doc_id"), "n": [r[0] for r in rows], "form": [r[1] for r in rows],
                "prefix_chars": pa.array([r[2] for r in rows], pa.int64()),
                "middle_chars": pa.array([r[3] for r in rows], pa.int64()),
                "output": pa.array([r[4] for r in rows], pa.binary()).cast(pa.string())}

    return C.per_chunk(_rows(df, id_col, text_col), "doc_id long, n long, form string, prefix_chars long, "
                       "middle_chars long, output string", run)


def restore_texts(df: DataFrame, output_col: str = "output", form_col: str = "form", to_col: str = "text") -> DataFrame:
    """The rows of ``df`` with the exact text of each output in ``to_col``; null where output or form is null."""
    fields = [f for f in df.schema.fields if f.name != to_col]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{to_col}` string"

    def run(batches):
        for batch in C.chunks(batches, output_col):
            texts = [None if text is None or form is None else restore(text, form) for text, form in
                     zip(batch.column(output_col).cast(pa.binary()).to_pylist(), batch.column(form_col).to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields),
                                              pa.array(texts, pa.binary()).cast(pa.string())],
                                             [*(f.name for f in fields), to_col])

    return df.mapInArrow(run, schema)


def fim_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fim_percent: int = FIM_PERCENT,
                spm_percent: int = SPM_PERCENT) -> DataFrame:
    """As ``fill_in_middle``, with the SHA-256 of the output and of the text rebuilt from output and form alone."""
    def run(batch):
        out = {name: [] for name in ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")}
        for text, name in zip(C.raw_texts(batch.column("text")), batch.column("name").to_pylist()):
            n, form, prefix, middle, output = transform(text, draws(name), fim_percent, spm_percent)
            for column, value in zip(out.values(), (n, form, prefix, middle, hashlib.sha256(output).hexdigest(),
                                                    hashlib.sha256(restore(output, form)).hexdigest())):
                column.append(value)
        whole = {c: pa.array(v, pa.int64()) for c, v in out.items() if c.endswith("_chars")}
        return {"doc_id": batch.column("doc_id"), **out, **whole}

    return C.per_chunk(_rows(df, id_col, text_col), SCHEMA, run)


def _rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return C.narrow(df, doc_id=df[id_col].cast("long"), text=text_col,
                    name=F.coalesce(df[id_col].cast("string"), F.lit("")))


def draws(name: str) -> list[int]:
    """Four numbers of 32 bits that a document's name fixes."""
    digest = hashlib.sha256((SALT + name).encode()).digest()
    return [int.from_bytes(digest[i:i + 4], "big") for i in range(0, 16, 4)]


def line_end(text: bytes, lines: int) -> int:
    """Where the first ``lines`` lines end."""
    at = 0
    for _ in range(lines):
        at = text.find(b"\n", at) + 1
        if not at:
            return len(text)
    return at


def chars(text: bytes) -> int:
    """Code points of valid UTF-8."""
    return len(text.decode("utf-8", "surrogatepass"))


def transform(text: bytes, draw: list[int], fim_percent: int, spm_percent: int) -> tuple:
    """Lines, form, code points of prefix and middle, and the transformed text."""
    n = text.count(b"\n") + (not text.endswith(b"\n") and bool(text))
    if not text or draw[2] % 100 >= fim_percent or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", None, None, text
    form = "spm" if draw[3] % 100 < spm_percent else "psm"
    few, many = sorted((draw[0] % (n + 1), draw[1] % (n + 1)))
    first = line_end(text, few)
    second = first + line_end(text[first:], many - few)
    prefix, middle = chars(text[:first]), chars(text[first:second])
    buffer = bytearray(text)
    for at, sentinel in ((second, SUFFIX), (first, MIDDLE), (0, PREFIX)):  # from the end: earlier places stay true
        buffer[at:at] = sentinel
    first, second = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    rotate(buffer, first if form == "psm" else 0, second, len(buffer))
    return n, form, prefix, middle, bytes(buffer)


def restore(output: bytes, form: str) -> bytes:
    """The text of an output, from the places of the sentinels in it."""
    if form == "plain":
        return output
    buffer = bytearray(output)
    begin, middle = (output.index(SUFFIX), output.index(MIDDLE)) if form == "psm" else (0, output.index(PREFIX))
    rotate(buffer, begin, middle, len(buffer))  # the suffix, in front of what it was exchanged with, goes back to the end
    for sentinel in (PREFIX, MIDDLE, SUFFIX):
        at = buffer.index(sentinel)
        del buffer[at:at + len(sentinel)]
    return bytes(buffer)


def rotate(buffer: bytearray, begin: int, cut: int, end: int) -> None:
    """Exchanges the neighbours begin..cut and cut..end in place: each is reversed, then both together."""
    for a, b in ((begin, cut), (cut, end), (begin, end)):
        buffer[a:b] = buffer[a:b][::-1]
