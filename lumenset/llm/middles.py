"""Fill-in-the-middle: documents cut in three and arranged anew, as descriptors over buffers that never change.

A document is a piece table: descriptors (buffer, start, length) over the bytes of its text and over one buffer of sentinels. Cutting
splits a descriptor, an arrangement permutes descriptors and puts sentinels between them, the inverse permutation restores
the document. Bytes are copied once, where a text leaves the operator; hashes stream over the descriptors.
"""

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.kinds import quoted
from .frames import binary, bound_batches, text_rows, unpacked

TEXT, SENTINEL = 0, 1
SENTINELS = b"<P><S><M>"
MARKS = {name: (SENTINEL, 3 * i, 3) for i, name in enumerate("PSM")}
# Places of the prefix, middle and suffix among the parts of an arranged text, each behind its sentinel.
ORDERS = {"psm": (("P", 0), ("S", 2), ("M", 1)), "spm": (("S", 2), ("P", 0), ("M", 1))}
SEGMENT = 1 << 20

# Classes of bytes: letters of A-Z and a-z, further bytes of a code point, and all others, which begin a token each.
LETTER, FURTHER, OTHER = 0, 1, 2
_CLASS = np.full(256, OTHER, dtype=np.uint8)
_CLASS[0x80:0xC0] = FURTHER
for _letters in (b"AZ", b"az"):
    _CLASS[_letters[0] : _letters[1] + 1] = LETTER


@dataclass(frozen=True)
class PieceTable:
    """Descriptors (buffer, start, length) over a text and the sentinels."""

    text: bytes
    pieces: tuple

    @classmethod
    def of(cls, text: bytes) -> "PieceTable":
        return cls(text, ((TEXT, 0, len(text)),))

    def cut(self, *offsets: int) -> "PieceTable":
        """Descriptors split at offsets (ascending) of the whole; empty ones stay, so n cuts of one piece make n + 1."""
        out, at, todo = [], 0, list(offsets)
        for place, (buffer, start, length) in enumerate(self.pieces):
            last = place == len(self.pieces) - 1
            while todo and (todo[0] < at + length or last):
                head = todo.pop(0) - at
                out.append((buffer, start, head))
                start, length, at = start + head, length - head, at + head
            out.append((buffer, start, length))
            at += length
        return PieceTable(self.text, tuple(out))

    def arranged(self, order: tuple) -> "PieceTable":
        """The pieces in another order, each behind its sentinel."""
        return PieceTable(self.text, tuple(p for mark, place in order for p in (MARKS[mark], self.pieces[place])))

    def restored(self, order: tuple) -> "PieceTable":
        """What :meth:`arranged` was given, without the sentinels."""
        behind = self.pieces[1::2]
        inverse = sorted(range(len(order)), key=lambda i: order[i][1])
        return PieceTable(self.text, tuple(behind[i] for i in inverse))

    def views(self):
        buffers = memoryview(self.text), memoryview(SENTINELS)
        return (buffers[buffer][start : start + length] for buffer, start, length in self.pieces)

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for view in self.views():
            digest.update(view)
        return digest.hexdigest()

    def joined(self) -> bytes:
        return b"".join(self.views())


def _starts(text: np.ndarray, at: int) -> np.ndarray:
    """Which bytes of the segment at ``at`` begin a token."""
    classes = _CLASS[text[at : at + SEGMENT]]
    before = np.empty_like(classes)
    before[1:] = classes[:-1]
    before[:1] = _CLASS[text[at - 1]] if at else OTHER
    return (classes == OTHER) | ((classes == LETTER) & (before != LETTER))


def count_tokens(text: bytes) -> tuple[int, np.ndarray]:
    """Tokens ``[A-Za-z]+|[^A-Za-z]`` of a text, and how many begin in each segment of it."""
    raw = np.frombuffer(text, dtype=np.uint8)
    counts = np.array([np.count_nonzero(_starts(raw, at)) for at in range(0, len(raw), SEGMENT)], dtype=np.int64)
    return int(counts.sum()), counts


def token_offset(text: bytes, counts: np.ndarray, token: int) -> int:
    """Byte at which a token begins; the end of the text for the token after the last."""
    ends = np.cumsum(counts)
    segment = int(np.searchsorted(ends, token, side="right"))
    if segment == len(counts):
        return len(text)
    inside = _starts(np.frombuffer(text, dtype=np.uint8), segment * SEGMENT)
    return segment * SEGMENT + int(np.flatnonzero(inside)[token - (ends[segment] - counts[segment])])


def code_points(text: bytes, start: int, stop: int) -> int:
    raw = np.frombuffer(text, dtype=np.uint8)
    return sum(int(np.count_nonzero(_CLASS[raw[at : min(at + SEGMENT, stop)]] != FURTHER)) for at in range(start, stop, SEGMENT))


def draws(doc_id: int | None, salt: str) -> tuple[int, ...]:
    """Four 32-bit numbers from the SHA-256 of the salt, a colon and the decimal id (nothing for a row without one)."""
    digest = hashlib.sha256(f"{salt}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def transformed(doc_id: int | None, text: bytes, salt: str, plain: int, spm: int):
    """(tokens, form, code points of the prefix, of the middle, arranged piece table) of one document."""
    first, second, form, order = draws(doc_id, salt)
    n, counts = count_tokens(text)
    table = PieceTable.of(text)
    if not text or form % 100 >= 100 - plain or any(SENTINELS[i : i + 3] in text for i in (0, 3, 6)):
        return n, "plain", None, None, table
    low, high = sorted((first % (n + 1), second % (n + 1)))
    cuts = token_offset(text, counts, low), token_offset(text, counts, high)
    name = "spm" if order % 100 < spm else "psm"
    return n, name, code_points(text, 0, cuts[0]), code_points(text, *cuts), table.cut(*cuts).arranged(ORDERS[name])


def parsed(text: bytes, form: str) -> PieceTable:
    """The document that an arranged text was made of, as descriptors over the arranged text.

    No part holds a sentinel, so the first of each one after the last is the one that was put there.
    """
    if form not in ORDERS:
        return PieceTable.of(text)
    order, pieces, at = ORDERS[form], [], 0
    for mark, _ in order:
        start = text.index(b"<%s>" % mark.encode(), at)
        if pieces:
            pieces[-1] = (TEXT, at, start - at)
        at = start + 3
        pieces += [MARKS[mark], (TEXT, at, len(text) - at)]
    return PieceTable(text, tuple(pieces)).restored(order)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salt: str = "1", plain: int = 10, spm: int = 20) -> DataFrame:
    """The documents arranged for training on filling in a middle.

    A text is cut before two of its tokens ``[A-Za-z]+|[^A-Za-z]`` (or its end), drawn from the id and ``salt``, into prefix, middle and suffix.
    ``plain`` per cent of documents, empty texts and texts that hold a sentinel stay as they are; of the others ``spm`` per
    cent become ``<S>``suffix``<P>``prefix``<M>``middle, the rest ``<P>``prefix``<S>``suffix``<M>``middle.

    Returns the columns of ``docs`` with the arranged text, and ``n`` (tokens), ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` (code
    points, null if plain) and ``sha256`` of the arranged text, which replace columns of those names. A null text counts as
    empty and comes back empty. Rows without an id draw the same numbers; repeated rows are arranged alike. An empty table gives none.
    """
    bound_batches(docs.sparkSession)
    rows = text_rows(docs, id_col, text_col)
    more = T.StructType.fromDDL("_out string, _n bigint, _form string, _prefix bigint, _middle bigint, _hash string")
    schema = T.StructType([rows.schema["_id"], rows.schema["_rest"], *more])

    def arrange(batches):
        for batch in batches:
            texts = [t or b"" for t in binary(batch["_text"])]
            found = [transformed(i, t, salt, plain, spm) for i, t in zip(batch["_id"].to_pylist(), texts)]
            n, form, prefix, middle, tables = zip(*found) if found else ((),) * 5
            columns = [pa.array([t.joined() for t in tables], pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(form, pa.string())]
            columns += [pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array([t.sha256() for t in tables], pa.string())]
            yield pa.RecordBatch.from_arrays([batch["_id"], batch["_rest"], *columns], schema.names)

    out = rows.mapInArrow(arrange, schema)
    names = {"n": "_n", "form": "_form", "prefix_chars": "_prefix", "middle_chars": "_middle", "sha256": "_hash"}
    return unpacked(out, docs, id_col, F.col("_out"), text_col, {k: F.col(v) for k, v in names.items()})


def restore_middle(docs: DataFrame, text_col: str = "text", form_col: str = "form", with_text: bool = True) -> DataFrame:
    """The documents that :func:`fill_in_middle` arranged, from the arranged text and ``form`` alone.

    Returns the columns of ``docs`` with the text as it was (without ``with_text`` as it is), and ``restored_sha256`` of the text as it was. A null text is
    empty; one of a null or another form is as it was. A text that lacks the sentinels of its form is an error.
    """
    bound_batches(docs.sparkSession)
    kept = F.struct(*[quoted(c) for c in docs.columns if c != text_col])
    rows = docs.select(quoted(text_col).cast("string").alias("_text"), quoted(form_col).cast("string").alias("_form"), kept.alias("_rest"))
    schema = T.StructType([rows.schema["_rest"], *T.StructType.fromDDL("_out string, _hash string")])

    def restore(batches):
        for batch in batches:
            texts = binary(batch["_text"])
            tables = [parsed(t or b"", f) for t, f in zip(texts, batch["_form"].to_pylist())]
            out = [t.joined() for t in tables] if with_text else texts
            columns = [pa.array(out, pa.binary()).cast(pa.string()), pa.array([t.sha256() for t in tables], pa.string())]
            yield pa.RecordBatch.from_arrays([batch["_rest"], *columns], schema.names)

    out = rows.mapInArrow(restore, schema)
    columns = [F.col("_out").alias(c) if c == text_col else F.col("_rest").getField(c).alias(c) for c in docs.columns if c != "restored_sha256"]
    return out.select(*columns, F.col("_hash").alias("restored_sha256"))
