import hashlib
import random
import re

from corpora import documents, no_documents, rows, texts
from lumenset.llm import middles


def by_hand(doc, text, plain=10, spm=20, salt="1"):
    """(tokens, form, prefix, middle, output) with regular expressions and slices."""
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{salt}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    low, high = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    p, m, s = ("".join(x) for x in (tokens[:low], tokens[low:high], tokens[high:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - plain:
        return len(tokens), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def hard_texts():
    draw = random.Random(8)
    pieces = ["<", "P", ">", "<P", "S>", "é", "日本", "🙂", "abc", " ", "\n", "M", "<S", "\u0000", "ÿ"]
    return ["".join(draw.choice(pieces) for _ in range(draw.randrange(12))) for _ in range(600)] + ["<P>", "a<M>b", "<<S", "P>P>", "é"]


def test_one_document_after_the_other():
    for i, text in enumerate(hard_texts()):
        n, form, prefix, middle, table = middles.transformed(i, text.encode(), "1", 10, 20)
        assert (n, form, prefix, middle, table.joined().decode()) == by_hand(i, text)
        assert table.sha256() == hashlib.sha256(table.joined()).hexdigest()
        assert middles.parsed(table.joined(), form).joined().decode() == text


def test_segments(monkeypatch):
    whole = [middles.transformed(i, t.encode(), "1", 0, 50)[:4] for i, t in enumerate(hard_texts())]
    monkeypatch.setattr(middles, "SEGMENT", 3)
    assert [middles.transformed(i, t.encode(), "1", 0, 50)[:4] for i, t in enumerate(hard_texts())] == whole


def test_piece_tables_split_and_permute_descriptors():
    table = middles.PieceTable.of(b"abcdef").cut(2, 2, 6)
    assert table.pieces == ((0, 0, 2), (0, 2, 0), (0, 2, 4), (0, 6, 0))
    assert table.cut(3).joined() == b"abcdef"
    three = middles.PieceTable.of(b"abcdef").cut(2, 3)
    for order in middles.ORDERS.values():
        assert three.arranged(order).restored(order) == three
    assert three.arranged(middles.ORDERS["spm"]).joined() == b"<S>def<P>ab<M>c"
    assert all(t.text is three.text for t in (three.arranged(middles.ORDERS["psm"]), three.cut(1)))


def test_documents(spark):
    docs = documents(spark)
    out = middles.fill_in_middle(docs)
    assert out.columns == [*docs.columns, "n", "form", "prefix_chars", "middle_chars", "sha256"]
    found = {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.text) for r in out.collect()}
    assert found == {i: by_hand(i, t) for i, t in texts()}
    back = middles.restore_middle(out)
    assert back.columns == [*out.columns, "restored_sha256"]
    assert {r.doc_id: r.text for r in back.collect()} == {i: t or "" for i, t in texts()}
    assert {r.doc_id: r.restored_sha256 for r in middles.restore_middle(out, with_text=False).collect()} == {
        i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in texts()
    }


def test_other_shares(spark):
    out = middles.fill_in_middle(documents(spark), salt="7", plain=0, spm=100)
    assert {r.doc_id: (r.n, r.form, r.prefix_chars, r.middle_chars, r.text) for r in out.collect()} == {i: by_hand(i, t, 0, 100, "7") for i, t in texts()}


def test_repeated_rows_rows_without_an_id_and_no_rows(spark):
    out = middles.fill_in_middle(documents(spark, True)).collect()
    assert sorted((str(r.doc_id), r.text) for r in out) == sorted((str(r[0]), by_hand(r[0], r[1])[4]) for r in rows(True))
    empty = middles.fill_in_middle(no_documents(spark))
    assert empty.count() == 0 and middles.restore_middle(empty).count() == 0
