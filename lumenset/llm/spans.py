"""Substring dedup: repeated word windows found in a compacted de Bruijn graph of the corpus.

An edge of the graph is a window of ``window`` words, from the node of its first ``window - 1`` words to
that of its last. Consecutive edges of a document that share their least ``anchor``-word hash form one
path, so the graph is shuffled by paths, about a tenth of the words, keyed by that anchor.

- A path whose anchor always stands in the same context has no branch inside: it is kept as one piece,
  repeated as often as its anchor. Paths of anchors seen once go no further.
- Where contexts differ the graph branches. Paths met twice in the very same context are repeated as they
  are; of the others, and of one source of each repeated one, the single edges are compared.
- Source coordinates (row, first word) carry what is repeated back to the documents.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .frames import binary, bound_batches, opened, packed, stored, text_rows, unpacked
from .words import as_long, encoded, hash_words, mix, window_hashes


def paths_of(words: np.ndarray, counts: np.ndarray, window: int, anchor: int):
    """Of all texts: anchor hash, context hash, first word within the text, number of edges, and text of each path."""
    empty = np.empty(0, dtype=np.int64)
    if len(words) < window:
        return empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty
    text = np.repeat(np.arange(len(counts)), counts)
    edges = np.flatnonzero(text[: len(words) - window + 1] == text[window - 1 :])
    if not len(edges):
        return empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty
    hashes = window_hashes(words, np.arange(len(words) - anchor + 1), anchor)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window - anchor + 1)
    least = np.empty(len(edges), dtype=np.int64)
    for a in range(0, len(edges), 1 << 17):
        part = edges[a : a + (1 << 17)]
        least[a : a + (1 << 17)] = views[part].argmin(axis=1) + part
    new = np.ones(len(edges), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (text[edges[1:]] != text[edges[:-1]])
    first = np.flatnonzero(new)
    start, n = edges[first], np.diff(np.append(first, len(edges)))
    context = mix(window_hashes(words, start, n + window - 1) + (least[first] - start).astype(np.uint64))
    begins = np.cumsum(counts) - counts
    return hashes[least[first]], context, start - begins[text[start]], n, text[start]


def row_keys(ids: list, texts: list[bytes]) -> pa.Array:
    """A 128-bit key of each row's id and text; equal rows have equal keys, and lose the same words."""
    seeds = ((1 << 64) - 1 if i is None else i & ((1 << 63) - 1) for i in ids)
    return pa.array([xxhash.xxh3_128_digest(t, seed=s) for t, s in zip(texts, seeds)], pa.binary())


def drop_repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, anchor: int = 16) -> DataFrame:
    """The documents without words that a repeated window covers.

    Words are runs of bytes other than space and 0x09-0x0D, compared as they are. A window is ``window`` consecutive
    words of one row; if its words also start anywhere else, in the same row or another, all words
    it covers go. Windows are judged on the input, not on what is left.

    Returns the columns of ``docs`` with the kept words joined by one space as the text, and ``n_words`` and
    ``n_removed``, which replace columns of those names. A null, empty or blank text has no words and comes
    back empty; a text of fewer words than a window keeps them all. Rows without an id take part like
    others. Repeated rows repeat their windows, so both lose them. An empty table gives none.
    """
    bound_batches(docs.sparkSession)
    factor = window - anchor + 2  # a path of n edges, at most window - anchor + 1, from word s is written s * factor + n
    rows = text_rows(docs, id_col, text_col)

    def cut(batches):
        for batch in batches:
            texts = encoded(binary(batch["_text"]))
            words, counts = hash_words(texts)
            anchors, contexts, start, n, text = paths_of(words, counts, window, anchor)
            keys = row_keys(batch["_id"].to_pylist(), texts)
            columns = [pa.array(as_long(anchors)), pa.array(as_long(contexts)), keys.take(pa.array(text)), pa.array(start * factor + n)]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "context", "row", "piece"])

    paths = rows.select("_id", "_text").mapInArrow(cut, "anchor long, context long, row binary, piece long")
    anchors = paths.groupBy("anchor").agg(F.min("context").alias("lo"), F.max("context").alias("hi"), F.count(F.lit(1)).alias("n"))
    met_again = stored(anchors.filter("n > 1").select("anchor", (F.col("lo") == F.col("hi")).alias("straight")), "anchors")
    repeated = stored(paths.join(met_again, "anchor"), "paths")
    # straight paths are repeated as a whole; the rest belong to anchors where the graph branches
    branching = repeated.filter("not straight").drop("straight")
    contexts = branching.groupBy("anchor", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "piece")).alias("source"))
    contexts = stored(contexts.select("anchor", "context", "source.*", (F.col("n") > 1).alias("known")), "contexts")
    whole = repeated.filter("straight").select("row", "piece").unionByName(
        branching.join(contexts.filter("known").select("anchor", "context"), ["anchor", "context"], "left_semi").select("row", "piece")
    )
    wanted = contexts.groupBy("row").agg(F.collect_list(F.struct("anchor", "piece", "known")).alias("wanted"))
    texts = packed(rows, row_key=row_keys)

    def open_paths(batches):
        for batch in batches:
            words, counts = hash_words(encoded(opened(batch["_blob"])))
            many = batch["wanted"].value_lengths().to_numpy()
            asked = batch["wanted"].flatten()
            anchors, pieces = (asked.field(c).to_numpy() for c in ("anchor", "piece"))
            known = asked.field("known").to_numpy(zero_copy_only=False)
            text = np.repeat(np.arange(len(counts)), many)
            n = pieces % factor
            edge = np.repeat(np.arange(len(pieces)), n)
            within = (pieces // factor)[edge] + np.arange(len(edge)) - np.repeat(np.cumsum(n) - n, n)
            hashes = window_hashes(words, (np.cumsum(counts) - counts)[text[edge]] + within, window)
            keys = batch["_row"].take(pa.array(text[edge]))
            columns = [pa.array(anchors[edge]), pa.array(as_long(hashes)), keys, pa.array(within), pa.array(known[edge])]
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "edge", "row", "at", "known"])

    opened_paths = texts.select("_row", "_blob").join(wanted, F.col("_row") == F.col("row")).select("_row", "_blob", "wanted")
    edges = opened_paths.mapInArrow(open_paths, "anchor long, edge long, row binary, at long, known boolean")
    # stored, so that Spark may split the rows of an edge that a large part of the documents holds
    twice = edges.groupBy("anchor", "edge").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor", "edge")
    twice = stored(twice, "edges")
    single = edges.filter("not known").join(twice, ["anchor", "edge"], "left_semi")
    single = single.select("row", (F.col("at") * factor + 1).alias("piece"))
    gone = whole.unionByName(single).groupBy(F.col("row").alias("_of")).agg(F.collect_list("piece").alias("_gone"))
    joined = texts.join(gone, texts["_row"] == gone["_of"], "left").drop("_of", "_row")
    rest = rows.schema["_rest"]
    schema = T.StructType(
        [T.StructField("_id", T.LongType()), rest, T.StructField("_kept", T.StringType())]
        + [T.StructField(c, T.LongType()) for c in ("_words", "_removed")]
    )

    def keep(batches):
        for batch in batches:
            kept, n_words, n_removed = [], [], []
            many = np.nan_to_num(batch["_gone"].value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            pieces = np.split(batch["_gone"].flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(many)[:-1])
            for text, piece in zip(opened(batch["_blob"]), pieces):
                words = (text or b"").split()
                n_words.append(len(words))
                if len(piece):
                    start, n = piece // factor, piece % factor
                    steps = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(steps, start, 1)
                    np.add.at(steps, start + n + window - 1, -1)
                    words = [w for w, inside in zip(words, np.cumsum(steps[:-1]) > 0) if not inside]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            columns = [batch["_id"], batch["_rest"], pa.array(kept, pa.binary()).cast(pa.string())]
            columns += [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    out = joined.mapInArrow(keep, schema)
    return unpacked(out, docs, id_col, F.col("_kept"), text_col, {"n_words": F.col("_words"), "n_removed": F.col("_removed")})


def kept_by_brute_force(docs: list[tuple], window: int = 35) -> list[tuple]:
    """(id, words, removed, SHA-256 of what is kept) of (id, text) rows, in plain Python; for tests."""
    texts = [(doc, (text or "").encode().split()) for doc, text in docs]
    seen = {}
    for _, words in texts:
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for doc, words in texts:
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if seen[tuple(words[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((doc, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out
