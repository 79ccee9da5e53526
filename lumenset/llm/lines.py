"""Line dedup: repeated lines are looked up in a sharded minimal perfect hash index.

Every distinct line that at least two documents hold is an entry of one shard. A shard is a minimal
perfect hash function with three arrays behind it: fingerprints, document counts, and the smallest
document id. Lines of documents travel once, as hashes, to the shard that would hold them; the shard
answers only for lines that must go. No line text is shuffled.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, functions as F, types as T

from .frames import binary, bound_batches, opened, packed, stored, text_rows, unpacked

KEYS_PER_SHARD = 100_000
PROBES_PER_CELL = 400_000


# The index of one shard


def build_index(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """A minimal perfect hash of distinct 64-bit keys: bit arrays by level, and the place of each key.

    At every level a key takes the slot its hash names if no other key of that level wants it; the
    rest go on to the next level. A key's place is the number of taken slots before its own.
    """
    levels, slots = [], np.zeros(len(keys), dtype=np.int64)
    left, base, level = np.arange(len(keys)), 0, 0
    while len(left):
        size = max(64, 2 * len(left))
        at = _slot(keys[left], level, size)
        alone = np.bincount(at, minlength=size)[at] == 1
        bits = np.zeros(size, dtype=bool)
        bits[at[alone]] = True
        levels.append(bits)
        slots[left[alone]] = base + at[alone]
        left, base, level = left[~alone], base + size, level + 1
    taken = np.concatenate(levels) if levels else np.zeros(0, dtype=bool)
    return levels, np.cumsum(taken)[slots] - 1 if len(keys) else slots


def look_up(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The place of each key; -1 where no level has its slot. A key not in the index may get any place."""
    out = np.full(len(keys), -1, dtype=np.int64)
    left, before = np.arange(len(keys)), 0
    for level, bits in enumerate(levels):
        at = _slot(keys[left], level, len(bits))
        hit = bits[at]
        out[left[hit]] = before + (np.cumsum(bits) - 1)[at[hit]]
        left, before = left[~hit], before + int(bits.sum())
    return out


def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    x = keys * np.uint64(0xD6E8FEB86659FD93) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(size)).astype(np.int64)


def _shard_index(key, table):
    columns = {c: table[c].to_numpy() for c in ("h", "fp", "n", "lo")}
    # two lines of one 64-bit hash are told apart by the fingerprint: the later ones get a key of their own
    keys = columns["h"].view(np.uint64) ^ columns["fp"].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    levels, place = build_index(keys)
    arrays = {}
    for c in ("fp", "n", "lo"):
        arrays[c] = np.empty(len(keys), dtype=np.int64)
        arrays[c][place] = columns[c]
    sizes = np.array([len(x) for x in levels], dtype=np.int64)
    bits = np.packbits(np.concatenate(levels))
    return pa.table(
        {
            "shard": pa.array([key[0].as_py()], pa.int64()),
            "load": pa.array([int(columns["n"].sum())], pa.int64()),
            "sizes": pa.array([sizes.tobytes()], pa.binary()),
            "bits": pa.array([bits.tobytes()], pa.binary()),
            "fps": pa.array([arrays["fp"].tobytes()], pa.binary()),
            "counts": pa.array([arrays["n"].tobytes()], pa.binary()),
            "owners": pa.array([arrays["lo"].tobytes()], pa.binary()),
        }
    )


INDEX = "shard long, load long, sizes binary, bits binary, fps binary, counts binary, owners binary"


def _probe(key, probes, index):
    h, fp, doc = (probes[c].to_numpy() for c in ("h", "fp", "doc"))
    drop = np.zeros(len(h), dtype=bool)
    if len(h) and index.num_rows:
        row = index.slice(0, 1).to_pylist()[0]
        sizes = np.frombuffer(row["sizes"], dtype=np.int64)
        bits = np.unpackbits(np.frombuffer(row["bits"], dtype=np.uint8))[: sizes.sum()].astype(bool)
        fps, owners = (np.frombuffer(row[c], dtype=np.int64) for c in ("fps", "owners"))
        keys = h.view(np.uint64) ^ fp.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        place = look_up(np.split(bits, np.cumsum(sizes)[:-1]), keys)
        at = np.maximum(place, 0)
        drop = (place >= 0) & (fps[at] == fp) & (owners[at] != doc)
    return pa.table({"doc": doc[drop], "h": h[drop], "fp": fp[drop]})


# Lines of documents


def split_lines(text: bytes | None) -> list[bytes]:
    return (text or b"").split(b"\n")


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The line stripped and in lower case; null if it is shorter than ``min_chars`` code points."""
    key = line.strip(b" \t\n\r\x0b\x0c").lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and sum((b & 0xC0) != 0x80 for b in key) < min_chars:
        return None
    return key


def _digests(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(k) for k in keys]), dtype="<i8").reshape(-1, 2)


def _document_lines(batch, min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """Digests of the distinct long lines of each document that has an id, and those ids."""
    digests, ids = [], []
    for doc, text in zip(batch["_id"].to_pylist(), binary(batch["_text"])):
        if doc is not None and text:
            keys = {k for k in (line_key(x, min_chars) for x in split_lines(text)) if k is not None}
            if keys:
                digests.append(_digests(list(keys)))
                ids.append(np.full(len(keys), doc, dtype=np.int64))
    if not ids:
        return np.empty((0, 2), dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate(digests), np.concatenate(ids)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """The documents without lines that an earlier document holds.

    Lines are compared by their key: both ends stripped of white space (0x20, 0x09-0x0D), A-Z in lower case.
    A key of at least ``min_chars`` code points that two documents hold keeps its lines only in the
    document of the smallest id. Returns the columns of ``docs`` with the remaining lines as the text,
    and ``n_lines`` and ``n_dropped``, which replace columns of those names.

    A null or empty text is one empty line and comes back as an empty text. Rows without an id keep all
    lines and count for none. Rows that share an id are one document: its lines stay in all of them. An empty table gives none.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = text_rows(docs, id_col, text_col)

    def count(batches):
        for batch in batches:
            digests, ids = _document_lines(batch, min_chars)
            order = np.lexsort((ids, digests[:, 1], digests[:, 0]))
            digests, ids = digests[order], ids[order]
            new = np.ones(len(ids), dtype=bool)
            new[1:] = (digests[1:] != digests[:-1]).any(axis=1)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(ids)) - 1
            columns = [digests[first, 0], digests[first, 1], ids[first], ids[last] if len(ids) else ids, last - first + 1]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["h", "fp", "lo", "hi", "n"])

    lines = rows.select("_id", "_text").mapInArrow(count, "h long, fp long, lo long, hi long, n long")
    lines = lines.groupBy("h", "fp").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    seen = Observation()
    lines = lines.observe(seen, F.count(F.lit(1)).alias("keys"), F.sum("n").alias("probes"))
    repeated = stored(lines.filter("lo < hi").drop("hi"), "lines")
    probes_in_all = int(seen.get["probes"] or 0)
    n_shards = max(1, -(-repeated.count() // KEYS_PER_SHARD), -(-probes_in_all // PROBES_PER_CELL))
    shard = (F.shiftrightunsigned("h", 33) % n_shards).alias("shard")
    index = stored(repeated.select(shard, "h", "fp", "n", "lo").groupBy("shard").applyInArrow(_shard_index, INDEX), "line-index")
    # shards of very common lines are probed in several cells; their number is bounded by all probes / PROBES_PER_CELL
    hot = {r["shard"]: 1 + r["load"] // PROBES_PER_CELL for r in index.filter(F.col("load") >= PROBES_PER_CELL).select("shard", "load").collect()}
    salts = F.floor(1 + F.col("load") / PROBES_PER_CELL)
    cells = index.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))

    def probe(batches):
        hot_shards = np.array(sorted(hot), dtype=np.int64)
        hot_salts = np.array([hot[s] for s in sorted(hot)], dtype=np.int64)
        for batch in batches:
            digests, ids = _document_lines(batch, min_chars)
            h, fp = digests[:, 0].copy(), digests[:, 1].copy()
            to = ((h.view(np.uint64) >> np.uint64(33)) % np.uint64(n_shards)).astype(np.int64)
            salt = np.zeros(len(h), dtype=np.int64)
            if len(hot_shards):
                at = np.minimum(np.searchsorted(hot_shards, to), len(hot_shards) - 1)
                split = hot_shards[at] == to
                salt[split] = ids[split] % hot_salts[at][split]
            names = ["shard", "salt", "h", "fp", "doc"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (to, salt, h, fp, ids)], names)

    probes = rows.select("_id", "_text").mapInArrow(probe, "shard long, salt long, h long, fp long, doc long")
    dropped = probes.groupBy("shard", "salt").cogroup(cells.groupBy("shard", "salt")).applyInArrow(_probe, "doc long, h long, fp long")
    by_doc = dropped.groupBy(F.col("doc").alias("_doc")).agg(F.collect_set(F.struct("h", "fp")).alias("_gone"))
    texts = packed(rows)
    joined = texts.join(by_doc, texts["_id"] == by_doc["_doc"], "left").drop("_doc")
    rest = rows.schema["_rest"]
    schema = T.StructType(
        [T.StructField("_id", T.LongType()), rest, T.StructField("_kept", T.StringType())]
        + [T.StructField(c, T.LongType()) for c in ("_lines", "_dropped")]
    )

    def keep(batches):
        for batch in batches:
            kept, n_lines, n_dropped = [], [], []
            for text, gone in zip(opened(batch["_blob"]), batch["_gone"].to_pylist()):
                lines = split_lines(text)
                n_lines.append(len(lines))
                if gone:
                    away = {(g["h"], g["fp"]) for g in gone}
                    keys = [line_key(x, min_chars) for x in lines]
                    lines = [x for x, k in zip(lines, keys) if k is None or tuple(_digests([k])[0].tolist()) not in away]
                n_dropped.append(n_lines[-1] - len(lines))
                kept.append(b"\n".join(lines))
            columns = [batch["_id"], batch["_rest"], pa.array(kept, pa.binary()).cast(pa.string())]
            columns += [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    out = joined.mapInArrow(keep, schema)
    return unpacked(out, docs, id_col, F.col("_kept"), text_col, {"n_lines": F.col("_lines"), "n_dropped": F.col("_dropped")})


def kept_by_brute_force(docs: list[tuple], min_chars: int = 10) -> list[tuple]:
    """(id, lines, dropped, SHA-256 of what is kept) of (id, text) rows, in plain Python; for tests."""
    holders = {}
    for doc, text in docs:
        for line in split_lines(None if text is None else text.encode()):
            key = line_key(line, min_chars)
            if key is not None and doc is not None:
                holders.setdefault(key, set()).add(doc)
    out = []
    for doc, text in docs:
        lines = split_lines(None if text is None else text.encode())
        kept = []
        for line in lines:
            owners = holders.get(line_key(line, min_chars) or b"", ())
            if doc is None or len(owners) < 2 or min(owners) == doc:
                kept.append(line)
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()))
    return out
