"""Line dedup (operator 10): sharded minimal perfect hashes over distinct line keys.

Every eligible line becomes a 128-bit key. Keys are dealt to shards as packed arrays (one row
for many lines). One job builds the index: a shard numbers its distinct keys by a minimal perfect
hash and keeps, per slot, a fingerprint, a document count and the first holder; a shard's index is
a row of a table in the shared folder, without the keys. Another job probes it: documents' packed
keys meet their shard's arrays, so no line is ever joined with a line. ``build_index`` and
``probe_index`` do so apart too, for documents that the index doesn't know: of their lines one in
2**32 is taken for another at most. Answers return per document and the texts are rebuilt in one pass.

Hot lines: a key that many documents of one batch hold is sent once for the batch, with its
smallest document; the shard's answer goes back to the batch, whose holders were set aside. So a
line held by a third of all documents reaches its shard once a batch, not once a document.

Defined results: a null or empty text is one empty line; a row whose id is null keeps all its
lines and is not counted as a holder; rows that share an id count as one document; a text
without eligible lines stays as it is; an empty table gives an empty result; other columns pass
through untouched, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import materialize, release, shards_for

MIN_CODE_POINTS = 10
BYTES_PER_SHARD = 64 << 20
#: A key held by so many documents of one batch is sent once for that batch.
HEAVY = 32

_ENTRY = "shard int, batch long, heavy boolean, hi binary, lo binary, doc binary"


class MinimalPerfectHash:
    """Levels of collision-free bits; a key's number is the rank of its bit. About 3 bits a key."""

    GAMMA = 1.7
    LEVELS = 40

    def __init__(self, hi: np.ndarray, lo: np.ndarray):
        """``hi``, ``lo``: the halves of distinct 128-bit keys."""
        self.levels: list[tuple[int, np.ndarray, np.ndarray, int]] = []
        base = 0
        for level in range(self.LEVELS):
            if not len(hi):
                break
            size = max(64, int(len(hi) * self.GAMMA))
            at = self._slot(hi, lo, level, size)
            once = np.bincount(at, minlength=size) == 1
            rank = np.cumsum(once, dtype=np.int64) - once
            self.levels.append((size, once, rank, base))
            base += int(once.sum())
            left = ~once[at]
            hi, lo = hi[left], lo[left]
        self.rest = {(int(a), int(b)): base + i for i, (a, b) in enumerate(zip(hi, lo, strict=True))}
        self.n = base + len(self.rest)

    @staticmethod
    def _slot(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
        x = hi ^ (lo * np.uint64(0x9E3779B97F4A7C15 + 2 * level & 0xFFFFFFFFFFFFFFFF))
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        return (x % np.uint64(size)).astype(np.int64)

    def index(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The number of each key; keys must be among those it was built from."""
        out = np.full(len(hi), -1, np.int64)
        todo = np.arange(len(hi))
        for level, (size, once, rank, base) in enumerate(self.levels):
            if not len(todo):
                break
            at = self._slot(hi[todo], lo[todo], level, size)
            hit = once[at]
            out[todo[hit]] = base + rank[at[hit]]
            todo = todo[~hit]
        for i in todo:
            out[i] = self.rest.get((int(hi[i]), int(lo[i])), -1)
        return out

    def packed(self) -> dict:
        """The function without its keys, as plain values."""
        rest = sorted(self.rest.items(), key=lambda x: x[1])
        return {"n": self.n, "sizes": [x[0] for x in self.levels], "bits": [np.packbits(x[1]).tobytes() for x in self.levels], "rest": np.array([k for k, _ in rest], np.uint64).tobytes()}

    @classmethod
    def unpacked(cls, n: int, sizes: list[int], bits: list[bytes], rest: bytes) -> MinimalPerfectHash:
        new = cls(np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        base = 0
        for size, b in zip(sizes, bits, strict=True):
            once = np.unpackbits(np.frombuffer(b, np.uint8), count=size).astype(bool)
            new.levels.append((size, once, np.cumsum(once, dtype=np.int64) - once, base))
            base += int(once.sum())
        left = np.frombuffer(rest, np.uint64).reshape(-1, 2).tolist()
        new.rest, new.n = {(a, b): base + i for i, (a, b) in enumerate(left)}, n
        return new


def line_key(line: bytes) -> bytes:
    """ASCII white space stripped at both ends, A-Z lower-cased (bytes methods touch ASCII alone)."""
    return line.strip().lower()


def eligible(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def _hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join([xxhash.xxh3_128_digest(k) for k in keys]), "<u8").reshape(-1, 2)
    return raw[:, 0].copy(), raw[:, 1].copy()


def _distinct(hi, lo, doc):
    """Distinct (key, document), sorted by key then document; and where a new key begins."""
    order = np.lexsort((doc, lo, hi))
    hi, lo, doc = hi[order], lo[order], doc[order]
    new_key = np.ones(len(hi), bool)
    new_key[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
    keep = new_key.copy()
    keep[1:] |= doc[1:] != doc[:-1]
    return hi[keep], lo[keep], doc[keep], new_key[keep]


def _index(n_shards: int, least: int):
    def run(batches):
        from pyspark import TaskContext

        batch_no = TaskContext.get().partitionId() << 32
        for b in batches:
            keys, docs = [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                if text and doc is not None:
                    found = {k for k in map(line_key, text.split(b"\n")) if eligible(k, least)}
                    keys += found
                    docs += [doc] * len(found)
            batch_no += 1
            if not keys:
                continue
            hi, lo, doc, first = _distinct(*_hashes(keys), np.array(docs, np.int64))
            group = np.cumsum(first) - 1
            start = np.flatnonzero(first)
            heavy = (np.diff(np.append(start, len(hi))) >= HEAVY)[group]
            shard = (hi % np.uint64(n_shards)).astype(np.int32)
            rows: dict[str, list] = {"shard": [], "batch": [], "heavy": [], "hi": [], "lo": [], "doc": []}

            def put(s, is_heavy, pick, rows=rows, hi=hi, lo=lo, doc=doc, batch_no=batch_no):
                for name, v in zip(rows, (s, batch_no, is_heavy, hi[pick].tobytes(), lo[pick].tobytes(), doc[pick].tobytes()), strict=True):
                    rows[name].append(v)

            for is_heavy, at in ((False, np.flatnonzero(~heavy)), (True, np.flatnonzero(heavy & first))):
                at = at[np.argsort(shard[at], kind="stable")]
                for part in np.split(at, np.flatnonzero(np.diff(shard[at])) + 1):
                    if len(part):
                        put(int(shard[part[0]]), is_heavy, part)
            if heavy.any():
                put(-1, True, np.flatnonzero(heavy))  # stays behind: who holds the heavy keys
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("shard", pa.int32()), ("batch", pa.int64()), ("heavy", pa.bool_()), ("hi", pa.binary()), ("lo", pa.binary()), ("doc", pa.binary())]))

    return run


def _cat(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


_ANSWER = pa.schema([("doc_id", pa.int64()), ("batch", pa.int64()), ("hi", pa.binary()), ("lo", pa.binary()), ("doc", pa.binary())])


def _grouped(by: np.ndarray, hi, lo, doc, as_doc: bool) -> pa.Table:
    """One row for each value of ``by`` with the packed keys that belong to it."""
    order = np.argsort(by, kind="stable")
    by, hi, lo, doc = by[order], hi[order], lo[order], doc[order]
    cuts = np.flatnonzero(np.diff(by)) + 1
    parts = np.split(np.arange(len(by)), cuts) if len(by) else []
    names = [int(by[p[0]]) for p in parts]
    none = [None] * len(parts)
    return pa.table([names if as_doc else none, none if as_doc else names, [hi[p].tobytes() for p in parts], [lo[p].tobytes() for p in parts], none if as_doc else [doc[p].tobytes() for p in parts]], schema=_ANSWER)


def _opened(entries: pa.Table):
    """What a shard's packed rows hold, an element for each key of a row: heavy, batch, hi, lo, doc."""
    sizes = np.array([len(x) // 8 for x in entries.column("doc").to_pylist()], np.int64)
    heavy = np.repeat(np.array(entries.column("heavy").to_pylist(), bool), sizes)
    batch = np.repeat(np.array(entries.column("batch").to_pylist(), np.int64), sizes)
    return heavy, batch, _cat(entries, "hi", "<u8"), _cat(entries, "lo", "<u8"), _cat(entries, "doc", "<i8")


_INDEX = pa.schema([("shard", pa.int32()), ("n", pa.int64()), ("sizes", pa.list_(pa.int64())), ("bits", pa.list_(pa.binary())), ("rest", pa.binary()), ("fingerprints", pa.binary()), ("counts", pa.binary()), ("holders", pa.binary())])
INDEX = "shard int, n long, sizes array<long>, bits array<binary>, rest binary, fingerprints binary, counts binary, holders binary"


def _build(entries: pa.Table) -> pa.Table:
    """One shard: number its distinct keys and fill the arrays."""
    heavy, _, hi, lo, doc = _opened(entries)
    uh, ul, _, first = _distinct(hi, lo, doc)
    mph = MinimalPerfectHash(uh[first], ul[first])
    slot = mph.index(hi, lo)
    fingerprint = np.zeros(mph.n, np.uint32)
    fingerprint[slot] = (lo >> np.uint64(32)).astype(np.uint32)
    holder = np.full(mph.n, np.iinfo(np.int64).max)
    np.minimum.at(holder, slot, doc)
    last = np.full(mph.n, np.iinfo(np.int64).min)
    np.maximum.at(last, slot, doc)
    count = np.where(holder < last, 2, 1).astype(np.uint8)  # of documents; 2 stands for two or more
    np.maximum.at(count, slot, np.where(heavy, 2, 1).astype(np.uint8))
    row = {"shard": entries.column("shard")[0].as_py()} | mph.packed() | {"fingerprints": fingerprint.tobytes(), "counts": count.tobytes(), "holders": holder.tobytes()}
    return pa.Table.from_pylist([row], schema=_INDEX)


def _probe(entries: pa.Table, index: pa.Table) -> pa.Table:
    """One shard: what the arrays say of every key, for its document, or for its batch where that has many holders."""
    heavy, batch, hi, lo, doc = _opened(entries)
    if not index.num_rows or not len(hi):
        return _ANSWER.empty_table()
    row = index.slice(0, 1).to_pylist()[0]
    mph = MinimalPerfectHash.unpacked(row["n"], row["sizes"], row["bits"], row["rest"])
    fingerprint, count, holder = (np.frombuffer(row[c], kind) for c, kind in (("fingerprints", "<u4"), ("counts", np.uint8), ("holders", "<i8")))
    slot = mph.index(hi, lo)
    hit = (slot >= 0) & (fingerprint[slot] == (lo >> np.uint64(32)).astype(np.uint32)) & ((count[slot] >= 2) | (doc != holder[slot]))
    plain = hit & ~heavy & (doc != holder[slot])
    deferred = hit & heavy
    return pa.concat_tables([
        _grouped(doc[plain], hi[plain], lo[plain], doc[plain], True),
        _grouped(batch[deferred], hi[deferred], lo[deferred], holder[slot][deferred], False),
    ])


def _settle(batches):
    """The heavy keys of a batch: their holders but the first lose the line."""
    for b in batches:
        t = pa.Table.from_batches([b])
        for i in range(t.num_rows):
            row = {n: t.column(n)[i].as_py() for n in t.column_names}
            known = {}
            for h, l, d in zip(row["a_hi"], row["a_lo"], row["a_doc"], strict=True):
                for k in zip(np.frombuffer(h, "<u8"), np.frombuffer(l, "<u8"), np.frombuffer(d, "<i8"), strict=True):
                    known[int(k[0]), int(k[1])] = int(k[2])
            hi, lo, doc = (np.frombuffer(row[n], k) for n, k in (("hi", "<u8"), ("lo", "<u8"), ("doc", "<i8")))
            first = np.array([known.get((int(a), int(c)), int(d)) for a, c, d in zip(hi, lo, doc, strict=True)], np.int64)
            lose = doc != first
            out = _grouped(doc[lose], hi[lose], lo[lose], doc[lose], True).select(["doc_id", "hi", "lo"])
            yield from out.to_batches()


def _rebuild(least: int):
    def run(batches):
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            out: dict[str, list] = {"text": [], "n_lines": [], "n_dropped": []}
            for text, his, los in zip(texts, b.column("hi").to_pylist(), b.column("lo").to_pylist(), strict=True):
                lines = (text or b"").split(b"\n")
                n = len(lines)
                if his:
                    drop = set()
                    for h, l in zip(his, los, strict=True):
                        drop.update(zip(np.frombuffer(h, "<u8").tolist(), np.frombuffer(l, "<u8").tolist(), strict=True))
                    keys = [line_key(x) for x in lines]
                    hi, lo = _hashes(keys)
                    lines = [x for x, k, h, l in zip(lines, keys, hi.tolist(), lo.tolist(), strict=True) if (h, l) not in drop or not eligible(k, least)]
                    text = b"\n".join(lines)
                out["text"].append(text)
                out["n_lines"].append(n)
                out["n_dropped"].append(n - len(lines))
            rest = [b.column(i) for i, name in enumerate(b.schema.names) if name not in ("text", "hi", "lo")]
            names = [name for name in b.schema.names if name not in ("text", "hi", "lo")]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(out["text"], pa.binary()).cast(pa.string()), pa.array(out["n_lines"], pa.int64()), pa.array(out["n_dropped"], pa.int64())], names=[*names, "text", "n_lines", "n_dropped"])

    return run


def _entries(docs: DataFrame, doc_id: str, text: str, least: int, n_shards: int) -> DataFrame:
    base = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    return materialize(base.mapInArrow(_index(n_shards, least), _ENTRY), "lines")


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_code_points: int = MIN_CODE_POINTS, bytes_per_shard: int = BYTES_PER_SHARD, entries: DataFrame | None = None) -> DataFrame:
    """The index of the documents' lines, a row for each shard that has any; as many shards as there are partitions of hashes."""
    made = entries is None
    if made:
        entries = _entries(docs, doc_id, text, min_code_points, shards_for(docs, text, bytes_per_shard))
    index = materialize(entries.where("shard >= 0").groupBy("shard").applyInArrow(_build, INDEX), "line-index")
    if made:
        release(entries)
    return index


def probe_index(index: DataFrame, entries: DataFrame) -> DataFrame:
    """doc_id, hi, lo: packed keys of the lines that a document loses to a smaller one, some rows a document."""
    probes = entries.where("shard >= 0").groupBy("shard").cogroup(index.groupBy("shard"))
    answers = materialize(probes.applyInArrow(_probe, "doc_id long, batch long, hi binary, lo binary, doc binary"), "answers")
    per_batch = answers.where("batch is not null").groupBy("batch").agg(F.collect_list("hi").alias("a_hi"), F.collect_list("lo").alias("a_lo"), F.collect_list("doc").alias("a_doc"))
    settled = entries.where("shard < 0").select("batch", "hi", "lo", "doc").join(per_batch, "batch").select("hi", "lo", "doc", "a_hi", "a_lo", "a_doc").mapInArrow(_settle, "doc_id long, hi binary, lo binary")
    lost = materialize(answers.where("doc_id is not null").select("doc_id", "hi", "lo").unionByName(settled), "lost-lines")
    release(answers)
    return lost


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_code_points: int = MIN_CODE_POINTS, bytes_per_shard: int = BYTES_PER_SHARD) -> DataFrame:
    """``docs`` with repeated lines left only in their smallest document.

    Returns the columns of ``docs`` as a struct ``doc`` (other than the text), and ``text``
    (rebuilt; null stays null), ``n_lines`` (before) and ``n_dropped``.
    """
    entries = _entries(docs, doc_id, text, min_code_points, shards_for(docs, text, bytes_per_shard))
    index = build_index(docs, doc_id, text, min_code_points, entries=entries)
    lost = probe_index(index, entries)
    release(entries, index)
    drops = lost.groupBy(F.col("doc_id").alias("drop_id")).agg(F.collect_list("hi").alias("hi"), F.collect_list("lo").alias("lo"))
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    whole = docs.select(F.struct(*others).alias("doc"), F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    joined = whole.join(drops, F.col("id") == F.col("drop_id"), "left").select("doc", "text", "hi", "lo")
    kind = joined.schema["doc"].dataType.simpleString()
    return joined.mapInArrow(_rebuild(min_code_points), f"doc {kind}, text string, n_lines long, n_dropped long")


def kept_digest(out: DataFrame) -> DataFrame:
    """The digest columns of a deduplicated table."""
    return out.select(F.col("doc.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], least: int = MIN_CODE_POINTS) -> list[tuple]:
    """The contract, literally; for tests."""
    first: dict[bytes, int] = {}
    held: dict[bytes, set] = {}
    split = [(d, (t or "").encode().split(b"\n")) for d, t in rows]
    for d, lines in split:
        for x in lines:
            k = line_key(x)
            if len(k.decode()) >= least and d is not None:
                held.setdefault(k, set()).add(d)
                first[k] = min(first.get(k, d), d)
    out = []
    for d, lines in split:
        kept = [x for x in lines if d is None or not (len(held.get(k := line_key(x), ())) >= 2 and first[k] != d)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()))
    return out
