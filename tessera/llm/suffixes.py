"""Suffix-array dedup (operator 6): byte strings that also start in a smaller document.

A sparse suffix array: of all suffixes only those at anchors are sorted, and only at anchors
that two documents may share (each 50-byte string has one anchor, at the same place in every
copy, so nothing is lost). An anchor carries the bytes around it that its windows cover. Sampled
splitters range-partition the anchors by their suffix's leading bytes. A bucket sorts its suffixes
by multikey quicksort (eight bytes at a time, all open groups at once) and takes
the common prefix of neighbours; the bytes before the anchors are sorted alike, backwards. A window
that starts j bytes before its anchor equals another if the suffixes share 50 - j bytes and the
contexts before share j: both are intervals of the sorted orders, numbered without any hash. The
smallest document of each such class keeps its copy.

Boundaries: splitters cut at the first sixteen bytes of a suffix. Equal windows have equal anchors
and so equal leading bytes; they never straddle a boundary, and comparing the last suffix of a
bucket with the first of the next would find no common anchor. Equal contexts within a batch of
documents are sent once, for the smallest document; all others are known to repeat. So a passage
of a third of all documents is sent once a batch.

Defined results: a null or empty text has no bytes; a row with a null id keeps all its bytes
and is no holder; rows that share an id are one document, whose texts lose each what a smaller
document holds; a string repeated within one document
alone stays; texts under 50 bytes stay; what is left of a text may cut a character, so it comes
as bytes; an empty table gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._anchors import Scheme, U, block_of, by_text, keys_of, mix, pack, shared_anchors, short_hash, sliding_argmin
from tessera.llm._common import hash_under, materialize, release, shards_for

WINDOW, ANCHOR = 50, 20
BEFORE = WINDOW - ANCHOR
BYTES_PER_SHARD = 10 << 20
#: Leading bytes that splitters look at; fewer than an anchor's.
LEADING = 16
#: Suffixes of a sample that place each splitter, and in all at most; they decide balance, not results.
PER_SPLITTER, MOST_SAMPLED = 64, 2_000_000
#: One suffix in so many of a sampled document is taken, so that many documents take part.
THIN = 8

_TABLE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


def _symbols(text: bytes) -> np.ndarray:
    return _TABLE[np.frombuffer(text, np.uint8)]


SCHEME = Scheme(WINDOW, ANCHOR, _symbols, 1_000_000)

_ENTRY = pa.schema([("bucket", pa.int32()), ("block", pa.int32()), ("context", pa.binary()), ("doc", pa.binary()), ("copy", pa.binary()), ("at", pa.binary()), ("first", pa.binary()), ("last", pa.binary())])
ENTRY = "bucket int, block int, context binary, doc binary, copy binary, at binary, first binary, last binary"


def _leading(context: np.ndarray) -> np.ndarray:
    """The suffix's first bytes, all of which its anchor covers; they compare in the order of bytes."""
    return np.ascontiguousarray(context[:, BEFORE : BEFORE + LEADING]).view(f"S{LEADING}").ravel()


def _contexts(text: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Rows of BEFORE + WINDOW bytes around ``at``; bytes that no window of lo..hi covers are 0."""
    padded = np.concatenate([np.zeros(BEFORE, np.uint8), text, np.zeros(WINDOW, np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, BEFORE + WINDOW)[at].copy()
    place = np.arange(-BEFORE, WINDOW, dtype=np.int32)
    rows[(place < (lo - at)[:, None]) | (place >= (hi + WINDOW - at)[:, None])] = 0
    return rows


def _anchored(text: bytes, keys: np.ndarray):
    """Each run of windows with one shared anchor: place of the anchor, first and last window."""
    symbols = _symbols(text)
    h = SCHEME.hashes(symbols)
    a = sliding_argmin(h, WINDOW - ANCHOR + 1)[: max(0, len(text) - WINDOW + 1)]
    new = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(a)) - 1
    keep = np.isin(h[a[new]], keys)
    return a[new][keep].astype(np.int64), new[keep], last[keep]


def _entries(splitters: np.ndarray):
    def run(batches):
        for b in batches:
            docs, copies, keys = b.column("id").to_pylist(), b.column("copy").to_pylist(), b.column("keys").to_pylist()
            texts = b.column("text").cast(pa.binary()).to_pylist()
            held: list[tuple] = []
            size = 0
            for doc, copy, packed, text in zip(docs, copies, keys, texts, strict=True):
                known, text = keys_of(packed), text or b""
                for s in range(0, max(0, len(text) - WINDOW + 1), SCHEME.chunk):
                    piece = text[s : s + SCHEME.chunk + WINDOW - 1]
                    at, lo, hi = _anchored(piece, known)
                    if len(at):
                        held.append((_contexts(np.frombuffer(piece, np.uint8), at, lo, hi), np.full(len(at), doc), np.full(len(at), copy, np.uint32), at + s, at - lo, at - hi))
                        size += len(at)
                if held and size > 150_000:
                    yield _batch(splitters, *(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, size = [], 0
            if held:
                yield _batch(splitters, *(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _batch(splitters, context, doc, copy, at, first, last) -> pa.RecordBatch:
    """``first``, ``last``: how many bytes before the anchor the first and the last window start."""
    words = context.view(U).reshape(len(context), -1)
    h = mix(first.astype(U) * U(64) + last.astype(U))
    for i in range(words.shape[1]):
        h = mix(h + words[:, i] * U(2 * i + 0x9E3779B97F4A7C15))
    order = np.lexsort((at, doc, h))
    context, words, doc, copy, at, first, last, h = (x[order] for x in (context, words, doc, copy, at, first, last, h))
    head = np.flatnonzero(np.append(True, h[1:] != h[:-1]))[np.cumsum(np.append(True, h[1:] != h[:-1])) - 1]
    same = (words == words[head]).all(axis=1) & (first == first[head]) & (last == last[head])
    late = same & (doc != doc[head])
    sent = ~late
    out: dict[str, list] = {n: [] for n in _ENTRY.names}

    def put(*values):
        for n, v in zip(out, values, strict=True):
            out[n].append(v)

    bucket = np.searchsorted(splitters, _leading(context[sent]), side="right").astype(np.int32)
    for c, d, v, a, f, z, i in pack(bucket, context[sent], doc[sent], copy[sent], at[sent].astype(np.uint32), first[sent].astype(np.uint8), last[sent].astype(np.uint8)):
        put(int(bucket[i]), None, c, d, v, a, f, z)
    n = len(splitters) + 1
    block = block_of(doc[late], n)
    for d, v, a, z, i in pack(block, doc[late], copy[late], (at - first)[late].astype(np.uint32), (at - last + WINDOW)[late].astype(np.uint32)):
        put(int(block[i]), int(block[i]), None, d, v, None, a, z)
    return pa.RecordBatch.from_pydict(out, schema=_ENTRY)


def multikey_sort(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort: the order of byte rows, and the bytes that each shares with the one before it (in that order).

    Many rows are first parted by some hundred sampled pivots at their first eight bytes. Then all groups that
    are still open are parted at once, by a pivot each, into smaller, equal and larger ones at the
    group's depth; those equal go on at the next eight bytes, the others at the same.
    """
    n, width = rows.shape
    words = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, -width % 8)))).view(">u8").astype(U)
    order = np.arange(n)
    start = np.zeros(n + 1, bool)  # where a group starts, in the order so far
    start[[0, n]] = True
    if n > 4096:
        pivots = np.unique(np.sort(words[:: n // 1000, 0])[::4])[:255]
        part = np.searchsorted(pivots, words[:, 0], side="right").astype(np.uint8)
        order = np.argsort(part, kind="stable")
        start[1:n] = np.diff(part[order]) != 0
    number = np.empty(n, np.int64)  # of a place among those open
    at, depth = np.arange(n), np.zeros(n, np.int64)  # places of groups still open, and the depth of each place
    while len(at):
        row = order[at]
        first = np.flatnonzero(start[at])
        size = np.diff(np.append(first, len(at)))
        group = np.repeat(np.arange(len(first)), size)
        w = words[row, depth]
        ends = first + size - 1
        three = np.sort(np.stack([w[first], w[first + size // 2], w[ends]]), axis=0)
        pivot = three[1][group]
        side = (w >= pivot).astype(np.int8) + (w > pivot)
        # each place's new one: its group's start, the smaller sides, and its rank among its own side
        to = np.empty(len(at), np.int64)
        base = at[first]
        for s in range(3):
            mine = side == s
            upto = np.cumsum(mine)
            before = (upto - mine)[first]
            to[mine] = (base[group] + upto - 1 - before[group])[mine]
            count = np.add.reduceat(mine, first, dtype=np.int64)
            start[base[count > 0]] = True
            base = base + count
        order[to] = row
        old, depth = depth, np.empty(len(at), np.int64)
        number[at] = np.arange(len(at))
        depth[number[to]] = old + (side == 1)
        alone = start[at] & start[at + 1]
        on = ~alone & (depth < words.shape[1])
        at, depth = at[on], depth[on]
    lcp = np.zeros(n, np.int32)
    for part in np.array_split(np.arange(1, n), max(1, n // 100_000)):
        differ = rows[order[part]] != rows[order[part - 1]]
        lcp[part] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, lcp


_SPAN = pa.schema([("block", pa.int32()), ("doc", pa.binary()), ("copy", pa.binary()), ("first", pa.binary()), ("last", pa.binary())])
SPAN = "block int, doc binary, copy binary, first binary, last binary"


def _bucket(n_blocks: int):
    return lambda t: _sorted_bucket(t, n_blocks)


def _sorted_bucket(t: pa.Table, n_blocks: int) -> pa.Table:
    """One bucket: windows that a smaller document holds, as [start, end) of bytes; those known before pass through."""
    known = t.filter(pc.is_valid(t.column("block"))).select(_SPAN.names).cast(_SPAN)
    t = t.filter(pc.is_null(t.column("block")))
    if not t.num_rows:
        return known
    join = lambda n, kind: np.frombuffer(b"".join(t.column(n).to_pylist()), kind)
    context = join("context", np.uint8).reshape(-1, BEFORE + WINDOW)
    doc, copy, at, first, last = join("doc", "<i8"), join("copy", "<u4"), join("at", "<u4").astype(np.int64), join("first", np.uint8).astype(np.int64), join("last", np.uint8).astype(np.int64)
    n = len(doc)
    right, r_lcp = multikey_sort(context[:, BEFORE:])
    left, l_lcp = multikey_sort(np.ascontiguousarray(context[:, BEFORE - 1 :: -1]))
    starts, rows = [], []
    for j in range(BEFORE + 1):
        mine = np.flatnonzero((last <= j) & (j <= first))
        if not len(mine):
            continue
        gid_r, gid_l = np.empty(n, np.int64), np.empty(n, np.int64)
        gid_r[right] = np.cumsum(r_lcp < WINDOW - j)
        gid_l[left] = np.cumsum(l_lcp < j)
        key = (gid_r[mine] << 32) | gid_l[mine]
        order = np.argsort(key)
        key = key[order]
        new = np.append(True, key[1:] != key[:-1])
        least = np.minimum.reduceat(doc[mine][order], np.flatnonzero(new))[np.cumsum(new) - 1]
        hit = mine[order][doc[mine][order] > least]
        starts.append(at[hit] - j)
        rows.append(hit)
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    owner, of = doc[row], copy[row]
    order = np.lexsort((start, of, owner))
    start, owner, of = start[order], owner[order], of[order]
    new = np.append(True, (owner[1:] != owner[:-1]) | (of[1:] != of[:-1]) | (start[1:] > start[:-1] + 1))[: len(start)]
    begin = np.flatnonzero(new)
    ends = start[np.append(begin[1:], len(start)) - 1] + WINDOW if len(start) else start
    start, owner, of = start[begin], owner[begin], of[begin]
    block = block_of(owner, n_blocks)
    rows = [(int(block[i]), d, v, a, z) for d, v, a, z, i in pack(block, owner.astype(np.int64), of, start.astype(np.uint32), ends.astype(np.uint32))]
    cols = list(zip(*rows, strict=True)) or [()] * 5
    return pa.concat_tables([known, pa.table([pa.array(c, f.type) for c, f in zip(cols, _SPAN, strict=True)], schema=_SPAN)])


def _merged(t: pa.Table) -> pa.Table:
    """One block: the merged spans of each document's text."""
    doc, copy, first, last = (np.frombuffer(b"".join(t.column(n).to_pylist()), kind) for n, kind in (("doc", "<i8"), ("copy", "<u4"), ("first", "<u4"), ("last", "<u4")))
    rows = []
    for d, c, at in by_text(doc, copy):
        a, z = merge_spans(first[at].astype(np.int64), last[at].astype(np.int64))
        rows.append((d, c, a.astype(np.uint32).tobytes(), z.astype(np.uint32).tobytes()))
    cols = list(zip(*rows, strict=True)) or [()] * 4
    return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["drop_id", "drop_copy", "first", "last"])


def merge_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of [start, end)."""
    order = np.argsort(start, kind="stable")
    start, upto = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > upto[:-1])
    at = np.flatnonzero(new)
    return start[at], upto[np.append(at[1:], len(start)) - 1]


def _remove(batches):
    for b in batches:
        names = b.schema.names
        texts = b.column(names.index("text")).cast(pa.binary()).to_pylist()
        kept, n_bytes, n_removed, n_spans = [], [], [], []
        for text, first, last in zip(texts, b.column(names.index("first")).to_pylist(), b.column(names.index("last")).to_pylist(), strict=True):
            text = text or b""
            n_bytes.append(len(text))
            spans = 0
            if first:
                s, e = np.frombuffer(first, "<u4"), np.frombuffer(last, "<u4")
                spans = len(s)
                view = memoryview(text)
                text = b"".join(view[a:z] for a, z in zip([0, *e.tolist()], [*s.tolist(), len(view)], strict=True))
            kept.append(text)
            n_removed.append(n_bytes[-1] - len(text))
            n_spans.append(spans)
        rest = [n for n in names if n not in ("text", "first", "last")]
        yield pa.RecordBatch.from_arrays([*(b.column(names.index(n)) for n in rest), pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans))], names=[*rest, "kept", "n_bytes", "n_removed", "n_spans"])


def _sampled(batches):
    """Leading bytes of one in THIN suffixes of each text."""
    for b in batches:
        lead = [np.zeros(0, f"S{LEADING}")]
        for text in b.column(0).cast(pa.binary()).to_pylist():
            h = SCHEME.hashes(_symbols(text or b""))
            a = np.unique(sliding_argmin(h, WINDOW - ANCHOR + 1)[: max(0, len(text or b"") - WINDOW + 1)]).astype(np.int64)
            a = a[mix(h[a] + U(1)) % U(THIN) == 0]
            if len(a):
                lead.append(_leading(_contexts(np.frombuffer(text, np.uint8), a, a - BEFORE, a)))
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(lead).astype(f"S{LEADING}").tobytes()], pa.binary())], names=["lead"])


def _splitters(base: DataFrame, n: int, n_bytes: int) -> np.ndarray:
    """Leading bytes that cut the suffixes of sampled documents into n equal parts."""
    want = min(PER_SPLITTER * n, MOST_SAMPLED)
    share = min(1.0, want * THIN * (BEFORE + 2) / 2 / max(1, n_bytes))
    few = base.where(hash_under(share, F.col("id"), F.lit("sample"))).select("text")
    rows = few.mapInArrow(_sampled, "lead binary").collect()  # about MOST_SAMPLED x LEADING bytes at most
    lead = np.sort(np.frombuffer(b"".join(bytes(r["lead"]) for r in rows), f"S{LEADING}"))
    return np.unique(lead[[len(lead) * i // n for i in range(1, n)]]) if len(lead) else lead


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """drop_id and drop_copy (which of the id's texts) with the repeated byte spans, packed: first, last (exclusive)."""
    base = docs.select(F.col(doc_id).cast("long").alias("id"), short_hash(F.col(text)).alias("copy"), F.col(text).alias("text")).where(F.col("id").isNotNull())
    n = shards_for(base, "text", BYTES_PER_SHARD)
    splitters = _splitters(base, n, n * BYTES_PER_SHARD)
    anchors = shared_anchors(base.select("id", "text"), SCHEME, BYTES_PER_SHARD)
    candidates = base.join(anchors, base.id == anchors.doc_id).select("id", "copy", "text", "keys")
    found = candidates.mapInArrow(_entries(splitters), ENTRY).groupBy("bucket").applyInArrow(_bucket(len(splitters) + 1), SPAN)
    spans = materialize(found.groupBy("block").applyInArrow(_merged, "drop_id long, drop_copy long, first binary, last binary"), "spans")
    release(anchors)
    return spans


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc`` (the other columns as a struct), ``kept`` (the bytes left), n_bytes, n_removed, n_spans."""
    spans = repeated_spans(docs, doc_id, text)
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    whole = docs.select(F.struct(*others).alias("doc"), F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    joined = whole.join(spans, (F.col("id") == F.col("drop_id")) & (short_hash(F.col("text")) == F.col("drop_copy")), "left").select("doc", "text", "first", "last")
    return joined.mapInArrow(_remove, f"doc {joined.schema['doc'].dataType.simpleString()}, kept binary, n_bytes long, n_removed long, n_spans long")


def kept_digest(out: DataFrame) -> DataFrame:
    return out.select(F.col("doc.doc_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]]) -> list[tuple]:
    """The contract, literally; for tests."""
    first: dict[bytes, int] = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, t in texts:
        for i in range(len(t) - WINDOW + 1) if d is not None else ():
            k = t[i : i + WINDOW]
            first[k] = min(first.get(k, d), d)
    out = []
    for d, t in texts:
        gone = np.zeros(len(t) + 1, np.int32)
        for i in range(len(t) - WINDOW + 1) if d is not None else ():
            if first[t[i : i + WINDOW]] < d:
                gone[i] += 1
                gone[i + WINDOW] -= 1
        hit = np.cumsum(gone[:-1]) > 0
        kept = np.frombuffer(t, np.uint8)[~hit].tobytes()
        out.append((d, len(t), int(hit.sum()), int((np.diff(np.append(0, hit.astype(np.int8))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out
