"""Windows that two documents may share, found through sampled anchors.

A window of L symbols has L - k + 1 runs of k symbols; its anchor is the one of least hash. Equal
windows have equal anchors, and neighbouring windows mostly the same one, so there are about
2 / (L - k + 2) anchors a symbol. Only anchors that two documents hold are worth a closer look:
their hashes are dealt to shards as packed arrays, once for each batch of documents, and the
shared ones come back to the documents that hold them. A wrong match of hashes costs work, never
a wrong result, as later steps compare the windows themselves.

Within a batch a hash that several documents hold is known to be shared, and is sent once
without them; so hot passages cross the network once a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import materialize, shards_for

U = np.uint64
MANY = np.iinfo(np.int64).min
#: Bits of an anchor's hash that are kept, in whole bytes.
KEY_BYTES = 6
KEY_MASK = U((1 << 8 * KEY_BYTES) - 1)


def short(keys: np.ndarray) -> np.ndarray:
    """Rows of KEY_BYTES bytes."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES])


def whole(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(packed, np.uint8).reshape(-1, KEY_BYTES)
    return out.view("<u8").ravel()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def rolling(x: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A polynomial hash of the k symbols from each place on, by doubling."""
    power, have, out, done, b = x, 1, None, 0, base
    while True:
        if k & have:
            if out is None:
                out, done = power, have
            else:  # the symbols so far, then those of this power
                n = len(power) - done
                out = out[:n] * U(pow(base, have, 1 << 64)) + power[done : done + n] if n > 0 else out[:0]
                done += have
        if 2 * have > k:
            return out[: max(0, len(x) - k + 1)]
        n = len(power) - have
        power = power[:n] * U(pow(base, have, 1 << 64)) + power[have:] if n > 0 else power[:0]
        have *= 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of w neighbours from each place on."""
    have, out = 1, x
    while 2 * have <= w:
        out = np.minimum(out[: len(out) - have], out[have:]) if len(out) > have else out[:0]
        have *= 2
    return np.minimum(out[: len(out) - (w - have)], out[w - have :]) if w > have and len(out) > w - have else out if w == have else out[:0]


def sliding_argmin(x: np.ndarray, w: int) -> np.ndarray:
    """Where the least of w neighbours from each place on stands; the leftmost of equals."""
    at, have = np.arange(len(x), dtype=np.int32), 1

    def join(a, b):
        return np.where(x[a] <= x[b], a, b)

    while 2 * have <= w:
        at = join(at[: len(at) - have], at[have:]) if len(at) > have else at[:0]
        have *= 2
    return join(at[: len(at) - (w - have)], at[w - have :]) if w > have and len(at) > w - have else at if w == have else at[:0]


@dataclass(frozen=True)
class Scheme:
    """Windows of ``length`` symbols with anchors of ``k``; ``symbols`` turns a text into numbers."""

    length: int
    k: int
    symbols: Callable[[bytes], np.ndarray]
    #: Symbols that are handled at a time, which bounds a worker's memory.
    chunk: int

    def hashes(self, symbols: np.ndarray) -> np.ndarray:
        return mix(rolling(symbols, self.k)) & KEY_MASK

    def chunks(self, docs: list, texts: list[bytes]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(documents, symbols, place of each piece, its end, its offset in the document).

        Pieces of long texts overlap by a window less a symbol, so each window lies in one piece.
        """
        held, size = [], 0
        for doc, text in zip(docs, texts, strict=True):
            s = self.symbols(text)
            for at in range(0, max(1, len(s) - self.length + 1), self.chunk):
                piece = s[at : at + self.chunk + self.length - 1]
                if len(piece) < self.length:
                    continue
                if size and size + len(piece) > self.chunk:
                    yield self._chunk(held)
                    held, size = [], 0
                held.append((doc, piece, at))
                size += len(piece)
        if held:
            yield self._chunk(held)

    @staticmethod
    def _chunk(held):
        ends = np.cumsum([len(p) for _, p, _ in held])
        return [d for d, _, _ in held], np.concatenate([p for _, p, _ in held]), np.append(0, ends[:-1]), ends, np.array([a for _, _, a in held], np.int64)

    def windows(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places where windows start, and the piece of each."""
        n = ends - starts - self.length + 1
        piece = np.repeat(np.arange(len(n)), n)
        return np.arange(len(piece)) + np.repeat(starts - np.append(0, np.cumsum(n)[:-1]), n), piece


def pack(by: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """(value, bytes of each array's part) for each value of ``by``."""
    order = np.argsort(by, kind="stable")
    by = by[order]
    for part in np.split(order, np.flatnonzero(np.diff(by)) + 1) if len(by) else []:
        yield (*(a[part].tobytes() for a in arrays), part[0])


def block_of(doc: np.ndarray, n: int) -> np.ndarray:
    """Documents come back in blocks, a row for a shard and a block, however many they are."""
    return (mix(doc.astype(U)) % U(n)).astype(np.int32)


def by_document(doc: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each document and the places of its entries."""
    order = np.argsort(doc, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(doc[order])) + 1) if len(doc) else []:
        yield int(doc[part[0]]), part


def short_hash(text: F.Column) -> F.Column:
    """32 bits that tell the texts of one id apart."""
    return F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF))


def by_text(doc: np.ndarray, copy: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Each document's text and the places of its entries."""
    order = np.lexsort((copy, doc))
    new = np.flatnonzero((np.diff(doc[order]) != 0) | (np.diff(copy[order]) != 0)) + 1
    for part in np.split(order, new) if len(doc) else []:
        yield int(doc[part[0]]), int(copy[part[0]]), part


_FOUND = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("key", pa.binary()), ("doc", pa.binary())])


def _collect(scheme: Scheme, n_shards: int):
    def run(batches):
        for b in batches:
            rows = [(d, t) for d, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True) if d is not None and t]
            for docs, symbols, starts, ends, _ in scheme.chunks([d for d, _ in rows], [t for _, t in rows]):
                least = sliding_min(scheme.hashes(symbols), scheme.length - scheme.k + 1)
                at, piece = scheme.windows(starts, ends)
                key = least[at]
                new = np.append(True, (key[1:] != key[:-1]) | (piece[1:] != piece[:-1]))
                key, doc = key[new], np.array(docs, np.int64)[piece[new]]
                order = np.lexsort((doc, key))
                key, doc = key[order], doc[order]
                other = np.append(True, key[1:] != key[:-1])
                once = other | np.append(True, doc[1:] != doc[:-1])
                key, doc, other = key[once], doc[once], other[once]
                first = np.flatnonzero(other)
                many = np.repeat(np.diff(np.append(first, len(key))) > 1, np.diff(np.append(first, len(key))))
                out: dict[str, list] = {n: [] for n in _FOUND.names}

                def put(*values, out=out):
                    for n, v in zip(out, values, strict=True):
                        out[n].append(v)

                sent = first
                doc_or_many = np.where(many, MANY, doc)[sent]
                shard = (key[sent] % U(n_shards)).astype(np.int32)
                packed = short(key)
                for k, d, i in pack(shard, packed[sent], doc_or_many):
                    put(int(shard[i]), None, k, d)
                owner = block_of(doc[many], n_shards)
                for k, d, i in pack(owner, packed[many], doc[many]):
                    put(int(owner[i]), int(owner[i]), k, d)
                yield pa.RecordBatch.from_pydict(out, schema=_FOUND)

    return run


_ANSWER = pa.schema([("block", pa.int32()), ("key", pa.binary()), ("doc", pa.binary())])


def _shared(n_shards: int):
    def run(t: pa.Table) -> pa.Table:
        """One shard: the anchors that two documents hold, for their blocks; those known before pass through."""
        known = t.filter(pc.is_valid(t.column("block"))).select(_ANSWER.names).cast(_ANSWER)
        t = t.filter(pc.is_null(t.column("block")))
        key, doc = whole(b"".join(t.column("key").to_pylist())), np.frombuffer(b"".join(t.column("doc").to_pylist()), "<i8")
        order = np.argsort(key)
        key, doc = key[order], doc[order]
        same = key[1:] == key[:-1]
        hit = (np.append(False, same) | np.append(same, False))[: len(key)] & (doc != MANY)
        key, doc = key[hit], doc[hit]
        block = block_of(doc, n_shards)
        rows = [(int(block[i]), k, d) for k, d, i in pack(block, short(key), doc)]
        cols = list(zip(*rows, strict=True)) or [()] * 3
        return pa.concat_tables([known, pa.table([pa.array(c, f.type) for c, f in zip(cols, _ANSWER, strict=True)], schema=_ANSWER)])

    return run


def _handed_back(t: pa.Table) -> pa.Table:
    """One block: a row for each document with its anchors."""
    key, doc = np.frombuffer(b"".join(t.column("key").to_pylist()), np.uint8).reshape(-1, KEY_BYTES), np.frombuffer(b"".join(t.column("doc").to_pylist()), "<i8")
    rows = [(d, key[at].tobytes()) for d, at in by_document(doc)]
    return pa.table([pa.array([d for d, _ in rows], pa.int64()), pa.array([k for _, k in rows], pa.binary())], names=["doc_id", "keys"])


def shared_anchors(docs: DataFrame, scheme: Scheme, bytes_per_shard: int) -> DataFrame:
    """(doc_id, keys): for each document with any, the anchor hashes that another document may hold. ``docs``: (id, text)."""
    n = shards_for(docs, "text", bytes_per_shard)
    found = docs.mapInArrow(_collect(scheme, n), "shard int, block int, key binary, doc binary")
    answers = found.groupBy("shard").applyInArrow(_shared(n), "block int, key binary, doc binary")
    out = materialize(answers.groupBy("block").applyInArrow(_handed_back, "doc_id long, keys binary"), "shared-anchors")
    return out


def keys_of(packed: bytes | None) -> np.ndarray:
    return np.unique(whole(packed or b""))
