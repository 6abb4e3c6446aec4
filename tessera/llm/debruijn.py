"""Substring dedup (operator 8): a de Bruijn graph of repeated word windows, compacted to paths.

Graph: an edge is a window of 13 words that two documents hold, and leads from the node of its
first 12 words to that of its last 12. Windows that two documents may share are found by sampled
anchors; those are dealt to shards by their first node's hash, with the smallest document of each batch that
holds them. A shard tells an edge's source, its smallest holder and the place there, so
every edge has one coordinate. Nodes learn their in- and out-degree from the edges' ends.

Compaction: edges that follow each other in their source through a node of one edge in and one
out are a segment; Spark joins link a segment's end to the one that goes on from it in another
source, and pointer doubling gives each segment its path and its place there. Cycles are cut at their smallest segment.

Spans: what a document repeats are runs of edges that follow each other in it and in their
source. They are cut at every ``GRID`` words of the source, so that a source has no more
different pieces than its length allows, however many documents repeat it. Every piece must lie on paths.

Verification: nothing rests on hashes. All documents spell their pieces, and the sources spell
them at the coordinates; SHA-256 digests of the words must agree, piece by piece, by a partial
aggregate. Where any doesn't, two windows shared a hash, and all is found anew under other hashes
until every piece is verified.

A document that isn't the smallest holder within its batch needs no shard's answer: its
edge is repeated for certain, and takes its coordinate from the document that the batch sent. So an
edge held by a third of all documents is sent once a batch.

Defined results: a null or empty text has no words; a row with a null id keeps all its words and
is no source; rows that share an id are one document, whose texts lose each what a smaller document
holds; a window repeated within one document alone stays; texts under 13 words stay; an empty
table gives an empty result; other columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._anchors import KEY_MASK, Scheme, U, block_of, by_text, keys_of, mix, rolling, shared_anchors, short, short_hash, sliding_min, whole
from tessera.llm._common import materialize, release, shards_for

WINDOW, ANCHOR = 13, 7
GRID = 64
BYTES_PER_SHARD = 12 << 20
#: Texts that are spelled or rebuilt at a time, which bounds a worker's memory.
ROWS = 500
#: Bytes of a batch that a worker gets.
BATCH = "8m"
#: Sets of hashes that are tried before the operator gives up.
TRIES = 4


def _words(text: bytes, seed: int) -> np.ndarray:
    words = text.split()
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words) if seed else map(xxhash.xxh3_64_intdigest, words), U, len(words))


def _symbols(text: bytes) -> np.ndarray:
    return _words(text, 0)


SCHEME = Scheme(WINDOW, ANCHOR, _symbols, 400_000)

#: Kinds of packed rows: an edge of a batch for its shard; of a document's edge the coordinate in the batch's sender; the coordinate in its source; an edge's end at a node.
SENT, LATE, HELD, ARC = range(4)
_PACKED = pa.schema([("part", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("tail", "head", "flag", "doc", "copy", "pos", "source", "source_copy", "source_pos"))])
PACKED = "part int, kind int, tail binary, head binary, flag binary, doc binary, copy binary, pos binary, source binary, source_copy binary, source_pos binary"
_KINDS = {"flag": np.uint8, "doc": "<i8", "copy": "<u4", "pos": "<u4", "source": "<i8", "source_copy": "<u4", "source_pos": "<u4"}


def _encoded(name: str, a: np.ndarray) -> bytes:
    """Differences, byte plane by byte plane: what shuffles and files compress best where places follow each other."""
    if name in ("tail", "head"):
        return short(a).tobytes()
    a = a.astype(_KINDS[name])
    if name != "flag":
        a = np.diff(a, prepend=a.dtype.type(0))
    return a.view(np.uint8).reshape(len(a), -1).T.tobytes()


def _decoded(name: str, raw: bytes) -> np.ndarray:
    if name in ("tail", "head"):
        return whole(raw)
    kind = np.dtype(_KINDS[name])
    a = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()
    return a if name == "flag" else np.cumsum(a, dtype=kind)


class _Out:
    """Packed rows to be, each part by document and place."""

    def __init__(self):
        self.rows: list[dict] = []

    def put(self, kind: int, part: np.ndarray, **arrays: np.ndarray) -> None:
        order = np.lexsort((arrays["pos"], arrays["copy"], arrays["doc"], part))
        part = part[order]
        arrays = {n: a[order] for n, a in arrays.items()}
        cuts = np.append(np.flatnonzero(_new(part)), len(part)) if len(part) else []
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            self.rows.append({"part": int(part[a]), "kind": kind} | {n: _encoded(n, x[a:z]) for n, x in arrays.items()})

    def table(self) -> pa.Table:
        return pa.Table.from_pylist(self.rows, schema=_PACKED)


def _opened(t: pa.Table, kind: int, *names: str) -> list[np.ndarray]:
    t = t.filter(pc.equal(t.column("kind"), kind))
    return [np.concatenate([_decoded(n, b""), *(_decoded(n, x) for x in t.column(n).to_pylist())]) for n in names]


def _new(*keys: np.ndarray) -> np.ndarray:
    """Where a sorted list's entry differs from the one before."""
    out = np.ones(len(keys[0]), bool)
    out[1:] = False
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def _edges(n_shards: int, seed: int, bits: int):
    """Candidate edges: those of a batch's smallest holders go to shards, others are known to repeat."""
    mask = U((1 << bits) - 1) if bits < 64 else U(0xFFFFFFFFFFFFFFFF)

    def run(batches):
        for b in batches:
            docs, copies = b.column("id").to_pylist(), b.column("copy").to_pylist()
            texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
            known = [keys_of(k) for k in b.column("keys").to_pylist()]
            for own, symbols, starts, ends, offset in SCHEME.chunks(list(range(len(docs))), texts):
                least = sliding_min(SCHEME.hashes(symbols), WINDOW - ANCHOR + 1)
                at, piece = SCHEME.windows(starts, ends)
                pick = np.concatenate([np.isin(least[s : e - WINDOW + 1], known[d]) for d, s, e in zip(own, starts, ends, strict=True)])
                at, piece = at[pick], piece[pick]
                if not len(at):
                    continue
                if seed:
                    symbols = np.concatenate([_words(texts[d], seed)[o : o + e - s] for d, s, e, o in zip(own, starts, ends, offset, strict=True)])
                node = mix(rolling(symbols, WINDOW - 1)) & mask & KEY_MASK
                tail, head = node[at], node[at + 1]
                doc, copy = np.array(docs, np.int64)[np.array(own)[piece]], np.array(copies, np.int64)[np.array(own)[piece]].astype(np.uint32)
                pos = (at - starts[piece] + offset[piece]).astype(np.uint32)
                order = np.lexsort((pos, copy, doc, head, tail))
                tail, head, doc, copy, pos = tail[order], head[order], doc[order], copy[order], pos[order]
                new = _new(tail, head)
                group = np.cumsum(new) - 1
                first = np.flatnonzero(new)[group]
                sent = doc == doc[first]
                many = np.bincount(group, weights=~sent) > 0
                out = _Out()
                out.put(SENT, (tail[sent] % U(n_shards)).astype(np.int32), tail=tail[sent], head=head[sent], flag=many[group][sent], doc=doc[sent], copy=copy[sent], pos=pos[sent])
                late, of = ~sent, first[~sent]
                out.put(LATE, block_of(doc[of], n_shards), doc=doc[late], copy=copy[late], pos=pos[late], source=doc[of], source_copy=copy[of], source_pos=pos[of])
                yield from out.table().to_batches()

    return run


def _sources(n_shards: int):
    def run(t: pa.Table) -> pa.Table:
        """One shard: the coordinate of each repeated edge, for its holders and for the nodes at its ends; late ones pass through."""
        tail, head, flag, doc, copy, pos = _opened(t, SENT, "tail", "head", "flag", "doc", "copy", "pos")
        out = _Out()
        if len(doc):
            order = np.lexsort((pos, copy, doc, head, tail))
            tail, head, flag, doc, copy, pos = (x[order] for x in (tail, head, flag, doc, copy, pos))
            new = _new(tail, head)
            group, at = np.cumsum(new) - 1, np.flatnonzero(new)
            first = at[group]
            other = doc != doc[first]
            repeated = (np.maximum.reduceat(flag, at) > 0) | (np.bincount(group, weights=other) > 0)
            # all places of an edge but its coordinate are held, those in the source's own document too, which stay
            held = repeated[group] & (np.arange(len(doc)) != first)
            of = first[held]
            out.put(HELD, block_of(doc[held], n_shards), doc=doc[held], copy=copy[held], pos=pos[held], source=doc[of], source_copy=copy[of], source_pos=pos[of])
            e = at[repeated]
            for node, leaves in ((tail[e], 1), (head[e], 0)):
                out.put(ARC, (node % U(n_shards)).astype(np.int32), tail=node, flag=np.full(len(e), leaves), doc=doc[e], copy=copy[e], pos=pos[e])
        return pa.concat_tables([t.filter(pc.equal(t.column("kind"), LATE)).cast(_PACKED), out.table()])

    return run


BORDER = "source long, copy long, pos long, starts boolean, ends boolean, from_source long, from_copy long, from_pos long"
_BORDER = pa.schema([(c, pa.bool_() if c in ("starts", "ends") else pa.int64()) for c in ("source", "copy", "pos", "starts", "ends", "from_source", "from_copy", "from_pos")])


def _borders(t: pa.Table) -> pa.Table:
    """One shard of nodes: where segments start and end. A node of one edge in and one out joins them, and starts a segment only where the coordinate jumps."""
    node, leaves, source, copy, pos = _opened(t, ARC, "tail", "flag", "doc", "copy", "pos")
    order = np.lexsort((leaves, node))
    node, leaves, source, copy, pos = node[order], leaves[order].astype(bool), source[order], copy[order].astype(np.int64), pos[order].astype(np.int64)
    new = _new(node)
    group, at = np.cumsum(new) - 1, np.flatnonzero(new)
    n_out = np.bincount(group, weights=leaves) if len(node) else np.zeros(0)
    n_in = np.bincount(group, weights=~leaves) if len(node) else np.zeros(0)
    single = (n_out == 1) & (n_in == 1)  # the edge in comes first, then the edge out
    i, o = at[single], at[single] + 1
    same = (source[i] == source[o]) & (copy[i] == copy[o])
    loop = same & (pos[i] == pos[o])
    jumps = ~(same & (pos[i] + 1 == pos[o])) & ~loop
    branching = ~single[group] if len(node) else np.zeros(0, bool)
    branching[i[loop]] = branching[o[loop]] = True
    a, z = np.append(np.flatnonzero(branching & leaves), o[jumps]), np.append(np.flatnonzero(branching & ~leaves), i[jumps])
    rows = np.append(a, z)
    came = np.append(np.full(int((branching & leaves).sum()), -1), i[jumps])
    came = np.append(came, np.full(len(z), -1))
    of = lambda x: pa.array(x[came], pa.int64(), mask=came < 0)
    starts = np.arange(len(rows)) < len(a)
    return pa.table([pa.array(source[rows]), pa.array(copy[rows]), pa.array(pos[rows]), pa.array(starts), pa.array(~starts), of(source), of(copy), of(pos)], schema=_BORDER)


def _segments(edges: DataFrame) -> DataFrame:
    """source, copy, start, last (the coordinate of the last edge), and from_*: the edge of another segment that leads on to it."""
    borders = edges.where(F.col("kind") == ARC).groupBy("part").applyInArrow(_borders, BORDER)
    here = ["source", "copy", "pos"]
    borders = borders.groupBy(*here).agg(F.max("starts").alias("starts"), F.max("ends").alias("ends"), *[F.max(f"from_{c}").alias(f"from_{c}") for c in here])
    along = Window.partitionBy("source", "copy").orderBy("pos")
    last = F.when(F.col("ends"), F.col("pos")).otherwise(F.lead("pos").over(along))
    return borders.withColumn("last", last).where("starts").select("source", "copy", F.col("pos").alias("start"), "last", *[f"from_{c}" for c in here])


def compact_paths(segments: DataFrame) -> DataFrame:
    """Segments with ``path`` (its first segment as a struct) and ``offset`` (edges of the path before it).

    A segment points to the one it goes on from; each round joins pointers with pointers, so that they
    reach twice as far. What still points on when a round leaves as many as the one before are cycles.
    """
    name = F.struct("source", "copy", "start").alias("segment")
    own = segments.select(name, (F.col("last") - F.col("start") + 1).alias("edges"), *[c for c in segments.columns])
    ends = own.select(F.col("source").alias("from_source"), F.col("copy").alias("from_copy"), F.col("last").alias("from_pos"), F.col("segment").alias("to"), F.col("edges").alias("before"))
    linked = own.join(ends, ["from_source", "from_copy", "from_pos"], "left")
    now = materialize(linked.select("segment", "to", F.coalesce("before", F.lit(0)).cast("long").alias("offset"), F.least("segment", "to").alias("low")), "pointers")
    links = now
    reach, before = 1, None
    while (n := now.where("to IS NOT NULL").count()) > 0:
        if n == before and reach >= n:  # a path has fewer each round, so these are cycles: cut each at its smallest segment
            cut = now.where("to IS NOT NULL").select("segment", "low")
            again = links.select("segment", F.col("to").alias("was"), F.col("offset").alias("before")).join(cut, "segment", "left")
            open_ = F.col("low").isNull() | (F.col("low") != F.col("segment"))
            mended = again.select("segment", F.when(open_, F.col("was")).alias("to"), F.when(open_, F.col("before")).otherwise(F.lit(0)).alias("offset"), F.least("segment", "was").alias("low"))
            old, now, reach, before = now, materialize(mended, "pointers"), 1, None
            if old is not links:
                release(old)
            continue
        beyond = now.select(F.col("segment").alias("at"), F.col("to").alias("next"), F.col("offset").alias("more"), F.col("low").alias("lower"))
        jump = now.join(beyond, F.col("to") == F.col("at"), "left")
        # a pointer to a path's first segment rests there; ``first`` remembers it
        new = jump.select("segment", F.col("next").alias("to"), (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset"), F.least("low", "lower").alias("low"), F.coalesce("next", "to", *(["first"] if "first" in now.columns else [])).alias("first"))
        old, now = now, materialize(new, "pointers")
        if old is not links:
            release(old)
        reach, before = 2 * reach, n
    first = F.coalesce("first", "segment") if "first" in now.columns else F.col("segment")
    out = materialize(own.join(now.select("segment", first.alias("path"), "offset"), "segment").select("path", "offset", "source", "copy", "start", "edges"), "paths")
    release(now, *([links] if now is not links else []))
    return out


def _translated(n_shards: int):
    def run(t: pa.Table) -> pa.Table:
        """One block of senders: late places get the coordinate that the sender's edge has itself."""
        doc, copy, pos, source, source_copy, source_pos = _opened(t, HELD, "doc", "copy", "pos", "source", "source_copy", "source_pos")
        late = _opened(t, LATE, "doc", "copy", "pos", "source", "source_copy", "source_pos")
        out = _Out()
        if len(late[0]):
            n = len(doc)
            keys = [np.append(a, b) for a, b in ((doc, late[3]), (copy, late[4]), (pos, late[5]))]
            order = np.lexsort((np.arange(n + len(late[0])) >= n, *keys[::-1]))  # a sender's own entry stands before those that look for it
            new = _new(*(k[order] for k in keys))
            top = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
            found = np.empty(len(order), np.int64)
            found[order] = np.where(top < n, top, -1)
            found = found[n:]
            known = found >= 0
            at = np.where(known, found, 0)
            to = [np.where(known, a[at], b) if n else b for a, b in ((source, late[3]), (source_copy, late[4]), (source_pos, late[5]))]
            out.put(HELD, block_of(late[0], n_shards), doc=late[0], copy=late[1], pos=late[2], source=to[0], source_copy=to[1], source_pos=to[2])
        return pa.concat_tables([t.filter(pc.equal(t.column("kind"), HELD)).cast(_PACKED), out.table()])

    return run


def compact(pos: np.ndarray, source: np.ndarray, source_copy: np.ndarray, source_pos: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Edges of one document to pieces: (start, edges, source, its text, start there), cut at every GRID words of the source."""
    _, order = np.unique(pos, return_index=True)  # repeated rows hold an edge once
    pos, source, source_copy, source_pos = pos[order].astype(np.int64), source[order], source_copy[order].astype(np.int64), source_pos[order].astype(np.int64)
    new = _new(source, source_copy)
    new[1:] |= (np.diff(pos) != 1) | (np.diff(source_pos) != 1)
    new |= source_pos % GRID == 0
    at = np.flatnonzero(new)
    return list(zip(pos[at].tolist(), np.diff(np.append(at, len(pos))).tolist(), source[at].tolist(), source_copy[at].tolist(), source_pos[at].tolist(), strict=True))


_SPAN = ("start", "edges", "source", "source_copy", "source_start")
_SPANS = pa.schema([("drop_id", pa.int64()), ("drop_copy", pa.int64()), *((n, pa.list_(pa.int64())) for n in _SPAN)])
SPANS = "drop_id long, drop_copy long, " + ", ".join(f"{n} array<long>" for n in _SPAN)


def _compact(t: pa.Table) -> pa.Table:
    """One block: the pieces of each document's text that a smaller document holds."""
    doc, copy, pos, source, source_copy, source_pos = _opened(t, HELD, "doc", "copy", "pos", "source", "source_copy", "source_pos")
    lost = doc != source
    doc, copy, pos, source, source_copy, source_pos = (x[lost] for x in (doc, copy, pos, source, source_copy, source_pos))
    out: list[list] = [[] for _ in _SPANS]
    for d, c, at in by_text(doc, copy):
        for col, v in zip(out, (d, c, *map(list, zip(*compact(pos[at], source[at], source_copy[at], source_pos[at]), strict=True))), strict=True):
            col.append(v)
    return pa.table([pa.array(c, f.type) for c, f in zip(out, _SPANS, strict=True)], schema=_SPANS)


_SPELLED = pa.schema([("source", pa.int64()), ("source_copy", pa.int64()), ("source_start", pa.int64()), ("edges", pa.int64()), ("digest", pa.binary())])


def _slices(batches):
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def _spell(batches):
    """Digests of the words of each text's pieces, its own and those that others took from it."""
    for b in _slices(batches):
        cols = {n: b.column(n).to_pylist() for n in ("id", "copy", *_SPAN, "asked")}
        out: list[tuple] = []
        for i, text in enumerate(b.column("text").cast(pa.binary()).to_pylist()):
            words = (text or b"").split()
            spell = lambda a, n, words=words: hashlib.sha256(b" ".join(words[a : a + n + WINDOW - 1])).digest()
            for a, n, s, c, q in zip(*(cols[x][i] or [] for x in _SPAN), strict=True):
                out.append((s, c, q, n, spell(a, n)))
            for p in cols["asked"][i] or []:
                out.append((cols["id"][i], cols["copy"][i], p["source_start"], p["edges"], spell(p["source_start"], p["edges"])))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True)) or [()] * 5, _SPELLED, strict=True)], schema=_SPELLED)


def _verified(base: DataFrame, spans: DataFrame, paths: DataFrame) -> bool:
    """Whether all pieces lie on paths, and are spelled alike by their holders and at their coordinates."""
    piece = ["source", "source_copy", "source_start", "edges"]
    pieces = spans.select(F.explode(F.arrays_zip(*piece)).alias("p")).select("p.*").distinct()
    pieces = materialize(pieces, "pieces")
    cell = lambda c: F.floor(F.col(c) / GRID)
    parts = paths.select(F.col("source").alias("of"), F.col("copy").alias("of_copy"), "start", (F.col("start") + F.col("edges")).alias("end"))
    parts = parts.withColumn("cell", F.explode(F.sequence(cell("start"), F.floor((F.col("end") - 1) / GRID))))
    meet = (F.col("source") == F.col("of")) & (F.col("source_copy") == F.col("of_copy")) & (cell("source_start") == F.col("cell"))
    upto = F.col("source_start") + F.col("edges")
    covered = F.sum(F.greatest(F.least(upto, F.col("end")) - F.greatest("source_start", "start"), F.lit(0)))
    off = pieces.join(parts, meet, "left").groupBy(*piece).agg(F.coalesce(covered, F.lit(0)).alias("covered")).where("covered <> edges")
    good = off.isEmpty()
    if good:
        asked = pieces.groupBy(F.col("source").alias("of_id"), F.col("source_copy").alias("of_copy")).agg(F.collect_list(F.struct("source_start", "edges")).alias("asked"))
        own = spans.withColumnRenamed("drop_id", "of_id").withColumnRenamed("drop_copy", "of_copy")
        tasks = own.join(asked, ["of_id", "of_copy"], "full")
        texts = base.join(tasks, (F.col("id") == F.col("of_id")) & (F.col("copy") == F.col("of_copy"))).select("id", "copy", "text", *_SPAN, "asked")
        spelled = texts.mapInArrow(_spell, "source long, source_copy long, source_start long, edges long, digest binary")
        bad = materialize(spelled.groupBy(*piece).agg(F.min("digest").alias("a"), F.max("digest").alias("z")).where("a <> z"), "misspelled", BATCH)
        good = bad.isEmpty()
        release(bad)
    release(pieces)
    return good


def _remove(batches):
    for b in _slices(batches):
        names = b.schema.names
        texts = b.column(names.index("text")).cast(pa.binary()).to_pylist()
        out, n_words, n_removed = [], [], []
        for text, starts, edges in zip(texts, b.column(names.index("start")).to_pylist(), b.column(names.index("edges")).to_pylist(), strict=True):
            words = (text or b"").split()
            n_words.append(len(words))
            if starts:
                cover = np.zeros(len(words) + 1, np.int32)
                np.add.at(cover, np.array(starts), 1)
                np.add.at(cover, np.array(starts) + np.array(edges) + WINDOW - 1, -1)
                keep = np.cumsum(cover[:-1]) == 0
                words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
            n_removed.append(n_words[-1] - len(words))
            out.append(b" ".join(words))
        rest = [n for n in names if n not in ("text", "start", "edges")]
        yield pa.RecordBatch.from_arrays([*(b.column(names.index(n)) for n in rest), pa.array(out, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=[*rest, "text", "n_words", "n_removed"])


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", first_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(spans, paths): verified pieces by drop_id and drop_copy (which of the id's texts), and the compacted graph.

    ``first_bits``: bits of a node's hash in the first try; few of them make hashes clash, for tests.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("id"), short_hash(F.col(text)).alias("copy"), F.col(text).alias("text")).where(F.col("id").isNotNull())
    n = shards_for(base, "text", BYTES_PER_SHARD)
    anchors = shared_anchors(base.select("id", "text"), SCHEME, BYTES_PER_SHARD)
    candidates = base.join(anchors, base.id == anchors.doc_id).select("id", "copy", "text", "keys")
    for seed in range(TRIES):
        found = candidates.mapInArrow(_edges(n, seed, 64 if seed else first_bits), PACKED)
        edges = materialize(found.groupBy("part").applyInArrow(_sources(n), PACKED), "edges", BATCH)
        segments = materialize(_segments(edges), "segments")
        paths = compact_paths(segments)
        held = edges.where(F.col("kind") != ARC).groupBy("part").applyInArrow(_translated(n), PACKED)
        spans = materialize(held.groupBy("part").applyInArrow(_compact, SPANS), "spans", BATCH)
        release(edges, segments)
        if _verified(base, spans, paths):
            release(anchors)
            return spans, paths
        release(spans, paths)
    raise RuntimeError(f"windows of different words shared a hash {TRIES} times")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", first_bits: int = 64) -> DataFrame:
    """``doc`` (the other columns as a struct), ``text`` (kept words joined by a space), n_words, n_removed."""
    spans, paths = repeated_spans(docs, doc_id, text, first_bits)
    release(paths)
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    whole_ = docs.select(F.struct(*others).alias("doc"), F.col(doc_id).cast("long").alias("id"), short_hash(F.col(text)).alias("copy"), F.col(text).alias("text"))
    joined = whole_.join(spans.select("drop_id", "drop_copy", "start", "edges"), (F.col("id") == F.col("drop_id")) & (F.col("copy") == F.col("drop_copy")), "left").select("doc", "text", "start", "edges")
    return joined.mapInArrow(_remove, f"doc {joined.schema['doc'].dataType.simpleString()}, text string, n_words long, n_removed long")


def kept_digest(out: DataFrame) -> DataFrame:
    return out.select(F.col("doc.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]]) -> list[tuple]:
    """The contract, literally; for tests."""
    first: dict[tuple, int] = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        for i in range(len(w) - WINDOW + 1):
            k = tuple(w[i : i + WINDOW])
            if d is not None:
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in split:
        gone = {i + j for i in range(len(w) - WINDOW + 1) if d is not None and first[tuple(w[i : i + WINDOW])] < d for j in range(WINDOW)}
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out
