"""MinHash near-dedup (operator 7): BagMinHash signatures of shingle multisets, bands, exact checks.

A text is the multiset of its shingles of five lower-cased words; w occurrences of a shingle
weigh w. Each shingle has Poisson processes over the weight octaves [0,1), [1,2), [2,4), ...; an
octave is split in halves, down to single levels of weight: the half that holds the first point
keeps its time, the other waits anew, and halves above w are left out. A level's points fall into
one of ``REGISTERS`` registers, and a register keeps its earliest point, so two texts agree in a
register with the probability of their weighted Jaccard similarity. A process whose next point is
later than all the text's registers ends with all its halves, so heavy shingles and long texts cost little.

Bands of ``ROWS`` registers make buckets; at a similarity of 0.8 a pair shares none of the 20 bands
with a probability of 3e-5. All pairs of different texts that share a bucket are settled, in two steps:

1. Every member of a bucket meets the bucket's representative, the member whose buckets are
   fullest, so that a family agrees on few of them. A pair that shares several buckets meets once.
2. Buckets whose other members still are of different classes go whole to a solver, a row for a
   member: large ones as tiles of at most ``TILE`` members a side, every two parts meeting in one.
   A solver drops texts that share too little of themselves with the tile, counts the overlaps
   of the others by matrix products, and returns as many links as it joins classes, so rows
   follow members and not pairs.

Both compare sets of (shingle, occurrence) by 64-bit hashes, whose Jaccard similarity is the
multisets'. Links join classes by label propagation with pointer jumping, each round written to
the shared folder.

Copies (equal words) are one text throughout: they are grouped by a hash of their words with
map-side aggregation, and expanded at the end by an equi-join of small rows.

Defined results: null and empty texts have no shingle and each is a class of its own; a text of
fewer than five words is one shingle of all its words; a row with a null id has a null class;
the class of a row is that of its text, so rows that share an id but not the text may be of
different classes, and ``keep_first`` drops a row by its own class alone; rows that share both
are kept together; an empty table gives an empty result; other columns pass through, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import anti_join, materialize, release

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 20, 4
REGISTERS = BANDS * ROWS
#: Members a side, and (shingle, occurrence) pairs a side, of what a solver holds at a time.
TILE, TILE_ELEMENTS = 1024, 2_000_000
#: Members that meet one copy of their representative.
SPAN = 256
#: Texts are signed in runs of about so many bytes, which bounds a worker's memory.
CHUNK_BYTES = 5_000_000

_U = np.uint64
_STEP = [_U((0x9E3779B97F4A7C15 * (2 * j + 3)) & 0xFFFFFFFFFFFFFFFF | 1) for j in range(SHINGLE)]


def _mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit hash of each number."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(text: bytes) -> np.ndarray:
    words = text.lower().split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))


def _shingles(words: np.ndarray) -> np.ndarray:
    """The hash of the shingle that starts at each word (of a concatenation of texts)."""
    n = max(0, len(words) - SHINGLE + 1)
    h = np.zeros(n, _U)
    for j, step in enumerate(_STEP):
        h += _mix(words[j : j + n] + step) * step
    return _mix(h)


def bags(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """text number, shingle, occurrences; for texts given as word hashes."""
    size = np.array([len(x) for x in texts], np.int64)
    ends = np.cumsum(size)
    text = np.repeat(np.arange(len(texts)), size)
    all_words = np.concatenate(texts) if texts else np.zeros(0, _U)
    s = _shingles(all_words)
    own = np.flatnonzero(np.arange(len(s)) + SHINGLE <= ends[text[: len(s)]])
    text, s = text[own], s[own]
    short = [i for i in np.flatnonzero((size > 0) & (size < SHINGLE))]
    if short:
        text = np.append(text, short)
        s = np.append(s, np.array([xxhash.xxh3_64_intdigest(texts[i].tobytes()) for i in short], _U))
    key = s ^ _mix(text.astype(_U) + _U(1))
    order = np.argsort(key)
    key, text, s = key[order], text[order], s[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return text[first], s[first], np.diff(np.append(first, len(key)))


def _wait(seed: np.ndarray) -> np.ndarray:
    """An exponential waiting time of rate 1 for each number."""
    return -np.log(((seed >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53)


def signatures(texts: list[np.ndarray], registers: int = REGISTERS) -> np.ndarray:
    """BagMinHash: a row of register values for each text; texts without shingles get zeros."""
    n = len(texts)
    text, s, w = bags(texts)
    # a process: its text, its random number, the levels of weight it spans, how many of them the text has, its first point
    more = [(text, _mix(s), np.ones(len(s), np.int64), np.ones(len(s), np.int64))]
    low = 1
    while len(sub := np.flatnonzero(w > low)):
        more.append((text[sub], _mix(s[sub] + _U(low * int(_STEP[1]) & 0xFFFFFFFFFFFFFFFF)), np.full(len(sub), low), np.minimum(low, w[sub] - low)))
        low *= 2
    text, seed, span, room = (np.concatenate(x) for x in zip(*more, strict=True))
    time = _wait(seed) / span
    best = np.full(n * registers, np.inf)
    ident = np.zeros(n * registers, _U)
    while len(text):
        level = span == 1
        t, point, x = text[level], seed[level], time[level]
        slot = t * registers + (_mix(point + _STEP[3]) % _U(registers)).astype(np.int64)
        np.minimum.at(best, slot, x)
        won = best[slot] == x
        ident[slot[won]] = point[won]
        then = _mix(point + _STEP[2])
        one = np.ones(len(t), np.int64)
        parts = [(t, then, one, one, x + _wait(then))]
        if len(up := np.flatnonzero(~level)):
            t, whole, half, has, x = text[up], seed[up], span[up] // 2, room[up], time[up]
            lower_first = _mix(whole + _STEP[4]) & _U(1) == 0
            lower, upper = _mix(whole + _STEP[0]), _mix(whole + _STEP[1])
            parts.append((t, lower, half, np.minimum(has, half), np.where(lower_first, x, x + _wait(lower) / half)))
            in_upper = has > half
            parts.append(tuple(v[in_upper] for v in (t, upper, half, has - half, np.where(lower_first, x + _wait(upper) / half, x))))
        text, seed, span, room, time = (np.concatenate(v) for v in zip(*parts, strict=True))
        on = time < best.reshape(n, registers).max(axis=1)[text]
        text, seed, span, room, time = text[on], seed[on], span[on], room[on], time[on]
    return ident.reshape(n, registers)


def _runs(texts: list[bytes]) -> list[np.ndarray]:
    """The numbers of the texts, in runs of about CHUNK_BYTES."""
    upto = np.cumsum([len(x) for x in texts]) // CHUNK_BYTES if texts else np.zeros(0, np.int64)
    return [p for p in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(upto)) + 1) if len(p)]


_SIGNED = pa.schema([("id", pa.int64()), ("copy", pa.int64()), ("node", pa.binary()), ("n", pa.int64()), ("bands", pa.list_(pa.int64()))])


def _sign(batches):
    for b in batches:
        texts = b.column(2).cast(pa.binary()).fill_null(b"").to_pylist()
        for part in _runs(texts):
            hashes = [word_hashes(texts[i]) for i in part]
            sig = signatures(hashes)
            bands = np.zeros((len(part), BANDS), _U)
            for r in range(ROWS):
                bands = _mix(bands + sig[:, r::ROWS] * _STEP[r])
            bands ^= _mix(np.arange(BANDS, dtype=_U))  # so that bands don't meet each other
            some = [len(h) > 0 for h in hashes]
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(part)), b.column(1).take(pa.array(part)),
                pa.array([xxhash.xxh3_128_digest(h.tobytes()) if ok else None for h, ok in zip(hashes, some, strict=True)], pa.binary()),
                pa.array([max(1, len(h) - SHINGLE + 1) if ok else 0 for h, ok in zip(hashes, some, strict=True)], pa.int64()),
                pa.array([x if ok else [] for x, ok in zip(bands.view(np.int64).tolist(), some, strict=True)], pa.list_(pa.int64())),
            ], schema=_SIGNED)


def element_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Of each text the sorted hashes of its (shingle, occurrence) pairs: a set in place of a multiset."""
    text, s, w = bags([word_hashes(t) for t in texts])
    before = np.cumsum(w) - w
    nth = np.arange(int(w.sum())) - np.repeat(before, w)
    element = _mix(np.repeat(s, w) + nth.astype(_U) * _STEP[2])
    text = np.repeat(text, w)
    order = np.lexsort((element, text))
    return np.split(element[order], np.cumsum(np.bincount(text, minlength=len(texts)))[:-1])


def _elements(batches):
    for b in batches:
        nodes, texts = b.column(0), b.column(1).cast(pa.binary()).to_pylist()
        for part in _runs(texts):
            sets = element_sets([texts[i] for i in part])
            yield pa.RecordBatch.from_arrays([nodes.take(pa.array(part)), pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "elements"])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if not len(a):
        return 0.0
    both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return both / (len(a) + len(b) - both)


_LINK = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _meet(least: float):
    """Rows (rep, salt, node, elements) sorted by (rep, salt), the representative first: links of its members with it."""

    def run(batches):
        head, own = None, np.zeros(0, _U)
        for b in batches:
            rep, salt, node = (b.column(i).to_pylist() for i in range(3))
            out = []
            for i, key in enumerate(zip(rep, salt, strict=True)):
                elements = np.frombuffer(b.column(3)[i].as_buffer(), "<u8")
                if node[i] == rep[i]:
                    head, own = key, elements.copy()
                elif key == head and similarity(own, elements) >= least - 1e-12:
                    out.append((rep[i], node[i]))
            yield pa.RecordBatch.from_pydict({"a": [x for x, _ in out], "b": [x for _, x in out]}, schema=_LINK)

    return run


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of ``a`` shares with each of ``b``.

    Elements that many pairs share are counted by a matrix product, the others pair by pair.
    """
    shape = (len(a), len(b))
    out = np.zeros(shape, np.int64)
    x, y = np.concatenate(a), np.concatenate(b)
    x_row, y_row = np.repeat(np.arange(len(a)), [len(s) for s in a]), np.repeat(np.arange(len(b)), [len(s) for s in b])
    common, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    x, y = at[: len(x)], at[len(x) :]
    in_x, in_y = np.bincount(x, minlength=len(common)), np.bincount(y, minlength=len(common))
    pairs = in_x * in_y
    dense = np.flatnonzero(pairs > max(16, len(a) * len(b) // 100))
    for some in np.array_split(dense, -(-len(dense) // 1024)) if len(dense) else []:
        column = np.full(len(common), -1)
        column[some] = np.arange(len(some))
        left, right = np.zeros((len(a), len(some)), np.float32), np.zeros((len(b), len(some)), np.float32)
        for matrix, row, element in ((left, x_row, x), (right, y_row, y)):
            here = np.flatnonzero(column[element] >= 0)
            matrix[row[here], column[element[here]]] = 1
        out += np.rint(left @ right.T).astype(np.int64)
    pairs[dense] = 0
    keep = np.flatnonzero(pairs[x] > 0)
    x, x_row = x[keep], x_row[keep]
    order = np.argsort(y, kind="stable")
    y_row, first = y_row[order], np.cumsum(in_y) - in_y
    for some in np.split(np.arange(len(x)), np.flatnonzero(np.diff(np.cumsum(in_y[x]) // 4_000_000)) + 1):
        times = in_y[x[some]]
        place = np.repeat(first[x[some]] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        out += np.bincount(np.repeat(x_row[some], times) * len(b) + y_row[place], minlength=out.size).reshape(shape)
    return out


def solve(nodes: list, labels: np.ndarray, sides: np.ndarray, sets: list[np.ndarray], least: float) -> list[tuple]:
    """Links that join classes of one tile: pairs between its sides, or within it where there is one side."""
    size = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    _, at, count = np.unique(every, return_inverse=True, return_counts=True)
    shared = np.bincount(np.repeat(np.arange(len(sets)), size), weights=count[at] > 1, minlength=len(sets))
    good = np.flatnonzero(shared >= least * size - 1e-9)  # the others share too little with all of the tile
    if len(good) < 2 or len(np.unique(labels[good])) < 2:
        return []
    if len(two := np.unique(sides)) == 2:
        rows, cols = good[sides[good] == two[0]], good[sides[good] == two[1]]
    else:  # pairs within the largest class need no check
        classes, n = np.unique(labels[good], return_counts=True)
        rows, cols = good[labels[good] != classes[n.argmax()]], good
    if not len(rows) or not len(cols):
        return []
    links, parent = [], {}

    def root(k):
        while parent.get(k, k) != k:
            k = parent[k]
        return k

    for part in np.array_split(rows, -(-len(rows) // TILE)):
        both = overlaps([sets[i] for i in part], [sets[i] for i in cols])
        near = (both >= (least - 1e-12) * (size[part][:, None] + size[cols][None, :] - both)) & (labels[part][:, None] != labels[cols][None, :])
        i, j = np.nonzero(near)
        _, once = np.unique(labels[part[i]] * (labels.max() + 1) + labels[cols[j]], return_index=True)
        for k in once.tolist():
            x, y = root(int(labels[part[i[k]]])), root(int(labels[cols[j[k]]]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                links.append((nodes[part[i[k]]], nodes[cols[j[k]]]))
    return links


def _tiles(least: float):
    """Rows (bucket, i, j, side, label, node, elements) sorted by (bucket, i, j): links, tile by tile."""

    def solved(held):
        sides, labels, nodes, sets = zip(*held, strict=True)
        _, number = np.unique(np.array(labels, dtype=object), return_inverse=True)
        return solve(list(nodes), number.astype(np.int64), np.array(sides), list(sets), least)

    def run(batches):
        key, held = None, []

        def out(links):
            return pa.RecordBatch.from_pydict({"a": [x for x, _ in links], "b": [x for _, x in links]}, schema=_LINK)

        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(6)]
            for i, (bucket, p, q, side, label, node) in enumerate(zip(*cols, strict=True)):
                if (bucket, p, q) != key:
                    if len(held) > 1:
                        yield out(solved(held))
                    key, held = (bucket, p, q), []
                held.append((side, label, node, np.frombuffer(b.column(6)[i].as_py(), "<u8")))
        if len(held) > 1:
            yield out(solved(held))

    return run


def components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) with each node's label the smallest of its component; ``links`` (a, b) are between nodes.

    Nodes of one label are of one class already, whatever linked them: links are taken as links of labels.
    Labels flow over these and jump to their label's label until nothing changes; nodes follow their old label.
    """
    ends = links.join(labels.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("y")), "b").where("x <> y").select("x", "y")
    both = materialize(ends.select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("e")).select("e.x", "e.y").distinct(), "label-links")
    if both.isEmpty():
        release(both)
        return labels
    # all labels but the smallest of their neighbourhood take it in the first round
    now = materialize(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("near")).select("node", F.least("node", "near").alias("label")), "label-classes")
    while True:
        near = both.join(now.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("at")).agg(F.min("label").alias("near"))
        new = now.join(near, F.col("node") == F.col("at"), "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # a label that found a smaller one takes its whole class along
        hooks = new.where("label < old").groupBy(F.col("old").alias("root")).agg(F.min("label").alias("to"))
        moved = materialize(new.join(hooks, F.col("label") == F.col("root"), "left").select("node", "old", F.least("label", "to").alias("label")), "label-classes")
        release(now)
        now = moved.select("node", "label")
        if moved.where("label < old").isEmpty():
            break
    to = now.select(F.col("node").alias("was"), F.col("label").alias("to"))
    out = materialize(labels.join(to, F.col("label") == F.col("was"), "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
    release(both, now)
    return out


def _representatives(buckets: DataFrame) -> DataFrame:
    """(of, rep, rep_n): of each bucket the member whose buckets hold most, of equals the least."""
    fullness = buckets.groupBy(F.col("node").alias("of_node")).agg(F.sum("size").alias("full"))
    ranked = buckets.join(fullness, F.col("node") == F.col("of_node"))
    first = F.min(F.struct((-F.col("full")).alias("o"), "node", "n")).alias("r")
    return ranked.groupBy(F.col("bucket").alias("of")).agg(first).select("of", F.col("r.node").alias("rep"), F.col("r.n").alias("rep_n"))


def _first_links(buckets: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links of members with their buckets' representatives. A representative of many is copied for every SPAN of them."""
    pairs = buckets.where("node <> rep").where(F.least("n", "rep_n") >= (least - 1e-9) * F.greatest("n", "rep_n")).select("rep", "node").distinct()
    pairs = materialize(pairs, "pairs")
    heads = pairs.groupBy(F.col("rep").alias("head")).agg(F.ceil(F.count("*") / SPAN).cast("int").alias("salts"))
    dealt = pairs.join(heads, F.col("rep") == F.col("head")).select("rep", F.pmod(F.xxhash64("node"), "salts").cast("int").alias("salt"), "node")
    copies = heads.select(F.col("head").alias("rep"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("head").alias("node"))
    rows = dealt.unionByName(copies).join(sets, "node").select("rep", "salt", "node", "elements")
    dealt_out = rows.repartition("rep", "salt").sortWithinPartitions("rep", "salt", F.col("node") != F.col("rep"))
    links = materialize(dealt_out.mapInArrow(_meet(least), "a binary, b binary"), "links")
    release(pairs)
    return links


def _other_links(buckets: DataFrame, labels: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links within buckets whose members, but for the representative, are of different classes."""
    now = buckets.join(labels, "node").select("bucket", "node", "n", "rep", "label")
    open_ = now.where("node <> rep").groupBy(F.col("bucket").alias("of")).agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size"), F.sum("n").alias("elements"))
    parts = F.greatest(F.ceil(F.col("size") / TILE), F.ceil(F.col("elements") / TILE_ELEMENTS)).cast("int")
    open_ = open_.where("lo < hi").select("of", parts.alias("parts"))
    part = F.pmod(F.xxhash64("node"), "parts").cast("int")
    members = now.join(open_, F.col("bucket") == F.col("of")).select("bucket", "label", "node", part.alias("side"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    members = members.select("bucket", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "label", "node")
    rows = members.join(sets, "node").select("bucket", "i", "j", "side", "label", "node", "elements")
    return materialize(rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(_tiles(least), "a binary, b binary"), "links")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(id, copy, class_id) for every row; ``copy`` is a hash of the text as it stands."""
    base = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("copy"), F.col(text).alias("text"))
    signed = materialize(base.mapInArrow(_sign, "id long, copy long, node binary, n long, bands array<long>"), "signed")
    texts = signed.where("node IS NOT NULL AND id IS NOT NULL").groupBy("node").agg(F.min(F.struct("id", "copy")).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    texts = materialize(texts, "texts")
    each = texts.select("node", "n", F.explode("bands").alias("bucket"))
    shared = each.groupBy(F.col("bucket").alias("of")).agg(F.count("*").alias("size")).where("size > 1")
    members = materialize(each.join(shared, F.col("bucket") == F.col("of")).select("bucket", "size", "node", "n"), "members")
    buckets = materialize(members.join(_representatives(members), F.col("bucket") == F.col("of")).select("bucket", "node", "n", "rep", "rep_n"), "buckets")
    release(members)

    nodes = buckets.select("node").distinct()
    heads = texts.join(nodes, "node", "left_semi").select("node", F.col("first.id").alias("of_id"), F.col("first.copy").alias("of_copy"))
    whole = base.join(heads, (F.col("id") == F.col("of_id")) & (F.col("copy") == F.col("of_copy"))).select("node", "text")
    sets = materialize(whole.mapInArrow(_elements, "node binary, elements binary").dropDuplicates(["node"]), "sets")

    labels = materialize(nodes.select("node", F.col("node").alias("label")), "labels")
    for step in (lambda: _first_links(buckets, sets, least), lambda: _other_links(buckets, labels, sets, least)):
        links = step()
        before, labels = labels, components(labels, links)
        release(links, *([before] if before is not labels else []))
    release(buckets, sets)

    ids = texts.select("node", F.col("first.id").alias("least_id"))
    by_label = ids.join(labels, "node").groupBy(F.col("label").alias("of")).agg(F.min("least_id").alias("class"))
    linked = labels.join(by_label, F.col("label") == F.col("of")).select("node", "class")
    of_text = ids.join(linked, "node", "left").select(F.col("node").alias("of"), F.coalesce("class", "least_id").alias("class"))
    out = signed.join(of_text, F.col("node") == F.col("of"), "left").select("id", "copy", F.when(F.col("id").isNotNull(), F.coalesce("class", "id")).alias("class_id"))
    out = materialize(out, "classes")
    release(signed, texts, labels)
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id): the smallest id of the text's class, for every row."""
    return classes(docs, doc_id, text, least).select(F.col("id").alias("doc_id"), "class_id")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class (all rows with its id and text), with the columns of ``docs``."""
    every = classes(docs, doc_id, text)
    lost = materialize(every.where("id <> class_id").select("id", "copy").distinct(), "lost")
    release(every)
    return anti_join(docs, lost, {"id": F.col(doc_id).cast("long"), "copy": F.xxhash64(F.col(text))})


def brute_force(rows: list[tuple[int, str | None]], least: float = SIMILARITY) -> dict[int, int]:
    """Classes by all pairs, from tuples of words; for tests."""
    from collections import Counter

    def bag(t):
        w = (t or "").encode().lower().split()
        return Counter(tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))) if w else Counter()

    own = {d: bag(t) for d, t in rows}
    label = {d: d for d in own}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    ids = sorted(own)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            top = (own[a] & own[b]).total()
            if top and top >= least * (own[a] | own[b]).total():
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}
