"""Packing (operator 4): Karmarkar-Karp differencing into near-equal windows.

Documents are tokenized where they are read and cut into whole windows of ``capacity`` tokens,
which are sequences already, and a remainder, cut into pieces of at most ``max_piece``. Only the
remainders' descriptions (no token) are dealt by a hash, and packed in lots of at most
``lot_pieces``: a lot of total S starts with ceil(S / capacity) windows; multiway differencing
(the two partial partitions of largest spread are merged, the fullest window of one onto the
emptiest of the other) makes the windows near-equal; while a window exceeds the capacity, the
count rises by its excess, by one at least, and the lot is packed again.

Tokens: a byte-level BPE never merges over the boundary before a space that follows a
non-space, so texts are split at single spaces, the distinct words of a run of texts are looked up in a
worker's bounded cache, and the texts' ids are gathered by number. A text where that boundary rule doesn't hold (a space followed by more white
space) is encoded whole.

Defined results: a null or empty text has one token, the closing id 0; rows with a null id or a
repeated id are packed as rows of their own, and pieces of rows that share an id can't be told
apart by id alone; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import materialize, release

CAPACITY = 1024
MAX_PIECE = 256
LOT_PIECES = 2048
TOKENIZER = "byte_bpe_50k"
#: Words in a worker's cache; later words are encoded anew each time.
CACHE_WORDS = 700_000
END_ID = 0
#: Texts are encoded in runs of about so many characters, which bounds a worker's memory.
CHUNK_CHARS = 6_000_000

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = f"{PIECE}, sequence_id long, offset long"
_PLACED = pa.schema([(x.split()[0], pa.int64()) for x in PLACED.split(", ")])


class WordEncoder:
    """Ids of whole texts by the public vocabulary, equal to the ``tokenizers`` library's.

    ``tiktoken`` reads the same vocabulary as ranks and encodes a word about four times faster;
    texts that hold the special token's string go to ``tokenizers`` itself.
    """

    SPECIAL = "<|endoftext|>"

    def __init__(self, name: str = TOKENIZER, cache_words: int = CACHE_WORDS):
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._bpe = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._json = public_tokenizers.path(f"{name}.json")
        self._whole = None
        self._cache: dict[str, bytes | None] = {}
        self._room = cache_words
        self._marks = {c: self._encode(c) for c in ".,!?;:\n"}

    def _encode(self, text: str) -> bytes:
        return array("I", self._bpe.encode_ordinary(text)).tobytes()

    def _piece(self, letters: str) -> bytes:
        return array("I", self._bpe._encode_single_piece(letters)).tobytes()

    def _word(self, word: str) -> bytes | None:
        return self._cache.get(word) or self._miss(word)

    def _miss(self, word: str) -> bytes | None:
        """Ids of a space and the word; None: it can't be told from its neighbours' white space."""
        if word.isalpha():
            ids = self._piece(" " + word)
        elif word == "" or word[0].isspace():
            return None
        elif word[-1] in self._marks and word[:-1].isalpha():
            return self._word(word[:-1]) + self._marks[word[-1]]
        elif (i := word.find("\n")) > 0 and not word[i - 1].isspace() and word[i + 1 :].isalpha():
            head = self._word(word[:i])
            return head and head + self._marks["\n"] + self._piece(word[i + 1 :])
        else:
            ids = self._encode(" " + word)
        if len(self._cache) < self._room and len(word) < 64:
            self._cache[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of one text, joined."""
        if self.SPECIAL in text:
            if self._whole is None:
                from tokenizers import Tokenizer

                self._whole = Tokenizer.from_file(self._json)
            return array("I", self._whole.encode(text, add_special_tokens=False).ids).tobytes()
        return self._encode(text)

    def encode_many(self, texts: list[str], closing: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with a closing id; and where each text ends. Each distinct word is looked up once."""
        words = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        ends = words.offsets.to_numpy()[1:] - words.offsets.to_numpy()[0]
        coded = words.flatten().dictionary_encode()  # to_numpy: several times faster than to_pylist
        get, miss = self._cache.get, self._miss
        known = [get(w) or miss(w) for w in coded.dictionary.to_numpy(zero_copy_only=False)]
        n_words, n = len(known), len(texts)
        odd = np.array([x is None for x in known], bool)
        firsts = np.append(0, ends[:-1])
        # an entry for each word, but the first of a text stands without its space; and one that closes the text
        entry = np.empty(len(coded) + n, np.int64)
        at_first, at_close = firsts + np.arange(n), ends + np.arange(n)
        word_at = np.ones(len(entry), bool)
        word_at[at_close] = False
        entry[word_at] = coded.indices.to_numpy()
        hit = odd[entry * word_at] & word_at
        hit[at_first] = False
        whole = np.add.reduceat(hit, at_first) > 0 if n else np.zeros(0, bool)
        heads = []
        for i, text in enumerate(texts):
            if self.SPECIAL in text:
                whole[i] = True
            heads.append(self.encode(text) if whole[i] else self._encode(text.partition(" ")[0]))
        parts = [x or b"" for x in known] + heads + [closing.to_bytes(4, "little")]
        size = np.array([len(x) for x in parts], np.int64) // 4
        start = np.cumsum(size) - size
        entry[at_first], entry[at_close] = n_words + np.arange(n), n_words + n
        count = size[entry]
        skip = np.repeat(whole, ends - firsts + 1)
        skip[at_first] = skip[at_close] = False
        count[skip] = 0
        before = np.cumsum(count)
        ids = np.frombuffer(b"".join(parts), "<u4")[np.repeat(start[entry] - before + count, count) + np.arange(before[-1] if n else 0)]
        return ids, before[at_close] if n else np.zeros(0, np.int64)


_encoder: WordEncoder | None = None


def _cut(capacity: int, max_piece: int, tokenizer: str):
    """Documents to pieces: whole windows first, then the remainder in pieces of about equal length."""

    def run(batches):
        global _encoder
        if _encoder is None:
            _encoder = WordEncoder(tokenizer)
        for b in batches:
            docs, texts = b.column(0).to_pylist(), [x or "" for x in b.column(1).to_pylist()]
            sizes = np.cumsum([len(x) for x in texts]) // CHUNK_CHARS
            for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(sizes)) + 1):
                if not len(part):
                    continue
                ids, ends = _encoder.encode_many([texts[i] for i in part], END_ID)
                raw, rows, at = memoryview(ids.tobytes()), [], 0
                for i, end in zip(part.tolist(), ends.tolist(), strict=True):
                    n = end - at
                    full = n // capacity * capacity
                    cuts = [*range(0, full, capacity), full]
                    if left := n - full:
                        parts = -(-left // max_piece)
                        cuts += [full + left * (j + 1) // parts for j in range(parts)]
                    rows += [(docs[i], a, z - a, zlib.crc32(raw[4 * (at + a) : 4 * (at + z)]), n) for a, z in zip(cuts, cuts[1:], strict=False)]
                    at = end
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=pa.schema(list(_PLACED)[:5]))

    return run


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp for k windows: item numbers by window.

    A partial partition is the sums of its windows that hold something, in falling order, and how it
    was merged; the heap gives the two of largest spread. Parts that fit side by side into k windows
    don't add up: a single item is put in its place, others are sorted together.
    """
    heap: list[tuple] = [(-size, i, np.array([size]), i, None) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        if len(a[2]) < len(b[2]):
            a, b = b, a
        x, y = a[2], b[2]
        if len(x) < k and len(y) == 1:
            at = len(x) - int(np.searchsorted(x[::-1], y[0]))
            sums, how = np.concatenate([x[:at], y, x[at:]]), at
        elif len(x) + len(y) <= k:
            both = np.concatenate([x, y])
            how = np.argsort(-both, kind="stable")
            sums = both[how]
        else:  # the fullest of one meets the emptiest of the other
            both = np.zeros(k, np.int64)
            both[: len(x)] = x
            both[k - len(y) :] += y[::-1]
            how = np.argsort(-both, kind="stable")
            sums = both[how]
        spread = sums[0] - (sums[-1] if len(sums) == k else 0)
        heapq.heappush(heap, (-int(spread), tie, sums, None, (a, b, how)))
        tie += 1
    windows: list[list[int]] = [[] for _ in range(k)]
    todo = [(heap[0], np.arange(len(heap[0][2])))] if heap else []
    while todo:  # which window each window of a part went to
        (_, _, _, item, merged), to = todo.pop()
        if item is not None:
            windows[int(to[0])].append(item)
            continue
        a, b, how = merged
        n, m = len(a[2]), len(b[2])
        if isinstance(how, int):
            left, right = np.delete(to, how), to[how : how + 1]
        else:
            back = np.empty(len(to), np.int64)
            back[how] = to
            left, right = back[:n], back[n:] if n + m <= k else back[::-1][:m]
        todo += [(a, left), (b, right)]
    return windows


def pack_lot(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity``; their count rises whenever one exceeds it."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        windows = differencing(sizes, k)
        most = max(sum(sizes[i] for i in w) for w in windows)
        if most <= capacity:
            return [sorted(w) for w in windows if w]
        k += max(1, k * (most - capacity) // capacity)  # as many as would bring the fullest window down


def _pack(capacity: int, lot_pieces: int):
    def run(batches):
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        have = 0

        def lot(part: pa.Table):
            nonlocal sequence
            sizes = part.column("length").to_pylist()
            ids, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
            for w in pack_lot(sizes, capacity):
                at = 0
                for i in w:
                    ids[i], offsets[i] = sequence, at
                    at += sizes[i]
                sequence += 1
            return pa.Table.from_arrays([*part.columns, pa.array(ids), pa.array(offsets)], schema=_PLACED).to_batches()

        for b in batches:
            held.append(b)
            have += b.num_rows
            while have >= 2 * lot_pieces:
                t = pa.Table.from_batches(held)
                yield from lot(t.slice(0, lot_pieces))
                held, have = t.slice(lot_pieces).to_batches(), have - lot_pieces
        if have:
            yield from lot(pa.Table.from_batches(held))

    return run


def _alone(capacity: int):
    """Pieces that fill a window get one each; odd numbers keep them apart from the packed ones."""

    def run(batches):
        from pyspark import TaskContext

        sequence = (1 << 62) + (TaskContext.get().partitionId() << 32)
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(sequence, sequence + n)), pa.array(np.zeros(n, np.int64))], schema=_PLACED)
            sequence += n

    return run


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, max_piece: int = MAX_PIECE, lot_pieces: int = LOT_PIECES, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per piece: where it starts in its document, its CRC, its sequence and offset."""
    spark = docs.sparkSession
    pieces = materialize(docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(_cut(capacity, max_piece, tokenizer), PIECE), "pieces")
    full = F.col("length") == capacity
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest = pieces.where(~full).repartition(n, F.xxhash64("doc_id", "start")).sortWithinPartitions("doc_id", "start", "ids_crc32", "doc_tokens")
    placed = materialize(pieces.where(full).mapInArrow(_alone(capacity), PLACED).unionByName(rest.mapInArrow(_pack(capacity, lot_pieces), PLACED)), "packed")
    release(pieces)
    return placed
