"""Benchmark decontamination (operator 9). DataFrame functions only.

Texts are lower-cased and split at everything but letters and digits (of ASCII, and all other
characters count as letters); a shingle is five words, hashed, and weighs 1 + ln(items / items
that have it), so that what many items share counts less.

Windows: a document is compared with items in windows of the items' sizes, at every start. A
window of a size can only be similar to an item of that size if its shingles that any such item
holds weigh enough for the lightest of them; a running sum over the places of those shingles
tells all starts where they do, whatever the order of the parts, and the others are pruned
exactly. Every window left gets a 64-bit SimHash over its weighted shingles, and so does every item.

Index: fingerprints are cut into ``RADIUS + 1`` blocks, and two within the radius agree in one
block at least, so a join on (size, block, value) finds for each window all items of its size
within the radius; which items the window's shingles came from plays no part in it. Candidates
are verified by the exact weighted Jaccard similarity of the shingle multisets.

The radius covers the threshold: at a similarity of 0.8 about 10 of 64 bits differ, 3 standard
deviations are 9 bits more, and 23 leaves one such pair in 100,000 out.

Sizes: the items' tables are written, and Catalyst broadcasts them only if the files are under
the session's limit; else the same joins shuffle. Nothing is collected but the number of items.

Defined results: null texts are empty; rows with a null id are not examined (and are kept by
``drop_contaminated``); an item of fewer than five words has no shingle and can't be found; a
document shorter than an item is one window; rows that share an id are examined each and the best
window is reported; items that share an id are one item per text; empty tables give an empty
result; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm._common import anti_join, materialize, release

SHINGLE = 5
SIMILARITY = 0.8
BITS = 64
RADIUS = 23
#: Everything of ASCII that is no letter or digit.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _hashed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, copy, n_words, g): copy is a hash of the text, and g has the hash of the shingle that starts at each word."""
    words = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), BETWEEN_WORDS), "")
    # exploding a one-element array holds the optimizer back from computing the array anew for each of its elements
    one = df.select(F.col(key).cast("long").alias("key"), F.xxhash64(F.col(text)).alias("copy"), F.explode(F.array(F.transform(words, lambda x: F.xxhash64(x)))).alias("w"))
    at = lambda i, k: F.get("w", i + F.lit(k))
    every = F.transform("w", lambda x, i: F.xxhash64(x, *[at(i, k) for k in range(1, SHINGLE)]))
    cut = F.slice(every, 1, F.greatest(F.size("w") - (SHINGLE - 1), F.lit(0)))
    return one.select("key", "copy", F.size("w").alias("n_words"), F.explode(F.array(cut)).alias("g"))


def _fingerprint(shingles: DataFrame, keys: list[str]) -> DataFrame:
    """SimHash over rows (keys, h, n, weight): each bit is the sign of the weighted votes."""
    vote = F.col("weight") * F.col("n")
    votes = [F.sum(F.when(F.expr(f"(h & {1 << b if b < 63 else -(1 << 63)}L) <> 0" if b < 63 else "h < 0"), vote).otherwise(-vote)).alias(f"b{b}") for b in range(BITS)]
    bits = [F.when(F.col(f"b{b}") > 0, F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for b in range(BITS)]
    print_ = bits[0]
    for x in bits[1:]:
        print_ = print_.bitwiseOR(x)
    return shingles.groupBy(*keys).agg(*votes).select(*keys, print_.alias("simhash"))


def _blocks(simhash: str) -> F.Column:
    """The values of the fingerprint's blocks, numbered."""
    n = RADIUS + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    return F.array(*[F.shiftrightunsigned(simhash, a).bitwiseAND(F.lit((1 << (z - a)) - 1)) for a, z in zip(cuts, cuts[1:], strict=False)])


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, window_start, window_words, hamming, similarity: the best window of each pair."""
    items = _hashed(benchmark.where(F.col(item_id).isNotNull()), item_id, item_text).where(F.size("g") > 0)
    each = materialize(items.dropDuplicates(["key", "copy"]).select(F.struct("key", "copy").alias("item"), F.col("n_words").alias("item_words"), F.explode("g").alias("h")), "item-shingles")
    n_items = max(1, each.agg(F.countDistinct("item").alias("n")).first()["n"])
    weigh = lambda of: F.round(1000 * (1 + F.log(F.lit(float(n_items)) / of))).cast("long")
    weights = materialize(each.groupBy("h").agg(F.countDistinct("item").alias("of")).select("h", weigh(F.col("of")).alias("weight")), "weights")
    bags = materialize(each.groupBy("item", "item_words", "h").agg(F.count("*").alias("n")).join(weights, "h"), "bags")
    sums = bags.groupBy("item", "item_words").agg(F.sum(F.col("weight") * F.col("n")).alias("item_weight"))
    enough = sums.groupBy("item_words").agg((similarity * F.min("item_weight")).alias("enough"))
    of_size = materialize(bags.select("item_words", "h", "weight").distinct().join(enough, "item_words"), "sizes")

    known = docs.where(F.col(doc_id).isNotNull())
    hits = _hashed(known, doc_id, text).select("key", "copy", "n_words", F.posexplode("g").alias("p", "h"))
    hits = materialize(hits.join(weights.select("h"), "h", "left_semi"), "hits")
    # a window's similarity to any item of its size is at most what its hits weigh: an exact prune, of documents first
    of_text = ["key", "copy", "n_words", "item_words", "enough"]
    held = hits.groupBy("key", "copy", "n_words", "h").agg(F.countDistinct("p").alias("n")).join(of_size, "h").groupBy(*of_text).agg(F.sum(F.col("weight") * F.col("n")).alias("held"))
    texts = materialize(held.where(F.col("held") >= F.col("enough")).select("key", "copy", "item_words"), "texts")
    # each hit weighs from the first start whose window holds it to the last; starts between two changes hold the same
    wide = F.least("item_words", "n_words")
    at = F.explode(F.array(F.struct((F.col("p") - (wide - SHINGLE)).alias("s"), F.col("weight").alias("d")), F.struct((F.col("p") + 1).alias("s"), (-F.col("weight")).alias("d")))).alias("at")
    placed = hits.distinct().join(texts.select("key", "copy").distinct(), ["key", "copy"], "left_semi").join(of_size, "h").join(texts, ["key", "copy", "item_words"])
    changes = placed.select(*of_text, at).groupBy(*of_text, F.col("at.s").alias("s")).agg(F.sum("at.d").alias("d"))
    along = Window.partitionBy(*of_text).orderBy("s")
    runs = changes.select(*of_text, "s", F.sum("d").over(along).alias("held"), F.lead("s").over(along).alias("next")).where(F.col("held") >= F.col("enough"))
    runs = runs.select("key", "copy", "item_words", F.greatest("s", F.lit(0)).alias("a"), F.least(F.col("next") - 1, F.col("n_words") - wide).alias("z")).where("a <= z")
    starts = materialize(runs.select("key", "copy", "item_words", F.explode(F.sequence("a", "z")).alias("start")), "starts")

    few = starts.select(F.col("key").alias("of_key"), F.col("copy").alias("of_copy")).distinct()
    again = known.join(few, (F.col(doc_id).cast("long") == F.col("of_key")) & (F.xxhash64(F.col(text)) == F.col("of_copy")), "left_semi")
    windows = _hashed(again, doc_id, text).dropDuplicates(["key", "copy"]).join(starts, ["key", "copy"])
    ids = ["key", "copy", "item_words", "start", "words"]
    cut = F.slice("g", F.col("start") + 1, F.greatest(wide - (SHINGLE - 1), F.lit(1)))
    rows = windows.select("key", "copy", "item_words", "start", wide.alias("words"), F.explode(cut).alias("h")).groupBy(*ids, "h").agg(F.count("*").alias("n"))
    rows = materialize(rows.join(weights, "h", "left").withColumn("weight", F.coalesce("weight", weigh(F.lit(1)))), "windows")

    prints = _fingerprint(rows, ids).select(*ids, "simhash", F.posexplode(_blocks("simhash")).alias("block", "value"))
    of_items = _fingerprint(bags, ["item", "item_words"]).select("item", "item_words", F.col("simhash").alias("item_simhash"), F.posexplode(_blocks("simhash")).alias("block", "value"))
    hamming = F.bit_count(F.col("simhash").bitwiseXOR(F.col("item_simhash")))
    of_items = materialize(of_items, "blocks")
    near = prints.join(of_items, ["item_words", "block", "value"]).where(hamming <= RADIUS).select(*ids, "item", hamming.alias("hamming")).distinct()
    near = materialize(near, "near")
    own = rows.groupBy(*ids).agg(F.sum(F.col("weight") * F.col("n")).alias("own"))
    shared = near.join(rows, ids).join(bags.select("item", "h", F.col("n").alias("item_n")), ["item", "h"]).groupBy(*ids, "item", "hamming").agg(F.sum(F.col("weight") * F.least("n", "item_n")).alias("shared"))
    scored = shared.join(own, ids).join(sums.select("item", "item_weight"), "item").withColumn("similarity", F.col("shared") / (F.col("own") + F.col("item_weight") - F.col("shared"))).where(F.col("similarity") >= similarity)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"), "words", (-F.col("hamming")).alias("d"))).alias("b")
    out = scored.groupBy("key", F.col("item.key").alias("item_key")).agg(best)
    out = out.select(F.col("key").alias("doc_id"), F.col("item_key").alias("item_id"), (-F.col("b.s")).alias("window_start"), F.col("b.words").alias("window_words"), (-F.col("b.d")).alias("hamming"), F.round("b.similarity", 6).alias("similarity"))
    out = materialize(out, "leaks")
    release(each, weights, bags, of_size, hits, texts, starts, rows, of_items, near)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leak, with the columns of ``docs``."""
    leaks = find_leaks(docs, benchmark).select("doc_id").distinct()
    return anti_join(docs, leaks, {"doc_id": F.col("doc_id").cast("long")})


def brute_force(docs: list[tuple], items: list[tuple], similarity: float = SIMILARITY) -> set[tuple]:
    """(doc_id, item_id) with any item-sized window of enough similarity, by trying all; for tests."""
    import math
    import re
    from collections import Counter

    words = lambda t: [w for w in re.split(BETWEEN_WORDS, (t or "").lower()) if w]
    shingles = lambda w: Counter(tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1))
    bags = {i: (words(t), shingles(words(t))) for i, t in items if len(words(t)) >= SHINGLE}
    of = Counter(h for _, b in bags.values() for h in b)
    weight = lambda h: round(1000 * (1 + math.log(len(bags) / of.get(h, 1))))
    out = set()
    for d, t in docs:
        w = words(t)
        for i, (iw, bag) in bags.items():
            n = min(len(iw), len(w))
            for s in range(len(w) - n + 1):
                own = shingles(w[s : s + n])
                top = sum(weight(h) * min(c, bag[h]) for h, c in own.items())
                if top and top >= similarity * (sum(weight(h) * c for h, c in own.items()) + sum(weight(h) * c for h, c in bag.items()) - top):
                    out.add((d, i))
                    break
    return out
