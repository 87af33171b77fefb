"""Near-duplicates by the Jaccard similarity of word shingles: candidates by hashing, links by exact sets.

Candidates come in three steps, each only for what the ones before left unconnected: SimHash fingerprints within two
bits (by ball hashing), the foremost sets of each MinHash band, and at last a join on the rarest shingles that
misses no pair among sets that share a band with a set they are not connected to.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.batches import slices, texts_of
from tracemill.llm.components import components
from tracemill.llm.simhash import LOWER, SEED, links, majority
from tracemill.session import settled, stored

SHINGLE = 5
THRESHOLD = 0.8
# A pair of similarity s shares a band with probability 1 - (1 - s^ROWS)^BANDS: 0.9993 at 0.8.
BANDS = 24
ROWS = 6
BLOCK = 2048
SIGNED = "doc_id long, digest binary, set long, size long, fp long, bands array<long>"
_random = np.random.default_rng(SEED)
FACTORS = _random.integers(0, 2**31, BANDS * ROWS, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
SHIFTS = _random.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)[:, None]


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Of a UTF-8 text, the sorted 64-bit hashes of its distinct shingles, lower case in ASCII; none without words.

    A text with fewer words has one shingle of all of them.
    """
    words = text.translate(LOWER).split()  # splits at \x20 and \x09-\x0D only
    if not words:
        return np.empty(0, dtype=np.uint64)
    runs = [words[i:] for i in range(min(shingle, len(words)))]
    hashes = map(xxhash.xxh64_intdigest, map(b" ".join, zip(*runs)), repeat(SEED))
    return np.unique(np.fromiter(hashes, np.uint64, len(runs[-1])))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of the MinHash signature; none for an empty set."""
    if not len(hashes):
        return np.empty(0, dtype=np.int64)
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 2**32 - 1, dtype=np.uint32)
    for at in range(0, len(high), BLOCK):
        np.minimum(least, (FACTORS * high[at : at + BLOCK] + SHIFTS).min(axis=1), out=least)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), seed=k) for k, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, dtype=np.uint64).view(np.int64)


def _class(hashes: np.ndarray) -> int:
    """The name of a set; 0 is the empty one's."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).view(np.int64)) if len(hashes) else 0


def _signed(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = [shingles(text, shingle) for text in texts_of(part, "text")]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("digest"),
                    pa.array([_class(x) for x in sets], pa.int64()),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([majority(x) for x in sets], pa.int64()),
                    pa.array([bands(x) for x in sets], pa.list_(pa.int64())),
                ],
                ["doc_id", "digest", "set", "size", "fp", "bands"],
            )

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = [shingles(text, shingle) for text in texts_of(part, "text")]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([_class(x) for x in sets], pa.int64()),
                    pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())),
                ],
                ["set", "hashes"],
            )

    return run


def text_digest(text: Column) -> Column:
    """128 bits of a text; NULL has the empty digest."""
    return F.coalesce(F.unhex(F.md5(F.encode(text, "UTF-8"))), F.lit(b""))


def _row_key() -> Column:
    """Tells rows apart by id and text. As one value: parts that are NULL are equal to each other."""
    return F.struct("doc_id", "digest").alias("row")


def _linked(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) of sets whose similarity is the threshold at least, stored."""
    left = sets.select(F.col("set").alias("u"), F.col("hashes").alias("a"))
    right = sets.select(F.col("set").alias("v"), F.col("hashes").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    similar = both / (F.size("a") + F.size("b") - both) >= threshold
    return stored(pairs.join(left, "u").join(right, "v").where(similar).select("u", "v"), "similar", compact=True)


def _rooted(members: DataFrame, found: DataFrame) -> DataFrame:
    """``members`` of bands whose sets are not all connected yet, with the ``root`` of each."""
    named = members.select("band", "set", "size").join(components(found), F.col("set") == F.col("node"), "left")
    named = named.select("band", "set", "size", F.coalesce("root", "set").alias("root"))
    open_ = named.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return stored(named.join(open_.select("band"), "band", "left_semi"), "open", compact=True)


def _pairs(frame: DataFrame, one: str, other: str, threshold: float) -> DataFrame:
    """Distinct (u, v), u < v, of two columns of (set, size) whose sizes allow the threshold."""
    near = F.least(f"{one}.size", f"{other}.size") / F.greatest(f"{one}.size", f"{other}.size") >= threshold
    ends = (F.col(f"{one}.set"), F.col(f"{other}.set"))
    return frame.where(near & (ends[0] != ends[1])).select(F.least(*ends).alias("u"), F.greatest(*ends).alias("v")).distinct()


def ball_pairs(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(u, v)``: sets to compare as their fingerprints are at most two bits apart; ``classes``: (set, size, fp).

    Every fingerprint has one set that stands for it. The others are compared with it, and those that stand for linked
    fingerprints with each other, so a large group costs one comparison for each of its sets.
    """
    own = F.struct("set", "size")
    first = classes.groupBy("fp").agg(F.min(own).alias("first"))
    same = classes.select("fp", own.alias("own")).join(first, "fp").select("own", F.col("first").alias("other"))
    ends = links(classes)
    one = first.select(F.col("fp").alias("u"), F.col("first").alias("own"))
    two = first.select(F.col("fp").alias("v"), F.col("first").alias("other"))
    near = ends.join(one, "u").join(two, "v").select("own", "other")
    return _pairs(same.unionByName(near), "own", "other", threshold)


def _foremost(open_: DataFrame, found: DataFrame, threshold: float) -> DataFrame:
    """Pairs of each set of an open band with the band's smallest one, the one before it and the one with most links."""
    ends = found.select(F.explode(F.array("u", "v")).alias("end")).groupBy("end").agg(F.count(F.lit(1)).alias("n"))
    ranked = open_.join(ends, F.col("set") == F.col("end"), "left")
    best = F.max(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "set", "size", "root"))
    hubs = ranked.groupBy("band").agg(best.alias("hub"))
    order = Window.partitionBy("band").orderBy("set")
    own = F.struct("set", "size", "root")
    near = open_.select("band", own.alias("own"), F.first(own).over(order).alias("first"), F.lag(own).over(order).alias("before"))
    hub = F.struct("hub.set", "hub.size", "hub.root")
    met = near.join(hubs, "band").select("own", F.explode(F.array("first", "before", hub)).alias("other"))
    return _pairs(met.where(F.col("own.root") != F.col("other.root")), "own", "other", threshold)


def rare_pairs(open_: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(u, v)``: all pairs of sets of different roots that may have the similarity. ``open_``: (set, size, root).

    Two sets x and y, x no larger, with similarity t share t/(1+t) of their sizes' sum. With one order for all shingles, some
    shared one is then among the first |x| - ceil(2t/(1+t) |x|) + 1 of x and the first |y| - ceil(t |y|) + 1 of y. The
    order puts shingles first that no other root has, which join nothing, then rare ones; sets that have only
    common passages in common do not meet. Of the rows of a shingle those of its main root only meet the others,
    so a large connected group is not compared with itself.
    """
    each = open_.select("set", "size", "root").distinct().join(sets, "set")
    tokens = each.select("set", "size", "root", F.explode("hashes").alias("token"))
    counts = tokens.groupBy("token", "root").agg(F.count(F.lit(1)).alias("n"))
    shared = counts.groupBy("token").agg(
        F.sum("n").alias("uses"), F.max_by("root", "n").alias("main"), F.count(F.lit(1)).alias("roots")
    )
    met = tokens.join(shared.where("roots > 1"), "token")
    of_set = Window.partitionBy("set")
    place = F.row_number().over(of_set.orderBy("uses", "token")) + F.col("size") - F.count(F.lit(1)).over(of_set)
    # A hair less than exact, so that rounding makes a prefix longer and never shorter.
    prefix = lambda share: F.col("size") - F.ceil(share * F.col("size") - 1e-6) + 1
    ranked = met.withColumn("place", place).where(F.col("place") <= prefix(threshold))
    ranked = ranked.withColumn("indexed", F.col("place") <= prefix(2 * threshold / (1 + threshold)))
    rows = stored(ranked.select("token", "main", "set", "size", "root", "place", "indexed"), "rare", compact=True)

    a, b = rows.where("root != main").alias("a"), rows.alias("b")
    first = F.struct("a.size", "a.set") < F.struct("b.size", "b.set")
    once = (F.col("b.root") == F.col("b.main")) | first
    in_index = F.when(first, F.col("a.indexed")).otherwise(F.col("b.indexed"))
    sizes = F.least("a.size", "b.size") >= threshold * F.greatest("a.size", "b.size") - 1e-6
    rest = 1 + F.least(F.col("a.size") - F.col("a.place"), F.col("b.size") - F.col("b.place"))
    enough = rest >= threshold / (1 + threshold) * (F.col("a.size") + F.col("b.size")) - 1e-6
    differ = F.col("a.root") != F.col("b.root")
    found = a.join(b, (F.col("a.token") == F.col("b.token")) & differ & once & in_index & sizes & enough)
    return found.select(F.least("a.set", "b.set").alias("u"), F.greatest("a.set", "b.set").alias("v")).distinct()


def similar_sets(
    members: DataFrame, sets: DataFrame, first_pairs: DataFrame, threshold: float = THRESHOLD
) -> DataFrame:
    """``(u, v)``: links that connect all sets that share a band and have the similarity.

    ``members``: (band, set, size); ``sets``: (set, hashes). After ``first_pairs``, sets of bands that are not
    all connected are compared with foremost ones of their bands; so a large group is connected by a number of comparisons
    that follows its size. What is not connected then is compared by ``rare_pairs``, which leaves no pair out.
    """
    found = _linked(first_pairs, sets, threshold)
    open_ = _rooted(members, found)
    found = found.unionByName(_linked(_foremost(open_, found, threshold), sets, threshold))
    open_ = _rooted(open_, found)
    return found.unionByName(_linked(rare_pairs(open_, sets, threshold), sets, threshold))


def jaccard_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``(doc_id, digest, root)`` of every row of ``docs``; rows of one group have one ``root``.

    Groups are connected by pairs of texts whose sets of shingles have the similarity. Texts of equal sets, also all
    without words, are one class from the start, named by 64 bits of the set; ``digest`` tells texts of one id apart.
    A link needs fingerprints within two bits or a shared band, see BANDS, and is held against the sets. Rows stay
    repeated, NULL ids have their place.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    given = given.withColumn("digest", text_digest(F.col("text")))
    signed = stored(given.mapInArrow(_signed(shingle), SIGNED), "jaccard", compact=True)
    lowest = F.min(F.struct("doc_id", "digest", "size", "fp", "bands")).alias("row")
    classes = signed.where("size > 0").groupBy("set").agg(lowest).select("set", "row.*")
    classes = stored(classes, "classes", compact=True)
    each = classes.select("set", "size", F.explode("bands").alias("band"))
    shared = each.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("band"))).where("n > 1")
    members = stored(shared.select("band", "set", "size"), "members", compact=True)
    first_pairs = stored(ball_pairs(classes, threshold), "balls", compact=True)
    # Only texts that are to be compared are read as sets; a repeated row gives its set once.
    ends = first_pairs.select(F.explode(F.array("u", "v")).alias("set")).unionByName(members.select("set")).distinct()
    wanted = classes.join(ends, "set", "left_semi").select(_row_key())
    texts = given.select(_row_key(), "text").join(wanted, "row", "left_semi").groupBy("row").agg(F.first("text").alias("text"))
    sets = stored(texts.select("text").mapInArrow(_sets(shingle), "set long, hashes array<long>"), "sets")
    forest = components(similar_sets(members, sets, first_pairs, threshold))
    return signed.join(forest, F.col("set") == F.col("node"), "left").select(
        "doc_id", "digest", F.coalesce("root", "set").alias("root")
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of near-duplicates (``doc_id``, ``text``): the one with the smallest id, a NULL id last.

    Rows are told apart by id and text, so rows of one id with different texts are decided each by itself; of one id,
    the smallest text digest stays, and of rows that have both in common the smallest in the other columns. What
    goes is stored as a table of keys; Spark broadcasts it if it is small enough, and then the texts are not shuffled.
    """
    rows = settled(docs.sparkSession, lambda: jaccard_groups(docs), "groups")
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")
    keys = rows.groupBy("root", "doc_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    keys = keys.join(rows.groupBy("root").agg(F.min(rank).alias("first")), "root")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))
    key = [F.col("doc_id").alias("its_id"), F.col("digest").alias("its_digest")]
    gone = stored(keys.where(~stays).select(*key), "gone", True)
    again = stored(keys.where(stays & (F.col("n") > 1)).select(*key), "again", True)
    named = docs.withColumn("its_text", text_digest(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col("its_id")) & (F.col("its_text") == F.col("its_digest"))
    kept = named.join(gone, same, "left_anti")
    single = kept.join(again, same, "left_anti").select(docs.columns)
    repeated = kept.join(again, same, "left_semi").groupBy("doc_id", "its_text").agg(F.min(F.struct(*docs.columns)).alias("row"))
    return single.unionByName(repeated.select("row.*"))
