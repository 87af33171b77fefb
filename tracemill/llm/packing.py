"""Documents into sequences of a fixed number of tokens: dominance reduction, then best fit."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracemill.llm.batches import slices
from tracemill.llm.vocabulary import added_tokens, encoder
from tracemill.session import stored

CAPACITY = 1024
END_ID = 2
# The ranks of the tokenizer file, which give the same ids faster; only that file has the strings with ids of their own.
VOCABULARY = "byte_bpe_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
# Pieces of one length that are numbered together, on average.
ITEMS_A_BUCKET = 20_000


def _cut(path: str, tokenizer: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, added_tokens(tokenizer)).encode_to_numpy
        for part in slices(batches, "text"):
            rows = []
            for owner, text in enumerate(part.column("text").to_pylist()):
                body = encode(text or "", allowed_special="all")
                ids = np.append(body, end_id).astype("<u4")
                # A remainder comes first, all later pieces are full.
                starts = [0, *range(len(ids) % capacity or capacity, len(ids), capacity)]
                ends = [*starts[1:], len(ids)]
                rows += [(owner, k, a, b - a, crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(starts, ends))]
            owner, piece, *figures = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(owner)), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in figures]],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return run


def cut_documents(
    docs: DataFrame,
    path: str = "",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "",
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: the token ids of every text plus ``end_id``, cut.

    ``path``: a rank file; ``tokenizer``: the tokenizer file of the same vocabulary. Its added tokens, as ``<|endoftext|>``, are
    one id wherever their string is in a text, as that library has it unless told otherwise. Only documents over
    ``capacity`` are cut; their first piece has the remainder.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    tokenizer = tokenizer or public_tokenizers.path(TOKENIZER)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(_cut(path, tokenizer, capacity, end_id), PIECES)


# --- the plan, from the number of pieces of each length -----------------------------------------


@dataclass
class Plan:
    """Runs of pieces of one length, numbered from 0, that go to runs of sequences at one offset.

    All figures are counts by length, so the plan and the work grow with the square of the capacity
    at most, and not with the number of pieces.
    """

    capacity: int
    left: list[int]
    used: list[int] = field(init=False)
    bins: int = 0
    rows: list[tuple[int, int, int, int, int]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.used = [0] * len(self.left)

    def place(self, length: int, count: int, first_bin: int, offset: int) -> None:
        self.rows.append((length, self.used[length], count, first_bin, offset))
        self.used[length] += count
        self.left[length] -= count

    def fix(self, lengths: tuple[int, ...], count: int) -> None:
        """``count`` new sequences, each with one piece of each of ``lengths``."""
        offset = 0
        for length in lengths:
            self.place(length, count, self.bins, offset)
            offset += length
        self.bins += count


def _largest(left: list[int], limit: int) -> int:
    """The greatest length of at most ``limit`` that has pieces left; 0 if there is none."""
    return next((size for size in range(min(limit, len(left) - 1), 0, -1) if left[size]), 0)


def _smallest(left: list[int], count: int) -> list[int]:
    """The ``count`` smallest pieces left."""
    out: list[int] = []
    for size in range(1, len(left)):
        out += [size] * min(left[size], count - len(out))
        if len(out) == count:
            break
    return out


def reduce_dominated(plan: Plan) -> None:
    """Fix sets of at most three pieces that dominate every other set with their largest piece.

    For the largest piece j, with room r beside it, let k be the largest piece that fits.
    Alone, if none fits. With k, if k is exactly r (whatever else fits into r then fits into k) or if
    no two pieces fit into r. With k and the largest piece that fits beside both, if no three pieces fit into r
    and the smaller piece of any two that fit is no longer than that one: the two can take its place and k's.
    Otherwise the next shorter j is tried, after Martello and Toth. A set stays dominating while
    its lengths have pieces left, since pieces only become fewer, so it is fixed that many times at once.
    """
    left = plan.left
    for j in range(len(left) - 1, 0, -1):
        while left[j]:
            room = plan.capacity - j
            left[j] -= 1  # the piece itself is not its own partner
            k = _largest(left, room)
            two, three = _smallest(left, 2), _smallest(left, 3)
            rest = 0
            if k and k < room:
                left[k] -= 1
                rest = _largest(left, room - k)
                left[k] += 1
            short = _largest(left, room // 2)
            left[j] += 1
            if not k:
                lengths = (j,)
            elif k == room or len(two) < 2 or sum(two) > room:
                lengths = (j, k)
            elif rest and rest >= short and (len(three) < 3 or sum(three) > room):
                lengths = (j, k, rest)
            else:
                break
            plan.fix(lengths, min(left[x] // n for x, n in Counter(lengths).items()))


def best_fit(plan: Plan) -> None:
    """Best fit, longest first: every piece into the open sequence with the least sufficient room."""
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: runs of sequences (first, count)
    for size in range(len(plan.left) - 1, 0, -1):
        for room in range(size, plan.capacity):
            while plan.left[size] and open_[room]:
                first, count = open_[room].pop()
                each = min(room // size, plan.left[size])
                many = min(count, plan.left[size] // each)
                for k in range(each):
                    plan.place(size, many, first, plan.capacity - room + k * size)
                open_[room - each * size].append((first, many))
                if count > many:
                    open_[room].append((first + many, count - many))
        while plan.left[size]:
            each = min(plan.capacity // size, plan.left[size])
            many = plan.left[size] // each
            open_[plan.capacity - each * size].append((plan.bins, many))
            plan.fix((size,) * each, many)


def plan_packing(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Where pieces go, from the number of pieces of each length (1 to ``capacity``)."""
    left = [0] * (capacity + 1)
    for length, count in counts.items():
        left[length] = count
    plan = Plan(capacity, left)
    reduce_dominated(plan)
    best_fit(plan)
    return plan


# --- the plan applied -----------------------------------------------------------------------------


def _numbered(pieces: DataFrame, total: int) -> DataFrame:
    """Pieces of each length numbered from 0: inside hash buckets, then shifted by the buckets before.

    A length that most documents share is so numbered by many tasks. Only rows that agree in all
    columns are tied, and these may change places.
    """
    buckets = max(1, -(-total // ITEMS_A_BUCKET))
    key = F.coalesce(F.col("doc_id"), F.col("ids_crc32"))
    spread = pieces.withColumn("bucket", F.pmod(F.xxhash64(key, "piece"), F.lit(buckets)))
    sizes = spread.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")
    shifts = sizes.select("length", "bucket", before.alias("shift"))
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    inside = spread.withColumn("item", F.row_number().over(order) - 1)
    return inside.join(shifts, ["length", "bucket"]).select(
        *pieces.columns, (F.col("item") + F.col("shift")).alias("item")
    )


def pack_documents(
    docs: DataFrame,
    path: str = "",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` of every piece.

    Texts are tokenised once and only figures are stored. The driver sees one count for each length, at
    most ``capacity`` of them, and sends back runs of pieces, whose number depends on the capacity
    alone. A NULL or empty text is one piece with ``end_id``. A NULL id is kept, repeated rows are
    packed each for itself, an empty table gives no row; other columns are not read.
    """
    spark = docs.sparkSession
    pieces = stored(cut_documents(docs, path, capacity, end_id, id_col, text_col), "pieces", compact=True)
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_packing(counts, capacity)
    runs = spark.createDataFrame(
        plan.rows or [(0, 0, 0, 0, 0)],
        "run_length long, first_item long, n_items long, first_bin long, offset long",
    )
    numbered = _numbered(pieces, sum(counts.values()))
    inside = (F.col("item") >= F.col("first_item")) & (F.col("item") < F.col("first_item") + F.col("n_items"))
    met = numbered.join(F.broadcast(runs), (F.col("length") == F.col("run_length")) & inside)
    return met.select(
        *pieces.columns,
        (F.col("first_bin") + F.col("item") - F.col("first_item")).alias("sequence_id"),
        "offset",
    )
