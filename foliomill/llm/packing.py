"""Best-fit packing of token pieces after Martello-Toth dominance reduction.

Lengths are whole numbers up to the capacity, so an instance of any size is a histogram of at most
``capacity`` counts.  The driver reduces and packs that histogram; the outcome is a short list of
bin patterns with multiplicities.  Each piece then finds its place by its rank among the pieces of
its length, which is counted per partition and length and never gathers a length in one task.

Edge cases: a null text is empty and becomes the end id alone; a document of any length is cut
whole; repeated rows are packed as often as they come; equal lengths are interchangeable; an empty
table gives an empty result; other columns are carried along by ``tokenize`` unless their names
clash with those it adds, which it replaces.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .scratch import batches_of, cut
from .words import give_back

CAPACITY = 2048
END_ID = 0
#: Text that both tokenizer libraries split alike: code points below U+0250 and common punctuation.
PLAIN = r"[\x00-ɏ‐-‧]*"
SPECIAL = "<|endoftext|>"


class Encoder:
    """Ids as the ``tokenizers`` file gives them.

    Plain text goes through the same vocabulary's rank file, which is several times as fast; text
    with the special token's string or other characters, or with a run of white space longer than
    that library takes, goes through ``tokenizers`` itself.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None):
        import re

        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(tokenizer_path)
        self.plain = re.compile(PLAIN)
        self.fast = None
        if ranks_path:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding(
                "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
            )

    def ids(self, text: str) -> np.ndarray:
        if self.fast and SPECIAL not in text and (text.isascii() or self.plain.fullmatch(text)):
            try:
                return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), "<u4")
            except ValueError:  # the pattern goes back over a run of white space once too often
                pass
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")


_encoders: dict[tuple, Encoder] = {}


#: Ids held before a batch of pieces leaves Python.
FLUSH_IDS = 1 << 18


def tokenize(
    docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, capacity: int = CAPACITY,
    end_id: int = END_ID, text_col: str = "text", keep_ids: bool = True,
) -> DataFrame:
    """Pieces of every row: its columns but the text, and ``piece, start, length, ids``, or
    ``ids_crc32`` (of the bytes of ``ids``) instead of ``ids`` unless ``keep_ids``.

    ``ids`` are little-endian unsigned 32-bit numbers.  Only documents longer than ``capacity`` are
    cut, into pieces of that length; the first takes what is left over.
    """
    last = ("ids", T.BinaryType()) if keep_ids else ("ids_crc32", T.LongType())
    made = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), last]
    carried = [f for f in docs.schema if f.name != text_col and f.name not in dict(made)]
    schema = T.StructType([*carried, *(T.StructField(n, t) for n, t in made)])
    digest = bytes if keep_ids else zlib.crc32

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (tokenizer_path, ranks_path)
        encoder = _encoders.get(key) or _encoders.setdefault(key, Encoder(*key))
        for batch in batches:
            rows, out, held = [], ([], [], [], []), 0
            texts = batch.column(batch.schema.get_field_index(text_col))

            def flush():
                keep = batch.select([f.name for f in carried]).take(pa.array(rows, pa.int32()))
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary() if keep_ids else pa.int64()]
                return pa.RecordBatch.from_arrays([*keep.columns, *map(pa.array, out, kinds)], names=[f.name for f in schema])

            for at in range(batch.num_rows):
                text = texts[at].as_py() or ""
                ids = np.append(encoder.ids(text), np.uint32(end_id)).astype("<u4")
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    rows.append(at)
                    for column, value in zip(out, (k, a, b - a, digest(ids[a:b].tobytes()))):
                        column.append(value)
                held += len(ids)
                if held > FLUSH_IDS:
                    yield flush()
                    rows, out, held = [], ([], [], [], []), 0
            if rows:
                yield flush()
        give_back()

    return docs.select(text_col, *[f.name for f in carried]).mapInArrow(cut_up, schema)


def _largest_upto(counts: np.ndarray) -> np.ndarray:
    """For each x the largest size up to x that is there, or 0."""
    sizes = np.where(counts > 0, np.arange(len(counts)), 0)
    return np.maximum.accumulate(sizes)


def reduce_instance(counts: np.ndarray, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Takes bins that dominate all alternatives out of ``counts``; returns (how many, sizes).

    Martello and Toth's reduction, for all items of a size at once: a bin is fixed for an item j if
    nothing fits beside it; if its largest partner fills it exactly or at most one other item fits
    (then the largest partner); and if at most two fit, when the largest single partner is at least
    as large as the best pair, or when that pair holds the largest partner and no two items larger
    than its lesser member fit beside j.
    """
    fixed = []

    def fix(times: int, *sizes: int) -> None:
        for s in sizes:
            counts[s] -= times
        fixed.append((int(times), sizes))

    changed = True
    while changed:
        changed = False
        for s in range(capacity, 0, -1):
            while counts[s] > 0:
                n, room = int(counts[s]), capacity - s
                counts[s] -= 1  # the others, without one item j of this size
                least = [int(x) for x in np.repeat(np.flatnonzero(counts)[:3], np.minimum(counts[np.flatnonzero(counts)[:3]], 3))[:3]]
                partner = int(_largest_upto(counts[: room + 1])[-1]) if room else 0
                counts[s] += 1
                pairs = lambda b: n // 2 if b == s else min(n, int(counts[b]))
                if not partner:
                    fix(n, s)
                elif partner == room or sum(least[:2]) > room or len(least) < 2:
                    fix(pairs(partner), s, partner)
                elif sum(least) > room or len(least) < 3:
                    counts[s] -= 1
                    upto = _largest_upto(counts[: room + 1])
                    best = (0, 0, 0)
                    for a in np.flatnonzero(counts[: room]):
                        counts[a] -= 1
                        b = int(upto[room - a]) if counts[a] or upto[room - a] != a else int(_largest_upto(counts[: room - a + 1])[-1])
                        counts[a] += 1
                        if b:
                            best = max(best, (int(a) + b, max(int(a), b), min(int(a), b)))
                    total, a, b = best
                    above = np.flatnonzero(counts[b:]) + b
                    larger = [int(x) for x in np.repeat(above[:3], np.minimum(counts[above[:3]], 3))[1:3]]
                    counts[s] += 1
                    if partner >= total:
                        fix(pairs(partner), s, partner)
                    elif partner == a and (len(larger) < 2 or sum(larger) > room):
                        # All that was asked is which sizes are there at least three times besides j.
                        fix(max(1, min((int(counts[x]) - 4) // k for x, k in Counter((s, a, b)).items())), s, a, b)
                    else:
                        break
                else:
                    break
                changed = True
    return fixed


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing over the histogram; returns (how many bins, sizes in each)."""
    by_room: list[list[tuple[int, tuple[int, ...]]]] = [[] for _ in range(capacity + 1)]
    for s in range(capacity, 0, -1):
        n = int(counts[s])
        while n:
            room = next((r for r in range(s, capacity) if by_room[r]), capacity)
            bins, holds = by_room[room].pop() if room < capacity else (n, ())
            each = min(room // s, n)
            use = min(bins, n // each)
            by_room[room - each * s].append((use, holds + (s,) * each))
            if bins > use and room < capacity:
                by_room[room].append((bins - use, holds))
            n -= use * each
    return [group for groups in by_room for group in groups]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Slots ``length, from_rank, to_rank, each, sequence, offset``: the item of rank r of a length
    goes to sequence ``sequence + (r - from_rank) // each``, there at
    ``offset + (r - from_rank) % each * length``."""
    counts = np.zeros(capacity + 1, np.int64)
    for size, n in histogram.items():
        counts[size] += n
    bins: Counter[tuple[int, ...]] = Counter()  # of one pattern together, so that slots are few
    for times, sizes in reduce_instance(counts, capacity) + best_fit(counts, capacity):
        bins[tuple(sorted(sizes, reverse=True))] += times
    slots, used, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for sizes, times in bins.items():
        offset = 0
        for s in dict.fromkeys(sizes):
            each = sizes.count(s)
            first = int(used[s])
            used[s] += times * each
            slots.append((s, first, int(used[s]), each, sequence, offset))
            offset += each * s
        sequence += times
    return slots


#: Slots up to this number (5 MB) are broadcast.
FEW_SLOTS = 100_000
#: Ranges into which the ranks of a length are divided beyond that.
RANGES = 1024


def spread(slots: list[tuple[int, ...]], histogram: dict[int, int]) -> list[tuple[int, ...]]:
    """``slots``, each once for every range of ranks of its length that it meets, with that range."""
    out = []
    for slot in slots:
        width = -(-histogram[slot[0]] // RANGES)
        out += [(*slot, at) for at in range(slot[1] // width, (slot[2] - 1) // width + 1)]
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, length_col: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; sequences hold at most ``capacity``.

    A piece meets the slots of its length whose range of ranks is its own: by broadcast while the
    slots are few, else by an equi-join whose keys hold a ``RANGES``-th of a length each.
    """
    spark = pieces.sparkSession
    kept = pieces.drop("sequence_id", "offset")
    schema = T.StructType([*kept.schema, T.StructField("__task", T.LongType()), T.StructField("__local", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            sizes = batch.column(batch.schema.get_field_index(length_col)).to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.argsort(sizes, kind="stable")
            groups, start, n = np.unique(sizes[order], return_index=True, return_counts=True)
            local = np.empty(len(sizes), np.int64)
            local[order] = np.arange(len(sizes)) - np.repeat(start, n) + np.repeat(seen[groups], n)
            seen[groups] += n
            columns = [*batch.columns, pa.array(np.full(len(sizes), task)), pa.array(local)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    with batches_of(spark):
        made = cut(kept, "pieces")  # so that what makes the pieces and what numbers them never run side by side
    table = cut(made.mapInArrow(number, schema), "numbered")
    counts = table.groupBy("__task", F.col(length_col).alias("__length")).agg(F.count(F.lit(1)).alias("__n"))
    counts = cut(counts, "lengths")
    histogram = {r["__length"]: r["n"] for r in counts.groupBy("__length").agg(F.sum("__n").alias("n")).collect()}
    before = Window.partitionBy("__length").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("__task").alias("__t"), "__length", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first")
    )
    slots = plan(histogram, capacity)
    few = len(slots) <= FEW_SLOTS
    ranges = 1 if few else RANGES
    rows = [(*x, 0) for x in slots] if few else spread(slots, histogram)
    where = spark.createDataFrame(
        rows or [(0, 0, 0, 1, 0, 0, 0)], "__size long, __from long, __to long, __each long, __sequence long, __offset long, __range long"
    )
    where = F.broadcast(where) if few else where.hint("merge")
    wide = spark.createDataFrame([(s, -(-n // ranges)) for s, n in histogram.items()] or [(0, 1)], "__of long, __width long")  # a row a length
    table = table.join(starts, (F.col("__task") == F.col("__t")) & (F.col(length_col) == F.col("__length")))
    table = table.withColumn("__rank", F.col("__first") + F.col("__local"))
    table = table.join(F.broadcast(wide), F.col(length_col) == F.col("__of"))
    table = table.withColumn("__at", F.lit(0).cast("long") if few else F.expr("__rank div __width"))
    table = table.join(
        where,
        (F.col(length_col) == F.col("__size")) & (F.col("__at") == F.col("__range")) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to")),
    )
    nth = F.col("__rank") - F.col("__from")
    return table.select(
        *kept.columns,
        (F.col("__sequence") + F.floor(nth / F.col("__each"))).cast("long").alias("sequence_id"),
        (F.col("__offset") + nth % F.col("__each") * F.col(length_col)).cast("long").alias("offset"),
    )
