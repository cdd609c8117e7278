"""Texts put into containers of fixed capacity, in tokens of a public tokenizer.

The plan is made from the histogram of lengths, not from documents: best fit over counts, longest first. It is a
list of bounded size (lengths up to the capacity), and each document takes its planned slot by its rank within its length.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.runtime import checkpoint

CAPACITY = 2048
#: The tokenizer of the byte-level vocabulary of 50,256 ranks, and how it splits texts.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the vocabulary's own splitting pattern.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ranks of one length are counted in so many buckets for each million documents.
BUCKETS_PER_MILLION = 16
MIN_BUCKETS = 16


def tokenizer(vocabulary: str = VOCABULARY):
    import tiktoken

    with open(vocabulary, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("public", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_lengths(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc, n_tokens): whole texts, special strings counted as ordinary text. Null texts give no row, empty ones 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary).encode_ordinary
        for batch in batches:
            counts = [len(encode(text)) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(counts, pa.int64())], names=["doc", "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc {kind}, n_tokens long")


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best fit over counts. Slots (length, first rank, per container, first container, containers), and how many containers.

    Ranks first..first + per * containers - 1 of the length lie ``per`` to a container in consecutive containers.
    """
    slots: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # free room: ranges (first container, containers)
    free: list[int] = []
    total = 0
    for length in sorted((n for n in counts if n > 0), reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(free, length)
            if at < len(free):
                space = free[at]
                first, many = room[space].pop()
                if not room[space]:
                    del room[space]
                    free.pop(at)
            else:
                space, first = capacity, total
                many = -(-left // (capacity // length))
                total += many
            per = min(space // length, left)
            used = min(many, left // per)
            slots.append((length, rank, per, first, used))
            rank, left = rank + per * used, left - per * used
            for kept, start, n in ((space - per * length, first, used), (space, first + used, many - used)):
                if n and kept:
                    if kept not in room:
                        room[kept] = []
                        insort(free, kept)
                    room[kept].append((start, n))
    return slots, total


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """The assignment: doc, n_tokens, n_pieces, piece, start_token, piece_tokens, container_id.

    A text within the capacity is one piece; a longer one is split into full containers and a rest that is packed like
    any other. An empty text has one piece of no tokens and no container; a null text gives no row. Equal lengths are
    told apart by document id, repeated ids by their order. ``df`` may be empty and hold other columns.
    """
    docs = checkpoint(token_lengths(df, id_col, text_col, vocabulary))
    buckets = max(MIN_BUCKETS, BUCKETS_PER_MILLION * (docs.count() // 1_000_000 + 1))
    items = docs.withColumn("rest", F.when(F.col("n_tokens") <= capacity, F.col("n_tokens")).otherwise(F.col("n_tokens") % capacity))
    histogram = items.where("rest > 0").groupBy("rest").count().collect()  # at most ``capacity`` rows
    slots, total = plan({r["rest"]: r["count"] for r in histogram}, capacity)

    # rank within length: buckets of a length are ranked apart and set off by the counts of those before
    items = items.withColumn("bucket", F.pmod(F.xxhash64("doc"), F.lit(buckets)))
    own = Window.partitionBy("rest", "bucket").orderBy("doc", "n_tokens")
    sizes = items.groupBy("rest", "bucket").count()
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("count").over(Window.partitionBy("rest").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    ranked = items.withColumn("local", F.row_number().over(own) - 1).join(offsets, ["rest", "bucket"]).withColumn("rank", F.col("local") + F.col("offset"))

    # whole containers of the long texts, numbered after the planned ones
    longest = items.where(F.col("n_tokens") > capacity).withColumn("full", F.floor(F.col("n_tokens") / capacity))
    per_bucket = longest.groupBy("bucket").agg(F.sum("full").alias("sum"))
    before = per_bucket.withColumn("base", F.coalesce(F.sum("sum").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("sum")
    running = Window.partitionBy("bucket").orderBy("doc", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    full = (
        longest.withColumn("first", F.coalesce(F.sum("full").over(running), F.lit(0)))
        .join(before, "bucket")
        .select("doc", "n_tokens", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("piece", "_i"), (F.col("first") + F.col("base")).alias("first"))
        .select("doc", "n_tokens", F.col("piece").cast("long").alias("piece"), F.lit(capacity).cast("long").alias("piece_tokens"), (F.lit(total) + F.col("first") + F.col("piece")).cast("long").alias("container_id"))
    )

    lengths = np.array([s[0] for s in slots], dtype=np.int64)
    table = np.array(slots, dtype=np.int64).reshape(len(slots), 5)
    table = table[np.lexsort((table[:, 1], lengths))] if len(slots) else table

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rest", "rank"))
            container = np.full(len(rest), -1, dtype=np.int64)
            held = np.flatnonzero(rest > 0)
            if len(held):
                base = np.int64(1) << 40
                at = np.searchsorted(table[:, 0] * base + table[:, 1], rest[held] * base + rank[held], side="right") - 1
                container[held] = table[at, 3] + (rank[held] - table[at, 1]) // table[at, 2]
            ids = pa.array(container, pa.int64(), mask=container < 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("n_tokens"), batch.column("rest"), ids], names=["doc", "n_tokens", "piece_tokens", "container_id"])

    kind = df.schema[id_col].dataType.simpleString()
    placed = ranked.select("doc", "n_tokens", F.col("rest").cast("long").alias("rest"), F.col("rank").cast("long").alias("rank")).mapInArrow(place, f"doc {kind}, n_tokens long, piece_tokens long, container_id long")
    rests = placed.where((F.col("piece_tokens") > 0) | (F.col("n_tokens") == 0)).select("doc", "n_tokens", F.when(F.col("n_tokens") > capacity, F.floor(F.col("n_tokens") / capacity)).otherwise(0).cast("long").alias("piece"), "piece_tokens", "container_id")
    pieces = rests.unionByName(full)
    return pieces.select(
        F.col("doc").alias(id_col), "n_tokens", F.greatest(F.ceil(F.col("n_tokens") / capacity), F.lit(1)).cast("long").alias("n_pieces"), "piece", (F.col("piece") * capacity).alias("start_token"), "piece_tokens", "container_id"
    )
