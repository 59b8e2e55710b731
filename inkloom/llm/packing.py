"""Problem 8: fill containers of fixed capacity with items of varying size.

Bounded-space online packing. Every partition keeps at most ``WINDOWS`` open
containers per kind, ordered by the room left. An item goes into the container
it fits best; if none has room, the fullest container is emitted and a new one
opened. What is still open when a partition ends is dissolved, gathered in
bounded groups and packed again, largest item first. Only an item longer than
the capacity is split: into whole containers and one remainder.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm.tokens import TOKENIZERS, counts, vocabulary
from inkloom.session import cut, spread

#: Open containers per partition and kind.
WINDOWS = 256
#: Open containers that meet in one task when leftovers are packed.
GROUP = 8192

PLACED = "spec_id long, capacity long, container string, item long, part int, start long, size long, closed boolean"


class Packer:
    """Open containers of one kind; ``emit`` gets (container, contents)."""

    def __init__(self, capacity: int, prefix: str, windows: int = WINDOWS):
        self.capacity, self.prefix, self.windows = capacity, prefix, windows
        self.room: list[tuple[int, int]] = []  # (room left, container), ascending
        self.held: dict[int, list[tuple[int, int, int, int]]] = {}
        self.next = 0
        self.out: list[tuple[str, int, int, int, int, bool]] = []

    def emit(self, container: int, closed: bool) -> None:
        name = f"{self.prefix}-{container}"
        self.out += [(name, *piece, closed) for piece in self.held.pop(container)]

    def add(self, item: int, size: int) -> None:
        """Place an item; null, empty and negative sizes need no room."""
        if size <= 0:
            return
        part = start = 0
        while size > self.capacity:
            self.held[self.next] = [(item, part, start, self.capacity)]
            self.emit(self.next, True)
            self.next += 1
            part, start, size = part + 1, start + self.capacity, size - self.capacity
        self.place(item, part, start, size)

    def place(self, item: int, part: int, start: int, size: int) -> None:
        k = bisect_left(self.room, (size, -1))
        if k < len(self.room):
            room, container = self.room.pop(k)
        else:
            if len(self.room) >= self.windows:
                self.emit(self.room.pop(0)[1], True)
            room, container = self.capacity, self.next
            self.held[container] = []
            self.next += 1
        self.held[container].append((item, part, start, size))
        if room == size:
            self.emit(container, True)
        else:
            insort(self.room, (room - size, container))

    def finish(self, closed: bool) -> None:
        for _, container in self.room:
            self.emit(container, closed)
        self.room = []


def _frame(spec: int, packer: Packer) -> pd.DataFrame:
    rows, packer.out = packer.out, []
    frame = pd.DataFrame(rows, columns=["container", "item", "part", "start", "size", "closed"])
    frame["item"] = frame["item"].astype("Int64")
    frame.insert(0, "capacity", packer.capacity)
    frame.insert(0, "spec_id", spec)
    return frame


def pack(
    sizes: DataFrame, specs: list[tuple[int, str, int]], windows: int = WINDOWS, group: int = GROUP
) -> DataFrame:
    """Contents of the containers: ``spec_id, container, item, part, start, size``.

    ``sizes`` has ``item`` (which may be null) and one column of sizes per measure named in
    ``specs`` (kind, measure, capacity). ``start`` is the offset of a split
    item's piece. Items with null, zero or negative sizes get no row; repeated
    items are packed each time they occur; other columns are ignored.
    """
    for spec, _, capacity in specs:
        if capacity is None or capacity <= 0:
            raise ValueError(f"kind {spec} has no positive capacity")

    def online(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = TaskContext.get().partitionId()
        packers = [(spec, measure, Packer(capacity, f"{at}", windows)) for spec, measure, capacity in specs]
        for batch in batches:
            for spec, measure, packer in packers:
                items = batch["item"].astype("Int64")
                for item, size in zip(items, batch[measure].fillna(0).astype("int64").tolist()):
                    packer.add(item, size)
                yield _frame(spec, packer)
        for spec, _, packer in packers:
            packer.finish(closed=False)
            yield _frame(spec, packer)

    needed = ["item", *dict.fromkeys(measure for _, measure, _ in specs)]
    placed = cut(sizes.select(*needed).mapInPandas(online, PLACED))
    tasks = placed.rdd.getNumPartitions()

    def leftovers(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "item", "part"], ascending=[False, True, True])
        packer = Packer(int(key[2]), f"m{key[1]}", windows=len(rows) + 1)
        for item, *piece in zip(rows["item"].astype("Int64"), rows["part"], rows["start"], rows["size"]):
            packer.place(item, *map(int, piece))
        packer.finish(closed=True)
        return _frame(int(key[0]), packer)

    groups = max(1, math.ceil(tasks * windows / group))
    # Groups are of whole partitions' windows, so that each has at most `group` containers or one partition's.
    bucket = (F.split("container", "-")[0].cast("int") % groups).alias("bucket")
    merged = (
        placed.filter("not closed")
        .select("*", bucket)
        .groupBy("spec_id", "bucket", "capacity")
        .applyInPandas(leftovers, PLACED)
    )
    return placed.filter("closed").unionByName(merged).drop("closed", "capacity")


def token_sizes(documents: DataFrame, tokenizers: list[str], folder: str = TOKENIZERS) -> DataFrame:
    """``item`` and the number of tokens of ``text`` by each tokenizer, in columns named after them."""
    spark = documents.sparkSession
    tools = [(name, *vocabulary(spark, name, folder)) for name in tokenizers]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if isinstance(t, str) else None for t in batch["text"].tolist()]
            yield pd.DataFrame({"item": batch["item"]} | {name: counts(*tool, texts) for name, *tool in tools})

    schema = ", ".join(["item long", *(f"`{name}` long" for name in tokenizers)])
    return documents.select(F.col("doc_id").alias("item"), "text").mapInPandas(measure, schema)


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``spec_id, container, doc_id, part, start, size``: every document in containers of each kind."""
    specs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pack_specs.parquet").orderBy("spec_id").collect()]
    documents = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    sizes = token_sizes(documents, list(dict.fromkeys(t for _, t, _ in specs)))
    return pack(sizes, specs).withColumnRenamed("item", "doc_id")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``spec_id, capacity, containers, tokens, fill``: how full the containers of each kind are."""
    specs = spark.read.parquet(f"{sf_dir}/pack_specs.parquet").select("spec_id", "capacity").distinct()
    packed = p8_pack(spark, sf_dir).groupBy("spec_id", "container").agg(F.sum("size").alias("size"))
    filled = packed.groupBy("spec_id").agg(F.count("*").alias("containers"), F.sum("size").alias("tokens"))
    return filled.join(specs, "spec_id").select(
        "spec_id", "capacity", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("fill")
    )
