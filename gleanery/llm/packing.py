"""Filling containers of fixed capacity: deficit round-robin over source queues, deficits carried from window to window."""

from __future__ import annotations

import base64
import os
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.session import keep, spread

#: Where the public tokenizers' files are, and which is used unless told otherwise.
TOKENIZERS, TOKENIZER = os.environ.get("TOKENIZERS_PATH", "/opt/tokenizers"), "byte_bpe_50k.tiktoken"
#: Tokens and documents that one task packs, at most about; of a document only its id, source and size are held.
TOKENS_PER_TASK, DOCUMENTS_PER_TASK = 10_000_000, 25_000
#: Tasks whose totals are summed up in one row, on the way to the totals of all tasks before each.
BLOCK = 1_024

_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def count_tokens(text: str = "text", folder: str = TOKENIZERS, file: str = TOKENIZER) -> F.Column:
    """Tokens of a text in a public byte-level vocabulary; null stays null, '' has none."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(os.path.join(folder, file), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("public", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        for s in batches:
            yield pd.Series([None if t is None else len(encoding.encode_ordinary(t)) for t in s], dtype="Int32")

    return count(text)


def fill(items: list[tuple[int, str, int]], capacity: int, shares: dict[str, float], deficit: dict[str, float]) -> list[tuple[int, int, int, int]]:
    """Packs (id, source, size) into windows: a list of (id, piece, window, size).

    An item longer than the capacity gives full windows of its own, and its rest is an item like any other. Every window
    credits each source with its share of the capacity. The source with the highest credit places the longest of its items that
    still fits and pays for it, until nothing fits; what a source has left or owes is carried to the next window. (Drawing items of any length
    while there is room was tried: it filled less and strayed farther from the mixture.)
    """
    out: list[tuple[int, int, int, int]] = []
    window = 0
    queues: dict[str, list[tuple[int, int, int]]] = {}
    for id_, source, size in items:
        piece = 0
        while size > capacity:
            out.append((id_, piece, window, capacity))
            deficit[source] = deficit.get(source, 0.0) - capacity
            for s, share in shares.items():
                deficit[s] = deficit.get(s, 0.0) + share * capacity
            size -= capacity
            piece, window = piece + 1, window + 1
        if size > 0 or piece == 0:
            queues.setdefault(source, []).append((size, id_, piece))
    for q in queues.values():
        q.sort()
    while queues:
        room = capacity
        for s in shares:
            deficit[s] = deficit.get(s, 0.0) + shares[s] * capacity
        active = set(queues)
        while active and room >= 0:
            source = max(active, key=lambda s: (deficit.get(s, 0.0), s))
            queue = queues[source]
            at = bisect_right(queue, (room, 1 << 62, 1 << 62)) - 1
            if at < 0:
                active.discard(source)
                continue
            size, id_, piece = queue.pop(at)
            out.append((id_, piece, window, size))
            room -= size
            deficit[source] = deficit.get(source, 0.0) - size
            if not queue:
                del queues[source]
                active.discard(source)
        window += 1
    return out


def pack(documents: DataFrame, containers: DataFrame, targets: DataFrame | None = None, tokens_per_task: int = TOKENS_PER_TASK) -> DataFrame:
    """``container``, ``bin``, ``doc_id``, ``piece``, ``tokens``: where each document, or each piece of one longer than the capacity, goes.

    Every kind of container packs all documents. ``targets`` (``source``, ``share``) are the wanted token proportions; without them
    the proportions of the whole corpus. Documents meet in tasks by a hash of their id, so that no source fills a task; only
    (id, source, size) reaches it. A task starts with the deficits that the tasks before it leave, which follow from the
    totals per task and source alone. Null texts are left out; an empty text takes a place of size 0; a null source is a source of its own.
    """
    source = F.coalesce(F.lower(F.regexp_replace("source", r"(?U)^\s+|\s+$", "")), F.lit(""))
    sized = keep(
        spread(documents.select("doc_id", "source", "text")).where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), count_tokens().alias("tokens"))
    )
    size = sized.agg(F.sum("tokens").alias("n"), F.count("*").alias("k")).first()
    total = size.n or 0
    tasks = max(1, -(-total // tokens_per_task), -(-size.k // DOCUMENTS_PER_TASK))
    placed = sized.withColumn("task", F.pmod(F.xxhash64("doc_id"), F.lit(tasks)).cast("int"))
    by_task = keep(placed.groupBy("task", "source").agg(F.sum("tokens").alias("n")))
    if targets is None:
        wanted = by_task.groupBy("source").agg((F.sum("n") / max(1, total)).alias("share"))
    else:
        wanted = targets.select(F.lower(F.trim("source")).alias("source"), F.col("share").cast("double").alias("share"))
    start = starting_deficits(by_task, wanted)
    kinds = containers.dropna(subset=["container", "capacity_tokens"]).distinct()
    rows = [(r.container, int(r.capacity_tokens)) for r in kinds.collect() if r.capacity_tokens > 0]  # a fixed dimension
    if not rows:
        return documents.sparkSession.createDataFrame([], "container string, bin long, doc_id long, piece int, tokens int")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("container"), F.lit(k).alias("capacity")) for c, k in rows])).alias("c")
    work = placed.select("task", "doc_id", "source", "tokens", each).select("task", "doc_id", "source", "tokens", "c.container", "c.capacity")
    starts = start.select("task", "source", "share", "owed", each).select("task", "source", "share", "owed", "c.container")

    def run(pdf: pd.DataFrame, begin: pd.DataFrame) -> pd.DataFrame:
        columns = ["container", "bin", "doc_id", "piece", "tokens"]
        if pdf.empty:
            return pd.DataFrame(columns=columns)
        task, container, capacity = int(pdf["task"].iloc[0]), pdf["container"].iloc[0], int(pdf["capacity"].iloc[0])
        items = sorted(zip(pdf["doc_id"].tolist(), pdf["source"].tolist(), pdf["tokens"].tolist()))
        shares, owed = (dict(zip(begin["source"].tolist(), begin[c].tolist())) for c in ("share", "owed"))
        out = pd.DataFrame(fill(items, capacity, shares, owed), columns=["doc_id", "piece", "window", "tokens"])
        out["container"] = container
        out["bin"] = out["window"].astype("int64") * tasks + task
        return out[columns]

    schema = "container string, bin long, doc_id long, piece int, tokens int"
    return work.groupBy("task", "container").cogroup(starts.groupBy("task", "container")).applyInPandas(run, schema)


def starting_deficits(by_task: DataFrame, wanted: DataFrame) -> DataFrame:
    """``task``, ``source``, ``share``, ``owed``: what each source of a task is owed after all tasks before it.

    ``by_task`` has the tokens ``n`` per ``task`` and ``source``, ``wanted`` the ``share`` of each source. It is the share of all tokens before,
    less those of the source: running sums over blocks of tasks and within each block, in Spark, however many tasks there are.
    """

    def before(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        """Sums of ``n`` over all rows of lower tasks, per ``keys``."""
        blocks = df.groupBy(*keys, "block").agg(F.sum("n").alias("n"))
        earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        within = Window.partitionBy(*keys, "block").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
        blocks = blocks.select(*keys, "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_b"))
        rows = df.select(*keys, "block", "task", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("_w"))
        return rows.join(blocks, [*keys, "block"]).select(*keys, "task", (F.col("_b") + F.col("_w")).alias(name))

    placed = by_task.withColumn("block", F.floor(F.col("task") / BLOCK))
    totals = placed.groupBy("task", "block").agg(F.sum("n").alias("n")).withColumn("_all", F.lit(1))
    joined = before(placed, ["source"], "own").join(before(totals, ["_all"], "total").drop("_all"), "task").join(wanted, "source", "left")
    share = F.coalesce("share", F.lit(0.0))
    return joined.select("task", "source", share.alias("share"), (share * F.col("total") - F.col("own")).alias("owed"))


def fill_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """How full the containers are: ``container``, ``bins``, ``tokens``, ``fill``."""
    sums = packed.groupBy("container").agg(F.countDistinct("bin").alias("bins"), F.sum("tokens").alias("tokens"))
    capacity = containers.select("container", "capacity_tokens")
    return sums.join(F.broadcast(capacity), "container").select(
        "container", "bins", "tokens", F.round(F.col("tokens") / (F.col("bins") * F.col("capacity_tokens")), 6).alias("fill")
    )


def mixture_report(packed: DataFrame, documents: DataFrame) -> DataFrame:
    """How far the sources of the windows are from their shares of all tokens: ``container``, ``stretch``, ``deviation``.

    The deviation is the mean, over windows (``stretch`` 1) and over runs of 10 and 100 windows, of the total variation distance between the
    tokens of the run by source and the shares: 0 is the target mixture, 1 has nothing of it. A single window holds few items,
    so only longer stretches can come near.
    """
    name = F.coalesce(F.lower(F.regexp_replace("source", r"(?U)^\s+|\s+$", "")), F.lit(""))
    placed = packed.join(documents.select(F.col("doc_id").cast("long").alias("doc_id"), name.alias("source")).distinct(), "doc_id")
    shares = placed.groupBy("container", "source").agg(F.sum("tokens").alias("n"))
    totals = shares.groupBy("container").agg(F.sum("n").alias("t"))
    shares = shares.join(totals, "container").select("container", "source", (F.col("n") / F.col("t")).alias("share"))
    runs = placed.select("container", "source", "tokens", "bin", F.explode(F.array(*map(F.lit, (1, 10, 100)))).alias("stretch"))
    held = runs.groupBy("container", "stretch", F.floor(F.col("bin") / F.col("stretch")).alias("run"), "source").agg(F.sum("tokens").alias("n"))
    size = held.groupBy("container", "stretch", "run").agg(F.sum("n").alias("t")).where("t > 0")
    # half the sum of |p - q| is 1 less the sum of min(p, q): sources that a run lacks add nothing
    both = held.join(size, ["container", "stretch", "run"]).join(shares, ["container", "source"])
    common = both.groupBy("container", "stretch", "run").agg(F.sum(F.least(F.col("n") / F.col("t"), F.col("share"))).alias("common"))
    return common.groupBy("container", "stretch").agg(F.round(1 - F.avg("common"), 6).alias("deviation"))


def integrity_report(packed: DataFrame, documents: DataFrame, containers: DataFrame) -> DataFrame:
    """What no packing may break, per ``container``: ``documents`` placed, ``overfull`` bins, documents ``split_short`` though they fit, and
    documents whose pieces are ``unequal`` to their tokens."""
    capacity = F.broadcast(containers.dropna(subset=["container", "capacity_tokens"]).select("container", "capacity_tokens").distinct())  # a fixed dimension
    stated = documents.where(F.col("text").isNotNull())
    sized = spread(stated.select("doc_id", "text")).select(F.col("doc_id").cast("long").alias("doc_id"), count_tokens().alias("size"))
    bins = packed.groupBy("container", "bin").agg(F.sum("tokens").alias("t")).join(capacity, "container")
    overfull = bins.groupBy("container").agg(F.count_if(F.col("t") > F.col("capacity_tokens")).alias("overfull"))
    pieces = packed.groupBy("container", "doc_id").agg(F.count("*").alias("k"), F.sum("tokens").alias("t")).join(sized, "doc_id", "full").join(capacity, "container", "left")
    of_docs = pieces.groupBy("container").agg(
        F.count("t").alias("documents"),
        F.count_if((F.col("k") > 1) & (F.col("size") <= F.col("capacity_tokens"))).alias("split_short"),
        F.count_if(~F.col("t").eqNullSafe(F.col("size"))).alias("unequal"),
    )
    return of_docs.join(overfull, "container", "left").select("container", "documents", "overfull", "split_short", "unequal")
