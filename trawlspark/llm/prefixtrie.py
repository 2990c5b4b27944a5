"""Prefix trie of conversations: range-partitioned shards below a broadcast skeleton of splitter paths.

1. A turn becomes a token of 24 bytes: 128 bits of a SHA-256 over its role and text, and the number of
   UTF-8 bytes of its text. A conversation is its path, the tokens in order, so that every node of the
   trie is a prefix of paths and its members are neighbours in the order of paths.
2. Equal paths are pre-aggregated to runs: for each block of BLOCK consecutive ids the sorted members.
   So a conversation that a third of all repeat costs one row for BLOCK of them.
3. Splitters cut the order of paths into shards. A splitter is the shortest prefix that still parts its
   sample from the sample before it. Only proper prefixes of splitters can have members in several
   shards; they are the skeleton, a trie broadcast with at most TRIE_BYTES of splitters.
4. Each shard is sorted and read as a stream. Nodes outside the skeleton are finished there; of each
   skeleton node on its way a shard returns a partial aggregate of what lies directly below it.
5. Partial aggregates are reduced by node and summed up along the skeleton, whose size is bounded; the
   top nodes of the shards then get their parent by a broadcast join.

Digests of the members that end at a node are sequential by nature: the runs of a path, all in one
shard, are streamed through one hash. The tokens of one conversation are one row (24 bytes a turn).
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlspark.llm.stage import ship, written

TOKEN = 24
#: Bits of the block of ids whose members make up one run of a path.
BLOCK_BITS = 16
#: Runs of a shard, about, once there are more shards than shuffle partitions.
SHARD_RUNS = 200_000
MAX_SHARDS = 16_384
#: Sampled paths for each shard, and the bytes of all samples: deeper paths are cut before sampling.
SAMPLES = 4
TRIE_BYTES = 32 << 20
#: Rows of a result batch.
ROWS = 20_000

_NODE = (
    "sid int, top int, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, ends_sha256 string"
)
_NAMES = [part.split()[0] for part in _NODE.split(", ")]
RESULT = _NAMES[2:]
_NO_ENDS = hashlib.sha256(b"").hexdigest()


def token(role: Column, text: Column) -> Column:
    """A turn's token in hexadecimal digits; null role or text is empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.lower(F.concat(F.substring(digest, 1, 32), F.lpad(F.hex(F.octet_length(text)), 16, "0")))


def ordered(conversations: DataFrame, group: Column) -> DataFrame:
    """(group, conv_id, tokens): the turns of each conversation in order of turn, null first.

    Equal turns come in the order of their tokens. Rows with a null conv_id take no part. The result is
    partitioned by group, of which conv_id must be a refinement.
    """
    turns = conversations.where("conv_id is not null").select(
        group.alias("group"), F.col("conv_id").cast("long").alias("conv_id"), "turn", token(F.col("role"), F.col("text")).alias("token")
    )
    listed = turns.repartition("group").groupBy("group", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "token"))).alias("turns"))
    return listed.select("group", "conv_id", F.col("turns.token").alias("tokens"))


def path(tokens: Column) -> Column:
    return F.unhex(F.array_join(tokens, ""))


def regrafted(conversations: DataFrame) -> DataFrame:
    """(conv_id, path): conversation c after its first h turns, below the first h turns of c - c % 5;
    h is the crc32 of the decimal c, modulo 9."""
    c = F.col("conv_id")
    own = ordered(conversations, c - c % 5)
    first = own.where("conv_id = group").select("group", F.slice("tokens", 1, 8).alias("head"))
    h = (F.crc32(c.cast("string")) % 9).cast("int")
    head = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), h)
    rest = F.slice("tokens", h + 1, F.greatest(F.size("tokens") - h, F.lit(0)))
    return own.join(first, "group", "left").select("conv_id", path(F.concat(head, rest)).alias("path"))


def common_turns(a: bytes, b: bytes) -> int:
    """Number of tokens that two paths share at their start."""
    low, high = 0, min(len(a), len(b)) // TOKEN
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * TOKEN : middle * TOKEN] == b[low * TOKEN : middle * TOKEN]:
            low = middle
        else:
            high = middle - 1
    return low


def splitters(sample: list[bytes], shards: int) -> list[bytes]:
    """At most shards - 1 rising prefixes that cut the sampled paths into parts of about equal length."""
    paths = sorted(set(sample))
    weight, total, cuts = 0, sum(len(p) + TOKEN for p in paths), []
    for before, here in zip(paths, paths[1:], strict=False):
        weight += len(before) + TOKEN
        if weight * shards >= total * (len(cuts) + 1) and len(cuts) < shards - 1:
            cuts.append(here[: TOKEN * (common_turns(before, here) + 1)])
    return cuts


class Skeleton:
    """The proper prefixes of splitters; node 0 is the root, parents come before children."""

    def __init__(self, cuts: list[bytes]):
        self.cuts = cuts
        self.child: dict[tuple[int, bytes], int] = {}
        self.parent, self.depth, self.bytes = [-1], [0], [0]
        for cut in cuts:
            at = 0
            for i in range(0, len(cut) - TOKEN, TOKEN):
                key = (at, cut[i : i + TOKEN])
                if key not in self.child:
                    self.child[key] = len(self.parent)
                    self.parent.append(at)
                    self.depth.append(i // TOKEN + 1)
                    self.bytes.append(int.from_bytes(key[1][16:], "big"))
                at = self.child[key]

    def shard(self, path: bytes) -> int:
        return bisect_right(self.cuts, path)

    def deepest(self, path: bytes) -> int:
        """The last skeleton node on a path."""
        at = 0
        for i in range(0, len(path), TOKEN):
            below = self.child.get((at, path[i : i + TOKEN]))
            if below is None:
                break
            at = below
        return at

    def summed(self, partial: dict[int, list]) -> list[tuple]:
        """Rows of the skeleton's nodes from [n_convs, least, n_children, n_leaves, saved, ends] of each."""
        rows = []
        for at in reversed(range(len(self.parent))):
            n, least, children, leaves, saved, ends = partial[at]
            if not children:
                leaves += 1
            saved += (n - 1) * self.bytes[at]
            rows.append((at, least, self.depth[at], n, children, leaves, saved, ends or _NO_ENDS))
            if at:
                above = partial.setdefault(self.parent[at], [0, least, 0, 0, 0, None])
                least = least if above[1] is None else min(above[1], least)
                above[:5] = [above[0] + n, least, above[2] + 1, above[3] + leaves, above[4] + saved]
        least_of = {r[0]: r[1] for r in rows}
        return [
            (at, None, least, depth, least_of.get(self.parent[at]), n, children, leaves, saved, ends)
            for at, least, depth, n, children, leaves, saved, ends in rows
        ]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32()] * 2 + [pa.int64()] * 7 + [pa.string()]
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_NAMES)


class _Shard:
    """Nodes of one shard from its sorted runs."""

    def __init__(self, skeleton: Skeleton):
        self.skeleton = skeleton
        self.partial: dict[int, list] = {}  # of skeleton nodes
        self.open: list[list] = []  # of each local node on the path: [least, n, leaves, saved, bytes, ends, children's rows]
        self.out: list[tuple] = []
        self.last: bytes | None = None
        self.top = self.top_depth = 0
        self.hash = None

    def _close(self, depth: int) -> None:
        """Finish the local nodes below a depth; a node's row waits for its parent's smallest member."""
        while len(self.open) + self.top_depth > depth and self.open:
            least, n, leaves, saved, size, ends, rows = self.open.pop()
            leaves = leaves or 1
            saved += (n - 1) * size
            self.out += [(*r[:4], least, *r[5:]) for r in rows]
            at = self.top_depth + len(self.open) + 1
            row = (None, None, least, at, None, n, len(rows), leaves, saved, ends or _NO_ENDS)
            if self.open:
                above = self.open[-1]
                above[0] = least if above[0] is None else min(above[0], least)
                above[1] += n
                above[2] += leaves
                above[3] += saved
                above[6].append(row)
            else:
                self.out.append((None, self.top, *row[2:]))
                self._add(n, least, 1, leaves, saved)

    def _add(self, n: int, least: int, children: int, leaves: int, saved: int) -> None:
        part = self.partial.setdefault(self.top, [0, None, 0, 0, 0, None])
        part[1] = least if part[1] is None else min(part[1], least)
        part[0] += n
        part[2] += children
        part[3] += leaves
        part[4] += saved

    def _digest(self) -> None:
        if self.hash is not None:
            if self.open:
                self.open[-1][5] = self.hash.hexdigest()
            else:
                self.partial[self.top][5] = self.hash.hexdigest()
            self.hash = None

    def add(self, path: bytes, least: int, n: int, members: bytes) -> None:
        if path != self.last:
            self._digest()
            shared = common_turns(self.last, path) if self.last is not None else 0
            self._close(max(shared, self.top_depth))
            if shared <= self.top_depth:
                self.top = self.skeleton.deepest(path)
                self.top_depth = self.skeleton.depth[self.top]
            for i in range((self.top_depth + len(self.open)) * TOKEN, len(path), TOKEN):
                self.open.append([None, 0, 0, 0, int.from_bytes(path[i + 16 : i + TOKEN], "big"), None, []])
            self.last = path
        if self.open:
            here = self.open[-1]
            here[0] = least if here[0] is None else min(here[0], least)
            here[1] += n
        else:
            self._add(n, least, 0, 0, 0)
        if self.hash is None:
            self.hash = hashlib.sha256(members)
        else:
            self.hash.update(b",")
            self.hash.update(members)

    def end(self) -> None:
        self._digest()
        self._close(0)
        self.out += [(at, None, p[1], None, None, p[0], *p[2:5], p[5]) for at, p in self.partial.items()]


def nodes(paths: DataFrame) -> DataFrame:
    """The nodes of the trie of paths (conv_id, path), one row a conversation.

    Columns: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs (members),
    n_children, n_leaves, saved_tokens (summed over the subtree: members but one, times the bytes of the
    node's last text), ends_sha256 (of the comma-joined ids of members that end there). A conversation
    without turns is a member of the root only. No conversation: no node.
    """
    spark = ship(paths.sparkSession)
    block = F.shiftright("conv_id", BLOCK_BITS)
    members = F.sort_array(F.collect_list("conv_id")).alias("ids")
    runs = paths.groupBy("path", block.alias("block")).agg(members).select(
        "path", F.col("ids")[0].alias("least"), F.size("ids").cast("long").alias("n"),
        F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary").alias("members"),
    )
    runs = written(runs, "runs")
    count = runs.count()
    if not count:
        return spark.createDataFrame([], _NODE).select(RESULT)
    shards = min(MAX_SHARDS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // SHARD_RUNS)))
    longest = TRIE_BYTES // (2 * SAMPLES * shards * TOKEN)
    place, places = F.pmod(F.xxhash64("path"), F.lit(1 << 30)), min(1 << 30, (SAMPLES * shards << 30) // count)
    sample = runs.where(place < places).select(F.substring("path", 1, TOKEN * longest).alias("path")).distinct()
    skeleton = Skeleton(splitters([bytes(r["path"]) for r in sample.collect()], shards))
    shared = spark.sparkContext.broadcast(skeleton)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = shared.value.shard
        for batch in batches:
            ids = pa.array([shard(p) for p in batch.column(0).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([ids, *batch.columns], names=["shard", *batch.schema.names])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(shared.value)
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard.add(*row)
                if len(shard.out) >= ROWS:
                    yield _batch(shard.out)
                    shard.out = []
        shard.end()
        yield _batch(shard.out)

    dealt = runs.mapInArrow(deal, "shard int, path binary, least bigint, n bigint, members binary").repartitionById(shards, "shard")
    found = written(dealt.select("path", "least", "n", "members").sortWithinPartitions("path", "least").mapInArrow(build, _NODE), "nodes")
    parts = found.where("sid is not null").groupBy("sid").agg(
        F.sum("n_convs"), F.min("conv_id"), F.sum("n_children"), F.sum("n_leaves"), F.sum("saved_tokens"), F.max("ends_sha256")
    )
    partial = {r[0]: list(r[1:]) for r in parts.collect()}
    top = spark.createDataFrame(skeleton.summed(partial), _NODE)
    local = found.where("sid is null").join(
        F.broadcast(top.select(F.col("sid").alias("top"), F.col("conv_id").alias("above"))), "top", "left"
    )
    local = local.withColumn("parent_conv_id", F.coalesce("above", "parent_conv_id"))
    return local.select(RESULT).unionByName(top.select(RESULT))
