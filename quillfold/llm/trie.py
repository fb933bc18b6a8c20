"""Prefix trie of conversations: union-find over the shared prefixes of sorted neighbours.

A conversation is the sequence of its turns; a turn is a 20-byte symbol (MD5 of role and text, bytes of the text), so
sequences sort as byte strings. Equal sequences are one string with a count. The distinct strings are sorted over all
tasks and cut in blocks. Within a block the edges between neighbours, weighted by the number of turns they share, are
taken in descending depth; each merge of two components makes a branching node (or adds a child to the node of that
depth). A block's forest is then contracted to what other blocks can share with it, the nodes on the paths to its first
and last string, and contracted forests are merged across boundaries in levels of `FAN` blocks (`_scan`); no task sees
more than that many. At last each block writes the nodes that begin in it, with the sums over all blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import saved

#: Bytes of a turn's symbol: MD5 and the length of its text.
SYMBOL = 20
#: Distinct conversations of a block, and contracted forests that are merged at a time.
ROWS, FAN = 4096, 32
#: Conversation ids of one piece of a list of ends.
PIECE = 10_000
NO_ENDS = hashlib.sha256(b"").hexdigest()

# rows of a path's array; columns are depths
N, LEAST, LEAVES, PAID, ONCE, CHILDREN = range(6)


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns: symbols in hexadecimal) of each conv_id of `conversations` (conv_id, turn, role, text).

    Turns are ordered by `turn`, null first, equal ones by symbol; null roles and texts are empty; rows whose conv_id is
    null belong to no conversation. The texts stay out of every shuffle: a turn is 40 characters from here on.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    role, text = filled("role"), filled("text")
    named = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    symbol = F.concat(named, F.lpad(F.hex(F.octet_length(text)), 8, "0"))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), symbol.alias("symbol")).alias("x")
    )
    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["symbol"]).alias("turns"))


def forked(seqs: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """Each conversation c of (conv_id, turns) begins anew with the first h turns of conversation c - c % family.

    h is crc32 of the decimal c, modulo `most`; its own turns follow after its first h. What is not there is left out.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    own = seqs.select("conv_id", "turns", h.cast("int").alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("from"))
    head = seqs.filter(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("from"), F.slice("turns", 1, most - 1).alias("head"))
    begun = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return own.join(head, "from", "left").select("conv_id", F.concat(begun, rest).alias("turns"))


def shared(a: bytes, b: bytes) -> int:
    """Turns that two sequences have in common at their beginning."""
    low, high = 0, min(len(a), len(b)) // SYMBOL
    while low < high:
        middle = (low + high + 1) // 2
        if a[SYMBOL * low : SYMBOL * middle] == b[SYMBOL * low : SYMBOL * middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _lengths(key: bytes) -> np.ndarray:
    """Bytes of text before each depth of a sequence: 0, first turn, first two ..."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(key, ">u4")[4::5].astype(np.int64))])


class Forest:
    """The trie of sorted distinct sequences with the nodes that branch or end. Per node: depth, first sequence, parent
    and the sums over its sequences; `paid` counts text bytes below it once per conversation, `once` once per node."""

    def __init__(self, keys: list[bytes], n: list[int], least: list[int]):
        self.keys, rows = keys, len(keys)
        self.size = [len(k) // SYMBOL for k in keys]
        every = np.frombuffer(b"".join(keys), ">u4")[4::5].astype(np.int64)
        self.offset = np.concatenate([[0], np.cumsum(np.array(self.size, np.int64) + 1)])
        self.bytes = np.zeros(int(self.offset[-1]), np.int64)  # _lengths of all, one after another
        starts = np.zeros(len(self.bytes), bool)
        starts[self.offset[:-1]] = True
        self.bytes[~starts] = every
        total = np.cumsum(self.bytes)
        self.bytes = total - np.repeat(total[self.offset[:-1]], np.diff(self.offset))
        self.depth, self.row, self.parent = list(self.size), list(range(rows)), [-1] * rows
        self.n, self.least, self.leaves, self.children = list(n), list(least), [1] * rows, [0] * rows
        self.paid, self.once, self.end = [0] * rows, [0] * rows, list(range(rows))
        self._merge([shared(a, b) for a, b in zip(keys, keys[1:], strict=False)])

    def _merge(self, edges: list[int]) -> None:
        """Kruskal's order on a path: edges of equal depth from left to right, so only the left component can already
        have its node at that depth."""
        find, top = list(range(len(self.keys))), list(range(len(self.keys)))

        def root(x: int) -> int:
            while find[x] != x:
                find[x] = find[find[x]]
                x = find[x]
            return x

        for at in sorted(range(len(edges)), key=lambda k: -edges[k]):
            a, b, depth = root(at), root(at + 1), edges[at]
            node = top[a]
            if self.depth[node] != depth:
                node = len(self.depth)
                for column, value in (
                    (self.depth, depth), (self.row, self.row[top[a]]), (self.parent, -1), (self.n, 0), (self.least, self.least[top[a]]),
                    (self.leaves, 0), (self.children, 0), (self.paid, 0), (self.once, 0), (self.end, -1),
                ):
                    column.append(value)
                self._adopt(node, top[a])
            elif not self.children[node]:
                self.leaves[node] = 0  # a sequence that ends here is begun by others
            self._adopt(node, top[b])
            find[b] = a
            top[a] = node
        self.top = top[root(0)]

    def _adopt(self, node: int, child: int) -> None:
        span = self.text_bytes(child, self.depth[node])
        self.parent[child] = node
        self.n[node] += self.n[child]
        self.least[node] = min(self.least[node], self.least[child])
        self.leaves[node] += self.leaves[child]
        self.children[node] += 1
        self.paid[node] += self.paid[child] + self.n[child] * span
        self.once[node] += self.once[child] + span

    def text_bytes(self, node: int, above: int) -> int:
        """Of the turns that lead to the node from the depth `above`."""
        begin = self.offset[self.row[node]]
        return int(self.bytes[begin + self.depth[node]] - self.bytes[begin + above])

    def path(self, row: int) -> np.ndarray:
        """Sums of each prefix of a sequence, over this forest."""
        out, node, till = np.zeros((6, self.size[row] + 1), np.int64), row, self.size[row]
        text = self.bytes[self.offset[row] : self.offset[row + 1]]
        while node >= 0:
            up = self.parent[node]
            above = self.depth[up] if up >= 0 else -1
            at = np.arange(above + 1, till + 1)
            span = text[till] - text[np.maximum(at - 1, 0)]
            out[N, at], out[LEAST, at], out[LEAVES, at] = self.n[node], self.least[node], self.leaves[node]
            out[PAID, at], out[ONCE, at] = self.paid[node] + self.n[node] * span, self.once[node] + span
            out[CHILDREN, at] = 1
            out[CHILDREN, till] = self.children[node]
            node, till = up, above
        return out


def _joined(left: np.ndarray, right: np.ndarray, last: bytes, met: int, depth: int) -> np.ndarray:
    """Sums of the prefixes up to `depth`, of which a forest's path to its last sequence `last` and the next forest's path
    to its first one share `met`."""
    a, b, at = left[:, : depth + 1], right[:, : depth + 1], np.arange(depth + 1)
    text = _lengths(last[: SYMBOL * met])
    out = a + b
    out[LEAST] = np.minimum(a[LEAST], b[LEAST])
    out[LEAVES] -= len(last) == SYMBOL * met  # what ended there goes on now
    out[ONCE] -= text[met] - text[np.maximum(at - 1, 0)]
    out[CHILDREN] -= at < met
    return out


class Contracted:
    """What neighbours need of a forest: its first and last sequence and the sums along the paths to them."""

    def __init__(self, first: bytes, last: bytes, low: np.ndarray, high: np.ndarray):
        self.first, self.last, self.low, self.high = first, last, low, high
        self.common = shared(first, last)

    def after(self, last: bytes, high: np.ndarray) -> np.ndarray:
        """The path to its last sequence, with a forest before it."""
        met = shared(last, self.first)
        return self._with(self.high, min(met, self.common), high, self.low, last, met)

    def before(self, first: bytes, low: np.ndarray) -> np.ndarray:
        """The path to its first sequence, with a forest behind it."""
        met = shared(self.last, first)
        return self._with(self.low, min(met, self.common), self.high, low, self.last, met)

    def merged(self, other: Contracted) -> Contracted:
        return Contracted(self.first, other.last, self.before(other.first, other.low), other.after(self.last, self.high))

    @staticmethod
    def _with(path, depth, left, right, last, met):
        out = path.copy()
        out[:, : depth + 1] = _joined(left, right, last, met, depth)
        return out


_FOREST = "id long, first binary, last binary, low binary, high binary"
_FRAME = "id long, last_before binary, high_before binary, first_after binary, low_after binary"
_sums = lambda b: np.frombuffer(b, np.int64).reshape(6, -1)


def _forest_row(at: int, x: Contracted) -> dict:
    return {"id": at, "first": x.first, "last": x.last, "low": x.low.tobytes(), "high": x.high.tobytes()}


def _forests(table: pa.Table) -> list[tuple[int, Contracted]]:
    rows = sorted(table.to_pylist(), key=lambda r: r["id"])
    return [(r["id"], Contracted(r["first"], r["last"], _sums(r["low"]), _sums(r["high"]))) for r in rows]


def _arrow(rows: list[dict], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.Table.from_pylist(rows, pa.schema([(n, kinds[k]) for n, k in (c.split() for c in schema.split(", "))]))


def _contract(block: pa.Table) -> pa.Table:
    forest, at = _sorted_forest(block)[0], block.column("block")[0].as_py()
    return _arrow([_forest_row(at, Contracted(forest.keys[0], forest.keys[-1], forest.path(0), forest.path(len(forest.keys) - 1)))], _FOREST)


def _sorted_forest(block: pa.Table) -> tuple[Forest, list[str]]:
    rows = sorted(zip(*(block.column(c).to_pylist() for c in ("key", "n", "least", "ends")), strict=True))
    keys, n, least, ends = map(list, zip(*rows, strict=True))
    return Forest(keys, n, least), ends


def _merge_group(group: pa.Table) -> pa.Table:
    (_, whole), *others = _forests(group.select(["id", "first", "last", "low", "high"]))
    for _, other in others:
        whole = whole.merged(other)
    return _arrow([_forest_row(group.column("group")[0].as_py(), whole)], _FOREST)


def _frame_group(group: pa.Table, frame: pa.Table) -> pa.Table:
    """What stands before and behind each forest of a group, from what stands before and behind the group. Only as much of
    a path is kept as the forest shares, and one turn more, which tells whether the sequence ends there."""
    told, forests = frame.to_pylist()[0], _forests(group.select(["id", "first", "last", "low", "high"]))
    rows = {at: {"id": at, "last_before": None, "high_before": None, "first_after": None, "low_after": None} for at, _ in forests}
    last, high = told["last_before"], told["high_before"] and _sums(told["high_before"])
    for at, x in forests:
        if last is not None:
            met = shared(last, x.first)
            rows[at] |= {"last_before": last[: SYMBOL * (met + 1)], "high_before": np.ascontiguousarray(high[:, : met + 2]).tobytes()}
        last, high = x.last, x.high if last is None else x.after(last, high)
    first, low = told["first_after"], told["low_after"] and _sums(told["low_after"])
    for at, x in reversed(forests):
        if first is not None:
            met = shared(x.last, first)
            rows[at] |= {"first_after": first[: SYMBOL * (met + 1)], "low_after": np.ascontiguousarray(low[:, : met + 2]).tobytes()}
        first, low = x.first, x.low if first is None else x.before(first, low)
    return _arrow(list(rows.values()), _FRAME)


def _scan(forests: DataFrame) -> DataFrame:
    """What stands before and behind each contracted forest: merged upwards in groups of `FAN`, then told downwards."""
    levels = [saved(forests)]
    while levels[-1].limit(2).count() > 1:
        group = levels[-1].withColumn("group", F.floor(F.col("id") / FAN))
        levels.append(saved(group.groupBy("group").applyInArrow(_merge_group, _FOREST)))
    frames = levels.pop().select("id", *[F.lit(None).cast("binary").alias(c.split()[0]) for c in _FRAME.split(", ")[1:]])
    for level in reversed(levels):
        group = level.withColumn("group", F.floor(F.col("id") / FAN)).groupBy("group")
        frames = saved(group.cogroup(frames.groupBy("id")).applyInArrow(_frame_group, _FRAME))
    return frames


_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, turn binary"


def _nodes(block: pa.Table, frame: pa.Table) -> pa.Table:
    """The nodes that begin in a block: all but those that its first sequence shares with the blocks before."""
    forest, ends = _sorted_forest(block)
    told, rows = frame.to_pylist()[0], len(forest.keys)
    own = Contracted(forest.keys[0], forest.keys[-1], forest.path(0), forest.path(rows - 1))
    whole, known = own, -1
    if told["first_after"] is not None:
        met = shared(own.last, told["first_after"])
        high = own.high.copy()
        high[:, : met + 1] = _joined(own.high, _sums(told["low_after"]), own.last, met, met)
        whole = Contracted(own.first, own.last, own.before(told["first_after"], _sums(told["low_after"])), high)
    if told["last_before"] is not None:
        known = shared(told["last_before"], own.first)
        low = whole.low.copy()
        low[:, : known + 1] = _joined(_sums(told["high_before"]), whole.low, told["last_before"], known, known)
        whole = Contracted(own.first, own.last, low, whole.after(told["last_before"], _sums(told["high_before"])))
    columns = (forest.depth, forest.row, forest.parent, forest.n, forest.least, forest.leaves, forest.children, forest.paid, forest.once, forest.end)
    depth, row, parent, n, least, leaves, children, paid, once, end = (np.array(c, np.int64) for c in columns)
    above = np.where(parent >= 0, depth[parent], -1)
    number = depth - above
    last = np.cumsum(number) - 1  # the place of each node itself behind the depths that lead to it
    node = np.repeat(np.arange(len(depth)), number)
    at = np.arange(len(node)) - last[node] + depth[node]
    begin = forest.offset[row][node]
    span = forest.bytes[begin + depth[node]] - forest.bytes[begin + np.maximum(at - 1, 0)]
    itself = at == depth[node]
    sums = np.empty((6, len(node)), np.int64)
    sums[N], sums[LEAST], sums[LEAVES] = n[node], least[node], leaves[node]
    sums[PAID], sums[ONCE] = paid[node] + n[node] * span, once[node] + span
    sums[CHILDREN] = np.where(itself, children[node], 1)
    begun = np.ones(len(node), bool)
    for edge, path in ((0, whole.low), (rows - 1, whole.high)):
        on, x = np.zeros(len(depth), bool), edge
        while x >= 0:
            on[x] = True
            x = forest.parent[x]
        here = on[node]
        sums[:, here] = path[:, at[here]]
        if edge == 0:
            begun &= ~here | (at > known)
    before = np.where(at - 1 > above[node], np.arange(len(node)) - 1, last[parent[node]])
    symbols = np.frombuffer(b"".join(forest.keys), np.uint8).reshape(-1, SYMBOL)
    symbol = np.maximum(begin - row[node] + at - 1, 0)[begun]
    flat = symbols[symbol, :16].tobytes() if len(symbols) else b""
    root = at[begun] == 0
    told_ends = [ends[e] if i and e >= 0 else NO_ENDS for i, e in zip(itself[begun].tolist(), end[node][begun].tolist(), strict=True)]
    turn = pa.array([None if r else flat[16 * k : 16 * k + 16] for k, r in enumerate(root.tolist())], pa.binary())
    kept = sums[:, begun]
    values = [
        pa.array(kept[LEAST]), pa.array(at[begun]), pa.array(sums[LEAST][before][begun], mask=root), pa.array(kept[N]), pa.array(kept[CHILDREN]),
        pa.array(kept[LEAVES]), pa.array(kept[PAID] - kept[ONCE]), pa.array(told_ends, pa.string()), turn,
    ]
    return pa.Table.from_arrays(values, [c.split()[0] for c in _NODE.split(", ")])


def _digests(keyed: DataFrame, most: int) -> DataFrame:
    """(id: hash of a sequence, ends: SHA-256 of its conversations in ascending order).

    A list may hold a third of all conversations. It is joined in pieces, in tasks that each hold a range of (id, conv_id);
    the task that hashes a list reads its pieces one after another and holds one.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, []
        schema = pa.schema([("id", pa.binary()), ("first", pa.int64()), ("piece", pa.string())])
        for batch in batches:
            out = []
            for key, conv in zip(batch.column("id").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if key != name or len(held) == most:
                    if held:
                        out.append((name, held[0], ",".join(map(str, held))))
                    name, held = key, []
                held.append(conv)
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema)
        if held:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (name, held[0], ",".join(map(str, held))), strict=True))], schema)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None
        schema = pa.schema([("id", pa.binary()), ("ends", pa.string())])
        for batch in batches:
            out = []
            for key, piece in zip(batch.column("id").to_pylist(), batch.column("piece").to_pylist(), strict=True):
                if key == name:
                    state.update(b"," + piece.encode())
                    continue
                if name is not None:
                    out.append({"id": name, "ends": state.hexdigest()})
                name, state = key, hashlib.sha256(piece.encode())
            yield pa.RecordBatch.from_pylist(out, schema)
        if name is not None:
            yield pa.RecordBatch.from_pylist([{"id": name, "ends": state.hexdigest()}], schema)

    ids = keyed.select(_hashed("key").alias("id"), "conv_id")
    cut = ids.repartitionByRange("id", "conv_id").sortWithinPartitions("id", "conv_id").mapInArrow(pieces, "id binary, first long, piece string")
    return cut.repartition("id").sortWithinPartitions("id", "first").mapInArrow(digests, "id binary, ends string")


def _hashed(key: str) -> Column:
    return F.unhex(F.md5(F.col(key)))


def trie(seqs: DataFrame) -> DataFrame:
    """One row per node of the trie of (conv_id, turns: symbols as `sequences` gives them), conv_id unique.

    conv_id: the smallest conversation that begins with the node's turns; depth: their number; parent_conv_id: the parent's
    conv_id, null at the root; n_convs, n_children, n_leaves (childless nodes in the subtree, itself included);
    saved_tokens: over the subtree, (n_convs - 1) x UTF-8 bytes of a node's last text; ends_sha256: of the ascending
    decimal conv_ids that end there, comma-joined; turn: MD5 of role and text of its last turn (`with_turns`), null at the
    root. Conversations without turns end at the root; no conversations give no node.
    """
    keyed = saved(seqs.select(F.col("conv_id").cast("long").alias("conv_id"), F.unhex(F.array_join("turns", "")).alias("key")))
    strings = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"))
    ended = strings.withColumn("id", _hashed("key")).join(_digests(keyed, PIECE), "id").select("key", "n", "least", "ends")
    place = ended.repartitionByRange("key").sortWithinPartitions("key").withColumn("place", F.monotonically_increasing_id())
    part, number = F.shiftright("place", 33), F.floor(F.col("place").bitwiseAND((1 << 33) - 1) / ROWS)
    cut = saved(place.select(part.alias("part"), number.alias("number"), "key", "n", "least", "ends"))
    width = FAN  # blocks of a part are numbered within a power of FAN, so that groups of FAN are neighbours
    while width <= (cut.agg(F.max("number")).first()[0] or 0):
        width *= FAN
    blocks = cut.withColumn("block", F.col("part") * width + F.col("number")).drop("part", "number")
    frames = _scan(blocks.groupBy("block").applyInArrow(_contract, _FOREST))
    return blocks.groupBy("block").cogroup(frames.groupBy("id")).applyInArrow(_nodes, _NODE)


def with_turns(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes with the role and text of their last turn (null at the root)."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    role, text = filled("role"), filled("text")
    named = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(named.alias("turn"), role.alias("role"), text.alias("text")).dropDuplicates(["turn"])
    return nodes.join(turns, "turn", "left")
