"""Trie of conversation prefixes, by union-find over the LCP edges of sorted neighbours.

Conversations are sequences of turns; a turn is named by 128 bits of hashes of (role, text).
Distinct sequences are range-partitioned and sorted, so conversations with a common prefix are
neighbours. In a partition the edges between neighbours, weighted by the length of their longest
common prefix, are taken in descending depth: every edge that joins two components of a
union-find creates a branching node (or adds a child to the one that is already at that depth).
Runs of nodes without a branch are filled in at the end, from one sequence of the node.

Prefixes of a partition's first and last sequence may go on in the neighbouring partitions. The
nodes on those two paths are contracted to one row per partition: what hangs below them is
summed up. These rows are merged across the boundaries by the same union-find, and the parents
that other nodes have among them are joined back.

Sequences are cut into segments of ``SEGMENT`` turns. The segments that follow one common prefix
are a trie of their own, whose totals are added to the node that they hang from, so a row never
holds more than one segment, however long a conversation is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.shared import Scratch

#: turns of a row
SEGMENT = 4096
#: member ids that are joined to one string before they are hashed in order
IDS = 4096

TURN = "struct<a:bigint,b:bigint,n:int>"


# -- turns --------------------------------------------------------------------------------------

def numbered_turns(rows: DataFrame, scratch: Scratch, conv_col: str = "conv_id",
                   turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
                   ) -> DataFrame:
    """(conv, pos, a, b, n): every turn with its place in its conversation from 0 in ``turn_col``
    order, null first, turns of one number by their hashes; two hashes of (role, text), null as
    empty; and the code points of the text. Rows without a conversation id are no turns.

    Rows are sorted in key ranges, so a conversation may go over several; the range that it
    starts in tells the next ones how far it has come.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    slim = rows.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"),
        F.xxhash64(role, text).alias("a"), F.xxhash64(F.lit(1), role, text).alias("b"),
        F.length(text).alias("n"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")]
    ranges = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = scratch.keep(slim.repartitionByRange(ranges, *order).withColumn(
        "range", F.spark_partition_id()), "turns")
    sizes = dealt.groupBy("conv", "range").agg(F.count("*").alias("size"))
    earlier = Window.partitionBy("conv").orderBy("range").rowsBetween(
        Window.unboundedPreceding, -1)
    # at most one row per range: the conversation that has begun in an earlier one
    begun = sizes.withColumn("before", F.sum("size").over(earlier)).filter(
        F.col("before") > 0).drop("size")
    here = F.row_number().over(Window.partitionBy("range", "conv").orderBy(*order[1:])) - 1
    return (dealt.withColumn("here", here)
            .join(F.broadcast(begun), ["conv", "range"], "left")
            .select("conv", (F.col("here") + F.coalesce("before", F.lit(0))).alias("pos"),
                    "a", "b", "n"))


def _pair(*parts: Column) -> Column:
    """Two 64-bit hashes of columns."""
    return F.struct(F.xxhash64(*parts).alias("x"), F.xxhash64(F.lit(1), *parts).alias("y"))


def _no_prefix() -> Column:
    return F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))


def segments(turns: DataFrame, convs: DataFrame, scratch: Scratch, segment: int) -> DataFrame:
    """(conv, seg, up, seq, name, end): the segments of every conversation of ``convs`` (conv,
    length), in turn order. ``up`` names the prefix before the segment, ``name`` its turns, and
    ``end`` the whole prefix up to its last turn. The last segment is never full (perhaps empty).
    """
    rows = turns.select("conv", F.floor(F.col("pos") / segment).cast("int").alias("seg"),
                        F.struct("pos", F.struct("a", "b", F.col("n").cast("int").alias("n"))
                                 .alias("turn")).alias("t"))
    last = convs.select("conv", F.floor(F.col("length") / segment).cast("int").alias("seg"),
                        F.lit(None).cast(rows.schema["t"].dataType).alias("t"))
    seqs = (rows.unionByName(last).groupBy("conv", "seg")
            .agg(F.sort_array(F.collect_list("t")).alias("ts"))       # a segment at most
            .select("conv", "seg", F.transform("ts", lambda t: t.turn).alias("seq")))
    named = scratch.keep(seqs.withColumn("name", _pair(F.col("seq"))), "segments")
    # only conversations of several segments are grouped again, by the names of their segments
    chain = F.aggregate("names", F.array(_no_prefix()), lambda done, one: F.array_append(
        done, _pair(F.element_at(done, -1), one)))
    long = (named.join(convs.filter(F.col("length") >= segment).select("conv"), "conv")
            .groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("seg", "name"))).alias("s"))
            .select("conv", F.transform("s", lambda s: s["name"]).alias("names"))
            .select("conv", chain.alias("ups")))
    ups = scratch.keep(long, "prefixes")
    at = ups.select("conv", F.posexplode("ups").alias("seg", "up")).filter("seg > 0")
    return (named.join(at, ["conv", "seg"], "left")
            .withColumn("up", F.coalesce("up", _no_prefix()))
            .withColumn("end", _pair(F.col("up"), F.col("name")))), ups


# -- one partition ------------------------------------------------------------------------------

class _Forest:
    """Trie nodes of sorted distinct sequences, as arrays; node ``i`` has the parent
    ``parent[i]`` (-1 for a root) at ``depth[i] - 1``."""

    def __init__(self, group, seq, offsets, count, least, full, below):
        """``group``: row -> number of its trie, ascending; ``seq``: (a, b, n) of all turns;
        ``full``: rows whose last node goes on in a trie of its own, with (children, leaves,
        saved) ``below``."""
        a, b, n = seq
        m = len(offsets) - 1
        length = np.diff(offsets)
        total = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))

        # compressed nodes: one per sequence at first, then one per merge that makes a branch
        depth, rep, cnt = length.tolist(), list(range(m)), count.tolist()
        low, children = least.tolist(), [int(c) for c in below[0]]
        leaves, saved = [int(c) for c in below[1]], [int(c) for c in below[2]]
        solid, end, up = list(full.tolist()), list(range(m)), [-1] * m
        top, root = list(range(m)), list(range(m))          # of union-find sets

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        def leaf_count(i):
            return leaves[i] if children[i] or solid[i] else 1

        def cost(i, d):
            """Saved code points of the nodes from depth[i] up to depth d + 1."""
            o = offsets[rep[i]]
            return (cnt[i] - 1) * int(total[o + depth[i]] - total[o + d])

        def hang(i, q):
            up[i] = q
            children[q] += 1
            leaves[q] += leaf_count(i)
            saved[q] += saved[i] + cost(i, depth[q])
            cnt[q] += cnt[i]
            low[q] = min(low[q], low[i])

        def branch(i, d):
            for values, v in ((depth, d), (rep, rep[i]), (cnt, 0), (low, low[i]), (children, 0),
                              (leaves, 0), (saved, 0), (solid, False), (end, -1), (up, -1)):
                values.append(v)
            hang(i, len(depth) - 1)
            return len(depth) - 1

        lcp = np.full(max(m - 1, 0), -1, np.int64)
        for i in np.flatnonzero(group[1:] == group[:-1]).tolist():
            lcp[i] = common(a, b, offsets, i, i + 1)
        for i in np.argsort(-lcp, kind="stable").tolist():
            d = int(lcp[i])
            if d < 0:
                break
            x, y = find(i), find(i + 1)
            p, q = top[x], top[y]
            node = p if depth[p] == d else branch(p, d)
            hang(q, node)
            root[y] = x
            top[x] = node
        for x in range(m):
            if root[x] == x and depth[top[x]] > 0:
                branch(top[x], 0)

        # every node of every run without a branch
        top_depth, up = np.array(depth, np.int64), np.array(up, np.int64)
        above = np.where(up < 0, -1, top_depth[up])
        runs = top_depth - above
        first = np.cumsum(runs) - runs
        of = np.repeat(np.arange(len(runs)), runs)
        self.depth = np.arange(len(of)) - first[of] + above[of] + 1
        is_top = self.depth == top_depth[of]
        step = np.arange(len(of)) - 1
        at = self.depth == above[of] + 1
        step[at] = np.where(up[of[at]] < 0, -1, (first + runs - 1)[up[of[at]]])
        self.parent = step
        self.count, self.least = np.array(cnt, np.int64)[of], np.array(low, np.int64)[of]
        self.children = np.where(is_top, np.array(children, np.int64)[of], 1)
        self.leaves = np.array([leaf_count(i) for i in range(len(runs))], np.int64)[of]
        at_rep = offsets[np.array(rep, np.int64)[of]]
        before = total[at_rep + np.maximum(self.depth - 1, 0)]
        self.saved = np.array(saved, np.int64)[of] + (self.count - 1) * (
            total[at_rep + top_depth[of]] - before)
        self.points = total[at_rep + self.depth] - before
        self.end = np.where(is_top, np.array(end, np.int64)[of], -1)
        self.solid = is_top & np.array(solid, bool)[of]
        self.group = group[np.array(rep, np.int64)[of]]
        tip = first + runs - 1                              # of compressed nodes
        self.tips = tip[:m]

    def path(self, node: int) -> np.ndarray:
        """Nodes from the root to ``node``."""
        out = [node]
        while self.parent[out[-1]] >= 0:
            out.append(int(self.parent[out[-1]]))
        return np.array(out[::-1])


def common(a, b, offsets, i, j) -> int:
    """Length of the longest common prefix of sequences i and j."""
    n = min(offsets[i + 1] - offsets[i], offsets[j + 1] - offsets[j])
    x, y = offsets[i], offsets[j]
    same = (a[x:x + n] == a[y:y + n]) & (b[x:x + n] == b[y:y + n])
    return int(n if same.all() else np.argmin(same))


NODE = ("kind string, part int, seg int, up struct<x:bigint,y:bigint>, conv long, depth long, "
        "parent long, side int, place int, n_convs long, n_children long, n_leaves long, "
        "saved long, tail struct<x:bigint,y:bigint>")
#: a partition's two outer paths: ``inner`` nodes are common to both
SIDE = ("array<struct<a:bigint,b:bigint,n:bigint,convs:bigint,least:bigint,kids:bigint,"
        "leaves:bigint,saved:bigint,full:boolean,tail:struct<x:bigint,y:bigint>>>")
ROW = NODE + (f", inner int, segs array<int>, ups array<struct<x:bigint,y:bigint>>, "
              f"left {SIDE}, right {SIDE}")


def _partition_nodes(part_of):
    """mapInArrow body over a partition of sorted rows (seg, up, seq, count, least, end, full,
    kids, leaves, saved): its finished nodes, and one row with its outer paths."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if batches:
            yield from _emit(part_of(), pa.Table.from_batches(batches).combine_chunks())
    return run


def _ints(column) -> np.ndarray:
    return np.asarray(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
                      ).astype(np.int64)


def _emit(part: int, t: pa.Table) -> Iterator[pa.RecordBatch]:
    seq = t.column("seq").combine_chunks()
    offsets = seq.offsets.to_numpy().astype(np.int64)
    turns = seq.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    a, b, n = (np.asarray(turns.field(i)).astype(np.int64) for i in range(3))
    ups, ends = t.column("up").combine_chunks(), t.column("end").combine_chunks()
    ux, uy = (np.asarray(ups.field(i)) for i in range(2))
    ex, ey = (np.asarray(ends.field(i)) for i in range(2))
    seg = _ints(t.column("seg"))
    new = (seg[1:] != seg[:-1]) | (ux[1:] != ux[:-1]) | (uy[1:] != uy[:-1])
    group = np.concatenate(([0], np.cumsum(new)))
    f = _Forest(group, (a, b, n), offsets, _ints(t.column("count")), _ints(t.column("least")),
                np.asarray(t.column("full").combine_chunks().to_numpy(zero_copy_only=False), bool),
                [_ints(t.column(c)) for c in ("kids", "leaves", "saved")])
    head = np.concatenate(([0], np.flatnonzero(new) + 1))       # a row of each trie

    # contract the paths of the first and the last sequence
    last = len(seg) - 1
    left, right = f.path(f.tips[0]), f.path(f.tips[last])
    if group[last] != 0:
        inner = -1
    else:
        inner = common(a, b, offsets, 0, last)
    right = right[inner + 1:]
    outer = np.full(len(f.depth), -1, np.int64)                 # side of a node on a path
    outer[left], outer[right] = 0, 1
    kids, leaves, saved = f.children.copy(), f.leaves.copy(), f.saved.copy()
    saved -= (f.count - 1) * f.points
    leaves[(kids == 0) & ~f.solid] = 0
    for i in np.concatenate((left, right)).tolist():            # without what is on a path
        q = f.parent[i]
        if q >= 0:
            kids[q] -= 1
            leaves[q] -= f.leaves[i]
            saved[q] -= f.saved[i]

    def tail(i):
        e = f.end[i]
        return None if e < 0 else {"x": int(ex[e]), "y": int(ey[e])}

    def side(nodes, row):
        o = offsets[row]
        return [{"a": int(a[o + f.depth[i] - 1]) if f.depth[i] else 0,
                 "b": int(b[o + f.depth[i] - 1]) if f.depth[i] else 0, "n": int(f.points[i]),
                 "convs": int(f.count[i]), "least": int(f.least[i]), "kids": int(kids[i]),
                 "leaves": int(leaves[i]), "saved": int(saved[i]), "full": bool(f.solid[i]),
                 "tail": tail(i)}
                for i in nodes.tolist()]

    schema = _ARROW
    free = np.flatnonzero(outer < 0)
    parent = f.parent[free]
    has = parent >= 0
    bound = has & (outer[np.maximum(parent, 0)] >= 0)           # the parent is on a path
    q = np.maximum(parent, 0)
    at = head[f.group[free]]
    e = f.end[free]
    columns = {
        "kind": np.full(len(free), "node"), "part": np.full(len(free), part, np.int32),
        "seg": seg[at].astype(np.int32),
        "up": pa.StructArray.from_arrays([pa.array(ux[at]), pa.array(uy[at])], ["x", "y"]),
        "conv": f.least[free], "depth": f.depth[free],
        "parent": pa.array(f.least[q], mask=~has | bound),
        "side": pa.array(outer[q].astype(np.int32), mask=~bound),
        "place": pa.array(f.depth[q].astype(np.int32), mask=~bound),
        "n_convs": f.count[free], "n_children": f.children[free], "n_leaves": f.leaves[free],
        "saved": f.saved[free],
        "tail": pa.StructArray.from_arrays([pa.array(ex[e]), pa.array(ey[e])], ["x", "y"],
                                           mask=pa.array(e < 0)),
    }
    arrays = [pa.array(columns[x.name], x.type) if not isinstance(columns.get(x.name), pa.Array)
              else columns[x.name].cast(x.type) for x in schema if x.name in columns]
    nulls = [pa.nulls(len(free), x.type) for x in schema if x.name not in columns]
    yield pa.RecordBatch.from_arrays(arrays + nulls, schema=schema)
    yield pa.RecordBatch.from_pylist([{
        "kind": "outer", "part": part, "inner": inner,
        "segs": [int(seg[0]), int(seg[last])],
        "ups": [{"x": int(ux[i]), "y": int(uy[i])} for i in (0, last)],
        "left": side(left, 0), "right": side(right, last)}], schema=schema)


_XY = pa.struct([("x", pa.int64()), ("y", pa.int64())])
_SIDE = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()),
                            ("convs", pa.int64()), ("least", pa.int64()), ("kids", pa.int64()),
                            ("leaves", pa.int64()), ("saved", pa.int64()), ("full", pa.bool_()),
                            ("tail", _XY)]))
_ARROW = pa.schema([
    ("kind", pa.string()), ("part", pa.int32()), ("seg", pa.int32()), ("up", _XY),
    ("conv", pa.int64()), ("depth", pa.int64()), ("parent", pa.int64()), ("side", pa.int32()),
    ("place", pa.int32()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved", pa.int64()), ("tail", _XY), ("inner", pa.int32()),
    ("segs", pa.list_(pa.int32())), ("ups", pa.list_(_XY)), ("left", _SIDE), ("right", _SIDE)])


# -- across partitions --------------------------------------------------------------------------

def _merge(paths: pa.Table) -> pa.Table:
    """Union-find over the outer paths of all partitions, one row each, along the LCP edges
    between neighbouring partitions in descending depth. Returns the merged nodes, and for every
    node of a path which merged node it is ("place" rows)."""
    rows = sorted(paths.to_pylist(), key=lambda r: r["part"])
    items, where = [], {}               # nodes on paths; (part, side, depth) -> item
    parent, trie = [], []
    for r in rows:
        for s, nodes in ((0, r["left"]), (1, r["right"])):
            for k, node in enumerate(nodes):
                d = k if s == 0 else r["inner"] + 1 + k
                where[r["part"], s, d] = len(items)
                items.append((r["part"], s, d, node))
                last = (0 if s == 0 or d - 1 <= r["inner"] else 1)
                parent.append(where[r["part"], last, d - 1] if d else -1)
                trie.append((int(r["segs"][s]), r["ups"][s]["x"], r["ups"][s]["y"]))
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def right_path(r):
        return list(r["left"][:r["inner"] + 1]) + list(r["right"])

    edges = []
    for p, q in zip(rows, rows[1:]):
        i = where[p["part"], 0 if p["inner"] >= 0 else 1, 0]
        if trie[i] != trie[where[q["part"], 0, 0]]:
            continue
        d = 0
        for x, y in zip(right_path(p)[1:], q["left"][1:]):
            if (x["a"], x["b"]) != (y["a"], y["b"]):
                break
            d += 1
        edges.append((d, p, q))
    for d, p, q in sorted(edges, key=lambda e: -e[0]):
        for k in range(d, -1, -1):
            i = find(where[p["part"], 0 if k <= p["inner"] else 1, k])
            j = find(where[q["part"], 0, k])
            root[max(i, j)] = min(i, j)

    node: dict[int, dict] = {}
    for i, (part, s, d, v) in enumerate(items):
        new = node.setdefault(find(i), {
            "depth": d, "convs": 0, "least": v["least"], "kids": 0, "leaves": 0, "saved": 0,
            "n": v["n"], "full": False, "tail": None, "up": find(parent[i]) if parent[i] >= 0 else -1})
        new["convs"] += v["convs"]
        new["least"] = min(new["least"], v["least"])
        for c in ("kids", "leaves", "saved"):
            new[c] += v[c]
        new["tail"] = new["tail"] or v["tail"]
        new["full"] |= v["full"]
    for i, v in sorted(node.items(), key=lambda x: -x[1]["depth"]):
        if v["kids"] == 0 and not v["full"]:
            v["leaves"] = 1
        v["saved"] += (v["convs"] - 1) * v["n"]
        if v["up"] >= 0:
            q = node[v["up"]]
            q["kids"] += 1
            q["leaves"] += v["leaves"]
            q["saved"] += v["saved"]
    none = {c: None for c in _ARROW.names}
    out = []
    for i, v in node.items():
        seg, x, y = trie[i]
        out.append({**none, "kind": "node", "seg": seg, "up": {"x": x, "y": y},
                    "conv": v["least"], "depth": v["depth"],
                    "parent": node[v["up"]]["least"] if v["up"] >= 0 else None,
                    "n_convs": v["convs"], "n_children": v["kids"], "n_leaves": v["leaves"],
                    "saved": v["saved"], "tail": v["tail"]})
    for i, (part, s, d, _) in enumerate(items):
        out.append({**none, "kind": "place", "part": part, "side": s, "place": d,
                    "parent": node[find(i)]["least"]})
    return pa.Table.from_pylist(out, schema=_ARROW).select(_NODE_NAMES)


_NODE_NAMES = [x.strip().split()[0] for x in
               "kind, part, seg, up, conv, depth, parent, side, place, n_convs, n_children, "
               "n_leaves, saved, tail".split(",")]


def _part_id():
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def trie_nodes(seqs: DataFrame, scratch: Scratch) -> DataFrame:
    """seqs (seg, up, seq, count, least, end, full, kids, leaves, saved), distinct by (up, seq)
    -> (seg, up, conv, depth, parent, n_convs, n_children, n_leaves, saved, tail): all nodes,
    depths within the segment, roots of every segment's trie included."""
    order = ["seg", "up", "seq"]
    parts = max(1, int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = scratch.keep(
        seqs.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .mapInArrow(_partition_nodes(_part_id), ROW), "forests")
    names = [c for c in _NODE_NAMES if c != "kind"]
    # one contracted row per partition: their number does not grow with the rows
    merged = scratch.keep(
        found.filter("kind = 'outer'").select("part", "inner", "segs", "ups", "left", "right")
        .withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_merge, NODE), "merged")
    places = merged.filter("kind = 'place'").select("part", "side", "place",
                                                    F.col("parent").alias("known"))
    inside = (found.filter("kind = 'node'").select(*names)
              .join(places, ["part", "side", "place"], "left")
              .withColumn("parent", F.coalesce("parent", "known")).select(*names))
    return inside.unionByName(merged.filter("kind = 'node'").select(*names)).drop(
        "part", "side", "place")


# -- members that end at a node -----------------------------------------------------------------

def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (x, y, conv) -> (x, y, first, ids): runs of one (x, y) as decimal ids in order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y, conv = (np.asarray(batch.column(i)) for i in range(3))
        new = np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
        starts = np.flatnonzero(new)
        stops = np.append(starts[1:], len(x))
        cuts = [(i, min(i + IDS, t)) for s, t in zip(starts, stops) for i in range(s, t, IDS)]
        at = np.array([i for i, _ in cuts])
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[at]), pa.array(y[at]), pa.array(conv[at]),
             pa.array([",".join(map(str, conv[i:j].tolist())) for i, j in cuts])],
            names=["x", "y", "first", "ids"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (x, y, first, ids) -> (x, y, digest): SHA-256 of all ids of an (x, y), comma-joined,
    fed piece by piece."""
    key, digest = None, None
    for batch in batches:
        out = []
        for x, y, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                             batch.column(3).to_pylist()):
            if (x, y) != key:
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest = (x, y), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield _digests(out)
    if key is not None:
        yield _digests([(*key, digest.hexdigest())])


def _digests(rows) -> pa.RecordBatch:
    x, y, d = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()),
                                       pa.array(d, pa.string())], names=["x", "y", "digest"])


def member_digests(ends: DataFrame) -> DataFrame:
    """ends (conv, end) -> (tail, digest): SHA-256 of the ids that end at each prefix. Ids are
    sorted and joined to strings in key ranges, so of a prefix with very many members one task
    reads a string per ``IDS`` of them."""
    rows = ends.select(F.col("end.x").alias("x"), F.col("end.y").alias("y"), "conv")
    parts = max(1, int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    strings = (rows.repartitionByRange(parts, "x", "y", "conv")
               .sortWithinPartitions("x", "y", "conv")
               .mapInArrow(_joined, "x long, y long, first long, ids string"))
    return (strings.repartition(parts, "x", "y").sortWithinPartitions("x", "y", "first")
            .mapInArrow(_digested, "x long, y long, digest string")
            .select(F.struct("x", "y").alias("tail"), "digest"))


# -- all ----------------------------------------------------------------------------------------

def prefix_trie(turns: DataFrame, convs: DataFrame, scratch: Scratch,
                segment: int = SEGMENT) -> DataFrame:
    """turns (conv, pos, a, b, n) with pos from 0 without gaps, convs (conv, length) -> one row
    per distinct prefix: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    A prefix's members are the conversations that start with it; those without turns are members
    of the root alone. Without conversations there is no row. ``saved_tokens`` sums over a
    node's subtree (n_convs - 1) times the code points of the node's last text. Turns count as
    equal if both 64-bit hashes of (role, text) agree.
    """
    rows, ups = segments(turns, convs, scratch, segment)
    rows = scratch.keep(rows, "rows")
    full = F.size("seq") >= segment
    # what continues after a full segment is the trie that its end names
    distinct = scratch.keep(
        rows.groupBy("seg", "up", "name").agg(
            F.count("*").alias("count"), F.min("conv").alias("least"),
            F.first("seq").alias("seq"), F.first("end").alias("end"))
        .withColumn("full", full), "distinct")
    zero = [F.lit(0).cast("long").alias(c) for c in ("kids", "leaves", "saved")]
    slim = distinct.select("seg", "up", "seq", "count", "least", "end", "full")
    if not ups.isEmpty():
        own = scratch.keep(trie_nodes(slim.select("*", *zero), scratch), "own").filter(
            "seg > 0 and depth = 0")
        own = own.select("up", F.col("n_children").alias("kids"),
                         F.col("n_leaves").alias("leaves"), "saved")
        # a trie's totals count for every trie above it, which are the earlier names of its chain
        chains = rows.filter("seg > 0").groupBy("up", "seg").agg(F.min("conv").alias("conv"))
        above = (chains.join(ups, "conv").select(
            "up", F.explode(F.slice("ups", F.lit(2), F.col("seg"))).alias("over")))
        totals = above.join(own, "up").groupBy("over").agg(
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        below = scratch.keep(own.select(F.col("up").alias("over"), "kids").join(totals, "over"),
                             "below")
        full_rows = slim.filter("full").join(below, slim["end"] == below["over"]).drop("over")
        slim = slim.filter("not full").select("*", *zero).unionByName(full_rows)
    else:
        slim = slim.select("*", *zero)
    nodes = trie_nodes(slim, scratch).filter("seg = 0 or depth > 0")
    # members that end right after a full segment have an empty segment there
    through = F.when(F.col("depth") >= segment, _pair(F.col("tail"), _pair(F.array().cast(f"array<{TURN}>")))).otherwise(
        F.col("tail"))
    last = rows.filter(~full).select("conv", "end")
    nodes = nodes.withColumn("tail", through)
    told = nodes.join(member_digests(last), "tail", "left")
    return told.select(
        F.col("conv").alias("conv_id"),
        (F.col("depth") + F.col("seg").cast("long") * segment).alias("depth"),
        F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("digest", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def graft(turns: DataFrame, scratch: Scratch, group: int = 100, most: int = 6
          ) -> tuple[DataFrame, DataFrame]:
    """numbered turns -> (turns, convs) in which the first h turns of every conversation c come
    from conversation c - c % ``group`` (all that it has, if fewer), h = crc32(c) % ``most``;
    its own turns after the first h follow."""
    turns = scratch.keep(turns, "numbered")
    h = (F.crc32(F.col("conv").cast("string")) % most).alias("h")
    convs = turns.groupBy("conv").agg(F.count("*").alias("size")).select(
        "conv", "size", h, (F.col("conv") - F.col("conv") % group).alias("base"))
    head = turns.filter(F.col("pos") < most - 1)
    have = head.groupBy(F.col("conv").alias("base")).agg(F.count("*").alias("have"))
    convs = scratch.keep(convs.join(have, "base", "left").withColumn(
        "given", F.least("h", F.coalesce("have", F.lit(0)))), "convs")
    first = (head.withColumnRenamed("conv", "base")
             .join(convs.select("conv", "base", "given"), "base")
             .filter(F.col("pos") < F.col("given")).select("conv", "pos", "a", "b", "n"))
    rest = (turns.join(convs.select("conv", "h", "given"), "conv")
            .filter(F.col("pos") >= F.col("h"))
            .select("conv", (F.col("pos") - F.col("h") + F.col("given")).alias("pos"),
                    "a", "b", "n"))
    length = F.col("given") + F.greatest(F.col("size") - F.col("h"), F.lit(0))
    return first.unionByName(rest), convs.select("conv", length.alias("length"))
