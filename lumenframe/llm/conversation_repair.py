"""Structure repair of conversations as a scan of min-plus matrices.

A legal conversation has the role initials ``(s?(ua)+)?``: an automaton of four states (nothing yet,
after the system turn, after a user turn, after an assistant turn). A row is a 4x4 matrix over
(cost, audit): the cheapest edits, ties to the ASCII-least audit, that lead from one state to another
while the row is kept (K, 0), reroled to user or assistant (R, 2) or deleted (D, 3; the only choice for
blank and duplicate rows), with the closure of insertions (I, 2 each) put before it. A truncated row that
stays adds 1. Of two audits of equal cost between the same states over the same rows none is a prefix of
the other (what follows could only be insertions, which cost), so the least one stays least whatever
follows and the product is associative.

Rows are ordered by conversation and turn over all tasks (a range partitioning, so a conversation of any
length spans as many as it needs), equal rows as one with a number of copies. A task folds successive rows
of one conversation to leaves of at most ``LEAF_ROWS`` rows. Leaves of conversations that have several are
multiplied in a tree: ``FAN`` neighbours a group and round. On the way back down each node learns the states
in which the best path enters and leaves it, so every leaf reads its own edits off its own matrix and
repairs its own rows; no audit and no text is ever taken apart on the way. The digest of a conversation of
several leaves runs over their texts as a stream, one leaf at a time, as SHA-256 has no other form.

Defined results: a null role or text is one space; rows of one turn (null turns first) are in order of role,
then text, and equal rows are duplicates of the first; a null conv_id is a conversation of its own; an
empty role or another initial than s, u, a can only be reroled or deleted; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

LEAF_ROWS, LEAF_BYTES = 256, 1 << 22
#: Bits of a node's number that a round of the tree takes away: up to 64 neighbours a group.
FAN = 6
WHITE = " \t\n\x0b\f\r"
START, SYSTEM, USER, ASSISTANT = range(4)
Cell = tuple[int, str] | None


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows hurt by the checksum of ``conv_id:turn``; copies is 0 for a dropped row, 2 for a repeated one."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.pmod(F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")), F.lit(20))
    text = F.when(fate == 1, "").when(fate == 2, F.translate(word("text"), ".!?", "")).otherwise(word("text"))
    return rows.select("conv_id", "turn", F.when(fate == 4, "user").otherwise(word("role")).alias("role"), text.alias("text"), F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1).cast("long").alias("copies"))


def least(a: Cell, b: Cell) -> Cell:
    return b if a is None or (b is not None and b < a) else a


def times(a: list[Cell], b: list[Cell]) -> list[Cell]:
    """The product of two matrices, row by row of 16 cells."""
    out: list[Cell] = [None] * 16
    for i in range(0, 16, 4):
        for j in range(4):
            x = a[i + j]
            if x is None:
                continue
            for k in range(4):
                y = b[4 * j + k]
                if y is None:
                    continue
                cost, old = x[0] + y[0], out[i + k]
                if old is None or cost < old[0] or (cost == old[0] and x[1] + y[1] < old[1]):
                    out[i + k] = (cost, x[1] + y[1])
    return out


def matrix(cells: dict[tuple[int, int], tuple[int, str]]) -> list[Cell]:
    return [cells.get((i, j)) for i in range(4) for j in range(4)]


ONE = matrix({(i, i): (0, "") for i in range(4)})
#: Any number of insertions; more than two never pay.
INSERTIONS = matrix({(i, i): (0, "") for i in range(4)} | {(START, USER): (2, "I"), (SYSTEM, USER): (2, "I"), (ASSISTANT, USER): (2, "I"), (USER, ASSISTANT): (2, "I"), (START, ASSISTANT): (4, "II"), (SYSTEM, ASSISTANT): (4, "II")})


def living_row(initial: str, truncated: bool) -> list[Cell]:
    """The matrix of one row that may stay, insertions before it included."""
    extra, cells = int(truncated), {(i, i): (3, "D") for i in range(4)}
    for i, j in ((START, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT)):
        cells[i, j] = (extra, "K") if initial == "sua"[j - 1] else (2 + extra, "R")
    if initial == "s":
        cells[START, SYSTEM] = (extra, "K")
    return times(INSERTIONS, matrix(cells))


def dead_rows(n: int) -> list[Cell]:
    """The product of n rows that must go: insertions stand before the last one at the latest."""
    return [c and (c[0] + 3 * n, "D" * (n - 1) + c[1] + "D") for c in INSERTIONS]


class Leaf:
    """Successive rows of one conversation: what they do to a state, and what was wrong with them."""

    KNOWN: dict[tuple[str, bool], list[Cell]] = {}

    def __init__(self):
        self.cells, self.bytes = ONE, 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.turn_first = self.turn_last = None
        self.roles, self.texts, self.copies = [], [], []

    def add(self, turn, role: str, text: str, n: int, new: bool, blank: bool, cut: bool) -> None:
        if not n:
            return
        initial, dead = role[:1], blank or not new
        if not dead:
            key = (initial if initial in ("s", "u", "a") else "", cut)
            if key not in self.KNOWN:
                self.KNOWN[key] = living_row(*key)
            self.cells = times(self.cells, self.KNOWN[key])
        if n > 1 or dead:
            self.cells = times(self.cells, dead_rows(n if dead else n - 1))
        self.blank += n if blank else 0
        self.duplicate += 0 if blank else n - new
        self.truncated += not dead and cut
        self.illegal += n - 1 + (self.last is not None and self.last + initial not in ("su", "ua", "au"))
        self.first, self.last = initial if self.first is None else self.first, initial
        if turn is not None and turn != self.turn_last:
            self.turns, self.turn_last = self.turns + 1, turn
            self.turn_first = turn if self.turn_first is None else self.turn_first
        self.roles.append(role)
        self.texts.append(text)
        self.copies.append(n)
        self.bytes += len(role) + len(text)

    def full(self, rows: int) -> bool:
        return len(self.copies) >= rows or self.bytes >= LEAF_BYTES


#: What each node of the tree carries.
NODE = "cost array<long>, audit array<string>, blank long, duplicate long, truncated long, illegal long, first string, last string, turn_first long, turn_last long, turns long"
NODE_NAMES = [x.split()[0] for x in NODE.split(", ")]
LEAF_FIELDS = f"roles array<string>, texts array<string>, copies array<long>, {NODE}"


def _node(cells: list[Cell], s) -> list:
    return [[c and c[0] for c in cells], [c and c[1] for c in cells], s.blank, s.duplicate, s.truncated, s.illegal, s.first, s.last, s.turn_first, s.turn_last, s.turns]


ARROW_NODE = [pa.list_(pa.int64()), pa.list_(pa.string()), *[pa.int64()] * 4, pa.string(), pa.string(), *[pa.int64()] * 3]
ARROW_LEAF = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), *ARROW_NODE]
LEAF_NAMES = ["place", "roles", "texts", "copies", *NODE_NAMES]


def _leaves(most: int):
    """Leaves of at most so many rows of rows in order, numbered by task: conv_id, part, place and LEAF_FIELDS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, now, done, place, size = None, None, [], 0, 0

        def out():
            cols = [pa.array(x, t) for x, t in zip(zip(*[d[2:] for d in done], strict=True), ARROW_LEAF, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.int32()), *cols], names=["conv_id", "part", *LEAF_NAMES])

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, part, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if leaf is None or conv != now[0] or leaf.full(most):
                    if leaf is not None:
                        done.append([*now, place, leaf.roles, leaf.texts, leaf.copies, *_node(leaf.cells, leaf)])
                        place, size = place + 1, size + leaf.bytes
                    leaf, now = Leaf(), (conv, part)
                    if size >= LEAF_BYTES or len(done) >= 4096:
                        yield out()
                        done, size = [], 0
                leaf.add(*row)
        if leaf is not None:
            done.append([*now, place, leaf.roles, leaf.texts, leaf.copies, *_node(leaf.cells, leaf)])
            yield out()

    return run


class Sum:
    """Nodes that follow each other, as one."""

    def __init__(self, nodes: list[dict]):
        self.cells = ONE
        self.blank, self.duplicate, self.truncated = (sum(x[c] for x in nodes) for c in ("blank", "duplicate", "truncated"))
        self.illegal, self.first, self.last, self.turns, self.turn_first, self.turn_last = 0, None, None, 0, None, None
        for x in nodes:
            self.cells = times(self.cells, cells_of(x))
            self.illegal += x["illegal"] + (self.last is not None and x["first"] is not None and self.last + x["first"] not in ("su", "ua", "au"))
            self.first, self.last = x["first"] if self.first is None else self.first, self.last if x["last"] is None else x["last"]
            if x["turns"]:
                self.turns += x["turns"] - (self.turn_last == x["turn_first"])
                self.turn_first = x["turn_first"] if self.turn_first is None else self.turn_first
                self.turn_last = x["turn_last"]


def cells_of(x: dict) -> list[Cell]:
    return [None if c is None else (c, a) for c, a in zip(x["cost"], x["audit"], strict=True)]


def _merge(key, rows):
    """One node of its children."""
    nodes = rows.sort_by("node").to_pylist()
    s = Sum(nodes)
    cols = [pa.array([v], t) for v, t in zip(_node(s.cells, s), ARROW_NODE, strict=True)]
    return pa.table([pa.array([nodes[0]["head"]], pa.int64()), pa.array([key[1].as_py()], pa.int64()), *cols], ["head", "node", *NODE_NAMES])


def best_end(cells: list[Cell]) -> tuple[int, int, str, str]:
    """(cost, last state, audit, insertions at the end) of the best legal conversation."""
    found = min((c[0] + e[0], c[1] + e[1], j, e[1]) for j in range(4) for f in (START, ASSISTANT) if (c := cells[j]) is not None and (e := INSERTIONS[4 * j + f]) is not None)
    return found[0], found[2], found[1], found[3]


def route(nodes: list[list[Cell]], enter: int, leave: int) -> list[tuple[int, int]]:
    """The states in which the best path from enter to leave enters and leaves each node."""
    now: dict[int, tuple[int, str, list[int]]] = {enter: (0, "", [enter])}
    for cells in nodes:
        after: dict[int, tuple[int, str, list[int]]] = {}
        for i, (cost, audit, path) in now.items():
            for j in range(4):
                if (c := cells[4 * i + j]) is not None and ((new := (cost + c[0], audit + c[1], [*path, j])) < after.get(j, (new[0] + 1,))):
                    after[j] = new
        now = after
    path = now[leave][2]
    return list(zip(path, path[1:], strict=False))


def _route(key, rows):
    """(head, node, enter, leave) of children that carry their parent's states as up_enter and up_leave."""
    nodes = rows.sort_by("node").to_pylist()
    steps = route([cells_of(x) for x in nodes], nodes[0]["up_enter"], nodes[0]["up_leave"])
    return pa.table([pa.array([x["head"] for x in nodes], pa.int64()), pa.array([x["node"] for x in nodes], pa.int64()), pa.array([a for a, _ in steps], pa.int32()), pa.array([b for _, b in steps], pa.int32())], ["head", "node", "enter", "leave"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(head, node, leave, tail, gaps, blank, duplicate, truncated, illegal, cost, audit) of whole conversations (head, node, NODE)."""
    for batch in batches:
        out = []
        for x in batch.to_pylist():
            cost, leave, audit, tail = best_end(cells_of(x))
            gaps = x["turn_last"] - x["turn_first"] + 1 - x["turns"] if x["turns"] else 0
            out.append((x["head"], x["node"], leave, tail, gaps, x["blank"], x["duplicate"], x["truncated"], x["illegal"], cost, audit))
        types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 6, pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 11, types, strict=True)], names=["head", "node", "leave", "tail", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])


def repaired_lines(roles: list[str], texts: list[str], copies: list[int], enter: int, edits: str) -> list[str]:
    """The lines that the edits make of a leaf's rows, from a state on."""
    rows, out, state = ((r, t) for r, t, n in zip(roles, texts, copies, strict=True) for _ in range(n)), [], enter
    for e in edits:
        role, text = (None, "") if e == "I" else next(rows)
        if e == "D":
            continue
        if e != "K":
            role = "assistant" if state == USER else "user"
        state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
        out.append(f"{role}:{text}")
    return out


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(head, node, lines) of leaves with enter and edits; null lines where no row is left."""
    for batch in batches:
        for i in range(batch.num_rows):
            x = batch.slice(i, 1).to_pylist()[0]
            lines = repaired_lines(x["roles"], x["texts"], x["copies"], x["enter"], x["edits"])
            yield pa.RecordBatch.from_arrays([pa.array([x["head"]], pa.int64()), pa.array([x["node"]], pa.int64()), pa.array(["\n".join(lines) if lines else None], pa.string())], names=["head", "node", "lines"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(head, repaired_sha256) of lines in order of head and node."""
    now, sha, begun = None, None, False

    def out():
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([sha.hexdigest()], pa.string())], names=["head", "repaired_sha256"])

    for batch in batches:
        for head, lines in zip(batch.column(0), batch.column(1), strict=True):
            if sha is None or head.as_py() != now:
                if sha is not None:
                    yield out()
                now, sha, begun = head.as_py(), hashlib.sha256(), False
            if lines.is_valid:
                sha.update(b"\n" * begun + lines.as_py().encode())
                begun = True
    if sha is not None:
        yield out()


def ordered_leaves(rows: DataFrame, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """One row a leaf (conv_id, node, roles, texts, copies, NODE) of (conv_id, turn, role, text, copies); node grows with the rows' order."""
    there = F.col("copies") > 0
    word = lambda c: F.when(there, F.coalesce(F.col(c), F.lit(" "))).alias(c)
    rows = rows.select("conv_id", F.when(there, F.col("turn")).cast("long").alias("turn"), word("role"), word("text"), "copies")
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    keyed = rows.where(there).withColumn("digest", F.sha2("text", 256))
    again = keyed.groupBy("conv_id", "role", "digest").agg(F.min(at).alias("begin"), F.max(at).alias("end")).where("begin < end")
    again = again.select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), "begin")
    once = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("n"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.sha2("text", 256) == F.col("_digest"))
    tail = F.substring(F.rtrim("text", F.lit(WHITE)), -1, 1)
    marked = once.join(again, same, "left").select("conv_id", "turn", "role", "text", "n", (F.col("begin").isNull() | (F.col("begin") == at)).alias("new"), F.coalesce(tail == "", F.lit(False)).alias("blank"), (~F.coalesce(tail.isin(".", "!", "?"), F.lit(True))).alias("cut"))
    first = lambda c: F.col(c).asc_nulls_first()
    order = [first("conv_id"), first("turn"), first("role")]
    spread = marked.repartitionByRange(*order, F.substring("text", 1, 64).asc_nulls_first()).sortWithinPartitions(*order, first("text"))
    kind = dict(rows.dtypes)["conv_id"]
    leaves = spread.select("conv_id", F.spark_partition_id().alias("part"), "turn", "role", "text", "n", "new", "blank", "cut").mapInArrow(_leaves(leaf_rows), f"conv_id {kind}, part int, place long, {LEAF_FIELDS}")
    stored = materialize(leaves)
    bits = int(stored.agg(F.coalesce(F.max("place"), F.lit(0))).first()[0]).bit_length()
    return stored.withColumn("node", F.shiftleft(F.col("part").cast("long"), bits) + F.col("place")).drop("part", "place")


def _best_paths(nodes: DataFrame, fan: int) -> tuple[DataFrame, DataFrame]:
    """(the whole conversations, the states of each node) of nodes (head, node, NODE) of conversations with several."""
    levels, n = [nodes], nodes.select("head").distinct().count()
    while n and levels[-1].count() > n:
        now = levels[-1]
        levels.append(materialize(now.groupBy("head", F.shiftright("node", fan).alias("up")).applyInArrow(_merge, f"head long, node long, {NODE}")))
    whole = levels[-1].mapInArrow(_finish, FINISHED)
    states = whole.select("head", "node", F.lit(START).alias("enter"), "leave")
    for level in reversed(levels[:-1]):
        up = states.select("head", F.col("node").alias("up"), F.col("enter").alias("up_enter"), F.col("leave").alias("up_leave"))
        below = level.withColumn("up", F.shiftright("node", fan)).join(up, ["head", "up"]).select("head", "up", "node", "cost", "audit", "up_enter", "up_leave")
        states = materialize(below.groupBy("head", "up").applyInArrow(_route, "head long, node long, enter int, leave int"))
    return whole, states


FINISHED = "head long, node long, leave int, tail string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def repair(rows: DataFrame, leaf_rows: int = LEAF_ROWS, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(conversations, leaves) of rows (conv_id, turn, role, text[, copies]).

    conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    leaves: conv_id, node, lines: the repaired rows as role:text, in order of node; null where none is left.
    """
    if "copies" not in rows.columns:
        rows = rows.withColumn("copies", F.lit(1).cast("long"))
    leaves = ordered_leaves(rows, leaf_rows)
    heads = leaves.groupBy("conv_id").agg(F.min("node").alias("head"), F.max("node").alias("end"), F.count("*").alias("n"))
    heads = materialize(heads)
    known = heads.select(F.col("conv_id").alias("_conv"), "head", "end", "n")
    nodes = materialize(leaves.drop("roles", "texts", "copies").join(known, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv", "conv_id"))
    lone, many = nodes.where("n = 1").select("head", "node", *NODE_NAMES), nodes.where("n > 1").select("head", "node", *NODE_NAMES)
    whole, states = _best_paths(many, fan)
    done = materialize(lone.mapInArrow(_finish, FINISHED).unionByName(whole))
    path = states.unionByName(done.join(heads.where("n = 1").select("head"), "head", "left_semi").select("head", "node", F.lit(START).alias("enter"), "leave"))
    own = F.element_at("_audit", 4 * F.col("enter") + F.col("leave") + 1)
    edits = path.join(nodes.select("head", "node", "end", F.col("audit").alias("_audit")), ["head", "node"]).join(done.select("head", "tail"), "head")
    edits = edits.select("node", "head", "enter", F.concat(own, F.when(F.col("node") == F.col("end"), F.col("tail")).otherwise("")).alias("edits"))
    lines = materialize(leaves.select("node", "roles", "texts", "copies").join(edits, "node").mapInArrow(_repair, "head long, node long, lines string"))
    lines = lines.join(heads.select("head", "conv_id", "n"), "head")
    short = lines.where("n = 1").select("head", F.sha2(F.coalesce("lines", F.lit("")), 256).alias("repaired_sha256"))
    streamed = lines.where("n > 1").select("head", "node", "lines").repartition("head").sortWithinPartitions("head", "node").select("head", "lines")
    digests = short.unionByName(streamed.mapInArrow(_digests, "head long, repaired_sha256 string"))
    out = heads.select("head", "conv_id").join(done.drop("node", "leave", "tail"), "head").join(digests, "head")
    return out.drop("head"), lines.select("conv_id", "node", "lines")


def query(spark, sf_dir) -> DataFrame:
    return repair(damage(table(spark, sf_dir, "conversations")))[0]


def _step(cell: str, cost: str, edit: str) -> str:
    return f"CASE WHEN {cell} IS NOT NULL THEN {{'c': ({cell}).c + {cost}, 'a': ({cell}).a || {edit}}} END"


def _closed(*v: str) -> str:
    """Columns w0 to w3: cells v with the insertions after them."""
    ins = lambda c, n: _step(c, f"{2 * n}::BIGINT", f"'{'I' * n}'")
    return f"{v[0]} AS w0, {v[1]} AS w1, least({v[2]}, {ins(v[0], 1)}, {ins(v[1], 1)}, {ins(v[3], 1)}) AS w2, least({v[3]}, {ins(v[2], 1)}, {ins(v[0], 2)}, {ins(v[1], 2)}) AS w3"


def _stays(initial: str, *cells: str) -> str:
    cost, edit = f"CASE WHEN initial = '{initial}' THEN cut ELSE 2 + cut END", f"CASE WHEN initial = '{initial}' THEN 'K' ELSE 'R' END"
    return ", ".join(f"CASE WHEN NOT dead THEN {_step(c, cost, edit)} END" for c in cells)


_LAST, _D = f"right(rtrim(text, '{WHITE}'), 1)", ("3::BIGINT", "'D'")
#: The same by a recursion over each conversation's rows; the checksum is computed byte by byte.
SQL = f"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS key FROM conversations),
f AS (SELECT k.* EXCLUDE (key), xor(list_reduce(list_prepend(4294967295, list_transform(key, lambda x: ascii(x)::BIGINT)), lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8)), 4294967295) % 20 AS fate FROM k, crc),
d AS (SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM f),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS p FROM d),
r AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g, conv_id, turn, role, text, p, left(role, 1) AS initial, {_LAST} = '' AS blank,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 AS again, {_LAST} NOT IN ('', '.', '!', '?') AS open, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY p) || left(role, 1) AS pair FROM o),
e AS (SELECT *, blank OR again AS dead, open::BIGINT AS cut FROM r),
s AS (SELECT g, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate,
  count(*) FILTER (WHERE open AND NOT dead) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, max(p) AS n FROM e GROUP BY g),
z(v) AS (SELECT NULL::STRUCT(c BIGINT, a VARCHAR)),
dp AS (SELECT g, 0::BIGINT AS p, {{'c': 0::BIGINT, 'a': ''}} AS v0, v AS v1, v AS v2, v AS v3 FROM s, z
  UNION ALL SELECT g, p, {_step('w0', *_D)}, least({_step('w1', *_D)}, CASE WHEN initial = 's' THEN {_stays('s', 'w0')} END),
    least({_step('w2', *_D)}, {_stays('u', 'w0', 'w1', 'w3')}), least({_step('w3', *_D)}, {_stays('a', 'w2')})
  FROM (SELECT g, e.p, initial, dead, cut, {_closed('v0', 'v1', 'v2', 'v3')} FROM dp JOIN e USING (g) WHERE e.p = dp.p + 1)),
b AS (SELECT g, least(w0, w3) AS best FROM (SELECT g, {_closed('v0', 'v1', 'v2', 'v3')} FROM dp JOIN s USING (g) WHERE dp.p = s.n)),
l AS (SELECT g, unnest(string_split((best).a, '')) AS edit, generate_subscripts(string_split((best).a, ''), 1) AS i FROM b WHERE (best).a <> ''),
m AS (SELECT *, sum(CASE WHEN edit <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY i) AS p FROM l),
q AS (SELECT g, i, p, edit, row_number() OVER (PARTITION BY g ORDER BY i) AS pos, count(*) OVER (PARTITION BY g) AS n FROM m WHERE edit <> 'D'),
h AS (SELECT q.g, sha256(string_agg((CASE WHEN edit = 'K' THEN role WHEN (pos + n) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || (CASE WHEN edit = 'I' THEN '' ELSE text END), chr(10) ORDER BY i)) AS sha FROM q LEFT JOIN e ON e.g = q.g AND e.p = q.p GROUP BY q.g),
a AS (SELECT DISTINCT conv_id FROM conversations)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce((best).c, 0)::BIGINT AS cost, coalesce((best).a, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM a LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN b ON b.g = s.g LEFT JOIN h ON h.g = s.g"""
